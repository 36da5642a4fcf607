"""Texts packed in blocks, and the exchange of hashes between blocks through buckets.

A block is a row with some megabytes of texts. What blocks have in common is found without a row
per item: a block sends its distinct hashes once, packed by bucket, and a bucket answers each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegraph.llm.common import batched, mix, raw, rows_at_once, slices
from wavegraph.session import materialize

BLOCK_BYTES = 2 << 20
BUCKET_WORDS = 1_000_000
# A block's number has the task in its upper bits; with the row inside the block it still fits 63 bits, for 2^27 tasks.
TASK_BITS, ROW_BITS = 16, 20
LAST = np.iinfo(np.int64).max
SENT = "block long, bucket long, data binary"


def _pack(ids: np.ndarray, texts: pa.Array) -> bytes:
    batch = pa.record_batch([pa.array(ids, pa.int64()), texts], names=["id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> tuple[np.ndarray, pa.Array]:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    return batch.column(0).to_numpy(), batch.column(1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack texts into blocks."""
    task = TaskContext.get().partitionId() << TASK_BITS
    number = rows = 0
    held: list[tuple[np.ndarray, pa.Array]] = []
    size = 0

    def packed() -> pa.RecordBatch:
        ids = np.concatenate([h[0] for h in held])
        texts = pa.concat_arrays([h[1] for h in held])
        numbers = [pa.array([x], pa.int64()) for x in (task + number, len(ids), size)]
        return pa.RecordBatch.from_arrays([*numbers, pa.array([_pack(ids, texts)], pa.binary())], names=["block", "rows", "chars", "blob"])

    for batch in batches:
        ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
        texts = raw(batch.column(1)).fill_null(b"")
        for start, stop in slices(texts, BLOCK_BYTES):
            part = texts.slice(start, stop - start)
            held.append((ids[start:stop], part))
            size += part.nbytes
            rows += len(part)
            if size >= BLOCK_BYTES or rows + batch.num_rows > 1 << ROW_BITS:
                yield packed()
                number, held, size, rows = number + 1, [], 0, 0
                if number >> TASK_BITS:
                    raise ValueError("a task has too much text; read the table in more partitions")
    if held:
        yield packed()


def by_bucket(block: int, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows (block, bucket, packed columns); the columns come sorted, and stay so in a bucket.

    A column of ``planes`` is packed plane by plane.
    """
    if not len(bucket):
        return
    # Numbers of 16 bits are sorted by counting.
    short = bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket
    order = np.argsort(short, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        yield block, int(bucket[start]), b"".join(c[start:stop].T.tobytes() for c in columns)


def planes(numbers: np.ndarray) -> np.ndarray:
    """The bytes of 64-bit numbers, a row each. By planes, those that are zero in all numbers take next to no room in a shuffle."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8)


def among(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``names`` are in ``known``."""
    return pc.is_in(pa.array(names), value_set=pa.array(known)).to_numpy(zero_copy_only=False)


_SENT_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])


def bucket_of(hash: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hash) % np.uint64(buckets)).astype(np.int64)


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """Of the hashes of a bucket, those that two texts have; to each block its own. The lowest bit says "twice in the block".

    The parts of all blocks are sorted together, once: a bucket has as many parts as there are blocks.
    """
    parts = [np.frombuffer(d, np.uint64) for d in group["data"]]
    every = np.concatenate(parts)
    names = every | np.uint64(1)
    order = np.argsort(names)
    new = np.ones(len(names), bool)
    new[1:] = names[order[1:]] != names[order[:-1]]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(names)))
    shared = (count > 1) | (np.bitwise_or.reduceat(every[order] & np.uint64(1), start) == 1)
    keep = np.empty(len(names), bool)
    keep[order] = np.repeat(shared, count)
    ends = np.cumsum([len(p) for p in parts]).tolist()
    mine = [names[a:b][keep[a:b]].tobytes() for a, b in zip([0, *ends], ends)]
    return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "data": mine})


def few_at_once(df: DataFrame) -> DataFrame:
    """``df``, to be read and handed to Python in batches of few rows, as each is a block; ``batched`` sets this back."""
    return rows_at_once(df, 4)


def packed_blocks(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, int]:
    """The texts in blocks, as a table of the shared folder, and how many buckets their hashes need.

    From here on Python gets few rows at once, as each is a block; ``batched`` sets this back.
    """
    plain = batched(docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")))
    blocks = materialize(plain.mapInArrow(_blocks, "block long, rows long, chars long, blob binary"))
    few_at_once(blocks)
    size = blocks.agg(F.sum("chars")).first()[0] or 0
    return blocks, max(1, -(-int(size) // (6 * BUCKET_WORDS)))


def shared_hashes(
    blocks: DataFrame, buckets: int, hashes: Callable[[np.ndarray, pa.Array], tuple[np.ndarray, np.ndarray]]
) -> DataFrame:
    """To each block, those of its hashes that at least two texts have, packed by bucket; all are odd.

    ``hashes`` gives for the ids and texts of a block the hashes (not 0) and the text of each.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(3)):
                names, row = hashes(*unpack(blob.as_py()))
                names = names | np.uint64(1)
                order = np.argsort(names)
                names, row = names[order], row[order]
                new = np.ones(len(names), bool)
                new[1:] = names[1:] != names[:-1]
                start = np.flatnonzero(new)
                if not len(start):
                    continue
                twice = np.maximum.reduceat(row, start) > np.minimum.reduceat(row, start)
                bucket = bucket_of(names[start], buckets)
                rows = list(by_bucket(number, bucket, (names[start] & ~np.uint64(1)) | twice.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SENT_ARROW.types)], schema=_SENT_ARROW)

    return blocks.mapInArrow(send, SENT).groupBy("bucket").applyInPandas(_shared, SENT)
