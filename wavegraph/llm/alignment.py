"""Cross-tokenizer alignment by runs along a diagonal.

A text is encoded by two tokenizers whose tokens cover the same bytes: A, byte-level BPE, on a blank
and the text, and B, pieces with byte fallback, which adds the blank itself. Where a token of A and
a token of B end at the same byte, the text is cut; what lies between two cuts is a group, and all
its tokens of A are linked with all its tokens of B.

The cuts are found by skipping runs: while groups have one token on either side, the arrays of token
ends agree at a fixed shift of the indices, a diagonal. Slices twice as long each time are compared
at that shift until one differs, and halving slices find where. An irregular group is then walked
token by token to its end, and the shift becomes what the group left behind.

Pairs of token ids are counted by the documents that hold them linked, and every document gets the
sums over its links.

Scale: texts are neither shuffled nor kept; of each document its digest, its numbers and its
distinct pairs stay, packed, in a table of the shared folder. A task adds up the pairs of its documents
before they are shuffled. The most frequent pairs, at most ``HELD_PAIRS``, are broadcast, so that no
frequent pair is shuffled per document; rarer ones are joined. A group of any size is linked by the
distinct ids on either side.

Defined cases: a text that is null or empty, or that a tokenizer does not give back byte for byte, has
no tokens, zeros and an empty group text; bytes that are not UTF-8 count as U+FFFD; special tokens'
strings in a text are plain text; repeated rows count as documents of their own; extra columns may
have any names, except that the text goes and a column named like the result is replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegraph.llm.bpe import _byte_symbols
from wavegraph.llm.common import batched, byte_list, slices, table
from wavegraph.session import materialize

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
# Token ends that are compared as Python lists together; a group longer than that takes longer lists.
WINDOW = 1 << 16
# Links of a group above which its ids are made distinct before they are linked.
CROSSED = 4096
# Distinct pairs that a task adds up before it hands them on.
SUMMED = 4_000_000
# The most pairs that are sent to every executor, of 17 bytes each.
HELD_PAIRS = 2_000_000


class Tokenizers:
    """Both tokenizers, made from the contents of their files, and what their tokens stand for."""

    def __init__(self, a_json: bytes, b_model: bytes) -> None:
        byte = {s: b for b, s in enumerate(_byte_symbols())}
        ranks = {bytes(byte[c] for c in token): n for token, n in json.loads(a_json)["model"]["vocab"].items()}
        # The same vocabulary and pattern in a faster library; no string is special to it.
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, n in ranks.items():
            self.a_bytes[n] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_length = np.array([len(t) for t in self.a_bytes])
        self.b_length = np.array([len(t) for t in self.b_bytes])
        self.a_size, self.b_size = len(self.a_bytes), len(self.b_bytes)
        # A token's id and what follows it: a comma inside a group; after A's part a bar, after B's a semicolon.
        self.words = np.array(
            [f"{i}{end}" for size, ends in ((self.a_size, ",|"), (self.b_size, ",;")) for end in ends for i in range(size)], object
        )

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of each text by A and by B; None where it has no tokens."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        for text, b in zip(plain, self.b.encode(plain, num_threads=1)):
            whole = b" " + text.encode()
            if not text or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
                yield None
                continue
            # Every byte has a token of A, so that A gives back each text; the lengths are compared all the same.
            a = self.a.encode_to_numpy(" " + text).astype(np.int64)
            yield (a, np.array(b, np.int64)) if self.a_length[a].sum() == len(whole) else None


def _runs(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Runs of cuts in two lists of token ends, up to the last cut that both have: a run's first cut, as tokens of A
    and of B before it, and its length; in a run, each next cut is one token further on either side."""
    i = j = 0
    n, m = len(a), len(b)
    first_a: list[int] = []
    first_b: list[int] = []
    lengths: list[int] = []
    while i < n and j < m:
        x, y = a[i], b[j]
        if x == y:
            first_a.append(i + 1)
            first_b.append(j + 1)
            u, v, step, most = i + 1, j + 1, 4, min(n - i, m - j) + i
            while u + step <= most and a[u : u + step] == b[v : v + step]:
                u += step
                v += step
                step *= 2
            while step > 1:
                step //= 2
                if u + step <= most and a[u : u + step] == b[v : v + step]:
                    u += step
                    v += step
            lengths.append(u - i)
            i, j = u, v
            continue
        while x != y:
            if x < y:
                i += 1
                if i == n:
                    return first_a, first_b, lengths
                x = a[i]
            else:
                j += 1
                if j == m:
                    return first_a, first_b, lengths
                y = b[j]
        i += 1
        j += 1
        first_a.append(i)
        first_b.append(j)
        lengths.append(1)
    return first_a, first_b, lengths


def cuts(a: np.ndarray, b: np.ndarray, window: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For ends of tokens over the same bytes: after how many tokens of A and of B the groups end."""
    found_a, found_b = [], []
    i = j = 0
    window = window or WINDOW
    while i < len(a):
        first_a, first_b, lengths = _runs(a[i : i + window].tolist(), b[j : j + window].tolist())
        if not lengths:
            window *= 2
            continue
        length = np.array(lengths)
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        found_a.append(np.repeat(np.array(first_a), length) + step + i)
        found_b.append(np.repeat(np.array(first_b), length) + step + j)
        i, j = int(found_a[-1][-1]), int(found_b[-1][-1])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))


def linked(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, b_size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct linked pairs of ids, as id of A * ``b_size`` + id of B, ascending, and how often each is linked."""
    n, m = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    size = n * m
    few = np.flatnonzero(size <= CROSSED)
    each = size[few]
    group = np.repeat(few, each)
    place = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each)
    first, second = (cut_a - n)[group] + place // m[group], (cut_b - m)[group] + place % m[group]
    pairs, times = np.unique(a[first] * b_size + b[second], return_counts=True)
    for g in np.flatnonzero(size > CROSSED):
        x, nx = np.unique(a[cut_a[g] - n[g] : cut_a[g]], return_counts=True)
        y, ny = np.unique(b[cut_b[g] - m[g] : cut_b[g]], return_counts=True)
        pairs = np.concatenate([pairs, (x[:, None] * b_size + y[None, :]).ravel()])
        times = np.concatenate([times, (nx[:, None] * ny[None, :]).ravel()])
        pairs, times = _summed(pairs, times)
    return pairs, times


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    start = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return keys[order][start], np.add.reduceat(values[order], start) if len(start) else values


def group_text(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, both: Tokenizers) -> str:
    """The groups as ``a1,a2|b1;a3|b2,b3``."""
    n, m = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[cut_a - 1] = last_b[cut_b - 1] = 1
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.repeat(cut_b - m, n)] = a + last_a * both.a_size
    out[np.arange(len(b)) + np.repeat(cut_a, m)] = b + last_b * both.b_size + 2 * both.a_size
    return "".join(both.words[out].tolist())[:-1]


def _pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending pairs as steps, the bytes of equal weight together, which a file's compression makes small."""
    step = np.diff(pairs, prepend=0).astype(np.uint32)
    return np.concatenate([step, times.astype(np.uint32)]).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


_MADE: dict[bytes, Tokenizers] = {}


def tokenizers_of(a_json: bytes, b_model: bytes) -> Tokenizers:
    """Both tokenizers, made once in each Python process."""
    key = hashlib.sha256(a_json + b_model).digest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Tokenizers(a_json, b_model)
    return _MADE[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def align(
    docs: DataFrame, text: str = "text", out: str = "aligned", a_path: str | None = None, b_path: str | None = None, full: bool = False
) -> DataFrame:
    """``docs`` without ``text``, and a struct ``out``: n_a, n_b, n_groups, n_links, groups, n_best, count_sum.

    ``groups`` is the SHA-256 of the groups' text in hexadecimal, or with ``full`` the text itself; empty
    without tokens. ``n_best`` is the links whose pair is the most widely held of its id of A, and
    ``count_sum`` the sum, over all links, of the documents that hold their pair.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast(
        (_read(a_path or public_tokenizers.path(A_FILE)), _read(b_path or public_tokenizers.path(B_FILE)))
    )
    b_size = sentencepiece.SentencePieceProcessor(model_proto=files.value[1]).get_piece_size()
    others = [c for c in docs.columns if c not in (text, out)]
    row = F.struct(F.monotonically_increasing_id().alias("row"), *([F.struct(*(docs[c] for c in others)).alias("own")] if others else []))
    plain = docs.select(row.alias("doc"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers_of(*files.value)
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                numbers, groups, packed = [], [], []
                for found in both.encode(byte_list(batch.column(1).slice(start, stop - start))):
                    if found is None:
                        numbers.append((0, 0, 0, 0))
                        groups.append("")
                        packed.append(b"")
                        continue
                    a, b = found
                    cut_a, cut_b = cuts(np.cumsum(both.a_length[a]), np.cumsum(both.b_length[b]))
                    pairs, times = linked(a, b, cut_a, cut_b, b_size)
                    numbers.append((len(a), len(b), len(cut_a), int(times.sum())))
                    said = group_text(a, b, cut_a, cut_b, both)
                    groups.append(said if full else hashlib.sha256(said.encode()).hexdigest())
                    packed.append(_pack(pairs, times))
                columns = np.array(numbers, np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), *map(pa.array, columns), pa.array(groups), pa.array(packed, pa.binary())],
                    names=["doc", *_NUMBERS, "groups", "pairs"],
                )

    schema = plain.select("doc").schema
    for name in _NUMBERS:
        schema = schema.add(name, "long")
    found = materialize(batched(plain).mapInArrow(run, schema.add("groups", "string").add("pairs", "binary")), codec="zstd")
    summed = _with_sums(found, pair_counts(found.select("pairs"), b_size))
    own = [F.col("doc.own")[c].alias(c) for c in others]
    return summed.select(*own, F.struct(*_NUMBERS, "groups", "n_best", "count_sum").alias(out))


def pair_counts(packed: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best) from a column of packed pairs: how many rows hold each pair, and whether no pair of the same id of A has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(_unpack(data)[0])
                size += len(held[-1])
                if size >= SUMMED:
                    yield summed(held)
                    held, size = [], 0
        if size:
            yield summed(held)

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    counted = materialize(packed.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    counted = counted.withColumn("a", F.expr(f"pair div {b_size}"))
    # As many rows as A has tokens, at most.
    top = counted.groupBy("a").agg(F.max("n").alias("top"))
    return counted.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _with_sums(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``found`` with n_best and count_sum. The most frequent pairs are looked up in a broadcast, the others by a join."""
    digits = F.length(F.bin("n"))
    spread = {r["digits"]: r["rows"] for r in counts.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    least, held = max(spread, default=0) + 1, 0
    while least > 1 and held + spread.get(least - 1, 0) <= HELD_PAIRS:
        least -= 1
        held += spread.get(least, 0)
    few = counts.where(digits >= least).toArrow()
    pairs, n, best = (few.column(k).to_numpy() for k in range(3))
    order = np.argsort(pairs)
    hot = found.sparkSession.sparkContext.broadcast((pairs[order], n[order], best[order].astype(bool)))

    def known(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A row's pairs and times; for those in the broadcast, where they are there, and which they are."""
        mine, times = _unpack(data)
        at = np.searchsorted(hot.value[0], mine)
        have = at < len(hot.value[0])
        have[have] = hot.value[0][at[have]] == mine[have]
        return mine, times, at, have

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((2, batch.num_rows), np.int64)
            for k, data in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                _, times, at, have = known(data)
                out[:, k] = times[have] @ hot.value[2][at[have]], times[have] @ hot.value[1][at[have]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(out[0]), pa.array(out[1])], names=[*batch.schema.names[:-1], "n_best", "count_sum"]
            )

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine, times, _, have = known(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int((~have).sum()), row)), pa.array(mine[~have]), pa.array(times[~have])], names=["row", "pair", "times"]
                )

    schema = found.drop("pairs").schema.add("n_best", "long").add("count_sum", "long")
    whole = found.mapInArrow(sums, schema)
    if least <= min(spread, default=0):
        return whole
    rest = (
        found.select("doc.row", "pairs").mapInArrow(rare, "row long, pair long, times long")
        .join(counts.where(digits < least), "pair")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    )
    return whole.join(rest, whole["doc.row"] == rest["row"], "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
    })


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = {"groups": "groups_sha256"}
    kept = (*_NUMBERS, "n_best", "count_sum", "groups")
    return found.select("doc_id", *(F.col(f"aligned.{c}").alias(names.get(c, c)) for c in kept))
