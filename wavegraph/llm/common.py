"""Small helpers of the training-data operators: tables, Arrow batches of text, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of text that a Python worker gets at once. Texts may be long, so this is far below Spark's default.
BATCH_ROWS = 500
# Bytes of text that the numpy helpers look at together.
SLICE_BYTES = 1 << 18
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_at_once(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be read and handed to Python in batches of so many rows.

    Spark's reader holds a column of a batch in one array, which doubles as it grows: at its default of 4,096 rows, texts
    or packed hashes make arrays of tens of megabytes in every task.
    """
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        df.sparkSession.conf.set(name, str(rows))
    return df


def batched(df: DataFrame) -> DataFrame:
    """``df``, to be read and handed to Python in batches that stay small even if every text is long."""
    return rows_at_once(df, BATCH_ROWS)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def raw(column: pa.Array) -> pa.Array:
    """Text as bytes, without a copy."""
    return column if pa.types.is_binary(column.type) else column.cast(pa.binary())


def byte_list(column: pa.Array) -> list[bytes]:
    """Text as a list of bytes; null is empty."""
    return [x or b"" for x in raw(column).to_pylist()]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    ends = np.frombuffer(raw(column).buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        yield start, min(end, len(column))
        start = end


# One random odd multiplier and one random value for each byte: a word's hash is a polynomial in the multiplier.
_SEED = np.random.default_rng(20240607)
_BYTE_VALUES = _SEED.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up = np.full(size, _BASE[which], np.uint64)
        down = np.full(size, pow(_BASE[which], -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if size <= 4 * SLICE_BYTES:
            _POWERS[which] = have
    return have


def split_words(column: pa.Array, keep: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a slice of texts: the bytes, the words' first and end bytes, and their row.

    ``keep`` says of each byte whether it belongs to words; ``lower`` folds A to Z.
    Null has no words. Words never reach over the end of a text.
    """
    column = raw(column)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if lower:
        data = _LOWER[data]
    inside = keep[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    borders = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    begins[borders] = inside[borders]
    stops[borders - 1] = inside[borders - 1]
    first = np.flatnonzero(begins)
    return data, first, np.flatnonzero(stops) + 1, np.searchsorted(ends, first, side="right") - 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[list(BLANKS)] = False


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, the same for equal words in any task; ``which`` picks one of two independent ones."""
    if not len(first):
        return np.zeros(0, np.uint64)
    up, down = _powers(which, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[which][data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


def windows(words: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of ``size`` consecutive words of one row, and the place of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = words[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(_BASE[0]) + words[k : k + n]
        out ^= out >> np.uint64(32)
    place = np.flatnonzero(row[:n] == row[size - 1 :])
    return mix(out[place]), place
