"""Substring dedup by recompression.

Every text is a sequence of words. Recompression renames it in rounds: first each run of equal
words becomes one symbol, then in every round the symbols are dealt into left and right ones by a
hash, and each pair of a left and a right neighbour becomes one symbol. Names are hashes of what
they stand for, so they are global without a dictionary: equal passages get equal symbols in their
interior, whatever surrounds them. For every symbol the words are known that its making depends on;
if all of them lie in a window of ``window`` words, every equal window, wherever it is, has that
symbol at the same place.

So each window is filed under the longest symbol that it determines. Symbols that only one text
has cannot be in a repeated window. The windows of the others, and the few that determine no
symbol, are verified by a hash of 96 bits of their words.

Scale: texts are packed in blocks of a few megabytes in a table of the shared folder. A block
sends every distinct symbol, and later every distinct window left, once, packed by bucket of the
hash; so a symbol or window that a third of all texts has costs one entry per block, and nothing is
expanded into pairs. A bucket holds a bounded share of them, whatever the size
of the input. Three passes over the blocks: symbols, windows, result.

Defined cases: a null text has no words; texts of fewer words than a window keep all; rows with
the same id are not earlier than each other; a row with a null id is later than all others; in one
text only windows that an earlier text has are removed. The result has the id and the columns
named below, whatever other columns the documents have.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegraph.llm.blocks import LAST, SENT, among, bucket_of, by_bucket, packed_blocks, planes, shared_hashes, unpack
from wavegraph.llm.common import NOT_BLANK, batched, mix, slices, split_words, table, windows, word_hashes
from wavegraph.session import materialize, settle

WINDOW = 13
ROUNDS = 5
FIRST_ROUND = 3

_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_OTHER = np.uint64(0x9E3779B97F4A7C15)
# A multiplier for every round.
_TURN = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
# Beyond any word of a block.
_FAR = 1 << 29


class Level:
    """Symbols of one round, in order: names, how many words they cover, the words that their making depends on, and whether
    they are the last of a text."""

    def __init__(self, name, size, low, high, last) -> None:
        self.name, self.size, self.low, self.high, self.last = name, size, low, high, last

    @classmethod
    def of_runs(cls, words: np.ndarray, row: np.ndarray) -> Level:
        """Runs of equal words. That a run ends depends on the words next to it."""
        change = np.ones(len(words), bool)
        change[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(change).astype(np.int32 if len(words) < 1 << 28 else np.int64)
        end = np.append(start[1:], start.dtype.type(len(words)))
        size = end - start
        name = words[start]
        long = np.flatnonzero(size > 1)
        name[long] = mix(name[long] + size[long].astype(np.uint64) * _PAIR)
        last = np.ones(len(start), bool)
        last[:-1] = row[start[1:]] != row[start[:-1]]
        return cls(name, size, start - 1, end + 1, last)

    def paired(self, round: int) -> Level:
        """The next round. A pair depends on its two symbols alone; a symbol that stays, on the neighbour it could have joined."""
        name, last = self.name, self.last
        left = ((name ^ (name >> np.uint64(29))) * _TURN[round]) >> np.uint64(63) == 0
        joins = left & ~last
        joins[:-1] &= ~left[1:]
        joined = np.zeros(len(left), bool)
        joined[1:] = joins[:-1]
        first = np.ones(len(left), bool)
        first[1:] = last[:-1]
        # A left symbol looks to the next one, whether it joins it or not, and a right one that stays to the one before.
        stay = np.flatnonzero(~joined)
        side = left[stay]
        none = np.where(side, last[stay], first[stay])
        other = np.where(none, stay, np.where(side, stay + 1, stay - 1))
        low, high = np.minimum(self.low[stay], self.low[other]), np.maximum(self.high[stay], self.high[other])
        low[none], high[none] = -_FAR, _FAR
        pair = np.flatnonzero(joins[stay])
        at = stay[pair]
        name, size, last = name[stay], self.size[stay], last[stay]
        name[pair] = mix(self.name[at] * _PAIR + self.name[at + 1] * _OTHER + np.uint64(round))
        size[pair] += self.size[at + 1]
        last[pair] = self.last[at + 1]
        return Level(name, size, low, high, last)


def anchors(words: np.ndarray, row: np.ndarray, window: int, rounds: int = ROUNDS, first: int = FIRST_ROUND) -> np.ndarray:
    """For every place, a name of the longest symbol that the window beginning there determines; 0 if there is none.

    Among equally long ones the largest name counts, so that equal windows choose alike: names have the size in their upper bits.
    """
    if not len(words):
        return np.zeros(0, np.uint64)
    level = Level.of_runs(words, row)
    # A symbol counts for a run of places. It is entered at two of a power of two, which cover the run, and handed down to the halves.
    best = [np.zeros(len(words), np.uint64) for _ in range(window.bit_length())]
    for round in range(1, rounds + 1):
        level = level.paired(round)
        if round < first:
            continue
        start, stop = np.maximum(level.high - window, 0), level.low + 1
        inside = np.flatnonzero(start < stop)
        start, stop = start[inside], stop[inside]
        size = np.minimum(level.size[inside], 31).astype(np.uint64)
        name = (size << np.uint64(59)) | (level.name[inside] >> np.uint64(5)) | np.uint64(1)
        length = stop - start
        for k, table in enumerate(best):
            some = np.flatnonzero((length >> k) == 1)
            np.maximum.at(table, start[some], name[some])
            np.maximum.at(table, stop[some] - (1 << k), name[some])
    for k in range(len(best) - 1, 0, -1):
        half = 1 << (k - 1)
        np.maximum(best[k - 1], best[k], out=best[k - 1])
        np.maximum(best[k - 1][half:], best[k][:-half], out=best[k - 1][half:])
    return best[0]


class _Block:
    """The words of a block: a hash of each, the row of each, and the windows; to ``verify`` them, two hashes of each window and its owner."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, window: int, verify: bool = True) -> None:
        self.ids, self.texts = ids, texts
        one, two, rows = [], [], []
        for start, stop in slices(self.texts):
            data, first, end, row = split_words(self.texts.slice(start, stop - start), NOT_BLANK, lower=False)
            one.append(word_hashes(data, first, end, 0))
            if verify:
                two.append(word_hashes(data, first, end, 1))
            rows.append(row + start)
        self.words, self.row = np.concatenate(one), np.concatenate(rows)
        if verify:
            self.hash, self.place = windows(self.words, self.row, window)
            self.check = (windows(np.concatenate(two), self.row, window)[0] >> np.uint64(32)).astype(np.uint32)
            self.owner = self.ids[self.row[self.place]]
        else:
            self.place = np.flatnonzero(self.row[: max(0, len(self.row) - window + 1)] == self.row[window - 1 :])


def _equal(hash: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows lie together, ascending by hash and check, and where each run of equal ones starts."""
    order = np.argsort(hash)
    twin = hash[order[1:]] == hash[order[:-1]]
    differ = check[order[1:]] != check[order[:-1]]
    if (twin & differ).any():
        order = np.lexsort((check, hash))
        twin = hash[order[1:]] == hash[order[:-1]]
        differ = check[order[1:]] != check[order[:-1]]
    new = np.ones(len(order), bool)
    new[1:] = ~twin | differ
    return order, np.flatnonzero(new)


def _columns(data: bytes) -> tuple[np.ndarray, ...]:
    """The four packed columns: hash, check, twice, and the planes of first."""
    n, at, out = len(data) // 21, 0, []
    for kind in ("<u8", "<u4", "u1"):
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(data, kind, n, at))
        at += n * width
    first = np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T
    return *out, np.ascontiguousarray(first).view("<i8").reshape(n)


def _first_texts(group: pd.DataFrame) -> pd.DataFrame:
    """To each block, the windows of its that also are in an earlier text, with the first text's id."""
    parts = [_columns(d) for d in group["data"]]
    sizes = [len(p[0]) for p in parts]
    hash, check, twice, first = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order, start = _equal(hash, check)
    least = np.empty(len(order), np.int64)
    if len(start):
        least[order] = np.repeat(np.minimum.reduceat(first[order], start), np.diff(np.append(start, len(order))))
    keep = (least < first) | (twice == 1)
    out, at = [], 0
    for n in sizes:
        k = slice(at, at + n)
        mine = keep[k]
        out.append(b"".join(c[k][mine].T.tobytes() for c in (hash, check, twice, planes(least))))
        at += n
    return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "data": out})


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, removed (spans of words: first, end) and kept (the text that stays)."""
    blocks, buckets = packed_blocks(docs, id, text)

    def symbols(ids: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        block = _Block(ids, texts, window, verify=False)
        names = anchors(block.words, block.row, window)[block.place]
        return names[names != 0], block.row[block.place][names != 0]

    def candidates(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for number, blob in zip(left["block"], left["blob"]):
            block = _Block(*unpack(blob), window)
            names = anchors(block.words, block.row, window)[block.place]
            known = np.concatenate([np.zeros(1, np.uint64), *(np.frombuffer(d, np.uint64) for d in right["data"])])
            used = among(names, known)
            hash, check, owner = block.hash[used], block.check[used], block.owner[used]
            order, start = _equal(hash, check)
            if len(start):
                hash, check, owner = hash[order[start]], check[order[start]], owner[order]
                least = np.minimum.reduceat(owner, start)
                twice = (np.maximum.reduceat(owner, start) > least).astype(np.uint8)
                rows += by_bucket(int(number), bucket_of(hash, buckets), hash, check, twice, planes(least))
        return pd.DataFrame(rows, columns=["block", "bucket", "data"])

    def sent() -> DataFrame:
        shared = materialize(shared_hashes(blocks, buckets, symbols))
        return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(candidates, SENT)

    # What was sent is stored, so that it is never on the disks together with all that led to it.
    repeated = settle(lambda: settle(sent).groupBy("bucket").applyInPandas(_first_texts, SENT))

    def result(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        parts = [_columns(d) for d in right["data"]]
        known = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in ((0, np.uint64), (1, np.uint32), (3, np.int64))]
        order = _equal(known[0], known[1])[0]
        hash, check, first = (k[order] for k in known)
        for blob in left["blob"]:
            block = _Block(*unpack(blob), window)
            hit = np.zeros(len(block.hash), bool)
            if len(hash):
                # Two windows of one hash but another check lie next to each other; few steps find the right one.
                at = np.searchsorted(hash, block.hash)
                todo = np.flatnonzero(at < len(hash))
                todo = todo[hash[at[todo]] == block.hash[todo]]
                while len(todo):
                    same = check[at[todo]] == block.check[todo]
                    hit[todo[same]] = first[at[todo[same]]] < block.owner[todo[same]]
                    todo = todo[~same]
                    at[todo] += 1
                    todo = todo[at[todo] < len(hash)]
                    todo = todo[hash[at[todo]] == block.hash[todo]]
            change = np.zeros(len(block.words) + window + 1, np.int32)
            np.add.at(change, block.place[hit], 1)
            np.add.at(change, block.place[hit] + window, -1)
            gone = np.cumsum(change)[: len(block.words)] > 0
            ends = np.searchsorted(block.row, np.arange(len(block.ids) + 1))
            for k, (ident, body) in enumerate(zip(block.ids.tolist(), block.texts.to_pylist())):
                mine = gone[ends[k] : ends[k + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                words = body.split()
                kept = [w for w, g in zip(words, mine.tolist()) if not g] if len(edges) else words
                out.append((None if ident == LAST else ident, len(words), int(mine.sum()), edges.reshape(-1, 2).tolist(), b" ".join(kept).decode("utf-8", "replace")))
        frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "removed", "kept"])
        return frame.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_words long, n_removed long, removed array<array<long>>, kept string"
    found = blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInPandas(result, schema)
    batched(docs)
    return found


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE first < doc_id),
k AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM r GROUP BY 1),
e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
t AS (
  SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.p) AS kept
  FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.p = r.p WHERE r.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""
