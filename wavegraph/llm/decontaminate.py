"""Benchmark decontamination with a generalised suffix automaton.

All items of the benchmark, as sequences of words, go into one automaton. The words of each
document are streamed through it; at every word the state holds the longest suffix read so far
that occurs in some item. Where that match is a whole window (``window`` words, or all words of a
shorter item), the words of the window are hit. A document is contaminated when its hit words
reach the share ``coverage``.

Scale: documents are neither shuffled nor split. The automaton holds at most ``shard_words`` item
words, whatever the benchmark's size: a larger benchmark is dealt into shards by a hash of the
item, and the documents pass the shards one after another, over tables in the shared folder.

Defined cases: a null text has no words; an item without words does nothing; an item with a null
id still hits and counts as the item with the empty id; repeated items are one item; documents
that repeat are judged one by one; the other columns of the documents may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavegraph.llm.common import UPPER, batched, byte_list, table
from wavegraph.session import materialize

WINDOW = 13
COVERAGE = 0.05
SHARD_WORDS = 200_000
PIECE_WORDS = 20_000

# Letters, digits and all bytes of characters beyond ASCII are parts of words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same in text that is not folded: a word with what follows it up to the next, and what comes before the first.
_PART = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
_LEAD = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items that each window occurs in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[tuple[int, int, str]] = []
        shortest = window
        for name, words in items:
            state = 0
            for n, word in enumerate(words, 1):
                state = self._add(state, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if n >= window or n == len(words):
                    ends.append((state, min(n, window), name))
            shortest = min(shortest, len(words) or window)
        self.least = b"\x01" * shortest
        self._place(ends)

    def _add(self, last: int, token: int) -> int:
        known = self.step[last].get(token)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, token, known)
        new = len(self.link)
        self.step.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        at = last
        while at >= 0 and token not in self.step[at]:
            self.step[at][token] = new
            at = self.link[at]
        if at >= 0:
            target = self.step[at][token]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._clone(at, token, target)
        return new

    def _clone(self, at: int, token: int, target: int) -> int:
        copy = len(self.link)
        self.step.append(dict(self.step[target]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[target])
        self.link[target] = copy
        while at >= 0 and self.step[at].get(token) == target:
            self.step[at][token] = copy
            at = self.link[at]
        return copy

    def _place(self, ends: list[tuple[int, int, str]]) -> None:
        """For each state, the windows that end there: their lengths, longest first, and their items."""
        own: dict[int, dict[int, set[str]]] = {}
        for state, size, name in ends:
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            own.setdefault(state, {}).setdefault(size, set()).add(name)
        self.found: list[tuple] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            mine = sorted(own.get(state, {}).items(), reverse=True)
            self.found[state] = (*mine, *self.found[self.link[state]]) if mine else self.found[self.link[state]]

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """Hit spans (first word, end), the items that hit, and the longest match in words."""
        spans: list[list[int]] = []
        items: set[str] = set()
        longest = 0
        known = bytes(map(self.vocabulary.__contains__, words))
        start = known.find(self.least)
        while start >= 0:
            stop = known.find(b"\x00", start)
            stop = len(words) if stop < 0 else stop
            state = length = 0
            for at in range(start, stop):
                token = self.vocabulary[words[at]]
                while state and token not in self.step[state]:
                    state = self.link[state]
                    length = self.length[state]
                state = self.step[state][token]
                length += 1
                longest = max(longest, length)
                for size, names in self.found[state]:
                    if size <= length:
                        items |= names
                        if spans and at - size + 1 <= spans[-1][1]:
                            while len(spans) > 1 and at - size + 1 <= spans[-2][1]:
                                spans.pop()
                            spans[-1] = [min(spans[-1][0], at - size + 1), at + 1]
                        else:
                            spans.append([at - size + 1, at + 1])
            start = known.find(self.least, stop)
        return spans, items, longest


def _union(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _shards(items: DataFrame, item_id: str, text: str, window: int, shard_words: int) -> Iterator[list]:
    """The items in shards of about ``shard_words`` words; long items in pieces that overlap by a window."""
    folded = F.translate(F.col(text), UPPER, UPPER.lower())
    named = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"),
        F.regexp_extract_all(folded, F.lit(_WORD), F.lit(0)).alias("words"),
    ).where(F.size("words") > 0)
    piece = max(PIECE_WORDS, 2 * window)
    pieces = named.select(
        "name",
        "words",
        F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1), F.lit(piece - window + 1))).alias("at"),
    ).select("name", "at", F.expr(f"slice(words, at, {piece})").alias("words"))
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    count = max(1, -(-total // shard_words))
    for k in range(count):
        part = pieces.where(F.pmod(F.xxhash64("name", "at"), F.lit(count)) == k) if count > 1 else pieces
        yield [(r["name"], [w.encode() for w in r["words"]]) for r in part.select("name", "words").collect()]


def scan(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    coverage: float = COVERAGE,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` with a struct column ``hit``: n_words, n_hit, spans (first word, end), items, longest, contaminated."""
    kind = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()), T.StructField("contaminated", T.BooleanType()),
    ])
    arrow = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))),
        ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("contaminated", pa.bool_()),
    ])
    base = [c for c in docs.columns if c != "hit"]
    at = base.index(text)
    out = T.StructType([*(docs.schema[c] for c in base), T.StructField("hit", kind)])

    def passed(shared, again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                rows = []
                before = batch.column(len(base)).to_pylist() if again else [None] * batch.num_rows
                for body, old in zip(byte_list(batch.column(at)), before):
                    words = words_of(body)
                    spans, names, longest = automaton.scan(words)
                    if old:
                        spans, names = _union(spans, old["spans"]), names.union(old["items"])
                        longest = max(longest, old["longest"])
                    hit = sum(e - s for s, e in spans)
                    rows.append({
                        "n_words": len(words), "n_hit": hit, "spans": spans, "items": sorted(names), "longest": longest,
                        "contaminated": hit > 0 and hit >= coverage * len(words),
                    })
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(base)], pa.array(rows, arrow)], names=[f.name for f in out]
                )

        return run

    spark = docs.sparkSession
    frame, again = batched(docs.select(*(docs[c] for c in base))), False
    for shard in _shards(items, item_id, item_text, window, shard_words):
        if again:
            frame = materialize(frame)
        frame = frame.mapInArrow(passed(spark.sparkContext.broadcast(Automaton(shard, window)), again), out)
        again = True
    return frame


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, unchanged, with all their columns."""
    found = scan(docs.withColumnRenamed("hit", "_their_hit"), items, **options)
    return found.where(~F.col("hit.contaminated")).drop("hit").withColumnRenamed("_their_hit", "hit")


def cut_spans(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents below the coverage limit, with every hit span cut out of their text.

    A span goes with what separates it from the word after it; all text outside the spans is unchanged.
    """
    found = scan(docs.withColumnRenamed("hit", "_their_hit"), items, text=text, **options).where(~F.col("hit.contaminated"))
    # What comes before the first word, then each word with what separates it from the next one.
    parts = F.regexp_extract_all(F.col(text), F.lit(_PART), F.lit(0))
    lead = F.regexp_extract(F.col(text), _LEAD, 0)
    kept = F.filter(parts, lambda w, i: ~F.exists("hit.spans", lambda s: (i >= s[0]) & (i < s[1])))
    changed = F.when(F.size("hit.spans") > 0, F.concat(lead, F.array_join(kept, ""))).otherwise(F.col(text))
    return found.withColumn(text, changed).drop("hit").withColumnRenamed("_their_hit", "hit")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = scan(docs, table(spark, sf_dir, "benchmark"))
    return hit.select(
        "doc_id",
        F.col("hit.n_words").alias("n_words"),
        F.col("hit.n_hit").alias("n_hit"),
        F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"),
        F.col("hit.contaminated").alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bl)),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bl) WHERE len(w) >= m)),
hits AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY 1),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
  sha256(coalesce(it.s, '')) AS items_sha256,
  coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
