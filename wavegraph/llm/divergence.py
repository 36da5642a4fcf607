"""Source divergence audit with a frequent-pattern tree of term rows.

Within a language, every source is a smoothed distribution over the language's kept terms. Two
sources differ by the sum, over all kept terms, of (p - q)^2 / (p + q), each rounded down, in whole
numbers of which ``SCALE`` make 1. A term that neither source has adds the same value each time, and
a term that one of them has adds a value that depends on its count alone. So the sum is

    kept terms * base + corrections of single counts + corrections of pairs of counts

Single counts are few: one row for each distinct count of a source. The pairs come from a
frequent-pattern tree: a term's row is its nonzero counts, the source with the most terms first;
equal rows are one row with a multiplicity; rows are inserted in order, so that rows which begin
alike share a path; a node's correction against each of its ancestors is computed once and
multiplied by the terms that pass the node. Pairs with a zero are never touched.

Scale: a task counts its documents' terms before any shuffle. Rows are dealt by range of their
whole pattern, so a language that holds a third of all terms is cut like any other; each task builds
the trees of ``BLOCK_ENTRIES`` counts at a time, and what a cut separates only loses some sharing. All
numbers are 64-bit integers or decimals; nothing is rounded twice. The result itself has a row for
every two sources of a language.

Defined cases: null text, language and source are the empty string; a language without kept terms
has pairs of value 0; a source without terms takes part with zero counts; documents that repeat
count each time; other columns of the documents are not read and may have any names; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavegraph.llm.common import batched, byte_list, table
from wavegraph.operators.skew import BROADCAST_ROWS, small_side
from wavegraph.session import materialize

SCALE = 1_000_000_000
PRIOR = 2
LEAST_DOCS = 10
TOP = 10
# Distinct terms that a task holds before it hands them on, and bytes of one text looked at together.
HELD_TERMS = 400_000
PIECE_BYTES = 1 << 20
# Counts whose tree is built together.
BLOCK_ENTRIES = 1 << 18
SALTS = 32

# Letters, and all bytes of characters beyond ASCII, are parts of terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    start = 0
    while start < len(text):
        end = start + PIECE_BYTES
        if end < len(text):
            while end < len(text) and _FOLD[text[end]] != 32:
                end += 1
        yield text[start:end].translate(_FOLD).split()
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, summed over what the task has seen."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in held.items():
            n = len(count)
            if n:
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                    pa.array(list(count), pa.binary()).view(pa.string()), pa.array(list(count.values()), pa.int64()),
                    pa.array([docs[t] for t in count], pa.int64()),
                ], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    new = 0
    for batch in batches:
        for text, lang, source in zip(byte_list(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            count, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            before = len(count)
            for words in _pieces(text):
                count.update(words)
                seen.update(words)
            docs.update(seen)
            new += len(count) - before
            if new > HELD_TERMS:
                yield from flush()
                new = 0
    yield from flush()


def divergence_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _f(p: str, q: str) -> Column:
    """``divergence_of`` for columns. Shares are at most ``SCALE`` + 1, so that the square fits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _share(n: str, size: str) -> Column:
    """The smoothed share of a term with ``n`` occurrences; null if the language has no terms."""
    return F.expr(f"1 + (cast({n} + {PRIOR} as decimal(19, 0)) * {SCALE}) div nullif({size}, 0)")


def _tree(lang: np.ndarray, cut: np.ndarray, rank: np.ndarray, p: np.ndarray, p0: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
    """Insert sorted rows into trees, one for a language; (language, source, source, sum of the pairs' corrections).

    Row i is the entries cut[i] to cut[i + 1], and stands for many[i] terms.
    """
    length = np.diff(cut)
    shared = np.zeros(len(lang), bool)
    shared[1:] = lang[1:] == lang[:-1]
    node_of_row = np.full(len(lang), -1)
    entry, passes, parent, tongue, made = [], [], [], [], 0
    for depth in range(int(length.max(initial=0))):
        row = np.flatnonzero(length > depth)
        at, before = cut[row] + depth, cut[np.maximum(row - 1, 0)] + depth
        old = shared[row] & (length[row - 1] > depth) & (rank[at] == rank[before]) & (p[at] == p[before])
        shared[row] = old
        first = np.flatnonzero(~old)
        entry.append(at[first])
        passes.append(np.add.reduceat(many[row], first))
        parent.append(node_of_row[row[first]])
        tongue.append(lang[row[first]])
        node_of_row[row] = made + np.cumsum(~old) - 1
        made += len(first)
    if not made:
        return [np.zeros(0, np.int64)] * 4
    at, passes, parent, tongue = (np.concatenate(x) for x in (entry, passes, parent, tongue))
    rank, p, p0 = rank[at].astype(np.int64), p[at], p0[at]
    wide = int(rank.max()) + 1
    keys, values, node, above, size = [], [], np.arange(made), parent, 0
    while True:
        live = above >= 0
        node, above = node[live], above[live]
        if size > 4 * BLOCK_ENTRIES or not len(node):
            key, value = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*values, np.zeros(0, np.int64)])
            order = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.diff(key[order], prepend=-1))
            keys, values = [key[order][start]], [np.add.reduceat(value[order], start) if len(start) else value]
            size = 0
            if not len(node):
                break
        fix = divergence_of(p[node], p[above]) - divergence_of(p[node], p0[above])
        fix += divergence_of(p0[node], p0[above]) - divergence_of(p0[node], p[above])
        keys.append((tongue[node] * wide + rank[above]) * wide + rank[node])
        values.append(fix * passes[node])
        size += len(node)
        above = parent[above]
    key = keys[0]
    return [key // (wide * wide), key // wide % wide, key % wide, values[0]]


def _pair_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trees of a task's sorted rows (lang, path, many), block by block."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        names = rows.column(0).combine_chunks().dictionary_encode()
        path = rows.column(1).combine_chunks()
        cut = path.offsets.to_numpy().astype(np.int64)
        rank, p, p0 = (path.values.field(k).to_numpy() for k in range(3))
        lang, a, b, value = _tree(names.indices.to_numpy().astype(np.int64), cut, rank, p, p0, rows.column(2).to_numpy())
        return pa.RecordBatch.from_arrays(
            [names.dictionary.take(pa.array(lang)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(value)],
            names=["lang", "a", "b", "value"],
        )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(1).flatten())
        if size >= BLOCK_ENTRIES:
            yield block(held)
            held, size = [], 0
    if size:
        yield block(held)


def _with_sources(left: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    """Join each row with the sources of its language. If they are too many to broadcast, a language is cut by salts."""
    if count <= BROADCAST_ROWS:
        return left.join(F.broadcast(groups), "lang")
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))
    every = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.withColumn("salt", salt).join(every, ["lang", "salt"]).drop("salt")


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other source of its language
    (part "pair"), and the ``top`` terms that it has more of than its language (part "term")."""
    plain = docs.select(
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
        F.coalesce(docs[lang].cast("string"), F.lit("")).alias("lang"),
        F.coalesce(docs[source].cast("string"), F.lit("")).alias("source"),
    )
    counted = batched(plain).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = materialize(
        counted.groupBy("lang", "term")
        .agg(F.collect_list(F.struct("source", "n")).alias("row"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_docs)
        .drop("docs")
    )
    flat = kept.select("lang", "term", "total", F.explode("row").alias("r")).select("lang", "term", "total", "r.source", "r.n")

    stats = flat.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("n"))
    of_lang = Window.partitionBy("lang")
    groups = (
        plain.select("lang", "source").distinct()
        .join(stats, ["lang", "source"], "left")
        .join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left")
        .na.fill(0, ["terms", "n", "v"])
        .withColumn("rank", F.row_number().over(of_lang.orderBy(F.desc("terms"), "source")))
        .withColumn("lang_size", F.sum("n").over(of_lang) + PRIOR * F.col("v"))
        .withColumn("size", F.col("n") + PRIOR * F.col("v"))
        .withColumn("p0", _share("0", "size"))
    )
    groups = materialize(groups.drop("terms", "n"))
    many = groups.count()
    entries = flat.join(
        small_side(groups.select("lang", "source", "rank", "size", "lang_size", "p0"), many), ["lang", "source"]
    ).withColumn("p", _share("n", "size"))

    # Every two sources: what they have if no term occurred in either.
    other = groups.select("lang", F.col("rank").alias("b"), F.col("source").alias("b_source"), F.col("p0").alias("q0"))
    me = groups.select("lang", F.col("rank").alias("a"), F.col("source").alias("a_source"), "p0", "v")
    base = _with_sources(me, other, many).where("a < b").select(
        "lang", "a", "b", "a_source", "b_source", F.coalesce(F.col("v") * _f("p0", "q0"), F.lit(0)).alias("value")
    )
    # A count of one source against the absence in another; equal counts together.
    single = entries.groupBy("lang", "rank", "p", "p0").agg(F.count(F.lit(1)).alias("times"))
    single = _with_sources(single, other.drop("b_source"), many).where("rank <> b").select(
        "lang", F.least("rank", "b").alias("a"), F.greatest("rank", "b").alias("b"),
        F.lit(None).cast("string").alias("a_source"), F.lit(None).cast("string").alias("b_source"),
        (F.col("times") * (_f("p", "q0") - _f("p0", "q0"))).alias("value"),
    )
    # Both present: the trees.
    rows = entries.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("rank", "p", "p0"))).alias("path"))
    rows = rows.where(F.size("path") > 1).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("many"))
    rows = rows.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    both = rows.mapInArrow(_pair_corrections, "lang string, a int, b int, value long").select(
        "lang", "a", "b", F.lit(None).cast("string").alias("a_source"), F.lit(None).cast("string").alias("b_source"), "value"
    )
    pairs = base.unionByName(single).unionByName(both).groupBy("lang", "a", "b").agg(
        F.max("a_source").alias("a_source"), F.max("b_source").alias("b_source"), F.sum("value").alias("value")
    )
    ends = F.array(
        F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")),
        F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")),
    )
    pairs = pairs.select("lang", F.explode(ends).alias("e"), "value").select(
        "lang", "e.source", F.lit("pair").alias("part"), "e.item", "value"
    )
    terms = (
        entries.withColumn("q", _share("total", "lang_size")).where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    )
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= top))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
tokens AS (SELECT lang, source, doc, unnest(w) AS term FROM (SELECT *, row_number() OVER () AS doc FROM d)),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY ALL),
kept AS (SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
mine AS (SELECT c.* FROM counts c JOIN kept USING (lang, term)),
g AS (
  SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(s.n, 0) + 2 * coalesce(v.v, 0) AS size
  FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM mine GROUP BY ALL) s USING (lang, source) LEFT JOIN v USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(m.n, 0) AS n,
    CAST(1 + (1000000000 * (coalesce(m.n, 0) + 2)) // g.size AS BIGINT) AS p
  FROM g JOIN kept k USING (lang) LEFT JOIN mine m USING (lang, source, term)),
whole AS (
  SELECT lang, term, CAST(1 + (1000000000 * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v.v)) AS BIGINT) AS q
  FROM mine JOIN v USING (lang) GROUP BY lang, term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, CAST(((s.p - w.q) * (s.p - w.q)) // (s.p + w.q) AS BIGINT)
  FROM shares s JOIN whole w USING (lang, term) WHERE s.n > 0 AND s.p > w.q)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
"""
