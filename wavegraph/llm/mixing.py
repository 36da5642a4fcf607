"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. Documents are first allotted the whole copies that
all of a source can have; the rest of the target is a sample without replacement: each document
draws a random number u and is ranked by its random odds u / (1 - u) over its inclusion odds, and
the lowest ranks are taken until the rest is full. Inclusion odds fall with a document's length,
so that no few long documents decide how near a source comes to its target.

Scale: the text is read once, for its size. The rank of a document is not found by sorting its
source: ranks are dealt into fine buckets, sums per bucket show in which bucket the sample ends,
and only the documents of that one bucket are ordered (about ``BUCKET_ROWS`` rows a source). A
source may hold any share of the rows. One row per source, and one per bucket, is all that is
gathered.

Defined cases: a null text has size 0; a null source is a source of its own, the last; an empty
table has no rows; rows equal in id, source and text draw the same number and are taken together;
a source of size 0 has target 0; other columns may have any names. Reruns agree, as the numbers
come from a hash of id and text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavegraph.llm.common import table
from wavegraph.operators.skew import small_side
from wavegraph.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
BUCKET_ROWS = 1000
SEED = 11

_WORDS = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES
) -> DataFrame:
    """Targets of sources: one row in ``sizes`` per source (source, source_size, n_docs).

    A source is full when its share of what is left exceeds ``most`` times its size. Sources fill
    up in the order of that size over the weight, so one pass in this order settles all of them.
    The windows have one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    full = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight)
    full = full.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    full = full.withColumn("rate", left / F.sum("weight").over(after))
    full = full.withColumn("is_full", F.col("cap") <= F.col("weight") * F.col("rate"))
    rate = F.first(F.when(~F.col("is_full"), F.col("rate")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("is_full"), F.col("cap")).otherwise(F.col("weight") * rate)
    return full.select("source", "source_size", "n_docs", target.alias("target"))


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Take documents of the last bucket in rank order, each that still fits; then the one that comes nearest, if any."""
    rows = rows.reset_index(drop=True)
    room = rows["_room"].iloc[0]
    taken, rest = [], []
    for (_, _, size), tied in rows.groupby(["_q", "_key", "size"], sort=True):
        index = tied.index
        size *= len(index)
        if size <= room:
            taken.append(index)
            room -= size
        else:
            rest.append((abs(size - room), size, index))
    if rest:
        gap, _, index = min(rest, key=lambda r: r[:2])
        if gap < room:
            taken.append(index)
    extra = pd.Series(False, index=range(len(rows)))
    for index in taken:
        extra.iloc[index] = True
    return rows.assign(_extra=extra.to_numpy())


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    seed: int = SEED,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, and ``key``, a hash of id and text."""
    key = F.xxhash64(F.lit(seed), F.col(id), F.col(text))
    sized = materialize(docs.select(
        F.col(id).alias("doc_id"), F.col(source).cast("string").alias("source"), words_in(F.col(text)).alias("size"),
        key.alias("_key"),
    ))
    sources = materialize(source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")),
        weights, share, most,
    ))
    count = sources.count()

    def with_source(df: DataFrame, facts: DataFrame) -> DataFrame:
        facts = facts.withColumnRenamed("source", "_source")
        joined = df.join(small_side(facts, count), F.col("source").eqNullSafe(F.col("_source")))
        return joined.drop("_source")

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    # 52 bits of the hash, never 0 or 1.
    u = (F.shiftrightunsigned(F.col("_key"), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    longer = 1 + F.col("size") * F.col("n_docs") / F.greatest(F.col("source_size"), F.lit(1))
    drawn = (
        with_source(sized, sources)
        .withColumn("_whole", F.least(whole, F.lit(most)).cast("long"))
        .withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn("_q", u / (1 - u) * longer)
    )
    buckets = F.ceil(F.col("n_docs") / bucket_rows)
    drawn = drawn.withColumn("_bucket", F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * buckets), buckets - 1))
    per_bucket = drawn.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"), F.first("_rest").alias("_rest"))
    running = Window.partitionBy("source").orderBy("_bucket")
    ends = (
        per_bucket.withColumn("_upto", F.sum("_sum").over(running))
        .where(F.col("_upto") > F.col("_rest"))
        .groupBy("source")
        .agg(F.min(F.struct("_bucket", (F.col("_rest") - F.col("_upto") + F.col("_sum")).alias("_room"))).alias("_end"))
        .select("source", F.col("_end._bucket").alias("_last"), F.col("_end._room").alias("_room"))
    )
    ends = materialize(sources.select(F.col("source").alias("_s")).join(
        ends, F.col("_s").eqNullSafe(F.col("source")), "left"
    ).select(F.col("_s").alias("source"), "_last", "_room"))
    placed = with_source(drawn, ends)
    inside = F.coalesce(F.col("_bucket") < F.col("_last"), F.col("_rest") > 0)
    border = F.coalesce(F.col("_bucket") == F.col("_last"), F.lit(False))
    plain = placed.where(~border).withColumn("_extra", inside)
    last = placed.where(border)
    out = last.withColumn("_extra", F.lit(False)).schema
    ended = last.groupBy("source").applyInPandas(_fill, out)
    copies = F.least(F.col("_whole") + F.col("_extra").cast("long"), F.lit(most).cast("long"))
    return plain.unionByName(ended).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), F.col("_key").alias("key"),
    )


def copies_of(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = SEED, **options) -> DataFrame:
    """``docs`` as the mix takes them: each document in as many rows as it has copies, numbered by ``copy`` from 1
    (a column of that name is replaced)."""
    counts = (
        mix(docs, id=id, text=text, seed=seed, **options).groupBy("key")
        .agg(F.max("copies").cast("int").alias("_copies")).withColumnRenamed("key", "_key")
    )
    # The caller's columns are inside ``row``, where no name is in the way.
    keyed = docs.select(
        F.struct(*(docs[c] for c in docs.columns if c != "copy")).alias("row"), F.xxhash64(F.lit(seed), docs[id], docs[text]).alias("_key")
    )
    taken = keyed.join(counts.where(F.col("_copies") > 0), "_key")
    copy = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy")
    return taken.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "copy"), copy)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")
