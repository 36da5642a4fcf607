"""Near copies that are linked with each other and not with the first pivots."""

import os

from pyspark.sql import functions as F

from wavegraph.llm import jaccard_join


def test_another_pivot_is_tried_once_for_a_text(spark):
    """300 texts of three regions, each a group of its own and near all others: pairs are as many as texts, not their square."""
    facts = spark.range(300).select(F.col("id").alias("row"), F.lit(100).cast("long").alias("n"), F.array(*[F.lit(0).cast("long")] * 8).alias("sketch"))
    placed = facts.select("row", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("region"))
    none = spark.createDataFrame([], "node long, root long")
    pairs = [jaccard_join._other_pivots(placed, none, facts, 85, turn).collect() for turn in range(3)]
    assert all(297 <= len(p) <= 300 and len({r.a for r in p}) == len(p) and all(r.a != r.b for r in p) for p in pairs)
    assert len({r.b for p in pairs for r in p}) > 3
    one = facts.select(F.col("row").alias("node"), F.lit(0).cast("long").alias("root"))
    assert jaccard_join._other_pivots(placed, one, facts, 85, 0).count() == 0


def test_a_pivot_is_chosen_among_those_that_are_near(spark):
    """Texts of two kinds of sizes share 20 regions. A text takes a pivot of its own kind, if any region has one."""
    facts = spark.range(200).select(
        F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, 100).otherwise(1000).cast("long").alias("n"),
        F.array(*[F.lit(0).cast("long")] * 8).alias("sketch"),
    )
    placed = facts.select("row", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("region"))
    none = spark.createDataFrame([], "node long, root long")
    pairs = jaccard_join._other_pivots(placed, none, facts, 85, 0).collect()
    assert len(pairs) >= 198 and all(r.a % 2 == r.b % 2 and r.a != r.b for r in pairs)


def test_sets_are_deleted_when_they_are_measured(spark, monkeypatch):
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(words[k:])) for k in range(3)], "doc_id long, text string")
    made = []
    monkeypatch.setattr(jaccard_join, "_sets", lambda *a, f=jaccard_join._sets: made.append(f(*a)) or made[-1])
    points, blocks = jaccard_join.points(docs, "doc_id", "text", 4, 85)
    row = {r.id: r.row for r in points.collect()}
    pairs = spark.createDataFrame([(row[0], row[1]), (row[1], row[2])], "a long, b long")
    found = {(r.a, r.b): (r.an, r.bn, r.common) for r in jaccard_join._measured(pairs, blocks, 4).collect()}
    assert found == {(row[0], row[1]): (37, 36, 36), (row[1], row[2]): (36, 35, 35)}
    assert len(made) == 1 and not any(os.path.exists(f.removeprefix("file://")) for f in made[0].inputFiles())
