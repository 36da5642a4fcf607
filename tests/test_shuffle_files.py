"""Shuffle files of stored tables go when the table is there."""

import time

from pyspark.sql import functions as F

from wavegraph import session


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f.rsplit("/", 1)[-1] for f in files.split("\n") if "shuffle_" in f}


def left_of(spark, before):
    """New shuffle files; they are deleted in the background."""
    for _ in range(50):
        if not (new := shuffles(spark) - before):
            break
        time.sleep(0.1)
    return new


def test_no_shuffle_file_outlives_its_table(spark):
    before = shuffles(spark)
    counted = spark.range(50_000).groupBy(F.col("id") % 5000).agg(F.count(F.lit(1)).alias("n"))
    table = session.materialize(counted)
    assert not left_of(spark, before)
    settled = session.settle(lambda: session.materialize(counted).groupBy("n").count())
    assert not left_of(spark, before)
    assert table.count() == 5000 and settled.first()["count"] == 5000
    # The same frame may be written again.
    assert session.materialize(counted).count() == 5000
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"
