"""The log queries on streams.

Each function starts from a streaming frame. The windowed ones drop rows that are later than
their watermark: one day for days, one hour for bursts. ``run_updates`` drains what is there
and leaves the results in a folder; a batch that runs twice after a failure replaces its own
output, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegraph.operators.listening import SKIPPING
from wavegraph.session import scratch_path
from wavegraph.streaming.versions import Versions

DAY_DELAY = "1 day"
BURST_DELAY = "1 hour"


def stream_listens_per_day(log: DataFrame) -> DataFrame:
    """(day, listens) for a stream of (ts, tag)."""
    days = log.where(F.col("tag") != SKIPPING).withWatermark("ts", DAY_DELAY).groupBy(F.window("ts", "1 day").alias("w"))
    return days.agg(F.count(F.lit(1)).alias("listens")).select(F.to_date("w.start").alias("day"), "listens")


def latest_rating(log: DataFrame) -> DataFrame:
    """(path, tag, ts): the newest row of each path."""
    newest = F.max_by(F.struct("tag", "ts"), F.struct("ts", "tag"))
    return log.groupBy("path").agg(newest.alias("n")).select("path", "n.tag", "n.ts")


def stream_latest_rating(log: DataFrame, known: Versions, checkpoint: str) -> None:
    """Drain a stream of (path, tag, ts) into ``known``: the newest row of each path, however late it comes.

    The stream itself keeps no path: a batch is reduced to its newest rows and written, and the history is reduced to
    the newest of all when it is read, or when a base is written. So nothing has to be evicted, and nothing is forgotten.
    """
    def step(batch: DataFrame, number: int) -> None:
        known.add(number, latest_rating(batch), lambda base, since: latest_rating(base.unionByName(since)))

    (
        log.select("path", "tag", "ts").writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(step).start().awaitTermination()
    )


def latest_ratings(known: Versions, before: int = 1 << 40) -> DataFrame:
    """(path, tag, ts): the newest row of each path in all batches (below ``before``)."""
    base, since = known.before(before)
    return latest_rating(base.unionByName(since))


def stream_burst_last_value(changes: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(control, start, last_value, changes): bursts of (control, ts, value), closed by a quiet ``gap``."""
    bursts = changes.withWatermark("ts", BURST_DELAY).groupBy("control", F.session_window("ts", gap).alias("w"))
    return bursts.agg(
        F.max_by("value", F.struct("ts", "value")).alias("last_value"), F.count(F.lit(1)).alias("changes")
    ).select("control", F.col("w.start").alias("start"), "last_value", "changes")


def run_updates(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Drain the stream; per key the row of the newest batch."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", state)
        .trigger(availableNow=True).foreachBatch(keep).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("n"))
    return newest.select(*keys, *(F.col(f"n.{c}").alias(c) for c in rest))


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table or file as a stream; its schema is read from the files."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
