"""Session settings and the shared folder that intermediate tables live in."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wavegraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for. On a cluster, leave ``master`` unset."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # One machine, one process: the warehouse is as good a place as any.
    named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; every call gives another one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# A task that writes a table holds a row group of it, and one that reads it gets a row group at once.
ROW_GROUP_BYTES = 8 << 20

_open = threading.local()


def _delete(spark: SparkSession, path: str, at_end: bool = False) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(place) if at_end else files.delete(place, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written inside loses its shuffle files as soon as it is written.

    Otherwise they stay until the driver collects its garbage, and all steps of a job may lie on the disks at once.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def _written(df: DataFrame, codec: str | None) -> tuple[str, DataFrame]:
    path = scratch_path(df.sparkSession, "table")
    writer = df.write.option("parquet.block.size", ROW_GROUP_BYTES)
    with shuffles_deleted(df.sparkSession):
        (writer.option("compression", codec) if codec else writer).parquet(path)
    _delete(df.sparkSession, path, at_end=True)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it from there.

    This cuts the lineage, so a lost executor costs no recompute, and computes ``df`` once
    (a checkpoint computes it twice). The files also tell Spark the size of the result. They
    are deleted when the driver ends, or when a ``settle`` around the call ends.
    """
    path, table = _written(df, codec)
    steps = getattr(_open, "steps", [])
    if steps:
        steps[-1].append((df.sparkSession, path))
    return table


def settle(make: Callable[[], DataFrame]) -> DataFrame:
    """Materialize what ``make`` returns, and delete all tables that were written for it."""
    steps = _open.steps = getattr(_open, "steps", [])
    mine: list[tuple[SparkSession, str]] = []
    steps.append(mine)
    try:
        frame = make()
        path, table = _written(frame, None)
    finally:
        steps.pop()
        for spark, old in mine:
            _delete(spark, old)
    if steps:
        steps[-1].append((frame.sparkSession, path))
    return table
