"""Row numbers and neighbours in an ordered group of any length.

A plain window puts a whole group into one task. These operators look at the longest group
first. When it is short, they use the plain window. When it is long, they cut the order into
runs by range partitioning, work inside each run, and join the runs by their borders, one
row per group and run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegraph.operators.skew import small_side
from wavegraph.session import materialize

LONG_GROUP = 1_000_000


def has_long_group(df: DataFrame, group: list[str], limit: int = LONG_GROUP) -> bool:
    """True if a group has more than ``limit`` rows (counted with map-side combine)."""
    return not df.groupBy(*group).count().where(F.col("count") > limit).isEmpty()


def _runs(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    ranged = df.repartitionByRange(*group, *order)
    return materialize(ranged.withColumn("_run", F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    test = F.lit(True)
    for key in keys:
        test = test & left[key].eqNullSafe(right[key])
    return test


def _attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    extra = [c for c in right.columns if c not in keys]
    return left.join(right, _same(left, right, keys), "left").select(
        *(left[c] for c in left.columns), *(right[c] for c in extra)
    )


def number_rows(
    df: DataFrame, group: list[str], order: list[str], name: str, long_group: int = LONG_GROUP
) -> DataFrame:
    """Add ``name``, the 1-based position in the group. ``order`` must tell all rows apart.

    Rows of groups are stored first, so that they are computed once and both the count and the order read them from there.
    In a run the rows lie in order, and Spark numbers them as they lie; what it has given the first of a group is taken off.
    """
    if group:
        df = materialize(df)
    if group and not has_long_group(df, group, long_group):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))
    keys = [*group, "_run"]
    lying = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    runs = materialize(lying.select("*", F.spark_partition_id().alias("_run"), F.monotonically_increasing_id().alias("_row")))
    before = (
        runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), F.min("_row").alias("_first"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_size").over(
                    Window.partitionBy(*(group or [F.lit(0)])).orderBy("_run")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_size")
    )
    before = materialize(before)
    return (
        _attach(runs, small_side(before, before.count()), keys)
        .withColumn(name, F.col("_row") - F.col("_first") + 1 + F.col("_before"))
        .drop("_row", "_first", "_before", "_run")
    )


def neighbours(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: str,
    before: str,
    after: str,
    wrap: bool = False,
    long_group: int = LONG_GROUP,
) -> DataFrame:
    """Add the ``value`` of the rows before and after in the group's order.

    With ``wrap`` the first row's predecessor is the last row, and the other way round.
    ``order`` must tell all rows apart. The rows are stored first, so that they are computed once.
    """
    held = materialize(df.withColumn("_v", F.struct(F.col(value).alias("v"))))
    if group and not has_long_group(held, group, long_group):
        window = Window.partitionBy(*group).orderBy(*order)
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = held.withColumn("_p", F.lag("_v").over(window)).withColumn("_n", F.lead("_v").over(window))
        if wrap:
            out = out.withColumn("_p", F.coalesce("_p", F.last("_v").over(whole)))
            out = out.withColumn("_n", F.coalesce("_n", F.first("_v").over(whole)))
    else:
        runs = _runs(held, group, order)
        keys = [*group, "_run"]
        window = Window.partitionBy(*keys).orderBy(*order)
        inside = runs.withColumn("_p", F.lag("_v").over(window)).withColumn("_n", F.lead("_v").over(window))
        rank = F.struct(*order)
        across = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_run")
        whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        borders = (
            runs.groupBy(*keys)
            .agg(F.min_by("_v", rank).alias("_lo"), F.max_by("_v", rank).alias("_hi"))
            .withColumn("_bp", F.lag("_hi").over(across))
            .withColumn("_bn", F.lead("_lo").over(across))
        )
        if wrap:
            borders = borders.withColumn("_bp", F.coalesce("_bp", F.last("_hi").over(whole)))
            borders = borders.withColumn("_bn", F.coalesce("_bn", F.first("_lo").over(whole)))
        out = (
            _attach(inside, borders.drop("_lo", "_hi"), keys)
            .withColumn("_p", F.coalesce("_p", "_bp"))
            .withColumn("_n", F.coalesce("_n", "_bn"))
            .drop("_bp", "_bn", "_run")
        )
    return out.withColumn(before, F.col("_p.v")).withColumn(after, F.col("_n.v")).drop("_v", "_p", "_n")
