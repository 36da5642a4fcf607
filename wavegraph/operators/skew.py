"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegraph.session import materialize

# A key is hot when it holds at least this share of a table that is itself at least this long.
# At most 1 / HOT_SHARE keys can be hot, so the list is bounded whatever the data.
HOT_SHARE = 0.001
MIN_ROWS = 500_000
SALTS = 64
# The most rows of a few columns of numbers that are sent whole to every executor.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast of a narrow table whose counted ``rows`` are few; else the table, to be shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hot_keys(df: DataFrame, *columns: str, share: float = HOT_SHARE, min_rows: int = MIN_ROWS) -> dict[str, list]:
    """For each column, the values that hold at least ``share`` of the rows. One pass, one row back."""
    top = int(2 / share)
    row = df.select(*columns).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.expr(f"approx_top_k(`{c}`, {top}, {100 * top})").alias(c) for c in columns),
    ).first()
    if row["n"] < min_rows:
        return {c: [] for c in columns}
    return {
        c: [e["item"] for e in row[c] if e["item"] is not None and e["count"] >= share * row["n"]]
        for c in columns
    }


def salted_join(
    few: DataFrame, many: DataFrame, key: str, hot: list, salts: int = SALTS, how: str = "inner"
) -> DataFrame:
    """Equi-join on ``key`` where ``many`` may hold a hot key.

    Rows of ``many`` with a hot key are spread over ``salts`` partitions by a hash of the
    row; the matching rows of ``few`` are repeated once per salt. Rows of other keys are
    neither moved apart nor repeated. The result is that of the plain join; ``how`` may be
    "inner", or "right" to keep the rows of ``many`` that have no partner.
    """
    if how not in ("inner", "right"):
        raise ValueError(how)
    if not hot:
        return few.join(many, key, how)
    is_hot: Column = F.col(key).isin(hot)
    spread = many.withColumn(
        "_salt",
        F.when(is_hot, F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0)),
    )
    repeated = few.withColumn(
        "_salt",
        F.explode(
            F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    return repeated.join(spread, [key, "_salt"], how).drop("_salt")


def lookup_join(few: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """Inner equi-join on ``key`` of a table that is usually short with one that may be very long, or have hot keys.

    ``few`` is stored and counted, and only then broadcast. ``many`` never is: what Spark takes for its size does not know how many
    rows an explode makes of one, nor how small the files of long texts get, and would send it whole through the driver.
    """
    few = materialize(few)
    if few.count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), key)
    return salted_join(few, many.hint("merge"), key, hot_keys(many, key)[key])


# Rows of one key on one side that one task takes; two such sides give its square in pairs.
SIDE_ROWS = 1000


def _grid(left: DataFrame, right: DataFrame, key: str, side_rows: int) -> DataFrame:
    """(key, left_cuts, right_cuts) of the keys whose pairs are too many for one task, by the rows they have on either side."""
    mine = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))
    theirs = right.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    cuts = lambda n: F.ceil(F.col(n) / side_rows).cast("int")
    return (
        mine.join(theirs, key).where(F.col("l") * F.col("r") > side_rows * side_rows)
        .select(key, cuts("l").alias("left_cuts"), cuts("r").alias("right_cuts"))
    )


def spread_join(left: DataFrame, right: DataFrame, key: str, side_rows: int = SIDE_ROWS) -> DataFrame:
    """Inner equi-join on ``key`` where a key may have very many rows on both sides.

    A key's pairs are laid out as a grid: its left rows are cut by a hash into as many parts as they need, its right rows
    too, and each cell of the grid is a key of its own. So no task gets more than about ``side_rows`` squared pairs
    of one key, however many it has, and only rows of long keys are repeated, one time for ``side_rows`` pairs.
    """
    # Counted before it is used twice; short tables and keys of few rows leave it empty.
    grid = materialize(_grid(left, right, key, side_rows))
    count = grid.count()
    if not count:
        return left.join(right, key)
    grid = small_side(grid, count)

    def placed(side: DataFrame, own: str, other: str) -> DataFrame:
        spot = F.pmod(F.xxhash64(*side.columns, F.lit(own)), F.coalesce(f"_{own}_cuts", F.lit(1))).cast("int")
        named = grid.select(key, F.col("left_cuts").alias("_left_cuts"), F.col("right_cuts").alias("_right_cuts"))
        across = F.explode(F.sequence(F.lit(0), F.coalesce(f"_{other}_cuts", F.lit(1)) - 1))
        return side.join(named, key, "left").withColumns({f"_{own}_at": spot}).withColumn(f"_{other}_at", across).drop("_left_cuts", "_right_cuts")

    cells = [key, "_left_at", "_right_at"]
    return placed(left, "left", "right").join(placed(right, "right", "left"), cells).drop("_left_at", "_right_at")
