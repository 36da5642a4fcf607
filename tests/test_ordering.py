import random

import pytest
from pyspark.sql import functions as F

from wavegraph.operators import listening, playlist
from wavegraph.operators.ordering import neighbours, number_rows


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else rng.choice("abc"), i, rng.choice("xyz")) for i in range(500)]
    return spark.createDataFrame(data, "grp string, pos long, val string").repartition(7)


@pytest.mark.parametrize("group", [["grp"], []])
def test_row_numbers_of_long_groups(rows, group):
    local = {}
    for r in sorted(rows.collect(), key=lambda r: (r.grp, r.pos)):
        local.setdefault(r.grp if group else None, []).append((r.grp, r.pos))
    want = {k: i + 1 for items in local.values() for i, k in enumerate(sorted(items, key=lambda k: k if group else k[1]))}
    got = number_rows(rows, group, ["pos"], "n", long_group=10)
    assert {(r.grp, r.pos): r.n for r in got.collect()} == want


@pytest.mark.parametrize("wrap", [False, True])
def test_neighbours_of_long_groups(rows, wrap):
    plain = neighbours(rows, ["grp"], ["pos"], "val", "p", "n", wrap)
    runs = neighbours(rows, ["grp"], ["pos"], "val", "p", "n", wrap, long_group=10)
    columns = ["grp", "pos", "p", "n"]
    by_place = lambda r: (r.grp, r.pos)
    assert sorted(plain.select(columns).collect(), key=by_place) == sorted(runs.select(columns).collect(), key=by_place)


def test_uniq_adjacent_over_run_borders(spark):
    lines = spark.createDataFrame([(i, "a" if i < 300 else "b") for i in range(600)], "pos long, val string").repartition(5)
    kept = playlist.uniq_adjacent(lines.withColumn("g", F.lit(1)), ["g"], ["pos"], "val", long_group=10)
    assert sorted(r.pos for r in kept.collect()) == [0, 300]


def test_newest_rows_reads_few_days(spark):
    log = spark.range(1000).select(
        F.col("id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts")
    )
    got = listening.newest_rows(log, 100, "ts", [F.desc("ts")])
    assert sorted(r.id for r in got.collect()) == list(range(900, 1000))
    assert listening.newest_rows(log, 5000, "ts", [F.desc("ts")]).count() == 1000


def test_newest_rows_of_one_day(spark):
    """All rows lie in one day, most in one second: the hour, the minute and the second are cut from counts."""
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:{s:02d}", h * 3600 + m * 60 + s) for h in range(24) for m in (0, 30) for s in (0, 59)]
    rows += [("2024-01-01 23:30:58", 100_000 + k) for k in range(300)] + [(None, -1)]
    log = spark.createDataFrame(rows, "t string, k long").withColumn("ts", F.to_timestamp("t"))
    for limit in (1, 10, 301, 302, 350, 1000):
        got = [r["k"] for r in listening.newest_rows(log, limit, "ts", [F.desc("ts"), F.desc("k")]).collect()]
        want = sorted(((t or "", k) for t, k in rows), reverse=True)[:limit]
        assert got == [k for _, k in want]
