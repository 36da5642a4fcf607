"""Streams over files that arrive in two batches; rows later than the watermark are dropped."""

import datetime as dt

from wavegraph.streaming import listens as s
from wavegraph.streaming import versions

SCHEMA = "ts timestamp, path string, tag string, control string, value double"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(path)


def test_days_drop_rows_later_than_a_day(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [(at(10), "a", "__rating_5", "c", 1.0), (at(10, 1), "b", "__skipping", "c", 1.0)])
    write(spark, path, [(at(9, 23), "a", "__purge", "c", 1.0)])
    # a batch is held against the watermark that the batch before it knew
    write(spark, path, [(at(10, 5), "d", "__purge", "c", 1.0), (at(2), "late", "__purge", "c", 1.0)])
    got = s.run_updates(s.stream_listens_per_day(stream(spark, path)), ["day"])
    assert {(str(r.day), r.listens) for r in got.collect()} == {("2024-01-10", 2), ("2024-01-09", 1)}


def test_latest_rating_over_batches(spark, tmp_path, monkeypatch):
    """Late rows do not win, later ones do, also after bases were written and the stream was started again."""
    monkeypatch.setattr(versions, "BATCHES_PER_BASE", 2)
    path = str(tmp_path / "in")
    none = spark.createDataFrame([], SCHEMA).select("path", "tag", "ts")
    known = versions.Versions.start(none, str(tmp_path / "known"))

    def run():
        s.stream_latest_rating(stream(spark, path), known, str(tmp_path / "state"))
        return {(r.path, r.tag) for r in s.latest_ratings(known).collect()}

    write(spark, path, [(at(3), "a", "__rating_3", "c", 1.0), (at(1), "b", "__purge", "c", 1.0)])
    write(spark, path, [(at(2), "a", "__rating_5", "c", 1.0), (at(4), "b", "__rating_4", "c", 1.0)])
    assert run() == {("a", "__rating_3"), ("b", "__rating_4")}
    for day in (1, 5, 2):
        write(spark, path, [(at(day), "a", f"day {day}", "c", 1.0), (at(3), "c", "__rating_3", "c", 1.0)])
    assert run() == {("a", "day 5"), ("b", "__rating_4"), ("c", "__rating_3")}
    assert sorted(known.bases()) == [-1, 1, 3]
    assert {(r.path, r.tag) for r in s.latest_ratings(known, 1).collect()} == {("a", "__rating_3"), ("b", "__purge")}


def test_bursts_keep_the_last_value(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [(at(1, 1, m), "p", "t", "x", float(m)) for m in (0, 10, 20)] + [(at(1, 3), "p", "t", "x", 9.0)])
    write(spark, path, [(at(1, 9), "p", "t", "z", 1.0)])
    write(spark, path, [(at(1, 0), "p", "t", "y", 5.0), (at(1, 9), "p", "t", "z", 1.0)])
    got = s.run_updates(s.stream_burst_last_value(stream(spark, path)), ["control", "start"], mode="append")
    rows = {(r.control, r.last_value, r.changes) for r in got.collect()}
    assert ("x", 20.0, 3) in rows and ("x", 9.0, 1) in rows
    assert not any(r[0] == "y" for r in rows)  # an hour and more before the watermark
