"""Steps that move no more rows and columns than their result needs."""

import datetime
import os
import re
from pathlib import Path

import pytest

from wavegraph.operators import graph as g
from wavegraph.operators import ordering, playlist
from wavegraph.standin import corpus, log_queries, source_queries


@pytest.fixture
def data(spark, tmp_path):
    """Few rows of the given tables: 12 orders of two lines, of which two have pages."""
    day = datetime.datetime(1995, 3, 4)
    made = {
        "lineitem": ([(o, p, o % 3 + 1, n, 2.0, 25000.0 * n, "N", "O", day) for o in range(12) for n, p in ((1, o % 5 + 1), (2, o % 4 + 1))],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "orders": ([(o, o % 2 + 1, "F", 1.0, day, "1-URGENT") for o in range(12)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(k, f"C{k}", 1, 5.0, "AUTO") for k in (1, 2)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": ([(k, f"red {k}", "B", "T") for k in range(1, 6)], "p_partkey long, p_name string, p_brand string, p_type string"),
        "supplier": ([(k, f"S{k}") for k in range(1, 41)], "s_suppkey long, s_name string"),
        "pages": ([(k, f"https://s.example/album/{k}", f"<p>{k}</p>") for k in (3, 7, 99)], "page_id long, url string, html string"),
        "events": ([(k, day, 1, "purchase", 1.0, '{"k": 5}') for k in range(3)],
                   "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_lines_of_pages_alone(spark, data):
    few = corpus.page_lines(spark, data)
    every = corpus.doc_lines(spark, data)
    assert few.count() == 4 and every.count() == 24
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, every.where("id IN (3, 7, 99)").select(*few.columns).collect()))


def test_pages_are_dealt_once(spark, data):
    plan = corpus._release_pages(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    lines = re.findall(r"^[ :+-]*(?:Project|Join|Aggregate|Filter|Relation|LogicalRelation)\b.*", plan, re.M)
    depth = lambda line: next(k for k, c in enumerate(line) if c.isalpha())
    at = next(k for k, line in enumerate(lines) if "AS body#" in line)
    above, deep = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < deep:
            above, deep = [*above, line], depth(line)
    assert sum("Join" in line for line in above) == 1
    assert sorted(r.page_id for r in source_queries.scan_pages(spark, data).collect()) == [3, 7]


def test_catalogue_tables_come_from_narrow_lines(spark, data):
    releases = {r.id: r.title for r in corpus.match_catalog(spark, data)["releases"].collect()}
    assert releases == {o: f"auto red {o % 5 + 1} vol {o}" for o in range(12)}
    assert "p_type" not in corpus._match_lines(spark, data).columns


def test_feed_numbers_rows_of_four_columns(spark, data, monkeypatch):
    stored = []
    keep = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df, *more: stored.append(df.columns) or keep(df, *more))
    rows = source_queries.latest_first_feed(spark, data).collect()
    assert sorted(r.place for r in rows) == list(range(1, 25))
    assert stored and not any({"title", "link", "description"} & set(columns) for columns in stored)


def test_one_order_over_all_rows_in_many_runs(spark):
    rows = spark.createDataFrame([(k * 7919 % 5000,) for k in range(5000)], "x long").repartition(7)
    found = ordering.number_rows(rows, [], ["x"], "n").collect()
    assert sorted((r.x, r.n) for r in found) == [(k, k + 1) for k in range(5000)]


def test_audio_files_are_written_by_several_tasks(spark, data):
    before = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("audio-*"))
    found = source_queries.scan_audio_listing(spark, data).collect()
    assert sorted(r.owner for r in found) == [k for k in range(1, 41) if k % 5]
    assert {(r.ending, r.owner % 2) for r in found} == {("ogg", 0), ("wav", 1)}
    (folder,) = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("audio-*")) - before
    assert len({f.name.split("-")[1] for f in folder.rglob("part-*.ogg")}) > 1


@pytest.mark.parametrize("long_release", [0, 2, 300])
def test_titles_and_files_of_short_and_long_releases(spark, long_release):
    titles = [("a", "x - t"), ("a", "t"), ("a", "-"), ("a", None), ("b", "x - "), ("b", "z"), (None, "t"), ("c", " t "), ("e", "t")]
    files = [("a", "t1"), ("a", "t1"), ("a", "x - t.mp3"), ("a", None), ("b", "x"), ("b", "zz"), (None, "t"), ("c", "t"), ("d", "t"), ("a", "u")]
    pairs, report = playlist.playlist_file_match(
        spark.createDataFrame(titles, "release string, wanted string"), spark.createDataFrame(files, "release string, file string"), long_release
    )
    assert sorted(map(tuple, pairs.collect())) == [("a", "t", "t1"), ("a", "x - t", "x - t.mp3"), ("b", "z", "zz"), ("c", " t ", "t")]
    assert sorted(map(tuple, report.collect()), key=str) == sorted(
        [("a", 4, 2, False), ("b", 2, 1, False), (None, 1, 0, False), ("c", 1, 1, True), ("e", 1, 0, False)], key=str
    )


def test_wanted_titles_of_files_seen_at_several_sizes(spark, data):
    titles, files = log_queries._titles(spark, data)
    assert files.count() == files.distinct().count() == 24
    assert {r.wanted for r in titles.where("release = '4'").collect()} == {"a5 - t1", "a1 - t2"}


def test_stored_graph_writes_what_is_asked_for(spark, tmp_path):
    graph = g.Graph(
        spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 12)], "artist_id long, release_id long"),
        spark.createDataFrame([(10, 5), (11, 5), (12, 5)], "release_id long, label_id long"),
        spark.createDataFrame([(10, 7), (11, 7)], "release_id long, producer_id long"),
    )
    stored = graph.stored(str(tmp_path / "graph"))
    sources = spark.createDataFrame([(1,)], "artist_id long")
    rows = lambda graph: sorted(map(tuple, g.hop_label(graph, sources).collect()))
    assert rows(stored) == rows(graph) != []
    assert not any("produced_by" in name for name in os.listdir(tmp_path / "graph"))
    stored.write_all()
    assert "produced_by_hubs" in os.listdir(tmp_path / "graph")
