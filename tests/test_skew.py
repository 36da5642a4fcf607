"""Joins with one key on half of all rows of both sides."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wavegraph.operators import graph as g
from wavegraph.operators import pages, scoring, skew
from wavegraph.plans import recommend


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(1)
    key = lambda: 7 if rng.random() < 0.5 else rng.randrange(40)
    left = [(key(), k) for k in range(1200)]
    right = [(key(), k % 50) for k in range(900)] + [(None, 1), (7, 3), (7, 3)]
    return spark.createDataFrame(left, "key int, a int"), spark.createDataFrame(right, "key int, b int"), left, right


@pytest.mark.parametrize("few", [200_000, 0])
def test_spread_join_is_the_join(sides, monkeypatch, few):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", few)
    left, right, mine, theirs = sides
    by_key = {}
    for k, b in theirs:
        by_key.setdefault(k, []).append(b)
    want = Counter((k, a, b) for k, a in mine for b in by_key.get(k, []))
    got = skew.spread_join(left, right, "key", side_rows=20)
    assert got.columns == ["key", "a", "b"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_no_cell_is_long(sides):
    """The hot key's pairs are spread over about as many cells as they need."""
    left, right, mine, theirs = sides
    side = 20
    grid = {r["key"]: (r["left_cuts"], r["right_cuts"]) for r in skew._grid(left, right, "key", side).collect()}
    rows = [Counter(k for k, _ in s) for s in (mine, theirs)]
    assert all(rows[0][k] * rows[1][k] > side * side for k in grid)
    assert grid[7] == (-(-rows[0][7] // side), -(-rows[1][7] // side))
    spot = left.where("key = 7").withColumn("at", F.pmod(F.xxhash64("key", "a", F.lit("left")), F.lit(grid[7][0])))
    assert max(r["count"] for r in spot.groupBy("at").count().collect()) < 3 * side


def test_neighbours_of_a_hot_artist(spark, monkeypatch):
    """Half of all credits are one person's; the neighbours are those of the plain definition."""
    rng = random.Random(2)
    edges = sorted({(1 if rng.random() < 0.5 else rng.randrange(2, 9), rng.randrange(60)) for _ in range(150)})
    graph = g.Graph(
        spark.createDataFrame(edges, "artist_id long, release_id long"), spark.createDataFrame([], "release_id long, label_id long"),
        spark.createDataFrame([], "release_id long, producer_id long"),
    )
    rated = [(r, r % 4) for r in range(0, 60, 2)]
    candidates = [(1, r) for r in range(60)] + [(2, r) for r in range(0, 60, 3)]
    monkeypatch.setattr(skew.spread_join, "__defaults__", (5,))
    found = scoring.labelled_neighbours(
        graph, spark.createDataFrame(candidates, "source_id long, release_id long"), spark.createDataFrame(rated, "release_id long, score int")
    ).select("source_id", "release_id", "neighbour_id", "score").collect()
    people = {}
    for a, r in edges:
        people.setdefault(r, set()).add(a)
    want = Counter(
        (s, r, n, score) for s, r in candidates for n, score in rated if n != r for _ in people.get(r, set()) & people.get(n, set())
    )
    assert Counter(tuple(r) for r in found) == want


def test_stored_graph_gives_the_same_scores(spark, tmp_path):
    rng = random.Random(3)
    frame = lambda pairs, names: spark.createDataFrame(sorted(pairs), names)
    graph = g.Graph(
        frame({(rng.randrange(1, 30), rng.randrange(80)) for _ in range(200)}, "artist_id long, release_id long"),
        frame({(rng.randrange(90), rng.randrange(1, 9)) for _ in range(90)}, "release_id long, label_id long"),
        frame({(rng.randrange(80), rng.randrange(1, 12)) for _ in range(90)}, "release_id long, producer_id long"),
    )
    seeds = spark.createDataFrame([(k,) for k in range(0, 80, 9)], "release_id long")
    stored = graph.stored(str(tmp_path / "graph"))
    for depth, most in ((1, None), (2, 6), (3, None)):
        plain = recommend.scored_recommendations(graph, seeds, depth, most)
        kept = recommend.scored_recommendations(stored, seeds, depth, most)
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, plain.collect())) != []


def test_roles_of_the_best(spark):
    graph = g.Graph(
        spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "artist_id long, release_id long"),
        spark.createDataFrame([(10, 5)], "release_id long, label_id long"), spark.createDataFrame([], "release_id long, producer_id long"),
    )
    roles = [(10, 1, ""), (10, 2, "Producer"), (10, 2, "Mixed By"), (10, 2, "Producer"), (10, 3, None), (11, 1, "Other")]
    row = recommend.enrich(
        graph, spark.createDataFrame([(10,), (12,)], "release_id long"), spark.createDataFrame([(10, "T")], "release_id long, title string"),
        spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "artist_id long, name string"),
        spark.createDataFrame([(5, "L")], "label_id long, name string"), spark.createDataFrame(roles, "release_id long, artist_id long, role string"),
    ).orderBy("release_id").collect()
    assert [(a["id"], a["name"], a["role"]) for a in row[0]["artists"]] == [(1, "A", ""), (2, "B", "Mixed By, Producer"), (3, "C", "")]
    assert row[1]["artists"] is None and row[1]["title"] is None


def test_release_info_takes_the_newest_page(spark):
    html = "<p>released May 1, 2021</p>" + "".join(f'<span class="track-title"> T{k}</span>' for k in (1, 2))
    shown = spark.createDataFrame(
        [("l/a", "<p>old</p>", "2022-01-01"), ("l/a", html, "2022-03-04"), ("l/x", html, "2022-03-04")], "path string, html string, fetched_at string"
    ).withColumn("fetched_at", F.to_timestamp("fetched_at"))
    found = pages.release_info(
        spark.createDataFrame([("l/a", "https://s.example/album/a"), ("l/b", "https://s.example/album/b")], "path string, url string"), shown,
        spark.createDataFrame([("l", "a", 5), ("l", "a", 6)], "label string, release string, size long"),
        spark.createDataFrame([("l/a", 2, "second"), ("l/a", 1, "first"), ("l/a", 3, None)], "path string, place int, entry string"),
    )
    rows = {r["path"]: r for r in found.collect()}
    a, b = rows["l/a"], rows["l/b"]
    assert (str(a["released_on"]), str(a["downloaded_on"]), a["n_tracks"], a["first_track"]) == ("2021-05-01", "2022-03-04", 2, "T1")
    assert (a["n_files"], a["bytes"], a["n_entries"], a["first_entry"]) == (2, 11, 3, "first")
    assert (b["released_on"], b["downloaded_on"], b["n_files"], b["n_entries"]) == (None, None, 0, 0)
