"""The golden graph of FIXTURES.md F5, and the same answers when every key counts as hot."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wavegraph.operators import expand
from wavegraph.operators import graph as g
from wavegraph.operators.scoring import idf_weighting
from wavegraph.operators.skew import hot_keys, salted_join
from wavegraph.plans import recommend

CONTRIBUTED = [(1, 10), (1, 11), (2, 10), (2, 12), (3, 12), (3, 13), (4, 14)]
RELEASED = [(10, 100), (11, 100), (12, 101), (13, 101), (14, 100)]


def make(spark, hot=False, contributed=CONTRIBUTED, released=RELEASED, produced=()):
    graph = g.Graph(
        spark.createDataFrame(contributed, "artist_id long, release_id long"),
        spark.createDataFrame(released, "release_id long, label_id long"),
        spark.createDataFrame(list(produced), "release_id long, producer_id long"),
    )
    if hot:
        for name in ("contributed_to", "released_on", "produced_by"):
            frame = getattr(graph, name)
            graph._hot[name] = {c: [r[0] for r in frame.select(c).distinct().collect()] for c in frame.columns}
    return graph


@pytest.fixture(params=[False, True], ids=["plain", "all-keys-hot"])
def graph(spark, request):
    return make(spark, request.param)


def sources(spark, *ids):
    return spark.createDataFrame([(i, 1) for i in ids], "artist_id long, seeds long")


def reach(frame, source):
    return {r.release_id for r in frame.where(F.col("source_id") == source).collect()}


def test_hops_of_the_golden_graph(spark, graph):
    both = sources(spark, 1, 2)
    assert reach(g.hop_same_artist(graph, both), 1) == {10, 11}
    assert reach(g.hop_same_artist(graph, both), 2) == {10, 12}
    assert reach(g.hop_shared_contributor(graph, both), 1) == {12}
    assert reach(g.hop_shared_contributor(graph, both), 2) == {11, 13}
    assert reach(g.hop_friend_of_friend(graph, both), 2) == {11, 13}
    labels = {(r.source_id, r.release_id): round(r.weight, 4) for r in g.hop_label(graph, both).collect()}
    assert labels == {(1, 10): 0.9102, (1, 14): 0.9102, (2, 11): 0.9102, (2, 14): 0.9102, (2, 13): 1.4427}


def test_similar_is_symmetric(spark, graph):
    pairs = {tuple(r) for r in g.similar_artists(graph, sources(spark, 1, 2, 3)).collect()}
    assert pairs == {(1, 2), (2, 1), (2, 3), (3, 2)}


def test_scores_of_the_golden_graph(spark, graph):
    seeds = spark.createDataFrame([(10,)], "release_id long")
    rows = recommend.scored_recommendations(graph, seeds, 2).collect()
    got = {r.release_id: (r.adamic_adar, r.jaccard, r.label_idf, r.predicted_score) for r in rows}
    assert got == {
        11: (0.4765, 0.5, 0.4191, 5.9989), 12: (0.4765, 0.3333, 0.4765, 5.4216),
        13: (0.0, 0.0, 0.4765, 0.0), 14: (0.0, 0.0, 0.4191, 0.0),
    }


def test_lone_artist_reaches_nothing_at_depth_1(spark, graph):
    assert g.hop_same_artist(graph, sources(spark, 4)).count() == 0
    assert g.hop_shared_contributor(graph, sources(spark, 4)).count() == 0


def brute_totals(contributed, released, produced, seeds_of, depth, max_degree):
    """Path enumeration over all sources, one path at a time."""
    by_artist, by_release = {}, {}
    for a, r in contributed:
        by_artist.setdefault(a, set()).add(r)
        by_release.setdefault(r, set()).add(a)
    rows = []
    for s, n in seeds_of.items():
        own = by_artist.get(s, set())
        near = {r2 for r1 in own for o in by_release[r1] - {s} for r2 in by_artist[o] if r2 != r1}
        far = {r2 for r1 in own for o in by_release[r1] - {s} for r2 in by_artist[o]}
        rows += [(r, 1.5, 1, n) for r in own if len(own) > 1] + [(r, 1.0, 1, n) for r in near]
        for edges in (released, produced):
            on, at = {}, {}
            for r, h in edges:
                on.setdefault(r, set()).add(h)
                at.setdefault(h, set()).add(r)
            found = {
                (h, r2) for r1 in own for h in on.get(r1, ()) for r2 in at[h]
                if r2 != r1 and len(at[h]) < max_degree and by_release.get(r2, set()) - {s}
            }
            rows += [(r2, 1 / math.log(len(at[h])), 2, n) for h, r2 in found]
        if depth >= 3:
            for r2 in far:
                k = sum(1 for r, _ in released if r == r2)
                rows += [(r2, 2.5, 3, n)] * k + ([(r2, 2.0, 2, n)] * k if r2 in near else [])
    out = {}
    for r, w, h, n in rows:
        a, b, c = out.get(r, (99.0, 99, 0))
        out[r] = (min(a, w), min(b, h), c + n)
    return {r: (round(w, 9), h, n) for r, (w, h, n) in out.items()}


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("depth", [2, 3])
def test_totals_equal_path_enumeration(spark, hot, depth):
    rng = random.Random(7 + depth)
    contributed = sorted({(rng.randint(1, 9), rng.randint(1, 25)) for _ in range(40)})
    contributed += [(1, r) for r in range(30, 45)]  # one artist with a third of the edges
    released = sorted({(rng.randint(1, 44), rng.randint(1, 6)) for _ in range(45)})
    produced = sorted({(rng.randint(1, 44), rng.randint(1, 4)) for _ in range(30)})
    graph = make(spark, hot, contributed, released, produced)
    weights = {1: 2, 3: 1, 5: 3}
    src = spark.createDataFrame(list(weights.items()), "artist_id long, seeds long")
    got = recommend.reached_candidates(graph, src, 3, g.own_releases(graph, src), depth, 12).collect()
    assert {r.release_id: (round(r.bacon_distance, 9), r.hops, r.source_count) for r in got} == brute_totals(
        contributed, released, produced, weights, depth, 12
    )


def test_traverse_grows_with_depth_and_caps(spark, graph):
    seeds = spark.createDataFrame([(10,)], "release_id long")
    levels = [
        {(r.release_id, r.depth) for r in expand.traverse(graph, seeds, d).collect()} for d in range(0, 4)
    ]
    assert levels[0] == {(10, 0)}
    assert levels[1] == {(10, 0), (11, 1), (12, 1)}
    assert levels[2] == levels[1] | {(14, 2)}
    for small, large in zip(levels, levels[1:]):
        assert small <= large
    capped = expand.traverse(graph, seeds, 1, releases_per_artist=1)
    assert {r.release_id for r in capped.collect()} == {10}
    everything = expand.traverse(graph, seeds, 2, labels_from="all")
    assert {(r.release_id, r.depth) for r in everything.collect()} == levels[2] | {(13, 2)}


def test_idf_weights_leave_out_seeds(spark, graph):
    seeds = spark.createDataFrame([(10,)], "release_id long")
    reached = expand.traverse(graph, seeds, 2)
    rows = {r.release_id: r for r in idf_weighting(graph, reached, seeds).collect()}
    assert set(rows) == {11, 12, 14}
    assert rows[11].contrib_weight == round(1 / math.log(3), 4)
    assert rows[11].label_weight == round(1 / math.log(4), 4)
    assert rows[11].shared_contributors == [1] and rows[11].shared_labels == [100]
    with_seeds = idf_weighting(graph, reached, seeds, keep_seeds=True)
    assert {r.release_id for r in with_seeds.collect()} == {10, 11, 12, 14}


def test_preferences_drop_disliked_and_boost_liked(spark, graph):
    rated = spark.createDataFrame(
        [("a/b", 3, 10, "matched"), ("a/c", 0, 12, "matched"), ("a/d", 2, None, "not_cached")],
        "path string, score int, release_id long, status string",
    )
    plain = recommend.preference_recommendations(graph, rated).collect()
    assert [r.release_id for r in plain] == [11, 14]
    boosted = {r.release_id: r for r in recommend.preference_recommendations(graph, rated, include_seeds=True).collect()}
    assert boosted[10].rank_score == pytest.approx(boosted[10].final_weight * 1.6, abs=1e-3)


def test_member_distance(spark, graph):
    got = {(r.artist_id, r.distance) for r in expand.member_distance(graph, sources(spark, 1), 2).collect()}
    assert got == {(2, 0), (3, 1)}


def test_hot_keys_and_salted_join(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    hot = hot_keys(many, "k", min_rows=0)["k"]
    assert hot == [7]
    assert hot_keys(many, "k")["k"] == []
    few = spark.createDataFrame([(7, "a"), (8, "b"), (7, "c"), (-1, "d")], "k long, name string")
    plain = sorted(map(tuple, few.join(many, "k").select("k", "name", "v").collect()))
    assert sorted(map(tuple, salted_join(few, many, "k", hot).select("k", "name", "v").collect())) == plain
    right = salted_join(few, many, "k", hot, how="right")
    assert right.count() == few.join(many, "k", "right").count()


def test_a_release_in_three_parts_keeps_all_tracks(spark):
    from wavegraph.operators import catalog

    def part(first, count):
        tracks = [(k, str(k), f"t{k}", [(5, "w", "Written By", "")]) for k in range(first, first + count)]
        return (1, tracks, [(k, 9, "a", ",", "") for k in range(first, first + 1)])

    docs = spark.createDataFrame(
        [part(0, 1000), part(1000, 1000), part(2000, 7)],
        "id long, tracks array<struct<place:int,position:string,title:string,"
        "extraartists:array<struct<id:long,name:string,role:string,anv:string>>>>, "
        "artists array<struct<place:int,id:long,name:string,join:string,anv:string>>",
    )
    for name in ("title", "master_id", "country", "released", "notes", "data_quality"):
        docs = docs.withColumn(name, F.lit(None).cast("string"))
    docs = docs.withColumn("extraartists", F.array().cast("array<struct<place:int,id:bigint,name:string,role:string,anv:string>>"))
    found = catalog.normalize_catalog(docs)
    assert {(r.track_pos, r.title) for r in found["tracks"].collect()} == {(k, f"t{k}") for k in range(2007)}
    assert found["track_artists"].count() == 2007 and found["release_artists"].count() == 1
