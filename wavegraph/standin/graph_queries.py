"""Graph, scoring and recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavegraph.functions.ids import clean_id, clean_label_name, release_web_url
from wavegraph.functions.weights import damped_idf, idf, inv_log_degree
from wavegraph.operators import expand, scoring
from wavegraph.operators import graph as g
from wavegraph.operators.skew import salted_join
from wavegraph.plans import recommend
from wavegraph.standin import tables as t
from wavegraph.standin.registry import query


@query("scan_graph_edges", """SELECT 'contributed_to' AS edge, artist_id AS a, release_id AS b FROM contributed_to
    UNION ALL SELECT 'released_on', release_id, label_id FROM released_on
    UNION ALL SELECT 'produced_by', release_id, producer_id FROM produced_by""")
def scan_graph_edges(spark, sf):
    graph = t.graph(spark, sf)

    def named(edge, frame):
        return frame.select(F.lit(edge).alias("edge"), F.col(frame.columns[0]).alias("a"), F.col(frame.columns[1]).alias("b"))

    people = graph.contributed_to.select("artist_id", "release_id")
    return (
        named("contributed_to", people)
        .unionByName(named("released_on", graph.released_on.select("release_id", "label_id")))
        .unionByName(named("produced_by", graph.produced_by.select("release_id", "producer_id")))
    )


@query("clean_ids", """SELECT label_id, nullif(label_id, 0) AS clean_id,
    nullif(nullif(name, 'Not On Label'), '') AS clean_name FROM label_name""")
def clean_ids(spark, sf):
    return t.label_names(spark, sf).select(
        "label_id", clean_id(F.col("label_id")).alias("clean_id"), clean_label_name(F.col("name")).alias("clean_name")
    )


@query("release_web_url", "SELECT release_id, 'https://www.discogs.com/release/' || release_id AS url FROM releases")
def web_url(spark, sf):
    return t.releases(spark, sf).select("release_id", release_web_url(F.col("release_id")).alias("url"))


@query("inv_log_degree", """SELECT artist_id, degree,
    round(CASE WHEN degree <= 1 THEN 1.0 ELSE 1 / ln(degree) END, 6)::DOUBLE AS weight FROM artist_degree""")
def inv_log(spark, sf):
    return g.degree(t.graph(spark, sf).contributed_to, "artist_id").withColumn(
        "weight", F.round(inv_log_degree(F.col("degree")), 6)
    )


@query("idf_weight", """SELECT label_id, degree, round(1 / ln(1 + degree), 6)::DOUBLE AS idf,
    round(1 / (1 + ln(degree + 1)), 6)::DOUBLE AS damped FROM label_degree""")
def idf_weight(spark, sf):
    return g.degree(t.graph(spark, sf).released_on, "label_id").select(
        "label_id", "degree", F.round(idf(F.col("degree")), 6).alias("idf"),
        F.round(damped_idf(F.col("degree")), 6).alias("damped"),
    )


@query("degree", """SELECT 'artist' AS kind, artist_id AS id, degree FROM artist_degree
    UNION ALL SELECT 'label', label_id, degree FROM label_degree
    UNION ALL SELECT 'producer', producer_id, degree FROM producer_degree""")
def degree(spark, sf):
    graph = t.graph(spark, sf)
    parts = [
        g.degree(edges, key).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "degree")
        for kind, edges, key in (
            ("artist", graph.contributed_to, "artist_id"),
            ("label", graph.released_on, "label_id"),
            ("producer", graph.produced_by, "producer_id"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("filter_degree", """SELECT release_id, label_id, degree FROM released_on JOIN label_degree USING (label_id)
    WHERE degree < 12""")
def filter_degree(spark, sf):
    graph = t.graph(spark, sf)
    return graph.hop(g.filter_degree(graph.released_on, "label_id", 12), "released_on", "label_id").select(
        "release_id", "label_id", "degree"
    )


@query("extract_release_features", """SELECT release_id, 'artist:' || artist_id AS feature FROM contributed_to
    UNION ALL SELECT release_id, 'label:' || label_id FROM released_on""")
def extract_release_features(spark, sf):
    return scoring.features(t.graph(spark, sf)).select(
        "release_id", F.concat_ws(":", "kind", "feature_id").alias("feature")
    )


@query("join_release_artists", """SELECT release_id, title, year, artist_id, name FROM releases
    JOIN contributed_to USING (release_id) JOIN artist_name USING (artist_id)""")
def join_release_artists(spark, sf):
    graph = t.graph(spark, sf)
    links = graph.hop(t.releases(spark, sf), "contributed_to", "release_id")
    names = t.artist_names(spark, sf)
    return salted_join(names, links, "artist_id", graph.hot("contributed_to", "artist_id")).select(
        "release_id", "title", "year", "artist_id", "name"
    )


@query("edge_hop_join", """SELECT DISTINCT s AS source_id, artist_id AS other_id FROM src_own
    JOIN contributed_to ON release_id = r1 WHERE artist_id <> s""")
def edge_hop_join(spark, sf):
    graph = t.graph(spark, sf)
    return g.co_contributors(graph, t.sources(spark, sf)).select("source_id", "other_id")


@query("similar_pairs_self_join", """SELECT DISTINCT x.artist_id AS a, y.artist_id AS b
    FROM contributed_to x JOIN contributed_to y USING (release_id)
    WHERE x.artist_id <> y.artist_id
      AND (x.artist_id IN (SELECT artist_id FROM sources) OR y.artist_id IN (SELECT artist_id FROM sources))""")
def similar_pairs(spark, sf):
    return g.similar_artists(t.graph(spark, sf), t.sources(spark, sf))


def _hop_sql(view: str, weight: str, hops: int) -> str:
    return f"SELECT s AS source_id, r2 AS release_id, {weight} AS weight, {hops} AS hops FROM {view}"


def _rounded(frame):
    return frame.withColumn("weight", F.round("weight", 6))


@query("hop_same_artist", _hop_sql("src_same", "1.5::DOUBLE", 1))
def hop_same_artist(spark, sf):
    return _rounded(g.hop_same_artist(t.graph(spark, sf), t.sources(spark, sf)))


@query("hop_shared_contributor", _hop_sql("src_shared", "1.0::DOUBLE", 1))
def hop_shared_contributor(spark, sf):
    return _rounded(g.hop_shared_contributor(t.graph(spark, sf), t.sources(spark, sf)))


@query("hop_label", _hop_sql(
    "src_label JOIN label_degree ON hub = label_id", "round(1 / ln(degree), 6)::DOUBLE", 2))
def hop_label(spark, sf):
    return _rounded(g.hop_label(t.graph(spark, sf), t.sources(spark, sf)))


@query("hop_producer", _hop_sql(
    "src_producer JOIN producer_degree ON hub = producer_id WHERE degree < 560", "round(1 / ln(degree), 6)::DOUBLE", 2))
def hop_producer(spark, sf):
    return _rounded(g.hop_producer(t.graph(spark, sf), t.sources(spark, sf), max_degree=560))


@query("hop_friend_of_friend", _hop_sql("src_shared JOIN released_on ON release_id = r2", "2.0::DOUBLE", 2).replace(
    "r2 AS release_id", "release_id"))
def hop_friend_of_friend(spark, sf):
    return _rounded(g.hop_friend_of_friend(t.graph(spark, sf), t.sources(spark, sf), with_label=True))


@query("hop_similar_artist", _hop_sql("src_similar", "2.5::DOUBLE", 3))
def hop_similar_artist(spark, sf):
    return _rounded(g.hop_similar_artist(t.graph(spark, sf), t.sources(spark, sf)))


@query("union_hops", """SELECT DISTINCT s AS source_id, r2 AS release_id, round(weight, 6)::DOUBLE AS weight, hops
    FROM one_rows""")
def union_hops(spark, sf):
    return _rounded(g.all_hops(t.graph(spark, sf), t.seed_artists(spark, sf), recommend.SIMILAR_MAX_DEGREE)).distinct()


@query("union_all_hops", """SELECT s AS source_id, r2 AS release_id, count(*) AS n_rows,
    round(sum(weight), 6)::DOUBLE AS total FROM one_rows GROUP BY s, r2""")
def union_all_hops(spark, sf):
    rows = g.all_hops(t.graph(spark, sf), t.seed_artists(spark, sf), recommend.SIMILAR_MAX_DEGREE)
    return rows.groupBy("source_id", "release_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("weight"), 6).alias("total")
    )


@query("min_distance", """SELECT s AS source_id, r2 AS release_id, round(min(weight), 6)::DOUBLE AS bacon_distance,
    min(hops) AS hops FROM one_rows GROUP BY s, r2""")
def min_distance(spark, sf):
    rows = g.all_hops(t.graph(spark, sf), t.seed_artists(spark, sf), recommend.SIMILAR_MAX_DEGREE)
    return g.min_distance(rows, "source_id", "release_id").withColumn(
        "bacon_distance", F.round("bacon_distance", 6)
    )


_NEAR = """SELECT *, row_number() OVER (PARTITION BY s ORDER BY distance, hops, r2) AS pos
    FROM (SELECT s, r2, min(weight) AS distance, min(hops) AS hops FROM one_rows GROUP BY s, r2)"""


@query("find_similar_releases", f"""SELECT s AS source_id, r2 AS release_id,
    round(distance, 6)::DOUBLE AS bacon_distance, hops FROM ({_NEAR}) WHERE pos <= 20""")
def find_similar_releases(spark, sf):
    return recommend.find_similar_releases(t.graph(spark, sf), t.seed_artists(spark, sf)).withColumn(
        "bacon_distance", F.round("bacon_distance", 6)
    )


@query("topn_by_distance", """SELECT r2 AS release_id, round(min(weight), 6)::DOUBLE AS bacon_distance,
    min(hops) AS hops FROM one_rows GROUP BY r2 ORDER BY min(weight), 3, 1 LIMIT 20""")
def topn_by_distance(spark, sf):
    rows = g.all_hops(t.graph(spark, sf), t.seed_artists(spark, sf), recommend.SIMILAR_MAX_DEGREE)
    near = g.min_distance(rows, "release_id")
    return recommend.top(near, 20, "bacon_distance", "hops", "release_id").withColumn(
        "bacon_distance", F.round("bacon_distance", 6)
    )


# --- scores -----------------------------------------------------------------------------

_OVERLAP = {
    "n_src": "SELECT count(*) AS n FROM sources",
    "common": """SELECT release_id, sum(1 / (1 + ln(degree + 1))) AS aa, count(*) AS shared
        FROM contributed_to JOIN sources USING (artist_id) JOIN artist_degree USING (artist_id) GROUP BY release_id""",
    "own_size": "SELECT release_id, count(*) AS own FROM contributed_to GROUP BY release_id",
    "idfs": """SELECT release_id, avg(1 / (1 + ln(degree + 1))) AS label_idf
        FROM released_on JOIN label_degree USING (label_id) GROUP BY release_id""",
    "src_rows": """SELECT s, r2, 1.5::DOUBLE AS weight, 1 AS hops FROM src_same
        UNION ALL SELECT s, r2, 1.0::DOUBLE, 1 FROM src_shared
        UNION ALL SELECT s, r2, 1 / ln(degree), 2 FROM src_label JOIN label_degree ON hub = label_id
        UNION ALL SELECT s, r2, 1 / ln(degree), 2 FROM src_producer JOIN producer_degree ON hub = producer_id""",
    "deep_rows": """SELECT s, r2, weight, hops FROM src_rows
        UNION ALL SELECT s, r2, 2.0::DOUBLE, 2 FROM src_shared JOIN released_on ON release_id = r2
        UNION ALL SELECT s, r2, 2.5::DOUBLE, 3 FROM src_similar JOIN released_on ON release_id = r2""",
    "reached": """SELECT r2 AS release_id, min(weight) AS distance, min(hops) AS hops, sum(seeds)::BIGINT AS source_count
        FROM src_rows JOIN sources ON s = artist_id GROUP BY r2""",
    "parts": """SELECT release_id, distance, hops, source_count, coalesce(aa, 0) AS aa, coalesce(shared, 0) AS shared,
        coalesce(shared / (n + own - shared), 0) AS jac, coalesce(label_idf, 0) AS label_idf
        FROM (SELECT * FROM reached WHERE release_id NOT IN (SELECT release_id FROM seeds))
        LEFT JOIN common USING (release_id) LEFT JOIN own_size USING (release_id) LEFT JOIN idfs USING (release_id), n_src""",
    "scored": """SELECT release_id, round(distance, 4)::DOUBLE AS bacon_distance, hops, source_count,
        round(aa, 4)::DOUBLE AS adamic_adar, round(jac, 4)::DOUBLE AS jaccard, round(label_idf, 4)::DOUBLE AS label_idf,
        round((10 * aa + 5 * jac) * (1 - 0.3 * (1 - label_idf)), 4)::DOUBLE AS predicted_score,
        shared AS shared_contributors FROM parts""",
}


def _own(spark, sf):
    return g.own_releases(t.graph(spark, sf), t.sources(spark, sf))


def _scored(spark, sf, depth=2):
    return recommend.scored_recommendations(t.graph(spark, sf), t.seeds(spark, sf), depth).withColumn(
        "bacon_distance", F.round("bacon_distance", 4)
    )


@query("source_count", "SELECT release_id, source_count, hops FROM reached", _OVERLAP)
def source_count(spark, sf):
    graph, sources = t.graph(spark, sf), t.sources(spark, sf)
    reached = recommend.reached_candidates(graph, sources, sources.count(), g.own_releases(graph, sources))
    return reached.select("release_id", "source_count", "hops")


@query("exclude_sources", "SELECT release_id FROM reached WHERE release_id NOT IN (SELECT release_id FROM seeds)", _OVERLAP)
def exclude_sources(spark, sf):
    graph, sources = t.graph(spark, sf), t.sources(spark, sf)
    reached = recommend.reached_candidates(graph, sources, sources.count(), g.own_releases(graph, sources))
    return g.exclude(reached, t.seeds(spark, sf)).select("release_id")


@query("shared_features", """SELECT release_id, artist_id, degree FROM contributed_to
    JOIN sources USING (artist_id) JOIN artist_degree USING (artist_id)""")
def shared_features(spark, sf):
    return scoring.shared_contributors(t.graph(spark, sf), _own(spark, sf))


@query("feature_union_size", """SELECT release_id, n + own - shared AS union_size
    FROM common JOIN own_size USING (release_id), n_src""", _OVERLAP)
def feature_union_size(spark, sf):
    graph, sources = t.graph(spark, sf), t.sources(spark, sf)
    n = sources.count()
    own = g.degree(graph.contributed_to, "release_id")
    return scoring.overlap(graph, _own(spark, sf)).join(own, "release_id").select(
        "release_id", (F.lit(n).cast("bigint") + F.col("degree") - F.col("shared")).alias("union_size")
    )


@query("adamic_adar", "SELECT release_id, round(aa, 4)::DOUBLE AS adamic_adar, shared FROM common", _OVERLAP)
def adamic_adar(spark, sf):
    return scoring.overlap(t.graph(spark, sf), _own(spark, sf)).withColumn(
        "adamic_adar", F.round("adamic_adar", 4)
    )


@query("jaccard", """SELECT release_id, round(shared / (n + own - shared), 4)::DOUBLE AS jaccard
    FROM common JOIN own_size USING (release_id), n_src""", _OVERLAP)
def jaccard(spark, sf):
    graph, sources = t.graph(spark, sf), t.sources(spark, sf)
    return scoring.jaccard(graph, scoring.overlap(graph, _own(spark, sf)), sources.count()).select(
        "release_id", F.round("jaccard", 4).alias("jaccard")
    )


@query("mean_label_idf", "SELECT release_id, round(label_idf, 4)::DOUBLE AS label_idf FROM idfs", _OVERLAP)
def mean_label_idf(spark, sf):
    return scoring.mean_label_idf(t.graph(spark, sf)).withColumn("label_idf", F.round("label_idf", 4))


@query("predicted_score", "SELECT * FROM scored", _OVERLAP)
def predicted_score(spark, sf):
    return _scored(spark, sf)


@query("topn_by_score", "SELECT * FROM scored ORDER BY predicted_score DESC, release_id LIMIT 20", _OVERLAP)
def topn_by_score(spark, sf):
    return recommend.top(_scored(spark, sf), 20, F.desc("predicted_score"), "release_id")


_ENRICHED = """SELECT b.*, title, 'https://www.discogs.com/release/' || b.release_id AS url,
    coalesce((SELECT string_agg(a.artist_id || ':' || name || ':' || role, '|' ORDER BY a.artist_id)
        FROM (SELECT l_partkey AS artist_id, coalesce(string_agg(DISTINCT CASE l_returnflag WHEN 'A' THEN 'Producer'
                WHEN 'R' THEN 'Mixed By' END, ', ' ORDER BY CASE l_returnflag WHEN 'A' THEN 'Producer' WHEN 'R' THEN 'Mixed By' END), '') AS role
            FROM lineitem WHERE l_orderkey = b.release_id AND l_partkey <> 0 GROUP BY l_partkey) c
            JOIN artist_name a USING (artist_id)), '') AS artists,
    coalesce((SELECT string_agg(n.label_id || ':' || name, '|' ORDER BY n.label_id)
        FROM released_on o JOIN label_name n USING (label_id) WHERE o.release_id = b.release_id), '') AS labels
    FROM best b JOIN releases USING (release_id)"""


def _flat(frame):
    def text(name):
        fields = [f.name for f in frame.schema[name].dataType.elementType.fields]
        pairs = F.transform(F.coalesce(F.col(name), F.array()), lambda p: F.concat_ws(":", *(p[f] for f in fields)))
        return F.array_join(pairs, "|")

    return frame.withColumn("artists", text("artists")).withColumn("labels", text("labels"))


@query("aggregate_recommendations", _ENRICHED,
       {**_OVERLAP, "best": "SELECT * FROM scored ORDER BY predicted_score DESC, release_id LIMIT 20"})
def aggregate_recommendations(spark, sf):
    out = recommend.aggregate_recommendations(
        t.graph(spark, sf), t.seeds(spark, sf), t.releases(spark, sf), t.artist_names(spark, sf),
        t.label_names(spark, sf), roles=t.roles(spark, sf),
    )
    return _flat(out.withColumn("bacon_distance", F.round("bacon_distance", 4)))


@query("aggregate_recommendations_deep", "SELECT * FROM scored ORDER BY predicted_score DESC, release_id LIMIT 50",
       {**_OVERLAP, "reached": _OVERLAP["reached"].replace("src_rows", "deep_rows")})
def aggregate_recommendations_deep(spark, sf):
    return recommend.top(_scored(spark, sf, depth=3), 50, F.desc("predicted_score"), "release_id")


@query("enrich_top_n", _ENRICHED, {"best": f"""SELECT r2 AS release_id, min(hops) AS hops FROM one_rows
    GROUP BY r2 ORDER BY min(weight), 2, 1 LIMIT 20"""})
def enrich_top_n(spark, sf):
    graph = t.graph(spark, sf)
    near = g.min_distance(g.all_hops(graph, t.seed_artists(spark, sf), recommend.SIMILAR_MAX_DEGREE), "release_id")
    best = recommend.top(near, 20, "bacon_distance", "hops", "release_id").select("release_id", "hops")
    return _flat(recommend.enrich(
        graph, best, t.releases(spark, sf), t.artist_names(spark, sf), t.label_names(spark, sf), t.roles(spark, sf)
    ))


# --- label propagation ------------------------------------------------------------------

_PROP = {
    "rated": """SELECT release_id, CASE tag WHEN '__purge' THEN 0 WHEN '__rating_3' THEN 1 WHEN '__rating_4' THEN 2
        ELSE 3 END AS score FROM own_log WHERE tag IN ('__purge', '__rating_3', '__rating_4', '__rating_5')""",
    "pool": f"SELECT s, r2, distance, hops FROM ({_NEAR}) WHERE pos <= 100",
    "near_rated": """SELECT s AS source_id, r2 AS release_id, n.release_id AS neighbour_id, score FROM pool
        JOIN contributed_to a ON a.release_id = r2
        JOIN contributed_to n ON n.artist_id = a.artist_id AND n.release_id <> r2
        JOIN rated ON rated.release_id = n.release_id""",
    "prop_size": "SELECT release_id AS neighbour_id, count(*) AS degree FROM contributed_to GROUP BY release_id",
    "prop": """SELECT source_id, release_id, sum(w * score) / sum(w) AS predicted
        FROM (SELECT *, CASE WHEN degree <= 1 THEN 1 ELSE 1 / ln(degree) END AS w
              FROM near_rated JOIN prop_size USING (neighbour_id))
        GROUP BY source_id, release_id HAVING sum(w) > 0""",
}


def _ratings(spark, sf):
    from wavegraph.functions.weights import tag_score

    return t.own_log(spark, sf).select("release_id", tag_score(F.col("tag")).alias("score")).dropna()


@query("semi_join_labeled", """SELECT source_id, release_id, neighbour_id, score, count(*) AS people
    FROM near_rated GROUP BY 1, 2, 3, 4""", _PROP)
def semi_join_labeled(spark, sf):
    graph = t.graph(spark, sf)
    pool = recommend.find_similar_releases(graph, t.seed_artists(spark, sf), 100)
    return (
        scoring.labelled_neighbours(graph, pool, _ratings(spark, sf))
        .groupBy("source_id", "release_id", "neighbour_id", "score").agg(F.count(F.lit(1)).alias("people"))
    )


@query("weighted_average", """SELECT artist_id, round(sum(score / degree) / sum(1 / degree), 6)::DOUBLE AS mean_score
    FROM rated JOIN contributed_to USING (release_id) JOIN artist_degree USING (artist_id)
    GROUP BY artist_id""", _PROP)
def weighted_average(spark, sf):
    graph = t.graph(spark, sf)
    rows = graph.hop(_ratings(spark, sf), "contributed_to", "release_id").join(
        g.degree(graph.contributed_to, "artist_id"), "artist_id"
    ).withColumn("w", F.lit(1.0) / F.col("degree"))
    return scoring.weighted_average(rows, ["artist_id"], "w", "score", "mean_score").withColumn(
        "mean_score", F.round("mean_score", 6)
    )


@query("label_propagation_scores", """SELECT source_id, release_id, round(distance, 4)::DOUBLE AS bacon_distance, hops,
    round(predicted, 6)::DOUBLE AS predicted_score FROM (
        SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(predicted, 9) DESC, distance, release_id) AS pos
        FROM prop JOIN pool ON s = source_id AND r2 = release_id) WHERE pos <= 20""", _PROP)
def label_propagation_scores(spark, sf):
    graph = t.graph(spark, sf)
    near = recommend.find_similar_releases(graph, t.seed_artists(spark, sf), 100)
    predicted = scoring.label_propagation(graph, near, _ratings(spark, sf)).withColumn(
        "predicted_score", F.round("predicted_score", 9)
    )
    best = recommend.top_per_source(predicted, 20, F.desc("predicted_score"), "bacon_distance", "release_id")
    return best.withColumn("predicted_score", F.round("predicted_score", 6)).withColumn(
        "bacon_distance", F.round("bacon_distance", 4)
    )


@query("topn_by_predicted", """SELECT source_id, release_id, round(predicted, 6)::DOUBLE AS predicted_score
    FROM prop JOIN pool ON s = source_id AND r2 = release_id
    ORDER BY round(predicted, 9) DESC, distance, release_id, source_id LIMIT 20""", _PROP)
def topn_by_predicted(spark, sf):
    graph = t.graph(spark, sf)
    near = recommend.find_similar_releases(graph, t.seed_artists(spark, sf), 100)
    predicted = scoring.label_propagation(graph, near, _ratings(spark, sf)).withColumn(
        "predicted_score", F.round("predicted_score", 9)
    )
    return recommend.top(
        predicted, 20, F.desc("predicted_score"), "bacon_distance", "release_id", "source_id"
    ).select("source_id", "release_id", F.round("predicted_score", 6).alias("predicted_score"))


# --- expansion --------------------------------------------------------------------------

_BFS = {
        "level1": """SELECT DISTINCT release_id, 1 AS depth FROM contributed_to JOIN sources USING (artist_id)
        WHERE release_id NOT IN (SELECT release_id FROM seeds)""",
    "level2": """SELECT DISTINCT release_id, 2 AS depth FROM released_on JOIN seed_labels USING (label_id)
        WHERE release_id NOT IN (SELECT release_id FROM seeds UNION ALL SELECT release_id FROM level1)""",
    "level3": """SELECT DISTINCT p.release_id, 3 AS depth FROM contributed_to p WHERE p.artist_id IN (
            SELECT artist_id FROM contributed_to WHERE release_id IN (
                SELECT release_id FROM seeds UNION ALL SELECT release_id FROM level2))
        AND release_id NOT IN (SELECT release_id FROM seeds UNION ALL SELECT release_id FROM level1
            UNION ALL SELECT release_id FROM level2)""",
    "bfs": """SELECT DISTINCT release_id, 0 AS depth FROM seeds UNION ALL SELECT * FROM level1
        UNION ALL SELECT * FROM level2""",
    "feats": """SELECT release_id, 'artist' AS kind, artist_id AS f FROM contributed_to
        UNION ALL SELECT release_id, 'label', label_id FROM released_on""",
    "found": "SELECT * FROM feats WHERE release_id IN (SELECT release_id FROM bfs)",
    "feat_n": "SELECT kind, f, count(*) AS n FROM found GROUP BY kind, f",
    "wanted": "SELECT DISTINCT kind, f FROM found WHERE release_id IN (SELECT release_id FROM seeds)",
    "weighted": """SELECT release_id, sum(CASE WHEN kind = 'artist' THEN 1 / ln(1 + n) ELSE 0 END) AS c,
        sum(CASE WHEN kind = 'label' THEN 1 / ln(1 + n) ELSE 0 END) AS l, count(*) AS shared_count,
        coalesce(string_agg(CASE WHEN kind = 'artist' THEN f END, '|' ORDER BY f), '') AS shared_contributors,
        coalesce(string_agg(CASE WHEN kind = 'label' THEN f END, '|' ORDER BY f), '') AS shared_labels
        FROM found JOIN wanted USING (kind, f) JOIN feat_n USING (kind, f)
        WHERE release_id NOT IN (SELECT release_id FROM seeds) GROUP BY release_id""",
    "weighted4": """SELECT release_id, round(c + l, 4)::DOUBLE AS final_weight, round(c, 4)::DOUBLE AS contrib_weight,
        round(l, 4)::DOUBLE AS label_weight, shared_contributors, shared_labels, shared_count FROM weighted""",
}


def _joined(frame):
    for name in ("shared_contributors", "shared_labels"):
        frame = frame.withColumn(name, F.array_join(name, "|"))
    return frame


@query("cap_per_artist", """SELECT artist_id, release_id FROM (SELECT *, row_number() OVER
    (PARTITION BY artist_id ORDER BY release_id) AS pos FROM contributed_to) WHERE pos <= 20""")
def cap_per_artist(spark, sf):
    graph = t.graph(spark, sf)
    return expand.cap_per_artist(graph, graph.contributed_to.select("artist_id").distinct())


@query("cap_per_label", """SELECT label_id, release_id FROM (SELECT *, row_number() OVER
    (PARTITION BY label_id ORDER BY release_id) AS pos FROM released_on) WHERE pos <= 10""")
def cap_per_label(spark, sf):
    graph = t.graph(spark, sf)
    return expand.cap_per_label(graph, graph.released_on.select("label_id").distinct(), pages=2, page_size=5)


@query("traverse_bfs", "SELECT * FROM bfs", _BFS)
def traverse_bfs(spark, sf):
    return expand.traverse(t.graph(spark, sf), t.seeds(spark, sf), 2)


@query("traverse_bfs_deep", "SELECT * FROM bfs UNION ALL SELECT * FROM level3", _BFS)
def traverse_bfs_deep(spark, sf):
    return expand.traverse(t.graph(spark, sf), t.seeds(spark, sf), 3)


@query("discovery_depth", """SELECT release_id, min(depth) AS depth FROM (
    SELECT release_id, 0 AS depth FROM seeds
    UNION ALL SELECT release_id, 1 FROM contributed_to JOIN sources USING (artist_id)
    UNION ALL SELECT release_id, 2 FROM released_on JOIN seed_labels USING (label_id)) GROUP BY release_id""")
def discovery_depth(spark, sf):
    graph = t.graph(spark, sf)
    start = t.seeds(spark, sf).withColumn("depth", F.lit(0))
    by_artist = graph.hop(t.sources(spark, sf).select("artist_id"), "contributed_to", "artist_id")
    by_label = graph.hop(t.seed_labels(spark, sf), "released_on", "label_id")
    return expand.discovery_depth(
        start.unionByName(by_artist.select("release_id", F.lit(1).alias("depth")))
        .unionByName(by_label.select("release_id", F.lit(2).alias("depth")))
    )


@query("except_known", """SELECT DISTINCT release_id FROM contributed_to JOIN sources USING (artist_id)
    WHERE release_id NOT IN (SELECT release_id FROM seeds)""")
def except_known(spark, sf):
    graph = t.graph(spark, sf)
    found = graph.hop(t.sources(spark, sf).select("artist_id"), "contributed_to", "artist_id").select("release_id")
    return expand.except_known(found.distinct(), t.seeds(spark, sf))


@query("feature_cardinality", "SELECT kind, f AS feature_id, n FROM feat_n", _BFS)
def feature_cardinality(spark, sf):
    graph = t.graph(spark, sf)
    reached = expand.traverse(graph, t.seeds(spark, sf), 2)
    found = scoring.features(graph).join(reached.select("release_id"), "release_id", "left_semi")
    return scoring.feature_cardinality(found)


@query("idf_weighting", "SELECT * FROM weighted4", _BFS)
def idf_weighting(spark, sf):
    graph, seeds = t.graph(spark, sf), t.seeds(spark, sf)
    return _joined(scoring.idf_weighting(graph, expand.traverse(graph, seeds, 2), seeds))


@query("traverse_and_weight", """SELECT depth, release_id, round(sum(c) + sum(l), 4)::DOUBLE AS final_weight,
    round(sum(c), 4)::DOUBLE AS contrib_weight, round(sum(l), 4)::DOUBLE AS label_weight,
    coalesce(string_agg(CASE WHEN kind = 'artist' THEN f END, '|' ORDER BY f), '') AS shared_contributors,
    coalesce(string_agg(CASE WHEN kind = 'label' THEN f END, '|' ORDER BY f), '') AS shared_labels, count(*) AS shared_count
    FROM (SELECT depth, release_id, kind, f, CASE WHEN kind = 'artist' THEN 1 / ln(1 + n) ELSE 0 END AS c,
            CASE WHEN kind = 'label' THEN 1 / ln(1 + n) ELSE 0 END AS l
        FROM reached_feats JOIN (SELECT kind, f, count(*) AS n FROM reached_feats GROUP BY kind, f HAVING min(depth) = 0)
            USING (kind, f) WHERE depth > 0)
    GROUP BY depth, release_id""", {
    "seed_set": "SELECT DISTINCT release_id FROM seeds",
    "reached_by": """SELECT release_id, min(depth) AS depth FROM (SELECT release_id, 0 AS depth FROM seed_set
        UNION ALL SELECT c.release_id, 1 FROM contributed_to c
            JOIN (SELECT DISTINCT artist_id FROM contributed_to JOIN seed_set USING (release_id)) USING (artist_id)
        UNION ALL SELECT o.release_id, 2 FROM released_on o
            JOIN (SELECT DISTINCT label_id FROM released_on JOIN seed_set USING (release_id)) USING (label_id)) GROUP BY release_id""",
    "reached_feats": """SELECT release_id, depth, 'artist' AS kind, artist_id AS f FROM contributed_to JOIN reached_by USING (release_id)
        UNION ALL SELECT release_id, depth, 'label', label_id FROM released_on JOIN reached_by USING (release_id)""",
})
def traverse_and_weight(spark, sf):
    return _joined(recommend.traverse_and_weight(t.graph(spark, sf), t.seeds(spark, sf)))


_PREF = {
    **_BFS,
    # pages with a known match; a stub is label/release
    "matched": """SELECT path AS stub, 'https://www.discogs.com/release/' || known.release_id AS url
        FROM known JOIN orders ON o_orderkey = known.release_id WHERE o_orderstatus <> 'P'""",
    "failed": """SELECT path AS stub FROM known JOIN orders ON o_orderkey = known.release_id
        WHERE o_orderpriority = '5-LOW'""",
    "prefs": """SELECT path, CASE tag WHEN '__purge' THEN 0 WHEN '__rating_3' THEN 1 WHEN '__rating_4' THEN 2
        ELSE 3 END AS score FROM own_log WHERE tag IN ('__purge', '__rating_3', '__rating_4', '__rating_5')""",
    "all_prefs": """SELECT path, CASE tag WHEN '__purge' THEN 0 WHEN '__rating_3' THEN 1 WHEN '__rating_4' THEN 2
        ELSE 3 END AS score FROM listens WHERE tag IN ('__purge', '__rating_3', '__rating_4', '__rating_5')""",
    "resolved": """SELECT path, score, CAST(regexp_extract(url, '(\\d+)$', 1) AS BIGINT) AS release_id
        FROM prefs JOIN matched ON path = matched.stub""",
    # the liked releases take the place of the seeds in the views above
    "seeds": "SELECT release_id FROM resolved WHERE score > 0",
}


def match_state(spark, sf):
    """(matched, failed): pages with a known match and pages known to fail; some are in both."""
    stubs = t.known(spark, sf).join(
        t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("release_id"), "o_orderstatus", "o_orderpriority"),
        "release_id",
    )
    matched = stubs.where("o_orderstatus <> 'P'").select(
        F.col("path").alias("stub"), release_web_url(F.col("release_id")).alias("url")
    )
    failed = stubs.where("o_orderpriority = '5-LOW'").select(F.col("path").alias("stub"))
    return matched, failed


@query("join_stub_map", """SELECT path, score,
    CASE WHEN matched.stub IS NOT NULL THEN CAST(regexp_extract(url, '(\\d+)$', 1) AS BIGINT) END AS release_id,
    CASE WHEN matched.stub IS NOT NULL THEN 'matched' WHEN failed.stub IS NOT NULL THEN 'known_fail'
         ELSE 'not_cached' END AS status
    FROM all_prefs LEFT JOIN matched ON path = matched.stub LEFT JOIN failed ON path = failed.stub""",
       {k: v for k, v in _PREF.items() if k in ("matched", "failed", "all_prefs")})
def join_stub_map(spark, sf):
    return recommend.resolve_preferences(recommend.preferences(t.listens(spark, sf)), *match_state(spark, sf))


@query("preference_recommendations", """SELECT w.*, final_weight AS rank_score FROM weighted4 w
    WHERE release_id NOT IN (SELECT release_id FROM resolved WHERE score = 0)
    ORDER BY final_weight DESC, release_id LIMIT 20""", _PREF)
def preference_recommendations(spark, sf):
    prefs = recommend.preferences(t.own_log(spark, sf))
    resolved = recommend.resolve_preferences(prefs, *match_state(spark, sf))
    return _joined(recommend.preference_recommendations(t.graph(spark, sf), resolved))


@query("filter_negative", """SELECT release_id FROM weighted4
    WHERE release_id NOT IN (SELECT release_id FROM own_log WHERE tag = '__purge')""", _BFS)
def filter_negative(spark, sf):
    weighted = recommend.traverse_and_weight(t.graph(spark, sf), t.seeds(spark, sf))
    return g.exclude(weighted, t.own_log(spark, sf).where("tag = '__purge'")).select("release_id")


@query("expand_artist_neighbourhood", """SELECT release_id, min(depth) AS depth FROM (
    SELECT release_id, 0 AS depth FROM contributed_to JOIN seed_artists USING (artist_id)
    UNION ALL SELECT b.release_id, 1 FROM one_own JOIN contributed_to o ON o.release_id = r1
    JOIN contributed_to b ON b.artist_id = o.artist_id) GROUP BY release_id""")
def expand_artist_neighbourhood(spark, sf):
    return expand.expand_artist_neighbourhood(t.graph(spark, sf), t.seed_artists(spark, sf), 1)


@query("member_distance", """SELECT artist_id, min(d) AS distance FROM (
    SELECT artist_id, 0 AS d FROM near UNION ALL
    SELECT c.artist_id, 1 FROM near n JOIN contributed_to a ON a.artist_id = n.artist_id
        JOIN contributed_to c ON c.release_id = a.release_id)
    WHERE artist_id NOT IN (SELECT artist_id FROM seed_artists) GROUP BY artist_id""",
       {"near": """SELECT DISTINCT c.artist_id FROM one_own JOIN contributed_to c ON c.release_id = r1
           WHERE c.artist_id NOT IN (SELECT artist_id FROM seed_artists)"""})
def member_distance(spark, sf):
    return expand.member_distance(t.graph(spark, sf), t.seed_artists(spark, sf), 1)


@query("label_affinity", """SELECT r.home AS label_id, o.label_id AS other_id, count(DISTINCT r.artist_id) AS shared_artists,
    round(count(DISTINCT r.artist_id) / any_value(n), 6)::DOUBLE AS share
    FROM roster r JOIN roster_size USING (home) JOIN contributed_to c ON c.artist_id = r.artist_id
    JOIN released_on o ON o.release_id = c.release_id WHERE o.label_id <> r.home GROUP BY r.home, o.label_id""",
       {"roster": """SELECT DISTINCT label_id AS home, artist_id FROM released_on JOIN seed_labels USING (label_id)
           JOIN contributed_to USING (release_id)""",
        "roster_size": "SELECT home, count(*) AS n FROM roster GROUP BY home"})
def label_affinity(spark, sf):
    return expand.label_affinity(t.graph(spark, sf), t.seed_labels(spark, sf)).withColumn("share", F.round("share", 6))


@query("artist_label_affinity", """SELECT artist_id, label_id, count(*) AS releases,
    round(count(*) / any_value(a.degree), 6)::DOUBLE AS of_artist, round(count(*) / any_value(l.degree), 6)::DOUBLE AS of_label
    FROM contributed_to JOIN sources USING (artist_id) JOIN released_on USING (release_id)
    JOIN artist_degree a USING (artist_id) JOIN label_degree l USING (label_id) GROUP BY artist_id, label_id""")
def artist_label_affinity(spark, sf):
    out = expand.artist_label_affinity(t.graph(spark, sf), t.sources(spark, sf))
    return out.withColumn("of_artist", F.round("of_artist", 6)).withColumn("of_label", F.round("of_label", 6))


@query("release_affinity", """SELECT x.release_id, y.release_id AS other_id, count(*) AS shared,
    round(count(*) / any_value(n), 6)::DOUBLE AS share
    FROM contributed_to x JOIN seeds USING (release_id)
    JOIN (SELECT release_id AS rid, count(*) AS n FROM contributed_to GROUP BY 1) ON rid = x.release_id
    JOIN contributed_to y ON y.artist_id = x.artist_id AND y.release_id <> x.release_id
    GROUP BY x.release_id, y.release_id""")
def release_affinity(spark, sf):
    return expand.release_affinity(t.graph(spark, sf), t.seeds(spark, sf)).withColumn("share", F.round("share", 6))
