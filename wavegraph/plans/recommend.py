"""Recommendations, from seeds or from the listening log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegraph.functions.ids import release_web_url
from wavegraph.functions.weights import tag_score
from wavegraph.operators import graph as g
from wavegraph.operators.expand import traverse
from wavegraph.operators.scoring import idf_weighting, label_propagation, score_candidates
from wavegraph.operators.skew import small_side
from wavegraph.session import materialize

TOP_N = 20
# Similar releases leave out labels and producers with so many releases.
SIMILAR_MAX_DEGREE = 1000


def top(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows; a top-k per task and a merge, no full sort."""
    return rows.orderBy(*order).limit(n)


def top_per_source(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows per source_id, limited within each task before the shuffle."""
    at = F.row_number().over(Window.partitionBy("source_id").orderBy(*order))
    return rows.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def find_similar_releases(
    graph: g.Graph, artists: DataFrame, top_n: int = TOP_N, max_degree: int | None = SIMILAR_MAX_DEGREE
) -> DataFrame:
    """(source_id, release_id, bacon_distance, hops): per artist the nearest releases."""
    near = g.min_distance(g.all_hops(graph, artists, max_degree), "source_id", "release_id")
    return top_per_source(near, top_n, "bacon_distance", "hops", "release_id")


def reached_candidates(
    graph: g.Graph, sources: DataFrame, n_sources: int, own: DataFrame, depth: int = 2,
    max_degree: int | None = None,
) -> DataFrame:
    """(release_id, bacon_distance, hops, source_count) over all sources; a path counts once per seed of its source."""
    counts = small_side(sources.select(F.col("artist_id").alias("source_id"), "seeds"), n_sources)
    return g.reached_totals(graph, own, counts, depth, max_degree)


def scored_recommendations(
    graph: g.Graph, seeds: DataFrame, depth: int = 2, max_degree: int | None = None
) -> DataFrame:
    """Every release within reach of the seeds' contributors, with all scores; seeds left out.

    The sources and their own releases are read by every branch, so both are stored first.
    """
    sources = materialize(g.sources_of(graph, seeds))
    n_sources = sources.count()
    own = materialize(g.own_releases(graph, sources, n_sources))
    reached = reached_candidates(graph, sources, n_sources, own, depth, max_degree)
    return score_candidates(graph, own, n_sources, g.exclude(reached, seeds))


def aggregate_recommendations(
    graph: g.Graph,
    seeds: DataFrame,
    titles: DataFrame,
    artist_names: DataFrame,
    label_names: DataFrame,
    top_n: int = TOP_N,
    depth: int = 2,
    max_degree: int | None = None,
    roles: DataFrame | None = None,
) -> DataFrame:
    """The best releases for a set of liked ones, with title, URL, artists[] and labels[]."""
    best = top(
        scored_recommendations(graph, seeds, depth, max_degree), top_n, F.desc("predicted_score"), "release_id"
    )
    return enrich(graph, best, titles, artist_names, label_names, roles)


def enrich(
    graph: g.Graph, best: DataFrame, titles: DataFrame, artist_names: DataFrame, label_names: DataFrame,
    roles: DataFrame | None = None,
) -> DataFrame:
    """Add title, url, artists[] and labels[] to the few rows that a top-n left.

    With ``roles`` (release_id, artist_id, role), each of the artists has a ``role``: all that the release credits it
    with, in order; empty for a main artist.
    """
    best = materialize(best)
    rows = best.count()
    few = best.select("release_id")
    links = graph.hop(few, "contributed_to", "release_id", rows)
    if roles is None:
        artists = _named(links, artist_names, "artist_id")
    else:
        held = roles.join(small_side(few, rows), "release_id", "left_semi").groupBy("release_id", "artist_id").agg(
            F.array_join(F.array_sort(F.collect_set(F.nullif("role", F.lit("")))), ", ").alias("role")
        )
        credited = links.join(held, ["release_id", "artist_id"], "left").fillna("", ["role"])
        artists = _named(credited, artist_names, "artist_id", "role")
    labels = _named(graph.hop(few, "released_on", "release_id", rows), label_names, "label_id")
    return (
        best.join(titles.select("release_id", "title"), "release_id", "left")
        .join(artists.withColumnRenamed("named", "artists"), "release_id", "left")
        .join(labels.withColumnRenamed("named", "labels"), "release_id", "left")
        .withColumn("url", release_web_url(F.col("release_id")))
    )


def _named(links: DataFrame, names: DataFrame, key: str, *more: str) -> DataFrame:
    pair = F.struct(F.col(key).alias("id"), F.col("name"), *more)
    return (
        links.join(names.select(key, "name"), key)
        .groupBy("release_id").agg(F.sort_array(F.collect_list(pair)).alias("named"))
    )


def similar_by_label_propagation(
    graph: g.Graph, artists: DataFrame, ratings: DataFrame, top_n: int = TOP_N,
    pool: int = 100, max_degree: int | None = SIMILAR_MAX_DEGREE,
) -> DataFrame:
    """Per artist, the nearest ``pool`` releases ranked by the score predicted from rated neighbours."""
    near = find_similar_releases(graph, artists, pool, max_degree)
    predicted = label_propagation(graph, near, ratings)
    return top_per_source(predicted, top_n, F.desc("predicted_score"), "bacon_distance", "release_id")


def traverse_and_weight(graph: g.Graph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Reached releases with their depth and feature weights."""
    reached = traverse(graph, seeds, depth)
    return reached.join(idf_weighting(graph, reached, seeds), "release_id")


def preferences(log: DataFrame) -> DataFrame:
    """(path, score) of the log rows whose tag has a score."""
    return log.select("path", tag_score(F.col("tag")).alias("score")).dropna()


def resolve_preferences(prefs: DataFrame, matched: DataFrame, failed: DataFrame) -> DataFrame:
    """Add release_id and status ("matched", "known_fail" or "not_cached") by the path's stub."""
    url_release = F.regexp_extract(F.rtrim(F.col("url"), F.lit("/")), r"(\d+)$", 1).try_cast("bigint")
    known = matched.select(F.col("stub").alias("path"), url_release.alias("release_id"))
    bad = failed.select(F.col("stub").alias("path"), F.lit(True).alias("bad"))
    return (
        prefs.join(known, "path", "left").join(bad, "path", "left")
        .withColumn(
            "status",
            F.when(F.col("release_id").isNotNull(), "matched").when(F.col("bad"), "known_fail").otherwise("not_cached"),
        )
        .drop("bad")
    )


def preference_recommendations(
    graph: g.Graph, resolved: DataFrame, depth: int = 2, top_n: int = TOP_N, include_seeds: bool = False
) -> DataFrame:
    """Rank what is reached from the liked releases; disliked ones are left out.

    A release's score is its final weight. With ``include_seeds`` the liked releases are
    ranked too, their weight raised by the factor 1 + preference / 5.
    """
    known = resolved.where("status = 'matched'").groupBy("release_id").agg(
        F.max("score").alias("score"), F.min("score").alias("low")
    )
    liked = known.where("score > 0").select("release_id", "score")
    disliked = known.where("low = 0").select("release_id")
    reached = traverse(graph, liked, depth)
    weighted = idf_weighting(graph, reached, liked, keep_seeds=include_seeds)
    boost = F.coalesce(F.lit(1.0) + F.col("score") / 5.0, F.lit(1.0))
    ranked = (
        g.exclude(weighted, disliked)
        .join(liked, "release_id", "left")
        .withColumn("rank_score", F.round(F.col("final_weight") * boost, 4))
        .drop("score")
    )
    return top(ranked, top_n, F.desc("rank_score"), "release_id")
