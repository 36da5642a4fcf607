"""Scores of candidate releases against the people behind the seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegraph.functions.weights import damped_idf, idf, inv_log_degree
from wavegraph.operators.graph import Graph, degree
from wavegraph.operators.skew import salted_join, small_side, spread_join
from wavegraph.session import materialize


def shared_contributors(graph: Graph, own: DataFrame) -> DataFrame:
    """(release_id, artist_id, degree) from the sources' own releases: what each release shares with the seeds."""
    degrees = own.groupBy("source_id").agg(F.count(F.lit(1)).alias("degree"))
    return salted_join(degrees, own, "source_id", graph.hot("contributed_to", "artist_id")).select(
        "release_id", F.col("source_id").alias("artist_id"), "degree"
    )


def overlap(graph: Graph, own: DataFrame) -> DataFrame:
    """(release_id, adamic_adar, shared): per release, over the contributors it shares with the seeds."""
    return (
        shared_contributors(graph, own)
        .groupBy("release_id")
        .agg(F.sum(damped_idf(F.col("degree"))).alias("adamic_adar"), F.count(F.lit(1)).alias("shared"))
    )


def jaccard(graph: Graph, overlaps: DataFrame, n_sources: int) -> DataFrame:
    """Add ``jaccard`` = shared / size of the union of both contributor sets."""
    sizes = graph.release_facts().select("release_id", "contributors")
    return _with_jaccard(overlaps.join(sizes, "release_id"), n_sources).drop("contributors")


def _with_jaccard(scored: DataFrame, n_sources: int) -> DataFrame:
    return scored.withColumn("jaccard", F.col("shared") / (F.lit(n_sources) + F.col("contributors") - F.col("shared")))


def mean_label_idf(graph: Graph) -> DataFrame:
    """(release_id, label_idf): mean of the damped weight over a release's labels."""
    return graph.release_facts().where("labels > 0").select("release_id", "label_idf")


def predicted_score(adamic_adar, jaccard_, label_idf):
    """(10 AA + 5 J), lowered by up to 30 % for releases on popular labels."""
    return (adamic_adar * 10.0 + jaccard_ * 5.0) * (1.0 - 0.3 * (1.0 - label_idf))


def score_candidates(graph: Graph, own: DataFrame, n_sources: int, candidates: DataFrame) -> DataFrame:
    """Add adamic_adar, jaccard, label_idf, predicted_score (rounded to 4) and shared_contributors."""
    candidates = materialize(candidates)
    rows = candidates.count()
    asked = small_side(candidates.select("release_id"), rows)
    # The facts of all releases are scanned, and only those of the candidates go on.
    facts = graph.release_facts().select("release_id", "contributors", "label_idf").join(asked, "release_id")
    full = (
        _with_jaccard(candidates.join(overlap(graph, own), "release_id", "left").join(facts, "release_id", "left"), n_sources)
        .fillna({"adamic_adar": 0.0, "jaccard": 0.0, "shared": 0, "label_idf": 0.0})
    )
    score = predicted_score(F.col("adamic_adar"), F.col("jaccard"), F.col("label_idf"))
    return full.select(
        *candidates.columns,
        F.round("adamic_adar", 4).alias("adamic_adar"),
        F.round("jaccard", 4).alias("jaccard"),
        F.round("label_idf", 4).alias("label_idf"),
        F.round(score, 4).alias("predicted_score"),
        F.col("shared").alias("shared_contributors"),
    )


def features(graph: Graph) -> DataFrame:
    """(release_id, kind, feature_id): contributors and labels of each release, distinct."""
    return graph.contributed_to.select(
        "release_id", F.lit("artist").alias("kind"), F.col("artist_id").alias("feature_id")
    ).unionByName(
        graph.released_on.select("release_id", F.lit("label").alias("kind"), F.col("label_id").alias("feature_id"))
    )


def feature_cardinality(reached_features: DataFrame) -> DataFrame:
    """(kind, feature_id, n): in how many releases of the reached set a feature occurs."""
    return reached_features.groupBy("kind", "feature_id").agg(F.count(F.lit(1)).alias("n"))


def _shared_features(
    graph: Graph, edges: str, key: str, kind: str, within: DataFrame, liked: DataFrame
) -> DataFrame:
    """(release_id, kind, feature_id, w): the seeds' features on the reached releases, with their IDF."""
    wanted = graph.hop(liked, edges, "release_id").select(key).distinct()
    found = graph.hop(wanted, edges, key).join(within, "release_id", "left_semi")
    weights = found.groupBy(key).agg(idf(F.count(F.lit(1))).alias("w"))
    return salted_join(weights, found, key, graph.hot(edges, key)).select(
        "release_id", F.lit(kind).alias("kind"), F.col(key).alias("feature_id"), "w"
    )


def idf_weighting(graph: Graph, reached: DataFrame, seeds: DataFrame, keep_seeds: bool = False) -> DataFrame:
    """Weight the reached releases by the rare features they share with the seeds.

    Gives release_id, contrib_weight, label_weight, final_weight (rounded to 4),
    shared_contributors[], shared_labels[] and shared_count for releases that share a
    feature and are no seeds, unless ``keep_seeds``. The arrays hold at most the features of the seeds.
    """
    liked = seeds.select("release_id").distinct()
    within = reached.select("release_id").distinct()
    shared = _shared_features(graph, "contributed_to", "artist_id", "artist", within, liked).unionByName(
        _shared_features(graph, "released_on", "label_id", "label", within, liked)
    )
    if not keep_seeds:
        shared = shared.join(liked, "release_id", "left_anti")
    is_label = F.col("kind") == "label"
    return (
        shared.groupBy("release_id")
        .agg(
            F.sum(F.when(is_label, 0.0).otherwise(F.col("w"))).alias("c"),
            F.sum(F.when(is_label, F.col("w")).otherwise(0.0)).alias("l"),
            F.sort_array(F.collect_list(F.when(~is_label, F.col("feature_id")))).alias("shared_contributors"),
            F.sort_array(F.collect_list(F.when(is_label, F.col("feature_id")))).alias("shared_labels"),
            F.count(F.lit(1)).alias("shared_count"),
        )
        .select(
            "release_id",
            F.round(F.col("c") + F.col("l"), 4).alias("final_weight"),
            F.round("c", 4).alias("contrib_weight"),
            F.round("l", 4).alias("label_weight"),
            "shared_contributors",
            "shared_labels",
            "shared_count",
        )
    )


def labelled_neighbours(graph: Graph, candidates: DataFrame, ratings: DataFrame) -> DataFrame:
    """(source_id, release_id, neighbour_id, score): rated releases that share a contributor, once per person."""
    rated = graph.hop(
        ratings.select("release_id", "score"), "contributed_to", "release_id"
    ).withColumnRenamed("release_id", "neighbour_id")
    people = graph.hop(candidates.select("source_id", "release_id"), "contributed_to", "release_id")
    # A person may have any number of candidates and of rated releases.
    pairs = spread_join(materialize(people), materialize(rated), "artist_id")
    return pairs.where("neighbour_id <> release_id").drop("artist_id")


def weighted_average(rows: DataFrame, keys: list[str], weight: str, value: str, name: str) -> DataFrame:
    """Sum of weight x value over the sum of weights; groups without weight are dropped."""
    return (
        rows.groupBy(*keys)
        .agg(F.sum(F.col(weight) * F.col(value)).alias("_top"), F.sum(weight).alias("_all"))
        .where(F.col("_all") > 0)
        .withColumn(name, F.col("_top") / F.col("_all"))
        .drop("_top", "_all")
    )


def label_propagation(graph: Graph, candidates: DataFrame, ratings: DataFrame) -> DataFrame:
    """Predict candidates' scores as the weighted mean of their rated neighbours' scores."""
    per_release = ratings.groupBy("release_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
    links = graph.hop(per_release, "contributed_to", "release_id")
    sizes = degree(links.select("release_id", "artist_id"), "release_id")
    own = per_release.join(sizes, "release_id").select(
        "release_id", (inv_log_degree(F.col("degree")) * F.col("score")).alias("own_top"),
        (inv_log_degree(F.col("degree")) * F.col("n")).alias("own_all"), F.col("n").alias("own_n"),
    )
    # What is rated under each person is added up once; a rated candidate's own share is taken off again.
    per_person = links.select("release_id", "artist_id").join(own, "release_id").groupBy("artist_id").agg(
        F.sum("own_top").alias("top"), F.sum("own_all").alias("all"), F.sum("own_n").alias("n")
    )
    people = graph.hop(candidates.select("source_id", "release_id"), "contributed_to", "release_id")
    summed = people.join(per_person, "artist_id").groupBy("source_id", "release_id").agg(
        F.sum("top").alias("top"), F.sum("all").alias("all"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("people")
    ).join(own, "release_id", "left")

    def others(total: str, mine: str) -> Column:
        return F.col(total) - F.col("people") * F.coalesce(mine, F.lit(0))

    mean = summed.where((others("n", "own_n") > 0) & (others("all", "own_all") > 1e-9)).select(
        "source_id", "release_id", (others("top", "own_top") / others("all", "own_all")).alias("predicted_score")
    )
    return candidates.join(mean, ["source_id", "release_id"])
