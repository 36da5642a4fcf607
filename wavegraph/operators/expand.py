"""Breadth-first expansion from seeds, level by level. The loop runs over levels, never over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegraph.operators.graph import Graph
from wavegraph.session import materialize

RELEASES_PER_ARTIST = 20
RELEASES_PER_PAGE = 50
PAGES_PER_LABEL = 5


def cap_per_key(rows: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows per key.

    The cap is the feature (one page of an artist's or label's list). Spark applies it within
    each task before the shuffle, so a hot key sends at most ``limit`` rows per task.
    """
    window = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_at", F.row_number().over(window)).where(F.col("_at") <= limit).drop("_at")


def cap_per_artist(graph: Graph, artists: DataFrame, limit: int = RELEASES_PER_ARTIST) -> DataFrame:
    """(artist_id, release_id): the first releases of each of the given artists."""
    return cap_per_key(graph.hop(artists, "contributed_to", "artist_id"), "artist_id", "release_id", limit)


def cap_per_label(
    graph: Graph, labels: DataFrame, pages: int = PAGES_PER_LABEL, page_size: int = RELEASES_PER_PAGE
) -> DataFrame:
    """(label_id, release_id): the first pages of releases of each of the given labels."""
    return cap_per_key(graph.hop(labels, "released_on", "label_id"), "label_id", "release_id", pages * page_size)


def traverse(
    graph: Graph,
    seeds: DataFrame,
    depth: int = 2,
    releases_per_artist: int | None = None,
    pages_per_label: int | None = None,
    labels_from: str = "seeds",
) -> DataFrame:
    """(release_id, depth): reached releases with the level they were first found at; seeds are level 0.

    Odd levels add the releases of all known contributors, even levels those on all known
    labels. With ``labels_from="seeds"`` a release found through a contributor adds neither
    contributors nor labels to what is known; with "all" every found release does. All releases
    of a contributor or label are taken unless a limit is given.
    """
    reached = materialize(seeds.select("release_id").distinct().withColumn("depth", F.lit(0)))
    documented = reached
    for level in range(1, depth + 1):
        known = documented.select("release_id")
        if level % 2 == 1:
            artists = graph.hop(known, "contributed_to", "release_id").select("artist_id").distinct()
            found = graph.hop(artists, "contributed_to", "artist_id")
            if releases_per_artist is not None:
                found = cap_per_key(found, "artist_id", "release_id", releases_per_artist)
        else:
            labels = graph.hop(known, "released_on", "release_id").select("label_id").distinct()
            found = graph.hop(labels, "released_on", "label_id")
            if pages_per_label is not None:
                found = cap_per_key(found, "label_id", "release_id", pages_per_label * RELEASES_PER_PAGE)
        fresh = except_known(found.select("release_id").distinct(), reached).withColumn("depth", F.lit(level))
        fresh = materialize(fresh)
        reached = reached.unionByName(fresh)
        if level % 2 == 0 or labels_from == "all":
            documented = documented.unionByName(fresh)
    return reached


def except_known(found: DataFrame, known: DataFrame, key: str = "release_id") -> DataFrame:
    """Found rows whose key is not known yet."""
    return found.join(known.select(key), key, "left_anti")


def discovery_depth(found: DataFrame) -> DataFrame:
    """(release_id, depth): the smallest level of each release in a list of (release_id, depth)."""
    return found.groupBy("release_id").agg(F.min("depth").alias("depth"))


def expand_artist_neighbourhood(graph: Graph, artists: DataFrame, depth: int = 1) -> DataFrame:
    """(release_id, depth): all releases of the artists, then those of similar artists, to ``depth``."""
    seen = materialize(artists.select("artist_id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        shared = graph.hop(frontier.select("artist_id"), "contributed_to", "artist_id").select("release_id").distinct()
        met = graph.hop(shared, "contributed_to", "release_id").select("artist_id").distinct()
        frontier = materialize(except_known(met, seen, "artist_id").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(frontier)
    return discovery_depth(graph.hop(seen, "contributed_to", "artist_id").select("release_id", "depth"))


def member_distance(graph: Graph, artists: DataFrame, max_distance: int = 2) -> DataFrame:
    """(artist_id, distance): 0 for those who share a group with a source, 1 for those one group further."""
    seen = materialize(artists.select("artist_id").distinct().withColumn("distance", F.lit(-1)))
    frontier = seen
    for level in range(0, max_distance + 1):
        groups = graph.hop(frontier.select("artist_id"), "contributed_to", "artist_id").select("release_id").distinct()
        met = graph.hop(groups, "contributed_to", "release_id").select("artist_id").distinct()
        frontier = materialize(except_known(met, seen, "artist_id").withColumn("distance", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen.where("distance >= 0")


def label_affinity(graph: Graph, labels: DataFrame) -> DataFrame:
    """(label_id, other_id, shared_artists, share): which part of a label's artists is also on another label."""
    roster = (
        graph.hop(graph.hop(labels, "released_on", "label_id"), "contributed_to", "release_id")
        .select(F.col("label_id").alias("home"), "artist_id").distinct()
    )
    size = roster.groupBy("home").agg(F.count(F.lit(1)).alias("artists"))
    work = graph.hop(roster, "contributed_to", "artist_id").select("home", "artist_id", "release_id")
    elsewhere = (
        graph.hop(work, "released_on", "release_id")
        .where("label_id <> home").select("home", "artist_id", "label_id").distinct()
    )
    return (
        elsewhere.groupBy("home", "label_id").agg(F.count(F.lit(1)).alias("shared_artists"))
        .join(size, "home")
        .select(
            F.col("home").alias("label_id"), F.col("label_id").alias("other_id"), "shared_artists",
            (F.col("shared_artists") / F.col("artists")).alias("share"),
        )
    )


def artist_label_affinity(graph: Graph, artists: DataFrame) -> DataFrame:
    """(artist_id, label_id, releases, of_artist, of_label): shares of an artist's and of a label's releases."""
    work = graph.hop(artists.select("artist_id").distinct(), "contributed_to", "artist_id")
    total = work.groupBy("artist_id").agg(F.count(F.lit(1)).alias("all_by_artist"))
    both = (
        graph.hop(work, "released_on", "release_id")
        .groupBy("artist_id", "label_id").agg(F.count(F.lit(1)).alias("releases"))
    )
    roster = graph.released_on.groupBy("label_id").agg(F.count(F.lit(1)).alias("all_on_label"))
    return both.join(total, "artist_id").join(roster, "label_id").select(
        "artist_id", "label_id", "releases",
        (F.col("releases") / F.col("all_by_artist")).alias("of_artist"),
        (F.col("releases") / F.col("all_on_label")).alias("of_label"),
    )


def release_affinity(graph: Graph, releases: DataFrame) -> DataFrame:
    """(release_id, other_id, shared, share): shared credits over the credits of the given release."""
    credits = graph.hop(releases.select("release_id").distinct(), "contributed_to", "release_id").select(
        F.col("release_id").alias("home"), "artist_id"
    )
    total = credits.groupBy("home").agg(F.count(F.lit(1)).alias("credits"))
    return (
        graph.hop(credits, "contributed_to", "artist_id").where("release_id <> home")
        .groupBy("home", "release_id").agg(F.count(F.lit(1)).alias("shared"))
        .join(total, "home")
        .select(
            F.col("home").alias("release_id"), F.col("release_id").alias("other_id"), "shared",
            (F.col("shared") / F.col("credits")).alias("share"),
        )
    )
