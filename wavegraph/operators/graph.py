"""The release graph and its one-hop queries.

Every hop starts from ``sources(artist_id)``, the people behind a set of liked releases, and
carries the source along. The number of rows between two steps is at most the number of
sources times the number of edges, whatever the size of a single release, artist or label:
no step emits the pairs within a group. Edges are distinct, so two different edges at one
node are two different neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegraph.functions.ids import clean_id, clean_label_name
from wavegraph.functions.weights import damped_idf, inv_log_degree
from wavegraph.operators.skew import BROADCAST_ROWS, hot_keys, salted_join
from wavegraph.session import materialize



_HUBS = {"released_on": "label_id", "produced_by": "producer_id"}


@dataclass
class Graph:
    """Distinct edges: (artist_id, release_id), (release_id, label_id), (release_id, producer_id).

    A stored graph also keeps what queries would otherwise work out of whole edge sets at each call: the facts
    of the releases, and the edges at labels and producers with their degree. Queries then join a few rows to
    tables that are only scanned.
    """

    contributed_to: DataFrame
    released_on: DataFrame
    produced_by: DataFrame
    _hot: dict = field(default_factory=dict, repr=False)

    def hot(self, edges: str, key: str) -> list:
        """The hot values of ``key`` in the named edge set, looked up once."""
        if edges not in self._hot:
            frame = getattr(self, edges)
            self._hot[edges] = hot_keys(frame, *frame.columns)
        return self._hot[edges][key]

    def stored(self, path: str) -> StoredGraph:
        """The graph with its edges and what follows from them below ``path``."""
        return StoredGraph(self, path)

    def release_facts(self) -> DataFrame:
        """(release_id, sole, contributors, labels, label_idf) of releases with contributors or labels.

        ``sole`` is the only contributor, null if there are several; ``label_idf`` the mean damped weight of the labels.
        """
        people = self.contributed_to.groupBy("release_id").agg(
            F.when(F.min("artist_id") == F.max("artist_id"), F.min("artist_id")).alias("sole"), F.count(F.lit(1)).alias("contributors")
        )
        weights = degree(self.released_on, "label_id").select("label_id", damped_idf(F.col("degree")).alias("w"))
        on_label = self.hop(weights, "released_on", "label_id").groupBy("release_id").agg(
            F.count(F.lit(1)).alias("labels"), F.avg("w").alias("label_idf")
        )
        return people.join(on_label, "release_id", "full").fillna(0, ["contributors", "labels"])

    def hub_edges(self, edges: str) -> DataFrame:
        """The named edges to releases with contributors, with the hub's degree and the release's ``sole`` contributor."""
        hub, frame = _HUBS[edges], getattr(self, edges)
        known = self.release_facts().where("contributors > 0").select("release_id", "sole")
        counted = salted_join(degree(frame, hub), frame, hub, self.hot(edges, hub))
        return counted.join(known, "release_id").select("release_id", hub, "degree", "sole")

    def hop(self, few: DataFrame, edges: str, key: str, rows: int | None = None) -> DataFrame:
        """Follow the named edges from the ``key`` column of ``few``; ``rows`` is its length, where that is known."""
        return self.join(few, getattr(self, edges), edges, key, rows)

    def join(self, few: DataFrame, frame: DataFrame, edges: str, key: str, rows: int | None = None) -> DataFrame:
        """Join ``few`` to a table of the named edges. If it is known to be short, the table is not shuffled."""
        if rows is not None and rows <= BROADCAST_ROWS:
            return frame.join(F.broadcast(few), key).select(*few.columns, *(c for c in frame.columns if c not in few.columns))
        return salted_join(few, frame, key, self.hot(edges, key))


class StoredGraph(Graph):
    """A graph whose tables are written below a folder when they are first asked for, and read from there."""

    def __init__(self, graph: Graph, path: str) -> None:
        self._graph, self._path, self._hot, self._kept = graph, path, {}, {}

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            frame, place = make(), f"{self._path}/{name}"
            frame.write.mode("overwrite").parquet(place)
            self._kept[name] = frame.sparkSession.read.schema(frame.schema).parquet(place)
        return self._kept[name]

    contributed_to = property(lambda self: self._table("contributed_to", lambda: self._graph.contributed_to))
    released_on = property(lambda self: self._table("released_on", lambda: self._graph.released_on))
    produced_by = property(lambda self: self._table("produced_by", lambda: self._graph.produced_by))

    def release_facts(self) -> DataFrame:
        return self._table("release_facts", super().release_facts)

    def hub_edges(self, edges: str) -> DataFrame:
        make = super().hub_edges
        return self._table(f"{edges}_hubs", lambda: make(edges))

    def write_all(self) -> None:
        """Write every table that is not there yet."""
        self.contributed_to, self.released_on, self.produced_by, self.release_facts()
        for name in _HUBS:
            self.hub_edges(name)


def _counted(frame: DataFrame) -> tuple[DataFrame, int]:
    """``frame``, stored, and its length: what tells whether the table that it is joined to has to be shuffled."""
    held = materialize(frame)
    return held, held.count()


def clean_edges(contributions: DataFrame, releases_on: DataFrame, labels: DataFrame, productions: DataFrame) -> Graph:
    """Distinct edges without null or zero ids, and without the placeholder label."""
    named = labels.select(
        clean_id(F.col("label_id")).alias("label_id"), clean_label_name(F.col("name")).alias("name")
    ).dropna()
    on_label = (
        releases_on.select("release_id", clean_id(F.col("label_id")).alias("label_id")).dropna()
        .join(named.select("label_id").distinct(), "label_id", "left_semi")
        .select("release_id", "label_id").distinct()
    )
    return Graph(
        contributions.select(clean_id(F.col("artist_id")).alias("artist_id"), "release_id").dropna().distinct(),
        on_label,
        productions.select("release_id", clean_id(F.col("producer_id")).alias("producer_id")).dropna().distinct(),
    )


def degree(edges: DataFrame, node: str) -> DataFrame:
    """(node, degree) of a distinct edge set."""
    return edges.groupBy(node).agg(F.count(F.lit(1)).alias("degree"))


def filter_degree(edges: DataFrame, node: str, max_degree: int | None) -> DataFrame:
    """Nodes with a degree below ``max_degree``, with that degree; None is no limit."""
    found = degree(edges, node)
    return found if max_degree is None else found.where(F.col("degree") < max_degree)


def sources_of(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(artist_id, seeds): the contributors of the seed releases and the number of seeds of each."""
    few, rows = _counted(seeds.select("release_id").distinct())
    edges = graph.hop(few, "contributed_to", "release_id", rows)
    return edges.groupBy("artist_id").agg(F.count(F.lit(1)).alias("seeds"))


def first_artists(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(artist_id): the first contributor of each seed release."""
    few, rows = _counted(seeds.select("release_id").distinct())
    edges = graph.hop(few, "contributed_to", "release_id", rows)
    return edges.groupBy("release_id").agg(F.min("artist_id").alias("artist_id")).select("artist_id").distinct()


def own_releases(graph: Graph, sources: DataFrame, rows: int | None = None) -> DataFrame:
    """(source_id, release_id): the sources' own releases; ``rows`` is the number of sources, where that is known."""
    few = sources.select("artist_id").distinct()
    if rows is None:
        few, rows = _counted(few)
    return graph.hop(few, "contributed_to", "artist_id", rows).select(F.col("artist_id").alias("source_id"), "release_id")


def _via(own_hubs: DataFrame, hub: str) -> DataFrame:
    """(source_id, hub, lo, hi): hubs of the sources' releases; lo = hi if one release leads there."""
    return own_hubs.groupBy("source_id", hub).agg(F.min("release_id").alias("lo"), F.max("release_id").alias("hi"))


# A release reached through a hub must differ from some release that leads to the hub.
_ELSEWHERE = "lo <> hi OR release_id <> lo"


def _met(graph: Graph, own: DataFrame, rows: int | None = None) -> DataFrame:
    if rows is None:
        own, rows = _counted(own)
    met = graph.hop(own, "contributed_to", "release_id", rows).withColumnRenamed("artist_id", "other_id")
    return _via(met.where("other_id <> source_id"), "other_id")


def co_contributors(graph: Graph, sources: DataFrame) -> DataFrame:
    """(source_id, other_id, lo, hi): who shares a release with a source."""
    return _met(graph, own_releases(graph, sources))


def similar_artists(graph: Graph, sources: DataFrame) -> DataFrame:
    """(a, b): the similarity edges at the sources, both directions."""
    one = co_contributors(graph, sources).select(F.col("source_id").alias("a"), F.col("other_id").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _row(frame: DataFrame, weight, hops: int) -> DataFrame:
    return frame.select("source_id", "release_id", weight.alias("weight"), F.lit(hops).alias("hops"))


def _several(graph: Graph, own: DataFrame) -> DataFrame:
    counts = own.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("source_id")
    return salted_join(counts, own, "source_id", graph.hot("contributed_to", "artist_id"))


def hop_same_artist(graph: Graph, sources: DataFrame) -> DataFrame:
    """All releases of a source that has at least two. Weight 1.5, one hop."""
    return _row(_several(graph, own_releases(graph, sources)), F.lit(1.5), 1)


def _reach_people(graph: Graph, own: DataFrame, rows: int | None = None) -> DataFrame:
    """(source_id, release_id, elsewhere): releases of those who share a release with the source.

    ``elsewhere`` tells if one of them leads there from another release than itself. One
    expansion serves the three hops through people.
    """
    others, rows = _counted(_met(graph, own, rows).withColumnRenamed("other_id", "artist_id"))
    reached = graph.hop(others, "contributed_to", "artist_id", rows)
    return reached.groupBy("source_id", "release_id").agg(F.max(F.expr(_ELSEWHERE)).alias("elsewhere"))


def hop_shared_contributor(graph: Graph, sources: DataFrame) -> DataFrame:
    """Other releases of those who share a release with the source. Weight 1, one hop."""
    return _row(_reach_people(graph, own_releases(graph, sources)).where("elsewhere"), F.lit(1.0), 1)


def hop_friend_of_friend(graph: Graph, sources: DataFrame, with_label: bool = False) -> DataFrame:
    """The same reach as two hops of weight 2; ``with_label`` gives one row per label of the release."""
    reach = _reach_people(graph, own_releases(graph, sources)).where("elsewhere")
    if with_label:
        reach = graph.hop(reach, "released_on", "release_id")
    return _row(reach, F.lit(2.0), 2)


def hop_similar_artist(graph: Graph, sources: DataFrame, with_label: bool = False) -> DataFrame:
    """All releases of similar artists. Weight 2.5, three hops."""
    reach = _reach_people(graph, own_releases(graph, sources))
    if with_label:
        reach = graph.hop(reach, "released_on", "release_id")
    return _row(reach, F.lit(2.5), 3)


def _hubs(graph: Graph, own: DataFrame, edges: str, hub: str, rows: int | None = None) -> DataFrame:
    """(source_id, hub, lo, hi): the hubs of the sources' releases."""
    return _via(graph.hop(own, edges, "release_id", rows), hub)


def _below(edges: DataFrame, max_degree: int | None) -> DataFrame:
    return edges if max_degree is None else edges.where(F.col("degree") < max_degree)


def _hub_rows(graph: Graph, own: DataFrame, edges: str, hub: str, max_degree: int | None, rows: int | None = None) -> DataFrame:
    """One row per source, hub (below ``max_degree``, if given) and other release there that someone else worked on."""
    if rows is None:
        own, rows = _counted(own)
    hubs, rows = _counted(_hubs(graph, own, edges, hub, rows))
    reached = graph.join(hubs, _below(graph.hub_edges(edges), max_degree), edges, hub, rows)
    kept = reached.where(_ELSEWHERE).where("sole IS NULL OR sole <> source_id")
    return _row(kept, inv_log_degree(F.col("degree")), 2)


def hub_totals(
    graph: Graph, own: DataFrame, counts: DataFrame, edges: str, hub: str, max_degree: int | None, rows: int | None = None
) -> DataFrame:
    """(release_id, weight, hops, paths): what ``_hub_rows`` gives, summed over the sources.

    ``counts`` has (source_id, seeds). The sources at a hub are added up before the hub's
    releases are looked up, and what a release must not count is taken off again: sources
    that only this release leads to the hub, and its sole contributor. The rows are those of
    the edges, however many sources there are.
    """
    via = materialize(_hubs(graph, own, edges, hub, rows).join(counts, "source_id"))
    total = materialize(via.groupBy(hub).agg(F.sum("seeds").alias("total")))
    reached = graph.join(total, _below(graph.hub_edges(edges), max_degree), edges, hub, total.count())
    itself = via.where("lo = hi").groupBy(hub, F.col("lo").alias("release_id")).agg(F.sum("seeds").alias("itself"))
    alone = via.select(hub, F.col("source_id").alias("sole"), F.col("lo").alias("a"), F.col("hi").alias("b"), "seeds")
    # Releases of several people have no sole contributor. Ids are positive; a negative number that
    # no source has keeps the many rows of such releases from meeting under one key.
    nobody = -1 - F.pmod(F.xxhash64("release_id"), F.lit(1 << 20))
    left = (
        reached.withColumn("sole", F.coalesce("sole", nobody)).join(itself, [hub, "release_id"], "left")
        .join(alone, [hub, "sole"], "left")
        .withColumn(
            "paths",
            F.col("total") - F.coalesce("itself", F.lit(0))
            - F.when((F.col("a") != F.col("b")) | (F.col("a") != F.col("release_id")), F.col("seeds")).otherwise(0),
        )
        .where("paths > 0")
    )
    return left.select("release_id", inv_log_degree(F.col("degree")).alias("weight"), F.lit(2).alias("hops"), "paths")


def hop_label(graph: Graph, sources: DataFrame, max_degree: int | None = None) -> DataFrame:
    """Releases on a source's label, one row per label. Weight 1 / ln(label degree), two hops."""
    return _hub_rows(graph, own_releases(graph, sources), "released_on", "label_id", max_degree)


def hop_producer(graph: Graph, sources: DataFrame, max_degree: int | None = None) -> DataFrame:
    """Releases by a producer of a source's releases, one row per producer."""
    return _hub_rows(graph, own_releases(graph, sources), "produced_by", "producer_id", max_degree)


def _weighed(weight: float, hops: int):
    return F.struct(F.lit(weight).alias("weight"), F.lit(hops).alias("hops"))


def _people_rows(reach: DataFrame, elsewhere: list, always: list) -> DataFrame:
    """One row per (weight, hops): those of ``elsewhere`` where that holds, and those of ``always``."""
    kinds = F.when(F.col("elsewhere"), F.array(*elsewhere, *always)).otherwise(
        F.array(*always) if always else F.array().cast("array<struct<weight:double,hops:int>>")
    )
    return reach.select("source_id", "release_id", F.explode(kinds).alias("k")).select("source_id", "release_id", "k.*")


def all_hops(graph: Graph, sources: DataFrame, max_degree: int | None = None) -> DataFrame:
    """The six hop queries, one after the other, repeats kept. The sources' own releases are stored once."""
    own, rows = _counted(own_releases(graph, sources))
    people = _people_rows(_reach_people(graph, own, rows), [_weighed(1.0, 1), _weighed(2.0, 2)], [_weighed(2.5, 3)])
    return (
        people.unionByName(_row(_several(graph, own), F.lit(1.5), 1))
        .unionByName(_hub_rows(graph, own, "released_on", "label_id", max_degree, rows))
        .unionByName(_hub_rows(graph, own, "produced_by", "producer_id", max_degree, rows))
    )


def reached_totals(graph: Graph, own: DataFrame, counts: DataFrame, depth: int, max_degree: int | None) -> DataFrame:
    """(release_id, bacon_distance, hops, source_count) over all sources.

    Depth 1: people. Depth 2: labels and producers too. Depth 3: friends of friends and
    similar artists, once per label of the release. ``own`` are the sources' own releases
    and ``counts`` has (source_id, seeds); a path counts once per seed of its source.
    """
    def total(rows: DataFrame, weight: float, hops: int, paths) -> DataFrame:
        summed = rows.groupBy("release_id").agg(F.sum(paths).alias("paths")).where("paths > 0")
        return summed.select("release_id", F.lit(weight).alias("weight"), F.lit(hops).alias("hops"), "paths")

    rows = own.count()
    reach = (
        _reach_people(graph, own, rows).join(counts, "source_id").groupBy("release_id")
        .agg(F.sum(F.when(F.col("elsewhere"), F.col("seeds")).otherwise(0)).alias("near"), F.sum("seeds").alias("far"))
    )
    out = total(reach, 1.0, 1, F.col("near")).unionByName(
        total(_several(graph, own).join(counts, "source_id"), 1.5, 1, F.col("seeds"))
    )
    if depth >= 2:
        for edges, hub in (("released_on", "label_id"), ("produced_by", "producer_id")):
            out = out.unionByName(hub_totals(graph, own, counts, edges, hub, max_degree, rows))
    if depth >= 3:
        labelled = reach.join(graph.release_facts().where("labels > 0").select("release_id", "labels"), "release_id")
        out = out.unionByName(total(labelled, 2.0, 2, F.col("near") * F.col("labels")))
        out = out.unionByName(total(labelled, 2.5, 3, F.col("far") * F.col("labels")))
    return out.groupBy("release_id").agg(
        F.min("weight").alias("bacon_distance"), F.min("hops").alias("hops"), F.sum("paths").alias("source_count")
    )


def min_distance(hops: DataFrame, *keys: str) -> DataFrame:
    """The smallest weight and the smallest number of hops per key."""
    return hops.groupBy(*keys).agg(F.min("weight").alias("bacon_distance"), F.min("hops").alias("hops"))


def exclude(candidates: DataFrame, unwanted: DataFrame, key: str = "release_id") -> DataFrame:
    """Candidates that are not in ``unwanted``."""
    return candidates.join(unwanted.select(key).distinct(), key, "left_anti")
