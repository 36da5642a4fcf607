"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Vectors are dealt into shards by a hash of their id. In a shard, nodes enter the graph in batches:
a greedy beam search proposes neighbours, and robust pruning keeps a proposal only if no neighbour
kept before is closer to it, by the factor ``ALPHA``, than the node itself; so edges stay few and
point in diverse directions. Queries go to every shard in blocks, a beam search finds candidates,
and the best of all shards are ranked by the exact measure.

The measure is the largest inner product. For the graph, each vector of a shard gets one more
component, which brings it to the length of the shard's longest; then near points are those of large
inner product. Equal vectors are one node with all their ids.

Scale: a shard holds about ``SHARD_ROWS`` vectors, and there are at least ``LEAST_SHARDS``; every
vector is indexed. A block holds about ``BLOCK_QUERIES`` queries. What a query gathers is k rows per
shard. The factor of queries times shards is the work asked for: every query searches all rows.

Defined cases: a row takes no part if its id or vector is null, or the vector is empty, zero, or has
a null or non-finite component; vectors are only compared with those of the same length; of rows with
the same id, one vector (the least) stands for all; a query's own id is no candidate; ties go to the
smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavegraph.llm.common import table
from wavegraph.session import materialize

K = 20
SHARD_ROWS = 20_000
LEAST_SHARDS = 8
BLOCK_QUERIES = 4096
DEGREE = 24
BUILD_BEAM = 64
BEAM = 256
EXPAND = 4
ALPHA = 1.2
# Points that each search begins from; there are enough of them for every cluster of a shard to have one.
ENTRIES = 512
BATCH = 512
REVERSE = 24


class Graph:
    """Directed graph over points; ``links`` has a row of ``DEGREE`` neighbours per point, -1 where there are fewer."""

    def __init__(self, points: np.ndarray, seed: int = 3) -> None:
        self.points = points.astype(np.float32)
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        self.links = np.full((len(points), DEGREE), -1, np.int32)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(points))
        self.entries = order[:ENTRIES].astype(np.int32)
        start = order[:BATCH]
        near = self._ranked(start, np.broadcast_to(start, (len(start), len(start))))
        self.links[start] = self._pruned(start, *near)
        at = len(start)
        while at < len(order):
            size = min(BATCH, at)
            self._insert(order[at : at + size])
            at += size

    def _ranked(self, nodes: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates of each node by distance (squared, as far as it differs between them); itself and repeats are -1."""
        near = np.array(near, np.int32)
        near[near == nodes[:, None]] = -1
        order = np.argsort(near, axis=1)
        ordered = np.take_along_axis(near, order, 1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        dots = np.einsum("pcd,pd->pc", self.points[ordered], self.points[nodes], optimize=True)
        distance = self.norms[ordered] - 2 * dots + self.norms[nodes][:, None]
        distance = np.where(ordered < 0, np.inf, np.maximum(distance, 0))
        order = np.argsort(distance, axis=1, kind="stable")
        return np.take_along_axis(ordered, order, 1), np.take_along_axis(distance, order, 1)

    def _pruned(self, nodes: np.ndarray, near: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Robust pruning of ranked candidates."""
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        for a in range(0, len(nodes), 256):
            cand, far = near[a : a + 256], distance[a : a + 256]
            vectors = self.points[cand]
            alive = np.isfinite(far)
            rows = np.arange(len(cand))
            for k in range(DEGREE):
                best = alive.argmax(axis=1)
                some = alive[rows, best]
                if not some.any():
                    break
                chosen = np.where(some, cand[rows, best], -1)
                out[a : a + 256, k] = chosen
                apart = self.norms[cand] - 2 * np.einsum("pcd,pd->pc", vectors, self.points[chosen], optimize=True) + self.norms[chosen][:, None]
                alive &= ALPHA * ALPHA * apart > far
                alive[rows, best] = False
                alive[~some] = False
        return out

    def _insert(self, nodes: np.ndarray) -> None:
        found, _ = self.search(self.points[nodes], BUILD_BEAM)
        inner = self.norms[nodes][None, :] - 2 * self.points[nodes] @ self.points[nodes].T
        np.fill_diagonal(inner, np.inf)
        few = min(16, len(nodes) - 1)
        mates = nodes[np.argpartition(inner, few, axis=1)[:, :few]] if few > 0 else np.zeros((len(nodes), 0), np.int32)
        self.links[nodes] = self._pruned(nodes, *self._ranked(nodes, np.concatenate([found, mates], axis=1)))
        # The way back: the neighbours get the new nodes as candidates.
        target, origin = self.links[nodes].ravel(), np.repeat(nodes, DEGREE)
        target, origin = target[target >= 0], origin[target >= 0]
        apart = ((self.points[target] - self.points[origin]) ** 2).sum(axis=1)
        order = np.lexsort((apart, target))
        target, origin = target[order], origin[order]
        unique, first, back = np.unique(target, return_index=True, return_inverse=True)
        place = np.arange(len(target)) - first[back]
        near = np.full((len(unique), DEGREE + REVERSE), -1, np.int32)
        near[:, :DEGREE] = self.links[unique]
        use = place < REVERSE
        near[back[use], DEGREE + place[use]] = origin[use]
        for a in range(0, len(unique), 1024):
            part = slice(a, a + 1024)
            self.links[unique[part]] = self._pruned(unique[part], *self._ranked(unique[part], near[part]))

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``beam`` nearest points found, nearest first, -1 where there are fewer."""
        parts = [self._search(queries[a : a + 256], beam) for a in range(0, len(queries), 256)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        queries = queries.astype(np.float32)
        count = len(queries)
        rows = np.arange(count)[:, None]
        # One column more takes what is written for -1.
        seen = np.zeros((count, len(self.points) + 1), bool)
        stamp = np.zeros((count, len(self.points) + 1), np.int16)
        node = np.full((count, beam), -1, np.int32)
        far = np.full((count, beam), np.inf, np.float32)
        done = np.ones((count, beam), bool)
        fresh = np.broadcast_to(self.entries, (count, len(self.entries)))
        while True:
            # A point that several expanded nodes lead to counts once: the last to write its place keeps it.
            number = np.broadcast_to(np.arange(fresh.shape[1], dtype=np.int16), fresh.shape)
            stamp[rows, fresh] = number
            new = (fresh >= 0) & ~seen[rows, fresh] & (stamp[rows, fresh] == number)
            r, c = np.nonzero(new)
            v = fresh[r, c]
            seen[r, v] = True
            gained = np.full(fresh.shape, np.inf, np.float32)
            gained[r, c] = self.norms[v] - 2 * np.einsum("ij,ij->i", self.points[v], queries[r])
            node = np.concatenate([node, fresh], axis=1)
            far = np.concatenate([far, gained], axis=1)
            done = np.concatenate([done, ~new], axis=1)
            best = np.argpartition(far, beam - 1, axis=1)[:, :beam]
            node, far, done = node[rows, best], far[rows, best], done[rows, best]
            open_far = np.where(done, np.inf, far)
            pick = np.argpartition(open_far, min(EXPAND, beam) - 1, axis=1)[:, :EXPAND]
            live = np.isfinite(open_far[rows, pick])
            if not live.any():
                break
            done[rows, pick] = True
            fresh = np.where(live[:, :, None], self.links[node[rows, pick]], -1).reshape(count, -1)
        order = np.argsort(far, axis=1, kind="stable")
        node, far = node[rows, order], far[rows, order]
        return np.where(np.isfinite(far), node, -1), far


class Shard:
    """The vectors of a shard: distinct ones as points of the graph, with the ids of each in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        one = np.ones(len(ids), bool)
        one[1:] = ids[1:] != ids[:-1]
        ids, vectors = ids[one], vectors[one]
        self.vectors, back = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, back.ravel()))
        self.ids = ids[order]
        self.start = np.searchsorted(back.ravel()[order], np.arange(len(self.vectors) + 1))
        squares = (self.vectors**2).sum(axis=1)
        extra = np.sqrt(np.maximum(squares.max() - squares, 0))
        self.graph = Graph(np.column_stack([self.vectors, extra]))

    def nearest(self, id: np.ndarray, queries: np.ndarray, k: int, beam: int) -> list[tuple[int, int, float]]:
        found, _ = self.graph.search(np.column_stack([queries, np.zeros(len(queries))]), max(beam, 2 * k))
        out = []
        for own, query, nodes in zip(id.tolist(), queries, found):
            nodes = nodes[nodes >= 0]
            scores = (self.vectors[nodes] * query).sum(axis=1)
            best = []
            # Of equal vectors only the first ids can be among the nearest.
            for score, node in zip(scores.tolist(), nodes.tolist()):
                mine = self.ids[self.start[node] : self.start[node] + k + 1] if self.start[node + 1] - self.start[node] > k else self.ids[self.start[node] : self.start[node + 1]]
                best += [(-score, other) for other in mine.tolist() if other != own]
            out += [(own, other, -score) for score, other in sorted(best)[:k]]
        return out


def _valid(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, id: str = "vec_id", vector: str = "embedding", beam: int = BEAM,
    shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` nearest to each row of ``queries``."""
    def clean(df: DataFrame) -> DataFrame:
        typed = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        return typed.where(F.col("id").isNotNull() & _valid(F.col("vector"))).withColumn("dim", F.size("vector"))

    points, asked = clean(vectors), materialize(clean(queries))
    shards = max(least_shards, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_queries))
    placed = points.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(rows["id"].to_numpy(), np.stack(rows["vector"].to_list()).astype(np.float64))
        return pd.DataFrame([(int(key[0]), int(key[1]), pickle.dumps(shard, protocol=5))], columns=["dim", "shard", "index"])

    index = materialize(placed.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, index binary"))
    numbered = asked.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    places = index.groupBy("dim").agg(F.collect_set("shard").alias("shards")).withColumnRenamed("dim", "_dim")
    sent = materialize(
        numbered.withColumn("q_block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int"))
        .join(places, F.col("dim") == F.col("_dim")).withColumn("q_shard", F.explode("shards"))
        .select(F.col("dim").alias("q_dim"), "q_shard", "q_block", "id", "vector")
    )
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(right):
            for blob in left["index"]:
                ids, vectors = right["id"].to_numpy(), np.stack(right["vector"].to_list()).astype(np.float64)
                out += pickle.loads(blob).nearest(ids, vectors, k, beam)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    on = ["dim", "shard", "block"]
    found = spread.groupBy(*on).cogroup(sent.groupBy("q_dim", "q_shard", "q_block")).applyInPandas(find, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
