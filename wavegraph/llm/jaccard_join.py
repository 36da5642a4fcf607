"""N-gram Jaccard join: all pairs of texts whose shingle sets are alike, and the groups they form.

Texts are points of the metric space of shingle sets. Two texts are linked at a Jaccard distance of
at most r = 1 - ``similarity``, so their sets differ by a bounded number of shingles, which their
sizes give. Regions are cut so that linked texts meet: the shingles are dealt by their hash into more
parts than linked sets can differ in, so linked sets have a part in common, and every common part is
a region. Sizes come in classes; a text that may be linked with one of the next class goes into the
regions of both (the boundary windows).

In a region the text of the least id is the pivot. Every other text is measured against it, which
links most groups of near copies in a pass that is linear in the region. Where a region still holds
texts of several groups, other texts take the pivot's place a few times, each text measured against one of them. Then the
pairs between groups remain, and of these only such as the triangle
inequality leaves: distances to the pivot may differ by r at most, and a parity sketch of 512 bits,
whose bits differ in no more places than the sets do, must be near enough. Linked sets share most of
their regions, so a set may leave out some of its most frequent ones. What remains is counted exactly.

Voronoi cells of sampled texts alone would not cut this space: texts that are not near copies share
next to no shingles, so all pivots are at distance 1 and every window would hold every text.

Scale: only parts that two texts have leave the blocks as rows; shingle sets are made and sent only
for pairs that are measured. Equal sets are one point. Regions are joined by key, where Spark splits hot
keys, and never gathered.

Defined cases: a null text, or one without words, has no shingles and is linked with nothing; a text
of fewer words than a shingle is one shingle; a null id is never a group's id, unless all are null;
other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavegraph.llm.blocks import LAST, ROW_BITS, among, few_at_once, packed_blocks, shared_hashes, unpack
from wavegraph.llm.common import NOT_BLANK, batched, mix, slices, split_words, table, windows, word_hashes
from wavegraph.llm.components import components
from wavegraph.operators.skew import small_side
from wavegraph.session import materialize, settle

SHINGLE = 4
SIMILARITY = 85  # per cent
CLASS_WIDTH = 1.5
SPARE_PARTS = 3
SKETCH_LONGS = 8
# Sketches that are made together.
SKETCHED = 1000
# How often regions of several groups are tried with another pivot before the pairs between their groups are.
TURNS = 4
# Near copies share many regions, so one of so many regions is tried in a turn.
TRIED = 4
# The pairs of a region of no more texts are few, so it is not tried again.
LONG_REGION = 64

_SALT = np.uint64(0x5851F42D4C957F2D)
_OTHER = np.uint64(0x14057B7EF767814F)


def _class_bounds(width: float = CLASS_WIDTH) -> np.ndarray:
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * width)))
    return np.array(bounds, np.int64)


_BOUNDS = _class_bounds()


def most_differ(sizes: np.ndarray, similarity: int) -> np.ndarray:
    """In how many shingles linked sets can differ, from the sum of their sizes.

    With d of them in one set only, the union is half of the sizes and d; d is at most the share
    1 - similarity of the union.
    """
    apart = 100 - similarity
    return apart * sizes // (200 - apart)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every text, sorted."""
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start, stop in slices(texts):
        data, first, end, row = split_words(texts.slice(start, stop - start), NOT_BLANK, lower=True)
        words = word_hashes(data, first, end)
        found, place = windows(words, row, size)
        rows.append(row[place] + start)
        hashes.append(found)
        count = np.bincount(row, minlength=stop - start)
        for few in range(1, size):
            found, place = windows(words, row, few)
            whole = count[row[place]] == few
            rows.append(row[place][whole] + start)
            hashes.append(mix(found[whole] + np.uint64(few)))
    row, hash = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hash, row))
    row, hash = row[order], hash[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hash[1:] != hash[:-1])
    return row[new], hash[new]


def part_keys(row: np.ndarray, hash: np.ndarray, n: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row) for every part of every set, in its class of sizes and, near the border, in the next; and of every set,
    in how many parts of a class it has shingles, at least.

    An empty part is a key only for the few sets that could agree with a linked one in empty parts alone.
    """
    keys, owners = [], []
    least = np.full(len(n), 1 << 30)
    own = np.searchsorted(_BOUNDS, np.maximum(n, 1), side="right") - 1
    up = (n > 0) & (100 * n >= similarity * _BOUNDS[own + 1])
    for shift, member in ((0, n > 0), (1, up)):
        kind = own + shift
        largest = _BOUNDS[kind + 1] - 1
        parts = most_differ(2 * largest, similarity) + 1 + SPARE_PARTS
        parts[~member] = 0
        offset = np.concatenate([[0], np.cumsum(parts)])
        mine = member[row]
        r, h = row[mine], mix(hash[mine] ^ _SALT)
        slot = offset[r] + ((h >> np.uint64(32)) % parts[r].astype(np.uint64)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h[order] + _OTHER), dtype=np.uint64)])
        edge = np.searchsorted(slot[order], np.arange(offset[-1] + 1))
        content = total[edge[1:]] - total[edge[:-1]]
        filled = edge[1:] > edge[:-1]
        owner = np.repeat(np.arange(len(n)), parts)
        number = np.arange(offset[-1]) - offset[:-1][owner]
        key = mix(content + mix((kind[owner] << 40).astype(np.uint64) + number.astype(np.uint64) + _OTHER))
        full = np.bincount(owner, weights=filled, minlength=len(n)).astype(np.int64)
        least[member] = np.minimum(least, full)[member]
        partner = np.minimum(largest, 100 * n // similarity)
        doubtful = full <= most_differ(n + partner, similarity)
        used = filled | doubtful[owner]
        keys.append(key[used] | np.uint64(1))
        owners.append(owner[used])
    return np.concatenate(keys), np.concatenate(owners), least


def sketches(row: np.ndarray, hash: np.ndarray, count: int) -> np.ndarray:
    """Of every set, which of 512 buckets of the hash hold an odd number of its shingles; ``row`` ascends."""
    bits = SKETCH_LONGS * 64
    place = (mix(hash ^ _OTHER) >> np.uint64(55)).astype(np.int64)
    out = np.zeros((count, SKETCH_LONGS), np.int64)
    for first in range(0, count, SKETCHED):
        size = min(SKETCHED, count - first)
        start, stop = np.searchsorted(row, (first, first + size))
        slot = (row[start:stop] - first) * bits + place[start:stop]
        odd = (np.bincount(slot, minlength=size * bits) & 1).astype(np.uint8).reshape(size, bits)
        out[first : first + size] = np.packbits(odd, axis=1).view(np.int64)
    return out


_POINT = "row long, id long, digest binary, n long, full long, node string, sketch array<long>, regions array<long>"


def points(docs: DataFrame, id: str, text: str, shingle: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """A row per text: digest (MD5 of the text), n (shingles), node (a name of the set), and, if any region has two texts, its regions;
    and the blocks, which hold the texts."""
    blocks, buckets = packed_blocks(docs, id, text)

    def keys(ids: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        row, hash = shingle_sets(texts, shingle)
        return part_keys(row, hash, np.bincount(row, minlength=len(ids)), similarity)[:2]

    def build(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, blob in zip(left["block"], left["blob"]):
            ids, texts = unpack(blob)
            row, hash = shingle_sets(texts, shingle)
            n = np.bincount(row, minlength=len(ids))
            found, owner, full = part_keys(row, hash, n, similarity)
            known = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(d, np.uint64) for d in right["data"])])
            use = among(found, known)
            found, owner = found[use].view(np.int64), owner[use]
            order = np.argsort(owner, kind="stable")
            regions = np.split(found[order], np.searchsorted(owner[order], np.arange(1, len(ids))))
            ends = np.concatenate([[0], np.cumsum(n)])
            sketch = sketches(row, hash, len(ids))
            upto = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hash ^ s), dtype=np.uint64)]) for s in (_SALT, ~_SALT)]
            sums = [u[ends[1:]] - u[ends[:-1]] for u in upto]
            for k, (ident, body) in enumerate(zip(ids.tolist(), texts)):
                live = len(regions[k]) > 0
                names = "".join(f"{int(s[k]):016x}" for s in sums)
                out.append((
                    (int(number) << ROW_BITS) + k, None if ident == LAST else ident, hashlib.md5(body.as_buffer()).digest(), int(n[k]), int(full[k]), names if live else None,
                    sketch[k] if live else None, regions[k] if live else None,
                ))
        frame = pd.DataFrame(out, columns=["row", "id", "digest", "n", "full", "node", "sketch", "regions"])
        return frame.astype({"id": "Int64"})

    def joined() -> DataFrame:
        shared = materialize(shared_hashes(blocks, buckets, keys))
        return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(build, _POINT)

    made = settle(joined)
    batched(docs)
    return made, blocks


def _sets(blocks: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(row, shingles) of ``rows``: of the blocks that hold them, only their texts are taken apart."""
    wanted = rows.groupBy(F.shiftright("row", ROW_BITS).alias("block")).agg(F.collect_set("row").alias("wanted"))
    held = blocks.select("block", "blob").join(small_side(wanted, rows.count()), "block").select("blob", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                wanted = np.sort(np.array(wanted))
                texts = unpack(blob.as_py())[1].take(pa.array(wanted & ((1 << ROW_BITS) - 1)))
                row, hash = shingle_sets(texts, shingle)
                parts = np.split(hash, np.searchsorted(row, np.arange(1, len(wanted))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wanted), pa.array([p.tobytes() for p in parts], pa.binary())], names=["row", "shingles"]
                )

    made = materialize(few_at_once(held).mapInArrow(run, "row long, shingles binary"))
    batched(made)
    return made


def _measured(pairs: DataFrame, blocks: DataFrame, shingle: int) -> DataFrame:
    """(a, b, an, bn, common): the sizes of the two sets of each pair, and how many shingles they share.

    Only sets that occur in a pair are made and sent, and they are deleted when the numbers are stored.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                found.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            numbers = np.array(found, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, numbers)], names=["a", "b", "an", "bn", "common"]
            )

    def counted() -> DataFrame:
        sent = _sets(blocks, materialize(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()), shingle)
        joined = (
            pairs.select("a", "b").join(sent.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sent.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")
        )
        return batched(joined.select("a", "b", "x", "y")).mapInArrow(count, "a long, b long, an long, bn long, common long")

    return settle(counted)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not in one group by ``roots``."""
    for end in ("a", "b"):
        named = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        pairs = pairs.join(named, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    return pairs.where("a_root <> b_root").drop("a_root", "b_root")


def _rooted(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """``placed`` with the group of each row by ``roots``; a row without links is a group."""
    return placed.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))


def _other_pivots(placed: DataFrame, roots: DataFrame, facts: DataFrame, similarity: int, turn: int) -> DataFrame:
    """(a, b): texts in regions of several groups, each with one pivot ``b`` of another group that it may be linked with.

    Every such region takes another text as its pivot in every turn, and a text is held against one of those of its regions that are near it.
    """
    grouped = _rooted(placed.select("region", "row"), roots)
    chance = F.xxhash64("row", "region", F.lit(turn))
    pivots = grouped.groupBy("region").agg(
        F.min_by(F.struct("row", "root"), chance).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi")
    ).where("lo < hi").select("region", F.col("p.row").alias("b"), F.col("p.root").alias("b_root"))
    apart = grouped.join(pivots, "region").where("root <> b_root").select(F.col("row").alias("a"), "b").distinct()
    of_b = facts.select(F.col("row").alias("b"), F.col("n").alias("p_n"), F.col("sketch").alias("p_sketch"))
    near = apart.join(facts.withColumnRenamed("row", "a"), "a").join(of_b, "b").where(_near(similarity))
    return near.groupBy("a").agg(F.min_by("b", F.xxhash64("b", F.lit(turn))).alias("b")).select("a", "b")


def _near(similarity: int, left: str = "", right: str = "p_") -> str:
    """SQL: the sizes and the sketches allow the two sets to be linked."""
    differ = " + ".join(f"bit_count({left}sketch[{k}] ^ {right}sketch[{k}])" for k in range(SKETCH_LONGS))
    apart = 100 - similarity
    return (
        f"100 * least({left}n, {right}n) >= {similarity} * greatest({left}n, {right}n) AND "
        f"({differ}) * {200 - apart} <= {apart} * ({left}n + {right}n)"
    )


def groups(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY,
    whole: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(one row per text: row, doc_id, digest, n_shingles, component_id, root, rep), and links (a, b, common) of rows.

    Texts of equal sets have one ``rep``, the row that stands for them; links are between such rows. They only
    span the groups, unless ``whole`` asks for all of the join: then every linked pair of different sets is there
    once, with a < b.
    ``component_id`` is the least id of the texts that links reach; ``root`` tells groups apart, also without ids.
    """
    all_points, blocks = points(docs, id, text, shingle, similarity)
    live = all_points.where(F.col("node").isNotNull())
    nodes = materialize(live.groupBy("node").agg(F.min("id").alias("least"), F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # Each shingle that only one of two linked sets has spoils one part at most. The other parts that hold shingles are regions
    # of both, so linked sets share at least ``need`` regions; a set that has fewer is linked with no other set.
    apart = 100 - similarity
    need = F.expr(f"full - ({apart} * (n + 100 * n div {similarity})) div {200 - apart}")
    reps = materialize(
        live.join(nodes.select(F.col("rep").alias("row")), "row", "left_semi")
        .withColumn("need", need).where("size(regions) >= need").select("row", "n", "need", "sketch", "regions")
    )
    rows = reps.select("row", F.explode("regions").alias("region"))
    pivots = rows.groupBy("region").agg(F.min("row").alias("pivot"), F.count(F.lit(1)).alias("many")).where("many > 1")
    placed = materialize(rows.join(pivots, "region"))
    facts = reps.select("row", "n", "sketch")
    of_pivot = facts.select(F.col("row").alias("pivot"), F.col("n").alias("p_n"), F.col("sketch").alias("p_sketch"))
    star = (
        placed.where("row != pivot").select("row", "pivot").distinct().join(facts, "row").join(of_pivot, "pivot")
        .where(_near(similarity)).select(F.col("row").alias("a"), F.col("pivot").alias("b"), "n", "p_n")
    )
    star = materialize(star)

    def linked(measured: DataFrame) -> DataFrame:
        return measured.where(
            F.col("common") * 100 >= F.lit(similarity) * (F.col("an") + F.col("bn") - F.col("common"))
        ).select("a", "b", "common")

    if whole:
        from_pivot = _measured(star, blocks, shingle)
        first = materialize(linked(from_pivot))
        roots = components(first)
    else:
        # Each text against one pivot first; then only what is not in its pivot's group by that.
        nearest = star.groupBy("a").agg(F.min_by(F.struct("b", "n", "p_n"), "b").alias("s")).select("a", "s.*")
        from_pivot = _measured(nearest, blocks, shingle)
        first = linked(from_pivot)
        roots = components(first)
        open_pairs = _apart(star.join(nearest.select("a", "b"), ["a", "b"], "left_anti"), roots)
        again = _measured(materialize(open_pairs), blocks, shingle)
        from_pivot = from_pivot.unionByName(again)
        first = materialize(linked(from_pivot))
        roots = components(first)
        # A group may hold texts that are linked with each other and not with the pivots so far. Other pivots join them, text by text.
        long = placed.where(F.col("many") > LONG_REGION)
        for turn in range(TURNS):
            tried = long.where(F.pmod(F.xxhash64("region", F.lit(turn)), F.lit(TRIED)) == 0)
            found = materialize(linked(_measured(materialize(_other_pivots(tried, roots, facts, similarity, turn)), blocks, shingle)))
            if found.isEmpty():
                break
            first = first.unionByName(found)
            roots = components(first)
        first = materialize(first)
    # What the pivots leave: regions with texts of several groups, and the pairs between the groups.
    grouped = _rooted(placed, roots)
    mixed = grouped.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.lit(whole) | F.expr("lo < hi")).select("region")
    distance = from_pivot.select(
        F.col("a").alias("row"), F.col("b").alias("pivot"), (1 - F.col("common") / (F.col("an") + F.col("bn") - F.col("common"))).alias("far")
    )
    # Regions that are not here are those where one of the two is the pivot, or where all are in one group. With the ``need`` - 1
    # most frequent regions of a set left out, two linked sets still meet, in the rarest region that they share.
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("many"), "region"))
    left = (
        grouped.where("row != pivot").join(mixed, "region", "left_semi").select("region", "row", "pivot", "root", "many")
        .withColumn("place", place).join(reps.select("row", "n", "need", "sketch"), "row").where("place >= need")
        .join(distance, ["row", "pivot"], "left")
    )
    carried = ("row", "root", "n", "sketch", "far")
    left = materialize(left.select("region", *carried))
    right = left.select(F.col("region").alias("p_region"), *(F.col(c).alias(f"p_{c}") for c in carried))
    radius = (100 - similarity) / 100 + 1e-9
    test = (
        f"region = p_region AND row < p_row AND {'true' if whole else 'root != p_root'} AND {_near(similarity)} "
        f"AND (far IS NULL OR p_far IS NULL OR abs(far - p_far) <= {radius})"
    )
    between = left.join(right, F.expr(test)).select(F.col("row").alias("a"), F.col("p_row").alias("b")).distinct()
    if whole:  # a pivot has the least row of its region
        first = first.select(F.col("b").alias("a"), F.col("a").alias("b"), "common")
        between = between.join(star.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    second = linked(_measured(materialize(between), blocks, shingle))
    links = materialize(first.unionByName(second))
    roots = components(links)
    rooted = nodes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialize(rooted.join(named, "root").select("node", "root", "component_id", "rep"))
    texts = all_points.select("row", F.col("id").alias("doc_id"), "digest", F.col("n").alias("n_shingles"), "node")
    joined = texts.join(found, "node", "left")
    return joined.select(
        "row", "doc_id", "digest", "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("root", "row").alias("root"), F.coalesce("rep", "row").alias("rep"),
    ), links


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one text of each group: that of the least id. Texts without an id stay.

    Rows are told apart by id and text, so rows of one id may lie in several groups.
    """
    found = settle(lambda: groups(docs, id, text, **options)[0])
    digest = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))

    def same(names: DataFrame) -> Column:
        return (F.col(id) == names["_id"]) & (digest == names["_digest"])

    names = [F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")]
    gone = found.where(F.col("doc_id") > F.col("component_id")).select(*names).distinct()
    gone = small_side(gone, gone.count())
    kept = docs.join(gone, same(gone), "left_anti")
    # Several rows of one id in one group: the first of them stays.
    least = found.where(F.col("doc_id") == F.col("component_id"))
    many = least.groupBy("doc_id", "root").agg(F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    again = materialize(least.join(many, ["doc_id", "root"]).select(*names, F.col("root").alias("_root")).distinct())
    count = again.count()
    if not count:
        return kept
    again = small_side(again, count)
    place = "_place"
    while place in docs.columns:
        place += "_"
    order = Window.partitionBy(again["_id"], again["_root"]).orderBy(text)
    double = kept.join(again, same(again)).select(*(kept[c] for c in kept.columns), F.row_number().over(order).alias(place))
    one = double.where(f"{place} = 1").drop(place)
    return kept.join(again, same(again), "left_anti").unionByName(one)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT x, y FROM c JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
u AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.c WHERE u.y != r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1) AS m USING (doc_id)
"""
