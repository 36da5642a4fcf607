"""From nested release documents to tables, and from those to graph edges.

A document has id, title, country, released, notes, data_quality, master_id, artists[],
extraartists[], tracks[] and, in the wide form, labels[], formats[], genres[], styles[],
videos[], companies[] and series[]. Where a key occurs twice, the first writer wins: the
lowest release id, then the order in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegraph.functions.ids import clean_id, clean_label_name
from wavegraph.functions.text import catalogue_year
from wavegraph.operators.ordering import number_rows
from wavegraph.operators.skew import hot_keys, salted_join


def fresh(rows: DataFrame, fetched_at: str, as_of: Column, days: int = 7) -> DataFrame:
    """Rows fetched less than ``days`` before ``as_of``; older ones must be fetched again."""
    return rows.where(F.col(fetched_at) > as_of - F.make_dt_interval(F.lit(days)))


def _items(docs: DataFrame, array: str, *fields: str) -> DataFrame:
    """One row per array element: release_id, pos and the named fields.

    A release of very many lines may come as several documents of one id. Their elements then carry
    ``place``, the position in the whole release, which counts instead of that in the part.
    """
    rows = docs.select(F.col("id").alias("release_id"), F.posexplode(array).alias("pos", "e"))
    if "place" in docs.schema[array].dataType.elementType.fieldNames():
        rows = rows.withColumn("pos", F.coalesce("e.place", "pos"))
    return rows.select("release_id", "pos", *(F.col(f"e.{f}").alias(f) for f in fields))


def _first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``. An aggregate, so each task sends one row per key."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)) if rest else None
    if best is None:
        return rows.distinct()
    return rows.groupBy(*keys).agg(best.alias("_best")).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def _tracks(docs: DataFrame) -> DataFrame:
    return _items(docs, "tracks", "position", "title", "extraartists").withColumnRenamed("pos", "track_pos")


def _track_credits(docs: DataFrame) -> DataFrame:
    return _tracks(docs).select("release_id", "track_pos", F.posexplode("extraartists").alias("pos", "e")).select(
        "release_id", "track_pos", "pos",
        *(F.col(f"e.{f}").alias(f) for f in ("id", "name", "role", "anv")),
    )


def normalize_catalog(docs: DataFrame) -> dict[str, DataFrame]:
    """artists, releases, release_artists, release_extraartists, tracks and track_artists."""
    main = _items(docs, "artists", "id", "name", "join", "anv").where("id IS NOT NULL AND name IS NOT NULL")
    extra = _items(docs, "extraartists", "id", "name", "role", "anv").where("id IS NOT NULL AND name <> ''")
    credit = _track_credits(docs).where("id IS NOT NULL AND name <> ''")

    def seen(rows: DataFrame, kind: int, track: Column) -> DataFrame:
        return rows.select("id", "name", "release_id", F.lit(kind).alias("kind"), track.alias("track"), "pos")

    people = (
        seen(main, 0, F.lit(0)).unionByName(seen(extra, 1, F.lit(0))).unionByName(seen(credit, 2, F.col("track_pos")))
    )
    order = ["release_id", "kind", "track", "pos"]
    releases = docs.select(
        "id", F.coalesce("title", F.lit("")).alias("title"), "master_id", "country", "released",
        catalogue_year(F.col("released")).alias("year"), "notes", "data_quality",
    )
    return {
        "artists": _first(people, ["id"], order).select("id", "name"),
        "releases": releases.groupBy("id").agg(F.min(F.struct(*releases.columns[1:])).alias("r")).select("id", "r.*"),
        "release_artists": _first(
            main.select("release_id", F.col("id").alias("artist_id"), F.coalesce("join", F.lit("")).alias("join_text"),
                        F.coalesce("anv", F.lit("")).alias("anv"), "pos"),
            ["release_id", "artist_id"], ["pos"]).drop("pos"),
        "release_extraartists": _first(
            extra.select("release_id", F.col("id").alias("artist_id"), F.coalesce("role", F.lit("")).alias("role"),
                         F.coalesce("anv", F.lit("")).alias("anv"), "pos"),
            ["release_id", "artist_id", "role"], ["pos"]).drop("pos"),
        "tracks": _first(_tracks(docs).drop("extraartists"), ["release_id", "track_pos"], ["position", "title"]),
        "track_artists": _first(
            credit.select("release_id", "track_pos", F.col("id").alias("artist_id"),
                          F.coalesce("role", F.lit("")).alias("role"), F.coalesce("anv", F.lit("")).alias("anv"), "pos"),
            ["release_id", "track_pos", "artist_id", "role"], ["pos"]).drop("pos"),
    }


def _dictionary(rows: DataFrame, keys: list[str], id_name: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary, links): an id per distinct key in key order, and (release_id, id)."""
    words = number_rows(rows.select(*keys).distinct(), [], keys, id_name)
    packed = F.to_json(F.struct(*keys))
    links = rows.select("release_id", packed.alias("_key")).distinct()
    coded = words.select(packed.alias("_key"), id_name)
    linked = salted_join(coded, links, "_key", hot_keys(links, "_key")["_key"])
    return words, linked.select("release_id", id_name)


def normalize_catalog_wide(docs: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``normalize_catalog`` and those of labels, formats, genres, styles, videos, companies, series."""
    labels = _items(docs, "labels", "id", "name", "catno").where("id <> 0 AND name <> ''")
    formats = _items(docs, "formats", "name", "qty", "text", "descriptions")
    companies = _items(docs, "companies", "id", "name", "entity_type", "entity_type_name").where("id <> 0 AND name <> ''")
    series = _items(docs, "series", "id", "name", "catno").where("id <> 0 AND name <> ''")
    genres = docs.select(F.col("id").alias("release_id"), F.explode("genres").alias("name")).where("name <> ''")
    styles = docs.select(F.col("id").alias("release_id"), F.explode("styles").alias("name")).where("name <> ''")
    format_keys = ["name", "qty", "text"]
    kinds = formats.select("release_id", *(F.coalesce(k, F.lit("")).alias(k) for k in format_keys))
    format_words, release_formats = _dictionary(kinds, format_keys, "format_id")
    genre_words, release_genres = _dictionary(genres, ["name"], "genre_id")
    style_words, release_styles = _dictionary(styles, ["name"], "style_id")
    described = formats.select(
        *(F.coalesce(k, F.lit("")).alias(k) for k in format_keys), F.explode("descriptions").alias("description")
    ).where("description <> ''").groupBy(*format_keys, "description").agg(F.count(F.lit(1)).alias("uses"))
    first = ["release_id", "pos"]

    def link(rows: DataFrame, name: str, *extra: str) -> DataFrame:
        keyed = rows.select("release_id", F.col("id").alias(name), *extra, "pos")
        return _first(keyed, ["release_id", name], ["pos"]).drop("pos")

    return {
        **normalize_catalog(docs),
        "labels": _first(labels, ["id"], first).select("id", "name", "catno"),
        "release_labels": link(labels, "label_id", "catno"),
        "formats": format_words,
        "release_formats": release_formats,
        "format_descriptions": described.join(format_words, format_keys).select("format_id", "description", "uses"),
        "genres": genre_words,
        "release_genres": release_genres,
        "styles": style_words,
        "release_styles": release_styles,
        "videos": _items(docs, "videos", "src", "duration", "embed", "title", "description").drop("pos"),
        "companies": _first(companies, ["id"], first).select("id", "name", "entity_type", "entity_type_name"),
        "release_companies": link(companies, "company_id"),
        "series": _first(series, ["id"], first).select("id", "name", "catno"),
        "release_series": link(series, "series_id", "catno"),
    }


def build_graph(docs: DataFrame, producer_roles: list[str]) -> dict[str, DataFrame]:
    """Distinct edges of the documents: contributed_to, released_on and produced_by (by credit role)."""
    main = _items(docs, "artists", "id").select("release_id", "id")
    extra = _items(docs, "extraartists", "id", "role")
    people = main.unionByName(extra.select("release_id", "id"))
    labels = _items(docs, "labels", "id", "name").where(clean_label_name(F.col("name")).isNotNull())
    makers = extra.where(F.col("role").isin(producer_roles))

    def edges(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("release_id", clean_id(F.col("id")).alias(name)).dropna().distinct()

    return {
        "contributed_to": edges(people, "artist_id"),
        "released_on": edges(labels, "label_id"),
        "produced_by": edges(makers, "producer_id"),
    }


def graph_nodes(docs: DataFrame, producer_roles: list[str]) -> DataFrame:
    """(kind, id, name) of the graph's nodes: release, artist, label, producer; the first name seen counts."""
    main = _items(docs, "artists", "id", "name").withColumn("role", F.lit(None).cast("string"))
    extra = _items(docs, "extraartists", "id", "name", "role")
    people = main.withColumn("late", F.lit(0)).unionByName(extra.withColumn("late", F.lit(1)))
    labels = _items(docs, "labels", "id", "name").withColumn("name", clean_label_name(F.col("name"))).where("name IS NOT NULL")

    def named(rows: DataFrame, kind: str, *order: str) -> DataFrame:
        valid = rows.withColumn("id", clean_id(F.col("id"))).where("id IS NOT NULL AND name IS NOT NULL AND name <> ''")
        best = valid.groupBy("id").agg(F.min_by("name", F.struct("release_id", *order, "pos")).alias("name"))
        return best.select(F.lit(kind).alias("kind"), "id", "name")

    releases = docs.groupBy("id").agg(F.min("title").alias("name")).select(F.lit("release").alias("kind"), "id", "name")
    makers = people.where(F.col("role").isin(producer_roles))
    return (
        releases.unionByName(named(people, "artist", "late")).unionByName(named(labels, "label"))
        .unionByName(named(makers, "producer", "late"))
    )


def rank_feature(docs: DataFrame, feature: str, top_n: int | None = None) -> DataFrame:
    """(feature, n): how often a label, artist, extraartist or label_id occurs, repeats in a release included."""
    if feature in ("label", "label_id"):
        rows = _items(docs, "labels", "id", "name").where(
            clean_id(F.col("id")).isNotNull() & clean_label_name(F.col("name")).isNotNull()
        )
        value = F.col("name") if feature == "label" else F.concat_ws(": ", "id", "name")
    elif feature == "artist":
        rows = _items(docs, "artists", "name").unionByName(_items(docs, "extraartists", "name"))
        value = F.trim("name")
    elif feature == "extraartist":
        rows = _items(docs, "extraartists", "name", "role").where(F.trim("name") != "")
        role = F.trim(F.coalesce("role", F.lit("")))
        value = F.when(role != "", F.concat(F.trim("name"), F.lit(" ("), role, F.lit(")"))).otherwise(F.trim("name"))
    else:
        raise ValueError(feature)
    counts = rows.select(value.alias("feature")).where("feature <> ''").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = counts.orderBy(F.desc("n"), "feature")
    return ranked.limit(top_n) if top_n else ranked


def names_per_release(
    links: DataFrame, names: DataFrame, hot: list | None = None, chunk: int = 1000, long_group: int = 1_000_000
) -> DataFrame:
    """(release_id, part, names[]): the artist names of a release in id order, ``chunk`` names per row.

    Nearly all releases have one part; a release credited to very many people has more, so
    no row and no task has to hold them all.
    """
    named = salted_join(names.select("artist_id", "name"), links.select("release_id", "artist_id"), "artist_id", hot or [])
    numbered = number_rows(named, ["release_id"], ["artist_id"], "_at", long_group)
    part = F.floor((F.col("_at") - 1) / chunk).cast("int")
    return (
        numbered.groupBy("release_id", part.alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("_at", "name"))).alias("n"))
        .select("release_id", "part", F.col("n.name").alias("names"))
    )
