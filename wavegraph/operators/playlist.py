"""The playlist table: built from rated releases and their files, browsed by label and release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegraph.functions.ids import path_part
from wavegraph.operators.listening import filter_rating, newest_rows
from wavegraph.operators.ordering import LONG_GROUP, neighbours, number_rows
from wavegraph.operators.skew import small_side
from wavegraph.session import materialize

# Endings of audio files.
AUDIO_ENDINGS = ["mp3", "ogg", "m4a", "m5a", "flac", "aiff", "wav"]


def track_row(line: Column) -> list[Column]:
    """label, release, track, path and created_at of a line YYYYMMDD/.../label/release/track."""
    day = F.left(line, F.lit(8))
    return [
        path_part(line, -3).alias("label"),
        path_part(line, -2).alias("release"),
        path_part(line, -1).alias("track"),
        F.substring(line, 9, 1 << 30).alias("path"),
        F.try_to_timestamp(day, F.lit("yyyyMMdd")).alias("created_at"),
    ]


def rated_files(log: DataFrame, audio: DataFrame) -> DataFrame:
    """Files of the top-rated releases with the day of the rating."""
    rated = filter_rating(log).groupBy("label", "release").agg(F.max("day").alias("rated_on"))
    return audio.join(rated, ["label", "release"])


def with_track_index(files: DataFrame, long_group: int = LONG_GROUP) -> DataFrame:
    """Add the 0-based ``track_ix`` within a release, in path order."""
    numbered = number_rows(files, ["label", "release"], ["path"], "track_ix", long_group)
    return numbered.withColumn("track_ix", F.col("track_ix") - 1)


def new_tracks(existing: DataFrame, incoming: DataFrame, version: str) -> DataFrame:
    """Rows to append to the table: paths that it lacks, once each, with a version."""
    once = incoming.dropDuplicates(["path"]).join(existing.select("path"), "path", "left_anti")
    if "version" not in once.columns:
        once = once.withColumn("version", F.lit(None).cast("string"))
    return once.withColumn("version", F.coalesce("version", F.lit(version)))


def playlist_mart(log: DataFrame, audio: DataFrame, existing: DataFrame, version: str) -> DataFrame:
    """The rows that a run adds to the playlist table."""
    files = rated_files(log, audio).dropDuplicates(["path"])
    line = F.concat(F.date_format("rated_on", "yyyyMMdd"), F.lit("/"), F.col("path"))
    rows = files.select(*track_row(line)).withColumn("path", F.ltrim("path", F.lit("/")))
    return new_tracks(existing, with_track_index(rows), version)


def filter_recent(tracks: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Tracks of the last days before ``as_of``."""
    return tracks.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))


def filter_search(tracks: DataFrame, text: str = "", **equal: str) -> DataFrame:
    """All non-empty conditions at once: column = value, and the path holds ``text``."""
    wanted = F.lit(True)
    for column, value in equal.items():
        if value:
            wanted = wanted & (F.col(column) == value)
    if text:
        wanted = wanted & F.contains(F.lower("path"), F.lit(text.lower()))
    return tracks.where(wanted)


def filter_unconverted(tracks: DataFrame) -> DataFrame:
    """Tracks that are not marked as converted; a missing mark counts as not."""
    return tracks.where(~F.coalesce("converted", F.lit(False)))


def browse(tracks: DataFrame, limit: int = 1000) -> DataFrame:
    """The newest tracks."""
    return newest_rows(tracks, limit, "created_at", [F.desc("created_at"), F.col("path")])


def release_representative(tracks: DataFrame) -> DataFrame:
    """One row per release: its first track."""
    return tracks.groupBy("label", "release").agg(
        F.min("track").alias("track"), F.min_by("path", F.struct("track", "path")).alias("path")
    )


def item_ordinal(tracks: DataFrame, by_release: bool, long_group: int = LONG_GROUP) -> DataFrame:
    """Add ``id``: the 0-based position in the release's listing, newest first; 0 in a listing of many releases."""
    if not by_release:
        return tracks.withColumn("id", F.lit(0))
    aged = tracks.withColumn("_age", -F.unix_timestamp(F.col("created_at").cast("timestamp")))
    out = number_rows(aged, ["label", "release"], ["_age", "path"], "id", long_group)
    return out.withColumn("id", F.col("id") - 1).drop("_age")


def track_neighbours(tracks: DataFrame, long_group: int = LONG_GROUP) -> DataFrame:
    """(label, release, path, prev, next) within a release, with wrap-around."""
    rows = tracks.select("label", "release", "path").distinct()
    return neighbours(rows, ["label", "release"], ["path"], "path", "prev", "next", True, long_group)


def release_neighbours(tracks: DataFrame, long_group: int = LONG_GROUP) -> DataFrame:
    """(label, release, prev, next) within a label, with wrap-around."""
    rows = tracks.select("label", "release").distinct()
    return neighbours(rows, ["label"], ["release"], "release", "prev", "next", True, long_group)


def label_neighbours(tracks: DataFrame) -> DataFrame:
    """(label, prev, next) over all labels, with wrap-around."""
    return neighbours(tracks.select("label").distinct(), [], ["label"], "label", "prev", "next", True)


def uniq_adjacent(lines: DataFrame, group: list[str], order: list[str], value: str,
                  long_group: int = LONG_GROUP) -> DataFrame:
    """Drop a row whose ``value`` is that of the row before it."""
    seen = neighbours(lines, group, order, value, "_before", "_after", False, long_group)
    return seen.where(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before", "_after")


# A release with more titles or files than this is matched by a join; the pairs of a shorter one are tried where it lies.
LONG_RELEASE = 300


def _title_forms(wanted: Column) -> tuple[Column, Column]:
    """The full title, and the part after the dash."""
    return F.trim(wanted), F.trim(F.coalesce(F.get(F.split(wanted, "-", 2), F.lit(1)), F.lit("")))


def _joined_pairs(titles: DataFrame, files: DataFrame) -> DataFrame:
    """(release, wanted, file): the names of files are cut at every place a title can end, so the match is an equi-join."""
    keys = titles.select(
        "release", "wanted", F.posexplode(F.array(*_title_forms(F.col("wanted")))).alias("form", "prefix"),
    ).where("prefix <> ''")
    lengths = keys.groupBy("release").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    cut = (
        files.join(lengths, "release")
        .select("release", "file", F.explode("lengths").alias("n"))
        .where(F.length("file") >= F.col("n"))
        .select("release", "file", F.substring(F.col("file"), F.lit(1), F.col("n")).alias("prefix"))
    )
    tried = keys.join(cut.distinct(), ["release", "prefix"])
    best = tried.groupBy("release", "wanted").agg(F.min("form").alias("form"))
    return tried.join(best, ["release", "wanted", "form"]).select("release", "wanted", "file").distinct()


def _matches(wanted: Column, files: Column) -> Column:
    """(wanted, files[]) for every title: the files that start with it, or else those that start with its last part."""
    def named(prefix: Column) -> Column:
        return F.filter(files, lambda f: (prefix != "") & F.startswith(f, prefix))

    def best(title: Column) -> Column:
        whole, part = (named(prefix) for prefix in _title_forms(title))
        return F.struct(title.alias("wanted"), F.when(F.size(whole) > 0, whole).otherwise(part).alias("files"))

    return F.filter(F.transform(wanted, best), lambda m: F.size(m["files"]) > 0)


def playlist_file_match(titles: DataFrame, files: DataFrame, long_release: int = LONG_RELEASE) -> tuple[DataFrame, DataFrame]:
    """Match wanted titles "artist - title" to the local files of the same release.

    A file matches if its name starts with the full title; where no file does, if it starts with
    the part after the dash. Titles and files of a release meet in one grouping; a release of very many of either is joined.
    Gives (release, wanted, file) and, per release, (release, n_wanted, n_matched, complete).
    """
    no_text = F.lit(None).cast("string")
    both = titles.select("release", "wanted", no_text.alias("file"), F.lit(1).alias("asked")).unionByName(
        files.select("release", no_text.alias("wanted"), "file", F.lit(None).cast("int").alias("asked"))
    )
    # Without a release nothing matches, and a release may have any number of rows.
    placed = both.where("release IS NOT NULL")
    counts = placed.groupBy("release").agg(F.count("asked").alias("t"), F.count("file").alias("f"))
    long = materialize(counts.where(F.greatest("t", "f") > long_release).select("release"))
    many = long.count()
    if many:
        long = small_side(long, many)
        placed = placed.join(long, "release", "left_anti")
    found = placed.groupBy("release").agg(
        F.collect_set("wanted").alias("wanted"), F.collect_set("file").alias("files"), F.count("asked").alias("n_wanted")
    ).select("release", "n_wanted", _matches(F.col("wanted"), F.col("files")).alias("matches"))
    pairs = found.select("release", F.explode("matches").alias("m")).select("release", "m.wanted", F.explode("m.files").alias("file"))
    matched = F.aggregate("matches", F.lit(0).cast("bigint"), lambda n, m: n + F.size(m["files"]))
    report = found.where("n_wanted > 0").select("release", "n_wanted", matched.alias("n_matched"))
    nowhere = titles.where("release IS NULL").groupBy("release").agg(F.count(F.lit(1)).alias("n_wanted"))
    report = report.unionByName(nowhere.withColumn("n_matched", F.lit(0).cast("bigint")))
    if many:
        some = titles.join(long, "release", "left_semi")
        joined = materialize(_joined_pairs(some, files.join(long, "release", "left_semi")))
        wanted = some.groupBy("release").agg(F.count(F.lit(1)).alias("n_wanted"))
        counted = joined.groupBy("release").agg(F.count(F.lit(1)).alias("n_matched"))
        report = report.unionByName(wanted.join(counted, "release", "left").fillna({"n_matched": 0}))
        pairs = pairs.unionByName(joined)
    return pairs, report.withColumn("complete", F.col("n_wanted") == F.col("n_matched"))


def pick_encoding(files: DataFrame, level: int) -> DataFrame:
    """(stem, file): per track the best file for a level: opus below 1, m5a below 2, else mp3."""
    by_kind = files.select(
        F.regexp_extract("path", r"^(.*)\.[^.]*$", 1).alias("stem"), F.regexp_extract("path", r"\.([^.]*)$", 1).alias("kind")
    ).where(F.col("kind").isin("opus", "m5a", "mp3"))
    has = {k: F.max(F.col("kind") == k).alias(k) for k in ("opus", "m5a", "mp3")}
    choice = F.when(F.col("mp3"), F.lit("mp3"))
    if level < 2:
        choice = F.when(F.col("m5a"), F.lit("m5a")).otherwise(choice)
    if level < 1:
        choice = F.when(F.col("opus"), F.lit("opus")).otherwise(choice)
    return by_kind.groupBy("stem").agg(*has.values()).select(
        "stem", F.concat("stem", F.lit("."), choice).alias("file")
    ).dropna()


def capped_grid_sample(items: DataFrame, width: int) -> DataFrame:
    """At most ``width`` items with distinct (cell, hue) in each brightness bucket, by item id.

    Items (id, hue, saturation, brightness), each between 0 and 1. Too dark, too bright and
    washed-out items are dropped. The cap is the feature (the size of the mosaic) and is
    applied within each task first.
    """
    level = (F.col("brightness") - 0.05) / 0.9
    kept = (
        items.where("brightness BETWEEN 0.05 AND 0.95")
        .withColumn("level", level)
        .where(~((F.col("saturation") < 0.10) & (F.col("level") > 0.2) & (F.col("level") < 0.9)))
        .withColumn("bucket", F.least(F.rint(F.col("level") * width).cast("int"), F.lit(width - 1)))
        .withColumn("cell", F.rint(F.col("level") * width * width).cast("int"))
    )
    first = kept.groupBy("bucket", "cell", "hue").agg(F.min("id").alias("id"))
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
    return first.withColumn("_at", at).where(F.col("_at") <= width).drop("_at")
