"""Readers and writers of the text formats: logs, lists, playlists, feeds. Schemas are explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavegraph.functions.text import parse_duration
from wavegraph.operators.skew import small_side
from wavegraph.session import materialize

LOG_LINE = r"^(\S+)/(\S+)\s+(\S+)(?:\s+\(time:(\d+):(\d+)\))?(?:\s+(\S+))?(?:\s+(\S+))?\s*$"
PLAYLIST_SCHEMA = "label STRING, release STRING, track STRING, track_ix INT, path STRING, created_at TIMESTAMP"


def scan_url_list(spark: SparkSession, path: str, https_only: bool = False) -> DataFrame:
    """(url): one per line, blank lines dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")
    return lines.where(F.startswith("url", F.lit("https://"))) if https_only else lines


def parse_log(lines: DataFrame) -> DataFrame:
    """Typed columns of log lines in ``value``; a line that is no record keeps its text in ``_corrupt``."""
    text = F.trim("value")
    ok = text.rlike(LOG_LINE)

    def part(n: int):
        return F.when(ok, F.nullif(F.regexp_extract(text, LOG_LINE, n), F.lit("")))

    return lines.where((text != "") & ~F.startswith(text, F.lit("#"))).select(
        part(1).alias("label"), part(2).alias("release"), part(3).alias("tag"),
        part(4).try_cast("bigint").alias("seconds"), part(5).try_cast("int").alias("files"),
        part(6).alias("who"), F.try_to_date(part(7), "yyyyMMdd").alias("day"),
        F.when(~ok, F.col("value")).alias("_corrupt"),
    )


def scan_listen_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def append_listen(events: DataFrame, path: str) -> None:
    """Append events (label, release, tag, seconds, files, who, day) to the log as text lines."""
    line = F.concat(
        F.concat_ws("/", "label", "release"), F.lit(" "), F.col("tag"),
        F.format_string(" (time:%d:%d) ", F.col("seconds"), F.col("files")),
        F.concat_ws(" ", F.col("who"), F.date_format("day", "yyyyMMdd")),
    )
    events.select(line.alias("value")).write.mode("append").text(path)


def scan_known_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path): label/release, one per line; what follows a blank is dropped."""
    return spark.read.text(path).select(F.get(F.split("value", " "), F.lit(0)).alias("path")).where("path <> ''")


def scan_share_list(spark: SparkSession, path: str) -> DataFrame:
    """(time, path, url, image, size, duration): records of six lines with blank lines between."""
    parts = F.transform(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\n"), lambda p: F.trim(p))
    return (
        spark.read.option("lineSep", "\n\n").text(path)
        .where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
        .select(
            F.get(parts, F.lit(0)).try_cast("bigint").alias("time"), F.get(parts, F.lit(1)).alias("path"),
            F.get(parts, F.lit(2)).alias("url"), F.get(parts, F.lit(3)).alias("image"),
            F.get(parts, F.lit(4)).try_cast("bigint").alias("size"),
            F.get(parts, F.lit(5)).try_cast("double").alias("duration"),
        )
    )


def write_share_list(shares: DataFrame, path: str) -> None:
    record = F.concat_ws("\n", *(F.concat(F.lit(" "), F.col(c).cast("string")) for c in
                                 ("time", "path", "url", "image", "size", "duration")))
    shares.select(record.alias("value")).write.option("lineSep", "\n\n").text(path)


def scan_playlist_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=PLAYLIST_SCHEMA, quote='"', escape='"')


def write_playlist_csv(rows: DataFrame, path: str) -> None:
    columns = [c.split()[0] for c in PLAYLIST_SCHEMA.split(", ")]
    rows.select(*columns).write.csv(path, quote='"', escape='"', quoteAll=True)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 0 in their file.

    Files are read in splits. Spark says where in its file a row's split begins, and numbers the rows of a task in their
    order; the lines of the splits before are added up from one count per split.
    """
    rows = materialize(spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), "value",
    ))
    splits = rows.groupBy("file", "split").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialize(splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    placed = rows.join(small_side(splits, splits.count()), ["file", "split"])
    return placed.select("file", (F.col("before") + F.col("row") - F.col("first")).alias("line"), "value")


def scan_m3u_triples(spark: SparkSession, path: str) -> DataFrame:
    """(list, ix, file, title, seconds): each list is a file whose lines come in threes.

    A list is read in splits, and three lines meet wherever the splits part them. Empty lines at its end do not count.
    """
    lines = numbered_lines(spark, path)
    ends = lines.where("value <> ''").groupBy("file").agg(F.max("line").alias("last"))
    at = F.col("line") % 3
    triples = (
        lines.join(ends, "file").where("line <= last")
        .groupBy(F.col("file").alias("list"), F.floor(F.col("line") / 3).cast("int").alias("ix"))
        .agg(*(F.max(F.when(at == k, F.col("value"))).alias(name) for k, name in enumerate(("source", "title", "time"))))
        .where("time IS NOT NULL")
    )
    name = F.when(F.col("source").rlike("https?:"), F.col("source")).otherwise(F.concat(F.lit("./"), "source"))
    return triples.select("list", "ix", name.alias("file"), "title", parse_duration(F.col("time")).alias("seconds"))


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): page.html files below a folder, or those a pattern names."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")
    )


def scan_audio_listing(spark: SparkSession, path: str, endings: list[str]) -> DataFrame:
    """(path, length) of audio files; the content is not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(path).select("path", "length")
    )


def feed_items(shares: DataFrame, base_url: str) -> DataFrame:
    """The items of the feed, the newest first."""
    from wavegraph.functions import text as x
    from wavegraph.functions.ids import path_part

    name = F.regexp_replace(path_part(F.col("path"), -1), r"-\d+.mp3", "")
    title = x.dedupe_bigrams(F.when(F.upper(name) == name, x.capitalize_words(F.lower(name))).otherwise(name))
    label = x.pretty_label(path_part(F.col("path"), -2))
    when = F.timestamp_seconds("time")
    return shares.select(
        F.concat(title, F.lit(" / "), label).alias("title"),
        F.col("url").alias("description"),
        F.floor("duration").alias("duration"),
        x.format_duration(F.col("duration")).alias("shown_duration"),
        F.concat(F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("pub_date"),
        F.concat(F.lit(base_url), F.col("path")).alias("link"),
        F.md5("path").alias("guid"),
        F.col("size"), F.col("image"), F.col("time"),
    ).orderBy(F.desc("time"), "guid", "size", "duration")


def write_feed(items: DataFrame, path: str) -> None:
    """The items as XML elements, in their order."""
    items.drop("time").write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
