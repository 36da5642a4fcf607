"""Analytics of the listening log: rows (label, release, path, tag, seconds, ts, day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegraph.functions.ids import store_url
from wavegraph.functions.weights import tag_score

# The tags that count as a rating, the best first, and the tag for a skipped release.
RATING_TAGS = ["__rating_5", "__rating_4", "__rating_3", "__purge"]
SKIPPING = "__skipping"


def filter_rating(log: DataFrame, tag: str = "__rating_5") -> DataFrame:
    """Rows with one rating."""
    return log.where(F.col("tag") == tag)


def filter_regex_any(rows: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose ``column`` matches one of the patterns; all rows if there are none."""
    return rows.where(F.col(column).rlike("(" + "|".join(patterns) + ")")) if patterns else rows


def label_rating_distribution(log: DataFrame, known: DataFrame, threshold: int = 5) -> DataFrame:
    """Per label with more than ``threshold`` ratings: share of each rating, weight and coverage.

    A skipped release counts as rated 3. The weight is 4 to 1 from the best rating to a
    purge, by share. Coverage is ratings over known releases of the label.
    """
    tag = F.when(F.col("tag") == SKIPPING, F.lit("__rating_3")).otherwise(F.col("tag"))
    names = {"__rating_5": "f5", "__rating_4": "f4", "__rating_3": "f3", "__purge": "purge"}
    counts = (
        log.select("label", tag.alias("tag")).where(F.col("tag").isin(RATING_TAGS))
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("total"),
            *(F.count_if(F.col("tag") == t).alias(names[t]) for t in RATING_TAGS),
        )
        .where(F.col("total") > threshold)
    )
    totals = known.groupBy("label").agg(F.count(F.lit(1)).alias("known"))
    share = {c: F.col(c) / F.col("total") for c in names.values()}
    weight = share["f5"] * 4 + share["f4"] * 3 + share["f3"] * 2 + share["purge"]
    return counts.join(totals, "label", "left").select(
        "label", "total", *(s.alias(c) for c, s in share.items()), weight.alias("weight"),
        (F.col("total") / F.col("known")).alias("coverage"),
    )


def listens_per_day(log: DataFrame) -> DataFrame:
    """(day, listens) without skipped releases."""
    return log.where(F.col("tag") != SKIPPING).groupBy("day").agg(F.count(F.lit(1)).alias("listens"))


def completion_stats(log: DataFrame, known: DataFrame, as_of: Column) -> DataFrame:
    """One row: percent listened, listens and downloads per day since the first dated row."""
    done = log.agg(F.count(F.lit(1)).alias("done"), F.min("day").alias("first_day"), as_of.alias("as_of"))
    total = known.agg(F.count(F.lit(1)).alias("total"))
    days = F.date_diff("as_of", "first_day")
    one = F.lit(1).alias("one")
    return done.select("*", one).join(total.select("*", one), "one").select(
        "done", "total", days.alias("days"),
        (F.lit(100.0) * F.col("done") / F.col("total")).alias("percent"),
        (F.col("done") / F.nullif(days, F.lit(0))).alias("listens_per_day"),
        (F.col("total") / F.nullif(days, F.lit(0))).alias("downloads_per_day"),
    )


def newest_rows(rows: DataFrame, limit: int, time: str, order: list[Column]) -> DataFrame:
    """The ``limit`` newest rows by the date or timestamp ``time``; ``order`` is the order, with ``time`` first.

    Counts per day tell in which day the oldest of them lies, counts per hour of that day in which hour, and so on
    to the second, until not many more rows than asked for are as new. Only those are compared.
    """
    enough, newer, cut = 4 * limit, 0, None
    units = ("day",) if dict(rows.dtypes)[time] == "date" else ("day", "hour", "minute", "second")
    scope = rows
    for unit in units:
        spans = scope.groupBy(F.date_trunc(unit, time).alias("span")).agg(F.count(F.lit(1)).alias("n")).where("span IS NOT NULL")
        # One row per calendar day, then 24 or 60.
        upto = F.sum("n").over(Window.orderBy(F.desc("span"))) + newer
        row = spans.withColumn("upto", upto).where(F.col("upto") >= limit).orderBy(F.desc("span")).first()
        if row is None:
            break
        cut = row["span"]
        if row["upto"] <= enough:
            break
        newer = row["upto"] - row["n"]
        scope = scope.where(F.date_trunc(unit, time) == F.lit(cut))
    if cut is not None:
        rows = rows.where(F.col(time) >= F.lit(cut))
    return rows.orderBy(*order).limit(limit)


def artist_counts_top_rated(log: DataFrame, audio: DataFrame, tail: int = 50_000) -> DataFrame:
    """Artists of the top-rated releases among the last log rows, by each release's first file name."""
    last = newest_rows(log.select("path", "tag", "ts"), tail, "ts", [F.desc("ts"), F.desc("path")])
    best = filter_rating(last).select(F.col("path").alias("release_path"))
    first_file = (
        audio.select(F.concat_ws("/", "label", "release").alias("release_path"), "track")
        .groupBy("release_path").agg(F.min("track").alias("track"))
    )
    artist = F.trim(F.get(F.split("track", "-"), F.lit(0)))
    return (
        best.join(first_file, "release_path")
        .groupBy(artist.alias("artist")).agg(F.count(F.lit(1)).alias("releases"))
    )


def unlistened(known: DataFrame, log: DataFrame, seed: int = 24, patterns: list[str] | None = None) -> DataFrame:
    """Known paths without a log row, in an order that depends only on the path and the seed."""
    fresh = filter_regex_any(known.select("path"), "path", patterns or [])
    fresh = fresh.join(log.select("path").distinct(), "path", "left_anti")
    return stable_shuffle(fresh, "path", F.lit(str(seed)))


def stable_shuffle(rows: DataFrame, key: str, salt: Column) -> DataFrame:
    """Sort by a hash of key and salt, kept as ``shuffle_key``: the same order for the same salt."""
    hashed = F.md5(F.concat(F.col(key).cast("string"), salt))
    return rows.withColumn("shuffle_key", hashed).orderBy("shuffle_key", key)


def six_hour_bucket(as_of: Column) -> Column:
    """The salt that changes every six hours."""
    return F.floor(F.unix_timestamp(as_of) / (6 * 3600)).cast("string")


def without_paths(log: DataFrame, undone: DataFrame) -> DataFrame:
    """The log without the rows of the given paths."""
    return log.join(undone.select("path").distinct(), "path", "left_anti")


def purged_releases(log: DataFrame) -> DataFrame:
    """(path, purges, seconds, last_ts) of releases that were purged, with all the time spent on them."""
    purges = F.count_if(F.col("tag") == "__purge")
    return (
        log.groupBy("path")
        .agg(purges.alias("purges"), F.sum("seconds").alias("seconds"), F.max("ts").alias("last_ts"))
        .where("purges > 0")
    )


def with_store_url(paths: DataFrame, release_domains: DataFrame, label_domains: DataFrame) -> DataFrame:
    """Add ``url`` to rows (path, label, release): (path, url) and (label, domain) win over the default."""
    return (
        paths.join(release_domains.select("path", F.col("url").alias("_url")), "path", "left")
        .join(label_domains.select("label", F.col("domain").alias("_domain")), "label", "left")
        .withColumn("url", store_url(F.col("label"), F.col("release"), F.col("_url"), F.col("_domain")))
        .drop("_url", "_domain")
    )


def listen_weight_lines(lines: DataFrame, tail: int) -> DataFrame:
    """(path, weight) text of the last log lines, as the shell transform writes them.

    Lines with no time, "nothing" or "skip" are dropped; __purge becomes 0 and __rating is
    removed, which leaves _5 and the like.
    """
    last = newest_rows(lines, tail, "ts", [F.desc("ts"), F.desc("line")])
    text = F.regexp_replace(F.regexp_replace("line", "__purge", "0"), "__rating", "")
    parts = F.split(text, " ")
    return last.where(~F.col("line").rlike("(time:0:0|nothing|skip)")).select(
        F.array_join(F.slice(parts, 1, 2), " ").alias("weight_line")
    )


def log_quality(lines: DataFrame) -> DataFrame:
    """(status, lines): blank, comment, short, double-prefixed, unknown-tag, bad-date and good lines."""
    parts = F.split(F.trim("line"), r"\s+")
    tag = F.try_element_at(parts, F.lit(2))
    status = (
        F.when(F.trim("line") == "", "blank")
        .when(F.startswith(F.trim("line"), F.lit("#")), "comment")
        .when(F.size(parts) < 2, "short")
        .when(tag.rlike("^__rating___"), "double_prefixed")
        .when(tag_score(tag).isNull(), "no_score")
        .when(~F.coalesce(F.try_element_at(parts, F.lit(5)), F.lit("")).rlike(r"^\d{8}$"), "bad_date")
        .otherwise("good")
    )
    return lines.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("lines"))


def latest_rating(log: DataFrame) -> DataFrame:
    """(path, tag, ts): the last row of each path wins."""
    return log.groupBy("path").agg(
        F.max_by("tag", F.struct("ts", "tag")).alias("tag"), F.max("ts").alias("ts")
    )
