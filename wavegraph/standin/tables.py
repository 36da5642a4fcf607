
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegraph.functions.ids import PLACEHOLDER_LABEL
from wavegraph.operators.graph import Graph, clean_edges, first_artists, sources_of
from wavegraph.session import scratch_path

_GRAPHS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_contributions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("artist_id"), F.col("l_orderkey").alias("release_id")
    )


def roles(spark, sf_dir) -> DataFrame:
    """(release_id, artist_id, role): how a release credits its people; main artists have no role."""
    role = F.when(F.col("l_returnflag") == "A", "Producer").when(F.col("l_returnflag") == "R", "Mixed By").otherwise("")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("release_id"), F.col("l_partkey").alias("artist_id"), role.alias("role")
    )


def label_names(spark, sf_dir) -> DataFrame:
    name = F.when(F.col("c_acctbal") < 0, PLACEHOLDER_LABEL).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("label_id"), name.alias("name"))


def artist_names(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("artist_id"), F.col("p_name").alias("name"))


def releases(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("release_id"),
        F.col("o_orderpriority").alias("title"),
        F.year("o_orderdate").alias("year"),
    )


def state_of(spark, sf_dir) -> tuple:
    """What tells a data set from another one in the same place: the sizes and times of its tables."""
    place = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return spark.sparkContext.applicationId, sf_dir, tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def graph(spark, sf_dir) -> Graph:
    """The graph of a data set; stored once per session, like its hot keys."""
    key = state_of(spark, sf_dir)
    if key not in _GRAPHS:
        on = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("release_id"), F.col("o_custkey").alias("label_id")
        )
        made = table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("release_id"), F.col("l_suppkey").alias("producer_id")
        )
        edges = clean_edges(raw_contributions(spark, sf_dir), on, label_names(spark, sf_dir), made)
        _GRAPHS[key] = edges.stored(scratch_path(spark, "graph"))
    return _GRAPHS[key]


def listens(spark, sf_dir) -> DataFrame:
    """The listening log: each event rates or skips one release; the listener stands for the label."""
    kind, value = F.col("event_type"), F.col("value")
    tag = (
        F.when(kind == "purchase", "__rating_5")
        .when(kind == "click", "__rating_4")
        .when((kind == "view") & (value < 20), "__skipping")
        .when(kind == "view", "__rating_3")
        .when(kind == "error", "__purge")
        .when(value < 20, "__rating___nothing")
        .otherwise("__nothing")
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("label"),
        F.col("event_id").cast("string").alias("release"),
        F.concat(F.lit("u"), F.col("user_id"), F.lit("/"), F.col("event_id")).alias("path"),
        tag.alias("tag"),
        F.floor("value").alias("seconds"),
        F.get_json_object("props", "$.k").cast("int").alias("files"),
        F.concat(F.lit("host"), F.get_json_object("props", "$.k")).alias("who"),
        F.col("ts"),
        F.to_date("ts").alias("day"),
        F.col("event_id").alias("release_id"),
        F.col("user_id"),
    )


def log_lines(spark, sf_dir) -> DataFrame:
    """The log as text, with the flaws of a real one: blank lines, comments, cut-off lines, bad dates."""
    log = listens(spark, sf_dir)
    line = F.concat_ws(
        " ", "path", "tag",
        F.concat(F.lit("(time:"), F.col("seconds"), F.lit(":"), F.col("files"), F.lit(")")),
        "who", F.date_format("ts", "yyyyMMdd"),
    )
    text = (
        F.when(F.col("files") == 1, "")
        .when(F.col("files") == 2, F.concat(F.lit("# "), line))
        .when(F.col("files") == 3, F.col("path"))
        .when(F.col("files") == 4, F.concat(line, F.lit("x")))
        .otherwise(line)
    )
    return log.select(text.alias("line"), "ts", "release_id")


def favourite_listener(spark, sf_dir) -> DataFrame:
    """One row: the listener with the most top ratings. Their log gives the seeds."""
    counts = listens(spark, sf_dir).where("tag = '__rating_5'").groupBy("user_id").count()
    return counts.orderBy(F.desc("count"), "user_id").limit(1).select("user_id")


def own_log(spark, sf_dir) -> DataFrame:
    return listens(spark, sf_dir).join(favourite_listener(spark, sf_dir), "user_id")


def seeds(spark, sf_dir) -> DataFrame:
    return own_log(spark, sf_dir).where("tag = '__rating_5'").select("release_id")


def sources(spark, sf_dir) -> DataFrame:
    return sources_of(graph(spark, sf_dir), seeds(spark, sf_dir))


def seed_artists(spark, sf_dir) -> DataFrame:
    return first_artists(graph(spark, sf_dir), seeds(spark, sf_dir))


def seed_labels(spark, sf_dir) -> DataFrame:
    return graph(spark, sf_dir).released_on.join(seeds(spark, sf_dir), "release_id").select("label_id").distinct()


def known(spark, sf_dir) -> DataFrame:
    """All releases on disk, as label/release: the logged ones and those never listened to."""
    heard = listens(spark, sf_dir).select("release_id", F.col("label").alias("heard_as"))
    label = F.coalesce(F.col("heard_as"), F.concat(F.lit("c"), F.col("o_custkey")))
    release = F.col("release_id").cast("string")
    return (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("release_id"), "o_custkey", "o_orderdate", "o_totalprice")
        .join(heard, "release_id", "left")
        .select(
            "release_id", label.alias("label"), release.alias("release"),
            F.concat_ws("/", label, release).alias("path"), F.col("o_orderdate").alias("created_at"),
        )
    )


def audio(spark, sf_dir, *more: str) -> DataFrame:
    """One audio file per line item, under its release's folder; ``more`` names columns to keep beside."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("release_id"),
        F.concat(
            F.lit("a"), F.col("l_partkey"), F.lit(" - t"), F.col("l_linenumber"), F.lit("-"), F.col("l_suppkey"),
            F.lit(".mp3"),
        ).alias("track"),
        F.col("l_extendedprice").cast("bigint").alias("size"),
        (F.col("l_quantity") * 37.5).alias("duration"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("time"),
    )
    return lines.join(known(spark, sf_dir), "release_id").select(
        "label", "release", "track", F.concat_ws("/", "path", "track").alias("path"), "created_at", "size",
        "duration", "time", *more,
    )
