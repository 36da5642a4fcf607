"""Sources, sinks and streams. Each file that is read was written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavegraph.operators.playlist import AUDIO_ENDINGS
from wavegraph.operators.ordering import number_rows
from wavegraph.plans.import_catalog import import_catalog as import_tables
from wavegraph.session import scratch_path
from wavegraph.sources import catalog as xml
from wavegraph.sources import text as src
from wavegraph.standin import corpus, graph_queries
from wavegraph.standin import tables as t
from wavegraph.standin.catalog_queries import _BEST, _CORE, _CORE_VIEWS, _NOW, _STATE, _WIDE, _WIDE_VIEWS, V, _long, known_before
from wavegraph.standin.registry import ORACLE, query
from wavegraph.streaming import listens as streams
from wavegraph.streaming.matching import MatchState, stream_correlate_pages
from wavegraph.streaming.versions import Versions


def _written(spark, frame, name, writer):
    path = scratch_path(spark, name)
    writer(frame, path)
    return path


def _agg(text, where="true"):
    return f"coalesce(string_agg({text}, ';' ORDER BY pos) FILTER (pos IS NOT NULL AND {where}), '')"


_ROLE = "CASE WHEN l_returnflag = 'A' THEN 'Producer' ELSE 'Mixed By' END"
_DOCS = f"""SELECT id, title, country, released, '' AS notes, title AS data_quality, o_custkey AS master_id,
    {_agg("l_partkey || ':' || artist || ':,:'", "l_returnflag = 'N'")} AS artists,
    {_agg(f"l_partkey || ':' || artist || ':' || {_ROLE} || ':'", "l_returnflag <> 'N'")} AS extraartists,
    {_agg("l_linenumber || ':' || p_name || ' ' || l_suppkey || ':' || l_suppkey || ':' || s_name || ':Written By:'")} AS tracks,
    o_custkey || ':' || any_value(name) || ':C' || id AS labels,
    {_agg("l_linestatus || ':' || qty || ':' || l_returnflag || ':' || p_type")} AS formats,
    {_agg("p_type")} AS genres, {_agg("p_brand")} AS styles,
    {_agg("'v/' || price || ':' || qty || ':true:' || p_name || ':' || p_type")} AS videos,
    {_agg("l_suppkey || ':' || s_name || ':23:Pressed By'")} AS companies,
    any_value(c_nationkey || ':' || c_mktsegment || ':') AS series
    FROM doc_head JOIN label_name ON label_id = o_custkey JOIN customer ON c_custkey = o_custkey LEFT JOIN line_base USING (id)
    GROUP BY id, title, country, released, o_custkey"""


_IMPORT_VIEWS = {**_CORE_VIEWS, **_WIDE_VIEWS}
_IMPORTED = f"""{_CORE} UNION ALL {_WIDE}
    UNION ALL SELECT DISTINCT 'contributed_to', id || '|' || l_partkey FROM line_base WHERE l_partkey <> 0
    UNION ALL SELECT 'released_on', id || '|' || o_custkey FROM doc_head JOIN label_name ON o_custkey = label_id
        WHERE o_custkey <> 0 AND name <> 'Not On Label'
    UNION ALL SELECT DISTINCT 'produced_by', id || '|' || l_partkey FROM line_base WHERE l_partkey <> 0 AND l_returnflag = 'A'
    UNION ALL SELECT 'nodes', 'release|' || id || '|' || title FROM doc_head
    UNION ALL SELECT DISTINCT 'nodes', 'artist|' || l_partkey || '|' || artist FROM line_base WHERE l_partkey <> 0
    UNION ALL SELECT DISTINCT 'nodes', 'label|' || o_custkey || '|' || name FROM doc_head JOIN label_name ON o_custkey = label_id
        WHERE o_custkey <> 0 AND name <> 'Not On Label'
    UNION ALL SELECT DISTINCT 'nodes', 'producer|' || l_partkey || '|' || artist FROM line_base
        WHERE l_partkey <> 0 AND l_returnflag = 'A'"""


def _doc_summary(docs):
    """Every column of a document; arrays as text, with a colon between the parts of an element."""
    def listed(array, *fields):
        part = lambda e: [F.coalesce(e[f].cast("string"), F.lit("")) for f in fields]
        return F.array_join(F.transform(array, lambda e: F.array_join(F.array(*part(e)), ":")), ";").alias(array)

    credit = ("id", "name", "role", "anv")
    tracks = F.array_join(F.transform("tracks", lambda t: F.concat_ws(
        ":", t["position"], t["title"],
        F.array_join(F.transform(t["extraartists"], lambda e: F.array_join(F.array(*(F.coalesce(e[f].cast("string"), F.lit("")) for f in credit)), ":")), ","),
    )), ";")
    formats = F.array_join(F.transform("formats", lambda f: F.concat_ws(
        ":", f["name"], f["qty"], f["text"], F.array_join(f["descriptions"], ","))), ";")
    return docs.select(
        "id", "title", "country", *(F.coalesce(c, F.lit("")).alias(c) for c in ("released", "notes")), "data_quality", "master_id",
        listed("artists", "id", "name", "join", "anv"), listed("extraartists", *credit), tracks.alias("tracks"),
        listed("labels", "id", "name", "catno"), formats.alias("formats"), F.array_join("genres", ";").alias("genres"),
        F.array_join("styles", ";").alias("styles"), listed("videos", "src", "duration", "embed", "title", "description"),
        listed("companies", "id", "name", "entity_type", "entity_type_name"), listed("series", "id", "name", "catno"),
    )


@query("scan_catalog_xml", _DOCS, V)
def scan_catalog_xml(spark, sf):
    return _doc_summary(xml.scan_catalog_xml(spark, corpus.dump(spark, sf)))


@query("scan_small_catalog_xml", _DOCS, V)
def scan_small_catalog_xml(spark, sf):
    return _doc_summary(xml.scan_small_catalog_xml(spark, corpus.dump(spark, sf)))


@query("import_catalog", _IMPORTED, _IMPORT_VIEWS)
def import_catalog(spark, sf):
    """A dump is read once, and all tables and the graph come of it."""
    return _long(import_tables(xml.scan_catalog_xml(spark, corpus.dump(spark, sf)), scratch_path(spark, "catalog"), ["Producer"]))


@query("scan_release_json", """SELECT CAST(release_id AS VARCHAR) AS release_id,
    'https://www.discogs.com/release/' || release_id AS discogs_url, CAST(release_id AS VARCHAR) AS source_ids
    FROM releases""")
def scan_release_json(spark, sf):
    def write(frame, path):
        packed = frame.select(F.array(F.col("release_id").cast("string")).alias("source_ids"), F.array(F.struct(
            F.col("release_id").cast("string").alias("release_id"), "title",
            F.concat(F.lit("https://www.discogs.com/release/"), "release_id").alias("discogs_url"),
        )).alias("releases"), "year")
        wrapped = packed.where("year < 1996").select(F.to_json(F.struct("source_ids", "releases")).alias("value"))
        bare = packed.where("year >= 1996").select(F.to_json("releases").alias("value"))
        wrapped.write.text(f"{path}/wrapped")
        bare.select(F.concat(F.lit("["), F.array_join(F.split("value", "^\\[|\\]$"), ""), F.lit("]")).alias("value")).write.text(f"{path}/bare")

    path = _written(spark, t.releases(spark, sf), "reached", write)
    both = xml.scan_release_json(spark, [f"{path}/wrapped", f"{path}/bare"], lines=True)
    return both.select("release_id", "discogs_url", F.array_join("source_ids", "|").alias("source_ids"))


@query("scan_url_list", "SELECT url FROM pages")
def scan_url_list(spark, sf):
    def write(frame, path):
        frame.select(F.explode(F.array(F.concat(F.lit(" "), "url"), F.lit(""))).alias("value")).write.text(path)

    return src.scan_url_list(spark, _written(spark, t.table(spark, sf, "pages"), "urls", write))


@query("scan_listen_log", """SELECT label, release, tag, seconds, files, who, CAST(CASE WHEN files <> 4 THEN day END AS VARCHAR) AS day,
    false AS corrupt FROM listens WHERE files NOT IN (1, 2, 3)
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM listens WHERE files = 3""")
def scan_listen_log(spark, sf):
    path = _written(spark, t.log_lines(spark, sf).select("line"), "log", lambda f, p: f.write.text(p))
    return src.scan_listen_log(spark, path).select(
        "label", "release", "tag", "seconds", "files", "who", F.col("day").cast("string").alias("day"),
        F.col("_corrupt").isNotNull().alias("corrupt"),
    )


@query("append_listen", """SELECT label, release, tag, seconds, files, who, CAST(day AS VARCHAR) AS day FROM listens""")
def append_listen(spark, sf):
    path = scratch_path(spark, "log")
    log = t.listens(spark, sf)
    src.append_listen(log.where("tag = '__purge'"), path)
    src.append_listen(log.where("tag <> '__purge'"), path)
    return src.scan_listen_log(spark, path).drop("_corrupt").withColumn("day", F.col("day").cast("string"))


@query("scan_known_paths", "SELECT path FROM known")
def scan_known_paths(spark, sf):
    def write(frame, path):
        frame.select(F.concat("path", F.lit(" x")).alias("value")).write.text(path)

    return src.scan_known_paths(spark, _written(spark, t.known(spark, sf), "known", write))


@query("scan_pages", "SELECT label || '/' || release AS stub, CAST(release_id AS BIGINT) AS page_id FROM known JOIN page_all ON page_id = release_id", V)
def scan_pages(spark, sf):
    """One file per page, by partitioned writing; the folder names are label and release."""
    from wavegraph.functions.ids import path_stub

    def write(frame, path):
        folders = frame.select(
            F.try_element_at(F.split("path", "/"), F.lit(-3)).alias("label"),
            F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("release"), F.col("html").alias("value"),
        )
        writer = folders.repartition("label", "release").write.option("compression", "gzip")
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("label", "release").text(path)

    path = _written(spark, corpus.release_pages(spark, sf), "pages", write)
    found = src.scan_pages(spark, path)
    stub = F.regexp_replace(path_stub(F.col("path")), "(label|release)=", "")
    image = F.regexp_extract("html", r"img\.example/(\d+)\.jpg", 1).cast("bigint")
    return found.select(stub.alias("stub"), image.alias("page_id")).where("page_id IS NOT NULL")


def _shares(spark, sf):
    return t.audio(spark, sf).select(
        "time", "path", F.concat(F.lit("https://s.example/"), "release").alias("url"), F.lit("i.jpg").alias("image"),
        "size", "duration",
    )


@query("scan_share_list", """SELECT time, path, 'https://s.example/' || release AS url, 'i.jpg' AS image, size, duration FROM audio""")
def scan_share_list(spark, sf):
    return src.scan_share_list(spark, _written(spark, _shares(spark, sf), "shares", src.write_share_list))


def _feed(spark, sf):
    path = _written(spark, _shares(spark, sf), "shares", src.write_share_list)
    return src.feed_items(src.scan_share_list(spark, path), "https://feed.example/")


@query("share_feed", """SELECT regexp_replace(track, '-[0-9]+.mp3', '') || ' / ' || release AS title,
    'https://s.example/' || release AS description, CAST(floor(duration) AS BIGINT) AS duration,
    strftime(to_timestamp(time) AT TIME ZONE 'UTC', '%a, %d %b %Y %H:%M:%S') || ' +0000' AS pub_date,
    'https://feed.example/' || path AS link, md5(path) AS guid, size, time FROM audio""")
def share_feed(spark, sf):
    return _feed(spark, sf).select("title", "description", "duration", "pub_date", "link", "guid", "size", "time")


@query("feed_columns", """SELECT DISTINCT path, md5(path) AS guid, strftime(to_timestamp(time) AT TIME ZONE 'UTC', '%Y') AS year FROM audio""")
def feed_columns(spark, sf):
    return _feed(spark, sf).select(
        F.replace("link", F.lit("https://feed.example/"), F.lit("")).alias("path"), "guid",
        F.regexp_extract("pub_date", r" (\d{4}) ", 1).alias("year"),
    ).distinct()


@query("latest_first_feed", """SELECT row_number() OVER (ORDER BY time DESC, md5(path), size, duration) AS place,
    md5(path) AS guid, time FROM audio""")
def latest_first_feed(spark, sf):
    items = _feed(spark, sf).select("guid", "time", "size", "duration", (-F.col("time")).alias("_back"))
    return number_rows(items, [], ["_back", "guid", "size", "duration"], "place").select("place", "guid", "time")


@query("share_feed_items", """SELECT count(*) AS items, count(DISTINCT path) AS guids, CAST(sum(size) AS BIGINT) AS bytes FROM audio""")
def share_feed_items(spark, sf):
    """The feed written as XML and read again."""
    path = _written(spark, _feed(spark, sf), "feed", src.write_feed)
    items = spark.read.format("xml").option("rowTag", "item").schema("guid STRING, size BIGINT").load(path)
    return items.agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("guid").alias("guids"), F.sum("size").alias("bytes")
    )


@query("scan_playlist_csv", """SELECT DISTINCT label, release, 'a "b", ' || track AS track, CAST(1 AS INTEGER) AS track_ix, path,
    created_at FROM audio""")
def scan_playlist_csv(spark, sf):
    rows = t.audio(spark, sf).select(
        "label", "release", F.concat(F.lit('a "b", '), "track").alias("track"), F.lit(1).alias("track_ix"), "path", "created_at"
    ).distinct()
    return src.scan_playlist_csv(spark, _written(spark, rows, "csv", src.write_playlist_csv))


@query("scan_m3u_triples", """SELECT './' || path AS file, track AS title, CAST(floor(duration) AS INTEGER) AS seconds FROM audio""")
def scan_m3u_triples(spark, sf):
    def write(frame, path):
        whole = F.floor("duration")
        triple = F.concat_ws("\n", "path", "track", F.format_string("%d:%02d", F.floor(whole / 60), whole % 60))
        frame.select(triple.alias("value")).write.text(path)

    return src.scan_m3u_triples(spark, _written(spark, t.audio(spark, sf), "m3u", write)).select("file", "title", "seconds")


@query("scan_audio_listing", """SELECT s_suppkey AS owner, CASE WHEN s_suppkey % 2 = 0 THEN 'ogg' ELSE 'wav' END AS ending,
    CAST(strlen(s_name) + 1 AS BIGINT) AS length FROM supplier WHERE s_suppkey % 5 <> 0""")
def scan_audio_listing(spark, sf):
    """One small file per supplier, found by its ending; every fifth is no audio file and is not listed."""
    files = t.table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("value"))
    path = scratch_path(spark, "audio")
    kinds = {"ogg": "s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0", "wav": "s_suppkey % 2 = 1 AND s_suppkey % 5 <> 0", "csv": "s_suppkey % 5 = 0"}
    for ending, which in kinds.items():
        # The tasks put their files in place themselves; the driver would move them one by one.
        some = files.where(which).repartition(spark.sparkContext.defaultParallelism, "s_suppkey")
        writer = some.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.option("extension", ending).partitionBy("s_suppkey").csv(path)
    listing = src.scan_audio_listing(spark, path, AUDIO_ENDINGS)
    return listing.select(
        F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("bigint").alias("owner"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("ending"), "length"
    )


@query("write_recommendations_json")
def write_recommendations_json(spark, sf):
    """The ranked recommendations, written and read again."""
    ranked = graph_queries.aggregate_recommendations(spark, sf)
    path = _written(spark, ranked, "json", xml.write_recommendations_json)
    return spark.read.schema(ranked.schema).json(path)


ORACLE["write_recommendations_json"] = ORACLE["aggregate_recommendations"]


# --- streams ----------------------------------------------------------------------------


def _log_stream(spark, sf):
    raw = streams.stream_table(spark, f"{sf}/events.parquet")
    kind = F.col("event_type")
    tag = F.when(kind == "purchase", "__rating_5").when((kind == "view") & (F.col("value") < 20), "__skipping").otherwise("__purge")
    return raw.select(
        F.col("ts").cast("timestamp").alias("ts"), tag.alias("tag"), "value", "user_id",
        F.concat(F.lit("u"), "user_id", F.lit("/"), F.get_json_object("props", "$.k")).alias("path"),
    )


@query("stream_listens_per_day", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS listens FROM events
    WHERE NOT (event_type = 'view' AND value < 20) GROUP BY 1""")
def stream_listens_per_day(spark, sf):
    days = streams.run_updates(streams.stream_listens_per_day(_log_stream(spark, sf)), ["day"])
    return days.withColumn("day", F.col("day").cast("string"))


@query("stream_latest_rating", """SELECT path, max_by(tag, (ts, tag)) AS tag, max(ts) AS ts FROM (
    SELECT ts, 'u' || user_id || '/' || json_extract_string(props, '$.k') AS path, CASE WHEN event_type = 'purchase' THEN '__rating_5'
        WHEN event_type = 'view' AND value < 20 THEN '__skipping' ELSE '__purge' END AS tag FROM events) GROUP BY path""")
def stream_latest_rating(spark, sf):
    log = _log_stream(spark, sf)
    none = spark.createDataFrame([], log.select("path", "tag", "ts").schema)
    known = Versions.start(none, scratch_path(spark, "ratings"))
    streams.stream_latest_rating(log, known, scratch_path(spark, "state"))
    return streams.latest_ratings(known)


# A burst is given out once the watermark (newest row less one hour) has passed its end.
@query("stream_burst_last_value", """SELECT user_id AS control, min(ts) AS start, max_by(value, (ts, value)) AS last_value,
    count(*) AS changes FROM (
        SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
            SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES
                THEN 0 ELSE 1 END AS is_new FROM events))
    GROUP BY user_id, burst
    HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def stream_burst_last_value(spark, sf):
    changes = _log_stream(spark, sf).withColumnRenamed("user_id", "control")
    return streams.run_updates(streams.stream_burst_last_value(changes), ["control", "start"], mode="append")


def _streamed(spark, sf):
    """All pages arrive in three batches, with the state of some known before: (folder of the matches, state)."""
    from wavegraph.functions.text import string_similarity_lev

    arrived = scratch_path(spark, "arrived")
    corpus.release_pages(spark, sf).repartition(3, "page_id").write.option("maxRecordsPerFile", 0).parquet(arrived)
    out, state = scratch_path(spark, "matched"), MatchState.start(*known_before(spark, sf), scratch_path(spark, "known"))
    incoming = spark.readStream.schema(spark.read.parquet(arrived).schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    stream_correlate_pages(
        incoming, corpus.match_catalog(spark, sf), state, out, scratch_path(spark, "state"), string_similarity_lev,
        corpus.match_index(spark, sf),
    )
    return out, state


@query("stream_match_new_pages", f"SELECT page_id, release_id FROM new_page JOIN ({_BEST}) USING (page_id)", _STATE)
def stream_match_new_pages(spark, sf):
    """The best matches of pages that nothing was known of."""
    return spark.read.parquet(_streamed(spark, sf)[0]).select("page_id", "release_id")


@query("stream_match_state", _NOW, _STATE)
def stream_match_state(spark, sf):
    """What is known of all pages after the last batch."""
    matched, failed = _streamed(spark, sf)[1].before(1 << 30)
    return matched.select("stub", "url").unionByName(failed.select("stub", F.lit(None).cast("string").alias("url")))
