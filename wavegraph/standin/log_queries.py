"""Listening log, playlist table and browsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavegraph.functions import ids, text
from wavegraph.functions.weights import tag_score
from wavegraph.operators import catalog, listening, ordering, playlist
from wavegraph.session import materialize
from wavegraph.standin import tables as t
from wavegraph.standin.graph_queries import _PREF, match_state
from wavegraph.standin.registry import query

_SCORE = """CASE tag WHEN '__purge' THEN 0 WHEN '__rating_3' THEN 1 WHEN '__rating_4' THEN 2
    WHEN '__rating_5' THEN 3 END"""


@query("tag_score", f"SELECT path, tag, {_SCORE} AS score FROM listens")
def tag_score_(spark, sf):
    return t.listens(spark, sf).select("path", "tag", tag_score(F.col("tag")).alias("score"))


@query("filter_rating", "SELECT path, seconds FROM listens WHERE tag = '__rating_5'")
def filter_rating(spark, sf):
    return listening.filter_rating(t.listens(spark, sf)).select("path", "seconds")


@query("filter_regex_any", "SELECT path, tag FROM listens WHERE regexp_matches(path, '(^u1./|77|/9.9$)')")
def filter_regex_any(spark, sf):
    return listening.filter_regex_any(t.listens(spark, sf), "path", ["^u1./", "77", "/9.9$"]).select("path", "tag")


@query("label_rating_distribution", """SELECT label, total, round(f5, 6)::DOUBLE AS f5, round(f4, 6)::DOUBLE AS f4,
    round(f3, 6)::DOUBLE AS f3, round(purge, 6)::DOUBLE AS purge,
    round(4 * f5 + 3 * f4 + 2 * f3 + purge, 6)::DOUBLE AS weight, round(total / n, 6)::DOUBLE AS coverage
    FROM (SELECT label, count(*) AS total, avg((tag = '__rating_5')::INT) AS f5, avg((tag = '__rating_4')::INT) AS f4,
            avg((tag IN ('__rating_3', '__skipping'))::INT) AS f3, avg((tag = '__purge')::INT) AS purge
        FROM listens WHERE tag IN ('__rating_5', '__rating_4', '__rating_3', '__purge', '__skipping')
        GROUP BY label HAVING count(*) > 5)
    LEFT JOIN (SELECT label, count(*) AS n FROM known GROUP BY label) USING (label)""")
def label_rating_distribution(spark, sf):
    out = listening.label_rating_distribution(t.listens(spark, sf), t.known(spark, sf))
    for name in ("f5", "f4", "f3", "purge", "weight", "coverage"):
        out = out.withColumn(name, F.round(name, 6))
    return out


@query("rating_sort", """SELECT label, round(sum(CASE tag WHEN '__rating_5' THEN 4 WHEN '__rating_4' THEN 3
        WHEN '__purge' THEN 1 ELSE 2 END) / count(*), 6)::DOUBLE AS weight
    FROM listens WHERE tag IN ('__rating_5', '__rating_4', '__rating_3', '__purge', '__skipping')
    GROUP BY label HAVING count(*) > 5 ORDER BY 2, 1""")
def rating_sort(spark, sf):
    out = listening.label_rating_distribution(t.listens(spark, sf), t.known(spark, sf))
    return out.select("label", F.round("weight", 6).alias("weight")).orderBy("weight", "label")


@query("listens_per_day", """SELECT CAST(day AS VARCHAR) AS day, count(*) AS listens FROM listens
    WHERE tag <> '__skipping' GROUP BY day""")
def listens_per_day(spark, sf):
    return listening.listens_per_day(t.listens(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("completion_stats", """SELECT done, total, days, round(100 * done / total, 6)::DOUBLE AS percent,
    round(done / days, 6)::DOUBLE AS listens_per_day, round(total / days, 6)::DOUBLE AS downloads_per_day
    FROM (SELECT count(*) AS done, CAST(date_diff('day', min(day), max(day)) AS INTEGER) AS days FROM listens),
         (SELECT count(*) AS total FROM known)""")
def completion_stats(spark, sf):
    out = listening.completion_stats(t.listens(spark, sf), t.known(spark, sf), F.max("day"))
    for name in ("percent", "listens_per_day", "downloads_per_day"):
        out = out.withColumn(name, F.round(name, 6))
    return out


@query("artist_counts_top_rated", """SELECT trim(split_part(track, '-', 1)) AS artist, count(*) AS releases
    FROM (SELECT path FROM (SELECT path, tag FROM listens ORDER BY ts DESC, path DESC LIMIT 50000)
          WHERE tag = '__rating_5') l
    JOIN (SELECT label || '/' || release AS path, min(track) AS track FROM audio GROUP BY 1) f USING (path)
    GROUP BY 1""")
def artist_counts_top_rated(spark, sf):
    return listening.artist_counts_top_rated(t.listens(spark, sf), t.audio(spark, sf))


@query("label_artist_counts", """SELECT label_id, artist_id, count(*) AS n FROM released_on
    JOIN contributed_to USING (release_id) GROUP BY label_id, artist_id""")
def label_artist_counts(spark, sf):
    graph = t.graph(spark, sf)
    return graph.hop(graph.released_on, "contributed_to", "release_id").groupBy("label_id", "artist_id").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("anti_join_unlistened", """SELECT path, md5(path || '24') AS shuffle_key FROM known
    WHERE path NOT IN (SELECT path FROM listens)""")
def anti_join_unlistened(spark, sf):
    return listening.unlistened(t.known(spark, sf), t.listens(spark, sf))


@query("purged_release_report", """SELECT path, count(*) FILTER (tag = '__purge') AS purges,
    CAST(sum(seconds) AS BIGINT) AS seconds, max(ts) AS last_ts
    FROM listens GROUP BY path HAVING count(*) FILTER (tag = '__purge') > 0""")
def purged_release_report(spark, sf):
    return listening.purged_releases(t.listens(spark, sf))


_DOMAINS = {
    "release_domain": """SELECT path, url FROM known JOIN pages ON page_id = release_id""",
    "label_domain": """SELECT 'c' || c_custkey AS label, lower(c_mktsegment) || '.example.com' AS domain
        FROM customer WHERE c_acctbal > 5000""",
}


def domains(spark, sf):
    """(release_domains, label_domains): the recorded addresses of releases and of labels."""
    pages = t.table(spark, sf, "pages").select(F.col("page_id").alias("release_id"), "url")
    by_release = t.known(spark, sf).join(pages, "release_id").select("path", "url")
    by_label = t.table(spark, sf, "customer").where("c_acctbal > 5000").select(
        F.concat(F.lit("c"), "c_custkey").alias("label"),
        F.concat(F.lower("c_mktsegment"), F.lit(".example.com")).alias("domain"),
    )
    return by_release, by_label


_URL = """coalesce(r.url, 'https://' || coalesce(d.domain, k.label || '.bandcamp.com') || '/album/' || k.release)"""


@query("resolve_release_url", f"""SELECT k.path, {_URL} AS url FROM known k LEFT JOIN release_domain r USING (path)
    LEFT JOIN label_domain d USING (label)""", _DOMAINS)
def resolve_release_url(spark, sf):
    return listening.with_store_url(t.known(spark, sf), *domains(spark, sf)).select("path", "url")


@query("top_rated_links", f"""SELECT k.path, {_URL} AS url FROM listens k LEFT JOIN release_domain r USING (path)
    LEFT JOIN label_domain d USING (label) WHERE k.tag = '__rating_5'""", _DOMAINS)
def top_rated_links(spark, sf):
    best = listening.filter_rating(t.listens(spark, sf)).select("path", "label", "release")
    return listening.with_store_url(best, *domains(spark, sf)).select("path", "url")


@query("listen_weight_lines", """SELECT array_to_string(string_split(
        replace(replace(line, '__purge', '0'), '__rating', ''), ' ')[1:2], ' ') AS weight_line
    FROM (SELECT line FROM log_lines ORDER BY ts DESC, line DESC LIMIT 5000)
    WHERE NOT regexp_matches(line, '(time:0:0|nothing|skip)')""")
def listen_weight_lines(spark, sf):
    lines = t.log_lines(spark, sf).withColumn("day", F.to_date("ts"))
    return listening.listen_weight_lines(lines, 5000)


@query("log_quality_report", """SELECT CASE WHEN line = '' THEN 'blank' WHEN line LIKE '#%' THEN 'comment'
        WHEN line NOT LIKE '% %' THEN 'short'
        WHEN split_part(line, ' ', 2) LIKE '\\_\\_rating\\_\\_\\_%' ESCAPE '\\' THEN 'double_prefixed'
        WHEN split_part(line, ' ', 2) NOT IN ('__purge', '__rating_3', '__rating_4', '__rating_5') THEN 'no_score'
        WHEN NOT regexp_matches(split_part(line, ' ', 5), '^[0-9]{8}$') THEN 'bad_date' ELSE 'good' END AS status,
    count(*) AS lines FROM log_lines GROUP BY 1""")
def log_quality_report(spark, sf):
    return listening.log_quality(t.log_lines(spark, sf))


@query("unpurge", """SELECT path, tag FROM listens WHERE path NOT IN (SELECT path FROM listens
    WHERE tag = '__purge' AND seconds > 60)""")
def unpurge(spark, sf):
    log = t.listens(spark, sf)
    undone = log.where("tag = '__purge' AND seconds > 60")
    return listening.without_paths(log, undone).select("path", "tag")


@query("freshness_filter", """SELECT event_id FROM events
    WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS""")
def freshness_filter(spark, sf):
    events = t.table(spark, sf, "events")
    as_of = events.agg(F.max("ts")).first()[0]
    return catalog.fresh(events, "ts", F.lit(as_of).cast("timestamp_ntz")).select("event_id")


# --- match state ------------------------------------------------------------------------

_STATE = {k: _PREF[k] for k in ("matched", "failed")}
_NEW = """SELECT path AS stub, CASE WHEN tag <> '__purge' THEN 'https://www.discogs.com/release/' || release_id END AS url,
    ts FROM listens"""


@query("upsert_match_map", """SELECT stub, url, 'matched' AS state FROM (
        SELECT stub, url FROM fresh_results WHERE url IS NOT NULL UNION ALL
        SELECT stub, url FROM matched WHERE stub NOT IN (SELECT stub FROM fresh_results WHERE url IS NOT NULL))
    UNION ALL SELECT stub, NULL, 'failed' FROM (
        SELECT stub FROM failed UNION SELECT stub FROM fresh_results WHERE url IS NULL)
    WHERE stub NOT IN (SELECT stub FROM matched UNION ALL SELECT stub FROM fresh_results WHERE url IS NOT NULL)""",
       {**_STATE, "fresh_results": _NEW})
def upsert_match_map(spark, sf):
    from wavegraph.plans import correlate

    matched, failed = match_state(spark, sf)
    found = F.when(F.col("tag") != "__purge", ids.release_web_url(F.col("release_id")))
    fresh = t.listens(spark, sf).select(F.col("path").alias("stub"), found.alias("url"), "ts")
    good, bad = correlate.upsert_match_map(matched, failed, fresh)
    return good.select("stub", "url", F.lit("matched").alias("state")).unionByName(
        bad.select("stub", F.lit(None).cast("string").alias("url"), F.lit("failed").alias("state"))
    )


@query("incremental_correlate", """SELECT path FROM known WHERE path NOT IN (SELECT stub FROM matched)
    AND path NOT IN (SELECT stub FROM failed)""", _STATE)
def incremental_correlate(spark, sf):
    from wavegraph.plans import correlate

    pages = t.known(spark, sf).select(F.col("path").alias("stub"))
    return correlate.unseen(pages, *match_state(spark, sf)).select(F.col("stub").alias("path"))


# --- playlist table ---------------------------------------------------------------------

_MART = {
    "ratings": "SELECT label, release, max(day) AS rated_on FROM listens WHERE tag = '__rating_5' GROUP BY label, release",
    "mart_files": """SELECT DISTINCT a.label, a.release, a.track, a.path, CAST(rated_on AS TIMESTAMP) AS created_at
        FROM audio a JOIN ratings USING (label, release)""",
    "present": "SELECT DISTINCT path FROM audio WHERE size > 60000",
    "mart": """SELECT label, release, track, path, created_at,
        row_number() OVER (PARTITION BY label, release ORDER BY path) - 1 AS track_ix FROM mart_files""",
}


@query("listing_join_ratings", """SELECT path, CAST(rated_on AS VARCHAR) AS rated_on, count(*) AS copies
    FROM audio JOIN ratings USING (label, release) GROUP BY 1, 2""", _MART)
def listing_join_ratings(spark, sf):
    return (
        playlist.rated_files(t.listens(spark, sf), t.audio(spark, sf))
        .groupBy("path", F.col("rated_on").cast("string").alias("rated_on")).agg(F.count(F.lit(1)).alias("copies"))
    )


@query("track_row_from_path", """SELECT DISTINCT label, release, track, path,
    strptime(strftime(created_at, '%Y%m%d'), '%Y%m%d') AS created_at FROM audio""")
def track_row_from_path(spark, sf):
    line = F.concat(F.date_format("created_at", "yyyyMMdd"), F.lit("/"), "path")
    rows = t.audio(spark, sf).select(*playlist.track_row(line)).distinct()
    return rows.withColumn("path", F.ltrim("path", F.lit("/")))


def _files(spark, sf):
    return t.audio(spark, sf).select("label", "release", "track", "path", "created_at").distinct()


@query("track_index", """SELECT path, row_number() OVER (PARTITION BY label, release ORDER BY path) - 1
    AS track_ix FROM (SELECT DISTINCT label, release, path FROM audio)""")
def track_index(spark, sf):
    return playlist.with_track_index(_files(spark, sf)).select("path", "track_ix")


@query("playlist_mart_write", """SELECT DISTINCT label, release, track, path, 'v1' AS version FROM audio
    WHERE path NOT IN (SELECT path FROM present)""", _MART)
def playlist_mart_write(spark, sf):
    existing = t.audio(spark, sf).where("size > 60000").select("path").distinct()
    rows = t.audio(spark, sf).select("label", "release", "track", "path")
    return playlist.new_tracks(existing, rows, "v1")


@query("playlist_mart", """SELECT *, 'v1' AS version FROM mart WHERE path NOT IN (SELECT path FROM present)""", _MART)
def playlist_mart(spark, sf):
    existing = t.audio(spark, sf).where("size > 60000").select("path").distinct()
    return playlist.playlist_mart(t.listens(spark, sf), t.audio(spark, sf), existing, "v1")


@query("filter_recent", """SELECT DISTINCT path FROM audio
    WHERE created_at >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAYS""")
def filter_recent(spark, sf):
    as_of = t.table(spark, sf, "orders").agg(F.max("o_orderdate")).first()[0]
    return playlist.filter_recent(_files(spark, sf), F.lit(as_of).cast("timestamp_ntz")).select("path")


@query("filter_search", """SELECT DISTINCT path FROM audio WHERE label = 'u7' AND lower(path) LIKE '%t3%'""")
def filter_search(spark, sf):
    return playlist.filter_search(_files(spark, sf), "T3", label="u7", release="").select("path")


@query("filter_unconverted", """SELECT path FROM (SELECT path, CASE WHEN max(size) > 60000 THEN true
    WHEN max(size) > 30000 THEN false END AS converted FROM audio GROUP BY path) WHERE converted IS NOT TRUE""")
def filter_unconverted(spark, sf):
    size = F.max("size")
    marked = t.audio(spark, sf).groupBy("path").agg(
        F.when(size > 60000, True).when(size > 30000, False).alias("converted")
    )
    return playlist.filter_unconverted(marked).select("path")


@query("browse_limit", """SELECT path, created_at FROM (SELECT DISTINCT path, created_at FROM audio)
    ORDER BY created_at DESC, path LIMIT 1000""")
def browse_limit(spark, sf):
    return playlist.browse(_files(spark, sf).select("path", "created_at"))


_BUCKET = "CAST(CAST(floor(epoch((SELECT max(ts) FROM events)) / 21600) AS BIGINT) AS VARCHAR)"


@query("stable_shuffle", f"SELECT label, md5(label || {_BUCKET}) AS shuffle_key FROM (SELECT DISTINCT label FROM known)")
def stable_shuffle(spark, sf):
    as_of = t.table(spark, sf, "events").agg(F.max("ts").cast("timestamp")).first()[0]
    labels = t.known(spark, sf).select("label").distinct()
    return listening.stable_shuffle(labels, "label", listening.six_hour_bucket(F.lit(as_of)))


@query("distinct_labels", "SELECT DISTINCT label FROM audio")
def distinct_labels(spark, sf):
    return t.audio(spark, sf).select("label").distinct()


@query("distinct_releases", "SELECT DISTINCT label, release FROM audio")
def distinct_releases(spark, sf):
    return t.audio(spark, sf).select("label", "release").distinct()


@query("release_representative", """SELECT label, release, min(track) AS track, min(path) AS path FROM audio
    GROUP BY label, release""")
def release_representative(spark, sf):
    return playlist.release_representative(t.audio(spark, sf))


@query("item_ordinal", """SELECT path, row_number() OVER (PARTITION BY label, release
        ORDER BY created_at DESC, path) - 1 AS id
    FROM (SELECT DISTINCT label, release, path, created_at FROM audio)""")
def item_ordinal(spark, sf):
    return playlist.item_ordinal(_files(spark, sf), by_release=True).select("path", "id")


def _wrap(columns: str, group: str, order: str, source: str) -> str:
    window = f"({group} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""SELECT {columns},
        coalesce(lag({order}) OVER ({group} ORDER BY {order}), last_value({order}) OVER {window}) AS prev,
        coalesce(lead({order}) OVER ({group} ORDER BY {order}), first_value({order}) OVER {window}) AS next
        FROM (SELECT DISTINCT {source} FROM audio)"""


@query("playlist_neighbors", _wrap("label, release, path", "PARTITION BY label, release", "path", "label, release, path"))
def playlist_neighbors(spark, sf):
    return playlist.track_neighbours(t.audio(spark, sf))


@query("release_neighbors", _wrap("label, release", "PARTITION BY label", "release", "label, release"))
def release_neighbors(spark, sf):
    return playlist.release_neighbours(t.audio(spark, sf))


@query("label_neighbors", _wrap("label", "", "label", "label"))
def label_neighbors(spark, sf):
    return playlist.label_neighbours(t.audio(spark, sf))


@query("uniq_adjacent", """SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER
    (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def uniq_adjacent(spark, sf):
    lines = t.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return playlist.uniq_adjacent(lines, ["user_id"], ["event_id"], "event_type")


@query("row_numbers_long_group", """SELECT event_type, event_id, row_number() OVER
    (PARTITION BY event_type ORDER BY event_id) AS n FROM events""")
def row_numbers_long_group(spark, sf):
    """The path for a group too long for one task, taken here for every group."""
    lines = t.table(spark, sf, "events").select("event_type", "event_id")
    return ordering.number_rows(lines, ["event_type"], ["event_id"], "n", long_group=0)


_WANTED = {
    "file_list": "SELECT DISTINCT release, track AS file FROM audio",
    # a remote title: the file's name without its id; of cheap files only the title part is known
    "titles": """SELECT DISTINCT release, CASE WHEN size > 20000 THEN regexp_replace(track, '-[0-9]+.mp3', '')
        ELSE 'x - ' || track END AS wanted FROM audio""",
    "wants": """SELECT release, wanted, 0 AS form, trim(wanted) AS prefix FROM titles
        UNION SELECT release, wanted, 1, trim(CASE WHEN contains(wanted, '-') THEN wanted[strpos(wanted, '-') + 1:] ELSE '' END)
        FROM titles""",
    "tried": """SELECT release, wanted, form, file FROM wants JOIN file_list USING (release)
        WHERE prefix <> '' AND starts_with(file, prefix)""",
    "pairs": """SELECT DISTINCT release, wanted, file FROM tried
        JOIN (SELECT release, wanted, min(form) AS form FROM tried GROUP BY release, wanted) USING (release, wanted, form)""",
}


def _titles(spark, sf):
    # A release's files are together once they have met their release; grouped by its number they stay where they are.
    dear = F.col("size") > 20000
    files = t.audio(spark, sf, "release_id").groupBy("release_id", "release", "track").agg(
        F.max(dear).alias("dear"), F.max(~F.coalesce(dear, F.lit(False))).alias("cheap")
    )
    files = materialize(files.select("release", F.col("track").alias("file"), "dear", "cheap"))
    whole = F.when(F.coalesce("dear", F.lit(False)), F.array(F.regexp_replace("file", r"-[0-9]+.mp3", "")))
    part = F.when(F.col("cheap"), F.array(F.concat(F.lit("x - "), "file")))
    none = F.array().cast("array<string>")
    wanted = F.concat(F.coalesce(whole, none), F.coalesce(part, none))
    titles = files.select("release", F.explode(wanted).alias("wanted")).distinct()
    return materialize(titles), files.select("release", "file")


@query("playlist_file_match", """SELECT release, n_wanted, coalesce(n_matched, 0) AS n_matched,
    n_wanted = coalesce(n_matched, 0) AS complete FROM
    (SELECT release, count(*) AS n_wanted FROM titles GROUP BY release)
    LEFT JOIN (SELECT release, count(*) AS n_matched FROM pairs GROUP BY release) USING (release)""", _WANTED)
def playlist_file_match(spark, sf):
    return playlist.playlist_file_match(*_titles(spark, sf))[1]


@query("playlist_file_pairs", "SELECT * FROM pairs", _WANTED)
def playlist_file_pairs(spark, sf):
    return playlist.playlist_file_match(*_titles(spark, sf))[0]


@query("capped_grid_sample", """WITH items AS (
        SELECT p_partkey AS id, CAST(substr(p_brand, 7) AS INTEGER) / 25 AS hue, p_size / 50 AS saturation,
            (p_retailprice - (SELECT min(p_retailprice) FROM part))
            / (SELECT max(p_retailprice) - min(p_retailprice) FROM part) AS brightness FROM part),
    kept AS (SELECT *, (brightness - 0.05::DOUBLE) / 0.9::DOUBLE AS level FROM items
        WHERE brightness BETWEEN 0.05::DOUBLE AND 0.95::DOUBLE),
    cells AS (SELECT id, hue, least(CAST(round_even(level * 9, 0) AS INTEGER), 8) AS bucket,
            CAST(round_even(level * 81, 0) AS INTEGER) AS cell FROM kept
        WHERE NOT (saturation < 0.1::DOUBLE AND level > 0.2::DOUBLE AND level < 0.9::DOUBLE)),
    firsts AS (SELECT bucket, cell, hue, min(id) AS id FROM cells GROUP BY bucket, cell, hue)
    SELECT bucket, cell, round(hue, 4)::DOUBLE AS hue, id FROM (SELECT *, row_number() OVER
        (PARTITION BY bucket ORDER BY id) AS pos FROM firsts) WHERE pos <= 9""")
def capped_grid_sample(spark, sf):
    part = t.table(spark, sf, "part")
    low, high = part.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    items = part.select(
        F.col("p_partkey").alias("id"),
        (F.substring("p_brand", 7, 9).cast("int") / 25).alias("hue"),
        (F.col("p_size") / 50).alias("saturation"),
        ((F.col("p_retailprice") - low) / (high - low)).alias("brightness"),
    )
    return playlist.capped_grid_sample(items, 9).withColumn("hue", F.round("hue", 4))


# --- names and paths --------------------------------------------------------------------


@query("path_stub", """SELECT path, label || '/' || release AS stub FROM (SELECT DISTINCT path, label, release FROM audio)""")
def path_stub(spark, sf):
    return t.audio(spark, sf).select("path").distinct().withColumn("stub", ids.path_stub(F.col("path")))


@query("split_artist_title", """SELECT track, split_part(track, ' - ', 1) AS artist,
    split_part(track, ' - ', 2) AS title FROM (SELECT DISTINCT track FROM audio)""")
def split_artist_title(spark, sf):
    name = F.col("track")
    return t.audio(spark, sf).select("track").distinct().select(
        "track", text.artist_of_title(name).alias("artist"), text.title_of_title(name).alias("title")
    )


@query("track_id_from_path", """SELECT path, regexp_extract(path, '(\\d*)\\.mp3$', 1) AS track_id
    FROM (SELECT DISTINCT path FROM audio)""")
def track_id_from_path(spark, sf):
    return t.audio(spark, sf).select("path").distinct().withColumn("track_id", text.track_id(F.col("path")))


# A name made of the whole text of a document, upper-cased for some languages.
_NAMES = """SELECT doc_id, doc_id || '. ' || CASE WHEN lang = 'en' THEN upper(t) ELSE t END || '-' || n_chars || '.mp3' AS name
    FROM (SELECT *, regexp_replace(text, '[^ A-Za-z]', '', 'g') AS t FROM documents)"""


def _names(spark, sf):
    t_ = F.regexp_replace("text", "[^ A-Za-z]", "")
    shown = F.when(F.col("lang") == "en", F.upper(t_)).otherwise(t_)
    return t.table(spark, sf, "documents").select(
        "doc_id", F.concat("doc_id", F.lit(". "), shown, F.lit("-"), "n_chars", F.lit(".mp3")).alias("name")
    )


_CLEAN = {
    "names": _NAMES,
    "bare": """SELECT doc_id, regexp_replace(regexp_replace(name, '-\\d+\\.mp3', ''), '^[0-9. ]*', '') AS b FROM names""",
    "clean": """SELECT doc_id, CASE WHEN upper(b) = b THEN array_to_string(list_transform(string_split(lower(b), ' '),
        lambda w: upper(w[1:1]) || w[2:]), ' ') ELSE b END AS title FROM bare""",
    "words": "SELECT doc_id, title, string_split(title, ' ') AS w FROM clean",
    "word_pairs": """SELECT doc_id, first, second, min(i) AS i FROM (
        SELECT doc_id, word AS second, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS first, i
        FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words))
        WHERE i > 1 GROUP BY doc_id, first, second""",
    "tails": "SELECT doc_id, string_agg(second, ' ' ORDER BY i) AS tail FROM word_pairs GROUP BY doc_id",
    "deduped": """SELECT doc_id, CASE WHEN tail IS NULL THEN title ELSE w[1] || ' ' || tail END AS title
        FROM words LEFT JOIN tails USING (doc_id)""",
}


@query("clean_track_title", "SELECT doc_id, title FROM clean", _CLEAN)
def clean_track_title(spark, sf):
    return _names(spark, sf).select("doc_id", text.clean_track_title(F.col("name")).alias("title"))


@query("dedupe_bigrams", "SELECT doc_id, title FROM deduped", _CLEAN)
def dedupe_bigrams(spark, sf):
    titles = _names(spark, sf).select("doc_id", text.clean_track_title(F.col("name")).alias("title"))
    return titles.select("doc_id", text.dedupe_bigrams(F.col("title")).alias("title"))


_LABEL_SQL = """array_to_string(list_transform(string_split(replace({0}, '-', ' '), ' '),
    lambda w: upper(w[1:1]) || w[2:]), ' ')"""


@query("pretty_label", f"""SELECT raw, array_to_string(list_transform(range(1, len(b) + 1), lambda i:
        b[i] || coalesce(upper(f[i]), '')), '') AS label
    FROM (SELECT raw, regexp_split_to_array(t, '[A-Z][a-z]+\\d+|Ep|Cd') AS b,
        regexp_extract_all(t, '[A-Z][a-z]+\\d+|Ep|Cd') AS f
        FROM (SELECT raw, {_LABEL_SQL.format('raw')} AS t FROM (SELECT DISTINCT
            lower(replace(p_name, ' ', '-')) || '-rec' || p_size || '-' || CASE WHEN p_size > 25 THEN 'cd' ELSE 'ep' END
            AS raw FROM part)))""")
def pretty_label(spark, sf):
    raw = F.concat(
        F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("-rec"), "p_size", F.lit("-"),
        F.when(F.col("p_size") > 25, "cd").otherwise("ep"),
    )
    return t.table(spark, sf, "part").select(raw.alias("raw")).distinct().withColumn(
        "label", text.pretty_label(F.col("raw"))
    )


@query("format_duration", """SELECT path, text, CAST(seconds AS INTEGER) AS seconds FROM (
    SELECT path, (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':'
        || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS text, s AS seconds
    FROM (SELECT path, CAST(floor(duration * 10) AS BIGINT) AS s
        FROM (SELECT path, max(duration) AS duration FROM audio GROUP BY path)))""")
def format_duration(spark, sf):
    longest = t.audio(spark, sf).groupBy("path").agg(F.max("duration").alias("duration"))
    return longest.select("path", text.format_duration(F.col("duration") * 10).alias("text")).withColumn(
        "seconds", text.parse_duration(F.col("text"))
    )


@query("release_year", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN d WHEN 'O' THEN '19??' ELSE '' END AS released,
    CASE o_orderstatus WHEN 'F' THEN CAST(d[1:4] AS INTEGER) END AS catalogue_year,
    right(strftime(o_orderdate, '%d %B %Y'), 4) AS page_year
    FROM (SELECT *, strftime(o_orderdate, '%Y-%m-00') AS d FROM orders)""")
def release_year(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-'00'")
    released = F.when(F.col("o_orderstatus") == "F", day).when(F.col("o_orderstatus") == "O", "19??").otherwise("")
    return t.table(spark, sf, "orders").select(
        "o_orderkey", released.alias("released"), text.catalogue_year(released).alias("catalogue_year"),
        text.page_year(F.date_format("o_orderdate", "dd MMMM yyyy")).alias("page_year"),
    )


@query("search_title", """SELECT item_id, array_to_string(string_split(regexp_replace(lower(
        CASE WHEN item_id > 20 THEN '[Tag x] ' || text ELSE text END), '^\\[[^\\]]*\\]\\s+', ''), ' ')[1:2], ' ') AS term
    FROM benchmark""")
def search_title(spark, sf):
    title = F.when(F.col("item_id") > 20, F.concat(F.lit("[Tag x] "), "text")).otherwise(F.col("text"))
    return t.table(spark, sf, "benchmark").select("item_id", text.search_title(title).alias("term"))


@query("title_keywords", """SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'),
    lambda w: len(w) > 2 AND w NOT IN ('the', 'a', 'an', 'and', 'or', 'of', 'in', 'on', 'for', 'to', 'at', 'by', 'with'))[1:3],
    ' ') AS words FROM documents""")
def title_keywords(spark, sf):
    return t.table(spark, sf, "documents").select(
        "doc_id", F.array_join(text.title_keywords(F.col("text")), " ").alias("words")
    )


@query("extract_ids_from_url", """SELECT url, CASE WHEN regexp_matches(url, '/release/\\d+') THEN 'release'
        WHEN regexp_matches(url, '/artist/\\d+') THEN 'artist' END AS kind,
    CAST(nullif(coalesce(nullif(regexp_extract(url, '/release/(\\d+)', 1), ''),
        regexp_extract(url, '/artist/(\\d+)', 1)), '') AS BIGINT) AS id
    FROM (SELECT url FROM pages UNION ALL SELECT 'https://www.discogs.com/release/' || o_orderkey || '-x' FROM orders
          UNION ALL SELECT 'https://www.discogs.com/artist/' || p_partkey FROM part)""")
def extract_ids_from_url(spark, sf):
    releases = t.table(spark, sf, "orders").select(
        F.concat(ids.release_web_url(F.col("o_orderkey")), F.lit("-x")).alias("url")
    )
    artists = t.table(spark, sf, "part").select(
        F.concat(F.lit("https://www.discogs.com/artist/"), "p_partkey").alias("url")
    )
    urls = t.table(spark, sf, "pages").select("url").unionByName(releases).unionByName(artists)
    return urls.select("url", ids.url_kind(F.col("url")).alias("kind"), ids.url_id(F.col("url")).alias("id"))


@query("url_host", "SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host FROM pages WHERE regexp_extract(url, '//([^/]*)', 1) LIKE '%blog%'")
def url_host(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", ids.url_host(F.col("url")).alias("host")).where(
        F.contains("host", F.lit("blog"))
    )


@query("pick_encoding", """SELECT stem, stem || '.' || CASE WHEN bool_or(k = 'm5a') THEN 'm5a' ELSE 'mp3' END AS file
    FROM (SELECT replace(path, '.mp3', '') AS stem, 'mp3' AS k FROM audio
          UNION SELECT replace(path, '.mp3', ''), 'm5a' FROM audio WHERE size > 50000) GROUP BY stem""")
def pick_encoding(spark, sf):
    audio = t.audio(spark, sf)
    converted = audio.where("size > 50000").select(F.replace("path", F.lit(".mp3"), F.lit(".m5a")).alias("path"))
    return playlist.pick_encoding(audio.select("path").unionByName(converted), 1)
