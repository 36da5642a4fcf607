"""Catalogue, page and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavegraph.functions import text
from wavegraph.functions.ids import release_web_url
from wavegraph.operators import catalog, matching, pages
from wavegraph.operators.listening import with_store_url
from wavegraph.plans import correlate
from wavegraph.sources import catalog as xml
from wavegraph.session import materialize, scratch_path
from wavegraph.standin import corpus
from wavegraph.standin import tables as t
from wavegraph.standin.log_queries import _DOMAINS, _URL, domains
from wavegraph.standin.registry import query

V = corpus.VIEWS


def _long(tables):
    """All tables as (table_name, row_text), to compare them at once."""
    out = None
    for name, frame in tables.items():
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in frame.columns]
        rows = frame.select(F.lit(name).alias("table_name"), F.concat_ws("|", *cells).alias("row_text"))
        out = rows if out is None else out.unionByName(rows)
    return out


_PEOPLE = """SELECT l_partkey AS id, artist AS name FROM line_base
    UNION SELECT l_suppkey, s_name FROM line_base WHERE l_suppkey NOT IN (SELECT l_partkey FROM line_base)"""
_CORE = """SELECT 'artists' AS table_name, id || '|' || (SELECT min_by(name, (rid, kind, track, pos)) FROM (
        SELECT l_partkey AS pid, artist AS name, id AS rid, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS kind,
            0 AS track, pos FROM line_base
        UNION ALL SELECT l_suppkey, s_name, id, 2, pos, 0 FROM line_base) w WHERE w.pid = people.id) AS row_text
    FROM (SELECT DISTINCT id FROM people) people
    UNION ALL SELECT 'releases', id || '|' || title || '|' || o_custkey || '|' || country || '|' || released || '|'
        || coalesce(CAST(year AS VARCHAR), '~') || '|~|' || title FROM doc_head
    UNION ALL SELECT DISTINCT 'release_artists', id || '|' || l_partkey || '|,|' FROM line_base WHERE l_returnflag = 'N'
    UNION ALL SELECT DISTINCT 'release_extraartists', id || '|' || l_partkey || '|'
        || CASE WHEN l_returnflag = 'A' THEN 'Producer' ELSE 'Mixed By' END || '|' FROM line_base WHERE l_returnflag <> 'N'
    UNION ALL SELECT 'tracks', id || '|' || (pos - 1) || '|' || l_linenumber || '|' || p_name || ' ' || l_suppkey FROM line_base
    UNION ALL SELECT 'track_artists', id || '|' || (pos - 1) || '|' || l_suppkey || '|Written By|' FROM line_base"""
_CORE_VIEWS = {**V, "people": _PEOPLE}


@query("normalize_catalog", _CORE, _CORE_VIEWS)
def normalize_catalog(spark, sf):
    return _long(catalog.normalize_catalog(corpus.documents(spark, sf)))


_FORMAT = """SELECT CAST(row_number() OVER (ORDER BY name, qty, text) AS INTEGER) AS format_id, name, qty, text
    FROM (SELECT DISTINCT l_linestatus AS name, CAST(qty AS VARCHAR) AS qty, l_returnflag AS text FROM line_base)"""
_WIDE = """SELECT 'labels' AS table_name, label_id || '|' || name || '|C' || min(id) AS row_text
        FROM doc_head JOIN label_name ON o_custkey = label_id WHERE label_id <> 0 GROUP BY label_id, name
    UNION ALL SELECT 'release_labels', id || '|' || o_custkey || '|C' || id FROM doc_head WHERE o_custkey <> 0
    UNION ALL SELECT 'formats', name || '|' || qty || '|' || text || '|' || format_id FROM format_words
    UNION ALL SELECT DISTINCT 'release_formats', id || '|' || format_id FROM line_base b JOIN format_words f
        ON b.l_linestatus = f.name AND CAST(b.qty AS VARCHAR) = f.qty AND b.l_returnflag = f.text
    UNION ALL SELECT 'format_descriptions', format_id || '|' || p_type || '|' || count(*) FROM line_base b JOIN format_words f
        ON b.l_linestatus = f.name AND CAST(b.qty AS VARCHAR) = f.qty AND b.l_returnflag = f.text GROUP BY format_id, p_type
    UNION ALL SELECT 'genres', name || '|' || genre_id FROM genre_words
    UNION ALL SELECT DISTINCT 'release_genres', id || '|' || genre_id FROM line_base JOIN genre_words ON p_type = name
    UNION ALL SELECT 'styles', name || '|' || style_id FROM style_words
    UNION ALL SELECT DISTINCT 'release_styles', id || '|' || style_id FROM line_base JOIN style_words ON p_brand = name
    UNION ALL SELECT 'videos', id || '|v/' || price || '|' || qty || '|true|' || p_name || '|' || p_type FROM line_base
    UNION ALL SELECT DISTINCT 'companies', l_suppkey || '|' || s_name || '|23|Pressed By' FROM line_base WHERE l_suppkey <> 0
    UNION ALL SELECT DISTINCT 'release_companies', id || '|' || l_suppkey FROM line_base WHERE l_suppkey <> 0
    UNION ALL SELECT 'series', c_nationkey || '|' || min_by(c_mktsegment, id) || '|'
        FROM doc_head JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 0 GROUP BY c_nationkey
    UNION ALL SELECT 'release_series', id || '|' || c_nationkey || '|'
        FROM doc_head JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 0"""


_WIDE_VIEWS = {
    **V, "format_words": _FORMAT,
    "genre_words": "SELECT CAST(row_number() OVER (ORDER BY p_type) AS INTEGER) AS genre_id, p_type AS name FROM (SELECT DISTINCT p_type FROM line_base)",
    "style_words": "SELECT CAST(row_number() OVER (ORDER BY p_brand) AS INTEGER) AS style_id, p_brand AS name FROM (SELECT DISTINCT p_brand FROM line_base)",
}


@query("normalize_catalog_wide", _WIDE, _WIDE_VIEWS)
def normalize_catalog_wide(spark, sf):
    docs = corpus.documents(spark, sf)
    core = ("artists", "releases", "release_artists", "release_extraartists", "tracks", "track_artists")
    wide = catalog.normalize_catalog_wide(docs)
    return _long({name: frame for name, frame in wide.items() if name not in core})


@query("build_graph_nodes", """SELECT 'release' AS kind, id, title AS name FROM doc_head
    UNION ALL SELECT DISTINCT 'artist', l_partkey, artist FROM line_base WHERE l_partkey <> 0
    UNION ALL SELECT DISTINCT 'label', o_custkey, name FROM doc_head JOIN label_name ON o_custkey = label_id
        WHERE o_custkey <> 0 AND name <> 'Not On Label'
    UNION ALL SELECT DISTINCT 'producer', l_partkey, artist FROM line_base WHERE l_partkey <> 0 AND l_returnflag = 'A'""", V)
def build_graph_nodes(spark, sf):
    return catalog.graph_nodes(corpus.documents(spark, sf), ["Producer"])


@query("build_graph", """SELECT DISTINCT 'contributed_to' AS edge, id AS release_id, l_partkey AS node FROM line_base WHERE l_partkey <> 0
    UNION ALL SELECT 'released_on', id, o_custkey FROM doc_head JOIN label_name ON o_custkey = label_id
        WHERE o_custkey <> 0 AND name <> 'Not On Label'
    UNION ALL SELECT DISTINCT 'produced_by', id, l_partkey FROM line_base WHERE l_partkey <> 0 AND l_returnflag = 'A'""", V)
def build_graph(spark, sf):
    """The edges; ``build_graph_nodes`` has the nodes."""
    edges = catalog.build_graph(corpus.documents(spark, sf), ["Producer"])
    out = None
    for name, frame in edges.items():
        rows = frame.select(F.lit(name).alias("edge"), "release_id", F.col(frame.columns[1]).alias("node"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("rank_feature", """SELECT 'label' AS kind, name AS feature, count(*) AS n FROM doc_head JOIN label_name ON o_custkey = label_id
        WHERE o_custkey <> 0 AND name <> 'Not On Label' GROUP BY name
    UNION ALL SELECT 'label_id', label_id || ': ' || name, count(*) FROM doc_head JOIN label_name ON o_custkey = label_id
        WHERE o_custkey <> 0 AND name <> 'Not On Label' GROUP BY label_id, name
    UNION ALL SELECT 'artist', artist, count(*) FROM line_base GROUP BY artist
    UNION ALL SELECT 'extraartist', artist || ' (' || CASE WHEN l_returnflag = 'A' THEN 'Producer' ELSE 'Mixed By' END || ')', count(*)
        FROM line_base WHERE l_returnflag <> 'N' GROUP BY 1, 2""", V)
def rank_feature(spark, sf):
    docs = corpus.documents(spark, sf)
    out = None
    for kind in ("label", "label_id", "artist", "extraartist"):
        rows = catalog.rank_feature(docs, kind).select(F.lit(kind).alias("kind"), "feature", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("correlated_array_subquery", """SELECT release_id, 0 AS part, string_agg(name, ' | ' ORDER BY artist_id) AS names
    FROM contributed_to JOIN artist_name USING (artist_id) GROUP BY release_id""")
def correlated_array_subquery(spark, sf):
    graph = t.graph(spark, sf)
    rows = catalog.names_per_release(
        graph.contributed_to, t.artist_names(spark, sf), graph.hot("contributed_to", "artist_id")
    )
    return rows.select("release_id", "part", F.array_join("names", " | ").alias("names"))


# --- pages ------------------------------------------------------------------------------


@query("meta_description", "SELECT page_id, status IN ('ok', 'parse_fail') AS has_meta FROM page_all", V)
def meta_description(spark, sf):
    return corpus.release_pages(spark, sf).select(
        "page_id", pages.meta_description(F.col("html")).isNotNull().alias("has_meta")
    )


@query("parse_description", """SELECT p.page_id, title, artist, year, coalesce((SELECT string_agg(title, ';' ORDER BY pos)
    FROM page_tracks t WHERE t.page_id = p.page_id), '') AS tracks FROM page_ok p""", V)
def parse_description(spark, sf):
    return pages.parsed_pages(corpus.release_pages(spark, sf)).where("status = 'ok'").select(
        "page_id", "title", "artist", "year", F.array_join("track_list", ";").alias("tracks")
    )


@query("html_unescape", "SELECT page_id, title FROM page_all", V)
def html_unescape(spark, sf):
    raw = F.regexp_extract("html", r'og:title. content="([^"]*), by x', 1)
    return corpus.release_pages(spark, sf).select("page_id", text.html_unescape(raw).alias("title"))


@query("og_title", "SELECT page_id, replace(title, '&', '&amp;') || ' x' AS og_title FROM page_all", V)
def og_title(spark, sf):
    return corpus.release_pages(spark, sf).select("page_id", pages.og_title(F.col("html")).alias("og_title"))


@query("embedded_release_json", """SELECT page_id, artist, title, year AS json_date, coalesce(n.np, 0) AS n_tracks
    FROM page_all LEFT JOIN n_page n USING (page_id)""", V)
def embedded_release_json(spark, sf):
    return pages.embedded_release(corpus.release_pages(spark, sf)).select(
        "page_id", F.col("json_artist").alias("artist"), F.col("json_title").alias("title"), "json_date",
        F.size("json_tracks").cast("bigint").alias("n_tracks"),
    )


@query("jsonld_track_url", """SELECT p.page_id, 'https://x.example/track/' || replace(t.title, ' ', '-') AS url
    FROM page_all p LEFT JOIN page_tracks t ON t.page_id = p.page_id AND t.pos = 1""", V)
def jsonld_track_url(spark, sf):
    source = corpus.release_pages(spark, sf)
    first = F.get(pages.page_track_titles(F.col("html"), F.lit(True)), F.lit(0))
    return source.select("page_id", pages.jsonld_track_url(F.col("html"), first).alias("url"))


@query("page_release_date", """SELECT page_id, '20' || strftime(o_orderdate, '%y-%m-%d') AS day, o_orderstatus = 'O' AS future
    FROM page_all""", V)
def page_release_date(spark, sf):
    day, future = pages.page_release_date(F.col("html"))
    return corpus.release_pages(spark, sf).select("page_id", day.cast("string").alias("day"), future.alias("future"))


@query("page_track_titles", "SELECT page_id, CAST(pos - 1 AS INTEGER) AS ix, title FROM page_tracks", V)
def page_track_titles(spark, sf):
    return corpus.release_pages(spark, sf).select(
        "page_id", F.posexplode(pages.page_track_titles(F.col("html"), F.lit(True))).alias("ix", "title")
    )


@query("page_single_title", "SELECT page_id, title FROM page_tracks WHERE pos = 1", V)
def page_single_title(spark, sf):
    return corpus.release_pages(spark, sf).select(
        "page_id", F.explode(pages.page_track_titles(F.col("html"), F.lit(False))).alias("title")
    )


@query("page_links", """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""")
def page_links(spark, sf):
    return pages.page_links(t.table(spark, sf, "pages").select("page_id", "html"))


@query("page_metadata_corpus", """SELECT page_id, status, CASE WHEN status = 'ok' THEN artist END AS artist,
    CASE WHEN status = 'ok' THEN title END AS title, CASE WHEN status = 'ok' THEN year END AS year,
    artist AS json_artist, 'https://img.example/' || page_id || '.jpg' AS art_url, o_orderstatus = 'O' AS future
    FROM page_all""", V)
def page_metadata_corpus(spark, sf):
    return pages.page_metadata(corpus.release_pages(spark, sf)).select(
        "page_id", "status", "artist", "title", "year", "json_artist", "art_url", "future"
    )


@query("page_status_counts", "SELECT status, count(*) AS pages FROM page_all GROUP BY status", V)
def page_status_counts(spark, sf):
    return pages.status_counts(pages.parsed_pages(corpus.release_pages(spark, sf)))


_PLAN = """CASE WHEN purged THEN 'skip_purged' WHEN no_files THEN 'skip_empty'
    WHEN future AND files < 4 AND release_date < as_of AND date_diff('day', release_date, page_date) <= 21 THEN 'retry'
    WHEN files = 0 OR exit_code <> 0 THEN 'fresh' WHEN future AND files < 4 AND release_date >= as_of THEN 'future'
    ELSE 'done' END"""
_MANIFEST = """SELECT o_orderkey AS release_id, count(l_orderkey) AS files, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS exit_code,
    CAST(o_orderdate AS DATE) AS release_date, CAST(max(l_shipdate) AS DATE) AS page_date,
    o_orderstatus <> 'P' AS future, o_orderpriority = '5-LOW' AS purged,
    o_orderpriority = '4-NOT SPECIFIED' AND count(l_orderkey) = 0 AS no_files,
    (SELECT CAST(max(o_orderdate) AS DATE) - 365 FROM orders) AS as_of
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY o_orderkey, o_orderstatus, o_orderdate, o_orderpriority"""


@query("recrawl_plan", f"SELECT release_id, {_PLAN} AS decision FROM manifest", {"manifest": _MANIFEST})
def recrawl_plan(spark, sf):
    orders = t.table(spark, sf, "orders")
    as_of = orders.agg(F.date_sub(F.max(F.to_date("o_orderdate")), 365)).first()[0]
    seen = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("files"), F.to_date(F.max("l_shipdate")).alias("page_date")
    )
    manifest = orders.join(seen, "o_orderkey", "left").fillna({"files": 0}).select(
        F.col("o_orderkey").alias("release_id"), "files", "page_date",
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("exit_code"),
        F.to_date("o_orderdate").alias("release_date"), (F.col("o_orderstatus") != "P").alias("future"),
        (F.col("o_orderpriority") == "5-LOW").alias("purged"),
        ((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("files") == 0)).alias("no_files"),
    )
    return pages.recrawl_plan(manifest, F.lit(as_of)).select("release_id", "decision")


_FRONTIER = {
    "found_links": """SELECT DISTINCT label, release FROM (SELECT regexp_extract(url, '//([^/]*)', 1) AS label,
            regexp_extract(regexp_replace(link, '[?#].*$', ''), '([^/]*)$', 1) AS release
        FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)) WHERE release <> ''""",
    # pages with a label in the table "labels" were crawled before; their first path word names a release
    "crawled": """SELECT label, release, max(toxic) = 1 AS purged, sum(quality) AS files FROM (
        SELECT regexp_extract(url, '//([^/]*)', 1) AS label,
            regexp_extract(regexp_extract(html, 'href="([^"]*)"', 1), '([^/]*)$', 1) AS release, toxic, quality
        FROM pages JOIN labels ON page_id = doc_id) GROUP BY label, release""",
}


@query("crawl_frontier", """SELECT label, release, CASE WHEN files IS NULL THEN 'new' WHEN purged THEN 'skip_purged'
    WHEN files = 0 THEN 'fresh' ELSE 'done' END AS decision FROM found_links LEFT JOIN crawled USING (label, release)""", _FRONTIER)
def crawl_frontier(spark, sf):
    from wavegraph.functions.ids import url_host

    source = t.table(spark, sf, "pages").select("page_id", url_host(F.col("url")).alias("label"), "html")
    links = pages.page_links(source).join(source.select("page_id", "label"), "page_id")
    state = t.table(spark, sf, "labels").withColumnRenamed("doc_id", "page_id")
    first = F.regexp_extract(F.regexp_extract("html", 'href="([^"]*)"', 1), "([^/]*)$", 1)
    crawled = source.join(state, "page_id").groupBy("label", first.alias("release")).agg(
        (F.max("toxic") == 1).alias("purged"), F.sum("quality").alias("files")
    )
    manifest = crawled.select(
        "*", F.lit(0).alias("exit_code"), F.lit(None).cast("date").alias("release_date"),
        F.lit(None).cast("date").alias("page_date"), F.lit(False).alias("future"), F.lit(False).alias("no_files"),
    )
    return pages.crawl_frontier(links, manifest, F.lit("2024-01-01").cast("date"))


@query("labels_without_links", """SELECT regexp_extract(url, '//([^/]*)', 1) AS label, count(*) AS pages FROM pages
    GROUP BY 1 HAVING max(len(regexp_extract_all(html, '<a href="(/[^"]*)"', 1))) < 6""")
def labels_without_links(spark, sf):
    from wavegraph.functions.ids import url_host

    links = F.size(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1)))
    return (
        t.table(spark, sf, "pages").groupBy(url_host(F.col("url")).alias("label"))
        .agg(F.count(F.lit(1)).alias("pages"), F.max(links).alias("most")).where("most < 6").drop("most")
    )


@query("release_info", f"""SELECT k.path, {_URL} AS url, CASE WHEN p.page_id IS NOT NULL THEN '20' || strftime(o_orderdate, '%y-%m-%d') END AS released_on,
    CASE WHEN p.page_id IS NULL THEN NULL WHEN {_URL} LIKE '%album%' THEN coalesce(np, 0)
        WHEN ft.title IS NULL THEN 0 ELSE 1 END AS n_tracks, ft.title AS first_track, coalesce(f.n, 0) AS n_files, f.bytes,
    CASE WHEN p.page_id IS NOT NULL THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') END AS downloaded_on,
    coalesce(f.n, 0) AS n_entries, f.first_entry
    FROM known k LEFT JOIN release_domain r USING (path) LEFT JOIN label_domain d USING (label)
    LEFT JOIN page_all p ON p.page_id = k.release_id LEFT JOIN n_page np ON np.page_id = p.page_id
    LEFT JOIN page_tracks ft ON ft.page_id = p.page_id AND ft.pos = 1
    LEFT JOIN (SELECT label || '/' || release AS path, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes,
        min_by(path, (time, path)) AS first_entry FROM audio GROUP BY 1) f ON f.path = k.path""", {**V, **_DOMAINS})
def release_info(spark, sf):
    places = with_store_url(t.known(spark, sf), *domains(spark, sf))
    # A page is fetched on the day after its release; a playlist has the files in the order of their time.
    fetched = t.known(spark, sf).select("path", (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("fetched_at"))
    shown = corpus.release_pages(spark, sf).select(F.replace("path", F.lit("/page.html"), F.lit("")).alias("path"), "html").join(fetched, "path")
    audio = t.audio(spark, sf)
    entries = audio.select(F.concat_ws("/", "label", "release").alias("path"), F.col("time").alias("place"), F.col("path").alias("entry"))
    out = pages.release_info(places, shown, audio, entries)
    return out.withColumn("n_tracks", F.col("n_tracks").cast("bigint")).withColumn(
        "released_on", F.col("released_on").cast("string")
    ).withColumn("downloaded_on", F.col("downloaded_on").cast("string"))


# --- matching ---------------------------------------------------------------------------


def _parsed(spark, sf):
    good = pages.parsed_pages(corpus.release_pages(spark, sf)).where("status = 'ok'")
    return materialize(good.select("page_id", "artist", "title", "track_list", "year"))


def _candidates(spark, sf):
    c = corpus.match_catalog(spark, sf)
    return matching.fuzzy_candidates(_parsed(spark, sf), c["releases"], c["release_artists"], c["artists"])


@query("filter_contains_ilike", """SELECT p_partkey FROM part WHERE p_name ILIKE '%ed w%' OR p_type ILIKE '%eco%'""")
def filter_contains_ilike(spark, sf):
    return t.table(spark, sf, "part").where(
        F.col("p_name").ilike("%ed w%") | F.col("p_type").ilike("%eco%")
    ).select("p_partkey")


@query("fuzzy_candidate_join", "SELECT page_id, release_id FROM cand", V)
def fuzzy_candidate_join(spark, sf):
    return _candidates(spark, sf)


@query("fuzzy_candidates_indexed", "SELECT page_id, release_id FROM cand", V)
def fuzzy_candidates_indexed(spark, sf):
    """The same from the stored index: no name or title is read that has none of the pieces asked for."""
    return corpus.match_index(spark, sf).candidates(_parsed(spark, sf))


@query("string_similarity_lev", """SELECT page_id, l_partkey AS p_partkey,
    round(1 - levenshtein(lower(page_all.artist), lower(b.artist)) / greatest(len(page_all.artist), len(b.artist)), 6)::DOUBLE AS ratio
    FROM page_all JOIN line_base b ON b.id = page_id""", V)
def string_similarity_lev(spark, sf):
    names = pages.embedded_release(corpus.release_pages(spark, sf)).select("page_id", "json_artist")
    lines = corpus.page_lines(spark, sf).select(F.col("id").alias("page_id"), F.col("l_partkey").alias("p_partkey"), "artist")
    return names.join(lines, "page_id").select(
        "page_id", "p_partkey", F.round(text.string_similarity_lev(F.col("json_artist"), F.col("artist")), 6).alias("ratio")
    )


@query("string_similarity")
def string_similarity(spark, sf):
    names = pages.embedded_release(corpus.release_pages(spark, sf)).select("page_id", "json_artist")
    lines = corpus.page_lines(spark, sf).select(F.col("id").alias("page_id"), F.col("l_partkey").alias("p_partkey"), "artist")
    return names.join(lines, "page_id").select(
        "page_id", "p_partkey", F.round(text.string_similarity(F.col("json_artist"), F.col("artist")), 6).alias("ratio")
    )


def _scored(spark, sf, similarity):
    c, asked = corpus.match_catalog(spark, sf), _parsed(spark, sf)
    found = materialize(matching.fuzzy_candidates(asked, c["releases"], c["release_artists"], c["artists"]))
    return matching.score_matches(
        found, asked, c["releases"], c["release_artists"], c["artists"], c["tracks"], similarity
    )


@query("score_match")
def score_match(spark, sf):
    out = _scored(spark, sf, text.string_similarity)
    return out.select("page_id", "release_id", F.round("confidence", 6).alias("confidence"), F.array_join("reasons", "; ").alias("reasons"))


@query("score_match_lev", "SELECT page_id, release_id, round(confidence, 6)::DOUBLE AS confidence FROM lev_all", V)
def score_match_lev(spark, sf):
    out = _scored(spark, sf, text.string_similarity_lev)
    return out.select("page_id", "release_id", F.round("confidence", 6).alias("confidence"))


@query("filter_confidence", "SELECT page_id, release_id FROM lev_all WHERE confidence >= 0.5", V)
def filter_confidence(spark, sf):
    return matching.filter_confidence(_scored(spark, sf, text.string_similarity_lev)).select("page_id", "release_id")


_BEST = """SELECT page_id, release_id, round(confidence, 6)::DOUBLE AS confidence FROM (SELECT *, row_number() OVER
    (PARTITION BY page_id ORDER BY round(confidence, 9) DESC, release_id) AS pos FROM lev_all WHERE confidence >= 0.5) WHERE pos = 1"""


@query("best_match_per_page", _BEST, V)
def best_match_per_page(spark, sf):
    good = matching.filter_confidence(_scored(spark, sf, text.string_similarity_lev))
    good = good.withColumn("confidence", F.round("confidence", 9))
    return matching.best_match_per_page(good).select("page_id", "release_id", F.round("confidence", 6).alias("confidence"))


def _correlated(spark, sf, similarity):
    return correlate.correlate_pages(
        _parsed(spark, sf), corpus.match_catalog(spark, sf), similarity, index=corpus.match_index(spark, sf)
    )


@query("correlate_pages")
def correlate_pages(spark, sf):
    return _correlated(spark, sf, text.string_similarity).select(
        "page_id", "release_id", F.round("confidence", 6).alias("confidence"), "url"
    )


@query("correlate_pages_lev", _BEST, V)
def correlate_pages_lev(spark, sf):
    return _correlated(spark, sf, text.string_similarity_lev).select(
        "page_id", "release_id", F.round("confidence", 6).alias("confidence")
    )


_STATE = {
    **V,
    "was_matched": """SELECT path AS stub, 'https://www.discogs.com/release/' || known.release_id AS url
        FROM known JOIN orders ON o_orderkey = known.release_id WHERE o_orderstatus = 'F'""",
    "was_failed": """SELECT path AS stub FROM known JOIN orders ON o_orderkey = known.release_id
        WHERE o_orderpriority = '5-LOW'""",
    "new_page": """SELECT page_id, replace(path, '/page.html', '') AS stub FROM page_all
        WHERE replace(path, '/page.html', '') NOT IN (SELECT stub FROM was_matched UNION ALL SELECT stub FROM was_failed)""",
    "now_matched": f"""SELECT stub, url FROM was_matched
        UNION ALL SELECT stub, 'https://www.discogs.com/release/' || release_id FROM new_page JOIN ({_BEST}) USING (page_id)""",
}


_NOW = """SELECT stub, url FROM now_matched
    UNION ALL SELECT stub, NULL FROM (SELECT stub FROM was_failed UNION SELECT stub FROM new_page)
        WHERE stub NOT IN (SELECT stub FROM now_matched)"""


def known_before(spark, sf):
    """(matched, failed): what a run over all pages knows of some of them."""
    stubs = t.known(spark, sf).join(
        t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("release_id"), "o_orderstatus", "o_orderpriority"), "release_id"
    )
    matched = stubs.where("o_orderstatus = 'F'").select(F.col("path").alias("stub"), release_web_url(F.col("release_id")).alias("url"))
    return matched, stubs.where("o_orderpriority = '5-LOW'").select(F.col("path").alias("stub"))


@query("correlate_new_pages", _NOW, _STATE)
def correlate_new_pages(spark, sf):
    """The state after a run over all pages; some of them were known before."""
    shown = pages.parsed_pages(corpus.release_pages(spark, sf)).withColumn("stub", F.replace("path", F.lit("/page.html"), F.lit("")))
    _, matched, failed = correlate.correlate_new_pages(
        shown, corpus.match_catalog(spark, sf), *known_before(spark, sf), F.lit("2024-01-01").cast("timestamp"),
        text.string_similarity_lev, corpus.match_index(spark, sf),
    )
    return matched.select("stub", "url").unionByName(failed.select("stub", F.lit(None).cast("string").alias("url")))


@query("correlation_summary", f"""SELECT count(*) AS total, count(b.page_id) AS matched, count(*) - count(b.page_id) AS failed,
    round(count(b.page_id) / count(*), 6)::DOUBLE AS rate FROM pages p LEFT JOIN ({_BEST}) b USING (page_id)""", V)
def correlation_summary(spark, sf):
    best = _correlated(spark, sf, text.string_similarity_lev)
    out = correlate.correlation_summary(t.table(spark, sf, "pages"), best)
    return out.withColumn("rate", F.round("rate", 6))


@query("scan_catalog_tables", """SELECT r.id, r.title, r.year, coalesce(a.n, 0) AS n_artists, a.name AS first_artist,
    coalesce(k.n, 0) AS n_tracks, k.title AS least_title FROM cat_releases r
    LEFT JOIN (SELECT release_id, count(*) AS n, min(name) AS name FROM cat_links JOIN cat_artists ON id = artist_id GROUP BY 1) a
        ON a.release_id = r.id
    LEFT JOIN (SELECT release_id, count(*) AS n, min(title) AS title FROM cat_tracks GROUP BY 1) k ON k.release_id = r.id""", V)
def scan_catalog_tables(spark, sf):
    """All four tables written, read again and joined."""
    path = scratch_path(spark, "catalog")
    names = ["releases", "release_artists", "artists", "tracks"]
    xml.write_catalog(corpus.match_tables(spark, sf), path)
    found = xml.scan_catalog_tables(spark, path, names)
    artists = found["release_artists"].join(found["artists"].withColumnRenamed("id", "artist_id"), "artist_id").groupBy(
        F.col("release_id").alias("id")
    ).agg(F.count(F.lit(1)).alias("n_artists"), F.min("name").alias("first_artist"))
    tracks = found["tracks"].groupBy(F.col("release_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_tracks"), F.min("title").alias("least_title")
    )
    joined = found["releases"].select("id", "title", "year").join(artists, "id", "left").join(tracks, "id", "left")
    return joined.fillna({"n_artists": 0, "n_tracks": 0})
