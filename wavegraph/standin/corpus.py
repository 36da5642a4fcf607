"""Release documents and release pages made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegraph.operators.ordering import number_rows
from wavegraph.operators.postings import Index
from wavegraph.operators.skew import small_side
from wavegraph.session import scratch_path, shuffles_deleted
from wavegraph.sources.catalog import write_catalog_xml
from wavegraph.standin.tables import known, label_names, state_of, table

LINES_PER_DOCUMENT = 1000
RELEASES_PER_FILE = 20_000
_STORED: dict = {}


def _stored(spark, sf, name, build) -> DataFrame:
    """What ``build`` gives, written once per session to the shared folder and read from there."""
    key = (state_of(spark, sf), name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        frame = build(spark, sf)
        with shuffles_deleted(spark):
            frame.write.option("compression", "zstd").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def doc_lines(spark, sf) -> DataFrame:
    """One row per line item with the names that documents need; pos counts the lines of an order."""
    return _stored(spark, sf, "doc-lines", _doc_lines)


def page_lines(spark, sf) -> DataFrame:
    """The lines of ``doc_lines`` whose order has a page. No text is looked up for the lines of other orders."""
    return _stored(spark, sf, "page-lines", lambda spark, sf: _doc_lines(spark, sf, _page_ids(spark, sf)))


def _page_ids(spark, sf) -> DataFrame:
    """(id): the numbers of the given pages, once each, stored; broadcast if they are few."""
    ids = _stored(spark, sf, "page-ids", lambda spark, sf: table(spark, sf, "pages").select(F.col("page_id").alias("id")).distinct())
    return small_side(ids, ids.count())


def _doc_lines(spark, sf, orders: DataFrame | None = None) -> DataFrame:
    """Numbered lines with their names, of all orders or of those in ``orders`` (id)."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        F.col("l_quantity").cast("int").alias("qty"), F.col("l_extendedprice").cast("bigint").alias("price"),
    )
    if orders is not None:
        lines = lines.join(orders, "id", "left_semi")
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand",
        F.concat("p_name", F.lit(" "), "p_partkey").alias("artist"), "p_name",
    )
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    full = lines.join(part, "l_partkey").join(supplier, "l_suppkey")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "qty", "price"]
    return number_rows(full, ["id"], order, "pos")


def documents(spark, sf) -> DataFrame:
    """Wide release documents. An order with very many lines becomes several documents of one id."""
    return _stored(spark, sf, "documents", _documents)


def dump(spark, sf) -> str:
    """The path of a dump of all releases, each as one record, written once per session in gzipped files of bounded length."""
    key = (state_of(spark, sf), "dump")
    if key not in _STORED:
        path = scratch_path(spark, "dump")
        docs = _documents(spark, sf, None)
        with shuffles_deleted(spark):
            write_catalog_xml(docs, path, "gzip", RELEASES_PER_FILE)
        _STORED[key] = path
    return _STORED[key]


def _documents(spark, sf, lines: int | None = LINES_PER_DOCUMENT) -> DataFrame:
    # A line travels once, and all lists of a document are made of its lines when these are together.
    line = F.struct(
        "pos", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "qty", "price", "p_type", "p_brand", "p_name", "s_name"
    )

    def place(e):
        return (e["pos"] - 1).cast("int").alias("place")

    def artist(e):
        return F.concat(e["p_name"], F.lit(" "), e["l_partkey"])

    def main(e):
        return F.struct(
            place(e), e["l_partkey"].alias("id"), artist(e).alias("name"), F.lit(",").alias("join"), F.lit("").alias("anv")
        )

    def credit(e):
        role = F.when(e["l_returnflag"] == "A", "Producer").otherwise("Mixed By")
        return F.struct(
            place(e), e["l_partkey"].alias("id"), artist(e).alias("name"), role.alias("role"), F.lit("").alias("anv")
        )

    def track(e):
        writer = F.struct(
            e["l_suppkey"].alias("id"), e["s_name"].alias("name"), F.lit("Written By").alias("role"), F.lit("").alias("anv")
        )
        return F.struct(
            place(e), e["l_linenumber"].cast("string").alias("position"),
            F.concat(e["p_name"], F.lit(" "), e["l_suppkey"]).alias("title"), F.array(writer).alias("extraartists"),
        )

    def kind(e):
        return F.struct(
            place(e), e["l_linestatus"].alias("name"), e["qty"].cast("string").alias("qty"), e["l_returnflag"].alias("text"),
            F.array(e["p_type"]).alias("descriptions"),
        )

    def video(e):
        return F.struct(
            place(e), F.concat(F.lit("v/"), e["price"]).alias("src"), e["qty"].alias("duration"), F.lit("true").alias("embed"),
            e["p_name"].alias("title"), e["p_type"].alias("description"),
        )

    def company(e):
        return F.struct(
            place(e), e["l_suppkey"].alias("id"), e["s_name"].alias("name"), F.lit("23").alias("entity_type"),
            F.lit("Pressed By").alias("entity_type_name"),
        )

    def listed(value, where=None):
        """A list of the lines in order; of a release without lines, an empty one."""
        held = F.coalesce("lines", F.array().cast(lists.schema["lines"].dataType))
        return F.transform(F.filter(held, where) if where is not None else held, value)

    chunk = F.lit(0) if lines is None else F.floor((F.col("pos") - 1) / lines)
    lists = doc_lines(spark, sf).groupBy("id", chunk.alias("part")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    head = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("country"),
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-'00'"))
        .when(F.col("o_orderstatus") == "O", "19??").otherwise("").alias("released"),
        F.lit(None).cast("string").alias("notes"), F.col("o_orderpriority").alias("data_quality"),
        F.col("o_custkey").alias("master_id"), "o_custkey",
    )
    named = label_names(spark, sf).select(F.col("label_id").alias("o_custkey"), F.col("name").alias("label_name"))
    segment = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").cast("bigint").alias("nation")
    )
    label = F.struct(F.col("o_custkey").alias("id"), F.col("label_name").alias("name"), F.concat(F.lit("C"), "id").alias("catno"))
    series = F.struct(F.col("nation").alias("id"), F.col("c_mktsegment").alias("name"), F.lit("").alias("catno"))
    # The narrow tables meet first; the lines are joined to what came of them.
    whole = head.join(named, "o_custkey").join(segment, "o_custkey").join(lists, "id", "left")
    return whole.select(
        "id", "title", "country", "released", "notes", "data_quality", "master_id",
        listed(main, lambda e: e["l_returnflag"] == "N").alias("artists"),
        listed(credit, lambda e: e["l_returnflag"] != "N").alias("extraartists"), listed(track).alias("tracks"),
        listed(kind).alias("formats"), listed(lambda e: e["p_type"]).alias("genres"), listed(lambda e: e["p_brand"]).alias("styles"),
        listed(video).alias("videos"), listed(company).alias("companies"), F.array(label).alias("labels"), F.array(series).alias("series"),
    )


def match_catalog(spark, sf) -> dict[str, DataFrame]:
    """The catalogue side of matching: every order is a release, every part an artist, every line a track."""
    builders = {
        name: (lambda spark, sf, name=name: match_tables(spark, sf)[name])
        for name in ("releases", "release_artists", "artists", "tracks")
    }
    return {name: _stored(spark, sf, f"match-{name}", build) for name, build in builders.items()}


def _match_lines(spark, sf) -> DataFrame:
    """(id, l_linenumber, l_partkey, l_suppkey, p_name): of ``doc_lines`` what the catalogue side of matching needs, not numbered."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    full = lines.join(supplier, "l_suppkey").join(part, "l_partkey")
    return full.select("id", "l_linenumber", "l_partkey", "l_suppkey", "p_name")


def match_tables(spark, sf) -> dict[str, DataFrame]:
    """The tables of ``match_catalog`` before they are stored; only the lines that they come from are."""
    lines = _stored(spark, sf, "match-lines", _match_lines)
    return {
        "releases": _titles(spark, sf, lines, table(spark, sf, "orders")),
        "release_artists": lines.select(F.col("id").alias("release_id"), F.col("l_partkey").alias("artist_id")).distinct(),
        "artists": table(spark, sf, "part").select(
            F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_partkey").alias("name")
        ),
        "tracks": lines.select(
            F.col("id").alias("release_id"), F.concat("p_name", F.lit(" "), "l_suppkey").alias("title")
        ),
    }


def _titles(spark, sf, lines: DataFrame, orders: DataFrame) -> DataFrame:
    """(id, title, year) of ``orders``; a title has the part of the order's first line."""
    # Lines come in the order of number, part and what does not change the part's name.
    first = lines.groupBy("id").agg(F.min_by("p_name", F.struct("l_linenumber", "l_partkey")).alias("p_name"))
    segment = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lower("c_mktsegment").alias("segment"))
    return (
        orders.select(F.col("o_orderkey").alias("id"), "o_custkey", F.year("o_orderdate").alias("year"))
        .join(first, "id", "left").join(segment, "o_custkey")
        .select("id", F.concat_ws(" ", "segment", F.coalesce("p_name", F.lit("untitled")), F.lit("vol"), "id").alias("title"), "year")
    )


def match_index(spark, sf) -> Index:
    """The index of ``match_catalog``, written once per session in two generations, as two imports would."""
    key = (state_of(spark, sf), "match-index")
    if key not in _STORED:
        index = Index(spark, scratch_path(spark, "match-index"), parts=8)
        catalog = match_catalog(spark, sf)
        old = {
            "releases": catalog["releases"].where("id % 4 <> 0"), "artists": catalog["artists"].where("id % 3 <> 0"),
            "release_artists": catalog["release_artists"],
        }
        index.add(old, 0)
        index.add(catalog, 1)
        _STORED[key] = index
    return _STORED[key]


def release_pages(spark, sf) -> DataFrame:
    """The pages of ``_release_pages``, stored."""
    return _stored(spark, sf, "release-pages", _release_pages)


def _release_pages(spark, sf) -> DataFrame:
    """(page_id, path, url, html): each given page, as the page of the order with its number.

    The page's own HTML is kept whole. French pages get no description, German ones a
    description that is no release, Spanish ones the shop's error text.
    """
    # What a page's order tells is looked up for the orders that have pages alone, and put together before it meets the long texts.
    wanted = _page_ids(spark, sf)
    lines = page_lines(spark, sf)
    paged = table(spark, sf, "orders").join(wanted.withColumnRenamed("id", "o_orderkey"), "o_orderkey", "left_semi")
    catalog = _titles(spark, sf, lines, paged).select(F.col("id").alias("page_id"), "title")
    shown = (
        lines.select(F.col("id").alias("page_id"), "pos", F.upper(F.concat("p_name", F.lit(" "), "l_suppkey")).alias("name"), "artist")
        .groupBy("page_id").agg(
            F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("t"), F.min_by("artist", "pos").alias("artist")
        )
    )
    pages = table(spark, sf, "pages").select("page_id", "url", F.col("html").alias("body"))
    orders = paged.select(F.col("o_orderkey").alias("page_id"), "o_orderdate", "o_orderstatus")
    heard = known(spark, sf).join(wanted.withColumnRenamed("id", "release_id"), "release_id", "left_semi")
    place = heard.select(F.col("release_id").alias("page_id"), F.concat("path", F.lit("/page.html")).alias("path"))
    names = F.transform("t", lambda e: e["name"])
    numbered = F.array_join(F.transform(names, lambda n, i: F.concat((i + 1).cast("string"), F.lit(". "), n)), "\n")
    title = F.replace(F.initcap("title"), F.lit(" Vol "), F.lit(" & Vol "))
    safe = F.replace(title, F.lit("&"), F.lit("&amp;"))
    verb = F.when(F.col("o_orderstatus") == "O", "releases").otherwise("released")
    described = F.concat(
        F.lit('<meta name="description" content="\n'), safe, F.lit(" by "), "artist", F.lit(", "), verb, F.lit(" "),
        F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("\n\n"), numbered, F.lit('\n">'),
    )
    german = F.lit('<meta name="description" content="Merch and more">')
    meta = (
        F.when(F.contains("body", F.lit('lang="fr"')), "")
        .when(F.contains("body", F.lit('lang="de"')), german)
        .when(F.contains("body", F.lit('lang="es"')), "<p>Sorry, that something isn't here</p>")
        .otherwise(described)
    )
    single = F.concat(F.lit('<h2 class="trackTitle"> '), F.get(names, F.lit(0)), F.lit("</h2>"))
    track_spans = F.concat(F.coalesce(single, F.lit("")), F.array_join(F.transform(names, lambda n: F.concat(F.lit('<span class="track-title"> '), n, F.lit("</span>"))), ""))
    data = F.to_json(F.struct(
        F.col("artist"), F.lit("").alias("album_release_date"),
        F.struct(title.alias("title"), F.lit("about it").alias("about"), F.date_format("o_orderdate", "yyyy").alias("release_date")).alias("current"),
        F.transform(names, lambda n: F.struct(n.alias("title"))).alias("trackinfo"),
    ))
    linked = F.to_json(F.struct(F.struct(F.transform(names, lambda n: F.struct(F.struct(
        n.alias("name"), F.concat(F.lit("https://x.example/track/"), F.replace(n, F.lit(" "), F.lit("-"))).alias("@id")
    ).alias("item"))).alias("itemListElement")).alias("track")))
    html = F.concat(
        meta, F.lit('<meta property="og:title" content="'), safe, F.lit(', by x">'),
        F.lit('<script data-tralbum="'), F.replace(F.replace(data, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")),
        F.lit('"></script><script type="application/ld+json">'), linked, F.lit("</script><p>"), verb, F.lit(" "),
        F.date_format("o_orderdate", "MMMM d, "), F.lit("20"), F.date_format("o_orderdate", "yy"), F.lit("</p>"),
        F.lit('<div id="tralbumArt"><a class="popupImage" href="https://img.example/'), F.col("page_id"), F.lit('.jpg"></a></div>'), track_spans, "body",
    )
    told = orders.join(catalog, "page_id").join(place, "page_id").join(shown, "page_id", "left")
    # The pages are dealt once and not sorted; what is known of their orders is narrower.
    full = pages.join(told.hint("shuffle_hash"), "page_id")
    no_tracks = F.array().cast("array<struct<pos:bigint,name:string>>")
    full = full.withColumn("artist", F.coalesce("artist", F.lit("Nobody"))).withColumn("t", F.coalesce("t", no_tracks))
    return full.select(
        "page_id", "path", "url", html.alias("html")
    )


VIEWS = {
    "line_base": """SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
        CAST(l_quantity AS INTEGER) AS qty, CAST(trunc(l_extendedprice) AS BIGINT) AS price, p_type, p_brand, p_name,
        p_name || ' ' || p_partkey AS artist, s_name,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag,
            l_linestatus, CAST(l_quantity AS INTEGER), CAST(trunc(l_extendedprice) AS BIGINT)) AS pos
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "doc_head": """SELECT o_orderkey AS id, o_orderpriority AS title, o_orderstatus AS country,
        CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-00') WHEN 'O' THEN '19??' ELSE '' END AS released,
        CASE o_orderstatus WHEN 'F' THEN CAST(year(o_orderdate) AS INTEGER) END AS year, o_custkey
        FROM orders""",
    "cat_releases": """SELECT o_orderkey AS id, lower(c_mktsegment) || ' ' || coalesce(p_name, 'untitled') || ' vol ' || o_orderkey AS title,
        CAST(year(o_orderdate) AS INTEGER) AS year
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN line_base ON line_base.id = o_orderkey AND pos = 1""",
    "cat_links": "SELECT DISTINCT id AS release_id, l_partkey AS artist_id FROM line_base",
    "cat_artists": "SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name FROM part",
    "cat_tracks": "SELECT id AS release_id, p_name || ' ' || l_suppkey AS title, pos FROM line_base",
    "page_src": """SELECT page_id, url, html AS body, o_orderstatus, o_orderdate, path || '/page.html' AS path,
        CASE WHEN contains(html, 'lang="fr"') THEN 'no_meta' WHEN contains(html, 'lang="de"') THEN 'parse_fail'
             WHEN contains(html, 'lang="es"') THEN 'not_found' ELSE 'ok' END AS status,
        array_to_string(list_transform(string_split(title, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS t0,
        coalesce(artist, 'Nobody') AS artist, CAST(year(o_orderdate) AS VARCHAR) AS year
        FROM pages JOIN orders ON page_id = o_orderkey JOIN cat_releases r ON r.id = page_id
        LEFT JOIN line_base b ON b.id = page_id AND b.pos = 1 JOIN known ON known.release_id = page_id""",
    "page_all": "SELECT *, replace(t0, ' Vol ', ' & Vol ') AS title FROM page_src",
    "page_ok": "SELECT page_id, path, artist, title, year FROM page_all WHERE status = 'ok'",
    "page_tracks": """SELECT page_id, upper(p_name || ' ' || l_suppkey) AS title, pos FROM page_all
        JOIN line_base ON id = page_id""",
    "page_words": """SELECT page_id, lower(artist) AS needle, list_filter(string_split(lower(title), ' '), lambda w: len(w) > 2
        AND w NOT IN ('the', 'a', 'an', 'and', 'or', 'of', 'in', 'on', 'for', 'to', 'at', 'by', 'with'))[1:3] AS words
        FROM page_ok""",
    "cand": """SELECT DISTINCT page_id, r.id AS release_id FROM page_words
        JOIN cat_artists a ON contains(lower(a.name), needle) JOIN cat_links l ON l.artist_id = a.id
        JOIN cat_releases r ON r.id = l.release_id
        WHERE len(words) = 0 OR len(list_filter(words, lambda w: contains(lower(r.title), w))) > 0""",
    "lev_artist": """SELECT page_id, release_id,
        max(1 - levenshtein(lower(p.artist), lower(a.name)) / greatest(len(p.artist), len(a.name))) AS s
        FROM cand JOIN page_ok p USING (page_id) JOIN cat_links l USING (release_id) JOIN cat_artists a ON a.id = l.artist_id
        GROUP BY page_id, release_id""",
    "lev_track": """SELECT page_id, release_id, count(DISTINCT p.pos) AS n FROM cand JOIN page_tracks p USING (page_id)
        JOIN cat_tracks t USING (release_id)
        WHERE 1 - levenshtein(lower(p.title), lower(t.title)) / greatest(len(p.title), len(t.title)) >= 0.8::DOUBLE
        GROUP BY page_id, release_id""",
    "n_page": "SELECT page_id, count(*) AS np FROM page_tracks GROUP BY page_id",
    "n_cat": "SELECT release_id, count(*) AS nc FROM cat_tracks GROUP BY release_id",
    "lev_all": """SELECT page_id, release_id, (s + (1 - levenshtein(lower(p.title), lower(r.title))
            / greatest(len(p.title), len(r.title))) + 0.5 * coalesce(n / greatest(np, nc), 0)
            + CASE WHEN p.year = CAST(r.year AS VARCHAR) THEN 0.5 ELSE 0 END) / 3 AS confidence
        FROM cand JOIN page_ok p USING (page_id) JOIN cat_releases r ON r.id = release_id
        JOIN lev_artist USING (page_id, release_id) LEFT JOIN lev_track USING (page_id, release_id)
        LEFT JOIN n_page USING (page_id) LEFT JOIN n_cat USING (release_id)""",
}
