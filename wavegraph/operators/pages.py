"""Release pages: what their HTML says, which links they have, what to fetch again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegraph.functions.text import html_unescape, page_year, strip

# What the pages look like.
NOT_FOUND_TEXT = "Sorry, that something isn't here"
META_DESCRIPTION = r'(?i)<meta\s+name="description"\s+content="([^"]*)"'
FIRST_LINE = r"^(.+?)\s+by\s+(.+?),\s+release[sd]\s+(.+)"
TRACK_LINE = r"^\d+\.\s+(.+)$"
OG_TITLE = r'og:title. content="([^"]*)'
EMBEDDED_JSON = r'data-tralbum="([^"]*)"'
JSON_LD = r'(?s)<script type="application.ld.json">(.*?)</scr'
PAGE_DATE = r"(release[sd]) ([A-Z][a-z]+ [0-9]{1,2}, 20[0-9]{2})"
ALBUM_TRACK = r'track-title">(.*?)<'
SINGLE_TRACK = r'trackTitle">(.*?)<'
ART_BLOCK = "tralbumArt"
ART_LINES = 4  # lines after one with the block's name that still belong to it
ART_TAG = r"[^<>]*popupImage[^<>]*"
ART_URL = r"https:[^\"'\s]*[jp][pn]g"
LINKS = {
    "any": r'href="([^"]*)"',
    "track": r'href="([^"]*/track/[^"]*)"',
    "details": r'href="([^"]*/details/[^"]*)"',
    "video": r'(?i)data-href="([^"]*(?:mp4|avi|mkv|flv))"',
}

EMBEDDED_SCHEMA = (
    "artist STRING, album_release_date STRING, current STRUCT<title: STRING, about: STRING, release_date: STRING>, "
    "trackinfo ARRAY<STRUCT<title: STRING>>"
)
JSON_LD_SCHEMA = "track STRUCT<itemListElement: ARRAY<STRUCT<item: STRUCT<name: STRING, `@id`: STRING>>>>"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def meta_description(html: Column) -> Column:
    """The description of the page, still with HTML entities; null if it has none."""
    return _found(html, META_DESCRIPTION)


def parse_description(content: Column) -> dict[str, Column]:
    """title, artist, released, track_list[] and year of an unescaped description "title by artist, released date"."""
    lines = F.split(strip(content), "\n")
    head = strip(F.get(lines, F.lit(0)))
    rest = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), strip)
    tracks = F.transform(
        F.filter(rest, lambda x: x.rlike(TRACK_LINE)), lambda x: strip(F.regexp_extract(x, TRACK_LINE, 1))
    )
    ok = head.rlike(FIRST_LINE)
    released = F.when(ok, strip(F.regexp_extract(head, FIRST_LINE, 3)))
    return {
        "title": F.when(ok, strip(F.regexp_extract(head, FIRST_LINE, 1))),
        "artist": F.when(ok, strip(F.regexp_extract(head, FIRST_LINE, 2))),
        "released": released,
        "track_list": F.when(ok, tracks),
        "year": page_year(released),
    }


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Add title, artist, released, track_list[], year and status to pages with an ``html`` column.

    status: "ok", "no_meta", "not_found" (the shop's own error page) or "parse_fail".
    """
    described = pages.withColumn("_content", html_unescape(meta_description(F.col("html"))))
    out = described.withColumns(parse_description(F.col("_content")))
    status = (
        F.when(F.col("title").isNotNull(), "ok")
        .when(F.col("_content").isNotNull(), "parse_fail")
        .when(F.contains("html", F.lit(NOT_FOUND_TEXT)), "not_found")
        .otherwise("no_meta")
    )
    return out.withColumn("status", status).drop("_content")


def og_title(html: Column) -> Column:
    """The page's shared title, without ", by"."""
    return F.replace(_found(html, OG_TITLE), F.lit(", by"), F.lit(""))


def page_release_date(html: Column) -> tuple[Column, Column]:
    """(date, future): the first "released Month d, 20yy"; future if it says "releases"."""
    day = F.try_to_date(F.regexp_extract(html, PAGE_DATE, 2), "MMMM d, yyyy")
    return day, F.regexp_extract(html, PAGE_DATE, 1) == "releases"


def is_album(url: Column) -> Column:
    """Whether the address is that of an album; others show a single track, in another form."""
    return F.coalesce(F.contains(url, F.lit("album")), F.lit(False))


def page_track_titles(html: Column, is_album: Column) -> Column:
    """The track titles that the page shows."""
    flat = F.regexp_replace(html, "\n", " ")
    found = F.when(is_album, F.regexp_extract_all(flat, F.lit(ALBUM_TRACK), F.lit(1))).otherwise(
        F.regexp_extract_all(flat, F.lit(SINGLE_TRACK), F.lit(1))
    )
    return F.transform(found, lambda x: F.ltrim(x))


def embedded_release(pages: DataFrame) -> DataFrame:
    """Add json_artist, json_title, json_about, json_date and json_tracks[] from the page's embedded JSON."""
    raw = html_unescape(_found(F.col("html"), EMBEDDED_JSON))
    return (
        pages.withColumn("_j", F.from_json(raw, EMBEDDED_SCHEMA))
        .withColumn("json_artist", F.col("_j.artist"))
        .withColumn("json_title", F.col("_j.current.title"))
        .withColumn("json_about", F.col("_j.current.about"))
        .withColumn("json_date", F.coalesce(F.nullif("_j.album_release_date", F.lit("")), F.col("_j.current.release_date")))
        .withColumn("json_tracks", F.col("_j.trackinfo.title"))
        .drop("_j")
    )


def jsonld_track_url(html: Column, title: Column) -> Column:
    """The address of the track with this title in the page's linked data."""
    items = F.from_json(F.regexp_extract(html, JSON_LD, 1), JSON_LD_SCHEMA)["track"]["itemListElement"]
    hits = F.filter(items, lambda e: e["item"]["name"] == title)
    return F.get(hits, F.lit(0))["item"]["@id"]


def art_url(html: Column) -> Column:
    """The address of the cover: of each line of the page's art block with a popup, one per line; null if there is none.

    A line's address is that of the popup's own tag or, if this has none, the first of the line. Popups outside the block are no covers.
    """
    def covers(lines: Column) -> Column:
        def cover(line: Column, i: Column) -> Column:
            before = F.slice(lines, F.greatest(i + 1 - ART_LINES, F.lit(1)), F.least(i, F.lit(ART_LINES)) + 1)
            # A tag may go on in the next lines.
            tag = F.regexp_extract(F.array_join(F.slice(lines, i + 1, F.lit(ART_LINES + 1)), "\n"), ART_TAG, 0)
            own = F.nullif(F.regexp_extract(tag, ART_URL, 0), F.lit(""))
            shown = F.contains(line, F.lit("popupImage")) & F.exists(before, lambda x: F.contains(x, F.lit(ART_BLOCK)))
            return F.when(shown, F.coalesce(own, F.regexp_extract(line, ART_URL, 0)))

        return F.array_join(F.filter(F.transform(lines, cover), lambda x: x != ""), "\n")

    # The lines are a lambda's argument, so that a page is cut into lines once.
    lines = F.array(F.split(F.when(F.contains(html, F.lit(ART_BLOCK)), html), "\n"))
    return F.nullif(F.get(F.transform(lines, covers), F.lit(0)), F.lit(""))


def page_links(pages: DataFrame, kind: str = "any") -> DataFrame:
    """(page_id, link), distinct: the links of a kind of ``LINKS`` in the page."""
    found = F.regexp_extract_all("html", F.lit(LINKS[kind]), F.lit(1))
    return pages.select("page_id", F.explode(found).alias("link")).distinct()


def status_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("status").agg(F.count(F.lit(1)).alias("pages"))


def page_metadata(pages: DataFrame) -> DataFrame:
    """One row per page (page_id, url, html) with everything its HTML tells; the text is read once."""
    day, future = page_release_date(F.col("html"))
    return (
        embedded_release(parsed_pages(pages))
        .withColumn("og_title", og_title(F.col("html")))
        .withColumn("page_date", day)
        .withColumn("future", future)
        .withColumn("art_url", art_url(F.col("html")))
        .withColumn("shown_tracks", page_track_titles(F.col("html"), is_album(F.col("url"))))
        .drop("html")
    )


def recrawl_plan(manifest: DataFrame, as_of: Column, buffer_days: int = 21, few_files: int = 4) -> DataFrame:
    """Add ``decision`` to a manifest (files, exit_code, release_date, page_date, future, purged, no_files).

    skip_purged, skip_empty, then for a page that announced its release: "future" or, when
    the date has passed and the page is not much newer, "retry". Without files, or after a
    failed run, "fresh". Else "done".
    """
    announced = F.col("future") & (F.col("files") < few_files) & F.col("release_date").isNotNull()
    passed = F.col("release_date") < as_of
    stale = F.date_diff("page_date", "release_date") <= buffer_days
    decision = (
        F.when(F.col("purged"), "skip_purged")
        .when(F.col("no_files"), "skip_empty")
        .when(announced & passed & stale, "retry")
        .when((F.col("files") == 0) | (F.col("exit_code") != 0), "fresh")
        .when(announced & ~passed, "future")
        .otherwise("done")
    )
    return manifest.withColumn("decision", decision)


def crawl_frontier(links: DataFrame, manifest: DataFrame, as_of: Column) -> DataFrame:
    """(label, release, decision) for links (label, link): "new" if never seen, else as ``recrawl_plan`` says."""
    release = F.element_at(F.split(F.regexp_replace("link", r"[?#].*$", ""), "/"), -1)
    wanted = links.select("label", release.alias("release")).where("release <> ''").distinct()
    planned = recrawl_plan(manifest, as_of).select("label", "release", "decision")
    return wanted.join(planned, ["label", "release"], "left").fillna({"decision": "new"})


def release_info(releases: DataFrame, pages: DataFrame, audio: DataFrame, entries: DataFrame) -> DataFrame:
    """Per release (path, url): dates and track titles of its page, number and size of its files, its playlist.

    Pages have path, html and ``fetched_at``, whose day is that of the download; ``entries`` (path, place, entry) are the
    lines of the releases' playlists. Of a release's pages the newest counts.
    """
    shown = page_track_titles(F.col("html"), is_album(F.col("url")))
    day, _ = page_release_date(F.col("html"))
    newest = pages.groupBy("path").agg(F.max_by(F.struct("html", "fetched_at"), F.struct("fetched_at", "html")).alias("p"))
    told = newest.select("path", "p.*").join(releases.select("path", "url"), "path").select(
        "path", day.alias("released_on"), F.to_date("fetched_at").alias("downloaded_on"),
        F.size(shown).alias("n_tracks"), F.get(shown, F.lit(0)).alias("first_track"),
    )
    files = audio.select(F.concat_ws("/", "label", "release").alias("path"), "size").groupBy("path").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes")
    )
    lists = entries.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_entries"), F.min_by("entry", F.struct("place", "entry")).alias("first_entry")
    )
    return (
        releases.select("path", "url").join(told, "path", "left").join(files, "path", "left").join(lists, "path", "left")
        .fillna({"n_files": 0, "n_entries": 0})
    )
