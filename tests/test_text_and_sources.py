from pyspark.sql import functions as F

from wavegraph.functions import ids, text, weights
from wavegraph.operators import catalog, pages, playlist
from wavegraph.sources import catalog as xml
from wavegraph.sources import text as src

XML = """<releases>
<release id="1" status="Accepted"><title>One &amp; only</title><country>US</country><released>2001-00-00</released>
 <master_id is_main_release="true">77</master_id>
 <artists><artist><id>5</id><name>Ann</name><join>,</join></artist><artist><id>5</id><name>Ann</name></artist></artists>
 <extraartists><artist><id>6</id><name>Bob</name><role>Producer</role></artist><artist><id>6</id><name>Bob</name><role>Artwork</role></artist></extraartists>
 <labels><label id="9" name="Lab" catno="L1"/><label id="10" name="Not On Label" catno="none"/></labels>
 <formats><format name="Vinyl" qty="1" text=""><descriptions><description>LP</description></descriptions></format></formats>
 <genres><genre>Rock</genre></genres><styles><style>Punk</style></styles>
 <tracklist><track><position>A1</position><title>T1</title><extraartists><artist><id>7</id><name>Cy</name><role>Bass</role></artist></extraartists></track>
 <track><position>A2</position><title>T2</title></track></tracklist>
</release>
<release id="2"><title>Bare</title><released>19??</released></release>
<release id="3"><title>Third</title><artists><artist><id>0</id><name>None</name></artist><artist><id>5</id><name>Ann 2</name></artist></artists></release>
</releases>
"""


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_both_xml_readers_agree_and_normalize(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(XML)
    path = str(tmp_path / "dump.xml")
    big, small = xml.scan_catalog_xml(spark, path), xml.scan_small_catalog_xml(spark, path)
    key = lambda r: r.id
    assert sorted(big.collect(), key=key) == sorted(small.collect(), key=key)
    assert [r.master_id for r in sorted(big.collect(), key=key)] == [77, None, None]
    out = catalog.normalize_catalog_wide(big)
    rows = {name: {tuple(r) for r in frame.collect()} for name, frame in out.items()}
    assert rows["artists"] == {(5, "Ann"), (6, "Bob"), (7, "Cy"), (0, "None")}
    assert {(r[0], r[1], r[5]) for r in rows["releases"]} == {(1, "One & only", 2001), (2, "Bare", None), (3, "Third", None)}
    assert rows["release_artists"] == {(1, 5, ",", ""), (3, 0, "", ""), (3, 5, "", "")}
    assert {r[2] for r in rows["release_extraartists"]} == {"Producer", "Artwork"}
    assert rows["tracks"] == {(1, 0, "A1", "T1"), (1, 1, "A2", "T2")}
    assert rows["track_artists"] == {(1, 0, 7, "Bass", "")}
    assert rows["genres"] == {("Rock", 1)} and rows["release_genres"] == {(1, 1)}
    edges = catalog.build_graph(big, ["Producer"])
    assert {tuple(r) for r in edges["contributed_to"].collect()} == {(1, 5), (1, 6), (3, 5)}
    assert {tuple(r) for r in edges["released_on"].collect()} == {(1, 9)}
    assert {tuple(r) for r in edges["produced_by"].collect()} == {(1, 6)}
    assert {tuple(r) for r in catalog.rank_feature(big, "extraartist").collect()} == {("Bob (Producer)", 1), ("Bob (Artwork)", 1)}
    assert [tuple(r) for r in catalog.rank_feature(big, "artist", 1).collect()] == [("Ann", 2)]


def test_names_per_release_in_parts(spark):
    links = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 3)], "release_id long, artist_id long")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(25)], "artist_id long, name string")
    for long_group in (5, 1000):
        got = catalog.names_per_release(links, names, chunk=10, long_group=long_group).collect()
        parts = {(r.release_id, r.part): r["names"] for r in got}
        assert [len(parts[(1, p)]) for p in range(3)] == [10, 10, 5]
        assert parts[(1, 2)] == ["n20", "n21", "n22", "n23", "n24"] and parts[(2, 0)] == ["n3"]


def test_page_description(spark):
    html = (
        '<META name="description" content="\n A by night &amp; day by The B&#39;s, releases 3 May 2024\n\n1. x\nno track\n2. y &quot;z&quot;\n">'
    )
    rows = spark.createDataFrame([(1, html), (2, "<p>"), (3, "Sorry, that something isn't here"),
                                  (4, '<meta name="description" content="shirts">')], "page_id int, html string")
    got = {r.page_id: r for r in pages.parsed_pages(rows).collect()}
    # the shortest title up to " by " wins
    assert (got[1].title, got[1].artist, got[1].year) == ("A", "night & day by The B's", "2024")
    assert got[1].track_list == ["x", 'y "z"']
    assert [got[i].status for i in (1, 2, 3, 4)] == ["ok", "no_meta", "not_found", "parse_fail"]


def test_small_expressions(spark):
    col = F.col("a")
    assert one(spark, text.dedupe_bigrams(col), a="a b a b c") == "a b a c"
    assert one(spark, text.dedupe_bigrams(col), a="single") == "single"
    assert one(spark, text.pretty_label(col), a="my-cat12-ep-cd") == "My CAT12 EP CD"
    assert one(spark, text.parse_duration(col), a="1:02:03") == 3723
    assert one(spark, text.parse_duration(col), a="02:03") == 123
    assert one(spark, text.format_duration(col.cast("double")), a="3723.9") == "1:02:03"
    assert one(spark, text.clean_track_title(col), a="01. LOUD NAME-123.mp3") == "Loud Name"
    assert one(spark, text.search_title(col), a="[X 1] The Big One") == "the big"
    assert one(spark, F.array_join(text.title_keywords(col), ","), a="The sound of an Old big machine") == "sound,old,big"
    assert one(spark, text.catalogue_year(col), a="19??") is None
    assert one(spark, ids.path_stub(col), a="/x/lab/rel/page.html") == "lab/rel"
    assert one(spark, ids.url_id(col), a="https://h/artist/12") == 12
    assert one(spark, weights.tag_score(col), a="__rating___5") is None
    assert one(spark, weights.tag_score(col), a="4") == 4
    assert one(spark, weights.inv_log_degree(col.cast("int")), a="1") == 1.0
    assert one(spark, text.artist_of_title(col), a="no dash") is None


def test_log_keeps_malformed_lines(spark, tmp_path):
    (tmp_path / "log").write_text(
        "lab/rel __rating_5 (time:18:8) me 20240131\n\n# note\nlab/rel\nlab/r2 __purge (time:1:2) me 2024013\nlab/r3 __nothing\n"
    )
    rows = src.scan_listen_log(spark, str(tmp_path / "log")).collect()
    assert [(r.release, r.tag, r.seconds, str(r.day)) for r in rows if r._corrupt is None] == [
        ("rel", "__rating_5", 18, "2024-01-31"), ("r2", "__purge", 1, "None"), ("r3", "__nothing", None, "None")
    ]
    assert [r._corrupt for r in rows if r._corrupt] == ["lab/rel"]


def test_release_json_in_both_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"source_ids": ["7"],\n "releases": [{"release_id": "7", "labels": ["1"]}, {"release_id": "8"}]}')
    (tmp_path / "b.json").write_text('[{"release_id": "9",\n "discogs_url": "https://www.discogs.com/release/9"}]')
    rows = xml.scan_release_json(spark, str(tmp_path)).collect()
    assert {(r.release_id, tuple(r.source_ids)) for r in rows} == {("7", ("7",)), ("8", ("7",)), ("9", ("9",))}


def test_playlist_and_shares(spark, tmp_path):
    (tmp_path / "p.m3u").write_text("f.mp3\nName\n1:05\nhttps://x/y\nOther\n1:00:00\n")
    rows = src.scan_m3u_triples(spark, str(tmp_path / "p.m3u")).orderBy("ix").collect()
    assert [(r.file, r.title, r.seconds) for r in rows] == [("./f.mp3", "Name", 65), ("https://x/y", "Other", 3600)]
    (tmp_path / "s").write_text(" 100\n lab/rel/A B A B-12.mp3\n u\n i\n 5\n 61.5\n\n 200\n lab/r2/x-1.mp3\n u\n i\n 6\n 2\n\n")
    items = src.feed_items(src.scan_share_list(spark, str(tmp_path / "s")), "https://h/").collect()
    assert [(r.title, r.shown_duration) for r in items] == [("x / R2", "0:00:02"), ("A B A / Rel", "0:01:01")]


def test_pick_encoding(spark):
    files = spark.createDataFrame([("a.mp3",), ("a.opus",), ("a.m5a",), ("b.mp3",), ("c.opus",)], "path string")
    got = [{r.file for r in playlist.pick_encoding(files, level).collect()} for level in (0, 1, 2)]
    assert got == [{"a.opus", "b.mp3", "c.opus"}, {"a.m5a", "b.mp3"}, {"a.mp3", "b.mp3"}]


def test_the_part_after_the_dash_counts_only_without_a_full_match(spark):
    from wavegraph.operators import playlist

    titles = spark.createDataFrame([("r", "A - B"), ("r", "C - D"), ("q", "E")], "release string, wanted string")
    files = spark.createDataFrame([("r", "A - B-1.mp3"), ("r", "B side-2.mp3"), ("r", "D-3.mp3")], "release string, file string")
    pairs, report = playlist.playlist_file_match(titles, files)
    assert {tuple(r) for r in pairs.collect()} == {("r", "A - B", "A - B-1.mp3"), ("r", "C - D", "D-3.mp3")}
    assert {tuple(r) for r in report.collect()} == {("r", 2, 2, True), ("q", 1, 0, False)}


def test_links_of_every_kind(spark):
    from wavegraph.operators import pages

    html = (
        '<a href="https://x.example/track/one">1</a><a href="https://x.example/track/one">again</a><a href="/album/a">a</a>'
        '<a href="https://a.example/details/item">d</a><div data-href="/v/clip.MP4"></div><div data-href="/v/page"></div>'
    )
    frame = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id long, html string")
    found = {k: sorted(r.link for r in pages.page_links(frame, k).collect()) for k in pages.LINKS}
    assert found["track"] == ["https://x.example/track/one"] and found["details"] == ["https://a.example/details/item"]
    assert found["video"] == ["/v/clip.MP4"] and len(found["any"]) == 5


def test_m3u_over_many_splits(spark, tmp_path):
    """Lists cut into many splits, and many lists in one; lines of three meet over the borders."""
    want = []
    for k, size in enumerate((400, 3, 1)):
        triples = [(f"f{k}-{i}" + "x" * (i % 37) + ".mp3", f"T{k} {i}", f"{i}:{i % 60:02d}") for i in range(size)]
        tail = ("", "\n\n\n\n", "left over\nand over\n")[k]
        (tmp_path / f"{k}.m3u").write_text("\n".join("\n".join(t) for t in triples) + "\n" + tail)
        want += [(f"{k}.m3u", i, f"./{f}", title, 60 * i + i % 60) for i, (f, title, _) in enumerate(triples)]
    (tmp_path / "empty.m3u").write_text("")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    for size in ("997b", "128m"):
        spark.conf.set(key, size)
        try:
            rows = src.scan_m3u_triples(spark, str(tmp_path / "*.m3u")).collect()
            splits = src.numbered_lines(spark, str(tmp_path / "*.m3u"))
            assert splits.groupBy("file", "line").count().where("count > 1").isEmpty()
        finally:
            spark.conf.set(key, before)
        assert sorted((r["list"].rsplit("/", 1)[1], *tuple(r)[1:]) for r in rows) == sorted(want)


def test_the_cover_is_that_of_the_art_block(spark):
    popup = '<a class="popupImage" href="https://i.example/%s">'
    cases = {
        # a popup before the block is no cover
        popup % "shirt.png" + '\n<div id="tralbumArt">\n' + popup % "cover.jpg": "https://i.example/cover.jpg",
        # the address may stand before the class, or in the popup's content
        '<div id="tralbumArt">\n<a href="https://i.example/a.png" class="popupImage">': "https://i.example/a.png",
        '<div id="tralbumArt">\n<a class="popupImage"><img src="https://i.example/b.jpg"></a>': "https://i.example/b.jpg",
        # four lines after the block's name belong to it, a fifth does not, unless the name comes again
        '<div id="tralbumArt">\n\n\n\n' + popup % "c.jpg": "https://i.example/c.jpg",
        '<div id="tralbumArt">\n\n\n\n\n' + popup % "d.jpg": None,
        'tralbumArt\n\n\ntralbumArt\n\n\n' + popup % "e.jpg": "https://i.example/e.jpg",
        # every line of the block counts
        "tralbumArt" + popup % "f.jpg" + "\n" + popup % "g.png": "https://i.example/f.jpg\nhttps://i.example/g.png",
        'tralbumArt\n<a class="popupImage"\nhref="https://i.example/l.jpg">': "https://i.example/l.jpg",
        # on one line, the popup's own address comes first
        '<img src="https://i.example/h.png"><div id="tralbumArt">' + popup % "i.jpg" + '<img src="https://i.example/j.png">': "https://i.example/i.jpg",
        popup % "k.jpg": None, "": None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)) + [(99, None)], "page_id int, html string")
    got = {r.page_id: r.art for r in rows.select("page_id", pages.art_url(F.col("html")).alias("art")).collect()}
    assert got == dict(enumerate(cases.values())) | {99: None}
