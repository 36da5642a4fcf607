"""Decontamination, substring dedup, Jaccard join, licenses and personal data against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm import cases
from wavegraph.llm import decontaminate, jaccard_join, licenses, pii, substring_dedup
from wavegraph.llm.components import components


@pytest.fixture(scope="module")
def rows():
    return cases.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, cases.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], cases.SCHEMA)


ITEMS = [
    (1, "the river under a green house talk seven winter paper salt open road blue stone"), (1, "repeated id"), (2, None), (3, "..."),
    (4, "One two"), (None, "ün ñandú 中文"), (5, "run " * 14), (5, "run " * 14),
]


@pytest.mark.parametrize("shard_words", [10, 200_000])
def test_decontaminate(spark, docs, rows, shard_words):
    rng = random.Random(4)
    items = ITEMS + [(10 + k, " ".join((r[1] or "").split()[k : k + rng.randrange(8, 30)])) for k, r in enumerate(rows[:12])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(docs, bench, shard_words=shard_words)
    assert found.columns == [*(c for c in docs.columns if c != "hit"), "hit"]
    mine = sorted(
        (repr(r["doc_id"]), r["text"] or "", r["hit"]["n_words"], r["hit"]["n_hit"], tuple(r["hit"]["items"]), r["hit"]["contaminated"])
        for r in found.collect()
    )
    plain = []
    for r in rows:
        n, hit, names = cases.contaminated_words(r[1], items, 13)
        plain.append((repr(r[0]), r[1] or "", n, hit, tuple(sorted(names)), hit > 0 and 20 * hit >= n))
    assert mine == sorted(plain)
    assert any(p[3] for p in plain) and not all(p[3] for p in plain)


def test_decontaminate_results(spark, docs, none):
    bench = spark.createDataFrame([(1, "one two"), (2, "stone light walk green under house talk seven winter paper salt open road blue")], "item_id long, text string")
    assert decontaminate.scan(none, bench).count() == 0
    same = decontaminate.drop_contaminated(docs, bench.limit(0))
    assert same.count() == docs.count() and same.schema == docs.schema
    long = "x " * 300 + "Stone, light walk green under house talk seven winter paper salt open road blue! " + "y " * 300
    kept = decontaminate.cut_spans(spark.createDataFrame([(1, long), (2, "one two")], "doc_id long, text string"), bench).collect()
    assert [r["doc_id"] for r in kept] == [1] and "light" not in kept[0]["text"] and kept[0]["text"].split().count("y") == 300


def test_decontaminate_window_over_several_short_hits(spark):
    """A window of a long item closes over hits of short items that do not touch each other."""
    long = "a b ok c d e f ok g h i j k l m"
    rng = random.Random(7)
    items = [(1, "ok"), (2, long), (3, "e f")] + [(10 + k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 14, 20])))) for k in range(6)]
    texts = [long, "x " * 5 + long + " y ok z", "ok z " * 4 + long] + [" ".join(rng.choice("abcdefghz") for _ in range(40)) for _ in range(20)]
    texts += [f"{items[k][1]} z {items[-k][1]} ok" for k in range(1, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for used in (items[:2], items[:3], items):
        found = decontaminate.scan(docs, spark.createDataFrame(used, "item_id long, text string")).collect()
        for r in found:
            n, hit, names = cases.contaminated_words(r["text"], used, 13)
            assert (r["hit"]["n_words"], r["hit"]["n_hit"], set(r["hit"]["items"])) == (n, hit, names)
            spans = r["hit"]["spans"]
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and sum(e - s for s, e in spans) == r["hit"]["n_hit"]
    assert len(found) == len(texts)


def test_substring_dedup(docs, rows, none):
    found = substring_dedup.dedup(docs).collect()
    first: dict[tuple, float] = {}
    for r in rows:
        words = cases.blank_words(r[1])
        for i in range(len(words) - 12):
            key, own = tuple(words[i : i + 13]), float("inf") if r[0] is None else r[0]
            first[key] = min(first.get(key, own), own)
    plain = []
    for r in rows:
        words, gone = cases.blank_words(r[1]), set()
        for i in range(len(words) - 12):
            if first[tuple(words[i : i + 13])] < (float("inf") if r[0] is None else r[0]):
                gone |= set(range(i, i + 13))
        plain.append((repr(r[0]), len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in found) == sorted(plain)
    assert sum(p[2] for p in plain) > 100
    assert all(sum(e - s for s, e in r["removed"]) == r["n_removed"] for r in found)
    assert substring_dedup.dedup(none).count() == 0


def test_equal_windows_choose_alike():
    rng = np.random.default_rng(2)
    passage = rng.integers(1, 60, 40).astype(np.uint64)
    words = np.concatenate([rng.integers(1, 60, 30).astype(np.uint64), passage, rng.integers(1, 60, 25).astype(np.uint64), passage])
    names = substring_dedup.anchors(words, np.zeros(len(words), np.int64), 13)
    assert (names[30:58] == names[95:123]).all() and (names[30:58] != 0).mean() > 0.7


def test_jaccard_join(docs, rows, none):
    found, links = jaccard_join.groups(docs)
    sets = [cases.shingle_set(r[1], 4) for r in rows]
    root = cases.link_groups(sets, 85)
    ids = {}
    for r, g in zip(rows, root):
        ids.setdefault(g, []).append(r[0])
    plain = sorted(
        (repr(r[0]), len(s), repr(min((i for i in ids[g] if i is not None), default=None))) for r, s, g in zip(rows, sets, root)
    )
    got = found.collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got) == plain
    assert len({r["root"] for r in got}) == len(set(root)) < len(rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    left = [cases.shingle_set(r["text"], 4) for r in kept.where("doc_id IS NOT NULL").collect()]
    assert len(left) == len({g for g, i in ids.items() if set(i) != {None}})
    assert jaccard_join.keep_one(none).count() == 0


def test_jaccard_join_whole(spark, docs, rows):
    """All linked pairs, also between texts that a pivot has brought into one group."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(80)]
    more = []
    for k in range(14):
        words = list(base)
        words[rng.randrange(80)] = f"new{k}"
        more.append((500 + k, " ".join(words)))
    more += [(600, more[0][1]), (601, "short one"), (602, None)]
    for frame, texts in ((spark.createDataFrame(more, "doc_id long, text string"), [t for _, t in more]), (docs, [r[1] for r in rows])):
        found, links = jaccard_join.groups(frame, whole=True)
        sets = {cases.shingle_set(t, 4) for t in texts} - {frozenset()}
        want = sum(
            1 for x in sets for y in sets if x is not y and 100 * len(x & y) >= 85 * len(x | y)
        ) // 2
        pairs = [tuple(r) for r in links.collect()]
        assert len(pairs) == len({p[:2] for p in pairs}) == want > 0 and all(a < b for a, b, _ in pairs)
        got = found.collect()
        reps = {r["rep"] for r in got}
        assert {x for p in pairs for x in p[:2]} <= reps and len({r["rep"] for r in got if r["n_shingles"]}) == len(sets)
        some = jaccard_join.groups(frame)[1].count()
        assert some < want or frame is docs


def test_keep_one_of_rows_that_share_an_id(spark):
    """Only the row of an id that is a near copy goes; the id's other texts stay, one of each group."""
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"{n}{rng.randrange(10**6)}" for _ in range(60)) for n in "abcd")
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c + " end"), (3, d), (3, d), (4, c), (4, None), (4, ""), (4, None), (None, a), (5, d + " x"), (5, "alone")]
    docs = spark.createDataFrame([(i, t, "theirs") for i, t in rows], "doc_id long, text string, _k string").repartition(3)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and {r["_k"] for r in kept.collect()} == {"theirs"}
    want = [(1, a), (2, b), (3, c), (3, d), (4, None), (4, ""), (4, None), (None, a), (5, "alone")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_jaccard_join_of_groups_without_a_common_pivot(spark):
    """Chains of near copies, where the ends are not linked themselves, and sizes at the border of the limit."""
    rng = random.Random(9)
    rows = []
    for chain in range(4):
        words = [f"c{chain}w{rng.randrange(10**6)}" for _ in range(60 + 40 * chain)]
        for step in range(12):
            rows.append((1000 - len(rows), " ".join(words)))
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    rows += [(2000 + n, " ".join(f"e{k}" for k in range(n))) for n in range(20, 60, 3)]
    found, _ = jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    root = cases.link_groups([cases.shingle_set(t, 4) for _, t in rows], 85)
    least = {}
    for (i, _), g in zip(rows, root):
        least[g] = min(least.get(g, i), i)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: least[g] for (i, _), g in zip(rows, root)}


def test_components(spark):
    links = [(i, i + 1) for i in range(20, 50)] + [(i + 1, i) for i in range(60, 70)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(20, 51), 20), **dict.fromkeys(range(60, 71), 60), **dict.fromkeys(range(100, 140), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_licenses(spark, none):
    rng = random.Random(3)
    rows, want = [], []
    for k in range(40):
        name, body = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        words = body.split()
        if k % 3 == 1 and len(words) > 30:  # a word changed costs five shingles
            words[rng.randrange(5, len(words) - 5)] = "other"
        before, after = cases.sentence(rng, rng.randrange(200)), cases.sentence(rng, rng.randrange(200))
        rows.append((k, " ".join([*before, *(words if k % 4 else words[: len(words) // 2]), *after]), "m"))
    rows += [(100, None, "m"), (101, "", "m"), (102, "licensed", "m")]
    index = licenses.Index(licenses.TEMPLATES)
    for _, text, _ in rows:
        words = [w for w in "".join(c if c.isalnum() else " " for c in cases.lower_ascii(text)).split()]
        mine = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        names = set()
        for name, body in licenses.TEMPLATES:
            t = "".join(c if c.isalnum() else " " for c in cases.lower_ascii(body)).split()
            item = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            if len(item & mine) >= 0.8 * len(item):
                names.add(name)
        want.append(names)
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, matches string"))
    assert [{m["license"] for m in r["matches"]} for r in found.orderBy("doc_id").collect()] == want
    assert all(1 - (1 - 0.8 * len(index.sets[m]) / (c.window + 0.2 * len(index.sets[m]))) ** len(c.salts) > 1 - 1e-5 for c in index.classes for m in c.members)
    assert licenses.scan(none).count() == 0
    with pytest.raises(ValueError):
        licenses.Index((("short", "four words are few"),))


PERSONAL = [
    "write to ann.b+c@mail.example.com, or a@b_c@d.example.org or x@.no or a@b", "10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 010.020.030.255",
    "card 4111 1111 1111 1111 and 4111111111111111 4111111111111111 x", "4111-1111-1111-1112", "call +1 (017) 555-7713. or +49 30 123 or +123456789012345678",
    "ñandú 中文 é +1 (017) 555-7713 ü me@x.org 𝒳 9.9.9.9", "me (at) home (dot) example (dot) com is my mail", None, "", "+" * 50, "1" * 3000, "7 " * 2500,
    "a" * 5000 + "@", " ".join(f"u{k}@h{k % 9}.example.com" for k in range(700)), "a@b.cd_e@f.gh", "1.1.1.1@x.yz", "5500 0000 0000 0004 4111 1111 1111 1111",
]


def test_personal_data(spark, docs, none):
    rows = [(k, t, "theirs") for k, t in enumerate(PERSONAL)] + [(None, PERSONAL[0], None), (2, PERSONAL[2], "theirs")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = pii.candidates(frame.select("doc_id", "text"))
    judged = pii.decide(found, pii.fit(found)).collect()
    assert len(judged) == len(rows)
    for r in judged:
        mine = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"] if s["strict"]]
        assert mine == cases.personal(r["text"])
        extra = [s for s in r["spans"] if not s["strict"]]
        assert not any(s["start"] < e and b < s["end"] for s in extra for _, b, e in mine)
    clean = pii.redact(frame)
    assert clean.columns == ["doc_id", "text", "spans"] and {r["spans"] for r in clean.collect()} == {"theirs", None}
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[7] is None and texts[8] == "" and texts[12] == "a" * 5000 + "@"
    assert texts[5] == "ñandú 中文 é [phone] ü [email] 𝒳 [ip]"
    assert texts[15].startswith("[") and "@" not in texts[15]
    assert not any(cases.personal(t) for t in texts.values())
    assert pii.redact(none).count() == 0


def test_labelers_are_weighed_by_their_agreement():
    """The context labeler is right, the gazetteer is random: the estimate must see that."""
    counts = []
    for form, gaz, ctx, edge, n in ((1, 1, 1, 1, 400), (1, -1, 1, 1, 380), (0, 1, -1, -1, 200), (0, -1, -1, -1, 210), (0, 1, 1, 1, 30), (0, -1, 1, 1, 30)):
        counts.append({"kind": 3, "form": form, "gaz": gaz, "ctx": ctx, "edge": edge, "size": 2, "n": n})
    model = pii.estimate(counts)
    strong = model.reliability[3, "ctx", 1][0] / model.reliability[3, "ctx", 1][1]
    weak = model.reliability[3, "gaz", 1][0] / model.reliability[3, "gaz", 1][1]
    assert strong > 5 and 0.5 < weak < 2
    w = model.weights[3]
    assert w["ctx=1"] - w["ctx=-1"] > abs(w["gaz=1"] - w["gaz=-1"])
