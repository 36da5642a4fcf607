"""Quality, language, mixing, URL filters, vector search and the pipeline."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from wavegraph.llm import language, mixing, quality, url_filter, vector_search


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        good = rng.random() < (0.85 if k % 4 else 0.4)
        words = cases.sentence(rng, rng.randrange(30, 120))
        text = " ".join(words) + "." if good else " | ".join(w + "$$$" for w in words)
        rows.append((k, text, f"host{k % 4}", "de" if k % 2 else None, "theirs"))
        if k % 3 == 0:
            labels.append((k, int(good)))
    rows += [(9000, None, None, None, "x"), (9001, "", "rare", "en", "x"), (0, rows[0][1], "host0", None, "x"), (None, "word word", "host1", "de", "x")]
    labels += [labels[0], (None, 1), (5000, 0), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, judged string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    evidence, rates = quality.fit(docs, marks)
    found = quality.judge(docs, evidence, rates)
    assert found.columns == docs.columns
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(rows)
    right = sum(("$$$" not in r[1]) == got[r[0]]["judged"]["keep"] for r in rows[:600])
    assert right >= 594
    rate = {(r["_host"], r["_path"]): r for r in rates.collect()}
    assert rate["host0", None]["host_rate"] < rate["host1", "de"]["host_rate"]
    # A host of one document stays near the rate of all.
    assert abs(rate["rare", "en"]["host_rate"] - 0.74) < 0.15
    # The score is the evidence plus the log odds of the path.
    one = got[1]["judged"]
    p = one["path_rate"]
    assert one["score"] == pytest.approx(1 / (1 + np.exp(-(np.log(p / (1 - p)) + one["evidence"]))))
    assert all(r["judged"]["keep"] for r in quality.judge(docs, *quality.fit(docs, marks.limit(0))).collect())
    empty = docs.limit(0)
    assert quality.judge(empty, *quality.fit(empty, marks)).count() == 0


def test_network_gradients():
    """Backpropagation through time against differences."""
    network = language.ByteNetwork(["a", "b", "c"], hidden=3)
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    codes = language.encode([b"abca", b"zz", b"\xc3\xa9x"])
    target = np.array([0, 1, 2])
    _, g = network.gradients(codes, target)
    rng = np.random.default_rng(0)
    for name, w in network.w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name.endswith("in"):
                at = (codes[0, 1], at[1])
            old = w[at]
            loss = []
            for d in (1e-3, -1e-3):
                w[at] = old + d
                loss.append(network.gradients(codes, target)[0])
            w[at] = old
            assert g[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, abs=2e-4), name


def test_language(spark):
    rng = random.Random(8)
    syllables = {"xx": ["ka", "ro", "mi", "tu"], "yy": ["sch", "ung", "eit", "ver"], "zz": ["é", "ña", "çi", "ou"]}
    rows = []
    for k in range(240):
        lang = ("xx", "yy", "zz")[k % 3]
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 60))]
        rows.append((k, " ".join(words).capitalize(), lang if k % 11 else None, "theirs"))
    truth = [("xx", "yy", "zz")[k % 3] for k in range(240)]
    rows += [(500, None, "xx", "s"), (501, "", None, "s"), (502, "123 !!! —…", "yy", "s"), (None, "karomi", None, "s"), (3, rows[3][1], "xx", "s"), (504, "karo" * 5000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    fold = language.split_of(F.col("doc_id"))
    network = language.train_network(docs.where(fold != 0), steps=150)
    found = language.predict(docs.select("doc_id", "text", "score"), network)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"] and found.count() == len(rows)
    held = {r["doc_id"] for r in docs.where(fold == 0).collect()}
    got = {r["doc_id"]: r for r in found.collect()}
    tested = [k for k in range(240) if k in held]
    assert len(tested) > 25 and np.mean([got[k]["lang_pred"] == truth[k] for k in tested]) > 0.95
    assert [got[k]["lang_pred"] for k in (500, 501, 502)] == ["und"] * 3 and got[504]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # Positions are labelled, and a document's score is their mean.
    prob = network.label(language.encode([b"karomi"]))
    assert prob.shape == (6, 1, 3) and prob.sum(axis=2) == pytest.approx(1)
    assert got[None]["score"] == pytest.approx(prob.mean(axis=0).max(), abs=1e-5)
    assert language.train_network(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}


def shares(sizes: dict, weights=(3, 1, 2), share=1.5, most=2) -> dict:
    """Targets, refilled until no source is above its limit."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    full: dict = {}
    while True:
        rest = share * sum(sizes.values()) - sum(full.values())
        open_ = [n for n in names if n not in full]
        total = sum(weight[n] for n in open_)
        target = {n: rest * weight[n] / total for n in open_}
        over = [n for n in open_ if target[n] > most * sizes[n]]
        if not over:
            return full | target
        full |= {n: most * sizes[n] for n in over}


def test_mixing(spark):
    rng = random.Random(6)
    rows = []
    for k in range(3000):
        source = rng.choice(["hot"] * 5 + ["b", "c", "d", None, "É"])
        rows.append((k, " ".join(["w"] * rng.choice([0, 1, 5, 50, 50, 60, 300])), source, 7))
    rows += [(9000, None, "only null", 7), (9001, "a b c", "small", 7), (5, rows[5][1], rows[5][2], 7), (None, "x y", "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (repr(r["doc_id"]), repr(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes: dict = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(cases.blank_words(text))
    want = shares(sizes)
    taken: dict = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 30 or source == "small"
    # Longer documents are less likely to be sampled.
    rest = [r for r in got if r["source"] == "hot" and r["size"] in (50, 300)]
    rate = {n: np.mean([r["copies"] for r in rest if r["size"] == n]) for n in (50, 300)}
    assert rate[50] > rate[300]
    copies = mixing.copies_of(docs)
    assert copies.columns == [*docs.columns, "copy"] and copies.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_url_filter(spark):
    rng = random.Random(5)
    hosts = ["example.net", "a.example.net", "xexample.net", "net", "example.com", "b.example.com", "w.org", "org", "EXAMPLE.Net", "t.co:80"]
    paths = ["", "/", "/en/", "/en/5", "/de/login", "/fr/x.pdf", "/en", "/DE/", "/search?q=1", "?page=2", "#top", "/tag/x/page/3", "/cart?x#y", "//de/"]
    urls = [f"{rng.choice(['http', 'https', 'ftp', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "http://net://de/", "a\nb://example.net\n/en/", urls[0]]
    pages = spark.createDataFrame([(k if k % 9 else None, u, "theirs") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    found = url_filter.judge(pages)
    assert found.columns == pages.columns
    rules = url_filter.LISTED + url_filter.PATTERNS
    want = []
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = cases.lower_ascii(re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
        listed = [r for r in rules if r.listed and re.search(r.regex, host + path)]
        other = [r for r in rules if not r.listed and re.search(r.regex, cases.lower_ascii(u))] if u is not None else []
        best = max(listed, key=lambda r: len(r.name), default=None)
        pattern = min(other, key=lambda r: r.name, default=None)
        want.append((repr(u), host, path, best and best.name, pattern and pattern.name, best.verdict if best else "block" if pattern else "allow"))
    got = [(repr(r["url"]), *(r["verdict"][c] for c in ("host", "path", "rule", "pattern", "verdict"))) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({w[3] for w in want}) == 5 and len({w[4] for w in want}) > 5
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_vector_search(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 12))
    data = np.concatenate([rng.normal(size=(400, 12)), centers[rng.integers(0, 5, 300)] + 0.05 * rng.normal(size=(300, 12))])
    data *= rng.uniform(0.5, 2, (len(data), 1))
    data[650:] = data[650]
    rows = [(k, v.tolist(), k) for k, v in enumerate(data)]
    odd = [(700, None, 0), (720, [], 0), (740, [0.0] * 12, 0), (760, [float("nan")] + [1.0] * 11, 0), (780, [None] + [1.0] * 11, 0),
           (800, [float("inf")] + [1.0] * 11, 0), (None, [1.0] * 12, 0), (820, [1.0, 2.0], 0), (821, [2.0, 2.0], 0)]
    vectors = spark.createDataFrame(rows + odd + [rows[20], rows[21]], "vec_id long, embedding array<double>, rank int").repartition(3)
    found = vector_search.search(vectors, vectors.where("vec_id % 20 = 0"), k=20).collect()
    got: dict = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 700, 20):
        scores = data @ data[q]
        order = sorted((k for k in range(700) if k != q), key=lambda k: (-round(scores[k], 9), k))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(m[2] == pytest.approx(scores[m[1]], abs=1e-12) for m in mine)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(mine, mine[1:]))
        hits += len({m[1] for m in mine} & set(order))
        total += 20
    assert hits / total >= 0.95
    assert got[820] == [(1, 821, 6.0)] and set(got) == {*range(0, 700, 20), 820}
    assert vector_search.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage against the plain version of its rule, on its own input."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    steps = dict(corpus_pipeline.STAGES)
    before: dict = {None: {r["doc_id"]: r for r in docs.collect()}}
    last = None
    for name in names:
        out = steps[name](spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        columns = docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
        if name != names[-1]:
            assert docs.columns == columns
            before[name] = {r["doc_id"]: r for r in docs.collect()}
            assert len(before[name]) == docs.count() and set(before[name]) <= set(before[last])
        last = name
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = before["quality"]
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.97
    rows = sorted(kept)
    root = cases.link_groups([cases.shingle_set(kept[i]["text"], 5) for i in rows], 80)
    assert set(before["near_duplicates"]) == {rows[g] for g in root}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = set()
    for i, r in before["near_duplicates"].items():
        n, hit, _ = cases.contaminated_words(r["text"], items, 13)
        if not (hit > 0 and 20 * hit >= n):
            clean.add(i)
    assert set(before["decontaminate"]) == clean
    assert set(before["personal_data"]) == clean
    for i, r in before["personal_data"].items():
        assert not cases.personal(r["text"]) and r["n_chars"] == len(r["text"])
        if not cases.personal(before["decontaminate"][i]["text"]):
            assert r["text"] == before["decontaminate"][i]["text"]
    mixed = docs.groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in mixed} <= clean and max(r["count"] for r in mixed) <= 2
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_duplicates_of_five_words(spark):
    """Texts of different words with some of them changed: near copies at five words and 80 per cent, not at four and 85."""
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for n, changed in ((49, 1), (50, 1), (52, 1), (500, 11), (48, 1), (47, 2), (120, 2)):
        words = [f"n{n}w{k}" for k in range(n)]
        other = list(words)
        for k in range(changed):
            other[(k + 1) * n // (changed + 1)] = f"new{n}x{k}"
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    rows += [(100 + k, " ".join(cases.sentence(rng, rng.randrange(3, 60)))) for k in range(20)]
    rows += [(200 + k, rows[-1 - k][1] + " tail") for k in range(8)]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = {r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    root = cases.link_groups([cases.shingle_set(t, 5) for _, t in rows], 80)
    assert kept == {rows[g][0] for g in root}
    assert kept >= {0, 2, 4, 6} and not kept & {1, 3, 5, 7}


def test_recall_in_a_full_shard():
    """20,000 points around 50 centers in one shard, against all inner products."""
    rng = np.random.default_rng(21)
    centers = rng.normal(size=(50, 64))
    points = centers[rng.integers(0, 50, 20_000)] + 0.3 * rng.normal(size=(20_000, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    asked = np.arange(0, 20_000, 100)
    found: dict = {}
    for query, near, _ in vector_search.Shard(np.arange(20_000), points).nearest(asked, points[asked], 20, vector_search.BEAM):
        found.setdefault(query, set()).add(near)
    scores = points[asked] @ points.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-scores, 20, axis=1)[:, :20]
    assert np.mean([len(found[q] & set(b)) / 20 for q, b in zip(asked.tolist(), best.tolist())]) >= 0.95
