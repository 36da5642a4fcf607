"""Columns of the caller that are named like the operators' own, and limits at their least."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SCHEMA, documents, sentence
from tests.llm.test_bpe import odd_texts
from tests.llm.test_divergence import plain_audit
from wavegraph.llm import alignment, blocks, bpe, decontaminate, divergence, jaccard_join, mixing, pii, quality


def with_names(spark, names):
    """The awkward documents with columns of these names, each with values of its own."""
    docs = spark.createDataFrame(documents(15, 30), SCHEMA)
    return docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})


def own(frame, names):
    return sorted((tuple(r) for r in frame.select("doc_id", *names).collect()), key=repr)


def test_quality_names(spark):
    names = ["path_rate", "host_rate", "_host", "_path", "_evidence", "row", "host"]
    docs = with_names(spark, names)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    judged = quality.judge(docs, *model)
    assert judged.columns == [*docs.columns, "judged"] and own(judged, names) == own(docs, names)
    plain = quality.judge(docs.select("doc_id", "text", "source", "lang"), *model)
    assert sorted(map(repr, judged.select("doc_id", "judged").collect())) == sorted(map(repr, plain.select("doc_id", "judged").collect()))


def test_pii_names(spark):
    names = ["_m", "_gap", "_ok", "_step", "_block", "_cand", "_cand_email_1", "_strict", "_loose", "_by_start", "_upto", "row", "body", "spans"]
    docs = with_names(spark, names).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("write to a.b@c.org, or +49 30 1234567")).otherwise(F.col("text")))
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and own(clean, names) == own(docs, names)
    plain = pii.redact(docs.select("doc_id", "text"))
    assert own(clean, ["text"]) == own(plain, ["text"])
    assert any(r["text"] == "write to [email], or [phone]" for r in clean.select("text").collect())
    found = pii.candidates(docs)
    assert found.columns == [c for c in docs.columns if c != "_cand"] + ["_cand"]


def test_mix_names(spark):
    names = ["_key", "_copies", "key", "size", "row"]
    docs = with_names(spark, [*names, "copy"])
    taken = mixing.copies_of(docs)
    assert taken.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    assert set(own(taken, names)) <= set(own(docs, names))
    plain = mixing.copies_of(docs.select("doc_id", "text", "source"))
    assert own(taken, ["text", "copy"]) == own(plain, ["text", "copy"])


def test_cut_spans_leaves_the_rest(spark):
    """Text outside the cut is unchanged byte for byte."""
    rng = random.Random(3)
    item = sentence(rng, 20)
    around = "Hello, world. One -- two\n\n  (three); " + " ".join(f"Word{k}," for k in range(400))
    rows = [
        (1, around, "a"), (2, f"{around} {'. '.join(item)}!! And on,  it goes.", "b"), (3, " ".join(item), "c"), (4, None, "d"),
        (5, f"  {' '.join(item)}?\n{around}", "e"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit string")
    items = spark.createDataFrame([("i", " ".join(item))], "item_id string, text string")
    cut = {r["doc_id"]: (r["text"], r["hit"]) for r in decontaminate.cut_spans(docs, items, coverage=0.5).collect()}
    assert cut == {1: (around, "a"), 2: (f"{around} And on,  it goes.", "b"), 4: (None, "d"), 5: ("  " + around, "e")}


def test_block_numbers(monkeypatch):
    """Blocks of the last of very many tasks: their rows' numbers are distinct and positive."""
    class Task:
        def partitionId(self):
            return (1 << 27) - 1

    monkeypatch.setattr(blocks.TaskContext, "get", staticmethod(Task))
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 50)
    batch = pa.record_batch([pa.array(range(100), pa.int64()), pa.array(["some text"] * 99 + [None])], names=["id", "text"])
    made = [r for out in blocks._blocks(iter([batch])) for r in out.to_pylist()]
    rows = [(r["block"] << blocks.ROW_BITS) + k for r in made for k in range(r["rows"])]
    assert len(set(rows)) == 100 and 0 < min(rows) and max(rows) < 1 << 63
    monkeypatch.setattr(blocks, "ROW_BITS", 3)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1 << 20)
    few = [pa.record_batch([pa.array([k], pa.int64()), pa.array([""])], names=["id", "text"]) for k in range(20)]
    assert [r["rows"] for out in blocks._blocks(iter(few)) for r in out.to_pylist()] == [8, 8, 4]


def test_same_groups_by_fewer_pairs(spark):
    """Groups of copies of copies: the groups are those of all pairs, though most pairs are not measured."""
    rng = random.Random(9)
    rows = []
    for g in range(4):
        words = [f"g{g}w{k}" for k in range(60)]
        for _ in range(25):
            if rng.random() < 0.7:
                words = list(words)
                words[rng.randrange(60)] = f"new{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spanned, _ = jaccard_join.groups(docs)
    every, links = jaccard_join.groups(docs, whole=True)
    assert own(spanned, ["component_id"]) == own(every, ["component_id"])
    assert links.count() > 50


def test_bpe_at_its_least(monkeypatch):
    path = bpe.public_tokenizers.path(bpe.VOCABULARY)
    vocabulary = bpe.read_vocabulary(path)
    texts = odd_texts(3, 60)
    want = [x.tolist() for x in vocabulary.encode(texts, {})]
    for name, value in (("PIECE", 20), ("CACHE_WORDS", 5), ("CACHE_CHARS", 4), ("FEW_SYMBOLS", 2)):
        monkeypatch.setattr(bpe, name, value)
    known = {}
    assert [vocabulary.encode([t], known)[0].tolist() for t in texts] == want


def test_alignment_at_its_least(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 50)
    cut_a, cut_b = np.array([1, 2, 30, 31, 60]), np.array([1, 20, 21, 49, 50])
    want = alignment.linked(a, b, cut_a, cut_b, 100)
    monkeypatch.setattr(alignment, "CROSSED", 3)
    found = alignment.linked(a, b, cut_a, cut_b, 100)
    assert all((x == y).all() for x, y in zip(want, found))
    again = alignment._unpack(alignment._pack(*found))
    assert all((x == y).all() for x, y in zip(found, again))
    assert all(len(x) == 0 for x in alignment._unpack(b""))


@pytest.mark.parametrize("held, piece", [(1, 40), (400_000, 1 << 20)])
def test_counts_at_their_least(monkeypatch, held, piece):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    monkeypatch.setattr(divergence, "PIECE_BYTES", piece)
    rows = [(t or "", lang or "", source or "") for _, t, lang, source, *_ in documents(3, 60)]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows)], names=["text", "lang", "source"])
    total: dict = {}
    for out in divergence._count(iter([batch])):
        for r in out.to_pylist():
            key = r["lang"], r["source"], r["term"]
            total[key] = [x + y for x, y in zip(total.get(key, [0, 0]), (r["n"], r["docs"]))]
    want: dict = {}
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        for w in words:
            want.setdefault((lang, source, w), [0, 0])[0] += 1
        for w in set(words):
            want[lang, source, w][1] += 1
    assert total == want
    assert plain_audit([], 1, 1) == set()


def test_trees_in_blocks(monkeypatch):
    """Cutting the sorted rows into blocks changes no sum."""
    rng = np.random.default_rng(8)
    paths = sorted({(["en", "de"][rng.integers(2)], tuple((int(s), int(rng.integers(5, 9)), 2) for s in range(7) if rng.random() < 0.5)) for _ in range(300)})
    paths = [(g, p) for g, p in paths if p]
    kind = pa.list_(pa.struct([("rank", pa.int32()), ("p", pa.int64()), ("p0", pa.int64())]))
    lists = pa.array([[dict(zip(("rank", "p", "p0"), e)) for e in p] for _, p in paths], kind)
    batch = pa.record_batch([pa.array([g for g, _ in paths]), lists, pa.array([1] * len(paths), pa.int64())], names=["lang", "path", "many"])

    def sums(size):
        monkeypatch.setattr(divergence, "BLOCK_ENTRIES", size)
        total: dict = {}
        for out in divergence._pair_corrections(iter([batch.slice(k, 9) for k in range(0, len(paths), 9)])):
            for r in out.to_pylist():
                key = r["lang"], r["a"], r["b"]
                total[key] = total.get(key, 0) + r["value"]
        return total

    assert sums(1 << 18) == sums(10) != {}
