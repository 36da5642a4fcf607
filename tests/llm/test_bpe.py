"""BPE by speculation and verification against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import SCHEMA, documents
from wavegraph.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


def odd_texts(seed, count):
    rng = random.Random(seed)
    every = [chr(c) for c in (
        *range(1, 0x180), *range(0x300, 0x340), *range(0x370, 0x400), 0x130, 0x558, 0x10D50, *range(0x2000, 0x2030), 0x3000,
        *range(0x4E00, 0x4E10), *range(0xAC00, 0xAC08), 0x1F600, 0x200D, 0x11A8,
    )]
    texts = ["".join(rng.choice(every) for _ in range(rng.randrange(50))) for _ in range(count)]
    texts += ["".join(rng.choice("aeinrst'! ") for _ in range(rng.randrange(150))) for _ in range(count)]
    texts += ["a<|endoftext|>B <|startoftext|><|startoftext|> <|endof text|>", "<|endoftext|>", "aΣ ΑΣ Σ", "é é", "x" * 3000, "ab" * 2000, ""]
    return texts


def test_like_the_library(library, vocabulary):
    texts = odd_texts(5, 800)
    known = {}
    for start in range(0, len(texts), 50):
        part = texts[start : start + 50]
        found = vocabulary.encode(part, known)
        found = [x.tolist() for x in found]
        assert found == [library.encode(t, add_special_tokens=False).ids for t in part]
        assert [vocabulary.decode(np.array(x, int)) for x in found] == [library.decode(x, skip_special_tokens=False) for x in found]


def test_verification_is_exact(vocabulary):
    """A guess is kept where it is what merging gives, and only there; every token is what merging makes of its symbols."""
    rng = random.Random(6)
    words = list({"".join(rng.choice("abcdeéinorstuzß0") for _ in range(rng.randrange(1, 14))) for _ in range(5000)})
    kept = 0
    for word, packed in zip(words, vocabulary.encode_words(words)):
        raw, ids = word.encode(), np.frombuffer(packed, np.int32).tolist()
        symbols = [vocabulary.pieces[0][raw[i : i + 1]] for i in range(len(raw) - 1)] + [vocabulary.pieces[1][raw[-1:]]]
        assert ids == vocabulary.merge(raw) == vocabulary._merge_many(symbols)
        kept += vocabulary.propose(raw) == ids
    assert 0 < kept < len(words)
    assert vocabulary.sound.all()


def test_scripts_taken_without_the_library(library, vocabulary):
    """Each character outside ``_OTHER`` is split and folded as the library does it."""
    for first in range(0, 0x20000, 0x400):
        part = [c for c in map(chr, range(first, first + 0x400)) if not 0xD800 <= ord(c) < 0xE000 and not bpe._OTHER.search(c)]
        text = "".join(f"a{c}1{c}!\n" for c in part)
        assert vocabulary.encode([text], {})[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_form(spark, library, monkeypatch):
    """Nulls, empty and long texts, repeated rows, clashing names; pieces, slices and the store of words at their least."""
    for name, value in (("PIECE", 40), ("SLICE_TEXTS", 3), ("CACHE_WORDS", 5), ("CACHE_CHARS", 4)):
        monkeypatch.setattr(bpe, name, value)
    rows = [(*r[:5], "own", *r[6:]) for r in documents(8, 40)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("hit", "bpe")
    coded = bpe.encode(docs)
    back = {tuple(r) for r in bpe.decode(coded).select("text", F.col("ids").cast("string"), "decoded", "bpe").collect()}
    want = set()
    for _, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.add((text, str(ids), library.decode(ids, skip_special_tokens=False), "own"))
    assert back == want
    assert coded.count() == len(rows)
    both = bpe.round_trip(docs.drop("bpe")).select("text", F.col("bpe.ids").cast("string"), "bpe.decoded").collect()
    assert {tuple(r) for r in both} == {w[:3] for w in want}
    assert bpe.round_trip(docs.limit(0)).collect() == []


def test_digests(spark, library, tmp_path):
    rows = documents(9, 30)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    found = [tuple(r) for r in bpe.op12_bpe(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
