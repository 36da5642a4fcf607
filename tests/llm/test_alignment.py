"""Cross-tokenizer alignment against plain loops over the libraries' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.cases import SCHEMA, documents
from tests.llm.test_bpe import odd_texts
from wavegraph.llm import alignment


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.A_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_FILE))


def plain_groups(text, libraries):
    """Groups as (ids of A, ids of B), or None."""
    a, b = libraries
    if not text:
        return None
    whole = (" " + text).encode()
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in printable)}
    left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [
        (i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
        for i in b.encode(text)
    ]
    if b"".join(t for _, t in left) != whole or b"".join(t for _, t in right) != whole:
        return None
    ends = [set(np.cumsum([len(t) for _, t in side]).tolist()) for side in (left, right)]
    groups, at = [], [0, 0]
    done = [0, 0]
    for end in sorted(ends[0] & ends[1]):
        group = []
        for k, side in enumerate((left, right)):
            ids = []
            while done[k] < end:
                ids.append(side[at[k]][0])
                done[k] += len(side[at[k]][1])
                at[k] += 1
            group.append(ids)
        groups.append(group)
    return groups


def plain_rows(texts, libraries):
    grouped = [plain_groups(t, libraries) or [] for t in texts]
    linked = [[(x, y) for a, b in groups for x in a for y in b] for groups in grouped]
    count = Counter(p for links in linked for p in set(links))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    for groups, links in zip(grouped, linked):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), said,
        )


@pytest.mark.parametrize("held, crossed, summed", [(2_000_000, 4096, 4_000_000), (40, 2, 50), (0, 4096, 50)])
def test_align(spark, libraries, monkeypatch, held, crossed, summed):
    for name, value in (("HELD_PAIRS", held), ("CROSSED", crossed), ("SUMMED", summed)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(*r[:5], "own", *r[6:]) for r in documents(11, 40)]
    texts = odd_texts(12, 40) + ["a▁b", "<s> </s> <0x41> <|endoftext|>", "中" * 300, "\U0001f600" * 40]
    rows += [(1000 + k, t, None, None, 0, "own", None, None, None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"verdict": "doc", "spans": "pairs", "removed": "row"})
    found = alignment.align(docs.repartition(5), full=True)
    assert found.columns == [c for c in docs.columns if c != "text"] + ["aligned"]
    fields = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    got = [(r["doc_id"], r["hit"], *(r["aligned"][f] for f in fields)) for r in found.collect()]
    want = [(r[0], "own", *numbers) for r, numbers in zip(rows, plain_rows([r[1] for r in rows], libraries))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[2] == 0 for w in want) and any(w[5] > w[2] for w in want)


def test_query(spark, libraries, tmp_path):
    rows = documents(13, 30)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = alignment.op13_alignment(spark, str(tmp_path))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    want = [(r[0], *n[:6], digest(n[6])) for r, n in zip(rows, plain_rows([r[1] for r in rows], libraries))]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_empty_table_and_text_alone(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert alignment.align(docs).collect() == []
    assert alignment.align(docs.select("text")).columns == ["aligned"]
    assert alignment.align(spark.createDataFrame([("a b",)], "text string"))\
        .select("aligned.n_groups").collect()[0][0] == 2


def test_cuts_over_windows():
    """Runs of one-to-one groups of any length and groups longer than a window."""
    rng = random.Random(7)
    for _ in range(300):
        at, a, b = 0, [], []
        for _ in range(rng.randrange(1, 12)):
            kind = rng.randrange(3)
            if kind == 0:
                for _ in range(rng.randrange(1, 70)):
                    at += rng.randrange(1, 4)
                    a.append(at)
                    b.append(at)
            else:
                size = rng.randrange(2, 40)
                a += sorted(rng.sample(range(at + 1, at + size), rng.randrange(0, size - 1))) + [at + size]
                b += sorted(rng.sample(range(at + 1, at + size), rng.randrange(0, size - 1))) + [at + size]
                at += size
        shared = sorted(set(a) & set(b))
        cut_a, cut_b = alignment.cuts(np.array(a), np.array(b), window=rng.choice([1, 3, 16, 1000]))
        assert [a[i - 1] for i in cut_a] == shared == [b[j - 1] for j in cut_b]
