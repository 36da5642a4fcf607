"""Source divergence audit against plain loops."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.cases import SCHEMA, documents, lower_ascii
from wavegraph.llm import divergence


def plain_audit(rows, least_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for row in rows:
        text, lang, source = (x or "" for x in row[1:4])
        words = term.findall(lower_ascii(text))
        groups.add((lang, source))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    kept = {lang: [t for t, n in c.items() if n >= least_docs] for lang, c in docs.items()}
    f = lambda p, q: (p - q) ** 2 // (p + q)

    def shares(counts, terms):
        size = sum(counts[t] for t in terms) + 2 * len(terms)
        return {t: 1 + 1_000_000_000 * (counts[t] + 2) // size for t in terms}

    out = set()
    for lang, source in groups:
        terms = kept.get(lang, [])
        p = shares(count[lang, source], terms)
        every = sum((count[g] for g in groups if g[0] == lang), Counter())
        q = shares(every, terms)
        pair = [
            (sum(f(p[t], r[t]) for t in terms), other)
            for tongue, other in groups
            if tongue == lang and other != source
            for r in [shares(count[lang, other], terms)]
        ]
        own = [(f(p[t], q[t]), t) for t in terms if count[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pair), ("term", own)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= top}
    return out


@pytest.fixture
def rows():
    rng = random.Random(4)
    made = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), *rest) for k, (_, t, _, _, *rest) in enumerate(documents(3, 90))]
    # A language without any kept term, and one of a single source that holds most rows.
    made += [(900, "solo", "xx", "a", 0, "h", "v", "s", "r"), (901, None, "xx", "b", 0, None, None, None, None)]
    return made


@pytest.mark.parametrize("block, held, few", [(1 << 18, 400_000, 200_000), (7, 5, 0)])
def test_audit(spark, rows, monkeypatch, block, held, few):
    monkeypatch.setattr(divergence, "BLOCK_ENTRIES", block)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 1 << 20 if few else 40)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", few)
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"hit": "rank", "verdict": "p0", "spans": "salt"})
    found = divergence.audit(docs.repartition(3), least_docs=4, top=3).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == plain_audit(rows, 4, 3)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_shares_paths():
    """Rows that begin alike pass the same node; the sums are those of all pairs in all rows."""
    rng = np.random.default_rng(2)
    rows = sorted(
        (int(rng.integers(2)), tuple((s, int(rng.integers(1, 4))) for s in range(6) if rng.random() < 0.6)) for _ in range(200)
    )
    rows = [(g, r) for g, r in rows if r]
    p0 = np.array([5, 9, 4, 7, 3, 8])
    cut = np.cumsum([0] + [len(r) for _, r in rows])
    rank = np.array([s for _, r in rows for s, _ in r])
    p = np.array([100 * c + s for _, r in rows for s, c in r])
    many = rng.integers(1, 5, len(rows))
    got = divergence._tree(np.array([g for g, _ in rows]), cut, rank, p, p0[rank], many)
    f = divergence.divergence_of
    want = Counter()
    for (g, r), m in zip(rows, many):
        for i, (b, cb) in enumerate(r):
            for a, ca in r[:i]:
                x, y, x0, y0 = 100 * cb + b, 100 * ca + a, p0[b], p0[a]
                want[g, a, b] += int(m * (f(x, y) - f(x, y0) - f(x0, y) + f(x0, y0)))
    assert {(int(g), int(a), int(b)): int(v) for g, a, b, v in zip(*got)} == dict(want)
