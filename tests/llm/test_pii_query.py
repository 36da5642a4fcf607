"""The registered query of operator 4 against the contract, column by column."""

import hashlib

from tests.llm import cases
from wavegraph.llm import pii

TEXTS = [
    None, "", "nothing here", "a@b.com and c@d.org and x.y+z%_@q-r.co.uk", "10.0.0.1 then 256.1.1.1 then 8.8.8.8",
    "4111111111111111 and 5500 0000 0000 0004", "+1 (555) 123-4567, +49 30 1234567 and a@b.com at 1.2.3.4", "𝒳 a@b.com 𝒳 4111-1111-1111-1111",
    "a@b.com " * 300,
]


def test_counts_and_spans(spark, tmp_path):
    rows = [*enumerate(TEXTS), (None, TEXTS[3]), (3, TEXTS[3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in rows:
        spans = cases.personal(text)
        listed = ",".join(f"{k}:{start}:{end}" for k, start, end in spans)
        want.append((doc, *(sum(s[0] == k for s in spans) for k in pii.KINDS), hashlib.sha256(listed.encode()).hexdigest()))
    found = pii.op4_pii(spark, str(tmp_path)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.collect())
