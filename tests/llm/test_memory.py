"""What a task holds at once of stored tables: row groups, and the reader's batches."""

import random

import pyarrow.parquet as pq

from wavegraph import session
from wavegraph.llm import blocks, common, pii

READER = "spark.sql.parquet.columnarReaderBatchSize"


def test_row_groups_are_small(spark):
    text = "array_join(transform(sequence(1, 16), x -> sha2(concat(id, '-', x), 256)), '') AS text"
    made = session.materialize(spark.range(0, 40_000, 1, 1).selectExpr("id", text))
    files = [f.removeprefix("file://") for f in made.inputFiles()]
    groups = [pq.ParquetFile(f).metadata.row_group(k).total_byte_size for f in files for k in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(groups) > 3 * session.ROW_GROUP_BYTES
    assert max(groups) < 2 * session.ROW_GROUP_BYTES
    assert made.count() == 40_000


def test_reader_gets_few_rows_at_once(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(9)], "id long, text string")
    common.batched(docs)
    assert spark.conf.get(READER) == str(common.BATCH_ROWS)
    blocks.few_at_once(docs)
    assert int(spark.conf.get(READER)) <= 16
    pii.redact(docs)
    assert spark.conf.get(READER) == str(common.BATCH_ROWS)


def test_redact_writes_texts_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(pii, "materialize", lambda df: written.append(df.columns) or session.materialize(df))
    rng = random.Random(5)
    texts = [None, "", "write to a.b@example.org now", f"call +1 212 555 {rng.randrange(1000, 9999)}", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = [r.text for r in pii.redact(docs).orderBy("id").collect()]
    assert written == [["row", "_cand"]]
    assert found == [None, "", "write to [email] now", "call [phone]", "nothing"]
