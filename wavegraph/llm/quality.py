"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A logistic model turns a document's text statistics into evidence (a log likelihood ratio of good
against poor). Every host has a rate of good documents, shrunk toward the global rate, and every
path of a host has a rate shrunk toward its host's: few documents move a rate little, and how
little is estimated from how much the rates differ (method of moments). A document's score adds
its evidence to the log odds of its path.

The logistic model is fitted on at most ``SAMPLE_ROWS`` labelled documents. The rates count all
documents: labelled ones by their label, others by the model's probability.

Scale: the text is read twice and never shuffled; what is grouped is one row per document with a
few numbers, summed before the shuffle, so a host may hold any share of the rows. The table of
rates is sent to all executors only if its counted size is small.

Defined cases: a null text has the statistics of an empty one; a null host or path is a host or
path of its own; without labels of both kinds the evidence is 0 and everything is kept; repeated
labels of a document count by their mean; rows that repeat are judged one by one; other columns
may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegraph.llm.common import NOT_BLANK, batched, raw, slices, split_words, table, word_hashes
from wavegraph.operators.skew import small_side
from wavegraph.session import materialize

SAMPLE_ROWS = 20_000
KEEP = 0.5

# Classes of bytes whose shares are statistics of a text.
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:!?'\"()-",
            b"|", b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256)))
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _k
FEATURES = len(_CLASSES) + 7


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text."""
    out = [np.zeros((0, FEATURES))]
    for start, stop in slices(texts):
        part = raw(texts).slice(start, stop - start)
        n = stop - start
        data, first, end, row = split_words(part, NOT_BLANK, lower=False)
        ends = np.frombuffer(part.buffers()[1], np.int32, n + 1, part.offset * 4).astype(np.int64)
        size = np.diff(ends)
        kinds = np.bincount(np.repeat(np.arange(n), size) * (len(_CLASSES) + 1) + _CLASS[data], minlength=n * (len(_CLASSES) + 1))
        shares = kinds.reshape(n, -1)[:, :-1] / np.maximum(size, 1)[:, None]
        words = np.bincount(row, minlength=n)
        hashes = word_hashes(data, first, end)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        # Distinct words of a text: sort by row and hash, count the changes.
        order = np.lexsort((hashes, row))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
        odd = _CLASS[data[end - 1]] >= 6 if len(end) else np.zeros(0, bool)
        per = np.maximum(words, 1)
        lines = kinds.reshape(n, -1)[:, 4] + 1
        out.append(np.column_stack([
            shares,
            np.log1p(words),
            size / per,
            np.bincount(row, weights=new[np.argsort(order, kind="stable")], minlength=n) / per,
            np.log1p(np.bincount(row, weights=again, minlength=n)) / np.log1p(per),
            np.bincount(row, weights=again, minlength=n) / per,
            np.bincount(row, weights=odd, minlength=n) / per,
            np.log1p(words / lines),
        ]))
    return np.concatenate(out)


@dataclass
class Evidence:
    """Weights of the log likelihood ratio; ``base`` are the log odds of a good document in the sample."""

    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    base: float

    def of(self, features: np.ndarray) -> np.ndarray:
        scaled = np.clip((features - self.mean) / self.spread, -8, 8)
        return np.clip(scaled @ self.weight[:-1] + self.weight[-1] - self.base, -30, 30)


def fit_evidence(features: np.ndarray, good: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Evidence:
    """Logistic regression by Newton's method."""
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = np.column_stack([np.clip((features - mean) / spread, -8, 8), np.ones(len(features))])
    weight = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        slope = x.T @ (good - p) - penalty * weight
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weight += step
        if np.abs(step).max() < 1e-8:
            break
    rate = float(np.clip(good.mean(), 1e-6, 1 - 1e-6))
    return Evidence(mean, spread, weight, math.log(rate / (1 - rate)))


def with_evidence(docs: DataFrame, evidence: Evidence | None, text: str = "text", features: bool = False) -> DataFrame:
    """``docs`` with a column ``_evidence``, or with the statistics ``_features`` themselves."""
    name = "_features" if features else "_evidence"
    if evidence is None and not features:
        return docs.withColumn(name, F.lit(0.0))
    at = docs.columns.index(text)
    schema = docs.withColumn(name, F.array(F.lit(0.0)) if features else F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = raw(batch.column(at)).fill_null(b"")
            found = statistics(column)
            added = pa.array(list(found), pa.list_(pa.float64())) if features else pa.array(evidence.of(found), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, added], names=[f.name for f in schema])

    return batched(docs).mapInArrow(run, schema)


def _strength(groups: DataFrame, within: str | None) -> float:
    """How many documents a prior is worth, from how much more the groups' rates differ than chance explains."""
    mean = F.col(within) if within else F.lit(None)
    row = groups.agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("around"),
    ).first()
    if not row["n"]:
        return 1.0
    rate = min(max(row["s"] / row["n"], 1e-6), 1 - 1e-6)
    differ = row["around"] if within else row["ss"] - row["n"] * rate * rate
    spare = row["n"] - row["nn"] / row["n"]
    chance = rate * (1 - rate)
    between = (differ - (row["k"] - 1) * chance) / spare if spare > 0 else 0.0
    return min(max(chance / between - 1, 1.0), 10_000.0) if between > 0 else 10_000.0


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
    label: str = "quality", label_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS,
) -> tuple[Evidence | None, DataFrame]:
    """The evidence model, and the rates: one row per host and path (_host, _path, host_rate, path_rate)."""
    narrow = docs.select(
        F.col(id).alias("_id"), F.col(host).alias("_host"), F.col(path).alias("_path"), F.col(text).alias("_text")
    )
    found = materialize(with_evidence(narrow, None, "_text", features=True).drop("_text"))
    labelled = (
        labels.select(F.col(label_id).alias("_id"), F.col(label).cast("double").alias("_good")).dropna()
        .groupBy("_id").agg(F.avg("_good").alias("_good"))
    )
    known = materialize(found.join(labelled, "_id", "left"))
    rows = (
        known.where(F.col("_good").isNotNull()).select("_features", "_good", F.xxhash64("_id").alias("_h"), "_id")
        .orderBy("_h", "_id").limit(sample_rows).collect()
    )
    good = np.array([r["_good"] >= 0.5 for r in rows], float)
    evidence = None
    if len(rows) and 0 < good.sum() < len(good):
        evidence = fit_evidence(np.array([r["_features"] for r in rows]), good)
    model = F.lit(0.5)
    if evidence is not None:
        terms = [
            F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col("_features")[k] - F.lit(float(m))) / F.lit(float(s)))) * F.lit(float(w))
            for k, (m, s, w) in enumerate(zip(evidence.mean, evidence.spread, evidence.weight))
        ]
        total = F.lit(float(evidence.weight[-1]))
        for term in terms:
            total = total + term
        model = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))
    sites = materialize(
        known.withColumn("_p", F.coalesce("_good", model)).groupBy("_host", "_path")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_p").alias("s"))
    )
    hosts = sites.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = whole["s"] / whole["n"] if whole["n"] else 0.5
    strong = _strength(hosts, None)
    rated = hosts.select(
        F.col("_host").alias("_h"), ((F.lit(strong * rate) + F.col("s")) / (F.lit(strong) + F.col("n"))).alias("host_rate"),
        (F.col("s") / F.col("n")).alias("_own"),
    )
    joined = materialize(sites.join(rated, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h"))
    inner = _strength(joined, "_own")
    shrunk = (F.lit(inner) * F.col("host_rate") + F.col("s")) / (F.lit(inner) + F.col("n"))
    return evidence, joined.select("_host", "_path", "host_rate", shrunk.alias("path_rate"))


def judge(
    docs: DataFrame, evidence: Evidence | None, rates: DataFrame, text: str = "text", host: str = "source",
    path: str = "lang", keep: float = KEEP,
) -> DataFrame:
    """``docs`` with a struct ``judged``: evidence, host_rate, path_rate, score (0 to 1), keep."""
    base = [c for c in docs.columns if c != "judged"]
    # The caller's columns are inside ``row``, where no name is in the way.
    boxed = docs.select(
        F.struct(*(docs[c] for c in base)).alias("row"), docs[text].cast("string").alias("text"), docs[host].alias("host"), docs[path].alias("path")
    )
    count = rates.count()
    joined = with_evidence(boxed, evidence, "text").join(
        small_side(rates, count), F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left"
    )
    rate = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.coalesce("path_rate", F.lit(0.5))))
    score = 1 / (1 + F.exp(-(F.log(rate / (1 - rate)) + F.col("_evidence"))))
    score = F.lit(1.0) if evidence is None else score
    return joined.select(*(F.col("row")[c].alias(c) for c in base), F.struct(
        F.col("_evidence").alias("evidence"), "host_rate", "path_rate", score.alias("score"), (score >= keep).alias("keep")
    ).alias("judged"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged documents; ``documents`` has no URL, so ``source`` stands for the host and ``lang`` for the path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = judge(docs, *fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", *(F.col(f"judged.{c}").alias(c) for c in ("evidence", "host_rate", "path_rate", "score", "keep"))
    )
