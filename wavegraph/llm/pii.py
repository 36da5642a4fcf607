"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans of four kinds (email, ip, card, phone) come from a strict pattern each and from a
looser one each. Labelers vote on every candidate: the pattern (strict or loose), a gazetteer (top
level domains, address blocks, card prefixes, calling codes), the words before it, and the signs
next to it. Expectation-maximisation finds how reliable each labeler is for a kind, from how they
agree over all documents, and so how likely each combination of votes is personal data. On these
likelihoods a logistic model over votes, form and length is trained; it decides on the loose
candidates. Strict spans always stay.

Scale: the text is read once by the patterns, each guarded by a sign it must have, and never
shuffled. The labelers have 3 answers at most, so what is gathered for the estimation is a table of
counts with at most 4 x 2 x 3^3 x 8 rows, however many documents there are.

Defined cases: a null text has no spans; without candidates nothing is estimated; every row is
searched by itself, so repeated rows and null ids do no harm; other columns may have any names.
Offsets count code points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegraph.llm.common import batched, table
from wavegraph.session import materialize

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
CONTEXT = 24

# The contract's patterns, written so that Java tries no start twice and never recurses: a start is a
# place where a run begins or where the last match ended, and repeats are possessive where what
# follows cannot begin within them.
_LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
_GUARD = {
    ("email", True): r"@", ("ip", True): r"[0-9]\.[0-9]", ("card", True): r"[0-9][ -]?[0-9]", ("phone", True): r"\+[0-9]",
    ("email", False): r"[(\[]at[)\]]", ("ip", False): r":[0-9A-Fa-f]{1,4}:", ("card", False): r"[0-9]{13}",
    ("phone", False): r"[0-9]{3}[ .-][0-9]{4}",
}

# Gazetteers and words of context.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "int", "io", "info", "biz", "de", "fr", "es", "it", "uk", "eu", "us", "ca", "jp", "cn", "in", "br", "ru", "nl", "ch", "at")
CALLING = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_PREFIX = r"(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
LOCAL_BLOCK = r"(?:0|127|22[4-9]|2[3-5][0-9])\."
CUES = {
    "email": r"mail|contact|write|@|courriel|correo|schreib",
    "ip": r"\bip\b|server|host|address|addr|login from",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta|iban|account",
    "phone": r"phone|tel|call|fax|mobile|cell|ruf|appel|llama",
}
COUNTER_CUES = r"version|order|invoice|isbn|issn|serial|ticket|build|\bref\b|\bno\b|\bv\b"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less 9 if above 9; the sum must end in 0."""
    def part(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, i: total + part(i)) % 10 == 0


def _valid(kind: str, strict: bool, x: Column) -> Column:
    digits = _digits(x)
    if kind == "ip" and strict:
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return x.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _gazetteer(kind: str, x: Column) -> Column:
    vote = {
        "email": F.when(F.lower(F.regexp_extract(x, "([A-Za-z0-9-]+)$", 1)).isin(*TOP_LEVEL), 1).otherwise(0),
        "ip": F.when(x.rlike("^" + LOCAL_BLOCK), -1).otherwise(1),
        "card": F.when(_digits(x).rlike("^" + CARD_PREFIX), 1).otherwise(-1),
        "phone": F.when(x.rlike("^" + CALLING), 1).when(x.startswith("+"), -1).otherwise(0),
    }[kind]
    return vote.cast("int")


BLOCK = 256


def _search(docs: DataFrame, text: Column, kind: str, strict: bool) -> DataFrame:
    """``docs`` with a column ``_cand_<kind>_<form>``: the valid matches with their offsets and votes.

    Offsets come from the lengths of matches and of the pieces between them. They are summed in
    blocks, so that a text of very many matches costs little more than its length.
    """
    pattern = (STRICT if strict else LOOSE)[kind]
    name = f"_cand_{kind}_{int(strict)}"
    none = F.array().cast("array<string>")
    found = F.when(text.rlike(_GUARD[kind, strict]), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    docs = docs.withColumn("_m", found).withColumn("_ok", F.transform("_m", lambda x: _valid(kind, strict, x)))
    docs = docs.withColumn("_gap", F.when(F.exists("_ok", lambda x: x), F.split(text, pattern, -1)).otherwise(none))
    docs = docs.withColumn("_step", F.zip_with("_gap", "_m", lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))))
    summed = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("_step") / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice("_step", b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda t, x: t + x),
    )
    docs = docs.withColumn("_block", F.when(F.size("_step") > 0, summed).otherwise(F.array().cast("array<int>")))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda t, x: t + x)

    def start(i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        inside = F.slice("_step", block * BLOCK + 1, i - block * BLOCK)
        return total(F.slice("_block", F.lit(1), block)) + total(inside) + F.length(F.element_at("_gap", i + 1))

    def votes(i: Column) -> Column:
        match = F.element_at("_m", i + 1)
        before = F.lower(F.right(F.element_at("_gap", i + 1), F.lit(CONTEXT)))
        after = F.substring(F.coalesce(F.get("_gap", i + 1), F.lit("")), 1, 1)
        context = F.when(before.rlike(COUNTER_CUES), -1).when(before.rlike(CUES[kind]), 1).otherwise(0)
        edge = F.when(before.rlike(r"[\p{L}0-9_/.:-]$") | after.rlike(r"[\p{L}0-9_/]"), -1).otherwise(1)
        at = start(i)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), at.alias("start"), (at + F.length(match)).alias("end"),
            F.lit(strict).alias("strict"), _gazetteer(kind, match).alias("gaz"), context.alias("ctx"), edge.alias("edge"),
            F.least(F.floor(F.length(match) / 5), F.lit(7)).cast("int").alias("size"),
        )

    places = F.filter(F.transform("_ok", lambda ok, i: F.when(ok, i).otherwise(F.lit(-1))), lambda i: i >= 0)
    out = F.when(F.size("_gap") > 0, F.transform(places, votes))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,strict:boolean,gaz:int,ctx:int,edge:int,size:int>>")
    return docs.withColumn(name, F.coalesce(out, empty)).drop("_m", "_ok", "_gap", "_step", "_block")


def _candidates(docs: DataFrame) -> DataFrame:
    """(row, body) with a column ``_cand``; the caller's columns are inside ``row``, where no name is in the way."""
    body = F.coalesce(F.col("body"), F.lit(""))
    for kind in KINDS:
        for strict in (True, False):
            docs = _search(docs, body, kind, strict)
    strict_spans = F.concat(*(F.col(f"_cand_{k}_1") for k in KINDS))
    docs = docs.withColumn("_strict", strict_spans).withColumn("_loose", F.concat(*(F.col(f"_cand_{k}_0") for k in KINDS)))
    alone = F.filter(
        "_loose", lambda c: ~F.exists("_strict", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    )
    return docs.select("row", "body", F.concat("_strict", F.when(F.size("_loose") > 0, alone).otherwise(F.col("_loose"))).alias("_cand"))


def _boxed(docs: DataFrame, text: str) -> DataFrame:
    return batched(docs).select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text].cast("string").alias("body"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``_cand`` (a column of that name is replaced): all candidate spans with the votes of the labelers.

    A loose candidate that meets a strict span of any kind is no candidate of its own.
    """
    return _candidates(_boxed(docs, text)).select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "_cand"), "_cand")


LABELERS = ("form", "gaz", "ctx", "edge")


@dataclass(frozen=True)
class Model:
    """Per kind: reliabilities of the labelers as estimated, and the weights of the final classifier."""

    reliability: dict[tuple[int, str, int], tuple[float, float]]
    weights: dict[int, dict[str, float]]


def _features(row: dict) -> list[str]:
    return ["bias", *(f"{name}={row[name]}" for name in LABELERS), f"size={row['size']}"]


def estimate(counts: list[dict], rounds: int = 30, steps: int = 300) -> Model:
    """Expectation-maximisation on counts of vote combinations, then the classifier on the likelihoods found."""
    reliability: dict[tuple[int, str, int], tuple[float, float]] = {}
    weights: dict[int, dict[str, float]] = {}
    for kind in sorted({r["kind"] for r in counts}):
        rows = [r for r in counts if r["kind"] == kind]
        total = sum(r["n"] for r in rows)
        # To begin with, a labeler is believed as the sum of its votes says.
        belief = [1 / (1 + math.exp(-(1.0 + sum(r[name] for name in LABELERS)))) for r in rows]
        for _ in range(rounds):
            real = sum(r["n"] * b for r, b in zip(rows, belief))
            prior = (real + 2.0) / (total + 3.0)
            odds = [math.log(prior / (1 - prior))] * len(rows)
            for name in LABELERS:
                for vote in (-1, 0, 1):
                    yes = sum(r["n"] * b for r, b in zip(rows, belief) if r[name] == vote)
                    no = sum(r["n"] * (1 - b) for r, b in zip(rows, belief) if r[name] == vote)
                    # A labeler is taken to be right rather than wrong before anything is seen.
                    lean = (2.0, 1.0) if vote > 0 else (1.0, 2.0) if vote < 0 else (1.0, 1.0)
                    given = ((yes + lean[0]) / (real + 4.0), (no + lean[1]) / (total - real + 4.0))
                    reliability[kind, name, vote] = given
                    for k, r in enumerate(rows):
                        if r[name] == vote:
                            odds[k] += math.log(given[0] / given[1])
            belief = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
        w: dict[str, float] = {f: 0.0 for r in rows for f in _features(r)}
        for _ in range(steps):
            slope = {f: -0.001 * v for f, v in w.items()}
            for r, b in zip(rows, belief):
                used = _features(r)
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[f] for f in used)))))
                for f in used:
                    slope[f] += r["n"] / total * (b - p)
            for f, s in slope.items():
                w[f] += s
        weights[kind] = w
    return Model(reliability, weights)


def fit(found: DataFrame) -> Model:
    """The model from all candidates of ``found``; only counts of vote combinations reach the driver."""
    votes = found.select(F.explode("_cand").alias("c")).select(
        F.col("c.kind").alias("kind"), F.when(F.col("c.strict"), 1).otherwise(0).alias("form"), F.col("c.gaz").alias("gaz"),
        F.col("c.ctx").alias("ctx"), F.col("c.edge").alias("edge"), F.col("c.size").alias("size"),
    )
    rows = votes.groupBy("kind", *LABELERS, "size").agg(F.count(F.lit(1)).alias("n")).collect()
    return estimate(sorted((r.asDict() for r in rows), key=lambda r: [r[k] for k in ("kind", *LABELERS, "size")]))


def decide(found: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """``_cand`` becomes ``spans``: struct kind (its number), start, end, strict; by kind, then start."""
    def score(c: Column) -> Column:
        out = F.lit(-30.0)
        for kind, weights in model.weights.items():
            total = F.lit(float(weights["bias"]))
            for name in LABELERS:
                value = F.when(c["strict"], 1).otherwise(0) if name == "form" else c[name]
                for vote in (-1, 0, 1):
                    if f"{name}={vote}" in weights:
                        total = total + F.when(value == vote, float(weights[f"{name}={vote}"])).otherwise(0.0)
            for size in range(8):
                if f"size={size}" in weights:
                    total = total + F.when(c["size"] == size, float(weights[f"size={size}"])).otherwise(0.0)
            out = F.when(c["kind"] == kind, total).otherwise(out)
        return out

    limit = math.log(accept / (1 - accept))
    kept = F.filter("_cand", lambda c: c["strict"] | (score(c) >= limit))
    spans = F.array_sort(F.transform(kept, lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["strict"].alias("strict")
    )))
    return found.withColumn("spans", spans).drop("_cand")


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every personal span in ``text`` replaced by its kind in brackets, as ``[email]``.

    Spans that overlap are replaced together, under the kind of the first.
    """
    # One search: the rows are written with their candidates, and read back for the model and for the new text.
    # The text is written once, inside ``row``.
    searched = materialize(_candidates(_boxed(docs, text)).drop("body")).withColumn("body", F.col("row")[text].cast("string"))
    found = decide(searched, fit(searched.select("_cand").where(F.size("_cand") > 0)))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = found.withColumn("by_start", by_start)
    # The end of everything up to a span, and whether the span begins a new stretch.
    upto = F.transform("by_start", lambda s, i: F.coalesce(F.array_max(F.transform(F.slice("by_start", F.lit(1), i), lambda p: p["end"])), F.lit(0)))
    found = found.withColumn("upto", F.when(F.size("by_start") > 0, upto).otherwise(F.array().cast("array<int>")))
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    ends = F.coalesce(F.array_max(F.transform("by_start", lambda s: s["end"])), F.lit(0))
    pieces = F.transform("by_start", lambda s, i: F.when(
        s["start"] >= F.get("upto", i),
        F.concat(F.substring(F.col("body"), F.get("upto", i) + 1, s["start"] - F.get("upto", i)), F.get(names, s["kind"])),
    ).otherwise(F.lit("")))
    clean = F.concat(F.array_join(pieces, ""), F.substring(F.col("body"), ends + 1, F.length("body")))
    changed = found.withColumn("body", F.when(F.size("by_start") > 0, clean).otherwise(F.col("body")))
    return changed.select(*(F.col("body").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = materialize(candidates(docs).select("doc_id", "_cand"))
    judged = decide(found, fit(found))

    def count(kind: int) -> Column:
        # A second parameter of the lambda, be it one with a default, would be the element's index.
        return F.size(F.filter("spans", lambda s: s["strict"] & (s["kind"] == kind))).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return judged.select(
        "doc_id", *counts, F.sha2(_listed(F.filter("spans", lambda s: s["strict"])), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
