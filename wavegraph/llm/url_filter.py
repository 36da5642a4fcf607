"""URL filters: pattern rules, each indexed by its rarest literal token.

A rule is a regular expression with the literal tokens that every URL it matches must have. The
tokens of all URLs are counted, each rule is filed under its token that the fewest URLs have, the
tokens of a URL fetch the rules filed there, and only those run their expression. Rules without a
whole literal token are filed under the empty token, which every URL has.

Scale: only the URL column is read, and each distinct URL is judged once. The rule index is sent
to all executors only if its counted size is small; else it is joined. A frequent token costs its
rows, never a group in one task.

Defined cases: a null URL, and one without ``://``, has an empty host and path and fits no host
rule; repeated URLs get the same verdict; the other columns of the pages may have any names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegraph.llm.common import UPPER, lower_ascii, table
from wavegraph.operators.skew import small_side


@dataclass(frozen=True)
class Rule:
    name: str
    regex: str
    tokens: tuple[str, ...]
    verdict: str
    listed: bool  # judged by host and path, the longest name wins; else judged by the whole URL, after the listed


def _tokens(text: str, opens: bool, closes: bool) -> tuple[str, ...]:
    """Runs of letters and digits that have something else, or a closed end, at either side."""
    out = []
    for m in re.finditer(r"[a-z0-9]+", text):
        left = opens if m.start() == 0 else text[m.start() - 1] != "*"
        right = closes if m.end() == len(text) else text[m.end()] != "*"
        if left and right:
            out.append(m.group())
    return tuple(sorted(set(out)))


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and its subdomains where the path begins with ``path``."""
    regex = r"^(?:[^/]*\.)?" + re.escape(host).replace("/", r"\/") + re.escape(path)
    tokens = _tokens(host, True, True) + _tokens(path.lower(), True, False) if path == path.lower() else _tokens(host, True, True)
    return Rule(host + path, regex, tokens, verdict, True)


def pattern_rule(pattern: str, verdict: str = "block") -> Rule:
    """Fits URLs that have ``pattern`` anywhere: ``*`` is any text, ``^`` a separator or the end."""
    parts = {"*": ".*", "^": r"(?:[^a-z0-9._%-]|$)"}
    regex = "(?s)" + "".join(parts.get(c) or re.escape(c) for c in pattern)
    return Rule(pattern, regex, _tokens(pattern, False, False), verdict, False)


LISTED = (
    host_rule("net", "/", "block"),
    host_rule("example.net", "/en/", "allow"),
    host_rule("example.com", "/de/", "block"),
    host_rule("org", "/fr/", "allow"),
)
# Pages that hold no text of their own: listings, accounts, shops, sessions, downloads.
PATTERNS = tuple(pattern_rule(p) for p in (
    "?page=", "&page=", "?sort=", "&sort=", "?replytocom=", "?print=", "?sessionid=", "&sessionid=", "?sid=", "&sid=",
    "/login^", "/logout^", "/signin^", "/signup^", "/register^", "/account/*/edit^", "/cart^", "/checkout^", "/basket^",
    "/search?", "/search/", "/tag/*/page/", "/category/*/page/", "/feed/", "/rss^", "/wp-admin/", "/cgi-bin/",
    ".jpg^", ".jpeg^", ".png^", ".gif^", ".css^", ".js^", ".zip^", ".exe^", ".pdf^",
))


def _rules_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(r.name, r.regex, list(r.tokens) or [""], r.verdict, r.listed) for r in rules]
    return spark.createDataFrame(rows, "name string, regex string, tokens array<string>, rule_verdict string, listed boolean")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + PATTERNS, url: str = "url") -> DataFrame:
    """``pages`` with a struct ``verdict``: host, path, rule (the listed rule that decides, or null), pattern, verdict."""
    spark = pages.sparkSession
    named = _rules_table(spark, rules)
    address = lower_ascii(F.col("_url"))
    split = r"(?s)^(?:(?!://).)*+://([^/?#]*+)([^?#]*+)"
    urls = (
        pages.select(F.col(url).alias("_url")).where(F.col("_url").isNotNull()).distinct()
        .withColumn("_host", F.translate(F.regexp_extract("_url", split, 1), UPPER, UPPER.lower()))
        .withColumn("_path", F.regexp_extract("_url", split, 2))
    )
    has = F.array_union(F.regexp_extract_all(address, F.lit("[a-z0-9]+"), F.lit(0)), F.array(F.lit("")))
    tokens = urls.select("*", F.explode(F.array_distinct(has)).alias("token"))
    wanted = named.select("name", F.explode("tokens").alias("token"))
    counted = (
        tokens.select("token").join(small_side(wanted.select("token").distinct(), len(rules) * 8), "token")
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )
    rarest = (
        wanted.join(counted, "token", "left").groupBy("name")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"))
    )
    index = named.drop("tokens").join(rarest, "name")
    subject = F.when(F.col("listed"), F.concat("_host", "_path")).otherwise(address)
    hits = (
        tokens.join(small_side(index, len(rules)), "token").withColumn("_subject", subject).where("_subject rlike regex")
    )
    best = hits.groupBy("_url").agg(
        F.max(F.when(F.col("listed"), F.struct(F.length("name").alias("l"), "name", "rule_verdict"))).alias("_rule"),
        F.min(F.when(~F.col("listed"), F.struct("name", "rule_verdict"))).alias("_pattern"),
    )
    judged = urls.join(best, "_url", "left").select("_url", F.struct(
        F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.name").alias("rule"),
        F.col("_pattern.name").alias("pattern"),
        F.coalesce("_rule.rule_verdict", "_pattern.rule_verdict", F.lit("allow")).alias("verdict"),
    ).alias("verdict"))
    none = F.struct(
        F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("pattern"), F.lit("allow").alias("verdict"),
    )
    kept = pages.drop("verdict") if "verdict" in pages.columns else pages
    joined = kept.join(judged, kept[url] == judged["_url"], "left")
    return joined.select(*(kept[c] for c in kept.columns), F.coalesce(judged["verdict"], none).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", *(F.col(f"verdict.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "pattern")))


_LOW = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATTERN_CASES = "\n".join(
    f"    WHEN regexp_matches({_LOW}, '{r.regex}') THEN '{r.name}'" for r in sorted(PATTERNS, key=lambda r: r.name)
)
OP6_SQL = rf"""
WITH p AS (
  SELECT page_id, url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, url, rest,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
r(name, host, path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f AS (
  SELECT h.page_id, h.url, h.host, h.path,
    (SELECT struct_pack(n := r.name, v := r.verdict) FROM r
     WHERE (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
     ORDER BY length(r.name) DESC LIMIT 1) AS rule
  FROM h),
g AS (SELECT *, CASE
{_PATTERN_CASES}
  END AS pattern FROM f)
SELECT page_id, host, path, rule.n AS rule,
  coalesce(rule.v, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern
FROM g
"""
