"""Names, titles and similarity."""

from __future__ import annotations

from difflib import SequenceMatcher
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that say nothing about a title.
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "in", "on", "for", "to", "at", "by", "with"]

# Tokens of a label name that are written in capitals.
CAPITAL_TOKENS = r"[A-Z][a-z]+\d+|Ep|Cd"


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Replace all named and numeric HTML entities."""
    return text.map(unescape, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def matching_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two strings; 0 if one is null or empty."""
    return pd.Series(
        [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)], dtype="float64"
    )


def string_similarity(left: Column, right: Column) -> Column:
    """Ratcliff/Obershelp ratio, ignoring case."""
    return matching_ratio(F.lower(left), F.lower(right))


def ratio_bound(left: Column, right: Column) -> Column:
    """An upper bound of ``string_similarity`` from the lengths alone; 0 if a string is empty."""
    a, b = F.length(left), F.length(right)
    total = F.nullif(a + b, F.lit(0))
    return F.coalesce(F.lit(2.0) * F.least(a, b) / total, F.lit(0.0))


def string_similarity_lev(left: Column, right: Column) -> Column:
    """1 - edit distance / longer length, ignoring case; 0 if a string is null or empty."""
    a, b = F.lower(left), F.lower(right)
    longer = F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0))
    ratio = F.lit(1.0) - F.levenshtein(a, b) / longer
    return F.when((F.length(a) > 0) & (F.length(b) > 0), ratio).otherwise(F.lit(0.0))


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def title_words(title: Column) -> Column:
    return F.filter(F.split(strip(F.lower(title)), r"\s+"), lambda w: w != "")


def title_keywords(title: Column, count: int = 3) -> Column:
    """The first words of a title that are no stop words and longer than two letters."""
    words = F.filter(title_words(title), lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 2))
    return F.slice(words, 1, count)


def search_title(title: Column) -> Column:
    """Lower case, without a leading [tag], the first two words."""
    bare = F.regexp_replace(F.lower(title), r"^\[[^\]]*\]\s+", "")
    return F.array_join(F.slice(F.split(bare, " "), 1, 2), " ")


def page_year(date_text: Column) -> Column:
    """The last four characters of a page's date, null if it is shorter."""
    return F.when(F.length(date_text) >= 4, F.right(date_text, F.lit(4)))


def catalogue_year(date_text: Column) -> Column:
    """The first four characters of a catalogue date as a number, null if they are none."""
    return F.when(F.length(date_text) >= 4, F.left(date_text, F.lit(4)).try_cast("int"))


def capitalize_words(text: Column) -> Column:
    """Upper-case the first letter of each word; leave the others."""
    return F.array_join(
        F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))),
        " ",
    )


def clean_track_title(name: Column) -> Column:
    """Drop the -id.mp3 ending and leading numbers; title case if all letters are capitals."""
    bare = F.regexp_replace(F.regexp_replace(name, r"-\d+\.mp3", ""), r"^[0-9. ]*", "")
    return F.when(F.upper(bare) == bare, capitalize_words(F.lower(bare))).otherwise(bare)


def dedupe_bigrams(title: Column) -> Column:
    """Drop a word if it followed the same word before: keep the second word of each new pair."""
    words = F.split(title, " ")
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    rest = F.transform(F.array_distinct(pairs), lambda p: F.split_part(p, F.lit(" "), F.lit(2)))
    return F.when(F.size(words) < 2, title).otherwise(
        F.array_join(F.concat(F.array(F.get(words, F.lit(0))), rest), " ")
    )


def pretty_label(label: Column) -> Column:
    """my-label-cd -> My Label CD."""
    text = capitalize_words(F.replace(label, F.lit("-"), F.lit(" ")))
    found = F.regexp_extract_all(text, F.lit(f"({CAPITAL_TOKENS})"), F.lit(1))
    between = F.split(text, CAPITAL_TOKENS, -1)
    upper = F.concat(F.transform(found, F.upper), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, upper, lambda p, q: F.concat(p, q)), "")


def format_duration(seconds: Column) -> Column:
    """h:mm:ss."""
    whole = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def parse_duration(text: Column) -> Column:
    """Seconds of mm:ss or h:mm:ss."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("int"))
    return F.aggregate(parts, F.lit(0), lambda total, part: total * 60 + part)


def artist_of_title(name: Column) -> Column:
    """The part before " - ", null if there is none."""
    return F.when(F.contains(name, F.lit(" - ")), F.get(F.split(name, " - ", 2), F.lit(0)))


def title_of_title(name: Column) -> Column:
    """The part after the first " - ", else all of it."""
    return F.coalesce(F.get(F.split(name, " - ", 2), F.lit(1)), name)


def track_id(path: Column) -> Column:
    """The digits before .mp3."""
    return F.regexp_extract(path, r"(\d*)\.mp3$", 1)
