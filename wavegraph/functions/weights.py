"""Degree and frequency weights. All are guarded, as division by ln(1) is an error in ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a tag of the listening log is worth.
TAG_SCORES = {"__purge": 0, "__rating_3": 1, "__rating_4": 2, "__rating_5": 3}


def inv_log_degree(degree: Column) -> Column:
    """1 / ln(degree), and 1 for a degree of at most one."""
    return F.when(degree <= 1, F.lit(1.0)).otherwise(F.lit(1.0) / F.ln(F.greatest(degree, F.lit(2))))


def idf(count: Column) -> Column:
    """1 / ln(1 + count), for a count of at least one."""
    return F.lit(1.0) / F.ln(F.lit(1) + F.greatest(count, F.lit(1)))


def damped_idf(degree: Column) -> Column:
    """1 / (1 + ln(degree + 1))."""
    return F.lit(1.0) / (F.lit(1.0) + F.ln(degree + F.lit(1)))


def tag_score(tag: Column) -> Column:
    """The score of a tag; a bare number from 0 to 5 counts as itself; null for any other."""
    score = F.when(tag.rlike(r"^[0-5]$"), tag.try_cast("int"))
    for name, value in TAG_SCORES.items():
        score = F.when(tag == name, F.lit(value)).otherwise(score)
    return score
