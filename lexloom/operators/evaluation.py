"""Evaluation analytics over answers, scores and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import numbered

# Phrases by which an answer admits a limitation.
LIMITATIONS = ("do not find", "not addressed", "insufficient")


def mean_nonzero(c: Column) -> Column:
    """Zeros count as missing."""
    return F.avg(F.nullif(c, F.lit(0)))


def rate(c: Column) -> Column:
    return F.avg(c.cast("int")) * 100


def admits_limitation(answer: Column) -> Column:
    low = F.lower(answer)
    out = F.lit(False)
    for p in LIMITATIONS:
        out = out | F.contains(low, F.lit(p))
    return out


def has_citations(answer: Column, numbers: Column, word: str, whole: bool = False) -> Column:
    """Whether the answer holds the word and any of the numbers; whole asks for the number as a word."""
    if whole:
        hit = F.exists(numbers, lambda n: F.array_contains(F.regexp_extract_all(answer, F.lit(r"\d+"), F.lit(0)), n.cast("string")))
    else:
        hit = F.exists(numbers, lambda n: F.contains(answer, n.cast("string")))
    return F.contains(answer, F.lit(word)) & F.coalesce(hit, F.lit(False))


def compare(a: DataFrame, b: DataFrame, key: str, by: str, tie: float = 0.1) -> DataFrame:
    """Means of score in a and b by group, their difference, and wins, losses and ties of b."""
    both = a.select(key, by, F.col("score").alias("a")).join(b.select(key, F.col("score").alias("b")), key)
    d = F.col("b") - F.col("a")
    return both.groupBy(by).agg(
        F.round(mean_nonzero(F.col("a")), 6).alias("mean_a"),
        F.round(mean_nonzero(F.col("b")), 6).alias("mean_b"),
        F.round(mean_nonzero(F.col("b")) - mean_nonzero(F.col("a")), 6).alias("delta"),
        F.count_if(d >= tie).alias("wins"),
        F.count_if(d <= -tie).alias("losses"),
        F.count_if(F.abs(d) < tie).alias("ties"),
    )


def perplexity(loss: Column, tokens: Column) -> Column:
    return F.exp(F.sum(loss * tokens) / F.sum(tokens))


def join_by_position(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """The rows of two result tables side by side by their place (from 0), as far as the shorter goes.

    Tables that share a key are better joined by it, as ``compare`` does.
    """
    return numbered(a, order_a).join(numbered(b, order_b), "place")
