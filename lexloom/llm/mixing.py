"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / weight, with u from a hash of its id and text, so reruns
agree. Each source repeats whole epochs up to its target; what is left of the target
goes to the documents with the least keys, up to the one that crosses the budget, which
is taken if that brings the sum nearer.

Prefix sums don't gather a source in one task: rows are dealt to ranges of (source,
key), cut at quantiles, so that ranges are even whatever the weights; ranges are summed
first, and rows are ordered within their range only. Rows equal in id and text are
told apart by their place in the written table; as they are alike in size, which of
them is taken doesn't change the result. The table of sources, a few numbers each, is
ordered in one task.

Null sources form one source, last in order; null and blank texts have size 0 and
take nothing. Null ids are ids like others; repeated rows count as often as they
occur. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, cut, unit_hash

WEIGHTS = (5, 2, 1)
MOST = 3  # times its size that a source, and so a document, may be taken


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.05 and 1: less for texts with many symbols a word."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0))
    return F.greatest(F.lit(0.05), 1 - symbols / F.greatest(size, F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n, source_size and target of each source; sizes has source, n and source_size.

    Sources that would pass ``most`` times their size stop there and the rest is shared
    by weight. With sources by rising limit per weight, the level at which the others
    stand is the greatest (what is left) / (weight left) on the way.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))).cast("int") + 1))
    weighed = weighed.withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = weighed.withColumn("level", rest / left)
    level = level.withColumn("level", F.max("level").over(every))
    return level.select("source", "n", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def sort_key(seed: str, doc_id: Column, text: Column, weight: Column) -> Column:
    u = unit_hash(seed, F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return -F.log(u) / weight


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix", rows_a_range: int = 500_000) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs and taken for every row of docs."""
    sized = docs.select("doc_id", "source", "text", count_words(F.col("text")).alias("size"))
    key = sort_key(seed, F.col("doc_id"), F.col("text"), quality_weight(F.col("text"), F.col("size")))
    slot = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    sized = cut(sized.select("doc_id", "source", "size", key.alias("key"), slot.alias("slot"), F.xxhash64(F.monotonically_increasing_id()).alias("tie")))

    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(sized.count() / rows_a_range))
    dealt = cut(sized.repartitionByRange(ranges, "slot", "key", "doc_id", "tie").withColumn("range", F.spark_partition_id()))

    by_range = cut(dealt.groupBy("source", "slot", "range").agg(F.count("*").alias("n"), F.sum("size").alias("in_range")))
    by_source = by_range.groupBy("source", "slot").agg(F.sum("n").alias("n"), F.sum("in_range").alias("source_size"))
    goal = targets(by_source, weights, most).withColumn("slot", slot)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.select("slot", "source_size", "target", epochs.alias("epochs"))
    goal = goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))

    ahead = Window.partitionBy("slot").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = by_range.select("slot", "range", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)).alias("ahead")).join(goal, "slot")
    within = Window.partitionBy("slot", "range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["slot", "range"])
    start = F.col("ahead") + F.col("within")
    more = F.when(start + F.col("size") / 2 <= F.col("budget"), F.col("size")).otherwise(F.lit(0))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + more).cast("long").alias("taken")
    )
