"""Row numbers over a whole table without a task that sees all of it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.sources.scratch import settled


def in_ranges(df: DataFrame, order: Sequence[Column | str], rows_a_range: int = 1_000_000) -> DataFrame:
    """df in a settled table with a column _range: rows dealt in order to ranges of about so many rows, cut at quantiles.

    Rows that are equal in order, however many, are dealt on by where they were read, so that no range is larger than the others.
    """
    rows = settled(df.withColumn("_tie", F.monotonically_increasing_id()), "rows")
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / rows_a_range))
    return settled(rows.repartitionByRange(ranges, *order, "_tie").withColumn("_range", F.spark_partition_id()), "ranges")


def ahead_of(ranges: DataFrame, value: Column) -> DataFrame:
    """_range and _ahead: the sum of value over all earlier ranges. The table has a row a range."""
    sums = ranges.groupBy("_range").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_ahead"))


def numbered(df: DataFrame, *order: Column | str, name: str = "place", first: int = 0, rows_a_range: int = 1_000_000) -> DataFrame:
    """df with the place of every row in the order: rows are numbered within ranges, behind the rows of all earlier ranges."""
    dealt = in_ranges(df, order, rows_a_range)
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_tie"))
    placed = dealt.withColumn("_within", within).join(F.broadcast(ahead_of(dealt, F.lit(1))), "_range")  # a row a range
    return placed.withColumn(name, (F.col("_ahead") + F.col("_within") - 1 + first).cast("long")).drop("_range", "_tie", "_within", "_ahead")
