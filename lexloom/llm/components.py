"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, cut


def _hook(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v) with u > v.

    Large: every larger neighbour of a node is linked to the least neighbour of the node.
    Small: so is every smaller neighbour, and the node itself. Minima are summed up
    before the shuffle, so a node with very many links doesn't gather in one task.
    """
    if large:
        both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    else:
        both = links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(apart(least), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with a link; component is the least node that it reaches.

    No links give an empty table. Links from a node to itself and null ends count as none.
    """
    now = cut(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = state(now)
    while seen[0]:
        now = cut(_hook(_hook(now, True), False).distinct())  # a large star has no more rows than links
        if (found := state(now)) == seen:
            break
        seen = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
