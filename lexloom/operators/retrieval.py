"""Filtered vector search and context blocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.references import refers_to

from .nearest import PACK, meet


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """To unit length; zero vectors stay."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def metadata_filter(
    author: str | None = None, volumes: Sequence[int] | None = None, book: str | None = None, numbers: Sequence[int] | None = None, strict_and: bool = False
) -> Column | None:
    """The conjunction of the filters given, or None; strict_and asks for all listed volumes and numbers at once."""
    parts = []
    if author:
        parts.append(F.col("author") == author)
    for name, values in (("volume", volumes), ("number", numbers)):
        if values:
            parts += [F.col(name) == v for v in values] if strict_and else [F.col(name).isin(*values)]
    if book:
        parts.append(refers_to(F.col("references"), book))
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def in_years(year: Column, low: int, high: int) -> Column:
    """Unknown years pass."""
    return year.isNull() | year.between(low, high)


def parse_numbers(c: Column) -> Column:
    """The integers of a comma-separated list; null if any part isn't one."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("int"))
    return F.when(F.exists(numbers, lambda x: x.isNull()), F.lit(None)).otherwise(numbers)


def top_k(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k rows nearest to the one query vector (column q) by inner product; ids break ties. Several query rows are an error."""
    found = query.select("q").limit(2).agg(F.collect_list("q").alias("qs"))
    one = found.select(F.when(F.size("qs") < 2, F.get("qs", F.lit(0))).otherwise(F.raise_error(F.lit("top_k takes one query"))).alias("q"))
    scored = vectors.join(F.broadcast(one)).where("q IS NOT NULL")
    return scored.withColumn("score", F.round(dot("embedding", "q"), 6)).drop("q", "embedding").orderBy(F.desc("score"), "vec_id").limit(k)


def retrieve(vectors: DataFrame, query: DataFrame, keep: Column | None, k: int, then: Column | None, most: int) -> DataFrame:
    """Filter, top k, a second filter on these only, and at most ``most`` of what is left, with their place from 1."""
    found = top_k(vectors if keep is None else vectors.where(keep), query, k)
    found = (found if then is None else found.where(then)).orderBy(F.desc("score"), "vec_id").limit(most)
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))  # at most k rows


def range_filter(column: str, low: int, high: int, whole: tuple[int, int]) -> Column | None:
    """No filter where the range is the whole one."""
    return None if (low, high) == whole else F.col(column).between(low, high)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, block: int = PACK) -> DataFrame:
    """query_id, vec_id, label, score and rank of the k nearest other rows of each query (query_id, q).

    Exact, so each query meets every vector: both are dealt to packs of about ``block`` rows, every pack of vectors
    meets every pack of queries in a task, and k rows a query leave it.
    """
    packs = -(-vectors.count() // block) or 1
    dealt = vectors.select("vec_id", "embedding", "label", F.pmod(F.xxhash64("vec_id"), F.lit(packs)).cast("int").alias("_pack"))
    asked = queries.select("query_id", "q", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("_pack"))
    scored = meet(dealt, asked, queries.count(), k, but_self=True).select("query_id", "vec_id", "label", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Header:
    """The line above an excerpt: what comes before the volume and the reference, and what an untitled one is called."""

    word: str = "Document"
    untitled: str = "Untitled"
    volume: str | None = ", Volume "
    reference: str | None = " | Text: "

    def column(self) -> Column:
        """Over the columns number, title, volume and reference."""
        given = lambda prefix, value, there: F.when(there, F.concat(F.lit(prefix), value)).otherwise(F.lit("")) if prefix else F.lit("")
        number = F.coalesce(F.col("number").cast("string"), F.lit("?"))
        return F.concat(
            F.lit(f"[{self.word} "), number, F.lit(' — "'), F.coalesce("title", F.lit(self.untitled)), F.lit('"'),
            given(self.volume, F.col("volume").cast("string"), F.col("volume").isNotNull() & (F.col("volume") != 0)),
            given(self.reference, F.col("reference"), F.coalesce(F.col("reference") != "", F.lit(False))), F.lit("]"),
        )


#: The three forms in use: prompts, evaluation and samples.
PROMPT_HEADER, EVALUATION_HEADER, SAMPLE_HEADER = Header(), Header(untitled="", volume=", Vol. ", reference=" | "), Header(untitled="", volume=None, reference=None)


def context_blocks(rows: DataFrame, by: str, rank: str, separator: str = "\n\n", header: Header = PROMPT_HEADER, tail: str = "\n") -> DataFrame:
    """One string of attributed blocks a group, in rank order; rows has number, title, volume, reference and text. Groups are the few rows of a query."""
    block = F.concat(header.column(), F.lit("\n"), F.trim("text"), F.lit(tail))
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["b"]), separator).alias("context"))
