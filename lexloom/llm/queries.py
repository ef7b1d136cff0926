"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import find_items
from .exact_dedup import exact_duplicates
from .html_text import extract_text
from .langid import identify
from .minhash import near_duplicates
from .mixing import mix_sources
from .oracle import EXACT_DEDUP, MIX_SOURCES, QUALITY_RULES, VECTOR_CODES
from .pii import find_spans
from .quality_rules import annotate_quality
from .toxicity import toxicity
from .vector_codes import encode
from .warc_zip import round_trip
from .weak_quality import classify
from .whitening import whiten


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and verdict of the cascade for every document."""
    return annotate_quality(table(spark, sf_dir, "documents"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base digest and spans of personal data for every document."""
    return find_spans(table(spark, sf_dir, "documents")).drop("r1", "r2", "all_spans")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every benchmark item found in a document."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archives it was written to."""
    return round_trip(table(spark, sf_dir, "pages"))


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, weak label and verdict for every document."""
    return classify(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict for every document; a fifth of the ids is held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and mixture of every document; a quarter of the ids is held out."""
    return identify(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether it is kept for every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every vector."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector."""
    return encode(table(spark, sf_dir, "embeddings")).drop("label")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays, group size and digest of every document."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc_zip": op4_warc_zip,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_weak_quality": op6_weak_quality,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_mix_sources": op10_mix_sources,
    "op11_whitening": op11_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_exact_dedup": op13_exact_dedup,
}
SQL: dict[str, str] = {"op8_quality_rules": QUALITY_RULES, "op10_mix_sources": MIX_SOURCES, "op12_vector_codes": VECTOR_CODES, "op13_exact_dedup": EXACT_DEDUP}
