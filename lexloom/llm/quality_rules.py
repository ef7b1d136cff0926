"""Quality rules as a short-circuit cascade.

Each rule says which documents it rejects. Cost and selectivity of every rule are
measured on a sample, and the rules run in the order of rejections per second, each
only on what the ones before it let through. The verdict doesn't depend on the order.

Null and blank texts have no words, so the word-count rule rejects them. Null ids
and repeated rows are treated like any other row; extra columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words

_LOW = 20  # bits that hold a position when hash and position share one long


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words)`` is true for documents to drop; it is never null."""

    name: str
    rejects: Callable[[Column, Column], Column]


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""
    )


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(at: Column) -> Column:
    """Words in three-word windows that start at these sorted positions."""
    step = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
    return F.aggregate(step, F.lit(0).cast("long"), lambda a, b: a + b)


_ALL = 1 << 30


def _twins(k: Column) -> Column:
    """Positions (p, q) of neighbours in the sorted array whose shortened hashes are equal."""
    at = lambda v: v.bitwiseAND(F.lit((1 << _LOW) - 1))

    def twin(v: Column, after: Column) -> Column:
        same = F.shiftrightunsigned(v.bitwiseXOR(after), _LOW) == 0
        return F.when(same, F.struct(at(v).alias("p"), at(after).alias("q")))

    return F.filter(F.zip_with(k, F.slice(k, 2, _ALL), lambda a, b: twin(a, b)), lambda x: x.isNotNull())


def _pair_twins(k: Column) -> Column:
    """The same over (hash, position) pairs."""

    def twin(v: Column, after: Column) -> Column:
        return F.when(v["h"] == after["h"], F.struct(v["p"].alias("p"), after["p"].alias("q")))

    return F.filter(F.zip_with(k, F.slice(k, 2, _ALL), lambda a, b: twin(a, b)), lambda x: x.isNotNull())


def _covered_by(twins: Column) -> Column:
    at = F.sort_array(F.array_union(F.transform(twins, lambda x: x["p"]), F.transform(twins, lambda x: x["q"])))
    return F.when(F.size(twins) == 0, F.lit(0).cast("long")).otherwise(let(at, _covered))


def n_repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the text.

    Hash and position share one long, so that sorting moves plain longs. Where the
    shortened hashes mix up two windows, or positions need more bits, whole
    (hash, position) pairs are sorted instead.
    """
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    window = lambda h, x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))
    packed = let(
        hashed,
        lambda h: F.transform(h, lambda x, i: F.shiftleft(window(h, x, i), _LOW).bitwiseOR(i.cast("long"))),
    )
    pairs = let(
        hashed,
        lambda h: F.transform(h, lambda x, i: F.struct(window(h, x, i).alias("h"), i.cast("long").alias("p"))),
    )
    inner = lambda a: F.sort_array(F.slice(a, 1, F.size(w) - 2))
    by_pairs = let(let(inner(pairs), _pair_twins), _covered_by)
    same = lambda p, q: (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))
    by_longs = let(
        let(inner(packed), _twins),
        lambda t: F.when(F.forall(t, lambda x: same(x["p"].cast("int"), x["q"].cast("int"))), _covered_by(t)).otherwise(by_pairs),
    )
    return (
        F.when(F.size(w) < 4, F.lit(0).cast("long")).when(F.size(w) < (1 << _LOW), by_longs).otherwise(by_pairs)
    )


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def too_short(n_words: Column) -> Column:
    return n_words < 50


def too_repetitive(n_words: Column, n_repeat: Column) -> Column:
    return 100 * n_repeat > 50 * n_words


BASE_RULES = (
    Rule("too_few_words", lambda t, w: too_short(F.size(w))),
    Rule("repeated_windows", lambda t, w: too_repetitive(F.size(w), n_repeat_words(w))),
)

#: Thresholds are well beyond prose in the languages of the corpus.
SHAPE_RULES = (
    Rule("symbols", lambda t, w: n_symbols(t) > 0.25 * F.size(w)),
    Rule("upper_case", lambda t, w: F.regexp_count(t, F.lit(r"\p{Lu}")) > 0.5 * word_chars(w)),
    Rule("word_length", lambda t, w: (word_chars(w) < 2 * F.size(w)) | (word_chars(w) > 20 * F.size(w))),
    Rule("repeated_lines", lambda t, w: let(_lines(t), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
    Rule("few_letters", lambda t, w: 2 * F.length(F.regexp_replace(t, r"\P{L}+", "")) < word_chars(w)),
    Rule("ellipses", lambda t, w: let(_lines(t), lambda x: F.size(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)\s*$"))) > 0.3 * F.size(x))),
)
RULES = BASE_RULES + SHAPE_RULES


def _never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def order_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7
) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, rejected share) by rejections per second, on about sample_rows rows.

    The sample is drawn in one pass, held in the cache and split into words once; each rule then runs over it
    twice, of which the first pays for compilation. An empty table leaves the order as given.
    """
    total = docs.count()  # reads no column
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    sample = docs.select("text").sample(False, min(1.0, sample_rows / total), seed).coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    sample = sample.select("text", words(F.col("text")).alias("w")).persist()
    n = max(1, sample.count())
    measured = []
    for r in rules:
        hit = F.count_if(_never_null(r.rejects(F.col("text"), F.col("w"))))
        took = []
        for _ in range(2):
            began = time.perf_counter()
            rejected = sample.agg(hit.alias("n")).first()["n"]
            took.append(time.perf_counter() - began)
        measured.append((r, min(took), rejected / n))
    sample.unpersist()
    return sorted(measured, key=lambda x: -x[2] / x[1])


def report_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """place, rule, seconds and rejected (a share of the sample) of each rule in the order in which the cascade would run them."""
    rows = [(i, r.name, took, share) for i, (r, took, share) in enumerate(order_rules(docs, rules, sample_rows), 1)]
    return docs.sparkSession.createDataFrame(rows, "place int, rule string, seconds double, rejected double")


def first_rejection(text: Column, w: Column, rules: list[Rule]) -> Column:
    """The name of the first rule in this order that rejects the text, else null; later rules don't run."""
    tried = [F.when(_never_null(r.rejects(text, w)), F.lit(r.name)) for r in rules]
    return F.coalesce(*tried, F.lit(None).cast("string"))


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows that no rule rejects, with their columns as they are."""
    ordered = [r for r, _, _ in order_rules(docs, rules, sample_rows)]
    text = F.col("text")
    return docs.where(let(words(text), lambda w: first_rejection(text, w, ordered)).isNull())


def annotate_quality(docs: DataFrame, rules: tuple[Rule, ...] = SHAPE_RULES, sample_rows: int = 2000) -> DataFrame:
    """doc_id, the base counts of every row, base_failed and kept.

    The counts decide the base rules; the others run as a cascade on what these leave.
    """
    ordered = [r for r, _, _ in order_rules(docs, rules, sample_rows)]
    text = F.col("text")

    def verdict(w: Column, n_repeat: Column) -> Column:
        failed = too_short(F.size(w)) | too_repetitive(F.size(w), n_repeat)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            word_chars(w).alias("word_chars"),
            n_repeat.alias("n_repeat_words"),
            failed.alias("base_failed"),
            F.when(failed, F.lit(False)).otherwise(first_rejection(text, w, ordered).isNull()).alias("kept"),
        )

    found = let(words(text), lambda w: let(n_repeat_words(w), lambda n: verdict(w, n)))
    counted = docs.select("doc_id", found.alias("c"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"))
    return counted.select(
        "doc_id", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words", "c.base_failed", "c.kept"
    )
