"""Audit, deduplication, holdout, splits and chunks of a corpus."""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.references import extract_references
from lexloom.functions.text import BLANK, hash32

from .ordinals import ahead_of, in_ranges, numbered


def inventory(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Documents, characters and mean length of each group, with a row TOTAL."""
    g = docs.select(by, F.length(text).cast("long").alias("chars")).rollup(by)
    out = g.agg(F.grouping(by).alias("g"), F.count("*").alias("files"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
    mean = F.when(F.col("files") > 0, F.floor(F.col("chars") / F.col("files"))).otherwise(F.lit(0)).cast("long")
    return out.select(F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col(by)).alias("grp"), "files", "chars", mean.alias("avg_chars"))


def anomalies(docs: DataFrame, short: int = 3000, long: int = 80000) -> DataFrame:
    n = F.length("text")
    flag = F.when(n < short, F.lit("stub")).when(n > long, F.lit("oversize"))
    return docs.select("doc_id", n.cast("long").alias("chars"), flag.alias("flag")).where("flag IS NOT NULL")


def ordered_anomalies(docs: DataFrame, short: int = 3000, long: int = 80000) -> DataFrame:
    """Stubs from the shortest, then oversize documents from the longest."""
    size = F.when(F.col("flag") == "stub", F.col("chars")).otherwise(-F.col("chars"))
    return anomalies(docs, short, long).orderBy(F.desc("flag"), size, "doc_id")


def table_lines(rows: DataFrame, width: int = 12) -> DataFrame:
    """rows with a column line: a Markdown table row, text to the left, numbers to the right with thousands separators."""
    numbers = {"int", "bigint", "smallint", "tinyint"}
    cells = [F.lpad(F.format_number(c, 0), width, " ") if t in numbers else F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), width, " ") for c, t in rows.dtypes]
    return rows.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))


def first_wins(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key. Tasks keep one row a key before they shuffle, so that many rows of a key don't meet in one."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(F.md5(key).alias("_k")).agg(first.alias("_v")).select("_v.*")


def fingerprint(text: Column, n: int = 300) -> Column:
    return F.btrim(F.substring(text, 1, n), F.lit(BLANK))


def seeded(seed: int, key: str) -> list[Column]:
    """A total order that depends on seed and key only."""
    return [F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key)]


def sample_exactly(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(*seeded(seed, key)).limit(n)


def split(df: DataFrame, key: str, test_share: float, seed: int = 42, scale: int = 1 << 16, floor_train: bool = False) -> DataFrame:
    """df with a column split: exactly ceil(share * rows) test rows, the least by hash.

    With floor_train there are floor((1 - share) * rows) training rows, and the rest are test rows.
    Null keys are rows like others, first in order; ties are in any order.

    Rows are counted by ranges of the hash first; only the range that holds the
    boundary is ranked, so no task sees all rows.
    """
    h = F.coalesce(hash32(str(seed), F.col(key)), F.lit(0))
    marked = df.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / ((1 << 32) // scale)))
    sums = marked.groupBy("_b").agg(F.count("*").alias("c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    rows = F.sum("c").over(Window.partitionBy())
    tests = rows - F.floor(rows * (1 - F.lit(test_share))) if floor_train else F.ceil(rows * test_share)
    sums = sums.select("_b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_a"), tests.alias("_t"))
    ranked = marked.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).join(sums, "_b")
    return ranked.withColumn("split", F.when(F.col("_a") + F.col("_r") <= F.col("_t"), F.lit("test")).otherwise(F.lit("train"))).drop("_h", "_b", "_r", "_a", "_t")


def windows(docs: DataFrame, size: int, step: int, least: int, tail: int) -> DataFrame:
    """doc_id, ord and chunk: stripped windows of size characters at every step before length - tail, if long enough.

    A text is cut once into pieces that windows are made of, so that work grows with its length.
    """
    g = math.gcd(size, step)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{g}}}"), F.lit(0))
    n = F.length("text")
    starts = F.when(n > tail, F.sequence(F.lit(0), n - tail - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    whole = lambda p: F.transform(starts, lambda s: F.btrim(F.array_join(F.slice(p, (s / g).cast("int") + 1, F.lit(size // g)), ""), F.lit(BLANK)))
    chunks = F.get(F.transform(F.array(pieces), whole), F.lit(0))
    return docs.select("doc_id", F.posexplode(chunks).alias("ord", "chunk")).where(F.length("chunk") >= least)


def outcomes(docs: DataFrame, held: DataFrame, key: str, least: int) -> DataFrame:
    """How many documents are held out, double, too short or written. docs has key, k (what double ones share) and chars."""
    marked = docs.join(held.select(key, F.lit(True).alias("h")), key, "left")
    groups = marked.where("h IS NULL").groupBy("k").agg(F.count("*").alias("rows"), F.min_by("chars", F.struct(key)).alias("first"))
    reason = F.when(F.col("first") < least, F.lit("short")).otherwise(F.lit("written"))
    counted = groups.select(F.explode(F.array(F.struct(reason.alias("reason"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("duplicate").alias("reason"), (F.col("rows") - 1).alias("n")))).alias("c")).select("c.*")
    out = marked.where("h").select(F.lit("held_out").alias("reason"), F.lit(1).cast("long").alias("n")).union(counted)
    return out.groupBy("reason").agg(F.sum("n").alias("n")).where("n > 0")


_WORDS = re.compile(r"[^ \t\n\x0b\f\r]+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+", re.ASCII)


def _fitting(text: str, size: int, count: Callable[[str], int]) -> Iterator[tuple[str, int]]:
    """Sentences with their tokens; longer ones than size in runs of words, and longer words in runs of characters."""
    for sentence in _SENTENCE_END.split(text):
        words = _WORDS.findall(sentence)
        whole = " ".join(words)
        if not words:
            continue
        if (n := count(whole)) <= size:
            yield whole, n
            continue
        run, held = [], 0
        for word in words:
            n = count(word)
            parts = [(word, n)] if n <= size else [(p, count(p)) for p in (word[i : i + max(1, size // 4)] for i in range(0, len(word), max(1, size // 4)))]
            for part, m in parts:
                if run and held + m > size:
                    yield " ".join(run), held
                    run, held = [], 0
                run.append(part)
                held += m
        if run:
            yield " ".join(run), held


def _packed(text: str, size: int, overlap: int, count: Callable[[str], int]) -> Iterator[tuple[str, int]]:
    """Chunks with their tokens. Work grows with the length of the text: a chunk looks back over the overlap only."""
    now: deque[tuple[str, int]] = deque()
    held = 0
    for sentence, n in _fitting(text, size, count):
        if now and held + n > size:
            yield " ".join(s for s, _ in now), held
            room, kept = min(overlap, size - n), deque()
            held = 0
            while now and held + now[-1][1] <= room:
                kept.appendleft(now.pop())
                held += kept[0][1]
            now = kept
        now.append((sentence, n))
        held += n
    if now:
        yield " ".join(s for s, _ in now), held


def pack_tokens(docs: DataFrame, size: int = 768, overlap: int = 128, vocabulary: Callable | None = None) -> DataFrame:
    """doc_id, ord, chunk and tokens: whole sentences up to size tokens; a chunk begins with the last sentences of the one before, up to overlap tokens.

    vocabulary is what ``tokens.vocabulary`` returns; a sentence counts with the space before it, so that the
    tokens of a chunk add up. Without one, words stand for tokens. White space becomes one space. Null texts have no chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary() if vocabulary else None
        count = (lambda s: encoder.count(" " + s)) if encoder else (lambda s: s.count(" ") + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # what a task holds is the chunks of so many texts
                part = batch.slice(at, 64)
                rows = [(i, o, c, n) for i, t in enumerate(part.column("text").to_pylist()) for o, (c, n) in enumerate(_packed(t or "", size, overlap, count))]
                which, order, chunk, held = zip(*rows, strict=True) if rows else ((), (), (), ())
                ids = part.column("doc_id").take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(order, pa.int32()), pa.array(chunk, pa.string()), pa.array(held, pa.int32())], ["doc_id", "ord", "chunk", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ord int, chunk string, tokens int")


def with_references(chunks: DataFrame, of_document: str = "references", most: int = 12) -> DataFrame:
    """chunks with their own references and, in order of name, those of chunk and document together; all columns are carried along."""
    own = chunks.withColumn("chunk_references", extract_references(F.col("chunk"), most))
    return own.withColumn("all_references", F.array_sort(F.array_union(F.coalesce(of_document, F.array().cast("array<string>")), "chunk_references")))


def bins(docs: DataFrame, key: str, size: str, width: int, rows_a_range: int = 1_000_000) -> DataFrame:
    """key and bin: place of each row's first unit, in key order, in bins of so many units, whatever documents they cut.

    Sums run within even ranges of the key, behind the sum of all earlier ranges.
    """
    dealt = in_ranges(docs.select(key, size), [key], rows_a_range)
    within = Window.partitionBy("_range").orderBy(key, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_w", F.coalesce(F.sum(size).over(within), F.lit(0))).join(F.broadcast(ahead_of(dealt, F.col(size))), "_range")  # a row a range
    return placed.select(key, F.floor((F.col("_ahead") + F.col("_w")) / width).cast("long").alias("bin"))


def pack_sentences(docs: DataFrame, size: int = 1200, least: int = 400, most: int = 3, collapse: bool = False) -> DataFrame:
    """doc_id, ord and chunk: sentences packed until the next one would pass size.

    With collapse, white space becomes one space first, and the space behind a sentence counts.
    """
    text = F.btrim(F.regexp_replace("text", r"(?U)\s+", " ")) if collapse else F.col("text")
    sentences = F.split(text, r"(?<=[.!?])\s+")
    none = F.array().cast("array<string>")
    long = lambda c: F.length(c) + F.when(c == "", F.lit(0)).otherwise(F.lit(int(collapse)))

    def step(a: Column, s: Column) -> Column:
        full = (long(a["cur"]) + F.length(s) > size) & (long(a["cur"]) > least)
        joined = F.when(a["cur"] == "", s).otherwise(F.concat(a["cur"], F.lit(" "), s))
        grown = F.struct(joined.alias("cur"), a["out"].alias("out"))
        flushed = F.struct(s.alias("cur"), F.concat(a["out"], F.array(a["cur"])).alias("out"))
        return F.when(F.size(a["out"]) >= most, a).when(full, flushed).otherwise(grown)

    packed = F.aggregate(sentences, F.struct(F.lit("").alias("cur"), none.alias("out")), step)
    chunks = F.transform(F.array(packed), lambda p: F.when((F.size(p["out"]) < most) & (long(p["cur"]) > least), F.concat(p["out"], F.array(p["cur"]))).otherwise(p["out"]))
    return docs.select("doc_id", F.posexplode(F.get(chunks, F.lit(0))).alias("ord", "chunk"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """df with a column place (from 0): an order that depends on seed and key only, by ranges of it."""
    return numbered(df, *seeded(seed, key))
