"""Keyword search by BM25 over postings, and the fusion of rankings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lexloom.sources.scratch import settled

from .nearest import PACK, _one, rounded

#: Runs of ASCII letters and digits and of all other characters beyond ASCII, lower-cased.
TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: By byte of UTF-8, whether it is of a term.
_OF_TERM = np.array([i > 127 or chr(i).isalnum() for i in range(256)])
K1, B = 1.2, 0.75
#: Scores are compared at six digits.
SLACK = 2e-6
#: Documents of a block that a task scores; bytes of text whose words are counted, scores held and gains added at a time.
BLOCK = 8_000
SLICE, CELLS, GAINS = 1 << 24, 1 << 21, 1 << 22
#: Terms asked for that are broadcast at most.
MOST_TERMS = 500_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def ranked(scores: DataFrame, k: int, item: str) -> DataFrame:
    """The k best items of each query with their rank; items in order break ties."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), item))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in turn, and the row of each, by their bytes; a term ends with its text at the latest."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if ends[0] == ends[-1]:
        return pa.array([], pa.string()), np.empty(0, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _OF_TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    met = ends[(ends > 0) & (ends < len(data))]  # where texts meet
    first[met], last[met - 1] = inside[met], inside[met - 1]
    low, high = np.flatnonzero(first), np.flatnonzero(last) + 1
    kind, string = (np.int32, pa.StringArray) if len(data) < 2**31 else (np.int64, pa.LargeStringArray)
    pieces = string.from_buffers(max(0, 2 * len(low) - 1), pa.py_buffer(np.stack([low, high], axis=1).astype(kind)), pa.py_buffer(data))  # terms and what is between them
    return pieces.take(pa.array(np.arange(0, len(pieces), 2))).cast(pa.string()), np.searchsorted(ends, low, "right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, df and words and, as arrays, doc_id, length and tf of the documents (doc_id, text: lower-cased) of a slice of some million characters that have it."""
    for batch in batches:
        texts, at = batch.column("text"), 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            words, row = _words(texts.slice(at, stop - at))
            found = words.dictionary_encode()
            many = stop - at
            sizes = np.bincount(row, minlength=many).astype(np.int32)
            key, tf = np.unique(found.indices.to_numpy().astype(np.int64) * many + row, return_counts=True)
            row = key % many
            edges = np.searchsorted(key, np.arange(len(found.dictionary) + 1) * many).astype(np.int32)
            sums = np.diff(np.append(0, np.cumsum(tf))[edges])
            listed = [pa.ListArray.from_arrays(pa.array(edges), x) for x in (batch.column("doc_id").take(pa.array(at + row)), pa.array(sizes[row]), pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([found.dictionary, pa.array(np.diff(edges)), pa.array(sums), *listed], ["term", "df", "words", "doc_id", "length", "tf"])
            at = stop


def best_documents(rows: pa.Table, asked: pa.Table, k: int, own: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row in ``asked`` of the query, doc_id and score: each query's k best by rounded score and doc_id.

    rows has doc_id, number (of a term) and gain, asked query_id, number and, where a query isn't to find itself, _self.
    Gains are added up in a table of some queries by all documents of the block.
    """
    coded = _one(rows["doc_id"]).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    names, many = coded.dictionary.take(pa.array(order)), len(order)
    number = rows["number"].to_numpy()
    by_term = np.argsort(number, kind="stable")
    number, doc, gain = number[by_term], place[coded.indices.to_numpy()][by_term], rows["gain"].to_numpy()[by_term]

    query = _one(asked["query_id"]).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    by_query = np.argsort(query, kind="stable")
    query, term = query[by_query], asked["number"].to_numpy()[by_query]
    low = np.searchsorted(number, term, "left")
    sizes = np.searchsorted(number, term, "right") - low
    there = sizes > 0
    first = np.flatnonzero(np.diff(query, prepend=-1) > 0)  # of each query
    mine = pc.fill_null(pc.index_in(_one(asked["_self"]).take(pa.array(by_query[first])), value_set=names), -1).to_numpy() if own else None
    edges, found = np.append(first, len(query)), []
    step = max(1, CELLS // max(1, many))
    for start in range(0, len(first), step):
        stop = min(len(first), start + step)
        pairs = edges[start] + np.flatnonzero(there[edges[start] : edges[stop]])
        ends = np.cumsum(sizes[pairs])
        score = np.zeros((stop - start) * many)
        at = 0
        while at < len(pairs):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GAINS, "right")))
            some = pairs[at:to]
            n = sizes[some]
            posting = np.repeat(low[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            score += np.bincount(np.repeat((query[some] - start) * many, n) + doc[posting], weights=gain[posting], minlength=len(score))
            at = to
        score = score.reshape(stop - start, many)
        if own:
            itself = np.flatnonzero(mine[start:stop] >= 0)
            score[itself, mine[start:stop][itself]] = 0.0
        floor = np.partition(score, many - k, axis=1)[:, many - k] if many > k else np.zeros(stop - start)
        qi, di = np.nonzero((score > 0) & (score >= (floor - SLACK)[:, None]))
        value = rounded(score[qi, di])
        best = np.lexsort((di, -value, qi))
        best = best[np.arange(len(best)) - np.searchsorted(qi[best], qi[best], "left") < k]
        found.append((by_query[first[start + qi[best]]], di[best], value[best]))
    which, docs, scores = (np.concatenate(x) if found else np.empty(0) for x in (zip(*found, strict=True) if found else ((), (), ())))
    return which.astype(np.int64), names.take(pa.array(docs.astype(np.int64))), scores.astype(np.float64)


def _task(k: int, own: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        which, docs, scores = best_documents(rows, asked, k, own)
        return pa.table([asked["query_id"].take(pa.array(which)), docs, pa.array(scores)], names=["query_id", "doc_id", "score"])

    return run


class KeywordIndex:
    """Postings below ``path``, in folders by a hash of the term; document counts of terms; totals.

    A row has a term and, as arrays, doc_id, tf and length of the documents of a slice of the table that have it; df and words are their number and the sum of tf.
    A search takes the postings of its terms only, dealt by document, so that no document's score is spread over tasks.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, path: str, folders: int = 64, key: str = "doc_id", text: str = "text") -> KeywordIndex:
        """Every document counts in the totals; null and empty texts have no postings.

        Folders let a search for few terms read few of the postings, which are shuffled for that. An index for searches that ask for
        terms of all folders needs one only; tasks then write the postings of their slices where they count them.
        """
        spark = docs.sparkSession
        known = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
        twice = settled(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")), "twice")
        schema = StructType([StructField("term", StringType()), StructField("df", IntegerType()), StructField("words", LongType())] + [StructField(n, ArrayType(t)) for n, t in (("doc_id", known.schema["doc_id"].dataType), ("length", IntegerType()), ("tf", IntegerType()))])
        once = known
        if not twice.isEmpty():  # rows of the same id and length count as one document
            same = F.col("doc_id").eqNullSafe(F.col("_id"))
            once, again = known.join(twice, same, "left_anti"), known.join(twice, same, "left_semi").select("doc_id", terms(F.col("text")).alias("w"))
            again = again.select("doc_id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", "doc_id", "length").agg(F.count("*").cast("int").alias("tf"))
        rows = once.withColumn("text", F.lower("text")).mapInArrow(_counted, schema)
        if not twice.isEmpty():
            rows = rows.unionByName(again.select("term", F.lit(1).alias("df"), F.col("tf").cast("long").alias("words"), *[F.array(c).alias(c) for c in ("doc_id", "length", "tf")]))
        if folders == 1:
            rows.write.parquet(f"{path}/postings/folder=0")
        else:  # folders of common terms are much larger than others, and dealt to as many tasks as their size asks for
            rows = rows.withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(folders)).cast("int"))
            rows.hint("rebalance", "folder").write.partitionBy("folder").parquet(f"{path}/postings")
        spark.range(1).select(F.lit(folders).alias("folders")).write.parquet(f"{path}/about")
        index = cls(spark, path)
        counts = index._rows().groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
        counts.write.parquet(f"{path}/terms")
        words = spark.read.schema(counts.schema).parquet(f"{path}/terms").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
        known.agg(F.count("*").alias("docs")).crossJoin(words).select("docs", (F.col("words") / F.greatest("docs", F.lit(1))).alias("mean")).write.parquet(f"{path}/totals")
        return index

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @staticmethod
    def _listed() -> Column:
        return F.inline(F.arrays_zip("doc_id", "length", "tf"))

    def postings(self) -> DataFrame:
        return self._rows().select("folder", "term", self._listed())

    def weights(self) -> DataFrame:
        """term, df and idf; the totals are one row."""
        totals = self.spark.read.parquet(f"{self.path}/totals")
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return self.spark.read.parquet(f"{self.path}/terms").join(F.broadcast(totals)).select("term", "df", idf.alias("idf"), "mean")

    @staticmethod
    def gain() -> Column:
        """What a posting adds to its document's score, over the columns idf, tf, length and mean."""
        tf = F.col("tf")
        return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))

    def search(self, queries: DataFrame, k: int, blocks: int = 1, but_self: bool = False) -> DataFrame:
        """query_id, doc_id, score and rank of the k best documents of each query (query_id, terms: array of strings).

        The postings of the terms asked for go to blocks of about ``BLOCK`` documents (as many blocks as given at least), and
        every block meets ``PACK`` queries at a time in a task, which sends on k documents a query. All scores are whole.
        """
        asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
        if but_self:
            asked = asked.withColumn("_self", F.col("query_id").cast(self.postings().schema["doc_id"].dataType)).where("_self IS NOT NULL")
        asked = settled(asked, "asked")
        words = settled(asked.select("term").distinct().join(self.weights(), "term").withColumn("number", F.monotonically_increasing_id()), "words")
        about = asked.select(F.count_distinct(F.struct("query_id")).alias("n")).crossJoin(self.spark.read.parquet(f"{self.path}/totals")).first()
        blocks = max(blocks, math.ceil(about["docs"] / BLOCK))
        packs = max(1, math.ceil(about["n"] / PACK))
        few = F.broadcast(words) if words.count() <= MOST_TERMS else words
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        met = self._read(words).join(few, "term").select("number", "idf", "mean", self._listed()).select("doc_id", "number", self.gain().alias("gain"))
        met = (met.where("doc_id IS NOT NULL") if but_self else met).withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).withColumn("_pack", every(packs))
        pairs = asked.join(few.select("term", "number"), "term").drop("term")
        pairs = pairs.withColumn("_pack", F.pmod(F.xxhash64("query_id"), F.lit(packs)).cast("int")).withColumn("_block", every(blocks))
        schema = StructType([queries.schema["query_id"], met.schema["doc_id"], StructField("score", DoubleType())])
        found = met.groupBy("_block", "_pack").cogroup(pairs.groupBy("_block", "_pack")).applyInArrow(_task(k, but_self), schema)
        return ranked(found, k, "doc_id")

    def _read(self, some: DataFrame) -> DataFrame:
        """The rows of the folders that the terms asked for are in."""
        folder = F.pmod(F.xxhash64("term"), F.lit(self._folders())).cast("int")
        wanted = some.select(folder.alias("folder")).where("folder >= 0").distinct()
        return self._rows().join(F.broadcast(wanted), "folder", "left_semi").drop("folder")  # a row a folder at most

    def _folders(self) -> int:
        return self.spark.read.parquet(f"{self.path}/about").first()["folders"]

    def telling_terms(self, docs: DataFrame, n: int = 8) -> DataFrame:
        """query_id and terms: the n terms of each document that count most there and least elsewhere, to search for others like it."""
        own = self._rows().select("term", F.inline(F.arrays_zip("doc_id", "tf"))).join(docs.select(F.col("doc_id")), "doc_id", "left_semi").join(self.weights(), "term")
        own = own.withColumn("w", F.round(F.col("tf") * F.col("idf"), 6))
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("w"), "term"))
        best = own.withColumn("place", place).where(F.col("place") <= n)
        return best.groupBy(F.col("doc_id").alias("query_id")).agg(F.sort_array(F.collect_list("term")).alias("terms"))


def fuse(a: DataFrame, b: DataFrame, item: str, k: int, depth: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, item, rank): what is listed in either, by the sum of 1 / (depth + rank)."""
    both = a.select("query_id", item, F.col("rank").alias("rank_a")).join(b.select("query_id", item, F.col("rank").alias("rank_b")), ["query_id", item], "full")
    share = lambda c: F.coalesce(1 / (depth + F.col(c)), F.lit(0.0))
    return ranked(both.withColumn("score", F.round(share("rank_a") + share("rank_b"), 6)), k, item)
