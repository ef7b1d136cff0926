"""Exact duplicates by a persistent index of digests.

The index is a table of SHA-256 digests of whole texts, bucketed and sorted by digest,
in a folder that outlives the session. New rows are first brought down to one a digest,
summed up before the shuffle, so that no group of copies meets in one task. A sort-merge
anti-join takes out the digests that the index has; as the index is bucketed, only the
new digests move, into its buckets. What is left is appended, one file a bucket. A load
that is broken off and run again under its name finds what it had appended and gives
the same verdicts.

Rows are loaded in steps from the largest ids down, so that the first row of a digest is
the one that stays: the largest id, of equal ids the one that is read first, and null ids
last. A digest that an earlier load brought keeps the row of that load.

Null texts count as empty ones; all empty texts are one group. Texts are equal only as
they are, without any change. Other columns are ignored. An empty table gives an empty
result. Tables, joins and sums are Spark's; nothing runs in Python.
"""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, cut, ensure_checkpoint_dir


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """The table digest, keep_id, load and tie below ``path``, bucketed and sorted by digest.

    Opened where it exists, with the buckets it was made with; made where it doesn't, with
    ``buckets``, or as many as the session has shuffle partitions. The folder has to be one that driver
    and executors share. One load writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None) -> None:
        self.spark, self.path = spark, path
        about = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about")
        if about.getFileSystem(spark._jsc.hadoopConfiguration()).exists(about):
            self.buckets = spark.read.json(f"{path}/about").first()["buckets"]
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.json(f"{path}/about")
        self.name = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {id_type}, load STRING, tie BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/rows'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, new: DataFrame) -> DataFrame:
        """The rows of new, one a digest, whose digest the index doesn't have."""
        return new.hint("merge").join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, new: DataFrame) -> None:
        """Rows (digest, keep_id, load, tie) whose digests aren't there yet; each bucket is sorted and written by one task."""
        new.select("digest", "keep_id", "load", "tie").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def compact(self, path: str) -> DigestIndex:
        """The same rows under another path, one file a bucket again, as every append adds one."""
        kind = self.rows().schema["keep_id"].dataType.simpleString()
        other = DigestIndex(self.spark, path, kind, self.buckets)
        other.append(self.rows())
        return other

    def close(self) -> None:
        """Takes the name out of the session's catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def deduplicate(docs: DataFrame, index: DigestIndex, load: str | None = None, steps: int = 2, rows_a_range: int = 500_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, keep_id, group_size, kept and text_sha256 of every row, after its digest is in the index; group_size counts the rows of this load."""
    load = load or uuid.uuid4().hex
    rows = cut(docs.select(F.col(key).alias("_id"), text_digest(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("tie")))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / rows_a_range))
    # from the largest ids down; ranges are even whatever the ids
    dealt = rows.repartitionByRange(ranges, F.col("_id").desc_nulls_last(), "tie")
    dealt = cut(dealt.withColumn("step", F.floor(F.spark_partition_id() * steps / ranges)))
    for step in range(steps):
        first = F.max(F.struct(F.col("_id"), (-F.col("tie")).alias("back"))).alias("first")
        new = dealt.where(F.col("step") == step).groupBy("digest").agg(first)
        index.append(index.unseen(new.select("digest", F.col("first._id").alias("keep_id"), F.lit(load).alias("load"), (-F.col("first.back")).alias("tie"))))

    sizes = dealt.groupBy("digest").agg(F.count("*").alias("group_size"))
    known = index.rows().select("digest", "keep_id", F.when(F.col("load") == load, F.col("tie")).alias("keep_tie"))
    answer = apart(sizes.hint("merge").join(known.hint("merge"), "digest"))
    kept = F.coalesce(F.col("tie") == F.col("keep_tie"), F.lit(False))
    return dealt.join(answer, "digest").select(F.col("_id").alias(key), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``deduplicate`` against an index of its own, in the shared folder."""
    path = f"{ensure_checkpoint_dir(docs.sparkSession)}/digests-{uuid.uuid4().hex}"
    index = DigestIndex(docs.sparkSession, path, docs.schema[key].dataType.simpleString())
    out = deduplicate(docs, index, text=text, key=key)
    index.close()
    return out
