"""Column helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where lambdas in body use it.

    A column that a lambda refers to can be inlined by the optimizer and then runs
    again for every element; a lambda variable can't.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: str, *key: Column) -> Column:
    """A number in (0, 1) from 52 bits of an md5 over seed and key: the same in every run and engine."""
    hexed = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key])), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """r1 and r2: 128 bits that tell rows apart by id and text, null ids too; only equal rows share them."""
    text_ = F.when(text.isNull(), F.lit("")).otherwise(F.concat(F.lit("t"), text))
    return [F.xxhash64(doc_id, text_).alias("r1"), F.xxhash64(F.lit(1), text_, doc_id).alias("r2")]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without that setting a local session, as in tests, gets one of its own; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from reliable files in the shared folder, so that what follows doesn't run its plan again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Takes away a folder that the operator itself has made."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def apart(df: DataFrame) -> DataFrame:
    """An aggregate behind an exchange of its own.

    A join right on an aggregate runs in the aggregate's stage, where hot keys of the
    other side can't be split; with an exchange on either side they can.
    """
    return df.hint("rebalance")
