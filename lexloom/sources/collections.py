"""Collections of rows with a key: upserts that may run again, and indexes of array-valued fields that spare files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import exists, settled


class KeyedCollection:
    """Rows below ``path`` in folders by a hash of their key, each key once.

    ``upsert`` rewrites only the folders that new rows fall into, by dynamic overwrite: tasks write beside the
    collection and the commit exchanges whole folders, so a run that is broken off before it leaves the old rows,
    and one that is repeated leaves each row once. One upsert runs at a time. The null key is a key like others.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, folders: int = 64) -> None:
        self.spark, self.path, self.key, self.folders = spark, path, key, folders

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("_folder")

    def _folder(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.folders)).cast("int")

    def upsert(self, rows: DataFrame, latest: str | None = None) -> None:
        """Puts rows in place of those with their keys. Of several new rows with a key the one that is greatest in ``latest`` (the whole row, without) goes in.

        The rows that stay come from the touched folders only; others aren't read or written. ``rows`` runs twice, first for its
        keys alone, and must have the same keys each time. Whole rows are shuffled only where keys come twice or old rows stay
        in a touched folder; they're written once, so a folder has a file for each task with rows of it.
        """
        placed = rows.withColumn("_folder", self._folder())
        ids = settled(placed.groupBy("_folder", self.key).agg(F.count("*").alias("_n")).withColumnRenamed(self.key, "_key"), "upsert")
        new = placed if ids.where("_n > 1").isEmpty() else self._one(rows, latest)
        if exists(self.spark, f"{self.path}/_folder=*"):
            old = self.spark.read.parquet(self.path).join(F.broadcast(ids.select("_folder").distinct()), "_folder", "left_semi")  # a row a folder at most
            stay = old.join(ids.select("_key"), F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
            if not stay.select(self.key).isEmpty():
                new = new.unionByName(stay.select(*new.columns))  # folders are exchanged at the commit, when all is read
        new.write.partitionBy("_folder").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(self.path)

    def _one(self, rows: DataFrame, latest: str | None) -> DataFrame:
        """The greatest row of each key, with its folder."""
        names = [c for c in rows.columns if c != self.key]
        order = F.struct(*([F.col(latest)] if latest else []), *names)
        one = rows.groupBy(self.key).agg(F.max(F.struct(order.alias("_o"), F.struct(*names).alias("_v")))["_v"].alias("_v"))
        return one.select(self.key, "_v.*").withColumn("_folder", self._folder()).select(*rows.columns, "_folder")


class IndexedCollection:
    """Rows below ``path`` in parts, with postings (field, value, part) of their indexed fields, arrays or plain.

    Rows are dealt to parts in the order of ``by``, so that a value that goes with that order is in few of them.
    A search joins the parts of its values to the rows' folders, and only these are read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, rows: DataFrame, path: str, fields: Sequence[str], by: Sequence[str], parts: int = 64) -> IndexedCollection:
        dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
        dealt.write.partitionBy("part").parquet(f"{path}/rows")
        self = cls(rows.sparkSession, path)
        kept, out = self.rows(), None
        for f in fields:
            value = F.explode(f) if kept.schema[f].dataType.typeName() == "array" else F.col(f)
            one = kept.select("part", value.alias("value")).where("value IS NOT NULL").select("part", F.col("value").cast("string").alias("value"))
            one = one.groupBy("value", "part").agg(F.count("*").alias("rows")).withColumn("field", F.lit(f))
            out = one if out is None else out.unionByName(one)
        if out is not None:
            out.repartitionByRange("field", "value").sortWithinPartitions("field", "value").write.partitionBy("field").parquet(f"{path}/postings")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def having(self, field: str, values: Sequence[object]) -> DataFrame:
        """The rows with any of the values in the field."""
        wanted = [str(v) for v in values]
        parts = self.postings().where((F.col("field") == field) & F.col("value").isin(*wanted)).select("part").distinct()
        rows = self.rows().join(F.broadcast(parts), "part", "left_semi").drop("part")  # a row a part at most
        if rows.schema[field].dataType.typeName() == "array":
            return rows.where(F.exists(field, lambda x: x.cast("string").isin(*wanted)))
        return rows.where(F.col(field).cast("string").isin(*wanted))
