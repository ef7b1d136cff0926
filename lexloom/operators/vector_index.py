"""An inverted-file index of vectors: cells around k-means centres, and searches that read few cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.sources.scratch import settled

from .nearest import PACK, meet
from .retrieval import dot, top_k_each

#: Most cells of an index, so that the tables of centres that are broadcast stay small; also its folders.
MOST_CELLS = 4096


def best_k(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; Spark keeps k a query and task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class VectorIndex:
    """Rows (vec_id, embedding and others) below ``path``, in a folder for each cell; large cells are dealt to slices.

    A row's cell is that of its nearest centre, and its reach the distance to it. Searches are by inner product. In a
    cell with centre c and farthest reach r nothing scores above q·c + |q| r, so a search can tell which cells can't matter.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, sample: int = 100_000, rows_a_slice: int = 50_000, seed: int = 7) -> VectorIndex:
        """Centres are fitted on about ``sample`` rows, drawn by a hash of the id; every row is dealt to a cell.

        There are as many cells as the square root of the rows, up to ``MOST_CELLS``, unless given. An empty table gives an empty index.
        """
        n = vectors.count()
        k = max(1, min(cells or round(math.sqrt(n)), MOST_CELLS))
        features = vectors.withColumn("_f", array_to_vector(F.col("embedding").cast("array<double>")))
        drawn = features if n <= sample else features.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) < sample)
        spark = vectors.sparkSession
        if not n:
            vectors.withColumns({"reach": F.lit(0.0), "slice": F.lit(0), "cell": F.lit(0)}).write.parquet(f"{path}/rows")
            spark.createDataFrame([], "cell int, centre array<double>, slices int, rows long, radius double").write.parquet(f"{path}/cells")
            return cls(spark, path)
        model = KMeans(k=k, seed=seed, maxIter=10, featuresCol="_f", predictionCol="cell").fit(drawn.select("_f"))
        share = n / max(1, sum(model.summary.clusterSizes))
        centres = [(i, c.tolist(), max(1, math.ceil(size * share / rows_a_slice))) for i, (c, size) in enumerate(zip(model.clusterCenters(), model.summary.clusterSizes, strict=True))]
        table = spark.createDataFrame(centres, "cell int, centre array<double>, slices int")
        dealt = model.transform(features).drop("_f").join(F.broadcast(table), "cell")  # at most MOST_CELLS rows
        off = F.zip_with("embedding", "centre", lambda a, b: a.cast("double") - b)
        dealt = dealt.withColumn("reach", F.sqrt(dot(off, off))).withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int")).drop("centre", "slices")
        dealt.repartition("cell", "slice").sortWithinPartitions("cell", "slice").write.partitionBy("cell").parquet(f"{path}/rows")
        index = cls(spark, path)
        sums = index.rows().groupBy("cell").agg(F.count("*").alias("rows"), F.max("reach").alias("radius"))
        table.join(F.broadcast(sums), "cell").write.parquet(f"{path}/cells")
        return index

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def order(self, queries: DataFrame) -> DataFrame:
        """query_id, q and, for every cell, its place by q·centre, the bound of its scores and its slices."""
        cells = sorted(self.cells().collect())
        number = np.array([c["cell"] for c in cells], dtype=np.int32)
        centre = np.array([c["centre"] for c in cells]) if cells else np.empty((0, 0))
        radius, slices = np.array([c["radius"] for c in cells]), np.array([c["slices"] for c in cells], dtype=np.int32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows if len(cells) else 0, 256):
                    part = batch.slice(at, 256)
                    q = part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    near = q @ centre.T
                    places = np.argsort(-near, axis=1, kind="stable")
                    bound = near + np.linalg.norm(q, axis=1)[:, None] * radius
                    which = np.repeat(np.arange(len(q)), len(cells))
                    flat = places.reshape(-1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("query_id").take(pa.array(which)), part.column("q").take(pa.array(which)), pa.array(number[flat]), pa.array(np.tile(np.arange(1, len(cells) + 1, dtype=np.int32), len(q))), pa.array(bound[which, flat]), pa.array(slices[flat])],
                        ["query_id", "q", "cell", "place", "bound", "slices"],
                    )

        kind = queries.schema["query_id"].dataType.simpleString()
        asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where("q IS NOT NULL")
        return asked.mapInArrow(run, f"query_id {kind}, q array<double>, cell int, place int, bound double, slices int")

    def _wanted(self, queries: DataFrame, packs: dict[int, list[int]], probes: int, beyond: bool) -> DataFrame:
        """query_id, q, _pack and the cells in it that a query asks for: the nearest ``probes``, or those beyond them whose bound isn't below ``least``."""
        cells = sorted(self.cells().collect())
        centre, radius = np.array([c["centre"] for c in cells]), np.array([c["radius"] for c in cells])
        number = np.array([c["cell"] for c in cells], dtype=np.int32)
        columns = {p: np.flatnonzero(np.isin(number, held)) for p, held in packs.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    q = part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    near = q @ centre.T
                    place = np.empty(near.shape, dtype=np.int32)
                    np.put_along_axis(place, np.argsort(-near, axis=1, kind="stable"), np.arange(len(cells), dtype=np.int32)[None, :], axis=1)
                    asked = place < probes
                    if beyond:
                        least = part.column("least").to_numpy(zero_copy_only=False)[:, None]  # NaN where fewer than k were found
                        asked = ~asked & ~(near + np.linalg.norm(q, axis=1)[:, None] * radius < least)
                    for p, own in columns.items():
                        some = asked[:, own]
                        rows = np.flatnonzero(some.any(axis=1))
                        if len(rows):
                            ends = np.concatenate([[0], np.cumsum(some[rows].sum(axis=1))]).astype(np.int32)
                            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(number[own[np.nonzero(some[rows])[1]]]))
                            taken = pa.array(rows)
                            yield pa.RecordBatch.from_arrays([part.column("query_id").take(taken), part.column("q").take(taken), pa.array(np.full(len(rows), p, dtype=np.int32)), listed], ["query_id", "q", "_pack", "cells"])

        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.mapInArrow(run, f"query_id {kind}, q array<double>, _pack int, cells array<int>") if cells else queries.select("query_id", "q", F.lit(0).alias("_pack"), F.array().cast("array<int>").alias("cells")).limit(0)

    def _best(self, queries: DataFrame, k: int, probes: int, but_self: bool, keep: Column | None, beyond: bool = False) -> DataFrame:
        """query_id, the index's columns and score: the k best of each pack of about ``PACK`` rows, of the cells asked for; only these cells' folders are read."""
        table, packs, ahead = [], {}, 0
        for c in sorted(self.cells().select("cell", "slices", "rows").collect()):
            for part in range(c["slices"]):
                table.append((c["cell"], part, ahead // PACK))
                packs.setdefault(ahead // PACK, []).append(c["cell"])
                ahead += c["rows"] // c["slices"] + 1
        asked = settled(self._wanted(queries, packs, probes, beyond), "asked")
        rows = self.rows() if keep is None else self.rows().where(keep)
        of = self.spark.createDataFrame(table, "cell int, slice int, _pack int")
        rows = rows.join(F.broadcast(asked.select(F.explode("cells").alias("cell")).where("cell >= 0").distinct()), "cell", "left_semi")  # at most MOST_CELLS rows
        rows = rows.join(F.broadcast(of), ["cell", "slice"]).drop("slice", "reach")  # a row a cell and slice
        return meet(rows, asked, queries.count(), k, but_self)

    def search(self, queries: DataFrame, k: int, probes: int, but_self: bool = False, keep: Column | None = None) -> DataFrame:
        """query_id, the index's columns, score and rank: the k best of the ``probes`` cells nearest to each query. keep filters rows before they are ranked."""
        return best_k(self._best(self._given(queries), k, probes, but_self, keep), k)

    def search_exact(self, queries: DataFrame, k: int, probes: int, but_self: bool = False, keep: Column | None = None) -> DataFrame:
        """The k best of all rows: after the nearest cells, those that might still hold a better row than the k-th found. Nulls have no score."""
        first = settled(self.search(queries, k, probes, but_self, keep), "first")
        least = first.where(F.col("rank") == k).select("query_id", (F.col("score") - 1e-6).alias("least"))
        found = self._best(self._given(queries).join(least, "query_id", "left"), k, probes, but_self, keep, beyond=True)
        return best_k(first.drop("rank").unionByName(found), k)

    @staticmethod
    def _given(queries: DataFrame) -> DataFrame:
        return queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where("q IS NOT NULL")

    def needed_probes(self, k: int, recall: float = 0.9, sample: int = 200) -> int:
        """The fewest probes by which about ``sample`` rows, as queries, find so much of their k nearest others, held against all rows."""
        n = self.rows().count()
        if not n:
            return 1
        drawn = self.rows().where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n)) < sample).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
        true = top_k_each(self.rows().select("vec_id", "embedding", "cell", F.lit(0).alias("label")), drawn, k).select("query_id", "vec_id")
        placed = true.join(self.rows().select("vec_id", "cell"), "vec_id").join(self.order(drawn).select("query_id", "cell", "place"), ["query_id", "cell"])
        counts = sorted(placed.groupBy("place").count().collect())  # a row a cell at most
        total, met = sum(c["count"] for c in counts), 0
        for c in counts:
            met += c["count"]
            if met >= recall * total:
                return c["place"]
        return 1
