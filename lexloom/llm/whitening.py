"""Whitening of embeddings over exact integer sums.

Each entry c becomes the integer x = floor(1024 c) + 100000. Sums S of x by dimension are
exact, so n x - S is the exact centred row, times n. MLlib's RowMatrix sums the Gramian
of the centred rows over the cluster; divided by n it is the covariance V, of which the
driver takes the eigenvectors. V is of the vectors' length on either side, whatever the
rows; so are the sums and what goes out as a broadcast. mapInPandas projects the rows. The
covariance of what comes out is summed likewise and held against the identity.

Rows whose vector is null, empty or holds a null, NaN or infinite entry go; other
columns than key and vector are ignored. Null and repeated keys are rows like others.
Vectors of different lengths are an error, and so are entries beyond 2^30 (``LARGEST``).
Directions without variance (an eigenvalue within rounding of 0, as where all vectors are
equal) have whitened and explained 0 and don't count in identity_error. Equal eigenvalues
are in any order. A deviation beyond 64 bits is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import batches, lists, matrix, shape, usable

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**30


def integers(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * v).astype(np.int64) + SHIFT


def column_sums(rows: DataFrame) -> np.ndarray:
    """Exact sums of the integer entries by dimension: one row of sums a task, added up by dimension."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in found:
            if batch.num_rows:
                s = integers(matrix(batch.column(0))).sum(axis=0)
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([lists(total[None, :])], ["s"])

    partial = rows.select("v").mapInArrow(run, "s array<long>").select(F.posexplode("s").alias("i", "s"))
    return np.array([r["s"] for r in sorted(partial.groupBy("i").agg(F.sum("s").alias("s")).collect(), key=lambda r: r["i"])], dtype=np.int64)


def covariance(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Of n centred rows (column c, lists of doubles) with divisor n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("c").alias("c")), "c")
    return RowMatrix(vectors, n, width).computeGramianMatrix().toArray() / n


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest, those within rounding of 0 as 0, and their unit vectors as columns."""
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return np.where(e > len(e) * np.finfo(float).eps * max(e[0], 0.0), e, 0.0), q


def squares(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows of integers; null beyond 64 bits."""
    if float(np.abs(d).max()) ** 2 * d.shape[1] < 2**62:
        return (d * d).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in (d.astype(object) ** 2).sum(axis=1)]


def whiten(rows: DataFrame, most: int = 8, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error: a row for each vector and each of its first ``most`` components."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    out = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = usable(rows, key, vector)
    n, width = shape(kept, LARGEST)
    if not n:
        return spark.createDataFrame([], out)
    s = column_sums(kept)

    def centre(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lists((n * integers(matrix(batch.column(0))) - s) / n)], ["c"])

    v = covariance(kept.select("v").mapInArrow(batches(centre), "c array<double>"), n, width)
    e, q = eigen(v)
    e, q = e[:most], q[:, :most]
    root = np.sqrt(e)
    sent = spark.sparkContext.broadcast((s, np.divide(q, root, out=np.zeros_like(q), where=root > 0)))

    def project(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, axes = sent.value
        for batch in found:
            if len(batch):
                d = n * integers(np.stack(batch["v"].to_numpy())) - sums
                yield pd.DataFrame({"k": batch["k"], "deviation": pd.array(squares(d), dtype="Int64"), "w": list((d / n) @ axes)})

    # keys go as text, as pandas has no integers beside nulls
    white = cut(kept.select(F.col(key).cast("string").alias("k"), "v").mapInPandas(project, "k string, deviation long, w array<double>"))
    mean = white.agg(*[F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in range(len(e))]).first()
    off = covariance(white.select(F.array(*[F.get("w", F.lit(i)) - m for i, m in enumerate(mean)]).alias("c")), n, len(e)) - np.eye(len(e))
    real = e > 0
    error = float(np.abs(off[np.ix_(real, real)]).max(initial=0.0))

    share = F.array(*[F.lit(float(x / np.trace(v)) if x > 0 else 0.0) for x in e])
    flat = white.select(F.col("k").cast(kind).alias(key), "deviation", F.posexplode("w").alias("i", "whitened"))
    return flat.select(
        key, (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"),
    )
