"""What the operators on vectors share: the rows that count, integer entries and tables of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """key, v and further columns of the rows whose vector has entries, none of them null, NaN or infinite; v is of doubles."""
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))  # NaN is above infinity here
    return rows.select(F.col(key), F.col(vector).cast("array<double>").alias("v"), *more).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def shape(rows: DataFrame, most: float) -> tuple[int, int]:
    """Rows and entries of each vector v. Vectors of different lengths, or entries beyond ``most`` either way, are an error."""
    size = F.size("v")
    n, least, longest, peak = rows.agg(F.count("*"), F.min(size), F.max(size), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if n and least != longest:
        raise ValueError(f"vectors have {least} to {longest} entries; all must have as many")
    if n and peak > most:
        raise ValueError(f"an entry is {peak}; exact integers hold entries up to {most}")
    return n, longest or 0


def matrix(column: pa.Array) -> np.ndarray:
    """A batch of lists of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def lists(rows: np.ndarray) -> pa.Array:
    """The other way round."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if len(rows) else 0)
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows).reshape(-1)))


def batches(step: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """step on each batch that has rows."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if batch.num_rows:
                yield step(batch)

    return run
