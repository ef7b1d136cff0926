"""Compression of vectors to codes: product quantisation by Elkan's Lloyd rounds over integers.

Entries become floor(4096 c), vectors are cut into equal parts, and each part position
has a codebook. A row carries, for each part, its entry, an upper bound of the distance
to it and a lower bound for every entry. They are persisted between rounds as a table in
the shared folder, of which the last two stand. A round shifts the bounds by how far the
entries moved, passes over every entry whose lower bound is above the upper one, or that
lies more than twice the upper bound from the own entry, and measures the rest. All
bounds are whole numbers, rounded to the safe side, and both tests are strict, so that an
entry at equal distance is always measured; distances are exact integers, and ties go to
the lower index. The sums of a round are added up within each task first; the driver
holds the codebooks, whose size is that of ``entries`` vectors.

Rows whose vector is null, empty or holds a null, NaN or infinite entry go; other
columns than key, vector and label are ignored. Null keys are last in order, and rows
with equal keys are ordered by their vectors. Fewer rows than entries give smaller
codebooks. Vectors of different lengths, or of one that the parts don't divide, are an
error, and so are entries beyond 4096 (``LARGEST``) and parts of over 4096 entries (``LONGEST``), whose distances might not fit.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, cut, delete_folder, ensure_checkpoint_dir
from .vectors import batches, matrix, shape, usable

SCALE = 4096
LARGEST = 4096.0
#: Above every distance between parts of up to LONGEST entries, and within 32 bits.
FAR, LONGEST = 2**31 - 1, 4096


def integers(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * v).astype(np.int64)


def root_below(d: np.ndarray) -> np.ndarray:
    """The greatest integers whose squares aren't above d."""
    r = np.sqrt(d.astype(np.float64)).astype(np.int64)
    r -= r * r > d
    return r + ((r + 1) * (r + 1) <= d)


def root_above(d: np.ndarray) -> np.ndarray:
    r = root_below(d)
    return r + (r * r < d)


def reassign(x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray, book: np.ndarray) -> int:
    """Moves rows x (n, s) to their nearest entries of book (k, s), in place; returns how many distances it measured.

    a (n): entries now; u (n): upper bounds; low (n, k): lower bounds.
    """
    square = lambda y: (y * y).sum(axis=-1)
    between = root_below(square(book[:, None] - book[None]))

    def near(rows: np.ndarray) -> np.ndarray:
        reach = u[rows, None]
        found = (low[rows] <= reach) & (between[a[rows]] <= 2 * reach)
        found[np.arange(len(rows)), a[rows]] = False
        return found

    rows = np.flatnonzero(near(np.arange(len(x))).any(axis=1))
    own = square(x[rows] - book[a[rows]])
    u[rows], low[rows, a[rows]] = root_above(own), root_below(own)
    i, j = np.nonzero(near(rows))
    d = square(x[rows[i]] - book[j])
    low[rows[i], j] = root_below(d)
    known = np.full((len(rows), len(book)), np.iinfo(np.int64).max)
    known[np.arange(len(rows)), a[rows]] = own
    known[i, j] = d
    best = known.argmin(axis=1)  # the first of equals
    a[rows], u[rows] = best, root_above(known[np.arange(len(rows)), best])
    return len(rows) + len(i)


#: Integers of 32 bits, as bytes: Spark passes them on without looking at each.
STATE = "x binary, a binary, u binary, low binary"


def packed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of integers."""
    data = np.ascontiguousarray(rows, dtype="<i4")
    ends = np.arange(len(data) + 1, dtype=np.int32) * data.itemsize * (data.size // max(1, len(data)))
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpacked(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(b, "<i4") for b in column.to_pylist()], dtype=np.int64)


def _unpack(batch: pa.RecordBatch, parts: int) -> list[np.ndarray]:
    """x (n, parts, s), a and u (n, parts) and low (n, parts, k) of a batch, to be changed."""
    x, a, u, low = (unpacked(batch.column(c)) for c in ("x", "a", "u", "low"))
    return [x.reshape(len(x), parts, -1), a, u, low.reshape(len(x), parts, -1)]


def _round(x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray, books: np.ndarray, moved: np.ndarray) -> int:
    measured = 0
    for p, book in enumerate(books):
        ap, up, lp = a[:, p].copy(), u[:, p] + moved[p][a[:, p]], np.maximum(low[:, p] - moved[p], 0)
        measured += reassign(x[:, p], ap, up, lp, book)
        a[:, p], u[:, p], low[:, p] = ap, up, lp
    return measured


def _sums(state: DataFrame, parts: int, k: int) -> dict[tuple[int, int], np.ndarray]:
    """Of each part and entry in use: its rows, then their sums by position; counted within tasks first."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in found:
            if batch.num_rows:
                x, a = unpacked(batch.column(0)), unpacked(batch.column(1))
                x = x.reshape(len(x), parts, -1)
                total = np.zeros((parts, k, x.shape[2] + 1), dtype=np.int64) if total is None else total
                for p in range(parts):
                    np.add.at(total[p, :, 0], a[:, p], 1)
                    np.add.at(total[p, :, 1:], a[:, p], x[:, p])
        if total is not None:
            at = np.indices(total.shape).reshape(3, -1)
            used = np.repeat(total[:, :, 0] > 0, total.shape[2])
            yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in (*at, total.reshape(-1))], ["part", "entry", "i", "s"])

    partial = state.select("x", "a").mapInArrow(run, "part long, entry long, i long, s long")
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in partial.groupBy("part", "entry", "i").agg(F.sum("s").alias("s")).collect():  # at most as many as the codebooks' numbers
        out.setdefault((r["part"], r["entry"]), []).append((r["i"], r["s"]))
    return {at: np.array([s for _, s in sorted(found)], dtype=np.int64) for at, found in out.items()}


def encode(
    rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, vector: str = "embedding", key: str = "vec_id", label: str = "label"
) -> DataFrame:
    """key, label, code, error, label_error and codebooks_sha256 of every vector."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part, so that codebooks have 1 to 256 entries")
    spark = rows.sparkSession
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, label)}
    ids = f"{key} {kinds[key]}, {label} {kinds[label]}"
    kept = usable(rows, key, vector, label)
    n, width = shape(kept, LARGEST)
    if not n:
        return spark.createDataFrame([], f"{ids}, code string, error long, label_error long, codebooks_sha256 string")
    if width > parts * LONGEST:
        raise ValueError(f"parts of over {LONGEST} entries have distances beyond 32 bits")
    if width % parts:
        raise ValueError(f"vectors have {width} entries, which {parts} parts don't divide")
    first = kept.orderBy(F.col(key).asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = integers(np.array([r["v"] for r in first])).reshape(len(first), parts, -1).transpose(1, 0, 2)
    k = books.shape[1]

    def begin(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = integers(matrix(batch.column("v")))
        fill = lambda m, by: packed(np.full((len(x), m), by))
        return pa.RecordBatch.from_arrays([batch.column(key), batch.column(label), packed(x), fill(parts, 0), fill(parts, FAR), fill(parts * k, 0)], [key, label, "x", "a", "u", "low"])

    def assign(books: np.ndarray, moved: np.ndarray):  # noqa: ANN202
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, a, u, low = _unpack(batch, parts)
            _round(x, a, u, low, books, moved)
            flat = [packed(y.reshape(len(x), -1)) for y in (x, a, u, low)]
            return pa.RecordBatch.from_arrays([batch.column(key), batch.column(label), *flat], batch.schema.names)

        return batches(step)

    folder = f"{ensure_checkpoint_dir(spark)}/codes-{uuid.uuid4().hex}"
    state, moved = kept.mapInArrow(batches(begin), f"{ids}, {STATE}"), np.zeros((parts, k), dtype=np.int64)
    for r in range(rounds):
        state.mapInArrow(assign(books, moved), f"{ids}, {STATE}").write.parquet(f"{folder}/round-{r}")
        state = spark.read.schema(f"{ids}, {STATE}").parquet(f"{folder}/round-{r}")
        if r:
            delete_folder(spark, f"{folder}/round-{r - 1}")
        new = books.copy()
        for (p, e), s in _sums(state, parts, k).items():
            new[p, e] = s[1:] // s[0]
        moved, books = root_above(((new - books) ** 2).sum(axis=2)), new

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, a, u, low = _unpack(batch, parts)
        _round(x, a, u, low, books, moved)
        error = sum(((x[:, p] - books[p][a[:, p]]) ** 2).sum(axis=1) for p in range(parts))
        code = [bytes(row).hex() for row in a.astype(np.uint8)]
        return pa.RecordBatch.from_arrays([batch.column(key), batch.column(label), pa.array(code), pa.array(error)], [key, label, "code", "error"])

    coded = cut(state.mapInArrow(batches(finish), f"{ids}, code string, error long"))
    delete_folder(spark, folder)
    digest = hashlib.sha256(",".join(str(c) for c in books.reshape(-1)).encode()).hexdigest()
    total = apart(coded.groupBy(F.col(label).alias("_of")).agg(F.sum("error").alias("label_error")))
    return coded.join(total, F.col(label).eqNullSafe(F.col("_of"))).select(key, label, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
