"""Vectors and queries that meet in packs: products of whole matrices in tasks, and exact scores of what may be among the best."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

#: Vectors in a pack, and queries that meet them at a time.
PACK = 20_000


def plain(name: str, df: DataFrame):  # noqa: ANN201
    """The vectors of a column in an element type that numpy takes as it is."""
    own = df.schema[name].dataType.elementType
    return F.col(name) if isinstance(own, (FloatType, DoubleType)) else F.col(name).cast("array<double>")


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits as Spark's round has it: halves of the shortest decimal go away from zero."""
    with np.errstate(all="ignore"):
        m = np.abs(x) * 1e6
        whole = np.floor(m)
        out = np.copysign((whole + (m - whole >= 0.5)) / 1e6, x)
        unsure = (np.abs(m - whole - 0.5) < 1e-9 + m * 1e-15) | (m >= 2.0**50)
    out = np.where(np.isfinite(x), out, x)
    for v in np.unique(x[unsure & np.isfinite(x)]):
        with localcontext() as c:
            c.prec = 400
            out[x == v] = float(Decimal(repr(float(v))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    return out + 0.0


def _lengths(col: pa.ListArray) -> np.ndarray:
    """Of every vector; -1 for null and for those with a null in them."""
    found = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if col.flatten().null_count:
        found[np.unique(pc.list_parent_indices(col).filter(pc.is_null(col.flatten())).to_numpy())] = -1
    return found


def _matrix(col: pa.ListArray, rows: np.ndarray, size: int) -> np.ndarray:
    if not size:
        return np.zeros((len(rows), 0))
    return col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)


def _one(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _needed(v: np.ndarray, ids: np.ndarray, place: np.ndarray, cell: np.ndarray, k: int) -> np.ndarray:
    """Without copies that can't be among a query's k best: of equal vectors in a cell, those of the first k + 1 ids (one may be its own)."""
    if len(v) < 2:
        return np.arange(len(v))
    with np.errstate(all="ignore"):
        order = np.lexsort((place, v @ np.random.default_rng(0).normal(size=v.shape[1]), cell))
    first = np.ones(len(v), dtype=bool)
    first[1:] = (v[order[1:]] != v[order[:-1]]).any(axis=1) | (cell[order[1:]] != cell[order[:-1]])
    other = first.copy()
    other[1:] |= ids[order[1:]] != ids[order[:-1]]
    nth = np.cumsum(other)
    return np.sort(order[nth - nth[first][np.cumsum(first) - 1] <= k])


def _at_least_floor(score: np.ndarray, slack: np.ndarray, k: int, group: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what may be among the k largest of a row, give or take slack; NaN counts as largest.

    The k-th largest of the maxima of groups of columns is no more than the k-th largest entry, and takes one pass.
    """
    n = score.shape[1]
    size = max(1, min(group, n // (4 * k)))
    groups = n // size
    whole = score[:, : groups * size].reshape(len(score), size, groups)  # what is left over are groups of one
    top = np.concatenate([whole.max(axis=1), score[:, groups * size :]], axis=1)
    floor = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k] if top.shape[1] > k else np.full(len(top), -np.inf)
    low = (floor - slack)[:, None]
    qi, g = np.nonzero(~(top < low))
    alone = g >= groups
    a, j = np.nonzero(~(whole[qi[~alone], :, g[~alone]] < low[qi[~alone]]))
    return np.concatenate([qi[~alone][a], qi[alone]]), np.concatenate([j * groups + g[~alone][a], g[alone] + groups * (size - 1)])


def best_pairs(vectors: pa.Table, queries: pa.Table, k: int, but_self: bool, step: int = 256) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Query row, vector row and score (not rounded) of each query's k best by rounded score and vec_id.

    vectors has vec_id, embedding and, where queries list ``cells``, cell. Products in any order tell what may be among
    the k best; their scores are summed entry by entry, as the column expression does. A null entry, or another number of
    them, makes the score null, and null scores come last.
    """
    vec, q = _one(vectors["embedding"]), _one(queries["q"])
    ids, asked = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy()
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[by_id] = np.arange(len(ids))
    low, high = (np.searchsorted(ids, asked, side, sorter=by_id) for side in ("left", "right"))
    own = "cells" in queries.column_names
    cell = vectors["cell"].to_numpy() if own else np.zeros(len(ids), dtype=np.int64)
    names = np.unique(cell)
    which = np.searchsorted(names, cell)
    open_to = np.ones((len(asked), len(names)), dtype=bool)
    if own and len(names):
        listed = _one(queries["cells"])
        wanted, of = listed.flatten().to_numpy(), pc.list_parent_indices(listed).to_numpy()
        there = np.isin(wanted, names)
        open_to[:] = False
        open_to[of[there], np.searchsorted(names, wanted[there])] = True
    v_size, q_size = _lengths(vec), _lengths(q)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(qi: np.ndarray, vi: np.ndarray, score: np.ndarray, known: np.ndarray) -> None:
        """The k best of pairs that hold all of their queries' candidates."""
        value = np.where(known, rounded(np.where(known, score, 0.0)), 0.0)
        high_first = np.where(np.isnan(value), 0.0, -value)
        order = np.lexsort((place[vi], high_first, ~np.isnan(value), ~known, qi))
        qi = qi[order]
        first = np.searchsorted(qi, qi, "left")
        best = order[np.arange(len(qi)) - first < k]
        found.append((qi[np.arange(len(qi)) - first < k], vi[best], score[best], known[best]))

    for size in np.unique(q_size):
        rows = np.flatnonzero(v_size == size) if size >= 0 else np.empty(0, dtype=np.int64)
        rows = rows[np.argsort(which[rows], kind="stable")]
        others = by_id[~np.isin(by_id, rows)]
        v = _matrix(vec, rows, max(size, 0))
        with np.errstate(all="ignore"):
            norm = np.sqrt((v * v).sum(axis=1))
        finite = np.flatnonzero(np.isfinite(norm))
        odd = np.flatnonzero(~np.isfinite(norm))  # these meet every query entry by entry
        finite = finite[_needed(v[finite], ids[rows[finite]], place[rows[finite]], which[rows[finite]], k)]
        longest = norm[finite].max(initial=0.0)
        even = bool(len(finite)) and longest <= 10 * np.median(norm[finite])  # or single precision would tell too few apart
        edges = np.searchsorted(which[rows[finite]], np.arange(len(names) + 1))
        at = np.full(len(ids), -1)
        at[rows[finite]] = np.arange(len(finite))
        v_as = {np.float64: v[finite]}
        of_size = np.flatnonzero(q_size == size)
        for start in range(0, len(of_size), step):
            some = of_size[start : start + step]
            m = _matrix(q, some, max(size, 0))
            with np.errstate(all="ignore"):
                m_norm = np.sqrt((m * m).sum(axis=1))
                kind = np.float32 if even and max(longest, 1.0) * m_norm.max(initial=1.0) < 1e30 else np.float64  # NaN: float64
                if kind not in v_as:
                    v_as[kind] = v_as[np.float64].astype(kind)
                vs, ms = v_as[kind], m.astype(kind)
                if len(names) == 1 and open_to[some, 0].all():
                    score = ms @ vs.T
                else:
                    score = np.full((len(some), len(vs)), -np.inf, dtype=kind)
                    for c in range(len(names)):
                        lo, hi, ask = edges[c], edges[c + 1], np.flatnonzero(open_to[some, c])
                        if hi > lo and len(ask):
                            score[ask, lo:hi] = ms[ask] @ vs[lo:hi].T
                if but_self:
                    for i in np.flatnonzero(high[some] > low[some]):
                        mine = at[by_id[low[some[i]] : high[some[i]]]]
                        score[i, mine[mine >= 0]] = -np.inf
                slack = 2e-6 + 8 * (max(size, 0) + 1) * float(np.finfo(kind).eps) * m_norm * longest
                qi, vi = _at_least_floor(score, slack, k)
            qi = np.concatenate([qi, np.repeat(np.arange(len(some)), len(odd))])
            vi = np.concatenate([finite[vi], np.tile(odd, len(some))])
            good = open_to[some[qi], which[rows[vi]]] & ~(but_self & (ids[rows[vi]] == asked[some[qi]]))
            qi, vi = qi[good], vi[good]
            exact = np.zeros(len(qi))
            for lo in range(0, len(qi), 1 << 20):
                part = slice(lo, lo + (1 << 20))
                with np.errstate(all="ignore"):
                    for d in range(max(size, 0)):
                        exact[part] += m[qi[part], d] * v[vi[part], d]
            n_good = np.bincount(qi, minlength=len(some))
            extra_q, extra_v = [], []
            for i in np.flatnonzero(n_good < k) if len(others) else ():  # null scores fill what is left
                mine = others[open_to[some[i], which[others]]]
                mine = mine[ids[mine] != asked[some[i]]][:k] if but_self else mine[:k]
                extra_q += [i] * len(mine)
                extra_v.append(mine)
            more = np.concatenate(extra_v) if extra_v else np.empty(0, dtype=np.int64)
            keep(
                some[np.concatenate([qi, np.array(extra_q, dtype=np.int64)])], np.concatenate([rows[vi], more]),
                np.concatenate([exact, np.zeros(len(more))]), np.arange(len(qi) + len(more)) < len(qi),
            )
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), pa.array([], pa.float64())
    qi, vi, score, known = (np.concatenate(x) for x in zip(*found, strict=True))
    return qi, vi, pa.array(score, mask=~known)


def meet(vectors: DataFrame, queries: DataFrame, n_queries: int, k: int, but_self: bool) -> DataFrame:
    """query_id, the vectors' columns but embedding and cell, and score: each query's k best of every pack it is sent to.

    Both tables have a column _pack; queries (query_id, q) may list the ``cells`` they may take from. A task holds a pack
    and a block of queries; every pack goes to each block, so that what is shuffled grows with rows times queries over PACK.
    """
    blocks = max(1, math.ceil(n_queries / PACK))
    rows = vectors.where("vec_id IS NOT NULL") if but_self else vectors
    rows = rows.withColumn("embedding", plain("embedding", rows)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.where("query_id IS NOT NULL") if but_self else queries
    asked = asked.withColumn("q", plain("q", asked)).withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    names = [c for c in vectors.columns if c not in ("embedding", "cell", "_pack")]
    schema = StructType([queries.schema["query_id"], *(vectors.schema[c] for c in names), StructField("score", DoubleType())])
    return rows.groupBy("_pack", "_block").cogroup(asked.groupBy("_pack", "_block")).applyInArrow(_task(names, k, but_self), schema).withColumn("score", F.round("score", 6))


def _task(names: list[str], k: int, but_self: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        qi, vi, score = best_pairs(rows, asked, k, but_self)
        taken = rows.select(names).take(pa.array(vi))
        return pa.table([asked["query_id"].take(pa.array(qi)), *taken.columns, score], names=["query_id", *names, "score"])

    return run
