"""Whitening and vector codes against brute force, with odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from lexloom.llm import vector_codes as C
from lexloom.llm import whitening as W
from lexloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, v int, k string, n long, x int, code string"


def rows_of(spark, vectors, first=0, labels=(3, 1, None)):
    rows = [(first + i, v, labels[i % len(labels)], 7, "k", 1, 2, "c") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def random_vectors(n, width, seed, spread=0.2):
    rng = random.Random(seed)
    base = [[float(np.float32(rng.gauss(0, spread))) for _ in range(width)] for _ in range(n)]
    return base


ODD = [None, [], [None, 1.0], [float("nan")] * 16, [float("inf")] + [0.0] * 15, [0.5] * 15 + [None]]


def lloyd(vectors, labels, parts=8, entries=16, rounds=6):
    """Plain rounds over all distances."""
    x = [[math.floor(4096 * c) for c in v] for v in vectors]
    s = len(x[0]) // parts
    cut = [[row[p * s : (p + 1) * s] for p in range(parts)] for row in x]
    books = [[row[p] for row in cut[:entries]] for p in range(parts)]

    def near(p, y):
        return min((sum((a - b) ** 2 for a, b in zip(y, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        members = [[[] for _ in books[p]] for p in range(parts)]
        for row in cut:
            for p in range(parts):
                members[p][near(p, row[p])[1]].append(row[p])
        books = [[[sum(c) // len(m) for c in zip(*m, strict=True)] if m else books[p][e] for e, m in enumerate(members[p])] for p in range(parts)]
    found = [[near(p, row[p]) for p in range(parts)] for row in cut]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for e, label in zip(error, labels, strict=True):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [("".join(f"{e:02x}" for _, e in f), e, total[label], digest) for f, e, label in zip(found, error, labels, strict=True)]


@pytest.mark.parametrize("case", ["many", "few", "equal", "lattice"])
def test_codes_equal_plain_rounds(spark, case):
    """lattice: small whole numbers, where many entries are at the same distance and others coincide."""
    rng = random.Random(5)
    vectors = {
        "many": random_vectors(300, 16, 1),
        "few": random_vectors(5, 16, 2),
        "equal": [[0.25] * 16] * 40 + random_vectors(30, 16, 3) + [[0.25] * 16] * 40,
        "lattice": [[rng.randrange(-3, 4) / 4096 for _ in range(16)] for _ in range(400)],
    }[case]
    labels = [(3, 1, None)[i % 3] for i in range(len(vectors))]
    got = C.encode(rows_of(spark, vectors).union(rows_of(spark, ODD, first=1000)).repartition(3))
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted(got.collect())
    assert [tuple(r)[2:] for r in got] == lloyd(vectors, labels)
    assert [r["vec_id"] for r in got] == list(range(len(vectors)))


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(3)
    x = rng.integers(-900, 900, (2000, 8)) + 5000 * rng.integers(0, 8, (2000, 1))
    book = x[:16].copy()
    a, u, low = np.zeros(2000, int), np.full(2000, C.FAR), np.zeros((2000, 16), int)
    measured = []
    for _ in range(6):
        measured.append(C.reassign(x, a, u, low, book))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (a == d.argmin(axis=1)).all() and (u * u >= d[np.arange(2000), a]).all() and (low * low <= d).all()
        new = np.array([x[a == e].sum(axis=0) // (a == e).sum() if (a == e).any() else book[e] for e in range(16)])
        move = C.root_above(((new - book) ** 2).sum(axis=1))
        book, u, low = new, u + move[a], np.maximum(low - move, 0)
    assert sum(measured[1:]) < 0.5 * 5 * 2000 * 16


def test_roots_are_exact():
    d = np.array([0, 1, 2, 3, 4, 2**52 - 1, (2**30) ** 2, (2**30) ** 2 - 1, (2**30) ** 2 + 1, (3037000000) ** 2 - 1])
    assert C.root_below(d).tolist() == [math.isqrt(int(y)) for y in d]
    assert C.root_above(d).tolist() == [math.isqrt(int(y) - 1) + 1 if y else 0 for y in d]


def test_codes_of_odd_tables(spark):
    assert C.encode(rows_of(spark, ODD)).count() == 0
    with pytest.raises(ValueError, match="as many"):
        C.encode(rows_of(spark, [[1.0] * 8, [1.0] * 16]))
    with pytest.raises(ValueError, match="divide"):
        C.encode(rows_of(spark, [[1.0] * 12]))
    with pytest.raises(ValueError, match="exact"):
        C.encode(rows_of(spark, [[5000.0] * 8]))
    repeated = spark.createDataFrame([(k, [k and len(k) / 8.0 or 0.5] * 8, "a") for k in [None, "aa", "aa", "b", None]], "vec_id string, embedding array<double>, label string")
    got = C.encode(repeated).collect()
    assert len(got) == 5 and all(r["error"] == 0 and r["label_error"] == 0 for r in got)


def test_whitening_equals_exact_covariance(spark):
    vectors = random_vectors(200, 12, 7)
    for v in vectors:
        v[3] = 0.5 * v[0] + 0.1 * v[3]
    got = W.whiten(rows_of(spark, vectors).union(rows_of(spark, ODD, first=1000)).repartition(3))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = [[n * c - t for c, t in zip(row, s, strict=True)] for row in x]  # whole numbers of any size
    v = np.array([[sum(r[i] * r[j] for r in d) / n**3 for j in range(12)] for i in range(12)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    assert len(got) == 200 * 8 and {r["n"] for r in got} == {n}
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: sum(c * c for c in row) for i, row in enumerate(d)}
    table = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(8):
        want = np.array(d) / n @ q[:, c] / math.sqrt(e[c])
        have = np.array([table[i, c + 1]["whitened"] for i in range(n)])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        assert abs(table[0, c + 1]["explained"] / (e[c] / np.trace(v)) - 1) < 1e-10
    white = np.array([[table[i, c + 1]["whitened"] for c in range(8)] for i in range(n)])
    white -= white.mean(axis=0)
    assert got[0]["identity_error"] < 1e-9 and np.abs(white.T @ white / n - np.eye(8)).max() < 1e-9


def test_whitening_of_odd_tables(spark):
    assert W.whiten(rows_of(spark, ODD)).count() == 0
    alone = W.whiten(rows_of(spark, [[0.5, 0.25]] * 3)).collect()
    assert len(alone) == 6 and all(r["whitened"] == r["explained"] == r["identity_error"] == 0 and r["deviation"] == 0 for r in alone)
    flat = W.whiten(rows_of(spark, [[float(i), 1.0, 2.0 * i] for i in range(5)])).collect()  # one direction varies
    assert {r["component"] for r in flat if r["whitened"]} == {1} and all(r["identity_error"] < 1e-9 for r in flat)
    keyed = spark.createDataFrame([(None, [1.0, 0.0]), (2**60 + 1, [0.0, 1.0]), (2**60 + 1, [0.5, 3.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"] or 0) for r in W.whiten(keyed).collect()) == [0, 0] + [2**60 + 1] * 4
    assert W.squares(np.array([[2**33, 1], [3, 4]])) == [None, 25]
    with pytest.raises(ValueError, match="as many"):
        W.whiten(rows_of(spark, [[1.0], [1.0, 2.0]]))


def test_queries_read_whole_tables(spark, tmp_path):
    vectors = random_vectors(120, 16, 9)
    rows_of(spark, vectors).write.parquet(f"{tmp_path}/embeddings.parquet")
    labels = [(3, 1, None)[i % 3] for i in range(120)]
    got = sorted(QUERIES["op12_vector_codes"](spark, str(tmp_path)).collect())
    assert [tuple(r) for r in got] == [(i, *w) for i, w in enumerate(lloyd(vectors, labels))]
    white = QUERIES["op11_whitening"](spark, str(tmp_path))
    assert white.count() == 120 * 8 and dict(white.dtypes)["component"] == "int" and dict(white.dtypes)["n"] == "bigint"
