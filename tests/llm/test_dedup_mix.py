"""Near duplicates, components and source mixing against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import components as C
from lexloom.llm import minhash as M
from lexloom.llm import mixing as X

from .conftest import ODD


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts, percent):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in texts}


def mutated(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"m{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, frame, percent):
    rng = random.Random(percent)
    texts = list(ODD)
    for _ in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 150, 400]))]
        texts += [mutated(words, rng.randrange(8), rng) for _ in range(25)] + [" ".join(words)] * 3
    docs = frame(texts)
    want = brute(dict(enumerate(texts, 1)), percent)
    rows = M.near_duplicates(docs, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_empty_and_null_ids(spark, frame):
    assert M.near_duplicates(frame(["x"]).where("doc_id < 0")).count() == 0
    docs = frame(["a b c d e f"] * 3).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id")))
    rows = M.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 2), (2, 2), (3, 2)]  # a null id is no name for a group


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(3))
    x, y = (M.signature(np.concatenate(p), 1024) for p in ((a, b), (a, c)))
    assert (x == y).mean() == pytest.approx(1 / 3, abs=0.06)


def test_bands_reach_the_recall():
    for t in (0.8, 0.85):
        b = M.n_bands(t, 6)
        assert (1 - t**6) ** b <= 1e-6 < (1 - t**6) ** (b - 1)


def test_blocks_of_groups(spark):
    """Block comparison finds the same links whatever the size of blocks."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in rng.integers(0, 20, 40)]
    ids = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, shingles binary")
    member = spark.createDataFrame([(i, len(s), 0, i if i % 3 else 0) for i, s in enumerate(sets)], "node long, n long, group long, component long")
    comp = [i if i % 3 else 0 for i in range(40)]
    want = {
        (i, j) for i in range(40) for j in range(i) if comp[i] != comp[j]
        and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))
    }
    for block in (5, 256):
        got = {(max(r["a"], r["b"]), min(r["a"], r["b"])) for r in M._links_in_groups(member, ids, 85, docs_a_block=block).collect()}
        assert got == want


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in C.components(df, "a", "b").collect()}
    linked = {x for p in links if p[0] != p[1] for x in p}
    assert got == {x: find(x) for x in linked}
    assert C.components(df.where("a < 0"), "a", "b").count() == 0


def water(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, fixed, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**{s: float(most * sizes[s]) for s in fixed}, **share}
        for s in over:
            fixed.add(s)
            left -= most * sizes[s]


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choices(["a", "b", "c", "d", None, "é"], [100, 3, 30, 1, 5, 10])[0]) for i in range(2000)]
    rows += [(9000, None, "a"), (9001, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = X.mix_sources(docs).collect()
    again = X.mix_sources(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"] and r["taken"] in (r["epochs"] * r["size"], (r["epochs"] + 1) * r["size"])
    want = water(sizes, X.WEIGHTS, X.MOST)
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)


def test_mixing_of_nothing(spark):
    assert X.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    only = X.mix_sources(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).first()
    assert (only["size"], only["target"], only["taken"]) == (0, 0.0, 0)


def test_likelier_with_quality(spark):
    good, bad = "plain words only " * 10, "a # b | c $ d " * 10
    rows = [(i, good if i % 2 else bad, "a") for i in range(1000)] + [(i, "w " * 3, "b") for i in range(2000, 2100)]
    out = X.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1)).where("source = 'a'")
    rate = {r["odd"]: r["t"] for r in out.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg((F.col("taken") > F.col("epochs") * F.col("size")).cast("int")).alias("t")).collect()}
    assert rate[1] >= rate[0]
