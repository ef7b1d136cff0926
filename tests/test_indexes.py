"""Vector cells, postings, fusion and collections against brute force."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.operators import keyword_search
from lexloom.operators.keyword_search import B, K1, KeywordIndex, fuse, terms
from lexloom.operators.ordinals import numbered
from lexloom.operators.vector_index import VectorIndex
from lexloom.plans import catalog, indexes  # noqa: F401  registers its queries
from lexloom.sources.collections import IndexedCollection, KeyedCollection
from lexloom.sources.scratch import shared_folder


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, one vector in a third of all rows, ties, and one that is no unit vector."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(centres[i % 12] + 0.15 * rng.normal(size=16)).tolist() for i in range(600)] + [centres[0].tolist()] * 300 + [(5 * centres[1]).tolist()]
    return rows, spark.createDataFrame([(i, v, i % 7) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int").repartition(3)


def nearest(rows, i, k):
    scored = sorted((-round(float(np.dot(rows[i], v)), 6), j) for j, v in enumerate(rows) if j != i)
    return [j for _, j in scored[:k]]


def test_cells(spark, vectors, tmp_path):
    rows, df = vectors
    index = VectorIndex.build(df, f"{tmp_path}/cells", cells=20, rows_a_slice=50)
    assert index.rows().count() == len(rows) and index.cells().agg(F.sum("rows")).first()[0] == len(rows)
    assert index.cells().agg(F.max("slices")).first()[0] > 3  # the common vector's cell is dealt out
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    true = {i: nearest(rows, i, 5) for i in range(0, len(rows), 50)}

    exact = index.search_exact(asked, 5, 2, but_self=True).collect()
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in exact} == {(i, n): j for i, found in true.items() for n, j in enumerate(found, 1)}

    probes = index.needed_probes(5, recall=0.95)
    assert probes < 12
    found = index.search(asked, 5, probes, but_self=True)
    scores = {(r["query_id"], r["rank"]): r["score"] for r in found.collect()}
    best = {(i, n): round(float(np.dot(rows[i], rows[j])), 6) for i, js in true.items() for n, j in enumerate(js, 1)}
    assert sum(abs(scores.get(at, -1e9) - s) < 2e-6 for at, s in best.items()) >= 0.9 * len(best)

    kept = index.search_exact(asked, 3, 1, keep=F.col("label") == 2)
    assert {r["label"] for r in kept.collect()} == {2}


def test_search_reads_few_folders(spark, vectors, tmp_path):
    _, df = vectors
    index = VectorIndex.build(df, f"{tmp_path}/cells", cells=20)
    one = df.where("vec_id = 7").select(F.lit(1).alias("query_id"), F.col("embedding").alias("q"))
    found = index.search(one, 3, 2)
    found.collect()
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    index = VectorIndex.build(none, f"{tmp_path}/none")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, q array<double>")
    assert index.search(asked, 3, 2).count() == index.search_exact(asked, 3, 2).count() == 0 and index.needed_probes(3) == 1


def brute_bm25(texts, query, k):
    split = [__import__("re").findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    mean = sum(map(len, split)) / len(split)
    out = []
    for i, w in enumerate(split):
        score = 0.0
        for t in set(query):
            df, tf = sum(t in x for x in split), w.count(t)
            if tf:
                score += math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
        if score:
            out.append((-round(score, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def test_keyword_search_is_exact(spark, tmp_path):
    rng = random.Random(2)
    common = ["the", "of", "and"]
    rare = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.7 else rare[int(rng.random() ** 2 * 80)] for _ in range(rng.randrange(3, 60))) for _ in range(200)]
    texts += [None, "", "!?", "the the the", "Éclair the ÉCLAIR", "the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    index = KeywordIndex.build(df, f"{tmp_path}/postings", folders=5)
    queries = [["the", "w79", "w3"], ["the", "of"], ["éclair", "the", "the"], ["nowhere"], [], ["w70", "w71", "w72", "the", "and"], ["the"]]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, terms array<string>")
    for lead in (1, 2):
        got = {}
        for r in sorted(index.search(asked, 5, lead).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        for q, words in enumerate(queries):
            want = brute_bm25(texts, words, 5)
            assert [d for d, _ in got.get(q, [])] == [d for d, _ in want]
            assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got.get(q, []), want, strict=True))
    assert index.search(asked, 5, but_self=True).where("doc_id = query_id").count() == 0
    own = {r["query_id"]: r["terms"] for r in index.telling_terms(df.where("doc_id = 204"), 2).collect()}
    assert own == {204: ["the", "éclair"]}
    assert df.select(terms(F.col("text")).alias("t")).where("doc_id = 202").first()["t"] == []


def test_keyword_blocks_equal_brute_force(spark, tmp_path, monkeypatch):
    """Many blocks, packs and passes of queries, copies that tie, and ids that come twice, which count as one document where their lengths are equal."""
    rng = random.Random(5)
    texts = [" ".join(f"t{int(rng.random() ** 3 * 40)}" for _ in range(rng.randrange(1, 30))) for _ in range(150)] + ["t1 t2 t3 t3"] * 60 + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for name, value in {"SLICE": 200, "CELLS": 300, "GAINS": 50, "PACK": 4}.items():
        monkeypatch.setattr(keyword_search, name, value)
    index = KeywordIndex.build(df, f"{tmp_path}/blocks", folders=3)
    assert index.postings().count() == sum(len(set((t or "").split())) for t in texts)  # a term and document once
    queries = [[f"t{rng.randrange(45)}" for _ in range(rng.randrange(0, 6))] for _ in range(20)] + [["t1", "t2", "t3"]]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, terms array<string>")
    found = index.search(asked, 7, blocks=9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # queries meet blocks, not every posting in a row of its own
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for q, words in enumerate(queries):
        assert [(d, pytest.approx(s, abs=2e-6)) for d, s in brute_bm25(texts, words, 7)] == got.get(q, [])
    table = np.arange(4)
    rows = pa.table({"doc_id": table, "number": table * 0, "gain": [1.0, 2.0, 2.0, 0.5]})
    which, docs, scores = keyword_search.best_documents(rows, pa.table({"query_id": [7, 1], "number": [0, 0], "_self": [9, 1]}), 2, True)
    assert sorted(zip(which.tolist(), docs.to_pylist(), scores.tolist(), strict=True)) == [(0, 1, 2.0), (0, 2, 2.0), (1, 0, 1.0), (1, 2, 2.0)]
    same = KeywordIndex.build(spark.createDataFrame([(1, "a b"), (1, "a c"), (1, "a"), (2, "a")], "doc_id long, text string"), f"{tmp_path}/same")
    assert sorted((r["term"], r["doc_id"], r["length"], r["tf"]) for r in same.postings().collect()) == [("a", 1, 1, 1), ("a", 1, 2, 2), ("a", 2, 1, 1), ("b", 1, 2, 1), ("c", 1, 2, 1)]


def test_counts_by_bytes(spark, tmp_path):
    """Terms end with their text, whatever the next one begins with; counts of a term come with its row, so that totals read no arrays."""
    rng = random.Random(8)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("az9 .-é😀\n") for _ in range(rng.randrange(7))) for _ in range(300)] + ["", "a", "a", ""]
    rows, whole = pa.record_batch({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string())}), []
    for at in (0, 150):
        for found in keyword_search._counted(iter([rows.slice(at, 150 if not at else None)])):
            whole += [(t, d, n, c) for t, ds, ns, cs in zip(*(found[c].to_pylist() for c in ("term", "doc_id", "length", "tf")), strict=True) for d, n, c in zip(ds, ns, cs, strict=True)]
            assert [(n, w) for n, w in zip(found["df"].to_pylist(), found["words"].to_pylist(), strict=True)] == [(len(x), sum(x)) for x in found["tf"].to_pylist()]
    split = [__import__("re").findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "") for t in texts]
    assert sorted(whole) == sorted((t, i, len(w), w.count(t)) for i, w in enumerate(split) for t in set(w))
    index = KeywordIndex.build(spark.createDataFrame([(1, "a b b"), (2, "a"), (2, "c c")], "doc_id long, text string"), f"{tmp_path}/counts")
    assert sorted((r["term"], r["df"], r["words"]) for r in spark.read.parquet(f"{index.path}/terms").collect()) == [("a", 2, 2), ("b", 1, 2), ("c", 1, 2)]


def test_postings_of_one_folder(spark, tmp_path):
    """They are written where they are counted and found as those of many folders; a table without rows, from which no folder comes, is searched too."""
    df = spark.createDataFrame([(1, "a b b"), (2, "a"), (2, "c c"), (3, None)], "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame([(1, ["a", "b", "d"]), (2, ["c"])], "query_id long, terms array<string>")
    one, many = (KeywordIndex.build(df, f"{tmp_path}/{n}", folders=n) for n in (1, 7))
    assert os.listdir(f"{one.path}/postings") == ["folder=0"]
    for get in (lambda x: x.postings().drop("folder"), lambda x: x.search(asked, 2), lambda x: x.telling_terms(df, 1)):
        assert sorted(map(tuple, get(one).collect())) == sorted(map(tuple, get(many).collect())) != []
    none = KeywordIndex.build(df.limit(0), f"{tmp_path}/none", folders=1)
    assert none.search(asked, 2).count() == none.telling_terms(df, 1).count() == 0


def test_hybrid_of_null_vectors(spark, tmp_path):
    """A vector that is null is asked for too, and its scores are null, as the SQL of hybrid_search has it."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(4)
    words = [" ".join(f"w{int(x)}" for x in rng.integers(0, 40, 12)) for _ in range(120)]
    spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, None if i in (50, 7) else rng.normal(size=8).tolist(), i % 3) for i in range(110)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.execute(catalog.SQL["hybrid_search"]).fetchall()
    assert {r[0] for r in want} == {0, 50, 100} and sorted(want) == sorted(tuple(r) for r in catalog.QUERIES["hybrid_search"](spark, str(tmp_path)).collect())


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, doc string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2), (2, "x", 1)], "query_id int, doc string, rank int")
    got = [(r["query_id"], r["doc"], r["score"]) for r in fuse(a, b, "doc", 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, "y", round(1 / 62 + 1 / 61, 6)), (1, "x", round(1 / 61, 6)), (1, "z", round(1 / 62, 6)), (2, "x", round(1 / 61, 6))]


def test_upsert_leaves_each_key_once(spark, tmp_path):
    path = f"{tmp_path}/rows"
    chunks = KeyedCollection(spark, path, "id", folders=8)
    first = spark.createDataFrame([(f"c{i}", i, "old") for i in range(100)] + [(None, 5, "old")], "id string, at long, text string")
    chunks.upsert(first)
    chunks.upsert(first)  # run again
    assert sorted(map(repr, chunks.rows().collect())) == sorted(map(repr, first.collect()))
    before = {f for f in spark.read.parquet(path).inputFiles()}
    chunks.upsert(spark.createDataFrame([("c7", 7, "new"), ("c7", 8, "newer"), ("new", 1, "added"), (None, 9, "new")], "id string, at long, text string"), latest="at")
    rows = {r["id"]: (r["at"], r["text"]) for r in chunks.rows().collect()}
    assert chunks.rows().count() == 102 == len(rows)
    assert rows["c7"] == (8, "newer") and rows["new"] == (1, "added") and rows[None] == (9, "new") and rows["c8"] == (8, "old")
    after = {f for f in spark.read.parquet(path).inputFiles()}
    assert len(before & after) >= 5  # three folders of eight were touched at most


def test_upsert_writes_rows_once(spark, tmp_path):
    """Distinct keys over an empty collection, in place of all that is there, and in place of some: rows go right to their folders, beside which only keys are written."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(f"k{i}", rng.bytes(3000)) for i in range(300)], "id string, data binary").repartition(3)
    rows.write.parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in")
    kept = KeyedCollection(spark, f"{tmp_path}/rows", "id", folders=4)
    beside = os.path.dirname(shared_folder(spark, "x")).removeprefix("file:")

    def held():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(beside) for f in names)

    before = held()
    for some in (rows, rows, rows.where("id < 'k2'"), rows.where("id = 'nowhere'")):
        kept.upsert(some)
        assert sorted(map(repr, kept.rows().collect())) == sorted(map(repr, rows.collect()))
    assert held() - before < 100_000  # of 900,000 bytes a time


def test_postings_spare_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, i // 10, [f"r{i // 20}", f"s{i % 3}"]) for i in range(200)] + [(200, 0, None), (201, 0, [])], "id long, volume int, refs array<string>")
    books = IndexedCollection.write(rows, f"{tmp_path}/books", ["refs", "volume"], ["volume", "id"], parts=10)
    found = books.having("refs", ["r2", "r7"])
    assert sorted(r["id"] for r in found.collect()) == [*range(40, 60), *range(140, 160)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert books.postings().where("field = 'refs' AND value IN ('r2', 'r7')").select("part").distinct().count() <= 4
    assert sorted(r["id"] for r in books.having("volume", [3]).collect()) == list(range(30, 40))
    assert books.having("refs", ["none"]).count() == 0 and books.having("refs", ["s1"]).count() == 67


def test_numbers_run_over_ranges(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(500)], "k int, id int").repartition(5)
    got = sorted((r["place"], r["k"]) for r in numbered(df, "k", rows_a_range=50).collect())
    assert [p for p, _ in got] == list(range(500)) and [k for _, k in got] == sorted(i % 3 for i in range(500))
    assert numbered(df.limit(0), "k").count() == 0
