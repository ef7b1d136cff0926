"""Products of packs against the scores that column expressions give."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.operators import nearest
from lexloom.operators.nearest import rounded
from lexloom.operators.retrieval import dot, top_k_each
from lexloom.operators.vector_index import VectorIndex
from lexloom.plans import catalog


def plain(vectors, queries, k):
    pairs = vectors.join(F.broadcast(queries), F.col("vec_id") != F.col("query_id"))
    scored = pairs.select("query_id", "vec_id", "label", F.round(dot("embedding", "q"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


@pytest.mark.parametrize("kind", ["double", "float"])
def test_like_column_expressions(spark, kind):
    """Copies, ties at six digits, nulls, other lengths, values that aren't finite, and large ones."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(300, 8)).tolist() + [rng.normal(size=8).tolist()] * 80 + (rng.integers(-3, 4, size=(60, 8)) / 1024).tolist()
    rows += [None, [1.0, None] + [0.0] * 6, [1.0] * 7, [], [math.nan] * 8, [math.inf] * 8, [-math.inf] + [1.0] * 7, [1e9] * 8, [3e18] * 8]
    table = [(i, None if v is None else list(v), i % 3) for i, v in enumerate(rows)] + [(None, [9.0] * 8, 1), (7, [1.0] * 8, 1)]
    vectors = spark.createDataFrame(table, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    queries = vectors.where("vec_id % 11 = 0 OR vec_id >= 440").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want = sorted(map(repr, plain(vectors, queries, 6).collect()))
    for block in (1000, 90):
        assert sorted(map(repr, top_k_each(vectors, queries, 6, block).collect())) == want
    few = vectors.where("vec_id IN (0, 440, 441, 442, 443)")
    assert sorted(map(repr, top_k_each(few, queries, 6).collect())) == sorted(map(repr, plain(few, queries, 6).collect()))


def test_rounding_is_sparks(spark):
    values = [0.0, -0.0, 0.5e-6, 1.5e-6, 2.5e-6, -0.5e-6, 0.1234565, 0.1234575, 1.0000005, -1.0000015, 1e9 + 0.0000005, 123456789.1234565, 1e300, math.inf, -math.inf, 5e-324]
    values += np.random.default_rng(3).normal(size=500).round(7).tolist()
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6)).collect()]
    assert rounded(np.array(values)).tolist() == want


def test_pairs_do_not_become_rows(spark):
    """Only the best of a pack leave a task, however many queries there are."""
    vectors = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"), F.lit(1).alias("label"))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plan = top_k_each(vectors, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cells_of_a_pack_are_asked_at_once(spark, tmp_path):
    """A query goes out once a pack, not once a cell, and pairs stay in tasks."""
    vectors = spark.range(900).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"), F.lit(1).alias("label"))
    index = VectorIndex.build(vectors, f"{tmp_path}/cells", cells=12)
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = index.search(asked, 5, 12, but_self=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "dynamicpruning" in plan
    assert index._wanted(asked, {0: list(range(12))}, 12, beyond=False).count() == asked.count()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, top_k_each(vectors, asked, 5).select(found.columns).collect()))


def test_hits_of_every_vector(spark, tmp_path):
    """hit_at_k asks for each vector, those whose id isn't divisible by 50 too, and equals its SQL."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist(), int(rng.integers(0, 3))) for i in range(1, 121)] + [(200, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = catalog.hit_at_k(spark, str(tmp_path)).collect()
    assert got[0]["queries"] == 121
    assert [tuple(r) for r in got] == con.sql(catalog.SQL["hit_at_k"]).fetchall()


def test_copies_are_scored_once(spark):
    """Of equal vectors only the first ids can be among the best, so not every pair of copies is scored entry by entry."""
    rng = np.random.default_rng(2)
    one, other = rng.normal(size=(2, 8)).tolist()
    rows = [(i, one if i % 3 else other, i % 2) for i in range(300)] + [(5, one, 7), (5, one, 8)] + [(900 + i, rng.normal(size=8).tolist(), 0) for i in range(9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want = sorted(map(repr, plain(vectors, queries.distinct(), 4).select("query_id", "vec_id", "score", "rank").collect()))
    got = top_k_each(vectors, queries.distinct(), 4, 100).select("query_id", "vec_id", "score", "rank")
    assert sorted(map(repr, got.collect())) == want
    v = np.array([r[1] for r in rows])
    ids = np.array([r[0] for r in rows])
    kept = nearest._needed(v, ids, np.argsort(np.argsort(ids, kind="stable")), np.zeros(len(v), dtype=np.int64), 4)
    assert len(kept) == 5 + 2 + 5 + 9


@pytest.mark.parametrize("n", [1, 3, 7, 39, 40, 83, 1000])
def test_floor_loses_nothing(n):
    """Every one of the k largest of a row is found, whatever groups the columns fall into; NaN is largest."""
    rng = np.random.default_rng(n)
    score = rng.normal(size=(20, n))
    score[3] = 0.5
    score[4, rng.integers(n)] = math.nan
    score[5, : n // 2] = -math.inf
    qi, vi = nearest._at_least_floor(score, np.zeros(20), 5)
    found = set(zip(qi.tolist(), vi.tolist(), strict=True))
    assert len(found) == len(qi)
    for i, row in enumerate(score):
        best = np.sort(row)[-5:]  # NaN last
        assert {(i, j) for j in range(n) if np.isnan(row[j]) or row[j] >= best[0]} <= found
