"""Exact duplicates against brute force, over several loads and a load that is run again."""

import hashlib
import random

from lexloom.llm import exact_dedup as X

from .conftest import ODD

SCHEMA = "doc_id long, text string, digest string, tie long, kept int, step int, load string"


def frame_of(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y") for i, t in pairs], SCHEMA)


def brute(pairs):
    """Sorted rows of (doc_id, keep_id, group_size, kept, digest); one row of each group is kept."""
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not done, hashlib.sha256(t.encode()).hexdigest()))
            done |= i == keep
    return sorted(out, key=repr)


def test_equal_texts(spark):
    rng = random.Random(4)
    texts = [*ODD, "a", "A", "a ", " a", "é", "é", "x" * 100_000, "x" * 99_999]
    pairs = [(i, rng.choice(texts)) for i in range(300)] + [(1000 + i, "hot") for i in range(200)]
    pairs += [(7, "a"), (7, "a"), (None, "a"), (None, "only null"), (None, "only null"), (5000, None), (5000, "")]
    rng.shuffle(pairs)
    got = X.exact_duplicates(frame_of(spark, pairs).repartition(5))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(pairs)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table_and_text_ids(spark):
    assert X.exact_duplicates(frame_of(spark, [])).count() == 0
    named = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t"), ("c", None)], "doc_id string, text string")
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in X.exact_duplicates(named).collect()}
    assert got == {("b", "b", True), ("a", "b", False), (None, "b", False), ("c", "c", True)}


def test_index_outlives_its_name_and_loads_again(spark, tmp_path):
    path = f"{tmp_path}/index"
    index = X.DigestIndex(spark, path, buckets=3)
    first = frame_of(spark, [(1, "a"), (2, "a"), (3, "b")])
    one = sorted(map(tuple, X.deduplicate(first, index, "one").select("doc_id", "keep_id", "kept").collect()))
    assert one == [(1, 2, False), (2, 2, True), (3, 3, True)]
    index.close()

    again = X.DigestIndex(spark, path, buckets=99)  # as after a restart: its folder says how many buckets
    assert again.buckets == 3 and again.rows().count() == 2
    assert sorted(map(tuple, X.deduplicate(first, again, "one").select("doc_id", "keep_id", "kept").collect())) == one
    more = X.deduplicate(frame_of(spark, [(9, "b"), (8, "c"), (7, "c")]), again, "two")
    assert sorted(map(tuple, more.select("doc_id", "keep_id", "group_size", "kept").collect())) == [(7, 8, 2, False), (8, 8, 2, True), (9, 3, 1, False)]
    assert sorted(r["keep_id"] for r in again.rows().collect()) == [2, 3, 8]

    new = again.rows().select("digest").limit(1)
    plan = again.unseen(new)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    small = again.compact(f"{tmp_path}/compact")
    assert sorted(map(tuple, small.rows().collect())) == sorted(map(tuple, again.rows().collect()))
    files = spark.read.parquet(f"{tmp_path}/compact/rows").inputFiles()
    assert len(files) <= 3
    small.close()
    again.close()
