"""Benchmark items that are much longer than most."""

import random

import numpy as np

from lexloom.llm import decontaminate as D


def prose(r, size):
    text = ""
    while len(text) < size:
        text += " " * bool(text) + "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    return text


def parts(items):
    return [D.parts_of(i, x, 0.1) for i, (_, x) in enumerate(items)]


def test_parts_cover_an_item():
    r = random.Random(1)
    for size in (1, 9, 10, 59, 60, 95, 130, 1000, 4999):
        x = prose(r, size)[:size]
        found = D.parts_of(0, x, 0.1)
        assert "".join(p.text for p in found) == x and sum(p.edits + 1 for p in found) == D.allowed(len(x), 0.1) + 1
        assert all(p.text == "".join(piece for _, piece in p.pieces) and x[p.offset :].startswith(p.text) for p in found)


def test_long_items_at_the_full_edit_limit():
    rng, r = np.random.default_rng(12), random.Random(12)
    items = [(i, prose(r, size)) for i, size in enumerate([90] * 60 + [1000, 1500, 2000, 3000] * 5)]
    texts = [f"{prose(r, 300)} {D._mutate(x, D.allowed(len(x), 0.1), rng)} {prose(r, 500)}" for _, x in items[60:]]
    near = {(d, i) for d, t in enumerate(texts) for i, x in items if D.infix_distance(x, t)[0] <= D.allowed(len(x), 0.1)}
    assert len(near) == len(texts)
    search = D.Searcher(items, 0.1, D.plan_tables(parts(items), 0.1, 0.99))
    assert all(search.plan.values())
    found = {(d, h[0]): h[1:] for d, hits in enumerate(search.find(texts)) for h in hits}
    assert set(found) == near
    for (d, i), (start, length, distance) in found.items():
        whole = D.infix_distance(items[i][1], texts[d])[0]
        assert distance == whole == D.infix_distance(items[i][1], texts[d][start : start + length])[0]


def test_class_tables_meet_the_recall_or_are_left_out():
    r = random.Random(3)
    items = [(i, prose(r, size)) for i, size in enumerate([20] * 60 + [2000] * 3)]
    plan = D.plan_tables(parts(items), 0.1, 0.99)
    assert all(plan.values())
    none = D.plan_tables(parts(items), 0.1, 1.01)
    assert set(none.values()) == {None}
    search = D.Searcher(items, 0.1, none)  # all windows are confirmed then
    text = f"{prose(r, 200)} {D._mutate(items[61][1], 150, np.random.default_rng(2))} {items[5][1]}"
    assert {h[0] for h in search.find([text])[0]} == {61, 5}


def test_benchmark_is_hashed(spark):
    for sf in ("sf0.01", "sf0.1"):
        assert D.hashed_share(spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet")) >= 0.9
    assert D.hashed_share(spark.createDataFrame([], "item_id int, text string")) == 1.0


def test_tables_alone_find_nearly_all():
    """Items with all their edits, through hashed windows only."""
    rng, r = np.random.default_rng(8), random.Random(8)
    items = [(i, prose(r, r.randrange(40, 800))) for i in range(300)]
    plan = D.plan_tables(parts(items), 0.1, 0.99)
    assert all(plan.values())
    texts = [f"{prose(r, 200)} {D._mutate(x, D.allowed(len(x), 0.1), rng)} {prose(r, 300)}" for _, x in items]
    found = D.Searcher(items, 0.1, plan).find(texts)
    near = [i for i, x in items if D.infix_distance(x, texts[i])[0] <= D.allowed(len(x), 0.1)]
    assert sum(any(h[0] == i for h in found[i]) for i in near) >= 0.99 * len(near)
