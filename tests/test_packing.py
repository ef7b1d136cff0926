"""First-fit decreasing against a naive version."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import packing


def naive(items, width):
    """(bin, start) of each (size, key), largest first, in the first bin with room."""
    rooms, out = [], {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        for b, room in enumerate(rooms):
            if room >= size:
                break
        else:
            b = len(rooms)
            rooms.append(width)
        out[key] = (b, width - rooms[b], size)
        rooms[b] -= size
    return out, len(rooms)


@pytest.mark.parametrize("width", [10, 64, 2048])
def test_bins_equal_naive_ones(spark, width):
    rng = random.Random(width)
    sizes = [rng.choice([1, 2, width // 2, width, 3 * width + 1, rng.randrange(1, width + 1), rng.randrange(1, max(2, width // 8))]) for _ in range(400)] + [7] * 200
    docs = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(9000, None, "x"), (9001, 0, "x")], "doc_id long, tokens long, segment string").repartition(3)
    got = {(r["doc_id"], r["segment"]): (r["bin"], r["start"], r["length"]) for r in packing.pack_whole(docs, "doc_id", "tokens", width).collect()}
    items = [(min(width, s - at), (i, at // width)) for i, s in enumerate(sizes) for at in range(0, s, width)]
    want, bins = naive(items, width)
    assert got == want
    assert width == 10 or sum(s for s, _ in items) > 0.95 * bins * width  # of tens, two hundred sevens leave room
    assert packing.pack_whole(docs.limit(0), "doc_id", "tokens", width).count() == 0


def test_sizes_are_counted_once(spark):
    counted = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def size(i):
        counted.add(1)
        return i % 9

    docs = spark.range(100).select(F.col("id").alias("doc_id"), size("id").alias("tokens"))
    assert packing.pack_whole(docs, "doc_id", "tokens", 10).count() == 88
    assert counted.value == 100
