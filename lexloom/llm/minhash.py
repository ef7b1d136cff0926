"""Near duplicates by circulant MinHash, banding and exact Jaccard similarity.

A first permutation places every shingle in a ring of 2**20 places; a second one,
shifted by one place for each coordinate, gives all coordinates of the signature: a
shingle's values are a run of neighbours in one table. Documents that agree in all
coordinates of a band are candidates, and links are confirmed on whole shingle sets.

Groups of copies are never expanded into pairs. Rows with equal sets form a class and
stand as one. In a band's bucket each class is compared with a pivot. A bucket whose
other classes then still lie in different components is compared in whole, in blocks
of bounded size, once for all buckets with the same members.

Null and blank texts have an empty set and link with nothing; a text of fewer words
than a shingle is one shingle. Links are found between rows, so null and repeated ids
do no harm: a group's id is the least id in it, null if it has none. Every row gives a
row. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, cut, row_key
from .components import components

RING_BITS = 20
#: Odd multipliers of the hashes, from one seed.
_ODD = np.random.default_rng(20240229).integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[10]
    x = (x ^ (x >> np.uint64(29))) * _ODD[11]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text, A-Z lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    if len(h) < size:
        return _mix((h * _ODD[: len(h)]).sum(keepdims=True) + _ODD[20] * np.uint64(len(h)))
    total = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        total += h[j : len(h) - size + 1 + j] * _ODD[j]
    return np.unique(_mix(total))


@lru_cache(maxsize=2)
def _ring(width: int) -> np.ndarray:
    """Row i holds the values of coordinates 0, 1, ... for place i: the second permutation, shifted."""
    table = np.random.default_rng(7).permutation(1 << RING_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[: width - 1]]), width)


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    place = ((shingles * _ODD[30]) >> np.uint64(64 - RING_BITS)).astype(np.int64)
    ring, least = _ring(width), np.full(width, 1 << RING_BITS, np.uint32)
    for at in range(0, len(place), 512):
        np.minimum(least, ring[place[at : at + 512]].min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    value = (sig.reshape(bands, rows).astype(np.uint64) * _ODD[40 : 40 + rows]).sum(axis=1)
    return _mix(value + np.arange(1, bands + 1, dtype=np.uint64) * _ODD[50]).view(np.int64)


def n_bands(threshold: float, rows: int, miss: float = 1e-6) -> int:
    """Bands with which a pair at the threshold is missed no oftener than this."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, the row key (r1, r2), n, two words that identify the set, and the band keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, keys = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), size)
                one, two = set_key(s)
                n.append(len(s))
                k1.append(one)
                k2.append(two)
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else None)
            made = [pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "r1", "r2")), *made], ["doc_id", "r1", "r2", "n", "k1", "k2", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text")))
    return keyed.mapInArrow(run, f"doc_id {kind}, r1 long, r2 long, n long, k1 long, k2 long, bands array<long>")


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set of shingles."""
    return tuple(int(_mix(shingles ^ _ODD[i]).sum().view(np.int64)) if len(shingles) else 0 for i in (21, 22))


def _sets(docs: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the classes in ends (node, k1, k2, r1), each from a row with that r1.

    Rows repeat where whole rows do; a task gives a class once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, sets = [], []
            for text, node, *key in zip(*(batch.column(c) for c in ("text", "node", "k1", "k2")), strict=True):
                if (i := node.as_py()) in seen:
                    continue
                s = shingle_set(text.as_py(), size)
                if set_key(s) == tuple(k.as_py() for k in key):
                    seen.add(i)
                    ids.append(i)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])

    keyed = docs.select("text", row_key(F.col("doc_id"), F.col("text"))[0])
    return keyed.join(ends, "r1").select("text", "node", "k1", "k2").mapInArrow(run, "id long, shingles binary")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have 100 * intersection >= percent * union."""

    @F.pandas_udf("boolean")
    def linked(x, y):  # noqa: ANN001, ANN202
        out = np.zeros(len(x), bool)
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)  # noqa: PLW2901
            both = np.concatenate([p, q])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out[i] = 100 * common >= percent * (len(p) + len(q) - common)
        return pd.Series(out)

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    whole = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return cut(whole.where(linked("x", "y")).select("a", "b").distinct())


def _common(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every set on the right."""
    value, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    ends = np.cumsum([len(x) for x in [*left, *right]])[:-1]
    at = np.split(place, ends)
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(value), width):
        dense = np.zeros((len(at), width), np.float32)
        for i, x in enumerate(at):
            own = x[np.searchsorted(x, low) : np.searchsorted(x, low + width)]
            dense[i, own - low] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def _links_in_groups(member: DataFrame, sets: DataFrame, percent: int, docs_a_block: int = 64, shingles_a_block: int = 250_000) -> DataFrame:
    """Links between members (node, n, group, component) of a group that lie in different components.

    Those outside the group's largest component are compared with each other and with
    the rest, a block of bounded size with another at a time; pairs are not laid out as rows.
    """
    size = member.groupBy("group", "component").agg(F.count("*").alias("c"))
    main = size.groupBy("group").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.count("*").alias("k")).where("k > 1")
    placed = member.join(main.select("group", "main"), "group").withColumn("stray", F.col("component") != F.col("main"))
    need = lambda of: F.greatest(F.ceil(F.count(F.when(of, 1)) / docs_a_block), F.ceil(F.sum(F.when(of, F.col("n"))) / shingles_a_block), F.lit(1)).cast("int")
    blocks = placed.groupBy("group").agg(need(F.col("stray")).alias("strays"), need(~F.col("stray")).alias("rest"))
    placed = placed.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("rest"))).cast("int"))
    ordinal = lambda n: F.sequence(F.lit(0), n - 1)
    meet = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    own = F.col("own")
    with_strays = F.transform(ordinal(F.col("strays")), lambda o: F.struct(F.lit("s").alias("kind"), F.least(o, own).alias("i"), F.greatest(o, own).alias("j"), F.when(own <= o, 0).otherwise(1).alias("side")))
    with_rest = F.transform(ordinal(F.col("rest")), lambda o: meet("r", own, o, 0))
    from_rest = F.transform(ordinal(F.col("strays")), lambda o: meet("r", o, own, 1))
    dealt = placed.select("node", "group", "component", F.explode(F.when(F.col("stray"), F.concat(with_strays, with_rest)).otherwise(from_rest)).alias("at"))
    dealt = dealt.select("node", "component", "group", "at.*").join(sets.withColumnRenamed("id", "node"), "node")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "node"], kind="stable")
        one, two = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if len(two) == 0:  # a block with itself
            two = one
        x, y = ([np.frombuffer(v, np.uint64) for v in part["shingles"]] for part in (one, two))
        if not x or not y:
            return pd.DataFrame({"a": [], "b": []})
        common = _common(x, y)
        union = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :] - common
        hit = (100 * common >= percent * union) & (one["component"].to_numpy()[:, None] != two["component"].to_numpy()[None, :])
        i, j = hit.nonzero()
        return pd.DataFrame({"a": one["node"].to_numpy()[i], "b": two["node"].to_numpy()[j]})

    return cut(dealt.groupBy("group", "kind", "i", "j").applyInPandas(compare, "a long, b long").distinct())


def _alike(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _classes(signed: DataFrame) -> DataFrame:
    """The distinct sets (n, k1, k2): their node, least id (rep) and least row hash (at).

    A node is k1, moved on by one where different sets share it.
    """
    same = signed.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("r1").alias("at"))
    order = F.row_number().over(Window.partitionBy("k1").orderBy("k2", "n"))
    return same.withColumn("node", F.col("k1") + order - 1)


def _open_buckets(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """(group, node, n, component) of the buckets whose members but the pivot lie in different components.

    All members are compared with the pivot already. Buckets with the same members are taken once.
    """
    rest = shared.where("node <> pivot").join(comp, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    members = [F.count("*").alias("c"), *[F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]]
    unfinished = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), *members).where("low <> high")
    group = unfinished.groupBy("c", "s1", "s2").agg(F.min("key").alias("group"))
    return rest.join(apart(group), F.col("key") == F.col("group")).select("group", "node", "n", "component").distinct()


def group_rows(docs: DataFrame, percent: int = 85, size: int = 5, rows: int = 6, orders: int = 4) -> DataFrame:
    """doc_id, r1, r2, n, group (a number, null for empty sets) and rep (the least id of the group) for every row of docs."""
    bands = n_bands(percent / 100, rows)
    signed = cut(_signed(docs, size, bands, rows))
    own = F.when(F.col("r1") == F.col("at"), F.col("bands")).alias("bands")
    member = signed.where("n > 0").join(_classes(signed), ["n", "k1", "k2"])
    member = cut(member.select("doc_id", "r1", "r2", "n", "k1", "k2", "node", "rep", "at", own))
    entry = member.where("bands IS NOT NULL").select("node", "n", F.explode("bands").alias("key"))

    # a bucket's pivot is its first member in one of a few random orders, so that a group of two or three
    # copies makes few pairs and a large one is tied together by many pivots
    turn = F.xxhash64("node", F.pmod("key", F.lit(orders)))
    pivot = entry.groupBy("key").agg(F.min(F.struct(turn.alias("h"), "node", "n")).alias("p"), F.count("*").alias("c")).where("c > 1")
    shared = cut(entry.join(apart(pivot), "key").select("key", "node", "n", F.col("p.node").alias("pivot"), F.col("p.n").alias("m")))
    pairs = shared.where(F.col("node") != F.col("pivot")).where(_alike(F.col("n"), F.col("m"), percent))
    pairs = cut(pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
    # sets are laid out for all that a comparison may need: whoever shares a bucket
    ends = member.where("bands IS NOT NULL").select("node", "k1", "k2", "r1").distinct()
    ends = ends.join(shared.select("node").distinct(), "node", "left_semi")
    sets = cut(_sets(docs, ends, size))
    comp = components(_links(pairs, sets, percent), "a", "b")

    more = _links_in_groups(_open_buckets(shared, comp), sets, percent)
    of = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"{end}c"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    tied = components(between, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("least"))

    # classes with a link and, in ``tied`` alone, those that only the second round linked
    alone = tied.join(comp.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), "component")
    linked = comp.union(alone).join(tied, "component", "left").select("node", F.coalesce("least", "component").alias("group"))
    reps = member.where("bands IS NOT NULL").select("node", "rep").distinct().join(linked, "node").groupBy("group").agg(F.min("rep").alias("least"))
    linked = linked.join(apart(reps), "group").select("node", "group", "least")
    whole = member.select("doc_id", "r1", "r2", "n", "node", "rep").join(linked, "node", "left")
    whole = whole.select("doc_id", "r1", "r2", "n", F.coalesce("group", "node").alias("group"), F.when(F.col("group").isNull(), F.col("rep")).otherwise(F.col("least")).alias("rep"))
    empty = signed.where("n = 0").select("doc_id", "r1", "r2", "n", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("rep"))
    return whole.union(empty)


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, rows: int = 6, orders: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (whether these ids are equal) for every row of docs."""
    grouped = group_rows(docs, percent, size, rows, orders)
    return grouped.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("rep")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One row of each group of near duplicates, that of the least id (null comes last), with its columns as they are.

    Rows without words stay. Of rows equal in id and text one stays; of different texts with one id, the least by hash.
    """
    grouped = cut(group_rows(docs, percent, size).where("n > 0").select("group", "doc_id", "r1", "r2"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "r1", "r2")
    best = grouped.groupBy("group").agg(F.min(first).alias("w"), F.count("*").alias("c")).where("c > 1").select("group", F.col("w.r1").alias("w1"), F.col("w.r2").alias("w2"))
    placed = cut(grouped.join(apart(best), "group").select("r1", "r2", ((F.col("r1") == F.col("w1")) & (F.col("r2") == F.col("w2"))).alias("stays")))
    gone = placed.where("NOT stays").select("r1", "r2").distinct()
    # rows that repeat as a whole can only be told apart by keeping the first of each
    again = cut(placed.where("stays").groupBy("r1", "r2").count().where("count > 1").select("r1", "r2"))
    row = docs.select(F.struct("*").alias("row"), *row_key(F.col("doc_id"), F.col("text"))).join(gone, ["r1", "r2"], "left_anti")
    if not again.isEmpty():
        row = row.join(again, ["r1", "r2"], "left_anti").union(row.join(again, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]))
    return row.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
