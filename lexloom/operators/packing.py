"""Whole documents in bins of bounded size: first-fit decreasing, planned on how many documents have each size."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.sources.scratch import settled

from .ordinals import numbered


@dataclass
class Alike:
    """Bins in a row with the same contents: (size, how many of it a bin, where in the bin, number of the first among its size)."""

    bins: int
    room: int
    holds: list[tuple[int, int, int, int]] = field(default_factory=list)

    def parted(self, bins: int, more: int, size: int, first: int, width: int, taken_before: int) -> Alike:
        """The same for some of the bins, which are taken_before bins behind the start, with more of a size in each."""
        holds = [(s, n, at, start + taken_before * n) for s, n, at, start in self.holds]
        return Alike(bins, self.room - more * size, holds + ([(size, more, width - self.room, first)] if more else []))


def plan(counts: dict[int, int], width: int) -> list[Alike]:
    """Bins for so many items of each size up to width, as first-fit decreasing fills them.

    Work grows with the sizes that occur, not with the items.
    """
    row: list[Alike] = []
    for size, left in sorted(counts.items(), reverse=True):
        done, out = 0, []
        for b in row:
            fit = b.room // size
            if left == 0 or fit == 0:
                out.append(b)
                continue
            full = min(b.bins, left // fit)
            if full:
                out.append(b.parted(full, fit, size, done, width, 0))
                done, left = done + full * fit, left - full * fit
            rest = b.bins - full
            if rest and left:  # fewer than a bin would take
                out.append(b.parted(1, left, size, done, width, full))
                done, left, rest, full = done + left, 0, rest - 1, full + 1
            if rest:
                out.append(b.parted(rest, 0, size, 0, width, full))
        fit = width // size
        empty = Alike(0, width)
        if left // fit:
            out.append(empty.parted(left // fit, fit, size, done, width, 0))
            done, left = done + left // fit * fit, left % fit
        if left:
            out.append(empty.parted(1, left, size, done, width, 0))
        row = out
    return row


def pack_whole(docs: DataFrame, key: str, size: str, width: int) -> DataFrame:
    """key, segment, bin, start and length of every document with a size, in bins of width.

    Only documents longer than a bin are cut: into whole bins and a rest. Null and zero sizes take no place. Only
    the count of each size, width numbers at most, comes to the driver; places among documents of a size are by key.
    """
    docs = settled(docs.select(key, size), "sizes")  # sizes that a Python function counts are counted once
    whole = F.floor(F.col(size) / width).cast("int")
    parts = F.transform(F.sequence(F.lit(0), whole), lambda i: F.struct(i.alias("segment"), F.least(F.lit(width), F.col(size) - i * width).cast("int").alias("length")))
    cut = docs.where(F.col(size) > 0).select(key, F.inline(F.filter(parts, lambda p: p["length"] > 0)))
    placed = numbered(cut, F.desc("length"), key, "segment", name="_place")
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, first, ahead = [], 0, 0
    starts = {}
    for s in sorted(counts, reverse=True):
        starts[s], ahead = ahead, ahead + counts[s]
    for b in plan(counts, width):
        rows += [(s, starts[s] + start, starts[s] + start + n * b.bins, n, first, at) for s, n, at, start in b.holds]
        first += b.bins
    slots = docs.sparkSession.createDataFrame(rows, "length int, low long, high long, many int, first long, at int")
    both = placed.join(F.broadcast(slots), "length").where("_place >= low AND _place < high")  # as many rows as kinds of bins and sizes in them
    step = F.col("_place") - F.col("low")
    return both.select(
        key, "segment", (F.col("first") + F.floor(step / F.col("many"))).cast("long").alias("bin"),
        (F.col("at") + F.pmod(step, F.col("many")) * F.col("length")).cast("int").alias("start"), "length",
    )
