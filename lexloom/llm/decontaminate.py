"""Benchmark decontamination: CGK walks, bit-sampling LSH and exact edit distances.

An item is found in a document where some stretch of it is within ``ratio`` edits a
character of the item. An item is cut into one more piece than it may have edits, and
the pieces are grouped into parts of about five. Of the allowed edits fewer fall on some
part than it has pieces, so that one of its pieces stays whole: windows of the part's
size are laid around every occurrence of a piece. Windows and parts are embedded by CGK
random walks, which turn few edits into few differing positions; samples of positions
are hashed, in as many tables as a simulation on whole items needs for the target
recall. A short item is one part, and its windows are of the item's size; a long one is
hashed part by part, as the walks of hundreds of characters with tens of edits have too
little in common, and one part that is found will do. Around windows that meet a part in a table, the whole item is
confirmed by the exact edit distance: stretches of an item that overlap are read as one,
and only what shares as many short runs of characters with the item as the allowed edits
must leave. Should tables not reach the recall for some kind of items, all their windows are
confirmed; ``hashed_share`` tells for how many items no part needs that.

Texts are compared lower-cased with white space collapsed. Null, blank and very
short texts hold no item; null or blank items are never found. Ids may be of any type;
null and repeated ids of documents and items do no harm, as every row is judged by its own text.
Repeated rows each give their rows; equal items are all reported. Items go out in
blocks of bounded numbers and characters, so a large benchmark needs no more memory.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut

#: The part of a walk that is sampled: a text is used up in about two of the three steps a character, and padding follows.
REACH = 0.6
#: Characters of the runs that are counted before an exact distance; a number of 32 bits holds them.
GRAM = 4
#: Pieces that make up a part of an item, about ten characters each where a tenth may be edited.
PIECES_A_PART = 5
SCHEMA = "start long, length long, distance long"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def allowed(length: int, ratio: float) -> int:
    return int(length * ratio)


def pieces(item: str, ratio: float) -> list[tuple[int, str]]:
    """(offset, piece) of a cut into one more piece than the item may have edits."""
    n = allowed(len(item), ratio) + 1
    at = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


@dataclass(frozen=True)
class Part:
    """A stretch of an item with fewer edits to expect than it has pieces."""

    item: int
    offset: int
    text: str
    pieces: tuple[tuple[int, str], ...]  # (offset in the part, piece)
    parts: int  # of the item

    @property
    def edits(self) -> int:
        return len(self.pieces) - 1

    @property
    def kind(self) -> tuple[int, int]:
        """What has tables of its own: parts of like length, of items of as many parts."""
        return min(self.parts, 4), size_class(len(self.text))


def parts_of(item: int, text: str, ratio: float) -> list[Part]:
    cut = pieces(text, ratio)
    n = max(1, round(len(cut) / PIECES_A_PART))
    out = []
    for i in range(n):
        own = cut[i * len(cut) // n : (i + 1) * len(cut) // n]
        at, end = own[0][0], own[-1][0] + len(own[-1][1])
        out.append(Part(item, at, text[at:end], tuple((o - at, p) for o, p in own), n))
    return out


def infix_distance(item: str, text: str) -> tuple[int, int]:
    """(least edits, end) that turn the item into some stretch of the text, by bit-parallel columns."""
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << len(item)) - 1, 1 << (len(item) - 1)
    pv, mv, score = full, 0, len(item)
    best = (score, 0)
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j)
    return best


@dataclass
class Tables:
    """Walks and sampled positions; a key needs ``walks`` walks of three steps a character."""

    walks: int
    tables: int
    bits: int
    longest: int
    seed: int = 11

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.advance = rng.integers(0, 2, size=(self.walks, 3 * self.longest, 256), dtype=np.uint8)
        self.at = rng.random((self.walks, self.tables, self.bits)) * REACH
        self.odd = rng.integers(1, 2**62, size=self.bits, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, code: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(windows, walks * tables) keys of the windows of code, which are padded by 0 where text ends."""
        out = np.empty((len(start), self.walks * self.tables), np.uint64)
        if not len(start):
            return out
        steps, last = int(REACH * 3 * length.max()) + 1, len(code) - 1
        walked = np.empty((steps, len(start)), np.uint8)
        mine = np.arange(len(start))[:, None]
        for w in range(self.walks):
            step = np.zeros(len(start), np.int64)
            for j in range(steps):
                c = code[np.minimum(start + step, last)]
                c[step >= length] = 0
                walked[j] = c
                step += self.advance[w, j][c]
            for t in range(self.tables):
                at = (self.at[w, t][None, :] * 3 * length[:, None]).astype(np.int64)
                value = (walked[at, mine] * self.odd).sum(axis=1)
                out[:, w * self.tables + t] = value ^ (length.astype(np.uint64) << np.uint64(48))
        return out


def encode(text: str) -> np.ndarray:
    """A byte for each character; 0 stands for none."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (code % 255 + 1).astype(np.uint8)


def grams(code: np.ndarray) -> np.ndarray:
    """The runs of GRAM characters, as numbers; at the end of the code there are fewer."""
    if len(code) < GRAM:
        return np.empty(0, np.uint32)
    runs = np.lib.stride_tricks.sliding_window_view(code, GRAM)
    return np.ascontiguousarray(runs).view(np.uint32)[:, 0]


def lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of all texts in a row, with start and length of each."""
    length = np.array([len(t) for t in texts], np.int64)
    return encode("".join(texts)), np.cumsum(length) - length, length


def _mutate(item: str, edits: int, rng: np.random.Generator) -> str:
    out = list(item)
    for _ in range(edits):
        i, kind = int(rng.integers(0, len(out))), int(rng.integers(0, 3))
        c = item[int(rng.integers(0, len(item)))]
        if kind == 0:
            out[i] = c
        elif kind == 1:
            out.insert(i, c)
        elif len(out) > 1:
            del out[i]
    return "".join(out)


def size_class(length: int) -> int:
    """Items of a class differ in length by a factor of about 1.4 at most."""
    return int(2 * math.log2(length))


def _met(part: Part, text: str) -> list[int]:
    """Where windows of the part's size are laid in the text: around each occurrence of a piece."""
    found = set()
    for offset, piece in part.pieces:
        at = text.find(piece) if piece else -1
        while at >= 0:
            found.add(max(0, at - offset))
            at = text.find(piece, at + 1)
    return sorted(found)


def plan_tables(items: list[list[Part]], ratio: float, recall: float, bits: int = 4, walks: int = 4, most: int = 96, trials: int = 200) -> dict[tuple[int, int], Tables | None]:
    """Tables of each kind of part for the recall of whole items, of which it takes one part to be found.

    Simulated on items of as many parts: edited as often as allowed, put between other text and searched by their windows.
    None stands for kinds whose recall isn't met by ``most`` tables; their windows are all confirmed.
    """
    groups: dict[int, list[list[Part]]] = {}
    for x in items:
        groups.setdefault(x[0].kind[0], []).append(x)
    plan: dict[tuple[int, int], Tables | None] = {}
    for own in groups.values():
        rng = np.random.default_rng(5)
        order = rng.permutation(len(own))
        windows: dict[tuple[int, int], list[tuple[int, str, str]]] = {p.kind: [] for x in own for p in x}
        for i in range(trials):
            x = own[order[i % len(own)]]
            whole = "".join(p.text for p in x)
            around = "".join(p.text for p in own[int(rng.integers(0, len(own)))])[::-1][:200]
            text = around + (_mutate(whole, max(1, allowed(len(whole), ratio)), rng) if len(whole) > 1 else whole) + around
            for p in x:
                n = len(p.text)
                windows[p.kind] += [(i, p.text, text[at : at + n].ljust(n)) for at in _met(p, text)]
        met = np.zeros((trials, most // walks), bool)  # whether a trial is found by so many tables a walk
        trial = {kind: Tables(walks, most // walks, bits, max(len(p.text) for x in own for p in x if p.kind == kind)) for kind in windows}
        for kind, laid in windows.items():
            if laid:
                same = trial[kind].keys(*lay_out([w[1] for w in laid])) == trial[kind].keys(*lay_out([w[2] for w in laid]))
                np.logical_or.at(met, [w[0] for w in laid], np.logical_or.accumulate(same.reshape(len(laid), walks, -1).any(axis=1), axis=1))
        enough = np.flatnonzero(met.mean(axis=0) >= recall)
        for kind in windows:  # twice, as the simulation is a sample
            plan[kind] = Tables(walks, min(most // walks, 2 * (int(enough[0]) + 1)), bits, trial[kind].longest) if len(enough) else None
    return plan


_searchers: dict[str, Searcher] = {}


def searcher(token: str, rows: list[tuple[object, str]], ratio: float, plan: dict[tuple[int, int], Tables | None]) -> Searcher:
    """One for a Python worker, which may run many tasks."""
    if token not in _searchers:
        _searchers.clear()
        _searchers[token] = Searcher(rows, ratio, plan)
    return _searchers[token]


class Searcher:
    """Finds one block of items in texts."""

    def __init__(self, items: list[tuple[object, str]], ratio: float, plan: dict[tuple[int, int], Tables | None]) -> None:
        self.items, self.ratio, self.plan = items, ratio, plan
        self.parts = [p for i, (_, text) in enumerate(items) for p in parts_of(i, text, ratio)]
        self.seeds = ahocorasick.Automaton()
        where: dict[str, tuple[set[tuple[int, int, int, tuple[int, int]]], set[tuple[int, int]]]] = {}
        for p in self.parts:
            whole = plan[p.kind] is None
            for offset, piece in p.pieces:
                hashed, open_ = where.setdefault(piece, (set(), set()))
                if whole:
                    open_.add((p.offset + offset, p.item))
                else:
                    hashed.add((offset, len(p.text), p.edits, p.kind))
        for piece, (hashed, open_) in where.items():
            self.seeds.add_word(piece, (len(piece), tuple(hashed), tuple(open_)))
        if where:
            self.seeds.make_automaton()
        self.grams: dict[int, np.ndarray] = {}
        self.by_key: dict[tuple[tuple[int, int], int, int], list[int]] = {}
        self.known: dict[tuple[int, int], list[np.ndarray]] = {}
        for kind, tables in plan.items():
            if tables is None:
                continue
            own = [i for i, p in enumerate(self.parts) if p.kind == kind]
            keys = tables.keys(*lay_out([self.parts[i].text for i in own]))
            for i, row in zip(own, keys.tolist(), strict=True):
                for t, key in enumerate(row):
                    self.by_key.setdefault((kind, t, key), []).append(i)
            self.known[kind] = [np.unique(keys[:, t]) for t in range(keys.shape[1])]

    def find(self, texts: list[str]) -> list[list[tuple[object, int, int, int]]]:
        """(item_id, start, length, distance) of each text, positions in the normalised text."""
        out: list[list[tuple[object, int, int, int]]] = [[] for _ in texts]
        if not self.items:
            return out
        laid: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
        around: dict[tuple[int, int], set[int]] = {}
        base = []
        at = 0
        for d, text in enumerate(texts):
            base.append(at)
            for end, (n, hashed, whole) in self.seeds.iter(text):
                for offset, length, edits, kind in hashed:
                    start = max(0, end + 1 - n - offset)
                    if len(text) - start >= length - edits:
                        laid.setdefault(kind, set()).add((d, start, length))
                for offset, item in whole:
                    around.setdefault((d, item), set()).add(max(0, end + 1 - n - offset))
            at += len(text) + 1
        if not laid and not around:
            return out
        code = encode("\0".join(texts))
        for d, part, start in self._candidates(code, base, laid):
            p = self.parts[part]
            around.setdefault((d, p.item), set()).add(max(0, start - p.offset))
        gram = grams(code) if around else code
        for (d, item), starts in sorted(around.items()):
            if found := self._nearest(item, sorted(starts), texts[d], gram[base[d] : base[d] + len(texts[d])]):
                out[d].append((self.items[item][0], *found))
        return out

    def _candidates(self, code: np.ndarray, base: list[int], laid: dict[tuple[int, int], set[tuple[int, int, int]]]) -> set[tuple[int, int, int]]:
        """(text, part, start) of the windows that meet a part in a table of their class."""
        found: set[tuple[int, int, int]] = set()
        for kind, own in laid.items():
            windows = sorted(own)
            for i in range(0, len(windows), 50_000):
                part = np.array(windows[i : i + 50_000], np.int64)
                start = np.array(base)[part[:, 0]] + part[:, 1]
                keys = self.plan[kind].keys(code, start, part[:, 2])
                for t, known in enumerate(self.known[kind]):
                    hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, keys[:, t]), len(known) - 1)] == keys[:, t])
                    for w, key in zip(hit.tolist(), keys[hit, t].tolist(), strict=True):
                        for own_part in self.by_key[(kind, t, key)]:
                            found.add((int(part[w, 0]), own_part, int(part[w, 1])))
        return found

    def _nearest(self, item: int, starts: list[int], text: str, gram: np.ndarray) -> tuple[int, int, int] | None:
        """(start, length, distance) of the nearest stretch around the starts, of which those that overlap are read as one."""
        own = self.items[item][1]
        k = allowed(len(own), self.ratio)
        stretches: list[list[int]] = []
        for start in starts:
            low, high = max(0, start - k), min(len(text), start + len(own) + k)
            if stretches and low <= stretches[-1][1]:
                stretches[-1][1] = high
            else:
                stretches.append([low, high])
        best: tuple[int, int, int] | None = None
        for low, high in stretches:
            low, high = self._alike(item, k, gram, low, high)  # noqa: PLW2901
            if high - low < len(own) - k or (best and best[2] == 0):
                continue
            stretch = text[low:high]
            distance, end = infix_distance(own, stretch)
            if distance <= k and (best is None or distance < best[2]):
                back, length = infix_distance(own[::-1], stretch[:end][::-1])
                best = (low + end - length, length, distance)
        return best

    def _alike(self, item: int, k: int, gram: np.ndarray, low: int, high: int) -> tuple[int, int]:
        """The part of a stretch that can hold the item: an edit changes GRAM of its runs of GRAM characters at most."""
        n = len(self.items[item][1])
        least, width = n - GRAM + 1 - GRAM * k, n + k - GRAM + 1
        if item not in self.grams:
            self.grams[item] = np.unique(grams(encode(self.items[item][1])))
        own, here = self.grams[item], gram[low : max(low, high - GRAM + 1)]
        if least <= 0 or not len(own):
            return low, high
        if not len(here):
            return low, low
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(own[np.minimum(np.searchsorted(own, here), len(own) - 1)] == here)])
        width = min(width, len(here))
        enough = np.flatnonzero(total[width:] - total[:-width] >= least)
        return (low + int(enough[0]), low + int(enough[-1]) + width + GRAM - 1) if len(enough) else (low, low)


def _blocks(benchmark: DataFrame, ratio: float, recall: float, block: int, characters: int) -> Iterator:
    """Broadcast (items, plan) of each block of at most about so many items and characters; an item goes to a block by its hash."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    blocks = max(1, math.ceil(size["n"] / (block * 0.8)), math.ceil(size["c"] / (characters * 0.8)))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(blocks)) == b).toLocalIterator()
        rows = sorted(((r["item_id"], t) for r in own if (t := normalise(r["text"]))), key=lambda r: (r[1], str(r[0])))
        if rows:
            cut_up = [parts_of(i, t, ratio) for i, (_, t) in enumerate(rows)]
            yield benchmark.sparkSession.sparkContext.broadcast((rows, plan_tables(cut_up, ratio, recall)))


def hashed_share(benchmark: DataFrame, ratio: float = 0.1, recall: float = 0.99, block: int = 20_000, characters: int = 50_000_000) -> float:
    """The share of items all parts of which are found through the tables; the others have windows that are confirmed without them."""
    hashed = total = 0
    for sent in _blocks(benchmark, ratio, recall, block, characters):
        rows, plan = sent.value
        total += len(rows)
        hashed += sum(all(plan[p.kind] for p in parts_of(i, t, ratio)) for i, (_, t) in enumerate(rows))
        sent.destroy()
    return hashed / total if total else 1.0


def _searched(batches: Iterator[pa.RecordBatch], search: Searcher) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batches with what is found in each of their texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part, search.find([normalise(x.as_py()) for x in part.column("text")])


def find_items(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.1, recall: float = 0.99, block: int = 20_000, characters: int = 50_000_000) -> DataFrame:
    """doc_id, item_id, start, length and distance of every item found in a document.

    block and characters bound the items that a pass over the documents sends to each task.
    """
    id_of = lambda df, c: df.schema[c].dataType
    schema = f"doc_id {id_of(docs, 'doc_id').simpleString()}, item_id {id_of(benchmark, 'item_id').simpleString()}, {SCHEMA}"
    item_kind = to_arrow_type(id_of(benchmark, "item_id"))
    found = docs.sparkSession.createDataFrame([], schema)
    for i, sent in enumerate(_blocks(benchmark, ratio, recall, block, characters)):

        def run(batches: Iterator[pa.RecordBatch], sent=sent, token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for part, hits in _searched(batches, searcher(token, sent.value[0], ratio, sent.value[1])):
                which = pa.array([i for i, h in enumerate(hits) for _ in h], pa.int64())
                flat = [x for h in hits for x in h]
                columns = [pa.array([x[j] for x in flat], kind) for j, kind in enumerate((item_kind, pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(which), *columns], ["doc_id", "item_id", "start", "length", "distance"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = part if i == 0 else found.union(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.1, recall: float = 0.99, block: int = 20_000, characters: int = 50_000_000) -> DataFrame:
    """The rows of docs that hold no item, with their columns as they are.

    Each block of items filters what the ones before it let through; nothing is shuffled.
    """
    kept, used = docs, []
    for i, sent in enumerate(_blocks(benchmark, ratio, recall, block, characters)):
        if i and i % 4 == 0:  # a task runs at most four searches in a row
            kept = cut(kept)
            while used:
                used.pop().destroy()
        used.append(sent)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for part, hits in _searched(batches, searcher(token, sent.value[0], ratio, sent.value[1])):
                yield part.filter(pa.array([not h for h in hits]))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
