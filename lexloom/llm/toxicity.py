"""Toxicity by a learnt lexicon, misspellings and context windows.

The lexicon holds words and word beginnings that are much likelier in toxic than in
other labelled documents. It is a trie; a word's Levenshtein automaton, whose states are
bits over the word's positions, is walked along the trie and so finds the terms within
one edit, or two for long terms; a swap of neighbours is one edit. Words may hold digits
and symbols between letters, as misspellings do; where such a word is no term, its runs
of letters are tried. Words that clean documents use are no misspellings. Each hit is
weighed by its context: less inside a quotation, more with other hits within a window of
words. Quotations are told by marks that belong together, within two lines, and by > before a line. Letters
that digits stand for, letters repeated and terms spelled out count as one edit.
Two weights and an offset turn the sums into a probability.

Null and empty texts have no hits and get the score of the offset. Without labelled
rows that have a text the lexicon is empty and every score is low. Ties between terms go
to fewer edits, then the heavier term, then by name; of several labels for an id the
toxic one counts. Texts are read whole. Repeated rows and null ids each give a row; extra
columns are ignored; null labels are skipped.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out

_WORD = re.compile(r"[^\W\d_]+")
#: Letters and digits, with symbols among them and perhaps one before.
_TOKEN = re.compile(r"[@$!]?[^\W_]+(?:[*@$!#%&+|]+[^\W_]+)*")
#: Marks that open a quotation, and those that may close it.
_CLOSED_BY = {'"': '"', "'": "'", "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", "‹": "›", "›": "‹"}
_MARKS = re.compile(f"[{''.join(sorted(set(''.join(_CLOSED_BY) + ''.join(_CLOSED_BY.values()))))}\n]")
#: Letters that digits and symbols stand for.
_STANDS_FOR = str.maketrans("013457@$!", "oleastasi")
_STANDS_ALSO = str.maketrans("013457@$!", "oieastasi")
_RUNS = re.compile(r"(.)\1{2,}")
#: Single letters with the same mark or space between them, four or more.
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:([.\-_*·~ ])[^\W\d_])(?:\1[^\W\d_]){2,}(?![^\W_])")
PREFIXES = range(4, 9)
#: Lengths from which a term may have one edit and two; a beginning needs one letter more, a word with a digit or symbol one less.
ONE_EDIT, TWO_EDITS = 5, 10


def _letters(word: str) -> int:
    """The letters of a word as bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


class Trie:
    """Terms with weights; a term that ends in * stands for all words that begin so."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.whole = {t for t in weights if not t.endswith("*")}
        self.starts = {t[:-1] for t in weights if t.endswith("*")}
        self.lengths = sorted({len(t) for t in self.starts})
        # a node: children by letter, (term, length) ends, and least and greatest number of letters still to come
        self.root: list = [{}, [], 99, 0]
        for t in weights:
            word = t.rstrip("*")
            node = self.root
            for i, c in enumerate(word):
                left = len(word) - i
                node[2], node[3] = min(node[2], left), max(node[3], left if t != word + "*" else 10**9)
                node = node[0].setdefault(c, [{}, [], 99, 0])
            node[1].append(t)
            node[2], node[3] = 0, max(node[3], 0 if t == word else 10**9)
        self.twice = any(self.edits(t, True) == 2 for t in weights)
        # an edit takes one letter of a term away at most: letter sets of terms, by the lengths of words that they can match
        self.sets: dict[int, set[tuple[int, int]]] = {}
        self.begin: set[tuple[int, int, int]] = set()
        for t in weights:
            own, k = _letters(t.rstrip("*")), self.edits(t, True)
            if t.endswith("*"):
                self.begin.add((len(t) - 1 - k, own, k))
            else:
                for n in range(len(t) - k, len(t) + k + 1):
                    self.sets.setdefault(n, set()).add((own, k))
        self.known: dict[str, tuple[str, int] | None] = {}
        self.tokens: dict[str, list[tuple[str, tuple[str, int]]]] = {}

    @staticmethod
    def edits(term: str, obscured: bool = False) -> int:
        n = len(term.rstrip("*")) - term.endswith("*") + obscured
        return (n >= ONE_EDIT) + (n >= TWO_EDITS)

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, heavier ones first among equals."""
        if word not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[word] = self._find(word)
        return self.known[word]

    def _close(self, word: str) -> bool:
        """Whether the automaton has to run: a quick test that lets all words within reach of a term pass."""
        n, lack = len(word), ~_letters(word)
        if any((own & lack).bit_count() <= k for own, k in self.sets.get(n, ())):
            return True
        return any(n >= least and (own & lack).bit_count() <= k for least, own, k in self.begin)

    def _find(self, word: str) -> tuple[str, int] | None:
        exact = [word] if word in self.whole else []
        exact += [word[:n] + "*" for n in self.lengths if word[:n] in self.starts]
        if exact:
            return max(exact, key=lambda t: (self.weights[t], t)), 0
        n = len(word)
        if n < ONE_EDIT - 1:
            return None
        odd = sum(not c.isalpha() for c in word)  # each is an edit
        obscured, k = odd > 0, 2 if n >= TWO_EDITS - 3 and self.twice else 1
        if odd > k:
            return None
        if not self._close(word):
            return None
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        full, done = (1 << n + 1) - 1, 1 << n
        best: tuple[int, float, str] | None = None
        # states: bit i of the j-th number says that the first i letters stand for the trie's path with j edits
        stack = [(self.root, (1, 3, 7 if k == 2 else 0), (0, 0, 0), 0)]
        while stack:
            (children, terms, _, _), now, last, before = stack.pop()
            for term in terms:
                reached = full if term.endswith("*") else done
                distance = 0 if now[0] & reached else 1 if now[1] & reached else 2 if now[2] & reached else 3
                if distance <= self.edits(term, obscured):
                    found = (distance, -self.weights[term], term)
                    best = found if best is None else min(best, found)
            r0, r1, r2 = now
            for c, child in children.items():
                m = at.get(c, 0)
                swap = m & (before >> 1)  # the word has this letter and then the one before
                n0 = (r0 & m) << 1
                n1 = ((r1 & m) << 1 | r0 << 1 | r0 | n0 << 1 | (last[0] & swap) << 2) & full
                n2 = ((r2 & m) << 1 | r1 << 1 | r1 | n1 << 1 | (last[1] & swap) << 2) & full if k == 2 else 0
                reach = n0 | n1 | n2 if k == 2 else n0 | n1
                # no more letters may be left over, in the word or in the term, than edits
                if reach and n - reach.bit_length() + 1 <= child[3] + k and child[2] - k <= n - (reach & -reach).bit_length() + 1:
                    stack.append((child, (n0, n1, n2), now, m))
        return (best[2], best[0]) if best else None


class _Quotation:
    """Where a text quotes: between marks that belong together, over a line break at most, and in lines that begin with >."""

    def __init__(self, text: str) -> None:
        spans = [(m.start(), m.end()) for m in re.finditer(r"(?m)^[ \t]*>.*$", text)] if ">" in text else []
        open_: list[tuple[str, int, int]] = []  # mark, place, line
        line = 0
        for m in _MARKS.finditer(text):
            mark, at = m[0], m.start()
            if mark == "\n":
                line += 1
                continue
            before, after = text[at - 1 : at], text[at + 1 : at + 2]
            inner = before.isalnum() and after.isalnum()  # an apostrophe
            k = next((k for k in range(len(open_) - 1, -1, -1) if mark in _CLOSED_BY[open_[k][0]] and line - open_[k][2] <= 1), -1)
            if k >= 0 and not (mark in "'’" and (inner or before.isspace() or after.isalnum())):
                spans.append((open_[k][1], at))
                del open_[k:]
            elif mark in _CLOSED_BY and not (mark in "'‘‚" and (before.isalnum() or not after.strip())):
                open_ = [x for x in open_ if line - x[2] <= 1][-8:]
                open_.append((mark, at, line))
        self.start, self.stop = [], []
        for a, b in sorted(spans):
            if self.stop and a <= self.stop[-1]:
                self.stop[-1] = max(self.stop[-1], b)
            else:
                self.start.append(a)
                self.stop.append(b)

    def holds(self, at: int) -> bool:
        i = bisect_left(self.start, at + 1) - 1
        return i >= 0 and at < self.stop[i]


def matched(token: str, trie: Trie) -> list[tuple[str, tuple[str, int]]]:
    """What ``_matched`` finds, looked up once a token."""
    if token not in trie.tokens:
        if len(trie.tokens) > 1_000_000:
            trie.tokens.clear()
        trie.tokens[token] = _matched(token, trie)
    return trie.tokens[token]


def _matched(token: str, trie: Trie) -> list[tuple[str, tuple[str, int]]]:
    """(word, hit) of a token as a whole; else of what its digits and symbols stand for, or of its letters without repeats; else of its runs of letters."""
    if hit := trie.find(token):
        return [(token, hit)]
    if not token.isalpha():
        for table in (_STANDS_FOR, _STANDS_ALSO):
            plain = token.translate(table)
            if plain.isalpha() and (hit := trie.find(plain)) and not hit[1]:
                return [(token, (hit[0], 1))]
    if _RUNS.search(token):
        for by in (r"\1\1", r"\1"):
            if hit := trie.find(_RUNS.sub(by, token)):
                return [(token, (hit[0], max(1, hit[1])))]
    if token.isalpha():
        return []
    return [(w, hit) for w in _WORD.findall(token) if (hit := trie.find(w))]


def _spelled(text: str, trie: Trie) -> dict[int, tuple[str, tuple[str, int]]]:
    """Terms that are spelled out letter by letter, by where they begin."""
    found = {}
    for m in _SPELLED.finditer(text):
        word = m[0].replace(m[1], "")
        if (hit := trie.find(word)) and not hit[1]:
            found[m.start()] = (word, (hit[0], 1))
    return found


def hits(text: str | None, trie: Trie, window: int = 10) -> list[tuple[str, str, int, bool, int]]:
    """(word, term, edits, quoted, other hits within the window) of every hit in the text."""
    low = (text or "").lower()
    tokens = set(_TOKEN.findall(low))
    own = {t: found for t in tokens if (found := matched(t, trie))}
    # a term that is spelled out has three letters at least that stand alone
    spelled = _spelled(low, trie) if sum(len(t) == 1 and t.isalpha() for t in tokens) >= 3 else {}
    if not own and not spelled:
        return []
    found, quoted = [], _Quotation(low)
    for i, m in enumerate(_TOKEN.finditer(low)):
        here = own.get(m[0], [])
        if m.start() in spelled:
            here = [*here, spelled[m.start()]]
        found += [(i, word, *hit, quoted.holds(m.start())) for word, hit in here]
    at = np.array([x[0] for x in found])
    near = np.searchsorted(at, at + window, "right") - np.searchsorted(at, at - window, "left") - 1
    return [(*x[1:], int(n)) for x, n in zip(found, near, strict=True)]


def gathered(found: list) -> list[tuple[str, str, int, bool, int, int]]:
    """All hits, those that weigh the same as one with their number."""
    return [(*h, n) for h, n in sorted(Counter((*h[:4], int(h[4] > 0)) for h in found).items())]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    fuzzy: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()
    scale: tuple[float, float] = (1.0, 1.0)
    offset: float = -3.0
    quotation: float = 0.3
    company: float = 1.25

    def sums(self, found: list) -> tuple[float, float]:
        exact = fuzzy = 0.0
        for word, term, edits, quoted, near, *n in found:
            if edits and word in self.clean:
                continue
            value = (self.fuzzy if edits else self.weights)[term] * (self.quotation if quoted else 1.0) * (self.company if near else 1.0) * (n[0] if n else 1)
            if edits:
                fuzzy += value / edits
            else:
                exact += value
        return exact, fuzzy

    def score(self, found: list) -> float:
        exact, fuzzy = self.sums(found)
        z = self.offset + self.scale[0] * exact + self.scale[1] * fuzzy
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


_tries: list[Trie] = []


def trie_for(weights: dict[str, float]) -> Trie:
    """One for a Python worker, which may run many tasks; it remembers the words it has looked up."""
    if not _tries or _tries[0].weights != weights:
        _tries[:] = [Trie(weights)]
    return _tries[0]


def _terms(text: str) -> tuple[int, set[str]]:
    """A key that near copies mostly share, and the terms of the text."""
    words = set(_WORD.findall(text.lower()))
    terms = {w for w in words if len(w) >= 3}
    terms |= {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}
    return min((hash_of(w) for w in words), default=0), terms


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) >> 1


def _count(rows: DataFrame, only: set[str] | None) -> DataFrame:
    """term, n: distinct groups of near copies among rows that use the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, keys = [], []
            for text in batch.column("text"):
                key, own = _terms(text.as_py())
                own = own if only is None else own & only
                terms += own
                keys += [key] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(keys, pa.int64())], ["term", "key"])

    return rows.select("text").mapInArrow(run, "term string, key long").distinct().groupBy("term").agg(F.count("*").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = 4000, most_clean: int = 8000, ratio: float = 12.0) -> Model:
    """A model from labelled rows; at most about most_toxic and most_clean documents of either label are read.

    docs has doc_id and text, labels doc_id and toxic.
    """
    labels = labels.select("doc_id", "toxic").where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(1):
        return Model()
    rate = F.when(F.col("toxic") == 1, F.lit(most_toxic / size[1])).otherwise(F.lit(most_clean / max(1, size.get(0, 1))))
    taken = labels.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    # the sample has about most_toxic + most_clean ids, whatever the input
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(taken), "doc_id").select("text", "toxic").persist()
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic = 0")
    n1, n0 = toxic.count(), clean.count()
    if not n1:
        rows.unpersist()
        return Model()
    least = max(6, math.ceil(0.01 * n1))
    pos = {r["term"]: r["n"] for r in _count(toxic, None).where(F.col("n") >= least).toLocalIterator()}
    neg = {r["term"]: r["n"] for r in _count(clean, set(pos)).toLocalIterator()} if pos else {}
    odds = {t: math.log((n + 0.5) / (n1 + 1)) - math.log((neg.get(t, 0) + 0.5) / (n0 + 1)) for t, n in pos.items()}
    good = {t: w for t, w in odds.items() if w >= math.log(ratio)}
    widest: Counter = Counter()
    for t in good:
        if not t.endswith("*"):
            for n in PREFIXES:
                if len(t) > n:
                    widest[t[:n] + "*"] = max(widest[t[:n] + "*"], pos[t])
    chosen: dict[str, float] = {}
    for t in sorted(good, key=lambda t: (not t.endswith("*"), len(t), t)):
        if any(t[:n] + "*" in chosen for n in PREFIXES if n < len(t.rstrip("*"))):
            continue  # a shorter beginning has it
        if t.endswith("*") and pos[t] < 1.5 * widest[t]:
            continue  # one word, not a family
        chosen[t] = good[t]

    trie_of = rows.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_for(trie_of.value)
        kind = pa.list_(pa.struct([("word", pa.string()), ("term", pa.string()), ("edits", pa.int64()), ("quoted", pa.bool_()), ("near", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            found = [[dict(zip(("word", "term", "edits", "quoted", "near", "n"), h, strict=True)) for h in gathered(hits(t.as_py(), trie))] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, kind)], ["toxic", "hits"])

    schema = "toxic int, hits array<struct<word:string,term:string,edits:long,quoted:boolean,near:long,n:long>>"
    seen = [(r["toxic"], [tuple(h) for h in r["hits"]]) for r in rows.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, schema).collect()]
    rows.unpersist()
    # how much a misspelling of each term tells, in rows that use it; untried ones count as the term, but less
    near = [Counter(t for label, found in seen if label == y for t in {h[1] for h in found if h[2]}) for y in (0, 1)]
    prior = 0.7 * min(n1, n0) / max(1, n1)
    fuzzy = {}
    for t, w in chosen.items():
        tells = math.log((near[1][t] + prior) / (n1 + 1)) - math.log((near[0][t] + 0.1) / (n0 + 1))
        fuzzy[t] = max(0.0, min(w, tells)) if near[0][t] or near[1][t] else 0.7 * w
    used = {h[0] for label, found in seen if not label for h in found if h[2]}
    model = Model(chosen, fuzzy, frozenset(used))
    x = np.array([[*model.sums(found), 1.0] for _, found in seen])
    y = np.array([t for t, _ in seen], float)
    w = np.array([0.5, 0.5, -3.0])
    for _ in range(300):  # Newton steps, damped; keeps the slopes positive
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3) * len(x) / 100
        step = np.linalg.solve(hess, x.T @ (p - y) + 1e-5 * len(x) * w)
        w = w - np.clip(step, -0.5, 0.5)
        w[:2] = np.maximum(w[:2], 0.05)
        if np.abs(step).max() < 1e-6:
            break
    model.scale, model.offset = (float(w[0]), float(min(w[1], w[0]))), float(w[2])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and n_hits for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_for(sent.value.weights)
        for batch in batches:
            found = [hits(t.as_py(), trie) for t in batch.column("text")]
            value = [sent.value.score(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(value, pa.float64()), pa.array([int(v >= 0.5) for v in value], pa.int32()), pa.array(map(len, found), pa.int64())],
                ["doc_id", "score", "predicted", "n_hits"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_hits long")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits; labels of held-out ids are never read."""
    model = learn(docs, labels.where(~held_out(F.col("doc_id"), folds, fold)))
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id"), folds, fold)).select("doc_id", "held_out", "score", "predicted", "n_hits")
