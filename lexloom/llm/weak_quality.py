"""Document quality from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Votes are counted by
pattern over all documents, and expectation-maximisation on these counts estimates
how often each labeller is right and the share of good documents. Posterior labels of
a sample train a linear scorer on hashed character features, which scores every text.

Null and empty texts are voted bad by length and get the score of their (empty)
features. An empty table gives no rows. Equal texts get equal scores; repeated rows and
null ids each give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words

GOOD, BAD, NONE = 1, 0, -1
BUCKETS = 1 << 11
DENSE = 4


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(NONE)).cast("byte")


def labellers(text: Column) -> dict[str, Column]:
    """The votes on a text by name, and the ratios that they and the scorer use."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return {
        "n": F.size(words(text)),
        "distinct": let(words(text), lambda w: F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))),
        "symbols": F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)),
        "upper": F.coalesce(F.regexp_count(text, F.lit(r"\p{Lu}")), F.lit(0)),
        "ends": F.coalesce(F.regexp_count(text, F.lit(r"[.!?][\s\"')]")), F.lit(0)),
        "same_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), F.lit(1))),
        "length": F.length(text),
    }


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, text, the dense features and one byte a labeller."""
    text = F.coalesce(F.col("text"), F.lit(""))
    m = docs.select("doc_id", text.alias("text"), *[c.alias(f"_{k}") for k, c in labellers(text).items()])
    n, c = F.greatest(F.col("_n"), F.lit(1)), F.col
    mean = c("_length") / n
    never = F.lit(False)
    prose = (c("_symbols") / n < 0.05) & (c("_upper") / n < 0.5)
    # detectors of one kind of junk say nothing about texts that lack it
    cast = [
        _vote(never, c("_symbols") / n > 0.2),
        _vote(never, (c("_upper") / n > 1.2) & (n >= 5)),
        _vote(never, (c("_distinct") < 0.2) & (n >= 20) & (n < 2000) | (c("_distinct") < 0.05)),
        _vote(never, c("_same_lines") > 0.5),
        _vote(mean.between(3, 12), ~mean.between(2, 20) & (n >= 5)),
        _vote((c("_ends") / n).between(0.01, 0.5) | (n < 20), (c("_ends") / n < 0.002) & (n >= 50)),
        _vote(prose, ~prose & (c("_ends") / n < 0.01) & (n >= 20)),
    ]
    dense = F.array(c("_symbols") / n, c("_upper") / n, c("_distinct"), c("_same_lines"))
    return m.select("doc_id", "text", dense.alias("dense"), F.array(*cast).alias("votes"))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, rate[class, labeller, vote] and posterior of each pattern of votes.

    Votes are indexed NONE + 1, BAD + 1 and GOOD + 1: a labeller that rarely speaks tells
    by speaking. Given the class, labellers are taken as independent.
    """
    n = counts.astype(float)
    vote = np.stack([patterns == v for v in (NONE, BAD, GOOD)], axis=2).astype(float)  # pattern, labeller, vote
    post = np.where((patterns == BAD).any(axis=1), 0.1, 0.9)  # to start with, a document is bad if anyone says so
    for _ in range(rounds):
        share = float(np.clip((post * n).sum() / n.sum(), 0.01, 0.99))
        rate = np.stack([np.einsum("p,pjv->jv", w, vote) + 0.5 for w in ((1 - post) * n, post * n)])
        rate /= rate.sum(axis=2, keepdims=True)
        like = np.log([1 - share, share])[:, None] + np.einsum("pjv,yjv->yp", vote, np.log(rate))
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return share, rate, post


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every character: lower, upper, other letter, digit, space, line feed, sentence mark, symbol, other."""
    out = np.full(1 << 16, 8, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        out[i] = 5 if c == "\n" else 4 if c.isspace() else 3 if c.isdigit() else 0 if c.islower() else 1 if c.isupper() else 2 if c.isalpha() else 6 if c in ".,;:!?'\"()-" else 7 if c in "#*$%&|<>@/\\_=+~^" else 8
    return out


def features(text: str, dense: list[float]) -> np.ndarray:
    """Square roots of the shares of hashed runs: four character classes, and two characters."""
    out = np.zeros(2 * BUCKETS + DENSE, np.float32)
    out[2 * BUCKETS :] = np.minimum(dense, 3)
    code = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    if len(code) >= 4:
        k = _classes()[code]
        four = ((k[:-3] * np.uint32(9) + k[1:-2]) * np.uint32(9) + k[2:-1]) * np.uint32(9) + k[3:]
        out[:BUCKETS] = np.bincount((four * np.uint32(0x9E3779B1)) >> np.uint32(21), minlength=BUCKETS)
        two = (code[:-1] * np.uint32(0x85EBCA77)) ^ (code[1:] * np.uint32(0xC2B2AE3D))
        out[BUCKETS : 2 * BUCKETS] = np.bincount((two * np.uint32(0x27D4EB2F)) >> np.uint32(21), minlength=BUCKETS)
        out[: 2 * BUCKETS] = np.sqrt(out[: 2 * BUCKETS] / len(code))
    return out


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 2.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic scorer for soft labels y, by accelerated gradient steps; classes weigh alike."""
    w, bias, v, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ (w + 0.9 * v) + bias + 0.9 * vb, -30, 30)))
        e = ((p - y) * weight / 2).astype(np.float32)
        v = 0.9 * v - rate * (x.T @ e + ridge * w)
        vb = 0.9 * vb - rate * float(e.sum())
        w, bias = w + v, bias + vb
    return w, float(bias)


def classify(docs: DataFrame, most_rows: int = 3000, least_score: float = 0.5) -> DataFrame:
    """doc_id, score, weak_label (the labellers' posterior) and kept for every row of docs.

    most_rows bounds the documents, drawn by a hash of id and text, that train the scorer.
    """
    cast = votes(docs)
    tally = cast.groupBy("votes").agg(F.count("*").alias("n")).collect()  # 3 ** labellers rows at most
    total = sum(r["n"] for r in tally)
    if total:
        patterns = np.array([list(r["votes"]) for r in tally])
        _, _, post = fit_labellers(patterns, np.array([r["n"] for r in tally]))
        posterior = {tuple(p): float(q) for p, q in zip(patterns.tolist(), post, strict=True)}
    else:
        posterior = {}
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(posterior)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense, own = batch.column("dense").to_pylist(), batch.column("votes").to_pylist()
            x = [features(t.as_py(), d).astype(np.float16).tobytes() for t, d in zip(batch.column("text"), dense, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array([table.value[tuple(v)] for v in own], pa.float64())], ["x", "y"])

    rate = min(1.0, most_rows / max(1, total))
    drawn = docs.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id", "text"), F.lit(1 << 20)) < rate * (1 << 20))
    rows = votes(drawn).select("text", "dense", "votes").mapInArrow(featured, "x binary, y double").collect() if total else []
    if rows:
        x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
        model = sc.broadcast(fit_scorer(x, np.array([r["y"] for r in rows])))
    else:
        model = sc.broadcast((np.zeros(2 * BUCKETS + DENSE, np.float32), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = model.value
        for batch in batches:
            dense, own = batch.column("dense").to_pylist(), batch.column("votes").to_pylist()
            z = np.array([float(features(t.as_py(), d) @ w) + bias for t, d in zip(batch.column("text"), dense, strict=True)])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            weak = [table.value[tuple(v)] for v in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(weak, pa.float64()), pa.array(score >= least_score)], ["doc_id", "score", "weak_label", "kept"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cast.mapInArrow(run, f"doc_id {kind}, score double, weak_label double, kept boolean")
