"""Language identification by mixture inference.

Every language has a distribution over hashed letter trigrams, counted over a sample
of labelled documents. A document's trigrams are drawn from a mixture of these:
expectation-maximisation estimates its proportions, and languages join the set one
by one as long as the penalised likelihood rises.

Null texts and texts without a letter are ``und`` with score 0; a language whose texts
have no letter isn't learnt. Empty tables give no rows; without labelled rows every text
is ``und``. Of languages with equal proportions the first by name is taken. Very long
texts are read whole; null ids are ids like others; repeated rows each give a row; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of letters and word ends, lower-cased; empty if there is no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _letters()[np.minimum(code, 0xFFFF)]
    if (beyond := code > 0xFFFF).any():
        rare, at = np.unique(code[beyond], return_inverse=True)
        known[beyond] = np.array([chr(c).isalpha() for c in rare])[at]
    code = np.where(known, code, 0)
    if not code.any():
        return np.empty(0, np.int64)
    code = np.concatenate([np.zeros(1, np.uint32), code, np.zeros(1, np.uint32)])
    a, b, c = code[:-2], code[1:-1], code[2:]
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    return h[b != 0].astype(np.int64)


def tally(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(bucket) < 20_000:
        return np.unique(bucket, return_counts=True)
    n = np.bincount(bucket, minlength=BUCKETS)
    at = n.nonzero()[0]
    return at, n[at]


def sample_by_language(docs: DataFrame, per_language: int) -> DataFrame:
    """About per_language documents of each language, by a hash of id and text."""
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return docs
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n))])
    return docs.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 20)) < F.element_at(rate, F.col("lang")) * (1 << 20))


def train(docs: DataFrame, per_language: int = 3000, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by bucket, from (doc_id, text, lang) rows without nulls.

    per_language bounds the documents counted for a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if lang not in found:
                    found[lang] = np.zeros(BUCKETS, np.int64)
                found[lang] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, n in found.items():
            at = n.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    counted = sample_by_language(docs.select("doc_id", "text", "lang"), per_language)
    rows = counted.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((len(langs), BUCKETS), smoothing)
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        table[i, own["bucket"]] += own["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if langs else table


def mixture(log_p: np.ndarray, n: np.ndarray, rounds: int = 12, penalty: float = 4.0) -> np.ndarray:
    """Proportions of the languages in a document with n[j] trigrams of log probability log_p[:, j].

    Each language added to the set must raise the log likelihood by penalty * log(trigrams).
    """
    total, shift = n.sum(), log_p.max(axis=0)
    p = np.exp(log_p - shift)

    def fit(chosen: list[int]) -> tuple[float, np.ndarray]:
        own = p[chosen]
        share = np.full(len(chosen), 1 / len(chosen))
        for _ in range(rounds if len(chosen) > 1 else 0):
            joint = share[:, None] * own
            new = (joint / joint.sum(axis=0)) @ n / total
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        return float(np.log(share @ own) @ n), share

    alone = log_p @ n
    chosen = [int(alone.argmax())]
    best, share = fit(chosen)
    cost = penalty * np.log(total + 1)
    _, overall = fit(list(range(len(p))))
    for k in np.argsort(-overall):
        if int(k) in chosen or overall[k] < 0.01:
            continue
        value, with_k = fit([*chosen, int(k)])
        if value - best <= cost:
            break
        chosen, best, share = [*chosen, int(k)], value, with_k
    out = np.zeros(len(p))
    out[chosen] = share
    return out


def predict(docs: DataFrame, langs: list[str], log_p: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (its proportion) and the proportions of the chosen set."""
    model = docs.sparkSession.sparkContext.broadcast(log_p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            pred, score, mixed = [], [], []
            for text in batch.column("text"):
                bucket = trigrams(text.as_py() or "")
                if not len(bucket) or not langs:
                    pred.append(UNKNOWN), score.append(0.0), mixed.append([])
                    continue
                at, n = tally(bucket)
                share = mixture(table[:, at], n)
                top = int(share.argmax())
                pred.append(langs[top]), score.append(float(min(1.0, share[top])))
                mixed.append([{"lang": langs[i], "share": float(share[i])} for i in np.argsort(-share) if share[i] > 0])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, kind)],
                ["doc_id", "lang_pred", "score", "mixture"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, per_language: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score and mixture; only rows that aren't held out are learnt from."""
    known = docs.where(~held_out(F.col("doc_id"), folds, fold) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs, log_p = train(known, per_language)
    found = predict(docs, langs, log_p)
    return found.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score", "mixture")
