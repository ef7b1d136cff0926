"""Token counts, cuts and chunks against an independent tokenizer and brute force."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lexloom.functions.tokens import Encoder, token_count, token_head, token_ids, vocabulary
from lexloom.operators import corpus
from lexloom.sources.settings import Settings

RANKS = Settings().tokenizer
OTHER = os.path.join(os.path.dirname(RANKS), "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="needs the vocabulary file")

TEXTS = ["", " ", "Hello world.  It's   1999!\n\n\tNew line ", "Übergröße – naïve 東京 \U0001f600", "<|endoftext|> x", None, " " * 5000 + "x", "a" + "\n" * 3000, "tail" + " " * 2000, "  \n" * 1000 + " end"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")


def test_counts_equal_another_tokenizer(spark, table):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(OTHER)
    other.encode_special_tokens = True
    got = table.select("doc_id", "text", token_count(spark, RANKS)(F.col("text")).alias("n"), token_ids(spark, RANKS)(F.col("text")).alias("ids"), token_head(spark, RANKS, 4)(F.col("text")).alias("head")).collect()
    for r in got:
        if r["text"] is None:
            assert r["n"] is r["ids"] is r["head"] is None
            continue
        assert r["ids"] == other.encode(r["text"], add_special_tokens=False).ids and r["n"] == len(r["ids"])
        assert r["text"].startswith(r["head"]) and (len(r["ids"]) > 4 or r["head"] == r["text"])


def test_texts_come_in_small_batches(spark):
    """Rows by the hundred, not Arrow batches of ten thousand texts of any length."""
    docs = spark.range(3).select(F.lit("some words").alias("text"))
    for of in (token_count(spark, RANKS), token_ids(spark, RANKS), token_head(spark, RANKS, 4)):
        plan = docs.select(of(F.col("text")))._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_long_texts_take_linear_time():
    encoder = Encoder(RANKS)
    for text in (" " * 2_000_000, "\n" * 1_000_000 + "x", "word. " * 200_000):
        began = time.time()
        encoder.count(text)
        assert time.time() - began < 20
    took = []
    for n in (20_000, 160_000):
        began = time.time()
        assert sum(1 for _ in corpus._packed("one two three four. " * n, 768, 128, lambda s: s.count(" ") + 1)) > n // 200
        took.append(time.time() - began)
    assert took[1] < 20 * took[0] + 1


def brute(text, size, overlap, count):
    """Chunks from lists of sentences, with tokens counted anew each time."""
    import re

    sentences = [" ".join(s.split()) for s in re.split(r"(?<=[.!?])\s+", text) if s.split()]
    assert all(count(s) <= size for s in sentences)
    out, now = [], []
    for s in sentences:
        if now and sum(map(count, now)) + count(s) > size:
            out.append(now)
            start = len(now)
            while start and sum(map(count, now[start - 1 :])) <= min(overlap, size - count(s)):
                start -= 1
            now = now[start:]
        now = [*now, s]
    return [(" ".join(x), sum(map(count, x))) for x in [*out, *([now] if now else [])]]


def test_chunks(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "Übergröße", "naïve", "x1", "don't", "12,345", "(so)"]
    prose = [" ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) + rng.choice(".!?") + rng.choice(["", "", "\n"]) for _ in range(200)) for _ in range(4)]
    long = ["w" * 5000 + " " + "many words without an end " * 100, None, "", " . "]
    encoder = Encoder(RANKS)
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate([*prose, *long])], "doc_id string, text string")
    rows = corpus.pack_tokens(docs, 64, 16, vocabulary(spark, RANKS)).collect()
    for i, t in enumerate(prose):
        got = [(r["chunk"], r["tokens"]) for r in sorted(rows, key=lambda r: r["ord"]) if r["doc_id"] == f"d{i}"]
        assert got == brute(t, 64, 16, lambda s: encoder.count(" " + s))
        assert all(encoder.count(" " + c) == n <= 64 for c, n in got)
    assert all(encoder.count(" " + r["chunk"]) == r["tokens"] <= 64 for r in rows)
    assert "".join(r["chunk"].replace(" ", "") for r in sorted(rows, key=lambda r: r["ord"]) if r["doc_id"] == "d4").count("w" * 5000) == 1
