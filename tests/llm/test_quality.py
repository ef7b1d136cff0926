"""Quality rules and the weak-label classifier."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import quality_rules as Q
from lexloom.llm import weak_quality as W

from .conftest import ODD


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_of_odd_texts(spark, frame):
    texts = [*ODD, "a b c a b c", "a b a b a b", "x\nx\ny\n\n \n", "#$%", "a a a a"]
    rows = {r["doc_id"]: r for r in Q.annotate_quality(frame(texts)).collect()}
    assert {i: tuple(rows[i][c] for c in COLUMNS) for i in rows} == {i: brute(t) for i, t in enumerate(texts, 1)}
    assert all(not r["kept"] for r in rows.values() if r["base_failed"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n#é", max_size=60), min_size=1, max_size=6))
def test_counts_of_any_text(spark, frame, texts):
    rows = {r["doc_id"]: r for r in Q.annotate_quality(frame(texts), rules=()).collect()}
    assert {i: tuple(rows[i][c] for c in COLUMNS) for i in rows} == {i: brute(t) for i, t in enumerate(texts, 1)}


def test_shortened_hashes_that_collide_fall_back(spark, monkeypatch):
    monkeypatch.setattr(Q, "_LOW", 60)  # 4 bits of hash: windows get mixed up
    texts = [" ".join(f"w{i}" for i in range(200)), "p q r s " * 20]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(Q.let(Q.words(F.col("text")), lambda w: Q.n_repeat_words(w))).collect()]
    assert got == [brute(t)[4] for t in texts]


def test_filter_keeps_prose_and_columns(spark, frame):
    looped = "\n".join(" ".join("abcdefghij"[(i * 7 + k * 3) % 10] * 2 + "xyz"[k % 3] + "klmnop"[(i + k) % 6] for k in range(9)) + "." for i in range(12))
    n, *_, repeated = brute(looped)
    assert 100 * repeated > 50 * n  # its lines come back shifted, so the base rule rejects it
    prose = "\n".join(" ".join("abcdefghij"[i] + "".join("klmnopqrst"[int(c)] for c in str(100 + 9 * i + k)) for k in range(9)) + "." for i in range(10))
    assert brute(prose)[4] == 0
    docs = frame([prose, prose.upper().replace(".", "!!"), "| ".join(f"cell{i}" for i in range(90)), "again " * 90, None, looped])
    kept = Q.filter_quality(docs)
    assert kept.columns == docs.columns
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_order_is_by_rejections_per_second(spark, frame):
    docs = frame(["abc def ghi"] * 50)
    ordered = Q.order_rules(docs)
    assert [x[2] / x[1] for x in ordered] == sorted((x[2] / x[1] for x in ordered), reverse=True)
    assert ordered[0][0].name == "too_few_words" and ordered[0][2] == 1.0
    rows = Q.report_order(docs).orderBy("place").collect()
    assert rows[0]["rule"] == "too_few_words" and {r["rule"] for r in rows} == {r.name for r in Q.RULES} and all(r["seconds"] > 0 for r in rows)


def test_empty_tables(spark, frame):
    none = frame(["x"]).where("doc_id < 0")
    assert Q.annotate_quality(none).count() == Q.filter_quality(none).count() == W.classify(none).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.8
    right = [0.95, 0.8, 0.7, 0.9]
    votes = np.stack([np.where(rng.random(len(y)) < 0.3, W.NONE, np.where(rng.random(len(y)) < r, y, ~y).astype(int)) for r in right], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, rate, _ = W.fit_labellers(patterns, counts)
    assert share == pytest.approx(0.8, abs=0.04)
    assert [rate[1, j, 2] / (rate[1, j, 1] + rate[1, j, 2]) for j in range(4)] == pytest.approx(right, abs=0.05)


def test_classifier_on_odd_texts(spark, frame):
    rows = W.classify(frame([*ODD, None, None])).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)


def test_classifier_against_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = W.classify(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) / len(good) > 0.95
    assert sum(not r["kept"] for r in rows if r["quality"] == 0) > 0.5 * sum(r["quality"] == 0 for r in rows)


def brute_votes(text):
    """The labellers' votes and the dense features, by plain Python."""
    import regex

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = max(len(w), 1)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols, upper = len(re.findall(r"[#*$%&|<>]", text)) / n, len(regex.findall(r"\p{Lu}", text)) / n
    ends, mean = len(re.findall(r"[.!?][ \t\n\x0b\f\r\"')]", text)) / n, len(text) / n
    distinct, same = len(set(w)) / n, (len(lines) - len(set(lines))) / max(len(lines), 1)
    prose = symbols < 0.05 and upper < 0.5
    vote = lambda good, bad: W.BAD if bad else W.GOOD if good else W.NONE
    cast = [
        vote(False, symbols > 0.2),
        vote(False, upper > 1.2 and len(w) >= 5),
        vote(False, (distinct < 0.2 and 20 <= len(w) < 2000) or distinct < 0.05),
        vote(False, same > 0.5),
        vote(3 <= mean <= 12, not 2 <= mean <= 20 and len(w) >= 5),
        vote(0.01 <= ends <= 0.5 or len(w) < 20, ends < 0.002 and len(w) >= 50),
        vote(prose, not prose and ends < 0.01 and len(w) >= 20),
    ]
    return cast, [symbols, upper, distinct, same]


def test_classifier_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    own = {i: brute_votes(t) for i, t in texts.items()}
    patterns, at, counts = np.unique([v for v, _ in own.values()], axis=0, return_inverse=True, return_counts=True)
    _, _, post = W.fit_labellers(patterns, counts)
    weak = dict(zip(own, post[at.ravel()], strict=True))
    x = np.stack([W.features(texts[i] or "", own[i][1]).astype(np.float16) for i in own]).astype(np.float32)
    w, bias = W.fit_scorer(x, np.array([weak[i] for i in own]))
    rows = {r["doc_id"]: r for r in W.classify(docs).collect()}
    assert len(rows) == len(texts)
    for k, i in enumerate(own):
        assert rows[i]["weak_label"] == pytest.approx(weak[i], abs=1e-4)
        assert rows[i]["score"] == pytest.approx(1 / (1 + np.exp(-float(x[k] @ w + bias))), abs=0.02)
        assert rows[i]["kept"] == (rows[i]["score"] >= 0.5)


def test_equal_texts_get_equal_scores(spark, frame):
    rows = W.classify(frame(["Some plain words here. And more of them."] * 3 + ["# | #"] * 3)).collect()
    assert len({round(r["score"], 9) for r in rows}) <= 2
