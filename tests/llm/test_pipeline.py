"""The pipeline against the stages' own brute-force versions, and the registered queries."""

import re

import corpus_pipeline as P
import pytest

from lexloom.llm import decontaminate as D
from lexloom.llm import mixing
from lexloom.llm import pii
from lexloom.llm import queries

from .conftest import ODD
from .test_dedup_mix import brute as components
from .test_quality import brute as counts
from .test_text_ops import levenshtein_infix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    word = lambda i, k: "abcdefghij"[(i * 7 + k * 3) % 10] * 2 + "xyz"[k % 3] + "klmnop"[(i + k) % 6] + str(i * k % 89)
    prose = ["\n".join(" ".join(word(i * 13 + j, k) for k in range(9)) + "." for j in range(14)) for i in range(12)]
    item = "the benchmark asks which river runs through the old town of the northern province"
    texts = [
        *prose,
        prose[0],
        prose[1].replace(prose[1].split()[3], "changed", 1),
        prose[2] + "\n" + item.replace("river", "rivers") + " " + prose[3][:60],
        prose[4] + "\nwrite to someone@mail.example.org or call +1 (555) 010-2030",
        prose[5].upper(),
        "# | " * 90,
        *ODD,
    ]
    rows = [(i, t, "en", "abc"[i % 3], None if t is None else len(t)) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(enumerate(texts, 1)), item


def test_stages(spark, corpus):
    folder, texts, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, seen = set(texts), {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS
        rows = {r["doc_id"]: r for r in docs.collect()}
        if name == "quality_rules":
            kept = {i for i in kept if counts(texts[i])[0] >= 50 and 2 * counts(texts[i])[4] <= counts(texts[i])[0]} - {17, 18}
        elif name == "near_dedup":
            kept = {i for i, (_, c) in components({i: texts[i] for i in kept}, 80).items() if i == c}
        elif name == "decontamination":
            kept = {i for i in kept if levenshtein_infix(item, D.normalise(texts[i])) > D.allowed(len(item), 0.1)}
        assert set(rows) == kept
        seen[name] = rows
    texts[16] = re.sub(r"\+1 \(555\) 010-2030", "[PHONE]", texts[16].replace("someone@mail.example.org", "[EMAIL]"))
    assert {i: r["text"] for i, r in seen["pii"].items()} == {i: texts[i] for i in kept}
    assert all(r["n_chars"] == len(r["text"]) for r in seen["pii"].values())
    mixed = P.run(spark, folder).collect()
    assert {r["doc_id"] for r in mixed} == kept
    assert sum(r["taken"] for r in mixed) > 0


def test_stages_of_nothing(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "mix"]
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_native_plans(spark, corpus, monkeypatch):
    """No Python in the plans of the operators that are to be native, from the tables on."""
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for module in (pii, mixing):
        monkeypatch.setattr(module, "cut", lambda df: df)
    for df in (queries.op8_quality_rules(spark, folder), pii._seen(docs), pii.find_spans(docs), pii.redact(docs), queries.op10_mix_sources(spark, folder)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
