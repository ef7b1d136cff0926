"""Ids of archives that are text, edges of discovered spans, and contexts with very long words."""

import pytest

from lexloom.llm import pii
from lexloom.llm import warc_zip as Z


@pytest.mark.parametrize("kind", ["string", "int", "date"])
def test_archives_keep_the_type_of_ids(spark, kind):
    ids = {"string": ["a/b <c>", "", "null", "é%20", None, "10", "9"], "int": [3, -1, 7, 8, None, 10, 9], "date": ["2024-01-0%d" % i for i in range(1, 7)] + [None]}[kind]
    html = ["same", "same", "other", None, "x", "same", ""]
    df = spark.createDataFrame([(i, f"http://h/{k}", h) for k, (i, h) in enumerate(zip(ids, html, strict=True))], "page_id string, url string, html string")
    pages = df.withColumn("page_id", df["page_id"].cast(kind))
    rows = Z.round_trip(pages)
    assert dict(rows.dtypes)["page_id"] == dict(rows.dtypes)["refers_to"] == kind
    of = {i: h for i, h in zip([r["page_id"] for r in pages.collect()], html, strict=True)}
    got = {r["page_id"]: r for r in rows.collect()}
    assert set(got) == set(of) and len(got) == 7
    for i, h in of.items():
        first = min((j for j, x in of.items() if (x or "") == (h or "") and j is not None), default=None)
        assert got[i]["payload_digest"] == Z.base32_sha1((h or "").encode())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if i == first or first is None else ("revisit", first))


def test_spans_end_before_marks(spark):
    known = [f"please write to user{i}@mail{i}.org about it" for i in range(6)]
    hard = ["please write to <anna@intranet>, about it", "x" * 300 + " please write to bob@intranet. about it", "q " + "w" * 400 + " write to “carl@lan” about it", "please write to dan@lan about" + "z" * 300]
    docs = spark.createDataFrame(list(enumerate(known + hard)), "doc_id long, text string")
    found = {r["doc_id"]: [hard[r["doc_id"] - 6][int(a) : int(b)] for _, a, b in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.find_spans(docs).where("doc_id >= 6").collect()}
    assert found == {6: ["anna@intranet"], 7: ["bob@intranet"], 8: ["carl@lan"], 9: ["dan@lan"]}
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}[6] == "please write to <[EMAIL]>, about it"


def test_context_words_are_whole(spark):
    text = "a" * 500 + " b " + "c" * 700 + " seed@mail.org " + "d" * 400 + " e"
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "text string").select(F.explode(pii.occurrences(F.col("text"), pii.FORMS["email"])).alias("o")).first()["o"]
    assert (row["l1"], row["l2"], row["n1"]) == ("c" * 700, "b", "d" * 400)
