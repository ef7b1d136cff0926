"""Null and repeated ids, clashing columns, ties and hostile inputs."""

import io
import random
import struct
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lexloom.llm import decontaminate as D
from lexloom.llm import html_text as H
from lexloom.llm import langid as L
from lexloom.llm import minhash as M
from lexloom.llm import mixing as X
from lexloom.llm import pii as P
from lexloom.llm import toxicity as T
from lexloom.llm import warc_zip as Z

from .test_dedup_mix import mutated, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, r1 int, spans int, doc string, `group` int, rep int"


def rows_of(pairs):
    return [(i, t, "en", "s", None if t is None else len(t), "x", 1, 2, "y", 3, 4) for i, t in pairs]


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(11)
    words = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = [" ".join(words), mutated(words, 1, rng), " ".join(reversed(words)), "a b c d e f", None, ""]
    pairs = [(1, texts[0]), (1, texts[0]), (1, texts[2]), (2, texts[1]), (None, texts[0]), (None, texts[3]), (None, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[5]), (9, texts[2])]
    docs = spark.createDataFrame(rows_of(pairs), SCHEMA)
    kept = M.drop_near_duplicates(docs, percent=80)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    assert got == sorted([(1, texts[0]), (1, texts[2]), (0, texts[3]), (7, ""), (7, ""), (8, "")])
    assert all(r["row"] == "x" and r["spans"] == 2 for r in kept.collect())
    found = M.near_duplicates(docs).collect()
    assert len(found) == len(pairs) and {(r["doc_id"], r["component_id"]) for r in found if r["n_shingles"]} == {(1, 1), (2, 1), (None, 1), (None, None), (9, 1)}


def test_links_in_open_buckets(spark, frame):
    """Groups whose members link to each other but hardly to a pivot; brute force by rows."""
    rng = random.Random(12)
    base = [f"v{rng.randrange(4000)}" for _ in range(150)]
    texts = []
    for g in range(12):
        own = mutated(base, 6, random.Random(g)).split()
        texts += [mutated(own, k % 3, rng) for k in range(8)]
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    rows = M.near_duplicates(frame(texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i + 1: find(i) + 1 for i in range(len(texts))}


def test_mix_of_null_and_repeated_ids(spark):
    rng = random.Random(13)
    rows = [(rng.choice([None, 5, i]), " ".join(["w"] * rng.randrange(1, 50)), rng.choice(["a", "b", None])) for i in range(600)]
    rows += [(5, "same text here", "a")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tie", F.lit(1)).withColumn("key", F.lit("k"))
    taken = lambda df: sorted((r["doc_id"] or 0, r["source"] or "", r["size"], r["taken"]) for r in X.mix_sources(df).collect())
    first = taken(docs)
    assert len(first) == len(rows) and taken(docs.repartition(7)) == taken(docs.repartition(3, "text")) == first


def test_mix_cuts_even_ranges(spark):
    """Ranges hold alike many rows whatever the weights and however many rows a source has."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a # b # c #").otherwise("a b c d").alias("text"), F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("source"))
    key = X.sort_key("mix", F.col("doc_id"), F.col("text"), X.quality_weight(F.col("text"), F.lit(6)))
    dealt = docs.select("source", key.alias("key")).repartitionByRange(16, "source", "key").groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in dealt.collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * sorted(sizes)[8]


ITEM = "which river runs through the old town of the northern province and how long is it"


@pytest.mark.parametrize("kind", ["long", "string"])
def test_decontamination_judges_rows(spark, kind):
    clean, dirty = "nothing of the sort is said here at all", f"before {ITEM.replace('river', 'rivers')} after"
    docs = spark.createDataFrame(rows_of([(1, clean), (1, dirty), (None, dirty), (None, clean), (2, None)]), SCHEMA)
    bench = spark.createDataFrame([(7, ITEM), (None, ITEM), (8, None), (9, " ")], "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, clean), (1, clean), (2, "")]
    found = D.find_items(docs, bench).collect()
    seven = 7 if kind == "long" else "7"
    assert sorted(((r["doc_id"], r["item_id"]) for r in found), key=repr) == sorted([(1, seven), (None, seven), (1, None), (None, None)], key=repr)
    assert D.find_items(docs, bench.where("item_id < '0'")).count() == 0


def test_blocks_by_characters(spark):
    docs = spark.createDataFrame(rows_of([(i, f"a {ITEM} {i} b") for i in range(6)]), SCHEMA)
    bench = spark.createDataFrame([(i, f"{ITEM} {i}") for i in range(6)], "item_id long, text string")
    one, many = (D.find_items(docs, bench, characters=c).collect() for c in (10**6, 100))
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 36
    assert D.drop_contaminated(docs, bench, characters=100).count() == 0


def test_items_without_or_with_odd_ids(spark):
    docs = spark.createDataFrame(rows_of([(i, f"a {ITEM} {i} b") for i in range(3)]), SCHEMA)
    bench = spark.createDataFrame([(None, f"{ITEM} 1"), (None, None), (None, " ")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.find_items(docs, bench).collect()} == {(i, None) for i in range(3)}
    assert D.drop_contaminated(docs, bench).count() == 0
    odd = spark.createDataFrame([({"a": 1}, f"{ITEM} 1"), ({"a": 1}, f"{ITEM} 1")], "item_id map<string,int>, text string")
    assert D.drop_contaminated(docs, odd).count() == 0


def test_recall_on_the_tables(spark):
    """All items against all documents whose id is divisible by 50, by exact distance."""
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 50 = 0"), spark.read.parquet(f"{d}/benchmark.parquet")
    items = [(r["item_id"], D.normalise(r["text"])) for r in bench.collect()]
    want = {
        (r["doc_id"], i) for r in docs.collect() for i, t in items
        if t and D.infix_distance(t, D.normalise(r["text"]))[0] <= D.allowed(len(t), 0.1)
    }
    got = {(r["doc_id"], r["item_id"]) for r in D.find_items(docs, bench).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_redaction_with_clashing_columns(spark):
    docs = spark.createDataFrame(rows_of([(1, "mail a@b.cc now"), (1, "other"), (None, "1.2.3.4 here"), (None, None)]), SCHEMA)
    out = P.redact(docs)
    assert out.columns == docs.columns
    rows = {(r["doc_id"], r["n_chars"]): r for r in out.collect()}
    assert {r["text"] for r in rows.values()} == {"mail [EMAIL] now", "other", "[IP] here", None}
    assert all((r["row"], r["r1"], r["spans"], r["doc"]) == ("x", 1, 2, "y") for r in rows.values())


def test_addresses_without_digits_are_discovered(spark, frame):
    seeds = [f"Note {'x' * (i % 7)} please write to user{i}@mail.example.org about it" for i in range(30)]
    hidden = ["Later please write to anna@intranet about it", "Now please write to root@localhost about it"]
    rows = {r["doc_id"]: r for r in P.find_spans(frame(seeds + hidden)).collect()}
    for i, t in enumerate(hidden, 31):
        at = t.index(t.split("write to ")[1].split()[0])
        assert rows[i]["spans"] == f"email:{at}:{at + len(t.split('write to ')[1].split()[0])}" and rows[i]["n_email"] == 0


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(1, 1), (2, 0)], [(None, 1)]])
def test_toxic_labels_without_texts(spark, labelled):
    docs = spark.createDataFrame([(1, None), (2, None), (3, "some text")], "doc_id long, text string")
    rows = T.toxicity(docs, spark.createDataFrame(labelled, "doc_id long, toxic int")).collect()
    assert len(rows) == 3 and all(0 <= r["score"] < 0.5 for r in rows)


def test_languages_without_letters_and_rare_letters(spark):
    rare = "𠀀𠀁𠀂 𠀃𠀄"
    rows = [(i, "12345 678", "xx") for i in range(8)] + [(i, rare * 3, "zh") for i in range(10, 18)] + [(i, "plain words of a text", "en") for i in range(20, 28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs).collect()}
    assert {out[i] for i in range(8)} == {"und"} and {out[i] for i in range(10, 18)} == {"zh"} and {out[i] for i in range(20, 28)} == {"en"}
    assert len(L.trigrams(rare)) == 5 and not len(L.trigrams("\U0001f600 1"))


def test_zip_comments():
    for comment in (b"PK\x05\x06 in a comment, " + b"z" * 30, b"c" * 65_535, b"PK\x05\x06" * 16_000):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(zipfile.ZipInfo("m"), b"data")
            z.comment = comment
        raw = out.getvalue()
        at, n = Z.locate_members(io.BytesIO(raw), len(raw))["m"]
        assert raw[at : at + n] == b"data"
    with pytest.raises(ValueError):
        Z.locate_members(io.BytesIO(raw[:-1]), len(raw) - 1)
    assert struct.calcsize("<HII") == 10


def brute_keep(weight, window, surge):
    """By definition: from each surge point on, up to the first window without text."""
    ahead = [sum(weight[i : i + window]) for i in range(len(weight))]
    least = min(surge, max(1, max(ahead, default=0) // 2))
    kept = [False] * len(weight)
    for s in range(len(weight)):
        if weight[s] and ahead[s] >= least:
            for i in range(s, len(weight)):
                if not ahead[i]:
                    break
                kept[i] = weight[i] > 0
    return kept


def test_surge_and_dive_against_brute_force():
    rng = random.Random(14)
    for _ in range(500):
        weight = [rng.choice([0, 0, 0, 5, 20, 70, 300]) for _ in range(rng.randrange(30))]
        for window in (1, 3, 5):
            assert H.keep_lines(weight, window, 60) == brute_keep(weight, window, 60)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>Short page.</p>", "Short page."),
        ("<article><p>kept</p><svg/><p>too</p></article>", "kept\ntoo"),
        ("<article><p>kept</p><iframe/><p>too</p></article>", "kept\ntoo"),
        ("<article><object-view>in</object-view><p>too</p></article>", "in\ntoo"),
        ("<p>first of all</p><template><p>and all the rest</p>", "first of all\nand all the rest"),
        ("<main><ul><li>menu</li></ul><article><p>art</p></article><p>Copyright</p></main>", "art"),
        ("<article><p>A</p><article class='comment'><p>no</p></article></article>", "A"),
        ("<article><p>one<span hidden>no</span> two</p></article>", "one two"),
        ("<article><div class='side-by-side'><p>A</p></div><section id='comments-policy'><p>B</p></section></article>", "A\nB"),
        ("<p>a < b & c</p>", "a < b & c"),
    ],
)
def test_small_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("piece", ["<div>a", "<p>x", '<a "', '<a b="', "<svg ", "<template>", "<!--", "<article>x", "<iframe>x", "<b>", "< ", "&", "<select><option>", "</i>"])
def test_hostile_pages_take_linear_time(piece):
    began = time.perf_counter()
    H.main_text(piece * (1_000_000 // len(piece)) + "</select></i>")
    assert time.perf_counter() - began < 15
