"""The core library on small literal frames."""

import html
import json
import random
import re
import shutil
import subprocess
import sys
from collections import deque
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexloom.functions import references as R
from lexloom.functions import text as T
from lexloom.operators import chat, corpus, evaluation, retrieval
from lexloom.plans import catalog, extended  # noqa: F401
from lexloom.sources import readers, settings
from lexloom.streaming import limiter


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


def test_markdown(spark):
    raw = "# Title\r\n\r\n**bold** and _soft_\n> quoted\n[link](http://x) [^1]\n\n\n\nNO. 12.\nVolume IV\n<b>tag</b> done\n"
    assert one(spark, T.clean_markdown(F.col("t")), t=raw) == "Title\n\nbold and soft\nquoted\nlink \n\n\n\n\ntag done".replace("\n\n\n\n\n", "\n\n")


def test_footer_only_in_the_last_lines(spark):
    body = "\n".join(f"line {i}" for i in range(40))
    assert one(spark, T.drop_footer(F.col("t")), t=body + "\nHymns from the book\nmore") == body
    early = "Hymns from the book\n" + body
    assert one(spark, T.drop_footer(F.col("t")), t=early) == early
    kept = body + "\npray the Holy Spirit to bring"
    assert one(spark, T.drop_footer(F.col("t")), t=kept) == kept


def test_unescape(spark):
    assert one(spark, T.unescape("t"), t="a &amp; b &copy;") == html.unescape("a &amp; b &copy;")


@pytest.mark.parametrize("name", ["strip_html", "clean_markdown"])
def test_references_without_a_semicolon_stay(spark, tmp_path, name):
    pages = ["<p>A &amp; B &ampp{x} &amp&lt;b&gt; &amp;copy; &copy 1 &middot;</p>", "x &amp;lt;b&gt; &#38; &nbsp;&quot;", None, ""]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, html varchar)")
    con.executemany("insert into pages values (?, ?)", [list(row) for row in enumerate(pages)])
    got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.SQL[name]).fetchall())


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Rom. 8:28-30 and Rom. 8:28-30", ["Romans 8:28-30"]),
        ("see 1 John 3:16, Psalm 23", ["1 John 3:16", "Psalms 23"]),
        ("Song of Solomon 2 and Job 1000", ["Song of Solomon 2", "Job 100"]),
        ("Ps 1:2–4", ["Psalms 1:2-4"]),
        ("nothing", []),
    ],
)
def test_references(spark, text, found):
    assert one(spark, R.extract_references(F.col("t")), t=text) == found


def test_reference_parts(spark):
    assert tuple(one(spark, R.parse_reference(F.col("t")), t="1 John 3:16-18")) == ("1 John", 3, 16, 18)
    assert one(spark, R.parse_reference(F.col("t")), t="none") is None
    assert one(spark, R.normalize_book(F.col("t")), t="1 Cor.") == "1 Corinthians"
    assert one(spark, R.primary_reference(F.col("t")), t="Title\nTEXT: Rom. 8:28\nand John 3:16") == "Romans 8:28"
    assert one(spark, R.refers_to(F.split("t", ";"), "Romans", 8, 29), t="Romans 8:28-30;John 1") is True


def test_language(spark):
    assert [one(spark, T.language(F.col("t")), t=t) for t in ("como vai", "como deus", "hello")] == ["en", "pt", "en"]


def test_fences_and_prefixes(spark):
    assert one(spark, T.strip_fences(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.strip_prefixes(F.col("t")), t="Assistant: resposta: yes") == "yes"
    assert one(spark, chat.parse_pairs(F.col("t")), t='{"question": "q", "answer": "a"}')[0]["answer"] == "a"
    assert one(spark, chat.parse_pairs(F.col("t")), t="broken {") is None or one(spark, chat.parse_pairs(F.col("t")), t="broken {") == []


def brute_windows(text, size, step, least, tail):
    return [(i, c) for i, s in enumerate(range(0, len(text) - tail, step)) if len(c := text[s : s + size].strip()) >= least]


@pytest.mark.parametrize("n", [0, 399, 400, 401, 800, 801, 1200, 1601])
def test_windows(spark, n):
    text = ("word " * 400)[:n]
    rows = corpus.windows(spark.createDataFrame([(1, text)], "doc_id int, text string"), 1200, 800, 400, 400).collect()
    assert sorted((r["ord"], r["chunk"]) for r in rows) == brute_windows(text, 1200, 800, 400, 400)


def brute_pack(text, size=1200, least=400, most=3):
    cur, out = "", []
    for s in re.split(r"(?<=[.!?])\s+", text):
        if len(out) >= most:
            break
        if len(cur) + len(s) > size and len(cur) > least:
            out.append(cur)
            cur = s
        else:
            cur = f"{cur} {s}" if cur else s
    if len(out) < most and len(cur) > least:
        out.append(cur)
    return out


def test_sentence_pack(spark):
    texts = ["", "Short.", ("A sentence of some length here. " * 80).strip(), "x" * 1500 + ". " + "Tail words. " * 50]
    rows = corpus.pack_sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for i, t in enumerate(texts):
        assert [r["chunk"] for r in sorted(rows, key=lambda r: r["ord"]) if r["doc_id"] == i] == brute_pack(t)


def test_first_wins_shadows(spark):
    docs = spark.createDataFrame([(2, "a" * 300 + "long"), (1, "a" * 300), (3, "b")], "doc_id int, text string")
    kept = corpus.first_wins(docs, corpus.fingerprint(F.col("text")), "doc_id")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_split_is_exact(spark):
    df = spark.range(1003).withColumnRenamed("id", "doc_id")
    counts = {r["split"]: r["count"] for r in corpus.split(df, "doc_id", 0.05).groupBy("split").count().collect()}
    assert counts == {"test": 51, "train": 952}


def test_filters(spark):
    rows = spark.createDataFrame([(1, 5, ["Romans 8:28"], None), (2, 6, ["John 1"], 1860), (3, 7, [], 1900)], "vec_id int, volume int, references array<string>, year int")
    ids = lambda c: [r["vec_id"] for r in rows.where(c).collect()]
    assert ids(retrieval.metadata_filter(volumes=[5, 6])) == [1, 2]
    assert ids(retrieval.metadata_filter(volumes=[5, 6], strict_and=True)) == []
    assert ids(retrieval.metadata_filter(book="Romans")) == [1]
    assert retrieval.metadata_filter() is None
    assert ids(retrieval.in_years(F.col("year"), 1855, 1892)) == [1, 2]
    assert one(spark, retrieval.parse_numbers(F.col("t")), t="42, 100,") == [42, 100]
    assert one(spark, retrieval.parse_numbers(F.col("t")), t="42, x") is None


def test_scores(spark):
    rows = [(1, "x", 0.0), (2, "x", 3.0), (3, "x", 2.0)]
    a = spark.createDataFrame(rows, "id int, c string, score double")
    b = spark.createDataFrame([(1, "x", 0.0999), (2, "x", 3.25), (3, "x", 1.0)], "id int, c string, score double")
    r = evaluation.compare(a, b, "id", "c").first()
    assert (r["wins"], r["losses"], r["ties"], r["mean_a"]) == (1, 1, 1, 2.5)
    null = spark.createDataFrame([(1, "x", None)], "id int, c string, score double")
    assert evaluation.compare(null, null, "id", "c").first()["delta"] is None


def test_citations(spark):
    cite = lambda whole: evaluation.has_citations(F.col("t"), F.array(F.lit(1)), "Sermon", whole)
    assert one(spark, cite(False), t="Sermon 12") is True
    assert one(spark, cite(True), t="Sermon 12") is False


def test_limiter(spark):
    at = [0, 1, 2, 3, 4, 5, 6, 7, 8, 3600, 3601, 3602]
    rows = [(i, 1, datetime.fromtimestamp(t, timezone.utc)) for i, t in enumerate(at)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    log, want = deque(), []
    for t in at:
        while log and log[0] <= t - 3600:
            log.popleft()
        want.append(len(log) < 8)
        if want[-1]:
            log.append(t)
    got = {r["event_id"]: r["allowed"] for r in limiter.admit(events).collect()}
    assert [got[i] for i in range(len(at))] == want
    used = {r["event_id"]: r["used"] for r in limiter.usage(events).collect()}
    assert used[9] == 10


def test_limiter_stream(spark, tmp_path):
    rows = [(i, i % 2, datetime.fromtimestamp(10**6 + i, timezone.utc)) for i in range(30)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = limiter.admit_stream(stream).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["event_id"], r["allowed"]) for r in spark.table("admitted").collect()}
    assert got == {(r["event_id"], r["allowed"]) for r in limiter.admit(events).collect()}


def test_readers(spark, tmp_path):
    (tmp_path / "c/volume-3").mkdir(parents=True)
    (tmp_path / "c/volume-3/sermon-39.md").write_text("# Sermon 39 & 40 | A Title\nin 1861\nText: John 3:16\n")
    (tmp_path / "c/README.md").write_text("no")
    (tmp_path / "c/volume-10").mkdir()
    (tmp_path / "c/volume-10/sermon_7.md").write_text("no heading")
    names = lambda **how: [r["stem"] for r in readers.markdown_files(spark, str(tmp_path / "c"), **how).collect()]
    assert names(limit=5) == ["sermon-39", "sermon_7"] and names(limit=1) == ["sermon-39"] and names(folders=r"volume-\d\d") == ["sermon_7"]
    docs = readers.parse_documents(readers.markdown_files(spark, str(tmp_path / "c"), folders="volume-3"), url="u/{volume}/{number}").collect()
    assert docs[0]["source_url"] == "u/3/39" and docs[0]["raw_url"] == ""
    assert [(d["number"], d["title"], d["volume"], d["year"], d["reference"], d["book"]) for d in docs] == [(39, "A Title", 3, 1861, "John 3:16", "John")]
    texts = spark.createDataFrame([("a" * 300,), ("b" * 250 + "\nline",), ("short",)], "text string")
    readers.write_delimited(texts, str(tmp_path / "d"))
    assert sorted(r["text"] for r in readers.read_delimited(spark, str(tmp_path / "d")).collect()) == sorted(["a" * 300, "b" * 250 + "\nline"])
    good = {"messages": [{"role": "user", "content": "q"}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\nbroken\n" + json.dumps({"messages": [{"role": "system", "content": "s"}]}) + "\n")
    (tmp_path / "b.jsonl").write_text(json.dumps(good) + "\n")
    chats = readers.read_chat(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "missing.jsonl"), str(tmp_path / "b.jsonl"))
    assert chat.merge(chats, "file", "block", "line").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        readers.read_chat(spark, str(tmp_path / "missing.jsonl"), strict=True).count()


def test_templates(spark):
    messages = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("user", "q"), ("tool", "t"), ("assistant", "a"))])
    assert one(spark, chat.role_tags(messages), t="") == "<|user|>\nq\n<|assistant|>\na\n<|assistant|>\n"
    assert one(spark, chat.first_of_role(messages), t="") == "q"


def test_split_keeps_null_keys(spark):
    df = spark.createDataFrame([(None,), (None,), *[(i,) for i in range(98)]], "doc_id long")
    for floor in (False, True):
        assert corpus.split(df, "doc_id", 0.05, floor_train=floor).groupBy("split").count().where("split = 'test'").first()["count"] == 5
    assert corpus.split(df.limit(3), "doc_id", 0.5, floor_train=True).where("split = 'train'").count() == 1


def brute_tokens(text, size, overlap):
    runs = []
    for s in re.split(r"(?<=[.!?])\s+", text):
        w = s.split()
        runs += [w[i : i + size] for i in range(0, len(w), size)]
    out, cur = [], []
    for r in runs:
        if cur and sum(map(len, cur)) + len(r) > size:
            out.append(" ".join(w for x in cur for w in x))
            room, kept = min(overlap, size - len(r)), []
            for x in reversed(cur):
                if len(x) > room:
                    break
                kept.insert(0, x)
                room -= len(x)
            cur = kept
        cur = [*cur, r]
    return out + ([" ".join(w for x in cur for w in x)] if cur else [])


@pytest.mark.parametrize(("size", "overlap"), [(20, 6), (7, 0), (768, 128)])
def test_pack_tokens(spark, size, overlap):
    r = random.Random(size)
    texts = ["", "One.", "a b c", " ".join("w" * r.randrange(1, 4) + r.choice(["", "", "", ".", "!"]) for _ in range(3000)), "x " * 50]
    rows = corpus.pack_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), size, overlap).collect()
    for i, t in enumerate(texts):
        assert [x["chunk"] for x in sorted(rows, key=lambda x: x["ord"]) if x["doc_id"] == i] == brute_tokens(t, size, overlap)


def test_limiter_cuts_stretches(spark):
    r = random.Random(5)
    rows, t = [], 0.0
    for i in range(600):
        t += r.choice([1, 200, 900, 3599, 3600, 3601, 9000])
        rows.append((i, r.choice([1, 1, 1, 2, None]), datetime.fromtimestamp(t, timezone.utc)))
    got = {x["event_id"]: (x["allowed"], x["used"]) for x in limiter.admit(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), limit=3).collect()}
    logs, want = {}, {}
    for i, user, ts in rows:
        log = logs.setdefault(user, deque())
        while log and log[0] <= ts.timestamp() - 3600:
            log.popleft()
        want[i] = (len(log) < 3, len(log))
        if len(log) < 3:
            log.append(ts.timestamp())
    assert got == want
    used = {x["event_id"]: x["used"] for x in limiter.usage(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")).collect()}
    assert used == {i: sum(u == v and 0 <= (b - a).total_seconds() <= 3600 for _, v, a in rows) for i, u, b in rows}


def test_several_queries_are_an_error(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<float>")
    with pytest.raises(Exception, match="one query"):
        retrieval.top_k(e, e.select(F.col("embedding").alias("q")), 1).collect()


def test_headers(spark):
    row = spark.createDataFrame([(1, 5, "T", 3, "John 3:16", " body "), (1, None, None, None, None, "b")], "g int, number int, title string, volume int, reference string, text string")
    rows = row.withColumn("r", F.coalesce("number", F.lit(9)))
    made = lambda **how: retrieval.context_blocks(rows, "g", "r", **how).first()["context"]
    assert made() == '[Document 5 — "T", Volume 3 | Text: John 3:16]\nbody\n\n\n[Document ? — "Untitled"]\nb\n'
    assert made(header=retrieval.EVALUATION_HEADER, tail="") == '[Document 5 — "T", Vol. 3 | John 3:16]\nbody\n\n[Document ? — ""]\nb'
    assert made(header=retrieval.SAMPLE_HEADER, tail="") == '[Document 5 — "T"]\nbody\n\n[Document ? — ""]\nb'


def test_small_readers_and_sinks(spark, tmp_path):
    (tmp_path / "q.txt").write_text(" one \n\n two\nthree\n")
    assert [tuple(r) for r in readers.read_lines(spark, str(tmp_path / "q.txt"), 2).collect()] == [(1, "one"), (2, "two")]
    assert [r["text"] for r in readers.repeat_list(spark, ["a", "b"], 5).orderBy("line").collect()] == list("ababa")
    path, schema = str(tmp_path / "v"), "id int, volume int, embedding array<float>"
    assert readers.open_vectors(spark, path, schema).count() == 0
    chunks = spark.createDataFrame([(1, 2, [1.0]), (2, 1, [0.0])], schema)
    readers.write_vectors(chunks, path)
    readers.write_vectors(chunks, path)
    assert readers.open_vectors(spark, path, schema).count() == 4
    readers.write_vectors(chunks, path, recreate=True)
    assert readers.open_vectors(spark, path, schema).count() == 2
    readers.write_splits(corpus.split(spark.range(10).withColumnRenamed("id", "doc_id"), "doc_id", 0.2), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/split=test")).count() == 2
    doc = json.loads(readers.result_document(chunks.select("id", "volume"), "id", [F.sum("volume").alias("volumes")], model="m").first()["document"])
    assert doc == {"model": "m", "total": 2, "volumes": 3, "results": [{"id": 1, "volume": 2}, {"id": 2, "volume": 1}]}
    page = "12\nTHE GOOD OLD WAY HOME\nA WORD DELIVERED ON SABBATH MORNING, JUNE 3, 1860, on John 3:16"
    found = readers.parse_printed(spark.createDataFrame([("x/chs12.pdf", page)], "path string, raw_text string")).first()
    assert (found["number"], found["reference"]) == (12, "John 3:16")


def test_settings(tmp_path):
    assert settings.from_environment(environ={"LEXLOOM_TOP_K": "4", "LEXLOOM_LANGUAGE": "", "OTHER": "x"}) == settings.Settings(top_k=4)
    (tmp_path / "s.json").write_text('{"chunk_words": 600, "unknown": 1}')
    assert settings.from_json(str(tmp_path / "s.json")).chunk_words == 600


def test_parse_by_suffix(spark):
    rows = [("a/volume-1/sermon-3.md", 1, "sermon-3", "# Sermon 3 | T\nJohn 3:16"), ("x/p12.txt", None, "p12", "THE GOOD OLD WAY HOME\nRom. 8:28"), ("x/y.bin", None, "y", "z")]
    got = readers.parse_by_suffix(spark.createDataFrame(rows, "path string, volume int, stem string, raw_text string")).collect()
    assert sorted((r["number"], r["reference"]) for r in got) == [(3, "John 3:16"), (12, "Romans 8:28")]


def test_stream_into_writes_each_batch_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        readers.stream_into(spark, str(tmp_path / "in"), "id long", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_memory_stream_equals_batch(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}", (c + t) % 4 > 0) for c in range(6) for t in range(6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, ok boolean")
    turns.write.parquet(str(tmp_path / "in"))
    stream = chat.remember_stream(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("memory_of_chats").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    want = {(r["conv_id"], r["turn"]) for r in chat.remember(turns, F.col("ok")).collect()}
    assert {(r["conv_id"], r["turn"]) for r in spark.table("memory_of_chats").collect()} == want


def test_entry_without_the_llm_folders(tmp_path):
    root = Path(__file__).parents[1]
    for name in ("lexloom", "__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        source = root / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert 'reference_list' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["corpus_inventory", "build_corpus", "chunk_600_300", "topk_postfilter", "knn_label_vote", "chat_render", "split_95_5", "ab_compare", "clean_markdown", "sentence_pack", "rate_limiter", "reference_list", "retrieve_sources", "grounded_records", "judge_scores", "corpus_outcomes", "conversation_memory", "inventory_table", "anomaly_order"])
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels", "pages", "events", "orders"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(catalog.SQL[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_pushdown(spark):
    plan = catalog.topk_filtered(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(label, [0,1,2])" in plan and "Python" not in plan
