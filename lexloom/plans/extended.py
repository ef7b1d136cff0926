"""Further registered queries: references, prompts, records, counters and memory, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import references as R
from lexloom.functions import text as T
from lexloom.functions import tokens
from lexloom.operators import chat, corpus, evaluation, generation, packing, retrieval
from lexloom.operators.ordinals import numbered
from lexloom.sources import settings
from lexloom.streaming import sessions

from .catalog import _BLANK_SQL, _hash_sql, _SCORE, query, read

_SPELLED = sorted(R._names().items())


def _sql_list(values) -> str:  # noqa: ANN001
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: What the texts of ``_citing`` refer to, by how they are made.
_CITED = f"""(SELECT k, r, CASE WHEN r = 'Romans 8:28' THEN [r] ELSE [r, 'Romans 8:28'] END AS refs, book, c, v, w FROM (
    SELECT *, book || ' ' || c || coalesce(':' || v, '') || coalesce('-' || w, '') AS r FROM (
        SELECT o_orderkey AS k, {_sql_list(b for _, b in _SPELLED)}[o_orderkey % {len(_SPELLED)} + 1] AS book, (o_custkey % 150 + 1)::INT AS c,
            CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 30 + 1)::INT END AS v, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 4 > 0 THEN (o_orderkey % 30 + 1 + o_orderkey % 4)::INT END AS w FROM orders)))"""


def _citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and a text that cites in one of all spellings and one of several sentences; every other text names another reference under a heading."""
    k, verse = F.col("o_orderkey"), (F.col("o_orderkey") % 30 + 1)
    spelled = F.element_at(F.array(*[F.lit(s.title()) for s, _ in _SPELLED]), (k % len(_SPELLED) + 1).cast("int"))
    dot = F.when(k % 3 == 0, F.lit(".")).otherwise(F.lit(""))
    verses = F.when(k % 5 > 0, F.concat(F.lit(":"), verse.cast("string"), F.when(k % 4 > 0, F.concat(F.lit("-"), (verse + k % 4).cast("string"))).otherwise(F.lit("")))).otherwise(F.lit(""))
    head = F.when(k % 2 == 0, F.lit("\nTEXT: JOHN 3:16\nand so on")).otherwise(F.lit(""))
    cited = F.concat(spelled, dot, F.lit(" "), (F.col("o_custkey") % 150 + 1).cast("string"), verses)
    forms = (("As ", " says, and Rom. 8:28 too."), ("12 read it (", "; romans 8:28)."), ("In chapter 3 — ", "—and at last ROM 8:28, Rom. 8:28"), ("They cited\n", ",\nRomans 8:28 and no more"))
    made = F.coalesce(*[F.when(k % len(forms) == i, F.concat(F.lit(before), cited, F.lit(after))) for i, (before, after) in enumerate(forms)])
    text = F.concat(made, head)
    return read(spark, sf_dir, "orders").select(k.alias("k"), text.alias("text"))


@query(f"""SELECT k, array_to_string(CASE WHEN k % 2 = 0 AND NOT list_contains(refs, 'John 3:16') THEN list_append(refs, 'John 3:16') ELSE refs END, ',') AS refs,
    CASE WHEN k % 2 = 0 THEN 'John 3:16' ELSE r END AS first, book, c AS chapter, v AS verse, w AS last_verse FROM {_CITED}""")
def reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = R.extract_references(F.col("text"))
    found = _citing(spark, sf_dir).select("k", refs.alias("refs"), R.primary_reference(F.col("text")).alias("first"), R.parse_reference(F.get(refs, F.lit(0))).alias("p"))
    return found.select("k", T.comma_list(F.col("refs")).alias("refs"), "first", "p.*")


_ALL_REFS = "CASE WHEN k % 2 = 0 AND NOT list_contains(refs, 'John 3:16') THEN list_append(refs, 'John 3:16') ELSE refs END"


@query(f"SELECT ref, count(*)::BIGINT AS uses, count(DISTINCT k)::BIGINT AS docs FROM (SELECT k, unnest({_ALL_REFS}) AS ref FROM {_CITED}) GROUP BY ref")
def ref_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _citing(spark, sf_dir).select("k", F.explode(R.extract_references(F.col("text"))).alias("ref"))
    return found.groupBy("ref").agg(F.count("*").alias("uses"), F.count_distinct("k").alias("docs"))


@query(f"SELECT k FROM {_CITED} WHERE (book = 'Genesis' AND c = 1) OR (book = 'Exodus' AND c = 20) OR (book = 'Luke' AND c = 3 AND 10 BETWEEN v AND coalesce(w, v))")
def reference_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _citing(spark, sf_dir).select("k", R.extract_references(F.col("text"), 1).alias("references"))
    asked = (("Genesis", 1), ("Exodus", 20), ("Luke", 3, 10))
    hit = [R.refers_to(F.col("references"), *a) for a in asked]
    return refs.where(hit[0] | hit[1] | hit[2]).select("k")


@query(f"SELECT k AS doc_id, array_to_string(list_sort({_ALL_REFS}), ',') AS chunk_refs, array_to_string(list_sort(list_distinct(list_append({_ALL_REFS}, 'Titus 2:1'))), ',') AS all_refs FROM {_CITED}")
def chunk_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _citing(spark, sf_dir).select(F.col("k").alias("doc_id"), F.col("text").alias("chunk"), F.array(F.lit("Titus 2:1")).alias("references"))
    found = corpus.with_references(chunks)
    return found.select("doc_id", T.comma_list(F.array_sort("chunk_references")).alias("chunk_refs"), T.comma_list(F.col("all_references")).alias("all_refs"))


@query()
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole sentences by tokens, with what the settings say of them."""
    own = settings.from_environment()
    docs = read(spark, sf_dir, "documents").where(F.length("text") >= own.least_chars)
    return corpus.pack_tokens(docs, own.chunk_tokens, own.chunk_overlap, tokens.vocabulary(spark, own.tokenizer))


@query()
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and the characters of its first 2048."""
    path = settings.from_environment().tokenizer
    count, head = tokens.token_count(spark, path), tokens.token_head(spark, path, 2048)
    return read(spark, sf_dir, "documents").select("doc_id", count(F.col("text")).alias("tokens"), F.length(head(F.col("text"))).alias("head_chars"))


@query()
def pack_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in bins of 2048 tokens, none cut that fits into one."""
    count = tokens.token_count(spark, settings.from_environment().tokenizer)
    sized = read(spark, sf_dir, "documents").select("doc_id", count(F.col("text")).cast("long").alias("tokens"))
    return packing.pack_whole(sized, "doc_id", "tokens", 2048)


_TITLED = "'[Document ' || e.vec_id || ' — \"' || coalesce(d.source, 'Untitled') || '\"' || CASE WHEN e.label <> 0 THEN ', Volume ' || e.label ELSE '' END || ' | Text: ' || d.lang || ']'"


@query(f"""SELECT place, vec_id, score, {_TITLED} || chr(10) || trim(substr(d.text, 1, 650), {_BLANK_SQL}) AS source
    FROM (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS place FROM (SELECT e.vec_id, e.label, {_SCORE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label IN (0, 1, 2, 3) ORDER BY score DESC, vec_id LIMIT 6)
        WHERE label IS NULL OR label BETWEEN 0 AND 2 ORDER BY score DESC, vec_id LIMIT 5) e JOIN documents d ON d.doc_id = e.vec_id""")
def retrieve_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, top 6, second filter, top 5, and the sources of these with their excerpts."""
    e = read(spark, sf_dir, "embeddings").withColumn("volume", F.col("label"))
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    years = retrieval.range_filter("label", 1, 63, whole=(1, 63))  # the whole range asks for no filter
    assert years is None
    found = retrieval.retrieve(e, q, retrieval.metadata_filter(volumes=(0, 1, 2, 3)), 6, retrieval.in_years(F.col("label"), 0, 2), 5)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", F.col("source").alias("title"), F.col("lang").alias("reference"))
    both = docs.join(F.broadcast(found), "vec_id").withColumn("number", F.col("vec_id"))  # five rows
    return both.select("place", "vec_id", "score", F.concat(retrieval.PROMPT_HEADER.column(), F.lit("\n"), F.btrim(F.substring("text", 1, 650), F.lit(T.BLANK))).alias("source"))


@query(f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_hash_sql('42', 'doc_id')}, doc_id) <= count(*) OVER () - floor(count(*) OVER () * (1 - 0.05::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM documents""")
def split_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.05, floor_train=True)


@query(f"""WITH h AS (SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50),
    r AS (SELECT length(text) AS chars, row_number() OVER (PARTITION BY trim(substr(text, 1, 300), {_BLANK_SQL}) ORDER BY doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h))
    SELECT 'held_out' AS reason, count(*) AS n FROM h UNION ALL SELECT CASE WHEN r > 1 THEN 'duplicate' WHEN chars < 500 THEN 'short' ELSE 'written' END, count(*) FROM r GROUP BY 1""")
def corpus_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5(corpus.fingerprint(F.col("text"))).alias("k"), F.length("text").alias("chars"))
    return corpus.outcomes(docs, corpus.sample_exactly(docs.select("doc_id"), 50, "doc_id"), "doc_id", 500)


_QUESTION = "SELECT conv_id, conv_id % 3 AS input, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS question FROM conversations GROUP BY conv_id"


@query(f"SELECT input, count_if(r = 1) AS loaded, count_if(r > 1) AS duplicates FROM (SELECT input, row_number() OVER (PARTITION BY question ORDER BY input, conv_id) AS r FROM ({_QUESTION})) GROUP BY input")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat.gather(read(spark, sf_dir, "conversations")).withColumn("input", F.col("conv_id") % 3)
    return chat.merge_counts(records, "input", "conv_id")


@query("SELECT event_type, round(avg(value), 6) AS mean_value, round(avg((value > 50)::INT) * 100, 6) AS slow_rate FROM events GROUP BY event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.round(evaluation.rate(F.col("value") > 50), 6).alias("slow_rate"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN quality::DOUBLE END AS groundedness, CASE WHEN doc_id % 4 < 3 THEN toxic::DOUBLE END AS honesty,
    CASE WHEN doc_id % 4 < 3 THEN 'because' ELSE '{generation.FAILED}' END AS reasoning FROM labels""")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's outputs: plain, fenced, fenced with talk around, and broken JSON."""
    body = F.concat(F.lit('{"groundedness": '), F.col("quality").cast("string"), F.lit(', "honesty": '), F.col("toxic").cast("string"), F.lit(', "reasoning": "because"}'))
    way = F.col("doc_id") % 4
    raw = F.when(way == 0, body).when(way == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(way == 2, F.concat(F.lit("Here it is:\n```\n"), body, F.lit("\n``` Done."))).otherwise(F.substring(body, 1, 20))
    return read(spark, sf_dir, "labels").select("doc_id", generation.parse_scores(raw).alias("s")).select("doc_id", "s.groundedness", "s.honesty", "s.reasoning")


_TEMPLATES = ("What is said about {topic}?", "How does the text speak of {topic}?", "Why does {topic} matter here?")
_SENTENCE = "coalesce(string_split(regexp_replace(text, '([.!?])[\\s\\x0b]+', '\\1' || chr(1), 'g'), chr(1))[{}], '')"


def _pick_sql(seed: str, values: tuple[str, ...], key: str = "doc_id") -> str:
    return f"{_sql_list(values)}[({_hash_sql(seed, key)} % {len(values)})::INT + 1]"


def _joined(first: str) -> str:
    return f"array_to_string([{_pick_sql('opener', generation.OPENERS)}, {first}, {_SENTENCE.format(2)}, '{generation.MIDDLE}', {_SENTENCE.format(3)}, {_pick_sql('closing', generation.CLOSINGS)}], ' ')"


@query(f"""SELECT doc_id, replace({_pick_sql('template', _TEMPLATES)}, '{{topic}}', lang) AS question, md5(trim({_joined(_SENTENCE.format(1))}, {_BLANK_SQL})) AS answer
    FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50)""")
def grounded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all documents but those held out."""
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", "lang")
    docs = docs.join(F.broadcast(corpus.sample_exactly(docs.select("doc_id"), 50, "doc_id")), "doc_id", "left_anti")  # 50 rows
    asked = generation.pair_with(docs, "doc_id", _TEMPLATES, "template", "template")
    record = chat.record(F.lit("Answer from the context."), F.col("text"), generation.fill(F.col("template"), topic=F.col("lang")), generation.grounded_answer(F.col("text"), F.col("doc_id")))
    question = F.substring_index(F.get(record, F.lit(1))["content"], "\n\nQUESTION:\n", -1)
    return asked.select("doc_id", question.alias("question"), F.md5(F.get(record, F.lit(2))["content"]).alias("answer"))


_UNANSWERABLE = ("What is said of steel frames?", "Which music is preferred?", "Who wrote to the editor in 1901?")


@query(f"SELECT doc_id, {_pick_sql('refuse', _UNANSWERABLE)} AS question FROM documents WHERE {_hash_sql('refuse|draw', 'doc_id')} % 100 < 7")
def refusal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generation.pair_with(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", _UNANSWERABLE, "refuse", "question", percent=7)
    return rows.where("question IS NOT NULL")


@query("""SELECT conv_id, turn, CASE WHEN least(coalesce(nullif(instr(text, 'the'), 0), 1000000000), coalesce(nullif(instr(text, ' a '), 0), 1000000000)) = 1000000000 THEN text
    ELSE substr(text, 1, least(coalesce(nullif(instr(text, 'the'), 0), 1000000000), coalesce(nullif(instr(text, ' a '), 0), 1000000000)) - 1) END AS text FROM conversations""")
def stop_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", generation.cut_at(F.col("text"), ("the", " a ")).alias("text"))


@query("SELECT doc_id FROM documents WHERE doc_id % 1000 NOT IN (SELECT doc_id % 1000 FROM documents WHERE doc_id < 40)")
def holdout_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose name, here the id's last digits, isn't that of a document held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 1000).alias("stem"))
    return docs.join(docs.where("doc_id < 40").select("stem").distinct(), "stem", "left_anti").select("doc_id")


_URL = "https://example.org/volume-{volume}/document-{number}.md"


@query("SELECT vec_id, CASE WHEN label <> 0 AND vec_id <> 0 THEN 'https://example.org/volume-' || label || '/document-' || vec_id || '.md' ELSE '' END AS url, d.source FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id")
def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", T.numbered_url(_URL, F.col("label"), F.col("vec_id")).alias("url"))
    return rows.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id", "left")


@query(f"""SELECT doc_id, CASE WHEN length(text) > 45 THEN substr(text, 1, 42) || '...' ELSE text END AS label, trim(substr(text, 1, 200), {_BLANK_SQL}) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS excerpt,
    length(array_to_string(list_slice(string_split(text, chr(10)), 1, 60), chr(10)))::BIGINT AS head, md5(trim(substr(text, 1, 650), {_BLANK_SQL})) AS source FROM documents
    WHERE length(text) >= 1000 AND trim(text, {_BLANK_SQL}) <> ''""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = read(spark, sf_dir, "documents").where((F.length(text) >= 1000) & (T.strip(text) != ""))
    return docs.select(
        "doc_id", generation.label(text).alias("label"), generation.excerpt(text, 200, "...").alias("excerpt"),
        F.length(generation.first_lines(text)).cast("long").alias("head"), F.md5(generation.excerpt(text, 650)).alias("source"),
    )


_UI = {"en": {"welcome": "Welcome", "ask": "Ask a question"}, "de": {"welcome": "Willkommen"}}


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN 'Willkommen' ELSE 'Welcome' END AS welcome, 'Ask a question' AS ask, 'unknown' AS other FROM documents""")
def ui_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda key: T.look_up(_UI, F.lit(key), F.col("lang"))
    return read(spark, sf_dir, "documents").select("doc_id", of("welcome").alias("welcome"), of("ask").alias("ask"), of("unknown").alias("other"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, role = 'assistant' AND length(text) % 3 > 0 AS ok, lead(role = 'assistant' AND length(text) % 3 > 0) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations)
    WHERE CASE role WHEN 'user' THEN coalesce(after, false) WHEN 'assistant' THEN ok ELSE true END""")
def conversation_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose length is divisible by 3 stand for those that failed."""
    return chat.remember(read(spark, sf_dir, "conversations"), F.length("text") % 3 > 0).select("conv_id", "turn", "role")


_SYSTEMS = {"default": "Answer from the context.", "strict": "Answer from the context.\nCite every source.", "concise": "Answer from the context.\nBe brief."}
_OTHER = "Answer from the writings of {author}."


def _variant(of: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("default", "strict", "none"))), (of % 3 + 1).cast("int"))


@query(f"""SELECT doc_id, CASE WHEN source IS NOT NULL AND source <> 'web' THEN 'Answer from the writings of ' || source || '.' WHEN doc_id % 3 = 1 THEN '{_SYSTEMS['default']}' || chr(10) || 'Cite every source.' ELSE '{_SYSTEMS['default']}' END AS system,
    'CONTEXT:' || chr(10) || lang || chr(10) || 'QUESTION: ' || doc_id AS user_text, 2 AS messages FROM documents""")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = chat.system_prompt(F.col("source"), _variant(F.col("doc_id")), _SYSTEMS, "web", _OTHER)
    user = generation.fill(F.lit("CONTEXT:\n{context}\nQUESTION: {question}"), context=F.col("lang"), question=F.col("doc_id").cast("string"))
    made = chat.build_messages(system, F.array().cast(chat.MESSAGES), user)
    at = lambda i: F.get(F.col("m"), F.lit(i))["content"]
    return read(spark, sf_dir, "documents").select("doc_id", made.alias("m")).select("doc_id", at(0).alias("system"), at(1).alias("user_text"), F.size("m").alias("messages"))


@query("""SELECT doc_id, chars, flag, row_number() OVER (ORDER BY flag DESC, CASE WHEN flag = 'stub' THEN chars ELSE -chars END, doc_id)::INT AS place FROM (
    SELECT doc_id, length(text)::BIGINT AS chars, CASE WHEN length(text) < 200 THEN 'stub' ELSE 'oversize' END AS flag FROM documents WHERE length(text) < 200 OR length(text) > 15000)""")
def anomaly_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies as a report lists them, with their place."""
    order = (F.desc("flag"), F.when(F.col("flag") == "stub", F.col("chars")).otherwise(-F.col("chars")), "doc_id")
    placed = numbered(corpus.anomalies(read(spark, sf_dir, "documents"), 200, 15000), *order, first=1)
    return placed.withColumn("place", F.col("place").cast("int"))


@query("""SELECT grp, '| ' || rpad(coalesce(grp, ''), 12, ' ') || ' | ' || lpad(format('{:,}', files), 12, ' ') || ' | ' || lpad(format('{:,}', chars), 12, ' ') || ' |' AS line FROM (
    SELECT CASE WHEN grouping(lang) = 1 THEN 'TOTAL' ELSE lang END AS grp, count(*) AS files, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), ()))""")
def inventory_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.inventory(read(spark, sf_dir, "documents"), "lang").select("grp", "files", "chars")
    return corpus.table_lines(rows).select("grp", "line")


@query("SELECT a.place, a.conv_id, b.doc_id FROM (SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1)::INT AS place FROM conversations WHERE turn = 0) a JOIN (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS place FROM documents) b USING (place)")
def results_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "conversations").where("turn = 0").select("conv_id")
    both = evaluation.join_by_position(a, read(spark, sf_dir, "documents").select("doc_id"), "conv_id", "doc_id")
    return both.withColumn("place", F.col("place").cast("int"))


@query("""SELECT user_id, min(ts)::TIMESTAMP AS first, max(ts)::TIMESTAMP AS last, count(*) AS events, sum(value::DECIMAL(24, 6))::DOUBLE AS total FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
            SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE)::INT, 1) AS fresh FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL))
    GROUP BY user_id, session""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user that lie at most half an hour apart, as sessions."""
    out = sessions.sessions(read(spark, sf_dir, "events"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})
