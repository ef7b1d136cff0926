"""Registered queries that write files with the library's sinks and read them back, and what readers and filters do on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import chat, corpus, generation, retrieval
from lexloom.sources import readers, settings, trees
from lexloom.sources.scratch import shared_folder

from .catalog import _BLANK_SQL, _SENTENCES, query, read
from .extended import _pick_sql


def _sermons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content: every document as a Markdown file in a folder of its volume, two of three with a heading; a README in each folder."""
    i = F.col("doc_id")
    volume = F.concat(F.lit("volume-"), (i % 20 + 1).cast("string"), F.lit("/"))
    head = F.when(i % 3 > 0, F.concat(F.lit("# Sermon "), i.cast("string"), F.lit(" | On "), F.coalesce("source", F.lit("nothing")), F.lit("\n\nin 18"), (i % 40 + 50).cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    docs = read(spark, sf_dir, "documents")
    named = docs.select(F.concat(volume, F.when(i % 2 == 0, F.lit("sermon-")).otherwise(F.lit("sermon_")), i.cast("string"), F.lit(".md")).alias("path"), F.encode(F.concat(head, F.coalesce("text", F.lit(""))), "UTF-8").alias("content"))
    return named.union(docs.select(volume.alias("v")).distinct().select(F.concat("v", F.lit("ReadMe.md")), F.encode(F.lit("# Sermon 0 | No sermon"), "UTF-8")))


_SERMON = """(SELECT doc_id, 'volume-' || (doc_id % 20 + 1) || '/sermon' || CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '_' END || doc_id || '.md' AS path,
    CASE WHEN doc_id % 3 > 0 THEN '# Sermon ' || doc_id || ' | On ' || coalesce(source, 'nothing') || chr(10) || chr(10) || 'in 18' || (doc_id % 40 + 50) || chr(10) ELSE '' END || coalesce(text, '') AS content,
    source FROM documents)"""


@query(rf"""SELECT (doc_id % 20 + 1)::INT AS volume, CASE WHEN doc_id % 3 > 0 THEN doc_id::INT END AS number,
    CASE WHEN doc_id % 3 > 0 THEN 'On ' || coalesce(source, 'nothing') ELSE regexp_replace(split_part(path, '/', 2), '\.md$', '') END AS title,
    try_cast(nullif(regexp_extract(substr(content, 1, 1500), '\b(18[5-9]\d|189[0-2])\b', 1), '') AS INT) AS year, length(content)::INT AS chars FROM {_SERMON}""")
def markdown_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of Markdown files written, scanned by folder and name and parsed; READMEs are no documents."""
    root = shared_folder(spark, "tree")
    trees.write_tree(_sermons(spark, sf_dir), root)
    raw = readers.markdown_files(spark, root, glob="*.md", folders=r"volume-\d+")
    return readers.parse_documents(raw).select("volume", "number", "title", "year", F.length("full_text").alias("chars"))


@query(f"SELECT path, strlen(content)::BIGINT AS bytes, sha256(content) AS sha256 FROM {_SERMON}")
def tree_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a tree copied under their paths; what the copy holds, read from it."""
    source, target = shared_folder(spark, "tree"), shared_folder(spark, "copy")
    trees.write_tree(_sermons(spark, sf_dir), source)
    trees.copy_tree(spark, source, target, glob="sermon*.md")
    copied = trees.list_tree(spark, target)
    return copied.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query(f"SELECT md5(trim(text, {_BLANK_SQL})) AS digest FROM documents WHERE length(trim(text, {_BLANK_SQL})) > 200")
def delimited_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written with a delimiter after each, split again, and those of over 200 characters."""
    path = shared_folder(spark, "delimited")
    readers.write_delimited(read(spark, sf_dir, "documents").where("text IS NOT NULL"), path)
    return readers.read_delimited(spark, path).select(F.md5("text").alias("digest"))


def _chat_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Conversations of an even and of an odd number of turns, a file of lines cut short, and one that isn't there."""
    records = chat.gather(read(spark, sf_dir, "conversations"))
    paths = [shared_folder(spark, "chat") for _ in range(4)]
    for odd in (0, 1):
        readers.write_chat(records.where(F.size("messages") % 2 == odd), paths[odd])
    whole = F.to_json(F.struct("messages"))
    records.select(F.concat(F.substring(whole, F.lit(1), F.length(whole) - 5), F.lit("\n"))).write.text(paths[2])
    return [paths[0], paths[2], paths[3], paths[1]]


_TURNS = "(SELECT conv_id, count(*) AS n, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id)"


@query(f"SELECT CASE WHEN n % 2 = 0 THEN 0 ELSE 3 END::INT AS file, n::INT AS messages, md5(first) AS digest FROM {_TURNS}")
def chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records as JSON lines in several files, read tolerantly in the order of the list."""
    rows = readers.read_chat(spark, *_chat_files(spark, sf_dir))
    return rows.select("file", F.size("messages").alias("messages"), F.md5(F.get("messages", F.lit(0))["content"]).alias("digest"))


@query(f"""SELECT 0::INT AS file, count_if(n % 2 = 0) AS kept, 0::BIGINT AS malformed, 0::BIGINT AS blank FROM {_TURNS}
    UNION ALL SELECT 1, 0, count(*), count(*) FROM {_TURNS} UNION ALL SELECT 3, count_if(n % 2 = 1), 0, 0 FROM {_TURNS}""")
def chat_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each file are records, malformed and blank."""
    return readers.chat_losses(spark, *_chat_files(spark, sf_dir))


@query("""SELECT vec_id, label, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings""")
def vector_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors streamed into a collection in bounded batches, normalised on the way; the stream runs again from its checkpoint and adds nothing."""
    source, target, state = (shared_folder(spark, n) for n in ("vectors", "collection", "checkpoint"))
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    readers.write_vectors(e, source, sort=("label", "vec_id"))
    schema = "vec_id long, label int, embedding array<float>"
    unit = lambda df: df.withColumn("embedding", retrieval.normalise(F.col("embedding")))
    for _ in range(2):
        readers.stream_into(spark, source, schema, target, state, unit, files=settings.from_environment().batch_files).awaitTermination()
    found = readers.open_vectors(spark, target, "vec_id long, label int, embedding array<double>")
    return found.select("vec_id", "label", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query("SELECT grp, files, chars FROM (SELECT CASE WHEN grouping(lang) = 1 THEN 'TOTAL' ELSE lang END AS grp, count(*) AS files, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), ()))")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as one JSON document, and its rows taken out of it again."""
    counts = corpus.inventory(read(spark, sf_dir, "documents"), "lang")
    made = readers.result_document(counts.withColumn("ord", F.coalesce("grp", F.lit(""))), "ord", report="inventory")
    return made.select(F.inline(F.from_json("document", "results array<struct<grp:string,files:bigint,chars:bigint>>")["results"]))


@query(r"""SELECT line, text FROM (SELECT (row_number() OVER (ORDER BY item_id))::INT AS line, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM benchmark WHERE trim(text) <> '') WHERE line <= 25""")
def question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first questions of a small list, a line each."""
    path = shared_folder(spark, "lines")
    asked = read(spark, sf_dir, "benchmark").orderBy("item_id").select(F.concat(F.lit(" "), F.regexp_replace("text", r"\s+", " "), F.lit("\n\n")))
    asked.coalesce(1).write.text(path)  # a list of questions is one small file
    return readers.read_lines(spark, path, 25)


_COLLAPSED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(body, '#+\s+', '', 'g'), '\s+', ' ', 'g'))) AS cleaned, md5(regexp_replace(body, '\A#[^\n]*\n', '')) AS headless,
    md5(trim(text, {_BLANK_SQL})) AS bare FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '# Head ' || doc_id || chr(10) ELSE '' END || text AS body FROM documents WHERE text IS NOT NULL)""")
def cleaned_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cleaned for questions, without their first heading, and without what a model puts before an answer."""
    text, i = F.col("text"), F.col("doc_id")
    body = F.concat(F.when(i % 2 == 0, F.concat(F.lit("# Head "), i.cast("string"), F.lit("\n"))).otherwise(F.lit("")), text)
    said = F.concat(F.element_at(F.array(*map(F.lit, (" ASSISTANT: ", "Resposta:", "tradução:\n", ""))), (i % 4 + 1).cast("int")), text)
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(T.clean_for_questions(body)).alias("cleaned"), F.md5(T.drop_first_heading(body)).alias("headless"), F.md5(T.strip_prefixes(said)).alias("bare"))


@query("""SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant' AND length(answer) >= 50 AND turn % 8 < 6""")
def parsed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answer pairs out of JSON in a list, alone, or in a fence; broken JSON gives none, and answers of under 50 characters go."""
    pairs = chat.question_answers(read(spark, sf_dir, "conversations")).select("conv_id", "turn", F.to_json(F.struct("question", "answer")).alias("j"))
    way = F.col("turn") % 8
    said = F.when(way < 2, F.concat(F.lit("["), "j", F.lit("]"))).when(way < 4, F.col("j")).when(way < 6, F.concat(F.lit("```json\n["), "j", F.lit("]\n```"))).otherwise(F.substring("j", 1, 12))
    found = pairs.select("conv_id", "turn", F.inline(chat.parse_pairs(said)))
    return found.where(F.length("answer") >= 50)


@query("""SELECT 'any' AS name, count(*) AS n FROM embeddings WHERE label IN (1, 2) UNION ALL SELECT 'all', 0 UNION ALL SELECT 'one', count(*) FROM embeddings WHERE label = 2
    UNION ALL SELECT 'whole', count(*) FROM embeddings UNION ALL SELECT 'range', count(*) FROM embeddings WHERE label BETWEEN 2 AND 5 UNION ALL SELECT 'years', count(*) FROM embeddings WHERE label IS NULL OR label BETWEEN 2 AND 5
    UNION ALL SELECT 'listed', sum(vec_id + label)::BIGINT FROM embeddings WHERE label IS NOT NULL""")
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors the filters of a search let through: any or all of several values, whole and part ranges, unknown years, and lists of numbers."""
    e = read(spark, sf_dir, "embeddings").withColumn("volume", F.col("label"))
    whole, part = retrieval.range_filter("label", 1, 63, (1, 63)), retrieval.range_filter("label", 2, 5, (1, 63))
    kept: dict[str, Column | None] = {
        "any": retrieval.metadata_filter(volumes=(1, 2)), "all": retrieval.metadata_filter(volumes=(1, 2), strict_and=True), "one": retrieval.metadata_filter(volumes=(2,), strict_and=True),
        "whole": whole, "range": part, "years": retrieval.in_years(F.col("label"), 2, 5),
    }
    counts = [F.count_if(F.lit(True) if c is None else c).alias(name) for name, c in kept.items()]
    numbers = retrieval.parse_numbers(F.concat(F.col("vec_id").cast("string"), F.lit(", "), F.coalesce(F.col("label").cast("string"), F.lit("none")), F.lit(",")))
    listed = F.sum(F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x)).alias("listed")
    row = e.agg(*counts, listed)
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in row.columns])))


@query(f"""SELECT doc_id, (row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) - 1)::BIGINT AS place FROM documents WHERE lang IN ('en', 'de', 'fr') AND length(text) >= 200""")
def shuffled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of supported languages and of enough characters in a seeded order."""
    docs = read(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de", "fr") & (F.length("text") >= settings.from_environment().least_chars))
    return corpus.shuffled(docs.select("doc_id"), "doc_id", seed=7)


_VARIANT = _SENTENCES.replace("text", _COLLAPSED)
_VARIANT_SQL = f"""p AS (SELECT doc_id, list_reduce(list_transform({_VARIANT}, lambda s: {{'cur': s, 'out': []::VARCHAR[]}}), lambda a, x: CASE WHEN len(a.out) >= 3 THEN a
        WHEN length(a.cur) + (a.cur <> '')::INT + length(x.cur) > 1200 AND length(a.cur) + (a.cur <> '')::INT > 400 THEN {{'cur': x.cur, 'out': list_append(a.out, a.cur)}}
        ELSE {{'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || ' ' || x.cur END, 'out': a.out}} END) AS p FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, CASE WHEN len(p.out) < 3 AND length(p.cur) + (p.cur <> '')::INT > 400 THEN list_append(p.out, p.cur) ELSE p.out END AS c FROM p),
    e AS (SELECT doc_id, (i - 1)::INT AS ord, c[i] AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c))"""


@query(f"WITH {_VARIANT_SQL} SELECT doc_id, ord, md5(chunk) AS digest FROM e")
def sentence_pack_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed after white space is collapsed."""
    return corpus.pack_sentences(read(spark, sf_dir, "documents"), collapse=True).select("doc_id", "ord", F.md5("chunk").alias("digest"))


@query(f"WITH {_VARIANT_SQL} SELECT doc_id, ord FROM e ORDER BY doc_id, ord LIMIT 500")
def first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 chunks, as a generator of questions takes them; tasks keep no more than that."""
    return corpus.pack_sentences(read(spark, sf_dir, "documents"), collapse=True).select("doc_id", "ord").orderBy("doc_id", "ord").limit(500)


_JUDGE = "You judge answers. Score each dimension from 1 to 5."
_BATTERY = {"Doctrinal": "What is taught here?", "Expository": "How is the passage read?", "Applicational": "What counsel is given?", "Passage-based": "What does the passage say?", "Open": "What stands out?", "Refusal": "What is said of steel frames?"}
_RULE = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@query(f"""SELECT doc_id, type, md5('{_JUDGE}' || {_RULE} || 'QUESTION:' || chr(10) || question || {_RULE} || 'RETRIEVED CONTEXT:' || chr(10) || text || {_RULE} || 'GENERATED ANSWER:' || chr(10) || coalesce(source, '') || {_RULE}
    || 'Now evaluate the answer and output only the JSON object.') AS digest FROM (SELECT *, CASE type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _BATTERY.items())} END AS question FROM (
    SELECT doc_id, text, source, {_pick_sql('battery', tuple(_BATTERY))} AS type FROM documents WHERE text IS NOT NULL))""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for a judge over every document, each with a question of one of six kinds."""
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    asked = generation.typed_battery(docs, "doc_id", _BATTERY)
    prompt = generation.judge_prompt(_JUDGE, F.col("question"), F.col("text"), F.coalesce("source", F.lit("")))
    return asked.select("doc_id", "type", F.md5(prompt).alias("digest"))


@query("""SELECT doc_id, '[Document ' || doc_id || ' — "' || coalesce(source, '') || '"' || CASE WHEN doc_id % 5 > 0 THEN ', Vol. ' || (doc_id % 5) ELSE '' END || CASE WHEN lang <> '' THEN ' | ' || lang ELSE '' END || ']' AS evaluation,
    '[Document ' || doc_id || ' — "' || coalesce(source, '') || '"]' AS sample FROM documents""")
def context_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of excerpts in evaluations and samples."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("number"), F.col("source").alias("title"), (F.col("doc_id") % 5).cast("int").alias("volume"), F.col("lang").alias("reference"))
    return docs.select("doc_id", retrieval.EVALUATION_HEADER.column().alias("evaluation"), retrieval.SAMPLE_HEADER.column().alias("sample"))
