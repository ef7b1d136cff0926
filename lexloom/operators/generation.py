"""Training records without a model: templates, grounded answers, refusals, and outputs of models cut and parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import hash32, pick, strip, strip_fences

# How grounded answers begin, what stands before their third sentence, and how they close.
OPENERS = ("Beloved,", "My brethren,", "Dear friends,", "")
MIDDLE = "This is the truth we must hold fast."
CLOSINGS = (
    "May God grant us grace to believe and practice these things.",
    "Let us look to Jesus and rest in His finished work.",
    "This is our comfort in every trial.",
    "Oh, that we may know more of this precious truth!",
)
# What a judge scores.
DIMENSIONS = ("groundedness", "citation_quality", "honesty", "helpfulness", "overall_score")
FAILED = "Judge failed to produce valid output."


def fill(template: Column, **values: Column) -> Column:
    """The template with every {name} replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), value)
    return template


def judge_prompt(instructions: str, question: Column, context: Column, answer: Column) -> Column:
    """What a judge is asked: instructions, question, context and answer between rules, and the form of its answer."""
    parts = (instructions, "QUESTION:\n{question}", "RETRIEVED CONTEXT:\n{context}", "GENERATED ANSWER:\n{answer}", "Now evaluate the answer and output only the JSON object.")
    filled = [fill(F.lit(p), question=question) if "{question}" in p else fill(F.lit(p), context=context) if "{context}" in p else fill(F.lit(p), answer=answer) if "{answer}" in p else F.lit(p) for p in parts]
    return F.concat_ws("\n\n---\n\n", *filled)


def typed_battery(rows: DataFrame, key: str, battery: dict[str, str], seed: str = "battery") -> DataFrame:
    """rows with the columns type and question: one of the battery's kinds of question by hash of the key, to be asked of the row as context."""
    kinds = tuple(battery)
    asked = F.create_map(*[F.lit(x) for kv in battery.items() for x in kv])
    return rows.withColumn("type", pick(seed, F.col(key), kinds)).withColumn("question", F.element_at(asked, F.col("type")))


def grounded_answer(chunk: Column, key: Column) -> Column:
    """An opener, the chunk's first three sentences with a fixed line before the third, and a closing; choices are by hash of the key."""
    sentences = F.split(chunk, r"(?<=[.!?])\s+", 4)
    nth = lambda i: F.coalesce(F.get(sentences, F.lit(i)), F.lit(""))
    parts = [pick("opener", key, OPENERS), nth(0), nth(1), F.lit(MIDDLE), nth(2), pick("closing", key, CLOSINGS)]
    return strip(F.array_join(F.array(*parts), " "))


def pair_with(rows: DataFrame, key: str, values: tuple[str, ...], seed: str, name: str, percent: int = 100) -> DataFrame:
    """rows with a column ``name`` of one of the values by hash of the key, null for all but about percent of the rows."""
    drawn = hash32(f"{seed}|draw", F.col(key)) % 100 < percent
    return rows.withColumn(name, F.when(drawn, pick(seed, F.col(key), values)))


def cut_at(text: Column, stops: tuple[str, ...]) -> Column:
    """The text before the first of the stop strings; all of it without one."""
    at = [F.when(F.instr(text, s) > 0, F.instr(text, s)) for s in stops]
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def parse_scores(raw: Column, dimensions: tuple[str, ...] = DIMENSIONS) -> Column:
    """A judge's scores from its JSON, fenced or not; where there is none, null scores and a fixed reasoning."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?(.*?)(?:```|\z)", 1)
    body = F.when(F.contains(raw, F.lit("```")), strip(fenced)).otherwise(strip_fences(raw))
    schema = ", ".join(f"{d} double" for d in dimensions) + ", reasoning string"
    parsed = F.when(F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}")), F.from_json(body, schema))
    right = F.coalesce(*[parsed[d] for d in dimensions]).isNotNull()
    one = lambda d: F.when(right, parsed[d]).alias(d)
    return F.struct(*map(one, dimensions), F.when(right, parsed["reasoning"]).otherwise(F.lit(FAILED)).alias("reasoning"))


def excerpt(text: Column, n: int, mark: str = "") -> Column:
    """The first n characters, trimmed; ``mark`` follows where characters were left out."""
    return F.concat(strip(F.substring(text, 1, n)), F.when(F.length(text) > n, F.lit(mark)).otherwise(F.lit("")))


def label(question: Column, n: int = 45) -> Column:
    """Questions of over n characters end in three dots within n."""
    return F.when(F.length(question) > n, F.concat(F.substring(question, 1, n - 3), F.lit("..."))).otherwise(question)


def first_lines(text: Column, n: int = 60) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")
