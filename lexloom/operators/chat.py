"""Chat records: validation, templates, deduplication and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .corpus import first_wins

MESSAGES = "array<struct<role:string,content:string>>"


def first_of_role(messages: Column, role: str = "user") -> Column:
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))


def chatml(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def role_tags(messages: Column, trailer: bool = True) -> Column:
    """Known roles as <|role|> blocks; others are left out."""
    known = F.filter(messages, lambda m: m["role"].isin("system", "user", "assistant"))
    body = F.array_join(F.transform(known, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")
    return F.concat(body, F.lit("<|assistant|>\n")) if trailer else body


def record(system: Column, context: Column, question: Column, answer: Column) -> Column:
    user = F.concat(F.lit("CONTEXT:\n"), context, F.lit("\n\nQUESTION:\n"), question)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", answer))


def gather(turns: DataFrame) -> DataFrame:
    """conv_id and messages in the order of turns; a conversation becomes one row, as templates need it whole."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def last_messages(turns: DataFrame, n: int = 6) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def question_answers(turns: DataFrame, question: int = 15, answer: int = 40) -> DataFrame:
    """User turns that the assistant answers next, and whether both are long enough."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    pair = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("reply"))
    valid = (F.length(F.trim("text")) > question) & (F.length(F.trim("reply")) > answer)
    return pair.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), F.col("reply").alias("answer"), valid.alias("valid"))


def merge(records: DataFrame, *order: str) -> DataFrame:
    """The first record of each user message; records without one count as equal."""
    return first_wins(records.withColumn("_u", first_of_role(F.col("messages"))), F.col("_u"), *order).drop("_u")


def merge_counts(records: DataFrame, source: str, *order: str) -> DataFrame:
    """How many records of each input a merge loads, and how many it leaves out as duplicates. The counts of inputs are few rows."""
    key = F.md5(first_of_role(F.col("messages")))
    first = records.groupBy(key.alias("_k")).agg(F.min(F.struct(source, *order)).alias("f"))
    loaded = first.groupBy(F.col(f"f.{source}").alias("_s")).agg(F.count("*").alias("loaded"))
    total = records.groupBy(source).agg(F.count("*").alias("n"))
    both = total.join(loaded, F.col(source).eqNullSafe(F.col("_s")), "left").withColumn("loaded", F.coalesce("loaded", F.lit(0)))
    return both.select(source, "loaded", (F.col("n") - F.col("loaded")).alias("duplicates"))


def parse_pairs(raw: Column) -> Column:
    """Question-answer pairs of a model's JSON output, an array or one object, fenced or not; null if it's neither."""
    from lexloom.functions.text import strip_fences

    body = strip_fences(raw)
    body = F.when(F.startswith(body, F.lit("{")), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return F.from_json(body, "array<struct<question:string,answer:string>>")


def remember(turns: DataFrame, succeeded: Column) -> DataFrame:
    """The turns that a conversation's memory holds: answers that succeeded, and the questions that they answer.

    A question goes again when its answer fails or never comes.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    marked = turns.withColumn("_ok", succeeded & (F.col("role") == "assistant"))
    marked = marked.withColumn("_next", F.lead("_ok").over(order))
    stays = F.when(F.col("role") == "user", F.coalesce("_next", F.lit(False))).when(F.col("role") == "assistant", F.col("_ok")).otherwise(F.lit(True))
    return marked.where(stays).drop("_ok", "_next")


def remember_stream(turns: DataFrame) -> DataFrame:
    """The same over a stream of (conv_id, turn, role, text, ok): each batch gives the memory of its conversations as it then stands."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        for r in pd.concat(batches).sort_values("turn").itertuples():
            if memory and memory[-1][1] == "user" and (r.role == "user" or not r.ok):
                memory.pop()
            if r.role != "assistant" or r.ok:
                memory.append((r.turn, r.role, r.text))
        state.update(tuple(map(list, zip(*memory, strict=True))) if memory else ([], [], []))
        yield pd.DataFrame({"conv_id": [key[0]] * len(memory), "turn": [m[0] for m in memory], "role": [m[1] for m in memory], "text": [m[2] for m in memory]})

    out, kept = "conv_id long, turn int, role string, text string", "turn array<int>, role array<string>, text array<string>"
    return turns.groupBy("conv_id").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def build_messages(system: Column, history: Column, user: Column, n: int = 6) -> Column:
    """System message, the last n of the history and the question with its context."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    recent = F.coalesce(F.slice(history, F.greatest(F.size(history) - n, F.lit(0)) + 1, F.lit(n)), F.array().cast(MESSAGES))
    return F.concat(F.array(turn("system", system)), recent, F.array(turn("user", user)))


def system_prompt(author: Column, variant: Column, base: dict[str, str], default_author: str, other: str) -> Column:
    """The prompt of a variant, ``default`` where it isn't known; another author than the default has ``other`` in every variant."""
    known = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    chosen = F.coalesce(F.try_element_at(known, variant), F.lit(base["default"]))
    return F.when(F.coalesce(author, F.lit(default_author)) == default_author, chosen).otherwise(F.replace(F.lit(other), F.lit("{author}"), author))
