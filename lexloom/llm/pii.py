"""Personal data by fixed forms and by bootstrapped contexts, all in column expressions.

Spans of fixed form (email, ip, card, phone) are the seeds. The words around a seed
are lexical patterns. Patterns and the identifiers seen in them make a graph: a
pattern scores by the share of its occurrences that are believed to be of a kind, an
identifier by its best patterns, and both are scored again for a few rounds. Tokens
with a digit or an @, and runs of several digit groups, are new spans where they look
like a kind and stand in patterns of high score for it.

Positions are code points, ends exclusive. Null and blank texts have no spans. Rows
with equal id and text get the same spans; ids may be null. Tables without a seed
give no new spans. Extra columns, whatever their names, pass through ``redact`` and are
ignored by ``find_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, cut, let, row_key

KINDS = ("email", "ip", "card", "phone")
ROW = ("r1", "r2")
#: Characters before and after an occurrence in which its context words are looked for first; where they aren't whole in there, all the text between is read.
CONTEXT = (200, 100)
#: Marks around a token that aren't part of it.
BEFORE, AFTER = "<>()[]{}\"'`“”‘’«»,;:!?*|=", "<>()[]{}\"'`“”‘’«»,;:!?*|=."
_S = r"\x20\x09-\x0D"
#: Loops over groups are possessive, which the regex engine runs without recursion, and runs are only tried at
#: their start (or where the last match ended), so that very long runs take linear time. Matches are the same.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for the form to be worth a search.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TOKEN = rf"(?<![^{_S}])[^{_S}0-9@]*+[0-9@][^{_S}]*+"
#: Digit groups joined by spaces, brackets, dots or hyphens, as long as they go on.
RUN = r"(?<![0-9A-Za-z])(?:\((?=[0-9]++\)))?+[0-9]++(?:[\x20\x09.()-]++[0-9]++)++"
OCCURRENCE = "array<struct<start:bigint,stop:bigint,token:string,l1:string,l2:string,n1:string>>"


def _running(lengths: Column) -> Column:
    """For each element the sum of those before it; blocks of about sqrt(n) elements are summed once."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    width = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))

    def by_block(w: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / w).cast("int")), lambda b: total(F.slice(lengths, F.lit(1), b * w)))
        return let(
            blocks,
            lambda p: F.transform(
                lengths, lambda _, i: F.get(p, F.floor(i / w).cast("int")) + total(F.slice(lengths, F.floor(i / w).cast("int") * w + 1, F.pmod(i, w)))
            ),
        )

    return let(width, by_block)


def occurrences(text: Column, form: str) -> Column:
    """Every match of a form with position and the words around it.

    The pieces between matches give the positions and the contexts; a neighbouring
    match counts as the word ``#``.
    """
    empty = F.array().cast(OCCURRENCE)

    def word_at(piece: Column, left: bool, n: int) -> Column:
        near = F.substring(piece, -CONTEXT[0], CONTEXT[0]) if left else F.substring(piece, 1, CONTEXT[1])
        words = lambda c: F.filter(F.split(F.lower(c), rf"[{_S}]+"), lambda x: x != "")
        whole = lambda s: (F.size(s) > n) | (F.length(piece) <= CONTEXT[0 if left else 1])  # noqa: E731  the outermost word may be cut
        split = let(words(near), lambda s: F.when(whole(s), s).otherwise(words(piece)))
        return let(split, lambda s: F.coalesce(F.when(F.size(s) >= n, F.get(s, F.size(s) - n if left else F.lit(n - 1))), F.lit("#")))

    def placed(match: Column, piece: Column) -> Column:
        lengths = F.zip_with(F.slice(piece, 1, F.size(match)), match, lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
        return let(
            let(lengths, _running),
            lambda before: F.transform(
                match,
                lambda m, i: F.struct(
                    (F.get(before, i) + F.length(F.get(piece, i))).alias("start"),
                    (F.get(before, i) + F.length(F.get(piece, i)) + F.length(m)).alias("stop"),
                    m.alias("token"),
                    word_at(F.get(piece, i), True, 1).alias("l1"),
                    word_at(F.get(piece, i), True, 2).alias("l2"),
                    word_at(F.get(piece, i + 1), False, 1).alias("n1"),
                ),
            ),
        )

    return let(
        F.regexp_extract_all(text, F.lit(form), F.lit(0)),
        lambda m: F.when(F.size(m) == 0, empty).otherwise(let(F.split(text, form, -1), lambda p: placed(m, p)).cast(OCCURRENCE)),
    )


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    place = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    twice = lambda v: F.when(2 * v > 9, 2 * v - 9).otherwise(2 * v)
    value = F.transform(place, lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda s, x: s + x) % 10 == 0


def _holds(kind: str, token: Column) -> Column:
    n = F.length(_digits(token))
    if kind == "ip":
        return F.forall(F.split(token, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return n.between(16, 19) & _luhn(_digits(token))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def seeds(text: Column, kind: str) -> Column:
    """The spans of a kind that have its fixed form, in order."""
    needs = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9]{1}")
    found = F.filter(occurrences(text, FORMS[kind]), lambda x: _holds(kind, x["token"]))
    return F.when(needs, found).otherwise(F.array().cast(OCCURRENCE))


def _looks(kind: str, token: Column) -> Column:
    """Whether a token could be of the kind at all."""
    n = F.length(_digits(token))
    if kind == "email":
        return F.contains(token, F.lit("@"))
    if kind == "ip":
        return token.rlike(r"[0-9a-fA-F]+([.:][0-9a-fA-F]*){3,}") & ~token.rlike(rf"[{_S}]")
    return n.between(13, 19) if kind == "card" else n.between(7, 15)


def _bare(x: Column) -> Column:
    """An occurrence without the marks around its token."""
    behind = F.ltrim(x["token"], F.lit(BEFORE))
    token = F.rtrim(behind, F.lit(AFTER))
    start = x["start"] + F.length(x["token"]) - F.length(behind)
    return F.struct(start.alias("start"), (start + F.length(token)).alias("stop"), token.alias("token"), x["l1"].alias("l1"), x["l2"].alias("l2"), x["n1"].alias("n1"))


def _seen(docs: DataFrame) -> DataFrame:
    """r1, r2, doc_id, the seeds of each kind, and other tokens with digits or @ and runs of digit groups of several words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.when(text.rlike("[0-9@]{1}"), F.transform(occurrences(text, TOKEN), _bare)).otherwise(F.array().cast(OCCURRENCE))
    # runs with fewer or more digits are of no kind
    spaced = lambda x: x["token"].rlike(rf"[{_S}]") & F.length(_digits(x["token"])).between(7, 19)
    runs = F.when(text.rlike(r"[0-9][.()-]*[\x20\x09][\x20\x09.()-]*[0-9]"), F.filter(occurrences(text, RUN), spaced)).otherwise(F.array().cast(OCCURRENCE))
    return docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), *[seeds(text, k).alias(k) for k in KINDS], F.concat(tokens, runs).alias("other"))


def discover(seen: DataFrame, rounds: int = 3, least_score: float = 0.8, least_seeds: int = 3) -> DataFrame:
    """r1, r2, kind, start and stop of tokens that stand in patterns of a kind.

    A pattern counts only if least_seeds different identifiers vouch for it.
    """
    part = lambda kind, column: seen.select(*ROW, F.lit(kind).alias("kind"), F.explode(column).alias("o"))
    seed = part(KINDS[0], KINDS[0])
    for kind in KINDS[1:]:
        seed = seed.union(part(kind, kind))
    base = F.concat(*[F.col(k) for k in KINDS])
    free = F.filter("other", lambda x: ~F.exists(base, lambda b: (x["start"] < b["stop"]) & (b["start"] < x["stop"])))
    other = seen.select(*ROW, F.lit(None).cast("string").alias("kind"), F.explode(free).alias("o"))
    # copies of a text would vouch for one another, so that occurrences are counted once for each token and context
    mention = cut(seed.union(other).select(*ROW, "kind", "o.start", "o.stop", F.lower("o.token").alias("token"), "o.l1", "o.l2", "o.n1"))
    patterns = F.array(F.concat_ws(" ", F.lit("L2"), "l2", "l1"), F.concat_ws(" ", F.lit("LR"), "l1", "n1"))
    edge = mention.select("kind", "token", F.explode(patterns).alias("pattern")).distinct()
    total = edge.groupBy("pattern").agg(F.count_distinct("token").alias("n"))
    trusted = edge.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count_distinct("token").alias("s")).where(F.col("s") >= least_seeds)
    # a pattern may have very many tokens: what is known of patterns is joined first, and from an exchange of its own
    known = apart(trusted.select("pattern", "kind").join(total, "pattern"))
    kinds = cut(edge.select("pattern", "token", F.col("kind").alias("known")).join(known, "pattern"))
    belief = F.when(F.col("known").isNotNull(), (F.col("known") == F.col("kind")).cast("double"))
    now = kinds.withColumn("x", F.coalesce(belief, F.lit(0.0)))
    for _ in range(rounds):
        strength = now.groupBy("pattern", "kind").agg((F.sum("x") / (F.max("n") + 1)).alias("p"))
        scored = kinds.join(apart(strength), ["pattern", "kind"])
        token = scored.groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.999)))))).alias("t"))
        now = cut(kinds.join(apart(token), ["token", "kind"]).withColumn("x", F.coalesce(belief, F.col("t"))))
    good = now.groupBy("pattern", "kind").agg((F.sum("x") / (F.max("n") + 1)).alias("p")).where(F.col("p") >= least_score)
    hit = mention.where("kind IS NULL").drop("kind").withColumn("pattern", F.explode(patterns)).join(apart(good), "pattern")
    looks = F.lit(False)
    for kind in KINDS:
        looks = F.when(F.col("kind") == kind, _looks(kind, F.col("token"))).otherwise(looks)
    best = F.max(F.struct("p", "kind"))["kind"]
    return hit.where(looks).groupBy(*ROW, "start", "stop").agg(best.alias("kind"))


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted (rank, start, stop), comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _ranked(rank: int, column: str) -> Column:
    return F.transform(F.col(column), lambda x: F.struct(F.lit(rank).alias("rank"), x["start"].alias("start"), x["stop"].alias("stop")))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the row key, count of each kind, base_sha256, spans, and the spans as an array (all_spans), for every row of docs."""
    seen = cut(_seen(docs))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    new = discover(seen).groupBy(*ROW).agg(F.collect_list(F.struct(rank.alias("rank"), "start", "stop")).alias("new"))
    base = F.concat(*[_ranked(i, k) for i, k in enumerate(KINDS)])
    joined = seen.join(new, [*ROW], "left").withColumn("base", base)
    every = F.array_sort(F.concat("base", F.coalesce("new", F.array().cast("array<struct<rank:int,start:bigint,stop:bigint>>"))))
    return joined.select(
        "doc_id",
        *ROW,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
        every.alias("all_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; n_chars, where there is one, follows the text.

    Spans that overlap are replaced as one, named after the first.
    """
    found = find_spans(docs).where(F.size("all_spans") > 0).select(*ROW, F.col("all_spans").alias("spans")).dropDuplicates([*ROW])
    kinds = F.array(*map(F.lit, KINDS))
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["rank"].alias("rank"))))
    old = lambda c: F.col("doc").getField(c)
    text = old("text")

    def rebuilt(s: Column) -> Column:
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
        step = lambda a, x: F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["stop"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(
                x["stop"].alias("at"),
                F.concat(a["out"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.concat(F.lit("["), F.upper(F.get(kinds, x["rank"])), F.lit("]")))).alias("out"),
            )
        )
        done = F.aggregate(s, begin, step)
        return let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, (d["at"] + 1).cast("int"), F.length(text))))

    # the columns of docs stay in a struct, so that no name clashes
    whole = docs.select(F.struct("*").alias("doc"), *row_key(F.col("doc_id"), F.col("text"))).join(found, [*ROW], "left")
    whole = whole.withColumn("text", F.when(F.col("spans").isNotNull(), let(by_start, rebuilt)).otherwise(text))
    n_chars = F.when(F.col("spans").isNotNull(), F.length("text").cast("long")).otherwise(old("n_chars") if "n_chars" in docs.columns else F.lit(None))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return whole.select(*[(new[c] if c in new else old(c)).alias(c) for c in docs.columns])
