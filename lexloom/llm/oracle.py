"""SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
_COUNT = "coalesce(len(regexp_extract_all(text, '{}')), 0)::BIGINT"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    m AS (SELECT *, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {_COUNT.format('[#*$%&|<>]')} AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM d),
    tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM m)),
    twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
    f AS (SELECT m.*, coalesce(covered.n, 0) AS n_repeat_words FROM m LEFT JOIN covered USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
    OR n_symbols > 0.25 * n_words OR {_COUNT.format(chr(92) + 'p{Lu}')} > 0.5 * word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 2 * n_dup_lines > len(lines) OR 2 * length(regexp_replace(text, '\P{{L}}+', '', 'g')) < word_chars
    OR len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 0.3 * len(lines)) AS kept FROM b"""

_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
MIX_SOURCES = rf"""
WITH s AS (SELECT doc_id, source, {_COUNT.format('[^' + chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D]+')} AS size, {_COUNT.format('[#*$%&|<>]')} AS symbols,
        md5(coalesce(text, '')) AS digest FROM documents),
    k AS (SELECT *, -ln((('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || digest), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / greatest(0.05::DOUBLE, 1 - symbols::DOUBLE / greatest(size, 1)) AS key FROM s),
    g AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s GROUP BY source),
    c AS (SELECT source, ss, [5, 2, 1][((r - 1) % 3 + 1)::INT] AS w, 3 * ss AS cap FROM g),
    l AS (SELECT *, (sum(ss) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST {_BEFORE}), 0))::DOUBLE
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST {_BEFORE}), 0)) AS level FROM c),
    t AS (SELECT source, ss AS source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target FROM l),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
    p AS (SELECT k.doc_id, k.source, k.size, e.source_size, e.target, e.epochs, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id {_BEFORE}), 0) AS ahead
        FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, epochs,
    (epochs * size + CASE WHEN ahead + size / 2 <= target - epochs * source_size THEN size ELSE 0 END)::BIGINT AS taken FROM p"""


EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def _vector_codes(rounds: int = 6) -> str:
    """Lloyd rounds, each a pair of tables: nearest entries, then their members' means."""
    nearest = """a{0} AS MATERIALIZED (SELECT r, part, min({{'d': list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': entry}}) AS m
        FROM p JOIN c{0} c USING (part) GROUP BY r, part)"""
    means = """c{1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{0} c LEFT JOIN (
        SELECT part, entry, list(mean ORDER BY i) AS v FROM (
            SELECT part, a.m.e AS entry, i, floor(sum(p.v[i]) / count(*))::BIGINT AS mean FROM p JOIN a{0} a USING (r, part), places GROUP BY part, a.m.e, i)
        GROUP BY part, entry) m USING (part, entry))"""
    steps = ", ".join(f"{nearest.format(k)}, {means.format(k, k + 1)}" for k in range(rounds)) + ", " + nearest.format(rounds)
    return f"""
WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    places AS (SELECT unnest(range(1, (SELECT max(len(x)) // 8 FROM k) + 1)) AS i),
    p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 8) + 1:(part + 1) * (len(x) // 8)] AS v FROM k, (SELECT unnest(range(8)) AS part)),
    c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM p WHERE r <= 16), {steps},
    coded AS (SELECT r, string_agg(format('{{:02x}}', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN coded USING (r)"""


VECTOR_CODES = _vector_codes()
