"""The registered language query against a plain version with dictionaries and loops."""

import binascii
import math

import pytest

from lexloom.llm.queries import QUERIES

M = 0xFFFFFFFF


def buckets(text):
    out = []
    letters = [c if c.isalpha() else "" for c in text.lower()]
    if not any(letters):
        return out
    padded = ["", *letters, ""]
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        if b:
            a, b, c = ((ord(x) if x else 0) for x in (a, b, c))  # noqa: PLW2901
            h = (a * 0x9E3779B1 & M) ^ (b * 0x85EBCA77 & M) ^ (c * 0xC2B2AE3D & M)
            out.append(((h ^ (h >> 15)) * 0x27D4EB2F & M) >> 16)
    return out


def fit(p, n, chosen, rounds=12):
    share, total = [1 / len(chosen)] * len(chosen), sum(n)
    for _ in range(rounds if len(chosen) > 1 else 0):
        new = [0.0] * len(chosen)
        for j, k in enumerate(n):
            joint = [s * p[i][j] for s, i in zip(share, chosen, strict=True)]
            for i, x in enumerate(joint):
                new[i] += k * x / sum(joint) / total
        done = max(abs(a - b) for a, b in zip(new, share, strict=True)) < 1e-3
        share = new
        if done:
            break
    return sum(k * math.log(sum(s * p[i][j] for s, i in zip(share, chosen, strict=True))) for j, k in enumerate(n)), share


def brute(docs):
    held = {i: binascii.crc32(b"" if i is None else str(i).encode()) % 4 == 2 for i, _, _ in docs}
    counts = {}
    for i, text, lang in docs:
        if not held[i] and lang is not None and text is not None:
            for b in buckets(text):
                counts.setdefault(lang, {})[b] = counts.setdefault(lang, {}).get(b, 0) + 1
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * 65536 for x in langs}
    out = {}
    for i, text, _ in docs:
        found = {}
        for b in buckets(text or ""):
            found[b] = found.get(b, 0) + 1
        if not found:
            out[i] = (held[i], "und", 0.0)
            continue
        keys, n = list(found), list(found.values())
        log_p = [[math.log((counts[x].get(b, 0) + 0.5) / total[x]) for b in keys] for x in langs]
        top = [max(row[j] for row in log_p) for j in range(len(keys))]
        p = [[math.exp(v - t) for v, t in zip(row, top, strict=True)] for row in log_p]
        alone = [sum(v * k for v, k in zip(row, n, strict=True)) for row in log_p]
        chosen = [alone.index(max(alone))]
        best, share = fit(p, n, chosen)
        _, overall = fit(p, n, list(range(len(langs))))
        for k in sorted(range(len(langs)), key=lambda k: -overall[k]):
            if k in chosen or overall[k] < 0.01:
                continue
            value, more = fit(p, n, [*chosen, k])
            if value - best <= 4 * math.log(sum(n) + 1):
                break
            chosen, best, share = [*chosen, k], value, more
        s, k = max((s, -k) for s, k in zip(share, chosen, strict=True))
        out[i] = (held[i], langs[-k], s)
    return out


def test_languages_equal_plain_inference(spark, tmp_path):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL").selectExpr("text", "lang").limit(60).collect()
    cut = [(r["text"][:300], r["lang"]) for r in real]
    mixed = [(cut[0][0] + " " + next(t for t, x in cut if x != cut[0][1]), cut[0][1])]
    rows = [(i, t, x, "s", len(t)) for i, (t, x) in enumerate([*cut, *mixed])] + [(900, None, "en", "s", 0), (901, "123 !", "en", "s", 5), (None, cut[1][0], cut[1][1], "s", 9), (902, "Ünïcode ǅ 𐐷 text", None, "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([r[:3] for r in rows])
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in QUERIES["op9_language_id"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for i, (held, lang, score) in want.items():
        assert got[i][:2] == (held, lang) and got[i][2] == pytest.approx(min(1.0, score), abs=2e-3), i
