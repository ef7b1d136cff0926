"""Pages, archives, decontamination, personal data, toxicity and languages."""

import base64
import hashlib
import io
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import decontaminate as D
from lexloom.llm import html_text as H
from lexloom.llm import langid as L
from lexloom.llm import pii as P
from lexloom.llm import toxicity as X
from lexloom.llm import warc_zip as Z

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def test_article_of_a_page():
    page = (
        '<html><head><title>T</title><script>if (a < b) "</p>"</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
        '<div class="ad">Buy</div><article><h1>Head &amp; more</h1><p>First  <b>bold\n</b>text<p>Second<!-- x --><aside>no</aside></p>'
        '<div id="comments"><p>Great post!</p></div></article><footer>&copy;</footer></body>'
    )
    assert H.main_text(page) == "Head & more\nFirst bold text\nSecond"


def test_page_without_article():
    body = "<p>" + "word " * 40 + "</p>"
    page = f'<div class="cookie-notice">We use cookies</div><header>Site</header><div>{body}<p>short</p></div><div class="sidebar">x y z</div><form><p>{"a " * 60}</p></form>'
    assert H.main_text(page) == ("word " * 40).strip() + "\nshort"


@pytest.mark.parametrize("page", [None, "", "   ", "<p", "<", "<article>", "<div class='ad'><article><p>in</p>", '<a "' * 300, "<p>" * 5000])
def test_broken_pages(page):
    assert isinstance(H.main_text(page), str)


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<article><p>é\U0001f600</p></article>")], "page_id long, url string, html string")
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract_text(pages).collect()} == {1: ("", 0), 2: ("é\U0001f600", 2)}
    assert H.extract_text(pages.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_members_of_archives(monkeypatch, zip64):
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/data", b"x" * 50)
        z.writestr(zipfile.ZipInfo("index"), b"lines")
        z.writestr("packed", b"y" * 50, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a remark"
    found = Z.locate_members(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert {k: out.getvalue()[a : a + n] for k, (a, n) in found.items()} == {"a/data": b"x" * 50, "index": b"lines"}
    with pytest.raises(ValueError):
        Z.locate_members(io.BytesIO(b"not a zip"), 9)


def test_archives_round_trip(spark, monkeypatch):
    texts = ["<p>a</p>", None, "", "<p>a</p>", "é" * 50_000, "line\r\n\r\nline", "<p>a</p>"]
    pages = spark.createDataFrame([(10 + i, None if i == 5 else f"http://x/{i} \n", t, "z") for i, t in enumerate(texts)], "page_id long, url string, html string, digest string")
    rows = {r["page_id"]: r for r in Z.round_trip(pages).collect()}
    first = {}
    for i, t in enumerate(texts, 10):
        raw = (t or "").encode()
        first.setdefault(raw, i)
        r = rows[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[raw] == i else ("revisit", first[raw]))
    assert Z.round_trip(pages.where("page_id < 0")).count() == 0
    short = {r["page_id"]: r["record_type"] for r in Z.round_trip(pages, least_bytes=5).collect()}
    assert short[11] == short[12] == "response" and short[13] == "revisit"


def levenshtein_infix(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(60):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (90, 120))
        assert D.infix_distance(item, text)[0] == levenshtein_infix(item, text)


def test_items_are_found(spark, frame):
    rng, r = np.random.default_rng(4), random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(r.randrange(15, 60)) for _ in range(40)]
    texts, planted = [*ODD], {}
    for k, item in enumerate(items):
        edits = k % (D.allowed(len(D.normalise(item)), 0.1) + 1)
        texts.append(f"{prose(50)} {D._mutate(item, edits, rng)} {prose(80)}")
        planted[len(texts)] = k
    texts += [prose(200) for _ in range(30)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    for block in (20_000, 15):
        rows = D.find_items(frame(texts), bench, block=block).collect()
        brute = {(d, k) for d, k in planted.items() if levenshtein_infix(D.normalise(items[k]), D.normalise(texts[d - 1])) <= D.allowed(len(D.normalise(items[k])), 0.1)}
        got = {(x["doc_id"], x["item_id"]) for x in rows}
        assert got <= brute and len(got) >= 0.99 * len(brute)
    kept = {x["doc_id"] for x in D.drop_contaminated(frame(texts), bench).collect()}
    assert kept == set(range(1, len(texts) + 1)) - {d for d, _ in got}
    assert D.find_items(frame(texts), bench.where("item_id < 0")).count() == 0
    assert D.find_items(frame(["x"]).where("doc_id < 0"), bench).count() == 0


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def brute_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            d = re.sub(r"\D", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


HARD = [
    "a@b.c..foo@d.e x.y@z.q_w@e.f, é\U0001f600 +1 (980) 555-6268 and 4111 1111 1111 1111 then 4111-1111-1111-1111-1",
    "1.2.3.4.5.6.7.8 999.1.1.1 01.02.03.004 0000000001.2.3.4", "4111111111111111 " * 50, "1 2 3 4 5 " * 5000, "a" * 50_000 + "@b.c", "x@" + "a." * 10_000 + "b",
    "9" * 50_000, "+" * 500 + "1" * 20, "1.1.1.1" * 500, "+1 2 3 4 5 6 7 8", "user@host.org " * 700,
]


def test_fixed_forms(spark, frame):
    rng = random.Random(6)
    texts = [*ODD, *HARD, *("".join(rng.choice("a1 .-+@()4") for _ in range(200)) for _ in range(150))]
    rows = {r["doc_id"]: r for r in P.find_spans(frame(texts)).collect()}
    for i, t in enumerate(texts, 1):
        assert rows[i]["base_sha256"] == hashlib.sha256(brute_spans(t).encode()).hexdigest(), t[:80] if t else t


def test_contexts_discover(spark, frame):
    seeds = [f"Order {i}. call me on +1 (555) 010-{1000 + i} tonight please {'x' * (i % 5)}" for i in range(30)]
    hidden = [f"Later {k}. call me on 555-0{k}-{4000 + k} tonight please" for k in range(3)]
    clean = [f"page 1234567{k} of the annual report" for k in range(5)]
    rows = sorted(P.find_spans(frame(seeds + hidden + clean)).collect(), key=lambda r: r["doc_id"])
    new = [r["spans"] for r in rows if r["n_phone"] == 0]
    assert all(s.startswith("phone:") for s in new[:3]) and new[3:] == [""] * 5
    out = {r["doc_id"]: r for r in P.redact(frame(seeds + hidden + clean)).collect()}
    assert out[1]["text"] == "Order 0. call me on [PHONE] tonight please " and out[1]["n_chars"] == len(out[1]["text"])
    assert "[PHONE]" in out[31]["text"] and out[36]["text"] == clean[2]


def test_redaction_of_odd_rows(spark, frame):
    docs = frame([*ODD, "a@b.cc 1.2.3.4 a@b.cc", "a@b.cc 1.2.3.4 a@b.cc"])
    out = P.redact(docs)
    assert out.columns == docs.columns
    texts = [r["text"] for r in sorted(out.collect(), key=lambda r: r["doc_id"])]
    assert texts[:-2] == ODD and texts[-2:] == ["[EMAIL] [IP] [EMAIL]"] * 2
    assert P.find_spans(docs.where("doc_id < 0")).count() == 0


def test_trie_finds_misspellings():
    trie = X.Trie({"stupid": 5.0, "worthless": 4.0, "disgusting": 6.0, "vermin*": 3.0, "bad": 1.0})
    found = {w: trie.find(w) for w in ("stupid", "stupd", "stuupid", "sutpid", "worthles", "disgustin", "verminous", "vermn", "bed", "bad", "plain")}
    assert found["stupid"] == ("stupid", 0) and found["stupd"] == ("stupid", 1) and found["stuupid"] == ("stupid", 1)
    assert found["worthles"] == ("worthless", 1) and found["disgustin"] == ("disgusting", 1)
    assert found["verminous"] == ("vermin*", 0) and found["vermn"] == ("vermin*", 1)
    assert found["sutpid"] == ("stupid", 1) and found["bed"] is found["plain"] is None


def test_trie_finds_digits_and_symbols():
    trie = X.Trie({"stupid": 5.0, "idiot": 4.0, "scum": 3.0, "disgusting": 6.0})
    text = "An id1ot, $tupid; sc*m! and d1sgust1ng stuff by id-iots? 1234 x@y.org"
    assert [(h[0], h[1], h[2]) for h in X.hits(text, trie)] == [("id1ot", "idiot", 1), ("$tupid", "stupid", 1), ("sc*m", "scum", 1), ("d1sgust1ng", "disgusting", 2)]
    assert trie.find("scam") is None
    assert [h[0] for h in X.hits("stop!stupid", trie)] == ["stupid"]


def swaps_too(a, b):
    """Edits where a swap of neighbours is one."""
    d = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        d.append([i])
        for j in range(1, len(b) + 1):
            least = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                least = min(least, d[i - 2][j - 2] + 1)
            d[i].append(least)
    return d[-1]


def test_trie_against_all_distances():
    rng = random.Random(8)
    whole = ["".join(rng.choice("abc") for _ in range(n)) for n in (4, 5, 5, 6, 7, 9, 10, 12, 13)]
    starts = ["".join(rng.choice("abc") for _ in range(n)) for n in (6, 7, 10, 11)]
    trie = X.Trie({**dict.fromkeys(whole, 1.0), **{f"{t}*": 1.0 for t in starts}})
    for _ in range(4000):
        word = list(rng.choice(whole + starts)) + [rng.choice("abc") for _ in range(rng.choice([0, 0, 3]))]
        for _ in range(rng.randrange(4)):
            i, kind = rng.randrange(len(word)), rng.randrange(4)
            word[i : i + 1 + (kind == 3)] = [[rng.choice("abc")], [rng.choice("abc"), word[i]], [], word[i : i + 2][::-1]][kind]
            word = word or ["a"]
        word = "".join(word)
        if len(word) < 4:
            continue
        near = [(swaps_too(t, word)[-1], t) for t in whole] + [(min(swaps_too(t, word)), f"{t}*") for t in starts]
        best = min((d for d, t in near if d <= X.Trie.edits(t)), default=None)
        assert (trie.find(word) or (None, None))[1] == best, word


def test_quotation_weighs_less():
    trie, model = X.Trie({"stupid": 5.0}), X.Model({"stupid": 5.0}, {"stupid": 3.0})
    said, quoted = (model.score(X.hits(t, trie)) for t in ("you are stupid", 'they wrote "you are stupid" there'))
    assert said > quoted > model.score([])


def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = X.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert sum(toxic) > 0.85 * len(toxic) and sum(clean) < 0.01 * len(clean)


def test_toxicity_of_odd_rows(spark, frame):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    rows = X.toxicity(frame(ODD), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] < 0.5 for r in rows)
    assert X.toxicity(frame(ODD).where("doc_id < 0"), labels).count() == 0


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) > 0.98 * len(rows)


def test_mixture_proportions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL")
    langs, log_p = L.train(docs, 200)
    part = {r["lang"]: r["text"] for r in docs.where("n_chars > 3000").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    text = part["en"][:2000] + " " + part["de"][:1000]
    share = dict(zip(langs, L.mixture(log_p[:, (t := L.tally(L.trigrams(text)))[0]], t[1]), strict=True))
    assert share["en"] == pytest.approx(2 / 3, abs=0.08) and share["de"] == pytest.approx(1 / 3, abs=0.08) and share["fr"] == share["es"] == 0


def test_languages_of_odd_rows(spark, frame):
    texts = [*ODD, "12345 !?", None]
    rows = {r["doc_id"]: r for r in L.identify(frame(texts)).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, len(texts) - 1, len(texts))] == ["und"] * 5
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert L.identify(frame(texts).where("doc_id < 0")).count() == 0
    unlabelled = frame(texts).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in L.identify(unlabelled).collect()} == {"und"}
