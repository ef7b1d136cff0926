"""Quotations on long lines, and documents with many hits."""

from lexloom.llm import toxicity as X


def test_quotation_is_read_over_the_whole_line():
    trie = X.Trie({"stupid": 5.0})
    text = 'x "' + "word " * 900 + "stupid " + "word " * 900 + '" then stupid\nstupid "stupid"'
    assert [h[3] for h in X.hits(text, trie)] == [True, False, False, True]


def test_gathered_hits_weigh_as_all():
    trie, model = X.Trie({"stupid": 0.01}), X.Model({"stupid": 0.01}, {"stupid": 0.01})
    found = X.hits("stupid " * 300 + "stupd", trie)
    assert len(found) == 301 and len(X.gathered(found)) == 2
    assert all(abs(a - b) < 1e-9 for a, b in zip(model.sums(found), model.sums(X.gathered(found)), strict=True))


def quoted(text):
    return [h[3] for h in X.hits(text, X.Trie({"stupid": 5.0}))]


def test_kinds_of_quotation():
    for a, b in ("“”", "„“", "«»", "»«", "‘’", "‚‘", "''", '""', "‹›"):
        assert quoted(f"they wrote {a}you are stupid{b} there, stupid") == [True, False], a
    assert quoted("she said “it is\nstupid” and\nstupid") == [True, False]
    assert quoted("> you are stupid\nstupid\n  > stupid") == [True, False, True]
    assert quoted("don't be stupid, it's not") == quoted("the dogs' stupid owner’s friends") == [False]
    assert quoted('an open " mark\n\n\nstupid\n\n\nand " another') == [False]


def test_spellings():
    trie = X.Trie({"stupid": 5.0, "idiot": 4.0})
    found = lambda t: [(h[1], h[2]) for h in X.hits(t, trie)]
    for text in ("s.t.u.p.i.d", "s t u p i d", "s-t-u-p-i-d", "stuuuuupid", "STUUUUPID", "5tup1d"):
        assert found(f"so {text} of you") == [("stupid", 1)], text
    assert found("what an 1d10t") == [("idiot", 1)] and found("stupid") == [("stupid", 0)]
    assert found("u s a n d s o o n") == found("a.b.c.d") == found("hmmmmm") == []


def test_scores_equal_brute_force_over_hits():
    """The score from hits as lists, by hand, with windows over words counted one by one."""
    import math
    import random

    rng = random.Random(4)
    trie = X.Trie({"stupid": 3.0, "idiot*": 2.0})
    model = X.Model({"stupid": 3.0, "idiot*": 2.0}, {"stupid": 1.5, "idiot*": 1.0}, frozenset({"stupic"}), (0.7, 0.4), -2.0)
    forms = {"stupid": ("stupid", 0), "stupd": ("stupid", 1), "idiots": ("idiot*", 0), "stupic": ("stupid", 1)}
    for _ in range(200):
        words = [rng.choice([*forms, "word", "other", "and", "more", "of", "it"]) for _ in range(rng.randrange(0, 60))]
        exact = fuzzy = 0.0
        at = [i for i, w in enumerate(words) if w in forms]
        for i in at:
            term, edits = forms[words[i]]
            company = 1.25 if any(j != i and -10 <= j - i < 10 or j - i == 10 for j in at if j != i) else 1.0
            if edits and words[i] not in model.clean:
                fuzzy += model.fuzzy[term] * company / edits
            elif not edits:
                exact += model.weights[term] * company
        want = 1 / (1 + math.exp(-(model.offset + 0.7 * exact + 0.4 * fuzzy)))
        assert abs(model.score(X.hits(" ".join(words), trie)) - want) < 1e-12
