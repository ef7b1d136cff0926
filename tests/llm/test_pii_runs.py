"""Addresses without digits and identifiers of several words, found by their contexts."""

from lexloom.llm import pii as P


def test_contexts_discover_addresses_without_digits_and_spaced_groups(spark, frame):
    cards = ["4111 1111 1111 1111", "5555 5555 5555 4444", "6011 1111 1111 1117", "3530 1113 3330 0000", "5105 1051 0510 5100"]
    seeds = [f"Order {i}. call me on +1 (555) 010-{1000 + i} tonight please" for i in range(30)]
    seeds += [f"Please write to user{i}@host{i}.org about details" for i in range(30)]
    seeds += [f"Shop {i} did charge my card {c} yesterday at noon" for i in range(3) for c in cards]
    hidden = {
        "Later. call me on 555 010 4000 tonight please": ("phone", "555 010 4000"),
        "Again. call me on (030) 123 45 67 tonight please": ("phone", "(030) 123 45 67"),
        "Please write to anna@intranet about details": ("email", "anna@intranet"),
        "Please write to name@localhost about details": ("email", "name@localhost"),
        "Shop 9 did charge my card 3782 822463 10005 yesterday at noon": ("card", "3782 822463 10005"),
    }
    clean = ["rows 555 010 4000 of the annual report", "meet anna@noon maybe", "1 2 3 4 5 6 7 8 9 " * 3000]
    docs = frame([*seeds, *hidden, *clean])
    spans = {r["doc_id"]: r["spans"] for r in P.find_spans(docs).collect()}
    for i, (text, (kind, token)) in enumerate(hidden.items(), len(seeds) + 1):
        assert spans[i] == f"{kind}:{text.index(token)}:{text.index(token) + len(token)}", text
    assert [spans[len(seeds) + len(hidden) + i] for i in (1, 2, 3)] == [""] * 3
    out = {r["doc_id"]: r["text"] for r in P.redact(docs).collect()}
    assert out[len(seeds) + 1] == "Later. call me on [PHONE] tonight please"
