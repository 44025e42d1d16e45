"""Discovered personal data against plain loops, on texts with planted contexts."""

import random

import pytest

from orrery.llm import pii

from .brute import base_spans, discovered


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(21), []
    filler = ["lorem", "ipsum", "dolor", "sit", "amet", "the", "of", "é", "12", "7", "2024"]
    seed = {
        "phone": lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
        "Fax:": lambda: f"+44 {rng.randint(10**8, 10**9)}",
        "mail": lambda: f"u{rng.randint(0, 99)}@x{rng.randint(0, 9)}.org",
        "host=": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "the": lambda: f"10.0.0.{rng.randint(0, 255)}",
    }
    unseen = {"phone": lambda: f"555-{rng.randint(1000, 9999)}", "Fax:": lambda: f"({rng.randint(100, 999)}) 55 {rng.randint(10, 99)}!", "mail": lambda: f"root@local{rng.randint(0, 9)}", "host=": lambda: f"10.0.{rng.randint(300, 900)}.9", "the": lambda: str(rng.randint(10**6, 10**7))}
    for _ in range(160):
        words = rng.choices(filler, k=rng.randint(3, 25))
        for _ in range(rng.randint(0, 3)):
            anchor = rng.choice([*seed])
            value = (unseen if rng.random() < 0.25 else seed)[anchor]()
            words.insert(rng.randint(0, len(words)), f"{anchor}{rng.choice([' ', ' \t', chr(10)])}{value}")
        out.append(" ".join(words) + rng.choice(["", ".", " 💥"]))
    return out


def test_spans_are_those_of_plain_loops(spark, texts):
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    more = discovered(texts)
    assert sum(map(len, more)) >= 20
    for k, text in enumerate(texts):
        spans = sorted({*base_spans(text), *more[k]})
        assert got[k] == ",".join(f"{pii.KINDS[kind]}:{a}:{b}" for a, kind, b in spans), text


def test_added_spans_are_the_planted_ones(spark, texts):
    """What follows an everyday word is not taken for personal data, what follows a label is."""
    more = discovered(texts)
    found = {text[:a].split()[-1].lower() for text, own in zip(texts, more, strict=True) for a, _, _ in own}
    assert found == {"phone", "fax:", "mail", "host="}
