"""The n-gram model against plain loops over dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import quality
from orrery.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, kept string, n string, block string, ids string, lang_ string"


class Plain:
    """Interpolated modified Kneser-Ney of one language."""

    def __init__(self, docs, order):
        self.order = order
        self.levels = {order: Counter(tuple(d[i : i + order]) for d in ([quality.START] * (order - 1) + d for d in docs) for i in range(len(d) - order + 1))}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.off, self.total, self.left = {}, defaultdict(float), defaultdict(float)
        for k, level in self.levels.items():
            n = [max(1, sum(c == j for c in level.values())) for j in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1])
            self.off[k] = [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.05), j - 0.05) for j in (1, 2, 3)]
            for g, c in level.items():
                self.total[g[:-1]] += c
                self.left[g[:-1]] += self.off[k][min(c, 3) - 1]

    def p(self, gram):
        shorter = self.p(gram[1:]) if len(gram) > 1 else 1 / quality.VOCABULARY
        context = gram[:-1]
        if context not in self.total:
            return shorter
        c = self.levels[len(gram)][gram]
        own = c - self.off[len(gram)][min(c, 3) - 1] if c else 0.0
        return (own + self.left[context] * shorter) / self.total[context]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    words = {lang: ["".join(rng.choice(["ba", "ne", "tion", "the", "é", "123"]) for _ in range(rng.randint(1, 3))) for _ in range(25)] for lang in ("en", "fr", None)}
    out = [(i, " ".join(rng.choices(words[lang], k=rng.randint(1, 40))), lang) for i in range(180) for lang in [rng.choice(["en", "fr", None])]]
    out += [(500, "", "en"), (501, None, "fr"), (502, " \n", None), (503, "unknown tongue 7 7 7", "xx"), (None, "ba ne ba", "en"), (7, out[7][1], out[7][2]), (8, "same id other text", "en")]
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_perplexity_is_that_of_plain_loops(spark, rows, order):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(180)] + [(7, 0), (None, 1)], "doc_id long, quality int")
    learned = {r["i"] for r in spark.range(180).select(F.col("id").alias("i")).filter(quality.counted(F.col("i"))).collect()}
    ids = [t.encode(x or "", add_special_tokens=False).ids for _, x, _ in rows]
    own = [k for k, (i, *_) in enumerate(rows) if i in learned and i % 3 > 0]
    models = {lang: Plain([ids[k] for k in own if rows[k][2] == lang], order) for lang in ("en", "fr", None)} | {"xx": Plain([ids[k] for k in own], order)}
    assert abs(sum(models["en"].p((ids[0][0], w)) for w in range(quality.VOCABULARY)) - 1) < 1e-9
    want = []
    for (i, _, lang), d in zip(rows, ids, strict=True):
        d2 = [quality.START] * (order - 1) + d
        logs = [math.log(models[lang].p(tuple(d2[j : j + order]))) for j in range(len(d))]
        want.append((str(i), str(lang), math.exp(-sum(logs) / len(d)) if d else None))
    got = sorted(((str(r["doc_id"]), str(r["lang"]), r["perplexity"]) for r in quality.classify(docs, labels, order=order, shard_pieces=700).collect()), key=str)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:2] == w[:2] and (g[2] is w[2] is None or abs(g[2] / w[2] - 1) < 1e-4), (g, w)


def test_sketch_forgets_no_id(spark):
    docs = spark.createDataFrame([(i,) for i in range(3000)] + [(None,)], "doc_id long")
    got = {r["doc_id"]: r["maybe"] for r in quality.flagged(docs, docs.filter("doc_id % 7 = 0").select("doc_id"), bits=15).collect()}
    assert len(got) == 3001 and not got[None] and all(got[i] for i in range(0, 3000, 7)) and sum(got.values()) < 700


def test_folded_pieces_come_back_and_pack_better():
    rng = np.random.default_rng(5)
    following = rng.integers(0, 2000, (2000, 12)).astype(np.uint16)  # each piece has few that follow it
    draws = np.minimum(rng.geometric(0.3, 400_000), 12) - 1
    ids, last = np.zeros(len(draws), np.uint32), 7
    for k, d in enumerate(draws.tolist()):
        ids[k] = last = int(following[last, d])
    sizes = np.array([0, 1, 255, 256, 257, 0, 513, 300_000, len(ids) - 301_282, 0], np.int64)
    followers, ranks = quality.folded(ids, sizes)
    assert quality.unfolded(followers, ranks, sizes).tolist() == ids.tolist()
    assert len(followers) + len(ranks) < 0.5 * len(quality.packed(ids.astype("<u2")))
    for few in ([], [0], [0, 0], [3]):
        few = np.array(few, np.int64)
        assert quality.unfolded(*quality.folded(ids[: few.sum()], few), few).tolist() == ids[: few.sum()].tolist()


def test_blocks_hold_folded_pieces(spark):
    words = "the quick brown fox jumps over a lazy dog while seven small birds sing".split()
    rng = np.random.default_rng(6)
    text = [" ".join(words[j % len(words)] for j in np.cumsum(rng.integers(1, 3, 4000))) for _ in range(8)]
    rows = spark.createDataFrame([(k, "en", t, False) for k, t in enumerate(text)], "doc_id long, lang string, text string, maybe boolean").coalesce(1)
    held = [r.asDict() for r in quality.tokenised(rows).collect()]
    assert sum(len(x) for r in held for x in r.values() if isinstance(x, (bytes, bytearray))) < 0.2 * sum(sum(r["sizes"]) for r in held)
