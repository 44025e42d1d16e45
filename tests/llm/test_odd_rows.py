"""Every operator on rows that are odd: nulls in every column, empty and very long texts, ties, repeats, texts with a regular
build, no rows at all, and columns whose names clash with an operator's own."""

import hashlib
import re
import zlib

import numpy as np

import pytest

import corpus_pipeline
from orrery.llm import binary, bpe_trie, exact_dedup, lines, media, minhash, packing, pii, quality, tokens, toxicity
from orrery.llm.common import scratch
from orrery.llm.spans import HashTable

from .brute import components, shingles

CLASHING = ["row", "digest", "key", "group", "start", "end", "n", "kept", "removed", "added", "whole", "spans", "base", "rep", "band", "score", "doc", "page.id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def thue_morse(n, one="a", two="b"):
    return "".join(two if bin(i).count("1") % 2 else one for i in range(n))


TWINS = [thue_morse(1024), thue_morse(1024, "b", "a"), thue_morse(4096), thue_morse(4096, "b", "a")]
LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", " \n\t", "one", LINE, f"{LINE}\n{LINE} mu", "x " * 60_000, "y" * 200_000, *TWINS, *[" ".join(t[i : i + 1] for i in range(1024)) for t in TWINS[:2]]]
    out = list(enumerate(texts, 1)) + [(5, LINE), (5, LINE), (5, "another text under the same id"), (None, LINE), (None, LINE), (None, "only here " * 9), (None, None), (1 << 60 | 1, "a late one"), (60, None), (61, "")]
    return [(i, t, None if k % 3 else "en", None, len(t) if t and k % 2 else None) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *[str(k)] * len(CLASHING)) for k, r in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 0, 1), (6, 1, None), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")


def pairs(rows):
    return sorted((str(i), t or "") for i, t, *_ in rows)


def test_toxicity(docs, rows, empty, labels):
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    kept = toxicity.reject(docs, toxicity.Model({"alpha$": 5.0}, [5.0, 0.0, 0.0, 0.0, 0.0, -0.5]))
    assert kept.columns == docs.columns and kept.count() == sum(LINE not in (t or "") for _, t, *_ in rows)
    assert toxicity.train(empty, labels).weights == [] and toxicity.score(empty, model).count() == toxicity.reject(empty, model).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def test_bpe_like_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_trie.tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe_trie.round_trip(docs).collect()) == sorted(want)
    assert bpe_trie.round_trip(empty).count() == bpe_trie.encode(empty).count() == 0
    back = bpe_trie.decode(bpe_trie.encode(docs)).collect()
    assert sorted((str(r["doc_id"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in back) == sorted((w[0], w[3]) for w in want)


def test_pieces_under_one_hash_keep_their_ids(monkeypatch):
    """With all hashes equal, bytes alone tell pieces apart."""
    monkeypatch.setattr(tokens, "byte_hashes", lambda raw, starts, ends: np.full(len(starts), 7, np.uint64))
    table = tokens.PieceTable(4)
    raw = np.frombuffer(b"aabbaacc", np.uint8)
    for _ in range(3):
        ids, n = table.encode(raw, np.array([0, 2, 4, 6]), np.array([2, 4, 6, 8]), lambda ps: [[p[0], p[0]] for p in ps])
        assert ids.tolist() == [97, 97, 98, 98, 97, 97, 99, 99] and n.tolist() == [2] * 4
    assert HashTable(4).find(np.array([7], np.uint64)).tolist() == [-1]


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_trie.tokenizer_path("byte_bpe_50k.json"))
    want = {}
    for i, x, *_ in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(i, []).append(ids)
    got, places = packing.pack(docs).collect(), {}
    for r in got:
        cut = [zlib.crc32(w[r["start"] : r["start"] + r["length"]].tobytes()) for w in want[r["doc_id"]] if len(w) == r["doc_tokens"]]
        assert r["ids_crc32"] in cut
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(len(w) for ws in want.values() for w in ws) and {r["doc_id"] for r in got} == set(want)
    for own in places.values():
        ends = [a + n for a, n in sorted(own)]
        assert [0, *ends[:-1]] == [a for a, _ in sorted(own)] and ends[-1] <= 2048
    assert packing.pack(empty).count() == 0


def test_binary(spark, docs, rows, empty):
    got = sorted(binary.files(docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    folder = scratch(spark, "parts")
    parts = binary.write(docs, folder, part_bytes=100_000)
    assert parts.count() > 3
    again = binary.read_back(spark, folder, parts).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert binary.files(empty).count() == 0


def test_near_duplicates(docs, rows, empty):
    sets = {k: shingles(t or "") for k, (_, t, *_) in enumerate(rows)}
    root = components(sets)
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[root[k]] = min((x for x in (least.get(root[k]), i) if x is not None), default=None)
    want = sorted((str(i), len(sets[k]), str(least[root[k]] if sets[k] else i)) for k, (i, *_) in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in minhash.near_duplicates(docs).collect()) == want
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({root[k] for k in sets if sets[k]}) + sum(not s for s in sets.values())
    assert minhash.near_duplicates(empty).count() == minhash.deduplicate(empty).count() == 0


def test_personal_data(docs, rows, empty):
    got = pii.find(docs).collect()
    assert len(got) == len(rows) and {r["spans"] for r in got} == {""} and {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and pairs(clean.select("doc_id", "text").collect()) == pairs(rows)
    assert pii.find(empty).count() == pii.redact(empty).count() == 0


def test_lines(docs, rows, empty):
    seen, want = set(), []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        out = []
        for part in re.split("(\n)", t or ""):
            norm = " ".join(part.lower().split())
            if len(norm.split()) >= 6 and norm in seen:
                part = re.match(r"\s*", part)[0] + re.search(r"\s*$", part)[0]
            seen.add(norm)
            out.append(part)
        want.append((i, "".join(out)))
    clean = lines.clean(docs)
    assert clean.columns == [*docs.columns, "removed_spans"]
    assert pairs(clean.select("doc_id", "text").collect()) == pairs(want)
    again = lines.clean(clean.limit(2))
    assert again.columns == clean.columns and lines.clean(empty).count() == lines.removed_units(empty).count() == 0


def test_exact_groups(docs, rows, empty):
    body = [re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t, *_ in rows]
    best = {}
    for (i, t, *_), b in zip(rows, body, strict=True):
        best[b] = min(best.get(b, (1,)), (-len(t or ""), i is None, i or 0, i))
    want = sorted((str(i), str(best[b][3]), body.count(b)) for (i, *_), b in zip(rows, body, strict=True))
    for least in (2, 256):
        got = exact_dedup.groups(docs, least=least).collect()
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == want and sum(r["kept"] for r in got) == len(best)
        kept = exact_dedup.deduplicate(docs, least=least)
        assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(b[3]) for b in best.values())
    assert exact_dedup.groups(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def test_exact_null_text_and_empty_text_agree(spark):
    docs = spark.createDataFrame([(4, None), (5, "")], "doc_id long, text string")
    assert [r["doc_id"] for r in exact_dedup.deduplicate(docs).collect()] == [4] == [r["doc_id"] for r in exact_dedup.groups(docs).filter("kept").collect()]


def test_media(spark):
    rng = np.random.default_rng(3)
    grey = np.kron(rng.integers(0, 255, (20, 20)), np.ones((5, 5)))
    image = bytearray(media.write_image(grey))
    data = [(1, image), (1, image), (None, image), (None, None), (2, None), (3, bytearray(media.write_image(np.full((64, 64), 9.0)))), (4, bytearray())]
    frame = spark.createDataFrame([(*r, "x", "y") for r in data], "id long, image binary, rep string, entry string")
    got = sorted((str(r["id"]), str(r["component_id"])) for r in media.copies(frame).collect())
    assert got == sorted([("1", "1"), ("1", "1"), ("None", "1"), ("None", "None"), ("2", "2"), ("3", "3"), ("4", "4")])


def test_quality(docs, rows, empty, labels):
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(r["kept"] is False for r in got if r["perplexity"] is None)
    assert quality.classify(empty, labels).count() == 0
    assert all(r["kept"] for r in quality.classify(docs, labels.limit(0)).collect() if r["perplexity"] is not None)


def test_pipeline(spark, docs, rows, empty, labels, tmp_path):
    for frame, name in ((docs, "odd"), (empty, "none")):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    kept = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert {r["doc_id"] for r in kept.collect()} <= {i for i, *_ in rows} and kept.count() > 5
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
