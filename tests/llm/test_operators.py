"""The training-data operators against brute-force versions, the library and round trips, with odd rows among the input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import binary, bpe_trie, exact_dedup, lines, media, minhash, packing, pii, quality, toxicity
from orrery.llm import components as component_parts
from orrery.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"


def words(rng, n):
    return " ".join("".join(rng.choice(["ba", "ne", "ti", "or", "the", "É", "ñu"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    out = [(1, base), (2, " ".join(near)), (3, base.replace(" ", "  ")), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One  two"), (9, words(rng, 9000))]
    out += [(10 + i, words(rng, rng.randint(1, 300))) for i in range(12)] + [(30, base)] * 2
    out += [(40, "mail a.b@c.de, 10.0.0.1 and 999.1.1.1; +1 (234) 555-6789, 4111 1111 1111 1111 or 4111111111111112"), (41, "é💥 x@y.zz@q.rr <|endoftext|> don't 12x")]
    return [(i, t, "en", None, len(t or ""), None) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, rows, empty):
    body = {i: re.sub(r"[\x20\x09-\x0D]+", "", t or "") for i, t, *_ in rows}
    points = {i: len(t or "") for i, t, *_ in rows}
    got = exact_dedup.groups(docs, least=2).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [i for i, *_ in rows if body[i] == body[r["doc_id"]]]
        assert r["keep_id"] == min(same, key=lambda i: (-points[i], i)) and r["group_size"] == len(same)
        assert r["text_sha256"] == hashlib.sha256(body[r["doc_id"]].encode()).hexdigest()
    assert sum(r["kept"] for r in got) == len(set(body.values()))
    kept = exact_dedup.deduplicate(docs, least=2)
    assert kept.columns == docs.columns and kept.count() == len(set(body.values()))
    assert exact_dedup.groups(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, rows, empty):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(empty).count() == 0


def test_bpe_like_the_library(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_trie.tokenizer_path("word_bpe_49k.json"))
    texts = {i: x or "" for i, x, *_ in rows}
    for r in bpe_trie.round_trip(docs).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_binary_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_trie.tokenizer_path("word_bpe_49k.json"))
    got = sorted(binary.files(docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(i for i, *_ in rows)
    texts, at = {i: x or "" for i, x, *_ in rows}, 0
    for r in got:
        ids = np.array([*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    folder = scratch(spark, "none")
    assert binary.read_back(spark, folder, binary.write(empty, folder)).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_trie.tokenizer_path("byte_bpe_50k.json"))
    got = packing.pack(docs).collect()
    texts, held, seen = {i: x or "" for i, x, *_ in rows}, {}, {}
    for r in got:
        ids = np.array([*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert all(seen[r["doc_id"]] % r["doc_tokens"] == 0 for r in got) and packing.pack(empty).count() == 0


def test_differencing_fills_windows():
    rng = random.Random(1)
    sizes = [rng.randint(1, 512) for _ in range(800)]
    parts = packing.windows(sizes, 2048)
    assert sorted(i for p in parts for i in p) == list(range(800))
    assert max(sum(sizes[i] for i in p) for p in parts) <= 2048 and len(parts) <= -(-sum(sizes) // 2048) + 3
    assert packing.windows([], 2048) == []


def test_personal_data(docs, empty):
    r = pii.find(docs).filter("doc_id = 40").first()
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert r["spans"] == "email:5:13,ip:15:23,phone:39:56,card:58:77"
    assert pii.find(docs).filter("doc_id = 41").first()["spans"] == "email:3:9"
    text = pii.redact(docs).filter("doc_id = 40").first()["text"]
    assert text == "mail <EMAIL>, <IP> and 999.1.1.1; <PHONE>, <CARD> or 4111111111111112"
    assert pii.redact(docs).columns == docs.columns and pii.find(empty).count() == pii.redact(empty).count() == 0


def test_lines(spark, empty):
    shared = "alpha beta gamma delta epsilon zeta eta."
    docs = spark.createDataFrame([(2, f"x y. {shared} end"), (1, f"É\n{shared}\n{shared.upper()}"), (3, None), (4, "short one.\nshort one.")], "doc_id long, text string")
    got = sorted(tuple(r) for r in lines.removed_units(docs).select("doc_id", "start", "end", "kept_doc_id", "kept_start").collect())
    n = len(shared)
    assert got == [(1, 2 + n + 1, 2 + 2 * n + 1, 1, 2), (2, 5, 5 + n, 1, 2)]
    assert {r["doc_id"]: r["text"] for r in lines.clean(docs).collect()}[2] == "x y.  end"
    assert lines.removed_units(empty).count() == 0


def test_lines_of_short_sentences(spark):
    line = "one two. three four! five six? seven."
    mixed = "Short one. alpha beta gamma delta epsilon zeta eta."
    long = "alpha beta gamma delta epsilon zeta eta."
    docs = spark.createDataFrame([(1, f"a b\n{line}\n{mixed}"), (2, f"É {line}\n{line.upper()}"), (3, f"{mixed}\nnew. {long}"), (4, "one two. three.\none two. three.")], "doc_id long, text string")
    got = sorted(tuple(r) for r in lines.removed_units(docs).select("doc_id", "start", "end", "kept_doc_id", "kept_start").collect())
    n, m = len(line), len(mixed)
    assert got == [(2, n + 3, 2 * n + 3, 1, 4), (3, 0, m, 1, n + 5), (3, m + 6, m + 6 + len(long), 1, n + 5 + 11)]
    assert {r["doc_id"]: r["text"] for r in lines.clean(docs).collect()}[3] == "\nnew. "


def test_toxicity(spark, empty):
    rng, rows, labels = random.Random(3), [], []
    for i in range(900):
        toxic = i % 4 == 0
        rows.append((i, words(rng, 60) + (" you blorkface. " + words(rng, 20) if toxic else ""), "en", "s", 1, None))
        labels.append((i, 1, int(toxic)))
    rows += [(9000, None, None, None, None, None), (9001, "", "", "", 0, None)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if got[i]["held_out"]]
    assert {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0} == set(held)
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert 0 <= got[9000]["score"] == got[9001]["score"] < 0.5
    assert toxicity.reject(docs, model).columns == docs.columns
    assert toxicity.score(empty, toxicity.train(empty, marks)).count() == 0


def test_toxicity_scores_a_clause_with_only_a_whole_word():
    grammar = toxicity.Grammar({"zog$": 2.0})
    assert grammar.features("Hello. You zog! Bye.")[0] > 0 == grammar.features("Hello. You zogs! Bye.")[0]
    assert grammar.features("Hello. You zog idiot! Bye.")[0] > 0


def clause_by_hand(words, levels):
    """The sum over insults and threats of their weight and its shares, each no less than nothing."""
    kind = {w: c for c, ws in toxicity.CLASSES.items() for w in ws.split()}
    marks = [kind.get(w, "o") for w in words]
    total = 0.0
    for k, w in enumerate(words):
        near = "y" in marks[max(0, k - toxicity.BEFORE) : k] or "y" in marks[k + 1 : k + 1 + toxicity.AFTER]
        if marks[k] == "v":
            base = toxicity.THREAT if near or "w" in marks[max(0, k - toxicity.INTENT) : k] else 0
        else:
            base = levels.get(w, 0)
        share = 1 + toxicity.TARGETED * near - toxicity.DENIED * ("n" in marks[max(0, k - toxicity.NEGATED) : k]) - toxicity.QUOTED * ("r" in marks[:k])
        total += max(0.0, base * share)
    return total


def test_toxicity_grammar_against_sums_by_hand():
    rng, levels = random.Random(11), {"blork": 6, "zog": 2}
    grammar = toxicity.Grammar({f"{w}$": float(n) for w, n in levels.items()})
    assert grammar.clause("you blork".split()) == grammar.clause("blork you".split()) == 9.0 > grammar.clause("they said you are a blork".split())
    for _ in range(4000):
        words_ = rng.choices(["blork", "zog", "kill", "will", "you", "not", "said", "a", "b"], k=rng.randint(0, 9))
        assert abs(grammar.clause(words_) - clause_by_hand(words_, levels)) < 1e-9, words_


def test_quality_keeps_trusted_and_drops_junk(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 80), "en", None, 1, None) for i in range(200)] + [(500, "#@! " * 80, "en", None, 1, None), (501, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs, spark.createDataFrame([(i, 1) for i in range(150)], "doc_id long, quality int")).collect()}
    assert not got[500] and not got[501] and sum(got[i] for i in range(200)) >= 190


def test_quality_judges_each_of_nine_languages_by_its_own(spark):
    rng = random.Random(8)
    rows = [(100 * k + i, words(rng, 60), f"l{k}", None, 1, None) for k in range(8) for i in range(30)]
    rows += [(900 + i, "".join(rng.choice("0123456789#@") for _ in range(60)), None if i % 2 else "small", None, 1, None) for i in range(40)]
    rows += [(2000, words(rng, 60), "new", None, 1, None)]
    labels = spark.createDataFrame([(r[0], 1) for r in rows if r[0] < 2000], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert len(got) == len(rows) and got[2000]["perplexity"] is not None
    assert len({got[i]["threshold"] for i in [*range(0, 800, 100), 900, 901]}) == 10
    assert sum(got[900 + i]["kept"] for i in range(40)) >= 38


def test_encoder_keeps_few_words_and_workers_give_memory_back(monkeypatch):
    from orrery.llm import common, tokens

    path = tokens.tokenizer_path("word_bpe_49k.json")
    encoder, calls = tokens.WordBpe(path, tokens.library_words(path)), []
    monkeypatch.setattr(common, "trim", lambda: calls.append(1))
    column = pa.array([" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}q" for k in range(a, a + 30_000)) for a in range(0, 180_000, 30_000)])
    for part in tokens.texts_by_slice(iter([pa.record_batch({"text": column})]), 100_000):
        encoder.encode(part.column("text"))
    assert len(calls) == 1 and 0 < len(encoder.known) <= 100_000


def test_media_finds_a_crop(spark):
    rng = np.random.default_rng(2)
    big = [np.kron(rng.integers(0, 255, (24, 24)), np.ones((5, 5))) for _ in range(4)]
    images = [(i, bytearray(media.write_image(g))) for i, g in enumerate(big)] + [(10, bytearray(media.write_image(big[2][10:110, 5:115] * 0.9))), (11, None), (12, bytearray(b"no image"))]
    got = {r["id"]: r["component_id"] for r in media.copies(spark.createDataFrame(images, "id long, image binary")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 10: 2, 11: 11, 12: 12}


def test_media_candidates_against_all_comparisons(spark):
    """Copies with noise, darker, cropped and turned by a quarter: tables and blocks give what comparing all with all gives."""
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(0, 0.125, 64).tolist()) for i in range(60)]
    greys = [media.read_image(bytes(r["image"])) for r in media.rasters(spark.createDataFrame(vectors, "id long, embedding array<double>")).orderBy("id").collect()]
    copies = [np.clip(g + rng.normal(0, 4, g.shape), 0, 255) for g in greys[:8]] + [0.8 * g + 20 for g in greys[8:16]] + [g[4:60, 6:62] for g in greys[16:24]] + [np.rot90(g) for g in greys[24:30]] + greys[30:34]
    data = [bytearray(media.write_image(g)) for g in greys + copies]
    found = [media.corners(media.read_image(d)[None])[0] for d in data]
    own = [(p, b.view(np.uint64)) for p, b in found]
    root = list(range(len(own)))
    links = 0
    for a in range(len(own)):
        for b in range(a + 1, len(own)):
            if media.same_scene(own[a], own[b]):
                links += 1
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert links >= 25
    frame = spark.createDataFrame(list(enumerate(data)), "id long, image binary").selectExpr("id", "image", "'x' AS rep", "1 AS entry")
    got = {r["id"]: r["component_id"] for r in media.copies(frame).collect()}
    assert sum(got[i] == r for i, r in enumerate(root)) >= 0.98 * len(root)
    assert media.copies(frame.limit(0)).count() == 0


def test_media_descriptors_seven_bits_apart_share_an_entry():
    rng = np.random.default_rng(6)
    for k in range(60):
        one = rng.integers(0, 256, (1, 32), dtype=np.uint8)
        flips = rng.choice(256, 7, replace=False) if k else np.arange(7) * 40  # at first one in each 40 bits
        two = np.packbits(np.unpackbits(one, axis=1) ^ np.isin(np.arange(256), flips), axis=1)
        assert set(media.entries(one)) & set(media.entries(two))


def test_media_possible_loses_no_link():
    rng = np.random.default_rng(9)
    big = [np.kron(rng.integers(0, 255, (16, 16)), np.ones((4, 4))) for _ in range(12)]
    greys = np.stack([*big, *[np.clip(g + rng.normal(0, 8, g.shape), 0, 255) for g in big]])
    own = [(p, b.view(np.uint64)) for p, b in media.corners(greys)]
    a, b = (k.ravel() for k in np.indices((len(own), len(own))))
    maybe = media.possible([c for _, c in own], a, b)
    links = [media.same_scene(own[i], own[j]) for i, j in zip(a, b, strict=True)]
    assert sum(links) > 24 and all(maybe[links]) and maybe.sum() < len(a) / 2


def test_media_links_a_quarter_of_a_large_image():
    rng = np.random.default_rng(12)
    linked = 0
    for _ in range(3):
        large = np.kron(rng.integers(0, 255, (64, 64)), np.ones((8, 8)))
        (p, b), (q, d) = (media.corners(np.rint(g)[None])[0] for g in (large, large[131:387, 117:373] * 0.9))
        assert len(p) > media.CORNERS * 32 and len(q) > media.CORNERS * 8 and set(media.entries(b)) & set(media.entries(d))
        linked += media.same_scene((p, b.view(np.uint64)), (q, d.view(np.uint64)))
    assert linked == 3


def test_media_counts_every_link(spark):
    """Links inside a component that others already connect, and those of images with a null or a repeated id."""
    rng = np.random.default_rng(21)
    grey = np.kron(rng.integers(0, 255, (16, 16)), np.ones((4, 4)))
    family = [np.clip(grey + rng.normal(0, 3, grey.shape), 0, 255) for _ in range(7)]
    lone = np.kron(rng.integers(0, 255, (16, 16)), np.ones((4, 4)))
    greys = [media.read_image(media.write_image(g)) for g in family]
    own = [(p, b.view(np.uint64)) for p, b in media.corners(np.stack(greys))]
    assert all(media.same_scene(a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    ids = [1, 2, 3, 4, 4, None, 6]
    data = [(i, bytearray(media.write_image(g))) for i, g in zip(ids, family, strict=True)] + [(9, bytearray(media.write_image(lone)))]
    frame = spark.createDataFrame(data, "id long, image binary")
    got = sorted((str(r["id"]), r["component_id"], r["n_links"]) for r in media.copies(frame).collect())
    assert got == sorted([(str(i), 1, 6) for i in ids] + [("9", 9, 0)])
    sets = media.features(frame).selectExpr("id AS rep", "monotonically_increasing_id() AS node", "n_corners", "image_key", "spots", "codes")
    for held in (1, 3, 100):
        parts = media._links(media.materialise(sets, "sets"), held).groupBy("node").sum("n").collect()
        assert sorted(r["sum(n)"] for r in parts) == [6] * 7


def test_media_compares_many_pairs_at_once(monkeypatch):
    """All pairs of copies, crops, a flat and a larger image: what one by one gives, with no call for each pair of small images."""
    rng = np.random.default_rng(31)
    big = [np.kron(rng.integers(0, 255, (16, 16)), np.ones((4, 4))) for _ in range(8)]
    greys = [*big, *[np.clip(g + rng.normal(0, 8, g.shape), 0, 255) for g in big], *[np.rot90(g)[:56, 3:60] for g in big], big[0], np.full((64, 64), 9.0), np.kron(big[1], np.ones((8, 8)))]
    images = [(p, b.view(np.uint64)) for p, b in (media.corners(np.asarray(g)[None])[0] for g in greys)]
    large = len(images) - 1
    assert len(images[large - 1][0]) == 0 and len(images[large][0]) * media.CORNERS > (1 << 20) // 64 > media.CORNERS**2
    a, b = (k.ravel() for k in np.indices((len(images), len(images))))
    want, calls = [media.same_scene(images[i], images[j]) for i, j in zip(a, b, strict=True)], []
    one_by_one = media.same_scene
    monkeypatch.setattr(media, "same_scene", lambda one, two, *rest: calls.append((one, two)) or one_by_one(one, two, *rest))
    assert media.linked(images, a, b).tolist() == want and sum(want) > 50
    assert 0 < len(calls) < 2 * len(images) and all(any(x is images[large] for x in pair) for pair in calls)


def test_media_candidates_come_in_blocks():
    rng = np.random.default_rng(32)
    codes = [rng.integers(0, 2, (n, 4), dtype=np.uint64) * np.uint64(rng.integers(1, 4)) + np.arange(n, dtype=np.uint64)[:, None] for n in rng.integers(0, 4, 40)]
    keys = [set(media.entries(np.ascontiguousarray(c).view(np.uint8)).tolist()) for c in codes]
    mixed = rng.random(40) < 0.4
    for side, own in ((mixed, lambda i, j: mixed[i] != mixed[j]), (np.zeros(40, bool), lambda i, j: True), (np.ones(40, bool), lambda i, j: True)):
        want = [(i, j) for i in range(40) for j in range(i + 1, 40) if keys[i] & keys[j] and own(i, j)]
        blocks = list(media.candidates(codes, side, 50))
        assert sorted((int(x), int(y)) for xs, ys in blocks for x, y in zip(xs, ys, strict=True)) == want
        assert len(blocks) > 1 and all(len(x) < 50 + 40 for x, _ in blocks)
    assert not list(media.candidates([], np.zeros(0, bool)))


@pytest.mark.parametrize("shape", ["path", "hub", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(7)
    ids = rng.sample(range(10**12), 600)
    links = {
        "path": list(zip(ids, ids[1:], strict=False)),
        "hub": [(max(ids), i) for i in ids[:300]] + [(min(ids), i) for i in ids[250:550]] + [(i, i) for i in ids[590:]],
        "random": [tuple(rng.sample(ids, 2)) for _ in range(330)],
        "none": [],
    }[shape]
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    want = {i: top(i) for a, b in links if a != b for i in (a, b)}
    got = component_parts.components(spark.createDataFrame(links, "a long, b long").repartition(16)).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want


@pytest.mark.parametrize("block", [0, 50, 1 << 19])
def test_components_of_few_links_take_one_task(spark, monkeypatch, block):
    rng, written = random.Random(8), []
    ids = rng.sample(range(10**12), 90)
    links = [*zip(ids[:40], ids[1:40], strict=False), *((ids[40], i) for i in ids[41:80]), (ids[85], ids[85])]
    plain = component_parts.materialise
    monkeypatch.setattr(component_parts, "materialise", lambda df, name: (written.append(name), plain(df, name))[1])
    frame = spark.createDataFrame(rng.sample(links, len(links)), "a long, b long").repartition(16)
    got = {r["node"]: r["root"] for r in (component_parts.components(frame, block) if block < 1 << 19 else component_parts.components(frame)).collect()}
    assert got == {i: min(own) for own in (ids[:40], ids[40:80]) for i in own}
    assert ("nodes" in written) == (block < 78)


def test_few_labelled_rows_make_few_files(spark):
    docs = spark.createDataFrame([(k, f"text number {k} of many") for k in range(400)], "doc_id long, text string").repartition(12)
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        rows = toxicity.labelled_rows(docs, labels, 3000)
        assert len(rows.inputFiles()) <= 3 and rows.count() == docs.filter(~toxicity.held_out(F.col("doc_id"))).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
