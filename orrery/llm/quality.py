"""Quality by an interpolated modified Kneser-Ney n-gram model of word pieces (operator 2).

Trusted text is that of documents whose label says quality 1. Texts are cut into the word pieces of a public vocabulary, once; a
table holds the pieces in blocks of documents, each piece as its rank among those that follow the one before. Counts of the
n-grams of trusted documents, by language, are gathered in shards of the n-gram; continuation counts, discounts, back-off weights
and interpolated probabilities follow as joins of those tables.

Documents meet the model by n-gram: a block asks each shard for the probabilities of its distinct n-grams, packed in one row, a
shard answers from its part of the model, and the answers come back to their block, where they are summed over its documents. No
table of n-grams is ever in one place, and what a task holds is one block or one shard, whose number grows with the corpus.

A fifth of the trusted documents, by a hash of doc_id, is not counted: a language's threshold is the `quantile` of the perplexity
of those, as text that was counted looks better than any other.

Defined results
    * null and empty texts, and texts without any piece, have a null perplexity and are not kept; repeated rows get equal results
    * a null language is a language of its own; one without counted trusted text uses the model of all trusted text and the
      threshold of all of it, and without any trusted text every document with a piece is kept
    * a language whose trusted documents were all counted, or of which none was, takes its threshold from all of its own
    * a doc_id is trusted if any of its labels says so; a null doc_id is never; further columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .tokens import texts_by_slice, tokenizer_path, word_bpe

VOCABULARY, START, PIECE_BITS = 49408, 65535, 16
ORDER = 2
#: The language keys of the model of all trusted text and of a null language.
POOLED, UNKNOWN = "\1", "\2"
#: followers and ranks: the pieces as `folded` makes them; sizes: pieces of each document.
BLOCKS = "block long, doc_ids array<long>, langs array<string>, maybe array<boolean>, sizes array<int>, followers binary, ranks binary"
#: Pieces after which `folded` begins anew.
SEGMENT = 256


def _key(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(UNKNOWN))


def trusted(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def counted(doc_id: Column) -> Column:
    """Whether a trusted document is one that the model learns from."""
    return F.pmod(F.xxhash64(doc_id, F.lit(2)), F.lit(5)) != 0


def flagged(docs: DataFrame, ids: DataFrame, bits: int = 25) -> DataFrame:
    """docs with `maybe`: false only where doc_id is not among ids. The sketch of 2**bits bits is a table of at most 2**bits / 8 bytes
    whatever the number of ids, so it is broadcast; where it fills up it says true more often, and a join settles what is so."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    parts = ids.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    rows = docs.withColumn("bit", F.bitmap_bit_position(place)).withColumn("part", F.bitmap_bucket_number(place))
    rows = rows.join(F.broadcast(parts), "part", "left")
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("maybe", F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))).drop("part", "bit", "bitmap")


def packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed: sorted codes share their high bytes, and pieces have few different ones."""
    import zstandard

    flat = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=3).compress(flat.tobytes())


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _within(sizes: np.ndarray) -> np.ndarray:
    """The place of each piece in its segment of SEGMENT pieces of a document."""
    return (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)) % SEGMENT


def folded(ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes]:
    """The pieces of documents: which pieces follow each piece, commonest first, and each piece's rank among those that follow the
    one before. Ranks are mostly small, so they pack better than pieces."""
    before = np.append(START, ids[:-1])[: len(ids)].astype(np.uint32)
    before[_within(sizes) == 0] = START
    pairs = pa.array(before << PIECE_BITS | ids.astype(np.uint32)).dictionary_encode()
    at, pair = pairs.indices.to_numpy(), pairs.dictionary.to_numpy()
    order = np.lexsort((pair, -np.bincount(at, minlength=len(pair)), pair >> PIECE_BITS))
    pair = pair[order]
    rank = np.zeros(len(pair), "<u2")
    rank[order] = np.arange(len(pair)) - np.searchsorted(pair >> PIECE_BITS, pair >> PIECE_BITS)
    return packed(pair.astype("<u4")), packed(rank[at])


def unfolded(followers: bytes, ranks: bytes, sizes: np.ndarray) -> np.ndarray:
    """The pieces of `folded`; one step goes through all segments."""
    pair, rank = unpacked(followers, "<u4"), unpacked(ranks, "<u2")
    first, piece = np.zeros(START + 1, np.int64), (pair & START).astype("<u2")
    context, at = np.unique(pair >> PIECE_BITS, return_index=True)
    first[context] = at
    starts = np.flatnonzero(_within(sizes) == 0)
    lengths = np.diff(np.append(starts, len(rank)))
    starts = starts[np.argsort(-lengths, kind="stable")]
    out, last = np.zeros(len(rank), "<u2"), np.full(len(starts), START, "<u2")
    for t, n in enumerate(len(starts) - np.cumsum(np.bincount(lengths))[:-1]):
        here = starts[:n] + t
        last = piece[first[last[:n]] + rank[here]]
        out[here] = last
    return out


def _pieces(row: dict) -> np.ndarray:
    return unfolded(row["followers"], row["ranks"], np.array(row["sizes"], np.int64))


def tokenised(docs: DataFrame, path: str | None = None, block_bytes: int = 8_000_000) -> DataFrame:
    """Documents (doc_id, lang, text, maybe) as blocks of pieces."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, block = word_bpe(path, "library"), TaskContext.get().partitionId() << 32
        for batch in texts_by_slice(batches, block_bytes):
            ids, at = encoder.encode(batch.column("text"))
            row = [pa.array([block])] + [pa.array([batch.column(c).to_pylist()], pa.list_(t)) for c, t in (("doc_id", pa.int64()), ("lang", pa.string()), ("maybe", pa.bool_()))]
            row += [pa.array([np.diff(at).tolist()], pa.list_(pa.int32())), *[pa.array([x], pa.binary()) for x in folded(ids, np.diff(at))]]
            yield pa.RecordBatch.from_arrays(row, names=["block", "doc_ids", "langs", "maybe", "sizes", "followers", "ranks"])
            block += 1

    return docs.select("doc_id", F.col("lang"), "text", "maybe").mapInArrow(run, BLOCKS)


def codes(ids: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """For each piece the code of the n-gram that ends in it: 16 bits a piece, START before a document's first."""
    pad = order - 1
    held = np.full(len(ids) + pad * len(sizes), START, np.int64)
    where = np.arange(len(ids)) + np.repeat(pad * np.arange(1, len(sizes) + 1), sizes)
    held[where] = ids
    code = np.zeros(len(ids), np.int64)
    for k in range(order):
        code = code << PIECE_BITS | held[where - pad + k]
    return code


def count(pieces: DataFrame, order: int) -> DataFrame:
    """lang, code, n over all rows of pieces(lang, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                own = [unpacked(b, "<u2") for b, x in zip(batch.column("ids").to_pylist(), langs, strict=True) if x == lang]
                code, n = np.unique(codes(np.concatenate(own).astype(np.int64), np.array([len(x) for x in own]), order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "code", "n"])

    return pieces.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def learned(blocks: DataFrame, ids: DataFrame, order: int) -> DataFrame:
    """Counts by language, and of all languages together, over the counted trusted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids_, at = _pieces(r), np.append(0, np.cumsum(r["sizes"]))
                own = [(r["doc_ids"][k], r["langs"][k], packed(ids_[at[k] : at[k + 1]])) for k, m in enumerate(r["maybe"]) if m and r["sizes"][k]]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "lang", "ids"])

    some = blocks.mapInArrow(run, "doc_id long, lang string, ids binary").filter(counted(F.col("doc_id")))
    some = some.join(ids.hint("merge"), "doc_id", "left_semi")  # the same plan whatever the number of labels
    own = materialise(count(some.select(_key(F.col("lang")).alias("lang"), "ids"), order), "counts")
    return own.unionByName(own.groupBy("code").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "code", "n"))


def model(counts: DataFrame, order: int) -> DataFrame:
    """lang, code (order << 48 | pieces), p and back: the interpolated probability of the last piece after those before it, and the
    weight that a context leaves to the shorter one. Order 0 holds the probability of a piece never counted."""
    low = lambda k: F.col("code").bitwiseAND(F.lit((1 << PIECE_BITS * k) - 1))
    before = F.shiftright("code", PIECE_BITS)
    levels = {order: counts}
    for k in range(order - 1, 0, -1):  # continuation counts: distinct pieces before
        levels[k] = materialise(levels[k + 1].groupBy("lang", low(k).alias("code")).agg(F.count(F.lit(1)).alias("n")), f"level{k}")
    less, contexts = {}, {}
    for k in range(1, order + 1):
        n = [F.greatest(F.count_if(F.col("n") == j), F.lit(1)).cast("double") for j in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        d = levels[k].groupBy("lang").agg(*[F.least(F.greatest(j - (j + 1) * y * n[j] / n[j - 1], F.lit(0.05)), F.lit(j - 0.05)).alias(f"d{j}") for j in (1, 2, 3)])
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        less[k] = levels[k].join(d, "lang").select("lang", "code", "n", off.alias("off"), before.alias("context"))
        contexts[k] = materialise(less[k].groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("back")), f"contexts{k}")
    out, shorter = None, None
    for k in range(1, order + 1):
        rows = less[k].join(contexts[k], ["lang", "context"])
        own = (F.col("n") - F.col("off")) / F.col("total")
        if shorter is None:
            rows = rows.select("lang", "code", (own + F.col("back") / VOCABULARY).alias("p"))
        else:
            rows = rows.withColumn("low", low(k - 1)).join(shorter.select("lang", F.col("code").alias("low"), F.col("p").alias("q")), ["lang", "low"])
            rows = rows.select("lang", "code", (own + F.col("back") * F.col("q")).alias("p"))
        shorter = materialise(rows, f"p{k}")
        found = shorter
        if k < order:
            found = found.join(contexts[k + 1].select("lang", F.col("context").alias("code"), "back"), ["lang", "code"], "full")
        else:
            found = found.withColumn("back", F.lit(None).cast("double"))
        found = found.select("lang", (F.lit(k << 48) + F.col("code")).alias("code"), "p", "back")
        out = found if out is None else out.unionByName(found)
    floor = contexts[1].select("lang", F.lit(0).cast("long").alias("code"), (F.col("back") / VOCABULARY).alias("p"), F.lit(None).cast("double").alias("back"))
    return out.unionByName(floor)


def wanted(row: dict, order: int, pooled: bool) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """For each language of a block, and for all together: its key, its documents, their pieces, and the sorted codes to ask for."""
    ids, sizes = _pieces(row).astype(np.int64), np.array(row["sizes"], np.int64)
    langs = np.array([UNKNOWN if x is None else x for x in row["langs"]], dtype=object)
    for lang in [*sorted(set(langs)), *([POOLED] if pooled else [])]:
        docs = np.flatnonzero(sizes > 0 if lang == POOLED else (langs == lang) & (sizes > 0))
        if not len(docs):
            continue
        own = ids[np.repeat((langs == lang) | (lang == POOLED), sizes)]
        ask = [np.zeros(1, np.int64)]
        whole = pc.unique(pa.array(codes(own, sizes[docs], order))).to_numpy()  # shorter ones are parts of these
        for k in range(1, order + 1):
            ask.append(np.unique(whole & ((1 << PIECE_BITS * k) - 1)) | k << 48)
            if k < order:  # contexts are asked for too: those that begin a document never end an n-gram
                ask.append(np.unique(whole >> PIECE_BITS & ((1 << PIECE_BITS * k) - 1)) | k << 48)
        yield lang, docs, own, np.unique(np.concatenate(ask))


def shard_of(code: np.ndarray, shards: int) -> np.ndarray:
    return code % 1_000_003 % shards


def asked(blocks: DataFrame, order: int, shards: int, pooled: bool) -> DataFrame:
    """shard, block, lang and packed codes; at most one row a code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[tuple] = []
                for lang, _, _, ask in wanted(row, order, pooled):
                    shard = shard_of(ask, shards)
                    by = np.argsort(shard, kind="stable")
                    there, first = np.unique(shard[by], return_index=True)
                    out += [(s, row["block"], lang, packed(own)) for s, own in zip(there.tolist(), np.split(ask[by], first[1:]), strict=True)]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["shard", "block", "lang", "codes"])

    return blocks.mapInArrow(run, "shard long, block long, lang string, codes binary")


def answered(requests: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """block, shard, lang and, for the codes asked for in their order, p and back as 32-bit numbers, NaN where there is none."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        langs = np.array(right.column("lang").to_pylist(), dtype=object)
        code, p, back = (right.column(c).to_numpy() for c in ("code", "p", "back"))
        tables = {}
        for lang in set(langs):
            own = np.flatnonzero(langs == lang)
            own = own[np.argsort(code[own])]
            tables[lang] = code[own], p[own].astype("<f4"), back[own].astype("<f4")
        out: list[tuple] = []
        for r in left.to_pylist():
            ask = unpacked(r["codes"], "<i8")
            values = np.full((2, len(ask)), np.nan, "<f4")
            if r["lang"] in tables:
                have, *held = tables[r["lang"]]
                at = np.minimum(np.searchsorted(have, ask), len(have) - 1)
                hit = have[at] == ask
                for k in (0, 1):
                    values[k, hit] = held[k][at[hit]]
            out.append((r["block"], r["shard"], r["lang"], packed(values[0]), packed(values[1])))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["block", "shard", "lang", "p", "back"])

    known = known.withColumn("shard", F.col("code") % 1_000_003 % shards)
    return requests.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(run, "block long, shard long, lang string, p binary, back binary")


def log_probabilities(own: np.ndarray, sizes: np.ndarray, ask: np.ndarray, p: np.ndarray, back: np.ndarray, order: int) -> np.ndarray:
    """Of each piece, backing off from what was not found; a context that was never counted leaves all to the shorter one."""
    whole = codes(own, sizes, order)
    out = np.full(len(own), np.log(p[0]), np.float64)
    for k in range(1, order + 1):
        at = np.searchsorted(ask, whole & ((1 << PIECE_BITS * k) - 1) | k << 48)
        if k > 1:
            context = np.searchsorted(ask, whole >> PIECE_BITS & ((1 << PIECE_BITS * (k - 1)) - 1) | (k - 1) << 48)
            out += np.where(np.isnan(back[context]), 0.0, np.log(back[context].astype(np.float64)))
        out = np.where(np.isnan(p[at]), out, np.log(p[at].astype(np.float64)))
    return out


def perplexities(blocks: DataFrame, answers: DataFrame, order: int, shards: int, pooled: bool) -> DataFrame:
    """doc_id, lang, perplexity and maybe of every document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        got: dict[str, list] = {}
        for r in right.to_pylist():
            got.setdefault(r["lang"], []).append(r)
        sizes, out = np.array(row["sizes"], np.int64), np.full(len(row["sizes"]), np.nan)
        for lang, docs, own, ask in wanted(row, order, pooled):
            p, back, shard = np.full(len(ask), np.nan, "<f4"), np.full(len(ask), np.nan, "<f4"), shard_of(ask, shards)
            for r in got.get(lang, []):
                p[shard == r["shard"]], back[shard == r["shard"]] = unpacked(r["p"], "<f4"), unpacked(r["back"], "<f4")
            if np.isnan(p[0]):  # no model of this language
                continue
            logs = log_probabilities(own, sizes[docs], ask, p, back, order)
            value = np.exp(-np.add.reduceat(logs, np.cumsum(sizes[docs]) - sizes[docs]) / sizes[docs])
            out[docs] = np.where(np.isnan(out[docs]), value, out[docs])
        columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["langs"], pa.string()), pa.array(out, mask=np.isnan(out)), pa.array(sizes > 0), pa.array(row["maybe"], pa.bool_())]
        return pa.table(columns, names=["doc_id", "lang", "perplexity", "filled", "maybe"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, lang string, perplexity double, filled boolean, maybe boolean")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, order: int = ORDER, shard_pieces: int = 4_000_000) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept of every row."""
    ids = trusted(labels)
    blocks = materialise(tokenised(flagged(docs.select("doc_id", "lang", "text"), ids)), "blocks")
    pieces = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda t, x: t + x))).first()[0] or 0
    shards = max(1, int(-(-pieces // shard_pieces)))
    counts = materialise(learned(blocks, ids, order), "all-counts")
    known = blocks.select(F.explode(F.array_distinct("langs")).alias("lang")).select(_key(F.col("lang")).alias("lang")).distinct()
    pooled = bool(known.join(counts.select("lang").distinct(), "lang", "left_anti").limit(1).count())
    table = model(counts if pooled else counts.filter(F.col("lang") != POOLED), order)
    answers = answered(asked(blocks, order, shards, pooled), table, shards)
    rows = materialise(perplexities(blocks, answers, order, shards, pooled).withColumn("key", _key(F.col("lang"))), "perplexity")
    sure = rows.filter("maybe AND perplexity IS NOT NULL").join(ids, "doc_id", "left_semi").withColumn("fresh", ~counted(F.col("doc_id")))
    limit = lambda which: F.percentile_approx(F.when(which, F.col("perplexity")), quantile, 10000)
    own = F.coalesce(limit(F.col("fresh")), limit(F.lit(True)))
    # a row for each language
    limits = sure.groupBy("key").agg(own.alias("own"))
    whole = sure.agg(own.alias("whole"))
    out = rows.join(limits, "key", "left").join(F.broadcast(whole), F.lit(True), "left")  # whole has one row
    out = out.withColumn("threshold", F.coalesce("own", "whole"))
    kept = F.col("filled") & (F.col("perplexity").isNull() | F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"))
