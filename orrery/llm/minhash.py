"""Near-duplicates by b-bit MinHash (operator 6).

A text's set holds the 64-bit hashes of its distinct five-word shingles. Texts with the same set form a class, and one text
stands for it. 128 minima make 32 bands of four; representatives that share a band are candidates. Four low bits of each
minimum are packed into eight numbers, and the fields that agree, corrected for chance, estimate the similarity: candidates
below `floor` leave, the others are confirmed on the full sets. At the similarity of 0.75 all bands miss with a chance of
5e-6, and the estimate lies 4.5 standard deviations above the floor.

No bucket is turned into all its pairs while it can be spanned by fewer: each round compares a bucket's members with one
pivot, and buckets whose members are then in one component, even through others, are done. In the buckets that stay open the
members outside the largest component are compared with all others, in blocks of bounded size inside a task, which has their
texts: only links leave it. So no candidate is lost.

Defined results
    * null, empty and white texts have no shingles and are linked with nothing; under five words the whole sequence is one
    * repeated texts are one class; a row with a null doc_id takes part like any other: its component's id is the smallest
      doc_id there, null if there is none, and then all its rows count as kept; rows that repeat a kept doc_id do too
    * `deduplicate` keeps one row of each component whatever its ids, and all rows without words
    * further columns are ignored by `near_duplicates` and kept by `deduplicate`
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_text
from .components import components
from .spans import U, byte_hashes, lower_ascii, mix, text_bytes, window_hashes, word_spans
from .tokens import texts_by_slice

WIDTH, BANDS, ROWS, BITS = 5, 32, 4, 4
MINIMA = BANDS * ROWS
_rng = np.random.default_rng(6)
_FACTOR = (_rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
FEATURES = "doc_id long, row long, n_shingles long, set_key binary, bands array<long>, packed array<long>"


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, at = text_bytes(column)
    starts, ends, first = word_spans(raw, at)
    words = byte_hashes(lower_ascii(raw), starts, ends)
    whole = window_hashes(words, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(whole[a : b - width + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        else:
            yield window_hashes(words[a:b], b - a) if b > a else words[:0]


def minima(own: np.ndarray) -> np.ndarray:
    """128 minima of a set; the multiplied and shifted hashes are scrambled once more, as minima need good high bits."""
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    low = (own >> U(32)).astype(np.uint32) ^ own.astype(np.uint32)
    for a in range(0, len(low), 1024):
        h = low[None, a : a + 1024] * _FACTOR[:, None]
        h ^= h >> np.uint32(15)
        h += _ADD[:, None]
        h *= _FACTOR[::-1, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def packed_bits(low: np.ndarray) -> np.ndarray:
    """BITS low bits of each minimum, in signed 64-bit numbers."""
    per = 64 // BITS
    fields = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, per)
    return (fields << (np.arange(per, dtype=np.uint64) * U(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix(key ^ rows[:, r])
    return key.view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text and row, the number of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_by_slice(batches):
            n, keys, bands, packed = [], [], [], []
            for own in shingle_sets(batch.column("text")):
                n.append(len(own))
                if not len(own):
                    keys.append(None), bands.append(None), packed.append(None)
                    continue
                low = minima(own)
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                bands.append(band_keys(low)), packed.append(packed_bits(low))
            numbers = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, numbers), pa.array(packed, numbers)],
                names=["doc_id", "row", "n_shingles", "set_key", "bands", "packed"],
            )

    return docs.select("doc_id", "text", "row").mapInArrow(run, FEATURES)


def _ones() -> int:
    return sum(1 << k for k in range(0, 64, BITS))


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: the share of fields that agree, corrected for agreement by chance."""
    differ = F.lit(0)
    for i in range(MINIMA * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        any_bit = x
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(_ones())))
    chance = 1.0 / (1 << BITS)
    return (1 - differ / F.lit(float(MINIMA)) - chance) / (1 - chance)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for all rows of a against all rows of b."""
    differ = np.zeros((len(a), len(b)), np.uint16)
    for i in range(a.shape[1]):
        x = a[:, None, i] ^ b[None, :, i]
        any_bit = x.copy()
        for k in range(1, BITS):
            any_bit |= x >> U(k)
        differ += np.bitwise_count(any_bit & U(_ones()))
    chance = 1.0 / (1 << BITS)
    return (1 - differ / float(MINIMA) - chance) / (1 - chance)


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a similarity of percent or more."""
    if len(one) > len(two):
        one, two = two, one
    both = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
    return 100 * both >= percent * (len(one) + len(two) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, per_unit: int = 64) -> DataFrame:
    """The pairs (a, b) with a similarity of percent or more on full sets. Pairs are dealt by a and a salt, so that a unit has
    about per_unit texts at most and the text of a is sent once to each unit."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("units", F.ceil(F.col("n") / per_unit).cast("int"))
    units = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), F.col("a").alias("doc"), F.lit(0).alias("role"))
    members = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("units")).cast("int").alias("unit"), F.col("b").alias("doc"), F.lit(1).alias("role"))
    rows = units.unionByName(members).join(texts.withColumnRenamed("row", "doc"), "doc")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("role", "ascending"), ("doc", "ascending")])
        ids, roles = table.column("doc").to_pylist(), table.column("role").to_pylist()
        found, pivot = [], None
        for k, own in enumerate(own for part in texts_by_slice(table.to_batches()) for own in shingle_sets(part.column("text"))):
            if roles[k] == 0:
                pivot = own
            elif similar(pivot, own, percent):
                found.append(ids[k])
        return pa.table({"a": pa.array([key[0].as_py()] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return rows.groupBy("a", "unit").applyInArrow(run, "a long, b long")


def _candidates(pairs: DataFrame, reps: DataFrame, percent: int, floor: float) -> DataFrame:
    """Distinct pairs whose sizes and packed bits allow the similarity."""
    one = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("packed").alias("pa"))
    two = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("packed").alias("pb"))
    p = pairs.distinct().join(one, "a").join(two, "b")
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return p.filter(fits & (estimate(F.col("pa"), F.col("pb")) >= floor)).select("a", "b")


def _across(open_: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, floor: float, rows: int = 512, columns: int = 1024, shingles: int = 500_000) -> DataFrame:
    """Links between different components of a bucket, one end outside its largest. Outside members are dealt into blocks of
    about `rows`, all members into blocks of about `columns`, and of about `shingles` in either; a task compares two blocks and
    confirms what packed bits allow on full sets, so only links leave it. A pair counts in the first band it shares: a bucket
    it shared earlier is open too, else the two were in one component."""
    out = F.col("root") != F.col("top.root")
    sides = open_.select("band", "rep", "root", out.alias("out")).join(reps.select("rep", "n", "bands", "packed"), "rep")
    size = sides.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("mn"), F.count_if("out").alias("o"), F.sum(F.when(F.col("out"), F.col("n"))).alias("on"))
    size = size.select(
        "band",
        F.ceil(F.greatest(F.col("m") / columns, F.col("mn") / shingles)).cast("int").alias("cs"),
        F.ceil(F.greatest(F.col("o") / rows, F.col("on") / shingles)).cast("int").alias("rs"),
    )
    sides = sides.join(size, "band").join(texts.select(F.col("row").alias("rep"), "text").hint("merge"), "rep")
    near = sides.filter("out").withColumn("r", F.pmod(F.xxhash64("rep"), F.col("rs")).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)))
    far = sides.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("cs")).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rs") - 1)))
    names = ["band", "r", "c", "rep", "root", "out", "n", "bands", "packed", "text"]
    both = near.select(*names, F.lit(True).alias("near")).unionByName(far.select(*names, F.lit(False).alias("near")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side, outside = (table.column(c).to_numpy(zero_copy_only=False) for c in ("near", "out"))
        rep, root, n = (table.column(c).to_numpy() for c in ("rep", "root", "n"))
        bands, packed = (table.column(c).combine_chunks().flatten().to_numpy().reshape(len(rep), -1) for c in ("bands", "packed"))
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        fits = 100 * np.minimum.outer(n[a], n[b]) >= percent * np.maximum.outer(n[a], n[b])
        fits &= (root[a][:, None] != root[b][None, :]) & (~outside[b][None, :] | (rep[a][:, None] < rep[b][None, :]))
        if fits.any():
            fits &= estimates(packed[a].view(np.uint64), packed[b].view(np.uint64)) >= floor
        i, j = np.nonzero(fits)
        i, j = a[i], b[j]
        first = np.zeros(len(i), bool)
        for x in range(0, len(i), 1 << 14):
            same = bands[i[x : x + (1 << 14)]] == bands[j[x : x + (1 << 14)]]
            first[x : x + (1 << 14)] = bands[i[x : x + (1 << 14)], same.argmax(axis=1)] == key[0].as_py()
        i, j = i[first], j[first]
        used = np.unique(np.concatenate([i, j]))
        parts = texts_by_slice(table.select(["text"]).take(pa.array(used)).to_batches())
        sets = dict(zip(used.tolist(), (own for part in parts for own in shingle_sets(part.column("text"))), strict=True))
        found = [k for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) if similar(sets[x], sets[y], percent)]
        return pa.table({"a": rep[i[found]], "b": rep[j[found]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return both.groupBy("band", "r", "c").applyInArrow(run, "a long, b long")


def _links(reps: DataFrame, docs: DataFrame, percent: int, floor: float, pivot_rounds: int) -> DataFrame:
    """node, root of all representatives that are linked with any other."""
    buckets = reps.select("rep", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).filter("n > 1")
    members = materialise(buckets.join(shared, "band").select("band", "rep", "pivot"), "buckets")
    # a representative shares a bucket with another or is linked with nothing
    reps = materialise(reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "bands", "packed"), "packed")
    texts = materialise(docs.select("row", "text").join(reps.select(F.col("rep").alias("row")).hint("merge"), "row", "left_semi"), "texts")
    roots = None
    pairs = members.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    pairs = materialise(_candidates(pairs, reps, percent, floor), "candidates")
    links = confirmed(pairs, texts, percent)
    for turn in range(pivot_rounds + 1):
        links = materialise(links, "confirmed")
        if roots is not None:  # what is known joins as stars
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(links)
        if turn == pivot_rounds:
            return roots
        # buckets whose members are in several components; those done never open again
        now = members.select("band", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        now = now.select("band", "rep", F.coalesce("root", "rep").alias("root"))
        per = now.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("pivot"))
        top = per.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "root", "pivot")).alias("top")).filter("parts > 1")
        members = materialise(now.join(top, "band").select("band", "rep", "root", "top"), "open")
        size = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("root") != F.col("top.root")).cast("long")).alias("o"))
        full, most = size.agg(F.sum(F.col("n") * F.col("o")), F.max("n")).first()
        if not full:
            return roots
        if turn + 2 < pivot_rounds and most > 256 and full > 100 * reps.count():
            outside = members.filter("root <> top.root").select(F.col("top.pivot").alias("a"), F.col("rep").alias("b"))
            links = confirmed(materialise(_candidates(outside, reps, percent, floor), "candidates"), texts, percent)
        else:
            links = _across(members, reps, texts, percent, floor)
            pivot_rounds = turn + 1
    return roots


def classes(docs: DataFrame, percent: int = 75, floor: float = 0.57, pivot_rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """The features of every row of written docs(doc_id, text, row), and for every set of shingles the smallest doc_id of its
    component and the first of its rows. Nodes are numbers of rows, as a doc_id may be null or stand for several texts."""
    rows = materialise(features(docs), "features")
    best = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")
    sets = rows.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min(best).alias("s"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
    sets = materialise(sets.select("set_key", F.col("s.row").alias("rep"), "s", "n", "bands", "packed"), "sets")
    roots = _links(sets.select("rep", "n", "bands", "packed"), docs, percent, floor, pivot_rounds)
    comps = materialise(sets.select("set_key", "rep", "s").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", "root", "s"), "comps")
    top = comps.filter("root IS NOT NULL").groupBy("root").agg(F.min("s").alias("top"))
    comps = comps.join(top, "root", "left").select("set_key", F.coalesce("top", "s").alias("top"))
    return rows, comps.select("set_key", F.col("top.doc_id").alias("component_id"), F.col("top.row").alias("first_row"))


def _components(docs: DataFrame, percent: int) -> DataFrame:
    rows, comps = classes(docs, percent)
    return rows.select("doc_id", "row", "n_shingles", "set_key").join(comps, "set_key", "left")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    out = _components(materialise(docs.select("doc_id", whole_text().alias("text"), F.monotonically_increasing_id().alias("row")), "rows"), percent)
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that stay, with all their columns: the first row of each component, by doc_id, and all without words."""
    names = docs.columns
    rows = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    found = _components(rows.select("doc.doc_id", F.coalesce("doc.text", F.lit("")).alias("text"), "row"), percent)
    gone = materialise(found.filter("set_key IS NOT NULL AND row <> first_row").select("row"), "gone")
    return rows.join(gone, "row", "left_anti").select(*[F.col(f"doc.`{c}`").alias(c) for c in names])
