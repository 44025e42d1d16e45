"""Copies of images by local descriptors (operator 8).

An image gives corners at several scales, up to CORNERS in each cell of about CELL x CELL pixels, each with the orientation of the grey values around it, and at each corner 256
binary tests turned to that orientation. Descriptors go into eight Hamming tables, one for each 32 of their bits: two that
differ in at most seven bits share an entry. Images that share an entry are compared: mutually best matches vote for a
similarity transform, and enough matches that agree with one make a link, so crops, quarter turns and edited copies are found.

Images with the same descriptors form a class with one representative. Representatives are dealt into parts, and for every two
parts a task compares each pair that shares an entry, once and whatever else links them; it returns a number of links and one
link to its component for each image, so no group becomes pairs of rows. Each image is read once for every part.

The test tables hold no images. `rasters` renders a vector as a small grey image, for a query over a whole table.

Defined results
    * a null, unreadable or flat image has no corners and is linked with nothing
    * repeated images are one class; rows with a null id take part like any other: a component's id is its smallest id, null if
      there is none; different images under one id are classes of their own
    * an empty table gives an empty result; further columns are ignored
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices
from .components import components, stars

CORNERS, CELL, TESTS, PATCH = 24, 64, 256, 9
_rng = np.random.default_rng(8)
_A, _B = (np.clip(_rng.normal(0, PATCH / 2.5, (TESTS, 2)), -PATCH + 1, PATCH - 1) for _ in range(2))
#: Angles are rounded to so many turns of the tests' ends, first ends then second.
TURNS, TABLES = 64, 8
_angles = np.arange(TURNS) * (2 * np.pi / TURNS)
_TURNED = np.rint(np.einsum("tij,pj->tpi", np.array([[np.cos(_angles), -np.sin(_angles)], [np.sin(_angles), np.cos(_angles)]]).transpose(2, 0, 1), np.concatenate([_A, _B]))).astype(int)
_DISC = np.hypot(*np.mgrid[-PATCH + 1 : PATCH, -PATCH + 1 : PATCH]) < PATCH
FEATURES = "id long, n_corners int, image_key binary, spots array<double>, codes array<long>"


def read_image(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM file."""
    head = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not head:
        return None
    kind, w, h, top = (int(x) for x in head.groups())
    depth = 3 if kind == 6 else 1
    raw = np.frombuffer(data, np.uint8, offset=head.end())
    if top > 255 or len(raw) < w * h * depth:
        return None
    return raw[: w * h * depth].reshape(h, w, depth).mean(axis=2)


def write_image(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    return b"P5 %d %d 255\n" % (w, h) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def _smooth(g: np.ndarray) -> np.ndarray:
    """Images (n, height, width) under the weights 1 2 1 along both axes, edges repeated."""
    for axis in (1, 2):
        g = np.moveaxis(g, axis, 0)
        out = g * 2
        out[1:] += g[:-1]
        out[:-1] += g[1:]
        out[0] += g[0]
        out[-1] += g[-1]
        out *= 0.25
        g = np.moveaxis(out, 0, axis)
    return g


def _highest(r: np.ndarray) -> np.ndarray:
    """The largest value of each pixel's 3 x 3 neighbours."""
    for axis in (1, 2):
        r = np.moveaxis(r, axis, 0)
        out = r.copy()
        np.maximum(out[1:], r[:-1], out=out[1:])
        np.maximum(out[:-1], r[1:], out=out[:-1])
        r = np.moveaxis(out, 0, axis)
    return r


def _describe(g: np.ndarray, i: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles and packed tests at the corners (image i, y, x) of one level g (n, height, width)."""
    edge = 3
    wide = np.pad(_smooth(_smooth(g)), ((0, 0), (edge, edge), (edge, edge)), mode="edge")
    (h, w), flat = wide.shape[1:], wide.ravel()
    base = (i * h + y + edge) * w + x + edge
    span = np.arange(-PATCH + 1, PATCH)
    dy, dx = (p[_DISC] for p in np.meshgrid(span, span, indexing="ij"))
    disc = flat[base[:, None] + dy * w + dx]
    angle = np.arctan2(disc @ dy.astype(np.float32), disc @ dx.astype(np.float32)).astype(np.float64)
    at = np.rint(angle * (TURNS / (2 * np.pi))).astype(int) % TURNS
    grey = flat[base[:, None] + (_TURNED[..., 1] * w + _TURNED[..., 0])[at]]
    return angle, np.packbits(grey[:, :TESTS] < grey[:, TESTS:], axis=1)


def corners(greys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the images (n, height, width): places (x, y, scale, angle) and 256 packed bits of the strongest corners of all scales in each cell."""
    levels, found, scale, g = [], [], 1.0, _smooth(greys.astype(np.float32))
    while min(g.shape[1:]) > 2 * PATCH + 2:
        gy, gx = np.gradient(g, axis=(1, 2))
        a, b, c = (_smooth(_smooth(p)) for p in (gx * gx, gy * gy, gx * gy))
        r = a * b - c * c - 0.05 * (a + b) ** 2
        inner = np.s_[:, PATCH:-PATCH, PATCH:-PATCH]
        i, y, x = np.nonzero((r[inner] == _highest(r)[inner]) & (r[inner] > 1e-3))
        y, x = y + PATCH, x + PATCH
        found.append(np.stack([i, y, x, np.full(len(i), len(levels))], axis=1))
        levels.append((g, scale, r[i, y, x]))
        h, w = (s * 3 // 4 for s in g.shape[1:])
        at_y, at_x = (np.rint(np.arange(n) * (4 / 3)).astype(int) for n in (h, w))
        g, scale = _smooth(g)[:, at_y[:, None], at_x[None, :]], scale * 4 / 3
    if not found:
        return [(np.zeros((0, 4)), np.zeros((0, TESTS // 8), np.uint8))] * len(greys)
    spots, strength = np.concatenate(found), np.concatenate([x[2] for x in levels])
    scales = np.array([x[1] for x in levels])[spots[:, 3]]
    down, across = (max(1, round(n / CELL)) for n in greys.shape[1:])
    cell_y, cell_x = (np.minimum(spots[:, k] * scales * cells // n, cells - 1).astype(int) for k, cells, n in ((1, down, greys.shape[1]), (2, across, greys.shape[2])))
    cell = (spots[:, 0] * down + cell_y) * across + cell_x
    order = np.lexsort((spots[:, 1] * scales, spots[:, 2] * scales, -strength, cell))
    first = np.searchsorted(cell[order], np.arange(len(greys) * down * across))
    order = order[np.arange(len(order)) - first[cell[order]] < CORNERS]
    spots, scales = spots[order], scales[order]
    angle, bits = np.zeros(len(spots)), np.zeros((len(spots), TESTS // 8), np.uint8)
    for k, (g, _, _) in enumerate(levels):
        level = np.flatnonzero(spots[:, 3] == k)
        for start in range(0, len(level), 2048):
            on = level[start : start + 2048]
            angle[on], bits[on] = _describe(g, *spots[on, :3].T)
    place = np.stack([spots[:, 2] * scales, spots[:, 1] * scales, scales, angle], axis=1)
    cuts = np.searchsorted(spots[:, 0], np.arange(len(greys) + 1))
    return [(place[s:e], bits[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def features(images: DataFrame) -> DataFrame:
    """images: id, image (binary)."""

    def described(greys: list[np.ndarray | None], pixels: int = 1 << 18) -> list[tuple]:
        """Images of one size go through together, so many that their pixels stay bounded."""
        out: list[tuple] = [(0, None, None, None)] * len(greys)
        sizes: dict[tuple, list[int]] = {}
        for k, grey in enumerate(greys):
            if grey is not None:
                sizes.setdefault(grey.shape, []).append(k)
        for shape, members in sizes.items():
            step = max(1, pixels // max(1, shape[0] * shape[1]))
            for start in range(0, len(members), step):
                own = members[start : start + step]
                for k, (place, bits) in zip(own, corners(np.stack([greys[j] for j in own])), strict=True):
                    if len(place):
                        key = hashlib.blake2b(bits.tobytes() + np.rint(place * 4).astype(np.int64).tobytes(), digest_size=16).digest()
                        out[k] = (len(place), key, place.ravel().tolist(), bits.view(np.int64).ravel().tolist())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64()))
        for batch in batches:
            sizes = [len(d or b"") for d in batch.column("image").to_pylist()]
            for start, end in slices(sizes, 4 << 20):
                part = batch.slice(start, end - start)
                rows = described([read_image(d) for d in part.column("image").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["id", "n_corners", "image_key", "spots", "codes"])

    return images.select("id", "image").mapInArrow(run, FEATURES)


def table_keys(bits: np.ndarray) -> np.ndarray:
    """For each descriptor its key in each Hamming table: the table's number, then its 32 bits."""
    return bits.view(np.uint32) | np.arange(TABLES, dtype=np.uint64) << np.uint64(32)


def entries(bits: np.ndarray) -> np.ndarray:
    """Distinct keys of the descriptors in their Hamming tables."""
    return np.unique(table_keys(bits).view(np.int64))


def same_scene(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], most_bits: int = 48, least: int = 5) -> bool:
    """Whether mutually best matches agree with one similarity transform. one, two: places (x, y, scale, angle), codes."""
    (pa_, ca), (pb, cb) = one, two
    if min(len(ca), len(cb)) < least:
        return False
    best, bits, back, low = np.zeros(len(ca), int), np.zeros(len(ca), int), np.zeros(len(cb), int), np.full(len(cb), TESTS + 1)
    step = max(1, (1 << 18) // len(cb))  # large images have many corners
    for start in range(0, len(ca), step):
        far = np.bitwise_count(ca[start : start + step, None, :] ^ cb[None, :, :]).sum(axis=2, dtype=np.int64)
        best[start : start + step], bits[start : start + step] = far.argmin(axis=1), far.min(axis=1)
        least_far, at = far.min(axis=0), far.argmin(axis=0)
        back, low = np.where(least_far < low, at + start, back), np.minimum(least_far, low)
    i = np.flatnonzero((back[best] == np.arange(len(ca))) & (bits <= most_bits))
    if len(i) < least:
        return False
    a, b = pa_[i], pb[best[i]]
    for k in range(len(i)):
        grow, turn = b[k, 2] / a[k, 2], b[k, 3] - a[k, 3]
        m = grow * np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
        moved = (a[:, :2] - a[k, :2]) @ m.T + b[k, :2]
        if (np.hypot(*(moved - b[:, :2]).T) <= 3 * max(1.0, grow)).sum() >= max(least, 0.5 * len(i)):
            return True
    return False


def _shapes(codes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each two numbers of descriptors the places of the pairs (a, b) that have them."""
    size = np.array([len(c) for c in codes], np.int64)
    both = (size[a] << 32) | size[b]
    order = np.argsort(both, kind="stable")
    shapes, first = np.unique(both[order], return_index=True)
    for shape, own in zip(shapes.tolist(), np.split(order, first[1:]), strict=False):  # without pairs no shape
        yield shape >> 32, shape & 0xFFFFFFFF, own


def _apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Bits in which descriptors differ (na, nb, pairs), 255 at most. one: (words, na, pairs), two: (words, nb, pairs)."""
    far = np.empty((one.shape[1], *two.shape[1:]), np.uint8)
    other, bits = np.empty(two.shape[1:], np.uint64), np.empty(two.shape[1:], np.uint8)
    for row, own in enumerate(far):
        for w in range(len(one)):
            np.bitwise_xor(one[w, row], two[w], out=other)
            np.bitwise_count(other, out=bits if w else own)
            if w:
                own += bits if w + 1 < len(one) else np.minimum(bits, 255 - own, out=bits)
    return far


def _flat(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All descriptors (words, n) and where each image's begin."""
    starts = np.cumsum([0, *(len(c) for c in codes)])[:-1]
    return np.ascontiguousarray(np.concatenate([np.zeros((0, TESTS // 64), np.uint64), *codes]).T), starts


def possible(codes: list[np.ndarray], a: np.ndarray, b: np.ndarray, most_bits: int = 48, least: int = 5, cells: int = 1 << 20) -> np.ndarray:
    """False for pairs (a, b) of codes with too few near descriptors for `same_scene`; many pairs at once."""
    out = np.zeros(len(a), bool)
    whole, at = _flat(codes)
    for na, nb, own in _shapes(codes, a, b):
        if na * nb > cells:
            out[own] = True
            continue
        if min(na, nb) < least:
            continue
        step = max(1, min(512, cells // (na * nb)))
        for start in range(0, len(own), step):
            k = own[start : start + step]
            one, two = (np.take(whole, at[x] + np.arange(n)[:, None], axis=1) for x, n in ((a[k], na), (b[k], nb)))
            out[k] = (_apart(one, two).min(axis=1) <= most_bits).sum(axis=0) >= least
    return out


def linked(images: list[tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray, most_bits: int = 48, least: int = 5, cells: int = 1 << 20) -> np.ndarray:
    """What `same_scene` says of each pair (a, b) of images, many pairs at once; pairs of large images one by one."""
    codes = [c for _, c in images]
    out = np.zeros(len(a), bool)
    maybe = np.flatnonzero(possible(codes, a, b, most_bits, least, cells))
    whole, at = _flat(codes)
    places = np.concatenate([np.zeros((0, 4)), *(p for p, _ in images)])
    for na, nb, own in _shapes(codes, a[maybe], b[maybe]):
        own = maybe[own]
        if na * nb > cells // 64:
            out[own] = [same_scene(images[x], images[y], most_bits, least) for x, y in zip(a[own].tolist(), b[own].tolist(), strict=True)]
            continue
        step = cells // (4 * max(1, na * nb))
        for start in range(0, len(own), step):
            k = own[start : start + step]
            i, j = at[a[k]] + np.arange(na)[:, None], at[b[k]] + np.arange(nb)[:, None]
            far = _apart(np.take(whole, i, axis=1), np.take(whole, j, axis=1)).astype(np.int32)
            # the least distance and, of several, the first that has it
            bits, best = np.divmod((far * nb + np.arange(nb, dtype=np.int32)[:, None]).min(axis=1), nb)
            back = (far * na + np.arange(na, dtype=np.int32)[:, None, None]).min(axis=0) % na
            mutual = ((np.take_along_axis(back, best, axis=0) == np.arange(na)[:, None]) & (bits <= most_bits)).T
            matches = mutual.sum(axis=1)
            for m in np.unique(matches[matches >= least]).tolist():
                some = np.flatnonzero(matches == m)
                of = np.nonzero(mutual[some])[1].reshape(-1, m)
                one = places[i.T[some[:, None], of]]
                two = places[j.T[some[:, None], best.T[some[:, None], of]]]
                out[k[some]] = _agree(one, two, max(least, 0.5 * m))
    return out


def _agree(one: np.ndarray, two: np.ndarray, enough: float, cells: int = 1 << 18) -> np.ndarray:
    """Whether the similarity transform of any match takes enough matched places of one (pairs, matches, 4) to those of two."""
    out = np.zeros(len(one), bool)
    step = max(1, cells // one.shape[1] ** 2)
    for start in range(0, len(one), step):
        a, b = one[start : start + step], two[start : start + step]
        grow, turn = b[..., 2] / a[..., 2], b[..., 3] - a[..., 3]
        c, s = (grow * np.cos(turn))[..., None], (grow * np.sin(turn))[..., None]
        ax, ay, bx, by = (p[:, None, :, k] - p[:, :, None, k] for p in (a, b) for k in (0, 1))
        off = np.hypot(ax * c - ay * s - bx, ax * s + ay * c - by)
        out[start : start + step] = ((off <= 3 * np.maximum(1.0, grow)[..., None]).sum(axis=2) >= enough).any(axis=1)
    return out


def _loaded(spots: pa.ChunkedArray | pa.Array, codes: pa.ChunkedArray | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    parts = []
    for column in (spots, codes):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        values, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        parts.append([values[x:y].reshape(-1, 4) for x, y in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)])
    return [(p, c.view(np.uint64)) for p, c in zip(*parts, strict=True)]


def candidates(codes: list[np.ndarray], side: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (the first before the second) of images that share an entry, each once, about `most` at a time: those of the two sides
    if `side` (bool) has both, else all."""
    order = np.argsort(side, kind="stable")
    across, n = bool(len(side) and side.any() and not side.all()), int(np.count_nonzero(~side))
    owner = np.repeat(np.arange(len(order), dtype=np.uint64), [len(codes[k]) for k in order])
    bits = np.concatenate([np.zeros((0, TESTS // 64), np.uint64), *(codes[k] for k in order)])
    share = np.zeros((n, len(order) - n) if across else (len(order), len(order)), bool)
    for table in table_keys(bits).T:
        keys = np.sort(table << np.uint64(29) | owner)
        keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
        keys, member = keys >> np.uint64(29), (keys & np.uint64((1 << 29) - 1)).astype(np.int64)
        i, apart = np.flatnonzero(keys[1:] == keys[:-1]), 1
        while len(i):  # members of an entry lie together
            x, y = member[i], member[i + apart]
            if across:
                cross = (x < n) & (y >= n)
                share[x[cross], y[cross] - n] = True
            else:
                share[x, y] = True
            apart += 1
            i = i[: np.searchsorted(i, len(keys) - apart)]
            i = i[keys[i] == keys[i + apart]]
    for start, end in slices([np.count_nonzero(row) for row in share], most):
        x, y = np.divmod(np.flatnonzero(share[start:end]), share.shape[1])
        x, y = order[x + start], order[y + n if across else y]
        yield np.minimum(x, y), np.maximum(x, y)


def _links(feats: DataFrame, held: int = 6144) -> DataFrame:
    """node, root and n: the links of every node in each unit that has some, and the first node linked with it there. Images are
    dealt into parts of about `held` images of CORNERS corners; a unit has two parts, fills the Hamming tables with them and
    compares each pair that shares an entry once. Neither candidates nor links become rows."""
    weight = F.greatest(F.col("n_corners") / CORNERS, F.lit(1))
    parts = max(1, int(-(-(feats.agg(F.sum(weight)).first()[0] or 0) // held)))
    own = feats.select("node", "rep", "image_key", "spots", "codes", F.pmod(F.xxhash64("image_key"), F.lit(parts)).cast("int").alias("part"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending"), ("image_key", "ascending")])
        node, part = (table.column(c).to_numpy() for c in ("node", "part"))
        images = _loaded(table.column("spots"), table.column("codes"))
        if table.column("low")[0] != table.column("high")[0] and not (part != part[0]).any():  # pairs within a part belong to its own unit
            images = []
        n, ends, tops = np.zeros(len(node), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x, y in candidates([c for _, c in images], (part != part[0])[: len(images)]):
            x, y = np.stack([x, y])[:, linked(images, x, y)]
            n += np.bincount(np.concatenate([x, y]), minlength=len(node))
            ends, tops = stars(np.concatenate([ends, x]), np.concatenate([tops, y]))
        root, some = np.arange(len(node)), np.flatnonzero(n)
        root[ends] = tops
        return pa.table({"node": pa.array(node[some]), "root": pa.array(node[root[some]]), "n": pa.array(n[some], pa.int64())})

    return dealt.groupBy("low", "high").applyInArrow(run, "node long, root long, n long")


def copies(images: DataFrame) -> DataFrame:
    """id, n_corners, component_id and n_links of every row; n_links counts the other classes that its class is linked with."""
    rows = materialise(features(images), "image-features")
    best = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "n_corners", "spots", "codes")).alias("s")
    sets = rows.filter("image_key IS NOT NULL").groupBy("image_key").agg(best).select("image_key", F.col("s.id").alias("rep"), "s.n_corners", "s.spots", "s.codes")
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "image-sets")
    links = materialise(_links(sets), "image-links")
    roots = components(links.select(F.col("root").alias("a"), F.col("node").alias("b")))
    degree = links.groupBy("node").agg(F.sum("n").alias("n_links"))
    comps = materialise(sets.select("image_key", "rep", "node").join(roots, "node", "left").join(degree, "node", "left"), "image-components")
    least = comps.filter("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("least"))
    comps = comps.join(least, "root", "left").select("image_key", F.coalesce("least", "rep").alias("component_id"), "n_links")
    out = rows.select("id", "n_corners", "image_key").join(comps, "image_key", "left")
    return out.select("id", "n_corners", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def rasters(vectors: DataFrame, side: int = 64) -> DataFrame:
    """id and image: each vector of 64 numbers gives the strengths of 64 waves over the image. Another length: a null image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (np.arange(side) + 0.5) / side
        waves = np.cos(np.pi * np.outer(2 * np.arange(8) + 3, at))
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                if v is None or len(v) != 64 or None in v:
                    out.append(None)
                    continue
                out.append(write_image(128 + 60 * (waves.T @ np.array(v).reshape(8, 8) @ waves)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "image"])

    return vectors.select("id", "embedding").mapInArrow(run, "id long, image binary")
