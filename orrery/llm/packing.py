"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing (operator 4).

A document is cut into full windows and a rest, the rest into pieces of at most `grain` tokens. Full windows are sequences
of their own. The pieces of the rests are dealt by hash into groups of about `per_group`, and each group is partitioned into
the fewest windows its tokens need: the two partial partitions with the largest imbalances are merged again and again, the
fullest windows of one with the emptiest of the other. If a window then exceeds the capacity, the count of windows rises.

Defined results
    * null and empty texts are the end mark alone; repeated rows are packed once for each row; a null doc_id stays null
    * sequence ids are distinct but not dense; offsets within a sequence have no gaps
    * further columns are ignored; an empty table gives an empty result
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .tokens import byte_bpe, texts_by_slice

END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, window: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    full = n - n % window
    out = [(a, window) for a in range(0, full, window)]
    rest = n - full
    parts = -(-rest // grain)
    bounds = [full + rest * i // parts for i in range(parts + 1)] if parts else []
    return out + [(a, b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def pieces(docs: DataFrame, window: int, grain: int, path: str | None = None) -> DataFrame:
    """All pieces of all documents with the checksum of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        for batch in texts_by_slice(batches):
            ids, at = encoder.encode(batch.column("text"))
            rows: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.append(ids[a:b], END_ID).astype("<u4")
                rows += [(doc, s, n, zlib.crc32(own[s : s + n]), len(own)) for s, n in cuts(len(own), window, grain)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def _merged(a: tuple, b: tuple, k: int, kids: list[tuple[int, int]]) -> tuple:
    """Two partial partitions (loads descending, nodes) as one of at most k windows; kids: the forest of joined nodes."""
    (la, na), (lb, nb) = a, b
    over = len(la) + len(lb) - k
    if over <= 0:
        loads, nodes = np.concatenate([la, lb]), np.concatenate([na, nb])
    else:
        i, j = len(la) - over, len(lb) - over
        joined = np.arange(len(kids), len(kids) + over)
        kids += zip(na[i:].tolist(), nb[j:][::-1].tolist(), strict=True)
        loads = np.concatenate([la[:i], la[i:] + lb[j:][::-1], lb[:j]])
        nodes = np.concatenate([na[:i], joined, nb[:j]])
    order = np.argsort(-loads, kind="stable")
    return loads[order], nodes[order]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k windows with nearly equal sums."""
    kids: list[tuple[int, int]] = [(-1, -1)] * len(sizes)
    heap = [(-n if k > 1 else 0, i, (np.array([n]), np.array([i]))) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        loads, nodes = _merged(a, b, k, kids)
        heapq.heappush(heap, (-int(loads[0] - (loads[-1] if len(loads) == k else 0)), serial, (loads, nodes)))
        serial += 1
    out = []
    for root in heap[0][2][1].tolist() if heap else []:
        held, todo = [], [root]
        while todo:
            x = todo.pop()
            if kids[x][0] < 0:
                held.append(x)
            else:
                todo += kids[x]
        out.append(sorted(held))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, beginning with what the sum needs, that differencing fills within capacity."""
    k = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while True:
        parts = differencing(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        k += 1


def pack(docs: DataFrame, window: int = 2048, grain: int = 512, per_group: int = 2000, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    cut = materialise(pieces(docs, window, grain, path).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = cut.filter(F.col("length") == window)
    rest = cut.filter(F.col("length") < window)
    n_groups = max(1, -(-rest.count() // per_group))

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("row", "ascending")])
        sizes = group.column("length").to_pylist()
        place, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for w, held in enumerate(windows(sizes, window)):
            at = 0
            for i in held:
                place[i], offset[i] = w, at
                at += sizes[i]
        sequence = 2 * (key[0].as_py() * (1 << 24) + place) + 1
        return group.select(names[:5]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rest = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(n_groups)))
    packed = rest.groupBy("group").applyInArrow(fill, PIECE + ", sequence_id long, offset long")
    alone = whole.withColumns({"sequence_id": 2 * F.col("row"), "offset": F.lit(0).cast("long")})
    return alone.select(*names).unionByName(packed.select(*names))
