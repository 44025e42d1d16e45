"""Substring deduplication by hashing lines and sentences (operator 9).

A text is cut into units: its lines, and each line into sentences (a full stop, exclamation or question mark before white
space). A unit is normalised to its lower-case words. Units of `least` words or more are grouped by a 128-bit digest over the
whole corpus with partial aggregates; the earliest occurrence, by doc_id and then position, stays and the others go. Whole lines
of several sentences go first, however short the sentences are; then the sentences of the lines that stayed are grouped. Their
code point offsets in the original text are kept, and so is the occurrence that stayed.

Defined results
    * null, empty and white texts have no units; a unit repeated within a text stays once there too
    * a line of one sentence is a sentence; of a line that stayed, sentences may still go that stay elsewhere; `occurrences` of a
      sentence counts those in lines that stayed
    * rows with a null doc_id come last; of rows repeated with one doc_id the first in input order stays, so each row is cleaned
      by its own spans
    * `clean` keeps all columns of the input and adds `removed_spans`, null where nothing went
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .spans import code_points, lower_ascii, spread, text_bytes, word_spans
from .tokens import texts_by_slice

UNIT = "doc_id long, row long, start long, end long, words int, h1 long, h2 long, line long, whole boolean"
_STOPS = (46, 33, 63)


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """BLAKE2b of the lower-case words head..tail of each unit with one space between, as two 64-bit numbers."""
    size = ends - starts
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    normal = np.full(at[-1], 32, np.uint8)
    normal[spread(at[:-1], size)] = lower_ascii(raw)[spread(starts, size)]
    flat = memoryview(normal.tobytes())
    found = b"".join(hashlib.blake2b(flat[a:b], digest_size=16).digest() for a, b in zip(at[head].tolist(), (at[tail] - 1).tolist(), strict=True))
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def units(raw: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """text index, byte start and end, words and two hashes of each unit with least words or more, where the line of several
    sentences that holds it begins (else -1), and whether it is such a line."""
    starts, ends, first = word_spans(raw, at)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, none, none.astype(bool)
    breaks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 10, out=breaks[1:])
    line = np.zeros(n, bool)
    line[first[:-1][first[:-1] < n]] = True
    line[1:] |= breaks[starts[1:]] > breaks[ends[:-1]]
    new = line.copy()
    new[1:] |= np.isin(raw[ends[:-1] - 1], _STOPS)
    lines, head = np.flatnonzero(line), np.flatnonzero(new)
    of = np.cumsum(line)[head] - 1  # the line of each sentence
    many = np.bincount(of, minlength=len(lines)) > 1
    within = np.where(many[of], starts[lines[of]], -1)
    tail, ends_of = np.append(head[1:], n), np.append(lines[1:], n)
    whole = np.repeat([True, False], [many.sum(), len(head)])
    head, tail, within = np.append(lines[many], head), np.append(ends_of[many], tail), np.append(starts[lines[many]], within)
    keep = tail - head >= least
    head, tail, within, whole = head[keep], tail[keep], within[keep], whole[keep]
    text = np.searchsorted(first, head, side="right") - 1
    h = digests(raw, starts, ends, head, tail)
    return text, starts[head], ends[tail - 1], tail - head, h[:, 0], h[:, 1], within, whole


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_by_slice(batches):
            raw, at = text_bytes(batch.column("text"))
            text, start, end, words, h1, h2, line, whole = units(raw, at, least)
            points = code_points(raw)
            base = points[at[:-1]][text]
            columns = [batch.column("doc_id").take(pa.array(text)), batch.column("row").take(pa.array(text))]
            columns += [pa.array(points[start] - base), pa.array(points[end] - base), pa.array(words.astype(np.int32)), pa.array(h1), pa.array(h2)]
            columns += [pa.array(np.where(line < 0, -1, points[line] - base)), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "start", "end", "words", "h1", "h2", "line", "whole"])

    return docs.select("doc_id", "text", "row").mapInArrow(run, UNIT)


def _later(found: DataFrame) -> DataFrame:
    """All occurrences of each unit but the first."""
    rank = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("row"), F.col("start"))
    groups = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).filter("n > 1")
    gone = found.join(groups, ["h1", "h2"]).filter((F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start")))
    return gone.select("doc_id", "row", "start", "end", "words", F.col("first.id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"), F.col("n").alias("occurrences"))


def _repeated(rows: DataFrame, least: int) -> DataFrame:
    """One row for each unit that goes, of written rows(doc_id, text, row)."""
    found = materialise(occurrences(rows, least), "units")
    lines = materialise(_later(found.filter("whole")), "lines")
    left = found.filter("NOT whole").join(lines.select("row", F.col("start").alias("line")).hint("merge"), ["row", "line"], "left_anti")
    return lines.unionByName(_later(materialise(left, "sentences")))


def removed_units(docs: DataFrame, least: int = 6) -> DataFrame:
    """One row for each unit that goes: doc_id, start, end, words, and the doc_id and start of the occurrence that stays."""
    return _repeated(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), least).drop("row")


def clean(docs: DataFrame, least: int = 6) -> DataFrame:
    """docs with the repeated units cut out of text, and the removed spans (start, end in the original) in `removed_spans`. A
    column of that name in docs gives way to it."""
    names = [c for c in docs.columns if c != "removed_spans"]
    rows = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    spans = _repeated(rows.select("doc.doc_id", "doc.text", "row"), least).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone"))
    # fold over the spans: what is before each stays
    cut = F.expr(
        "aggregate(gone, named_struct('at', 0L, 'out', ''), (s, x) -> named_struct('at', x.end, 'out', concat(s.out, substring(doc.text, s.at + 1, greatest(x.start - s.at, 0)))),"
        " s -> concat(s.out, substring(doc.text, s.at + 1)))"
    )
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(cut).alias("text")
    return rows.join(spans, "row", "left").select(*[text if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in names], F.col("gone").alias("removed_spans"))
