"""Token ids as flat binary files (operator 5).

Documents are dealt by ranges of doc_id. Each task writes two files into the shared folder: the ids one after the other as
little-endian unsigned integers of the least width that holds the vocabulary, and for each document its id and the 64-bit
offset at which it begins. A small table of parts, one row for each, gives the base of a part by a prefix sum. Readers map the
files into memory where the folder is a local path, else read ranges of them through the file system's own client.

A task writes under a name of its own attempt and reports it, so a repeated task leaves no doubt about which file counts.

Defined results
    * null and empty texts hold the end mark alone; rows with a null doc_id come first, repeated ids keep the order of texts
    * further columns are ignored; an empty table gives no parts and an empty result
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch
from .tokens import texts_by_slice, tokenizer_path, word_bpe

END_ID = 1
PART = "part long, file string, first_doc long, docs long, ids long, width int"
NO_DOC = np.iinfo(np.int64).min


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def id_width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def write(docs: DataFrame, folder: str, vocabulary: int = 49408, path: str | None = None, engine: str = "library", part_bytes: int = 32 << 20) -> DataFrame:
    """Write the files and return the table of parts, one for each part_bytes of text."""
    path = path or tokenizer_path("word_bpe_49k.json")
    width = id_width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = word_bpe(path, engine), TaskContext.get().partitionId()
        store, base = _open(folder)
        name, total, index = f"{part:06d}-{uuid.uuid4().hex[:8]}", 0, []
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{name}.bin") as out:
            for batch in texts_by_slice(batches):
                ids, at = encoder.encode(batch.column("text"))
                n = np.diff(at)
                marked = np.full(len(ids) + len(n), END_ID, dtype=f"<u{width}")
                marked[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                out.write(marked)
                keys = np.array([NO_DOC if d is None else d for d in batch.column("doc_id").to_pylist()], dtype="<i8")
                index.append((keys, total + at[:-1] + np.arange(len(n))))
                total += len(marked)
        if not index:
            store.delete_file(f"{base}/{name}.bin")
            return
        keys = np.concatenate([k for k, _ in index])
        offsets = np.append(np.concatenate([o for _, o in index]), total).astype("<u8")
        with store.open_output_stream(f"{base}/{name}.idx") as out:
            out.write(keys.astype("<i8"))
            out.write(offsets)
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "first_doc": int(keys[0]), "docs": len(keys), "ids": total, "width": width}], schema=_schema())

    def _schema() -> pa.Schema:
        whole = pa.int64()
        return pa.schema([("part", whole), ("file", pa.string()), ("first_doc", whole), ("docs", whole), ("ids", whole), ("width", pa.int32())])

    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    spread = docs.select("doc_id", "text").repartitionByRange(max(1, -(-size // part_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(spread.mapInArrow(run, PART), "parts")


def bases(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """The table of parts with the number of ids before each: a prefix sum over one row for each task of the writer."""
    rows, base = [], 0
    for r in parts.orderBy("part").collect():
        rows.append((r["part"], r["file"], r["docs"], r["ids"], r["width"], base))
        base += r["ids"]
    return spark.createDataFrame(rows, "part long, file string, docs long, ids long, width int, base long")


class Mapped:
    """A file of numbers: mapped into memory where the folder is local, else read range by range."""

    def __init__(self, folder: str, name: str):
        self.store, base = _open(folder)
        self.path = f"{base}/{name}"

    def read(self, dtype: str, count: int, offset: int = 0) -> np.ndarray:
        """count numbers from the byte offset on."""
        if not count:
            return np.zeros(0, dtype)
        if self.store.type_name == "local":
            return np.memmap(self.path, dtype=dtype, mode="r", offset=offset, shape=(count,))
        with self.store.open_input_file(self.path) as f:
            return np.frombuffer(f.read_at(count * np.dtype(dtype).itemsize, offset), dtype)


def read_part(folder: str, name: str, docs: int, width: int, step: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, offsets (one more) and ids of `step` documents of a part at a time, so that what is held is bounded."""
    index, flat = Mapped(folder, f"{name}.idx"), Mapped(folder, f"{name}.bin")
    for a in range(0, docs, step):
        n = min(step, docs - a)
        offsets = index.read("<u8", n + 1, 8 * (docs + a)).astype(np.int64)
        yield index.read("<i8", n, 8 * a), offsets, flat.read(f"<u{width}", int(offsets[-1] - offsets[0]), int(offsets[0]) * width)


def read_back(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for own, at, ids in read_part(folder, r["file"], r["docs"], r["width"]):
                    bounds = zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)
                    sums = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in bounds]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NO_DOC), pa.array(at[:-1] + r["base"], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    table = bases(spark, parts)
    n = max(1, parts.count())
    return table.repartition(n, F.col("part")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def files(docs: DataFrame) -> DataFrame:
    """Write docs' ids to a fresh folder under the shared one and read them back."""
    spark = docs.sparkSession
    folder = scratch(spark, "ids")
    return read_back(spark, folder, write(docs, folder))
