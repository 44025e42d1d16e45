"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_written: list[tuple[object, str]] = []


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Set here only where it is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _drop(jvm_path: object, conf: object) -> None:
    try:
        jvm_path.getFileSystem(conf).delete(jvm_path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, removed when the driver exits."""
    path = f"{shared_dir(spark)}/orrery-{name}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(lambda: [_drop(*x) for x in _written])
    jvm = spark.sparkContext._jvm
    _written.append((jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage is cut, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialise` that nothing will read again; others are left alone."""
    for df in tables:
        path = getattr(df, "_folder", None)
        if path is not None:
            jvm = df.sparkSession.sparkContext._jvm
            _drop(jvm.org.apache.hadoop.fs.Path(path), df.sparkSession.sparkContext._jsc.hadoopConfiguration())


def whole_text(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def slices(sizes, limit: int):
    """Cut positions 0..len(sizes) into runs whose sizes add up to about limit, so a batch of long texts stays bounded."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


_trimmed = [0.0]


def trim(every: float = 0.25) -> None:
    """Give freed memory back to the system, at most once in `every` seconds: a Python worker is kept between tasks and shares its
    executor's memory with others, and the allocators would hold on to what a task's batches took."""
    if time.monotonic() - _trimmed[0] < every:
        return
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
    _trimmed[0] = time.monotonic()
