"""Span and event files as streams: windows with late data, and nodes kept up to date from each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import graph

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def per_window(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows, errors and mean value of each kind in each window; state older than the watermark goes."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    rows = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def keep_nodes(stream: DataFrame, path: str, checkpoint: str, key: str, props: list[str], parts: int = 64) -> StreamingQuery:
    """Upsert each batch into a table of nodes under path, dealt by a hash of the key into `parts` folders.

    A batch rewrites only the folders that its keys fall into, each under the batch's number; `nodes` reads the newest of each. A
    batch that is run again writes the same folders again, and a folder's versions before the last two are deleted, so neither work
    nor disk grows with the number of batches. The newest row of a batch by ts wins. Ends when all files present are read."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*props), "ts").alias("s")).select(key, *[f"s.{p}" for p in props])
        newest = newest.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        touched = [r["part"] for r in newest.select("part").distinct().collect()]  # at most `parts`
        held = {p: v for p, v in _versions(spark, path, number).items() if p in touched}
        if held:
            old = spark.read.parquet(*[f"{path}/part={p}/batch={v[-1]}" for p, v in held.items()])
            newest = graph.upsert(old.select(key, *props), newest.select(key, *props), [key], props, [], []).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        with_batch = newest.withColumn("batch", F.lit(number))
        with_batch.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(path)
        for p, v in held.items():
            _delete(spark, *[f"{path}/part={p}/batch={x}" for x in v[:-1]])

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[int]]:
    """The batches that wrote each folder, in order; those before a number only."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for status in fs.globStatus(hadoop(f"{path}/part=*/batch=*")) or []:
        part, batch = (int(x.split("=")[1]) for x in status.getPath().toString().rstrip("/").split("/")[-2:])
        if before is None or batch < before:
            out.setdefault(part, []).append(batch)
    return {p: sorted(v) for p, v in out.items()}


def _delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """The table that keep_nodes keeps."""
    return spark.read.parquet(*[f"{path}/part={p}/batch={v[-1]}" for p, v in _versions(spark, path).items()])
