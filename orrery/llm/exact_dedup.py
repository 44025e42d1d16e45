"""Exact deduplication by a heavy-hitter split (operator 10), with DataFrame functions only.

A mergeable frequent-items sketch (the Misra-Gries family, Spark's ``approx_top_k``) names the digests that may be frequent.
The exact count and the winner of each are computed with map-side aggregation; those winners, at most ``max_heavy`` of them,
are broadcast, so rows of a frequent digest never meet in one task. All other digests use one ordinary shuffle.

Defined results
    * null text counts as empty; two texts are equal when identical after the characters 20, 09-0D (hex) are deleted
    * of equal texts the row with the most code points in its original text stays, then the smallest doc_id; a null doc_id
      comes after all others, and of rows repeated with the same doc_id exactly one stays
    * an empty table gives an empty result; further columns of the input are ignored by `groups` and kept by `deduplicate`
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, whole_text

SPACES = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text without white space."""
    return F.unhex(F.sha2(F.regexp_replace(text, SPACES, "").cast("binary"), 256))


def _short(digest: Column) -> Column:
    """The first seven bytes as a number: the sketch's item."""
    return F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long")


def frequent_keys(digests: DataFrame, max_heavy: int, tracked: int, least: int) -> list[int]:
    """Short keys whose estimated count reaches `least`; at most max_heavy, so the list's size is bounded by a parameter."""
    row = digests.agg(F.expr(f"approx_top_k(key, {max_heavy}, {tracked})").alias("top")).first()
    return [x["item"] for x in (row["top"] or []) if x["item"] is not None and x["count"] >= least]


def heavy_winners(digests: DataFrame, keys: list[int], order: Column) -> DataFrame:
    """Verified winners of the frequent keys: exact group size and the best row, from partial aggregates."""
    return (
        digests.filter(F.col("key").isin(keys) if keys else F.lit(False))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    )


def _digests(docs: DataFrame) -> DataFrame:
    """One small row per document: digest, short key, code points and a row number that stays once written."""
    d = docs.select("doc_id", text_digest(whole_text()).alias("digest"), F.length(whole_text()).alias("points"))
    d = d.withColumn("key", _short(F.col("digest"))).withColumn("row", F.monotonically_increasing_id())
    return materialise(d, "digests")


def _order() -> Column:
    return F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("row"))


def groups(docs: DataFrame, max_heavy: int = 256, tracked: int = 4096, least: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, dropped rows too."""
    d = _digests(docs)
    keys = frequent_keys(d, max_heavy, tracked, least)
    d = d.withColumn("best", _order())
    winners = heavy_winners(d, keys, F.col("best"))
    light = d.filter(~F.col("key").isin(keys)) if keys else d
    # partial aggregates first: a digest's rows meet as one row a task, and only digests of several rows come back
    several = light.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("best").alias("top")).filter("n > 1")
    light = light.join(several.withColumnRenamed("digest", "same"), F.col("digest") == F.col("same"), "left")
    light = light.select("doc_id", "digest", "row", F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce("top", "best").alias("best"))
    if keys:
        heavy = d.filter(F.col("key").isin(keys)).drop("best").join(F.broadcast(winners), "digest")
        light = light.unionByName(heavy.select(*light.columns))
    return light.select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, max_heavy: int = 256, tracked: int = 4096, least: int = 256) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows of frequent digests leave on the map side."""
    d = _digests(docs)
    keys = frequent_keys(d, max_heavy, tracked, least)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    rows = rows.withColumn("digest", text_digest(F.coalesce(F.col("doc.text"), F.lit(""))))
    if keys:
        winners = heavy_winners(d.withColumn("best", _order()), keys, F.col("best"))
        best = F.broadcast(winners.select(F.col("digest").alias("hot"), F.col("best.id").alias("hot_id")))
        rows = rows.join(best, F.col("digest") == F.col("hot"), "left")
        rows = rows.filter(F.col("hot").isNull() | F.col("doc.doc_id").eqNullSafe(F.col("hot_id"))).drop("hot", "hot_id")
    first = Window.partitionBy("digest").orderBy(F.length(F.coalesce(F.col("doc.text"), F.lit(""))).desc(), F.col("doc.doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(first)).filter("rank = 1").select("doc.*")
