"""One query for each training-data operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary, bpe_trie, exact_dedup, lines, media, minhash, packing, pii, quality, toxicity
from .common import read_documents

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents),
g AS (SELECT body, count(*) AS group_size FROM d GROUP BY body),
r AS (SELECT d.*, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST) AS keep_id FROM d)
SELECT r.doc_id, r.keep_id, g.group_size, r.doc_id = r.keep_id AS kept, sha256(r.body) AS text_sha256
FROM r JOIN g USING (body)
"""


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.round_trip(read_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir))


def op5_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.files(read_documents(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    return media.copies(media.rasters(vectors))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removed_units(read_documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_packing": op4_packing,
    "op5_binary": op5_binary,
    "op6_minhash": op6_minhash,
    "op7_pii": op7_pii,
    "op8_media": op8_media,
    "op9_lines": op9_lines,
    "op10_exact_dedup": op10_exact_dedup,
}

SQL: dict[str, str] = {"op10_exact_dedup": OP10_SQL}
