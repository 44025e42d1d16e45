"""Grounding of facts: source, quality and evidence, how they merge, and what they say about a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Qualities from lowest to highest.
QUALITY = ("speculative", "low", "medium", "high", "exact")


def rank(quality: Column) -> Column:
    return F.array_position(F.array(*[F.lit(q) for q in QUALITY]), quality).cast("int") - 1


def quality(rank_: Column) -> Column:
    return F.get(F.array(*[F.lit(q) for q in QUALITY]), F.greatest(rank_, F.lit(0)))


def at_least(own: Column, asked: str) -> Column:
    return rank(own) >= QUALITY.index(asked)


def union(a: Column, b: Column) -> Column:
    """Both lists in order, each entry once; null for none."""
    both = F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
    return F.when(F.size(both) > 0, both)


def stamped(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New source, quality and review flag over the old; extractors, fallbacks and merged ids are joined. Untagged facts are guesses."""
    o, w = old.alias("o"), new.alias("w")
    cols = ["source", "quality", "review"]
    default = {"source": F.lit("heuristic"), "quality": F.lit("speculative"), "review": F.lit(True)}
    out = o.join(w, F.col(f"o.{key}") == F.col(f"w.{key}"), "full")
    there = F.col(f"w.{key}").isNotNull()
    return out.select(
        F.coalesce(f"o.{key}", f"w.{key}").alias(key),
        *[F.when(there, F.coalesce(f"w.{c}", default[c])).otherwise(F.col(f"o.{c}")).alias(c) for c in cols],
        *[union(F.col(f"o.{c}"), F.col(f"w.{c}")).alias(c) for c in ("extractors", "fallbacks", "merged")],
    )


def composite(a: Column, b: Column) -> Column:
    """struct(source, quality, review) of two agreeing facts: the lower quality, one step up, to high at most, if their sources differ."""
    same, low = a["source"] == b["source"], F.least(rank(a["quality"]), rank(b["quality"]))
    return F.struct(F.when(same, a["source"]).otherwise("composite").alias("source"), quality(F.when(same, low).otherwise(F.least(low + 1, F.lit(3)))).alias("quality"), (a["review"] | b["review"]).alias("review"))


def welded(a: Column, b: Column) -> Column:
    """The same of a survivor and what is merged into it: the lower quality stays."""
    same = a["source"] == b["source"]
    return F.struct(F.when(same, a["source"]).otherwise("composite").alias("source"), quality(F.least(rank(a["quality"]), rank(b["quality"]))).alias("quality"), (a["review"] | b["review"]).alias("review"))


def demoted(quality_: Column) -> Column:
    return quality(rank(quality_) - 1)


def recent_calls(calls: DataFrame, by: list[str], keep: int = 10) -> DataFrame:
    """The newest call of each model and prompt of a fact, and of those the last `keep`. calls: by, model, prompt, at."""
    newest = calls.groupBy(*by, "model", "prompt").agg(F.max("at").alias("at"))
    w = Window.partitionBy(*by).orderBy(F.desc("at"), F.desc("model"), F.desc("prompt"))
    return newest.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep).drop("r")


def tiers(facts: DataFrame) -> DataFrame:
    """label and the number of facts of each quality, and of those to review."""
    return facts.groupBy("label").agg(*[F.count_if(F.col("quality") == q).alias(q) for q in QUALITY], F.count_if("review").alias("review"))


def disputed(facts: DataFrame) -> DataFrame:
    """Facts of a model that another extractor, not a model, names too."""
    model = lambda x: x.startswith("llm")
    return facts.filter((F.col("source") == "llm") & (F.size("extractors") > 1) & F.exists("extractors", model) & F.exists("extractors", lambda x: ~model(x)))
