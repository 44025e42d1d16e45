"""Fixpoints over edges: components, reachability, taint, lineage, decaying propagation.

Rounds run on the driver, the work of each in one or two joins; each round's table is cut from its lineage. A round that adds nothing
ends the loop, so cycles end too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut


def components(pairs: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for every node of pairs(a, b): alternating large and small stars."""
    edges = pairs.filter("a <> b").select("a", "b").distinct()
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = cut(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        new = large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        new = cut(new)
        if not new.join(edges, ["a", "b"], "left_anti").limit(1).count() and not edges.join(new, ["a", "b"], "left_anti").limit(1).count():
            roots = new.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        edges = new


def reached(edges: DataFrame, seeds: DataFrame, rounds: int = 32) -> DataFrame:
    """node and hop: all that edges (src, dst) lead to from seeds (node), with the least number of hops."""
    out = frontier = cut(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    for k in range(1, rounds + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(out.select("node"), "node", "left_anti").withColumn("hop", F.lit(k)))
        if not frontier.limit(1).count():
            break
        out = out.unionByName(frontier)
    return out


def taint(imports: DataFrame, sinks: DataFrame, blind: DataFrame, rounds: int = 32) -> DataFrame:
    """file, sink and round: files that import a sink, and those that import such files. imports: src, dst; a dst among `blind`
    (observability packages) never taints."""
    clean = imports.join(blind.select(F.col("name").alias("dst")), "dst", "left_anti")
    seeds = clean.join(sinks.select(F.col("name").alias("dst")), "dst").select(F.col("src").alias("file"), F.col("dst").alias("sink")).distinct()
    out = frontier = cut(seeds.withColumn("round", F.lit(1)))
    for k in range(2, rounds + 1):
        step = frontier.join(clean, F.col("file") == F.col("dst")).select(F.col("src").alias("file"), "sink").distinct()
        frontier = cut(step.join(out.select("file", "sink"), ["file", "sink"], "left_anti").withColumn("round", F.lit(k)))
        if not frontier.limit(1).count():
            break
        out = out.unionByName(frontier)
    return out


def propagated(calls: DataFrame, tagged: DataFrame, hops: int = 3, decay: float = 0.95, least: float = 0.85) -> DataFrame:
    """node, hop and confidence: what calls a tagged node, by fewest hops, while base confidence times decay stays high enough.

    tagged: node, tags (how many). A node keeps the best confidence it gets."""
    base = F.when(F.col("tags") == 1, 0.97).when(F.col("tags") == 2, 0.90).otherwise(0.80)
    frontier = tagged.select("node", base.alias("base"))
    out = None
    for k in range(1, hops + 1):
        frontier = frontier.join(calls.select("src", "dst"), F.col("node") == F.col("dst")).groupBy(F.col("src").alias("node")).agg(F.max("base").alias("base"))
        own = frontier.select("node", F.lit(k).alias("hop"), F.round(F.col("base") * decay ** (k - 1), 6).alias("confidence")).filter(F.col("confidence") >= least)
        out = own if out is None else out.unionByName(own)
    return out.groupBy("node").agg(F.max_by(F.struct("hop", "confidence"), F.struct("confidence", -F.col("hop"))).alias("b")).select("node", "b.hop", "b.confidence")


def lineage(produces: DataFrame, consumes: DataFrame, fields: DataFrame, start: str, field: str, rounds: int = 16) -> DataFrame:
    """structure, via (function) and hop: where a field flows. A function that consumes a reached structure leads to what it produces,
    if that holds a field of the same name in any case, or one that ends in a dot and the name; each function once."""
    name = field.lower()
    holds = fields.filter((F.lower("field") == name) | F.lower("field").endswith(f".{name}")).select("structure").distinct()
    flows = consumes.select("function", F.col("structure").alias("src")).join(produces.select("function", F.col("structure").alias("dst")), "function").join(holds.withColumnRenamed("structure", "dst"), "dst", "left_semi").filter("src <> dst")
    flows = cut(flows.distinct())  # each round reads it
    spark = fields.sparkSession
    out = frontier = cut(spark.createDataFrame([(start, None, 0)], "structure string, via string, hop int"))
    used = spark.createDataFrame([], "via string")
    for k in range(1, rounds + 1):
        step = frontier.select(F.col("structure").alias("src")).join(flows, "src").join(used.withColumnRenamed("via", "function"), "function", "left_anti")
        step = cut(step.select("function", "dst").distinct())
        new = step.join(out.select(F.col("structure").alias("dst")), "dst", "left_anti").groupBy(F.col("dst").alias("structure")).agg(F.min("function").alias("via")).withColumn("hop", F.lit(k))
        frontier = cut(new)
        if not frontier.limit(1).count():
            break
        used = cut(used.unionByName(step.select(F.col("function").alias("via"))).distinct())
        out = out.unionByName(frontier)
    return out


def best_bridge(bridges: DataFrame) -> DataFrame:
    """One bridge of each step: a channel or endpoint to another service, else a written container, else any, then by id."""
    order = F.when(F.col("type").isin("MessageChannel", "APIEndpoint") & F.col("crosses"), 0).when((F.col("type") == "DataContainer") & F.col("written"), 1).otherwise(2)
    return bridges.groupBy("step").agg(F.min_by("id", F.struct(order, "id")).alias("bridge"))
