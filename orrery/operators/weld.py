"""Passes over nodes and edges: candidates by a join, a uniqueness rule, a rewiring, tombstones and garbage collection.

Each pass is a function of frames; a mapping is applied as a whole, through components, never pair by pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_match(candidates: DataFrame, key: str, target: str) -> DataFrame:
    """key and target of those keys that have exactly one target; smallest and largest agree, so no set is kept."""
    found = candidates.filter(F.col(target).isNotNull()).groupBy(key).agg(F.min(target).alias("_a"), F.max(target).alias("_b"))
    return found.filter("_a = _b").select(key, F.col("_a").alias(target))


def ambiguous(candidates: DataFrame, key: str, target: str) -> DataFrame:
    """Keys with several targets, for review."""
    return candidates.groupBy(key).agg(F.min(target).alias("_a"), F.max(target).alias("_b")).filter("_a <> _b").select(key)


def ladder(items: DataFrame, key: str, *steps: DataFrame) -> DataFrame:
    """key, target and step: each step (key, target) matches only what the steps before left, and only if it has one target."""
    left, out = items.select(key), None
    for k, step in enumerate(steps, 1):
        own = unique_match(step.join(left, key, "left_semi"), key, "target").withColumn("step", F.lit(k))
        out = own if out is None else out.unionByName(own)
        left = left.join(own.select(key), key, "left_anti")
    return out


def first_tier(items: DataFrame, key: str, *steps: DataFrame) -> DataFrame:
    """key, target and tier: all targets of the first step that has any."""
    rows = reduce(DataFrame.unionByName, [s.select(key, "target", F.lit(k).alias("tier")) for k, s in enumerate(steps, 1)])
    best = rows.groupBy(key).agg(F.min("tier").alias("tier"))
    return rows.join(best, [key, "tier"]).join(items.select(key), key, "left_semi").select(key, "target", "tier").distinct()


def rewired(edges: DataFrame, mapping: DataFrame, fan_out: bool = False) -> DataFrame:
    """edges (src, rel, dst) with ends moved from mapping.old to mapping.new; equal edges and loops go. With fan_out old may have
    several new ends."""
    for end in ("src", "dst"):
        edges = moved(edges, mapping if fan_out else mapping.groupBy("old").agg(F.min("new").alias("new")), end)
    return edges.filter("src <> dst").select("src", "rel", "dst").distinct()


def moved(edges: DataFrame, mapping: DataFrame, end: str) -> DataFrame:
    """edges with one end moved from mapping.old to mapping.new."""
    return edges.join(mapping.select(F.col("old").alias(end), "new"), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")


def orphans(nodes: DataFrame, *references: DataFrame) -> DataFrame:
    """Nodes (id) that no reference (id) names."""
    return nodes.join(reduce(DataFrame.unionByName, [r.select("id") for r in references]), "id", "left_anti")


def tombstoned(rows: DataFrame, dead: DataFrame, on: list[str], commit: str) -> DataFrame:
    """rows with valid_to set where they are live and among the dead."""
    out = rows.join(dead.select(*on, F.lit(True).alias("_dead")).distinct(), on, "left")
    return out.withColumn("valid_to", F.when(F.col("valid_to").isNull() & F.col("_dead"), F.lit(commit)).otherwise(F.col("valid_to"))).drop("_dead")


def reconciled(existing: DataFrame, expected: DataFrame, commit: str) -> DataFrame:
    """Live edges of the functions that were analysed again and are no longer expected get a tombstone. Both: src, rel, dst."""
    again = expected.select("src").distinct()
    stale = existing.filter("valid_to IS NULL").join(again, "src", "left_semi").join(expected, ["src", "rel", "dst"], "left_anti")
    return tombstoned(existing, stale, ["src", "rel", "dst"], commit)


def edge_upsert(old: DataFrame, new: DataFrame, keys: list[str], props: list[str]) -> DataFrame:
    """Edges by (src, rel, dst) and further key properties, of which null is a value; new properties win."""
    from .graph import upsert

    return upsert(old, new, ["src", "rel", "dst", *sorted(keys)], props, [], [])


def ngrams(name: Column, least: int = 2) -> Column:
    """(start, run) of all runs of dotted segments but the whole, from the segment `least` on, counted from 0."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    runs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.struct(i.alias("start"), F.array_join(F.slice(parts, i + 1, j - i), ".").alias("run"), (j - i).alias("size")))))
    return F.filter(runs, lambda r: (r["size"] >= least) & (r["size"] < n))
