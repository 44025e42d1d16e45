"""Graph operators over node and edge frames: keyed upserts, tombstones, rewiring, reachability and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUALITY = ("speculative", "low", "medium", "high", "exact")


def live(df: DataFrame, col: str = "valid_to_commit") -> DataFrame:
    return df.filter(F.col(col).isNull())


def upsert(old: DataFrame, new: DataFrame, keys: list[str], always: list[str], once: list[str], if_missing: list[str]) -> DataFrame:
    """Keyed merge: `always` columns take the new value (null deletes), `once` only on creation, `if_missing` keeps the first non-null."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    created, touched = F.col("o.__there").isNull(), F.col("n.__there").isNotNull()
    joined = o.withColumn("__there", F.lit(True)).alias("o").join(n.withColumn("__there", F.lit(True)).alias("n"), on, "full_outer")
    cols = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    cols += [F.when(touched, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in always]
    cols += [F.when(created, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in once]
    cols += [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in if_missing]
    return joined.select(*cols)


def split_missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that would be skipped because an endpoint is not a node."""
    ids = nodes.select(F.col("id").alias("__id")).distinct()
    no_src = edges.join(ids, edges["src"] == F.col("__id"), "left_anti")
    no_dst = edges.join(ids, edges["dst"] == F.col("__id"), "left_anti")
    return no_src.union(no_dst).distinct()


def rewire(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move edge ends from mapping.old to mapping.new and drop the edges that become equal or loops."""
    for end in ("src", "dst"):
        edges = edges.join(mapping, edges[end] == mapping["old"], "left").withColumn(end, F.coalesce("new", end)).drop("old", "new")
    return edges.filter("src <> dst").dropDuplicates(["src", "rel", "dst"])


def latest(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side only, with `change`."""
    gone = old.join(new, keys, "left_anti").select(*keys, F.lit("removed").alias("change"))
    return gone.unionByName(new.join(old, keys, "left_anti").select(*keys, F.lit("added").alias("change")))


def hash_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """added, modified, deleted or unchanged by key."""
    o, n = old.select(key, F.col(digest).alias("__o")), new.select(key, F.col(digest).alias("__n"))
    status = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "deleted").when(F.col("__o") == F.col("__n"), "unchanged").otherwise("modified")
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def reachable(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """id and the least number of hops from any seed, up to `hops`; each hop is one join with the frontier."""
    reached = seeds.select("id", F.lit(0).alias("hop")).distinct()
    frontier = reached
    for k in range(1, hops + 1):
        step = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = step.join(reached.select("id"), "id", "left_anti").withColumn("hop", F.lit(k))
        reached = reached.unionByName(frontier)
    return reached


def composite_quality(a: Column, b: Column, same_source: Column) -> Column:
    """The lower of two qualities; different sources raise it one step, up to high."""
    ranks = F.array(*[F.lit(q) for q in QUALITY])
    low = F.least(F.array_position(ranks, a), F.array_position(ranks, b))
    raised = F.greatest(low, F.least(low + 1, F.lit(4)))
    return F.element_at(ranks, F.when(same_source, low).otherwise(raised).cast("int"))


def spof_score(services: Column, teams: Column, writes: Column, reads: Column) -> Column:
    """0..100 on an exponential curve; half rounds up."""
    raw = 2 * services + 3 * teams + 1.5 * writes + 0.5 * reads
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 * (1 - F.exp(-raw / 15)) + 0.5))).cast("long")


def tier(score: Column) -> Column:
    return F.when(score >= 100, "T0").when(score >= 50, "T1").when(score >= 15, "T2").when(score >= 6, "T3").otherwise("T4")


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
