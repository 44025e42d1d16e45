"""Change findings: diffs of two file topologies, pairs that are no change, renames, breaking removals and orphan producers.

Edges: source_id, source_name, target_id, target_name, rel, source_file, target_type. Where the order of edges decides a pairing, it
is that of target_id, then source_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut

EDGE = ("source_id", "source_name", "target_id", "target_name", "rel", "source_file", "target_type")
#: HTTP methods, the mark of an entity's table mapping, and the relations of producers.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE")
METADATA, HANDLER = "::__class_metadata", "::__route_handler"
PRODUCERS = ("PUBLISHES_TO", "PRODUCES")


def endpoint_key(urn: Column) -> Column:
    """endpoint:METHOD:/path of an endpoint's URN, whoever found it; null where it names no method before a path."""
    found = rf"(?i)^cr:endpoint:(?:[^:]*:)*?({'|'.join(METHODS)}):(/.*)$"
    return F.when(urn.rlike(found), F.concat(F.lit("endpoint:"), F.upper(F.regexp_extract(urn, found, 1)), F.lit(":"), F.regexp_extract(urn, found, 2)))


def edge_key(rel: Column, target_type: Column, target_id: Column) -> Column:
    """What identifies an edge's target in a diff."""
    own = F.when((rel == "IMPLEMENTS_ENDPOINT") & (target_type == "APIEndpoint"), endpoint_key(target_id))
    return F.coalesce(own, target_id)


def keyed(edges: DataFrame) -> DataFrame:
    """One edge for each (source_id, rel, key): the one with the greatest target_id."""
    rows = edges.withColumn("key", edge_key(F.col("rel"), F.col("target_type"), F.col("target_id")))
    return rows.groupBy("source_id", "rel", "key").agg(F.max_by(F.struct(*EDGE), F.struct("target_id", "source_file")).alias("e")).select("key", "e.*")


def diff_edges(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Added and removed edges by identity."""
    o, w, on = keyed(old), keyed(new), ["source_id", "rel", "key"]
    return w.join(o.select(*on), on, "left_anti").select(*EDGE), o.join(w.select(*on), on, "left_anti").select(*EDGE)


def diff_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """key and change of nodes (id, type, name); endpoints by method and path."""
    key = F.coalesce(F.when(F.col("type") == "APIEndpoint", endpoint_key(F.col("id"))), F.col("id")).alias("key")
    o, w = old.select(key).distinct(), new.select(key).distinct()
    return w.join(o, "key", "left_anti").withColumn("change", F.lit("added")).unionByName(o.join(w, "key", "left_anti").withColumn("change", F.lit("removed")))


def prune_duplicate_routes(edges: DataFrame) -> DataFrame:
    """edges without the implementations of an endpoint that a route handler of the same file implements."""
    key = F.when((F.col("rel") == "IMPLEMENTS_ENDPOINT") & (F.col("target_type") == "APIEndpoint"), endpoint_key(F.col("target_id")))
    rows = edges.withColumn("key", key).withColumn("handler", F.col("source_name").endswith(HANDLER))
    covered = rows.filter("handler AND key IS NOT NULL").select("source_file", "key").distinct().withColumn("covered", F.lit(True))
    return rows.join(covered, ["source_file", "key"], "left").filter("covered IS NULL OR handler").select(*edges.columns)


def paired(removed: DataFrame, added: DataFrame, by: list[str], apart: str) -> DataFrame:
    """Pairs of removed and added edges, each used once: equal in `by`, different in `apart`. First those with one source_id, then,
    of what is left, those with one source_name; the k-th removed edge of a group meets the k-th added one, and is no pair if both
    are equal in `apart`.

    Columns r and a: the edges."""

    def match(r: DataFrame, a: DataFrame, name: str) -> DataFrame:
        keys = [*by, name]
        w = Window.partitionBy(*keys).orderBy("target_id", "source_id")
        r, a = (x.withColumn("k", F.row_number().over(w)).select(*keys, "k", F.struct(*EDGE).alias(m)) for x, m in ((r, "r"), (a, "a")))
        return r.join(a, [*keys, "k"]).filter(F.col(f"r.{apart}") != F.col(f"a.{apart}")).select("r", "a")

    first = cut(match(removed, added, "source_id"))
    left = [x.join(first.select(f"{m}.*"), list(EDGE), "left_anti") for x, m in ((removed, "r"), (added, "a"))]
    return cut(first.unionByName(match(*left, "source_name")))


def drop_scope_drift(added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the pairs that differ in target_id alone: one target under two scopes."""
    pairs = paired(removed, added, ["source_file", "rel", "target_type", "target_name"], "target_id")
    return added.join(pairs.select("a.*"), list(EDGE), "left_anti"), removed.join(pairs.select("r.*"), list(EDGE), "left_anti")


def table_renames(added: DataFrame, removed: DataFrame) -> DataFrame:
    """old_table and new_table of entities whose mapping moved."""
    mapped = (F.col("rel") == "MAPS_TO") & (F.col("target_type") == "DataContainer") & F.col("source_name").endswith(METADATA)
    pairs = paired(removed.filter(mapped), added.filter(mapped), ["source_file"], "target_name")
    return pairs.select(F.lower("r.target_name").alias("old_table"), F.lower("a.target_name").alias("new_table")).distinct()


def drop_table_cascades(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """edges without those that touch the schema of a renamed table, but for the mapping itself."""
    tables = renames.select(F.explode(F.array("old_table", "new_table")).alias("table")).distinct()
    schema = lambda c: F.regexp_extract(F.col(c), "^cr:schema:database_table:([^:]+)", 1)
    rows = edges.withColumn("s", schema("source_id")).withColumn("t", schema("target_id"))
    for side in ("s", "t"):
        rows = rows.join(tables.select(F.col("table").alias(side), F.lit(True).alias(f"hit_{side}")), side, "left")
    kept = ((F.col("rel") == "MAPS_TO") & (F.col("target_type") == "DataContainer")) | (F.col("hit_s").isNull() & F.col("hit_t").isNull())
    return rows.filter(kept).select(*edges.columns)


def inherited_columns(removed: DataFrame, renames: DataFrame) -> DataFrame:
    """old_table, new_table and the names of the columns that moved with the table."""
    fields = removed.filter("rel = 'HAS_FIELD' AND target_type = 'DataField'").select(F.regexp_extract("source_id", "^cr:schema:database_table:([^:]+)", 1).alias("old_table"), "target_name")
    names = fields.groupBy("old_table").agg(F.array_join(F.array_sort(F.collect_list("target_name")), ", ").alias("columns"))
    return renames.join(names, "old_table", "left").select("old_table", "new_table", F.coalesce("columns", F.lit("")).alias("columns"))


def resource_score(candidate: dict[str, Column], target: dict[str, Column]) -> Column:
    """How well a candidate (urn, name, type, context) fits a removed target (urn, name, type)."""
    scope = lambda u: F.when(u.rlike("^cr:[^:]*:[^:]+:"), F.get(F.split(u, ":"), F.lit(2)))
    stem = lambda u: F.lower(F.substring_index(scope(u), "/", -1))
    a, b = F.lower(candidate["name"]), F.lower(target["name"])
    points = lambda test, k: F.when(F.coalesce(test, F.lit(False)), k).otherwise(0)
    name = F.when(a == b, 200).when(F.contains(a, b) | F.contains(b, a), 20).otherwise(0)
    own = points(candidate["urn"] == target["urn"], 1000) + points(candidate["type"] == target["type"], 100) + F.coalesce(name, F.lit(0)) + points(scope(candidate["urn"]) == scope(target["urn"]), 80)
    return own + points(stem(candidate["urn"]) == stem(target["urn"]), 60) + points(candidate["urn"].endswith(F.concat(F.lit(":"), target["name"])), 10) + points(F.contains(F.lower(candidate["context"]), stem(target["urn"])), 5)


def findings(added: DataFrame, removed: DataFrame, nodes: DataFrame, affected: DataFrame, renames: DataFrame) -> DataFrame:
    """severity, category, target_id, target_name, affected and score: one row a rename, a removed target and an added target.

    nodes: urn. affected: urn, affected, the number of services downstream. A target that is also removed is not looked at again as an
    added one, nor the new side of a renamed table."""
    pairs = paired(removed, added, ["source_file", "rel", "target_type"], "target_name")
    gone = removed.join(pairs.select("r.*"), list(EDGE), "left_anti").groupBy("target_id").agg(F.min_by(F.struct(*EDGE), F.struct("source_id", "rel")).alias("e"))
    fresh = added.join(pairs.select("a.*"), list(EDGE), "left_anti").join(removed.select("target_id"), "target_id", "left_anti")
    tables = renames.select(F.col("new_table").alias("t")).distinct()
    fresh = fresh.groupBy("target_id").agg(F.min_by(F.struct(*EDGE), F.struct("source_id", "rel")).alias("e"))
    fresh = fresh.join(tables, (F.lower("e.target_name") == F.col("t")) & (F.col("e.target_type") == "DataContainer"), "left_anti")
    rows = pairs.select(F.lit("renamed").alias("what"), "r.*").unionByName(gone.select(F.lit("removed").alias("what"), "e.*")).unionByName(fresh.select(F.lit("added").alias("what"), "e.*"))
    known = nodes.select(F.col("urn").alias("target_id"), F.lit(True).alias("known"))
    rows = rows.join(known, "target_id", "left").join(affected.select(F.col("urn").alias("target_id"), "affected"), "target_id", "left").withColumn("affected", F.coalesce("affected", F.lit(0)).cast("long"))
    added_, makes = F.col("what") == "added", F.col("rel").isin(*PRODUCERS)
    severity = F.when(added_ & (~makes | (F.col("affected") > 0)), "INFO").when(added_ | F.col("known").isNull(), "WARNING").when(F.col("affected") > 0, "DANGER").otherwise("INFO")
    category = F.when(added_, F.when(makes & (F.col("affected") == 0), "orphan_producer").otherwise("new_dependency")).when(F.col("what") == "renamed", "renamed_dependency").when(F.col("affected") > 0, "breaking_change").otherwise("removed_dependency")
    rows = rows.withColumn("severity", severity).withColumn("category", category)
    score = F.when(F.col("severity") == "DANGER", 2 * F.col("affected") + 1).when(F.col("severity") == "WARNING", 1).otherwise(0).cast("long")
    return rows.select("severity", "category", "target_id", "target_name", "affected", score.alias("score"))


def report(found: DataFrame) -> DataFrame:
    """Findings, services and score by severity."""
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"), F.sum("affected").alias("affected"), F.sum("score").alias("score"))


def rewired(edges: DataFrame, welded: DataFrame) -> DataFrame:
    """edges whose targets were merged into another resource point to it. welded: old, new."""
    out = edges.join(welded.select(F.col("old").alias("target_id"), "new"), "target_id", "left")
    return out.withColumn("target_id", F.coalesce("new", "target_id")).select(*edges.columns)
