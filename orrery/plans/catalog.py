"""Registered queries over the estate, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import risk, semver
from ..functions import scalars as S
from ..operators import graph as G
from . import estate
from .estate import Estate

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, ctes: bool = True):
    """Register f(estate) under name; sql follows the estate's common table expressions unless ctes is false."""

    def add(f):
        _QUERIES[name] = lambda spark, sf_dir: f(Estate(spark, sf_dir))
        if sql:
            _SQL[name] = f"WITH {estate.SQL}{', ' if sql.lstrip().startswith('+') else ''}{sql.lstrip().removeprefix('+')}" if ctes else sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["d2_blast_downstream"](spark, sf_dir)


n = lambda: F.count(F.lit(1))


@query("c1_live_edges", "SELECT rel, live, count(*) AS n FROM edge GROUP BY rel, live")
def live_edges(e: Estate) -> DataFrame:
    return e.edges().groupBy("rel", "live").agg(n().alias("n"))


@query(
    "c2_resolve_resource",
    """+ r AS (SELECT 'cr:datacontainer:p' || p_partkey AS id, p_name AS name FROM part),
    t AS (SELECT id, name, CASE WHEN id = 'cr:datacontainer:p7' THEN 1 WHEN lower(name) = 'cr:datacontainer:p7' THEN 2
          WHEN contains(lower(id), 'cr:datacontainer:p7') THEN 3 END AS tier FROM r)
    SELECT id, name, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""",
)
def resolve(e: Estate, asked: str = "cr:datacontainer:p7") -> DataFrame:
    r = e.table("part").select(estate.urn("datacontainer", F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("id"), F.col("p_name").alias("name"))
    t = r.withColumn("tier", F.when(F.col("id") == asked, 1).when(F.lower("name") == asked.lower(), 2).when(F.contains(F.lower("id"), F.lit(asked.lower())), 3))
    return t.join(F.broadcast(t.agg(F.min("tier").alias("tier"))), "tier").select("id", "name", "tier")


@query(
    "d2_blast_downstream",
    """+ c AS (SELECT resource, s.id, s.team, rel FROM access JOIN service s ON service = s.id
      WHERE rel IN ('READS', 'LISTENS_TO', 'MAPS_TO'))
    SELECT resource, count(DISTINCT id) AS services, count(DISTINCT team) AS teams, count(DISTINCT team) > 1 AS cross_team FROM c GROUP BY resource""",
)
def blast_downstream(e: Estate) -> DataFrame:
    """Consumers of every resource over dependency relations, lifted to their services."""
    c = e.dealt(e.pairs("READS", "LISTENS_TO", "MAPS_TO"), "s").join(e.teams(), "s")
    out = e.dealt(c, "x").groupBy("x", "team").agg(n().alias("k")).groupBy("x").agg(F.sum("k").alias("services"), n().alias("teams"))
    return out.select(estate.resource_urn(F.col("x")).alias("resource"), "services", "teams", (F.col("teams") > 1).alias("cross_team"))


@query(
    "d3_blast_upstream",
    """SELECT resource, count(DISTINCT service) AS producers, CAST(sum(n) AS BIGINT) AS writes FROM access
    WHERE rel IN ('WRITES', 'PUBLISHES_TO') GROUP BY resource""",
)
def blast_upstream(e: Estate) -> DataFrame:
    """Of each resource; a producer either writes or publishes, so its rows are counted."""
    out = e.dealt(e.use("WRITES", "PUBLISHES_TO"), "x").groupBy("x").agg(n().alias("producers"), F.sum("n").alias("writes"))
    return out.select(estate.resource_urn(F.col("x")).alias("resource"), "producers", "writes")


@query(
    "d4_owner_cascade",
    """+ sole AS (SELECT repo, min(id) AS only FROM service WHERE id LIKE 'cr:service:s%' GROUP BY repo HAVING count(DISTINCT id) = 1)
    SELECT s.repo, count(*) AS services, count(sole.only) > 0 AS sole_owner FROM service s LEFT JOIN sole USING (repo) GROUP BY s.repo""",
)
def owner_cascade(e: Estate) -> DataFrame:
    s = e.services()
    sole = s.filter(F.col("id").startswith("cr:service:s")).groupBy("repo").agg(F.min("id").alias("only"), F.countDistinct("id").alias("k")).filter("k = 1").drop("k")
    return s.join(sole, "repo", "left").groupBy("repo").agg(n().alias("services"), (F.count("only") > 0).alias("sole_owner"))


@query("d5_orphan_services", "SELECT id, name FROM service WHERE id NOT IN (SELECT service FROM access)")
def orphan_services(e: Estate) -> DataFrame:
    return e.services().join(e.busy().select(estate.service_urn(F.col("s")).alias("service")), F.col("id") == F.col("service"), "left_anti").select("id", "name")


@query("d6_read_containers", "SELECT DISTINCT dst AS resource FROM edge WHERE rel = 'WRITES' AND dst IN (SELECT dst FROM edge WHERE rel = 'READS' AND live)")
def read_containers(e: Estate) -> DataFrame:
    edges = e.edges()
    readers = edges.filter("rel = 'READS' AND live").select("dst")
    return edges.filter("rel = 'WRITES'").join(readers, "dst", "left_semi").select(F.col("dst").alias("resource")).distinct()


@query(
    "d10_container_weld",
    """SELECT p_brand || ':' || p_type || ':' || p_size AS fingerprint, min(p_partkey) AS winner, count(*) AS members FROM part
    GROUP BY 1 HAVING count(*) > 1""",
    ctes=False,
)
def container_weld(e: Estate) -> DataFrame:
    """Containers with one fingerprint are one; the smallest id of the group wins, so chains need no order."""
    p = e.table("part").withColumn("fingerprint", F.concat_ws(":", "p_brand", "p_type", F.col("p_size").cast("string")))
    return p.groupBy("fingerprint").agg(F.min("p_partkey").alias("winner"), n().alias("members")).filter("members > 1")


@query(
    "d16_shared_resources",
    """+ w AS (SELECT DISTINCT service, resource FROM access WHERE rel IN ('READS', 'WRITES')),
    k AS (SELECT resource FROM w GROUP BY resource HAVING count(*) > 1)
    SELECT a.service AS a, b.service AS b, count(*) AS shared FROM w a JOIN w b ON a.resource = b.resource AND a.service < b.service
    WHERE a.resource IN (SELECT resource FROM k) GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def shared_resources(e: Estate) -> DataFrame:
    w = e.use("READS", "WRITES").select("s", "x").distinct()
    a, b = w.withColumnRenamed("s", "a"), w.withColumnRenamed("s", "b")
    pairs = a.join(b, "x").filter("a < b").groupBy("a", "b").agg(n().alias("shared")).filter("shared >= 2")
    first, second = estate.service_urn(F.col("a")), estate.service_urn(F.col("b"))
    return pairs.select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b"), "shared")


@query(
    "e1_data_gravity",
    """+ g AS (SELECT resource, count(DISTINCT service) AS services, count(DISTINCT team) AS teams,
        CAST(sum(CASE WHEN rel IN ('WRITES', 'PUBLISHES_TO') THEN n ELSE 0 END) AS BIGINT) AS writes,
        CAST(sum(CASE WHEN rel IN ('READS', 'LISTENS_TO') THEN n ELSE 0 END) AS BIGINT) AS reads
      FROM access JOIN service s ON service = s.id GROUP BY resource HAVING count(DISTINCT service) > 1)
    SELECT *, CAST(least(100, floor(100 * (1 - exp(-(2 * services + 3 * teams + 1.5 * writes + 0.5 * reads) / 15)) + 0.5)) AS BIGINT) AS spof FROM g""",
)
def data_gravity(e: Estate) -> DataFrame:
    """Distinct services and teams, writes and reads of each resource that several services use, with its single-point score."""
    of = lambda *rels: F.sum(F.when(F.col("rel").isin(*[estate.RELS.index(r) for r in rels]), F.col("n")).otherwise(0))
    per = e.dealt(e.pairs(writes=of("WRITES", "PUBLISHES_TO"), reads=of("READS", "LISTENS_TO")), "s").join(e.teams(), "s")
    per = e.dealt(per, "x").groupBy("x", "team").agg(n().alias("services"), F.sum("writes").alias("writes"), F.sum("reads").alias("reads"))
    g = per.groupBy("x").agg(F.sum("services").alias("services"), n().alias("teams"), F.sum("writes").alias("writes"), F.sum("reads").alias("reads")).filter("services > 1")
    return g.select(estate.resource_urn(F.col("x")).alias("resource"), "services", "teams", "writes", "reads", G.spof_score(F.col("services"), F.col("teams"), F.col("writes"), F.col("reads")).alias("spof"))


@query(
    "e3_bottlenecks",
    """+ w AS (SELECT DISTINCT service, resource FROM access WHERE rel IN ('WRITES', 'PUBLISHES_TO')),
    r AS (SELECT DISTINCT service, resource FROM access WHERE rel IN ('READS', 'LISTENS_TO')),
    d AS (SELECT DISTINCT w.service, r.service AS dependent FROM w JOIN r USING (resource) WHERE w.service <> r.service)
    SELECT d.service, count(*) AS dependents, count(DISTINCT team) AS teams FROM d JOIN service s ON dependent = s.id GROUP BY d.service""",
)
def bottlenecks(e: Estate) -> DataFrame:
    w = e.use("WRITES", "PUBLISHES_TO").select("s", "x")
    r = e.use("READS", "LISTENS_TO").select(F.col("s").alias("dependent"), "x")
    d = w.join(r, "x").filter("s <> dependent").select("s", "dependent").distinct()
    teams = e.teams().select(F.col("s").alias("dependent"), "team")
    out = d.join(teams, "dependent").groupBy("s", "team").agg(n().alias("k")).groupBy("s").agg(F.sum("k").alias("dependents"), n().alias("teams"))
    return out.select(estate.service_urn(F.col("s")).alias("service"), "dependents", "teams")


@query(
    "e4_degree_weight",
    """+ d AS (SELECT id, count(*) AS degree FROM (SELECT service AS id FROM access UNION ALL SELECT resource FROM access) GROUP BY id)
    SELECT id, degree, round(1 + log10(greatest(1, degree)), 6) AS weight FROM d""",
)
def degree(e: Estate) -> DataFrame:
    d = _degrees(e)
    name = F.when(F.col("kind") == 0, estate.service_urn(F.col("id"))).otherwise(estate.resource_urn(F.col("id")))
    return d.select(name.alias("id"), "degree", F.round(1 + F.log10(F.greatest(F.lit(1), F.col("degree")).cast("double")), 6).alias("weight"))


def _degrees(e: Estate) -> DataFrame:
    """kind (0: service, 1: resource), id and degree; both ends of an edge are counted from one pass."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("s").alias("id")), F.struct(F.lit(1).alias("kind"), F.col("x").alias("id"))))
    return e.dealt(e.use().select(ends.alias("end")).select("end.kind", "end.id"), "kind", "id").groupBy("kind", "id").agg(n().alias("degree"))


@query(
    "e6_gravity_score",
    """+ out1 AS (SELECT DISTINCT service AS src, resource AS dst FROM access WHERE rel IN ('WRITES', 'PUBLISHES_TO')),
    back AS (SELECT DISTINCT resource AS src, service AS dst FROM access WHERE rel IN ('READS', 'LISTENS_TO', 'MAPS_TO')),
    hop AS (SELECT src, dst, 2.0 AS coef, 1 AS stage FROM out1
      UNION ALL SELECT DISTINCT a.src, b.dst, 1.5, 2 FROM out1 a JOIN back b ON a.dst = b.src WHERE a.src <> b.dst),
    d AS (SELECT id, count(*) AS degree FROM (SELECT service AS id FROM access UNION ALL SELECT resource FROM access) GROUP BY id),
    f AS (SELECT src, dst, arg_min(coef, stage) AS coef FROM hop GROUP BY src, dst),
    g AS (SELECT src AS service, round(CAST(sum(coef * (1 + log10(degree))) AS DOUBLE), 4) AS score, count(*) AS reached FROM f JOIN d ON dst = d.id GROUP BY src)
    SELECT service, score, reached, CASE WHEN score >= 100 THEN 'T0' WHEN score >= 50 THEN 'T1' WHEN score >= 15 THEN 'T2' WHEN score >= 6 THEN 'T3' ELSE 'T4' END AS tier FROM g""",
)
def gravity_score(e: Estate) -> DataFrame:
    """Two hops downstream through resources; the first hit of a node decides its coefficient."""
    one = e.use("WRITES", "PUBLISHES_TO").select("s", "x")
    back = e.pairs("READS", "LISTENS_TO", "MAPS_TO").select(F.col("s").alias("end"), "x")
    d = _degrees(e)
    weigh = lambda coef: coef * (1 + F.log10(F.col("degree").cast("double")))
    # services and resources are different nodes, so no pair is met both directly and through a resource
    one, back = e.dealt(one, "x"), e.dealt(back, "x")
    direct = one.join(d.filter("kind = 1").select(F.col("id").alias("x"), "degree"), "x").groupBy("s").agg(F.sum(weigh(2.0)).alias("score"), n().alias("reached"))
    two = e.dealt(one.join(back, "x").filter("s <> end").select("s", "end"), "end").distinct()
    two = two.join(d.filter("kind = 0").select(F.col("id").alias("end"), "degree"), "end").groupBy("s").agg(F.sum(weigh(1.5)).alias("score"), n().alias("reached"))
    g = direct.unionByName(two).groupBy("s").agg(F.round(F.sum("score"), 4).alias("score"), F.sum("reached").alias("reached"))
    return g.select(estate.service_urn(F.col("s")).alias("service"), "score", "reached", G.tier(F.col("score")).alias("tier"))


@query(
    "e11_drift",
    """+ declared AS (SELECT DISTINCT service, p_brand AS dep FROM access JOIN part ON resource = 'cr:datacontainer:p' || p_partkey WHERE rel = 'MAPS_TO'),
    seen AS (SELECT DISTINCT service, p_brand AS dep FROM access JOIN part ON resource = 'cr:datacontainer:p' || p_partkey WHERE rel IN ('READS', 'WRITES')),
    j AS (SELECT coalesce(d.service, s.service) AS service, d.dep IS NOT NULL AS declared, s.dep IS NOT NULL AS seen
      FROM declared d FULL JOIN seen s ON d.service = s.service AND d.dep = s.dep)
    SELECT service, count(*) FILTER (declared AND seen) AS aligned, count(*) FILTER (declared AND NOT seen) AS missing,
      count(*) FILTER (seen AND NOT declared) AS undeclared,
      CAST(floor((1 - count(*) FILTER (declared <> seen) / count(*)) * 100 + 0.5) AS BIGINT) AS score FROM j GROUP BY service""",
)
def drift(e: Estate) -> DataFrame:
    """Declared against observed dependencies of each service: aligned, missing, undeclared, and a score."""
    part = e.table("part").select(estate.number(F.col("p_partkey"), 0).alias("x"), F.col("p_brand").alias("dep"))
    a = e.use("READS", "WRITES", "MAPS_TO").join(part, "x")
    per = a.groupBy("s", "dep").agg(F.max(F.col("rel") == 2).alias("d"), F.max(F.col("rel") < 2).alias("o"))
    out = per.groupBy("s").agg(F.count_if(F.col("d") & F.col("o")).alias("aligned"), F.count_if(F.col("d") & ~F.col("o")).alias("missing"), F.count_if(F.col("o") & ~F.col("d")).alias("undeclared"), F.count_if(F.col("d") != F.col("o")).alias("off"), n().alias("all"))
    score = F.floor((1 - F.col("off") / F.col("all")) * 100 + 0.5).cast("long")
    return out.select(estate.service_urn(F.col("s")).alias("service"), "aligned", "missing", "undeclared", score.alias("score"))


@query(
    "e15_repo_inventory",
    """+ f AS (SELECT service, count(*) AS functions FROM fn GROUP BY service)
    SELECT repo, min(team) AS team, count(*) AS services, CAST(sum(coalesce(functions, 0)) AS BIGINT) AS functions FROM service LEFT JOIN f ON id = f.service GROUP BY repo""",
)
def repo_inventory(e: Estate) -> DataFrame:
    f = e.functions().groupBy("service").agg(n().alias("functions"))
    return e.services().join(f, F.col("id") == F.col("service"), "left").groupBy("repo").agg(F.min("team").alias("team"), n().alias("services"), F.sum(F.coalesce("functions", F.lit(0))).alias("functions"))


@query("e16_team_inventory", "SELECT team, count(*) AS services, count(DISTINCT repo) AS repos FROM service GROUP BY team")
def team_inventory(e: Estate) -> DataFrame:
    return e.services().groupBy("team").agg(n().alias("services"), F.countDistinct("repo").alias("repos"))


_DEPS = """+ dep AS (SELECT DISTINCT 'cr:service:s' || l_suppkey AS service, p_brand AS package, p_size AS minor FROM lineitem JOIN part ON l_partkey = p_partkey),
    top AS (SELECT package, max(minor) AS latest FROM dep GROUP BY package)"""


def _deps(e: Estate) -> DataFrame:
    p = e.table("part").select("p_partkey", F.col("p_brand").alias("package"), F.col("p_size").alias("minor"))
    li = e.table("lineitem").select("l_partkey", estate.urn("service", F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("service"))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("service", "package", "minor").distinct()


@query("e18_dependency_report", _DEPS + " SELECT package, count(DISTINCT service) AS consumers, count(DISTINCT minor) AS versions, count(DISTINCT minor) > 1 AS skew, max(minor) AS latest_minor FROM dep GROUP BY package")
def dependency_report(e: Estate) -> DataFrame:
    return _deps(e).groupBy("package").agg(F.countDistinct("service").alias("consumers"), F.countDistinct("minor").alias("versions"), (F.countDistinct("minor") > 1).alias("skew"), F.max("minor").alias("latest_minor"))


@query("e19_version_drift", _DEPS + " SELECT service, package, CASE WHEN max(minor) = max(latest) THEN 'none' ELSE 'minor' END AS drift FROM dep JOIN top USING (package) GROUP BY service, package")
def version_drift(e: Estate) -> DataFrame:
    d = _deps(e).groupBy("service", "package").agg(F.max("minor").alias("minor"))
    top = d.groupBy("package").agg(F.max("minor").alias("latest"))
    v = lambda c: F.concat(F.lit("1."), F.col(c).cast("string"), F.lit(".0"))
    keys = d.join(top, "package").select("service", "package", semver.key(v("minor")).alias("a"), semver.key(v("latest")).alias("b"))
    return keys.select("service", "package", semver.difference(F.col("a"), F.col("b")).alias("drift"))


@query("e23_severity", "SELECT p_partkey, CASE WHEN p_size / 5.0 >= 9 THEN 'CRITICAL' WHEN p_size / 5.0 >= 7 THEN 'HIGH' WHEN p_size / 5.0 >= 4 THEN 'MEDIUM' WHEN p_size > 0 THEN 'LOW' ELSE 'UNKNOWN' END AS severity FROM part", ctes=False)
def severity(e: Estate) -> DataFrame:
    return e.table("part").select("p_partkey", risk.severity(F.lit(None).cast("string"), F.col("p_size") / 5.0).alias("severity"))


@query("e25_quality_tiers", "SELECT source, count(*) FILTER (quality = 1) AS high, count(*) FILTER (quality = 0) AS low, count(*) FILTER (toxic = 1) AS needs_review FROM labels JOIN documents USING (doc_id) GROUP BY source", ctes=False)
def quality_tiers(e: Estate) -> DataFrame:
    d = e.table("labels").join(e.table("documents").select("doc_id", "source"), "doc_id")
    return d.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("high"), F.count_if(F.col("quality") == 0).alias("low"), F.count_if(F.col("toxic") == 1).alias("needs_review"))


@query("e28_word_census", "SELECT w AS tool, count(DISTINCT p_partkey) AS configs, count(DISTINCT p_brand) AS repos FROM (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> '' GROUP BY w", ctes=False)
def census(e: Estate) -> DataFrame:
    w = e.table("part").select("p_partkey", "p_brand", F.explode(F.split("p_name", " ")).alias("tool")).filter("tool <> ''")
    return w.groupBy("tool").agg(F.countDistinct("p_partkey").alias("configs"), F.countDistinct("p_brand").alias("repos"))


_PRINT = r"left(sha256(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\f\v]+', '', 'g')), 16)"


@query("e29_exact_duplicates", f"SELECT {_PRINT} AS fingerprint, count(*) AS copies, count(DISTINCT source) AS teams FROM documents GROUP BY 1 HAVING count(*) > 1", ctes=False)
def exact_duplicates(e: Estate) -> DataFrame:
    d = e.table("documents").select("source", S.content_hash(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\r\f\x0B]+", "")).alias("fingerprint"))
    return d.groupBy("fingerprint").agg(n().alias("copies"), F.countDistinct("source").alias("teams")).filter("copies > 1")


@query(
    "e35_merkle_root",
    """SELECT s_nationkey AS repo, left(sha256(string_agg(h, ':' ORDER BY h)), 16) AS root
    FROM (SELECT s_nationkey, left(sha256(s_name), 16) AS h FROM supplier) GROUP BY s_nationkey""",
    ctes=False,
)
def merkle_root(e: Estate) -> DataFrame:
    """The root needs all hashes of a repository in order: an array of 16 bytes a file, so a repository may have some millions."""
    h = e.table("supplier").select("s_nationkey", S.content_hash(F.col("s_name")).alias("h"))
    return h.groupBy(F.col("s_nationkey").alias("repo")).agg(S.content_hash(F.array_join(F.array_sort(F.collect_list("h")), ":")).alias("root"))


@query(
    "b1_upsert",
    """+ o AS (SELECT p_partkey AS id, p_name AS name, p_brand AS once, CASE WHEN p_size > 25 THEN p_size END AS fill FROM part WHERE p_partkey % 3 <> 0),
    w AS (SELECT p_partkey AS id, CASE WHEN p_size > 10 THEN upper(p_name) END AS name, p_type AS once, p_size AS fill FROM part WHERE p_partkey % 2 = 0)
    SELECT coalesce(o.id, w.id) AS id, CASE WHEN w.id IS NOT NULL THEN w.name ELSE o.name END AS name,
      CASE WHEN o.id IS NULL THEN w.once ELSE o.once END AS once, coalesce(o.fill, w.fill) AS fill FROM o FULL JOIN w ON o.id = w.id""",
)
def upsert(e: Estate) -> DataFrame:
    p = e.table("part")
    old = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("once"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("fill"))
    new = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.upper("p_name")).alias("name"), F.col("p_type").alias("once"), F.col("p_size").alias("fill"))
    return G.upsert(old, new, ["id"], ["name"], ["once"], ["fill"])


@query("b3_missing_endpoints", "+ node AS (SELECT 'cr:channel:o' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F') SELECT DISTINCT src, rel, dst FROM edge WHERE rel = 'LISTENS_TO' AND (dst NOT IN (SELECT id FROM node) OR src NOT IN (SELECT id FROM fn))")
def missing_endpoints(e: Estate) -> DataFrame:
    channels = e.table("orders").filter("o_orderstatus <> 'F'").select(estate.urn("channel", F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).alias("id"))
    return G.split_missing_endpoints(e.edges().filter("rel = 'LISTENS_TO'").select("src", "rel", "dst"), channels.unionByName(e.functions().select("id")))


@query("b13_gc_containers", "SELECT 'cr:datacontainer:p' || p_partkey AS id FROM part WHERE 'cr:datacontainer:p' || p_partkey NOT IN (SELECT dst FROM edge WHERE live)")
def gc_containers(e: Estate) -> DataFrame:
    ids = e.table("part").select(estate.urn("datacontainer", F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("id"))
    return ids.join(e.edges().filter("live").select(F.col("dst").alias("id")), "id", "left_anti")


@query("f7_latest_order", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey", ctes=False)
def latest_order(e: Estate) -> DataFrame:
    return G.latest(e.table("orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query(
    "h2_snapshot_diff",
    """+ o AS (SELECT DISTINCT src, rel, dst FROM edge WHERE rel <> 'LISTENS_TO' AND NOT live), w AS (SELECT DISTINCT src, 'READS' AS rel, dst FROM edge WHERE rel = 'READS')
    SELECT *, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM w) UNION ALL SELECT *, 'added' FROM (SELECT * FROM w EXCEPT SELECT * FROM o)""",
)
def snapshot_diff(e: Estate) -> DataFrame:
    edges = e.edges()
    return G.snapshot_diff(edges.filter("rel <> 'LISTENS_TO' AND NOT live").drop("live"), edges.filter("rel = 'READS'").drop("live"), ["src", "rel", "dst"])


@query(
    "h6_merkle_diff",
    """SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS status
    FROM (SELECT p_partkey, p_name AS h FROM part WHERE p_size > 10) a FULL JOIN (SELECT p_partkey, CASE WHEN p_size > 40 THEN p_type ELSE p_name END AS h FROM part WHERE p_size < 45) b USING (p_partkey)""",
    ctes=False,
)
def merkle_diff(e: Estate) -> DataFrame:
    p = e.table("part")
    old = p.filter("p_size > 10").select("p_partkey", S.content_hash(F.col("p_name")).alias("h"))
    new = p.filter("p_size < 45").select("p_partkey", S.content_hash(F.when(F.col("p_size") > 40, F.col("p_type")).otherwise(F.col("p_name"))).alias("h"))
    return G.hash_diff(old, new, "p_partkey", "h")


_PATH = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/+$', ''), '/[0-9]+$', '/{param}')"


@query("l5_endpoint_groups", rf"SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, {_PATH} AS path, count(*) AS endpoints, min(page_id) AS survivor FROM pages GROUP BY 1, 2", ctes=False)
def endpoint_groups(e: Estate) -> DataFrame:
    """Emergent endpoints with one canonical path; the smallest id survives."""
    p = e.table("pages").select("page_id", S.host_of(F.col("url")).alias("host"), S.normal_path(S.path_of(F.col("url"))).alias("path"))
    return p.groupBy("host", "path").agg(n().alias("endpoints"), F.min("page_id").alias("survivor"))


@query("a4_spans", "SELECT user_id AS service, event_type AS operation, count(*) AS spans, round(max(value), 6) AS slowest, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1, 2", ctes=False)
def spans(e: Estate) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return e.table("events").groupBy(F.col("user_id").alias("service"), F.col("event_type").alias("operation")).agg(n().alias("spans"), F.round(F.max("value"), 6).alias("slowest"), F.sum(k).alias("k"))


@query("i15_liveness", "SELECT c_custkey, CASE WHEN k IS NULL THEN 'unknown' WHEN k >= 30 THEN 'active' WHEN k >= 5 THEN 'steady' ELSE 'slow' END AS liveness FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey", ctes=False)
def liveness(e: Estate) -> DataFrame:
    k = e.table("orders").groupBy("o_custkey").agg(n().alias("k"))
    return e.table("customer").join(k, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", S.liveness(F.col("k")).alias("liveness"))


@query(
    "k1_top_k",
    """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score
    FROM embeddings WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 5""",
    ctes=False,
)
def top_k(e: Estate) -> DataFrame:
    """The five nearest vectors to one; the query side is a single row."""
    v = e.table("embeddings")
    q = F.broadcast(v.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))
    return v.filter("vec_id <> 0").join(q, F.lit(True)).select("vec_id", F.round(G.cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(5)


@query(
    "j5_subgraph",
    """+ p AS (SELECT DISTINCT service AS a, resource AS b FROM access), u AS (SELECT a AS src, b AS dst FROM p UNION SELECT b, a FROM p),
    h0 AS (SELECT 'cr:service:s1' AS id), h1 AS (SELECT DISTINCT dst AS id FROM u WHERE src IN (SELECT id FROM h0)),
    h2 AS (SELECT DISTINCT dst AS id FROM u WHERE src IN (SELECT id FROM h1))
    SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id""",
)
def subgraph(e: Estate, start: int = 2) -> DataFrame:
    """Two hops around one service. A resource's number is made negative, so services and resources are one set of nodes."""
    p = e.pairs().select(F.col("s").alias("src"), (-1 - F.col("x")).alias("dst"))
    both = p.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")
    out = G.reachable(both, e.spark.createDataFrame([(start,)], "id long"), 2)
    return out.select(F.when(F.col("id") >= 0, estate.service_urn(F.col("id"))).otherwise(estate.resource_urn(-1 - F.col("id"))).alias("id"), "hop")


@query("f1_first_hit", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) = 1", ctes=False)
def first_hit(e: Estate) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")
    return e.table("lineitem").withColumn("r", F.row_number().over(w)).filter("r = 1").select("l_orderkey", "l_partkey", "l_suppkey")


@query("c17_redaction", r"SELECT doc_id, left(regexp_replace(text, '(?i)(token|secret|password|api_key)(\s*=\s*)\S+', '\1\2[REDACTED:key]', 'g'), 4096) AS text FROM documents WHERE regexp_matches(text, '(?i)(token|secret|password|api_key)\s*=\s*\S')", ctes=False)
def redaction(e: Estate) -> DataFrame:
    d = e.table("documents").filter(F.col("text").rlike(r"(?i)(token|secret|password|api_key)\s*=\s*\S"))
    return d.select("doc_id", S.redacted(F.col("text")).alias("text"))


from . import basics, changes, filesets, fixpoints, governance, identities, impact, reports, schemas, supply, topology, welds  # noqa: E402, F401  they register their queries
