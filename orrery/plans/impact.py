"""Further registered queries: resolution by paths, ownership, change findings, two-hop blasts, conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import estate
from .catalog import n, query
from .estate import Estate

PATHS = r"""p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host,
  regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/+$', '') AS path FROM pages)"""


def _paths(e: Estate) -> DataFrame:
    path = S.path_of(F.col("url"))
    return e.table("pages").select("page_id", S.host_of(F.col("url")).alias("host"), F.when(path == "/", "").otherwise(path).alias("path"))


@query("l17_host_labels", f"WITH {PATHS} SELECT split_part(host, '.', 1) AS label, count(DISTINCT host) AS hosts, count(*) AS n FROM p GROUP BY 1", ctes=False)
def host_labels(e: Estate) -> DataFrame:
    """Calls by the leftmost label of their host, the name by which a service would be found."""
    return _paths(e).groupBy(F.substring_index("host", ".", 1).alias("label")).agg(F.countDistinct("host").alias("hosts"), n().alias("n"))


@query(
    "l2_unique_suffix",
    f"""WITH {PATHS}, q AS (SELECT DISTINCT path FROM p WHERE path <> ''),
    s AS (SELECT path, list_aggregate(string_split(path, '/')[i:], 'string_agg', '/') AS suffix
          FROM (SELECT path, unnest(range(2, len(string_split(path, '/')) + 1)) AS i FROM q))
    SELECT suffix, min(path) AS path FROM s GROUP BY suffix HAVING count(DISTINCT path) = 1""",
    ctes=False,
)
def unique_suffix(e: Estate) -> DataFrame:
    """Suffixes of paths, cut at slashes, that belong to one path only. Each path gives as many rows as it has segments."""
    parts = F.split("path", "/")
    cut = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    s = _paths(e).filter("path <> ''").select("path").distinct().select("path", F.explode(cut).alias("suffix"))
    return s.groupBy("suffix").agg(F.min("path").alias("path"), F.max("path").alias("last")).filter("path = last").drop("last")


@query(
    "q16_longest_root",
    f"""WITH {PATHS}, r AS (SELECT DISTINCT host || regexp_replace(path, '/[^/]*$', '') AS root FROM p)
    SELECT page_id, (SELECT max(root) FROM r WHERE starts_with(host || path || '/', root || '/') AND length(root) =
      (SELECT max(length(root)) FROM r WHERE starts_with(host || path || '/', root || '/'))) AS root FROM p""",
    ctes=False,
)
def longest_root(e: Estate) -> DataFrame:
    """The longest root that covers each path: prefixes are exploded and met by equality, not by a comparison of all with all."""
    p = _paths(e).withColumn("full", F.concat("host", "path"))
    roots = p.select(F.concat("host", F.regexp_replace("path", "/[^/]*$", "")).alias("root")).distinct()
    parts = F.split("full", "/")
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    met = p.select("page_id", F.explode(cut).alias("root")).join(roots, "root")
    return met.groupBy("page_id").agg(F.max_by("root", F.length("root")).alias("root"))


@query(
    "e33_precision_recall",
    """+ w AS (SELECT DISTINCT service, resource FROM access WHERE rel = 'WRITES'), r AS (SELECT DISTINCT service, resource FROM access WHERE rel = 'READS'),
    b AS (SELECT coalesce(w.service, r.service) AS service, w.service IS NOT NULL AS want, r.service IS NOT NULL AS got FROM w FULL JOIN r ON w.service = r.service AND w.resource = r.resource),
    c AS (SELECT service, count(*) FILTER (want AND got) AS hits, count(*) FILTER (want) AS wanted, count(*) FILTER (got) AS given FROM b GROUP BY service)
    SELECT service, hits, CASE WHEN given = 0 THEN 1.0::DOUBLE ELSE hits / given END AS precision, CASE WHEN wanted = 0 THEN 1.0::DOUBLE ELSE hits / wanted END AS recall FROM c""",
)
def precision_recall(e: Estate) -> DataFrame:
    """Written resources as the wanted set, read ones as the given set; a share of nothing is 1. One aggregate instead of a full join."""
    b = e.access("READS", "WRITES").groupBy("service", "resource").agg(F.max((F.col("rel") == "WRITES").cast("int")).alias("want"), F.max((F.col("rel") == "READS").cast("int")).alias("got"))
    c = b.groupBy("service").agg(F.sum(F.col("want") * F.col("got")).alias("hits"), F.sum("want").alias("wanted"), F.sum("got").alias("given"))
    share = lambda d: F.when(F.col(d) == 0, F.lit(1.0)).otherwise(F.col("hits") / F.when(F.col(d) != 0, F.col(d)))
    return c.select("service", "hits", share("given").alias("precision"), share("wanted").alias("recall"))


@query(
    "j1_two_hop_blast",
    """+ w AS (SELECT DISTINCT service, resource FROM access WHERE rel IN ('WRITES', 'PUBLISHES_TO')),
    r AS (SELECT DISTINCT service, resource FROM access WHERE rel IN ('READS', 'LISTENS_TO', 'MAPS_TO')),
    h AS (SELECT DISTINCT w.service AS src, r.service AS dst FROM w JOIN r USING (resource) WHERE w.service <> r.service),
    one AS (SELECT dst FROM h WHERE src = 'cr:service:s1'),
    two AS (SELECT h.dst, min(h.src) AS via FROM h JOIN one ON h.src = one.dst WHERE h.dst <> 'cr:service:s1' GROUP BY h.dst)
    SELECT coalesce(one.dst, two.dst) AS service, CASE WHEN two.dst IS NULL THEN 1 ELSE 2 END AS tier, two.via FROM one FULL JOIN two ON one.dst = two.dst""",
)
def two_hop_blast(e: Estate, start: str = "cr:service:s1") -> DataFrame:
    """Consumers of a service's outputs, and of theirs. One that is reached both ways is in tier 2 with its smallest via."""
    w = e.access("WRITES", "PUBLISHES_TO").select(F.col("service").alias("src"), "resource").distinct()
    r = e.access("READS", "LISTENS_TO", "MAPS_TO").select(F.col("service").alias("dst"), "resource").distinct()
    # each hop starts from its few services, so the whole service graph is never made
    one = w.filter(F.col("src") == start).join(r, "resource").filter(F.col("dst") != start).select("dst").distinct()
    outputs = w.join(one.withColumnRenamed("dst", "src"), "src", "left_semi")
    two = outputs.join(r, "resource").filter((F.col("src") != F.col("dst")) & (F.col("dst") != start)).groupBy("dst").agg(F.min("src").alias("via"))
    both = one.withColumn("via", F.lit(None).cast("string")).unionByName(two).groupBy(F.col("dst").alias("service")).agg(F.max("via").alias("via"))
    return both.select("service", F.when(F.col("via").isNull(), 1).otherwise(2).alias("tier"), "via")


@query(
    "n4_removed_edges",
    """+ gone AS (SELECT rel, dst, count(*) AS removed FROM edge WHERE NOT live AND rel IN ('WRITES', 'PUBLISHES_TO') GROUP BY rel, dst),
    c AS (SELECT resource, count(DISTINCT service) AS affected FROM access WHERE rel IN ('READS', 'LISTENS_TO', 'MAPS_TO') GROUP BY resource)
    SELECT rel, dst AS resource, removed, coalesce(affected, 0) AS affected, CASE WHEN affected IS NULL THEN 'WARNING' ELSE 'DANGER' END AS severity,
      CASE WHEN affected IS NULL THEN 1 ELSE 2 * affected + 1 END AS score FROM gone LEFT JOIN c ON dst = resource""",
)
def removed_edges(e: Estate) -> DataFrame:
    """Producing edges that are gone: a danger where live consumers remain, a warning elsewhere."""
    gone = e.edges().filter(~F.col("live") & F.col("rel").isin("WRITES", "PUBLISHES_TO")).groupBy("rel", F.col("dst").alias("resource")).agg(n().alias("removed"))
    c = e.access("READS", "LISTENS_TO", "MAPS_TO").groupBy("resource").agg(F.countDistinct("service").alias("hit"))
    hit = F.col("hit").isNull()
    out = gone.join(c, "resource", "left")
    return out.select("rel", "resource", "removed", F.coalesce("hit", F.lit(0)).alias("affected"), F.when(hit, "WARNING").otherwise("DANGER").alias("severity"), F.when(hit, 1).otherwise(2 * F.col("hit") + 1).alias("score"))


@query(
    "a16_cache_split",
    """WITH c AS (SELECT user_id, max(ts) AS fetched FROM events GROUP BY user_id), now AS (SELECT max(ts) AS stamp FROM events)
    SELECT c_custkey AS key, fetched > stamp - INTERVAL 24 HOUR AND fetched IS NOT NULL AS hit FROM customer LEFT JOIN c ON c_custkey = user_id CROSS JOIN now""",
    ctes=False,
)
def cache_split(e: Estate, hours: int = 24) -> DataFrame:
    """Keys with an entry younger than a day are hits, all others misses. The newest entry stands for now."""
    events = e.table("events").select("user_id", "ts")
    c = events.groupBy("user_id").agg(F.max("ts").alias("fetched"))
    now = F.broadcast(events.agg(F.max("ts").alias("at")))  # one row
    joined = e.table("customer").select(F.col("c_custkey").alias("key")).join(c, F.col("key") == F.col("user_id"), "left").join(now)
    return joined.select("key", F.coalesce(F.col("fetched") > F.col("at") - F.make_dt_interval(hours=F.lit(hours)), F.lit(False)).alias("hit"))


@query(
    "f3_priority_dedupe",
    """+ k AS (SELECT resource, service, rel, CASE rel WHEN 'WRITES' THEN 0 WHEN 'PUBLISHES_TO' THEN 1 WHEN 'READS' THEN 2 WHEN 'LISTENS_TO' THEN 3 ELSE 4 END AS p FROM access)
    SELECT resource, service, rel FROM k QUALIFY row_number() OVER (PARTITION BY resource, service ORDER BY p) = 1""",
)
def priority_dedupe(e: Estate) -> DataFrame:
    """One relation for each resource and service, by priority; an aggregate, so most rows go before the exchange."""
    by = ("WRITES", "PUBLISHES_TO", "READS", "LISTENS_TO", "MAPS_TO")
    place = F.get(F.array(*[F.lit(by.index(r)) for r in estate.RELS]), F.col("rel").cast("int"))
    p = e.pairs(first=F.min(place))
    return p.select(estate.resource_urn(F.col("x")).alias("resource"), estate.service_urn(F.col("s")).alias("service"), F.get(F.array(*[F.lit(r) for r in by]), F.col("first")).alias("rel"))


@query(
    "i12_identity_drift",
    """SELECT a.n_name AS name, b.n_name AS other FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey
    WHERE levenshtein(lower(a.n_name), lower(b.n_name)) < 3 OR contains(lower(a.n_name), lower(b.n_name)) OR contains(lower(b.n_name), lower(a.n_name))""",
    ctes=False,
)
def identity_drift(e: Estate) -> DataFrame:
    """Owner names that differ little or contain each other. Owners are a dimension of fixed size, 25 rows."""
    a = e.table("nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("name"), F.lower("n_name").alias("x"))
    b = F.broadcast(a.toDF("j", "other", "y"))
    return a.join(b, (F.col("i") < F.col("j")) & ((F.levenshtein("x", "y") < 3) | F.contains("x", "y") | F.contains("y", "x"))).select("name", "other")
