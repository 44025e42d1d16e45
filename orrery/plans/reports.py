"""Registered queries: reports, lookups by tiers, vectors, traces, conventions, schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import scalars as S
from ..operators import catalogue as R
from ..operators import pairs as P
from ..operators import weld as W
from .catalog import n, query
from .estate import Estate


@query(
    "e12_drift_classes",
    """WITH d AS (SELECT p_partkey % 40 AS service, p_partkey AS ref, CASE WHEN p_size % 9 = 0 AND p_partkey % 2 = 0 THEN NULL ELSE p_size END AS urn FROM part), o AS (SELECT DISTINCT l_suppkey % 40 AS service, l_partkey % 50 + 1 AS urn FROM lineitem WHERE l_quantity > 45),
    u AS (SELECT service FROM d WHERE urn IS NULL GROUP BY 1), x AS (SELECT service, count(*) AS extra FROM o WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.service = o.service AND d.urn = o.urn) GROUP BY service),
    c AS (SELECT service, count(*) FILTER (urn IS NOT NULL AND EXISTS (SELECT 1 FROM o WHERE o.service = d.service AND o.urn = d.urn)) AS aligned, count(*) FILTER (urn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.service = d.service AND o.urn = d.urn)) AS missing, count(*) FILTER (urn IS NULL) AS lost FROM d GROUP BY service)
    SELECT coalesce(c.service, x.service) AS service, coalesce(aligned, 0) AS aligned, coalesce(missing, 0) AS missing, CASE WHEN coalesce(lost, 0) > 0 THEN 0 ELSE coalesce(extra, 0) END AS undeclared, CASE WHEN coalesce(lost, 0) > 0 THEN lost + coalesce(extra, 0) ELSE 0 END AS unverifiable FROM c FULL JOIN x ON c.service = x.service""",
    ctes=False,
)
def drift_classes(e: Estate) -> DataFrame:
    """Declared against observed dependencies, where what cannot be resolved makes the rest unverifiable."""
    d = e.table("part").selectExpr("p_partkey % 40 AS service", "p_partkey AS ref", "cast(if(p_size % 9 = 0 AND p_partkey % 2 = 0, null, p_size) AS bigint) AS urn")
    o = e.table("lineitem").filter("l_quantity > 45").selectExpr("l_suppkey % 40 AS service", "l_partkey % 50 + 1 AS urn").distinct()
    return R.drift_classes(d, o)


@query(
    "e14_drift_report",
    "WITH s AS (SELECT s_nationkey AS system, count(*) AS entities, count(*) FILTER (s_acctbal < 0) AS drifted, count(*) FILTER (s_suppkey % 4 = 0) AS unchecked FROM supplier GROUP BY 1) SELECT n_nationkey AS system, coalesce(entities, 0) AS entities, CAST(CASE WHEN coalesce(entities, 0) = 0 THEN 100 ELSE floor((1 - drifted / entities) * 100 + 0.5) END AS BIGINT) AS score, CAST(CASE WHEN coalesce(entities, 0) = 0 THEN 100 ELSE floor((1 - unchecked / entities) * 100 + 0.5) END AS BIGINT) AS coverage FROM nation LEFT JOIN s ON n_nationkey = system",
    ctes=False,
)
def drift_report(e: Estate) -> DataFrame:
    """Alignment and coverage of each system; a system of nothing is aligned."""
    s = e.table("supplier").groupBy(F.col("s_nationkey").alias("system")).agg(n().alias("entities"), F.count_if(F.col("s_acctbal") < 0).alias("drifted"), F.count_if(F.col("s_suppkey") % 4 == 0).alias("unchecked"))
    out = e.table("nation").select(F.col("n_nationkey").alias("system")).join(s, "system", "left").fillna(0)
    return out.select("system", "entities", R.score(F.col("drifted"), F.col("entities")).alias("score"), R.score(F.col("unchecked"), F.col("entities")).alias("coverage"))


@query(
    "e13_owner_reconciliation",
    "WITH f AS (SELECT s_suppkey AS service, 'T' || s_nationkey % 6 AS a, 'T' || s_suppkey % 6 AS b FROM supplier), al AS (SELECT DISTINCT 'T' || p_size % 6 AS x, 'T' || p_partkey % 6 AS y FROM part WHERE p_size % 5 = 0) SELECT service, a, b, EXISTS (SELECT 1 FROM al WHERE (x = a AND y = b) OR (x = b AND y = a)) AS reconciled FROM f WHERE a <> b",
    ctes=False,
)
def owner_reconciliation(e: Estate) -> DataFrame:
    """Two owners of a service that differ, and whether an approved alias, either way, makes them one."""
    f = e.table("supplier").selectExpr("s_suppkey AS service", "concat('T', s_nationkey % 6) AS a", "concat('T', s_suppkey % 6) AS b").filter("a <> b")
    al = e.table("part").filter("p_size % 5 = 0").selectExpr("explode(array(struct(concat('T', p_size % 6) AS a, concat('T', p_partkey % 6) AS b), struct(concat('T', p_partkey % 6) AS a, concat('T', p_size % 6) AS b))) AS p").select("p.*").distinct()
    return f.join(al.withColumn("yes", F.lit(True)), ["a", "b"], "left").select("service", "a", "b", F.coalesce("yes", F.lit(False)).alias("reconciled"))


@query("e16_service_inventory", "+ o AS (SELECT service, count(*) AS functions FROM fn GROUP BY 1) SELECT team, count(*) AS services, count(DISTINCT repo) AS repos, CAST(sum(coalesce(functions, 0)) AS BIGINT) AS functions, count(*) FILTER (functions IS NULL) AS idle FROM service LEFT JOIN o ON id = service GROUP BY team")
def service_inventory(e: Estate) -> DataFrame:
    f = e.functions().groupBy("service").agg(n().alias("functions"))
    s = e.services().join(f, F.col("id") == F.col("service"), "left")
    return s.groupBy("team").agg(n().alias("services"), F.count_distinct("repo").alias("repos"), F.sum(F.coalesce("functions", F.lit(0))).alias("functions"), F.count_if(F.col("functions").isNull()).alias("idle"))


@query(
    "e17_api_catalog",
    "WITH x AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS repo, page_id % 3 AS version, url FROM pages) SELECT repo, version, min(page_id) AS first, count(*) AS specs, count(DISTINCT regexp_replace(url, '[?#].*$', '')) AS endpoints, string_agg(DISTINCT CAST(page_id % 4 AS VARCHAR), ', ' ORDER BY CAST(page_id % 4 AS VARCHAR)) AS exposers FROM x GROUP BY repo, version",
    ctes=False,
)
def api_catalog(e: Estate) -> DataFrame:
    """Specifications of one repository and version as one interface: its first id, endpoints and exposers."""
    x = e.table("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("repo"), (F.col("page_id") % 3).alias("version"), F.regexp_replace("url", "[?#].*$", "").alias("path"), (F.col("page_id") % 4).cast("string").alias("exposer"))
    return x.groupBy("repo", "version").agg(F.min("page_id").alias("first"), n().alias("specs"), F.count_distinct("path").alias("endpoints"), F.array_join(F.array_sort(F.collect_set("exposer")), ", ").alias("exposers"))


@query("e32_topology_coverage", "SELECT (SELECT count(*) FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)) AS scanned, (SELECT count(*) FROM nation) AS known", ctes=False)
def topology_coverage(e: Estate) -> DataFrame:
    s = e.table("supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("yes", F.lit(1))
    return e.table("nation").select("n_nationkey").join(s, "n_nationkey", "left").agg(F.count("yes").alias("scanned"), n().alias("known"))


@query(
    "c3_resource_context",
    "WITH x AS (SELECT DISTINCT l_partkey AS id, l_suppkey % 7 AS s, l_linenumber AS k FROM lineitem WHERE l_returnflag = 'R') SELECT p_partkey AS id, string_agg(DISTINCT 'svc' || s, ', ' ORDER BY 'svc' || s) AS exposers, string_agg(DISTINCT 'api' || k, ', ' ORDER BY 'api' || k) AS titles FROM part LEFT JOIN x ON p_partkey = id GROUP BY p_partkey",
    ctes=False,
)
def resource_context(e: Estate) -> DataFrame:
    li = e.table("lineitem").filter("l_returnflag = 'R'")
    part = lambda v: li.selectExpr("l_partkey AS id", f"{v} AS value")
    return R.contexts(e.table("part").select(F.col("p_partkey").alias("id")), "id", exposers=part("concat('svc', l_suppkey % 7)"), titles=part("concat('api', l_linenumber)"))


@query(
    "c4_field_resolve",
    "WITH f AS (SELECT p_partkey AS id, 'cr:field:' || p_brand || ':' || p_type AS urn, p_type AS name FROM part), t AS (SELECT id, CASE WHEN urn = 'STANDARD' THEN 1 WHEN lower(name) = 'standard' THEN 2 WHEN contains(lower(urn), 'standard') THEN 3 END AS tier FROM f) SELECT id, tier FROM t WHERE tier = (SELECT min(tier) FROM t)",
    ctes=False,
)
def field_resolve(e: Estate, asked: str = "STANDARD") -> DataFrame:
    f = e.table("part").selectExpr("p_partkey AS id", "concat('cr:field:', p_brand, ':', p_type) AS urn", "p_type AS name")
    low = asked.lower()
    return R.tiers(f, F.lit(asked), F.col("urn") == asked, F.lower("name") == low, F.contains(F.lower("urn"), F.lit(low))).select("id", "tier")


@query(
    "c5_service_context",
    "WITH s AS (SELECT s_suppkey AS id, lower(s_name) AS name, CASE WHEN s_suppkey % 2 = 0 THEN '/srv' ELSE '/srv/n' || s_nationkey END AS path FROM supplier), x AS (SELECT c_custkey AS k, '/srv/n' || c_nationkey || '/src' AS asked FROM customer) SELECT k, id, length(path) AS depth FROM x JOIN s ON starts_with(asked, path || '/') QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(path) DESC, id) <= 5",
    ctes=False,
)
def service_context(e: Estate) -> DataFrame:
    """The five services whose roots cover a path, deepest first: the path's prefixes meet roots by equality."""
    s = e.table("supplier").selectExpr("s_suppkey AS id", "if(s_suppkey % 2 = 0, '/srv', concat('/srv/n', s_nationkey)) AS path")
    x = e.table("customer").selectExpr("c_custkey AS k", "concat('/srv/n', c_nationkey, '/src') AS asked")
    return R.roots(x, s, 5).select("k", "id", "depth")


@query("c7_path_choice", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN p_brand ELSE '' END AS path FROM part", ctes=False)
def path_choice(e: Estate) -> DataFrame:
    """The first path that is not empty, else the first."""
    empty = F.lit("")
    paths = F.when(F.col("p_size") % 3 == 0, F.array(empty, F.col("p_type"), F.col("p_brand"))).when(F.col("p_size") % 3 == 1, F.array(F.col("p_brand"), F.col("p_type"))).otherwise(F.array(empty, empty))
    return e.table("part").select(F.col("p_partkey").alias("id"), F.coalesce(F.get(F.filter(paths, lambda p: p != ""), F.lit(0)), F.get(paths, F.lit(0))).alias("path"))


@query("c8_page", "SELECT s_name AS name, s_suppkey AS id FROM supplier ORDER BY s_name, s_suppkey LIMIT 5 OFFSET 3", ctes=False)
def page(e: Estate, skip: int = 3, size: int = 5) -> DataFrame:
    """One page of services by name, ties by id. The page is the feature; Spark keeps skip + size rows of each partition."""
    return e.table("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")).orderBy("name", "id").offset(skip).limit(size)


@query("c11_io_gate", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'tainted' WHEN p_type = 'STANDARD' THEN 'sink' WHEN p_brand LIKE '%3' THEN 'decorator' WHEN p_partkey % 5 = 0 THEN 'convention' ELSE 'none' END AS gate FROM part", ctes=False)
def io_gate(e: Estate) -> DataFrame:
    """The first of ordered tests that says a function does input or output."""
    gates = ((F.col("p_size") % 2 == 0, "tainted"), (F.col("p_type") == "STANDARD", "sink"), (F.col("p_brand").endswith("3"), "decorator"), (F.col("p_partkey") % 5 == 0, "convention"))
    return e.table("part").select(F.col("p_partkey").alias("id"), F.coalesce(*[F.when(t, g) for t, g in gates], F.lit("none")).alias("gate"))


@query("c12_verb_conventions", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'repository' WHEN 1 THEN 'publisher' WHEN 2 THEN 'runner' END AS kind FROM part", ctes=False)
def verb_conventions(e: Estate) -> DataFrame:
    """What a method's class suffix and verb say of it."""
    name = I.looked_up(F.col("p_partkey") % 5, {0: "UserRepository.findById", 1: "OrderPublisher.publish", 2: "ImportCommand.execute", 3: "UserRepository.helper"}, F.lit("Math.add"))
    d = e.table("part").select(F.col("p_partkey").alias("id"), name.alias("m"))
    kind = F.when(F.col("m").rlike(r"(Repository|Dao|Store)\.(find|get|save|delete|insert|update|fetch|load|persist)\w*$"), "repository").when(F.col("m").rlike(r"(Publisher|Producer|Dispatcher|Emitter)\.(publish|send|dispatch|emit|produce)\w*$"), "publisher").when(F.col("m").rlike(r"(Command|Runner|Job|Worker)\.(execute|run|handle|process)\w*$"), "runner")
    return d.select("id", kind.alias("kind"))


_TRACE = "t AS (SELECT conv_id, turn, ['sanitizer', 'llm', 'persist', 'parse'][conv_id % 4 + 1] AS stage, ['SEND', 'DROP', 'KEEP', 'FAIL', 'REJECT'][(conv_id + turn) % 5 + 1] AS action, text FROM conversations)"


def _trace(e: Estate) -> DataFrame:
    pick = lambda k, names: f"element_at(array({', '.join(map(repr, names))}), cast({k} % {len(names)} + 1 AS int))"
    return e.table("conversations").selectExpr("conv_id", "turn", pick("conv_id", ["sanitizer", "llm", "persist", "parse"]) + " AS stage", pick("(conv_id + turn)", ["SEND", "DROP", "KEEP", "FAIL", "REJECT"]) + " AS action", "text")


@query(
    "c13_trace_filters",
    f"WITH {_TRACE} SELECT stage, count(*) FILTER (action IN ('DROP', 'REJECT', 'FAIL')) AS dropped, count(*) FILTER (stage IN ('sanitizer', 'llm', 'persist') AND action IN ('DROP', 'FAIL')) AS surprises, count(*) FILTER (text ILIKE '%the%') AS named, count(DISTINCT conv_id) FILTER (action = 'SEND') AS prompts FROM t GROUP BY stage",
    ctes=False,
)
def trace_filters(e: Estate) -> DataFrame:
    """Dropped, surprising, naming and prompting events of each stage of a trace."""
    act = F.col("action")
    return _trace(e).groupBy("stage").agg(F.count_if(act.isin("DROP", "REJECT", "FAIL")).alias("dropped"), F.count_if(F.col("stage").isin("sanitizer", "llm", "persist") & act.isin("DROP", "FAIL")).alias("surprises"), F.count_if(F.contains(F.lower("text"), F.lit("the"))).alias("named"), F.count_distinct(F.when(act == "SEND", F.col("conv_id"))).alias("prompts"))


@query("c14_baseline_gate", "SELECT n_nationkey AS change, CASE WHEN known = 0 THEN 'stop' WHEN known < files THEN 'fallback' ELSE 'go' END AS gate FROM (SELECT n_nationkey, count(s_suppkey) AS files, count(*) FILTER (s_suppkey % 3 = 0) AS known FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1)", ctes=False)
def baseline_gate(e: Estate) -> DataFrame:
    """A change of no known files stops; one of some known files looks at history."""
    s = e.table("supplier").groupBy(F.col("s_nationkey").alias("change")).agg(n().alias("files"), F.count_if(F.col("s_suppkey") % 3 == 0).alias("known"))
    out = e.table("nation").select(F.col("n_nationkey").alias("change")).join(s, "change", "left").fillna(0)
    return out.select("change", F.when(F.col("known") == 0, "stop").when(F.col("known") < F.col("files"), "fallback").otherwise("go").alias("gate"))


@query("d17_url_join", "WITH d AS (SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) AS host, page_id % 20 AS api FROM pages WHERE page_id % 2 = 0), m AS (SELECT page_id, api FROM pages JOIN d ON split_part(split_part(url, '://', 2), '/', 1) = host WHERE page_id % 2 = 1) SELECT page_id, count(DISTINCT api) AS apis, CASE WHEN count(DISTINCT api) = 1 THEN min(api) END AS api FROM m GROUP BY page_id", ctes=False)
def url_join(e: Estate) -> DataFrame:
    """Calls and the deployments of their host; one deployment is a match."""
    host = F.substring_index(F.get(F.split("url", "://"), F.lit(1)), "/", 1)
    p = e.table("pages").select("page_id", host.alias("host"))
    d = p.filter("page_id % 2 = 0").select("host", (F.col("page_id") % 20).alias("api")).groupBy("host").agg(F.count_distinct("api").alias("apis"), F.min("api").alias("api"))
    return p.filter("page_id % 2 = 1").join(d, "host").select("page_id", "apis", F.when(F.col("apis") == 1, F.col("api")).alias("api"))


@query("d18_implements_rewire", "WITH c AS (SELECT p_partkey AS id, p_brand AS s, lower(p_type) AS m, p_size % 3 AS path FROM part WHERE p_partkey % 2 = 0), o AS (SELECT p_brand AS s, p_type AS m, p_size % 3 AS path, min(p_partkey) AS spec FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2, 3) SELECT id, spec FROM c JOIN o ON c.s = o.s AND c.path = o.path AND c.m = lower(o.m)", ctes=False)
def implements_rewire(e: Estate) -> DataFrame:
    """Implementations in code moved to the specified endpoint of the same service, path and method in any case."""
    p = e.table("part").selectExpr("p_partkey AS id", "p_brand AS s", "lower(p_type) AS m", "p_size % 3 AS path")
    return p.filter("id % 2 = 0").join(p.filter("id % 2 = 1").groupBy("s", "m", "path").agg(F.min("id").alias("spec")), ["s", "m", "path"]).select("id", "spec")


@query(
    "d19_shared_packages",
    "WITH u AS (SELECT DISTINCT l_suppkey AS repo, p_brand AS pkg FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48), k AS (SELECT a.repo AS a, b.repo AS b, count(*) AS shared FROM u a JOIN u b ON a.pkg = b.pkg AND a.repo < b.repo GROUP BY 1, 2 HAVING count(*) >= 5), t AS (SELECT k.*, x.s_nationkey AS team FROM k JOIN supplier x ON a = x.s_suppkey JOIN supplier y ON b = y.s_suppkey WHERE x.s_nationkey <> y.s_nationkey) SELECT a, b, shared FROM t ORDER BY shared DESC, a, b LIMIT 10",
    ctes=False,
)
def shared_packages(e: Estate) -> DataFrame:
    """The ten pairs of repositories of different teams that share most packages, five at least, by an index of packages."""
    p = e.table("part").select("p_partkey", F.col("p_brand").alias("pkg"))
    u = e.table("lineitem").filter("l_quantity > 48").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("repo"), "pkg").distinct()
    s = e.table("supplier").select(F.col("s_suppkey").alias("repo"), F.col("s_nationkey").alias("team"))
    sets = u.join(s, "repo").groupBy(F.col("repo").alias("id"), "team").agg(F.sort_array(F.collect_set("pkg")).alias("v"))
    return P.most_shared(sets, 10, 5)


@query("d21_channel_convergence", "WITH c AS (SELECT p_partkey AS id, p_type AS name, p_brand AS provider FROM part), b AS (SELECT DISTINCT p_type AS name, p_brand AS provider, p_size % 6 AS broker FROM part WHERE p_size % 5 = 0) SELECT id, min(broker) AS broker FROM c JOIN b USING (name, provider) GROUP BY id HAVING count(DISTINCT broker) = 1", ctes=False)
def channel_convergence(e: Estate) -> DataFrame:
    """Channels and the only declared broker of one name and provider."""
    b = e.table("part").filter("p_size % 5 = 0").selectExpr("p_type AS name", "p_brand AS provider", "p_size % 6 AS broker").groupBy("name", "provider").agg(F.min("broker").alias("broker"), F.max("broker").alias("last")).filter("broker = last").drop("last")
    return e.table("part").selectExpr("p_partkey AS id", "p_type AS name", "p_brand AS provider").join(b, ["name", "provider"]).select("id", "broker")


@query("d23_column_parents", "WITH h AS (SELECT p_brand AS structure, min(p_partkey) AS container FROM part WHERE p_size > 10 GROUP BY 1) SELECT p_partkey AS field, container FROM part JOIN h ON p_brand = structure", ctes=False)
def column_parents(e: Estate) -> DataFrame:
    h = e.table("part").filter("p_size > 10").groupBy("p_brand").agg(F.min("p_partkey").alias("container"))
    return e.table("part").select(F.col("p_partkey").alias("field"), "p_brand").join(h, "p_brand").select("field", "container")


@query("h1_inbound_union", "SELECT l_suppkey AS service, l_partkey AS other FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'", ctes=False)
def inbound_union(e: Estate) -> DataFrame:
    """Inbound calls and shared resources as one set: one scan and one distinct."""
    return e.table("lineitem").filter("l_returnflag IN ('A', 'N')").select(F.col("l_suppkey").alias("service"), F.col("l_partkey").alias("other")).distinct()


def _vectors(e: Estate) -> DataFrame:
    return e.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("label") % 3).alias("block"))


_VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label % 3 AS block FROM embeddings)"


@query("k2_endpoint_matches", f"WITH {_VEC}, p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b USING (block) WHERE a.id % 50 = 0 AND b.id % 2 = 1) SELECT * FROM p WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5", ctes=False)
def endpoint_matches(e: Estate) -> DataFrame:
    """The five nearest endpoints of each query that are similar enough."""
    v = _vectors(e)
    return P.nearest(v.filter("id % 50 = 0"), v.filter("id % 2 = 1"), "block", 5, 0.2)


@query(
    "k3_semantic_duplicates",
    f"WITH {_VEC}, p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b USING (block)), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 10) SELECT * FROM t WHERE score >= 0.3 AND a < b ORDER BY score DESC, a, b LIMIT 50",
    ctes=False,
)
def semantic_duplicates(e: Estate) -> DataFrame:
    """Pairs whose second is among the ten nearest of the first, itself counted, within a type; the fifty most similar."""
    v = _vectors(e)
    return P.nearest(v, v, "block", 10, 0.3).filter("a < b").orderBy(F.desc("score"), "a", "b").limit(50)


@query("k5_span_links", f"WITH {_VEC}, p AS (SELECT a.id AS span, b.id AS fn, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b USING (block) WHERE a.id % 10 = 0 AND b.id % 10 = 1) SELECT span, fn, score FROM p WHERE score > 0.1 QUALIFY row_number() OVER (PARTITION BY span ORDER BY score DESC, fn) = 1", ctes=False)
def span_links(e: Estate) -> DataFrame:
    """The best function of each span, if it is similar enough."""
    v = _vectors(e)
    return P.nearest(v.filter("id % 10 = 0"), v.filter("id % 10 = 1"), "block", 1, 0.100001).select(F.col("a").alias("span"), F.col("b").alias("fn"), "score")


@query("k6_exact_matches", "WITH f AS (SELECT p_partkey AS id, p_brand AS s, CASE p_partkey % 3 WHEN 0 THEN 'get' || p_size WHEN 1 THEN 'op' || p_size ELSE 'x' END AS k FROM part), ep AS (SELECT p_brand AS s, p_partkey AS e, unnest(['get' || p_size, 'op' || p_size]) AS k FROM part WHERE p_partkey % 2 = 0) SELECT f.id, min(e) AS endpoint FROM f JOIN ep USING (s, k) GROUP BY f.id", ctes=False)
def exact_matches(e: Estate) -> DataFrame:
    """Functions and the first endpoint of their service whose squashed method and path, or operation id, is their name."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("GET /"), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("op_"), F.col("p_size").cast("string"))).otherwise("x")
    f = e.table("part").select(F.col("p_partkey").alias("id"), "p_brand", I.squashed(name).alias("k"))
    ep = e.table("part").filter("p_partkey % 2 = 0").select("p_brand", F.col("p_partkey").alias("e"), F.explode(F.array(F.concat(F.lit("get"), F.col("p_size").cast("string")), F.concat(F.lit("op"), F.col("p_size").cast("string")))).alias("k"))
    return f.join(ep.groupBy("p_brand", "k").agg(F.min("e").alias("endpoint")), ["p_brand", "k"]).select("id", "endpoint")


@query("k7_match_candidates", f"WITH {_VEC}, m AS (SELECT DISTINCT id FROM v WHERE id % 7 = 0), p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b USING (block) WHERE a.id % 20 = 0 AND b.id % 3 = 1 AND a.id NOT IN (SELECT id FROM m)) SELECT a, count(*) AS candidates, max(score) AS best FROM (SELECT * FROM p WHERE score >= 0.15 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5) GROUP BY a", ctes=False)
def match_candidates(e: Estate) -> DataFrame:
    """Up to five candidates for what exact matching left, for a reviewer."""
    v = _vectors(e)
    left = v.filter("id % 20 = 0").join(v.filter("id % 7 = 0").select("id"), "id", "left_anti")
    return P.nearest(left, v.filter("id % 3 = 1"), "block", 5, 0.15).groupBy("a").agg(n().alias("candidates"), F.max("score").alias("best"))


@query("k8_input_hashes", "WITH h AS (SELECT p_brand AS service, left(sha256(string_agg(p_partkey || ':' || p_size, ',' ORDER BY p_partkey)), 16) AS hash FROM part GROUP BY 1), o AS (SELECT p_brand AS service, left(sha256(string_agg(p_partkey || ':' || CASE WHEN p_brand = 'Brand#13' THEN 0 ELSE p_size END, ',' ORDER BY p_partkey)), 16) AS hash FROM part GROUP BY 1) SELECT h.service, h.hash = o.hash AS skip FROM h JOIN o USING (service)", ctes=False)
def input_hashes(e: Estate) -> DataFrame:
    """Services whose inputs are those of the last run, by a hash over them in order."""
    text = lambda z: S.content_hash(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", z.alias("z")))), lambda r: F.concat(r["p_partkey"].cast("string"), F.lit(":"), r["z"].cast("string"))), ","))
    h = e.table("part").groupBy("p_brand").agg(text(F.col("p_size")).alias("now"), text(F.when(F.col("p_brand") == "Brand#13", 0).otherwise(F.col("p_size"))).alias("then"))
    return h.select(F.col("p_brand").alias("service"), (F.col("now") == F.col("then")).alias("skip"))


@query("k9_index_check", "SELECT label, count(*) AS vectors, count(*) FILTER (len(embedding) <> 64) AS stale FROM embeddings GROUP BY label", ctes=False)
def index_check(e: Estate, dimension: int = 64) -> DataFrame:
    """Vectors of each label and those whose dimension is not the index's."""
    return e.table("embeddings").groupBy("label").agg(n().alias("vectors"), F.count_if(F.size("embedding") != dimension).alias("stale"))


@query("f5_canonical", "SELECT p_brand AS content, arg_min(p_partkey, (p_size % 2 = 1, p_partkey)) AS canonical, count(*) AS copies FROM part GROUP BY p_brand", ctes=False)
def canonical(e: Estate) -> DataFrame:
    """Of copies the first that is no link, by id."""
    return e.table("part").groupBy(F.col("p_brand").alias("content")).agg(F.min_by("p_partkey", F.struct(F.col("p_size") % 2 == 1, "p_partkey")).alias("canonical"), n().alias("copies"))


@query(
    "f8_contract_ladder",
    "WITH s AS (SELECT p_partkey AS id, p_type AS name, p_brand AS scope FROM part WHERE p_size % 2 = 0), a AS (SELECT c_custkey AS k, ['STANDARD', 'PROMO', 'SMALL'][c_custkey % 3 + 1] AS name, 'Brand#' || (c_nationkey + 1) AS scope FROM customer), x AS (SELECT k, max(id) AS t FROM a JOIN s USING (name, scope) GROUP BY k), y AS (SELECT k, max(id) AS t FROM a JOIN s USING (name) GROUP BY k) SELECT y.k, coalesce(x.t, y.t) AS target, CASE WHEN x.t IS NOT NULL THEN 1 ELSE 2 END AS tier FROM y LEFT JOIN x USING (k)",
    ctes=False,
)
def contract_ladder(e: Estate) -> DataFrame:
    """The contract of a name and scope, else the latest of that name."""
    s = e.table("part").filter("p_size % 2 = 0").selectExpr("p_partkey AS id", "p_type AS name", "p_brand AS scope")
    a = e.table("customer").selectExpr("c_custkey AS k", "element_at(array('STANDARD', 'PROMO', 'SMALL'), cast(c_custkey % 3 + 1 AS int)) AS name", "concat('Brand#', c_nationkey + 1) AS scope")
    one = a.join(s.groupBy("name", "scope").agg(F.max("id").alias("target")), ["name", "scope"]).select("k", "target")
    two = a.join(s.groupBy("name").agg(F.max("id").alias("target")), "name").select("k", "target")
    return W.first_tier(a, "k", one, two)


@query("g_report_order", "SELECT p_brand AS package, count(*) AS consumers, count(DISTINCT p_size) AS versions, row_number() OVER (ORDER BY count(DISTINCT p_size) > 30 DESC, count(*) DESC, p_brand) AS place FROM part GROUP BY p_brand", ctes=False)
def report_order(e: Estate) -> DataFrame:
    """A report's order by several keys, ended by a unique one. Packages are few, so one partition ranks them."""
    g = e.table("part").groupBy(F.col("p_brand").alias("package")).agg(n().alias("consumers"), F.count_distinct("p_size").alias("versions"))
    return g.withColumn("place", F.row_number().over(Window.orderBy((F.col("versions") > 30).desc(), F.desc("consumers"), "package")))


@query("i1_urn_parts", "SELECT s_suppkey AS k, 'service' AS kind, 's' || s_suppkey AS name, 'cr:service' AS prefix, 'org/' || s_nationkey AS repo FROM supplier", ctes=False)
def urn_parts(e: Estate) -> DataFrame:
    """A URN built, taken apart and shortened."""
    from .estate import urn

    d = e.table("supplier").select(F.col("s_suppkey").alias("k"), urn("service", F.concat(F.lit("org/"), F.col("s_nationkey").cast("string")), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("u"))
    part = lambda i: F.get(F.split("u", ":"), F.lit(i))
    return d.select("k", part(1).alias("kind"), part(3).alias("name"), F.substring_index("u", ":", 2).alias("prefix"), part(2).alias("repo"))


@query("i17_fuzzy_matches", "SELECT p_partkey AS id FROM part WHERE regexp_matches(lower(p_name), 'a.*e')", ctes=False)
def fuzzy_matches(e: Estate) -> DataFrame:
    return e.table("part").filter(R.fuzzy(F.col("p_name"), "ae")).select(F.col("p_partkey").alias("id"))


@query("i22_ordered_union", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'b,a' WHEN p_size % 3 = 1 THEN 'b,a,c' ELSE 'b,a,d' END AS names FROM part", ctes=False)
def ordered_union(e: Estate) -> DataFrame:
    more = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("a"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("c"), F.lit("b"))).otherwise(F.array(F.lit("d")))
    return e.table("part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_distinct(F.concat(F.array(F.lit("b"), F.lit("a"), F.lit("b")), more)), ",").alias("names"))
