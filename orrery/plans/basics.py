"""Registered queries on single operators that larger queries use too: scores, tiers, hashes, JSON, left joins over hops, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import gravity as V
from ..operators import graph as G
from ..operators import grounding as N
from ..operators import policy
from ..sources import parsers as P
from .catalog import n, query
from .estate import Estate
from .filesets import files


@query("a1_graph_session", "SELECT (SELECT count(*) FROM part) AS containers, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS services", ctes=False)
def graph_session(e: Estate) -> DataFrame:
    """Nodes of a session over one snapshot: frames are lazy views of its tables."""
    return e.table("part").agg(n().alias("containers")).join(e.services().agg(n().alias("services")))


@query("a5_trace_lines", "SELECT ['llm', 'persist'][p_partkey % 2 + 1] AS stage, count(*) AS n, max(p_size) AS most FROM part GROUP BY 1", ctes=False)
def trace_lines(e: Estate) -> DataFrame:
    """Trace events of JSON lines; every file has a malformed one, which is skipped."""
    text = F.concat(F.lit('{"stage":"'), F.when(F.col("p_partkey") % 2 == 0, "llm").otherwise("persist"), F.lit('","data":{"z":'), F.col("p_size").cast("string"), F.lit("}}\nnot json\n"))
    rows = P.lines(e.table("part").select(F.col("p_partkey").cast("string").alias("file"), text.alias("text"))).select(F.from_json("body", "stage string, data struct<z:int>").alias("j")).filter("j.stage IS NOT NULL")
    return rows.groupBy("j.stage").agg(n().alias("n"), F.max("j.data.z").alias("most"))


@query("b5_untagged_default", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'ast' ELSE 'heuristic' END AS source, CASE WHEN p_size % 2 = 0 THEN 'exact' ELSE 'speculative' END AS quality, p_size % 2 <> 0 AS review FROM part", ctes=False)
def untagged_default(e: Estate) -> DataFrame:
    """A fact that comes without grounding is a guess to review."""
    none = F.lit(None).cast("array<string>")
    tag = lambda v: F.when(F.col("p_size") % 2 == 0, F.lit(v))
    new = e.table("part").select(F.col("p_partkey").alias("id"), tag("ast").alias("source"), tag("exact").alias("quality"), tag(False).alias("review"), none.alias("extractors"), none.alias("fallbacks"), none.alias("merged"))
    return N.stamped(new.limit(0), new, "id").select("id", "source", "quality", "review")


@query("d1_left_hops", "WITH w AS (SELECT o_custkey AS c, o_orderkey AS o FROM orders WHERE o_orderstatus = 'O'), l AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R') SELECT c_custkey AS id, count(DISTINCT w.o) AS first, count(DISTINCT p) AS second FROM customer LEFT JOIN w ON c_custkey = c LEFT JOIN l ON w.o = l.o GROUP BY c_custkey", ctes=False)
def left_hops(e: Estate) -> DataFrame:
    """Two optional hops: what a hop must fulfil is asked of its side before the join, so that nothing is lost that has none."""
    w = e.table("orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("o"))
    l = e.table("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))  # noqa: E741
    return e.table("customer").select(F.col("c_custkey").alias("id")).join(w, "id", "left").join(l, "o", "left").groupBy("id").agg(F.count_distinct("o").alias("first"), F.count_distinct("p").alias("second"))


@query("e2_spof", "SELECT p_partkey AS id, CAST(greatest(0, least(100, floor(100 * (1 - exp(-(2 * (p_size % 9) + 3 * (p_size % 4) + 1.5 * (p_partkey % 7) + 0.5 * (p_partkey % 5)) / 15)) + 0.5))) AS BIGINT) AS spof FROM part", ctes=False)
def spof(e: Estate) -> DataFrame:
    z, k = F.col("p_size"), F.col("p_partkey")
    return e.table("part").select(k.alias("id"), G.spof_score(z % 9, z % 4, k % 7, k % 5).alias("spof"))


@query("e5_weight", "SELECT p_partkey AS id, round(1 + log10(greatest(1, p_size - 3)), 6) AS weight FROM part", ctes=False)
def weight(e: Estate) -> DataFrame:
    return e.table("part").select(F.col("p_partkey").alias("id"), F.round(1 + F.log10(F.greatest(F.lit(1), F.col("p_size") - 3).cast("double")), 6).alias("weight"))


@query(
    "e8_tiers",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'T?' WHEN s >= 100 THEN 'T0' WHEN s >= 50 THEN 'T1' WHEN s >= 15 THEN 'T2' WHEN s >= 6 THEN 'T3' ELSE 'T4' END AS tier, round(CASE WHEN s <= 0 THEN 0 WHEN s <= 6 THEN s / 30 WHEN s <= 15 THEN 0.2 + (s - 6) / 45 WHEN s <= 50 THEN 0.4 + (s - 15) / 175 WHEN s <= 100 THEN 0.6 + (s - 50) / 250 WHEN s <= 200 THEN 0.8 + (s - 100) / 500 ELSE 1 END, 6) AS bar FROM (SELECT *, p_size * 5 - 10 AS s FROM part)",
    ctes=False,
)
def tiers(e: Estate) -> DataFrame:
    """Tiers and bars of scores; what nothing observed depends on is unverified."""
    d = e.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 5 - 10).alias("s"), (F.col("p_partkey") % 5 != 0).alias("seen"))
    return d.select("id", V.tier(F.col("s"), F.col("seen")).alias("tier"), F.round(V.bar(F.col("s")), 6).alias("bar"))


@query("e10_severity_scores", "SELECT p_brand AS change, CAST(sum(CASE p_size % 3 WHEN 0 THEN 2 * (p_partkey % 4) + 1 WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS score FROM part GROUP BY p_brand", ctes=False)
def severity_scores(e: Estate) -> DataFrame:
    """The score of a change: twice the services a danger affects and one, one a warning."""
    k = F.col("p_size") % 3
    return e.table("part").groupBy(F.col("p_brand").alias("change")).agg(F.sum(F.when(k == 0, 2 * (F.col("p_partkey") % 4) + 1).when(k == 1, 1).otherwise(0)).alias("score"))


@query("f2_top_scores", "SELECT p_partkey AS id, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10", ctes=False)
def top_scores(e: Estate, k: int = 10) -> DataFrame:
    """The k highest, ties by id; each partition keeps k."""
    return e.table("part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")).orderBy(F.desc("score"), "id").limit(k)


@query("f4_latest_evidence", "SELECT user_id AS fact, event_type AS model, max_by(event_id, struct_pack(t := ts, i := event_id)) AS evidence FROM events GROUP BY 1, 2", ctes=False)
def latest_evidence(e: Estate) -> DataFrame:
    return e.table("events").groupBy(F.col("user_id").alias("fact"), F.col("event_type").alias("model")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("evidence"))


@query("i10_host_labels", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, split_part(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '.', 1) AS label FROM pages", ctes=False)
def hosts(e: Estate) -> DataFrame:
    h = S.host_of(F.col("url"))
    return e.table("pages").select("page_id", h.alias("host"), F.substring_index(h, ".", 1).alias("label"))


@query("i16_content_hashes", "SELECT doc_id, left(sha256(coalesce(text, '')), 16) AS hash FROM documents", ctes=False)
def content_hashes(e: Estate) -> DataFrame:
    return e.table("documents").select("doc_id", S.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query("i18_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", ctes=False)
def cosines(e: Estate) -> DataFrame:
    v = e.table("embeddings")
    b = v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("w"))
    return v.select(F.col("vec_id").alias("a"), "embedding").join(b, "a").select("a", "b", F.round(G.cosine(F.col("embedding"), F.col("w")), 6).alias("score"))


@query("i21_json_rows", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(props->>'k' AS BIGINT) END AS k FROM events", ctes=False)
def json_rows(e: Estate) -> DataFrame:
    """A key of each row's JSON; a corrupt row gives null, never an error."""
    text = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return e.table("events").select("event_id", F.from_json(text, "k long")["k"].alias("k"))


@query("m1_rule_rows", "SELECT unnest(['ar-tests-present', 'ar-skills-coverage', 'ar-codeowners', 'ar-rules-validated', 'ar-context-minimal', 'ar-context-actionable', 'ar-makefile-targets', 'ar-architecture-context', 'ar-blast-radius']) AS id, unnest(['error', 'warning', 'warning', 'warning', 'warning', 'warning', 'warning', 'warning', 'warning']) AS level, 'repository' AS scope", ctes=False)
def rule_rows(e: Estate) -> DataFrame:
    """The built-in rules, whose ids, levels and reading SQL are checked where they are made."""
    return e.spark.createDataFrame([(r.id, r.level, r.scope) for r in policy.READINESS], "id string, level string, scope string")


@query("m3_refused_queries", "SELECT unnest([1, 2, 3, 4, 5]) AS k, unnest([true, false, true, false, true]) AS refused", ctes=False)
def refused_queries(e: Estate) -> DataFrame:
    """Which of five texts are refused: writing words, several statements, and commands are; the same words in quotes are not."""

    def refused(sql: str) -> bool:
        try:
            policy.check_reading(sql)
        except policy.Refused:
            return True
        return False

    texts = ["DROP TABLE part", "SELECT 'drop' AS x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1 AS x) SELECT x FROM a", "MERGE INTO part USING x ON true"]
    return e.spark.createDataFrame([(k, refused(t)) for k, t in enumerate(texts, 1)], "k int, refused boolean")


_ROUTES = "router.get('/a{z}', h)\n  app.post(\"/b\", x)\n#[Route('/c{k}', methods: ['PUT'])]\n@GetMapping(\"/d/{id}\")\n@app.delete('/e')\n"


@query("q21_routes", "SELECT 'r' || p_partkey || '.txt' AS file, unnest(['GET', 'POST', 'PUT', 'GET', 'DELETE']) AS method, unnest(['/a' || p_size, '/b', '/c' || p_partkey, '/d/{id}', '/e']) AS path FROM part", ctes=False)
def routes(e: Estate) -> DataFrame:
    """Routes of source files in the common spellings of four frameworks."""
    return P.routes(files(e, "r{k}.txt", _ROUTES))
