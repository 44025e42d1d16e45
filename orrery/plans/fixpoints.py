"""Registered queries on fixpoints and grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fixpoint as X
from ..operators import grounding as N
from .catalog import n, query
from .estate import Estate

#: Edges between parts: each leads to two others, so that there are chains, cycles and components of several sizes.
_HOPS = "hop AS (SELECT p_partkey AS src, CASE WHEN p_size % 3 = 0 THEN p_partkey // 2 ELSE p_partkey - p_partkey % 10 END AS dst FROM part WHERE p_size % 4 <> 0)"


def _hops(e: Estate) -> DataFrame:
    return e.table("part").filter("p_size % 4 <> 0").selectExpr("p_partkey AS src", "if(p_size % 3 = 0, p_partkey div 2, p_partkey - p_partkey % 10) AS dst")


@query(
    "j6_components",
    f"""WITH RECURSIVE {_HOPS}, u AS (SELECT src AS a, dst AS b FROM hop WHERE src <> dst UNION SELECT dst, src FROM hop WHERE src <> dst),
    r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON r.node = u.a) SELECT node, min(root) AS root FROM r GROUP BY node""",
    ctes=False,
)
def components(e: Estate) -> DataFrame:
    """Components of pairs, each named by its smallest node."""
    return X.components(_hops(e).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query(
    "b14_gc_channels",
    f"""WITH RECURSIVE {_HOPS}, r AS (SELECT p_partkey AS node FROM part WHERE p_size = 7 UNION SELECT hop.dst FROM r JOIN hop ON node = src)
    SELECT p_partkey AS channel FROM part WHERE p_partkey NOT IN (SELECT node FROM r) AND p_size <> 30""",
    ctes=False,
)
def gc_channels(e: Estate) -> DataFrame:
    """Channels that no live function publishes to or listens to, directly or over routes, and that are not declared."""
    p = e.table("part")
    live = X.reached(_hops(e), p.filter("p_size = 7").select(F.col("p_partkey").alias("node")))
    return p.filter("p_size <> 30").select(F.col("p_partkey").alias("channel")).join(live.select(F.col("node").alias("channel")), "channel", "left_anti")


@query(
    "j7_taint",
    f"""WITH RECURSIVE {_HOPS}, i AS (SELECT * FROM hop WHERE dst NOT IN (SELECT p_partkey FROM part WHERE p_size = 11)),
    t AS (SELECT src AS file, dst AS sink, 1 AS k FROM i WHERE dst IN (SELECT p_partkey FROM part WHERE p_size = 21) UNION SELECT i.src, sink, k + 1 FROM t JOIN i ON i.dst = t.file WHERE k < 32)
    SELECT file, sink, CAST(min(k) AS INTEGER) AS round FROM t GROUP BY file, sink""",
    ctes=False,
)
def taint(e: Estate) -> DataFrame:
    """Files that reach a sink over imports, with the round in which that is found."""
    of = lambda z: e.table("part").filter(F.col("p_size") == z).select(F.col("p_partkey").alias("name"))
    return X.taint(_hops(e), of(21), of(11))


@query(
    "j8_propagation",
    f"""WITH {_HOPS}, t AS (SELECT p_partkey AS node, CASE p_size % 3 WHEN 1 THEN 0.97 WHEN 2 THEN 0.90 ELSE 0.80 END AS base FROM part WHERE p_partkey % 9 = 0),
    a AS (SELECT src AS node, max(base) AS base FROM t JOIN hop ON node = dst GROUP BY 1), b AS (SELECT src AS node, max(base) AS base FROM a JOIN hop ON node = dst GROUP BY 1), c AS (SELECT src AS node, max(base) AS base FROM b JOIN hop ON node = dst GROUP BY 1),
    u AS (SELECT node, 1 AS hop, round(base::DOUBLE, 6) AS confidence FROM a UNION ALL SELECT node, 2, round(base::DOUBLE * 0.95, 6) FROM b UNION ALL SELECT node, 3, round(base::DOUBLE * 0.9025, 6) FROM c)
    SELECT node, hop, confidence FROM u WHERE confidence >= 0.85 QUALIFY row_number() OVER (PARTITION BY node ORDER BY confidence DESC, hop) = 1""",
    ctes=False,
)
def propagation(e: Estate) -> DataFrame:
    """Callers of tagged components over at most three hops, with decaying confidence."""
    t = e.table("part").filter("p_partkey % 9 = 0").selectExpr("p_partkey AS node", "if(p_size % 3 = 0, 3, p_size % 3) AS tags")
    return X.propagated(_hops(e), t)


_FLOW = """c AS (SELECT 'f' || l_orderkey AS fn, 't' || l_partkey AS st FROM lineitem WHERE l_returnflag = 'N' AND l_partkey % 3 = 0), p AS (SELECT 'f' || l_orderkey AS fn, 't' || l_partkey AS st FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 2 = 0),
  h AS (SELECT 't' || p_partkey AS st FROM part WHERE p_size % 5 < 2)"""


@query(
    "j3_lineage",
    f"""WITH RECURSIVE {_FLOW}, f AS (SELECT DISTINCT c.fn, c.st AS src, p.st AS dst FROM c JOIN p USING (fn) WHERE c.st <> p.st AND p.st IN (SELECT st FROM h)),
    r AS (SELECT 't6' AS st, 0 AS hop UNION SELECT f.dst, hop + 1 FROM r JOIN f ON r.st = f.src WHERE hop < 16)
    SELECT st AS structure, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY st""",
    ctes=False,
)
def lineage(e: Estate, start: str = "t6") -> DataFrame:
    """Structures that a field flows to, through functions that consume one and produce the next."""
    li = e.table("lineitem")
    side = lambda flag, test: li.filter(f"l_returnflag = '{flag}' AND {test}").selectExpr("concat('f', l_orderkey) AS function", "concat('t', l_partkey) AS structure").distinct()
    fields = e.table("part").selectExpr("concat('t', p_partkey) AS structure", "CASE p_size % 5 WHEN 0 THEN 'Email' WHEN 1 THEN 'user.EMAIL' ELSE 'mail' END AS field")
    return X.lineage(side("R", "l_partkey % 2 = 0"), side("N", "l_partkey % 3 = 0"), fields, start, "email").select("structure", "hop")


@query(
    "j4_bridges",
    """WITH b AS (SELECT l_orderkey AS step, l_partkey AS id, CASE l_returnflag WHEN 'N' THEN 'MessageChannel' WHEN 'R' THEN 'DataContainer' ELSE 'Cache' END AS type, l_suppkey % 2 = 0 AS crosses, l_linenumber > 2 AS written FROM lineitem)
    SELECT step, arg_min(id, (CASE WHEN type = 'MessageChannel' AND crosses THEN 0 WHEN type = 'DataContainer' AND written THEN 1 ELSE 2 END, id)) AS bridge FROM b GROUP BY step""",
    ctes=False,
)
def bridges(e: Estate) -> DataFrame:
    type_ = F.when(F.col("l_returnflag") == "N", "MessageChannel").when(F.col("l_returnflag") == "R", "DataContainer").otherwise("Cache")
    b = e.table("lineitem").select(F.col("l_orderkey").alias("step"), F.col("l_partkey").alias("id"), type_.alias("type"), (F.col("l_suppkey") % 2 == 0).alias("crosses"), (F.col("l_linenumber") > 2).alias("written"))
    return X.best_bridge(b)


_RANKS = "['speculative', 'low', 'medium', 'high', 'exact']"
_FACT = "p_partkey AS id, ['ast', 'llm', 'infra'][p_partkey % 3 + 1] AS source, {0}[p_size % 5 + 1] AS quality, p_size % 4 = 0 AS review".format(_RANKS)


def _fact(e: Estate, shift: int) -> DataFrame:
    k, z = F.col("p_partkey") + shift, F.col("p_size") + 2 * shift
    names = F.array(*[F.lit(s) for s in ("ast", "llm", "infra")])
    return e.table("part").select(F.col("p_partkey").alias("id"), F.get(names, (k % 3).cast("int")).alias("source"), N.quality((z % 5).cast("int")).alias("quality"), (z % 4 == 0).alias("review"))


_TWO = f"""a AS (SELECT p_partkey AS id, ['ast', 'llm', 'infra'][p_partkey % 3 + 1] AS sa, p_size % 5 AS qa, p_size % 4 = 0 AS ra FROM part),
  b AS (SELECT p_partkey AS id, ['ast', 'llm', 'infra'][CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE p_partkey + 1 END % 3 + 1] AS sb, (p_size + 2) % 5 AS qb, (p_size + 2) % 4 = 0 AS rb FROM part)"""


def _two(e: Estate) -> DataFrame:
    b = _fact(e, 1).join(_fact(e, 0).select("id", F.col("source").alias("s0")), "id").join(e.table("part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    b = b.withColumn("source", F.when(F.col("p_size") % 2 == 0, F.col("s0")).otherwise(F.col("source")))
    pack = lambda d, m: d.select("id", F.struct("source", "quality", "review").alias(m))
    return pack(_fact(e, 0), "a").join(pack(b, "b"), "id")


@query("b6_composite", f"WITH {_TWO} SELECT id, CASE WHEN sa = sb THEN sa ELSE 'composite' END AS source, {_RANKS}[CASE WHEN sa = sb THEN least(qa, qb) ELSE least(least(qa, qb) + 1, 3) END + 1] AS quality, ra OR rb AS review FROM a JOIN b USING (id)", ctes=False)
def composites(e: Estate) -> DataFrame:
    return _two(e).select("id", N.composite(F.col("a"), F.col("b")).alias("g")).select("id", "g.*")


@query("b8_weld_grounding", f"WITH {_TWO} SELECT id, CASE WHEN sa = sb THEN sa ELSE 'composite' END AS source, {_RANKS}[least(qa, qb) + 1] AS quality, ra OR rb AS review FROM a JOIN b USING (id)", ctes=False)
def weld_groundings(e: Estate) -> DataFrame:
    return _two(e).select("id", N.welded(F.col("a"), F.col("b")).alias("g")).select("id", "g.*")


@query("b7_fallback", f"SELECT p_partkey AS id, {_RANKS}[greatest(p_size % 5 - 1, 0) + 1] AS quality, CASE WHEN p_partkey % 2 = 0 THEN 'x,guess' ELSE 'guess' END AS fallbacks FROM part", ctes=False)
def fallbacks(e: Estate) -> DataFrame:
    """Quality one step lower, and the fallback's name behind those applied before."""
    old = F.when(F.col("id") % 2 == 0, F.array(F.lit("x"), F.lit("guess"))).otherwise(F.lit(None).cast("array<string>"))
    return _fact(e, 0).select("id", N.demoted(F.col("quality")).alias("quality"), F.array_join(N.union(old, F.array(F.lit("guess"))), ",").alias("fallbacks"))


@query("c9_quality_filter", "SELECT p_partkey AS id FROM part WHERE p_size % 5 >= 2", ctes=False)
def quality_filter(e: Estate) -> DataFrame:
    return _fact(e, 0).filter(N.at_least(F.col("quality"), "medium")).select("id")


@query(
    "b4_grounding_stamp",
    f"""WITH o AS (SELECT {_FACT} FROM part WHERE p_partkey % 3 <> 1), w AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'llm' END AS source, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'high' END AS quality, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE false END AS review FROM part WHERE p_partkey % 2 = 0)
    SELECT coalesce(o.id, w.id) AS id, CASE WHEN w.id IS NULL THEN o.source ELSE coalesce(w.source, 'heuristic') END AS source, CASE WHEN w.id IS NULL THEN o.quality ELSE coalesce(w.quality, 'speculative') END AS quality,
      CASE WHEN w.id IS NULL THEN o.review ELSE coalesce(w.review, true) END AS review, CASE WHEN o.id IS NOT NULL AND w.id IS NOT NULL THEN 'a,b,c' WHEN o.id IS NOT NULL THEN 'a,b' ELSE 'b,c' END AS extractors, CASE WHEN w.id IS NOT NULL THEN 'm' END AS merged
    FROM o FULL JOIN w ON o.id = w.id""",
    ctes=False,
)
def grounding_stamp(e: Estate) -> DataFrame:
    """A new grounding over the old one; a fact without any is a guess to review (B5)."""
    none = F.lit(None).cast("array<string>")
    old = _fact(e, 0).filter("id % 3 <> 1").withColumns({"extractors": F.array(F.lit("a"), F.lit("b")), "fallbacks": none, "merged": none})
    tag = lambda v: F.when(F.col("p_partkey") % 4 != 0, F.lit(v))
    new = e.table("part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), tag("llm").alias("source"), tag("high").alias("quality"), tag(False).alias("review"), F.array(F.lit("b"), F.lit("c")).alias("extractors"), none.alias("fallbacks"), F.array(F.lit("m")).alias("merged"))
    out = N.stamped(old, new, "id")
    return out.select("id", "source", "quality", "review", F.array_join("extractors", ",").alias("extractors"), F.array_join("merged", ",").alias("merged"))


@query(
    "b9_recent_calls",
    """WITH c AS (SELECT user_id % 50 AS fact, event_type AS model, CAST(event_id % 7 AS BIGINT) AS prompt, max(ts) AS "at" FROM events GROUP BY 1, 2, 3)
    SELECT fact, model, prompt, "at" FROM c QUALIFY row_number() OVER (PARTITION BY fact ORDER BY "at" DESC, model DESC, prompt DESC) <= 10""",
    ctes=False,
)
def recent_calls(e: Estate) -> DataFrame:
    """The last ten calls of each fact, the newest of each model and prompt."""
    c = e.table("events").select((F.col("user_id") % 50).alias("fact"), F.col("event_type").alias("model"), (F.col("event_id") % 7).alias("prompt"), F.col("ts").alias("at"))
    return N.recent_calls(c, ["fact"])


@query(
    "e25_label_tiers",
    "SELECT p_type AS label, count(*) FILTER (p_size % 5 = 0) AS speculative, count(*) FILTER (p_size % 5 = 1) AS low, count(*) FILTER (p_size % 5 = 2) AS medium, count(*) FILTER (p_size % 5 = 3) AS high, count(*) FILTER (p_size % 5 = 4) AS exact, count(*) FILTER (p_size % 4 = 0) AS review FROM part GROUP BY p_type",
    ctes=False,
)
def label_tiers(e: Estate) -> DataFrame:
    return N.tiers(_fact(e, 0).join(e.table("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label")), "id"))


@query("e26_disputed", "SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 1 AND p_size % 4 IN (1, 3)", ctes=False)
def disputed(e: Estate) -> DataFrame:
    z = F.col("p_size") % 4
    x = F.when(z == 0, F.array(F.lit("llm:a"), F.lit("llm:b"))).when(z == 1, F.array(F.lit("llm:a"), F.lit("ast"))).when(z == 2, F.array(F.lit("llm:a"))).otherwise(F.array(F.lit("regex"), F.lit("ast"), F.lit("llm")))
    return N.disputed(_fact(e, 0).join(e.table("part").select(F.col("p_partkey").alias("id"), x.alias("extractors")), "id")).select("id")
