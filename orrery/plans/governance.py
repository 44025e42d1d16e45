"""Registered queries on governance: the built-in rules, their report, guarded queries, maturity and capabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import policy
from .catalog import n, query
from .estate import Estate

#: Repositories are customers' nations with a market segment; parts are configurations of suppliers and repositories, orders tasks.
_REPO = "repo AS (SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'structure' WHEN 1 THEN 'semantic' WHEN 2 THEN 'contracts' END AS scan_mode, CASE WHEN c_custkey % 17 = 0 THEN 'gone' END AS valid_to FROM customer)"
_TABLES = f"""{_REPO}, stored AS (SELECT 1000000 + s_suppkey AS service, s_suppkey * 3 % 150 + 1 AS repo FROM supplier), owner AS (SELECT s_nationkey AS team, CASE WHEN s_suppkey % 2 = 0 THEN 1000000 + s_suppkey ELSE s_suppkey * 7 % 150 + 1 END AS target FROM supplier WHERE s_suppkey % 3 <> 0),
  config AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 1000000 + p_partkey % 100 ELSE p_partkey % 150 + 1 END AS owner, ['pipeline', 'skill', 'rule', 'agent_instructions', 'global', 'mcp'][p_size % 6 + 1] AS type, p_size * 400 AS size,
    CASE p_partkey % 4 WHEN 0 THEN 'testing, ci-cd' WHEN 1 THEN 'security' WHEN 2 THEN 'developer-experience' ELSE 'latest' END AS topics, CASE WHEN p_partkey % 2 = 0 THEN 'a, architecture-map' ELSE 'other' END AS servers FROM part),
  task AS (SELECT DISTINCT o_custkey AS repo, ['setup', 'test', 'run', 'lint'][o_orderkey % 4 + 1] AS name FROM orders),
  own AS (SELECT owner AS repo, c.* FROM config c WHERE owner < 1000000 UNION ALL SELECT s.repo, c.* FROM config c JOIN stored s ON c.owner = s.service), live AS (SELECT * FROM repo WHERE valid_to IS NULL)"""


def tables(e: Estate) -> dict[str, DataFrame]:
    c, s, p, o = (e.table(t) for t in ("customer", "supplier", "part", "orders"))
    pick = lambda k, names: f"element_at(array({', '.join(repr(x) for x in names)}), cast({k} % {len(names)} + 1 AS int))"
    return {
        "repo": c.selectExpr("c_custkey AS id", "c_name AS name", "CASE c_custkey % 4 WHEN 0 THEN 'structure' WHEN 1 THEN 'semantic' WHEN 2 THEN 'contracts' END AS scan_mode", "if(c_custkey % 17 = 0, 'gone', null) AS valid_to"),
        "stored": s.selectExpr("1000000 + s_suppkey AS service", "s_suppkey * 3 % 150 + 1 AS repo"),
        "owner": s.filter("s_suppkey % 3 <> 0").selectExpr("s_nationkey AS team", "if(s_suppkey % 2 = 0, 1000000 + s_suppkey, s_suppkey * 7 % 150 + 1) AS target"),
        "config": p.selectExpr(
            "p_partkey AS id", "if(p_partkey % 3 = 0, 1000000 + p_partkey % 100, p_partkey % 150 + 1) AS owner", pick("p_size", ["pipeline", "skill", "rule", "agent_instructions", "global", "mcp"]) + " AS type", "p_size * 400 AS size",
            pick("p_partkey", ["testing, ci-cd", "security", "developer-experience", "latest"]) + " AS topics", "if(p_partkey % 2 = 0, 'a, architecture-map', 'other') AS servers",
        ),
        "task": o.selectExpr("o_custkey AS repo", pick("o_orderkey", ["setup", "test", "run", "lint"]) + " AS name").distinct(),
    }


def _sql_rule(rule: str, level: str, status: str, join: str, where: str = "", source: str = "live") -> str:
    return f"SELECT '{rule}' AS rule, '{level}' AS level, CAST(r.id AS VARCHAR) AS entity_id, CASE WHEN {status} THEN 'pass' ELSE 'fail' END AS status FROM {source} r LEFT JOIN {join} GROUP BY r.id, r.scan_mode {where}"


_OWNS = "own o ON o.repo = r.id AND "
_RULES = " UNION ALL ".join(
    [
        _sql_rule("ar-tests-present", "error", "count(o.id) > 0", _OWNS + "type = 'pipeline' AND contains(topics, 'test')"),
        _sql_rule("ar-skills-coverage", "warning", "count(o.id) > 0", _OWNS + "type = 'skill'"),
        _sql_rule("ar-codeowners", "warning", "count(o.team) > 0", "(SELECT team, coalesce(s.repo, target) AS repo FROM owner LEFT JOIN stored s ON target = s.service) o ON o.repo = r.id", source="repo"),
        _sql_rule("ar-rules-validated", "warning", "count(o.id) > 0", _OWNS + "type IN ('rule', 'agent_instructions')"),
        _sql_rule("ar-context-minimal", "warning", "count(o.id) = 0", _OWNS + "type IN ('rule', 'agent_instructions', 'global') AND size > 12000"),
        _sql_rule("ar-context-actionable", "warning", "count(o.id) = 0 OR count(o.id) FILTER (topics IN ('testing, ci-cd', 'developer-experience')) > 0", _OWNS + "type IN ('rule', 'agent_instructions')"),
        _sql_rule("ar-makefile-targets", "warning", "count(DISTINCT t.name) = 3", "task t ON t.repo = r.id AND t.name <> 'lint'"),
        _sql_rule("ar-architecture-context", "warning", "r.scan_mode IN ('semantic', 'contracts') AND count(o.id) > 0", _OWNS + "type = 'mcp' AND contains(servers, 'architecture')"),
        _sql_rule("ar-blast-radius", "warning", "r.scan_mode IN ('semantic', 'contracts')", "(SELECT 1) o ON true"),
    ]
)


@query("m5_readiness_rules", f"WITH {_TABLES} {_RULES}", ctes=False)
def readiness_rules(e: Estate) -> DataFrame:
    """The nine built-in rules, a row for each rule and repository."""
    return policy.execute(e.spark, policy.READINESS, tables(e))[0].select("rule", "level", "entity_id", "status")


_REPORT = f"""WITH {_TABLES}, rows_ AS ({_RULES})
  SELECT rule, level, count(*) AS evaluated, count(*) FILTER (status = 'pass') AS compliant, count(*) FILTER (status = 'fail') AS violations, CAST(floor(100.0::DOUBLE * count(*) FILTER (status = 'pass') / count(*) + 0.5) AS BIGINT) AS percent FROM rows_ GROUP BY rule, level"""


@query("m4_compliance_report", _REPORT, ctes=False)
def compliance_report(e: Estate) -> DataFrame:
    return policy.report(policy.execute(e.spark, policy.READINESS, tables(e))[0])


@query(
    "e24_governance_report",
    f"""WITH {_TABLES}, r AS ({_RULES}), x AS (SELECT level, entity_id, bool_or(status = 'fail') AS bad, count(DISTINCT rule) FILTER (status = 'fail') AS violations FROM r GROUP BY 1, 2)
    SELECT level, count(*) AS evaluated, count(*) FILTER (NOT bad) AS compliant, CAST(sum(violations) AS BIGINT) AS violations, CAST(floor(100.0::DOUBLE * count(*) FILTER (NOT bad) / count(*) + 0.5) AS BIGINT) AS percent FROM x GROUP BY level""",
    ctes=False,
)
def governance_report(e: Estate) -> DataFrame:
    """By level: distinct entities, those without a violation, and violations, each evaluation once."""
    rows = policy.execute(e.spark, policy.READINESS, tables(e))[0]
    x = rows.groupBy("level", "entity_id").agg(F.max(F.col("status") == "fail").alias("bad"), F.count_distinct(F.when(F.col("status") == "fail", F.col("rule"))).alias("violations"))
    out = x.groupBy("level").agg(n().alias("evaluated"), F.count_if(~F.col("bad")).alias("compliant"), F.sum("violations").alias("violations"))
    return out.withColumn("percent", F.floor(100.0 * F.col("compliant") / F.col("evaluated") + 0.5).cast("long"))


@query("m2_rule_execution", f"WITH {_TABLES} SELECT 'ok-rule' AS rule, CAST(id AS VARCHAR) AS entity_id, 'fail' AS status FROM repo WHERE id % 2 = 1", ctes=False)
def rule_execution(e: Estate) -> DataFrame:
    """Of three rules one runs; one has no column for its detail, one is no query. Rows with another status are left out."""
    rules = [
        policy.Rule("ok-rule", "info", "repository", "SELECT id AS entity_id, name AS entity_name, if(id % 2 = 1, 'fail', 'odd') AS status, '' AS detail FROM repo"),
        policy.Rule("no-detail", "info", "repository", "SELECT id AS entity_id, name AS entity_name, 'pass' AS status FROM repo"), policy.Rule("no-table", "info", "repository", "SELECT * FROM nowhere"),
    ]
    return policy.execute(e.spark, rules, tables(e))[0].select("rule", "entity_id", "status")


@query("a2_read_query", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand", ctes=False)
def read_query(e: Estate) -> DataFrame:
    return policy.run_query(e.spark, "SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_size > :least GROUP BY p_brand", {"part": e.table("part")}, least=10)


@query("a3_guarded_query", "SELECT s_nationkey AS nation, max(s_acctbal) AS most FROM supplier WHERE s_name <> 'drop table; --' GROUP BY 1", ctes=False)
def guarded_query(e: Estate) -> DataFrame:
    """A query from outside; words of writing inside quotes are no statement."""
    return policy.guarded(e.spark, "SELECT s_nationkey AS nation, max(s_acctbal) AS most FROM supplier WHERE s_name <> 'drop table; --' GROUP BY 1", {"supplier": e.table("supplier")})


@query(
    "e27_maturity",
    f"""WITH {_TABLES}, m AS (SELECT r.id, count(o.id) AS configs, count(*) FILTER (type = 'rule' AND size > 200) AS rules, count(*) FILTER (type = 'skill') AS skills, count(*) FILTER (type = 'pipeline') AS flows, count(*) FILTER (type = 'mcp') AS mcp, count(*) FILTER (type = 'global') AS agents
      FROM live r LEFT JOIN own o ON o.repo = r.id GROUP BY r.id)
    SELECT id, configs, CASE WHEN agents > 1 OR (mcp > 0 AND rules > 0 AND flows > 0) THEN 4 WHEN skills + flows > 0 THEN 3 WHEN rules > 0 THEN 2 WHEN configs > 0 THEN 1 ELSE 0 END AS level FROM m""",
    ctes=False,
)
def maturity(e: Estate) -> DataFrame:
    """How far each repository is with agents, from 0 (nothing) to 4 (several agents, or servers with rules and workflows)."""
    t = tables(e)
    own = t["config"].filter("owner < 1000000").withColumn("repo", F.col("owner")).unionByName(t["config"].join(t["stored"], F.col("owner") == F.col("service")).select(*t["config"].columns, "repo"))
    of = lambda test: F.count_if(F.expr(test))
    m = own.groupBy("repo").agg(n().alias("configs"), of("type = 'rule' AND size > 200").alias("rules"), of("type = 'skill'").alias("skills"), of("type = 'pipeline'").alias("flows"), of("type = 'mcp'").alias("mcp"), of("type = 'global'").alias("agents"))
    m = t["repo"].filter("valid_to IS NULL").select("id").join(m.withColumnRenamed("repo", "id"), "id", "left").fillna(0)
    return m.select("id", "configs", F.expr("CASE WHEN agents > 1 OR (mcp > 0 AND rules > 0 AND flows > 0) THEN 4 WHEN skills + flows > 0 THEN 3 WHEN rules > 0 THEN 2 WHEN configs > 0 THEN 1 ELSE 0 END").alias("level"))


@query(
    "e30_capabilities",
    f"WITH {_TABLES}, t AS (SELECT id, repo, type, trim(unnest(string_split(topics, ','))) AS topic FROM own) SELECT topic, type, count(DISTINCT repo) AS repos, count(DISTINCT id) AS configs FROM t WHERE topic <> '' GROUP BY topic, type",
    ctes=False,
)
def capabilities(e: Estate) -> DataFrame:
    """Topics of configurations by type, with the repositories and configurations that have them."""
    t = tables(e)
    own = t["config"].filter("owner < 1000000").select("id", "type", "topics", F.col("owner").alias("repo")).unionByName(t["config"].join(t["stored"], F.col("owner") == F.col("service")).select("id", "type", "topics", "repo"))
    x = own.select("id", "repo", "type", F.explode(F.split("topics", ",")).alias("topic")).withColumn("topic", F.trim("topic")).filter("topic <> ''")
    return x.groupBy("topic", "type").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("id").alias("configs"))


@query(
    "e31_blindspots",
    """WITH tech AS (SELECT DISTINCT c_custkey AS repo, CASE WHEN contains(lower(p_type), 'e') THEN 'react' ELSE 'php' END || p_size % 9 AS tech FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
    skill AS (SELECT DISTINCT 'react' || p_size % 5 AS tech, p_partkey % 150 + 1 AS repo FROM part),
    u AS (SELECT tech, count(*) AS repos FROM tech GROUP BY tech HAVING count(*) >= 3), c AS (SELECT tech, count(*) AS covered FROM tech JOIN skill USING (tech, repo) GROUP BY tech)
    SELECT tech, repos, CAST(floor(100.0::DOUBLE * coalesce(covered, 0) / repos + 0.5) AS BIGINT) AS percent FROM u LEFT JOIN c USING (tech) ORDER BY percent, repos DESC, tech LIMIT 20""",
    ctes=False,
)
def blindspots(e: Estate) -> DataFrame:
    """Technologies of three repositories or more that few of their skills cover: the twenty least covered."""
    p = e.table("part").select("p_partkey", F.concat(F.when(F.contains(F.lower("p_type"), F.lit("e")), "react").otherwise("php"), (F.col("p_size") % 9).cast("string")).alias("tech"))
    li = e.table("lineitem").select("l_orderkey", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).join(e.table("orders").select("o_orderkey", F.col("o_custkey").alias("repo")), F.col("l_orderkey") == F.col("o_orderkey"))
    tech = li.select("repo", "tech").distinct()
    skill = e.table("part").selectExpr("concat('react', p_size % 5) AS tech", "p_partkey % 150 + 1 AS repo").distinct().withColumn("has", F.lit(1))
    out = tech.join(skill, ["tech", "repo"], "left").groupBy("tech").agg(n().alias("repos"), F.count("has").alias("covered")).filter("repos >= 3")
    return out.select("tech", "repos", F.floor(100.0 * F.col("covered") / F.col("repos") + 0.5).cast("long").alias("percent")).orderBy("percent", F.desc("repos"), "tech").limit(20)
