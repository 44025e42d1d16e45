"""Governance: guarded SQL, rules as rows of SQL, their evaluation and report."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that only a writing statement has.
WRITING = ("create", "delete", "detach", "merge", "set", "remove", "drop", "insert", "update", "alter", "truncate", "overwrite", "load", "call", "copy", "grant")
LEVELS = ("error", "warning", "info")
COLUMNS = ("entity_id", "entity_name", "status", "detail")


class Refused(ValueError):
    """A query that is more than one reading statement."""


def bare(sql: str) -> str:
    """sql without comments and quoted text, in lower case."""
    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", " ", sql, flags=re.S).lower()


def check_reading(sql: str) -> None:
    """Refuse all but one SELECT, WITH or VALUES statement."""
    text = bare(sql).strip().rstrip(";")
    words = re.findall(r"[a-z_]+", text)
    if not words or words[0] not in ("select", "with", "values", "from") or ";" in text:
        raise Refused("only one reading statement is run")
    if found := sorted(set(words) & set(WRITING)):
        raise Refused(f"writing words: {', '.join(found)}")


def run_query(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None, **args: object) -> DataFrame:
    """A reading query over named frames; args fill :name markers."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or None)


def guarded(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None, **args: object) -> DataFrame:
    """run_query for text that comes from outside."""
    check_reading(sql)
    return run_query(spark, sql, tables, **args)


@dataclass(frozen=True)
class Rule:
    """A rule's SQL gives a row for each entity: entity_id, entity_name, status (pass or fail) and detail."""

    id: str
    level: str
    scope: str
    sql: str

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z0-9-]+", self.id) or self.level not in LEVELS:
            raise ValueError(f"rule {self.id!r}: bad id or level")
        check_reading(self.sql)


def execute(spark: SparkSession, rules: Iterable[Rule], tables: dict[str, DataFrame], fail_fast: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """The rows of all rules with rule and level, and what each rule that could not run said. Rows without an entity or with another
    status are left out. The rules are one plan, so Spark reads what they share once."""
    parts, errors = [], {}
    for rule in rules:
        try:
            df = guarded(spark, rule.sql, tables)
            if missing := set(COLUMNS) - set(df.columns):
                raise ValueError(f"no column {', '.join(sorted(missing))}")
        except Exception as problem:  # noqa: BLE001  the rule's own text decides what fails
            errors[rule.id] = str(problem).splitlines()[0]
            if fail_fast:
                break
            continue
        parts.append(df.select(F.lit(rule.id).alias("rule"), F.lit(rule.level).alias("level"), F.col("entity_id").cast("string"), F.col("entity_name").cast("string"), "status", F.col("detail").cast("string")))
    empty = spark.createDataFrame([], "rule string, level string, entity_id string, entity_name string, status string, detail string")
    return reduce(DataFrame.unionByName, parts, empty).filter("entity_id IS NOT NULL AND status IN ('pass', 'fail')"), errors


def report(rows: DataFrame) -> DataFrame:
    """Of each rule: entities evaluated and compliant, violations, and the compliant share in percent; an entity's rows count once."""
    per = rows.groupBy("rule", "level", "entity_id").agg(F.max((F.col("status") == "fail").cast("int")).alias("bad"))
    out = per.groupBy("rule", "level").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("bad") == 0).alias("compliant"), F.sum("bad").alias("violations"))
    return out.withColumn("percent", F.floor(100.0 * F.col("compliant") / F.col("evaluated") + 0.5).cast("long"))


_LIVE = "valid_to IS NULL"
_OWN = "SELECT r.id AS repo_id, c.* FROM repo r JOIN config c ON c.owner = r.id UNION ALL SELECT s.repo AS repo_id, c.* FROM stored s JOIN config c ON c.owner = s.service"


def _counted(what: str, where: str) -> str:
    return f"""SELECT r.id AS entity_id, r.name AS entity_name, CASE WHEN count(o.id) > 0 THEN 'pass' ELSE 'fail' END AS status, concat(count(DISTINCT o.id), ' {what}') AS detail
      FROM repo r LEFT JOIN (SELECT * FROM ({_OWN}) WHERE {where}) o ON o.repo_id = r.id WHERE r.{_LIVE} GROUP BY r.id, r.name"""


_INSTRUCTIONS = "type IN ('rule', 'agent_instructions')"
_SCANNED = "r.scan_mode IN ('semantic', 'contracts')"
#: The built-in pack on how ready repositories are for agents. Tables: repo(id, name, scan_mode, valid_to), stored(service, repo),
#: owner(team, target), config(id, owner, type, size, topics, servers), task(repo, name).
READINESS = (
    Rule("ar-tests-present", "error", "repository", _counted("pipelines with tests", "type = 'pipeline' AND topics LIKE '%test%'")),
    Rule("ar-skills-coverage", "warning", "repository", _counted("skills", "type = 'skill'")),
    Rule(
        "ar-codeowners", "warning", "repository",
        """SELECT r.id AS entity_id, r.name AS entity_name, CASE WHEN count(o.team) > 0 THEN 'pass' ELSE 'fail' END AS status, concat(count(DISTINCT o.team), ' teams') AS detail
        FROM repo r LEFT JOIN (SELECT target AS repo, team FROM owner UNION ALL SELECT s.repo, o.team FROM owner o JOIN stored s ON o.target = s.service) o ON o.repo = r.id GROUP BY r.id, r.name""",
    ),
    Rule("ar-rules-validated", "warning", "repository", _counted("rules", _INSTRUCTIONS)),
    Rule(
        "ar-context-minimal", "warning", "repository",
        f"""SELECT r.id AS entity_id, r.name AS entity_name, CASE WHEN count(o.id) = 0 THEN 'pass' ELSE 'fail' END AS status, concat(count(DISTINCT o.id), ' too large') AS detail
        FROM repo r LEFT JOIN (SELECT * FROM ({_OWN}) WHERE type IN ('rule', 'agent_instructions', 'global') AND size > 12000) o ON o.repo_id = r.id WHERE r.{_LIVE} GROUP BY r.id, r.name""",
    ),
    Rule(
        "ar-context-actionable", "warning", "repository",
        f"""SELECT r.id AS entity_id, r.name AS entity_name, CASE WHEN count(o.id) = 0 OR max(o.useful) THEN 'pass' ELSE 'fail' END AS status, concat(count(DISTINCT o.id), ' configs') AS detail
        FROM repo r LEFT JOIN (SELECT *, topics RLIKE '(^|,) *(developer-experience|ci-cd|testing) *(,|$)' AS useful FROM ({_OWN}) WHERE {_INSTRUCTIONS}) o ON o.repo_id = r.id WHERE r.{_LIVE} GROUP BY r.id, r.name""",
    ),
    Rule(
        "ar-makefile-targets", "warning", "repository",
        f"""SELECT r.id AS entity_id, r.name AS entity_name, CASE WHEN count(DISTINCT t.name) = 3 THEN 'pass' ELSE 'fail' END AS status, concat(count(DISTINCT t.name), ' of 3 targets') AS detail
        FROM repo r LEFT JOIN task t ON t.repo = r.id AND t.name IN ('setup', 'test', 'run') WHERE r.{_LIVE} GROUP BY r.id, r.name""",
    ),
    Rule(
        "ar-architecture-context", "warning", "repository",
        f"""SELECT r.id AS entity_id, r.name AS entity_name, CASE WHEN {_SCANNED} AND count(o.id) > 0 THEN 'pass' ELSE 'fail' END AS status, coalesce(r.scan_mode, 'none') AS detail
        FROM repo r LEFT JOIN (SELECT * FROM ({_OWN}) WHERE type = 'mcp' AND servers LIKE '%architecture%') o ON o.repo_id = r.id WHERE r.{_LIVE} GROUP BY r.id, r.name, r.scan_mode""",
    ),
    Rule("ar-blast-radius", "warning", "repository", f"SELECT r.id AS entity_id, r.name AS entity_name, CASE WHEN {_SCANNED} THEN 'pass' ELSE 'fail' END AS status, coalesce(r.scan_mode, 'none') AS detail FROM repo r WHERE r.{_LIVE}"),
)
