"""Files that describe an estate, as frames: trace spans, pipeline traces, code owners, package manifests, OpenAPI documents.

Each reader keeps one row per fact. Files are read whole only where the format needs it; unreadable files and rows are
counted or returned, never raised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "spanId string, traceId string, operationName string, serviceName string, parentSpanId string, latency_ms double, status string, attributes map<string,string>"
TRACE = "ts string, stage string, action string, target string, reason string"
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def spans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid spans and rejected rows of JSON arrays. A span needs spanId, operationName, serviceName and latency_ms."""
    rows = spark.read.schema(f"{SPAN}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    ok = F.col("_bad").isNull() & F.col("spanId").isNotNull() & F.col("operationName").isNotNull() & F.col("serviceName").isNotNull() & F.col("latency_ms").isNotNull()
    return rows.filter(ok).drop("_bad"), rows.filter(~ok)


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Pipeline events, one JSON object a line; malformed lines are skipped."""
    return spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path)


def code_owners(spark: SparkSession, path: str) -> DataFrame:
    """file, line, pattern, teams, users of code-owner files. Comments and blank lines give nothing; a pattern may have no owner."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "body"))
    bare = text.withColumn("body", F.trim(F.regexp_replace("body", r"(^|\s)#.*$", ""))).filter("body <> ''")
    words = F.split("body", r"\s+")
    owners = F.slice(words, 2, F.size(words))
    teams = F.transform(F.filter(owners, lambda o: o.contains("/") & o.startswith("@")), lambda o: F.substring_index(o, "/", -1))
    users = F.transform(F.filter(owners, lambda o: ~o.contains("/") | ~o.startswith("@")), lambda o: F.regexp_replace(o, "^@", ""))
    return bare.select("file", (F.col("line") + 1).alias("line"), F.get(words, F.lit(0)).alias("pattern"), teams.alias("teams"), users.alias("users"))


def npm_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """file, package, ecosystem, required, is_dev of package.json files. Unreadable files give no rows."""
    kinds = "dependencies map<string,string>, devDependencies map<string,string>"
    own = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", kinds).alias("j"))
    parts = [own.select("file", F.explode(f"j.{k}").alias("package", "required"), F.lit(dev).alias("is_dev")) for k, dev in (("dependencies", False), ("devDependencies", True))]
    return parts[0].unionByName(parts[1]).select("file", "package", F.lit("npm").alias("ecosystem"), "required", "is_dev")


def endpoints(spark: SparkSession, path: str) -> DataFrame:
    """file, title, version, method, path, operation_id of OpenAPI documents in JSON. A path without methods gives nothing."""
    shape = "info struct<title string, version string>, paths map<string, map<string, string>>"
    own = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", shape).alias("j"))
    paths = own.select("file", "j.info.title", "j.info.version", F.explode("j.paths").alias("path", "item"))
    each = paths.select("*", F.explode("item").alias("method", "body")).filter(F.lower("method").isin(*METHODS))
    return each.select("file", "title", "version", F.upper("method").alias("method"), "path", F.get_json_object("body", "$.operationId").alias("operation_id"))


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A snapshot: nodes by label and edges by relation, so that later reads prune."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def import_graph(spark: SparkSession, path: str, present: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The snapshot alone, or added to present nodes and edges; what is present stays where the identity is the same."""
    nodes, edges = (spark.read.parquet(f"{path}/{k}") for k in ("nodes", "edges"))
    if present is None:
        return nodes, edges
    add = lambda old, new, key: old.unionByName(new.join(old.select(*key), key, "left_anti"), allowMissingColumns=True)
    return add(present[0], nodes, ["label", "id"]), add(present[1], edges, ["rel", "src", "dst"])


def sarif(violations: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 result a violation (rule, level, entity, detail), as JSON text by rule and entity."""
    level = F.when(F.col("level") == "error", "error").when(F.col("level") == "warning", "warning").otherwise("note")
    place = F.array(F.struct(F.array(F.struct(F.col("entity").alias("fullyQualifiedName"))).alias("logicalLocations")))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("detail").alias("text")).alias("message"), place.alias("locations"))
    return violations.select("rule", "entity", F.to_json(result).alias("result"))
