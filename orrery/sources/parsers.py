"""Parsers of files that describe an estate. Each takes a frame of files (file, text) and gives one row a fact.

`read` makes such a frame from a path. Formats that regular expressions read stay in the JVM; nested ones go through Python in Arrow
batches, file by file. A file that cannot be read gives no rows, or a row with its error where that is said.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I

METHODS = "get|put|post|delete|options|head|patch|trace"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """file, line (from 1) and body."""
    return files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("p", "body")).select("file", (F.col("p") + 1).alias("line"), "body")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# Avro


def _flat(schema: object, named: dict, prefix: str, nullable: bool, out: list) -> str:
    """Append the fields of a type under prefix and return what the type is called."""
    if isinstance(schema, list):
        real = [s for s in schema if s != "null"]
        return _flat(real[0], named, prefix, True, out) if len(real) == 1 else "union"
    if isinstance(schema, str):
        return _flat(named[schema], named, prefix, nullable, out) if schema in named else schema
    kind = schema["type"]
    if isinstance(kind, (dict, list)):
        return _flat(kind, named, prefix, nullable, out)
    if "name" in schema and kind in ("record", "enum", "fixed") and prefix.count(".") < 16:
        named = {**named, schema["name"]: {**schema, "fields": []}}
    if kind == "record":
        for f in schema["fields"]:
            name, own = f"{prefix}.{f['name']}" if prefix else f["name"], f["type"]
            optional = isinstance(own, list) and "null" in own
            inner = [s for s in own if s != "null"][0] if optional and len(own) == 2 else own
            at = len(out)
            out.append(None)
            called = _flat(own, named, name, optional, out)
            out[at] = (name, called, inner.get("logicalType") if isinstance(inner, dict) else None, optional)
        return "record"
    if kind == "array":
        return f"array<{_flat(schema['items'], named, prefix, nullable, out)}>"
    if kind == "map":
        return f"map<{_flat(schema['values'], named, prefix, nullable, out)}>"
    return kind


def avro_fields(files: DataFrame) -> DataFrame:
    """file, record, field (dotted where nested), type, logical and nullable of schema files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    schema, out = json.loads(text), []
                    if schema["type"] == "record":
                        _flat(schema, {}, "", False, out)
                        rows += [(file, schema["name"], *f) for f in out]
                except (ValueError, KeyError, TypeError, RecursionError):
                    continue
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file", "record", "field", "type", "logical", "nullable"])

    return files.select("file", "text").mapInArrow(run, "file string, record string, field string, type string, logical string, nullable boolean")


# GraphQL


def graphql_fields(files: DataFrame) -> DataFrame:
    """file, kind, type, field and returns of a schema's types, inputs and interfaces; comments and descriptions give nothing."""
    bare = F.regexp_replace(F.regexp_replace("text", r'(?s)""".*?"""|"[^"\n]*"', ""), r"#[^\n]*", "")
    blocks = files.select("file", F.explode(_found(bare, r"(?:extend\s+)?((?:type|input|interface)\s+\w+[^{}]*\{[^}]*\})")).alias("block"))
    head = r"^(type|input|interface)\s+(\w+)"
    each = blocks.select("file", F.regexp_extract("block", head, 1).alias("kind"), F.regexp_extract("block", head, 2).alias("type"), F.explode(_found(F.regexp_extract("block", r"(?s)\{(.*)\}", 1), r"(\w+\s*(?:\([^)]*\))?\s*:\s*[\[\]!\w]+)")).alias("f"))
    return each.select("file", "kind", "type", F.regexp_extract("f", r"^(\w+)", 1).alias("field"), F.regexp_extract("f", r":\s*([\[\]!\w]+)$", 1).alias("returns"))


def graphql_operations(files: DataFrame) -> DataFrame:
    """file, operation, name and root (the first field) of client documents."""
    shape = r"(query|mutation|subscription)\s+(\w+)\s*(?:\([^)]*\))?\s*\{\s*(?:\w+\s*:\s*)?(\w+)"
    found = files.select("file", F.explode(_found(F.regexp_replace("text", r"#[^\n]*", ""), shape, 0)).alias("o"))
    return found.select("file", *[F.regexp_extract("o", shape, k).alias(m) for k, m in enumerate(("operation", "name", "root"), 1)])


# catalogs


def catalog_entities(files: DataFrame) -> DataFrame:
    """file, kind, name, type, owner, system, lifecycle and depends_on of catalog files: YAML documents of a fixed shape."""
    docs = files.select("file", F.explode(F.split("text", r"(?m)^---\s*$")).alias("d"))
    top = lambda k: F.nullif(F.trim(F.regexp_extract("d", rf"(?m)^{k}:[ \t]*['\"]?([^\n'\"#]+)", 1)), F.lit(""))
    part = lambda b, k: F.nullif(F.trim(F.regexp_extract(F.regexp_extract("d", rf"(?m)^{b}:[ \t]*\n((?:[ \t]+[^\n]*\n?|\n)*)", 1), rf"(?m)^  {k}:[ \t]*['\"]?([^\n'\"#]+)", 1)), F.lit(""))
    needs = _found(F.regexp_extract("d", r"(?m)^  dependsOn:[ \t]*\n((?:    ?[ \t]*-[^\n]*\n?)*)", 1), r"-\s*['\"]?([^\s'\"]+)")
    bare = F.transform(needs, lambda x: F.regexp_replace(F.regexp_replace(x, "^[a-z]+:", ""), "^[^/]+/", ""))
    out = docs.select("file", top("kind").alias("kind"), part("metadata", "name").alias("name"), *[part("spec", k).alias(k) for k in ("type", "owner", "system", "lifecycle")], F.array_join(bare, ",").alias("depends_on"))
    return out.filter("kind IS NOT NULL AND name IS NOT NULL")


# dependencies

DEPENDENCY = "file string, ecosystem string, package string, required string, installed string, is_dev boolean"


def dependencies(files: DataFrame) -> DataFrame:
    """file, ecosystem, package, required, installed and is_dev of manifests and lock files, by their names: package.json,
    package-lock.json, composer.json, yarn.lock, go.mod and requirements.txt."""
    named = lambda name: files.filter(F.col("file").rlike(rf"(^|/){name}$"))
    rows = lambda df, eco, pkg, req, inst, dev: df.select("file", F.lit(eco).alias("ecosystem"), pkg.alias("package"), req.alias("required"), inst.alias("installed"), dev.alias("is_dev"))
    none, out = F.lit(None).cast("string"), []
    for name, eco, sections in ((r"package\.json", "npm", ("dependencies", "devDependencies")), (r"composer\.json", "composer", ("require", "require-dev"))):
        j = named(name).select("file", F.from_json("text", ", ".join(f"`{s}` map<string,string>" for s in sections)).alias("j"))
        for s, dev in zip(sections, (False, True), strict=True):
            out.append(rows(j.select("file", F.explode(F.col("j")[s]).alias("k", "v")), eco, F.col("k"), F.col("v"), none, F.lit(dev)))
    lock = named(r"package-lock\.json").select("file", F.from_json("text", "packages map<string,struct<version:string,dev:boolean>>").alias("j"))
    lock = lock.select("file", F.explode("j.packages").alias("k", "v")).filter(F.contains("k", F.lit("node_modules/")))
    out.append(rows(lock, "npm", F.regexp_extract("k", "node_modules/((?:@[^/]+/)?[^/]+)$", 1), none, F.col("v.version"), F.coalesce("v.dev", F.lit(False))))
    yarn = named(r"yarn\.lock").select("file", F.explode(_found(F.col("text"), r'(?m)^("?[^\s#"][^\n]*:\n  version "[^"]+")')).alias("b"))
    first = F.regexp_extract("b", r'^"?((?:@[^@/]+/)?[^@"]+)@([^,"\n:]+)', 1), F.regexp_extract("b", r'^"?((?:@[^@/]+/)?[^@"]+)@([^,"\n]+?)"?(?:,|:|$)', 2)
    out.append(rows(yarn, "npm", first[0], first[1], F.regexp_extract("b", r'version "([^"]+)"', 1), F.lit(False)))
    go = named(r"go\.mod").select("file", F.explode(_found(F.regexp_replace("text", r"(?m)^(module|go|replace)\s.*$", ""), r"(?m)^\s*(?:require\s+)?([\w./-]+\.[\w./-]+ v[\w.+-]+)")).alias("b"))
    out.append(rows(go, "go", F.substring_index("b", " ", 1), F.substring_index("b", " ", -1), F.substring_index("b", " ", -1), F.lit(False)))
    pip = lines(named(r"requirements[\w.-]*\.txt")).withColumn("b", F.trim(F.regexp_replace("body", r"(#|;).*$", ""))).filter(F.col("b").rlike(r"^[A-Za-z0-9]"))
    shape = r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(.*)$"
    pinned = F.nullif(F.regexp_extract("b", r"==\s*([\w.+-]+)", 1), F.lit(""))
    out.append(rows(pip, "pypi", F.lower(F.regexp_extract("b", shape, 1)), F.nullif(F.regexp_extract("b", shape, 2), F.lit("")), pinned, F.contains("file", F.lit("dev"))))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


# structure: one pattern gives the facts of a kind of file

PLUGINS = {
    "docker-base": (r"(^|/)Dockerfile[^/]*$", r"(?mi)^\s*FROM\s+(?:--\S+\s+)?([^\s]+)"), "docker-stage": (r"(^|/)Dockerfile[^/]*$", r"(?mi)^\s*FROM\s+(?:--\S+\s+)?\S+\s+AS\s+(\S+)"),
    "make-target": (r"(^|/)Makefile$", r"(?m)^([A-Za-z0-9][\w.-]*)\s*:(?!=)"), "action-use": (r"\.github/workflows/[^/]+\.ya?ml$", r"(?m)^\s*-?\s*uses:\s*['\"]?([^\s'\"#]+)"),
    "action-job": (r"\.github/workflows/[^/]+\.ya?ml$", r"(?m)^  ([\w-]+):\s*$"), "gitlab-image": (r"\.gitlab-ci\.yml$", r"(?m)^\s*image:\s*['\"]?([^\s'\"#]+)"), "gitlab-include": (r"\.gitlab-ci\.yml$", r"(?m)^\s*-\s*(?:component|project|local|template):\s*['\"]?([^\s'\"#]+)"),
    "compose-image": (r"(^|/)(docker-)?compose[^/]*\.ya?ml$", r"(?m)^\s+image:\s*['\"]?([^\s'\"#]+)"), "renovate-preset": (r"(^|/)renovate\.json5?$", r'"((?:config|github>|local>)[^"]*)"'),
    "migration-table": (r"(^|/)migrations?/[^/]+\.(php|sql)$", r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?([A-Za-z_][\w.]*)"), "tool-config": (r"(^|/)(\.eslintrc[^/]*|\.prettierrc[^/]*|phpstan\.neon[^/]*|tsconfig\.json|ruff\.toml)$", r"(?s)^()"),
    "messenger-transport": (r"(^|/)messenger\.ya?ml$", r"(?m)^            ([\w-]+):"), "queue-declare": (r"rabbitmq[^/]*\.json$", r'"queues"\s*:\s*\[[^\]]*?"name"\s*:\s*"([^"]+)"'), "helm-value": (r"(^|/)values[^/]*\.ya?ml$", r"(?m)^\s*repository:\s*['\"]?([^\s'\"#]+)"),
}


def structural(files: DataFrame) -> DataFrame:
    """file, kind and name of what the plugins find, each once a file; a plugin is a pattern of file names and one of names in it."""
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), F.when(F.col("file").rlike(glob), F.array_distinct(_found(F.col("text"), pattern))).alias("names")) for kind, (glob, pattern) in PLUGINS.items()])
    each = files.select("file", F.explode(found).alias("f")).filter("f.names IS NOT NULL")
    return each.select("file", "f.kind", F.explode("f.names").alias("name"))


def package_scripts(files: DataFrame) -> DataFrame:
    """file, name and command of package.json scripts."""
    j = files.filter(F.col("file").rlike(r"(^|/)package\.json$")).select("file", F.from_json("text", "scripts map<string,string>").alias("j"))
    return j.select("file", F.explode("j.scripts").alias("name", "command"))


TOPICS = {"testing": r"\btests?\b", "ci-cd": r"\b(ci|pipeline|deploy)", "security": r"\b(security|secret|auth)", "architecture": r"\barchitectur", "developer-experience": r"\b(lint|format|setup|makefile)"}


def agent_configs(files: DataFrame) -> DataFrame:
    """file, topics and fingerprint of agents' instruction files; the fingerprint is that of the text without front matter, comments
    and white space."""
    own = files.filter(F.col("file").rlike(r"(^|/)(AGENTS|CLAUDE|GEMINI)\.md$|\.cursorrules$|\.mdc$|copilot-instructions\.md$|/SKILL\.md$"))
    low = F.lower("text")
    topics = F.array_join(F.filter(F.array(*[F.when(low.rlike(p), F.lit(t)) for t, p in TOPICS.items()]), lambda t: t.isNotNull()), ",")
    bare = F.regexp_replace(low, r"(?s)\A---\n.*?\n---\n|<!--.*?-->|/\*.*?\*/|(?m)^\s*//[^\n]*|\s+", "")
    return own.select("file", topics.alias("topics"), F.left(F.sha2(bare.cast("binary"), 256), F.lit(16)).alias("fingerprint"))


# connections


def env_connections(files: DataFrame) -> DataFrame:
    """file, name, technology, host, port and db of environment files' connection strings; templates give none."""
    v = lines(files.filter(F.col("file").rlike(r"(^|/)\.env[^/]*$"))).select("file", F.regexp_extract("body", r"^\s*(?:export\s+)?([A-Z][A-Z0-9_]*)\s*=", 1).alias("name"), F.regexp_replace(F.regexp_extract("body", r"=\s*(.*?)\s*$", 1), "^[\"']|[\"']$", "").alias("value"))
    return v.filter("name <> ''").select("file", "name", F.explode(F.array(I.dsn(F.col("value")))).alias("d")).filter("d IS NOT NULL").select("file", "name", "d.technology", "d.host", "d.port", "d.db")


def config_connections(files: DataFrame) -> DataFrame:
    """file, technology, host, port and db of configuration arrays and objects, by their keys, in PHP, TypeScript, JSON or YAML."""
    value = lambda *keys: F.nullif(F.regexp_extract("text", rf"(?im)['\"]?\b(?:{'|'.join(keys)})['\"]?\s*(?:=>|:|=)\s*['\"]?([\w.-]+)", 1), F.lit(""))
    found = F.struct(F.regexp_replace(value("driver", "type", "dialect"), "^pdo_", "").alias("technology"), value("host", "hostname").alias("host"), value("port").cast("int").alias("port"), value("dbname", "database", "db_name").alias("db"))
    # generated rows are computed once, while filters would repeat the patterns of a projection
    rows = files.select("file", F.inline(F.array(found))).withColumn("technology", I.technology(F.col("technology")))
    return rows.filter("host IS NOT NULL AND db IS NOT NULL").filter(I.family(F.col("technology")).isNotNull() & ~I.names_no_place(F.col("host")))


# OpenAPI in YAML


def yaml_endpoints(files: DataFrame) -> DataFrame:
    """file, method and path of OpenAPI documents in YAML with paths two blanks in and methods four."""
    rows = lines(files.filter(F.col("text").rlike(r"(?m)^(openapi|swagger):"))).withColumn("path", F.nullif(F.regexp_extract("body", r"^  ['\"]?(/[^'\":]*)['\"]?:\s*$", 1), F.lit("")))
    rows = rows.withColumn("method", F.nullif(F.regexp_extract("body", rf"^    ({METHODS}):\s*$", 1), F.lit(""))).filter("path IS NOT NULL OR method IS NOT NULL")
    from pyspark.sql import Window

    above = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("path", F.last("path", ignorenulls=True).over(above)).filter("method IS NOT NULL AND path IS NOT NULL").select("file", F.upper("method").alias("method"), "path")


# vulnerabilities


def osv_records(files: DataFrame) -> DataFrame:
    """id, aliases, ecosystem, package, introduced, fixed, vector and declared of vulnerability records kept as JSON files: a snapshot
    stands for the service, so that a job needs no network."""
    shape = "id string, aliases array<string>, severity array<struct<type:string,score:string>>, database_specific struct<severity:string>, affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<events:array<map<string,string>>>>>>"
    j = files.select(F.from_json("text", shape).alias("j")).filter("j.id IS NOT NULL")
    vector = F.get(F.filter("j.severity", lambda s: s["type"] == "CVSS_V3"), F.lit(0))["score"]
    each = j.select("j.id", "j.aliases", vector.alias("vector"), F.col("j.database_specific.severity").alias("declared"), F.explode("j.affected").alias("a"))
    events = F.flatten(F.transform("a.ranges", lambda r: r["events"]))
    first = lambda k: F.get(F.filter(F.transform(events, lambda x: x[k]), lambda x: x.isNotNull()), F.lit(0))
    return each.select("id", "aliases", "a.package.ecosystem", F.col("a.package.name").alias("package"), first("introduced").alias("introduced"), first("fixed").alias("fixed"), "vector", "declared")


# sinks


def csv_field(value: Column) -> Column:
    """A value as a CSV field: quoted where it holds a comma, a quote or a line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_rows(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_field(F.col(f"`{c}`")) for c in df.columns]).alias("line"))


def wipe(spark: SparkSession, *paths: str) -> int:
    """Delete snapshots and caches; how many were there."""
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(p.getFileSystem(conf).delete(p, True))
    return gone


def policy_json(violations: DataFrame) -> DataFrame:
    """A line of JSON for each violation, as the machine-readable report."""
    return violations.select(F.to_json(F.struct("rule", "level", "entity", "detail")).alias("line"))


def policy_table(violations: DataFrame) -> DataFrame:
    """A line of text for each violation, as the report for people."""
    return violations.select(F.concat_ws(" | ", F.rpad("level", 8, " "), "rule", "entity", F.coalesce("detail", F.lit(""))).alias("line"))


def routes(files: DataFrame) -> DataFrame:
    """file, method and path of route declarations: calls and decorators of a router, attributes and mapping annotations."""
    call = rf"(?:\b|@)(?:router|app|server|api|route)\.({METHODS})\(\s*['\"](/[^'\"]*)['\"]"
    attribute = r"#\[Route\(\s*['\"](/[^'\"]*)['\"][^\]]*?methods:\s*\[\s*['\"]([A-Z]+)['\"]"
    mapping = r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*)?['\"](/[^'\"]*)['\"]"
    pairs = lambda p, m, u: F.arrays_zip(_found(F.col("text"), p, m).alias("m"), _found(F.col("text"), p, u).alias("u"))
    found = F.concat(*[F.transform(pairs(p, m, u), lambda x: F.struct(F.upper(x["m"]).alias("method"), x["u"].alias("path"))) for p, m, u in ((call, 1, 2), (attribute, 2, 1), (mapping, 1, 2))])
    return files.select("file", F.explode(found).alias("r")).select("file", "r.method", "r.path")
