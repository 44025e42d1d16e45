"""Registered queries on the parsers of estate files: each part of the tables gives one small file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import parsers as P
from .catalog import n, query
from .estate import Estate


def files(e: Estate, name: str, text: str) -> DataFrame:
    """One file for each part: {k}, {z} and {t} in name and text stand for its key, size and type.

    A part is a few bytes and its file takes long to parse, so parts are dealt out before."""
    def filled(s: str):
        out = F.lit(s)
        for mark, col in (("{k}", "p_partkey"), ("{z}", "p_size"), ("{t}", "p_type")):
            out = F.replace(out, F.lit(mark), F.col(col).cast("string"))
        return out

    p = e.table("part").select("p_partkey", "p_size", "p_type")
    return e.dealt(p, "p_partkey", size=1 << 16, tables=("part",)).select(filled(name).alias("file"), filled(text).alias("text"))


_AVRO = '{"type":"record","name":"R{k}","fields":[{"name":"id","type":"string"},{"name":"a{z}","type":["null",{"type":"bytes","logicalType":"decimal"}]},{"name":"in","type":{"type":"record","name":"I","fields":[{"name":"x","type":{"type":"array","items":"I"}}]}},{"name":"m","type":{"type":"map","values":"long"}}]}'


@query("a6_avro_fields", "SELECT 'R' || p_partkey AS record, unnest(['id', 'a' || p_size, 'in', 'in.x', 'm']) AS field, unnest(['string', 'bytes', 'record', 'array<record>', 'map<long>']) AS type, unnest([NULL, 'decimal', NULL, NULL, NULL]) AS logical, unnest([false, true, false, false, false]) AS nullable FROM part WHERE p_partkey % 5 <> 0", ctes=False)
def avro_fields(e: Estate) -> DataFrame:
    """Fields of schema files, every fifth of which is broken."""
    whole = files(e, "{k}.avsc", _AVRO).withColumn("text", F.when(F.regexp_extract("file", r"^(\d+)", 1).cast("long") % 5 == 0, F.lit("{")).otherwise(F.col("text")))
    return P.avro_fields(whole).drop("file")


_SDL = '# type No {\n"""doc { x: Y }"""\ntype T{k} implements N {\n  id: ID!\n  "d" items{z}(first: Int): [Item!]!\n}\ninput I{k} { a: String }\nextend type Query { t{k}: T{k} }\n'


@query("a8_graphql_fields", "SELECT p_partkey || '.graphql' AS file, unnest(['type', 'type', 'input', 'type']) AS kind, unnest(['T' || p_partkey, 'T' || p_partkey, 'I' || p_partkey, 'Query']) AS type, unnest(['id', 'items' || p_size, 'a', 't' || p_partkey]) AS field, unnest(['ID!', '[Item!]!', 'String', 'T' || p_partkey]) AS returns FROM part", ctes=False)
def graphql_fields(e: Estate) -> DataFrame:
    return P.graphql_fields(files(e, "{k}.graphql", _SDL))


@query("a8_graphql_operations", "SELECT p_partkey || '.gql' AS file, unnest(['query', 'mutation']) AS operation, unnest(['Get' || p_partkey, 'Set']) AS name, unnest(['item', 'save' || p_size]) AS root FROM part", ctes=False)
def graphql_operations(e: Estate) -> DataFrame:
    return P.graphql_operations(files(e, "{k}.gql", "query Get{k}($a: ID!) {\n  x: item(id: $a) { id }\n}\n# query No { a }\nmutation Set { save{z} { ok } }"))


_CATALOG = "apiVersion: v1\nkind: Component\nmetadata:\n  name: svc-{k}\n  title: x\nspec:\n  type: service\n  owner: team-{z}\n  lifecycle: production\n  dependsOn:\n    - component:default/other-{z}\n    - resource:db\n---\nkind: System\nmetadata:\n  name: 'sys-{k}'\nspec:\n  owner: \"group:x\"\n---\nnothing: here\n"


@query(
    "a10_catalog_entities",
    "SELECT p_partkey || '.yaml' AS file, unnest(['Component', 'System']) AS kind, unnest(['svc-' || p_partkey, 'sys-' || p_partkey]) AS name, unnest(['service', NULL]) AS type, unnest(['team-' || p_size, 'group:x']) AS owner, unnest([NULL::VARCHAR, NULL]) AS system, unnest(['production', NULL]) AS lifecycle, unnest(['other-' || p_size || ',db', '']) AS depends_on FROM part",
    ctes=False,
)
def catalog_entities(e: Estate) -> DataFrame:
    return P.catalog_entities(files(e, "{k}.yaml", _CATALOG))


@query(
    "a11_dependencies",
    """SELECT ecosystem, package, required, installed, is_dev, count(*) AS n FROM (
      SELECT 'npm' AS ecosystem, 'lib' || p_size AS package, '^1.' || p_size AS required, NULL AS installed, false AS is_dev FROM part UNION ALL SELECT 'npm', '@o/dev', '2', NULL, true FROM part
      UNION ALL SELECT 'npm', '@o/lib', NULL, '1.' || p_size || '.0', true FROM part UNION ALL SELECT 'npm', 'y' || p_size, '^3.0.0', '3.1.' || p_size, false FROM part UNION ALL SELECT 'npm', '@s/z', '1 || 2', '2.0.0', false FROM part
      UNION ALL SELECT 'go', 'github.com/a/b' || p_size, 'v1.2.3', 'v1.2.3', false FROM part UNION ALL SELECT 'go', 'x.org/y', 'v0.0.1', 'v0.0.1', false FROM part
      UNION ALL SELECT 'pypi', 'flask', '==2.' || p_size, '2.' || p_size, false FROM part UNION ALL SELECT 'pypi', 'uvicorn', '>=0.1', NULL, false FROM part UNION ALL SELECT 'composer', 'v/p', '^' || p_size, NULL, false FROM part) GROUP BY ALL""",
    ctes=False,
)
def dependencies(e: Estate) -> DataFrame:
    """Dependencies of six kinds of manifests and lock files."""
    sets = [
        ("r{k}/package.json", '{"dependencies":{"lib{z}":"^1.{z}"},"devDependencies":{"@o/dev":"2"}}'), ("r{k}/package-lock.json", '{"packages":{"":{"version":"1"},"node_modules/@o/lib":{"version":"1.{z}.0","dev":true}}}'),
        ("r{k}/yarn.lock", '# yarn lockfile v1\n\ny{z}@^3.0.0:\n  version "3.1.{z}"\n  resolved "u"\n\n"@s/z@1 || 2", "@s/z@^2":\n  version "2.0.0"\n'), ("r{k}/go.mod", "module m.org/x\n\ngo 1.21\n\nrequire github.com/a/b{z} v1.2.3\n\nrequire (\n\tx.org/y v0.0.1 // indirect\n)\n"),
        ("r{k}/requirements.txt", "# c\nFlask==2.{z} # x\n-r other.txt\nuvicorn[standard] >=0.1; python_version > '3'\n"), ("r{k}/composer.json", '{"require":{"v/p":"^{z}"}}'), ("r{k}/other.json", "{}"),
    ]
    whole = files(e, *sets[0])
    for s in sets[1:]:
        whole = whole.unionByName(files(e, *s))
    return P.dependencies(whole).groupBy("ecosystem", "package", "required", "installed", "is_dev").agg(n().alias("n"))


@query(
    "a12_structure",
    "SELECT kind, name, count(*) AS n FROM (SELECT unnest(['docker-base', 'docker-base', 'docker-stage', 'make-target', 'make-target', 'action-use', 'action-job', 'gitlab-image', 'gitlab-include', 'migration-table']) AS kind, unnest(['node:' || p_size, 'alpine', 'b', 'test', 'run-' || p_size, 'actions/checkout@v4', 'build', 'php:8', 'g/c@1', 'orders_' || p_size]) AS name FROM part) GROUP BY ALL",
    ctes=False,
)
def structure(e: Estate) -> DataFrame:
    """Facts of build and deployment files, by the plugins' patterns."""
    sets = [
        ("r{k}/Dockerfile", "FROM --platform=x node:{z} AS b\nRUN x\nFROM alpine\n"), ("r{k}/Makefile", "A := 1\ntest: x\n\tgo\nrun-{z}:\n"), ("r{k}/.github/workflows/ci.yml", "on: push\njobs:\n  build:\n    steps:\n      - uses: actions/checkout@v4\n"),
        ("r{k}/.gitlab-ci.yml", "include:\n  - component: g/c@1\nt:\n  image: 'php:8'\n"), ("r{k}/migrations/V1.sql", "create table if not exists `orders_{z}` (id int);"), ("r{k}/README.md", "FROM nothing"),
    ]
    whole = files(e, *sets[0])
    for s in sets[1:]:
        whole = whole.unionByName(files(e, *s))
    return P.structural(whole).groupBy("kind", "name").agg(n().alias("n"))


@query(
    "a12_agent_configs",
    "SELECT 'r' || p_partkey || '/AGENTS.md' AS file, CASE WHEN p_size % 2 = 0 THEN 'testing,security' ELSE 'security' END AS topics, left(sha256('usesecrets' || p_size || CASE WHEN p_size % 2 = 0 THEN 'runtests.' ELSE '' END), 16) AS fingerprint FROM (SELECT * FROM part)",
    ctes=False,
)
def agent_configs(e: Estate) -> DataFrame:
    own = files(e, "r{k}/AGENTS.md", "---\nname: x\n---\nUse Secrets  {z}\n<!-- Tests -->").withColumn("z", F.regexp_extract("text", r"Secrets  (\d+)", 1).cast("int"))
    text = F.when(F.col("z") % 2 == 0, F.concat("text", F.lit("\nRun tests."))).otherwise(F.replace("text", F.lit("<!-- Tests -->"), F.lit("<!-- x -->")))
    return P.agent_configs(own.select("file", text.alias("text")))


@query("a14_env_connections", "SELECT 'r' || p_partkey || '/.env' AS file, unnest(['DB_URL', 'CACHE']) AS name, unnest(['postgres', 'redis']) AS technology, unnest(['h' || p_size, 'r.x']) AS host, unnest([5433, 6380]) AS port, unnest(['shop', '0']) AS db FROM part", ctes=False)
def env_connections(e: Estate) -> DataFrame:
    return P.env_connections(files(e, "r{k}/.env", "# c\nexport DB_URL=\"postgres://u:p@h{z}:5433/shop\"\nCACHE=redis://r.x:6380\nT=mysql://${H}/x\nN=5\n"))


@query("a14_config_connections", "SELECT 'r' || p_partkey || '/db.php' AS file, 'mysql' AS technology, 'db' || p_size || '.x' AS host, 3307 AS port, 'shop' AS db FROM part", ctes=False)
def config_connections(e: Estate) -> DataFrame:
    return P.config_connections(files(e, "r{k}/db.php", "return ['driver' => 'pdo_mysql', 'host' => 'db{z}.x', 'port' => 3307, 'dbname' => 'shop'];"))


@query("a7_yaml_endpoints", "SELECT 'r' || p_partkey || '/api.yaml' AS file, unnest(['GET', 'POST', 'GET']) AS method, unnest(['/v' || p_size, '/v' || p_size, '/w/{id}']) AS path FROM part", ctes=False)
def yaml_endpoints(e: Estate) -> DataFrame:
    return P.yaml_endpoints(files(e, "r{k}/api.yaml", "openapi: 3.0.0\npaths:\n  /v{z}:\n    get:\n      x: y\n    post:\n  '/w/{id}':\n    parameters: []\n    get:\n"))


_OSV = '{"id":"GHSA-{k}","aliases":["CVE-{k}"],"severity":[{"type":"CVSS_V3","score":"CVSS:3.1/AV:N"}],"database_specific":{"severity":"HIGH"},"affected":[{"package":{"ecosystem":"npm","name":"p{z}"},"ranges":[{"events":[{"introduced":"0"},{"fixed":"1.{z}.0"}]}]}]}'


@query("a15_osv_records", "SELECT 'GHSA-' || p_partkey AS id, 'CVE-' || p_partkey AS alias, 'npm' AS ecosystem, 'p' || p_size AS package, '0' AS introduced, '1.' || p_size || '.0' AS fixed, 'CVSS:3.1/AV:N' AS vector, 'HIGH' AS declared FROM part", ctes=False)
def osv_records(e: Estate) -> DataFrame:
    return P.osv_records(files(e, "{k}.json", _OSV)).withColumn("alias", F.get("aliases", F.lit(0))).drop("aliases")


@query("a9_code_owners", "SELECT line, pattern, team, count(*) AS n FROM (SELECT unnest([2, 3]) AS line, unnest(['*', '/svc/' || p_size]) AS pattern, unnest(['core', 'pay' || p_size % 3]) AS team FROM part) GROUP BY ALL", ctes=False)
def code_owners(e: Estate) -> DataFrame:
    text = files(e, "r{k}/CODEOWNERS", "# all\n* @o/core\n/svc/{z} @o/payX @ann # y\n").withColumn("text", F.expr("replace(text, 'payX', concat('pay', cast(regexp_extract(text, 'svc/([0-9]+)', 1) AS int) % 3))"))
    bare = P.lines(text).withColumn("body", F.trim(F.regexp_replace("body", r"(^|\s)#.*$", ""))).filter("body <> ''")
    words = F.split("body", r"\s+")
    return bare.groupBy("line", F.get(words, F.lit(0)).alias("pattern"), F.substring_index(F.get(words, F.lit(1)), "/", -1).alias("team")).agg(n().alias("n"))


@query("a21_csv_rows", r'''SELECT p_partkey || ',' || CASE p_partkey % 3 WHEN 0 THEN '"a,b"' WHEN 1 THEN '"say ""x"""' ELSE p_name END || ',' AS line FROM part''', ctes=False)
def csv_rows(e: Estate) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, "a,b").when(F.col("p_partkey") % 3 == 1, 'say "x"').otherwise(F.col("p_name"))
    return P.csv_rows(e.table("part").select("p_partkey", text.alias("t"), F.lit(None).cast("string").alias("e")))


def _violations(e: Estate) -> DataFrame:
    return e.table("part").filter("p_size > 45").select(F.concat(F.lit("rule-"), (F.col("p_size") % 3).cast("string")).alias("rule"), F.when(F.col("p_size") % 2 == 0, "error").otherwise("warning").alias("level"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity"), F.col("p_name").alias("detail"))


_V = "SELECT 'rule-' || p_size % 3 AS rule, CASE WHEN p_size % 2 = 0 THEN 'error' ELSE 'warning' END AS level, 'part:' || p_partkey AS entity, p_name AS detail FROM part WHERE p_size > 45"


@query("a20_policy_json", f"""SELECT '{{"rule":"' || rule || '","level":"' || level || '","entity":"' || entity || '","detail":"' || detail || '"}}' AS line FROM ({_V})""", ctes=False)
def policy_json(e: Estate) -> DataFrame:
    return P.policy_json(_violations(e))


@query("a20_policy_table", f"SELECT rpad(level, 8, ' ') || ' | ' || rule || ' | ' || entity || ' | ' || detail AS line FROM ({_V})", ctes=False)
def policy_table(e: Estate) -> DataFrame:
    return P.policy_table(_violations(e))


@query(
    "a20_policy_sarif",
    f"""SELECT rule, entity, '{{"ruleId":"' || rule || '","level":"' || level || '","message":{{"text":"' || detail || '"}},"locations":[{{"logicalLocations":[{{"fullyQualifiedName":"' || entity || '"}}]}}]}}' AS result FROM ({_V})""",
    ctes=False,
)
def policy_sarif(e: Estate) -> DataFrame:
    from ..sources.files import sarif

    return sarif(_violations(e))
