"""Registered queries on identities: paths, URLs, stores, channels, teams, each over names that a table's columns make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import scalars as S
from .catalog import n, query
from .estate import Estate

#: Paths of pages and parts in many spellings.
_PATHS = """x AS (SELECT p_partkey AS k, CASE p_partkey % 12 WHEN 0 THEN '/api/v1/users/:id' WHEN 1 THEN '/api/V2/' WHEN 2 THEN '{baseUrl}/x' WHEN 3 THEN '/{a}/:b/' WHEN 4 THEN 'orders//' || p_size || '/' WHEN 5 THEN 'GRAPHQL q'
  WHEN 6 THEN '/A/{userId}/Bc' WHEN 7 THEN 'https://h.x/p/' || p_size || '?q=1' WHEN 8 THEN '/' WHEN 9 THEN '/t/550e8400-e29b-41d4-a716-446655440000/${z}' WHEN 10 THEN '/v/deadbeefdeadbeefdeadbeef/e.f' ELSE 'DYNAMIC' END AS path FROM part)"""


def _paths(e: Estate) -> DataFrame:
    k = F.col("p_partkey") % 12
    lits = {0: "/api/v1/users/:id", 1: "/api/V2/", 2: "{baseUrl}/x", 3: "/{a}/:b/", 5: "GRAPHQL q", 6: "/A/{userId}/Bc", 8: "/", 9: "/t/550e8400-e29b-41d4-a716-446655440000/${z}", 10: "/v/deadbeefdeadbeefdeadbeef/e.f"}
    z = F.col("p_size").cast("string")
    path = I.looked_up(k, lits, F.when(k == 4, F.concat(F.lit("orders//"), z, F.lit("/"))).when(k == 7, F.concat(F.lit("https://h.x/p/"), z, F.lit("?q=1"))).otherwise("DYNAMIC"))
    return e.table("part").select(F.col("p_partkey").alias("k"), path.alias("path"))


_TIDY = "regexp_replace(regexp_replace('/' || {0}, '/+', '/', 'g'), '(.)/$', '\\1')"
_DYN = r"(path IN ('DYNAMIC', '{baseUrl}/x', '/{a}/:b/'))"


@query(
    "i2_match_path",
    f"WITH {_PATHS} SELECT k, CASE WHEN starts_with(path, 'GRAPHQL') THEN path WHEN NOT {_DYN} THEN "
    + _TIDY.format(r"regexp_replace(regexp_replace(regexp_replace(path, '(?i)^/api(/v\d+)?(/|$)', '/'), ':([a-zA-Z0-9_]+)', '{\1}', 'g'), '\{[^}]+\}', '{param}', 'g')")
    + " END AS path FROM x",
    ctes=False,
)
def match_paths(e: Estate) -> DataFrame:
    return _paths(e).select("k", I.match_path(F.col("path")).alias("path"))


@query(
    "i2_kept_path",
    f"WITH {_PATHS} SELECT k, CASE WHEN starts_with(path, 'GRAPHQL') THEN path WHEN NOT {_DYN} THEN " + _TIDY.format(r"regexp_replace(regexp_replace(regexp_replace(path, '^https?://[^/]+', ''), '[?#].*$', ''), ':([a-zA-Z0-9_]+)', '{\1}', 'g')") + " END AS path FROM x",
    ctes=False,
)
def kept_paths(e: Estate) -> DataFrame:
    return _paths(e).select("k", I.kept_path(F.col("path")).alias("path"))


@query(
    "f6_endpoint_survivor",
    f"""WITH {_PATHS}, s AS (SELECT k, path, unnest(string_split(path, '/')) AS s, generate_subscripts(string_split(path, '/'), 1) AS i FROM x),
    c AS (SELECT k, path, string_agg(CASE WHEN regexp_full_match(s, '(:.*|\\$.*|\\{{.*\\}}|\\d+|[0-9a-f]{{24,}}|550e8400.*)') THEN '{{param}}' ELSE lower(s) END, '/' ORDER BY i) AS j, count(*) FILTER (starts_with(s, '{{') OR starts_with(s, ':')) AS t FROM s GROUP BY k, path),
    g AS (SELECT k, t, CASE WHEN starts_with(path, 'GRAPHQL') THEN path ELSE {_TIDY.format('j')} END AS canon FROM c)
    SELECT canon, arg_min(k, (-t, k)) AS survivor, count(*) AS members FROM g GROUP BY canon HAVING count(*) > 1""",
    ctes=False,
)
def endpoint_survivor(e: Estate) -> DataFrame:
    """Of endpoints with one canonical path the most templated survives, then the smallest id."""
    p = _paths(e).select("k", I.dedup_path(F.col("path")).alias("canon"), I.template_score(F.col("path")).alias("t"))
    return p.groupBy("canon").agg(F.min_by("k", F.struct(-F.col("t"), "k")).alias("survivor"), n().alias("members")).filter("members > 1")


@query(
    "l3_template_match",
    r"""WITH t AS (SELECT DISTINCT '/' || split_part(p_type, ' ', 1) || CASE WHEN p_size % 3 = 0 THEN '/{id}' WHEN p_size % 3 = 1 THEN '/{id}/items' ELSE '/{a}/{b}' END AS tpl FROM part),
    x AS (SELECT p_partkey AS k, '/' || split_part(p_type, ' ', 1) || '/' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '/items' END AS path FROM part),
    m AS (SELECT k, tpl, length(tpl) - length(replace(tpl, '{', '')) AS params FROM x JOIN t ON split_part(tpl, '/', 2) = split_part(path, '/', 2) AND length(tpl) - length(replace(tpl, '/', '')) = length(path) - length(replace(path, '/', ''))
      AND (NOT ends_with(tpl, '/items') OR ends_with(path, '/items')))
    SELECT k, arg_min(tpl, (params, tpl)) AS tpl FROM m GROUP BY k""",
    ctes=False,
)
def template_match(e: Estate) -> DataFrame:
    """The template of fewest parameters that a path matches. Both sides meet by first segment and length, so few are compared."""
    first = F.substring_index("p_type", " ", 1)
    tail = F.when(F.col("p_size") % 3 == 0, "/{id}").when(F.col("p_size") % 3 == 1, "/{id}/items").otherwise("/{a}/{b}")
    t = e.table("part").select(F.concat(F.lit("/"), first, tail).alias("tpl")).distinct()
    x = e.table("part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("/"), first, F.lit("/"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("/items")).alias("path"))
    key = lambda c: F.struct(F.get(F.split(c, "/"), F.lit(1)).alias("first"), F.size(F.split(c, "/")).alias("size"))
    t = t.withColumn("key", key("tpl")).withColumn("regex", I.path_regex(F.col("tpl")))
    m = x.withColumn("key", key("path")).join(t, "key").filter(F.regexp_like("path", F.col("regex")))
    return m.groupBy("k").agg(F.min_by("tpl", F.struct(F.length("tpl") - F.length(F.replace("tpl", F.lit("{"), F.lit(""))), "tpl")).alias("tpl"))


@query(
    "i3_base_urls",
    """WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'HTTPS://User:pw@Host' || page_id || '.x:443/a/b//?q#f' WHEN 2 THEN 'http://h:8080' WHEN 3 THEN ' Not A URL ' ELSE 'http://h:80/api' END AS url FROM pages)
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') WHEN 1 THEN 'https://host' || page_id || '.x/a/b' WHEN 2 THEN 'http://h:8080' WHEN 3 THEN 'not a url' ELSE 'http://h/api' END AS canonical,
      CASE page_id % 5 WHEN 0 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') || '/api/x' WHEN 1 THEN 'https://host' || page_id || '.x/a/b/api/x' WHEN 2 THEN 'http://h:8080/api/x' WHEN 3 THEN ' Not A URL /api/x' ELSE 'http://h/api/x' END AS joined FROM u""",
    ctes=False,
)
def base_urls(e: Estate) -> DataFrame:
    k = F.col("page_id") % 5
    url = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("HTTPS://User:pw@Host"), F.col("page_id").cast("string"), F.lit(".x:443/a/b//?q#f"))).when(k == 2, "http://h:8080").when(k == 3, " Not A URL ").otherwise("http://h:80/api")
    u = e.table("pages").select("page_id", url.alias("url"))
    u = u.withColumn("p", I.base_url(F.col("url")))
    return u.select("page_id", I.canonical_url(F.col("url"), F.col("p")).alias("canonical"), I.joined_url(F.col("url"), F.col("p"), F.lit("api/x")).alias("joined"))


_DSN = ("postgres://u:p@DB{k}.x:5433/shop?schema=s", "mysql://h{k}/a/b", "jdbc:mariadb://h{k}:3307/m;x=1", "redis://h{k}", "memcached://h{k}", "mongodb://${HOST}/x", "ftp://h{k}/x", "amqp://u@h{k}:5672/v", "jdbc:redis://h{k}")


@query(
    "i4_dsn",
    """SELECT p_partkey AS k, CASE z WHEN 0 THEN 'postgres' WHEN 1 THEN 'mysql' WHEN 2 THEN 'mysql' WHEN 3 THEN 'redis' WHEN 4 THEN 'memcached' WHEN 7 THEN 'rabbitmq' END AS technology, CASE WHEN z IN (5, 6, 8) THEN NULL WHEN z = 0 THEN 'DB' || p_partkey || '.x' ELSE 'h' || p_partkey END AS host,
    CASE z WHEN 0 THEN 5433 WHEN 2 THEN 3307 WHEN 4 THEN 11211 WHEN 7 THEN 5672 END AS port, CASE z WHEN 0 THEN 'shop' WHEN 1 THEN 'a' WHEN 2 THEN 'm' WHEN 3 THEN '0' WHEN 4 THEN 'memcached' WHEN 7 THEN 'v' END AS db FROM (SELECT *, p_partkey % 9 AS z FROM part)""",
    ctes=False,
)
def dsns(e: Estate) -> DataFrame:
    text = F.get(F.array(*[F.lit(d) for d in _DSN]), (F.col("p_partkey") % 9).cast("int"))
    d = e.table("part").select(F.col("p_partkey").alias("k"), F.replace(text, F.lit("{k}"), F.col("p_partkey").cast("string")).alias("text"))
    return d.withColumn("d", I.dsn(F.col("text"))).select("k", "d.technology", "d.host", "d.port", "d.db")


@query(
    "i5_fingerprints",
    """WITH x AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'MariaDB' WHEN 1 THEN 'psql' WHEN 2 THEN 'redis' WHEN 3 THEN 'unknown' WHEN 4 THEN 'kafka' ELSE 's3' END AS t, CASE WHEN p_partkey % 7 = 0 THEN 'localhost' WHEN p_partkey % 11 = 0 THEN 'changeme' ELSE 'H' || p_size || '.X.' END AS h, p_size % 2 * 9000 AS port, '/Db' || p_size || '/' AS d FROM part),
    y AS (SELECT *, CASE t WHEN 'MariaDB' THEN 'mysql' WHEN 'psql' THEN 'postgres' ELSE t END AS tech FROM x),
    z AS (SELECT *, CASE WHEN tech IN ('mysql', 'postgres') THEN 'rdbms' WHEN tech = 'redis' THEN 'kv' WHEN tech = 'kafka' THEN 'broker' WHEN tech = 's3' THEN 'object' END AS family,
      CASE WHEN port > 0 THEN port ELSE CASE tech WHEN 'mysql' THEN 3306 WHEN 'postgres' THEN 5432 WHEN 'redis' THEN 6379 WHEN 'kafka' THEN 9092 WHEN 's3' THEN 443 END END AS prt FROM y)
    SELECT k, family, CASE WHEN family IS NOT NULL AND h LIKE 'H%' THEN left(sha256(family || '|' || tech || '|' || lower(rtrim(h, '.')) || ':' || prt || '|' || lower(trim(d, '/')) || '|'), 16) END AS fingerprint FROM z""",
    ctes=False,
)
def fingerprints(e: Estate) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    tech = I.looked_up(k % 6, {0: "MariaDB", 1: "psql", 2: "redis", 3: "unknown", 4: "kafka"}, F.lit("s3"))
    host = F.when(k % 7 == 0, "localhost").when(k % 11 == 0, "changeme").otherwise(F.concat(F.lit("H"), z.cast("string"), F.lit(".X.")))
    x = e.table("part").select(k.alias("k"), I.technology(tech).alias("tech"), host.alias("host"), (z % 2 * 9000).alias("port"), F.concat(F.lit("/Db"), z.cast("string"), F.lit("/")).alias("db"))
    return x.select("k", I.family(F.col("tech")).alias("family"), I.fingerprint(F.col("tech"), F.col("host"), F.col("port"), F.col("db")).alias("fingerprint"))


@query("c15_unbindable_hosts", "SELECT p_partkey AS k, p_partkey % 6 IN (0, 1, 2, 3) AS unusable, p_partkey % 6 IN (0, 1, 2) AS nowhere FROM part", ctes=False)
def unbindable_hosts(e: Estate) -> DataFrame:
    host = I.looked_up(F.col("p_partkey") % 6, {0: "  ", 1: "Your-Host", 2: "${DB}.x", 3: "LOCALHOST", 4: "db.example"}, F.lit("10.0.0.1"))
    x = e.table("part").select(F.col("p_partkey").alias("k"), host.alias("h"))
    return x.select("k", I.unusable_host(F.col("h")).alias("unusable"), I.names_no_place(F.col("h")).alias("nowhere"))


@query("i6_technology_families", "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'timeseries' WHEN 2 THEN 'queue' WHEN 3 THEN 'broker' END AS family FROM part", ctes=False)
def technology_families(e: Estate) -> DataFrame:
    t = I.looked_up(F.col("p_partkey") % 5, {0: " Mongo ", 1: "influxdb", 2: "SQS", 3: "gcp-pubsub"}, F.lit("abacus"))
    return e.table("part").select(F.col("p_partkey").alias("k"), I.technology(t).alias("t")).select("k", I.family(F.col("t")).alias("family"))


@query("i7_table_scopes", "SELECT p_partkey AS k, CASE WHEN p_name ILIKE 'a%' THEN 'first' WHEN p_name ILIKE '%n' THEN 'second' WHEN p_name ILIKE '%re%' THEN 'third' ELSE 'repo' END AS scope FROM part", ctes=False)
def table_scopes(e: Estate) -> DataFrame:
    """The first configured store one of whose patterns matches, else the repository."""
    scope = F.lit("repo")
    for pattern, store in (("*Re*", "third"), ("*n", "second"), ("A*", "first")):
        scope = F.when(I.glob_matches(F.lit(pattern), F.col("p_name")), store).otherwise(scope)
    return e.table("part").select(F.col("p_partkey").alias("k"), scope.alias("scope"))


@query(
    "i8_topic_patterns",
    """WITH x AS (SELECT p_partkey AS k, p_size % 5 AS b, CASE p_partkey % 4 WHEN 0 THEN 'acme.order' WHEN 1 THEN 'acme.order.new' WHEN 2 THEN 'acme.order.new.eu' ELSE 'zacme.xorder' END AS topic FROM part)
    SELECT k, CASE b WHEN 0 THEN topic IN ('acme.order', 'acme.order.new', 'acme.order.new.eu') WHEN 1 THEN topic = 'acme.order.new' WHEN 2 THEN topic IN ('acme.order') WHEN 3 THEN true ELSE topic = 'acme.order.new.eu' END AS bound FROM x""",
    ctes=False,
)
def topic_patterns(e: Estate) -> DataFrame:
    binding = I.looked_up(F.col("p_size") % 5, {0: "acme.order.#", 1: "acme.*.new", 2: "#.acme.order", 3: "#"}, F.lit("*.order.*.eu"))
    topic = I.looked_up(F.col("p_partkey") % 4, {0: "acme.order", 1: "acme.order.new", 2: "acme.order.new.eu"}, F.lit("zacme.xorder"))
    return e.table("part").select(F.col("p_partkey").alias("k"), F.regexp_like(topic, I.topic_regex(binding)).alias("bound"))


@query("i9_placeholders", "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'orders.new' WHEN 1 THEN 'q' WHEN 4 THEN 'a_b' END AS name FROM part", ctes=False)
def placeholders(e: Estate) -> DataFrame:
    stub = I.looked_up(F.col("p_partkey") % 5, {0: "orders.{env}.new", 1: "{stage}.q", 2: "plain.name", 3: "{env}.{tenant}.q"}, F.lit("a_%env%_b"))
    return e.table("part").select(F.col("p_partkey").alias("k"), I.without_placeholders(stub).alias("name"))


@query(
    "i11_team_matches",
    """WITH t AS (SELECT lower(r_name) AS team FROM region UNION ALL SELECT 'core-' || lower(r_name) FROM region), p AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'it-' || lower(r_name) WHEN 1 THEN r_name || '/squad' WHEN 2 THEN 'x-' || lower(r_name) || '-v2' WHEN 3 THEN 'a_core-' || lower(r_name) ELSE lower(r_name) || 'x' END AS phantom
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    m AS (SELECT k, team FROM p JOIN t ON lower(phantom) = team OR regexp_matches(lower(phantom), '[-/_]' || team || '$') OR regexp_matches(lower(phantom), '^' || team || '[-/_]') OR (length(team) > 4 AND (contains(lower(phantom), '-' || team || '-') OR contains(lower(phantom), '/' || team || '/') OR contains(lower(phantom), '_' || team || '_'))))
    SELECT k, arg_max(team, (length(team), team)) AS team FROM m GROUP BY k""",
    ctes=False,
)
def team_matches(e: Estate) -> DataFrame:
    """The longest known team that a phantom owner's name holds. Teams are a dimension of fixed size, ten rows."""
    r = e.table("region").select(F.col("r_regionkey").alias("rk"), F.lower("r_name").alias("r"), "r_name")
    teams = F.broadcast(r.select(F.col("r").alias("team")).unionByName(r.select(F.concat(F.lit("core-"), "r").alias("team"))))
    place = F.broadcast(e.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("rk")).join(r, "rk"))
    k = F.col("s_suppkey") % 5
    phantom = F.when(k == 0, F.concat(F.lit("it-"), "r")).when(k == 1, F.concat("r_name", F.lit("/squad"))).when(k == 2, F.concat(F.lit("x-"), "r", F.lit("-v2"))).when(k == 3, F.concat(F.lit("a_core-"), "r")).otherwise(F.concat("r", F.lit("x")))
    p = e.table("supplier").join(place, "s_nationkey").select(F.col("s_suppkey").alias("k"), phantom.alias("phantom"))
    return p.join(teams, I.team_in(F.col("phantom"), F.col("team"))).groupBy("k").agg(F.max_by("team", F.struct(F.length("team"), "team")).alias("team"))


@query(
    "e34_ownership_discrepancies",
    """WITH f AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN NULL ELSE 'Team-' || p_type END AS a, CASE p_partkey % 6 WHEN 0 THEN 'x' WHEN 1 THEN 'team-' || lower(p_type) WHEN 2 THEN lower(p_type) WHEN 3 THEN 'squad-' || p_type WHEN 4 THEN 'other one' ELSE NULL END AS b FROM part)
    SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a IS NULL OR b IS NULL THEN 'orphan' WHEN lower(a) = lower(b) THEN 'same' WHEN contains(lower(a), lower(b)) OR contains(lower(b), lower(a)) OR levenshtein(lower(a), lower(b)) < 3
      OR regexp_replace(lower(a), '^(team|squad|guild|tribe)-', '') = regexp_replace(lower(b), '^(team|squad|guild|tribe)-', '') THEN 'drift' ELSE 'conflict' END AS kind FROM f) GROUP BY kind""",
    ctes=False,
)
def ownership_discrepancies(e: Estate) -> DataFrame:
    """Owners of a catalog and of a code-owners file: none on a side, equal, one team under two names, or two teams."""
    k = F.col("p_partkey") % 6
    a = F.when(k != 0, F.concat(F.lit("Team-"), "p_type"))
    b = F.when(k == 0, "x").when(k == 1, F.concat(F.lit("team-"), F.lower("p_type"))).when(k == 2, F.lower("p_type")).when(k == 3, F.concat(F.lit("squad-"), "p_type")).when(k == 4, "other one")
    f = e.table("part").select(a.alias("a"), b.alias("b"))
    kind = F.when(F.col("a").isNull() | F.col("b").isNull(), "orphan").when(F.lower("a") == F.lower("b"), "same").when(I.drifted(F.col("a"), F.col("b")), "drift").otherwise("conflict")
    return f.groupBy(kind.alias("kind")).agg(n().alias("n"))


@query("i13_class_bases", r"SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'order' || p_size WHEN 1 THEN 'updatesave' END AS base, 'postv' || p_size || 'items' AS squashed FROM part", ctes=False)
def class_bases(e: Estate) -> DataFrame:
    z = F.col("p_size").cast("string")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Billing\\Order_"), z, F.lit("Controller.handle"))).when(F.col("p_partkey") % 4 == 1, "UpdateSaveCommand.execute").when(F.col("p_partkey") % 4 == 2, "Utility.parseXml").otherwise("some_function")
    return e.table("part").select(F.col("p_partkey").alias("k"), I.class_base(name).alias("base"), I.squashed(F.concat(F.lit("POST /v/"), z, F.lit("/items"))).alias("squashed"))


@query("i14_schema_files", "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'shipmentV' || p_size || '.avsc' WHEN 1 THEN 'save.avsc' END AS file FROM part", ctes=False)
def schema_files(e: Estate) -> DataFrame:
    z = F.col("p_size").cast("string")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Order-ShipmentV"), z)).when(F.col("p_partkey") % 4 == 1, "Save").when(F.col("p_partkey") % 4 == 2, "a.b-c").otherwise("x-y")
    return e.table("part").select(F.col("p_partkey").alias("k"), I.schema_file(name).alias("file"))


@query(
    "i19_name_families",
    """SELECT family, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'db:' || p_brand WHEN 1 THEN '/v1/a/' || p_size WHEN 2 THEN split_part(p_type, ' ', 1) WHEN 3 THEN split_part(p_brand, '#', 1) ELSE 'Service' END AS family FROM part) GROUP BY family""",
    ctes=False,
)
def name_families(e: Estate) -> DataFrame:
    """Nodes by the bucket in which a map shows them."""
    k, z = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    type_ = F.when(k == 0, "DataContainer").otherwise("Service")
    name = F.when(k == 0, "x_y").when(k == 1, F.concat(F.lit("get /v1/a/"), z, F.lit("/more"))).when(k == 2, F.concat(F.substring_index("p_type", " ", 1), F.lit(".b_c"))).when(k == 3, F.concat(F.substring_index("p_brand", "#", 1), F.lit("_x"))).otherwise("plain")
    return e.table("part").select(I.name_family(type_, name, F.when(k == 0, F.col("p_brand"))).alias("family")).groupBy("family").agg(n().alias("n"))


@query("c10_scan_modes", "SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN p_partkey % 7 < 5 WHEN 1 THEN p_partkey % 7 IN (1, 2, 4) ELSE p_partkey % 7 IN (2, 4) END AS ok FROM part", ctes=False)
def scan_modes(e: Estate) -> DataFrame:
    mode = I.looked_up(F.col("p_partkey") % 7, {0: "structure", 1: "semantic", 2: "contracts", 3: "fast", 4: "deep", 5: "other"})
    asked = I.looked_up(F.col("p_size") % 3, {0: "structure", 1: "semantic", 2: "contracts"})
    return e.table("part").select(F.col("p_partkey").alias("k"), I.scan_covers(mode, asked).alias("ok"))


@query("c16_container_names", "SELECT p_partkey AS k, p_partkey % 7 < 5 AS unsafe FROM part", ctes=False)
def container_names(e: Estate) -> DataFrame:
    name = I.looked_up(F.col("p_partkey") % 7, {0: " ", 1: "two words", 2: "SELECT", 3: "a/b", 4: "t_{ENV}", 5: "orders"}, F.lit("order_items"))
    return e.table("part").select(F.col("p_partkey").alias("k"), I.unsafe_container(name).alias("unsafe"))


@query("q9_environments", "SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' WHEN 2 THEN 'development' WHEN 3 THEN 'development' WHEN 4 THEN 'test' ELSE 'unknown' END AS env FROM part", ctes=False)
def environments(e: Estate) -> DataFrame:
    path = I.looked_up(F.col("p_partkey") % 6, {0: "k8s/PROD/app.yml", 1: ".env.staging", 2: "docker-compose.yml", 3: "conf/dev/db.php", 4: "tests/.env.test"}, F.lit("config/product.yml"))
    return e.table("part").select(F.col("p_partkey").alias("k"), I.scope_class(path).alias("env"))


@query(
    "c6_team_fallback",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'org' || c_nationkey ELSE 'Unassigned' END AS team FROM customer",
    ctes=False,
)
def team_fallbacks(e: Estate) -> DataFrame:
    k = F.col("c_custkey")
    team = F.when(k % 3 == 0, F.col("c_mktsegment"))
    org = F.when((k % 3 == 1) & (k % 2 == 0), F.concat(F.lit("org"), F.col("c_nationkey").cast("string"), F.lit("/sub"))).otherwise("unknown")
    return e.table("customer").select("c_custkey", S.team_fallback(team, org).alias("team"))
