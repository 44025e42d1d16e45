"""Identities of endpoints, URLs, stores, channels and teams as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Technologies by scheme, their aliases, families and default ports, and hosts that name no place.
SCHEMES = {"mysql": "mysql", "mariadb": "mysql", "postgres": "postgres", "postgresql": "postgres", "mongodb": "mongodb", "redis": "redis", "memcached": "memcached", "amqp": "rabbitmq", "kafka": "kafka", "sqlserver": "sqlserver"}
ALIASES = {"mariadb": "mysql", "postgresql": "postgres", "psql": "postgres", "mongo": "mongodb", "mongodb+srv": "mongodb", "rabbit": "rabbitmq", "gcp-pubsub": "pubsub"}
FAMILIES = {
    "rdbms": "mysql postgres sqlserver oracle", "document": "mongodb", "kv": "redis memcached", "timeseries": "influxdb victoriametrics questdb prometheus",
    "broker": "kafka rabbitmq pubsub", "queue": "sqs", "object": "s3 gcs",
}
PORTS = {"mysql": 3306, "postgres": 5432, "sqlserver": 1433, "oracle": 1521, "mongodb": 27017, "redis": 6379, "memcached": 11211, "influxdb": 8086, "kafka": 9092, "rabbitmq": 5672, "pubsub": 443, "sqs": 443, "s3": 443, "gcs": 443}
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "host.docker.internal", "db", "database", "postgres", "mysql", "mariadb", "mongo", "mongodb", "redis", "kafka", "rabbitmq")
SENTINELS = ("<host>", "your-host", "xxx", "changeme", "replaceme", "<dbname>", "your-database", "your-db")
TEMPLATE = r"\$\{|%env|process\.env|\{\{"
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def looked_up(value: Column, table: dict[str, object], other: Column | None = None) -> Column:
    """The entry of value in a table, else other. Texts are looked up in one map, as each test of a chain would repeat their expression."""
    if all(isinstance(k, str) for k in table):
        found = F.try_element_at(F.create_map(*[F.lit(x) for entry in table.items() for x in entry]), value)
        return found if other is None else F.coalesce(found, other)
    out = F.lit(None) if other is None else other
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


# paths


def tidy(path: Column) -> Column:
    """A slash in front, none doubled, none at the end."""
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/"), "(?<=.)/$", "")


def is_dynamic(path: Column) -> Column:
    """A path of placeholders alone, or one that begins with a host variable."""
    return (path == "DYNAMIC") | path.rlike(r"\{(config|env)\.|^/?\{(base[uU]r[li]|domain|host)\}") | (path.rlike(r"^(/*(\{[^/]*\}|:[^/]*))*/*$") & (path != "/"))


def strip_prefix(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)^/api(/v\d+)?(/|$)", "/")


def match_path(path: Column) -> Column:
    """For matching: common prefix gone, every parameter {param}; null for a dynamic path."""
    own = tidy(F.regexp_replace(F.regexp_replace(strip_prefix(path), ":([a-zA-Z0-9_]+)", "{$1}"), r"\{[^}]+\}", "{param}"))
    return F.when(path.startswith("GRAPHQL"), path).when(~is_dynamic(path), own)


def kept_path(path: Column) -> Column:
    """For display: origin and query gone, :name as {name}, names kept; null for a dynamic path."""
    own = tidy(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^https?://[^/]+", ""), "[?#].*$", ""), ":([a-zA-Z0-9_]+)", "{$1}"))
    return F.when(path.startswith("GRAPHQL"), path).when(~is_dynamic(path), own)


def dedup_path(path: Column) -> Column:
    """For duplicates: segments that are variables or ids become {param}, others lower case."""
    variable = rf"(?i)^(:.*|\$.*|\{{.*\}}|.*\$\{{.*|\d+|{UUID}|[0-9a-f]{{24,}})$"
    parts = F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(variable), "{param}").otherwise(F.lower(s)))
    return F.when(path.startswith("GRAPHQL"), path).otherwise(tidy(F.array_join(parts, "/")))


def template_score(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s.startswith("{") | s.startswith(":")))


def path_regex(path: Column) -> Column:
    """A regular expression that the paths of a template match."""
    escaped = F.regexp_replace(path, r"([.+*?^$()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\{[^/}]*\}", "[^/]+"), "(?<=/):[^/]+", "[^/]+"), F.lit("$"))


# URLs and stores


def base_url(url: Column) -> Column:
    """struct(scheme, host, port, path) of an http URL; a default port is null, an unreadable URL too."""
    u = F.trim(url)
    rest = F.regexp_replace(F.regexp_extract(u, r"^(?i:https?)://(.+)$", 1), "^.*@", "")
    place = F.regexp_extract(rest, "^([^/?#]*)", 1)
    scheme, port = F.lower(F.regexp_extract(u, "^(?i:(https?))://", 1)), F.nullif(F.regexp_extract(place, ":([0-9]{1,5})$", 1), F.lit("")).cast("int")
    host = F.lower(F.regexp_replace(place, "(?<=.):[0-9]{1,5}$", ""))
    path = F.nullif(F.regexp_replace(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), "/+$", ""), F.lit(""))
    own = F.struct(scheme.alias("scheme"), host.alias("host"), F.when(port != F.when(scheme == "http", 80).otherwise(443), port).alias("port"), path.alias("path"))
    return F.when((rest != "") & (host != ""), own)


def canonical_url(url: Column, parsed: Column) -> Column:
    """parsed: base_url(url), best a column of its own."""
    port = F.coalesce(F.concat(F.lit(":"), parsed["port"].cast("string")), F.lit(""))
    return F.coalesce(F.concat(parsed["scheme"], F.lit("://"), parsed["host"], port, F.coalesce(parsed["path"], F.lit(""))), F.lower(F.trim(url)))


def joined_url(url: Column, parsed: Column, path: Column) -> Column:
    """The URL with a path, which is not doubled where it begins with the URL's own."""
    p = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    own = F.coalesce(parsed["path"], F.lit(""))
    has = (own != "") & ((p == own) | p.startswith(F.concat(own, F.lit("/"))))
    port = F.coalesce(F.concat(F.lit(":"), parsed["port"].cast("string")), F.lit(""))
    whole = F.concat(parsed["scheme"], F.lit("://"), parsed["host"], port, F.when(has, "").otherwise(own), p)
    return F.coalesce(whole, F.concat(F.regexp_replace(url, "/+$", ""), p))


def technology(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return looked_up(n, ALIASES, n)


def family(tech: Column) -> Column:
    return looked_up(tech, {t: f for f, ts in FAMILIES.items() for t in ts.split()})


def dsn(value: Column) -> Column:
    """struct(technology, host, port, db) of a connection string, jdbc or not; null for templates and unknown schemes."""
    v = F.trim(value)
    shape = r"(?i)^(?:jdbc:)?([\w+]+)://(?:[^/@\s]+@)?([^/?\s:]+)(?::(\d+))?(?:/([^?\s/;]*)[^?\s]*)?(?:\?\S*)?"
    tech, host = looked_up(F.lower(F.regexp_extract(v, shape, 1)), SCHEMES), F.regexp_extract(v, shape, 2)
    name = F.nullif(F.regexp_extract(v, shape, 4), F.lit(""))
    db = F.coalesce(name, F.when(~v.rlike("(?i)^jdbc:"), F.when(tech == "redis", "0").when(tech == "memcached", "memcached")))
    port = F.coalesce(F.nullif(F.regexp_extract(v, shape, 3), F.lit("")).cast("int"), F.when(tech == "memcached", 11211))
    return F.when(~v.rlike(TEMPLATE) & (host != "") & tech.isNotNull() & db.isNotNull(), F.struct(tech.alias("technology"), host.alias("host"), port.alias("port"), db.alias("db")))


def names_no_place(host: Column) -> Column:
    """Empty, a sentinel or a template."""
    h = F.lower(F.trim(host))
    return (h == "") | h.isin(*SENTINELS) | h.rlike(TEMPLATE)


def unusable_host(host: Column) -> Column:
    return names_no_place(host) | F.lower(F.trim(host)).isin(*LOCAL_HOSTS)


def fingerprint(tech: Column, host: Column, port: Column, db: Column) -> Column:
    """16 hex digits for a physical store; null where family, host or name say nothing. tech: from `technology`."""
    h, n = F.lower(F.regexp_replace(F.trim(host), r"^\[|\]$|\.$", "")), F.lower(F.regexp_replace(F.trim(db), r"^[`'\"/]+|[`'\"/]+$", ""))
    at = F.when(port > 0, port).otherwise(looked_up(tech, PORTS, F.lit(0)))
    text = F.concat(family(tech), F.lit("|"), tech, F.lit("|"), h, F.lit(":"), at.cast("string"), F.lit("|"), n, F.lit("|"))
    return F.when(~unusable_host(h) & ~names_no_place(n), F.left(F.sha2(text.cast("binary"), 256), F.lit(16)))


# names


def glob_matches(pattern: Column, name: Column) -> Column:
    """Stars at the ends only."""
    p, t = F.lower(pattern), F.lower(name)
    bare, a, b = F.regexp_replace(p, r"^\*|\*$", ""), p.startswith("*"), p.endswith("*")
    return (p == "*") | (p == t) | F.when(a & b, F.contains(t, bare)).when(b, t.startswith(bare)).when(a, t.endswith(bare)).otherwise(F.lit(False))


def topic_regex(binding: Column) -> Column:
    """A star is one word, a hash none or more."""
    escaped = F.regexp_replace(binding, r"([.+?^${}()|\[\]\\])", r"\\$1")
    steps = ((r"\*", r"[^.]+"), (r"\\\.#", r"(\\..*)?"), (r"^#\\\.", r"(.*\\.)?"), ("#", ".*"))
    for old, new in steps:
        escaped = F.regexp_replace(escaped, old, new)
    return F.concat(F.lit("^"), escaped, F.lit("$"))


def without_placeholders(name: Column) -> Column:
    """A stub's name without environment placeholders; null where there were none, or where any other is left."""
    shape = r"\{(env|ENV|environment|stage|STAGE)\}|\$\{?[A-Z_]*ENV[A-Z_]*\}?|%env%"
    bare = F.regexp_replace(name, shape, "")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\.{2,}", "."), "_{2,}", "_"), r"^[._]+|[._]+$", "")
    return F.when((bare != name) & ~out.rlike(r"\{[^}]+\}") & (out != ""), out)


def team_in(phantom: Column, team: Column) -> Column:
    """Whether a team's name is the phantom's, ends or begins it, or, if longer than four, is a whole segment of it."""
    p, t = F.lower(phantom), F.lower(team)
    end = F.exists(F.array(*[F.lit(x) for x in "-/_"]), lambda s: p.endswith(F.concat(s, t)) | p.startswith(F.concat(t, s)) | ((F.length(t) > 4) & F.contains(p, F.concat(s, t, s))))
    return (F.length(t) >= 2) & ((p == t) | end)


def drifted(a: Column, b: Column) -> Column:
    """Different names of what may be one team."""
    x, y = F.lower(a), F.lower(b)
    strip = lambda c: F.regexp_replace(c, "^(team|squad|guild|tribe)-", "")
    return (x != y) & (F.contains(x, y) | F.contains(y, x) | (F.levenshtein(x, y) < 3) | (strip(x) == strip(y)))


def class_base(name: Column) -> Column:
    """The bare class of an entry-point method: Billing\\OrderController.handle gives order."""
    method = r"(?:handle|execute|__invoke|process|run|index)"
    own = F.regexp_extract(name, rf"([^\\]+)\.{method}$", 1)
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(own, "(?i)(RequestHandler|Controller|Handler|Command|Action|Middleware)$", ""), "[^a-zA-Z0-9]", "")), F.lit(""))


def squashed(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]", ""))


def schema_file(channel: Column) -> Column:
    last = F.substring_index(channel, "-", -1)
    return F.when(~F.contains(channel, F.lit(".")) & (F.length(last) >= 2), F.concat(F.lower(F.left(last, F.lit(1))), F.substring(last, F.lit(2), F.length(last)), F.lit(".avsc")))


def name_family(type_: Column, name: Column, store: Column) -> Column:
    """The bucket of a node: its store, the first three segments of a path, what precedes a dot or an underscore, or its type."""
    n = F.regexp_replace(name, r"(?i)^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|GRAPHQL|GRPC|WS|WSS)\s+", "")
    path = F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split(n, "/"), lambda s: s != ""), 1, 3), "/"))
    own = F.when(n.startswith("/"), path).when(F.contains(n, F.lit(".")), F.substring_index(n, ".", 1)).when(F.contains(n, F.lit("_")), F.substring_index(n, "_", 1)).otherwise(type_)
    return F.when((type_ == "DataContainer") & store.isNotNull(), F.concat(F.lit("db:"), store)).otherwise(own)


def scan_covers(mode: Column, asked: Column) -> Column:
    """Whether a scan of one mode serves what asks for another: contracts over semantic over structure, and the two old names."""
    rank = lambda m: looked_up(m, {"structure": 0, "semantic": 1, "contracts": 2, "fast": 0, "deep": 2})
    return F.coalesce(rank(mode) >= rank(asked), F.lit(False))


def unsafe_container(name: Column) -> Column:
    """No name of a table: empty, white space, a reserved word, a slash, code or an unresolved template."""
    words = "select insert update delete from where table null values set into join index"
    return (F.trim(name) == "") | name.rlike(r"\s|/|[()=;]|\$|\{\$|%[sd]|\{[A-Z_]+\}") | F.lower(name).isin(*words.split())


def scope_class(path: Column) -> Column:
    """The environment that a path names, in the order in which they are asked for."""
    p = F.lower(path)
    return F.when(p.rlike(r"(^|[/._-])(prod|production|live)([/._-]|$)"), "production").when(p.rlike(r"(^|[/._-])(stag|staging|preprod|uat)([/._-]|$)"), "staging").when(p.rlike(r"(^|[/._-])(dev|development|local)([/._-]|$)|docker-compose"), "development").when(p.rlike(r"(^|[/._-])(tests?|testing|ci)([/._-]|$)"), "test").otherwise("unknown")
