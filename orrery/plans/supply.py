"""Registered queries on packages: version drift, ranges, vulnerabilities, severities, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk, semver
from .catalog import n, query
from .estate import Estate

_S = lambda c: F.col(c).cast("string")


def _dot(*parts: Column) -> Column:
    return F.concat_ws(".", *[p.cast("string") for p in parts])


#: Versions of packages: a part is a release of its brand; what it requires is written in one of eight ways.
_NUM = "p_partkey % 8 AS k, p_size % 4 AS a, p_size % 7 AS b, p_partkey % 5 AS c"


def _versions(e: Estate) -> DataFrame:
    return e.table("part").selectExpr("p_partkey", "p_brand", *_NUM.split(", "))


@query(
    "e19_drift_levels",
    f"""WITH p AS (SELECT p_partkey, p_brand, {_NUM} FROM part), l AS (SELECT *, p_partkey % 4 AS x, p_partkey % 3 AS y, p_partkey % 6 AS z FROM p)
    SELECT p_partkey, CASE WHEN k IN (0, 1) THEN 'none' WHEN k = 5 AND a = x AND b = y AND c = z THEN CASE WHEN b = 0 AND c = 0 THEN 'major' WHEN b > 0 AND c = 0 THEN 'minor' ELSE 'patch' END
      WHEN k = 5 AND (a, b, c) < (x, y, z) AND b = 0 AND c = 0 THEN 'major' WHEN k = 6 THEN 'none'
      WHEN a <> x THEN 'major' WHEN k = 3 AND b <> y THEN 'minor' WHEN k = 3 THEN CASE WHEN 0 <> z THEN 'patch' ELSE 'none' END
      WHEN b <> y THEN 'minor' WHEN c <> z THEN 'patch' ELSE 'none' END AS drift FROM l""",
    ctes=False,
)
def drift_levels(e: Estate) -> DataFrame:
    """What each release requires against the latest version."""
    d = _versions(e)
    full = _dot(F.col("a"), F.col("b"), F.col("c"))
    shown = (
        F.when(F.col("k") == 0, F.concat(F.lit("workspace:"), full)).when(F.col("k") == 1, "*").when(F.col("k") == 2, F.concat(F.lit("^"), full)).when(F.col("k") == 3, F.concat(F.lit("~"), _dot(F.col("a"), F.col("b"))))
        .when(F.col("k") == 4, F.concat(F.lit(">= "), full, F.lit(" <9.0.0"))).when(F.col("k") == 5, F.concat(full, F.lit("-rc.1"))).when(F.col("k") == 6, "dev-master").otherwise(full)
    )
    latest = _dot(F.col("p_partkey") % 4, F.col("p_partkey") % 3, F.col("p_partkey") % 6)
    d = d.select("p_partkey", shown.alias("shown"), F.col("k").isin(5, 7).alias("locked"), semver.key(latest).alias("latest"))
    return d.select("p_partkey", semver.drift(F.col("shown"), F.col("locked"), F.col("latest")).alias("drift"))


_RANGES = ("^1.2.0", "~1.2", "1.x", ">=1.0.0 <2.3.0", "*", "0.2.x || >=3", "1.2.3", "1.0.0 - 2.2")
_HOLDS = """CASE vk WHEN 0 THEN a = 1 AND (b, c) >= (2, 0) WHEN 1 THEN a = 1 AND b = 2 WHEN 2 THEN a = 1 WHEN 3 THEN (a, b) >= (1, 0) AND (a, b) < (2, 3) WHEN 4 THEN true
  WHEN 5 THEN (a = 0 AND b = 2) OR a >= 3 WHEN 6 THEN a = 1 AND b = 2 AND c = 3 ELSE (a, b) >= (1, 0) AND (a, b) < (2, 3) END"""
_MATCH = f"""v AS (SELECT DISTINCT p_brand, p_size % 4 AS a, p_size % 7 AS b, p_partkey % 5 AS c FROM part),
  u AS (SELECT p_partkey AS vuln, p_brand, p_partkey // 40 % 8 AS vk FROM part WHERE p_partkey % 40 = 0), m AS (SELECT u.vuln, v.*, vk FROM u JOIN v USING (p_brand) WHERE {_HOLDS})"""


def _matched(e: Estate) -> DataFrame:
    """package, version and vuln of each installed version that a vulnerability's range holds."""
    v = _versions(e).select("p_brand", _dot(F.col("a"), F.col("b"), F.col("c")).alias("version")).distinct()
    ranges = F.array(*[F.lit(r) for r in _RANGES])
    u = e.table("part").filter("p_partkey % 40 = 0").select(F.col("p_partkey").alias("vuln"), "p_brand", F.get(ranges, (F.floor(F.col("p_partkey") / 40) % 8).cast("int")).alias("affected"))
    # keys and ranges are read once for each version and vulnerability, before the join
    v, u = v.withColumn("key", semver.key(F.col("version"))), u.withColumn("any", semver.alternatives(F.col("affected")))
    return u.join(v, "p_brand").filter((F.col("affected") == "*") | (F.col("affected") == F.col("version")) | semver.within(F.col("key"), F.col("any")))


@query("e20_vulnerable_versions", f"WITH {_MATCH} SELECT p_brand AS package, a || '.' || b || '.' || c AS version, count(*) AS vulnerabilities, min(vuln) AS first FROM m GROUP BY ALL", ctes=False)
def vulnerable_versions(e: Estate) -> DataFrame:
    """Versions by the ranges of their packages' vulnerabilities; the join is by package, never all with all."""
    return _matched(e).groupBy(F.col("p_brand").alias("package"), "version").agg(n().alias("vulnerabilities"), F.min("vuln").alias("first"))


@query(
    "e21_osv_groups",
    f"WITH {_MATCH} SELECT p_brand AS package, vuln, string_agg(a || '.' || b || '.' || c, ',' ORDER BY a || '.' || b || '.' || c) AS versions FROM m GROUP BY ALL",
    ctes=False,
)
def osv_groups(e: Estate) -> DataFrame:
    """The affected versions of each package and vulnerability."""
    return _matched(e).groupBy(F.col("p_brand").alias("package"), "vuln").agg(F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"))


_METRICS = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "HLN", "I": "HLN", "A": "HLN"}


def _vector(key: Column) -> Column:
    parts, step = [], 1
    for m, letters in _METRICS.items():
        at = (F.floor(key / step) % len(letters)).cast("int")
        parts.append(F.concat(F.lit(f"{m}:"), F.substring(F.lit(letters), at + 1, F.lit(1))))
        step *= len(letters)
    return F.concat_ws("/", F.when(key % 11 == 0, "CVSS:2.0").otherwise("CVSS:3.1"), *parts)


def _metric_sql() -> str:
    out, step = [], 1
    for m, letters in _METRICS.items():
        out.append(f"substring('{letters}', CAST(p_partkey // {step} % {len(letters)} AS INTEGER) + 1, 1) AS {m.lower()}_")
        step *= len(letters)
    return ", ".join(out)


_CVSS = f"""q AS (SELECT p_partkey, p_size, {_metric_sql()} FROM part),
  w AS (SELECT *, CASE av_ WHEN 'N' THEN 0.85::DOUBLE WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 ELSE 0.2 END * CASE ac_ WHEN 'L' THEN 0.77::DOUBLE ELSE 0.44 END * CASE ui_ WHEN 'N' THEN 0.85::DOUBLE ELSE 0.62 END *
      CASE pr_ WHEN 'N' THEN 0.85::DOUBLE WHEN 'L' THEN CASE s_ WHEN 'C' THEN 0.68 ELSE 0.62 END ELSE CASE s_ WHEN 'C' THEN 0.5 ELSE 0.27 END END * 8.22 AS expl,
    1 - (1 - {{c}}) * (1 - {{i}}) * (1 - {{a}}) AS iss FROM q),
  z AS (SELECT *, CASE WHEN s_ = 'C' THEN 7.52 * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15) ELSE 6.42 * iss END AS imp FROM w),
  y AS (SELECT *, floor(least(CASE WHEN s_ = 'C' THEN 1.08 * (imp + expl) ELSE imp + expl END, 10) * 100000 + 0.5) AS k FROM z),
  score AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN imp <= 0 THEN 0.0::DOUBLE WHEN k % 10000 = 0 THEN k / 100000 ELSE (floor(k / 10000) + 1) / 10 END AS base FROM y)"""
for _x in "cia":
    _CVSS = _CVSS.replace(f"{{{_x}}}", f"CASE {_x}_ WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END")


@query("e22_cvss", f"WITH {_CVSS} SELECT p_partkey, round(base, 6) AS base FROM score", ctes=False)
def cvss(e: Estate) -> DataFrame:
    return e.table("part").select("p_partkey", F.round(risk.cvss_base(_vector(F.col("p_partkey"))), 6).alias("base"))


@query(
    "e23_severity_classes",
    f"""WITH {_CVSS} SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE
      CASE WHEN base >= 9 THEN 'CRITICAL' WHEN base >= 7 THEN 'HIGH' WHEN base >= 4 THEN 'MEDIUM' WHEN base > 0 THEN 'LOW' ELSE 'UNKNOWN' END END AS severity FROM score""",
    ctes=False,
)
def severity_classes(e: Estate) -> DataFrame:
    """Declared where that is a known word, in any case, else from the vector's score."""
    k = F.col("p_size") % 6
    declared = F.when(k == 0, "critical").when(k == 1, "Moderate").when(k == 2, "LOW").when(k == 3, "bad")
    scored = e.table("part").select("p_partkey", declared.alias("declared"), risk.cvss_base(_vector(F.col("p_partkey"))).alias("base"))
    return scored.select("p_partkey", risk.severity(F.col("declared"), F.col("base")).alias("severity"))


@query("i20_display_id", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'GHSA-' || p_partkey ELSE 'CVE-2020-' || p_partkey END AS id FROM part", ctes=False)
def display_ids(e: Estate) -> DataFrame:
    own, cve = F.concat(F.lit("GHSA-"), _S("p_partkey")), F.concat(F.lit("CVE-2020-"), _S("p_partkey"))
    aliases = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("PYSEC-1"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("PYSEC-1"), cve, F.lit("CVE-9"))).otherwise(F.array(cve))
    return e.table("part").select("p_partkey", risk.display_id(own, aliases).alias("id"))


@query(
    "b19_latest_release",
    """WITH r AS (SELECT p_brand AS package, p_size % 4 AS a, p_size % 7 AS b, p_partkey % 5 AS c, p_partkey % 3 > 0 AS final, p_partkey FROM part WHERE p_partkey % 7 <> 0)
    SELECT package, a || '.' || b || '.' || c || CASE WHEN final THEN '' ELSE '-rc.' || p_partkey END AS latest FROM r
    QUALIFY row_number() OVER (PARTITION BY package ORDER BY a DESC, b DESC, c DESC, final DESC, p_partkey DESC) = 1""",
    ctes=False,
)
def latest_release(e: Estate) -> DataFrame:
    """The largest valid version of each package; a final release comes after its candidates, invalid tags are left out."""
    full = _dot(F.col("a"), F.col("b"), F.col("c"))
    tag = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("release-"), full)).when(F.col("p_partkey") % 3 == 0, F.concat(full, F.lit("-rc."), _S("p_partkey"))).otherwise(full)
    r = _versions(e).select(F.col("p_brand").alias("package"), tag.alias("tag")).filter(semver.valid(F.col("tag")))
    return r.groupBy("package").agg(F.max_by("tag", semver.key(F.col("tag"))).alias("latest"))


@query(
    "e18_consumers",
    """+ d AS (SELECT DISTINCT 'cr:service:s' || l_suppkey AS service, p_brand AS package, p_size % 4 AS version FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 12 AND l_suppkey % 3 = 0),
    s AS (SELECT d.*, repo FROM d JOIN service ON d.service = service.id), r AS (SELECT n_name AS repo, 'Brand#' || (n_nationkey % 5 + 1) || '1' AS package, 9 AS version FROM nation),
    a AS (SELECT package, version, repo FROM s UNION SELECT package, version, repo FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.repo = r.repo AND s.package = r.package)),
    g AS (SELECT package, count(DISTINCT version) AS versions, count(*) AS consumers, count(DISTINCT repo) AS repos FROM a GROUP BY package)
    SELECT package, versions, consumers, repos, versions > 1 AS skew, row_number() OVER (ORDER BY versions > 1 DESC, consumers DESC, package) AS place FROM g""",
)
def consumers(e: Estate) -> DataFrame:
    """Consumers of packages by version, once a repository; a repository's own declaration counts only where no service of it depends.

    The place follows skew, consumers and name: one ordered list of packages, so a single partition ranks it."""
    from pyspark.sql import Window

    p = e.table("part").filter("p_size <= 12").select("p_partkey", F.col("p_brand").alias("package"), (F.col("p_size") % 4).alias("version"))
    d = e.table("lineitem").filter("l_suppkey % 3 = 0").select("l_suppkey", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "package", "version").distinct()
    place = e.table("supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(e.table("nation").select("n_nationkey", F.col("n_name").alias("repo"))), F.col("s_nationkey") == F.col("n_nationkey"))
    s = d.join(place.select("s_suppkey", "repo"), F.col("l_suppkey") == F.col("s_suppkey")).select("package", "version", "repo").distinct()
    r = e.table("nation").select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") % 5 + 1).cast("string"), F.lit("1")).alias("package"), F.lit(9).alias("version"), F.col("n_name").alias("repo"))
    a = s.unionByName(r.join(s, ["repo", "package"], "left_anti").select("package", "version", "repo")).distinct()
    g = a.groupBy("package").agg(F.count_distinct("version").alias("versions"), n().alias("consumers"), F.count_distinct("repo").alias("repos")).withColumn("skew", F.col("versions") > 1)
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("skew"), F.desc("consumers"), "package")))
