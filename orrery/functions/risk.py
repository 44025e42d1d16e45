"""Severity of vulnerabilities: base scores from vectors, classes, display ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The metric weights of the public CVSS v3 specification; the PR weights for an unchanged and a changed scope.
WEIGHTS = {"AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62}, "C": {"H": 0.56, "L": 0.22, "N": 0.0}, "I": {"H": 0.56, "L": 0.22, "N": 0.0}, "A": {"H": 0.56, "L": 0.22, "N": 0.0}}
PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}


def _weight(metric: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, w in table.items():
        out = F.when(metric == name, F.lit(float(w))).otherwise(out)
    return out


def cvss_base(vector: Column) -> Column:
    """Base score of a CVSS 3.0 or 3.1 vector; null for any other or a malformed one."""
    # the last of repeated metrics counts
    of = lambda m: F.regexp_extract(vector, rf".*/{m}:([^:/]+)", 1)
    w = {m: _weight(of(m), t) for m, t in WEIGHTS.items()}
    changed = of("S") == "C"
    pr = F.when(changed, _weight(of("PR"), PRIVILEGES["C"])).when(of("S") == "U", _weight(of("PR"), PRIVILEGES["U"]))
    exploit = 8.22 * w["AV"] * w["AC"] * pr * w["UI"]
    iss = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
    whole = F.when(changed, 1.08 * (impact + exploit)).otherwise(impact + exploit)
    raw = F.when(whole > 10, 10.0).otherwise(whole)
    # the smallest number with one decimal that is no less, safe from rounding; a missing metric makes it null
    up = F.ceil(F.floor(raw * 100000 + 0.5) / 10000) / 10
    return F.when(vector.rlike(r"^CVSS:3\.[01]/") & raw.isNotNull(), F.when(impact <= 0, 0.0).otherwise(up))


def severity(declared: Column, score: Column) -> Column:
    """The declared class, else that of the score, else UNKNOWN."""
    d = F.upper(declared)
    known = F.when(d == "MODERATE", "MEDIUM").when(d.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), d)
    own = F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW").otherwise("UNKNOWN")
    return F.coalesce(known, own)


def display_id(osv_id: Column, aliases: Column) -> Column:
    """The first CVE alias, else the id itself."""
    return F.coalesce(F.get(F.filter(aliases, lambda a: a.startswith("CVE-")), F.lit(0)), osv_id)
