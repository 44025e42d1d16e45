"""Scalar expressions: paths, URLs, fingerprints, liveness, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_of(url: Column) -> Column:
    """The path of a URL without query and fragment, no slash at the end."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    return F.when(F.length(bare) > 1, F.regexp_replace(bare, "/+$", "")).otherwise(F.lit("/"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))


def normal_path(path: Column) -> Column:
    """Number segments and {name} segments become {param}."""
    return F.regexp_replace(F.regexp_replace(path, r"/\{[^/}]*\}", "/{param}"), r"/[0-9]+(?=/|$)", "/{param}")


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(16))


def liveness(commits: Column) -> Column:
    return F.when(commits.isNull(), "unknown").when(commits >= 30, "active").when(commits >= 5, "steady").when(commits >= 1, "slow").otherwise("dormant")


def redacted(text: Column) -> Column:
    """Values of secret keys and credentials in connection strings."""
    keys = F.regexp_replace(text, r"(?i)(token|secret|password|api_key)(\s*=\s*)\S+", "$1$2[REDACTED:key]")
    return F.left(F.regexp_replace(keys, r"[a-z]+://[^\s:/]+:[^\s@/]+@\S+", "[REDACTED:dsn]"), F.lit(4096))


def team_fallback(team: Column, org: Column) -> Column:
    return F.coalesce(team, F.when(org != "unknown", F.get(F.split(org, "/"), F.lit(0))), F.lit("Unassigned"))
