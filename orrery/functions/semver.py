"""Semantic versions and ranges as expressions: sort keys, differences, ranges, lowest versions.

A version becomes a string that sorts as it does, by a chain of replacements; all else compares such strings. Arguments are best
plain columns, as an expression names them several times.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VERSION = r"^\s*[v=]*\s*\d{1,9}\.\d{1,9}\.\d{1,9}(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?\s*$"
_COMPARATOR = r"^(>=|<=|>|<|=|\^|~>?)?v?(\d{1,9}(\.(\d{1,9}|[xX*])){0,2}(-[0-9A-Za-z.-]+)?(\+\S*)?|[xX*]?)$"
#: What precedes a number that counts as one: the begin, a dot, or the first hyphen after three numbers.
_BEFORE = r"(?<=^|\.|^\d{1,9}\.\d{1,9}\.\d{1,9}-|^\d{10}\.\d{10}\.\d{10}-)"
_ZERO = "0" * 10


def valid(version: Column) -> Column:
    return F.coalesce(version.rlike(_VERSION), F.lit(False))


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def _padded(bare: Column) -> Column:
    """Numbers as ten digits; a brace after a version without pre-release, which sorts after any hyphen."""
    return _chain(bare, (_BEFORE + r"(\d{1,9})(?=$|[.-])", f"{_ZERO}$1"), (r"(?<![0-9A-Za-z])\d+(\d{10})(?=$|[.-])", "$1"), (r"^([0-9.]+)$", "$1}"))


def key(version: Column) -> Column:
    """A string that sorts as the version does; null where it is not valid. Numeric identifiers sort before others."""
    return F.when(valid(version), _padded(_chain(version, (r"^\s*[v=]*\s*|\+.*$|\s+$", ""))))


def _next(text: Column, places: int) -> Column:
    """The key of the first version after all that agree with the first one or two numbers of text."""
    number = lambda p: F.regexp_extract(text, p, 1).cast("long")
    up = F.lpad((number(r"^(\d+)" if places == 1 else r"^\d+\.(\d+)") + 1).cast("string"), 10, "0")
    if places == 1:
        return F.concat(up, F.lit(f".{_ZERO}.{_ZERO}-{_ZERO}"))
    return F.concat(F.lpad(F.regexp_extract(text, r"^(\d+)", 1), 10, "0"), F.lit("."), up, F.lit(f".{_ZERO}-{_ZERO}"))


def bounds(comparator: Column) -> Column:
    """struct(low, open_low, high, open_high) of one comparator with keys, null where it is none; pre-releases count as versions."""
    op = F.regexp_extract(comparator, _COMPARATOR, 1)
    text = F.regexp_replace(comparator, r"^(>=|<=|>|<|=|\^|~>?)?v?|\+.*$", "")
    full, two, one = text.rlike(r"^\d+\.\d+\.\d+"), text.rlike(r"^\d+\.\d+"), text.rlike(r"^\d")
    own = _padded(_chain(text, (r"^(\d+)(\.[xX*])*$", "$1.0.0-0"), (r"^(\d+\.\d+)(\.[xX*])?$", "$1.0-0")))
    beyond = F.when(two, _next(text, 2)).otherwise(_next(text, 1))
    patch = F.concat(F.lit(f"{_ZERO}.{_ZERO}."), F.lpad((F.regexp_extract(text, r"^0+\.0+\.(\d+)", 1).cast("long") + 1).cast("string"), 10, "0"), F.lit(f"-{_ZERO}"))
    caret = F.when(text.rlike(r"^0*[1-9]") | ~two, _next(text, 1)).when(text.rlike(r"^0+\.0*[1-9]") | ~full, _next(text, 2)).otherwise(patch)
    low, high = F.lit(""), F.lit("~")

    def make(a: Column, oa: bool, b: Column, ob: bool) -> Column:
        return F.struct(a.alias("low"), F.lit(oa).alias("open_low"), b.alias("high"), F.lit(ob).alias("open_high"))

    out = F.when(~comparator.rlike(_COMPARATOR), None).when(~one & op.isin(">", "<"), make(high, True, low, True)).when(~one, make(low, False, high, False))
    out = out.when(op == "^", make(own, False, caret, True)).when(op.isin("~", "~>"), make(own, False, beyond, True))
    out = out.when((op == ">") & full, make(own, True, high, False)).when(op == ">", make(beyond, False, high, False))
    out = out.when(op == ">=", make(own, False, high, False)).when(op == "<", make(low, False, own, True))
    out = out.when((op == "<=") & full, make(low, False, own, False)).when(op == "<=", make(low, False, beyond, True))
    return out.when(full, make(own, False, own, False)).otherwise(make(own, False, beyond, True))


def alternatives(range_: Column) -> Column:
    """array of arrays of bounds: any of the outer, all of the inner. Hyphen ranges are two comparators."""
    plain = _chain(range_, (r"(\S+)\s+-\s+(\S+)", ">=$1 <=$2"), (r"(>=|<=|>|<|=|\^|~>?)\s+", "$1"))
    return F.transform(F.split(plain, r"\s*\|\|\s*"), lambda one: F.transform(F.split(F.trim(one), r"[\s,]+"), bounds))


def within(version_key: Column, any_: Column) -> Column:
    """Whether a version, by its key, lies in a range, by its `alternatives`; an unreadable range holds none."""

    def holds(b: Column) -> Column:
        low = (version_key > b["low"]) | (~b["open_low"] & (version_key == b["low"]))
        high = (version_key < b["high"]) | (~b["open_high"] & (version_key == b["high"]))
        return F.coalesce(low & high, F.lit(False))

    return F.coalesce(F.exists(any_, lambda one: F.forall(one, holds)), F.lit(False))


def lowest(range_: Column) -> Column:
    """The lowest version that the first part of a range names, as text; null where there is none."""
    first = F.regexp_extract(F.regexp_replace(range_, r"(>=|\^|~>?|=)\s+", "$1"), r"^\s*(?:>=|\^|~>?|=)?v?(\d{1,9}(?:\.(?:\d{1,9}|[xX*])){0,2}(?:-[0-9A-Za-z.-]+)?)(?:[\s|,].*)?$", 1)
    return F.nullif(_chain(first, (r"^(\d+)(\.[xX*])*$", "$1.0.0"), (r"^(\d+\.\d+)(\.[xX*])?$", "$1.0")), F.lit(""))


def difference(one: Column, two: Column) -> Column:
    """major, minor, patch, prerelease or none between two versions, given by their keys; null where one is null."""
    low, high = F.least(one, two), F.greatest(one, two)
    differs = lambda k: F.substring(low, 11 * k + 1, 10) != F.substring(high, 11 * k + 1, 10)
    main = F.when(differs(0), "major").when(differs(1), "minor").when(differs(2), "patch")
    zero = lambda k: F.substring(low, 11 * k + 1, 10) == _ZERO
    candidate, final = ~low.endswith("}"), high.endswith("}")
    released = F.when(zero(1) & zero(2), "major").otherwise(F.coalesce(main, F.when(zero(2), "minor").otherwise("patch")))
    return F.when(one.isNull() | two.isNull(), None).when(one == two, "none").when(candidate & final, released).otherwise(F.coalesce(main, F.lit("prerelease")))


def drift(shown: Column, locked: Column, latest_key: Column) -> Column:
    """major, minor, patch or none of a required or locked version against the latest one's key; workspace, `*` and other specs have none."""
    have = key(F.when(locked, shown).otherwise(lowest(shown)))
    d = F.when(shown.startswith("workspace:") | (shown == "*"), "none").otherwise(difference(have, latest_key))
    return F.when(d.isin("major", "minor", "patch"), d).otherwise("none")
