"""Every registered estate query against its SQL on the smallest tables, and the operators on small graphs."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from orrery.functions import risk, scalars, semver
from orrery.operators import graph
from orrery.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    q = duck.sql(catalog.oracle_sql()[name])
    assert sorted(q.columns) == cols
    want = sorted(tuple(str(dict(zip(q.columns, r, strict=True))[c]) for c in cols) for r in q.fetchall())
    assert got == want


def test_upsert_null_deletes_and_once_stays(spark):
    old = spark.createDataFrame([(1, "a", "x", None), (2, "b", "y", 5)], "id int, name string, made string, fill int")
    new = spark.createDataFrame([(1, None, "z", 7), (3, "c", "w", 9)], "id int, name string, made string, fill int")
    rows = {r["id"]: (r["name"], r["made"], r["fill"]) for r in graph.upsert(old, new, ["id"], ["name"], ["made"], ["fill"]).collect()}
    assert rows == {1: (None, "x", 7), 2: ("b", "y", 5), 3: ("c", "w", 9)}


def test_reachable_terminates_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = {r["id"]: r["hop"] for r in graph.reachable(edges, spark.createDataFrame([("a",)], "id string"), 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_rewire_merges_edges_and_drops_loops(spark):
    edges = spark.createDataFrame([("f", "R", "x"), ("f", "R", "y"), ("x", "R", "y")], "src string, rel string, dst string")
    mapping = spark.createDataFrame([("y", "x")], "old string, new string")
    assert [tuple(r) for r in graph.rewire(edges, mapping).select("src", "rel", "dst").collect()] == [("f", "R", "x")]


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.normal_path(scalars.path_of(F.lit("https://h.x/v1/12/u/{id}/?q=1"))).alias("p"), semver.drift(F.lit("^1.2.3"), F.lit(False), semver.key(F.lit("1.4.0"))).alias("d"),
        risk.severity(F.lit(None).cast("string"), F.lit(7.5)).alias("s"), scalars.redacted(F.lit("token = abc postgres://u:p@h/db")).alias("t"), scalars.team_fallback(F.lit(None).cast("string"), F.lit("org/sub")).alias("o"),
        graph.composite_quality(F.lit("low"), F.lit("medium"), F.lit(False)).alias("q"), graph.tier(F.lit(15)).alias("tier"),
    ).first()
    assert tuple(r) == ("/v1/{param}/u/{param}", "minor", "HIGH", "token = [REDACTED:key] [REDACTED:dsn]", "org", "medium", "T2")
