"""Work grows no faster than the input: the rows that joins make, and exact answers without rows for all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import catalogue, fixpoint, gravity, pairs
from orrery.operators.graph import cosine
from orrery.plans import catalog, filesets
from orrery.plans.estate import Estate

SF = "/root/testdata/sf0.01"


def joined(spark, df):
    """The most rows that any join of df makes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        plans, out = [df._jdf.queryExecution().executedPlan()], [0]
        while plans:
            p = plans.pop()
            rows = p.metrics().get("numOutputRows")
            out += [rows.get().value()] if "Join" in p.nodeName() and rows.isDefined() else []
            plans += [p.children().apply(i) for i in range(p.children().size())]
        return max(out)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


#: Bounds in rows of sf0.01, each a small multiple of the rows that the query reads or gives.
BOUNDS = {
    "c5_service_context": 8000,
    "d19_shared_packages": 5000,
    "k2_endpoint_matches": 250,
    "k3_semantic_duplicates": 1000,
    "k5_span_links": 250,
    "k7_match_candidates": 250,
}


@pytest.mark.parametrize("name", sorted(BOUNDS))
def test_joins_make_few_rows(spark, name):
    assert joined(spark, catalog.queries()[name](spark, SF)) <= BOUNDS[name]


def test_equal_targets_are_scored_once(spark, tmp_path):
    p = spark.read.parquet("/root/testdata/sf0.001/part.parquet").crossJoin(spark.range(30))
    p.withColumn("p_partkey", F.col("p_partkey") + F.col("id") * 210 * 4).drop("id").write.parquet(f"{tmp_path}/part.parquet")
    assert joined(spark, catalog.queries()["n3_candidate_scores"](spark, f"{tmp_path}")) <= 30 * 200


def test_roots_are_deepest_first_and_few(spark):
    services = spark.createDataFrame([(i, "/a") for i in range(9, 0, -1)] + [(20, "/a/b"), (21, "/a/bc")], "id long, path string")
    asked = spark.createDataFrame([(1, "/a/b/c"), (2, "/a/b/c"), (3, "/x/y"), (4, "z"), (5, None)], "k long, asked string")
    got = sorted((r["k"], r["id"], r["depth"]) for r in catalogue.roots(asked, services, 3).collect())
    assert got == [(k, i, d) for k in (1, 2) for i, d in ((1, 2), (2, 2), (20, 4))]


def test_nearest_in_parts_is_that_of_all_pairs(spark, monkeypatch):
    """Copies, zeros, null, NaN and vectors of other lengths; parts of a few rows, so several units meet."""
    monkeypatch.setattr(pairs.dealt, "__defaults__", (7,))
    made = np.random.default_rng(5).normal(size=(60, 3)).round(1).tolist()
    made += [made[0]] * 9 + [[0.0] * 3] * 2 + [[float("nan"), 1.0, 0.0], None, [1.0, None, 0.0], [1.0, 0.0]]
    v = spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(made)], "id long, v array<float>, block int")
    a, b = v.toDF("a", "va", "block"), v.toDF("b", "vb", "block")
    for k, least in ((3, 0.2), (1, -1.0)):
        rows = a.join(b, "block").select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("score")).filter("score IS NOT NULL").collect()
        want = set()
        for i in {r["a"] for r in rows}:
            nan = lambda s: s != s
            own = sorted((r for r in rows if r["a"] == i), key=lambda r: (not nan(r["score"]), 0 if nan(r["score"]) else -r["score"], r["b"]))[:k]
            want |= {(r["a"], r["b"], str(r["score"])) for r in own if nan(r["score"]) or r["score"] >= least}
        assert {(r["a"], r["b"], str(r["score"])) for r in pairs.nearest(v, v, "block", k, least).collect()} == want


def test_most_shared_in_parts_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs.dealt, "__defaults__", (9,))
    rng = np.random.default_rng(3)
    sets = [sorted(rng.choice(list("abcdefgh"), size=rng.integers(1, 6), replace=False).tolist()) for _ in range(12)]
    rows = [(int(i), sets[rng.integers(12)], int(rng.integers(3)) if i % 11 else None) for i in rng.permutation(90)]
    want = [(-len(set(v) & set(w)), i, j) for i, v, t in rows for j, w, u in rows if i < j and None not in (t, u) and t != u and len(set(v) & set(w)) >= 2]
    got = pairs.most_shared(spark.createDataFrame(rows, "id long, v array<string>, team int"), 7, 2).collect()
    assert [(r["a"], r["b"], r["shared"]) for r in got] == [(i, j, -s) for s, i, j in sorted(want)[:7]]


def test_dependents_without_pairs_of_services_and_callers(spark):
    """Forty services with one set of two endpoints and a hundred callers; some call themselves, share a resource too or have no team."""
    implements = [(i, p) for i in range(40) for p in ("p", "q")] + [(50, "r")]
    calls = [(c, "pq"[c % 2]) for c in range(100, 200)] + [(100, "q"), (3, "p"), (50, "r"), (60, "r")]
    shared, teams = [(0, 100), (0, 70), (1, 71), (80, 100), (80, 71)], {c: f"t{c % 3}" for c in range(100, 198)} | {3: "own", 50: "t", 60: None, 70: "t9"}
    make = lambda rows, names: spark.createDataFrame(rows, names)
    d = gravity.dependents(make(shared, "service long, dependent long"), make(implements, "src long, dst string"), make(calls, "src long, dst string"), make(list(teams.items()), "dependent long, team string"))
    found = {(s, c) for s, p in implements for c, q in calls if p == q and s != c} | set(shared)
    want = {s: [teams[c] for t, c in found if t == s and c in teams] for s in {s for s, _ in found}}
    assert {r["service"]: (r["dependents"], r["teams"]) for r in d.collect()} == {s: (len(t), len(set(t) - {None})) for s, t in want.items() if t}
    assert joined(spark, d) <= 500


@pytest.mark.parametrize("rels", [("READS", "WRITES"), ("PUBLISHES_TO",), ("LISTENS_TO",)])
def test_parts_of_edges_grow_with_bytes(spark, monkeypatch, rels):
    """A task's share of the edges is set by bytes of the tables, not by how many rows fit a part when compressed."""
    e, seen = Estate(spark, SF), []
    for size in (1 << 16, 1 << 15):
        monkeypatch.setitem(Estate.dealt.__kwdefaults__, "size", size)
        seen.append(e.use(*rels).rdd.getNumPartitions())
    assert seen[0] > 4 and abs(seen[1] - 2 * seen[0]) <= 1


def test_pairs_are_distinct_and_counted(spark):
    e = Estate(spark, SF)
    want = e.use().groupBy("s", "x").agg(F.sum("n").alias("k"), F.min("rel").alias("low"))
    got = e.pairs(k=F.sum("n"), low=F.min("rel"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_files_are_dealt_and_looked_up_once(spark):
    e = Estate(spark, SF)
    assert filesets.files(e, "{k}", "x").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    for name in ("a14_config_connections", "a14_env_connections"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") <= 20


def test_blast_summary_names_no_function(spark):
    """Edges of functions are lifted by numbers; names of all lines are neither made nor exchanged."""
    assert "cr:function" not in catalog.queries()["e9_blast_summary"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_lineage_joins_its_sides_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(fixpoint, "cut", lambda df, cut=fixpoint.cut: kept.append(set(df.columns)) or cut(df))
    sides = [spark.createDataFrame([r], "function string, structure string") for r in (("f", "b"), ("f", "a"))]
    fields = spark.createDataFrame([("b", "x.id")], "structure string, field string")
    assert {(r["structure"], r["hop"]) for r in fixpoint.lineage(*sides, fields, "a", "id").collect()} == {("a", 0), ("b", 1)}
    assert kept.count({"function", "src", "dst"}) == 1
