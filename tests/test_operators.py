"""Operators of the estate on small graphs with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from orrery.functions import identity, risk, semver
from orrery.operators import change, fixpoint, policy
from orrery.operators import gravity as V
from orrery.operators import grounding as N


def weight(n):
    return 1 + math.log10(max(1, n))


def star(hub, rel, n, kind="Service", outward=False):
    """n nodes that each have an edge to the hub, or from it."""
    names = [f"{hub}-{rel}-{i}" for i in range(n)]
    return [(x, kind) for x in names], [(hub, x, rel) if outward else (x, hub, rel) for x in names]


def graph(*parts):
    nodes, edges = {}, []
    for ns, es in parts:
        nodes.update(dict(ns))
        edges += es
    return list(nodes.items()), edges


T, S, C, E = ("t", "DataContainer"), ("s", "Service"), ("c", "MessageChannel"), ("e", "APIEndpoint")
#: name: nodes and edges, the node looked at, its score, tier and evidence (direct, transitive, consumed)
SCENARIOS = {
    "leaf listener": (graph(([S, C], [("s", "c", "LISTENS_TO")])), "s", 0, "T?", (0, 0, 0)),
    "one writer, one reader": (graph(([S, T, ("r", "Service")], [("s", "t", "WRITES"), ("r", "t", "READS")])), "s", 2 * weight(2) + 1.5 * weight(1), "T4", (0, 1, 0)),
    "table of eight readers": (graph(([T], []), star("t", "READS", 8)), "t", 8 * 2 * weight(1), "T2", (8, 0, 0)),
    "bus of twelve consumers": (graph(([S, C], [("s", "c", "PUBLISHES_TO")]), star("c", "LISTENS_TO", 12)), "s", 2 * weight(13) + 12 * 1.5, "T2", (0, 12, 0)),
    "endpoint of six callers": (graph(([S, E], [("s", "e", "IMPLEMENTS_ENDPOINT")]), star("e", "CALLS", 6)), "s", 2 * weight(7) + 6 * 1.5, "T3", (0, 6, 1)),
    "hub called by a hub": (graph(([S, ("h", "Service")], [("h", "s", "CALLS")]), star("h", "CALLS", 9)), "s", 2 * weight(10), "T4", (1, 0, 0)),
    "cycle": (graph(([("a", "Service"), ("b", "Service"), ("d", "Service")], [("a", "b", "CALLS"), ("b", "d", "CALLS"), ("d", "a", "CALLS")])), "a", 2 * weight(2), "T4", (1, 0, 0)),
    "three writers, thirty readers": (graph(([T], []), star("t", "READS", 30), star("t", "WRITES", 3)), "t", 60, "T1", (30, 0, 0)),
    "endpoint nobody calls": (graph(([S, E], [("s", "e", "IMPLEMENTS_ENDPOINT")])), "s", 0.5 * weight(1), "T?", (0, 0, 0)),
    "mixed endpoints": (graph(([S, E, ("f", "APIEndpoint"), ("r", "Service")], [("s", "e", "IMPLEMENTS_ENDPOINT"), ("s", "f", "IMPLEMENTS_ENDPOINT"), ("r", "e", "CALLS")])), "s", 2 * weight(2) + 0.5 + 1.5, "T4", (0, 1, 1)),
    "eighty endpoints nobody calls": (graph(([S], []), star("s", "IMPLEMENTS_ENDPOINT", 80, "APIEndpoint", True)), "s", 40, "T?", (0, 0, 0)),
    "own mappings are not downstream": (graph(([S], []), star("s", "MAPS_TO", 40, "DataContainer", True)), "s", 0, "T?", (0, 0, 0)),
    "writes without readers": (graph(([S], []), star("s", "WRITES", 20, "DataContainer", True)), "s", 40, "T?", (0, 0, 0)),
    "one consumed endpoint": (graph(([S, E, ("r", "Service")], [("s", "e", "IMPLEMENTS_ENDPOINT"), ("r", "e", "CALLS")])), "s", 2 * weight(2) + 1.5, "T4", (0, 1, 1)),
    "dead letters go on": (graph(([C, ("d", "MessageChannel"), ("r", "Service")], [("c", "d", "DEAD_LETTERS_TO"), ("r", "d", "LISTENS_TO")])), "c", 2 * weight(2) + 1.5, "T4", (0, 1, 0)),
    "packages are no targets": (graph(([S, ("p", "Package")], [("p", "s", "DEPENDS_ON")])), "s", 0, "T?", (0, 0, 0)),
}


def test_gravity_scenarios(spark):
    """All scenarios as parts of one graph."""
    nodes, edges = [], []
    for k, ((ns, es), *_) in enumerate(SCENARIOS.values()):
        nodes += [(f"{k}:{u}", t) for u, t in ns]
        edges += [(f"{k}:{a}", f"{k}:{b}", r) for a, b, r in es]
    got = {r["urn"]: r for r in V.gravity(spark.createDataFrame(nodes, "urn string, type string"), spark.createDataFrame(edges, "src string, dst string, rel string")).collect()}
    for k, (name, (_, node, score, tier, evidence)) in enumerate(SCENARIOS.items()):
        r = got[f"{k}:{node}"]
        assert (r["score"], r["tier"], (r["direct"], r["transitive"], r["consumed"])) == (math.floor(score + 0.5), tier, evidence), name


@pytest.mark.parametrize(
    "version,range_,holds",
    [
        ("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("0.0.3", "^0.0.3", True), ("0.0.4", "^0.0.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False),
        ("1.9.9", "~1", True), ("2.0.0-rc.1", "^1.2.0", False), ("2.0.0-rc.1", ">=1.0.0", True), ("1.5.0", "1.x", True), ("1.5.0", "*", True), ("1.5.0", "", True), ("1.5.0", ">= 1.2 <1.5", False), ("1.4.9", ">=1.2 <1.5", True),
        ("2.2.9", "1.0.0 - 2.2", True), ("2.3.0", "1.0.0 - 2.2", False), ("3.0.0", "<2 || >=3", True), ("1.0.0", ">1", False), ("2.0.0", ">1", True), ("1.9.0", "<=1", True), ("1.2.3", "=1.2.3", True), ("1.2.3", "garbage", False),
        ("1.0.0-alpha.10", ">1.0.0-alpha.9", True), ("1.0.0", ">1.0.0-rc.1", True), ("x", "*", False),
    ],
)
def test_ranges(spark, version, range_, holds):
    d = spark.createDataFrame([(version, range_)], "v string, r string").select(semver.key(F.col("v")).alias("k"), semver.alternatives(F.col("r")).alias("a"))
    assert d.select(semver.within(F.col("k"), F.col("a"))).first()[0] is holds


def test_version_order_and_differences(spark):
    order = ["0.9.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0", "2.0.0+b"]
    got = spark.createDataFrame(list(enumerate(order)), "i int, v string").orderBy(semver.key(F.col("v"))).collect()
    assert [r["v"] for r in got] == order
    cases = [("1.2.3", "1.2.3", "none"), ("1.2.3", "2.0.0", "major"), ("1.2.3-rc1", "1.2.4", "patch"), ("1.2.3-rc1", "1.2.3", "patch"), ("1.2.0-rc1", "1.2.0", "minor"), ("2.0.0-rc1", "2.0.0", "major"), ("1.0.0-a", "1.0.0-b", "prerelease"), ("dev", "1.0.0", None)]
    d = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(semver.key(F.col("a")).alias("a"), semver.key(F.col("b")).alias("b"))
    assert [r[0] for r in d.select(semver.difference(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]
    lows = [(">=1.2 <3", "1.2.0"), ("^1", "1.0.0"), ("~ 2.3", "2.3.0"), ("1.x", "1.0.0"), ("dev-master", None), ("*", None)]
    assert [r[0] for r in spark.createDataFrame([x[:1] for x in lows], "r string").select(semver.lowest(F.col("r"))).collect()] == [x[1] for x in lows]


def test_cvss_of_public_vectors(spark):
    cases = [
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H", 7.8),
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H", None), ("CVSS:4.0/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", None), ("", None), (None, None), ("CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", None),
    ]
    got = [r[0] for r in spark.createDataFrame([(c[0],) for c in cases], "v string").select(risk.cvss_base(F.col("v"))).collect()]
    assert got == [c[1] for c in cases]


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "WITH a AS (SELECT 1) DELETE FROM t", "", "CALL x()", "SELECT * FROM t /* */ ; DROP TABLE t"])
def test_writing_queries_are_refused(sql):
    with pytest.raises(policy.Refused):
        policy.check_reading(sql)


def test_reading_queries_pass_with_words_of_writing_in_text():
    policy.check_reading("WITH a AS (SELECT 'drop; delete' AS x) SELECT x FROM a -- insert\n WHERE `set` = 1;")


def test_rules_fail_alone_or_stop(spark):
    t = {"r": spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, name string")}
    good = policy.Rule("good", "error", "repository", "SELECT id AS entity_id, name AS entity_name, if(id = 1, 'pass', 'fail') AS status, NULL AS detail FROM r")
    bad = policy.Rule("bad", "info", "repository", "SELECT nothing FROM r")
    rows, errors = policy.execute(spark, [bad, good], t)
    assert {(r["entity_id"], r["status"]) for r in rows.collect()} == {("1", "pass"), ("2", "fail")} and set(errors) == {"bad"}
    assert policy.execute(spark, [bad, good], t, fail_fast=True)[0].count() == 0
    assert {(r["evaluated"], r["compliant"], r["percent"]) for r in policy.report(rows).collect()} == {(2, 1, 50)}
    with pytest.raises(ValueError):
        policy.Rule("Bad Id", "error", "repository", "SELECT 1")


def test_components_of_paths_cycles_and_pairs(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in fixpoint.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}}
    assert fixpoint.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lineage_uses_a_function_once_and_ends(spark):
    make = lambda rows, cols: spark.createDataFrame(rows, cols)
    produces = make([("f", "b"), ("g", "c"), ("g", "x"), ("h", "a")], "function string, structure string")
    consumes = make([("f", "a"), ("g", "b"), ("h", "c")], "function string, structure string")
    fields = make([("a", "Id"), ("b", "user.id"), ("c", "ID"), ("x", "idle")], "structure string, field string")
    assert {(r["structure"], r["via"], r["hop"]) for r in fixpoint.lineage(produces, consumes, fields, "a", "id").collect()} == {("a", None, 0), ("b", "f", 1), ("c", "g", 2)}


def edge(src, name, dst, shown, rel="PUBLISHES_TO", file="f", kind="MessageChannel"):
    return (src, name, dst, shown, rel, file, kind)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, source_name string, target_id string, target_name string, rel string, source_file string, target_type string")


def test_pairs_by_id_before_name_and_each_edge_once(spark):
    removed = frame(spark, edge("1", "a", "x", "X"), edge("2", "b", "y", "Y"))
    added = frame(spark, edge("1", "a", "x2", "X2"), edge("9", "b", "y2", "Y2"), edge("8", "b", "y3", "Y3"))
    pairs = change.paired(removed, added, ["source_file", "rel", "target_type"], "target_name")
    assert {(r["r"]["target_id"], r["a"]["target_id"]) for r in pairs.collect()} == {("x", "x2"), ("y", "y2")}


def test_endpoint_keys(spark):
    cases = [("cr:endpoint:code:POST:/x", "endpoint:POST:/x"), ("cr:endpoint:org/repo:api/v1.yml:post:/x:y", "endpoint:POST:/x:y"), ("cr:endpoint:repo:POST:notpath", None), ("cr:channel:POST:/x", None)]
    got = spark.createDataFrame([(c[0],) for c in cases], "u string").select(change.endpoint_key(F.col("u"))).collect()
    assert [r[0] for r in got] == [c[1] for c in cases]


def test_grounding_of_empty_lists_and_lowest_quality(spark):
    r = spark.range(1).select(N.union(F.lit(None).cast("array<string>"), F.array().cast("array<string>")).alias("u"), N.demoted(F.lit("speculative")).alias("d"), identity.unsafe_container(F.lit("ok")).alias("s")).first()
    assert tuple(r) == (None, "speculative", False)
