"""File sources, snapshots and streams on small files."""

import json

import pytest

from orrery.sources import files
from orrery.streaming import spans as streams


def test_spans_and_traces(spark, tmp_path):
    ok = {"spanId": "1", "operationName": "get", "serviceName": "a", "latency_ms": 2.5, "attributes": {"k": "v"}}
    (tmp_path / "s.json").write_text(json.dumps([ok, {"spanId": "2"}]))
    good, bad = files.spans(spark, str(tmp_path / "s.json"))
    assert [r["spanId"] for r in good.collect()] == ["1"] and bad.count() == 1
    (tmp_path / "t.jsonl").write_text('{"ts": "1", "stage": "llm", "action": "SEND"}\nnot json\n')
    assert [r["stage"] for r in files.traces(spark, str(tmp_path / "t.jsonl")).collect()] == ["llm"]


def test_code_owners(spark, tmp_path):
    (tmp_path / "CODEOWNERS").write_text("# all\n*  @org/core @ann x@y.z # note\n\n/docs\n")
    got = [tuple(r)[1:] for r in files.code_owners(spark, str(tmp_path / "CODEOWNERS")).orderBy("line").collect()]
    assert got == [(2, "*", ["core"], ["ann", "x@y.z"]), (4, "/docs", [], [])]


def test_manifests_and_endpoints(spark, tmp_path):
    (tmp_path / "package.json").write_text(json.dumps({"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}))
    (tmp_path / "broken.json").write_text("{")
    got = {tuple(r)[1:] for r in files.npm_dependencies(spark, str(tmp_path)).collect()}
    assert got == {("a", "npm", "^1", False), ("b", "npm", "2", True)}
    (tmp_path / "api.json").write_text(json.dumps({"info": {"title": "T", "version": "1"}, "paths": {"/x/{id}": {"get": {"operationId": "x"}, "parameters": []}, "/y": {}}}))
    assert [tuple(r)[1:] for r in files.endpoints(spark, str(tmp_path / "api.json")).collect()] == [("T", "1", "GET", "/x/{id}", "x")]


def test_snapshot_comes_back_and_adds(spark, tmp_path):
    nodes = spark.createDataFrame([("S", "a", "new"), ("S", "b", "b")], "label string, id string, name string")
    edges = spark.createDataFrame([("R", "a", "b")], "rel string, src string, dst string")
    files.export_graph(nodes, edges, str(tmp_path))
    assert {r["id"] for r in files.import_graph(spark, str(tmp_path))[0].collect()} == {"a", "b"}
    old = spark.createDataFrame([("S", "a", "old")], nodes.schema)
    both, links = files.import_graph(spark, str(tmp_path), (old, edges))
    assert {(r["id"], r["name"]) for r in both.collect()} == {("a", "old"), ("b", "b")} and links.count() == 1


def test_sarif(spark):
    v = spark.createDataFrame([("r", "error", "e", "d")], "rule string, level string, entity string, detail string")
    assert json.loads(files.sarif(v).first()["result"]) == {"ruleId": "r", "level": "error", "message": {"text": "d"}, "locations": [{"logicalLocations": [{"fullyQualifiedName": "e"}]}]}


@pytest.mark.parametrize("shape", ["windows", "sessions"])
def test_streams_give_what_a_batch_gives(spark, tmp_path, shape):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "ts", "user_id", "event_type", "value", "props")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    step = {"windows": streams.per_window, "sessions": streams.sessions}[shape]
    q = step(streams.events(spark, f"{tmp_path}/in"), late="10000 days").writeStream.format("memory").queryName(f"got_{shape}").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table(f"got_{shape}").drop("mean_value").collect())) == sorted(map(str, step(rows, late="10000 days").drop("mean_value").collect()))


def test_nodes_follow_the_stream(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "ts", "user_id", "event_type", "value", "props").orderBy("ts", "event_id")
    first = rows.limit(500)
    first.write.parquet(f"{tmp_path}/in/a")
    stream = lambda: streams.events(spark, f"{tmp_path}/in/*", 1)
    streams.keep_nodes(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", "user_id", ["event_type"]).awaitTermination()
    rows.exceptAll(first).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    streams.keep_nodes(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", "user_id", ["event_type"]).awaitTermination()
    got = {r["user_id"]: r["event_type"] for r in streams.nodes(spark, f"{tmp_path}/out").collect()}
    want = {r["user_id"]: r["event_type"] for r in rows.orderBy("ts").collect()}
    assert got == want
    for p in (tmp_path / "out").glob("part=*"):
        assert len(list(p.glob("batch=*"))) <= 2
