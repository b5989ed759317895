"""Requests by name, configuration, and the notes log."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import gate, layout, notes
from corvane.plans.api import Api, RequestError
from corvane.plans.config import Config
from corvane.plans.workspace import Workspace
from tests.conftest import tree_of

SOURCE = "import os\nimport nowhere\n\ndef f(a):\n    b = a\n    c = b + 1\n    return c\n\ndef g():\n    return f(1)\n"


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    raw = tree_of(spark, {"m.py": SOURCE, "requirements.txt": "x\n"})
    return Api(spark, lambda: Workspace(raw), f"file://{tmp_path_factory.mktemp('notes')}/log", "/w")


def point(line, col):
    return {"file": "m.py", "range": {"start": [line, col], "end": [line, col]}}


def test_requests(api):
    assert api.call("ping", {}) == "pong" and api.call("daemon.info", {})["root"] == "/w"
    assert api.call("workspace.scan", {}) is None
    score = api.call("workspace.healthSummary", {})[0]
    assert (score["target"], score["bucket"], score["aiSignal"]["hallucinatedImports"]) == ({"file": "m.py"}, "yellow", 1)
    assert score["location"]["range"]["end"] == [10, 0]
    assert api.call("workspace.worst", {}) == score
    d = api.call("file.diagnostics", {"file": "m.py"})[0]
    assert d["location"]["range"]["start"] == [1, 0] and d["fix"]["edits"][0]["newText"] == "" and "symbol" not in d
    assert api.call("file.diagnostics", {"file": "none.py"}) == []
    assert api.call("file.list", {}) == [{"file": "m.py", "loc": 11, "language": "python"}]
    assert api.call("symbol.definition", {"location": point(3, 5)})["range"]["start"] == [3, 0]
    assert [r["range"]["start"] for r in api.call("symbol.references", {"location": point(3, 5)})] == [[8, 0]]
    out = api.call("slice.compute", {"origin": point(6, 4), "crossFile": False})
    assert [n["label"] for n in out["nodes"]] == ["b = a", "c = b + 1", "return c"] and out["edges"][0] == {"from": 0, "to": 1, "kind": "data"}
    s = api.call("summary.generate", {"symbol": "local . corvane m.py g#."})
    assert [f["id"] for f in s["factsGiven"]] == ["f-sig", "f-call-0", "f-imp-0", "f-imp-1"] and s["generatedAt"].endswith("Z")
    assert api.call("capabilities.status", {})["summaries"]["available"]
    assert api.call("workspace.summary", {})["functions"] == 2
    assert api.call("cache.invalidate", {}) is None and api.call("file.list", {})


def test_errors(api):
    for method, params, code in (("no.such", {}, -32601), ("file.diagnostics", {}, -32602), ("slice.compute", {"origin": point(6, 4)}, -32000), ("summary.generate", {"symbol": "x"}, -32602), ("slice.compute", {"origin": point(7, 0), "crossFile": False}, -32602), ("notes.post", {"kind": "shout", "title": "t"}, -32602)):
        with pytest.raises(RequestError) as e:
            api.call(method, params)
        assert e.value.code == code, method
    assert json.loads(api.handle("{"))["error"]["code"] == -32700
    assert json.loads(api.handle('{"id": 3, "method": "ping"}')) == {"jsonrpc": "2.0", "id": 3, "result": "pong"}


def test_notes(api, spark):
    a = api.call("notes.post", {"kind": "intent", "title": "one", "location": point(1, 0)})
    b = api.call("notes.post", {"kind": "concern", "title": "two", "location": point(2, 0)})
    api.call("notes.post", {"id": a["id"], "kind": "question", "title": "again"})
    assert [n["title"] for n in api.call("notes.list", {})] == ["again", "two"]
    assert [(r["file"], r["kind"]) for r in notes.spotlights(api.notes.list()).collect()] == [("m.py", "concern")]
    assert api.call("notes.resolve", {"id": b["id"]}) == {"resolved": True}
    assert api.call("notes.resolve", {"id": b["id"]}) == {"resolved": False}
    api.call("notes.clear", {})
    assert api.call("notes.list", {}) == []


def test_config(tmp_path):
    assert Config.load(str(tmp_path)) == Config()
    (tmp_path / ".corvane").mkdir()
    (tmp_path / ".corvane/config.toml").write_text('ignore = ["gen"]\n[health]\nnovelty = 0.5\nother = 1\n')
    c = Config.load(str(tmp_path))
    assert (c.health.novelty, c.health.coupling, c.ignore) == (0.5, 0.2, ("gen",))


def test_leaves_and_labels(spark):
    df = spark.createDataFrame([("local . corvane d/m.py K.f#.", 3, 9)], "s string, a int, b int")
    scores = df.select(F.col("s").alias("symbol_id"), F.struct(F.struct(F.col("a").alias("line")).alias("start"), F.struct(F.col("b").alias("line")).alias("end")).alias("range"), F.lit("red").alias("bucket"), F.lit(0.9).alias("composite"))
    assert layout.symbol_leaves(scores).first().asDict() == {"label": "K.f", "area": 7, "bucket": "red", "composite": 0.9}
    files = spark.createDataFrame([("a.py", 0, "green", 0.0)], "file string, loc int, bucket string, composite double")
    assert layout.file_leaves(files).first()["area"] == 1
    texts = spark.createDataFrame([("abcdef",)], "t string")
    assert [texts.select(layout.shortened(F.col("t"), n)).first()[0] for n in (6, 4, 1)] == ["abcdef", "…def", "…"]
    arr = spark.range(1).select(gate.shown(F.array(*map(F.lit, range(11)))).alias("s")).first()["s"]
    assert (len(arr["first"]), arr["more"]) == (8, 3)
