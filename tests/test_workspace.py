"""Whole scans of small source trees: what must be reported and what must not."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import tree_of
from corvane.plans import store
from corvane.plans.workspace import CrossFileUnavailable, Semantics, UnknownSymbol, Workspace
from corvane.sources import tree

SLOP = '''import os
import httpx
import invented_pkg  # nobody has this


def load(address):
    if not address:
        return ""
    if address.startswith("https"):
        if "v2" in address:
            try:
                return httpx.get(address).text
            except ValueError:
                return ""
    return ""



def run():
    return invented_pkg.go()
'''


def codes(ws):
    return [(r["file"], r["range"]["start"]["line"], r["code"], r["severity"]) for r in ws.diagnostics().collect()]


def test_python_tree_is_yellow_with_one_critical(spark):
    ws = Workspace(tree_of(spark, {"app.py": SLOP, "requirements.txt": "httpx==1.0  # web\n-r other\n"}))
    assert codes(ws) == [("app.py", 2, "hallucination/unknown-import", "critical")]
    d = ws.diagnostics().first()
    assert d["message"] == "no package 'invented_pkg' in requirements.txt / pyproject.toml"
    assert d["fix"]["edits"][0]["location"]["range"]["end"]["line"] == 3
    assert {(r["name"], r["cc"]) for r in ws.functions().collect()} == {("load", 7), ("run", 0)}
    assert ws.files().first()["loc"] == SLOP.count("\n") + 1
    score = ws.health().first()
    assert (score["bucket"], round(score["composite"] * 100)) == ("yellow", 40)
    counts = ws.summary_counts().first()
    assert (counts["files"], counts["functions"], counts["diagnostics"], counts["yellow"]) == (1, 2, 1, 1)


def test_healthy_tree_is_green(spark):
    files = {
        "app/__init__.py": "",
        "app/api.py": SLOP.replace("import invented_pkg  # nobody has this\n", "from fastapi import FastAPI\nfrom .db import rows\n").replace("invented_pkg.go()", "rows()"),
        "app/db.py": "from sqlalchemy import create_engine\n\n\ndef rows():\n    e = create_engine('x')\n    return []\n\n\ndef put(name: str, price: int) -> None:\n    if price < 0:\n        raise ValueError('negative')\n    _ = (name, price)\n",
        "web/client.ts": 'import { readFile } from "node:fs/promises";\nimport pino from "pino";\nexport async function read(p: string) {\n  const t = await readFile(p);\n  return t ? t : pino();\n}\n',
        "package.json": '{"dependencies": {"pino": "1"}}',
        "requirements.txt": "httpx\nfastapi>=0.1\nSQLAlchemy\n",
    }
    ws = Workspace(tree_of(spark, files))
    assert codes(ws) == []
    assert {r["bucket"] for r in ws.health().collect()} == {"green"}
    assert [r["path"] for r in ws.files().collect()] == sorted(p for p in files if p.endswith((".py", ".ts")))
    assert {r["path"]: r["loc"] for r in ws.files().collect()}["app/__init__.py"] == 1


def test_typescript_and_rust_imports(spark):
    ts = 'import fs from "fs/promises";\nimport x from "imagined-package";\nimport y from "./local";\nimport z from "@scope/known/deep";\nconst p = require("pino");\nconst make = () => 1;\n'
    rs = "use std::io;\nuse serde::Serialize;\nuse imagined_crate::Thing;\nuse util::helper;\nfn main() {}\n"
    ws = Workspace(tree_of(spark, {"a.ts": ts, "package.json": '{"dependencies": {"pino": "1"}, "devDependencies": {"@scope/known": "2"}}', "src/main.rs": rs, "src/util.rs": "pub fn helper() {}", "Cargo.toml": '[package]\nname = "own"\n[dependencies]\nserde = "1"\n'}))
    assert {(f, c) for f, _, c, _ in codes(ws)} == {("a.ts", "hallucination/unknown-import"), ("src/main.rs", "hallucination/unknown-import")}
    assert {r["message"] for r in ws.diagnostics().collect()} == {"no package 'imagined-package' in package.json", "no package 'imagined_crate' in Cargo.toml"}
    assert "make" in {r["name"] for r in ws.functions().collect()}


def test_no_manifest_means_no_import_diagnostics(spark):
    assert codes(Workspace(tree_of(spark, {"app.py": SLOP}))) == []
    assert len(codes(Workspace(tree_of(spark, {"app.py": SLOP, "requirements.txt": ""})))) == 2


def test_arity_across_files(spark):
    files = {"lib.py": "def compute(a, b):\n    return a\n\ndef log_event(x, level=1):\n    pass\n\ndef twice(a): pass\n\ndef vary(*a): pass\n", "main.py": "from lib import compute\ncompute(1)\ncompute(1, 2)\nlog_event(1)\ntwice(1, 2)\nvary(1, 2, 3)\nobj.compute(1)\n", "b.py": "def twice(a, b): pass\n"}
    ws = Workspace(tree_of(spark, files))
    rows = ws.diagnostics().collect()
    assert [(r["file"], r["range"]["start"]["line"], r["message"]) for r in rows] == [("main.py", 1, "arity mismatch: compute() expects 2..2 args, called with 1")]
    assert rows[0]["related"][0]["location"]["file"] == "lib.py"


def test_arity_by_language_when_not_compatible(spark):
    files = {"lib.py": "def f(a): pass\n", "x.ts": "function f(a, b) { return a }\n", "m.py": "f()\n"}
    assert codes(Workspace(tree_of(spark, files))) == []
    assert [c[0] for c in codes(Workspace(tree_of(spark, files), semantics=Semantics(compat=False)))] == ["m.py"]


def test_shader_bindings(spark):
    ts = 'const a = gl.getUniformLocation(p, "uTexture");\nconst b = gl.getUniformLocation(p, "uLight");\nconst c = gl.getAttribLocation(p, `uNope`);\n'
    ws = Workspace(tree_of(spark, {"r.ts": ts, "s.glsl": "uniform highp vec3 uLight;\nin vec2 uv;\n", "w.wgsl": "@group(0) var<uniform> cam: C;"}))
    assert {r["name"] for r in ws.shaders.collect()} == {"uLight", "uv", "cam"}
    assert [(r["range"]["start"]["line"], r["code"], r["severity"]) for r in ws.diagnostics().collect()] == [(0, "binding/unknown-uniform", "error")]
    assert codes(Workspace(tree_of(spark, {"r.ts": ts}))) == []  # no shaders, no diagnostics


def test_definition_references_hover(spark):
    src = "def outer():\n    def inner():\n        return 1\n    return inner()\n\ndef fetch(): pass\n\ndef prefetch(): pass\n\ndef user():\n    a.fetch()\n    prefetch()\n"
    ws = Workspace(tree_of(spark, {"m.py": src}))
    assert ws.definition("m.py", 2, 10).first()["name"] == "outer.inner"
    assert ws.hover("m.py", 0, 2).first()["name"] == "outer"
    assert ws.definition("m.py", 4, 0).collect() == []
    assert [r["name"] for r in ws.references("m.py", 5, 4).collect()] == ["user"]
    symbol = ws.definition("m.py", 9, 0).first()["symbol_id"]
    assert symbol == "local . corvane m.py user#."


def test_slices(spark):
    src = "def f(a):\n    x = a + 1\n    y = 2\n    z = x\n    x = z * y\n    return x\n"
    ws = Workspace(tree_of(spark, {"m.py": src}))
    labels = lambda row: [n["label"] for n in row["nodes"]]
    back = ws.slice("m.py", 5, 4).first()
    assert labels(back) == ["x = a + 1", "y = 2", "z = x", "x = z * y", "return x"]
    assert [(e["from"], e["to"], e["kind"]) for e in back["edges"]][0] == (0, 1, "data")
    assert not back["truncated"]
    assert labels(ws.slice("m.py", 3, 4).first()) == ["x = a + 1", "z = x"]
    fore = ws.slice("m.py", 2, 4, direction="forward").first()
    assert labels(fore) == ["y = 2", "x = z * y", "return x"]
    cut = ws.slice("m.py", 5, 4, max_hops=2).first()
    assert len(cut["nodes"]) == 2 and cut["truncated"]
    assert ws.slice("m.py", 5, 4, kind="full").first()["truncated"]
    assert ws.slice_everything().count() == 5
    with pytest.raises(CrossFileUnavailable):
        ws.slice("m.py", 5, 4, cross_file=True)
    flow = spark.createDataFrame([('x\n[FLOW-BEGIN]\n{"file":"","line":3,"label":"n"}\nnoise\n[FLOW-END]',)], "text string")
    assert ws.slice("m.py", 5, 4, cross_file=True, flow_report=flow).first()["nodes"][0]["range"]["start"]["line"] == 2


def test_summary_and_gate(spark):
    ws = Workspace(tree_of(spark, {"m.py": "import os\nimport json\n\ndef f():\n    return json.loads(read_all())\n"}))
    symbol = ws.functions().first()["symbol_id"]
    out = ws.summary(symbol).first()
    assert out["text"].split("\n")[1:5] == ["- function f (2 LOC)", "- calls json.loads", "- calls read_all", "- imports os"]
    assert all(c["entailed"] for c in out["claims"])
    claims = ws.gate_claims("It uses json.loads on text. It sends mail! Reads via read_all", symbol).orderBy("ord").collect()
    assert [c["claim"] for c in claims] == ["It uses json.loads on text.", "It sends mail!", "Reads via read_all"]
    assert [c["entailed"] for c in claims] == [True, False, True]
    assert claims[1]["reason"] and claims[2]["supporting_fact_ids"] == ["f-call-1"]
    with pytest.raises(UnknownSymbol):
        ws.summary("nope")


def test_reports_churn_and_capabilities(spark):
    semgrep = {"results": [{"check_id": "a.b.slop.eval", "path": "/r/m.py", "start": {"line": 1, "col": 1}, "end": {"line": 1, "col": 9}, "extra": {"severity": "ERROR"}}, {"path": "x"}]}
    pyright = {"generalDiagnostics": [{"file": "/r/m.py", "severity": "information", "message": "hm", "range": {"start": {"line": 0, "character": 2}, "end": {"line": 0, "character": 3}}}]}
    one = lambda s, c: spark.createDataFrame([(s,)], f"{c} string")
    tools = {"semgrep": one(json.dumps(semgrep), "json"), "pyright": one(json.dumps(pyright), "json"), "tsc": one("m.py(3,1): error TS2345: bad thing\nnoise\n", "text")}
    raw = tree_of(spark, {"m.py": "def f():\n    pass\n"})
    ws = Workspace(raw, tools, numstat=one("5\t7\tm.py\n-\t-\tb.bin\n1\t1\td/{old => m.py}\n", "text"), root="/r")
    rows = {r["source"]: r for r in ws.diagnostics().collect()}
    assert (rows["semgrep"]["code"], rows["semgrep"]["severity"], rows["semgrep"]["file"], rows["semgrep"]["message"]) == ("slop.eval", "error", "m.py", "slop.eval")
    assert (rows["pyright"]["code"], rows["pyright"]["severity"], rows["pyright"]["range"]["start"]["col"]) == ("pyright", "info", 2)
    assert rows["tsc"]["range"]["start"]["line"] == 2
    assert {r["path"]: r["churn_loc"] for r in ws.churn().collect()} == {"m.py": 14}
    unit = ws.health("symbol").first()
    assert unit["novelty"] == 0.14 and unit["dominant"] == "novelty"
    caps = {r["capability"]: r["available"] for r in ws.capabilities().collect()}
    assert caps["semgrep"] and caps["churn"] and not caps["rust-analyzer"]
    assert ws.diagnostics(exclude=["tsc"]).count() == 2 and ws.diagnostics(include=["tsc"], exclude=["tsc"]).count() == 0


def test_parse_once_by_content_and_store(spark, tmp_path):
    body = "def f():\n    return g()\n"
    silver = store.Silver(spark, f"file://{tmp_path}/silver")
    ws = Workspace(tree_of(spark, {"a.py": body, "b/a.py": body}), silver=silver)
    assert sorted(r["symbol_id"] for r in ws.functions().collect()) == ["local . corvane a.py f#.", "local . corvane b/a.py f#."]
    assert silver.known().count() == 1
    again = Workspace(tree_of(spark, {"a.py": body, "c.py": "def h(): pass\n"}), silver=silver)
    assert again.functions().count() == 2 and silver.known().count() == 2
    saved = store.manifest(ws.sources)
    assert {r["path"]: r["change"] for r in store.compared(again.sources, saved).collect()} == {"a.py": "same", "b/a.py": "removed", "c.py": "added"}
    assert store.cache_counts(again.sources, saved).first().asDict() == {"hits": 1, "misses": 1}
    again.invalidate()
    assert silver.known() is None


def test_tree_source_honours_ignore_files(spark, tmp_path):
    files = {"a.py": "x=1", "_b.py": "", ".hidden.py": "y", "pkg/__init__.py": "", "pkg/gen/x.py": "1", "pkg/keep/x.py": "1", "node_modules/m.py": "1", "build/z.py": "1", "pkg/build/z.py": "1", "logs/a.log.py": "1", "d/deep/er/t.py": "1"}
    for p, t in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / ".gitignore").write_text("/build/\n*.log.py\n!pkg/keep/x.py\nd/**/t.py\n# note\n")
    (tmp_path / "pkg/.gitignore").write_text("gen/\n")
    got = sorted(r["path"] for r in tree.read(spark, str(tmp_path), (".py",)).collect())
    assert got == [".hidden.py", "_b.py", "a.py", "pkg/__init__.py", "pkg/build/z.py", "pkg/keep/x.py"]
    ws = Workspace.scan(spark, str(tmp_path))
    assert ws.files().count() == 6


def test_rules_over_a_tree(spark):
    py = 'import hashlib, requests\npassword = "admin"\napi_key = "0123456789abcdefgh"\neval(x)\nsubprocess.run(f"ls {x}", shell=True)\ndb.execute("a" + x + "b")\nrequests.get(u, verify=False)\nhashlib.md5(p).hexdigest()\nopen(request.args["f"])\ntry:\n    f()\nexcept:\n    pass\ntry:\n    f()\nexcept Exception:\n    pass\ndef stub():\n    raise NotImplementedError("x")\n# production ready\npass\n'
    ts = "eval(x); new Function(y); exec(`ls ${x}`); db.query(`a ${x}`);\n"
    ws = Workspace(tree_of(spark, {"m.py": py, "m.ts": ts}))
    got = {(r["file"], r["code"].removeprefix("slop.")): r["range"]["start"]["line"] for r in ws.rule_hits().collect()}
    want = {"default-admin-password": 1, "hardcoded-secret": 2, "eval-on-untyped-input": 3, "shell-true-from-format": 4, "py-sql-string-concat": 5, "requests-no-verify": 6, "weak-hash-for-credentials": 7, "open-user-path": 8, "silent-except": 9, "broad-except-pass": 13, "raise-not-implemented": 17, "pretend-implemented": 19}
    assert {k: v for (f, k), v in got.items() if f == "m.py"} == want
    assert {k for f, k in got if f == "m.ts"} == {"js-eval", "js-exec-template", "js-sql-string-concat"}


def test_treemap_and_red(spark):
    ws = Workspace(tree_of(spark, {f"f{i}.py": "x\n" * (i * 7 + 1) for i in range(9)}))
    tiles = ws.treemap().toPandas()
    assert abs((tiles.w * tiles.h).sum() - 600_000) < 1e-6
    assert ws.red_functions().count() == 0
    assert ws.worst().count() == 1 and ws.worst_function().count() == 0
    assert ws.health("symbol").filter(F.col("bucket") == "red").count() == 0
