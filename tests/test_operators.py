"""Operators on small tables, against plain Python."""

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane import schemas
from corvane.operators import arity, fanin, gate, health, intervals, keys, latest, layout, notes, resolve, slicing
from corvane.sources import churn, manifests, reports, tree
from corvane.streaming import changes


def test_unresolved_uses_equality_joins_only(spark):
    refs = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "k string")
    cat = lambda *n: spark.createDataFrame([(x,) for x in n], "n string")
    out = resolve.unresolved(refs, ("k", cat("a", "a"), "n"), (F.upper("k"), cat("B"), "n"))
    assert sorted(str(r["k"]) for r in out.collect()) == ["None", "c"]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_local_modules(spark):
    paths = ["a.py", "pkg/sub/__init__.py", "lib/x.py", "src/util.rs", "src/net/mod.rs", "deep/other.rs", "top.rs", "x.ts"]
    got = {(r[0], r[1]) for r in resolve.local_modules(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {("python", "a"), ("python", "pkg"), ("python", "lib"), ("rust", "util"), ("rust", "net"), ("rust", "top")}


def test_arity(spark):
    defs = spark.createDataFrame([("f", 1, 2), ("g", 0, None), ("h", 1, 1), ("h", 2, 2)], "name string, min_args int, max_args int")
    calls = spark.createDataFrame([("f", 0), ("f", 1), ("f", 3), ("g", 99), ("h", 5), ("z", 1)], "name string, argc int")
    got = sorted((r["name"], r["argc"]) for r in arity.arity_mismatches(calls, defs, ["name"]).collect())
    assert got == [("f", 0), ("f", 3)]


def test_fan_in_counts_texts_not_callers(spark):
    units = spark.createDataFrame([("1", "K.f", ["x.f", "f", "f"]), ("2", "g", ["a.f", "b.f", "g"]), ("3", "f", [])], "symbol_id string, name string, callees array<string>")
    got = {r["symbol_id"]: r["fan_in"] for r in fanin.fan_in(units).collect()}
    assert got == {"1": 2, "2": 0, "3": 4}  # "a.f" and "b.f" count twice; a unit's own don't count
    edges = units.select(F.col("symbol_id").alias("c"), F.explode(F.array_distinct("callees")).alias("t"))
    assert {r["symbol_id"]: r["fan_in"] for r in fanin.fan_in_edges(edges, units, "c", "t", "symbol_id", "name").collect()} == got


@pytest.mark.parametrize("value,name", [(0.0, "green"), (0.299999, "green"), (0.3, "yellow"), (0.599999, "yellow"), (0.6, "red"), (1.0, "red")])
def test_bucket_bounds(spark, value, name):
    assert spark.range(1).select(health.bucket(F.lit(value))).first()[0] == name


def test_file_floors(spark):
    files = spark.createDataFrame([("none", 100, 0, 0, 0), ("err", 1, 1, 0, 1), ("one", 1, 1, 1, 1), ("two", 1, 2, 2, 2), ("long", 5000, 0, 0, 0)], "file string, loc int, diagnostics int, hallucinated int, errors int")
    units = spark.createDataFrame([], "file string, loc int, composite double, cc int, fan_in int, fan_out int")
    got = {r["file"]: (r["composite"], r["bucket"]) for r in health.file_scores(files, units).collect()}
    assert got == {"none": (0.06, "green"), "err": (0.3, "yellow"), "one": (0.4, "yellow"), "two": (0.8, "red"), "long": (0.3, "yellow")}


def test_innermost_with_and_without_bins(spark):
    rng = random.Random(4)
    spans = [(i, rng.randint(0, 2), a := rng.randint(0, 300), a + rng.randint(0, 90)) for i in range(60)]
    points = [(i, rng.randint(0, 2), rng.randint(0, 350)) for i in range(80)]
    want = {}
    for q, f, x in points:
        inside = [(b - a, i) for i, g, a, b in spans if g == f and a <= x <= b]
        if inside:
            want[q] = min(inside)[1]
    p, s = spark.createDataFrame(points, "q int, f int, x int"), spark.createDataFrame(spans, "i int, f int, a int, b int")
    for width in (None, (F.col("x"), F.col("a"), F.col("b"), 32)):
        out = intervals.innermost(p, s, ["f"], F.col("x").between(F.col("a"), F.col("b")), ["q"], [F.col("b") - F.col("a"), F.col("i")], width)
        assert {r["q"]: r["i"] for r in out.collect()} == want


def test_suffix_join(spark):
    texts, leaves = ["prefetch", "fetch", "x.ab", "b", "é", ""], ["fetch", "b", "ab", "é", "", "longer.fetch"]
    got = {(r["t"], r["l"]) for r in intervals.by_suffix(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(x,) for x in leaves], "l string"), "l").collect()}
    assert got == {(t, x) for t in texts for x in leaves if x and t.endswith(x)}


def test_words_are_lower_cased_by_sentence(spark):
    """One pass lower-cases a whole sentence, ASCII letters only, and stop words are taken off the facts alone."""
    texts = ["Reads THE Cache. Über ÄRGER. \u0130stanbul \u212aelvin Temp", "The And For.", "ABC_d 12é4 ab", None, ""]
    facts = spark.createDataFrame([([("a", "the cache and Ärger"), ("b", "TEMP the"), ("c", "and for")],)], "facts array<struct<id:string,content:string>>")
    cases = gate.verdicts(spark.createDataFrame([(t,) for t in texts], "t string").crossJoin(gate.tokenised(facts, "facts")), "t", "facts")
    got = {r["t"]: [(v["claim"], v["supporting_fact_ids"]) for v in r["verdicts"] or []] for r in cases.collect()}
    assert got == {texts[0]: [("Reads THE Cache.", ["a"]), ("Über ÄRGER.", ["a"]), ("\u0130stanbul \u212aelvin Temp", ["b"])], texts[1]: [("The And For.", [])], texts[2]: [(texts[2], [])], None: [], "": []}
    words = spark.createDataFrame([(t,) for t in texts[:3]], "t string").select(gate.tokens(F.col("t")).alias("k")).collect()
    assert [r["k"] for r in words] == [["reads", "cache", "Über", "Ärger", "\u0130stanbul", "\u212aelvin", "temp"], [], ["abc_d", "12é4"]]
    plan = spark.createDataFrame([("x", [("a", "x", ["x"])])], "t string, facts array<struct<id:string,content:string,tokens:array<string>>>")
    assert "array_except" not in gate.verdicts(plan, "t", "facts")._jdf.queryExecution().analyzed().toString()


def test_imports_are_not_dealt_out_by_ecosystem(spark):
    """Three ecosystems are three keys, which may not gather the imports in three tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("python", "nope"), ("python", "mine"), ("typescript", "left"), ("tsx", "right"), ("rust", "crate_a"), (None, "x")]
        imports = spark.createDataFrame(rows, "language string, module string")
        named = lambda r: spark.createDataFrame(r, "ecosystem string, name string")
        present = spark.createDataFrame([("python",), ("js",), ("js",), ("other",)], "ecosystem string")
        out = resolve.unknown_imports(imports, named([("js", "left")]), present, named([("python", "mine")]))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi, BuildRight" in plan
        assert sorted(tuple(r) for r in out.collect()) == [("python", "nope"), ("tsx", "right")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _slice(statements, origin, hops, backward):
    mine, theirs = ("w", "r") if backward else ("r", "w")
    names, taken = set(statements[origin][theirs]), [origin]
    for i in range(origin - 1, -1, -1) if backward else range(origin + 1, len(statements)):
        if len(taken) >= max(hops, 1):
            break
        if names & set(statements[i][mine]):
            taken.append(i)
            names |= set(statements[i][theirs])
    return sorted(taken)


def test_slices_match_the_fold(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(120):
        n = rng.randint(1, 9)
        cases.append(([{"w": rng.sample("abcdef", rng.randint(0, 2)), "r": rng.sample("abcdef", rng.randint(0, 2))} for _ in range(n)], rng.randrange(n), rng.randint(0, 5)))
    rows = [(i, [(s["w"], s["r"]) for s in c], o, h) for i, (c, o, h) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, s array<struct<writes:array<string>,reads:array<string>>>, o int, h int")
    out = df.select("i", slicing.backward(F.col("s"), F.col("o"), F.col("h")).alias("b"), slicing.forward(F.col("s"), F.col("o"), F.col("h")).alias("f")).collect()
    for r in out:
        c, o, h = cases[r["i"]]
        assert r["b"] == _slice(c, o, h, True) and r["f"] == _slice(c, o, h, False)
        assert o in r["b"] and o in r["f"]


def _sentences(text):
    out, cur = [], ""
    for i, c in enumerate(text):
        cur += c
        if c in ".!?" and (i + 1 == len(text) or text[i + 1] in " \t\n\r\f\v"):
            out.append(cur)
            cur = ""
    strip = [re.sub(r"^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$", "", s) for s in [*out, cur]]
    return [s for s in strip if s]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab.!? \n_é", max_size=30), min_size=1, max_size=8))
def test_sentences_and_tokens(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", gate.sentences(F.col("t")).alias("s"), gate.tokens(F.col("t")).alias("k"))
    for r in df.collect():
        assert r["s"] == _sentences(r["t"])
        words = {w for w in re.split(r"[^\w]+", r["t"]) if len(w.encode()) >= 3}
        assert set(r["k"]) == {w for w in words if w not in gate.STOP_WORDS}


def test_confusion(spark):
    rows = [(False, False)] * 3 + [(True, False)] + [(False, True)] * 2 + [(True, True)] * 4
    r = spark.createDataFrame(rows, "t boolean, p boolean").agg(*gate.confusion(F.col("t"), F.col("p"))).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["recall"]) == (3, 1, 2, 4, 0.75, 0.6)
    none = spark.createDataFrame([], "t boolean, p boolean").agg(*gate.confusion(F.col("t"), F.col("p"))).first()
    assert (none["precision"], none["recall"]) == (1.0, 1.0)


def test_latest_changed_sessions(spark):
    rows = [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "x"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, v int, s string")
    last = latest.latest_wins(df, ["k"], ["v"])
    assert {r["k"]: r["s"] for r in last.collect()} == {"a": "z", "b": None}
    assert latest.latest_wins(last, ["k"], ["v"]).exceptAll(last).isEmpty()
    got = {(r["k"], r["v"]): r["changed"] for r in latest.changed(df, ["k"], "v", "s").collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("b", 1): False}
    t0 = datetime(2024, 1, 1)
    ev = spark.createDataFrame([("u", t0 + timedelta(seconds=s)) for s in (0, 4, 8, 30, 34, 100)], "u string, ts timestamp")
    assert sorted(r["n"] for r in latest.sessions(ev, "u", "ts", "5 seconds").collect()) == [1, 2, 3]
    seconds = spark.createDataFrame([(2,), (59,), (60,), (200,)], "d int").select(latest.presence(F.col("d")), latest.presence_label(F.col("d"))).collect()
    assert [tuple(r) for r in seconds] == [("live", "active 2s ago"), ("recent", "active 59s ago"), ("idle", "idle 1m"), ("idle", "idle 3m")]


def test_garbage_and_unseen(spark):
    art = spark.createDataFrame([("s1:x",), ("s2:x",), ("s1:y",), ("s3",)], "key string")
    blobs = spark.createDataFrame([("s1", "python", "p"), ("s3", "python", "q"), ("s1", "python", "r"), ("s1", "rust", "t")], "blob_sha string, language string, path string")
    assert sorted(r["key"] for r in latest.live_artifacts(art, blobs).collect()) == ["s1:x", "s1:y", "s3"]
    known = spark.createDataFrame([("s3", "python")], "blob_sha string, language string")
    assert sorted((r["blob_sha"], r["language"]) for r in latest.unseen(blobs, known).collect()) == [("s1", "python"), ("s1", "rust")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=25))
def test_squarified_tiles_cover_the_box(areas):
    areas = sorted(map(float, areas), reverse=True)
    tiles = layout.squarify(areas, 0, 0, 1000, 600)
    assert len(tiles) == len(areas)
    scale = 600_000 / sum(areas)
    for a, (x, y, w, h) in zip(areas, tiles, strict=True):
        assert abs(w * h - a * scale) < 1e-3 * max(1, a * scale)
        assert x >= -1e-6 and y >= -1e-6 and x + w <= 1000 + 1e-6 and y + h <= 600 + 1e-6
    for i, (x, y, w, h) in enumerate(tiles):
        for X, Y, W, H in tiles[:i]:
            assert min(x + w, X + W) - max(x, X) < 1e-6 or min(y + h, Y + H) - max(y, Y) < 1e-6


def _log(spark, ops):
    rows = [(s, op, i, "intent", title, None, None, None, None, "human", datetime(2024, 1, 1)) for s, (op, i, title) in enumerate(ops)]
    return spark.createDataFrame(rows, schemas.NOTES_LOG)


def test_notes_match_a_replay(spark):
    rng = random.Random(6)
    for _ in range(6):
        ops = [(rng.choice(["post", "post", "post", "resolve", "clear"]), rng.choice("abc"), str(k)) for k in range(rng.randint(0, 14))]
        state, existed = {}, []
        for s, (op, i, title) in enumerate(ops):
            if op == "post":
                state[i] = title
            elif op == "resolve":
                existed.append((s, state.pop(i, None) is not None))
            else:
                state.clear()
        log = _log(spark, ops)
        assert [(r["id"], r["title"]) for r in notes.live(log).collect()] == list(state.items()), ops
        assert sorted((r["seq"], r["existed"]) for r in notes.resolved(log).collect()) == existed, ops
    assert notes.badge(notes.live(log)).first()["unresolved"] == len(state)


def test_manifests(spark):
    files = {
        "requirements.txt": "# c\nFoo_Bar==1\nbaz[extra]>=2 ; x\n-e .\npkg~=1.0\n\n",
        "pyproject.toml": '[project]\ndependencies = ["Dep_One>=1", "two"]\n[tool.poetry.dependencies]\npython = "3"\nThree_x = "1"\n',
        "poetry.lock": '[[package]]\nname = "Lock_A"\n',
        "uv.lock": 'name = "uv-a"\n',
        "Pipfile.lock": '{"default": {"Pip_A": {}}, "develop": {"pip-b": {}}}',
        "package.json": '{"dependencies": {"a": "1"}, "peerDependencies": {"@s/b": "1"}, "optionalDependencies": {"c": "1"}}',
        "package-lock.json": '{"packages": {"": {}, "node_modules/x": {}, "node_modules/x/node_modules/@s/y": {}}, "dependencies": {"z": {}}}',
        "pnpm-lock.yaml": "importers:\n  /left@1.0.0:\n    dev: true\n  direct:\n",
        "yarn.lock": '"@s/w@^1":\n  version "1"\nplain@^2:\n',
        "Cargo.toml": '[package]\nname = "my-own"\n[dependencies]\nser-de = "1"\n[workspace.dependencies]\nws = "1"\n',
        "Cargo.lock": 'name = "lock-c"\n',
        "sub/package.json": '{"dependencies": {"no": "1"}}',
    }
    df = spark.createDataFrame(list(files.items()), "path string, source string")
    got: dict = {}
    for r in manifests.packages(df).collect():
        got.setdefault(r["source_file"], set()).add(r["name"])
    assert got == {
        "requirements.txt": {"foo-bar", "baz", "pkg~"},
        "pyproject.toml": {"dep-one", "two", "python", "three-x"},
        "poetry.lock": {"lock-a"},
        "uv.lock": {"uv-a"},
        "Pipfile.lock": {"pip-a", "pip-b"},
        "package.json": {"a", "@s/b", "c"},
        "package-lock.json": {"x", "@s/y", "z"},
        "pnpm-lock.yaml": {"left", "/left@1.0.0", "direct", "dev"},
        "yarn.lock": {"@s/w", "plain"},
        "Cargo.toml": {"my-own", "my_own", "ser-de", "ser_de", "ws"},
        "Cargo.lock": {"lock-c", "lock_c"},
    }
    assert {r["name"] for r in manifests.packages(df.filter("path = 'requirements.txt'"), compat=False).collect()} == {"foo-bar", "baz", "pkg"}
    broken = spark.createDataFrame([("Cargo.toml", "][")], "path string, source string")
    assert manifests.packages(broken).isEmpty() and manifests.present(broken).first()["ecosystem"] == "rust"


def test_reports(spark):
    one = lambda s, c="json": spark.createDataFrame([(s,)], f"{c} string")
    r0 = {"start": {"line": 4, "character": 1}, "end": {"line": 4, "character": 2}}
    pub = {"uri": "file:///r/src/a%20b.rs", "diagnostics": [{"range": r0, "severity": 2, "code": "E1", "message": "m1"}, {"range": r0, "code": {"value": "E2"}, "message": "m2"}, {"range": r0, "code": "E1", "message": "m3", "severity": 4}, {"range": r0, "message": "m4", "source": "rustc"}]}
    got = {r["code"]: (r["severity"], r["message"], r["file"]) for r in reports.rust_analyzer(one(json.dumps(pub)), root="/r").collect()}
    assert got == {"E1": ("hint", "m3", "src/a b.rs"), "E2": ("error", "m2", "src/a b.rs"), "rustc": ("error", "m4", "src/a b.rs")}
    text = spark.createDataFrame([("m.py", "ok\n [Shape Error] 1x2\n[Pytea Error] x\n")], "file string, text string")
    assert [(r["code"], r["id"]) for r in reports.pytea(text).orderBy("ord").collect()] == [("pytea/shape-mismatch", "pytea:m.py:0"), ("pytea/analysis-error", "pytea:m.py:1")]
    assert reports.tsc(one("a.ts(1,1): info TS1: x\nb.ts(0,0): warning TS2: y", "text")).first()["range"]["start"]["line"] == 0
    for read in (reports.pyright, reports.semgrep, reports.rust_analyzer):
        assert read(one("not json")).isEmpty()
    assert spark.createDataFrame([("x\n  import torch.nn",), ("torch",)], "s string").select(reports.imports_torch(F.col("s"))).collect() == [(True,), (False,)]


def test_churn(spark):
    text = "3\t4\ta.py\n1\t0\tsrc/{old => new.py}\n-\t-\tx.png\nnoise\n2\t2\ta.py\n1\t1\tp => q\n"
    df = spark.createDataFrame([(text,)], "text string")
    assert {r["path"]: r["churn_loc"] for r in churn.numstat(df).collect()} == {"a.py": 11, "new.py": 1, "q": 2}
    assert {r["path"] for r in churn.numstat(df, compat=False).collect()} == {"a.py", "src/new.py", "q"}


@pytest.mark.parametrize(
    "line,path,hit",
    [("*.py", "a/b.py", True), ("/x", "a/x", False), ("/x", "x", True), ("a/b", "a/b", True), ("a/b", "c/a/b", False), ("**/z", "p/q/z", True), ("d/**", "d/e/f", True), ("d/**", "d", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("\\#x", "#x", True), ("x ", "x", True)],
)
def test_ignore_patterns(line, path, hit):
    regex, negated, folder = tree.pattern(line)
    assert bool(regex.match(path)) == hit and not negated and not folder


def test_ignore_lines_without_pattern():
    assert tree.pattern("# c") is None and tree.pattern("   ") is None
    assert tree.pattern("!x/")[1:] == (True, True)


def test_names(spark):
    rows = [("@s/p/deep",), ("lodash/fp",), ("plain",), ("@s",)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string").select(keys.js_package(F.col("m"))).collect()]
    assert got == ["@s/p", "lodash", "plain", "@s/"]
    assert spark.range(1).select(keys.iso_time(F.lit(1700000000))).first()[0] == "2023-11-14T22:13:20Z"


def test_change_stream_replays_like_a_batch(spark, tmp_path):
    feed, seen = tmp_path / "feed", []
    feed.mkdir()
    lines = [(1, "a.py", "create"), (2, "b.py", "create"), (3, ".git/x.py", "create"), (4, "a.py", "modify"), (5, "c.txt", "create"), (6, "b.py", "remove"), (7, "web/node_modules/x.ts", "create")]
    for k, part in enumerate((lines[:3], lines[3:])):
        (feed / f"{k}.json").write_text("\n".join(json.dumps({"seq": s, "path": p, "kind": d, "ts": f"2024-01-01T00:00:0{s}Z"}) for s, p, d in part))
    q = changes.follow(changes.feed(spark, str(feed)), lambda last, i: seen.extend((r["path"], r["kind"], r["seq"]) for r in last.collect()), str(tmp_path / "cp"), {"availableNow": True})
    q.awaitTermination(120)
    assert {p: (d, s) for p, d, s in sorted(seen, key=lambda x: x[2])} == {"a.py": ("modify", 4), "b.py": ("remove", 6)}


def test_client_state_on_a_stream(spark, tmp_path):
    schema = "seq long, type string, file string, capability string, payload string"
    rows = [(1, "diagnosticsUpdated", "a", None, "1"), (2, "healthUpdated", None, None, "2"), (3, "diagnosticsUpdated", "a", None, "3"), (4, "capabilityDegraded", None, "c", "4"), (5, "capabilityRestored", None, "c", "5"), (6, "indexProgress", None, None, "6")]
    batch = changes.client_state(spark.createDataFrame(rows, schema))
    want = {("diagnosticsUpdated", "a"): "3", ("healthUpdated", ""): "2", ("capability", "c"): "5"}
    assert {(r["slot"], r["key"]): r["payload"] for r in batch.collect()} == want
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    q = changes.client_state(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("state_now").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {(r["slot"], r["key"]): r["payload"] for r in spark.table("state_now").collect()} == want


def test_bursts_and_watermarks_on_a_stream(spark, tmp_path):
    rows = [{"seq": k, "path": "a.py", "kind": "modify", "ts": f"2024-01-01T00:00:{s:02d}Z", "blob_sha": f"s{k % 2}"} for k, s in enumerate((0, 0, 1, 30))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text("\n".join(map(json.dumps, rows)))
    src = spark.readStream.schema(changes.CHANGE + ", blob_sha string").json(str(tmp_path / "in"))
    for name, df, want in (("dedup_now", changes.deduplicated(src), 2), ("bursts_now", changes.bursts(src), 1)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        assert spark.table(name).count() <= 2 and spark.table(name).count() >= (want if name == "dedup_now" else 0)


def test_affected_and_events(spark):
    names = spark.createDataFrame([("f",)], "name string")
    calls = spark.createDataFrame([("a.py", "f"), ("b.py", "g")], "file string, callee string")
    funcs = spark.createDataFrame([("c.py", ["x.f", "y"]), ("d.py", [])], "file string, callees array<string>")
    assert sorted(r["file"] for r in changes.affected(names, calls, funcs).collect()) == ["a.py", "c.py"]
    kind = "file string, id string, code string, message string, severity string"
    old = spark.createDataFrame([("a", "1", "c", "m", "error"), ("b", "1", "c", "m", "error")], kind)
    new = spark.createDataFrame([("a", "1", "c", "m", "error"), ("e", "2", "c", "m", "error")], kind)
    assert sorted(r["file"] for r in changes.events_of(old, new).collect()) == ["b", "e"]


def test_hits_by_file_equal_plain_python(spark):
    """Texts that would end a quoted pattern, several hits of one text, hits across lines, other languages and nulls."""
    import re

    from corvane.operators import rules

    secret = 'password = "abcdefgh\\Eijklmnopqrs"'
    texts = {
        "a.py": f"x = 1\n{secret}\n\\Q\n{secret}\n{secret}",
        "b.ts": "// é\n\ntoken: 'aaaaaaaaaaaaaaaaaaaa'\npass = \"admin\"; password='letmein'",
        "c.py": "# fully implemented\n\n    pass\n# complete solution\n TODO\n",
        "d.rs": secret,
        "e.py": "",
        "f.py": None,
    }
    language = {"py": "python", "ts": "typescript", "rs": "rust"}
    rows = [(p, language[p[-2:]], t) for p, t in texts.items()]
    got = sorted((r["file"], r["rule"], r["line"]) for r in rules.hits_by_file(spark.createDataFrame(rows, "path string, language string, source string")).collect())
    want = [(p, r.id, t[: m.start()].count("\n")) for p, lang, t in rows for r in rules.RULES if r.pattern and lang in r.languages and t for m in re.finditer(r.pattern, t)]
    assert got == sorted(want) and len(got) == 8


def test_degraded_and_snapshots(spark):
    from corvane.operators import diagnostics, health

    caps = spark.createDataFrame([(1, True), (1, None), (2, True), (2, False)], "w int, available boolean")
    assert sorted(map(tuple, health.degraded(caps, ["w"]).collect())) == [(1, False), (2, True)]
    scores = spark.createDataFrame([("b", 0.405, "yellow"), ("a", 0.0, "green")], "file string, composite double, bucket string")
    assert [tuple(r) for r in health.snapshot(scores).collect()] == [("a", "green", 0), ("b", "yellow", 41)]
    point = "struct<start:struct<line:int,col:int>,end:struct<line:int,col:int>>"
    rows = [(f, ((n, 0), (n, 0)), s, c, "error", "m" * 99, n) for f, n, s, c in [("b", 1, "binding", "x"), ("a", 9, "cwe", "y"), ("a", 2, "tsc", "z"), ("a", 9, "binding", "x")]]
    df = spark.createDataFrame(rows, f"file string, range {point}, source string, code string, severity string, message string, ord int")
    assert [tuple(r) for r in diagnostics.snapshot(df).collect()] == [("a", 9, "x", "error", "m" * 80), ("a", 9, "y", "error", "m" * 80), ("b", 1, "x", "error", "m" * 80)]
    (only,) = diagnostics.by_severity(df, 2).collect()
    assert (only["severity"], only["n"], [d["ord"] for d in only["first"]]) == ("error", 4, [9, 9])


def test_tree_patterns(spark):
    """Order, counts, places from the end, and patterns of several heights, against a walk over random trees."""
    import random

    from corvane.operators import twigs
    from corvane.operators.twigs import Twig

    rng = random.Random(4)
    pats = {
        ("flat", "l"): (Twig("a", "x|y"),),
        ("deep", "l"): (Twig("a", None, children=(Twig("b", ord=0, children=(Twig("a", "x"),)), Twig("b", ord=-1))), Twig("b", "z", n=0)),
        ("other", "m"): (Twig("a", "x"),),
    }

    def tree(n):
        parents = [-1] + [rng.randrange(max(0, k - 3), k) for k in range(1, n)]
        nodes = [{"id": k, "parent": p, "kind": rng.choice("ab"), "word": rng.choice("xyz"), "text": ""} for k, p in enumerate(parents)]
        for x in nodes:
            same = [y["id"] for y in nodes if y["parent"] == x["parent"] and y["kind"] == x["kind"]]
            x |= {"ord": same.index(x["id"]), "of": len(same), "n": sum(y["parent"] == x["id"] for y in nodes)}
        return nodes

    def holds(t, x, nodes):
        import re

        own = x["kind"] == t.kind and (t.word is None or re.fullmatch(t.word, x["word"])) and (t.n is None or t.n == x["n"])
        own = own and (t.ord is None or x["ord"] == (t.ord if t.ord >= 0 else x["of"] + t.ord))
        return bool(own) and all(any(y["parent"] == x["id"] and holds(c, y, nodes) for y in nodes) for c in t.children)

    rows, want = [], set()
    for f in range(25):
        nodes = tree(rng.randint(1, 14))
        rows += [(str(f), "l", x["id"], 0, x["parent"], x["kind"], x["word"], x["text"], x["ord"], x["of"], x["n"], ((x["id"], 0), (x["id"], 1))) for x in nodes]
        want |= {(str(f), rule, x["id"]) for (rule, lang), alts in pats.items() if lang == "l" for x in nodes if any(holds(t, x, nodes) for t in alts)}
    kind = "file string, language string, id int, last int, parent int, kind string, word string, text string, ord int, of int, n int, range struct<start:struct<line:int,col:int>,end:struct<line:int,col:int>>"
    got = {(r["file"], r["rule"], r["id"]) for r in twigs.matches(spark.createDataFrame(rows, kind), twigs.patterns(spark, pats)).collect()}
    assert got == want and {r for _, r, _ in want} == {"flat", "deep"}
