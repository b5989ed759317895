"""Tool-call linking, and the pipeline stage by stage against plain Python."""

import json
import random
import time
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import chat, kernel, pii, quality, toxicity
from tests.llm import brute, data

TURNS = "conv_id long, turn long, role string, text string"


def call(i, name, args):
    return {"id": i, "name": name, "arguments": args}


def calls(*c, **more):
    return json.dumps({**more, "tool_calls": list(c)})


def result(i, content="r"):
    return json.dumps({"tool_call_id": i, "content": content})


def lines(df, conv=1):
    return [r for r in df.orderBy("conv_id", *chat.ORDER).collect() if r["conv_id"] == conv]


def test_plain_turns_become_canonical_lines(spark):
    rows = [(1, 0, "user", 'say "hé"\n\t/'), (1, 1, "assistant", None), (1, None, None, "{broken"), (1, 2, "user", '{"a": 1, "a": 2}'), (1, 2, "user", '{"a": 1, "a": 2}')]
    out = chat.formatted(data.clashing(spark.createDataFrame(rows, TURNS)))
    assert out.columns[:4] == ["conv_id", "turn", "idx", "kind"]
    got = sorted(r["json"] for r in out.collect())
    assert got == sorted(['{"content":"say \\"hé\\"\\n\\t/","role":"user"}', '{"role":"assistant"}', '{"content":"{broken"}', '{"content":"{\\"a\\": 1, \\"a\\": 2}","role":"user"}', '{"content":"{\\"a\\": 1, \\"a\\": 2}","role":"user"}'])
    assert all(r["valid"] and r["linked"] is None for r in out.collect())
    assert chat.formatted(spark.createDataFrame([], TURNS)).count() == 0


def test_calls_meet_results_in_order(spark):
    rows = [
        (1, 0, "user", "go"),
        (1, 1, "assistant", calls(call("b", "add", {"y": {"$result": "a"}, "x": 1}), call("lonely", "add", {"x": 2}), content="ok")),
        (1, 2, "tool", result("b", "3")),
        (1, 3, "assistant", calls(call("a", "get", '{"q":"v","n":[1,{"k":2,"a":1}]}'), call("a", "get", {"q": "w"}))),
        (1, 4, "tool", result("a", "7")),
        (1, 5, "tool", result("a", "8")),
        (1, 6, "tool", result("nobody")),
        (2, 9, "tool", result("b")),
    ]
    got = lines(chat.formatted(spark.createDataFrame(rows, TURNS)))
    seen = [(r["kind"], r["call_id"], r["linked"], r["problems"]) for r in got if r["kind"] != "message"]
    assert seen == [("call", "lonely", False, ""), ("call", "a", True, ""), ("call", "a", False, "duplicate"), ("call", "b", True, ""), ("result", "b", True, ""), ("result", "a", True, ""), ("result", "a", False, "duplicate"), ("result", "nobody", False, "no call")]
    assert json.loads(next(r["json"] for r in got if r["kind"] == "call" and r["call_id"] == "a")) == {"arguments": {"q": "v", "n": [1, {"k": 2, "a": 1}]}, "id": "a", "name": "get", "role": "assistant", "type": "call"}
    text = next(r["json"] for r in got if r["call_id"] == "b" and r["kind"] == "call")
    assert text == '{"arguments":{"x":1,"y":{"$result":"a"}},"id":"b","name":"add","role":"assistant","type":"call"}'
    assert lines(chat.formatted(spark.createDataFrame(rows, TURNS)), 2)[0]["problems"] == "no call"


def test_chains_and_cycles(spark):
    chain = [call(f"c{k}", "f", {"x": {"$result": f"c{k + 1}"}} if k < 6 else {}) for k in range(7)]
    rows = [(1, 0, "assistant", calls(*chain)), (2, 0, "assistant", calls(call("p", "f", {"x": {"$result": "q"}}), call("q", "f", {"x": {"$result": "p"}}), call("r", "f", {"x": {"$result": "missing"}})))]
    df = chat.formatted(spark.createDataFrame(rows, TURNS))
    assert [r["call_id"] for r in lines(df) if r["kind"] == "call"] == [f"c{k}" for k in range(6, -1, -1)]
    assert {r["call_id"]: r["problems"] for r in lines(df, 2) if r["kind"] == "call"} == {"p": "cycle", "q": "cycle", "r": ""}


def test_chains_beyond_any_number_of_rounds_and_calls_that_wait_for_cycles(spark):
    chain = [call(f"c{k}", "f", {"x": {"$result": f"c{k + 1}"}} if k < 99 else {}) for k in range(100)]
    needs = {"own": ["own"], "p": ["q"], "q": ["p"], "between": ["p", "free"], "s": ["t", "between"], "t": ["s"], "after": ["s"], "last": ["after"], "free": []}
    tangle = [call(i, "f", {f"x{k}": {"$result": d} for k, d in enumerate(deps)}) for i, deps in needs.items()]
    rows = [(1, 0, "assistant", calls(*chain[:50])), (1, 7, "assistant", calls(*chain[50:])), (2, 0, "assistant", calls(*tangle))]
    df = chat.formatted(spark.createDataFrame(rows, TURNS))
    got = [r for r in lines(df) if r["kind"] == "call"]
    assert [(r["call_id"], r["level"], r["at"], r["valid"]) for r in got] == [(f"c{99 - k}", k, 7, True) for k in range(100)]
    waits = "waits for a cycle"
    assert {r["call_id"]: r["problems"] for r in lines(df, 2) if r["kind"] == "call"} == {"own": "cycle", "p": "cycle", "q": "cycle", "between": waits, "s": "cycle", "t": "cycle", "after": waits, "last": waits, "free": ""}


def placed_by_walking(spots, needs):
    """Levels, places and stuck calls of one conversation: settled again and again, cycles by search from each call."""
    out = {}
    while True:
        ready = [c for c in spots if c not in out and all(d in out for d in needs.get(c, ()))]
        if not ready:
            break
        for c in ready:
            out[c] = (max([spots[c], *(out[d][0] for d in needs.get(c, ()))]), 1 + max((out[d][1] for d in needs.get(c, ())), default=-1), None)

    def reaches_itself(c):
        seen, todo = set(), list(needs.get(c, ()))
        while todo:
            x = todo.pop()
            if x == c:
                return True
            if x not in seen:
                seen.add(x)
                todo += needs.get(x, ())
        return False

    stuck = {c: "cycle" if reaches_itself(c) else "waits for a cycle" for c in spots if c not in out}
    return out, stuck


def placed(spark, spots, needs):
    from corvane.llm.scratch import Scratch

    rows = spark.createDataFrame([(1, c, at, 0) for c, at in spots.items()], "conv long, call_id string, at long, level int")
    edges = spark.createDataFrame([(1, c, d) for c, ds in needs.items() for d in ds], "conv long, call_id string, dep string")
    got = chat._placed(rows, edges, Scratch(spark, "t")).collect()
    assert len(got) == len(spots)
    return {r["call_id"]: (r["at"], r["level"], r["stuck"]) for r in got if r["stuck"] is None}, {r["call_id"]: r["stuck"] for r in got if r["stuck"]}


def test_places_in_random_graphs(spark):
    rng = random.Random(21)
    for n in (14, 30):
        spots = {f"c{k}": rng.randrange(50) for k in range(n)}
        needs = {f"c{k}": sorted({f"c{rng.randrange(max(0, k - 4), min(n, k + (5 if rng.random() < 0.06 else 1)))}" for _ in range(rng.choice((1, 1, 1, 2)))} - {f"c{k}"}) for k in range(n) if rng.random() < 0.8}
        needs = {c: d for c, d in needs.items() if d}
        assert placed(spark, spots, needs) == placed_by_walking(spots, needs)


def test_long_chain_and_long_cycle(spark):
    """Chains and rings are followed by doubling, so neither rounds nor rows follow the square of their length."""
    spots = {f"c{k}": k % 17 for k in range(1000)} | {f"r{k}": 3 for k in range(10_000)} | {"tail": 1}
    needs = {f"c{k}": [f"c{k + 1}"] for k in range(999)} | {f"r{k}": [f"r{(k + 1) % 10_000}"] for k in range(10_000)} | {"tail": ["r5"]}
    began = time.time()
    settled, stuck = placed(spark, spots, needs)
    assert time.time() - began < 120
    assert settled == {f"c{k}": (max(j % 17 for j in range(k, min(1000, k + 17))), 999 - k, None) for k in range(1000)}
    assert stuck == {f"r{k}": "cycle" for k in range(10_000)} | {"tail": "waits for a cycle"}


def test_arguments_against_schemas(spark):
    tools = spark.createDataFrame([("add", "x", "number", True), ("add", "y", "object", None), ("get", "q", "string", True), ("get", "n", "array", False), ("get", "ok", "boolean", False), ("ping", None, None, None)], "tool string, param string, type string, required boolean")
    cases = {"1": ("add", {"x": 1.5}, ""), "2": ("add", {"x": "s", "y": {}}, "type of x"), "3": ("add", {}, "missing x"), "4": ("get", {"q": "v", "n": [1], "ok": True}, ""), "5": ("get", {"q": 1, "n": {}, "zz": 0}, "type of n; type of q; unexpected zz"), "6": ("nope", {}, "unknown tool"), "7": ("get", "[1]", "arguments are no object"), "8": ("ping", {}, ""), "9": ("add", {"x": {"$result": "1"}}, ""), "10": ("ping", None, "arguments are no object")}
    rows = [(1, 0, "assistant", calls(*(call(i, n, a) for i, (n, a, _) in cases.items())))]
    got = {r["call_id"]: r["problems"] for r in chat.formatted(spark.createDataFrame(rows, TURNS), tools).collect() if r["kind"] == "call"}
    assert got == {i: p for i, (_, _, p) in cases.items()}
    odd = [(1, 0, "assistant", '{"tool_calls": [{"function": {"name": "ping", "arguments": "{}"}}]}'), (None, 0, "assistant", calls(call("a", "ping", {})))]
    got = [(r["conv_id"], r["problems"]) for r in chat.formatted(spark.createDataFrame(odd, TURNS), tools).collect() if r["kind"] == "call"]
    assert sorted(got, key=str) == [(1, "no identifier"), (None, "duplicate")]


def test_no_python_on_executors(spark):
    plan = chat.formatted(spark.createDataFrame([(1, 0, "user", "x")], TURNS))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = data.documents(seed=7, n=90)
    toxic = [(900 + k, rows[k][1] + " " + data.BAD[0] + " you " + data.BAD[1], "en", "s1", 1) for k in range(20, 50)]
    rows += toxic
    labels = [(i, 1, int(i >= 900)) for i, *_ in rows if i is not None]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, data.DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels


def _score(field, text):
    """Document score with marginals from plain forward and backward sums."""
    run = next(kernel.runs(pa.array([text])))
    w = kernel.words(run, kernel.NOT_ALNUM)
    e = field.emissions(toxicity.features(w))
    n = len(e)
    ahead, back = [], [None] * n
    for k in range(n):
        x = (1.0, math.exp(min(max(e[k], -30), 30)))
        a = x if not k else tuple(x[b] * sum(ahead[-1][a] * math.exp(field.chain[a][b]) for a in (0, 1)) for b in (0, 1))
        ahead.append(tuple(v / sum(a) for v in a))
    for k in range(n - 1, -1, -1):
        if k == n - 1:
            back[k] = (1.0, 1.0)
        else:
            x = (1.0, math.exp(min(max(e[k + 1], -30), 30)))
            b = tuple(sum(math.exp(field.chain[a][c]) * x[c] * back[k + 1][c] for c in (0, 1)) for a in (0, 1))
            back[k] = tuple(v / sum(b) for v in b)
    p = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(ahead, back, strict=True)]
    top = max(p, default=0.0)
    odds = math.log(min(max(top, 1e-3), 1 - 1e-3) / (1 - min(max(top, 1e-3), 1 - 1e-3)))
    z = sum(a * b for a, b in zip(field.curve, (1, top, odds / 7, math.log1p(sum(p)), math.log1p(100 * sum(p) / max(n, 1))), strict=True))
    return 1 / (1 + math.exp(-z))


def test_pipeline_equals_brute_force(spark, corpus, monkeypatch):
    folder, rows, labels = corpus
    monkeypatch.setattr(quality, "GROUP", 15)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "minhash", "pii", "packing"]
    verdicts = brute.quality_verdicts([r[:4] for r in rows], quality.MEASURES, 15, quality.REACH, quality.ERRORS)
    left = [r for r, (_, ok) in zip(rows, verdicts, strict=True) if ok]

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/out-{name}")
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{folder}/out-{name}")
        after[name] = {r["doc_id"]: r for r in docs.collect()} if name != "packing" else docs.collect()
    assert sorted(after["quality"]) == sorted(r[0] for r in left)

    usable = F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1
    field = toxicity.learn(spark.createDataFrame(left, data.DOCS), spark.read.parquet(f"{folder}/labels.parquet"), usable=usable)
    left = [r for r in left if _score(field, r[1]) < toxicity.CUTOFF]
    assert sorted(after["toxicity"]) == sorted(r[0] for r in left)
    learnt = {i for i, _, t in labels if t and zlib.crc32(str(i).encode()) % 3 != 1}
    assert learnt and not any(r[0] >= 900 for r in left)
    assert sum(r[0] < 90 for r in left) >= 85  # clean documents stay

    groups = brute.near_duplicates([(r[0], r[1]) for r in left], 80)
    keep = {i for i, _, c in groups if i == c}
    left = [r for r in left if r[0] in keep]
    assert len(keep) < len(groups) and sorted(after["minhash"]) == sorted(keep)

    anchors = pii.automaton()
    for r in left:
        spans = pii.ordered(pii.find(r[1], anchors))
        base = brute.personal_data(r[1])
        assert {(k, a, b) for k in base for a, b in base[k]} <= set(spans)
        text = r[1]
        for kind, a, b in sorted(spans, key=lambda s: -s[1]):
            text = text[:a] + f"<{kind.upper()}>" + text[b:]
        got = after["pii"][r[0]]
        assert (got["text"], got["n_chars"]) == (text, len(text))
    assert any("<EMAIL>" in r["text"] for r in after["pii"].values())

    packed = after["packing"]
    assert {r["doc_id"] for r in packed} == keep
    by: dict = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    whole = corpus_pipeline.run(spark, folder)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(*cols).collect())) == sorted(tuple(r[c] for c in cols) for r in packed)
    assert np.isfinite([r["length"] for r in packed]).all()


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], data.DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
