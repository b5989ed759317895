"""Values carried along an order, places in it, progress, and suffix joins on crowded ends."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import intervals, latest, notes, ordered


@pytest.mark.parametrize("stretches", [1, 3, 7])
def test_carried_forward_equals_a_walk(spark, stretches):
    rng = random.Random(stretches)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i * 3 - 50, rng.choice([None, None, f"v{i}"])) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, v string")
    last, want = {}, {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        want[at] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    got = {r["at"]: r["seen"] for r in ordered.carried_forward(df, ["k"], "at", F.col("v"), "seen", stretches).collect()}
    assert got == want
    last, want = None, {}
    for _, at, v in sorted(rows, key=lambda r: r[1]):
        want[at], last = last, v if v is not None else last
    assert {r["at"]: r["seen"] for r in ordered.carried_forward(df, [], "at", F.col("v"), "seen", stretches).collect()} == want


def test_only_a_large_key_is_cut(spark, monkeypatch):
    """Keys that a task can hold are taken by one window, however many there are; a row finds its stretch without looking at all cuts."""
    monkeypatch.setattr(ordered, "STRETCH", 50)
    small = spark.createDataFrame([(f"k{i % 40}", i, i) for i in range(400)], "k string, at long, v long")
    assert ordered.needed(small, ["k"]) == 1 and ordered.needed(small, []) == 8 and ordered.needed(small.limit(0), ["k"]) == 1
    one = ordered.carried_forward(small, ["k"], "at", F.col("v"), "seen")
    assert "Join" not in one._jdf.queryExecution().toString()
    assert {r["at"]: r["seen"] for r in one.collect()} == {i: i - 40 if i >= 40 else None for i in range(400)}
    large = small.withColumn("k", F.when(F.col("at") % 4 == 0, F.col("k")).otherwise("hot"))
    assert ordered.needed(large, ["k"]) == 8
    cut = small.union(spark.createDataFrame([("n", None, 0)], small.schema)).withColumn("s", ordered.stretch(small, "at", 24))
    places = [(r["at"], r["s"]) for r in cut.collect()]
    assert dict(places)[None] == 0 and [s for _, s in sorted(p for p in places if p[0] is not None)] == sorted(s for at, s in places if at is not None)
    assert {s for _, s in places} == set(range(24))


def test_changes_along_stretches(spark):
    rows = [("k", i, v) for i, v in enumerate([None, "a", "a", None, None, "b", "a"])] + [("j", 3, "a")]
    df = spark.createDataFrame(rows, "k string, v long, s string")
    for stretches in (1, 4):
        got = sorted((r["k"], r["v"], r["previous"], r["changed"]) for r in latest.changed(df, ["k"], "v", "s", stretches).collect())
        assert [g[3] for g in got] == [True, False, True, False, True, False, True, True]
    assert got[0][:3] == ("j", 3, None)


def test_resolves_across_stretches(spark):
    rng = random.Random(5)
    log, there, want = [], set(), []
    for seq in range(300):
        op = rng.choices(("post", "resolve", "clear"), (6, 6, 1))[0]
        i = rng.choice(("hot", "hot", "x", "y"))
        if op == "resolve":
            want.append((seq, i in there))
        there = there | {i} if op == "post" else there - {i} if op == "resolve" else set()
        log.append((seq, op, None if op == "clear" else i))
    df = spark.createDataFrame(log, "seq long, op string, id string").repartition(3)
    for stretches in (1, 6):
        out = notes.resolved(df, stretches)
        assert sorted((r["seq"], r["existed"]) for r in out.collect()) == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_places_have_no_gaps(spark):
    df = spark.createDataFrame([(i % 7, f"x{i}") for i in range(500)] + [(None, "n")], "a int, b string").repartition(6)
    got = sorted((r["place"], r["a"], r["b"]) for r in ordered.numbered(df, ["a", F.desc("b")]).collect())
    assert [g[0] for g in got] == list(range(1, 502))
    assert [g[2] for g in got] == ["n"] + [b for _, b in sorted(((i % 7, f"x{i}") for i in range(500)), key=lambda r: (r[0], [-ord(c) for c in r[1]] + [1]))]
    assert ordered.numbered(df.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 49, 50, 130])
def test_progress(spark, n):
    got = sorted(map(tuple, ordered.ticks(spark.range(n).select((F.col("id") % 3).alias("p")), ["p"], 50).collect()))
    assert got == [(k, n) for k in sorted({0, *range(50, n + 1, 50), n})]


def test_crowded_suffixes_stay_linear(spark):
    """Thousands of texts and leaves with one end: intermediate rows follow the texts, not their product."""
    texts = spark.range(3000).select(F.concat(F.lit("call"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("_end")).alias("t"))
    leaves = spark.range(3000).select(F.concat(F.lpad((F.col("id") * 2).cast("string"), 5, "0"), F.lit("_end")).alias("l"))
    out = intervals.by_suffix(texts, "t", leaves, "l")
    got = sorted((r["t"], r["l"]) for r in out.collect())
    assert got == [(f"call{i:05}_end", f"{i:05}_end") for i in range(0, 3000, 2)]
    plan = out._jdf.queryExecution().executedPlan()
    assert "CartesianProduct" not in plan.toString() and "NestedLoop" not in plan.toString()


@pytest.mark.parametrize("stretches", [1, 5])
def test_innermost_of_nested_intervals(spark, stretches):
    rng = random.Random(8)
    spans = []

    def nest(f, lo, hi, depth):
        spans.append((f, lo, hi, len(spans)))
        at = lo
        while depth and at < hi and rng.random() < 0.8:
            a = rng.randint(at, hi)
            b = rng.randint(a, hi)
            nest(f, a, b, depth - 1)
            at = b + 1

    for f in ("hot", "hot2", None):
        for base in (0, 60, 200):
            nest(f, base, base + 50, 4)
    spans.append(("hot", 60, 110, len(spans)))  # equal to another: the later is the inner one
    points = [(f, k, rng.randint(-3, 260)) for k, f in enumerate(rng.choices(("hot", "hot2", None, "none"), k=300))]
    want = {}
    for f, k, x in points:
        around = [(b - a, -o) for g, a, b, o in spans if g == f and a <= x <= b]
        if around:
            want[k] = -min(around)[1]
    df = intervals.innermost_nested(spark.createDataFrame(points, "f string, k int, x long"), spark.createDataFrame(spans, "f string, lo long, hi long, o int"), ["f"], "x", "lo", "hi", "o", stretches)
    assert {r["k"]: r["o"] for r in df.collect()} == want
