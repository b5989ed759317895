"""Trees followed change by change against whole scans."""

import random
from collections import Counter

from pyspark.sql import functions as F

from corvane.plans import increments
from corvane.plans.workspace import Semantics, Workspace
from corvane.streaming.incremental import Incremental, changed_keys
from tests.conftest import tree_of


def facts(rows):
    return sorted((r["id"], r["file"], r["code"], r["message"], str(r["range"]), str(r["related"])) for r in rows.collect())


def apply(spark, state, before, after, version, compat=True):
    """Hands over only what differs between two trees."""
    paths = [p for p in {*before, *after} if before.get(p) != after.get(p)]
    raw = tree_of(spark, {p: after[p] for p in paths if p in after}) if any(p in after for p in paths) else tree_of(spark, {"x": ""}).limit(0)
    state.apply(spark.createDataFrame([(p,) for p in paths], "path string"), increments.units_of(raw, compat), version)


STEPS = [
    {"requirements.txt": "", "lib.py": "def f(a): pass\n", "use.py": "f(1)\nimport nowhere\nimport near.deep\n", "ok.py": "f(2)\n"},
    {"lib.py": "def f(a, b): pass\n", "requirements.txt": "nowhere\n", "near/x.py": "f(1, 2)\n"},  # a definition, a manifest and a new module matter to other files
    {"lib2.py": "def f(): pass\n", "view.ts": 'gl.getUniformLocation(p, "uTint");\nf(1);\n'},  # defined twice: no call is wrong
    {"a.frag": "uniform vec4 uColor;\n", "lib2.py": None},  # a first shader makes bindings unknown
    {"a.frag": "uniform vec4 uTint;\n", "requirements.txt": None},  # a symbol is there, and no manifest any more
    {"lib.py": None, "use.py": "import nowhere\n", "package.json": '{"dependencies": {"left": "1"}}', "m.ts": 'import a from "left/x";\nimport b from "right";\n'},
    {"a.frag": None, "requirements.txt": "x\n"},
]


def test_results_equal_a_scan_after_every_change(spark, tmp_path):
    state = increments.followed(spark, f"file://{tmp_path}/state", slots=4)
    tree = {}
    for k, step in enumerate(STEPS):
        before = dict(tree)
        tree = {p: t for p, t in {**tree, **step}.items() if t is not None}
        apply(spark, state, before, tree, k)
        if k == 2:
            apply(spark, state, before, tree, k)  # a change that is repeated
        want = facts(Workspace(tree_of(spark, tree)).own_diagnostics())
        assert facts(increments.diagnostics(state)) == want, k
        assert want or k not in (0, 1, 3)


def test_languages_apart_without_compatibility(spark, tmp_path):
    semantics = Semantics(compat=False)
    state = increments.followed(spark, f"file://{tmp_path}/state", semantics, slots=2)
    one = {"a.py": "def f(a): pass\n", "b.ts": "f(1, 2);\n", "c.py": "f()\n"}
    apply(spark, state, {}, one, 0, compat=False)
    two = {**one, "d.ts": "function f(a: number) {}\n"}
    apply(spark, state, one, two, 1, compat=False)
    got = facts(increments.diagnostics(state))
    assert got == facts(Workspace(tree_of(spark, two), semantics=semantics).own_diagnostics())
    assert {g[1] for g in got} == {"b.ts", "c.py"}


def plain(spark, folder, slots=64, seen=None):
    """Units that provide numbers under keys and use keys; a result is the sum of each key's numbers, for each user."""

    def judge(units, provided):
        if seen is not None:
            seen.append(units.count())
        sums = provided.groupBy("key").agg(F.sum(F.col("value").cast("long")).alias("total"))
        return units.select("path", F.explode("uses").alias("key")).join(sums, "key").select("path", "key", "total")

    return Incremental(spark, folder, judge, "int", "key string, total long", slots=slots)


def unit_rows(spark, units):
    return spark.createDataFrame([(p, [(k, str(v)) for k, v in gives], uses, 0) for p, (gives, uses) in units.items()], "path string, provides array<struct<key:string,value:string>>, uses array<string>, body int")


def sums(units):
    total = Counter()
    for gives, _ in units.values():
        for k, v in gives:
            total[k] += v
    there = {k for gives, _ in units.values() for k, _ in gives}
    return sorted((p, k, total[k]) for p, (_, uses) in units.items() for k in uses if k in there)


def test_random_changes(spark, tmp_path):
    rng = random.Random(3)
    state = plain(spark, f"file://{tmp_path}/state", slots=4)
    units = {}
    unit = lambda: ([(f"k{rng.randrange(6)}", rng.randrange(9)) for _ in range(rng.randrange(3))], list({f"k{rng.randrange(6)}" for _ in range(rng.randrange(3))}))
    for version in range(4):
        touched = {f"p{rng.randrange(12)}": unit() if rng.random() < 0.75 else None for _ in range(rng.randint(1, 5))}
        units = {p: u for p, u in {**units, **touched}.items() if u is not None}
        there = {p: u for p, u in touched.items() if u is not None}
        state.apply(spark.createDataFrame([(p,) for p in touched], "path string"), unit_rows(spark, there), version)
        assert sorted(map(tuple, state.results().collect())) == sums(units), version


def test_a_change_touches_little(spark, tmp_path):
    """One file of ten thousand: few slots are written, and only the file and the users of what it provides are judged."""
    n, seen = 10_000, []
    state = plain(spark, f"file://{tmp_path}/state", seen=seen)
    i = F.col("id")
    many = spark.range(n).select(
        F.concat(F.lit("p"), i).alias("path"),
        F.array(F.struct(F.concat(F.lit("k"), i).alias("key"), F.lit("1").alias("value"))).alias("provides"),
        F.array(F.concat(F.lit("k"), F.floor(i / 2))).alias("uses"),
        F.lit(0).alias("body"),
    )
    state.apply(many.select("path"), many, 0)
    written = lambda name: {p.parent.parent.name for p in (tmp_path / "state" / name).glob("slot=*/version=1/*.parquet")}
    state.apply(spark.createDataFrame([("p70",)], "path string"), unit_rows(spark, {"p70": ([("k70", 5)], ["k1"])}), 1)
    assert seen == [n, 3]  # p70, and the users p140 and p141 of k70
    assert len(written("units")) == 1 and len(written("results")) <= 3 and len(written("index")) <= 4
    got = {r["path"]: (r["key"], r["total"]) for r in state.results().filter(F.col("path").isin("p70", "p140", "p141", "p142")).collect()}
    assert got == {"p70": ("k1", 1), "p140": ("k70", 5), "p141": ("k70", 5), "p142": ("k71", 1)}


def test_changed_keys(spark):
    rows = lambda x: spark.createDataFrame(x, "key string, path string, value string")
    before = rows([("v:a", "p", "1"), ("v:b", "p", "1"), ("v:b", "q", "1"), ("e:a", "p", None), ("e:b", "p", None), ("v:same", "p", None)])
    after = rows([("v:a", "p", "2"), ("v:b", "p", "1"), ("e:a", "q", None), ("e:c", "p", None), ("v:same", "p", None)])
    got = changed_keys(before, after, F.col("key").startswith("v:"))
    assert sorted(r["key"] for r in got.collect()) == ["e:b", "e:c", "v:a", "v:b"]
