"""What a query's tasks hold must not grow with its tables."""

from pyspark.sql import functions as F

from corvane.operators import resolve, rules, twigs
from corvane.parse import python_units, udtf
from corvane.plans import store, trees
from corvane.plans.workspace import Workspace
from tests.conftest import tree_of


def _rows_by_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_files_of_one_split_are_dealt_out(spark, tmp_path):
    k = F.col("id")
    spark.range(60_000).select(k.alias("p_partkey"), (k % 50 + 1).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    sizes = _rows_by_task(trees._raw(spark, str(tmp_path)).select("path"))
    assert sum(sizes) == 60_001
    assert max(sizes) < 2 * trees._FILES_A_TASK  # the texts of all files were one task's before


def test_patterns_meet_nodes_where_these_lie(spark):
    files = spark.createDataFrame([("a.py", "python", "eval(x)\ntry:\n    f()\nexcept:\n    pass\n")], "path string, language string, source string")
    nodes = udtf.nodes(files)
    hits = rules.structural_hits(nodes)
    assert {r["rule"] for r in hits.collect()} == {"slop.eval-on-untyped-input", "slop.silent-except"}
    assert {tuple(r) for r in rules.structural_hits(udtf.nodes(files, rules.node_conditions())).collect()} == {tuple(r) for r in hits.collect()}
    assert udtf.nodes(files, rules.node_conditions()).count() < nodes.count()


def test_conditions_are_those_of_the_patterns():
    source = "def f():\n    raise NotImplementedError('x')\nrequests.get(u, verify=False)\nopen(p)\n"
    every = python_units.nodes(source)
    keep = udtf._kept(twigs.conditions(rules._twigs(rules.RULES))["python"])
    some = python_units.nodes(source, keep)
    assert some == [n for n in every if keep(n["kind"], n["word"], n["n"])]
    assert {n["word"] for n in some} >= {"def", "raise", "requests.get", "verify", "open"}


def test_names_of_a_catalogue_are_not_broadcast(spark):
    """Their plan's size is that of the few numbers they are made of; what can't be a local module isn't one key."""
    names = spark.range(1000).select(F.lit("js").alias("ecosystem"), F.concat(F.lit("a"), "id").alias("name"))
    imports = spark.range(3000).select(F.lit("a.ts").alias("file"), F.lit("typescript").alias("language"), F.concat(F.lit("a"), "id").alias("module"))
    present = spark.createDataFrame([("js",)], "ecosystem string")
    own = spark.createDataFrame([("python", "a5"), ("js", "a2000")], "ecosystem string, name string")
    found = resolve.unknown_imports(imports, names, present, own)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        by_task = _rows_by_task(resolve.unknown_imports(imports, names, present, own))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(by_task) == 2000 and max(by_task) < 1000  # null keys were all one task's


def test_files_are_parsed_in_counted_tasks_and_churn_is_not_broadcast(spark, tmp_path, monkeypatch):
    k = F.col("id")
    spark.range(400).select(k.alias("p_partkey"), (k % 50 + 1).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(store, "FILES_A_TASK", 20)
    ws = trees._workspace(spark, str(tmp_path))
    sizes = _rows_by_task(ws.parsed.select("path"))
    assert sum(sizes) == 400 and max(sizes) < 60  # joined by their size in the shuffle, one task's before
    assert "BroadcastHashJoin [file" not in ws.red_functions()._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_made_for_slices_only(spark):
    files = {"a.py": "def f(x):\n    y = x\n    return y\n", "b.ts": "function g(x) { const y = x; return y }\n"}
    ws = Workspace(tree_of(spark, files))
    assert {r["n"] for r in ws.parsed.select(F.size("bodies").alias("n")).collect()} == {0}
    assert {r["name"] for r in ws.functions().select("name").collect()} == {"f", "g"}
    assert {(r["name"], r["n"]) for r in ws.bodies().select("name", F.size("statements").alias("n")).collect()} == {("f", 2), ("g", 2)}
    ws.release()
