"""Queries of whole workspaces: every part is a source file of one tree, with size, imports, calls and churn that follow from its columns.

Part ``k`` of size ``s`` is ``p{k}.py``: it imports ``os`` and, for each fifth, a package that nobody has, and defines one function with ``s``
conditions, which calls twenty others in each fourth.  Its churn is ``3 s`` lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans import store
from corvane.plans.catalog import query, table
from corvane.plans.workspace import Workspace
from corvane.shipping import dealt
from corvane.sources import manifests

#: Files that a task makes and parses, about: some MB of text.
_FILES_A_TASK = 5_000

_CALLS = "".join(f"    g{j}(a)\n" for j in range(20))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    imported = F.when(k % 5 == 0, F.concat(F.lit("lib_"), k.cast("string"))).otherwise("json")
    text = F.concat(F.lit("import os\nimport "), imported, F.lit("\ndef f"), k.cast("string"), F.lit("(a):\n"), F.repeat(F.lit("    if a:\n        pass\n"), F.col("p_size")), F.when(k % 4 == 0, _CALLS).otherwise(""), F.lit("    return a\n"))
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", _FILES_A_TASK)
    files = parts.select(F.concat(F.lit("p"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("t"))
    manifest = spark.createDataFrame([("requirements.txt", "requests\n")], "path string, t string")
    return files.unionByName(manifest).select("path", F.encode("t", "UTF-8").alias("content"), F.octet_length("t").cast("long").alias("size"))


def _workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    churn = table(spark, sf_dir, "part").select(F.concat((F.col("p_size") * 2).cast("string"), F.lit("\t"), F.col("p_size").cast("string"), F.lit("\tp"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("text"))
    return Workspace(_raw(spark, sf_dir), numstat=churn)


_TREE = """t AS (SELECT p_partkey AS k, p_size AS s, 'p' || p_partkey || '.py' AS file, 'f' || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS hall, CASE WHEN p_partkey % 4 = 0 THEN 20 ELSE 0 END AS calls FROM part),
u AS (SELECT *, (5 + 2 * s + calls)::INT AS loc, least(3 * s / 100.0, 1.0)::DOUBLE AS novelty, least(s / 30.0, 1.0)::DOUBLE AS cc01, (calls / 20.0)::DOUBLE AS coupling FROM t),
f AS (SELECT *, round(0.2 * novelty + 0.3 * cc01 + 0.2 * coupling + 0.3 * 0.3 * hall, 6) AS composite FROM u),
w AS (SELECT *, round(greatest(0.7 * composite + 0.3 * (0.3 * hall / 10 + 0.7 * hall / 2), 0.4 * hall), 6) AS file_composite FROM f)"""
_BUCKET = "CASE WHEN {0} < 0.3 THEN 'green' WHEN {0} < 0.6 THEN 'yellow' ELSE 'red' END"


@query(f"WITH {_TREE} SELECT file AS path, 'python' AS language, loc FROM u")
def q_ws_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).files().select("path", "language", "loc")


@query(f"WITH {_TREE} SELECT 'local . corvane ' || file || ' ' || name || '#.' AS symbol_id, file, name, s AS cc, calls AS fan_out, 0 AS ord FROM u")
def q_ws_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).functions().select("symbol_id", "file", "name", "cc", F.size("callees").alias("fan_out"), "ord")


@query(f"WITH {_TREE} SELECT file, round(file_composite, 6) AS composite, {_BUCKET.format('file_composite')} AS bucket, s AS cc, calls AS fan_out, hall AS hallucinated FROM w")
def q_ws_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _workspace(spark, sf_dir).health()
    return out.select("file", F.round("composite", 6).alias("composite"), "bucket", F.col("cc").cast("long").alias("cc"), F.col("fan_out").cast("long").alias("fan_out"), F.col("hallucinated").cast("long").alias("hallucinated"))


@query(f"WITH {_TREE} SELECT name, composite, novelty, cc01 AS cognitive_complexity, coupling FROM f WHERE composite > 0.6")
def q_ws_red_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).red_functions().select("name", "composite", "novelty", "cognitive_complexity", "coupling")


@query(f"WITH {_TREE} (SELECT 'file' AS kind, file AS worst, file_composite AS composite FROM w ORDER BY file_composite DESC, file LIMIT 1) UNION ALL (SELECT 'symbol', name, composite FROM f ORDER BY composite DESC, 'local . corvane ' || file LIMIT 1)")
def q_ws_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _workspace(spark, sf_dir)
    return ws.worst().select(F.lit("file").alias("kind"), F.col("file").alias("worst"), "composite").unionByName(ws.worst_function().select(F.lit("symbol").alias("kind"), F.col("name").alias("worst"), "composite"))


@query(f"WITH {_TREE} SELECT file, 'hallucination/unknown-import' AS code, 'critical' AS severity, 1 AS line, 'no package ''lib_' || k || ''' in requirements.txt / pyproject.toml' AS message FROM t WHERE hall = 1")
def q_ws_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).diagnostics().select("file", "code", "severity", F.col("range.start.line").alias("line"), "message")


@query(f"WITH {_TREE} SELECT file, line, name, hover FROM (SELECT file, unnest([0, 2, 3, loc - 2]) AS line, name FROM u) p, LATERAL (SELECT CASE WHEN line >= 2 THEN p.name END AS hover) WHERE line >= 2")
def q_ws_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four points of every file; the first lies outside its function."""
    ws = _workspace(spark, sf_dir)
    points = ws.files().select("path", F.explode(F.array(F.lit(0), F.lit(2), F.lit(3), F.col("loc") - 2)).alias("line")).select(F.monotonically_increasing_id().alias("q"), F.col("path").alias("file"), "line", F.lit(2).alias("col"))
    points = points.withColumn("q", F.concat_ws(":", "file", F.col("line").cast("string")))
    found = ws.enclosing(points).select("q", "file", "name")
    hover = ws.enclosing(points, "hover").select("q", F.col("name").alias("hover"))
    return found.join(hover, "q").select("file", F.split_part("q", F.lit(":"), F.lit(2)).cast("int").alias("line"), "name", "hover")


@query(f"WITH {_TREE} SELECT file, fact_id, content FROM (SELECT file, name, s, calls, k, 'f-sig' AS fact_id, 'function ' || name || ' (' || (2 * s + calls + 2) || ' LOC)' AS content FROM t UNION ALL SELECT file, name, s, calls, k, 'f-imp-0', 'imports os' FROM t UNION ALL SELECT file, name, s, calls, k, 'f-imp-1', 'imports ' || CASE WHEN k % 5 = 0 THEN 'lib_' || k ELSE 'json' END FROM t)")
def q_ws_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of every symbol but its calls."""
    rows = _workspace(spark, sf_dir).facts().filter("kind <> 'call'")
    return rows.select(F.split_part("symbol", F.lit(" "), F.lit(4)).alias("file"), "fact_id", "content")


@query("SELECT * FROM (VALUES ('pyright', false, 'no report'), ('tsc', false, 'nothing in the tree needs it'), ('rust-analyzer', false, 'nothing in the tree needs it'), ('semgrep', false, 'no report'), ('pytea', false, 'nothing in the tree needs it'), ('churn', true, 'numstat given')) v(capability, available, reason) WHERE EXISTS (SELECT 1 FROM part)")
def q_ws_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("pyright", "tsc", "rust-analyzer", "semgrep", "pytea", "churn")
    return _workspace(spark, sf_dir).capabilities().filter(F.col("capability").isin(*names))


@query("SELECT count(*) FILTER (p_partkey % 3 = 0) AS hits, count(*) FILTER (p_partkey % 3 > 0) AS misses FROM part")
def q_ws_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest that was saved before: a third of the files is as it was, a third has changed, a third is new; of another version of the analyzer none counts."""
    now = _workspace(spark, sf_dir).files()
    k = F.regexp_extract("path", r"p(\d+)", 1).cast("long")
    saved = store.manifest(now).filter(k % 3 < 2).withColumn("blob_sha", F.when(k % 3 == 1, F.lit("old")).otherwise(F.col("blob_sha")))
    other = store.manifest(now).filter(k % 3 == 2).withColumn("analyzer_version", F.lit("0"))
    return store.cache_counts(now, saved.unionByName(other))


@query("""
SELECT DISTINCT ecosystem, name, source_file FROM (
  SELECT 'python' AS ecosystem, 'pkg-' || p_partkey AS name, 'requirements.txt' AS source_file FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'python', 'lib' || p_partkey, 'requirements.txt' FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT 'js', '@s/a' || p_partkey, 'package.json' FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT 'rust', 'cr-' || p_partkey, 'Cargo.lock' FROM part WHERE p_partkey % 4 = 2 UNION ALL SELECT 'rust', 'cr_' || p_partkey, 'Cargo.lock' FROM part WHERE p_partkey % 4 = 2)
""")
def q_manifest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of manifest together with files that are none, broken ones and empty ones; lines end as on other systems in half of them."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    end = F.when(k % 8 < 4, "\r\n").otherwise("\n")
    pip = F.concat(F.lit("# c"), end, F.lit("Pkg_"), n, F.lit("==1 ; python_version > '3'"), end, end, F.lit("-e ."), end, F.lit("lib"), n, F.lit("[x]<2"))
    npm = F.concat(F.lit('{"dependencies": {"@s/a'), n, F.lit('": "1"}, "peerDependencies": null}'))
    lock = F.concat(F.lit('[[package]]\nname = "cr-'), n, F.lit('"\n'))
    kind = k % 4
    path = F.when(kind == 0, "requirements.txt").when(kind == 1, "package.json").when(kind == 2, "Cargo.lock").otherwise("sub/package.json")
    files = table(spark, sf_dir, "part").select(path.alias("path"), F.when(kind == 0, pip).when(kind == 1, npm).when(kind == 2, lock).otherwise(npm).alias("source"))
    odd = [("package.json", "{"), ("package.json", ""), ("package-lock.json", "[1]"), ("yarn.lock", None), ("Cargo.toml", "= broken"), ("pyproject.toml", "")]
    return manifests.packages(files.unionByName(spark.createDataFrame(odd, "path string, source string")))
