"""Queries of the engine's own operators over the star-schema, event and text tables, with their DuckDB equivalents.

Each query is one or a few operators of ``corvane.operators`` with other columns than those of a source
tree: customers stand for functions, nations for files, order lines for references, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.operators import arity, diagnostics, fanin, gate, health, intervals, keys, latest, layout, ordered, resolve, rules, slicing
from corvane.parse import udtf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- names and references ---------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size <= 40)
  AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_brand = 'Brand#13')
  AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_type = 'PROMO')
""")
def q_unresolved_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, sf_dir, "part")
    catalogs = (part.filter("p_size <= 40"), part.filter("p_brand = 'Brand#13'"), part.filter("p_type = 'PROMO'"))
    return resolve.unresolved(refs, *(("l_partkey", c, "p_partkey") for c in catalogs))


@query("""
SELECT p_partkey, lower(replace(regexp_extract(p_brand, '^[^#= <>!;\\[]*'), '_', '-')) AS brand_key,
  lower(replace(regexp_extract(p_type, '^[^#= <>!;\\[]*'), '_', '-')) AS type_key,
  lower(replace(regexp_extract(p_name, '^[^#= <>!;\\[]*'), '_', '-')) AS name_key
FROM part
""")
def q_normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda c: keys.package_key(F.regexp_extract(c, r"^[^#= <>!;\[]*", 0))
    return table(spark, sf_dir, "part").select("p_partkey", cut("p_brand").alias("brand_key"), cut("p_type").alias("type_key"), cut("p_name").alias("name_key"))


@query("SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def q_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
WHERE tag NOT IN ('p', 'a', 'li') GROUP BY tag
""")
def q_regex_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag"))
    counts = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return resolve.unresolved_if_any(counts, "tag", spark.createDataFrame([("p",), ("a",), ("li",)], "name string"), "name")


@query("""
SELECT page_id, CASE WHEN h LIKE '%.com' THEN 'com' WHEN h LIKE '%.org' THEN 'org' ELSE 'other' END AS host_class,
  CASE WHEN p LIKE '%.html' THEN 'html' WHEN p LIKE '%.php' THEN 'php' WHEN p = '' OR p = '/' THEN 'root' ELSE 'none' END AS path_class
FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)
""")
def q_language_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, p = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    host = F.when(h.endswith(".com"), "com").when(h.endswith(".org"), "org").otherwise("other")
    path = F.when(p.endswith(".html"), "html").when(p.endswith(".php"), "php").when(p.isin("", "/"), "root").otherwise("none")
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host_class"), path.alias("path_class"))


@query("""
SELECT a.p_partkey, b.leaf FROM part a
JOIN (SELECT DISTINCT leaf FROM (SELECT substr(split_part(p_name, ' ', -1), 2) AS leaf FROM part) WHERE leaf <> '') b ON suffix(a.p_name, b.leaf)
""")
def q_suffix_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    ends = part.select(F.expr("substr(substring_index(p_name, ' ', -1), 2)").alias("leaf")).distinct()
    return intervals.by_suffix(part, "p_name", ends, "leaf").select("p_partkey", "leaf")


# --- contents ---------------------------------------------------------------------------------------------------


@query("""
SELECT d.doc_id, d.sha, d.loc, c.copies FROM
  (SELECT doc_id, sha256(text) AS sha, length(text) - length(replace(text, chr(10), '')) + 1 AS loc FROM documents) d
JOIN (SELECT sha256(text) AS sha, count(*) AS copies FROM documents GROUP BY 1) c ON d.sha = c.sha
""")
def q_blob_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    blobs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), loc.cast("long").alias("loc"))
    return blobs.join(blobs.groupBy("sha").agg(F.count(F.lit(1)).alias("copies")), "sha").select("doc_id", "sha", "loc", "copies")


@query("""
SELECT doc_id, sha256(text) AS sha, sha256(text) IS DISTINCT FROM lag(sha256(text)) OVER (PARTITION BY source, lang ORDER BY doc_id) AS changed FROM documents
""")
def q_changed_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("sha"))
    return latest.changed(blobs, ["source", "lang"], "doc_id", "sha").select("doc_id", "sha", "changed")


@query("""
WITH live AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE lang = 'en'),
keyed AS (SELECT doc_id, sha256(text) || ':' || source AS key FROM documents)
SELECT doc_id, key FROM keyed WHERE split_part(key, ':', 1) IN (SELECT sha FROM live)
""")
def q_artifact_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sha = F.sha2("text", 256)
    return latest.live_artifacts(docs.select("doc_id", F.concat(sha, F.lit(":"), "source").alias("key")), docs.filter("lang = 'en'").select(sha.alias("blob_sha")))


_SECRET, _DEFAULT = rules.RULES[6].pattern, rules.RULES[11].pattern


@query(f"""
SELECT doc_id, rule, severity FROM (
  SELECT doc_id, 'slop.hardcoded-secret' AS rule, 'error' AS severity FROM documents WHERE regexp_matches(text, '{_SECRET.replace("'", "''")}')
  UNION ALL
  SELECT doc_id, 'slop.default-admin-password', 'error' FROM documents WHERE regexp_matches(text, '{_DEFAULT.replace("'", "''")}')
  UNION ALL
  SELECT doc_id, 'slop.pretend-implemented', 'warning' FROM documents WHERE regexp_matches(text, '{rules.RULES[12].pattern}'))
""")
def q_rule_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "rule", "severity")


@query("""
WITH n AS (SELECT count(*) AS n FROM documents) SELECT DISTINCT files_done, n AS files_total FROM (
  SELECT unnest(range(0, n + 1, 50)) AS files_done, n FROM n UNION ALL SELECT n, n FROM n)
""")
def q_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.ticks(table(spark, sf_dir, "documents"), ["source", "doc_id"], 50)


# --- units, calls and health --------------------------------------------------------------------------------------


@query("SELECT l_orderkey, count(DISTINCT l_partkey) AS fan_out FROM lineitem GROUP BY l_orderkey")
def q_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("callees"))
    return units.select("l_orderkey", fanin.fan_out(F.col("callees")).cast("long").alias("fan_out"))


@query("""
WITH edges AS (SELECT DISTINCT l.l_partkey AS caller, s.s_name AS callee FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey),
units AS (SELECT s_suppkey AS unit, s_name AS name FROM supplier)
SELECT u.unit, count(e.caller) AS fan_in FROM units u
LEFT JOIN edges e ON split_part(e.callee, '#', -1) = split_part(u.name, '#', -1) AND e.caller <> u.unit GROUP BY u.unit
""")
def q_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller"), "l_suppkey").distinct()
    edges = lines.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("callee")), "l_suppkey").select("caller", "callee")
    return fanin.fan_in_edges(edges, supplier.select(F.col("s_suppkey").alias("unit"), "s_name"), "caller", "callee", "unit", "s_name", "#")


@query("""
WITH one AS (SELECT p_brand, p_type, p_size FROM part GROUP BY ALL HAVING count(*) = 1)
SELECT l.l_orderkey, l.l_linenumber, l.l_quantity AS argc, one.p_size - 10 AS min_args, one.p_size + 10 AS max_args
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN one USING (p_brand, p_type, p_size)
WHERE l.l_quantity < one.p_size - 10 OR l.l_quantity > one.p_size + 10
""")
def q_unambiguous_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    on = ["p_brand", "p_type", "p_size"]
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("argc")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    defs = part.select(*on, (F.col("p_size") - 10).alias("min_args"), (F.col("p_size") + 10).alias("max_args"))
    return arity.arity_mismatches(calls.select("l_orderkey", "l_linenumber", "argc", *on), defs, on).select("l_orderkey", "l_linenumber", "argc", "min_args", "max_args")


_WINDOW = "o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 14 DAY"


@query(f"""
SELECT c.c_custkey, coalesce(n, 0) AS recent_orders, round(coalesce(total, 0), 2) AS recent_total FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total FROM orders WHERE {_WINDOW} GROUP BY 1) o ON o.o_custkey = c.c_custkey
""")
def q_churn_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = _recent(table(spark, sf_dir, "orders"))
    sums = recent.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    out = table(spark, sf_dir, "customer").select("c_custkey").join(sums, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("recent_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("recent_total"))


def _recent(orders: DataFrame) -> DataFrame:
    """Orders of the last 14 days; the newest date is a scalar subquery, which is pushed to the scan as a filter."""
    last = orders.agg(F.max("o_orderdate").alias("m"))
    return orders.filter(F.col("o_orderdate") >= last.scalar() - F.expr("INTERVAL 14 DAYS"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as functions: churn is their recent orders, complexity their urgent ones, fan-in their orders, fan-out their priorities."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    last = orders.agg(F.max("o_orderdate").alias("m")).scalar()
    recent = F.col("o_orderdate") >= last - F.expr("INTERVAL 14 DAYS")
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(recent).alias("churn"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("cc"),
        F.count(F.lit(1)).alias("fan_in"),
        F.size(F.collect_set("o_orderpriority")).cast("long").alias("fan_out"),
        F.count_if(recent & (F.col("o_orderstatus") == "F")).alias("hallucinated"),
    )
    units = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(per, "c_custkey", "left").fillna(0)
    return health.unit_scores(units.withColumns({"diagnostics": F.lit(0), "untested": F.lit(False)}))


_UNITS = f"""per AS (SELECT o_custkey, count(*) FILTER ({_WINDOW}) AS churn, count(*) FILTER (o_orderpriority = '1-URGENT') AS cc, count(*) AS fan_in,
    count(DISTINCT o_orderpriority) AS fan_out, count(*) FILTER ({_WINDOW} AND o_orderstatus = 'F') AS hallucinated FROM orders GROUP BY 1),
raw AS (SELECT c_custkey, c_nationkey, coalesce(churn, 0) AS churn, coalesce(cc, 0) AS cc, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(hallucinated, 0) AS hallucinated
  FROM customer LEFT JOIN per ON o_custkey = c_custkey),
parts AS (SELECT *, least(churn / 100.0::DOUBLE, 1) AS novelty, least(cc / 30.0::DOUBLE, 1) AS cognitive_complexity, least((fan_in + fan_out) / 20.0::DOUBLE, 1) AS coupling,
  (CASE WHEN hallucinated > 0 THEN 0.3::DOUBLE ELSE 0 END) AS ai_signal FROM raw),
units AS (SELECT *, round(least(0.2::DOUBLE * novelty + 0.3::DOUBLE * cognitive_complexity + 0.2::DOUBLE * coupling + 0.3::DOUBLE * ai_signal, 1), 6) AS composite FROM parts)"""
_BUCKET = "CASE WHEN composite < 0.3 THEN 'green' WHEN composite < 0.6 THEN 'yellow' ELSE 'red' END AS bucket"


@query(f"""
WITH {_UNITS}
SELECT c_custkey, round(novelty, 6) AS novelty, round(cognitive_complexity, 6) AS cognitive_complexity, round(coupling, 6) AS coupling, round(ai_signal, 6) AS ai_signal, composite, {_BUCKET},
  CASE greatest(novelty, cognitive_complexity, coupling, ai_signal) WHEN novelty THEN 'novelty' WHEN cognitive_complexity THEN 'cognitive_complexity' WHEN coupling THEN 'coupling' ELSE 'ai_signal' END AS dominant
FROM units
""")
def q_health_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ("novelty", "cognitive_complexity", "coupling", "ai_signal")
    return _customers(spark, sf_dir).select("c_custkey", *(F.round(p, 6).alias(p) for p in parts), "composite", "bucket", health.dominant().alias("dominant"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files: lines are the orders of a unit, diagnostics the units that are not green."""
    units = _customers(spark, sf_dir).withColumn("loc", F.col("fan_in"))
    per = units.groupBy("c_nationkey").agg(
        F.sum("loc").alias("loc"),
        F.count_if(F.col("bucket") != "green").alias("diagnostics"),
        F.sum("hallucinated").alias("hallucinated"),
        F.count_if(F.col("bucket") == "red").alias("errors"),
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    files = nation.join(per, "c_nationkey", "left").fillna(0)
    return health.file_scores(files, units, "c_nationkey")


_FILES = f"""{_UNITS},
per_file AS (SELECT c_nationkey, sum(fan_in) AS loc, count(*) FILTER (composite >= 0.3) AS diagnostics, sum(hallucinated) AS hallucinated, count(*) FILTER (composite >= 0.6) AS errors,
  sum((composite * greatest(fan_in, 1))::DECIMAL(28, 12))::DOUBLE / sum(greatest(fan_in, 1)) AS mean, count(*) AS n_units, sum(cc) AS cc, sum(fan_in) AS fan_in, sum(fan_out) AS fan_out FROM units GROUP BY 1),
files AS (SELECT n_name, coalesce(loc, 0) AS loc, coalesce(diagnostics, 0) AS diagnostics, coalesce(hallucinated, 0) AS hallucinated, coalesce(errors, 0) AS errors, mean, coalesce(n_units, 0) AS n_units,
  coalesce(cc, 0) AS cc, coalesce(p.fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM nation LEFT JOIN per_file p ON c_nationkey = n_nationkey),
signal AS (SELECT *, least(0.3::DOUBLE * least(diagnostics / 10.0::DOUBLE, 1) + 0.7::DOUBLE * least(hallucinated / 2.0::DOUBLE, 1), 1) AS ai FROM files),
scored AS (SELECT n_name, n_units::BIGINT AS n_units, round(ai, 6) AS ai_signal, round(greatest(
    CASE WHEN n_units = 0 THEN least(0.7::DOUBLE * ai + 0.3::DOUBLE * least(loc / 500.0::DOUBLE, 1), 1) ELSE least(0.7::DOUBLE * mean + 0.3::DOUBLE * ai, 1) END,
    least(0.4::DOUBLE * hallucinated, 1), CASE WHEN errors > 0 THEN 0.3::DOUBLE ELSE 0 END), 6) AS composite,
  round(least(cc / (30.0::DOUBLE * greatest(n_units, 1)), 1), 6) AS cognitive_complexity, round(least((fan_in + fan_out) / (20.0::DOUBLE * greatest(n_units, 1)), 1), 6) AS coupling FROM signal)"""


@query(f"WITH {_FILES} SELECT n_name, n_units, cognitive_complexity, coupling, ai_signal, composite, {_BUCKET} FROM scored")
def q_health_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.ranked(_nations(spark, sf_dir), "n_name").select("n_name", "n_units", "cognitive_complexity", "coupling", "ai_signal", "composite", "bucket")


@query(f"WITH {_UNITS} SELECT c_custkey, composite, {_BUCKET} FROM units ORDER BY composite DESC, c_custkey LIMIT 50")
def q_health_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.ranked(_customers(spark, sf_dir), "c_custkey", 50).select("c_custkey", "composite", "bucket")


@query(f"""
WITH {_FILES}
SELECT count(*) AS files, count(*) FILTER (composite < 0.3) AS green, count(*) FILTER (composite >= 0.3 AND composite < 0.6) AS yellow, count(*) FILTER (composite >= 0.6) AS red,
  (SELECT count(*) FROM customer) AS functions, (SELECT count(*) FROM events WHERE event_type = 'error') AS diagnostics FROM scored
""")
def q_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n")).scalar()
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'").agg(F.count(F.lit(1)).alias("n")).scalar()
    return health.summary(_nations(spark, sf_dir), functions, errors)


@query("""
SELECT o_orderkey AS symbol, 'f-sig' AS fact_id, 'signature' AS kind, 'function order-' || o_orderkey || ' (' || n || ' LOC)' AS content, 0::BIGINT AS ord
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
UNION ALL
SELECT l_orderkey, 'f-call-' || (i - 1), 'call', 'calls part-' || l_partkey, i FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
""")
def q_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("loc"), F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    units = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey")
    calls = F.transform("parts", lambda p: F.concat(F.lit("part-"), p.cast("string")))
    functions = units.select(F.col("o_orderkey").alias("symbol_id"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("name"), F.lit("f").alias("file"), "loc", calls.alias("callees"))
    none = spark.createDataFrame([], schemas.IMPORTS)
    return gate.facts(functions, none).withColumn("ord", F.col("ord").cast("long"))


# --- intervals, order and streams in batch ----------------------------------------------------------------------------


@query("""
WITH e AS (SELECT user_id, ts, event_id FROM events),
cut AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e),
grp AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM cut)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM grp GROUP BY user_id, s
""")
def q_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(latest.sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", "30 minutes"), "first_ts", "last_ts")


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("""
WITH cut AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
grp AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM cut),
spans AS (SELECT user_id, 'session' AS kind, min(ts) AS lo, max(ts) AS hi FROM grp GROUP BY user_id, s
  UNION ALL SELECT DISTINCT user_id, 'day', date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND FROM events),
met AS (SELECT e.event_id, s.kind, s.lo, s.hi, row_number() OVER (PARTITION BY e.event_id ORDER BY s.hi - s.lo, s.kind, s.lo) AS r FROM events e JOIN spans s ON s.user_id = e.user_id AND e.ts BETWEEN s.lo AND s.hi)
SELECT event_id, kind, lo, hi FROM met WHERE r = 1
""")
def q_innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    burst = _ntz(latest.sessions(events, "user_id", "ts", "30 minutes"), "first_ts", "last_ts").select("user_id", F.lit("session").alias("kind"), F.col("first_ts").alias("lo"), F.col("last_ts").alias("hi"))
    start = F.date_trunc("day", "ts").cast("timestamp_ntz")
    days = events.select("user_id", start.alias("lo")).distinct().select("user_id", F.lit("day").alias("kind"), "lo", (F.col("lo") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL '0.000001' SECOND")).alias("hi"))
    width = F.col("hi") - F.col("lo")
    return intervals.innermost(events, burst.unionByName(days), ["user_id"], F.col("ts").between(F.col("lo"), F.col("hi")), ["event_id"], [width, F.col("kind"), F.col("lo")])


@query("SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def q_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""
SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END DESC, ts, event_id) = 1
""")
def q_spotlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return latest.strongest(events, "user_id", keys.rank_of(F.col("event_type"), {"error": 3, "purchase": 2, "click": 1}, 0), ["ts", "event_id"], ["event_type", "event_id"])


@query("""
WITH l AS (SELECT user_id, date_diff('second', max(ts), (SELECT max(ts) FROM events)) AS d FROM events GROUP BY user_id)
SELECT user_id, d AS seconds, CASE WHEN d < 3 THEN 'live' WHEN d < 60 THEN 'recent' ELSE 'idle' END AS presence, CASE WHEN d < 60 THEN 'active ' || d || 's ago' ELSE 'idle ' || (d // 60) || 'm' END AS label FROM l
""")
def q_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("m")).scalar()
    per = events.groupBy("user_id").agg(F.max("ts").alias("seen"))
    whole = lambda c: F.unix_seconds(c.cast("timestamp"))
    per = per.withColumn("seconds", whole(last) - whole(F.col("seen")))
    return per.select("user_id", "seconds", latest.presence(F.col("seconds")).alias("presence"), latest.presence_label(F.col("seconds")).alias("label"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def q_iso_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", keys.iso_time(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("iso"))


_SEVERITY = {"error": "critical", "purchase": "error", "signup": "warning", "click": "info", "view": "hint"}


def _mapped(column: str, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


@query("""
WITH d AS (SELECT event_id, user_id, event_type AS source, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'error' WHEN 'signup' THEN 'warning' WHEN 'click' THEN 'info' ELSE 'hint' END AS severity FROM events WHERE event_type <> 'signup')
SELECT event_id, source, severity, CASE severity WHEN 'critical' THEN 'Error' WHEN 'error' THEN 'Error' WHEN 'warning' THEN 'Warning' WHEN 'info' THEN 'Information' ELSE 'Hint' END AS client_severity,
  CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 WHEN 'info' THEN 3 ELSE 4 END AS rank, severity IN ('error', 'critical') AS severe,
  count(*) OVER (PARTITION BY user_id, source) AS of_source FROM d
""")
def q_diag_union_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("source"))
    parts = [events.filter(F.col("source") == s).withColumn("severity", F.lit(v)) for s, v in _SEVERITY.items()]
    rows = diagnostics.chosen(diagnostics.union(parts), exclude=["signup"])
    counts = rows.groupBy("user_id", "source").agg(F.count(F.lit(1)).alias("of_source"))
    rank = keys.rank_of(F.col("severity"), schemas.SEVERITY_RANK)
    return rows.join(counts, ["user_id", "source"]).select("event_id", "source", "severity", diagnostics.client_severity(F.col("severity")).alias("client_severity"), rank.alias("rank"), diagnostics.severe(F.col("severity")).alias("severe"), "of_source")


@query("SELECT event_type AS source, count(*) AS n FROM events GROUP BY 1")
def q_diag_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.per_source(table(spark, sf_dir, "events").select(F.col("event_type").alias("source")))


@query("""
SELECT o_orderkey, file, line, col, severity, code, message FROM (
  SELECT o_orderkey, 'o' || o_custkey || '.ts' AS file, greatest(o_orderkey % 90 - 1, 0)::INT AS line, greatest(o_orderkey % 7 - 1, 0)::INT AS col,
    CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'warning' END AS severity, 'TS' || (2000 + o_orderkey % 500) AS code, 'status ' || o_orderstatus || ': ' || o_orderpriority AS message FROM orders)
""")
def q_report_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.sources import reports

    k = F.col("o_orderkey")
    text = F.format_string("o%d.ts(%d,%d): %s TS%d: status %s: %s", "o_custkey", k % 90, k % 7, F.when(F.col("o_orderstatus") == "F", "error").otherwise("warning"), 2000 + k % 500, "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf_dir, "orders").select(k, text.alias("line"))
    return reports.tsc_lines(lines, "line").select("o_orderkey", "file", F.col("range.start.line").alias("line"), F.col("range.start.col").alias("col"), "severity", "code", "message")


# --- slices and the gate --------------------------------------------------------------------------------------------


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as functions: a turn is a statement that writes its first three words and reads all others."""
    words = F.split("text", " ")
    rest = F.slice(words, F.lit(4), F.greatest(F.size(words) - 3, F.lit(0)))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.slice(words, 1, 3).alias("writes"), rest.alias("reads"))
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "writes", "reads"))), lambda s: F.struct(s["writes"].alias("writes"), s["reads"].alias("reads"))).alias("statements"))


def _slice_oracle(backward: bool) -> str:
    first, step, mine, theirs = ("max(turn)", "- 1", "writes", "reads") if backward else ("min(turn)", "+ 1", "reads", "writes")
    return f"""
WITH RECURSIVE s AS (SELECT conv_id, turn, string_split(text, ' ')[1:3] AS writes, string_split(text, ' ')[4:] AS reads FROM conversations),
o AS (SELECT conv_id, {first} AS turn FROM s GROUP BY 1),
walk(conv_id, turn, names, taken) AS (
  SELECT s.conv_id, s.turn, s.{theirs}, [s.turn] FROM s JOIN o USING (conv_id, turn)
  UNION ALL
  SELECT s.conv_id, s.turn, CASE WHEN len(taken) < 10 AND list_has_any(s.{mine}, names) THEN list_distinct(names || s.{theirs}) ELSE names END,
    CASE WHEN len(taken) < 10 AND list_has_any(s.{mine}, names) THEN taken || [s.turn] ELSE taken END
  FROM walk JOIN s ON s.conv_id = walk.conv_id AND s.turn = walk.turn {step})
SELECT conv_id, array_to_string(list_sort(arg_{"min" if backward else "max"}(taken, turn)), ',') AS taken, len(arg_{"min" if backward else "max"}(taken, turn)) >= 10 AS truncated FROM walk GROUP BY conv_id
"""


def _sliced(spark: SparkSession, sf_dir: str, backward: bool) -> DataFrame:
    talks = _talks(spark, sf_dir)
    s = F.col("statements")
    taken = slicing.backward(s, F.size(s) - 1) if backward else slicing.forward(s, F.lit(0))
    return talks.select("conv_id", F.array_join(taken.cast("array<string>"), ",").alias("taken"), (F.size(taken) >= 10).alias("truncated"))


@query(_slice_oracle(True))
def q_slice_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sliced(spark, sf_dir, True)


@query(_slice_oracle(False))
def q_slice_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sliced(spark, sf_dir, False)


SENTENCES_SQL = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, unnest(generate_series(0, len(s) - 1))::INT AS ord, unnest(s) AS claim FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents)")
def q_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(gate.sentences(F.col("text"))).alias("ord", "claim"))


_STOP = "[" + ", ".join(f"'{w}'" for w in gate.STOP_WORDS) + "]"
TOKENS_SQL = r"list_filter(list_transform(list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}_]+'), lambda t: strlen(t) >= 3), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda t: NOT list_contains({1}, t))"
_CLAIMS = f"""claims AS (SELECT doc_id, unnest(generate_series(0, len(s) - 1))::INT AS ord, unnest(s) AS claim, content FROM
  (SELECT d.doc_id, {SENTENCES_SQL.replace("text", "d.text")} AS s, b.text AS content FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))),
gated AS (SELECT doc_id, ord, list_has_any({TOKENS_SQL.format("claim", _STOP)}, {TOKENS_SQL.format("content", _STOP)}) AS entailed FROM claims)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sentences against the fact that its benchmark item states; items are numbered from 0 and dealt to documents in turn."""
    items = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("n")).scalar()
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.array(F.struct(F.lit("f").alias("id"), F.col("text").alias("content"))).alias("facts"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % items).alias("item_id"))
    return gate.gated(docs.join(gate.tokenised(bench, "facts"), "item_id"), "text", "facts").select("doc_id", "ord", "entailed", "supporting_fact_ids", "reason")


@query(f"WITH {_CLAIMS} SELECT doc_id, ord, entailed, CASE WHEN entailed THEN 'f' ELSE '' END AS support, CASE WHEN entailed THEN NULL ELSE '{gate.NO_SUPPORT}' END AS reason FROM gated")
def q_token_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("doc_id", "ord", "entailed", F.array_join("supporting_fact_ids", ",").alias("support"), "reason")


@query(f"WITH {_CLAIMS} SELECT doc_id, count(*) AS claims, round(count(*) FILTER (entailed) / count(*), 6) AS ratio, count(*) FILTER (entailed) / count(*) < 0.7 AS low_confidence FROM gated GROUP BY 1")
def q_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.verified_ratio(_claims(spark, sf_dir), ["doc_id"]).withColumn("ratio", F.round("ratio", 6))


@query("""
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 1), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 1), 6) AS recall FROM (
  SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn, count(*) FILTER (quality = 1 AND toxic = 1) AS tn FROM labels)
""")
def q_gate_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = gate.confusion(F.col("quality") == 1, F.col("toxic") == 1)
    return table(spark, sf_dir, "labels").agg(*cells).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


# --- layout and parsing (not expressible in SQL) -----------------------------------------------------------------------


@query()
def q_treemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    sizes = orders.join(customer, "o_custkey").groupBy("c_nationkey").agg(F.sum("n").alias("n"))
    return layout.treemap(nation.join(sizes, "c_nationkey", "left").fillna(0, ["n"]), "n_regionkey", "n_name", "n")


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sentences as the body of a small module: each second sentence is a condition."""
    body = F.transform(gate.sentences(F.col("text")), lambda s, i: F.concat(F.when(i % 2 == 0, "    if ready and able or idle:\n        ").otherwise("    "), F.lit("say("), F.concat(F.lit('"'), F.regexp_replace(s, r'["\\\n\r]', " "), F.lit('"')), F.lit(")")))
    source = F.concat(F.lit("import os\n\ndef act_"), F.col("doc_id").cast("string"), F.lit("(ready, able, idle=False):\n"), F.array_join(body, "\n"), F.lit("\n"))
    # Parsing is bound by CPU, so texts are dealt out to all cores first where the table has fewer splits than these; a large table stays as it is.
    docs, least = table(spark, sf_dir, "documents").select("doc_id", "text"), 2 * spark.sparkContext.defaultParallelism
    docs = docs.repartition(least, "doc_id") if docs.rdd.getNumPartitions() < least else docs
    return docs.select(F.concat(F.lit("m/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), source.alias("source"))


@query()
def q_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udtf.parsed(_snippets(spark, sf_dir)).select("path", F.explode("functions").alias("f")).select("path", "f.name", "f.loc", "f.callees")


@query()
def q_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udtf.parsed(_snippets(spark, sf_dir)).select("path", F.explode("functions").alias("f")).select("path", "f.name", "f.cc")
