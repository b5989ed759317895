"""Both jobs over the whole tables, twice into one new folder, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import gate
from corvane.plans.catalog import SENTENCES_SQL, TOKENS_SQL
from corvane.session import work_folder
from jobs import change_digest, grounding_audit

#: Events as changes of files, in SQL that Spark and DuckDB share.
PATH = "concat('src/u', CAST(user_id AS STRING), CASE event_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.rs' ELSE '.md' END)"
KIND = "CASE event_type WHEN 'click' THEN 'modify' WHEN 'view' THEN 'access' WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'create' ELSE 'modify' END"


def job1_grounding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a summary whose facts are the passage of one benchmark item, dealt to documents in turn."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    s = grounding_audit.GroundingAudit(f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", work_folder(spark), symbol=f"doc_id % {max(1, items)}", fact_symbol="item_id", fact_id="concat('b', item_id)", content="text")
    grounding_audit.run(spark, s)
    return grounding_audit.run(spark, s).select("lang", "source", "summary", "claims", "supported", F.round("ratio", 6).alias("ratio"), "low_confidence")


def job2_change_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a change of a file."""
    s = change_digest.ChangeDigest(f"{sf_dir}/events*.parquet", work_folder(spark), seq="event_id", path=PATH, kind=KIND)
    change_digest.run(spark, s)
    out = change_digest.run(spark, s)
    return out.select(F.col("day").cast("string").alias("day"), "path", "last_kind", "last_seq", "changes", "bursts", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_ts"), F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_grounding_audit": job1_grounding_audit, "job2_change_digest": job2_change_digest}

_STOP = "[" + ", ".join(f"'{w}'" for w in gate.STOP_WORDS) + "]"
ORACLES = {
    "job1_grounding_audit": f"""
WITH s AS (SELECT coalesce(nullif(lang, ''), 'und') AS lang, coalesce(nullif(source, ''), 'und') AS source, doc_id::VARCHAR AS summary, {SENTENCES_SQL.replace("text", "coalesce(d.text, '')")} AS s, b.text AS content
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT greatest(count(*), 1) FROM benchmark)),
e AS (SELECT lang, source, summary, content, unnest(CASE WHEN len(s) > 0 THEN s ELSE [NULL] END) AS claim FROM s),
j AS (SELECT lang, source, summary, claim, claim IS NOT NULL AND content IS NOT NULL AND list_has_any({TOKENS_SQL.format("coalesce(claim, '')", _STOP)}, {TOKENS_SQL.format("coalesce(content, '')", _STOP)}) AS ok FROM e)
SELECT lang, source, summary, count(claim) AS claims, count(*) FILTER (ok) AS supported, round(count(*) FILTER (ok) / nullif(count(claim), 0), 6) AS ratio,
  coalesce(count(*) FILTER (ok) / nullif(count(claim), 0) < 0.7, false) AS low_confidence FROM j GROUP BY lang, source, summary
""",
    "job2_change_digest": f"""
WITH c AS (SELECT event_id AS seq, {PATH} AS path, {KIND} AS kind, ts, ts::DATE AS day FROM events),
r AS (SELECT * FROM c WHERE kind <> 'access' AND path NOT LIKE '%.md'),
g AS (SELECT *, lag(ts) OVER (PARTITION BY day, path ORDER BY ts) AS before FROM r)
SELECT strftime(day, '%Y-%m-%d') AS day, path, arg_max(kind, seq) AS last_kind, max(seq) AS last_seq, count(*) AS changes, count(*) FILTER (before IS NULL OR ts - before > INTERVAL 30 MINUTE) AS bursts,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts FROM g GROUP BY day, path
""",
}
