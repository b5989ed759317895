"""Audit of written summaries against the facts they should rest on.

``python -m jobs.grounding_audit --config jobs/grounding_audit.json --summaries DIR --facts DIR --output DIR``

Reads summaries and facts, judges every sentence by the facts of the summary's symbol, and writes three Parquet tables under ``output``:

* ``claims``, by language: every sentence with its verdict and the facts that support it;
* ``report``, by language: a row for each summary with its claims, the share that is supported, and whether that is too low;
* ``totals``: the same by language and source.

Each run replaces what an earlier one wrote, so running again gives the same tables, also after a run that broke off.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import gate
from jobs.common import log, main

CLAIMS = "source string, summary string, ord int, claim string, entailed boolean, supporting_fact_ids array<string>, lang string"
REPORT = "source string, summary string, claims long, supported long, ratio double, low_confidence boolean, lang string"


@dataclass(frozen=True)
class GroundingAudit:
    """Paths, and SQL expressions over the columns of the two tables."""

    summaries: str
    facts: str
    output: str
    #: Of a summary: its id, text, symbol, language and source.
    summary: str = "doc_id"
    text: str = "text"
    symbol: str = "symbol"
    lang: str = "lang"
    source: str = "source"
    #: Of a fact: its symbol, id and content.
    fact_symbol: str = "symbol"
    fact_id: str = "fact_id"
    content: str = "content"
    #: Share of supported claims below which a summary is of low confidence.
    floor: float = 0.7


def judged(summaries: DataFrame, facts: DataFrame, s: GroundingAudit) -> DataFrame:
    """Every sentence of every summary, and a row without a sentence for a summary that has none.

    The facts of a symbol are few: they describe one function.  A summary whose symbol has no facts has no supported sentence.
    """
    known = facts.select(F.expr(s.fact_symbol).cast("string").alias("_symbol"), F.struct(F.expr(s.fact_id).cast("string").alias("id"), F.coalesce(F.expr(s.content).cast("string"), F.lit("")).alias("content")).alias("fact"))
    known = gate.tokenised(known.groupBy("_symbol").agg(F.array_sort(F.collect_list("fact")).alias("facts")), "facts")
    named = lambda e: F.coalesce(F.nullif(F.expr(e).cast("string"), F.lit("")), F.lit("und"))
    rows = summaries.select(named(s.lang).alias("lang"), named(s.source).alias("source"), F.expr(s.summary).cast("string").alias("summary"), F.coalesce(F.expr(s.text).cast("string"), F.lit("")).alias("text"), F.expr(s.symbol).cast("string").alias("_symbol"))
    return gate.verdicts(rows.join(known, "_symbol", "left"), "text", "facts").select("lang", "source", "summary", F.posexplode_outer("verdicts").alias("ord", "v")).select("lang", "source", "summary", "ord", "v.claim", "v.entailed", "v.supporting_fact_ids")


def run(spark: SparkSession, s: GroundingAudit) -> DataFrame:
    """Runs the audit and returns the report as it stands in the output."""
    summaries, facts = spark.read.parquet(s.summaries), spark.read.parquet(s.facts)
    log.info("reads %s summaries from %s and %s facts from %s", summaries.count(), s.summaries, facts.count(), s.facts)
    out = judged(summaries, facts, s)
    # A language's rows go to as many files as they need, and one file of a small language isn't cut by every task.
    out.hint("rebalance", "lang").write.mode("overwrite").partitionBy("lang").parquet(f"{s.output}/claims")
    claims = spark.read.schema(CLAIMS).parquet(f"{s.output}/claims")
    report = claims.groupBy("lang", "source", "summary").agg(F.count("ord").alias("claims"), F.count_if("entailed").alias("supported"))
    share = F.try_divide("supported", "claims")
    report = report.select("lang", "source", "summary", "claims", "supported", share.alias("ratio"), F.coalesce(share < s.floor, F.lit(False)).alias("low_confidence"))
    report.hint("rebalance", "lang").write.mode("overwrite").partitionBy("lang").parquet(f"{s.output}/report")
    back = spark.read.schema(REPORT).parquet(f"{s.output}/report")

    totals = back.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("summaries"), F.sum("claims").alias("claims"), F.sum("supported").alias("supported"), F.count_if("low_confidence").alias("low_confidence"))
    totals.write.mode("overwrite").parquet(f"{s.output}/totals")
    done = spark.read.schema(totals.schema).parquet(f"{s.output}/totals").agg(F.sum("summaries").alias("summaries"), F.sum("claims").alias("claims"), F.sum("supported").alias("supported")).first()
    log.info("wrote %s claims, %s of them supported, and the reports of %s summaries to %s", done["claims"] or 0, done["supported"] or 0, done["summaries"] or 0, s.output)
    return back


if __name__ == "__main__":
    main(GroundingAudit, run, __doc__)
