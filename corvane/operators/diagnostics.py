"""Diagnostics: construction, union, order and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane import schemas
from corvane.operators.keys import rank_of


def build(rows: DataFrame, source: str, code: Column | str, severity: Column | str, message: Column, id_: Column, related: Column | None = None, fix: Column | None = None, ord_: str = "ord", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(file, range, ord, ...)`` as diagnostics, with further columns that are to stay."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    kinds = {f.name: f.dataType for f in _empty_schema().fields}
    return rows.select(
        id_.alias("id"),
        lit(severity).alias("severity"),
        F.lit(source).alias("source"),
        lit(code).alias("code"),
        message.alias("message"),
        "file",
        "range",
        F.lit(None).cast("string").alias("symbol"),
        (related if related is not None else F.array()).cast(kinds["related"]).alias("related"),
        (fix if fix is not None else F.lit(None)).cast(kinds["fix"]).alias("fix"),
        F.col(ord_).cast("long").alias("ord"),
        *keep,
    )


def _empty_schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schemas.DIAGNOSTICS)


def union(parts: list[DataFrame]) -> DataFrame:
    """A bag: nothing is deduplicated across sources."""
    return reduce(DataFrame.unionByName, parts)


def order() -> list[Column]:
    """The client's order: by severity, sources that look for generated code first, then file and line."""
    ai = F.when(F.col("source").isin(*schemas.AI_SOURCES), 0).otherwise(1)
    return [rank_of(F.col("severity"), schemas.SEVERITY_RANK), ai, F.col("file"), F.col("range.start.line"), F.col("source"), F.col("ord")]


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*order())


def by_severity(rows: DataFrame, first: int) -> DataFrame:
    """``(severity, n, first)``: the number of diagnostics of each severity, and the first so many in the client's order.

    The first rows are cut within each task before they are shuffled (for up to 1,000), so no severity is gathered.
    """
    counts = rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    placed = rows.withColumn("_k", F.row_number().over(Window.partitionBy("severity").orderBy(*order()))).filter(F.col("_k") <= first)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "file", "range", "source", "code", "message", "ord"))), lambda d: d.dropFields("_k"))
    return counts.join(placed.groupBy("severity").agg(listed.alias("first")), "severity").select("severity", "n", "first")


def snapshot(rows: DataFrame, prefix: int = 80) -> DataFrame:
    """``(file, line, code, severity, message_prefix)`` of the sources that need no external tool, by file, line and code."""
    own = rows.filter(F.col("source").isin(*schemas.AI_SOURCES))
    return own.select("file", F.col("range.start.line").alias("line"), "code", "severity", F.substring("message", 1, prefix).alias("message_prefix")).orderBy("file", "line", "code")


def chosen(rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, file: str | None = None) -> DataFrame:
    """Exclusion wins; an empty inclusion means all."""
    if include:
        rows = rows.filter(F.col("source").isin(*include))
    if exclude:
        rows = rows.filter(~F.col("source").isin(*exclude))
    return rows if file is None else rows.filter(F.col("file") == file)


def severe(severity: Column) -> Column:
    return severity.isin("error", "critical")


def per_file(rows: DataFrame) -> DataFrame:
    """``(file, diagnostics, errors, hallucinated)``."""
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("diagnostics"), F.count_if(severe(F.col("severity"))).alias("errors"), F.count_if(F.col("source") == "hallucination").alias("hallucinated"))


def per_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")


def client_severity(severity: Column) -> Column:
    """Five severities as an editor's four."""
    out = F.lit("Information")
    for mine, theirs in schemas.CLIENT_SEVERITY.items():
        out = F.when(severity == mine, theirs).otherwise(out)
    return out
