"""Fan-out and fan-in of named units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.keys import leaf


def fan_out(callees: Column) -> Column:
    """Number of distinct callee texts."""
    return F.coalesce(F.size(F.array_distinct(callees)), F.lit(0))


def fan_in(units: DataFrame, unit_id: str = "symbol_id", name: str = "name", callees: str = "callees", separator: str = ".") -> DataFrame:
    """``(unit_id, fan_in)``: callee texts of other units whose last segment is the unit's own, each text once a caller.

    Callees are counted by last segment first, and a unit's own are taken off again, so a popular
    name never multiplies callers by definitions.
    """
    texts = units.select(F.explode(F.array_distinct(F.col(callees))).alias("_text"))
    calls = texts.groupBy(leaf(F.col("_text"), separator).alias("_leaf")).agg(F.count(F.lit(1)).alias("_calls"))
    own_leaf = leaf(F.col(name), separator)
    own = F.size(F.filter(F.array_distinct(F.coalesce(F.col(callees), F.array().cast("array<string>"))), lambda c: leaf(c, separator) == F.col("_leaf")))
    named = units.select(F.col(unit_id), own_leaf.alias("_leaf"), F.col(callees).alias(callees)).withColumn("_own", own)
    return named.join(calls, "_leaf", "left").select(unit_id, F.coalesce(F.col("_calls") - F.col("_own"), F.lit(0)).cast("long").alias("fan_in"))


def fan_in_edges(edges: DataFrame, units: DataFrame, caller: str, callee: str, unit: str, name: str, separator: str = ".") -> DataFrame:
    """The same for a table of distinct ``(caller, callee text)`` edges and a table of units: ``(unit, fan_in)``."""
    said = edges.select(F.col(caller).alias("_caller"), leaf(F.col(callee), separator).alias("_leaf"))
    calls = said.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_calls"))
    named = units.select(F.col(unit), leaf(F.col(name), separator).alias("_leaf"))
    own = said.groupBy(F.col("_caller").alias(unit), "_leaf").agg(F.count(F.lit(1)).alias("_own"))
    out = named.join(own, [unit, "_leaf"], "left").join(calls, "_leaf", "left")
    return out.select(unit, (F.coalesce("_calls", F.lit(0)) - F.coalesce("_own", F.lit(0))).cast("long").alias("fan_in"))
