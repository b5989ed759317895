"""Calls that disagree with the one definition they can mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unambiguous(defs: DataFrame, keys: list[str]) -> DataFrame:
    """Definitions whose key is defined once: the definition's columns, aggregated before the shuffle."""
    others = [c for c in defs.columns if c not in keys]
    one = defs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.any_value(c).alias(c) for c in others))
    return one.filter("_n = 1").drop("_n")


def arity_mismatches(calls: DataFrame, defs: DataFrame, on: list[str], count: str = "argc", least: str = "min_args", most: str = "max_args") -> DataFrame:
    """Calls joined to their only definition where the count lies outside the bounds; a null upper bound is none.

    ``calls`` and ``defs`` share the columns ``on`` and no others.
    """
    joined = calls.join(unambiguous(defs, on), on)
    return joined.filter((F.col(count) < F.col(least)) | (F.col(count) > F.col(most)))
