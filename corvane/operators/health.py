"""Health scores of units and of the files that hold them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.keys import clamp01


@dataclass(frozen=True)
class Weights:
    novelty: float = 0.2
    cognitive_complexity: float = 0.3
    coupling: float = 0.2
    ai_signal: float = 0.3


def bucket(composite: Column) -> Column:
    return F.when(composite < 0.3, "green").when(composite < 0.6, "yellow").otherwise("red")


def unit_scores(units: DataFrame, weights: Weights = Weights(), digits: int = 6) -> DataFrame:  # noqa: B008
    """Adds the four components, ``composite`` and ``bucket``.

    Reads ``churn, cc, fan_in, fan_out, diagnostics, hallucinated, untested`` (a boolean), all numbers not null.
    """
    hall = F.when(F.col("hallucinated") > 0, 1.0).otherwise(0.0)
    bare = F.when((F.col("churn") > 0) & F.col("untested"), 1.0).otherwise(0.0)
    parts = {
        "novelty": clamp01(F.col("churn") / 100.0),
        "cognitive_complexity": clamp01(F.col("cc") / 30.0),
        "coupling": clamp01((F.col("fan_in") + F.col("fan_out")) / 20.0),
        "ai_signal": clamp01(0.4 * clamp01(F.col("diagnostics") / 5.0) + 0.3 * hall + 0.1 * bare),
    }
    total = F.lit(0.0)
    for name in parts:
        total = total + getattr(weights, name) * F.col(name)
    out = units.withColumns(parts).withColumn("composite", F.round(clamp01(total), digits))
    return out.withColumn("bucket", bucket(F.col("composite")))


def file_scores(files: DataFrame, units: DataFrame, key: str = "file", digits: int = 6) -> DataFrame:
    """One row for each file: its units' composites weighted by lines, blended with the file's own signal, and floors.

    ``files(key, loc, diagnostics, hallucinated, errors)``; ``units(key, loc, composite, cc, fan_in, fan_out)``.  Sums are
    of decimals, so they don't depend on the order in which tasks finish.
    """
    w = F.greatest(F.col("loc"), F.lit(1))
    dec = lambda c: c.cast("decimal(28,12)")
    rolled = units.groupBy(key).agg(
        (F.sum(dec(F.col("composite") * w)).cast("double") / F.sum(w)).alias("_mean"),
        F.count(F.lit(1)).alias("n_units"),
        F.sum("cc").cast("long").alias("cc"),
        F.sum("fan_in").cast("long").alias("fan_in"),
        F.sum("fan_out").cast("long").alias("fan_out"),
    )
    out = files.join(rolled, key, "left").fillna(0, ["n_units", "cc", "fan_in", "fan_out"])
    ai = clamp01(0.3 * clamp01(F.col("diagnostics") / 10.0) + 0.7 * clamp01(F.col("hallucinated") / 2.0))
    blended = F.when(F.col("n_units") == 0, clamp01(0.7 * F.col("ai_signal") + 0.3 * clamp01(F.col("loc") / 500.0))).otherwise(clamp01(0.7 * F.col("_mean") + 0.3 * F.col("ai_signal")))
    floors = F.greatest(clamp01(0.4 * F.col("hallucinated")), F.when(F.col("errors") > 0, 0.3).otherwise(0.0))
    n = F.greatest(F.col("n_units"), F.lit(1))
    out = out.withColumn("ai_signal", ai).withColumn("composite", F.round(F.greatest(blended, floors), digits))
    out = out.withColumns({
        "novelty": F.lit(0.0),
        "cognitive_complexity": F.round(clamp01(F.col("cc") / (30.0 * n)), digits),
        "coupling": F.round(clamp01((F.col("fan_in") + F.col("fan_out")) / (20.0 * n)), digits),
        "ai_signal": F.round("ai_signal", digits),
        "bucket": bucket(F.col("composite")),
    })
    return out.drop("_mean")


def ranked(scores: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Worst first, with the key as tie-break; with a limit (at least 1) only the worst."""
    out = scores.orderBy(F.desc("composite"), key)
    return out if limit is None else out.limit(max(1, limit))


def snapshot(scores: DataFrame, key: str = "file") -> DataFrame:
    """``(path, bucket, composite_hundredths)``, by path."""
    return scores.select(F.col(key).alias("path"), "bucket", F.round(F.col("composite") * 100).cast("int").alias("composite_hundredths")).orderBy("path")


def degraded(capabilities: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any capability of a workspace is not available; one that isn't known counts as available."""
    return capabilities.groupBy(*keys).agg(F.bool_or(~F.coalesce("available", F.lit(True))).alias("degraded"))


def dominant(parts: tuple[str, ...] = ("novelty", "cognitive_complexity", "coupling", "ai_signal")) -> Column:
    """Name of the component with the largest value; the first of equals."""
    top = F.greatest(*(F.col(p) for p in parts))
    out = F.lit(parts[-1])
    for p in reversed(parts[:-1]):
        out = F.when(F.col(p) == top, p).otherwise(out)
    return out


def summary(files: DataFrame, functions: int | Column, diagnostics: int | Column) -> DataFrame:
    """One row: files, functions, diagnostics and the number of files in each bucket."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    colors = [F.count_if(F.col("bucket") == b).alias(b) for b in ("green", "yellow", "red")]
    return files.agg(F.count(F.lit(1)).alias("files"), *colors).withColumns({"functions": lit(functions), "diagnostics": lit(diagnostics)})
