"""Operators over the order of rows: latest states, changes, sessions, ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.ordered import carried_forward


def latest_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; an aggregate, so states are reduced before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    return best.select(*keys, "_last.*")


def changed(rows: DataFrame, key: list[str], version: str, value: str, stretches: int | None = None) -> DataFrame:
    """Adds ``previous`` and ``changed``: whether the value differs from the key's previous version; a first one counts as changed unless it is null.

    The previous version is carried along the order, so a key may hold any share of the rows.
    """
    out = carried_forward(rows, key, version, F.struct(value), "_before", stretches)
    return out.withColumn("previous", F.col(f"_before.{value}")).withColumn("changed", ~F.col(value).eqNullSafe(F.col("previous"))).drop("_before")


def sessions(rows: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Debounced bursts: rows of a key less than the gap apart belong together: ``(key, first_ts, last_ts, n)``.

    Spark's session windows merge partial sessions before and after the shuffle.
    """
    burst = rows.groupBy(F.col(key), F.session_window(F.col(ts).cast("timestamp"), gap)).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return burst.select(key, "first_ts", "last_ts", "n")


def presence(delta_seconds: Column) -> Column:
    """``live`` below 3 seconds, ``recent`` below a minute, else ``idle``."""
    return F.when(delta_seconds < 3, "live").when(delta_seconds < 60, "recent").otherwise("idle")


def presence_label(delta_seconds: Column) -> Column:
    minutes = F.floor(delta_seconds / 60)
    return F.when(delta_seconds < 60, F.concat(F.lit("active "), F.floor(delta_seconds).cast("string"), F.lit("s ago"))).otherwise(F.concat(F.lit("idle "), minutes.cast("string"), F.lit("m")))


def strongest(rows: DataFrame, key: str, priority: Column, order: list[str], keep: list[str]) -> DataFrame:
    """For each key the row of highest priority, the first by ``order`` among equals."""
    rank = F.struct((-priority).alias("p"), *order)
    return rows.groupBy(key).agg(F.min_by(F.struct(*keep), rank).alias("_best")).select(key, "_best.*")


def live_artifacts(artifacts: DataFrame, blobs: DataFrame, key: str = "key", sha: str = "blob_sha") -> DataFrame:
    """Artifacts whose key begins, before its colon, with the hash of a live blob."""
    alive = blobs.select(F.col(sha).alias("_sha")).distinct()
    return artifacts.join(alive, F.split_part(key, F.lit(":"), F.lit(1)) == F.col("_sha"), "left_semi")


def unseen(blobs: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("blob_sha", "language")) -> DataFrame:
    """One row for each content that isn't parsed yet: parse these, append the result, join it back to all paths."""
    return blobs.dropDuplicates(list(keys)).join(known.select(*keys).distinct(), list(keys), "left_anti")
