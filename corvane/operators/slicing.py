"""Program slices as ordered folds over a unit's statements.

A unit's statements are one array, ``struct<writes, reads, ...>`` in source order, so a slice is a higher-order fold
in one row: no shuffle, no window.  The length of the array is that of one function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STATE = "struct<names:array<string>,taken:array<int>>"


def _fold(statements: Column, order: Column, seed: Column, origin: Column, hops: Column, needs: str, gives: str) -> Column:
    """Walks ``order`` (indices); takes a statement that shares a name with the state, and adds the names it gives."""
    start = F.struct(seed.alias("names"), F.array(origin).alias("taken")).cast(_STATE)

    def step(state: Column, i: Column) -> Column:
        s = F.get(statements, i)
        take = (F.size(state["taken"]) < hops) & F.arrays_overlap(s[needs], state["names"])
        return F.when(F.coalesce(take, F.lit(False)), F.struct(F.array_union(state["names"], s[gives]).alias("names"), F.concat(state["taken"], F.array(i)).alias("taken"))).otherwise(state)

    return F.sort_array(F.aggregate(order, start, step)["taken"])


def backward(statements: Column, origin: Column, max_hops: Column | int = 10) -> Column:
    """Indices of the statements that influence the origin; names once needed stay needed."""
    hops = F.greatest(max_hops if isinstance(max_hops, Column) else F.lit(max_hops), F.lit(1))
    order = F.when(origin > 0, F.sequence(origin - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return _fold(statements, order, F.get(statements, origin)["reads"], origin, hops, "writes", "reads")


def forward(statements: Column, origin: Column, max_hops: Column | int = 10) -> Column:
    """Indices of the statements that the origin influences."""
    hops = F.greatest(max_hops if isinstance(max_hops, Column) else F.lit(max_hops), F.lit(1))
    last = F.size(statements) - 1
    order = F.when(origin < last, F.sequence(origin + 1, last)).otherwise(F.array().cast("array<int>"))
    return _fold(statements, order, F.get(statements, origin)["writes"], origin, hops, "reads", "writes")


def origin_index(statements: Column, line: Column, col: Column) -> Column:
    """First statement that contains the point (its end included); the first one if none does."""

    def holds(s: Column) -> Column:
        r = s["range"]
        after = (r["start"]["line"] < line) | ((r["start"]["line"] == line) & (r["start"]["col"] <= col))
        before = (r["end"]["line"] > line) | ((r["end"]["line"] == line) & (r["end"]["col"] >= col))
        return after & before

    found = F.array_position(F.transform(statements, holds), True)
    return F.greatest(found - 1, F.lit(0)).cast("int")


def slices(units: DataFrame, origin: Column, direction: str = "backward", kind: str = "thin", max_hops: int = 10, statements: str = "statements") -> DataFrame:
    """Adds ``nodes``, ``edges`` and ``truncated`` to each unit that has statements.

    Edges chain consecutive nodes as ``data``.  ``truncated`` is set for full slices, and once the hops are used up.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction is backward or forward, not {direction}")
    s = F.col(statements)
    fold = backward if direction == "backward" else forward
    out = units.filter(F.size(s) > 0).withColumn("_at", origin.cast("int"))
    out = out.withColumn("_taken", fold(s, F.col("_at"), max_hops))
    nodes = F.transform("_taken", lambda i, k: F.struct(k.alias("id"), F.get(s, i)["range"].alias("range"), F.get(s, i)["label"].alias("label")))
    out = out.withColumn("nodes", nodes)
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: i > 0), lambda i: F.struct(F.get(F.col("nodes"), i - 1)["id"].alias("from"), F.get(F.col("nodes"), i)["id"].alias("to"), F.lit("data").alias("kind")))
    cut = F.lit(kind == "full") | (F.size("nodes") >= max(max_hops, 1))
    return out.withColumns({"edges": pairs, "truncated": cut}).drop("_at", "_taken")
