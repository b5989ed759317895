"""Operators over one long order: values carried along it, and places in it, without a task that sees all of a key or of the table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import work_folder

#: Rows of a stretch of the order, about.
STRETCH = 1_000_000
#: Stretches at most; beyond, they grow.
STRETCHES = 5_000
#: Bins by which keys are counted first.
BINS = 10_007


def needed(rows: DataFrame, keys: list[str]) -> int:
    """How many stretches the order takes: one, if no key holds more rows than a stretch does.

    Keys are first counted by ``BINS`` bins, so that only a table in which some bin holds more than that is shuffled by key.
    """
    counted = lambda by: rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
    held = counted([F.pmod(F.hash(*keys), F.lit(BINS))] if keys else [])
    if keys and (held["most"] or 0) > STRETCH:
        held = counted(keys)
    return min(STRETCHES, math.ceil(held["all"] / STRETCH)) if (held["most"] or 0) > STRETCH else 1


def stretch(rows: DataFrame, order: str, stretches: int) -> Column:
    """The stretch of the order to which a row belongs: cuts are approximate quantiles, so that each holds about as many rows.

    Rows of one order value share a stretch.  A null comes before all others.  A row is compared with every so many-th cut, and then with those between two of these.
    """
    if stretches <= 1:
        return F.lit(0)
    at = [k / stretches for k in range(1, stretches)]
    cuts = rows.agg(F.percentile_approx(order, at, 10 * stretches).alias("c")).first()["c"] or []
    kind, cuts = rows.schema[order].dataType, sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    each = math.isqrt(len(cuts)) + 1
    parts = [cuts[i : i + each] for i in range(0, len(cuts), each)]
    above = lambda some: F.size(F.filter(some, lambda c: F.coalesce(F.col(order) > c, F.lit(False))))
    listed = lambda some: F.array(*(F.lit(c).cast(kind) for c in some))
    part = above(listed([p[-1] for p in parts]))  # parts that lie below the row as a whole
    return F.when(part == len(parts), len(cuts)).otherwise(part * each + above(F.get(F.array(*map(listed, parts)), part)))


def carried_forward(rows: DataFrame, keys: list[str], order: str, value: Column, out: str, stretches: int | None = None) -> DataFrame:
    """Adds ``out``: of all earlier rows of the key the last ``value`` that isn't null.

    This is an as-of join once both sides are one table, with a null ``value`` on the rows that only ask.  A key's rows are taken by
    stretches of the order; what each stretch ends with is carried into the later ones, as few rows as there are stretches.  So a key, or no key
    at all, may hold any share of the rows.  Where no key holds more rows than a stretch, the order isn't cut.  Rows of equal order don't see each
    other's values reliably: the order should be unique within a key.  Without ``stretches`` the rows are counted, so they should be cheap to read again.
    """
    stretches = needed(rows, keys) if stretches is None else stretches
    if stretches <= 1:
        along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_v", value).withColumn(out, F.last("_v", ignorenulls=True).over(along)).drop("_v")
    base = rows.withColumns({"_v": value, "_s": stretch(rows, order, stretches)})
    before = Window.partitionBy(*keys, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    here = base.withColumn("_here", F.last("_v", ignorenulls=True).over(before))
    ends = base.groupBy(*keys, "_s").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(order))).alias("_end"))
    along = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(along)).select(*(F.col(k).alias(f"_c_{k}") for k in keys), F.col("_s").alias("_c_s"), "_carry")
    on = F.col("_s") == F.col("_c_s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    joined = here.join(carry.filter("_carry IS NOT NULL"), on, "left")
    return joined.select(*rows.columns, F.coalesce("_here", "_carry").alias(out))


def running_total(rows: DataFrame, keys: list[str], order: str, value: Column, out: str, stretches: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the key's rows up to and with this one, taken by stretches as ``carried_forward`` does."""
    stretches = needed(rows, keys) if stretches is None else stretches
    base = rows.withColumns({"_v": value, "_s": stretch(rows, order, stretches)})
    here = base.withColumn("_here", F.sum("_v").over(Window.partitionBy(*keys, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = base.groupBy(*keys, "_s").agg(F.sum("_v").alias("_sum")).withColumn("_carry", F.sum("_sum").over(along))
    carry = carry.select(*(F.col(k).alias(f"_c_{k}") for k in keys), F.col("_s").alias("_c_s"), "_carry")
    on = F.col("_s") == F.col("_c_s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    return here.join(carry, on, "left").select(*rows.columns, (F.col("_here") + F.coalesce("_carry", F.lit(0))).alias(out))


def numbered(rows: DataFrame, order: list, out: str = "place") -> DataFrame:
    """Adds the place of each row in the order, from 1 and without gaps; among equal rows any.

    Two passes: the sorted rows are written with their place in their own range, and then what all earlier ranges hold is added, one number for each.
    """
    sorted_ = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    folder = f"{work_folder(rows.sparkSession)}/numbered"
    sorted_.write.parquet(folder)
    kept = rows.sparkSession.read.schema(sorted_.schema).parquet(folder)
    kept = kept.withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as the sort has ranges
    first = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_first")
    return kept.join(F.broadcast(first), "_range").select(*rows.columns, (F.col("_first") + F.col("_at") + 1).alias(out))


def ticks(rows: DataFrame, order: list, every: int = 50) -> DataFrame:
    """Progress ``(files_done, files_total)``: at the start, after each ``every`` rows of the order, and at the end; also of an empty table.

    Any order will do, with gaps and ties; a tick that falls on the end is there once.
    """
    keys = rows.select(*(F.col(c).alias(f"_o{i}") if isinstance(c, str) else c.alias(f"_o{i}") for i, c in enumerate(order)))
    total = keys.agg(F.count(F.lit(1)).alias("files_total"))
    some = numbered(keys, keys.columns, "files_done").filter(F.col("files_done") % every == 0).select("files_done")
    ends = total.select(F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), "files_total"))).alias("files_done"))
    return some.unionByName(ends).distinct().withColumn("files_total", total.scalar()).select("files_done", "files_total")
