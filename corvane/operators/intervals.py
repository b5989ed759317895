"""Points in intervals, and references by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.ordered import carried_forward, numbered, running_total


def innermost(points: DataFrame, intervals: DataFrame, on: list[str], inside: Column, point_id: list[str], prefer: list[Column], width: tuple[Column, Column, Column, int] | None = None) -> DataFrame:
    """For each point the interval that ``prefer`` orders first among those that contain it; points in none are left out.

    Both tables share the columns ``on`` and no others.  ``inside`` is the containment test.  The best
    interval is an aggregate (``min_by``), so it is reduced before the shuffle and needs no window.
    ``width = (point, start, end, size)`` adds a bin to the join key, for keys with very many intervals: an
    interval is then repeated in each bin of ``size`` that it covers.
    """
    if width:
        point, start, end, size = width
        points = points.withColumn("_bin", F.floor(point / size))
        intervals = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(start / size), F.floor(end / size))))
        on = [*on, "_bin"]
    kept = [c for c in intervals.columns if c not in on]
    joined = points.join(intervals, on).filter(inside)
    best = joined.groupBy(*point_id).agg(F.min_by(F.struct(*kept), F.struct(*(p.alias(f"p{i}") for i, p in enumerate(prefer)))).alias("_best"))
    return best.select(*point_id, "_best.*")


def innermost_nested(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, tie: str, stretches: int | None = None) -> DataFrame:
    """Each point with the columns of the innermost interval that contains it, ends included; points in none are left out.

    For intervals that are nested or apart, as those of a tree are.  Points and ends of intervals are one sorted sequence: how many
    intervals are open at a point is a running total, and the innermost of them is the last that was opened at this depth, as on a stack.  Work follows the rows of
    both tables, however many intervals lie around each other, and stretches of the sequence are taken apart, so one file may hold any share.
    Of equal intervals the one with the larger ``tie`` is the inner one.  Points and intervals share the columns ``on`` and no others; their
    places are whole numbers.
    """
    own = [c for c in points.columns if c not in on]
    theirs = [c for c in intervals.columns if c not in on]
    held = F.struct(*theirs)
    none, asked = F.lit(None).cast(intervals.select(held.alias("x")).schema["x"].dataType), F.struct(*own)
    nothing = F.lit(None).cast(points.select(asked.alias("x")).schema["x"].dataType)
    row = lambda place, kind, first, second, step, p, i: [place.cast("long").alias("_at"), F.lit(kind).alias("_kind"), first.cast("long").alias("_a"), second.cast("long").alias("_b"), F.lit(step).alias("_step"), p.alias("_p"), i.alias("_i")]
    zero = F.lit(0)
    events = (
        intervals.select(*on, *row(F.col(start), 0, -F.col(end), F.col(tie), 1, nothing, held))
        .unionByName(points.select(*on, *row(F.col(at), 1, zero, zero, 0, asked, none)))
        .unionByName(intervals.select(*on, *row(F.col(end), 2, -F.col(start), -F.col(tie), -1, nothing, none)))
    )
    placed = numbered(events, [*on, "_at", "_kind", "_a", "_b"], "_n")
    deep = running_total(placed, on, "_n", F.col("_step"), "_depth", stretches)
    found = carried_forward(deep, [*on, "_depth"], "_n", F.col("_i"), "_best", stretches)
    return found.filter("_kind = 1 AND _depth > 0").select(*on, "_p.*", "_best.*")


def packed_span(start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """Lines first, then columns, as one number."""
    return (end_line - start_line) * 100_000 + (end_col - start_col)


def by_suffix(texts: DataFrame, text: str, leaves: DataFrame, leaf: str, head: int = 3) -> DataFrame:
    """Pairs of a text and a leaf that it ends with.

    The last ``head`` characters only tell which lengths the leaves with this end have; a text then meets leaves by equality, once for each of
    these lengths.  So texts that share their end don't meet in pairs, and work follows the output.  Leaves shorter than ``head`` have
    ends of their own length.  Empty leaves end nothing.
    """
    keyed = leaves.filter(F.char_length(leaf) > 0).withColumns({"_size": F.char_length(leaf), "_leaf": F.col(leaf)})
    short = F.least("_size", F.lit(head))
    lengths = keyed.groupBy(short.alias("_n"), F.expr(f"right(_leaf, least(_size, {head}))").alias("_end")).agg(F.collect_set("_size").alias("_sizes"))
    ends = texts.withColumn("_n", F.explode(F.array(*(F.lit(k) for k in range(1, head + 1))))).withColumn("_end", F.expr(f"right(`{text}`, _n)"))
    cut = ends.join(lengths, ["_n", "_end"]).withColumn("_size", F.explode("_sizes")).filter(F.col("_size") <= F.char_length(text)).withColumn("_leaf", F.expr(f"right(`{text}`, _size)"))
    return cut.drop("_n", "_end", "_sizes", "_size").join(keyed.drop("_size"), "_leaf").drop("_leaf")
