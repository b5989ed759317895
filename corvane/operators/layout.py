"""Squarified treemap: row packing depends on all that was placed before, so a box is laid out in one task.

A box holds one workspace; boxes are independent and run in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squarify(areas: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles for areas in descending order that tile the box ``(x, y, w, h)``; areas are scaled to fill it."""
    total = sum(areas)
    if not areas or total <= 0 or w <= 0 or h <= 0:
        return []
    scale = w * h / total
    todo = [a * scale for a in areas]
    out: list[tuple[float, float, float, float]] = []
    at = 0
    while at < len(todo):
        side = min(w, h)
        count, row, worst = 0, 0.0, float("inf")
        while at + count < len(todo):
            grown = row + todo[at + count]
            big, small = todo[at], todo[at + count]
            ratio = max(side * side * big / (grown * grown), grown * grown / (side * side * small))
            if ratio > worst:
                break
            worst, row, count = ratio, grown, count + 1
        last = at + count == len(todo)
        thick = max(w, h) if last else row / side
        pos = 0.0
        for k in range(count):
            length = side - pos if k == count - 1 else todo[at + k] / row * side
            out.append((x, y + pos, thick, length) if w >= h else (x + pos, y, length, thick))
            pos += length
        if w >= h:
            x, w = x + thick, w - thick
        else:
            y, h = y + thick, h - thick
        at += count
    return out


def file_leaves(scores: DataFrame) -> DataFrame:
    """Files as leaves: ``(label, area, bucket, composite)``, with their lines as area, 1 at least."""
    return scores.select(F.col("file").alias("label"), F.greatest("loc", F.lit(1)).alias("area"), "bucket", "composite")


def symbol_leaves(scores: DataFrame) -> DataFrame:
    """Functions as leaves: the label is the last part of the symbol, the area its lines."""
    name = F.regexp_replace(F.substring_index("symbol_id", " ", -1), r"#\.$", "")
    loc = F.col("range.end.line") - F.col("range.start.line") + 1
    return scores.select(name.alias("label"), F.greatest(loc, F.lit(1)).alias("area"), "bucket", "composite")


def shortened(label: Column, n: int) -> Column:
    """At most ``n`` characters: the tail, after an ellipsis."""
    tail = F.concat(F.lit("…"), F.right(label, F.lit(max(1, n - 1)))) if n > 1 else F.lit("…")
    return F.when(F.char_length(label) <= n, label).otherwise(tail)


def treemap(leaves: DataFrame, box: str, label: str, area: str, width: float = 1000.0, height: float = 600.0) -> DataFrame:
    """``(box, label, area, x, y, w, h)``; areas below 1 count as 1, larger ones come first, ties by label."""
    rows = leaves.select(F.col(box).alias("box"), F.col(label).cast("string").alias("label"), F.greatest(F.col(area).cast("double"), F.lit(1.0)).alias("area"))
    kind = rows.schema["box"].dataType.simpleString()

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["area", "label"], ascending=[False, True], ignore_index=True)
        tiles = squarify(pdf["area"].tolist(), 0.0, 0.0, width, height)
        return pdf.join(pd.DataFrame(tiles, columns=["x", "y", "w", "h"]))

    return rows.groupBy("box").applyInPandas(lay, f"box {kind}, label string, area double, x double, y double, w double, h double").withColumnRenamed("box", box)
