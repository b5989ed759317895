"""Small expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_of(column: Column, ranks: dict[str, int], other: int = 99) -> Column:
    """The rank of an enumeration's value."""
    out = F.lit(None).cast("int")
    for value, rank in ranks.items():
        out = F.when(column == value, F.lit(rank)).otherwise(out)
    return F.coalesce(out, F.lit(other))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def leaf(name: Column, separator: str = ".") -> Column:
    """What follows the last separator."""
    return F.substring_index(name, separator, -1)


def package_key(name: Column) -> Column:
    """Lower case, with hyphens for underscores."""
    return F.translate(F.lower(name), "_", "-")


def js_package(module: Column) -> Column:
    """``@scope/name`` or the first segment of a module path."""
    scoped = F.concat(F.lit("@"), F.split_part(F.substring(module, 2, 1 << 20), F.lit("/"), F.lit(1)), F.lit("/"), F.split_part(F.substring(module, 2, 1 << 20), F.lit("/"), F.lit(2)))
    return F.when(module.startswith("@"), scoped).otherwise(F.split_part(module, F.lit("/"), F.lit(1)))


def iso_time(seconds: Column) -> Column:
    """Epoch seconds as ISO text in UTC to the second."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
