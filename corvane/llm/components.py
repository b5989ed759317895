"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` of longs → ``(id, component)``: for each linked id the smallest id reachable.

    Every round passes the smallest label to the neighbours and then to the label's own label
    (pointer jumping), so long chains shorten quickly; a round ends in a written table.  Labels only
    fall, hence the loop ends; repeated and reversed links and loops are harmless; no links give an
    empty table.  A hub with very many neighbours is pre-aggregated before its shuffle, and joins on
    it are between two plain exchanges, which adaptive execution can split.
    """
    both = scratch.table(f"{tag}-links", links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = scratch.table(f"{tag}-0", both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"), F.lit(True).alias("moved")))
    for i in range(1, max_rounds + 1):
        label = state.select(F.col("id").alias("b"), "component")
        heard = both.join(label, "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        near = state.select("id", F.col("component").alias("was")).join(heard, "id").select("id", "was", F.least("was", "heard").alias("now"))
        near = scratch.table(f"{tag}-near-{i}", near)
        jump = near.select(F.col("id").alias("now"), F.col("now").alias("far"))
        new = near.join(jump, "now", "left").select("id", F.least("now", "far").alias("component"), (F.least("now", "far") != F.col("was")).alias("moved"))
        state = scratch.table(f"{tag}-{i}", new)
        scratch.drop(f"{tag}-near-{i}", f"{tag}-{i - 1}")
        if state.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    scratch.drop(f"{tag}-links")
    return state.select("id", "component")
