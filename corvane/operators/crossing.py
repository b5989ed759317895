"""Slices that cross functions, for many origins at once.

A program is five tables:

* ``reads(fn, at, name)`` and ``writes(fn, at, name)``: the names of each statement, by its place in its function;
* ``params(fn, pos, name)``;
* ``calls(fn, at, callee)`` and ``arguments(fn, at, callee, pos, name)``: which functions a statement calls, and the names in each argument;
* ``returns(fn, at)``: the statements that give a function's result.

What a statement needs comes from earlier statements of its function that write it, from the results of what it calls, and, if it is a parameter, from that
argument of every call.  A slice goes on round by round; in each only the facts that are new meet the tables.  Of a name that a function needs
the latest place is kept: what is written before an earlier place was found then.  So facts are as many as names in functions, however long
these are, and recursion ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import work_folder

#: What an argument of a call is known by; a whole statement has this place.
WHOLE = -1


class _Rounds:
    """Tables of one walk, each written once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{work_folder(spark)}/slice"

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")


def backward(origins: DataFrame, reads: DataFrame, writes: DataFrame, params: DataFrame, calls: DataFrame, arguments: DataFrame, returns: DataFrame, max_hops: int = 10) -> DataFrame:
    """``(q, fn, at, hop)``: the statements that influence the origins ``(q, fn, at)``, each with its distance; an origin has 0.

    Statements at most ``max_hops`` away are found.  A call that a parameter leads to brings in only what its argument reads; its hop is that of the call.
    """
    rounds = _Rounds(origins.sparkSession)
    fresh = rounds.put("found-0", origins.select("q", "fn", "at", F.lit(WHOLE).alias("pos"), F.lit(0).alias("hop")).distinct())
    found = fresh
    known = rounds.put("known-0", fresh.select("q", "fn", F.lit("").alias("name"), F.lit(0).cast("long").alias("upto")).limit(0))
    for hop in range(1, max_hops + 1):
        whole, parts = fresh.filter(F.col("pos") == WHOLE), fresh.filter(F.col("pos") != WHOLE)
        needs = whole.join(reads, ["fn", "at"]).select("q", "fn", "at", "name").unionByName(parts.join(arguments.drop("callee").distinct(), ["fn", "at", "pos"]).select("q", "fn", "at", "name"))
        needs = needs.groupBy("q", "fn", "name").agg(F.max("at").cast("long").alias("at")).join(known, ["q", "fn", "name"], "left").filter("upto IS NULL OR at > upto")
        needs = rounds.put(f"needs-{hop}", needs)
        before = needs.join(writes.withColumnRenamed("at", "w"), ["fn", "name"]).filter("w < at AND (upto IS NULL OR w >= upto)").select("q", "fn", F.col("w").alias("at"), F.lit(WHOLE).alias("pos"))
        bound = needs.filter("upto IS NULL").join(params, ["fn", "name"]).select("q", F.col("fn").alias("callee"), "pos").distinct()
        given = bound.join(arguments.select("fn", "at", "callee", "pos").distinct(), ["callee", "pos"]).select("q", "fn", "at", "pos")
        results = whole.join(calls, ["fn", "at"]).select("q", F.col("callee").alias("fn")).distinct().join(returns, "fn").select("q", "fn", "at", F.lit(WHOLE).alias("pos"))
        new = before.unionByName(given).unionByName(results).distinct().join(found.select("q", "fn", "at", "pos"), ["q", "fn", "at", "pos"], "left_anti")
        fresh = rounds.put(f"found-{hop}", new.withColumn("hop", F.lit(hop)))
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
        known = rounds.put(f"known-{hop}", known.unionByName(needs.select("q", "fn", "name", F.col("at").alias("upto"))).groupBy("q", "fn", "name").agg(F.max("upto").alias("upto")))
    return found.groupBy("q", "fn", "at").agg(F.min("hop").alias("hop"))
