"""Digest of a growing log of file changes, by day and file.

``python -m jobs.change_digest --config jobs/change_digest.json --input DIR --output DIR``

A file stream takes the log's files that no earlier run has taken, until none is left, and ends.  Each of its batches

* adds the relevant changes to ``output/changes``, by day and batch, and
* makes ``output/digest`` anew for the days that the batch touches: a row for each file with its last change, the number of changes and of bursts
  (changes no more than ``gap`` apart belong to one).

``output/progress`` is the stream's checkpoint.  A batch that is repeated after a failure replaces its own partitions, and a digest is always made
from all changes of its day, so late changes and repeated batches give what one run over everything would.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import latest
from corvane.streaming import changes
from jobs.common import log, main

CHANGES = "seq long, path string, kind string, ts timestamp, day date, batch long"
DIGEST = "path string, last_kind string, last_seq long, changes long, bursts long, first_ts timestamp, last_ts timestamp, day date"


@dataclass(frozen=True)
class ChangeDigest:
    """Paths, and SQL expressions over the log's columns: order, file, kind (create, modify or remove) and time.  ``input`` is a folder or a pattern."""

    input: str
    output: str
    seq: str = "seq"
    path: str = "path"
    kind: str = "kind"
    ts: str = "ts"
    #: Changes of a file no further apart than this are one burst.
    gap: str = "30 minutes"
    #: Files of the log that a batch takes at most.
    files: int = 1000


def digest(rows: DataFrame, gap: str) -> DataFrame:
    """``changes(day, path, seq, kind, ts)`` → a row for each day and file.  A burst ends with its day."""
    last = latest.latest_wins(rows.select("day", "path", F.col("kind").alias("last_kind"), F.col("seq").alias("last_seq")), ["day", "path"], ["last_seq"])
    bursts = latest.sessions(rows.select(F.struct("day", "path").alias("of"), "ts"), "of", "ts", gap)
    bursts = bursts.groupBy("of.day", "of.path").agg(F.sum("n").alias("changes"), F.count(F.lit(1)).alias("bursts"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    return last.join(bursts, ["day", "path"])


def replaced(rows: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions that the rows belong to, in place of those that are there."""
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def absorb(batch: DataFrame, batch_id: int, s: ChangeDigest) -> None:
    """Takes a batch of the log into both tables; taking it again changes nothing."""
    spark = batch.sparkSession
    rows = batch.select(F.expr(s.seq).cast("long").alias("seq"), F.expr(s.path).cast("string").alias("path"), F.expr(s.kind).cast("string").alias("kind"), F.expr(s.ts).cast("timestamp").alias("ts"))
    rows = changes.relevant(rows).filter("ts IS NOT NULL").withColumns({"day": F.to_date("ts"), "batch": F.lit(batch_id).cast("long")})
    replaced(rows, f"{s.output}/changes", "day", "batch")
    taken = spark.read.schema(CHANGES).parquet(f"{s.output}/changes")
    # The days are names of partitions, as many as the batch spans.
    days = {r["day"]: r["n"] for r in taken.filter(F.col("batch") == batch_id).groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}
    log.info("batch %s: wrote %s changes of %s days to %s/changes", batch_id, sum(days.values()), len(days), s.output)
    if days:
        replaced(digest(taken.filter(F.col("day").isin(*days)), s.gap), f"{s.output}/digest", "day")
        made = spark.read.schema(DIGEST).parquet(f"{s.output}/digest").filter(F.col("day").isin(*days)).count()
        log.info("batch %s: wrote %s rows of these days to %s/digest", batch_id, made, s.output)


def run(spark: SparkSession, s: ChangeDigest) -> DataFrame:
    """Takes what is new in the log and returns the whole digest as it stands in the output."""
    for name, kind in (("changes", CHANGES), ("digest", DIGEST)):  # so that an empty log leaves empty tables
        spark.createDataFrame([], kind).write.mode("append").partitionBy(*(("day", "batch") if name == "changes" else ("day",))).parquet(f"{s.output}/{name}")
    source = spark.readStream.schema(spark.read.parquet(s.input).schema).option("maxFilesPerTrigger", s.files).parquet(s.input)
    stream = source.writeStream.foreachBatch(lambda batch, i: absorb(batch, i, s)).option("checkpointLocation", f"{s.output}/progress").trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("read %s rows of %s that no earlier run has taken", sum(p["numInputRows"] for p in stream.recentProgress), s.input)
    return spark.read.schema(DIGEST).parquet(f"{s.output}/digest")


if __name__ == "__main__":
    main(ChangeDigest, run, __doc__)
