"""Change feeds of a source tree as streams, and incremental recomputation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import latest
from corvane.sources import tree

#: A change: its order, the file, what happened to it and when.
CHANGE = "seq long, path string, kind string, ts timestamp"

#: The debounce of the change feed: a query's trigger interval.
DEBOUNCE = "150 milliseconds"


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """JSON change records that appear in a folder."""
    return spark.readStream.schema(CHANGE).json(folder)


def relevant(changes: DataFrame) -> DataFrame:
    """Creations, modifications and removals of files in a supported language, outside ignored folders."""
    p = F.col("path")
    ignored = p.startswith(".corvane") | F.concat(F.lit("/"), p).contains("/.git/") | p.contains("node_modules")
    return changes.filter(F.col("kind").isin("create", "modify", "remove") & ~ignored & tree.language(p).isNotNull())


def deduplicated(changes: DataFrame, sha: str = "blob_sha", late: str = "10 minutes") -> DataFrame:
    """Drops repeats of a path's content that come within the watermark."""
    return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", sha])


def bursts(changes: DataFrame, gap: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Changes of a path less than the gap apart, as one row: ``(path, first_ts, last_ts, n)``."""
    rows = changes.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return rows.select("path", "first_ts", "last_ts", "n")


def tombstones(changes: DataFrame) -> DataFrame:
    """The last change of each path: ``(path, kind, seq)``; removals stay as rows."""
    return latest.latest_wins(changes.select("path", "kind", "seq"), ["path"], ["seq"])


def affected(changed_names: DataFrame, call_sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Files whose results may change when definitions of these names do: those that call them."""
    names = changed_names.select(F.col("name").alias("_n")).distinct()
    calls = call_sites.select("file", F.col("callee").alias("_n"))
    texts = functions.select("file", F.explode("callees").alias("c")).select("file", F.substring_index("c", ".", -1).alias("_n"))
    return calls.unionByName(texts).join(names, "_n", "left_semi").select("file").distinct()


def follow(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Calls ``rebuild(tombstones of the batch, batch id)`` for each micro-batch with relevant changes.

    A batch may be repeated after a failure, so ``rebuild`` must write by batch id.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        last = tombstones(relevant(batch))
        if not last.isEmpty():
            rebuild(last, batch_id)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": DEBOUNCE})).start()


def events_of(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(type, file)``: files whose diagnostics differ between two snapshots of ``(file, id, code, message, severity)``."""
    key = ["file", "id", "code", "message", "severity"]
    gone, come = old.select(*key).exceptAll(new.select(*key)), new.select(*key).exceptAll(old.select(*key))
    return gone.select("file").unionByName(come.select("file")).distinct().select(F.lit("diagnosticsUpdated").alias("type"), "file")


def client_state(events: DataFrame) -> DataFrame:
    """The last payload of each kind and key: scores and notes are replaced whole, diagnostics by file, capabilities by name.

    ``events(seq, type, file, capability, payload)``; works on a stream in update mode as on a table.
    """
    group = F.when(F.col("type").isin("capabilityDegraded", "capabilityRestored"), "capability").otherwise(F.col("type"))
    key = F.when(F.col("type") == "diagnosticsUpdated", F.col("file")).when(group == "capability", F.col("capability")).otherwise(F.lit(""))
    rows = events.filter("type <> 'indexProgress'").withColumns({"slot": group, "key": key})
    return rows.groupBy("slot", "key").agg(F.max_by(F.struct("type", "payload"), "seq").alias("_l"), F.max("seq").alias("seq")).select("slot", "key", "_l.type", "_l.payload", "seq")
