"""Notes as the fold of an operation log."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.operators.keys import rank_of
from corvane.operators.latest import strongest
from corvane.operators.ordered import carried_forward

_FIELDS = ("kind", "title", "body", "location", "symbol", "severity", "author", "ts")


def live(log: DataFrame) -> DataFrame:
    """Notes that are posted and neither resolved nor cleared since, in the order in which they first appeared.

    ``log(seq, op, id, kind, title, body, location, symbol, severity, author, ts)`` with ``op`` one of ``post``, ``resolve`` and
    ``clear``.  Posting an existing id replaces the note in its place; after a resolve or a clear it is a new
    one.  Everything is aggregated by id before the shuffle.
    """
    cleared = log.filter("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_cleared"))
    gone = log.filter("op = 'resolve'").groupBy("id").agg(F.max("seq").alias("_gone"))
    posts = log.filter("op = 'post'").join(gone, "id", "left").withColumn("_cleared", cleared.scalar())
    posts = posts.filter(F.col("seq") > F.greatest(F.coalesce("_gone", F.lit(-1)), F.col("_cleared")))
    last = posts.groupBy("id").agg(F.max_by(F.struct(*_FIELDS), "seq").alias("_n"), F.min("seq").alias("first_seq"))
    return last.select("id", "_n.*", "first_seq").orderBy("first_seq")


def resolved(log: DataFrame, stretches: int | None = None) -> DataFrame:
    """For each resolve, whether the note existed then: ``(seq, id, existed)``.

    The last clear before an operation, and the last operation on its id, are carried along the log's order: an as-of join on each side.
    """
    ops = carried_forward(log.select("seq", "op", "id"), [], "seq", F.when(F.col("op") == "clear", F.col("seq")), "cleared", stretches)
    ops = carried_forward(ops.filter("op <> 'clear'"), ["id"], "seq", F.struct("seq", "op"), "last", stretches)
    there = (F.col("last.op") == "post") & (F.col("cleared").isNull() | (F.col("cleared") < F.col("last.seq")))
    return ops.filter("op = 'resolve'").select("seq", "id", F.coalesce(there, F.lit(False)).alias("existed"))


def badge(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count(F.lit(1)).alias("unresolved"))


def note_id(micros: Column) -> Column:
    """``n-`` and the time in hexadecimal."""
    return F.concat(F.lit("n-"), F.lower(F.hex(micros * 1000)))


def spotlights(notes: DataFrame) -> DataFrame:
    """``(file, id, kind)``: for each file with a note the strongest kind, the earliest among equals."""
    placed = notes.filter("location IS NOT NULL").withColumn("file", F.col("location.file"))
    return strongest(placed, "file", rank_of(F.col("kind"), schemas.NOTE_PRIORITY, -1), ["first_seq"], ["id", "kind"])


class NotesLog:
    """An operation log in a folder that all executors share; each operation is one appended row.

    One writer at a time: the sequence is the writer's clock, kept ahead of what it wrote before.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._last = spark, path, 0

    def table(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schemas.NOTES_LOG)
        return self.spark.read.schema(schemas.NOTES_LOG).parquet(self.path)

    def _append(self, op: str, id_: str | None, **fields) -> int:
        self._last = max(self._last + 1, time.time_ns() // 1000)
        row = {"seq": self._last, "op": op, "id": id_, "ts": datetime.now(UTC), **fields}
        self.spark.createDataFrame([row], schemas.NOTES_LOG).coalesce(1).write.mode("append").parquet(self.path)
        return self._last

    def post(self, kind: str, title: str, body: str = "", id: str | None = None, location=None, symbol=None, severity=None, author: str = "agent") -> str:  # noqa: A002
        """Adds a note, or replaces the one with this id in its place; returns the id."""
        if kind not in schemas.NOTE_PRIORITY:
            raise ValueError(f"kind is one of {', '.join(schemas.NOTE_PRIORITY)}, not {kind}")
        id = id or f"n-{time.time_ns():x}"  # noqa: A001
        self._append("post", id, kind=kind, title=title, body=body, location=location, symbol=symbol, severity=severity, author=author)
        return id

    def resolve(self, id: str) -> bool:  # noqa: A002
        """Removes a note; whether there was one."""
        existed = not self.list().filter(F.col("id") == id).isEmpty()
        self._append("resolve", id)
        return existed

    def clear(self) -> None:
        self._append("clear", None)

    def list(self) -> DataFrame:
        return live(self.table())
