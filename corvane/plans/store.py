"""Parsed contents by their hash, so that each content is parsed once, wherever and whenever it appears."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import latest
from corvane.parse import udtf
from corvane.shipping import tasks_for

#: Results of another version are never reused.
ANALYZER_VERSION = "1"
#: Files that a task parses, about: some MB of text.
FILES_A_TASK = 5_000


def tasks(files: DataFrame) -> int:
    """Tasks to which the counted files are dealt out; joined by their size in the shuffle, where texts and what is parsed of them are a small part of what they are in memory, a task's share would grow with the tree."""
    return tasks_for(files, FILES_A_TASK)


def _representatives(files: DataFrame, many: int) -> DataFrame:
    """One file for each content and language, in so many tasks; only names are compared."""
    one = files.groupBy("blob_sha", "language").agg(F.min("path").alias("path"))
    return files.repartition(many, "path").join(one.select("path").repartition(many, "path"), "path", "left_semi")


def parse_once(files: DataFrame, many: int | None = None, bodies: bool = True) -> DataFrame:
    """``(blob_sha, language, functions, ...)`` for each distinct content, parsed by so many tasks."""
    todo = _representatives(files, many or tasks(files)).select(F.col("blob_sha").alias("path"), "language", "source")
    return udtf.parsed(todo, bodies).withColumnRenamed("path", "blob_sha")


class Silver:
    """A Parquet table of parsed contents in a folder that all executors share.

    New contents are appended by one write, which is published when its job commits; a reader sees
    all of it or nothing.  ``path`` must be the store's own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/analyzer={ANALYZER_VERSION}"

    def known(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.parquet(self.path)

    def parsed(self, files: DataFrame, many: int | None = None) -> DataFrame:
        """Parses what is new, and returns the parsed contents of all files by hash and language."""
        known = self.known()
        todo = _representatives(files, many or tasks(files))
        if known is not None:
            todo = todo.join(known.select("blob_sha", "language").distinct(), ["blob_sha", "language"], "left_anti")
        fresh = udtf.parsed(todo.select(F.col("blob_sha").alias("path"), "language", "source")).withColumnRenamed("path", "blob_sha")
        fresh.write.mode("append").parquet(self.path)
        # Two writers may have added one content: either result stands for both.
        return self.spark.read.parquet(self.path).dropDuplicates(["blob_sha", "language"])

    def invalidate(self) -> None:
        """Forget everything."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def manifest(files: DataFrame) -> DataFrame:
    """``(path, blob_sha, analyzer_version)``: what a scan leaves for the next to compare with."""
    return files.select("path", "blob_sha", F.lit(ANALYZER_VERSION).alias("analyzer_version"))


def hydrated(saved: DataFrame) -> DataFrame:
    """A saved manifest without rows of another version."""
    return saved.filter(F.col("analyzer_version") == ANALYZER_VERSION)


def compared(files: DataFrame, saved: DataFrame) -> DataFrame:
    """``(path, change)``: added, changed, removed or same since the saved manifest."""
    old = hydrated(saved).select("path", F.col("blob_sha").alias("old"))
    both = files.select("path", "blob_sha").join(old, "path", "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("blob_sha").isNull(), "removed").when(F.col("old") == F.col("blob_sha"), "same").otherwise("changed")
    return both.select("path", kind.alias("change"))


def cache_counts(files: DataFrame, saved: DataFrame) -> DataFrame:
    """One row: ``hits`` and ``misses`` of the saved manifest."""
    return compared(files, saved).filter("change <> 'removed'").agg(F.count_if(F.col("change") == "same").alias("hits"), F.count_if(F.col("change") != "same").alias("misses"))


def collected_garbage(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    return latest.live_artifacts(artifacts, files)
