"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.shipping import ship

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset, a session on one machine gets a folder of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/corvane-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def unused(names: list[str], *wanted: str) -> list[str]:
    """Names for columns beside ``names``, which clash with none of them whatever their case."""
    taken = {n.lower() for n in names}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` to be broadcast if it was counted to have at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Scratch:
    """Named Parquet tables of one run, under a folder of its own in the shared folder.

    Writing cuts the lineage: a lost executor costs the tasks of the current stage only.  ``drop``
    removes a table that is no longer needed; what a returned DataFrame still reads goes when the
    process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"
        _left.append((spark, self.root))

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        """A table written before."""
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the folder belongs to the cluster's own clean-up
            return
