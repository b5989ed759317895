"""A workspace that follows its tree: each batch of changes gives a new snapshot and the events that tell what changed.

Only contents that no snapshot has seen are parsed; everything that depends on them (and on names or manifests that
changed) is derived anew from the parsed contents, so files that didn't change themselves are right as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane import schemas
from corvane.plans import store
from corvane.plans.workspace import Semantics, Workspace
from corvane.streaming import changes


class LiveWorkspace:
    """Snapshots of a tree under ``folder``, which all executors share.

    Snapshots are written under their batch id, so a batch that is repeated after a failure replaces its own; a reader takes the latest whole one.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, semantics: Semantics | None = None):
        self.spark, self.root, self.folder, self.semantics = spark, root, folder.rstrip("/"), semantics
        self.silver = store.Silver(spark, f"{self.folder}/silver")

    def rebuild(self, last: DataFrame | None = None, batch_id: int = 0) -> None:
        """Writes the snapshot of a batch: diagnostics, file scores, the manifest, and events."""
        ws = Workspace.scan(self.spark, self.root, semantics=self.semantics, silver=self.silver)
        before = self.latest("diagnostics", below=batch_id)
        target = f"{self.folder}/snapshots/batch={batch_id}"
        ws.all_diagnostics().write.mode("overwrite").parquet(f"{target}/diagnostics")
        ws.health().write.mode("overwrite").parquet(f"{target}/health")
        store.manifest(ws.sources).write.mode("overwrite").parquet(f"{target}/manifest")
        now = self.spark.read.schema(schemas.DIAGNOSTICS).parquet(f"{target}/diagnostics")
        old = before if before is not None else self.spark.createDataFrame([], schemas.DIAGNOSTICS)
        told = changes.events_of(old, now).unionByName(self.spark.createDataFrame([("healthUpdated", None)], "type string, file string"))
        told.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/events")
        ws.release()

    def follow(self, feed: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        return changes.follow(feed, self.rebuild, f"{self.folder}/progress", trigger)

    def batches(self) -> list[int]:
        """Ids of whole snapshots: events are written last."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/snapshots/batch=*/events/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(f.getPath().getParent().getParent().getName().partition("=")[2]) for f in found or [])

    def latest(self, table: str, below: int | None = None) -> DataFrame | None:
        """A table of the latest whole snapshot (before a batch), or none."""
        ids = [b for b in self.batches() if below is None or b < below]
        return self.spark.read.parquet(f"{self.folder}/snapshots/batch={ids[-1]}/{table}") if ids else None
