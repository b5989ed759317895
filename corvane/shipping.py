"""Sessions made ready for Python on executors: the package is shipped, and Arrow batches are bounded."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Bytes of an Arrow batch, so that a task holds a few MB of rows however long they are.
BATCH = 4 << 20

#: Tasks at most to which rows are dealt out; beyond, each takes more rows.
MOST_TASKS = 20_000


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the application, once, and bound the batches of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="corvane-"), "corvane_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "corvane").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def tasks_for(rows: DataFrame, each: int) -> int:
    """Tasks of about ``each`` rows, and at least two for each core."""
    return min(max(math.ceil(rows.count() / each), 2 * rows.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)


def dealt(rows: DataFrame, key: str, each: int) -> DataFrame:
    """The rows dealt out by a key, about ``each`` to a task, where the input has fewer splits than that takes.

    For narrow rows of which long texts are made: a table of some MB is one split, so all texts would be made and parsed by one task, however many there are.
    """
    least = tasks_for(rows, each)
    return rows.repartition(least, key) if rows.rdd.getNumPartitions() < least else rows
