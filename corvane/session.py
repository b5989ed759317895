"""Sessions with the settings that the operators count on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def session(name: str = "corvane", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides, with ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: under ``spark.checkpoint.dir``, or else under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/corvane-{uuid.uuid4().hex}"
