"""What the command lines of the jobs share."""

from __future__ import annotations

import argparse
import dataclasses
import logging

from pyspark.sql import SparkSession

from corvane.session import session

log = logging.getLogger("jobs")


def settings_of(kind: type, spark: SparkSession, path: str | None, given: dict):
    """The job's settings: its defaults, then a JSON file that Spark reads, then what the command line gives.  Unknown names are an error."""
    found = {}
    if path:
        row = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path).first()
        found = row.asDict() if row else {}
    found |= {k: v for k, v in given.items() if v is not None}
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(found) - set(fields)):
        raise ValueError(f"no such setting: {', '.join(unknown)}")
    casts = {"float": float, "int": int}
    return kind(**{k: casts.get(str(fields[k].type), str)(v) for k, v in found.items()})


def main(kind: type, run, doc: str, argv: list[str] | None = None) -> None:
    """Parses the command line, starts a session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(description=doc)
    parser.add_argument("--config", help="a JSON file with settings")
    for f in dataclasses.fields(kind):
        parser.add_argument(f"--{f.name.replace('_', '-')}")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(kind.__name__)
    try:
        run(spark, settings_of(kind, spark, given.pop("config"), given))
    finally:
        spark.stop()
