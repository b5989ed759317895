"""What changed between two versions of tables: changes of a tree's listing, and a daemon's events of all kinds, with the fold that gives the state back.

An event is a row, ``(type, key, payload, copies)``, so no event holds a whole table or a whole file's diagnostics:

* ``healthUpdated``: a file's score, ``notesUpdated``: a note; no payload if it is gone
* ``diagnosticsUpdated``: a diagnostic of the file ``key``, with how many copies more (or less) there are now
* ``capabilityDegraded`` with its reason, ``capabilityRestored``; a capability that is no longer listed keeps its state
* ``indexProgress``: files done and all files of the change, at the start, after each so many, and at the end
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.ordered import numbered, ticks
from corvane.sources import tree

EVENTS = "type string, key string, payload string, copies long"
LISTING = "path string, blob_sha string, ts timestamp, version long"
CHANGES = "seq long, path string, kind string, ts timestamp, version long"
MARKS = "version long, changes long"


def captured(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, kind, before, after)``: keys that come, go or have other values, with ``kind`` one of create, remove and modify.

    Keys may be null.  Both sides are reduced by key before the one shuffle; of a key's repeated rows on one side the greatest counts.
    """
    values = [c for c in new.columns if c not in keys]
    of = lambda df: F.struct(*(df[c].alias(c) for c in values), F.lit(True).alias("_there"))
    here, there = new.select(*keys, of(new).alias("after")), old.select(*keys, of(old).alias("before"))
    both = there.unionByName(here, allowMissingColumns=True).groupBy(*keys).agg(F.max("before").alias("before"), F.max("after").alias("after"))
    kind = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "remove").otherwise("modify")
    drop = lambda c: F.when(F.col(c).isNotNull(), F.struct(*(F.col(f"{c}.{v}").alias(v) for v in values)) if values else F.lit(True)).alias(c)
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select(*keys, kind.alias("kind"), drop("before"), drop("after"))


# --- a daemon's events --------------------------------------------------------------------------------------------


def _by_key(type_: str, old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    rows = captured(old, new, [key])
    return rows.select(F.lit(type_).alias("type"), F.col(key).cast("string").alias("key"), F.to_json("after").alias("payload"), F.lit(None).cast("long").alias("copies"))


def _diagnostics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Copies of equal diagnostics are counted, so a file's diagnostics are never gathered."""
    values = [c for c in new.columns if c != "file"]
    row = lambda df, n: df.select(F.col("file").alias("key"), F.to_json(F.struct(*values)).alias("payload"), F.lit(n).cast("long").alias("n"))
    both = row(old, -1).unionByName(row(new, 1)).groupBy("key", "payload").agg(F.sum("n").alias("copies"))
    return both.filter("copies <> 0").select(F.lit("diagnosticsUpdated").alias("type"), "key", "payload", "copies")


def _capabilities(old: DataFrame, new: DataFrame) -> DataFrame:
    columns = ["capability", "available", "reason"]
    rows = captured(old.select(*columns), new.select(*columns), ["capability"]).filter("kind <> 'remove'")
    now, was = F.coalesce("after.available", F.lit(False)), F.coalesce("before.available", F.lit(False))
    told = rows.filter(~now | ~was)  # one that stays available tells nothing
    payload = F.when(now, F.to_json(F.struct(F.lit(True).alias("available"), F.lit("restored").alias("reason")))).otherwise(F.to_json(F.struct(F.lit(False).alias("available"), F.col("after.reason").alias("reason"))))
    return told.select(F.when(now, "capabilityRestored").otherwise("capabilityDegraded").alias("type"), F.col("capability").alias("key"), payload.alias("payload"), F.lit(None).cast("long").alias("copies"))


def _progress(old: DataFrame, new: DataFrame, every: int) -> DataFrame:
    changed = captured(old, new, ["path"]).filter("kind <> 'remove'").select("path")
    rows = ticks(changed, ["path"], every)
    payload = F.to_json(F.struct(F.col("files_done").alias("filesDone"), F.col("files_total").alias("filesTotal")))
    return rows.select(F.lit("indexProgress").alias("type"), F.lit(None).cast("string").alias("key"), payload.alias("payload"), F.lit(None).cast("long").alias("copies"))


def events(old: dict[str, DataFrame], new: dict[str, DataFrame], every: int = 50) -> DataFrame:
    """Events that lead from one version to the next.

    Tables are ``health`` by ``file``, ``diagnostics`` of a ``file``, ``capabilities(capability, available, reason)``, ``notes`` by ``id`` and ``files`` by ``path``; what is not
    given on both sides tells nothing.
    """
    make = {
        "health": lambda a, b: _by_key("healthUpdated", a, b, "file"),
        "notes": lambda a, b: _by_key("notesUpdated", a, b, "id"),
        "diagnostics": _diagnostics,
        "capabilities": _capabilities,
        "files": lambda a, b: _progress(a, b, every),
    }
    parts = [f(old[name], new[name]) for name, f in make.items() if name in old and name in new]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def folded(told: DataFrame, version: str = "version") -> DataFrame:
    """``(slot, key, payload, copies)``: the state after all events, which carry their version.  Works on a stream in update or complete mode as on a table."""
    slot = F.when(F.col("type").startswith("capability"), "capability").otherwise(F.col("type"))
    rows = told.filter("type <> 'indexProgress'").withColumns({"slot": slot, "item": F.when(F.col("type") == "diagnosticsUpdated", F.col("payload"))})
    last = rows.groupBy("slot", "key", "item").agg(F.max_by(F.struct("payload"), F.col(version)).alias("_last"), F.sum("copies").alias("copies"))
    state = last.select("slot", "key", "_last.payload", "copies")
    return state.filter(F.when(F.col("slot") == "diagnosticsUpdated", F.col("copies") > 0).otherwise(F.col("payload").isNotNull()))


# --- a tree's changes ---------------------------------------------------------------------------------------------


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, blob_sha)`` of the files of a tree in a supported language."""
    return tree.files(tree.read(spark, root)).select("path", "blob_sha")


def watch(now: DataFrame, folder: str) -> int:
    """Compares a listing with that of the last look and writes what changed to ``folder/changes`` by version; the number of changes.

    A look that failed is done again with the listing that it had written, so its version tells the same changes under the same ``seq``, in place of
    those that are there.  A look without changes counts as one, too.
    """
    spark = now.sparkSession
    for name, kind in (("listing", LISTING), ("changes", CHANGES), ("marks", MARKS)):  # so that a first look finds empty tables
        empty = spark.createDataFrame([], kind).write.mode("append")
        (empty if name == "marks" else empty.partitionBy("version")).parquet(f"{folder}/{name}")
    version = spark.read.schema(MARKS).parquet(f"{folder}/marks").agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0] + 1
    look = lambda v: spark.read.schema(LISTING).parquet(f"{folder}/listing").filter(F.col("version") == v)
    if look(version).isEmpty():
        _replace(now.select("path", "blob_sha", F.current_timestamp().alias("ts"), F.lit(version).alias("version")), f"{folder}/listing")
    before, after = (look(v).select("path", "blob_sha") for v in (version - 1, version))
    at = look(version).agg(F.max("ts")).first()[0]
    seen = F.lit(at) if at is not None else F.current_timestamp()
    found = numbered(captured(before, after, ["path"]).select("path", "kind"), ["path"])
    rows = found.select((F.lit(version << 32) + F.col("place")).alias("seq"), "path", "kind", seen.alias("ts"), F.lit(version).alias("version"))
    _replace(rows, f"{folder}/changes")
    made = spark.read.schema(CHANGES).parquet(f"{folder}/changes").filter(F.col("version") == version).count()
    spark.createDataFrame([(version, made)], MARKS).coalesce(1).write.mode("append").parquet(f"{folder}/marks")
    return made


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def watched(spark: SparkSession, folder: str, late: str = "10 minutes") -> DataFrame:
    """The changes of all looks as a stream.  A look that was done again tells its changes once."""
    rows = spark.readStream.schema(CHANGES).parquet(f"{folder}/changes")
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["version", "seq"])


def debounced(changes: DataFrame, gap: str = "150 milliseconds", late: str = "10 minutes") -> DataFrame:
    """``(path, kind, seq, n, first_ts, last_ts)``: the last of a path's changes that are less than the gap apart.  A burst is one whatever batches its changes come in."""
    rows = changes.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap))
    out = rows.agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.select("path", "kind", "seq", "n", "first_ts", "last_ts")
