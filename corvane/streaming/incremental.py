"""Results of files kept up to date change by change, without looking at all files again.

A file is a *unit*: what it provides under keys (definitions, packages, modules), the keys that it uses, and a body.  A file's results follow from its
own unit and from what is provided under the keys it uses, and from nothing else.  So when files change, only these are judged again: the
changed ones, and those that use a key under which something else is provided now.

Three tables hold the state, each dealt into slots by a hash: ``units`` and ``results`` by file, ``index`` (who provides and who uses what) by key and one of
some salts of the file, so that a key which very many use is spread.  A change writes the slots of its own rows and reads those of the keys that it
touches.  Every change writes its slots under its own version, so repeating it after a failure replaces its own rows, and a reader takes the latest
finished version of each slot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVIDED = "array<struct<key:string,value:string>>"
INDEX = "role string, key string, path string, value string, slot int, version long"

#: Rows of the sides of joins that are sent to all tasks; with more, they are shuffled.
BROADCAST_ROWS = 10_000


def provided(units: DataFrame) -> DataFrame:
    return units.select(F.inline("provides"), "path").select(F.lit("provides").alias("role"), "key", "path", "value")


def used(units: DataFrame) -> DataFrame:
    """A row for each key that a unit uses, once."""
    return units.select(F.explode(F.array_distinct("uses")).alias("key"), "path").select(F.lit("uses").alias("role"), "key", "path", F.lit(None).cast("string").alias("value"))


def changed_keys(before: DataFrame, after: DataFrame, by_value: Column) -> DataFrame:
    """Keys under which something else is provided: another multiset of values where ``by_value`` holds of the key, something instead of nothing or the reverse elsewhere.

    Both tables are ``(key, path, value)``.  Counts of equal values are compared, so no key's values are gathered.
    """
    was, now = before.select("key", "path", "value", F.lit(1).alias("n")), after.select("key", "path", "value", F.lit(-1).alias("n"))
    both = was.unionByName(now).groupBy("key", "path", "value").agg(F.sum("n").alias("d"), F.count_if(F.col("n") > 0).alias("was"), F.count_if(F.col("n") < 0).alias("now"))
    keys = both.groupBy("key").agg(F.bool_or(F.col("d") != 0).alias("differs"), (F.sum("was") > 0).alias("was"), (F.sum("now") > 0).alias("now"))
    return keys.filter(F.when(by_value, F.col("differs")).otherwise(F.col("was") != F.col("now"))).select("key")


class Incremental:
    """The state under ``folder``, which all executors share.

    ``judge(units, provided)`` gives the results of some units, with their ``path``: ``units(path, uses, body)``, and ``provided(key, path, value)``, which holds
    all that is provided under the keys they use, and perhaps more.  ``by_value`` says of a key (a column) whether its users depend on the values or only
    on there being any.  ``common`` says of which keys users aren't indexed, as nearly all files use them: where these flip, all units are looked at.
    ``body`` and ``result`` are the types of a unit's body and of a result's columns beside ``path``.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        judge: Callable[[DataFrame, DataFrame], DataFrame],
        body: str,
        result: str,
        by_value: Callable[[Column], Column] = lambda key: F.lit(True),
        common: Callable[[Column], Column] = lambda key: F.lit(False),
        slots: int = 256,
        salts: int = 4,
    ):
        self.spark, self.folder, self.judge, self.by_value, self.common, self.slots, self.salts = spark, folder.rstrip("/"), judge, by_value, common, slots, salts
        self._created = False
        self.schemas = {
            "units": T._parse_datatype_string(f"path string, provides {PROVIDED}, uses array<string>, body {body}, slot int, version long"),
            "index": T._parse_datatype_string(INDEX),
            "results": T._parse_datatype_string(f"path string, {result}, slot int, version long"),
        }

    # --- tables ------------------------------------------------------------------------------------------------------

    def _slot(self) -> Column:
        """Of a row by file."""
        return F.pmod(F.xxhash64("path"), F.lit(self.slots)).cast("int")

    def _index_slot(self, salt: Column) -> Column:
        return F.pmod(F.xxhash64("key", salt), F.lit(self.slots)).cast("int")

    def _salt(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.salts)).cast("int")

    def _put(self, name: str, rows: DataFrame, version: int, slots: Iterable[int]) -> None:
        """Writes the slots of a version, an empty one as a mark that nothing is in it any more."""
        marks = self.spark.createDataFrame([(s,) for s in slots], "slot int")
        marks = marks.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schemas[name] if f.name not in ("slot", "version")), "slot")
        out = rows.unionByName(marks).withColumn("version", F.lit(version).cast("long"))
        out.hint("rebalance", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "version").parquet(f"{self.folder}/{name}")

    def _get(self, name: str, below: int, slots: Iterable[int] | None = None) -> DataFrame:
        """The latest rows of each slot before a version.  Only names of partitions decide what is read."""
        rows = self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")
        latest: dict[int, int] = {}
        for file in rows.inputFiles():
            parts = dict(p.split("=", 1) for p in file.split("/") if p.startswith(("slot=", "version=")))
            slot, version = int(parts["slot"]), int(parts["version"])
            if version < below and (slots is None or slot in slots):
                latest[slot] = max(version, latest.get(slot, -1))
        want = F.lit(False)
        for v in sorted(set(latest.values())):
            want = want | ((F.col("version") == v) & F.col("slot").isin(*(s for s, x in latest.items() if x == v)))
        first = "key" if name == "index" else "path"
        return rows.filter(want).filter(f"{first} IS NOT NULL").drop("version")

    def _create(self) -> None:
        for name, schema in self.schemas.items():
            self.spark.createDataFrame([], schema).write.mode("append").partitionBy("slot", "version").parquet(f"{self.folder}/{name}")
        self.spark.createDataFrame([], "version long").write.mode("append").parquet(f"{self.folder}/finished")

    def finished(self) -> int:
        """The last version that was written whole, or -1."""
        last = self.spark.read.schema("version long").parquet(f"{self.folder}/finished").agg(F.max("version").alias("v")).first()["v"]
        return -1 if last is None else last

    def results(self) -> DataFrame:
        """All results as of the last finished version."""
        return self._get("results", self.finished() + 1).drop("slot")

    # --- changes -----------------------------------------------------------------------------------------------------

    def _side(self, rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows

    def _slots(self, rows: DataFrame, slot: Column) -> list[int]:
        """Numbers of slots: as many as there are slots, at most."""
        return sorted(r["slot"] for r in rows.select(slot.alias("slot")).distinct().collect())

    def _of_keys(self, version: int, keys: DataFrame, role: str) -> DataFrame:
        """The index rows of some keys before a version."""
        salted = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))).alias("salt"))
        rows = self._get("index", version, self._slots(salted, self._index_slot(F.col("salt"))))
        return rows.filter(F.col("role") == role).join(self._side(keys), "key", "left_semi").select("key", "path", "value")

    def apply(self, paths: DataFrame, units: DataFrame, version: int) -> None:
        """Takes a change: ``paths(path)`` are all files that changed, ``units(path, provides, uses, body)`` what those are now that are still there.

        Versions grow from 0 on.  A change with a version that was taken before replaces it, if it is the last.
        """
        if not self._created:
            self._create()
            self._created = True
        stage = f"{self.folder}/stage/version={version}"

        def kept(name: str, rows: DataFrame) -> DataFrame:
            rows.write.mode("overwrite").parquet(f"{stage}/{name}")
            return self.spark.read.schema(rows.schema).parquet(f"{stage}/{name}")

        paths = self._side(kept("paths", paths.select("path").distinct()))
        fresh = kept("fresh", units.select("path", "provides", "uses", "body").join(paths, "path", "left_semi"))
        own = self._slots(paths, self._slot())
        unit_rows = self._get("units", version, own)
        old = unit_rows.join(paths, "path", "left_semi")

        # What the changed files provide, before and after; under which keys that makes a difference; and who uses these.
        given = kept("given", provided(old).unionByName(provided(fresh)).select("key").distinct())
        before = self._of_keys(version, given, "provides")
        after = before.join(paths, "path", "left_anti").unionByName(provided(fresh).select("key", "path", "value"))
        changed = kept("changed", changed_keys(before, after, self.by_value(F.col("key"))))
        users = self._of_keys(version, changed.filter(~self.common(F.col("key"))), "uses").select("path")
        everywhere = changed.filter(self.common(F.col("key")))
        if not everywhere.isEmpty():
            users = users.unionByName(used(self._get("units", version)).join(F.broadcast(everywhere), "key", "left_semi").select("path"))
        users = kept("users", users.distinct().join(paths, "path", "left_anti"))

        # These and the changed files are judged by all that is provided under their keys.
        user_slots = self._slots(users, self._slot())
        others = self._get("units", version, user_slots).join(self._side(users), "path", "left_semi")
        again = kept("again", fresh.unionByName(others.select(*fresh.columns)))
        wanted = kept("wanted", used(again).select("key").distinct())
        known = self._of_keys(version, wanted, "provides").join(paths, "path", "left_anti").unionByName(provided(fresh).select("key", "path", "value"))
        judged = self.judge(again.select("path", "uses", "body"), known)

        touched = sorted(set(own) | set(user_slots))
        stay = self._get("results", version, touched).join(self._side(paths.unionByName(users)), "path", "left_anti")
        columns = [f.name for f in self.schemas["results"] if f.name not in ("slot", "version")]
        self._put("results", stay.unionByName(judged.select(*columns).withColumn("slot", self._slot())), version, touched)

        listed = lambda rows: provided(rows).unionByName(used(rows).filter(~self.common(F.col("key")))).withColumn("slot", self._index_slot(self._salt()))
        index_slots = sorted({*self._slots(listed(old), F.col("slot")), *self._slots(listed(fresh), F.col("slot"))})
        self._put("index", self._get("index", version, index_slots).join(paths, "path", "left_anti").unionByName(listed(fresh)), version, index_slots)
        self._put("units", unit_rows.join(paths, "path", "left_anti").unionByName(fresh.withColumn("slot", self._slot())), version, own)
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.folder}/finished")
