"""Diagnostics of a source tree kept up to date file by file.

What a file's diagnostics rest on besides itself are definitions by name, packages and local modules by name, shader symbols by name, and whether
an ecosystem has a manifest and the tree a shader at all.  These are the keys of ``corvane.streaming.incremental``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.operators import resolve
from corvane.parse import udtf
from corvane.plans.workspace import Semantics, Workspace
from corvane.sources import manifests, tree
from corvane.streaming.incremental import Incremental

R = schemas.RANGE
DEFINITION = f"struct<file:string,language:string,name:string,range:{R},min_args:int,max_args:int>"
BODY = (
    f"struct<language:string,imports:array<struct<module:string,range:{R}>>,calls:array<struct<callee:string,argc:int,range:{R}>>,"
    f"bindings:array<struct<callee:string,name:string,range:{R}>>>"
)
RESULT = schemas.DIAGNOSTICS.replace("file string, ", "")


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("\u0001", F.lit(kind), *parts)


def _has(kind: str, key: Column) -> Column:
    return key.startswith(f"{kind}\u0001")


def units_of(raw: DataFrame, compat: bool = True) -> DataFrame:
    """``raw(path, content, size)`` → a unit for each source file, manifest and shader; contents are parsed, one row each."""
    text = raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("source"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    keyed = lambda keys: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("value")))

    parsed = udtf.parsed(tree.files(raw).select("path", "language", "source"))
    eco = resolve.ecosystem(F.col("language"))
    family = F.when(F.col("language").isin("typescript", "tsx"), "js").otherwise(F.col("language"))
    named = lambda n: _key("def", n) if compat else _key("def", n, family)
    defs = F.transform("definitions", lambda d: F.struct(named(d["name"]).alias("key"), F.to_json(F.struct(F.col("path").alias("file"), "language", d["name"].alias("name"), d["range"].alias("range"), d["min_args"].alias("min_args"), d["max_args"].alias("max_args"))).alias("value")))
    own = resolve.local_module(F.col("path"))
    module = F.when(own.isNotNull(), keyed(F.array(_key("mod", own["ecosystem"], own["name"])))).otherwise(none)

    def looked_up(i: Column) -> Column:
        raw_, norm, local = resolve.import_names(eco, i["module"])
        return F.array(_key("eco", eco), _key("pkg", eco, raw_), _key("pkg", eco, norm), F.when(local.isNotNull(), _key("mod", eco, local)))

    uses = F.concat(
        F.transform("calls", lambda c: named(c["callee"])),
        F.coalesce(F.flatten(F.transform("imports", looked_up)), F.array().cast("array<string>")),
        F.coalesce(F.flatten(F.transform("bindings", lambda b: F.array(_key("sym", b["name"]), F.lit("anysym\u0001")))), F.array().cast("array<string>")),
    )
    code = parsed.select("path", F.concat(defs, module).alias("provides"), F.filter(uses, lambda k: k.isNotNull()).alias("uses"), F.struct("language", "imports", "calls", "bindings").cast(BODY).alias("body"))

    files = text.filter(F.col("path").isin(*manifests.MANIFESTS))
    names = manifests.packages(files, compat=compat).groupBy("source_file").agg(F.collect_set(_key("pkg", F.col("ecosystem"), F.col("name"))).alias("names"))  # one file's names
    pairs = F.create_map(*(F.lit(x) for kv in manifests.MANIFESTS.items() for x in kv))
    listed = files.join(names, F.col("path") == F.col("source_file"), "left")
    nothing = (F.array().cast("array<string>").alias("uses"), F.lit(None).cast(BODY).alias("body"))
    listed = listed.select("path", keyed(F.concat(F.array(_key("eco", F.element_at(pairs, F.col("path")))), F.coalesce("names", F.array().cast("array<string>")))).alias("provides"), *nothing)

    symbols = manifests.shader_names(F.col("path"), F.col("source"))
    some = F.when(F.size(symbols) > 0, F.array(F.lit("anysym\u0001"))).otherwise(F.array().cast("array<string>"))
    shaders = text.filter(symbols.isNotNull()).select("path", keyed(F.concat(some, F.transform(F.array_distinct(symbols), lambda n: _key("sym", n)))).alias("provides"), *nothing)
    return code.unionByName(listed).unionByName(shaders)


class Part(Workspace):
    """A workspace of some units and of what is provided under their keys; only its own diagnostics can be asked for."""

    def __init__(self, units: DataFrame, provided: DataFrame, semantics: Semantics):
        self.spark, self.semantics, self.reports, self.root = units.sparkSession, semantics, {}, None
        self.parsed = units.filter("body IS NOT NULL").select("path", "body.*")
        self._provided = provided
        self.packages = self._named("pkg", "ecosystem", "name")
        some = provided.filter(_has("anysym", F.col("key"))).limit(1).select(F.lit("\u0001").alias("name"))  # no symbol's name, but there are shaders
        self.shaders = self._named("sym", "name").unionByName(some)

    def _named(self, kind: str, *columns: str) -> DataFrame:
        rows = self._provided.filter(_has(kind, F.col("key")))
        return rows.select(*(F.split_part("key", F.lit("\u0001"), F.lit(i + 2)).alias(c) for i, c in enumerate(columns))).distinct()

    def definitions(self) -> DataFrame:
        return self._provided.filter(_has("def", F.col("key"))).select(F.from_json("value", DEFINITION).alias("d")).select("d.*")

    def ecosystems(self) -> DataFrame:
        return self._named("eco", "ecosystem")

    def local_modules(self) -> DataFrame:
        return self._named("mod", "ecosystem", "name")


def followed(spark: SparkSession, folder: str, semantics: Semantics | None = None, slots: int = 256) -> Incremental:
    """The state of a tree's diagnostics under ``folder``."""
    semantics = semantics or Semantics()

    def judge(units: DataFrame, provided: DataFrame) -> DataFrame:
        return Part(units, provided, semantics).own_diagnostics().withColumnRenamed("file", "path")

    common = lambda key: _has("eco", key) | _has("anysym", key)
    return Incremental(spark, folder, judge, BODY, RESULT, by_value=lambda key: _has("def", key), common=common, slots=slots)


def diagnostics(state: Incremental) -> DataFrame:
    return state.results().withColumnRenamed("path", "file").select(*(c.split()[0] for c in ("id", "severity", "source", "code", "message", "file", "range", "symbol", "related", "fix", "ord")))
