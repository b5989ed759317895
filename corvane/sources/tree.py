"""A source tree as a Spark data source: ``(path, content, size)`` of every file that isn't ignored.

Spark's own binary reader hides names with a leading dot or underscore and drops empty files, so it can't see
``__init__.py``.  The driver lists the tree, with ignore files, and packs the files by size into partitions; executors read
them, so the root must be a folder that they share.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane import schemas
from corvane.shipping import ship

#: Fixed value: directories that are never entered.
PRUNED = frozenset((".git", "node_modules", "target", ".corvane"))


def pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """An ignore line as ``(regex of a relative path, negated, directories only)``."""
    line = line.rstrip("\n").rstrip("\r")
    if not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line[1:] if line.startswith(("\\#", "\\!")) else line
    folder = line.endswith("/")
    line = line.rstrip("/") if folder else line
    anchored = "/" in line
    line = line.lstrip("/")
    if not line:
        return None
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif c == "*":
            while i + 1 < len(line) and line[i + 1] == "*":
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    try:
        return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, folder
    except re.error:
        return None


def _rules(folder: str) -> list:
    found = []
    for name in (".gitignore", ".ignore"):
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                found += [p for line in f if (p := pattern(line))]
        except OSError:
            continue
    return found


def walk(root: str, pruned: frozenset[str] = PRUNED) -> list[tuple[str, int]]:
    """Relative paths with forward slashes, and sizes, of the files below the root, in order."""
    out: list[tuple[str, int]] = []

    def ignored(rel: str, folder: bool, levels: list[tuple[str, list]]) -> bool:
        for base, rules in reversed(levels):
            inner = rel[len(base) :]
            for regex, negated, only in reversed(rules):
                if (folder or not only) and regex.match(inner):
                    return not negated
        return False

    def enter(folder: str, rel: str, levels: list[tuple[str, list]]) -> None:
        here = [*levels, (rel, _rules(folder))]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = rel + e.name
            if e.name in pruned:
                continue
            if e.is_dir(follow_symlinks=False):
                if not ignored(path, True, here):
                    enter(e.path, path + "/", here)
            elif e.is_file(follow_symlinks=False) and not ignored(path, False, here):
                out.append((path, e.stat().st_size))

    enter(root, "", [("", _rules_of_exclude(root))])
    return out


def _rules_of_exclude(root: str) -> list:
    try:
        with open(os.path.join(root, ".git", "info", "exclude"), encoding="utf-8", errors="replace") as f:
            return [p for line in f if (p := pattern(line))]
    except OSError:
        return []


@dataclass
class Part(InputPartition):
    paths: tuple[str, ...]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.bytes = int(options.get("partitionbytes", 8 << 20))
        self.extensions = tuple(x for x in options.get("extensions", "").split(",") if x)
        self.names = frozenset(x for x in options.get("names", "").split(",") if x)

    def partitions(self) -> list[Part]:
        parts: list[list[str]] = [[]]
        size = 0
        for path, n in walk(self.root):
            p = PurePosixPath(path)
            if (self.extensions or self.names) and p.suffix.lower() not in self.extensions and path not in self.names:
                continue
            if parts[-1] and size + n > self.bytes:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n + 512
        return [Part(tuple(p)) for p in parts]

    def read(self, partition: Part):
        for path in partition.paths:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    content = f.read()
            except OSError:  # it went between listing and reading
                continue
            yield path, content, len(content)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content binary, size long"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> DataFrame:
    """All files, or those with one of the extensions or at one of the paths; others aren't read at all."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("extensions", ",".join(extensions)).option("names", ",".join(names)).load(root)


def language(path: Column) -> Column:
    """By extension, whatever its case; null for other files."""
    low = F.lower(path)
    out = F.lit(None).cast("string")
    for lang, ends in schemas.LANGUAGES.items():
        for e in ends:
            out = F.when(low.endswith(e), lang).otherwise(out)
    return out


def files(raw: DataFrame) -> DataFrame:
    """``(path, language, loc, blob_sha, bytes_read, source)`` of the files in a supported language."""
    rows = raw.withColumn("language", language(F.col("path"))).filter("language IS NOT NULL")
    source = F.try_validate_utf8(F.col("content").cast("string"))
    rows = rows.withColumn("source", F.coalesce(source, F.make_valid_utf8(F.col("content").cast("string"))))
    loc = F.char_length("source") - F.char_length(F.replace("source", F.lit("\n"), F.lit(""))) + 1
    return rows.select("path", "language", loc.cast("int").alias("loc"), F.sha2("content", 256).alias("blob_sha"), F.col("size").alias("bytes_read"), "source")
