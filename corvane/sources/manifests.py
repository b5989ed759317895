"""Declared packages of a workspace, from the manifests and lock files at its root."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.keys import package_key
from corvane.shipping import ship

#: Fixed value: file names and their ecosystem.
MANIFESTS = {
    "requirements.txt": "python",
    "pyproject.toml": "python",
    "poetry.lock": "python",
    "uv.lock": "python",
    "Pipfile.lock": "python",
    "package.json": "js",
    "package-lock.json": "js",
    "pnpm-lock.yaml": "js",
    "yarn.lock": "js",
    "Cargo.toml": "rust",
    "Cargo.lock": "rust",
}

#: The patterns of names in lock files and of declarations in shaders.
NAME_LINE = r'(?m)^name\s*=\s*"([^"]+)"'
PNPM_PACKAGE = r"(?m)^\s{2}/([^:\s]+?)@[^:]+:"
PNPM_KEY = r"(?m)^\s{2,4}([A-Za-z0-9_@/\-.]+):"
YARN_HEAD = r'(?m)^"?([A-Za-z0-9_@/\-.]+)@[^:]+:"?$'
GLSL_NAME = r"\b(?:uniform|attribute|in|out|varying)\s+(?:highp\s+|mediump\s+|lowp\s+)?\w+(?:\[\d+\])?\s+([A-Za-z_]\w*)\b"
WGSL_NAME = r"\bvar(?:<[^>]+>)?\s+([A-Za-z_]\w*)\s*:"


def discovered(files: DataFrame, path: str = "path") -> DataFrame:
    """The known manifests that exist at the root."""
    return files.filter(F.col(path).isin(*MANIFESTS))


def present(files: DataFrame, path: str = "path", keys: tuple[str, ...] = ()) -> DataFrame:
    """Ecosystems that have a manifest at all, even an empty or broken one; of each workspace, where ``keys`` tell them apart."""
    pairs = F.create_map(*(F.lit(x) for kv in MANIFESTS.items() for x in kv))
    return discovered(files, path).select(*keys, F.element_at(pairs, F.col(path)).alias("ecosystem")).distinct()


def _keys(json: Column, *sections: str) -> Column:
    """Keys of objects in a JSON text."""
    found = [F.coalesce(F.json_object_keys(F.get_json_object(json, f"$.{s}")), F.array().cast("array<string>")) for s in sections]
    return F.concat(*found)


def _requirements(text: Column, compat: bool) -> Column:
    """A name a line, before any version; a compatible run leaves ``~`` and ``@`` in the name."""
    cut = r"[=<>!;\[ ].*$" if compat else r"[=<>!;\[ ~@(].*$"
    lines = F.transform(F.split(text, r"\r?\n"), lambda s: F.trim(F.regexp_replace(s, r"#.*$", "")))
    kept = F.filter(lines, lambda s: (s != "") & ~s.startswith("-"))
    return F.transform(kept, lambda s: package_key(F.trim(F.regexp_replace(s, cut, ""))))


def toml_names(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``kind \\n text`` → declared names; broken files declare none."""
    import re
    import tomllib

    def table(value, *path) -> dict:
        for p in path:
            value = value.get(p) if isinstance(value, dict) else None
        return value if isinstance(value, dict) else {}

    def names(tagged: str) -> list[str]:
        kind, _, text = tagged.partition("\n")
        try:
            doc = tomllib.loads(text)
        except (tomllib.TOMLDecodeError, RecursionError):
            return []
        if kind == "pyproject.toml":
            listed = table(doc, "project").get("dependencies")
            found = [m[0] for d in (listed if isinstance(listed, list) else []) if isinstance(d, str) and (m := re.match(r"[A-Za-z0-9_.-]+", d.strip()))]
            return [n.lower().replace("_", "-") for n in [*found, *table(doc, "tool", "poetry", "dependencies")]]
        found = [k for s in ("dependencies", "dev-dependencies", "build-dependencies") for k in table(doc, s)] + [*table(doc, "workspace", "dependencies")]
        found += [n for t in ("package", "lib") if isinstance(n := table(doc, t).get("name"), str)]
        return [x for n in found for x in (n, n.replace("-", "_"))]

    for part in texts:
        yield part.map(names)


def packages(files: DataFrame, path: str = "path", content: str = "source", compat: bool = True) -> DataFrame:
    """``(ecosystem, name, source_file)`` from the manifests among ``files(path, text)``.

    A workspace has at most eleven of them; only TOML needs a parser outside the JVM.
    """
    ship(files.sparkSession)
    rows = discovered(files, path).select(F.col(path).alias("p"), F.col(content).cast("string").alias("t"))
    t = F.col("t")
    toml = F.pandas_udf(toml_names, "array<string>")
    lock_names = F.regexp_extract_all(t, F.lit(NAME_LINE), 1)
    both = lambda names: F.flatten(F.transform(names, lambda n: F.array(n, F.translate(n, "-", "_"))))
    after = F.transform(F.filter(_keys(t, "packages"), lambda k: k.contains("node_modules/")), lambda k: F.substring_index(k, "node_modules/", -1))
    pnpm = F.concat(
        F.transform(F.regexp_extract_all(t, F.lit(PNPM_PACKAGE), 1), lambda n: F.when(n.startswith("@"), n).otherwise(F.split_part(n, F.lit("@"), F.lit(1)))),
        F.regexp_extract_all(t, F.lit(PNPM_KEY), 1),
    )
    native = {
        "requirements.txt": _requirements(t, compat),
        "poetry.lock": F.transform(lock_names, package_key),
        "uv.lock": F.transform(lock_names, package_key),
        "Pipfile.lock": F.transform(_keys(t, "default", "develop"), package_key),
        "package.json": _keys(t, "dependencies", "devDependencies", "peerDependencies", "optionalDependencies"),
        "package-lock.json": F.concat(after, _keys(t, "dependencies")),
        "pnpm-lock.yaml": pnpm,
        "yarn.lock": F.regexp_extract_all(t, F.lit(YARN_HEAD), 1),
        "Cargo.lock": both(lock_names),
    }
    names = F.array().cast("array<string>")
    for file, found in native.items():
        names = F.when(F.col("p") == file, found).otherwise(names)
    tomls = rows.filter(F.col("p").endswith(".toml")).select("p", toml(F.concat("p", F.lit("\n"), "t")).alias("names"))
    rows = rows.filter(~F.col("p").endswith(".toml")).select("p", names.alias("names")).unionByName(tomls)
    pairs = F.create_map(*(F.lit(x) for kv in MANIFESTS.items() for x in kv))
    return rows.select(F.element_at(pairs, F.col("p")).alias("ecosystem"), F.explode("names").alias("name"), F.col("p").alias("source_file")).filter("name <> ''").distinct()


def shader_names(path: Column, content: Column) -> Column:
    """The names that a shader file declares, null for other files."""
    names = F.concat(F.regexp_extract_all(content, F.lit(GLSL_NAME), 1), F.regexp_extract_all(content, F.lit(WGSL_NAME), 1))
    return F.when(F.regexp_like(path, F.lit(r"\.(glsl|vert|frag|wgsl|hlsl)$")), names)


def shader_symbols(files: DataFrame, path: str = "path", content: str = "source") -> DataFrame:
    """``name`` of every uniform, attribute and variable that shader files declare."""
    return files.select(F.explode(shader_names(F.col(path), F.col(content).cast("string"))).alias("name")).distinct()
