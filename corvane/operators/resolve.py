"""References that nothing declares: anti-joins of references with catalogues of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.keys import js_package, package_key

#: Fixed value: the short list of standard modules that compatible runs use.
PYTHON_MODULES = tuple(
    """__future__ abc argparse array ast asyncio atexit base64 bisect builtins bz2 calendar cmath collections colorsys
    concurrent contextlib copy csv ctypes curses dataclasses datetime decimal difflib dis email enum errno faulthandler
    filecmp fileinput fnmatch fractions functools gc genericpath getopt getpass glob gzip hashlib heapq hmac html http
    importlib inspect io ipaddress itertools json keyword linecache locale logging lzma mailbox marshal math mimetypes
    multiprocessing netrc numbers operator optparse os pathlib pdb pickle pipes pkgutil platform plistlib pprint profile
    pstats queue quopri random re readline reprlib resource runpy secrets select selectors shelve shlex shutil signal
    site smtplib socket socketserver sqlite3 ssl stat statistics string struct subprocess symtable sys sysconfig tarfile
    telnetlib tempfile textwrap threading time timeit tkinter token tokenize tomllib trace traceback tracemalloc types
    typing unicodedata unittest urllib uuid venv warnings wave weakref webbrowser wsgiref xml xmlrpc zipfile zipimport
    zlib zoneinfo""".split()
)

#: Fixed value: built-in modules of Node (a ``node:`` scheme is cut off before the look-up).
NODE_MODULES = tuple(
    """assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain
    events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream
    string_decoder timers tls trace_events tty url util v8 vm wasi worker_threads zlib""".split()
)

#: Fixed value: first segments of Rust paths that name no package.
RUST_ROOTS = ("std", "core", "alloc", "test", "proc_macro", "crate", "self", "super")


def python_modules(compat: bool) -> tuple[str, ...]:
    """Standard modules: the short list, or that of the running interpreter."""
    if compat:
        return PYTHON_MODULES
    import sys

    return tuple(sorted(sys.stdlib_module_names))


def unresolved(refs: DataFrame, *catalogs: tuple[Column | str, DataFrame, str]) -> DataFrame:
    """References that none of the catalogues holds.

    Each catalogue is ``(key of a reference, names, their column)``.  Every one becomes its own anti-join on an equality, never
    one join with OR, which could only be a nested loop.  A null key is found in no catalogue.

    Names are shuffled and never broadcast: what a plan takes for their size is that of the columns they are made of, which may be a hundredth of theirs.
    """
    out = refs
    for k, (key, names, column) in enumerate(catalogs):
        name = f"_name{k}"
        known = names.select(F.col(column).alias(name)).distinct().hint("merge")
        out = out.join(known, (F.col(key) if isinstance(key, str) else key) == F.col(name), "left_anti")
    return out


def ecosystem(language: Column) -> Column:
    return F.when(language == "python", "python").when(language.isin("typescript", "tsx"), "js").when(language == "rust", "rust")


def import_names(eco: Column, module: Column) -> tuple[Column, Column, Column]:
    """The names under which a module may be declared, as written and normalised, and the one that a local module would have (null where there are none)."""
    raw = F.when(eco == "js", js_package(module)).otherwise(module)
    norm = F.when(eco == "python", package_key(module)).when(eco == "rust", F.translate(module, "-", "_")).otherwise(js_package(module))
    local = F.when(eco == "python", F.split_part(module, F.lit("."), F.lit(1))).when(eco == "rust", F.split_part(module, F.lit("::"), F.lit(1)))
    return raw, norm, local


def unknown_imports(imports: DataFrame, packages: DataFrame, present: DataFrame, local_modules: DataFrame, compat: bool = True) -> DataFrame:
    """Imports that no manifest, standard library or local module explains.

    ``imports(file, language, module, ...)``, ``packages(ecosystem, name)``, ``present(ecosystem)``: ecosystems that have a
    manifest at all, ``local_modules(ecosystem, name)``.  Python names are looked up as written and normalised, Rust
    names as written and with underscores for hyphens, JavaScript by top-level package.
    """
    m = F.col("module")
    # At most three rows; a shuffle would deal all imports out by as many keys.
    there = present.select(F.col("ecosystem").alias("_eco")).filter(F.col("_eco").isin("python", "js", "rust")).distinct()
    refs = imports.withColumn("_eco", ecosystem(F.col("language"))).join(F.broadcast(there), "_eco", "left_semi")
    node_head = F.split_part(F.regexp_replace(m, "^node:", ""), F.lit("/"), F.lit(1))
    builtin = (
        F.when(F.col("_eco") == "python", m.isin(*python_modules(compat)) | m.startswith(".") | (m == ""))
        .when(F.col("_eco") == "js", m.isin(*NODE_MODULES) | node_head.isin(*NODE_MODULES) | m.startswith(".") | m.startswith("/"))
        .otherwise(m.isin(*RUST_ROOTS))
    )
    refs = refs.filter(~builtin)
    tag = lambda name: F.concat_ws("\u0001", F.col("_eco"), name)
    raw, norm, local = import_names(F.col("_eco"), m)
    declared = packages.select(F.concat_ws("\u0001", "ecosystem", "name").alias("name"))
    own = local_modules.filter(F.col("ecosystem").isin("python", "rust")).select(F.concat_ws("\u0001", "ecosystem", "name").alias("name"))
    # What can't be local has a key that no module has; nulls would all be shuffled to one task.
    as_local = F.when(local.isNotNull(), tag(local)).otherwise(F.concat(F.lit("\u0001"), m))
    return unresolved(refs, (tag(raw), declared, "name"), (tag(norm), declared, "name"), (as_local, own, "name")).drop("_eco")


def local_module(path: Column) -> Column:
    """``struct(ecosystem, name)`` of the module that a file makes its tree provide, or null."""
    head, inner = F.split_part(path, F.lit("/"), F.lit(1)), F.regexp_replace(path, "^src/", "")
    py = F.when(path.contains("/"), head).otherwise(F.regexp_replace(path, r"(\.py)+$", ""))
    rs = F.when(inner.endswith("/mod.rs"), F.split_part(inner, F.lit("/"), F.lit(1))).when(~inner.contains("/"), F.regexp_replace(inner, r"(\.rs)+$", ""))
    named = lambda eco, name: F.struct(F.lit(eco).alias("ecosystem"), name.alias("name"))
    return F.when(path.endswith(".py") & (py != ""), named("python", py)).when(path.endswith(".rs") & rs.isNotNull(), named("rust", rs))


def local_modules(files: DataFrame) -> DataFrame:
    """``(ecosystem, name)`` of modules that a tree itself provides, from ``files(path)`` alone."""
    return files.select(local_module(F.col("path")).alias("m")).filter("m IS NOT NULL").select("m.*").distinct()


def unresolved_if_any(refs: DataFrame, key: str, catalog: DataFrame, column: str) -> DataFrame:
    """As ``unresolved``, but with an empty catalogue nothing is reported."""
    any_ = catalog.limit(1).select(F.lit(True).alias("_any"))
    return unresolved(refs, (key, catalog, column)).withColumn("_any", F.lit(True)).join(F.broadcast(any_), "_any", "left_semi").drop("_any")
