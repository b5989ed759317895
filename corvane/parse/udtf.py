"""Parsing as one pass over file contents: every relation of a file in one row."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane import schemas
from corvane.operators.twigs import NODE
from corvane.shipping import ship

R = schemas.RANGE
PARSED = (
    f"path string, language string, functions array<struct<name:string,range:{R},cc:int,loc:int,callees:array<string>>>, imports array<struct<module:string,range:{R}>>, "
    f"definitions array<struct<name:string,min_args:int,max_args:int,range:{R}>>, calls array<struct<callee:string,argc:int,range:{R}>>, "
    f"bindings array<struct<callee:string,name:string,range:{R}>>, bodies array<struct<name:string,range:{R},statements:array<struct<range:{R},label:string,writes:array<string>,reads:array<string>>>>>"
)
NODES = f"path string, language string, nodes array<{NODE}>"


def parse(language: str, source: str, bodies: bool = True):
    """The front end's result for one file; an empty one for an unknown language, or brackets nested thousands deep.  Without ``bodies`` it has no statements of functions."""
    from corvane.parse import model, python_units, rust_units, ts_units

    ends = {"typescript": ts_units.parse, "tsx": ts_units.parse, "rust": rust_units.parse}
    try:
        if language == "python":
            return python_units.parse(source, bodies)
        found = ends[language](source) if language in ends else model.Parsed()
        return found if bodies else replace(found, bodies=[])
    except RecursionError:
        return model.Parsed()


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Lists and dictionaries as Arrow, a column of plain values at a time."""
    if pa.types.is_list(kind):
        ends, flat = [0], []
        for v in values:
            flat += v
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _column(flat, kind.value_type), type=kind)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_column([v[f.name] for v in values], f.type) for f in kind], fields=list(kind))
    return pa.array(values, kind)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _parsed(bodies: bool):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(at, 64).to_pylist():
                    p = parse(r["language"], r["source"] or "", bodies)
                    rows.append({"path": r["path"], "language": r["language"], **p.__dict__})
                yield _batch(rows, schema)

    return found


def _arrow_schema() -> pa.Schema:
    point = pa.struct([("line", pa.int32()), ("col", pa.int32())])
    span = pa.struct([("start", point), ("end", point)])
    text, num = pa.string(), pa.int32()
    names = pa.list_(text)
    statement = pa.struct([("range", span), ("label", text), ("writes", names), ("reads", names)])
    lists = {
        "functions": [("name", text), ("range", span), ("cc", num), ("loc", num), ("callees", names)],
        "imports": [("module", text), ("range", span)],
        "definitions": [("name", text), ("min_args", num), ("max_args", num), ("range", span)],
        "calls": [("callee", text), ("argc", num), ("range", span)],
        "bindings": [("callee", text), ("name", text), ("range", span)],
        "bodies": [("name", text), ("range", span), ("statements", pa.list_(statement))],
    }
    return pa.schema([("path", text), ("language", text), *((k, pa.list_(pa.struct(v))) for k, v in lists.items())])


def parsed(files: DataFrame, bodies: bool = True) -> DataFrame:
    """``files(path, language, source)`` → ``PARSED``: one call of a front end for each row, in Arrow batches.  ``bodies`` are most of what is found; without them the column is empty."""
    ship(files.sparkSession)
    return files.select("path", "language", F.col("source").cast("string").alias("source")).mapInArrow(_parsed(bodies), PARSED)


def _kept(conditions: list[tuple[str, str | None, int | None]]):
    """Whether a node of this kind, word and number of parts fits any of the conditions; what was asked before is kept, up to a bound."""
    each: dict[str, list] = {}
    for kind, word, n in conditions:
        each.setdefault(kind, []).append((word and re.compile(word), n))

    @lru_cache(1 << 16)
    def keep(kind: str, word: str, n: int) -> bool:
        return any((pattern is None or pattern.fullmatch(word)) and (many is None or n == many) for pattern, many in each.get(kind, ()))

    return keep


def _nodes(only: dict[str, list[tuple[str, str | None, int | None]]] | None):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corvane.parse import python_units, ts_units

        ends = {"python": python_units.nodes, "typescript": ts_units.nodes, "tsx": ts_units.nodes}
        keep = {lang: None if only is None else _kept(only.get(lang, [])) for lang in ends}
        point = pa.struct([("line", pa.int32()), ("col", pa.int32())])
        num, text = pa.int32(), pa.string()
        node = pa.struct([("id", num), ("last", num), ("parent", num), ("kind", text), ("word", text), ("text", text), ("ord", num), ("of", num), ("n", num), ("range", pa.struct([("start", point), ("end", point)]))])
        schema = pa.schema([("path", text), ("language", text), ("nodes", pa.list_(node))])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(at, 64).to_pylist():
                    lang = r["language"]
                    try:
                        rows_of = ends[lang](r["source"] or "", keep[lang]) if lang in ends else []
                    except RecursionError:
                        rows_of = []
                    rows.append({"path": r["path"], "language": lang, "nodes": rows_of})
                yield _batch(rows, schema)

    return found


def nodes(files: DataFrame, only: dict[str, list[tuple[str, str | None, int | None]]] | None = None) -> DataFrame:
    """``files(path, language, source)`` → a row for each node: ``(file, language, id, last, parent, kind, word, text, ord, of, n, range)``.

    ``only`` cuts nodes down where they are found: conditions ``(kind, word, n)`` by language, of which a node must fit one; its numbers stay those among all.
    """
    ship(files.sparkSession)
    rows = files.select("path", "language", F.col("source").cast("string").alias("source")).mapInArrow(_nodes(only), NODES)
    return rows.select(F.col("path").alias("file"), "language", F.inline("nodes"))
