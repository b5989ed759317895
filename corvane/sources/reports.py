"""Reports of external tools as diagnostics.  The tools are never run: their output is the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane import schemas
from corvane.operators.diagnostics import build


def _range(sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    point = lambda a, b: F.struct(a.cast("int").alias("line"), b.cast("int").alias("col"))
    return F.struct(point(sl, sc).alias("start"), point(el, ec).alias("end"))


def _from_one(x: Column) -> Column:
    """A position that counts from 1, as one that counts from 0."""
    return F.greatest(x.cast("long") - 1, F.lit(0)).cast("int")


def _relative(path: Column, root: str | None) -> Column:
    """The path below the root, with forward slashes."""
    p = F.translate(path, "\\", "/")
    if not root:
        return p
    head = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(head), F.substr(p, F.lit(len(head) + 1))).otherwise(p)


def _severity(x: Column, names: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for theirs, mine in names.items():
        out = F.when(x == theirs, mine).otherwise(out)
    return out


def _id(source: str, code: Column) -> Column:
    return F.concat_ws(":", F.lit(source), F.col("file"), F.col("range.start.line").cast("string"), code)


def pyright(reports: DataFrame, column: str = "json", root: str | None = None) -> DataFrame:
    """A type checker's JSON reports; positions count from 0.  Malformed reports give no rows."""
    p = "struct<line:int,character:int>"
    kind = f"generalDiagnostics array<struct<file:string,severity:string,message:string,rule:string,range:struct<start:{p},end:{p}>>>"
    rows = reports.select(F.posexplode(F.from_json(column, kind)["generalDiagnostics"]).alias("ord", "d"))
    rows = rows.select("ord", "d", _relative(F.col("d.file"), root).alias("file"), _range(F.col("d.range.start.line"), F.col("d.range.start.character"), F.col("d.range.end.line"), F.col("d.range.end.character")).alias("range"))
    code = F.coalesce("d.rule", F.lit("pyright"))
    sev = _severity(F.col("d.severity"), {"error": "error", "warning": "warning", "information": "info"}, "hint")
    return build(rows, "pyright", code, sev, F.col("d.message"), _id("pyright", code))


#: Fixed value: a compiler's line.
_TSC = r"^([^()]+)\((\d+),(\d+)\): (error|warning) (TS\d+): (.+)$"


def tsc_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Compiler lines ``file(line,col): severity code: message``; other lines are left out, other columns stay."""
    t = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    part = lambda k: F.regexp_extract(t, _TSC, k)
    line, col = _from_one(part(2)), _from_one(part(3))
    return lines.filter(F.regexp_like(t, F.lit(_TSC))).select("*", part(1).alias("file"), _range(line, col, line, col).alias("range"), part(4).alias("severity"), part(5).alias("code"), part(6).alias("message"))


def tsc(reports: DataFrame, column: str = "text", root: str | None = None) -> DataFrame:
    lines = reports.select(F.posexplode(F.split(column, r"\r?\n")).alias("ord", "line"))
    rows = tsc_lines(lines).withColumn("file", _relative(F.col("file"), root))
    return build(rows, "tsc", F.col("code"), F.col("severity"), F.col("message"), _id("tsc", F.col("code")))


def semgrep(reports: DataFrame, column: str = "json", root: str | None = None) -> DataFrame:
    """A pattern scanner's JSON reports; positions count from 1.  Results without a check, path or position are left out."""
    p = "struct<line:long,col:long>"
    kind = f"results array<struct<check_id:string,path:string,start:{p},end:{p},extra:struct<message:string,severity:string>>>"
    rows = reports.select(F.posexplode(F.from_json(column, kind)["results"]).alias("ord", "r"))
    rows = rows.filter("r.check_id IS NOT NULL AND r.path IS NOT NULL AND r.start.line IS NOT NULL AND r.start.col IS NOT NULL AND r.end.line IS NOT NULL AND r.end.col IS NOT NULL")
    ends = [_from_one(F.col(f"r.{c}")) for c in ("start.line", "start.col", "end.line", "end.col")]
    rows = rows.select("ord", "r", _relative(F.col("r.path"), root).alias("file"), _range(*ends).alias("range"))
    code = F.regexp_extract("r.check_id", r"([^.]*\.)?[^.]*$", 0)
    sev = _severity(F.coalesce("r.extra.severity", F.lit("WARNING")), {"ERROR": "error", "WARNING": "warning", "INFO": "info"}, "warning")
    return build(rows, "semgrep", code, sev, F.coalesce("r.extra.message", code), _id("semgrep", code))


def rust_analyzer(published: DataFrame, column: str = "json", root: str | None = None, session: str | None = None, at: tuple[str, str] | None = None) -> DataFrame:
    """Published diagnostics, a JSON object a row; of equal file, line and code the last stays.  Within a file ``ord`` is the place in its report.

    ``at`` names the columns of a message's number and of the place where its entries begin; without it rows count in the order they are in.
    With ``session`` the last stays of each session, and the column stays too.
    """
    from corvane.operators.latest import latest_wins

    p = "struct<line:int,character:int>"
    kind = f"uri string, diagnostics array<struct<range:struct<start:{p},end:{p}>,severity:int,code:string,message:string,source:string>>"
    own = [session] if session else []
    n, first = (F.col(at[0]), F.col(at[1])) if at else (F.monotonically_increasing_id(), F.lit(0))
    rows = published.select(*own, n.alias("n"), first.alias("first"), F.from_json(column, kind).alias("p"))
    path = F.url_decode(F.regexp_replace(F.replace(F.regexp_replace("p.uri", "^file://", ""), F.lit("+"), F.lit("%2B")), r"^/([A-Za-z]:)", "$1"))
    rows = rows.select(*own, "n", "first", _relative(path, root).alias("file"), F.posexplode("p.diagnostics").alias("k", "d")).withColumn("k", F.col("first") + F.col("k"))
    value = F.get_json_object("d.code", "$.value")
    code = F.coalesce(F.when(F.col("d.code").startswith("{"), value).otherwise(F.col("d.code")), "d.source", F.lit("rust-analyzer"))
    ends = (F.col("d.range.start.line"), F.col("d.range.start.character"), F.col("d.range.end.line"), F.col("d.range.end.character"))
    rows = rows.select(*own, "file", _range(*ends).alias("range"), code.alias("code"), F.coalesce("d.severity", F.lit(1)).alias("level"), F.col("d.message").alias("message"), "n", "k")
    rows = latest_wins(rows.withColumn("line", F.col("range.start.line")), [*own, "file", "line", "code"], ["n", "k"]).withColumn("ord", F.col("k"))
    sev = F.when(F.col("level") == 1, "error").when(F.col("level") == 2, "warning").when(F.col("level") == 3, "info").otherwise("hint")
    return build(rows, "rust-analyzer", F.col("code"), sev, F.col("message"), _id("rust-analyzer", F.col("code")), keep=tuple(own))


def pytea(reports: DataFrame, file: str = "file", column: str = "text") -> DataFrame:
    """A shape checker's output for each file: lines that begin with its two tags."""
    kept = F.filter(F.transform(F.split(column, r"\r?\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s.startswith("[Shape Error]") | s.startswith("[Pytea Error]"))
    rows = reports.select(F.col(file).alias("file"), F.posexplode(kept).alias("ord", "line"))
    zero = F.lit(0)
    rows = rows.withColumn("range", _range(zero, zero, zero, zero))
    code = F.when(F.col("line").startswith("[Shape Error]"), "pytea/shape-mismatch").otherwise("pytea/analysis-error")
    return build(rows, "pytea", code, "error", F.col("line"), F.concat_ws(":", F.lit("pytea"), "file", F.col("ord").cast("string")))


def imports_torch(source: Column) -> Column:
    """Whether any line imports torch: the shape checker's gate."""
    return F.exists(F.split(source, "\n"), lambda s: F.ltrim(s).startswith("import torch") | F.ltrim(s).startswith("from torch"))


def flows(reports: DataFrame, column: str = "text", begin: str = "[FLOW-BEGIN]", end: str = "[FLOW-END]", fallback: str = "") -> DataFrame:
    """Nodes of a flow between two markers, JSON lines ``{file, line, label}``: ``(id, file, range, label)``."""
    t = F.col(column)
    inner = F.split_part(F.substr(t, F.instr(t, begin) + len(begin)), F.lit(end), F.lit(1))
    whole = reports.filter((F.instr(t, begin) > 0) & (F.instr(t, end) > F.instr(t, begin)))
    lines = F.filter(F.transform(F.split(inner, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    rows = whole.select(F.posexplode(lines).alias("id", "line")).filter(F.col("line").startswith("{"))
    d = F.from_json("line", "file string, line long, label string")
    rows = rows.select("id", d.alias("d")).filter("d IS NOT NULL")
    line = (F.greatest(F.coalesce("d.line", F.lit(1)), F.lit(1)) - 1).cast("int")
    file = F.when(F.coalesce(F.col("d.file"), F.lit("")) == "", fallback).otherwise(F.col("d.file"))
    return rows.select("id", file.alias("file"), _range(line, F.lit(0), line, F.lit(0)).alias("range"), F.substring(F.coalesce("d.label", F.lit("<node>")), 1, 80).alias("label"))


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], schemas.DIAGNOSTICS)
