"""The request surface over a workspace: methods by name, parameters and results as JSON values.

Results are small by nature (one file, one function, a top list); those that list all files are read row by row.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import keys, notes
from corvane.plans.workspace import CrossFileUnavailable, UnknownSymbol, Workspace

VERSION = "0.1.0"

#: Error codes of JSON-RPC.
PARSE_ERROR, UNKNOWN_METHOD, INVALID_PARAMS, INTERNAL, CROSS_FILE = -32700, -32601, -32602, -32603, -32000


class RequestError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def camel(value):
    """Keys in camel case, and null entries left out."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if v is not None:
                head, *rest = k.split("_")
                out[head + "".join(x.capitalize() for x in rest)] = camel(v)
        return out
    if isinstance(value, list):
        return [camel(v) for v in value]
    return value


def rows(df: DataFrame) -> list[dict]:
    """Rows as JSON values, ranges as pairs of ``[line, column]``."""

    def pairs(value):
        if isinstance(value, dict):
            if set(value) == {"line", "col"}:
                return [value["line"], value["col"]]
            return {k: pairs(v) for k, v in value.items()}
        return [pairs(v) for v in value] if isinstance(value, list) else value

    return [camel(pairs(json.loads(x))) for x in df.toJSON().toLocalIterator()]


class Api:
    """Serves requests about one workspace, which ``open_`` reads anew for each scan."""

    def __init__(self, spark: SparkSession, open_: Callable[[], Workspace], notes_path: str, root: str = ""):
        self.spark, self.open, self.root = spark, open_, root
        self.notes = notes.NotesLog(spark, notes_path)
        self._ws: Workspace | None = None

    @property
    def ws(self) -> Workspace:
        if self._ws is None:
            self._ws = self.open()
        return self._ws

    def handle(self, line: str) -> str:
        """One request as a line of JSON, and its response."""
        try:
            request = json.loads(line)
        except ValueError as e:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(e)}})
        try:
            answer = {"result": self.call(request.get("method", ""), request.get("params") or {})}
        except RequestError as e:
            answer = {"error": {"code": e.code, "message": str(e)}}
        return json.dumps({"jsonrpc": "2.0", "id": request.get("id"), **answer}, ensure_ascii=False)

    def call(self, method: str, params: dict):
        served = {
            "workspace.scan": self._scan,
            "workspace.healthSummary": lambda p: self._health(self.ws.health(limit=p.get("limit"))),
            "workspace.summary": lambda p: rows(self.ws.summary_counts())[0],
            "workspace.worst": lambda p: next(iter(self._health(self.ws.worst())), {"error": "no scores yet"}),
            "file.diagnostics": lambda p: self._diagnostics(p["file"]),
            "file.list": lambda p: rows(self.ws.files().select(F.col("path").alias("file"), "loc", "language")),
            "slice.compute": self._slice,
            "summary.generate": self._summary,
            "symbol.definition": lambda p: next(iter(self._at(self.ws.definition, p)), None),
            "symbol.references": lambda p: self._at(self.ws.references, p),
            "cache.invalidate": self._invalidate,
            "capabilities.status": lambda p: {r["capability"]: {"available": r["available"], "reason": r["reason"]} for r in self.ws.capabilities().collect()},
            "notes.post": self._post,
            "notes.list": lambda p: self._notes(),
            "notes.resolve": lambda p: {"resolved": self.notes.resolve(p["id"])},
            "notes.clear": lambda p: self.notes.clear(),
            "ping": lambda p: "pong",
            "daemon.info": lambda p: {"version": VERSION, "root": self.root},
        }
        if method not in served:
            raise RequestError(UNKNOWN_METHOD, f"unknown method: {method}")
        try:
            return served[method](params)
        except (KeyError, TypeError, ValueError) as e:
            what = f"symbol not found: {e.args[0]}" if isinstance(e, UnknownSymbol) else f"invalid parameters: {e}"
            raise RequestError(INVALID_PARAMS, what) from e
        except CrossFileUnavailable as e:
            raise RequestError(CROSS_FILE, str(e)) from e

    def _scan(self, params: dict):
        if self._ws is not None:
            self._ws.release()
        self._ws = self.open()

    def _invalidate(self, params: dict):
        self.ws.invalidate()
        self._ws = None

    def _health(self, scores: DataFrame) -> list[dict]:
        target = F.struct("file").alias("target")
        end = F.struct(F.struct(F.lit(0).alias("line"), F.lit(0).alias("col")).alias("start"), F.struct(F.greatest(F.col("loc") - 1, F.lit(0)).cast("int").alias("line"), F.lit(0).alias("col")).alias("end"))
        parts = [
            F.struct(F.col("novelty").alias("value"), F.lit(0).alias("days_since_created"), F.lit(0).alias("recent_churn_loc")).alias("novelty"),
            F.struct(F.col("cognitive_complexity").alias("value"), F.col("cc").alias("raw")).alias("cognitive_complexity"),
            F.struct(F.col("coupling").alias("value"), "fan_in", "fan_out").alias("coupling"),
            F.struct(F.col("ai_signal").alias("value"), F.col("diagnostics").alias("diagnostic_count"), F.col("hallucinated").alias("hallucinated_imports"), F.lit(0.0).alias("untested_blast_radius")).alias("ai_signal"),
        ]
        return rows(scores.select(target, F.struct("file", end.alias("range")).alias("location"), *parts, "composite", "bucket", "dominant"))

    def _diagnostics(self, file: str) -> list[dict]:
        d = self.ws.diagnostics(file=file)
        related = F.transform("related", lambda r: r)
        return rows(d.select("id", "severity", "source", "code", "message", F.struct("file", "range").alias("location"), "symbol", related.alias("related"), "fix"))

    @staticmethod
    def _point(params: dict) -> tuple[str, int, int]:
        place = params["location"]
        line, col = place["range"]["start"]
        return place["file"], int(line), int(col)

    def _at(self, find, params: dict) -> list[dict]:
        return rows(find(*self._point(params)).select("file", "range"))

    def _slice(self, params: dict) -> dict:
        file, line, col = self._point({"location": params["origin"]})
        out = self.ws.slice(file, line, col, params.get("direction", "backward"), params.get("kind", "thin"), int(params.get("maxHops") or 10), params.get("crossFile", True))
        found = rows(out)
        if not found:
            raise ValueError("no function with statements encloses the origin")
        nodes = [{"id": n["id"], "location": {"file": file, "range": n["range"]}, "label": n["label"]} for n in found[0].get("nodes", [])]
        return {"request": params, "nodes": nodes, "edges": found[0].get("edges", []), "truncated": found[0].get("truncated", False)}

    def _summary(self, params: dict) -> dict:
        out = rows(self.ws.summary(params["symbol"]))[0]
        given = rows(self.ws.facts(params["symbol"]).orderBy("ord").select(F.col("fact_id").alias("id"), "kind", "content"))
        now = self.spark.range(1).select(keys.iso_time(F.lit(int(time.time())))).first()[0]
        return {**out, "factsGiven": given, "model": "offline", "generatedAt": now}

    def _post(self, params: dict) -> dict:
        place = params.get("location")
        location = place and {"file": place["file"], "range": {k: dict(zip(("line", "col"), place["range"][k], strict=True)) for k in ("start", "end")}}
        id_ = self.notes.post(params["kind"], params["title"], params.get("body", ""), params.get("id"), location, params.get("symbol"), params.get("severity"), params.get("author", "agent"))
        return next(n for n in self._notes() if n["id"] == id_)

    def _notes(self) -> list[dict]:
        stamp = keys.iso_time(F.unix_seconds("ts"))
        return rows(self.notes.list().withColumn("created_at", stamp).drop("ts", "first_seq"))
