"""A source tree as tables, and the questions that can be asked of it.

Everything is lazy; files are counted when something parsed is first asked for.  Contents are parsed in one pass, once for each distinct content, and in another for slices; all other steps are joins and aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.operators import arity, diagnostics, fanin, gate, health, intervals, layout, resolve, rules, slicing
from corvane.parse import udtf
from corvane.plans import store
from corvane.sources import churn as churn_source
from corvane.sources import manifests, reports, tree

#: Fixed value: where the message of an unknown import looks for the package.
MANIFEST_HINT = {"python": "requirements.txt / pyproject.toml", "typescript": "package.json", "tsx": "package.json", "rust": "Cargo.toml"}
#: The wording of messages.
NO_PACKAGE, DELETE_IMPORT = "no package '%s' in %s", "Delete `import %s`"
ARITY, DEFINED_HERE = "arity mismatch: %s() expects %d..%s args, called with %d", "function defined here"
NO_BINDING = "%s('%s') — no matching uniform/attribute/var in any shader in the workspace"
_SHADERS = (".glsl", ".vert", ".frag", ".wgsl", ".hlsl")
_SCHEMES = {"pyright": reports.pyright, "tsc": reports.tsc, "semgrep": reports.semgrep, "rust-analyzer": reports.rust_analyzer, "pytea": reports.pytea}


class UnknownSymbol(KeyError):
    """No function bears this identifier."""


class CrossFileUnavailable(RuntimeError):
    """Slices across files need the flows of an external tool."""


class NotInFunction(ValueError):
    """No function with statements encloses the point."""


@dataclass(frozen=True)
class Semantics:
    """``compat`` keeps quirks on which recorded results depend; without it, they are corrected.

    In a compatible run the definition index ignores languages, the standard library is a short list, and requirement
    lines keep ``~`` and ``@``.  ``rules`` says whether the rule pack runs over the tree where no scanner's report is given.  ``prefix`` stands before the codes of this engine's own diagnostics, and ``scheme`` in symbol ids.
    """

    compat: bool = True
    rules: bool = True
    prefix: str = ""
    scheme: str = "corvane"
    weights: health.Weights = field(default_factory=health.Weights)


class Workspace:
    """Tables of one source tree.

    ``raw(path, content, size)`` holds the files; ``tool_reports`` maps a tool to its report table; ``numstat(text)`` is version-control text.
    What is missing gives empty tables and a row in ``capabilities``.
    """

    def __init__(self, raw: DataFrame, tool_reports: dict[str, DataFrame] | None = None, numstat: DataFrame | None = None, semantics: Semantics | None = None, silver: store.Silver | None = None, root: str | None = None):
        self.spark: SparkSession = raw.sparkSession
        self.semantics = semantics or Semantics()
        self.reports, self.root, self.silver = tool_reports or {}, root, silver
        self._numstat = numstat
        self.raw = raw
        self.sources = tree.files(raw).persist()
        text = raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("source"))
        self.manifest_files = text.filter(F.col("path").isin(*manifests.MANIFESTS))
        self.packages = manifests.packages(self.manifest_files, compat=self.semantics.compat)
        self.shaders = manifests.shader_symbols(text)
        self._scores: dict[str, DataFrame] = {}
        if silver:
            self.parsed  # noqa: B018  (what is new is stored now)

    @classmethod
    def scan(cls, spark: SparkSession, root: str, **options) -> Workspace:
        """Reads the tree below a folder that all executors share; files that no table needs aren't read."""
        extensions = tuple(e for ends in schemas.LANGUAGES.values() for e in ends) + _SHADERS
        return cls(tree.read(spark, root, extensions, tuple(manifests.MANIFESTS)), root=root, **options)

    @cached_property
    def parsed(self) -> DataFrame:
        """What the front ends find in each file; without a store, bodies are left to ``_with_bodies``, as only slices look at them and they are most of it."""
        return self._found(False)

    @cached_property
    def _with_bodies(self) -> DataFrame:
        return self.parsed if self.silver else self._found(True)

    def _found(self, bodies: bool) -> DataFrame:
        """Files are counted for the number of tasks."""
        many, on = store.tasks(self.sources), ["blob_sha", "language"]
        found = self.silver.parsed(self.sources, many) if self.silver else store.parse_once(self.sources, many, bodies)
        return self.sources.select("path", "language", "blob_sha", "loc").repartition(many, *on).join(found.repartition(many, *on), on).persist()

    # --- relations ---------------------------------------------------------------------------------------------

    def _exploded(self, column: str) -> DataFrame:
        parsed = self._with_bodies if column == "bodies" else self.parsed
        return parsed.select(F.col("path").alias("file"), "language", F.posexplode(column).alias("ord", "_r")).select("file", "language", "_r.*", "ord")

    def symbol_id(self, file: Column, name: Column) -> Column:
        return F.concat(F.lit(f"local . {self.semantics.scheme} "), file, F.lit(" "), name, F.lit("#."))

    def files(self) -> DataFrame:
        return self.sources.select("path", "language", "loc", "blob_sha", "bytes_read").orderBy("path")

    def functions(self) -> DataFrame:
        rows = self._exploded("functions").drop("language")
        return rows.withColumn("symbol_id", self.symbol_id(F.col("file"), F.col("name")))

    def imports(self) -> DataFrame:
        return self._exploded("imports")

    def definitions(self) -> DataFrame:
        return self._exploded("definitions").drop("ord")

    def call_sites(self) -> DataFrame:
        return self._exploded("calls")

    def bindings(self) -> DataFrame:
        return self._exploded("bindings")

    def bodies(self) -> DataFrame:
        return self._exploded("bodies")

    def ecosystems(self) -> DataFrame:
        """``(ecosystem)`` of those that have a manifest at all."""
        return manifests.present(self.manifest_files)

    def local_modules(self) -> DataFrame:
        return resolve.local_modules(self.sources)

    def churn(self) -> DataFrame:
        if self._numstat is None:
            return self.spark.createDataFrame([], schemas.CHURN)
        return churn_source.numstat(self._numstat, compat=self.semantics.compat)

    # --- diagnostics -------------------------------------------------------------------------------------------

    def unknown_imports(self) -> DataFrame:
        rows = resolve.unknown_imports(self.imports(), self.packages, self.ecosystems(), self.local_modules(), self.semantics.compat)
        hint = F.create_map(*(F.lit(x) for kv in MANIFEST_HINT.items() for x in kv))
        line = F.col("range.start.line")
        edge = lambda x: F.struct(x.cast("int").alias("line"), F.lit(0).alias("col"))
        place = F.struct("file", F.struct(edge(line).alias("start"), edge(line + 1).alias("end")).alias("range"))
        fix = F.struct(F.format_string(DELETE_IMPORT, "module").alias("description"), F.array(F.struct(place.alias("location"), F.lit("").alias("new_text"))).alias("edits"))
        message = F.format_string(NO_PACKAGE, "module", F.element_at(hint, F.col("language")))
        return diagnostics.build(rows, "hallucination", f"{self.semantics.prefix}hallucination/unknown-import", "critical", message, F.concat_ws(":", F.lit("hallucination"), "file", line.cast("string"), "module"), fix=fix)

    def arity_mismatches(self) -> DataFrame:
        calls = self.call_sites().withColumnRenamed("callee", "name")
        defs = self.definitions().select("language", "name", "min_args", "max_args", F.struct("file", "range").alias("defined"))
        family = F.when(F.col("language").isin("typescript", "tsx"), "js").otherwise(F.col("language"))
        on = ["name"] if self.semantics.compat else ["name", "language"]
        calls, defs = (calls.drop("language"), defs.drop("language")) if self.semantics.compat else (calls.withColumn("language", family), defs.withColumn("language", family))
        rows = arity.arity_mismatches(calls, defs, on)
        most = F.coalesce(F.col("max_args").cast("string"), F.lit("∞"))
        message = F.format_string(ARITY, "name", "min_args", most, "argc")
        id_ = F.concat_ws(":", F.lit("crossfile-arity"), "file", F.col("range.start.line").cast("string"), F.col("range.start.col").cast("string"), "name")
        related = F.array(F.struct(F.col("defined").alias("location"), F.lit(DEFINED_HERE).alias("message")))
        return diagnostics.build(rows, "crossfile", f"{self.semantics.prefix}crossfile/arity-mismatch", "error", message, id_, related=related)

    def unknown_bindings(self) -> DataFrame:
        rows = resolve.unresolved_if_any(self.bindings(), "name", self.shaders, "name")
        message = F.format_string(NO_BINDING, "callee", "name")
        id_ = F.concat_ws(":", F.lit("binding"), "file", F.col("range.start.line").cast("string"), "name")
        return diagnostics.build(rows, "binding", f"{self.semantics.prefix}binding/unknown-uniform", "error", message, id_)

    def rule_hits(self) -> DataFrame:
        """The rule pack over the tree itself, patterns and structural rules; reports of an external scanner are separate."""
        regex = rules.hits_by_file(self.sources)
        zero = F.lit(0)
        point = F.struct(F.col("line").alias("line"), zero.alias("col"))
        regex = regex.select("file", "rule", "severity", "message", F.struct(point.alias("start"), point.alias("end")).alias("range"))
        found = rules.structural_hits(udtf.nodes(self.sources.select("path", "language", "source"), rules.node_conditions()))
        rows = regex.unionByName(found).withColumn("ord", F.lit(0))
        return diagnostics.build(rows, "rules", F.col("rule"), F.col("severity"), F.col("message"), F.concat_ws(":", F.lit("rules"), "file", F.col("range.start.line").cast("string"), "rule"))

    def own_diagnostics(self) -> DataFrame:
        """What the tree itself shows, without the reports of tools."""
        return diagnostics.union([self.unknown_imports(), self.arity_mismatches(), self.unknown_bindings()])

    def all_diagnostics(self) -> DataFrame:
        own = [self.own_diagnostics()]
        if self.semantics.rules and "semgrep" not in self.reports:
            own.append(self.rule_hits())
        for tool, read in _SCHEMES.items():
            if tool in self.reports:
                own.append(read(self.reports[tool]) if tool == "pytea" else read(self.reports[tool], root=self.root))
        return diagnostics.union(own)

    def diagnostics(self, file: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        return diagnostics.ordered(diagnostics.chosen(self.all_diagnostics(), include, exclude, file))

    # --- health --------------------------------------------------------------------------------------------------

    def _unit_scores(self) -> DataFrame:
        functions = self.functions()
        hall = self.unknown_imports().groupBy("file").agg(F.count(F.lit(1)).alias("hallucinated"))
        fan = fanin.fan_in(functions)
        churn = self.churn().withColumnRenamed("path", "file").withColumnRenamed("churn_loc", "churn")
        # Never broadcast: a plan takes them for as small as the columns that their texts are made of.
        units = functions.join(fan.hint("merge"), "symbol_id", "left").join(hall.hint("merge"), "file", "left").join(churn.hint("merge"), "file", "left")
        units = units.fillna(0, ["fan_in", "hallucinated", "churn"]).withColumns({"fan_out": fanin.fan_out(F.col("callees")), "diagnostics": F.lit(0), "untested": F.lit(False)})
        return health.unit_scores(units, self.semantics.weights)

    def health(self, kind: str = "file", limit: int | None = None) -> DataFrame:
        """Scores of files or of functions, worst first, with the dominant component."""
        if kind not in ("file", "symbol"):
            raise ValueError(f"kind is file or symbol, not {kind}")
        units = self._unit_scores()
        if kind == "symbol":
            return health.ranked(units.withColumn("dominant", health.dominant()), "symbol_id", limit)
        counts = diagnostics.per_file(self.all_diagnostics())
        files = self.sources.select(F.col("path").alias("file"), "loc", "language").join(counts.hint("merge"), "file", "left").fillna(0, ["diagnostics", "errors", "hallucinated"])
        scores = health.file_scores(files, units)
        return health.ranked(scores.withColumn("dominant", health.dominant()), "file", limit)

    def worst(self) -> DataFrame:
        return self.health("file", 1)

    def worst_function(self) -> DataFrame:
        return self.health("symbol", 1)

    def red_functions(self) -> DataFrame:
        """Functions to decorate: strictly above the red bound, which the bucket itself includes."""
        return self._unit_scores().filter("composite > 0.6")

    def summary_counts(self) -> DataFrame:
        count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
        return health.summary(self.health("file"), count(self.functions()), count(self.all_diagnostics()))

    def treemap(self, width: float = 1000.0, height: float = 600.0) -> DataFrame:
        leaves = self.health("file").select(F.lit("workspace").alias("box"), "file", "loc")
        return layout.treemap(leaves, "box", "file", "loc", width, height)

    # --- point queries ---------------------------------------------------------------------------------------------

    def _point(self, file: str, line: int, col: int) -> DataFrame:
        return self.spark.createDataFrame([(0, file, line, col)], "q int, file string, line int, col int")

    def _inside(self) -> Column:
        s, e, line, col = F.col("range.start"), F.col("range.end"), F.col("line"), F.col("col")
        after = (s["line"] < line) | ((s["line"] == line) & (s["col"] <= col))
        before = (e["line"] > line) | ((e["line"] == line) & (e["col"] >= col))
        return after & before

    def enclosing(self, points: DataFrame, by: str = "definition") -> DataFrame:
        """The innermost function around each point ``(q, file, line, col)``; of equals the later for definitions, the earlier for ``hover``."""
        s, e = F.col("range.start"), F.col("range.end")
        units = self.functions().select("file", "symbol_id", "name", "range", F.col("ord").alias("unit_ord"), "loc", "callees")
        span = (e["line"] - s["line"]) * 1000 + (e["col"] - s["col"]) if by == "hover" else intervals.packed_span(s["line"], s["col"], e["line"], e["col"])
        order = [span, F.col("unit_ord") if by == "hover" else -F.col("unit_ord")]
        return intervals.innermost(points, units, ["file"], self._inside(), ["q", "file"], order)

    def definition(self, file: str, line: int, col: int) -> DataFrame:
        return self.enclosing(self._point(file, line, col)).select("file", "symbol_id", "name", "range")

    def hover(self, file: str, line: int, col: int) -> DataFrame:
        return self.enclosing(self._point(file, line, col), "hover").select("file", "symbol_id", "name", "range")

    def references(self, file: str, line: int, col: int) -> DataFrame:
        """Functions any of whose callees ends with the leaf of the definition at the point."""
        leaf = self.definition(file, line, col).select(F.substring_index("name", ".", -1).alias("leaf"))
        texts = self.functions().select("symbol_id", "file", "name", "range", F.explode("callees").alias("callee"))
        return intervals.by_suffix(texts, "callee", leaf, "leaf").select("symbol_id", "file", "name", "range").distinct()

    def slice(self, file: str, line: int, col: int, direction: str = "backward", kind: str = "thin", max_hops: int = 10, cross_file: bool = False, flow_report: DataFrame | None = None) -> DataFrame:
        """One row with ``nodes``, ``edges`` and ``truncated``."""
        if cross_file:
            if flow_report is None:
                raise CrossFileUnavailable("no flow report was given")
            nodes = reports.flows(flow_report, fallback=file)
            return nodes.agg(F.array_sort(F.collect_list(F.struct("id", "file", "range", "label"))).alias("nodes"))
        units = self.bodies().filter(F.col("file") == file)
        s, e = F.col("range.start"), F.col("range.end")
        found = intervals.innermost(self._point(file, line, col), units.select("file", "name", "range", "statements", F.col("ord").alias("unit_ord")), ["file"], self._inside(), ["q", "file"], [intervals.packed_span(s["line"], s["col"], e["line"], e["col"]), F.col("unit_ord")])
        out = slicing.slices(found, slicing.origin_index(F.col("statements"), F.lit(line), F.lit(col)), direction, kind, max_hops)
        return out.select("file", "name", "nodes", "edges", "truncated")

    def slice_everything(self, direction: str = "backward", max_hops: int = 10) -> DataFrame:
        """The slice from every statement of every function: ``(file, name, at, nodes, edges, truncated)``."""
        each = self.bodies().withColumn("at", F.explode(F.sequence(F.lit(0), F.size("statements") - 1))).filter("at >= 0")
        return slicing.slices(each, F.col("at"), direction, "thin", max_hops).select("file", "name", "at", "nodes", "edges", "truncated")

    def facts(self, symbol: str | None = None) -> DataFrame:
        functions = self.functions()
        return gate.facts(functions if symbol is None else functions.filter(F.col("symbol_id") == symbol), self.imports())

    def summary(self, symbol: str) -> DataFrame:
        """Offline summary: ``(symbol, text, claims)``, each fact a claim that supports itself."""
        if self.functions().filter(F.col("symbol_id") == symbol).isEmpty():
            raise UnknownSymbol(symbol)
        known = self.facts(symbol)
        claims = known.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content", "fact_id"))), lambda f: F.struct(f["content"].alias("text"), F.lit(True).alias("entailed"), F.array(f["fact_id"]).alias("supporting_fact_ids"))).alias("claims"))
        return gate.rendered(known).join(claims, "symbol")

    def gate_claims(self, text: str, symbol: str) -> DataFrame:
        """A written summary's sentences against the facts of its symbol."""
        known = self.facts(symbol).groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "fact_id", "content"))), lambda f: F.struct(f["fact_id"].alias("id"), f["content"].alias("content"))).alias("facts"))
        return gate.gated(known.withColumn("text", F.lit(text)), "text", "facts").drop("text", "facts")

    # --- state -----------------------------------------------------------------------------------------------------

    def capabilities(self) -> DataFrame:
        """``(capability, available, reason)``; a tool's report counts only where the tree has what the tool needs."""
        langs = {r["language"] for r in self.sources.select("language").distinct().collect()}
        names = {r["path"] for r in self.raw.filter(F.col("path").isin("tsconfig.json", "Cargo.toml")).select("path").collect()}
        needs = {
            "pyright": "python" in langs,
            "tsc": bool(langs & {"typescript", "tsx"}) and "tsconfig.json" in names,
            "rust-analyzer": "rust" in langs and "Cargo.toml" in names,
            "semgrep": True,
            "pytea": "python" in langs and not self.sources.filter((F.col("language") == "python") & reports.imports_torch(F.col("source"))).isEmpty(),
        }
        rows = [(t, t in self.reports, "report given" if t in self.reports else "no report" if need else "nothing in the tree needs it") for t, need in needs.items()]
        rows.append(("churn", self._numstat is not None, "numstat given" if self._numstat is not None else "no numstat"))
        rows.append(("summaries", True, "offline, from facts"))
        rows.append(("cross-file-slices", False, "only from a flow report"))
        structural = [r.id for r in rules.RULES if r.pattern is None]
        rows.append(("rules", True, f"{len(rules.RULES) - len(structural)} by pattern, {len(structural)} by tree patterns"))
        return self.spark.createDataFrame(rows, schemas.CAPABILITIES)

    def release(self) -> None:
        """Drop what is cached."""
        self.sources.unpersist()
        for kept in ("parsed", "_with_bodies"):
            if kept in self.__dict__:
                self.__dict__[kept].unpersist()

    def invalidate(self) -> None:
        """Drop what is cached, and the parsed contents of a store."""
        self.release()
        if self.silver:
            self.silver.invalidate()
