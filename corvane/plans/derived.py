"""Queries over texts that follow from the tables by a stated rule: manifests, imports, reports, source trees, notes.

The tables hold no source code, so a part stands for a manifest, an order for a report, a line for an import, and so on.  Each query runs its operator
over the text that its rule makes of every row; the oracle states what the operator must find, from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import arity, crossing, diagnostics, gate, health, intervals, keys, latest, layout, notes, ordered, resolve, rules, slicing
from corvane.parse import udtf
from corvane.plans.catalog import ORACLES, QUERIES, SENTENCES_SQL, _slice_oracle, _talks, query, table
from corvane.sources import churn, manifests, reports, tree
from corvane.session import work_folder
from corvane.shipping import dealt
from corvane.streaming import changes
from corvane.streaming.incremental import Incremental

# --- manifests ------------------------------------------------------------------------------------------------------

#: Each format: its file, the text of part ``k``, and the names that it declares.
FORMATS = {
    "requirements": ("requirements.txt", "# all\nPkg_{k}==1.0 # pinned\n-r other.txt\n\nlib{k}[extra]>=2", ("pkg-{k}", "lib{k}")),
    "pyproject": ("pyproject.toml", '[project]\ndependencies = ["Dep_{k}>=1", "x{k}"]\n[tool.poetry.dependencies]\nPo_{k} = "1"\n', ("dep-{k}", "x{k}", "po-{k}")),
    "poetry_lock": ("poetry.lock", '[[package]]\nname = "A_{k}"\nversion = "1"\n[[package]]\nname = "b{k}"\n', ("a-{k}", "b{k}")),
    "uv_lock": ("uv.lock", 'version = 1\n[[package]]\nname = "U_{k}"\n', ("u-{k}",)),
    "pipfile_lock": ("Pipfile.lock", '{{"default": {{"P_{k}": {{}}}}, "develop": {{"q{k}": {{}}}}}}', ("p-{k}", "q{k}")),
    "package_json": ("package.json", '{{"name": "n", "dependencies": {{"@s/a{k}": "1"}}, "devDependencies": {{"b{k}": "1"}}, "peerDependencies": {{"c{k}": "1"}}}}', ("@s/a{k}", "b{k}", "c{k}")),
    "package_lock": ("package-lock.json", '{{"packages": {{"": {{}}, "node_modules/a{k}/node_modules/@t/c{k}": {{}}}}, "dependencies": {{"d{k}": {{}}}}}}', ("@t/c{k}", "d{k}")),
    "pnpm_lock": ("pnpm-lock.yaml", "packages:\n  /x{k}@1.0.0:\n      dev: true\n", ("x{k}", "/x{k}@1.0.0")),
    "yarn_lock": ("yarn.lock", '"y{k}@^1":\n  version "1"\n\n@z/w{k}@~2:\n  version "2"\n', ("y{k}", "@z/w{k}")),
    "cargo_toml": ("Cargo.toml", '[package]\nname = "me-{k}"\n[dependencies]\nser-de{k} = "1"\n', ("me-{k}", "me_{k}", "ser-de{k}", "ser_de{k}")),
    "cargo_lock": ("Cargo.lock", '[[package]]\nname = "cr-{k}"\nversion = "1"\n', ("cr-{k}", "cr_{k}")),
}


def _filled(pattern: str, key: str) -> Column:
    """The pattern with the key for ``{k}``, and single braces for double ones."""
    parts = pattern.replace("{{", "\x01").replace("}}", "\x02").split("{k}")
    plain = [F.lit(p.replace("\x01", "{").replace("\x02", "}")) for p in parts]
    out = [plain[0]]
    for p in plain[1:]:
        out += [F.col(key).cast("string"), p]
    return F.concat(*out)


def _said(pattern: str, key: str) -> str:
    """The same in SQL, for patterns without quotes."""
    return "'" + pattern.replace("{k}", f"' || {key} || '") + "'"


def _manifest(name: str) -> None:
    file, text, names = FORMATS[name]
    eco = manifests.MANIFESTS[file]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = table(spark, sf_dir, "part").select(F.lit(file).alias("path"), _filled(text, "p_partkey").alias("source"))
        return manifests.packages(files)

    run.__name__ = f"q_manifest_{name}"
    each = " UNION ALL ".join(f"SELECT {_said(n, 'p_partkey')} AS name FROM part" for n in names)
    query(f"SELECT DISTINCT '{eco}' AS ecosystem, name, '{file}' AS source_file FROM ({each})")(run)


for _name in FORMATS:
    _manifest(_name)


@query("""
SELECT DISTINCT p_brand, unnest(CASE p_partkey % 4 WHEN 0 THEN ['python'] WHEN 1 THEN ['js', 'python'] WHEN 2 THEN ['rust'] ELSE [] END) AS ecosystem FROM part
""")
def q_manifest_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand is a workspace, and each of its parts a file at its root or below."""
    names = F.array(F.lit("requirements.txt"), F.lit("yarn.lock"), F.lit("Cargo.lock"), F.lit("src/package.json"))
    files = table(spark, sf_dir, "part").select("p_brand", F.get(names, (F.col("p_partkey") % 4).cast("int")).alias("path"))
    both = files.unionByName(files.filter("path = 'yarn.lock'").withColumn("path", F.lit("uv.lock")))
    return manifests.present(both, keys=("p_brand",)).select("p_brand", "ecosystem")


@query("""
SELECT DISTINCT name FROM (SELECT unnest(CASE WHEN p_partkey % 3 = 0 THEN ['u' || p_partkey, 'v' || p_partkey, 'c' || p_partkey] WHEN p_partkey % 3 = 1 THEN ['w' || p_partkey, 't' || p_partkey] ELSE [] END) AS name FROM part)
""")
def q_shader_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    glsl = _filled("uniform mat4 u{k};\nvarying highp vec2 v{k};\nin vec3[4] c{k};\n// uniform x", "p_partkey")
    wgsl = _filled("@group(0) var<uniform> w{k}: f32;\nvar t{k} : i32;", "p_partkey")
    kind = F.col("p_partkey") % 3
    path = F.concat(F.col("p_partkey").cast("string"), F.when(kind == 0, ".frag").when(kind == 1, ".wgsl").otherwise(".txt"))
    return manifests.shader_symbols(table(spark, sf_dir, "part").select(path.alias("path"), F.when(kind == 1, wgsl).otherwise(glsl).alias("source")))


# --- imports --------------------------------------------------------------------------------------------------------

#: Imports by ``l_partkey mod 12`` and language: the module, and whether only a catalogue could explain it.
_MODULES = {
    "python": ("os", "Pkg_{k}", ".near", "mine.deep.x", "nowhere{k}", "json", "lib{k}", "", "numpy", "local{k}.a", "urllib", "pkg_{k}"),
    "tsx": ("fs", "node:fs/promises", "./near", "/abs", "@s/a{k}/deep", "b{k}/lib/x", "nowhere{k}", "path/posix", "react", "../up", "@none/x{k}", "url"),
    "rust": ("std", "crate", "ser_de{k}", "ser-de{k}", "nowhere{k}", "super", "proc_macro", "tokio", "mine", "self", "core", "ser_no{k}"),
}
_DECLARED = {"python": ("pkg-{k}", "lib{k}"), "js": ("@s/a{k}", "b{k}"), "rust": ("ser-de{k}", "ser_de{k}")}


def _unknown_sql() -> str:
    """What is unknown: by place of the module in its list, always or unless its part is small enough to be declared."""
    always = {"python": (4, 8), "tsx": (6, 8, 10), "rust": (4, 7, 11)}
    unless = {"python": (1, 6, 11), "tsx": (4, 5), "rust": (2, 3)}
    out = []
    for n, (lang, modules) in enumerate(_MODULES.items()):
        for m in always[lang] + unless[lang]:
            size = " AND p_size > 25" if m in unless[lang] else ""
            out.append(f"SELECT l_orderkey, l_linenumber, '{lang}' AS language, {_said(modules[m], 'l_partkey')} AS module FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 3 = {n} AND l_partkey % 12 = {m}{size}")
    return "\nUNION ALL ".join(out)


@query(_unknown_sql())
def q_unknown_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    lang = F.get(F.array(*map(F.lit, _MODULES)), (F.col("l_linenumber") % 3).cast("int"))
    # The pattern is chosen before it is filled: a plan that repeats the expression then makes one text and not all of them.
    each = F.array(*(F.array(*map(F.lit, modules)) for modules in _MODULES.values()))
    pattern = F.get(F.get(each, (F.col("l_linenumber") % 3).cast("int")), (F.col("l_partkey") % 12).cast("int"))
    module = F.replace(pattern, F.lit("{k}"), F.col("l_partkey").cast("string"))
    imports = lines.select("l_orderkey", "l_linenumber", lang.alias("language"), module.alias("module"))
    small = table(spark, sf_dir, "part").filter("p_size <= 25")
    named = [F.struct(F.lit(eco).alias("ecosystem"), _filled(p, "p_partkey").alias("name")) for eco, ps in _DECLARED.items() for p in ps]
    packages = small.select(F.inline(F.array(*named)))
    present = spark.createDataFrame([("python",), ("js",), ("rust",)], "ecosystem string")
    local = table(spark, sf_dir, "part").select(F.lit("python").alias("ecosystem"), _filled("local{k}", "p_partkey").alias("name"))
    own = spark.createDataFrame([("python", "mine"), ("rust", "mine")], "ecosystem string, name string")
    return resolve.unknown_imports(imports, packages, present, local.unionByName(own)).select("l_orderkey", "l_linenumber", "language", "module")


@query("""
SELECT DISTINCT ecosystem, name FROM (
  SELECT 'python' AS ecosystem, 'm' || p_partkey AS name FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'python', 'd' || (p_partkey % 10) FROM part WHERE p_partkey % 4 = 1
  UNION ALL SELECT 'rust', 'r' || p_partkey FROM part WHERE p_partkey % 4 = 2 UNION ALL SELECT 'rust', 'h' || p_partkey FROM part WHERE p_partkey % 4 = 3)
""")
def q_local_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    folder = F.concat(F.lit("d"), (k % 10).cast("string"), F.lit("/sub/"), k.cast("string"), F.lit(".py"))
    path = F.when(k % 4 == 0, _filled("m{k}.py", "p_partkey")).when(k % 4 == 1, folder).when(k % 4 == 2, _filled("src/r{k}.rs", "p_partkey")).otherwise(_filled("src/h{k}/mod.rs", "p_partkey"))
    part = table(spark, sf_dir, "part")
    deep = part.select(_filled("src/a/b{k}.rs", "p_partkey").alias("path"))  # no module of the root
    return resolve.local_modules(part.select(path.alias("path")).unionByName(deep))


# --- source trees and churn -----------------------------------------------------------------------------------------


@query("""
SELECT 'd' || doc_id || e AS path, l AS language, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS loc, sha256(text) AS blob_sha, strlen(text) AS bytes_read FROM (
  SELECT doc_id, coalesce(text, '') AS text, ['.py', '.PYI', '.tsx', '.mts', '.rs'][(doc_id % 6 + 1)::INT] AS e, ['python', 'python', 'tsx', 'typescript', 'rust'][(doc_id % 6 + 1)::INT] AS l FROM documents WHERE doc_id % 6 < 5)
""")
def q_tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, each sixth with an extension that no language has."""
    ends = F.array(*(F.lit(e) for e in (".py", ".PYI", ".tsx", ".mts", ".rs", ".md")))
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.get(ends, (F.col("doc_id") % 6).cast("int")))
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    raw = table(spark, sf_dir, "documents").select(path.alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("size"))
    return tree.files(raw).drop("source")


@query("""
SELECT 'src/p' || l_partkey || '.py' AS path, sum(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity::BIGINT + l_linenumber END)::BIGINT AS churn_loc
FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1
""")
def q_numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as lines of numstat; the seventh of an order is a binary file, the sixth a renamed one."""
    path = F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".py"))
    path = F.when(F.col("l_linenumber") == 6, F.concat(F.lit("old.py => "), path)).otherwise(path)
    count = lambda c: F.when(F.col("l_linenumber") == 7, "-").otherwise(F.col(c).cast("long").cast("string"))
    text = F.concat_ws("\t", count("l_quantity"), count("l_linenumber"), path)
    return churn.numstat(table(spark, sf_dir, "lineitem").select(text.alias("text")))


@query("""
SELECT path, kind, max(seq) AS seq FROM (
  SELECT event_id AS seq, 'src/u' || user_id || CASE event_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' ELSE '.md' END AS path,
    CASE event_type WHEN 'click' THEN 'create' WHEN 'view' THEN 'modify' WHEN 'error' THEN 'remove' ELSE 'access' END AS kind FROM events)
WHERE kind <> 'access' AND path NOT LIKE '%.md' GROUP BY path, kind QUALIFY row_number() OVER (PARTITION BY path ORDER BY max(seq) DESC) = 1
""")
def q_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of files: what the watcher passes on, and the last change of each file."""
    end = F.when(F.col("event_id") % 3 == 0, ".py").when(F.col("event_id") % 3 == 1, ".rs").otherwise(".md")
    kind = F.when(F.col("event_type") == "click", "create").when(F.col("event_type") == "view", "modify").when(F.col("event_type") == "error", "remove").otherwise("access")
    path = F.concat(F.lit("src/u"), F.col("user_id").cast("string"), end)
    feed = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), path.alias("path"), kind.alias("kind"))
    hidden = feed.withColumn("path", F.concat(F.lit("web/node_modules/"), "path"))
    return changes.tombstones(changes.relevant(feed.unionByName(hidden))).select("path", "kind", "seq")


@query("""
WITH last AS (SELECT user_id, max(event_id) AS e, arg_max(event_type, event_id) AS t FROM events GROUP BY 1), live AS (SELECT * FROM last WHERE t <> 'error'),
one AS (SELECT 'n' || e * 7 % 101 AS name, any_value(e % 3) AS need FROM live GROUP BY 1 HAVING count(*) = 1)
SELECT 'u' || user_id AS path, name AS callee, e % 5 AS argc, need FROM live JOIN one ON name = 'n' || e * 13 % 101 WHERE e % 5 <> need
""")
def q_incremental_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of files, taken in three changes; a file defines one name and calls another, and an error removes it.  What is left must equal one look at the last versions."""
    events = table(spark, sf_dir, "events")
    name = lambda times: F.concat(F.lit("n"), (F.col("e") * times % 101).cast("string"))

    def judge(units: DataFrame, provided: DataFrame) -> DataFrame:
        calls = units.select("path", F.col("body.callee").alias("callee"), F.col("body.argc").alias("argc"))
        defs = provided.select(F.col("key").alias("callee"), F.col("value").cast("long").alias("need"))
        return arity.arity_mismatches(calls, defs, ["callee"], least="need", most="need")

    state = Incremental(spark, f"{work_folder(spark)}/incremental", judge, "struct<callee:string,argc:long>", "callee string, argc long, need long", slots=4, salts=2)
    n = events.count()
    for k in range(3):
        batch = events.filter((F.col("event_id") * 3 >= k * n) & (F.col("event_id") * 3 < (k + 1) * n))
        last = latest.latest_wins(batch.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("e"), "event_type"), ["path"], ["e"])
        defined = F.array(F.struct(name(7).alias("key"), (F.col("e") % 3).cast("string").alias("value")))
        units = last.filter("event_type <> 'error'").select("path", defined.alias("provides"), F.array(name(13)).alias("uses"), F.struct(name(13).alias("callee"), (F.col("e") % 5).alias("argc")).alias("body"))
        state.apply(last.select("path"), units, k)
    return state.results()


@query("SELECT DISTINCT sha256(text) AS blob_sha, lang AS language FROM documents EXCEPT SELECT sha256(text), lang FROM documents WHERE doc_id % 3 = 0")
def q_unseen_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that are not parsed yet, where every third document is."""
    blobs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("blob_sha"), F.col("lang").alias("language"))
    return latest.unseen(blobs, blobs.filter("doc_id % 3 = 0")).select("blob_sha", "language")


@query("SELECT doc_id, doc_id % 4 < 2 AS torch FROM documents")
def q_torch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    line = F.when(k == 0, "\n  import torch.nn").when(k == 1, "\nfrom torch import nn").when(k == 2, "\nx = 'import torch'").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", reports.imports_torch(F.concat(F.translate("text", "\n", " "), line)).alias("torch"))


# --- reports --------------------------------------------------------------------------------------------------------


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("id", "file", F.col("range.start.line").alias("line"), F.col("range.start.col").alias("col"), F.col("range.end.line").alias("end_line"), "severity", "source", "code", "message")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN '{0}' WHEN 'O' THEN '{1}' ELSE '{2}' END"


@query(f"""
SELECT 'pyright:' || file || ':' || line || ':' || code AS id, * FROM (SELECT 'o' || o_custkey || '.py' AS file, (o_orderkey % 90)::INT AS line, (o_orderkey % 7)::INT AS col, (o_orderkey % 90 + 1)::INT AS end_line,
  {_STATUS.format("error", "warning", "info")} AS severity, 'pyright' AS source, CASE WHEN o_orderkey % 5 = 0 THEN 'pyright' ELSE 'rule' || o_orderkey % 5 END AS code, 'order ' || o_orderkey AS message FROM orders)
""")
def q_report_pyright(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    sev = F.when(F.col("s") == "F", "error").when(F.col("s") == "O", "warning").otherwise("information")
    rule = F.when(k % 5 == 0, "").otherwise(F.format_string(',"rule":"rule%d"', k % 5))
    text = F.format_string('{"generalDiagnostics":[{"file":"/w/o%d.py","severity":"%s","message":"order %d"%s,"range":{"start":{"line":%d,"character":%d},"end":{"line":%d,"character":0}}}]}', "c", sev, k, rule, k % 90, k % 7, k % 90 + 1)
    return _found(reports.pyright(_orders(spark, sf_dir).select(text.alias("json")), root="/w"))


@query(f"""
SELECT 'semgrep:' || file || ':' || line || ':' || code AS id, * FROM (SELECT 'a/o' || o_custkey || '.py' AS file, greatest(o_orderkey % 90 - 1, 0)::INT AS line, greatest(o_orderkey % 7 - 1, 0)::INT AS col, (o_orderkey % 90)::INT AS end_line,
  {_STATUS.format("error", "info", "warning")} AS severity, 'semgrep' AS source, 'slop.r' || o_orderkey % 5 AS code, CASE WHEN o_orderkey % 3 = 0 THEN 'slop.r' || o_orderkey % 5 ELSE 'order ' || o_orderkey END AS message FROM orders)
""")
def q_report_semgrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    sev = F.when(F.col("s") == "F", ',"severity":"ERROR"').when(F.col("s") == "O", ',"severity":"INFO"').otherwise("")
    said = F.when(k % 3 == 0, '"x":1').otherwise(F.format_string('"message":"order %d"', k))
    text = F.format_string('{"results":[{"check_id":"rules.pack.slop.r%d","path":"/w/a\\\\o%d.py","start":{"line":%d,"col":%d},"end":{"line":%d,"col":1},"extra":{%s%s}},{"path":"broken"}]}', k % 5, "c", k % 90, k % 7, k % 90 + 1, said, sev)
    return _found(reports.semgrep(_orders(spark, sf_dir).select(text.alias("json")), root="/w/"))


@query("""
SELECT 'rust-analyzer:' || file || ':' || line || ':' || code AS id, * FROM (SELECT 'src/o ' || o_orderkey || '.rs' AS file, line, 0 AS col, line AS end_line, severity, 'rust-analyzer' AS source, code, message FROM (
  SELECT o_orderkey, (o_orderkey % 90)::INT AS line, 'warning' AS severity, 'E' || o_orderkey % 9 AS code, 'second' AS message FROM orders
  UNION ALL SELECT o_orderkey, 3, 'error', 'rustc', 'none' FROM orders UNION ALL SELECT o_orderkey, 4, 'hint', 'n' || o_orderkey % 9, 'value' FROM orders))
""")
def q_report_rust_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two entries share file, line and code: the second stays."""
    k = F.col("k")
    at = '{"range":{"start":{"line":%d,"character":0},"end":{"line":%d,"character":0}}'
    text = F.format_string(
        '{"uri":"file:///w/src/o%%20%d.rs","diagnostics":[' + f'{at},"severity":1,"code":"E%d","message":"first"}},{at},"severity":2,"code":"E%d","message":"second"}},' + '{"range":{"start":{"line":3,"character":0},"end":{"line":3,"character":0}},"source":"rustc","message":"none"},{"range":{"start":{"line":4,"character":0},"end":{"line":4,"character":0}},"severity":4,"code":{"value":"n%d"},"message":"value"}]}',
        k, k % 90, k % 90, k % 9, k % 90, k % 90, k % 9, k % 9,
    )
    return _found(reports.rust_analyzer(_orders(spark, sf_dir).select(text.alias("json")), root="/w"))


@query("""
SELECT 'pytea:o' || o_orderkey || '.py:' || ord AS id, 'o' || o_orderkey || '.py' AS file, 0 AS line, 0 AS col, 0 AS end_line, 'error' AS severity, 'pytea' AS source, code, message FROM (
  SELECT o_orderkey, 0 AS ord, 'pytea/shape-mismatch' AS code, '[Shape Error] at ' || o_custkey AS message FROM orders UNION ALL SELECT o_orderkey, 1, 'pytea/analysis-error', '[Pytea Error] in ' || o_custkey FROM orders)
""")
def q_report_pytea(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.format_string("o%d.py", "k").alias("file"), F.format_string("start\n  [Shape Error] at %d\r\nnoise [Shape Error]\n[Pytea Error] in %d\nend", "c", "c").alias("text"))
    return _found(reports.pytea(rows))


@query("""
SELECT id, file, line, label, count(*) AS n FROM (SELECT 0 AS id, 'f' || o_custkey || '.py' AS file, (o_orderkey % 90)::INT AS line, 'x' || o_custkey AS label FROM orders UNION ALL SELECT 2, 'main.py', 0, '<node>' FROM orders) GROUP BY ALL
""")
def q_report_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('log\n[FLOW-BEGIN]\n{"file":"f%d.py","line":%d,"label":"x%d"}\nnot json\n{"line":0}\n[FLOW-END]\n{"file":"late"}', "c", F.col("k") % 90 + 1, "c")
    rows = reports.flows(_orders(spark, sf_dir).select(text.alias("text")), fallback="main.py")
    return rows.groupBy("id", "file", F.col("range.start.line").alias("line"), "label").agg(F.count(F.lit(1)).alias("n"))


#: Sources by ``o_orderkey mod 12`` with the rule that they break and its severity, if any; the last two are TypeScript.
_SOURCES = (
    ("x = eval(y{k})", "eval-on-untyped-input", "error"),
    ("\nrequests.get(u{k}, timeout=3, verify=False)", "requests-no-verify", "error"),
    ('db.execute("a" + x + "b{k}")', "py-sql-string-concat", "error"),
    ("try:\n    f{k}()\nexcept:\n    pass", "silent-except", "warning"),
    ('def f{k}(a):\n    raise NotImplementedError("x")', "raise-not-implemented", "warning"),
    ("requests.get(u{k}, verify=True)", None, None),
    ("eval(a{k}, b)", None, None),
    ('subprocess.run(f"ls {{x{k}}}", shell=True)', "shell-true-from-format", "error"),
    ("hashlib.md5(p{k}).hexdigest()", "weak-hash-for-credentials", "warning"),
    ('s = "eval(x{k})"', None, None),
    ("a.exec(`ls ${{x{k}}}`);", "js-exec-template", "error"),
    ("f(new Function(y{k}));", "js-eval", "error"),
)


@query(" UNION ALL ".join(f"SELECT 'o' || o_orderkey || '{'.ts' if i > 9 else '.py'}' AS file, 'slop.{rule}' AS rule, '{sev}' AS severity, {int(text.startswith(chr(10)))} AS line FROM orders WHERE o_orderkey % 12 = {i}" for i, (text, rule, sev) in enumerate(_SOURCES) if rule))
def q_rule_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a source file, and all tree patterns are looked for in each."""
    kind = (F.col("o_orderkey") % 12).cast("int")
    source = F.get(F.array(*(_filled(text, "o_orderkey") for text, _, _ in _SOURCES)), kind)
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 50_000)
    files = orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.when(kind > 9, ".ts").otherwise(".py")).alias("path"), F.when(kind > 9, "typescript").otherwise("python").alias("language"), source.alias("source"))
    return rules.structural_hits(udtf.nodes(files, rules.node_conditions())).select("file", "rule", "severity", F.col("range.start.line").alias("line"))


def _program_sql(hops: int) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT conv_id AS fn, turn AS place, role, string_split(text, ' ') AS w FROM conversations),
reads AS (SELECT DISTINCT fn, place, unnest(w[3:]) AS name FROM w), writes AS (SELECT DISTINCT fn, place, unnest(w[1:2]) AS name FROM w),
size AS (SELECT greatest(max(fn), 0) + 1 AS n FROM w), calls AS (SELECT fn, place, (fn + 1) % n AS callee, w FROM w, size WHERE role = 'assistant'),
args AS (SELECT DISTINCT fn, place, callee, pos, name FROM (SELECT fn, place, callee, unnest([0, 1]) AS pos, unnest([w[3], w[4]]) AS name FROM calls) WHERE name IS NOT NULL),
params AS (SELECT fn, pos, name FROM (SELECT fn, unnest([0, 1]) AS pos, unnest([w[3], w[4]]) AS name FROM w WHERE place = 0) WHERE name IS NOT NULL),
returns AS (SELECT fn, max(place) AS place FROM w GROUP BY fn),
needs AS (SELECT fn, place, -1 AS pos, name FROM reads UNION ALL SELECT fn, place, pos, name FROM args),
edges AS (SELECT n.fn, n.place, n.pos, x.fn AS fn2, x.place AS place2, -1 AS pos2 FROM needs n JOIN writes x ON x.fn = n.fn AND x.name = n.name AND x.place < n.place
  UNION SELECT n.fn, n.place, n.pos, a.fn, a.place, a.pos FROM needs n JOIN params p ON p.fn = n.fn AND p.name = n.name JOIN args a ON a.callee = n.fn AND a.pos = p.pos
  UNION SELECT c.fn, c.place, -1, r.fn, r.place, -1 FROM calls c JOIN returns r ON r.fn = c.callee),
walk(q, fn, place, pos, hop) AS (SELECT fn, fn, place, -1, 0 FROM returns UNION SELECT q, fn2, place2, pos2, hop + 1 FROM walk JOIN edges USING (fn, place, pos) WHERE hop < {hops})
SELECT q, fn, place, min(hop) AS hop FROM walk GROUP BY q, fn, place
"""


@query(_program_sql(4))
def q_slice_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as functions that call the next one: every function's result, sliced across them."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("fn"), F.col("turn").alias("at"), "role", F.split("text", " ").alias("w"))
    names = lambda words: turns.select("fn", "at", F.explode(words).alias("name")).distinct()
    n = turns.agg(F.greatest(F.max("fn"), F.lit(0)) + 1).scalar()
    calls = turns.filter("role = 'assistant'").select("fn", "at", ((F.col("fn") + 1) % n).alias("callee"), "w")
    pair = F.posexplode(F.array(F.get("w", 2), F.get("w", 3))).alias("pos", "name")
    arguments = calls.select("fn", "at", "callee", pair).filter("name IS NOT NULL")
    params = turns.filter("at = 0").select("fn", pair).filter("name IS NOT NULL")
    returns = turns.groupBy("fn").agg(F.max("at").alias("at"))
    origins = returns.select(F.col("fn").alias("q"), "fn", "at")
    rest = F.slice("w", F.lit(3), F.greatest(F.size("w") - 2, F.lit(0)))
    return crossing.backward(origins, names(rest), names(F.slice("w", 1, 2)), params, calls.drop("w"), arguments, returns, 4).withColumnRenamed("at", "place")


@query("""
SELECT event_id, CASE WHEN hour(ts) % 3 = 0 THEN 1 WHEN (hour(ts) // 6 + user_id) % 2 = 1 THEN 6 ELSE 24 END AS hours FROM events
""")
def q_innermost_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, some of their quarters and some hours as nested spans of each user, and events as points in them."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.hour("ts").alias("h"), F.datediff("ts", F.lit("2000-01-01")).cast("long").alias("d"))
    slot = lambda size: ((F.col("d") * 24 + F.floor(F.col("h") / size) * size) * 10).alias("lo")
    spans = [events.filter(keep).select("user_id", slot(size), F.lit(size).alias("hours")).distinct() for size, keep in ((24, "true"), (6, "(h div 6 + user_id) % 2 = 1"), (1, "h % 3 = 0"))]
    spans = diagnostics.union(spans).select("user_id", "lo", (F.col("lo") + F.col("hours") * 10 - 1).alias("hi"), "hours")
    points = events.select("event_id", "user_id", ((F.col("d") * 24 + F.col("h")) * 10 + 5).alias("at"))
    return intervals.innermost_nested(points, spans, ["user_id"], "at", "lo", "hi", "hours").select("event_id", "hours")


@query("""
WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'diagnosticsUpdated' WHEN 'view' THEN 'healthUpdated' WHEN 'error' THEN 'capabilityDegraded' WHEN 'signup' THEN 'capabilityRestored' ELSE 'notesUpdated' END AS type,
  'u' || user_id AS file, 'tool' || user_id % 7 AS capability, props FROM events),
k AS (SELECT *, CASE WHEN type LIKE 'capability%' THEN 'capability' ELSE type END AS slot, CASE WHEN type = 'diagnosticsUpdated' THEN file WHEN type LIKE 'capability%' THEN capability ELSE '' END AS key FROM e)
SELECT slot, key, arg_max(type, event_id) AS type, arg_max(props, event_id) AS payload, max(event_id) AS seq FROM k GROUP BY slot, key
""")
def q_client_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a daemon's five lasting kinds, folded to what a client shows."""
    kind = F.col("event_type")
    type_ = F.when(kind == "click", "diagnosticsUpdated").when(kind == "view", "healthUpdated").when(kind == "error", "capabilityDegraded").when(kind == "signup", "capabilityRestored").otherwise("notesUpdated")
    user = F.col("user_id").cast("string")
    tool = F.concat(F.lit("tool"), (F.col("user_id") % 7).cast("string"))
    return changes.client_state(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), type_.alias("type"), F.concat(F.lit("u"), user).alias("file"), tool.alias("capability"), F.col("props").alias("payload")))


@query("""
WITH d AS (SELECT 'o' || o_custkey AS file, 'i' || o_orderkey AS id, o_orderstatus AS code, o_orderpriority AS message, o_orderkey FROM orders),
old AS (SELECT file, id, code, message FROM d WHERE o_orderkey % 10 <> 3), new AS (SELECT file, id, CASE WHEN o_orderkey % 10 = 5 THEN 'X' ELSE code END, message FROM d WHERE o_orderkey % 10 <> 7)
SELECT DISTINCT file, 'diagnosticsUpdated' AS type FROM ((SELECT * FROM old EXCEPT ALL SELECT * FROM new) UNION ALL (SELECT * FROM new EXCEPT ALL SELECT * FROM old))
""")
def q_events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as diagnostics of their customer's file, in two versions: which files' events follow."""
    k = F.col("o_orderkey") % 10
    d = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("file"), F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("message"), F.lit("error").alias("severity"))
    return changes.events_of(d.filter("k <> 3"), d.filter("k <> 7").withColumn("code", F.when(F.col("k") == 5, "X").otherwise(F.col("code"))))


# --- diagnostics ----------------------------------------------------------------------------------------------------

_EVENT_DIAGNOSTICS = """d AS (SELECT event_id, 'u' || user_id || '.py' AS file, (event_id % 40)::INT AS line, CASE event_type WHEN 'error' THEN 'hallucination' WHEN 'purchase' THEN 'crossfile' WHEN 'signup' THEN 'semgrep' ELSE 'pyright' END AS source,
  CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' WHEN 3 THEN 'info' ELSE 'hint' END AS severity FROM events)"""


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as diagnostics of their user's file."""
    kind, nth = F.col("event_type"), F.col("event_id") % 5
    source = F.when(kind == "error", "hallucination").when(kind == "purchase", "crossfile").when(kind == "signup", "semgrep").otherwise("pyright")
    severity = F.when(nth == 0, "critical").when(nth == 1, "error").when(nth == 2, "warning").when(nth == 3, "info").otherwise("hint")
    point = F.struct((F.col("event_id") % 40).cast("int").alias("line"), F.lit(0).alias("col"))
    file = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".py"))
    code, message = F.concat(F.lit("c"), nth.cast("string")), F.concat(F.lit("event "), F.repeat(F.col("event_id").cast("string"), 30))
    return table(spark, sf_dir, "events").select("event_id", file.alias("file"), F.struct(point.alias("start"), point.alias("end")).alias("range"), source.alias("source"), severity.alias("severity"), code.alias("code"), message.alias("message"), F.col("event_id").alias("ord"))


@query(f"WITH {_EVENT_DIAGNOSTICS} SELECT file, count(*) AS diagnostics, count(*) FILTER (severity IN ('error', 'critical')) AS errors, count(*) FILTER (source = 'hallucination') AS hallucinated FROM d GROUP BY 1")
def q_diag_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.per_file(_diagnostics(spark, sf_dir))


@query(f"""
WITH {_EVENT_DIAGNOSTICS}, r AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 WHEN 'info' THEN 3 ELSE 4 END AS rank, CASE WHEN source IN ('hallucination', 'crossfile') THEN 0 ELSE 1 END AS ai FROM d)
SELECT event_id, severity, source, file, line, row_number() OVER (ORDER BY rank, ai, file, line, source, event_id) AS place FROM r
""")
def q_diag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every diagnostic's place in the client's list."""
    return ordered.numbered(_diagnostics(spark, sf_dir), diagnostics.order()).select("event_id", "severity", "source", "file", F.col("range.start.line").alias("line"), "place")


@query(f"""
WITH {_EVENT_DIAGNOSTICS} SELECT severity, count(*) AS n, array_to_string(list(event_id ORDER BY CASE WHEN source IN ('hallucination', 'crossfile') THEN 0 ELSE 1 END, file, line, source, event_id)[1:5], ',') AS first FROM d GROUP BY 1
""")
def q_diag_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each severity with its first five diagnostics."""
    out = diagnostics.by_severity(_diagnostics(spark, sf_dir), 5)
    return out.select("severity", "n", F.array_join(F.transform("first", lambda d: d["ord"].cast("string")), ",").alias("first"))


@query(f"WITH {_EVENT_DIAGNOSTICS} SELECT file, line, 'c' || (event_id % 5) AS code, severity, substr('event ' || repeat(event_id::VARCHAR, 30), 1, 80) AS message_prefix FROM d WHERE source IN ('hallucination', 'crossfile')")
def q_snapshot_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.snapshot(_diagnostics(spark, sf_dir))


@query("SELECT c_name AS path, CASE WHEN x < 0.3 THEN 'green' WHEN x < 0.6 THEN 'yellow' ELSE 'red' END AS bucket, round(x * 100)::INT AS composite_hundredths FROM (SELECT c_name, (c_custkey % 97) / 96.0::DOUBLE AS x FROM customer)")
def q_snapshot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_custkey") % 97 / 96.0
    return health.snapshot(table(spark, sf_dir, "customer").select(F.col("c_name").alias("file"), x.alias("composite"), health.bucket(x).alias("bucket")))


@query("SELECT user_id, bool_or(event_type = 'error') AS degraded FROM events GROUP BY 1")
def q_any_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as workspaces, event types as capabilities, which errors take away."""
    caps = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("capability"), (F.col("event_type") != "error").alias("available"))
    return health.degraded(caps, ["user_id"])


# --- notes ------------------------------------------------------------------------------------------------------------

#: Events as an operation log: a resolve takes the note of its user away, and the one clear all that came before.
_LOG = """log AS (SELECT event_id AS seq, CASE WHEN event_id = (SELECT max(event_id) // 3 FROM events) THEN 'clear' WHEN event_type = 'error' THEN 'resolve' ELSE 'post' END AS op, 'n' || user_id AS id,
  CASE event_type WHEN 'purchase' THEN 'concern' WHEN 'click' THEN 'question' WHEN 'view' THEN 'intent' ELSE 'observation' END AS kind FROM events),
live AS (SELECT p.id, max(p.seq) AS seq, arg_max(p.kind, p.seq) AS kind, min(p.seq) AS first_seq FROM log p WHERE op = 'post' AND seq > (SELECT seq FROM log WHERE op = 'clear')
  AND NOT EXISTS (SELECT 1 FROM log r WHERE r.op = 'resolve' AND r.id = p.id AND r.seq > p.seq) GROUP BY 1)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    third = events.agg(F.floor(F.max("event_id") / 3).alias("m")).scalar()
    op = F.when(F.col("event_id") == third, "clear").when(F.col("event_type") == "error", "resolve").otherwise("post")
    kind = F.when(F.col("event_type") == "purchase", "concern").when(F.col("event_type") == "click", "question").when(F.col("event_type") == "view", "intent").otherwise("observation")
    none = {f: F.lit("t") for f in ("title", "body", "symbol", "severity", "author")}
    point = F.struct(F.lit(0).alias("line"), F.lit(0).alias("col"))
    file = F.concat(F.lit("f"), (F.col("user_id") % 10).cast("string"))
    return events.select(F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.struct(file.alias("file"), F.struct(point.alias("start"), point.alias("end")).alias("range")).alias("location")).withColumns(none)


@query(f"WITH {_LOG} SELECT id, kind, first_seq FROM live")
def q_notes_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.live(_log(spark, sf_dir)).select("id", "kind", "first_seq")


@query(f"WITH {_LOG} SELECT count(*) AS unresolved FROM live")
def q_notes_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.badge(notes.live(_log(spark, sf_dir)))


@query(f"""
WITH {_LOG} SELECT file, id, kind FROM (SELECT 'f' || (substr(id, 2)::BIGINT % 10) AS file, * FROM live) QUALIFY row_number() OVER (PARTITION BY file ORDER BY CASE kind WHEN 'concern' THEN 3 WHEN 'question' THEN 2 WHEN 'intent' THEN 1 ELSE 0 END DESC, first_seq) = 1
""")
def q_notes_spotlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.spotlights(notes.live(_log(spark, sf_dir)))


@query(f"""
WITH {_LOG}, r AS (SELECT r.seq, r.id, max(p.seq) AS last FROM log r LEFT JOIN log p ON p.id = r.id AND p.op <> 'clear' AND p.seq < r.seq WHERE r.op = 'resolve' GROUP BY 1, 2)
SELECT r.seq, r.id, coalesce(p.op = 'post', false) AND NOT EXISTS (SELECT 1 FROM log c WHERE c.op = 'clear' AND c.seq > r.last AND c.seq < r.seq) AS existed FROM r LEFT JOIN log p ON p.seq = r.last
""")
def q_notes_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.resolved(_log(spark, sf_dir))


@query("SELECT event_id, 'n-' || lower(to_hex(epoch_us(ts) * 1000)) AS id FROM events")
def q_note_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", notes.note_id(F.unix_micros(F.col("ts").cast("timestamp"))).alias("id"))


# --- facts, slices, layout and parsing -----------------------------------------------------------------------------


@query("""
SELECT o_orderkey AS symbol, 'f-imp-' || (c_custkey % 3 + 2) AS fact_id, 'import' AS kind, 'imports seg' || c_mktsegment AS content, (c_custkey % 3 + 3 + n)::BIGINT AS ord FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey, 'f-imp-0', 'import', 'imports os', (1 + n)::BIGINT FROM orders JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""")
def q_facts_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as functions in the file of their customer, which imports two modules."""
    callees = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("callees"))
    file = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    units = table(spark, sf_dir, "orders").join(callees, "o_orderkey").select(F.col("o_orderkey").alias("symbol_id"), F.lit("f").alias("name"), F.lit(1).alias("loc"), file("o_custkey").alias("file"), "callees")
    customer = table(spark, sf_dir, "customer")
    imports = customer.select(file("c_custkey").alias("file"), F.concat(F.lit("seg"), "c_mktsegment").alias("module"), (F.col("c_custkey") % 3 + 2).cast("int").alias("ord"))
    imports = imports.unionByName(customer.select(file("c_custkey").alias("file"), F.lit("os").alias("module"), F.lit(0).alias("ord")))
    return gate.facts(units, imports).filter("kind = 'import'").withColumn("ord", F.col("ord").cast("long"))


@query("SELECT l_orderkey, array_to_string(list(DISTINCT l_partkey ORDER BY l_partkey)[1:3], ',') AS first, greatest(count(DISTINCT l_partkey) - 3, 0) AS more FROM lineitem GROUP BY 1")
def q_facts_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("facts"))
    out = facts.select("l_orderkey", gate.shown(F.col("facts"), 3).alias("s"))
    return out.select("l_orderkey", F.array_join(F.col("s.first").cast("array<string>"), ",").alias("first"), F.col("s.more").cast("long").alias("more"))


@query(f"""
WITH taken AS ({_slice_oracle(True)}) SELECT conv_id, taken AS lines, len(string_split(taken, ',')) AS n_nodes, len(string_split(taken, ',')) - 1 AS n_edges, truncated FROM taken
""")
def q_slice_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices with nodes and edges from each conversation's last turn; a turn's range is its line."""

    def placed(s: Column, i: Column) -> Column:
        point = F.struct(i.cast("int").alias("line"), F.lit(0).alias("col"))
        return F.struct(F.struct(point.alias("start"), point.alias("end")).alias("range"), F.lit("turn").alias("label"), s["writes"].alias("writes"), s["reads"].alias("reads"))

    talks = _talks(spark, sf_dir).withColumn("statements", F.transform("statements", placed))
    last = slicing.origin_index(F.col("statements"), F.size("statements") - 1, F.lit(0))
    out = slicing.slices(talks, last)
    lines = F.array_join(F.transform("nodes", lambda n: n["range"]["start"]["line"].cast("string")), ",")
    return out.select("conv_id", lines.alias("lines"), F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"), "truncated")


@query("""
WITH a AS (SELECT n_regionkey, n_name, greatest(coalesce(n, 0), 1) AS area FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) ON c_nationkey = n_nationkey)
SELECT n_regionkey, n_name AS label, area::DOUBLE AS area, round(area / sum(area) OVER (PARTITION BY n_regionkey) * 600000, 3) AS tile FROM a
""")
def q_treemap_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile's size is its share of the box."""
    return QUERIES["q_treemap"](spark, sf_dir).select("n_regionkey", "label", "area", F.round(F.col("w") * F.col("h"), 3).alias("tile"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN p_name ELSE '…' || right(p_name, 7) END AS label, greatest(p_size, 1) AS area FROM part")
def q_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("file"), F.col("p_size").alias("loc"), F.lit("green").alias("bucket"), F.lit(0.0).alias("composite"))
    leaves = layout.file_leaves(part.withColumn("file", F.concat("p_partkey", F.lit("|"), "file")))
    return leaves.select(F.split_part("label", F.lit("|"), F.lit(1)).cast("long").alias("p_partkey"), layout.shortened(F.split_part("label", F.lit("|"), F.lit(2)), 8).alias("label"), "area")


@query("SELECT CASE WHEN p_brand LIKE '%1%' THEN '@' || p_type || '/' || p_partkey || '/x' ELSE p_type || '/' || p_partkey END AS module, CASE WHEN p_brand LIKE '%1%' THEN '@' || p_type || '/' || p_partkey ELSE p_type END AS package FROM part")
def q_js_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    module = F.when(F.col("p_brand").contains("1"), F.concat(F.lit("@"), "p_type", F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/x"))).otherwise(F.concat_ws("/", "p_type", F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select(module.alias("module"), keys.js_package(module).alias("package"))


#: The modules of ``q_units`` and ``q_complexity`` follow from the number of sentences.
_COUNTED = f"(SELECT doc_id, len({SENTENCES_SQL}) AS k FROM documents)"
ORACLES["q_complexity"] = f"SELECT 'm/' || doc_id || '.py' AS path, 'act_' || doc_id AS name, (3 * ((k + 1) // 2))::INT AS cc FROM {_COUNTED}"


@query(f"SELECT 'm/' || doc_id || '.py' AS path, 'act_' || doc_id AS name, (1 + k + (k + 1) // 2)::INT AS loc, CASE WHEN k > 0 THEN 'say' ELSE '' END AS callees FROM {_COUNTED}")
def q_unit_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with their callees as one text."""
    return QUERIES["q_units"](spark, sf_dir).withColumn("callees", F.array_join("callees", ","))

