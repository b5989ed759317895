"""The rule pack: rules as a table, those that are plain patterns as column expressions, and those that are tree patterns as twigs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import twigs
from corvane.operators.twigs import Twig


@dataclass(frozen=True)
class Rule:
    """A rule with its languages and severity; ``pattern`` is null for rules of ``TWIGS``."""

    id: str
    languages: tuple[str, ...]
    severity: str
    message: str
    cwe: str | None
    pattern: str | None = None


_PY, _JS = ("python",), ("typescript", "tsx", "javascript")

#: Identifiers, languages, severities, weaknesses and patterns.
RULES = (
    Rule("slop.eval-on-untyped-input", _PY, "error", "eval or exec of an expression: parse the input instead", "CWE-94"),
    Rule("slop.js-eval", _JS, "error", "eval or Function of an expression: parse the input instead", "CWE-94"),
    Rule("slop.shell-true-from-format", _PY, "error", "a shell command made from an interpolated string", "CWE-78"),
    Rule("slop.js-exec-template", _JS, "error", "exec of a template string: pass the arguments as a list", "CWE-78"),
    Rule("slop.py-sql-string-concat", _PY, "error", "SQL made from pieces of strings: use parameters", "CWE-89"),
    Rule("slop.js-sql-string-concat", _JS, "error", "SQL made from pieces of strings: use parameters", "CWE-89"),
    Rule("slop.hardcoded-secret", _PY + _JS, "error", "a literal credential: keep it outside the source", "CWE-798", r"""(?i)(api[_-]?key|secret|token|password|passwd)\s*[:=]\s*['"][^'"\s]{16,}['"]"""),
    Rule("slop.silent-except", _PY, "warning", "a bare except that passes: name the exception or log it", "CWE-703"),
    Rule("slop.broad-except-pass", _PY, "warning", "except Exception that passes: log it or raise it again", "CWE-703"),
    Rule("slop.requests-no-verify", _PY, "error", "a request that doesn't verify certificates", "CWE-295"),
    Rule("slop.weak-hash-for-credentials", _PY, "warning", "md5 or sha1: use a password hash", "CWE-327"),
    Rule("slop.default-admin-password", _PY + _JS, "error", "a well-known default password", "CWE-259", r"""(?i)(password|passwd|pass)\s*[:=]\s*['"](admin|password|changeme|letmein|123456)['"]"""),
    Rule("slop.pretend-implemented", _PY + _JS, "warning", "declared finished beside an empty body", None, r"(?i)(fully implemented|production.ready|ready for production|complete solution).{0,80}\n\s*(pass|return\s*(None|null|undefined)?\s*$|TODO)"),
    Rule("slop.raise-not-implemented", _PY, "warning", "a function that only raises NotImplementedError", None),
    Rule("slop.open-user-path", _PY, "warning", "open of a path that a request names", "CWE-22"),
)




def _arg(*children: Twig, ord: int | None = None, word: str | None = None) -> Twig:  # noqa: A002
    return Twig("arg", word, ord=ord, children=children)


def _call(word: str, *args: Twig, n: int | None = None) -> Twig:
    return Twig("call", word, n=n, children=args)


def _stmt(word: str, *body: Twig, text: str | None = None, n: int | None = None) -> Twig:
    return Twig("stmt", word, text, n=n, children=body)


_INTERPOLATED = _arg(Twig("fstr"), ord=0)
_SUM = _arg(Twig("plus", children=(Twig("str", ord=0), Twig("str", ord=-1))), ord=0)

#: Which calls and statements the structural rules mean, by rule, for each of its languages.
TWIGS = {
    "slop.eval-on-untyped-input": (_call("eval|exec", n=1),),
    "slop.js-eval": (_call("eval|Function|new Function", n=1),),
    "slop.shell-true-from-format": (_call(r"subprocess\.(run|call|Popen)", _INTERPOLATED, _arg(Twig("expr", text="True"), word="shell")), _call(r"os\.system", _INTERPOLATED)),
    "slop.js-exec-template": (_call(r"(.*\.)?(exec|execSync)", _INTERPOLATED, n=1),),
    "slop.py-sql-string-concat": (_call(r".*\.(execute|query)", _SUM, n=1), _call(r".*\.(execute|query)", _INTERPOLATED, n=1)),
    "slop.js-sql-string-concat": (_call(r".*\.(execute|query)", _SUM, n=1), _call(r".*\.(execute|query)", _INTERPOLATED, n=1)),
    "slop.silent-except": (_stmt("except", _stmt("pass"), text="", n=1),),
    "slop.broad-except-pass": (_stmt("except", _stmt("pass"), text="Exception", n=1),),
    "slop.requests-no-verify": (_call(r"requests\.(get|post|put|delete|request)", _arg(Twig("expr", text="False"), word="verify")),),
    "slop.weak-hash-for-credentials": (_call(r"(?s)hashlib\.(md5|sha1)\(.*\)\.hexdigest", n=0),),
    "slop.raise-not-implemented": (_stmt("def", _stmt("raise", text=r"(?s)NotImplementedError\(.*\)"), n=1),),
    "slop.open-user-path": (_call("open", _arg(Twig("expr", text=r"(?s)request\.(args|form|json)\[.*"), ord=0)), _call("open", _arg(Twig("fstr", text=r"(?s).*\{\s*request\.args\[.*"), ord=0))),
}


def _twigs(rules: tuple[Rule, ...]) -> dict[tuple[str, str], tuple[Twig, ...]]:
    return {(r.id, lang): TWIGS[r.id] for r in rules if r.pattern is None for lang in r.languages}


def twig_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The tree patterns of the rules, a row for each of their nodes; as small as the pack."""
    return twigs.patterns(spark, _twigs(rules))


def node_conditions(rules: tuple[Rule, ...] = RULES) -> dict[str, list[tuple[str, str | None, int | None]]]:
    """What ``udtf.nodes`` may cut nodes down to where only the rules look at them."""
    return twigs.conditions(_twigs(rules))


def structural_hits(nodes: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(file, rule, severity, message, range)``: ``nodes`` as front ends give them, with the tree patterns of their language."""
    spark = nodes.sparkSession
    pack = table(spark, rules).select("rule", "severity", "message").distinct()
    found = twigs.matches(nodes, twig_table(spark, rules), "file")
    return found.join(F.broadcast(pack), "rule").select("file", "rule", "severity", "message", "range")


def table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(rule, language, severity, message, cwe, pattern)``: a row for each rule and language; as small as the pack."""
    rows = [(r.id, lang, r.severity, r.message, r.cwe, r.pattern) for r in rules for lang in r.languages]
    return spark.createDataFrame(rows, "rule string, language string, severity string, message string, cwe string, pattern string")


def matches(texts: DataFrame, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each text and pattern rule that occurs in it: the text's columns, ``rule`` and ``severity``.

    Patterns are literals of one projection, so each is compiled once and texts are scanned where they lie.
    """
    hits = [F.when(F.regexp_like(F.col(text), F.lit(r.pattern)), F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules if r.pattern]
    found = texts.withColumn("_hits", F.filter(F.array(*hits), lambda h: h.isNotNull()))
    return found.filter(F.size("_hits") > 0).select(*texts.columns, F.explode("_hits").alias("_hit")).select(*texts.columns, "_hit.rule", "_hit.severity")


def hits_by_file(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``files(path, language, source)`` → every occurrence of the language's pattern rules with its line (from 0)."""

    def lines(text: Column) -> Column:
        return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))

    def occurrences(r: Rule) -> Column:
        """Lines on which the matches of the rule's pattern begin: the text is cut at them once, and newlines are counted along the pieces."""
        hits = F.regexp_extract_all("source", F.lit(f"({r.pattern})"), 1)
        steps = F.zip_with(F.split("source", r.pattern), hits, lambda piece, hit: F.struct(lines(piece).alias("before"), lines(hit).alias("inside"), hit.isNotNull().alias("hit")))
        start = F.struct(F.lit(0).alias("line"), F.array().cast("array<int>").alias("out"))
        found = F.aggregate(steps, start, lambda a, s: F.struct((a["line"] + s["before"] + F.coalesce(s["inside"], F.lit(0))).alias("line"), F.when(s["hit"], F.array_append(a["out"], a["line"] + s["before"])).otherwise(a["out"]).alias("out")))["out"]
        struct = lambda line: F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"), F.lit(r.cwe).cast("string").alias("cwe"), line.alias("line"))
        return F.when(F.col("language").isin(*r.languages), F.transform(found, struct)).otherwise(F.array())

    each = [occurrences(r) for r in rules if r.pattern]
    rows = files.select("path", F.explode(F.concat(*each)).alias("h"))
    return rows.select(F.col("path").alias("file"), "h.*")
