"""The entailment gate: which sentences of a text are supported by known facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: words that support nothing.
STOP_WORDS = tuple(
    """the and for with from this that its into over than then when which will would have has had not but are was were
    been being also such them they their there these those only each any some all one two function calls call imports
    import uses use use: it is in on to of as""".split()
)
NO_SUPPORT = "no supporting fact found for this claim"


def sentences(text: Column) -> Column:
    """Sentences, cut after ``.``, ``!`` or ``?`` before white space or the end; blank ones are left out."""
    cut = F.split(F.regexp_replace(text, r"([.!?])(?=\s)", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def _words(text: Column) -> Column:
    """Words of at least 3 bytes, ASCII-lower-cased.

    Whole texts are lower-cased, and those of ASCII by ``lower``, which goes over their bytes where ``translate`` makes a string of each character.
    """
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.filter(F.split(low, r"[^\p{IsAlphabetic}\p{N}_]+"), lambda t: F.octet_length(t) >= 3)


def tokens(text: Column) -> Column:
    """Distinct significant words: at least 3 bytes, ASCII-lower-cased, no stop word."""
    return F.array_except(_words(text), F.array(*map(F.lit, STOP_WORDS)))


def tokenised(cases: DataFrame, facts: str) -> DataFrame:
    """Adds to each fact of the array ``facts`` its tokens, so that they are made once for a table of facts that is joined to many texts."""
    return cases.withColumn(facts, F.transform(facts, lambda f: F.struct(f["id"].alias("id"), f["content"].alias("content"), tokens(f["content"]).alias("tokens"))))


def verdicts(cases: DataFrame, text: str, facts: str) -> DataFrame:
    """Adds ``verdicts``, an array with ``claim``, ``entailed`` and ``supporting_fact_ids`` of each sentence.  ``facts`` come from ``tokenised``; null means none.

    Sentences are judged within their row, so neither text nor facts are copied to each of them.  Facts have no stop words among their tokens,
    so a sentence's may stay.
    """
    cut = F.transform(sentences(F.col(text)), lambda s: F.struct(s.alias("claim"), _words(s).alias("t")))
    known = F.coalesce(F.col(facts), F.filter(facts, lambda f: F.lit(False)), F.array().cast("array<struct<id:string,content:string,tokens:array<string>>>"))
    support = lambda c: F.transform(F.filter(known, lambda f: F.arrays_overlap(f["tokens"], c["t"])), lambda f: f["id"].cast("string"))
    found = F.transform(cut, lambda c: F.struct(c["claim"].alias("claim"), support(c).alias("ids")))
    return cases.withColumn("verdicts", F.transform(found, lambda c: F.struct(c["claim"].alias("claim"), (F.size(c["ids"]) > 0).alias("entailed"), c["ids"].alias("supporting_fact_ids"))))


def gated(cases: DataFrame, text: str, facts: str) -> DataFrame:
    """A row for each sentence of ``text``: ``ord, claim, entailed, supporting_fact_ids, reason`` beside the case's columns.

    ``facts`` is an array of ``struct<id, content>``, small for each case, or one from ``tokenised``.  All supporting facts are listed, in order.
    """
    ready = "tokens" in cases.schema[facts].dataType.elementType.fieldNames()
    judged = verdicts(cases if ready else tokenised(cases, facts), text, facts)
    out = judged.select(*cases.columns, F.posexplode("verdicts").alias("ord", "_v")).select(*cases.columns, "ord", "_v.*")
    return out.withColumn("reason", F.when(~F.col("entailed"), NO_SUPPORT))


def confusion(truth: Column, predicted: Column) -> list[Column]:
    """Aggregates with "not entailed" as the positive class; precision and recall are 1 where nothing divides."""
    tp, fp = F.count_if(~truth & ~predicted), F.count_if(truth & ~predicted)
    fn, tn = F.count_if(~truth & predicted), F.count_if(truth & predicted)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, a + b), F.lit(1.0))
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp, fp).alias("precision"), ratio(tp, fn).alias("recall")]


def verified_ratio(claims: DataFrame, keys: list[str], floor: float = 0.7) -> DataFrame:
    """Share of entailed claims of each key, and whether it is below the floor."""
    out = claims.groupBy(*keys).agg(F.count(F.lit(1)).alias("claims"), (F.count_if("entailed") / F.count(F.lit(1))).alias("ratio"))
    return out.withColumn("low_confidence", F.col("ratio") < floor)


def facts(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """``(symbol, fact_id, kind, content, ord)``: signature, calls and the file's imports of each function."""
    sig = functions.select(F.col("symbol_id").alias("symbol"), F.lit("f-sig").alias("fact_id"), F.lit("signature").alias("kind"), F.format_string("function %s (%d LOC)", "name", "loc").alias("content"), F.lit(0).alias("ord"))
    calls = functions.select(F.col("symbol_id").alias("symbol"), F.posexplode("callees").alias("i", "c"))
    calls = calls.select("symbol", F.concat(F.lit("f-call-"), F.col("i").cast("string")).alias("fact_id"), F.lit("call").alias("kind"), F.concat(F.lit("calls "), "c").alias("content"), (F.col("i") + 1).alias("ord"))
    brought = functions.select("file", F.col("symbol_id").alias("symbol"), F.size("callees").alias("n")).join(imports.select("file", "module", F.col("ord").alias("i")), "file")
    brought = brought.select("symbol", F.concat(F.lit("f-imp-"), F.col("i").cast("string")).alias("fact_id"), F.lit("import").alias("kind"), F.concat(F.lit("imports "), "module").alias("content"), (F.col("i") + F.col("n") + 1).alias("ord"))
    return sig.unionByName(calls).unionByName(brought)


def rendered(facts_: DataFrame, note: str = "(rendered from facts alone)") -> DataFrame:
    """``(symbol, text)``: a header, a line for each fact in order, and a note."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda f: F.concat(F.lit("- "), f["content"]))
    out = facts_.groupBy("symbol").agg(listed.alias("_lines"))
    return out.select("symbol", F.array_join(F.concat(F.array(F.concat("symbol", F.lit(":"))), F.col("_lines"), F.array(F.lit(note))), "\n").alias("text"))


def shown(facts_: Column, limit: int = 8) -> Column:
    """The first facts of an array and how many more there are."""
    return F.struct(F.slice(facts_, 1, limit).alias("first"), F.greatest(F.size(facts_) - limit, F.lit(0)).alias("more"))
