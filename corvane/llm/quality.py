"""Quality rules whose thresholds follow the data.

One pass measures each text.  Every measure is a rate; for each language and source its distribution
is kept as a mergeable quantile sketch: counts in logarithmic bins, so that any quantile is known to
``ACCURACY`` (relative), two sketches merge by adding counts, and partial sketches are added before
the shuffle.  A text tells its rate only to the resolution of its length, so its count has ``HALF`` added in the sketch: of texts without any
occurrence the longer ones say more, and no quantile is zero.  The fence of a measure is a far quantile of the group's own sketch: the upper quartile plus ``REACH`` times
its distance from the median, or, where fewer than a quarter of the texts have any occurrence, the upper decile plus ``REACH`` times its distance.  Nothing else
sets it.  Fences are drawn towards those of the language, and these towards those of everything, by a geometric mean with the weight of ``GROUP`` texts
(low ends, which may be negative, by an arithmetic one), so that small groups follow larger ones.  Thresholds are then joined back to the documents.

A text breaks a fence with the part of its rate that chance doesn't explain: a count ``k`` is taken down by
``ERRORS`` standard errors of the square root of a Poisson count, to ``max(0, sqrt(k) - ERRORS / 2) ** 2``.  So it breaks it if ``k`` is more than chance makes of
the fence's own rate over the text's length, however long that is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import kernel as K
from corvane.llm.scratch import Scratch

ACCURACY = 0.01
REACH = 8.0
#: Weight, in texts, of the fences of the language in those of a group, and of everything in those of a language.
GROUP = 200
ERRORS = 3.0
#: Added to a count in the sketch.
HALF = 0.5
#: Share of texts with an occurrence from which the upper quartile sets the fence.
SEEN = 0.25


@dataclass(frozen=True)
class Measure:
    """A rate, and whether it is a mean size, of which low values are rejected too, and not a count with its chance.

    ``clump`` units of the count come together at least, and count as one: words that repeat come as three words twice.
    """

    name: str
    expr: str
    low: bool = False
    clump: int = 1

    def count(self) -> str:
        return self.expr.split(" / ")[0] + (f" / {self.clump}" if self.clump > 1 else "")


MEASURES = (
    Measure("symbols", "n_symbols / word_chars"),
    Measure("bangs", "n_bangs / word_chars"),
    Measure("capitals", "n_capitals / word_chars"),
    Measure("dup_lines", "n_dup_lines / n_words"),
    Measure("repeats", "n_repeat_words / n_words", clump=6),
    Measure("word_length", "word_chars / n_words", True),
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_LINE = np.zeros(256, bool)
_NOT_LINE[10] = True
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capitals")


def _repeated(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values with their text: which occur in their text twice or more, and which of these come after the first."""
    key = K.mix64(h + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def measure(run: K.Run) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of the run."""
    w = K.words(run)
    filled = np.zeros(len(run.buf) + 1, np.int64)
    np.cumsum(~K.BLANK[run.buf], out=filled[1:])
    lines = K.words(run, _NOT_LINE)
    sums = w.prefix_sums(lower=False)
    real = filled[lines.end] > filled[lines.start]
    line_doc = lines.doc()[real]
    _, later = _repeated(lines.span_hash(sums, lines.start[real], lines.end[real]), line_doc)
    s, ptr = K.windows(w.span_hash(sums, w.start, w.end), w.ptr, 3)
    per = np.diff(ptr)
    doc = np.repeat(np.arange(len(run)), per)
    twice, _ = _repeated(s, doc)
    begin = (np.arange(len(s)) - np.repeat(ptr[:-1], per) + np.repeat(w.ptr[:-1], per))[twice]
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + 3, -1)
    n = len(run)
    return {
        "n_words": np.diff(w.ptr),
        "word_chars": K.sums_by_text(_FIRST_BYTE[run.buf] & ~K.BLANK[run.buf], run.off),
        "n_symbols": K.sums_by_text(_SYMBOL[run.buf], run.off),
        "n_dup_lines": np.bincount(line_doc[later], minlength=n),
        "n_repeat_words": K.sums_by_text(np.cumsum(cover[:-1]) > 0, w.ptr),
        "n_lines": np.bincount(line_doc, minlength=n),
        "n_bangs": K.sums_by_text(run.buf == 33, run.off),
        "n_capitals": K.sums_by_text((run.buf >= 65) & (run.buf <= 90), run.off),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes every column but the last (the text) through, and adds the counts."""
    for batch in batches:
        for run in K.runs(batch.column(batch.num_columns - 1)):
            found = measure(run)
            kept = [c.slice(run.first, len(run)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[k].astype(np.int64)) for k in COUNTS)], [*batch.schema.names[:-1], *COUNTS])


def measured(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of each row's text."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"{c} long" for c in COUNTS)])
    return rows.mapInArrow(_measured, fields)


def bin_of(value: Column) -> Column:
    """Logarithmic bin of a value; everything below 1e-6 shares the bin of zero."""
    step = math.log((1 + ACCURACY) / (1 - ACCURACY))
    return F.when(value < 1e-6, F.lit(-100_000)).otherwise(F.ceil(F.log(value) / step)).cast("int")


def value_of(bin_: Column) -> Column:
    """The middle value of a bin."""
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    return F.when(bin_ == -100_000, F.lit(0.0)).otherwise(F.pow(F.lit(gamma), bin_) * (2 / (gamma + 1)))


def _resolved(m: Measure) -> Column:
    """The rate as the sketch takes it, and whether there is any occurrence."""
    return F.col(m.name) if m.low else F.expr(f"try_divide({m.count()} + {HALF}, {m.expr.split(' / ')[1]})")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, bin by measure) counts: ``rows(lang, source, measure...)`` → ``(lang, source, measure, bin, n, seen)``; ``seen`` texts have an occurrence."""
    pairs = F.array(*(F.struct(F.lit(m.name).alias("measure"), bin_of(_resolved(m)).alias("bin"), (F.col(m.name) > 0).cast("long").alias("any")) for m in MEASURES))
    return rows.select("lang", "source", F.inline(pairs)).filter("bin IS NOT NULL").groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("any").alias("seen"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches of larger groups, by adding counts."""
    return sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def fences(sketch: DataFrame, *by: str) -> DataFrame:
    """A row for each group: its size, and ``measure_hi`` and ``measure_lo`` for each measure.  A window covers the bins of one sketch, some hundreds."""
    one = Window.partitionBy(*by, "measure")
    seen = sketch.withColumn("upto", F.sum("n").over(one.orderBy("bin"))).withColumn("total", F.sum("n").over(one))
    cut = [F.min(F.when(F.col("upto") >= F.col("total") * q, value_of(F.col("bin")))).alias(a) for a, q in QUANTILES.items()]
    quart = seen.groupBy(*by, "measure").agg(*cut, F.max("total").alias("size"), (F.sum("seen") / F.max("total")).alias("share"))
    far = lambda q: F.col(q) + (F.col(q) - F.col("q50")) * REACH
    high = F.when(F.col("share") >= SEEN, far("q75")).otherwise(far("q90"))
    out = []
    for m in MEASURES:
        here = F.col("measure") == m.name
        out.append(F.max(F.when(here, high)).alias(f"{m.name}_hi"))
        out.append(F.max(F.when(here, far("q25") if m.low else F.lit(-1.0))).alias(f"{m.name}_lo"))
    return quart.groupBy(*by).agg(F.max("size").alias("size"), *out)


QUANTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}
LIMITS = tuple(f"{m.name}_{end}" for m in MEASURES for end in ("hi", "lo"))


def _rated(counts: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and the rates."""
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return counts.withColumn("base_failed", failed).withColumns({m.name: F.expr(f"try_divide({m.expr.replace(' / ', ', ')})") for m in MEASURES})


def _certain(m: Measure) -> Column:
    """The rate of a text without what chance may have added to its count."""
    if m.low:
        return F.col(m.name)
    return F.expr(f"try_divide(pow(greatest(sqrt({m.count()}) - {ERRORS / 2}, 0), 2), {m.expr.split(' / ')[1]})")


def _drawn(own: str, size: str, towards: Column) -> Column:
    """A group's fence, drawn towards that of a larger group."""
    mean = lambda a, b: (a * F.col(size) + b * GROUP) / (F.col(size) + GROUP)
    return F.exp(mean(F.log(F.col(own)), F.log(towards))) if own.endswith("_hi") else mean(F.col(own), towards)


def _limits(rated: DataFrame, scratch: Scratch) -> DataFrame:
    """The fences of every language and source that has texts which pass the base rules."""
    own = scratch.table("sketches", sketches(rated.filter("NOT base_failed")))
    by_lang = merged(own, "lang")
    world = fences(merged(by_lang)).first()
    langs = fences(by_lang, "lang").select(F.col("lang").alias("lang2"), *(_drawn(c, "size", F.lit(world[c] if world else None)).alias(f"{c}2") for c in LIMITS))
    near = fences(own, "lang", "source").join(langs, F.col("lang").eqNullSafe(F.col("lang2")), "left")
    return scratch.table("limits", near.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(_drawn(c, "size", F.col(f"{c}2")).alias(c) for c in LIMITS)))


def _verdict(rated: DataFrame, limits: DataFrame) -> DataFrame:
    """Joins the fences and adds ``kept``."""
    within = F.lit(True)
    for m in MEASURES:
        low, high = F.col(f"{m.name}_lo") / (1 + ACCURACY), F.col(f"{m.name}_hi") / (1 - ACCURACY)  # the ends of the sketch's bins
        within = within & F.coalesce(_certain(m).between(low, high), F.lit(True))
    on = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    return rated.join(limits, on, "left").withColumn("kept", ~F.col("base_failed") & within)


def _rows(docs: DataFrame, keep: list[str], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Counts of each row, with the columns ``keep`` as ``_k0``, ``_k1`` and so on."""
    own = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in zip(own, keep, strict=True)), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return _rated(measured(rows, "text", [*own, "lang", "source"]))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, base rules and verdict for each row.

    Returns ``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines, n_bangs, n_capitals)``, one row for each input row; other columns are ignored.  ``base_failed``: fewer than 50 words, or more than
    half of the words in repeated 3-word windows.  ``kept``: not ``base_failed`` and every measure
    within the fence of its group.  A null or empty text has no words and fails.  A null language or
    source is a group of its own.  Sketches hold only texts that pass the base rules; if there are
    none, the base rules decide alone.  Repeated rows count and come back as often; an empty table
    gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    counts = scratch.table("counts", _rows(docs, [id_col], text_col, lang_col, source_col))
    out = _verdict(counts, _limits(counts, scratch))
    return out.select(F.col("_k0").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bangs", "n_capitals")


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The input's columns, of the rows that ``judged`` keeps.

    Texts are measured twice, for the sketches and beside their own row for the verdict, so that no text is
    shuffled or stored, and a repeated id decides nothing.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    names = docs.columns
    limits = _limits(_rows(docs, [], text_col, lang_col, source_col), scratch)
    out = _verdict(_rows(docs, names, text_col, lang_col, source_col), limits)
    return out.filter("kept").select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(names)))
