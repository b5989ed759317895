"""The language of a text: known words first, character n-grams for the others.

A word is a stretch of letters and marks in lower case.  For every language the model holds the relative frequency of each known word and
of each n-gram of ``1`` to ``LONGEST`` characters of its words, taken with a blank on either side.  A word that any language knows scores the
logarithm of its frequency in each language.  Another word falls back to the longest n-grams of which any language knows one, and scores the
mean of theirs.  What a language doesn't know costs it ``PENALTY`` decimal places more than the rarest it could have met.  A text takes the language
with the best mean over its words.

The fit uses a sample: at most ``TRAIN_DOCS`` documents of each language, by the hash of their text, of at most ``TRAIN_BYTES`` bytes each.  These are its
documented bounds; the model, which is broadcast, is bounded by them.  A word is known if ``KNOWN_DOCS`` documents of the sample have it, so that
n-grams learn from more words than those they stand in for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import kernel as K
from corvane.llm.scratch import Scratch, broadcast_if_small

TRAIN_DOCS = 1000
TRAIN_BYTES = 20_000
KNOWN_DOCS = 2
LONGEST = 5
PENALTY = 1.0
UNKNOWN = "und"
#: Groups into which the documents of each language are dealt before the sample is chosen from them.
DEALT = 64

_SPACE = np.zeros(256, bool)
_SPACE[0x20] = True


@dataclass
class Table:
    """Decimal logarithms of relative frequencies: a row for each key (sorted), a column for each language."""

    keys: np.ndarray
    logs: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each key, and whether it is known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys


@dataclass
class Model:
    """Languages in order of their share of the sample's words, then by name; the table of words, and those of n-grams of 1, 2... characters."""

    langs: list[str]
    words: Table
    grams: list[Table]


def letters(text: Column) -> Column:
    """Words in lower case with single blanks between them; other characters and null texts leave nothing.  Marks alone are no word."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}]+", " "))


def _sample(docs: DataFrame, scratch: Scratch, text_col: str, lang_col: str) -> DataFrame:
    """The documents with the smallest hashes of each language, chosen in two rounds so that no task sees all of a language.  Only hashes are shuffled."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter(f"lang IS NOT NULL AND octet_length(text) <= {TRAIN_BYTES}")
    keys = rows.select("lang", F.xxhash64("text").alias("h"))
    dealt = keys.withColumn("deal", F.pmod("h", F.lit(DEALT)))
    first = lambda by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("h"))
    dealt = dealt.dropDuplicates(["lang", "h"]).withColumn("k", first(["deal"])).filter(F.col("k") <= TRAIN_DOCS)
    chosen = scratch.table("chosen", dealt.withColumn("k", first([])).filter(F.col("k") <= TRAIN_DOCS).select("lang", "h"))
    return rows.withColumn("h", F.xxhash64("text")).join(broadcast_if_small(chosen, 200 * TRAIN_DOCS), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "h", letters(F.col("text")).alias("words"))


def _hashed(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each whole text."""
    out = np.zeros(len(texts), np.uint64)
    for run in K.runs(texts, 1 << 24):
        w = K.Words(run, run.off[:-1], run.off[1:], np.arange(len(run) + 1))
        out[run.first : run.first + len(run)] = w.hashes(lower=False)
    return out


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two blanks, and where each begins; a blank ends the whole."""
    whole = " ".join(texts.to_pylist())
    points = np.frombuffer(f" {whole} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = np.flatnonzero(points == 32)
    return points, blank


def gram_keys(points: np.ndarray, blank: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of ``size`` characters that lie between two neighbouring blanks (inclusive), and the word of each.  A blank alone is none."""
    m = len(points) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(m, np.uint64)
    for j in range(size):
        key = K.mix64(key * np.uint64(0x9E3779B97F4A7C15) + points[j : j + m] + np.uint64(1))
    begin = np.arange(m)
    word = np.searchsorted(blank, begin, "right") - 1
    within = (word < len(blank) - 1) & (begin + size - 1 <= blank[np.minimum(word + 1, len(blank) - 1)])
    if size == 1:
        within &= points[:m] != 32
    return key[within], word[within]


def _logs(counts: np.ndarray) -> np.ndarray:
    """Decimal logarithms of the counts' shares of their columns; where a count is zero, ``PENALTY`` below one of the largest total."""
    total = counts.sum(0)
    least = -np.log10(max(1, total.max(initial=0))) - PENALTY
    return np.where(counts > 0, np.log10(np.maximum(counts, 1) / np.maximum(total, 1)), least).astype(np.float32)


def fit(lang: list[str], word: pa.Array, n: np.ndarray, n_docs: np.ndarray) -> Model:
    """The model of a table (language, word, occurrences, documents), in any order."""
    share: dict[str, int] = {}
    for name, c in zip(lang, n.tolist(), strict=True):
        share[name] = share.get(name, 0) + c
    langs = sorted(share, key=lambda x: (-share[x], x))
    of = np.array([langs.index(x) for x in lang], np.int64)

    def table(keys: np.ndarray, col: np.ndarray, weight: np.ndarray) -> Table:
        own, back = np.unique(keys, return_inverse=True)
        counts = np.zeros((len(own), len(langs)), np.int64)
        np.add.at(counts, (back, col), weight)
        return Table(own, _logs(counts))

    known = n_docs >= KNOWN_DOCS
    words = table(_hashed(word)[known], of[known], n[known])
    grams = []
    points, blank = _points(word)
    for size in range(1, LONGEST + 1):
        key, w = gram_keys(points, blank, size) if len(word) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        grams.append(table(key, of[w], n[w]))
    return Model(langs, words, grams)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of a bounded sample of the rows with a language.  Copies of a text count once; without rows the model knows no language."""
    scratch = Scratch(docs.sparkSession, "langid")
    words = _sample(docs, scratch, text_col, lang_col).select("lang", "h", F.explode(F.split("words", " ")).alias("word")).filter("word != ''")
    by_doc = words.groupBy("lang", "word", "h").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.table("words", by_doc.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    return fit(counts.column("lang").to_pylist(), counts.column("word").cast(pa.string()).combine_chunks(), np.asarray(counts.column("n")), np.asarray(counts.column("docs")))


def word_logs(model: Model, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For distinct words: the logarithm in each language, and whether the word itself is known."""
    at, known = model.words.find(_hashed(words))
    out = np.zeros((len(words), len(model.langs)), np.float64)
    out[known] = model.words.logs[at[known]]
    left = np.flatnonzero(~known)
    for size in range(LONGEST, 0, -1):
        if not len(left):
            break
        table = model.grams[size - 1]
        points, blank = _points(words.take(pa.array(left)))
        key, word = gram_keys(points, blank, size)
        at, hit = table.find(key)
        n = np.bincount(word[hit], minlength=len(left))
        for k in range(len(model.langs)):
            total = np.bincount(word[hit], table.logs[at[hit], k].astype(np.float64), len(left))
            out[left, k] = np.where(n > 0, total / np.maximum(n, 1), 0.0)
        left = left[n == 0]
    return out, known


def judge(model: Model, run: K.Run) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
    """For texts of words with single blanks: language, score, words, known words."""
    w = K.words(run, _SPACE)
    n = np.diff(w.ptr)
    size = len(run)
    if not model.langs or not len(w.start):
        return [UNKNOWN] * size, np.zeros(size), n, np.zeros(size, np.int64)
    _, first, back = np.unique(w.hashes(lower=False), return_index=True, return_inverse=True)
    distinct = pa.array([run.buf[a:b].tobytes().decode() for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)], pa.string())
    logs, known = word_logs(model, distinct)
    doc = w.doc()
    mean = np.stack([np.bincount(doc, logs[back, k], size) for k in range(len(model.langs))], 1) / np.maximum(n, 1)[:, None]
    best = mean.argmax(1)  # the first of equals
    odds = np.exp((mean - mean.max(1, keepdims=True)) * np.sqrt(n)[:, None] * np.log(10))
    score = 1 / odds.sum(1)
    lang = [model.langs[b] if c else UNKNOWN for b, c in zip(best.tolist(), n.tolist(), strict=True)]
    return lang, np.where(n > 0, score, 0.0), n, np.bincount(doc, known[back], size).astype(np.int64)


def _predicted(shared):
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for run in K.runs(batch.column(batch.num_columns - 1)):
                lang, score, n, known = judge(model, run)
                kept = [c.slice(run.first, len(run)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n.astype(np.int64)), pa.array(known)], [*batch.schema.names[:-1], "lang_pred", "score", "n_words", "n_known"])

    return predicted


def predicted(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(keep..., lang_pred, score, n_words, n_known)`` for each row, whatever its columns are called.

    ``score`` is the best language's share among all, each weighed by its mean with the root of the number of words, so that it rises with
    the distance and the length.  A text that is null, empty or has no letter is ``und`` with 0, and so is all without a model.  A text that
    suits languages equally (in a script that none of them knows, say) takes the one with most words in the sample, then the first by name.
    Repeated rows come back as often; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col(f"`{text_col}`").cast("string")
    words = F.when(text.rlike(r"\p{L}"), letters(text)).otherwise("")
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), words.alias("_text"))
    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string", "score double", "n_words long", "n_known long"])
    return rows.mapInArrow(_predicted(shared), fields).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "n_words", "n_known")
