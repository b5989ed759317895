"""Phrases that stand together more often than their parts would.

Each shard, some MB of one task's texts, gets a generalised suffix automaton of its pieces, bounded to the depth that is asked for.
An automaton's links form the tree of the reversed prefixes, so the bounded one is built level by level: a substring of ``L`` words is
a child of its suffix of ``L - 1`` words, by the word that comes before.  Every node knows how many ends its substring has (endpos) and one of
them; a node that has as many ends as its only child belongs to the child's state.  The nodes enumerate all substrings up to the depth with
their counts, and one shuffle adds the counts of all shards.

Substrings of a frequent phrase are frequent.  So words are counted first, then pairs of frequent words, by a hash of ``PAIR_BITS``, then all phrases whose
pairs are all frequent by it, and pieces are cut in between.  What is frequent travels as a bitmap of a fixed size (``FILTER_BITS``).  Hash and bitmap
let some rare pairs pass and never stop a frequent one: with very many pairs more is counted in vain, and the counts stay exact.  Words are numbered
by their bytes within a shard, and phrases meet by their text, so no count that is returned rests on a hash.

A phrase is subsumed by a longer one that is found as often.  Then one of the phrases with one word more is found as often too: those of which
it is the suffix (the automaton's link) or the prefix.  One equality join finds these.
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

DEPTH = 5
LEAST = 100
TOP = 2000
#: Bytes of text of a shard, beyond one text.
SHARD = 4 << 20
#: Bits of the bitmap of frequent words, and of that of frequent pairs (16 MB each).
FILTER_BITS = 1 << 27
PAIR_BITS = 40
#: Groups into which each language's phrases are dealt before their first ones meet.
DEALT = 64

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = _ENDS.copy()
_GAPS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices ``buf[start:end]`` as strings."""
    size = end - start
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    data = buf[np.repeat(start - off[:-1], size) + np.arange(off[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


@dataclass
class Pieces:
    """The words of a shard in order: ``buf[start:end]`` are the bytes of each, with one space after it.

    ``word`` numbers them by bytes and language, ``lang`` gives the language's number, ``joined`` says whether the next word follows in the same piece.
    """

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    lang: np.ndarray
    joined: np.ndarray


def pieces(run: K.Run, lang: np.ndarray, n_langs: int) -> Pieces:
    """Words of the texts of ``run``, each of which ends in a line end; ``lang`` is the number of each text's language."""
    w = K.words(run, _GAPS)
    size = w.end - w.start
    low = _LOWER[run.buf]
    low[w.end] = 32
    keep = ~_GAPS[run.buf]
    keep[w.end] = True  # the byte after a word stands for the space
    buf = low[keep]
    end = np.cumsum(size + 1) - 1
    start = end - size
    ends = np.flatnonzero(_ENDS[run.buf])
    joined = np.zeros(len(size), bool)
    joined[:-1] = np.diff(np.searchsorted(ends, w.start)) == 0
    of = lang[w.doc()]
    edges = np.append(start, len(buf)).astype(np.int32)
    number = np.asarray(pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(buf)]).dictionary_encode().indices).astype(np.int64)
    return Pieces(buf, start, end, number * n_langs + of, of, joined)


@dataclass
class Level:
    """Nodes of one depth: their endpos counts, one end each (the last word's place), and the node of one word less that each is linked to."""

    count: np.ndarray
    at: np.ndarray
    link: np.ndarray


def automaton(word: np.ndarray, joined: np.ndarray, depth: int) -> list[Level]:
    """The link tree of the generalised suffix automaton of all pieces, down to substrings of ``depth`` words."""
    levels = []
    _, at, node, count = np.unique(word, return_index=True, return_inverse=True, return_counts=True)
    levels.append(Level(count, at, np.zeros(len(at), np.int64)))
    one, width = node, len(count)
    end = np.arange(len(word))  # places where a substring of the level's depth ends
    for size in range(2, depth + 1):
        go = end[end >= size - 1]
        node = node[end >= size - 1]
        ok = joined[go - size + 1]
        go, node = go[ok], node[ok]
        key, first, node, count = np.unique(node * width + one[go - size + 1], return_index=True, return_inverse=True, return_counts=True)
        levels.append(Level(count, go[first], key // max(1, width)))
        end = go
    return levels


def _marks(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = (key & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) > 0


def _whole(texts: pa.Array) -> np.ndarray:
    """A hash of each text."""
    out = np.zeros(len(texts), np.uint64)
    for run in K.runs(texts):
        w = K.Words(run, run.off[:-1], run.off[1:], np.arange(len(run) + 1))
        out[run.first : run.first + len(run)] = w.hashes(lower=False)
    return out


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return K.mix64(first * np.uint64(0x9E3779B97F4A7C15) + second) & np.uint64((1 << PAIR_BITS) - 1)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, K.Run]]:
    """The batches (lang, text) in shards of about ``most`` bytes: languages and texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= most:
            yield from _shard(held, most)
            held, size = [], 0
    yield from _shard(held, most)


def _shard(held: list[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, K.Run]]:
    if not held:
        return
    rows = pa.Table.from_batches(held)
    lang, text = rows.column(0).cast(pa.large_string()).combine_chunks(), rows.column(1).cast(pa.large_string()).combine_chunks()
    for run in K.runs(text, most):
        yield lang.slice(run.first, len(run)), run


def _counted(order: int, shared, most: int):
    """Counts of words (order 1), of hashes of pairs of marked words (2), or of phrases whose pairs are marked (3)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else np.frombuffer(shared.value, np.uint8)
        for lang, run in _shards(batches, most):
            coded = lang.dictionary_encode()
            names, of = coded.dictionary, np.asarray(coded.indices)
            p = pieces(run, of, len(names))
            joined = p.joined
            if order > 1 and len(p.start):
                own, first, back = np.unique(p.word, return_index=True, return_inverse=True)
                key = K.mix64(_whole(_gather(p.buf, p.start[first], p.end[first])) ^ _whole(names)[p.lang[first]])
                joined = joined.copy()
                if order == 2:
                    often = _marks(bits, key)[back]
                    joined[:-1] &= often[:-1] & often[1:]
                else:
                    go = np.flatnonzero(joined)
                    joined[go] = _marks(bits, _pair(key[back[go]], key[back[go + 1]]))
                inner = joined.copy()
                inner[1:] |= joined[:-1]
                keep = np.flatnonzero(inner)  # words outside any phrase leave; pieces stay apart
                back = back[keep]
                p, joined = Pieces(p.buf, p.start[keep], p.end[keep], p.word[keep], p.lang[keep], None), joined[keep]
            levels = automaton(p.word, joined, {1: 1, 2: 2, 3: DEPTH}[order])
            if order == 2:
                if len(p.start):
                    at = levels[1].at
                    yield pa.RecordBatch.from_arrays([pa.array(_pair(key[back[at - 1]], key[back[at]]).astype(np.int64)), pa.array(levels[1].count.astype(np.int64))], ["key", "n"])
                continue
            for size, level in enumerate(levels, 1):
                if order > 1 and size == 1:
                    continue
                for k in range(0, len(level.at), 200_000):
                    at = level.at[k : k + 200_000]
                    phrase = _gather(p.buf, p.start[at - size + 1], p.end[at]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(p.lang[at])).cast(pa.string()), phrase, pa.array(np.full(len(at), size, np.int32)), pa.array(level.count[k : k + 200_000].astype(np.int64))], ["lang", "phrase", "size", "n"])

    return counted


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word) → the word's hash with its language."""
    for batch in batches:
        key = K.mix64(_whole(batch.column(1)) ^ _whole(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64))], ["key"])


def _bitmap(keys: DataFrame):
    """A broadcast bitmap of the low bits of ``key``, ``FILTER_BITS`` wide however many there are."""
    bit = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    slots = keys.select(F.shiftright(bit, 6).alias("slot"), F.expr("shiftleft(1L, CAST(key & 63 AS INT))").alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(max(1, FILTER_BITS // 64), np.int64)
    bits[np.asarray(slots.column("slot"))] = np.asarray(slots.column("mask"))
    return keys.sparkSession.sparkContext.broadcast(bits.tobytes())


def _added(rows: DataFrame, order: int, shared) -> DataFrame:
    fields, by = ("key long, n long", ["key"]) if order == 2 else ("lang string, phrase string, size int, n long", ["lang", "phrase", "size"])
    return rows.mapInArrow(_counted(order, shared, SHARD), fields).groupBy(*by).agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, scratch: Scratch, text_col: str, lang_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``DEPTH`` words with ``least`` occurrences: ``(lang, phrase, size, n)``; and the words of each language, ``(lang, words)``."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.concat(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("\n")).alias("text"))
    words = _added(rows, 1, None)
    # a language's total and its frequent words come from one shuffle of the counts
    ones = scratch.table("words", words.groupBy("lang", F.when(F.col("n") >= least, F.col("phrase")).alias("phrase")).agg(F.sum("n").alias("n")))
    totals = scratch.table("totals", ones.groupBy("lang").agg(F.sum("n").alias("words")))
    ones = ones.filter("phrase IS NOT NULL").select("lang", "phrase", F.lit(1).alias("size"), "n")
    keys = ones.select("lang", "phrase").mapInArrow(_word_keys, "key long")
    pairs = scratch.table("pairs", _added(rows, 2, _bitmap(keys)).filter(F.col("n") >= least).select("key"))
    return ones.unionByName(scratch.table("more", _added(rows, 3, _bitmap(pairs)).filter(F.col("n") >= least))), totals


def _part(words: str, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scores(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """Every phrase of two words or more with its lowest-scoring cut: ``(lang, phrase, size, a, l, r, n, score)``.

    Products are decimals of 38 digits: ``1000 a n`` and ``l r`` are exact as long as counts stay below 10**16 and words below 10**19.
    """
    counts = grams.select("lang", F.col("phrase").alias("part"), F.col("n").alias("found"))
    cut = grams.filter("size > 1").withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "size", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "size", "a", "k", _part("w", F.lit(1), F.col("k")).alias("head"), _part("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    cut = cut.join(counts.withColumnsRenamed({"part": "head", "found": "l"}), ["lang", "head"]).join(counts.withColumnsRenamed({"part": "tail", "found": "r"}), ["lang", "tail"])
    cut = cut.join(broadcast_if_small(totals.withColumnRenamed("words", "n")), "lang")
    score = F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "size", "a", "x.l", "x.r", "n", "x.score")


def subsumed(grams: DataFrame) -> DataFrame:
    """``(lang, phrase, a)``: what lies within a phrase of one word more that is found as often."""
    w = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(w, F.lit(2), F.col("size") - 1), " "), F.array_join(F.slice(w, F.lit(1), F.col("size") - 1), " "))
    return grams.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("a")).distinct()


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best phrases of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    A-Z in lower case; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs.  Candidates have two to ``DEPTH`` words and at least
    ``least`` occurrences ``a``; ``l`` and ``r`` count the parts of the cut with the lowest ``score``, ``floor(1000 a n / (l r))`` with ``n`` words in the
    language.  Candidates within a longer one that is found as often are dropped.  The first ``top`` by score, then ``a``, then bytes stay.

    A null language is ``und``, a null or empty text has no words.  Repeated rows count as often as they stand there.  A language without
    candidates, and an empty table, give no rows.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    grams, totals = frequent(docs, scratch, text_col, lang_col, least)
    kept = scratch.table("kept", scores(grams, totals).join(subsumed(grams), ["lang", "phrase", "a"], "left_anti"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    dealt = kept.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, top: int = TOP) -> str:
    """The same in DuckDB."""
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, s AS size, array_to_string(w[i:i + s - 1], ' ') AS phrase, count(*) AS c FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS s) z WHERE i + s - 1 <= len(w) GROUP BY ALL),
tot AS (SELECT lang, sum(c)::BIGINT AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (SELECT * FROM g WHERE c >= {least}),
cut AS (SELECT lang, phrase, size, c AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size > 1),
sc AS (SELECT cut.lang, cut.phrase, a, h.c AS l, t.c AS r, n, k, ((1000::HUGEINT * a * n) // (h.c::HUGEINT * t.c))::BIGINT AS score FROM cut JOIN tot USING (lang)
  JOIN f h ON h.lang = cut.lang AND h.phrase = array_to_string(ws[1:k], ' ') JOIN f t ON t.lang = cut.lang AND t.phrase = array_to_string(ws[k + 1:], ' ')),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, c, unnest([array_to_string(string_split(phrase, ' ')[2:], ' '), array_to_string(string_split(phrase, ' ')[1:size - 1], ' ')]) AS phrase FROM f WHERE size > 2),
kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM longer WHERE longer.lang = best.lang AND longer.phrase = best.phrase AND longer.c = best.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}
"""
