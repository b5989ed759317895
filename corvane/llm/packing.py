"""Best-fit packing planned on the histogram of lengths.

Texts become token pieces of at most ``SEQUENCE`` tokens.  The number of pieces of each length, at most
``SEQUENCE`` numbers, is all that the plan needs: best-fit decreasing over counts says, for runs of pieces
of one length, which sequences and offsets they take.  Each piece then finds its slot by its rank
within its length.  Ranks are counted in salted parts whose number grows with the input, so a
length that most pieces have is not ranked in one task.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm.scratch import Scratch

SEQUENCE = 1024
END_ID = 2
#: Pieces in a salted part of one length, about.
PART = 4096

#: Blank, or other, characters in a row from which on a text goes through the tokenizers library.
STRETCH = 5000
_STRETCH = re.compile(rf"\s{{{STRETCH}}}|\S{{{STRETCH}}}")

#: Fixed value: the splitting pattern of byte-level BPE files of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes stand for themselves, the others take code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts as the tokenizers library gives them for a byte-level BPE file.

    Where the file's ids rank its merges, texts go through tiktoken with the same vocabulary, which
    gives the same ids three times as fast.  Texts that hold the string of a special token or a stretch of ``STRETCH``
    characters that are all blank or all not, on which tiktoken's pattern may run out of stack, and all
    texts if ids don't rank merges, go through the tokenizers library itself, which is loaded when first needed.
    """

    def __init__(self, spec: str):
        model = json.loads(spec)
        self.spec, self._slow = spec, None
        self.specials = [t["content"] for t in model["added_tokens"]]
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        order = [vocab.get(a + b, -1) for a, b in pairs]
        step = model["pre_tokenizer"]
        usual = step == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": step.get("trim_offsets"), "use_regex": True} and model["normalizer"] is None
        self.fast = None
        if usual and order == sorted(set(order)) and len(vocab) == len(order) + 256 and order[0] >= 256:
            letters = byte_letters()
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(letters[c] for c in t): i for t, i in vocab.items()}, special_tokens={})

    @property
    def slow(self) -> Tokenizer:
        if self._slow is None:
            self._slow = Tokenizer.from_str(self.spec)
            self._slow.no_padding()
            self._slow.no_truncation()
        return self._slow

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.specials) or len(text) >= STRETCH and _STRETCH.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _pieces(spec, sequence: int, end_id: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple[int, int, int, int, bytes]] = []
                for i, text in enumerate(part.column(1)):
                    ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                    first = (len(ids) - 1) % sequence + 1
                    edges = [0, *range(first, len(ids) + 1, sequence)]
                    rows += [(i, k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
                who, piece, start, length, ids = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["id", "piece", "start", "length", "ids"])

    return pieces


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``(id_col, piece, start, length, ids)``: each text's ids and the end id, cut into pieces of ``sequence`` tokens.

    Only longer texts are cut, and only their first piece may be shorter.  ``ids`` are little-endian
    unsigned 32-bit numbers.  A null or empty text is the end id alone.  Repeated rows and null ids
    are kept as they are; an empty table gives an empty table.  The file is read by the driver.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_pieces(spec, sequence, end_id), f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram of lengths below ``sequence``.

    Returns runs ``(length, first rank, last rank, first sequence, offset)``, in which consecutive ranks take consecutive
    sequences at one offset, and the number of sequences.  Sequences of equal room stay together, so
    the work depends on the lengths that occur and hardly on how many pieces have them.
    """
    out: list[tuple[int, int, int, int, int]] = []
    open_: list[tuple[int, int, int]] = []  # (room left, first sequence, how many), by room
    used = 0
    for size in sorted(counts, reverse=True):
        rank, todo = 0, counts[size]
        while todo:
            at = bisect_left(open_, (size, -1, -1))
            if at < len(open_):
                room, first, many = open_.pop(at)
            else:
                room, first, many = sequence, used, -(-todo // (sequence // size))
                used += many
            each = room // size
            full = min(many, todo // each)
            for k in range(each if full else 0):
                out.append((size, rank, rank + full - 1, first, sequence - room + k * size))
                rank += full
            todo -= full * each
            if full and room - each * size:
                insort(open_, (room - each * size, first, full))
            if full < many and todo:
                some = min(todo, each)
                for k in range(some):
                    out.append((size, rank, rank, first + full, sequence - room + k * size))
                    rank += 1
                todo -= some
                if room - some * size:
                    insort(open_, (room - some * size, first + full, 1))
                full += 1
            if full < many:
                insort(open_, (room, first + full, many - full))
    return out, used


def packed(pieces: DataFrame, sequence: int = SEQUENCE, length_col: str = "length") -> DataFrame:
    """All columns of ``pieces`` with ``sequence_id`` and ``offset``; lengths must lie between 1 and ``sequence``.

    Input columns of these two names are replaced.  Every sequence is filled without gaps from 0.
    An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(F.col(length_col).cast("long").alias("_len"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    rows = scratch.table("pieces", rows.withColumn("_at", F.monotonically_increasing_id()))
    many = rows.count()
    salt = F.pmod(F.xxhash64("_at"), F.lit(max(1, many // PART))).cast("int")
    short = rows.filter(F.col("_len") < sequence).withColumn("_salt", salt)
    sizes = scratch.table("sizes", short.groupBy("_len", "_salt").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["_len"]: r["n"] for r in sizes.groupBy("_len").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    slots, used = plan(counts, sequence)
    slot = spark.createDataFrame(slots, "_l long, lo long, hi long, first long, offset long")
    if len(slots) < 500_000:  # it depends on the lengths alone
        slot = F.broadcast(slot)
    before = Window.partitionBy("_len").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("_len").alias("b_len"), F.col("_salt").alias("b_salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = short.withColumn("nth", F.row_number().over(Window.partitionBy("_len", "_salt").orderBy("_at")) - 1)
    ranked = ranked.join(base, (F.col("_len") == F.col("b_len")) & (F.col("_salt") == F.col("b_salt"))).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(slot, (F.col("_len") == F.col("_l")) & F.col("rank").between(F.col("lo"), F.col("hi")))
    placed = placed.select("_row", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
    alone = rows.filter(F.col("_len") == sequence).select("_row", (F.col("_at") + used).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone).select(*(F.col(f"_row.`{c}`").alias(c) for c in names), "sequence_id", "offset")
