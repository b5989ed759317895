"""BPE encoding and decoding with merges in batched numpy rounds.

A batch's words that were not met before become one flat array of symbols.  In each round, every
word's adjacent pairs are looked up by binary search in the sorted pair keys, and each word merges its
lowest-ranked pair, the leftmost of equals, as one-at-a-time BPE does; only pairs beside a merge are
looked up again.  Words that have no pair left drop out.  Very long words are merged with a heap
instead, so that one word of a million letters doesn't take a million rounds.

Results of words are kept in a table of bounded size, so frequent words are merged once.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 200
KEPT = 300_000
_NONE = np.int64(1) << 40

#: Fixed value: white space as the normalizer of such files has it.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class WordBPE:
    """A BPE file of the kind: NFC, white space dropped, lower case, words by pattern, byte letters, a suffix at the end of each word."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model, parts = j["model"], [p["type"] for p in (j["normalizer"] or {}).get("normalizers", [])]
        split = j["pre_tokenizer"]["pretokenizers"][0]
        if parts != ["NFC", "Replace", "Lowercase"] or j["decoder"] or j["post_processor"] or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("this is not a file of the kind that WordBPE reads")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        self.suffix = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        vocab = model["vocab"]
        self.vocab = vocab
        self.token = np.array([""] * (max([*vocab.values(), *self.specials.values()]) + 1), object)
        for t, i in [*vocab.items(), *self.specials.items()]:
            self.token[i] = t
        self.n = len(self.token)
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + self.suffix, -1) for c in letters], np.int64)
        if min(self.inner.min(), self.last.min()) < 0:
            raise ValueError("every byte must be in the vocabulary")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, at = np.unique(keys[::-1], return_index=True)  # of a pair listed twice the last rank holds
        self.keys, self.ranks = keys, len(pairs) - 1 - at
        self.made = made[self.ranks]
        self.known: dict[str, tuple[bytes, bytes, int]] = {}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the symbol it makes; a very high rank where there is no such merge."""
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Symbols of each word."""
        out: list[np.ndarray | None] = [None] * len(words)
        todo = []
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._merge_long(w)
            else:
                todo.append(i)
        if not todo:
            return out
        size = np.array([len(words[i]) for i in todo])
        flat = np.frombuffer(b"".join(words[i] for i in todo), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(size)
        sym[ends - 1] = self.last[flat[ends - 1]]
        index = np.array(todo)
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self.lookup(sym[:-1], sym[1:])
        rank[ends - 1] = _NONE
        start = ends - size
        while len(sym):
            place = np.arange(len(sym))
            best = np.minimum.reduceat((rank << 22) | (place - np.repeat(start, size)), start)
            stay = best < (_NONE << 22)
            if not stay.all():
                for k in np.flatnonzero(~stay):
                    out[index[k]] = sym[start[k] : start[k] + size[k]].copy()
                keep = np.repeat(stay, size)
                sym, rank, made = sym[keep], rank[keep], made[keep]
                size, index, best = size[stay], index[stay], best[stay]
                start = np.cumsum(size) - size
                if not len(sym):
                    break
            at = start + (best & ((1 << 22) - 1))
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            rank[at] = _NONE
            sym, rank, made = sym[keep], rank[keep], made[keep]
            size = size - 1
            start = np.cumsum(size) - size
            at = new[at]
            owner = np.arange(len(size))
            right = at[at < start[owner] + size[owner] - 1]
            left = at[at > start[owner]] - 1
            fresh = np.concatenate((left, right))
            rank[fresh], made[fresh] = self.lookup(sym[fresh], sym[fresh + 1])
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        sym = self.inner[raw].tolist()
        sym[-1] = int(self.last[raw[-1]])
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        r, m = self.lookup(np.array(sym[:-1]), np.array(sym[1:]))
        heap = [(int(r[i]), i, sym[i], sym[i + 1], int(m[i])) for i in np.flatnonzero(r < _NONE)]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i] if not gone[i] else n
            if gone[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i] = c
            gone[j] = True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    rr, mm = self.lookup(np.array([sym[x]]), np.array([sym[y]]))
                    if rr[0] < _NONE:
                        heapq.heappush(heap, (int(rr[0]), x, sym[x], sym[y], int(mm[0])))
        return np.array([s for s, g in zip(sym, gone, strict=True) if not g], np.int64)

    def words(self, text: str) -> list[str]:
        """Words of a text in order; a special token's string is a word by itself."""
        if self.special and any(s in text for s in self.specials):
            out = []
            for k, part in enumerate(self.special.split(text)):
                out += [part] if k % 2 else self.pattern.findall(self.normal(part))
            return out
        return self.pattern.findall(self.normal(text))

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character's own lower case (without the context rule for a final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def learn(self, words: set[str]) -> None:
        """Add the results of words to the table."""
        fresh = [w for w in words if w not in self.known]
        plain = [w for w in fresh if w not in self.specials]
        for w in fresh:
            if w in self.specials:
                self.known[w] = (str(self.specials[w]).encode(), w.encode(), 1)
        for k in range(0, len(plain), 50_000):
            part = plain[k : k + 50_000]
            for w, s in zip(part, self.merge([w.encode() for w in part]), strict=True):
                self.known[w] = (" ".join(map(str, s.tolist())).encode(), " ".join(self.token[s]).encode(), len(s))

    def encode(self, text: str) -> tuple[str, str, int]:
        """Decimal ids joined by a space, the decoded text, and the number of ids."""
        words = self.words(text)
        self.learn(set(words) - self.known.keys())
        return self._join(words)

    def _join(self, words: list[str]) -> tuple[str, str, int]:
        found = [self.known[w] for w in words]
        return b" ".join([f[0] for f in found]).decode(), b" ".join([f[1] for f in found]).decode(), sum([f[2] for f in found])


def _coded(spec):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(spec.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                split, unknown, big, first = [], set(), 0, at
                while at < batch.num_rows and big < 4 << 20:
                    text = batch.column(1)[at].as_py() or ""
                    big += len(text)
                    split.append(bpe.words(text))
                    unknown.update(split[-1])
                    at += 1
                if len(bpe.known) > KEPT:
                    bpe.known.clear()
                bpe.learn(unknown - bpe.known.keys())
                ids, decoded, n = zip(*map(bpe._join, split), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(split)), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["id", "n_tokens", "ids", "decoded"])

    return coded


def coded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids, decoded)`` for each row: the ids of the whole text, as decimal numbers joined by one space, and what they decode to.

    A null, empty or blank text has no ids and decodes to an empty text.  The file has no decoder, so
    tokens are joined by a space.  Repeated rows and null ids are kept as they are; other columns are ignored; an empty
    table gives an empty table.  The file is read by the driver.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_coded(spec), f"id {kind}, n_tokens long, ids string, decoded string").withColumnRenamed("id", id_col)
