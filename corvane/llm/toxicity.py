"""Toxic spans and document scores from a linear-chain conditional random field.

Documents carry labels, the field needs labelled tokens.  They come from a greedy cover: among the
words, word beginnings and word ends that hardly occur, or hardly occur often, in clean documents, take again and again the
one found in most toxic documents that none so far explains, until the next would explain too few.  Then
the cover begins anew without the features it has, for those alone that many documents have, until there is none.  Near copies in the sample count once.
Tokens of toxic documents with a chosen feature are labelled toxic, all others clean.  The field has
two states, features of the word itself, its beginnings and its end, and transitions; it is fitted by
gradient ascent with forward-backward sums over all tokens of the sample's whole texts, in pieces of ``PIECE`` words.

Scoring runs forward-backward over every whole text.  Marginals of at least ``SPAN`` give the offending
offsets; their maximum, their sum and its share of the words go through a logistic curve fitted on the sample, which gives
the document's score.

Only the fit uses a sample: at most ``TRAIN_DOCS`` labelled documents of each class, by the hash of their
id, of at most ``TRAIN_BYTES`` bytes each; these are its documented bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import kernel as K
from corvane.llm.scratch import Scratch

TRAIN_DOCS = 2000
TRAIN_BYTES = 20_000
CUTOFF = 0.7
SPAN = 0.5
#: The kinds of feature: the word, and so many of its first or (negative) last bytes.
KINDS = (0, 4, 5, 6, 7, 8, -4, -5)
#: A seed is found in at least this share of the toxic sample that no other seed explains, and at least so many documents.
SEED_SHARE, SEED_DOCS = 0.002, 3
PURITY = 0.98
#: A feature that explains no new document must be found in this share of the toxic sample.
MANY = 0.05
#: A feature is met often in a text that has it twice or more, and in this share of its words; marked by this bit of its hash.
OFTEN_SHARE, OFTEN = 0.01, np.uint64(1 << 63)
PIECE = 64
EPOCHS = 40
L2 = 2e-4
#: Texts that share a step of the forward-backward pass, and bytes of text taken at once so that there are enough of them.
SIDE = 256
RUN = 1 << 20
#: The same of the sample, whose features are gathered on the driver.
FIT_RUN = 1 << 18
#: Pieces of the sample whose marginals are held at once by the fit.
STEP = 512
#: Longest text of a step times the texts beside it, at most.
CELLS = 1 << 20


def features(w: K.Words) -> np.ndarray:
    """Feature hashes of each word, a column for each kind; 0 where the word is too short."""
    sums = w.prefix_sums()
    size = w.end - w.start
    out = np.zeros((len(size), len(KINDS)), np.uint64)
    for j, k in enumerate(KINDS):
        long = size > abs(k)
        a = w.end[long] + k if k < 0 else w.start[long]
        b = w.start[long] + k if k > 0 else w.end[long]
        out[long, j] = K.mix64(w.span_hash(sums, a, b) + np.uint64(j + 1)) & ~OFTEN | np.uint64(1)
    return out


@dataclass
class Field:
    """Weights by feature hash (sorted), the state bias, the chain, and the curve of document scores."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    chain: np.ndarray  # chain[a, b]: weight of going from state a to b
    curve: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.keys & np.uint64((1 << 22) - 1)] = True

    def emissions(self, f: np.ndarray) -> np.ndarray:
        """Log odds of the toxic state for each word by its own features."""
        out = np.full(len(f), self.bias)
        if len(self.keys):
            for j in range(f.shape[1]):
                hit = np.flatnonzero(self.sieve[f[:, j] & np.uint64((1 << 22) - 1)])
                at = np.searchsorted(self.keys, f[hit, j])
                at[at == len(self.keys)] = 0
                real = self.keys[at] == f[hit, j]
                out[hit[real]] += self.weights[at[real]]
        return out


def marginals(field: Field, e: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """P(toxic) of each word given its whole text: forward and backward odds, many texts side by side."""
    t = np.exp(field.chain)
    out = np.zeros(len(e))
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    order = order[: np.count_nonzero(size)]
    x = np.exp(np.clip(e, -30, 30))
    k = 0
    while k < len(order):
        part = order[k : k + max(1, min(SIDE, CELLS // int(size[order[k]])))]
        k += len(part)
        n, first = size[part], ptr[part]
        longest = int(n[0])
        live = np.searchsorted(-n, -np.arange(longest), "left")  # texts with more than so many words
        ahead = np.empty((longest, len(part)))
        for i in range(longest):
            here = x[first[: live[i]] + i]
            if i:
                r = ahead[i - 1, : live[i]]
                here = here * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
            ahead[i, : live[i]] = here
        back = np.ones(len(part))
        for i in range(longest - 1, -1, -1):
            m = live[i]
            at = first[:m] + i
            odds = ahead[i, :m] * back[:m]
            out[at] = odds / (1 + odds)
            y = x[at] * back[:m]
            back[:m] = (t[1, 0] + t[1, 1] * y) / (t[0, 0] + t[0, 1] * y)
    return out


def _curve_inputs(p: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """One, the largest marginal, its log odds, the log of the marginals' sum, and that of the sum for each hundred words."""
    n = np.diff(ptr)
    full = np.flatnonzero(n)
    top = np.zeros(len(n))
    if len(full):
        top[full] = np.maximum.reduceat(p, ptr[full])
    total = K.sums_by_text(p, ptr)
    odds = np.log(np.clip(top, 1e-3, 1 - 1e-3)) - np.log1p(-np.clip(top, 1e-3, 1 - 1e-3))
    return np.column_stack((np.ones(len(top)), top, odds / 7, np.log1p(total), np.log1p(100 * total / np.maximum(n, 1))))


def _features(texts: pa.Array) -> Iterator[tuple[int, K.Words, np.ndarray]]:
    """Runs of texts with the index of their first text, so that no more than one run's features are held."""
    for run in K.runs(texts, FIT_RUN):
        w = K.words(run, K.NOT_ALNUM)
        yield run.first, w, features(w)


def _distinct(w: K.Words, f: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a run; features that a text has often come a second time, marked."""
    doc, flat = np.repeat(w.doc() + first, f.shape[1]), f.ravel()
    doc, flat = doc[flat != 0], flat[flat != 0]
    order = np.lexsort((flat, doc))
    doc, flat = doc[order], flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(flat)))
    doc, flat = doc[at], flat[at]
    often = (times >= 2) & (times >= OFTEN_SHARE * np.diff(w.ptr)[doc - first])
    return np.concatenate((doc, doc[often])), np.concatenate((flat, flat[often] | OFTEN))


def _often(texts: pa.Array, least: float) -> np.ndarray:
    """Sorted features found in at least so many texts."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for first, w, f in _features(texts):
        keys, inv = np.unique(np.concatenate((keys, _distinct(w, f, first)[1])), return_inverse=True)
        counts = np.bincount(inv, np.concatenate((counts, np.ones(len(inv) - len(counts)))), len(keys))
    return keys[counts >= least]


def _pairs(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a text and the index of one of the sorted features ``known``."""
    owners, found = zip(*_known(texts, known), strict=True)
    return np.concatenate(owners), np.concatenate(found)


def _met_in(texts: pa.Array, known: np.ndarray) -> np.ndarray:
    """In how many texts each of the sorted features ``known`` is found."""
    return sum((np.bincount(at, minlength=len(known)) for _, at in _known(texts, known)), np.zeros(len(known), np.int64))


def _known(texts: pa.Array, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, run by run."""
    for first, w, f in _features(texts):
        doc, flat = _distinct(w, f, first)
        at = np.searchsorted(known, flat)
        at[at == len(known)] = 0
        keep = known[at] == flat
        yield doc[keep].astype(np.int32), at[keep].astype(np.int32)


def originals(texts: pa.Array) -> np.ndarray:
    """Whether each text shares none of four smallest hashes of its five-word windows with a text before it; texts of fewer words stay."""
    seen: set[tuple[int, int]] = set()
    out = np.ones(len(texts), bool)
    for run in K.runs(texts):
        w = K.words(run)
        windows, ptr = K.windows(w.hashes(), w.ptr, 5)
        for i in np.flatnonzero(np.diff(ptr)):
            part = windows[ptr[i] : ptr[i + 1]]
            mine = {(k, int((part * np.uint64(2 * k + 3) if k else part).min())) for k in range(4)}
            out[run.first + i] = not (mine & seen)
            seen |= mine
    return out


def seeds(bad: pa.Array, good: pa.Array) -> np.ndarray:
    """Feature hashes that the greedy cover chooses, from texts labelled toxic and clean, whether it takes them for occurring at all or often."""
    least = max(SEED_DOCS, SEED_SHARE * len(bad))
    keys = _often(bad, least)
    if not len(keys):
        return keys
    owner, inv = _pairs(bad, keys)
    n = np.bincount(inv, minlength=len(keys))
    clean = _met_in(good, keys)
    rate = n / len(bad)
    may = rate / (rate + clean / max(len(good), 1)) >= PURITY
    owner, inv = owner[may[inv]], inv[may[inv]]
    chosen: list[int] = []

    def cover(owner: np.ndarray, inv: np.ndarray, least: float) -> int:
        left, before = np.ones(len(bad), bool), len(chosen)
        while len(inv):
            gain = np.bincount(inv, minlength=len(keys))
            best = int(np.argmax(gain))
            if gain[best] < least:
                break
            chosen.append(best)
            left[owner[inv == best]] = False
            stay = left[owner]
            owner, inv = owner[stay], inv[stay]
        return len(chosen) - before

    found = cover(owner, inv, least)
    while found:
        fresh = ~np.isin(inv, chosen)
        owner, inv = owner[fresh], inv[fresh]
        found = cover(owner, inv, max(least, MANY * len(bad)))
    chosen = keys[chosen]
    return np.unique(np.array(chosen, np.uint64) & ~OFTEN)


def fit(texts: pa.Array, toxic: np.ndarray, prior: float) -> Field:
    """A field from labelled documents; ``prior`` is the share of toxic ones among all that are labelled."""
    empty = Field(np.zeros(0, np.uint64), np.zeros(0), -20.0, np.zeros((2, 2)), np.array([np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), 0, 0, 0, 0]))
    if not len(texts) or toxic.all() or not toxic.any():
        return empty
    own = originals(texts)
    texts, toxic = texts.filter(pa.array(own)), toxic[own]
    if toxic.all() or not toxic.any():
        return empty
    seed = seeds(texts.filter(pa.array(toxic)), texts.filter(pa.array(~toxic)))
    if not len(seed):
        return empty

    # Features that hardly any toxic document has tell nothing; index 0 stands for them.
    keys = np.unique(np.append(_often(texts.filter(pa.array(toxic)), SEED_DOCS) & ~OFTEN, np.uint64(0)))
    number = np.min_scalar_type(len(keys))  # the largest table of the fit holds such numbers
    rows, marks, beside = [], [], [np.zeros(0, np.uint64)]
    for first, w, f in _features(texts):
        at = np.searchsorted(keys, f)
        at[at == len(keys)] = 0
        at = np.where(keys[at] == f, at, 0).astype(number)
        doc = w.doc()
        hits = np.isin(f, seed).any(1)
        beside.append(np.unique(f[hits]))
        mark = hits & toxic[first + doc]
        pieces = -(-np.diff(w.ptr) // PIECE)  # of each text
        place = np.arange(len(doc)) - w.ptr[doc]
        piece = (np.cumsum(pieces) - pieces)[doc] + place // PIECE
        row, m = np.zeros((int(pieces.sum()), PIECE, len(KINDS)), number), np.full((int(pieces.sum()), PIECE), -1, np.int8)
        row[piece, place % PIECE], m[piece, place % PIECE] = at, mark
        rows.append(row)
        marks.append(m)
    may = np.unique(np.concatenate(beside))
    steps = [(r[i : i + STEP], m[i : i + STEP]) for r, m in zip(rows, marks, strict=True) for i in range(0, len(m), STEP)]
    weights, bias, chain = np.zeros(len(keys)), -2.0, np.zeros((2, 2))
    zero = keys == 0
    g2 = [np.full(len(keys), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    total = sum(len(y) for _, y in steps)
    for _ in range(EPOCHS):
        grad, gb, gc = np.zeros(len(keys)), 0.0, np.zeros((2, 2))
        for inv, y in steps:
            valid = y >= 0
            e = np.full(y.shape, bias)
            for j in range(len(KINDS)):
                e += weights[inv[:, :, j]]
            p, joint = _batch_marginals(e, chain, valid)
            err = np.where(valid, (y == 1) - p, 0.0)
            gb += err.sum()
            grad += np.bincount(inv.ravel(), np.repeat(err.ravel(), len(KINDS)), len(keys))
            pair = valid[:, 1:] & valid[:, :-1]
            for a in (0, 1):
                for b in (0, 1):
                    gc[a, b] += ((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() - (joint[a][b] * pair).sum()
        grad = grad / total - L2 * weights
        grad[zero] = 0
        gb, gc = gb / total, gc / total - L2 * chain
        g2[0] += grad**2
        g2[1] += gb**2
        g2[2] += gc**2
        weights += 0.5 * grad / np.sqrt(g2[0])
        bias += 0.5 * gb / np.sqrt(g2[1])
        chain += 0.5 * gc / np.sqrt(g2[2])
    # Beyond what the sample labels toxic, a feature speaks for toxicity only beside one that the cover chose.
    keep = (np.abs(weights) > 0.05) & ~zero & ((weights < 0) | np.isin(keys, may))
    field = Field(keys[keep], weights[keep], float(bias), chain, empty.curve)
    z = np.vstack([_curve_inputs(marginals(field, field.emissions(f), w.ptr), w.ptr) for _, w, f in _features(texts)])
    share = toxic.mean()
    weight = np.where(toxic, prior / share, (1 - prior) / (1 - share))
    curve, ridge = np.zeros(z.shape[1]), np.array([1e-3] + [1e-1] * (z.shape[1] - 1))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        h = (z * (weight * q * (1 - q))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, z.T @ (weight * (toxic - q)) - ridge * curve)
        curve += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    field.curve = curve
    return field


def _batch_marginals(e: np.ndarray, chain: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, list]:
    """Marginals and pair marginals of windows of equal length; places that aren't valid stand outside the text, on either side."""
    n, m = e.shape
    x = np.exp(np.clip(np.where(valid, e, 0), -30, 30))
    t = np.exp(chain)
    ahead, back = np.ones((2, n, m)), np.ones((2, n, m))
    for i in range(m):
        both = np.stack((np.ones(n), x[:, i]))
        if i:
            go = valid[:, i] & valid[:, i - 1]
            step = np.stack([ahead[0, :, i - 1] * t[0, b] + ahead[1, :, i - 1] * t[1, b] for b in (0, 1)])
            both = both * np.where(go, step, 1.0)
        ahead[:, :, i] = both / both.sum(0)
    for i in range(m - 2, -1, -1):
        go = valid[:, i] & valid[:, i + 1]
        step = np.stack([t[a, 0] * back[0, :, i + 1] + t[a, 1] * x[:, i + 1] * back[1, :, i + 1] for a in (0, 1)])
        step = np.where(go, step, 1.0)
        back[:, :, i] = step / step.sum(0)
    p = ahead * back
    p /= p.sum(0)
    joint = [[ahead[a, :, :-1] * t[a, b] * (x[:, 1:] if b else 1.0) * back[b, :, 1:] for b in (0, 1)] for a in (0, 1)]
    norm = sum(joint[a][b] for a in (0, 1) for b in (0, 1))
    return p[1], [[joint[a][b] / norm for b in (0, 1)] for a in (0, 1)]


def _chars(run: K.Run, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Code points before byte ``at`` in its own text."""
    heads = np.zeros(len(run.buf) + 1, np.int64)
    np.cumsum((run.buf & 0xC0) != 0x80, out=heads[1:])
    return heads[at] - heads[run.off[doc]]


def _scored(shared):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared.value
        for batch in batches:
            for run in K.runs(batch.column(batch.num_columns - 1), RUN):
                w = K.words(run, K.NOT_ALNUM)
                p = marginals(field, field.emissions(features(w)), w.ptr)
                score = 1 / (1 + np.exp(-np.clip(_curve_inputs(p, w.ptr) @ field.curve, -30, 30)))
                hit = np.flatnonzero(p >= SPAN)
                doc = np.searchsorted(w.ptr, hit, "right") - 1
                edges = pa.array(np.searchsorted(hit, w.ptr).astype(np.int32))
                spans = [pa.ListArray.from_arrays(edges, pa.array(_chars(run, side[hit], doc))) for side in (w.start, w.end)]
                kept = [c.slice(run.first, len(run)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score), *spans], [*batch.schema.names[:-1], "score", "span_starts", "span_ends"])

    return scored


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None) -> Field:
    """Fit on a bounded sample of labelled documents.  ``usable`` says which ids may be learnt from (all, by default).

    Labels that are null are ignored; an id that is labelled twice counts as toxic if one label says so; of several texts with one id the smallest is learnt from.
    Without both classes the field is empty and every document gets the prior as its score.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    if usable is not None:
        ids = ids.filter(usable)
    ids = scratch.table("labels", ids.groupBy("id").agg(F.max("y").alias("y")))
    n = {r["y"]: r["n"] for r in ids.groupBy((F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = n.get(True, 0) / max(1, sum(n.values()))
    mixed = F.xxhash64(F.col("id").cast("string"))
    side = lambda c: ids.filter(c).orderBy(mixed, "id").limit(TRAIN_DOCS)
    chosen = scratch.table("chosen", side("y > 0").union(side("y <= 0")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") <= TRAIN_BYTES)
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toArrow().sort_by("id")
    return fit(rows.column("text").combine_chunks(), np.asarray(rows.column("y")) > 0, prior)


def _rows(docs: DataFrame, field: Field, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` as ``_k0``, ``_k1`` and so on, with ``score``, ``span_starts`` and ``span_ends``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), F.col(f"`{text_col}`").cast("string").alias("_text"))
    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double", "span_starts array<long>", "span_ends array<long>"])
    return rows.mapInArrow(_scored(shared), fields)


def scored(docs: DataFrame, field: Field, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(keep..., score, span_starts, span_ends)`` for each row.

    Spans are code-point offsets of words whose marginal reaches ``SPAN``.  Null, empty and wordless
    texts get the curve's value at zero; repeated rows come back as often; an empty table stays empty.
    """
    return _rows(docs, field, text_col, keep).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "score", "span_starts", "span_ends")


def kept_documents(docs: DataFrame, labels: DataFrame, usable: Column | None = None, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The input's columns, whatever their names, of the rows whose score stays below ``cutoff``; the field learns from the labelled rows of the input."""
    field = learn(docs, labels, text_col=text_col, usable=usable)
    names = tuple(docs.columns)
    return _rows(docs, field, text_col, names).filter(F.col("score") < cutoff).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(names)))
