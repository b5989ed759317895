"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle space gives two signature values, the smallest and the largest
image of a document's set, so 32 hash evaluations a shingle give a signature of 64 values.  Bands of
four values (both ends of two permutations) find candidates: two sets of similarity 0.85 miss each
other in all 16 bands with a probability of 7e-6.  A lower limit takes more permutations (44 at 0.80,
which miss 9e-6).  Every reported link is confirmed on the full sets.

Shape of the job
    1. one pass over the texts: size, 128-bit digest and signature of each shingle set;
    2. documents of equal sets become one class, whose smallest id stands for it;
    3. classes that share a band value form a bucket.  Rather than all pairs of a bucket, rounds of
       stars are verified: a center against all members that don't hang together with it yet.  The first two
       rounds have one center a bucket, the member that meets most others; each further round has, beside it, twice as many
       others, picked by hash, as long as rounds link anything.  What stays unresolved once a round links nothing is
       compared block by block: every pair's signatures, and the full sets of pairs whose signatures
       agree well enough and that don't hang together yet;
    4. components of the confirmed links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import kernel as K
from corvane.llm.components import connected_components
from corvane.llm.scratch import Scratch, unused

SHINGLE = 5
PERMUTATIONS = 32
BAND_PERMUTATIONS = 2
BANDS = PERMUTATIONS // BAND_PERMUTATIONS
#: How often a pair at the limit may miss all bands.
MISS = 1e-5
#: Rounds after which stars end although they still link; tests set some.
STAR_ROUNDS: int | None = None
BLOCK = 256
#: A signature of 64 values estimates a similarity of 0.85 with a deviation of 0.045; pairs are let through down to five and a half of these,
#: so that a pair at the limit is lost with 6e-7 here, which is less than what the bands miss.
SLACK = 0.25
#: Ids that may be broadcast (8 bytes each); beyond it the candidates' texts are found by a shuffled join.
BROADCAST_IDS = 2_000_000


def permutations(percent: int) -> int:
    """Permutations whose bands two sets of ``percent`` % similarity all miss with a probability of at most ``MISS``."""
    if percent >= 85:
        return PERMUTATIONS
    one = (percent / 100) ** (2 * BAND_PERMUTATIONS)
    return BAND_PERMUTATIONS * max(BANDS, math.ceil(math.log(MISS) / math.log1p(-one)))


def shingle_sets(run: K.Run) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of the run."""
    w = K.words(run)
    h = w.hashes()
    s, ptr = K.windows(h, w.ptr, SHINGLE)
    for i in range(len(run)):
        n = w.ptr[i + 1] - w.ptr[i]
        if n >= SHINGLE:
            x = np.sort(s[ptr[i] : ptr[i + 1]])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif n:
            short, _ = K.windows(h[w.ptr[i] : w.ptr[i + 1]], np.array([0, n]), int(n))
            yield K.mix64(short + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray], count: int = PERMUTATIONS) -> np.ndarray:
    """Min and max under each of ``count`` permutations, as the upper 32 bits: rows of 2 * count values; sets must not be empty."""
    a = K.mix64(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
    b = K.mix64(np.arange(1001, 1001 + count, dtype=np.uint64))
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1]))
    out = np.empty((len(sets), 2 * count), np.uint32)
    image = np.empty_like(flat)
    for p in range(count):
        np.multiply(flat, a[p], out=image)
        np.add(image, b[p], out=image)
        out[:, 2 * p] = np.minimum.reduceat(image, starts) >> np.uint64(32)
        out[:, 2 * p + 1] = np.maximum.reduceat(image, starts) >> np.uint64(32)
    return out


def _features(count: int):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in K.runs(batch.column(1)):
                sets = list(shingle_sets(run))
                sizes = np.array([len(x) for x in sets], np.int64)
                full = [x for x in sets if len(x)]
                sig: list[bytes | None] = [None] * len(sets)
                d1, d2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if full:
                    rows = signatures(full, count)
                    where = np.flatnonzero(sizes)
                    flat, starts = np.concatenate(full), np.concatenate(([0], np.cumsum(sizes[where])[:-1]))
                    d1[where] = np.add.reduceat(flat, starts)
                    d2[where] = np.add.reduceat(K.mix64(flat + np.uint64(0x51ED270B)), starts)
                    for i, row in zip(where, rows, strict=True):
                        sig[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(run.first, len(run)), pa.array(sizes), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(sig, pa.binary())],
                    ["id", "n", "d1", "d2", "sig"],
                )

    return features


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sig) → one row for each band: its key, a hash of the band's number and values."""
    width = 2 * BAND_PERMUTATIONS
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1, width).astype(np.uint64)
        bands = sig.shape[1]
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2]).copy()
        for k in range(width):
            key = K.mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
        ids = np.repeat(np.asarray(batch.column(0)), bands)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "id"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in K.runs(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, len(run)), pa.array([x.tobytes() for x in shingle_sets(run)], pa.binary())], ["id", "shingles"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two non-empty sets have a similarity of at least ``percent`` %."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = _common(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                if _links(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64), percent):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return confirm


def _block_links(percent: int):
    """Groups of (key, i, j): a spanning forest of the links between block i and block j, beyond those known.

    Signatures pick the pairs that may link; the likeliest come first, a pair that already hangs together
    is skipped, and every other is confirmed on the full sets before it counts.
    """

    def links(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        side, ids = np.asarray(table.column("block")), np.asarray(table.column("id"))
        raw = table.column("shingles").combine_chunks()
        sets = [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in range(len(ids))]
        sig = signatures(sets, permutations(percent))
        _, root = np.unique(np.asarray(table.column("component")), return_inverse=True)
        parent = list(range(int(root.max()) + 1))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        first = np.flatnonzero(side == i)
        second = first if i == j else np.flatnonzero(side == j)
        need = int(np.ceil((percent / 100 - SLACK) * sig.shape[1]))
        a, b = [], []
        for x in first:
            agree = np.count_nonzero(sig[second] == sig[x], axis=1)
            close = np.flatnonzero((agree >= need) & (root[second] != root[x]) & ((ids[second] > ids[x]) if i == j else True))
            for y in second[close[np.argsort(-agree[close], kind="stable")]]:
                p, q = top(root[x]), top(root[y])
                if p != q and _links(sets[x], sets[y], percent):
                    parent[max(p, q)] = min(p, q)
                    a.append(min(ids[x], ids[y]))
                    b.append(max(ids[x], ids[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Group documents whose shingle sets have a similarity of at least ``percent`` %.

    Returns ``(id_col, n_shingles, component_id, kept)``, one row for each input row, whatever other
    columns the input has.  A set holds the distinct 5-word shingles of the ASCII-lower-cased text; a
    text of one to four words is one shingle; a null, empty or blank text has none, links with nothing
    and is kept.  Equal sets always link.  ``component_id`` is the smallest id reachable by links.
    Rows whose id is null can be neither linked nor named: they come back with a null component, kept.
    A row that repeats comes back as often.  An id should name one text: where it names several, links are confirmed on the one whose set sorts first.  An empty table gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = scratch.table("features", texts.mapInArrow(_features(permutations(percent)), "id long, n long, d1 long, d2 long, sig binary"))

    named = seen.filter("id IS NOT NULL AND n > 0")
    classes = scratch.table("classes", named.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"))
    stands = F.coalesce("rep", "id")
    member = scratch.table("members", named.join(classes, ["d1", "d2", "n"], "left").select("id", "n", stands.alias("rep"), F.when(stands == F.col("id"), F.col("sig")).alias("sig")))
    reps = member.filter("sig IS NOT NULL").select("id", "sig")

    bands = scratch.table("bands", reps.mapInArrow(_bands, "key long, id long"))
    shared = scratch.table("shared", bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    bucket = scratch.table("buckets", bands.join(shared, "key"))
    scratch.drop("bands", "shared")
    meets = bucket.groupBy("id").agg(F.sum("size").alias("meets"))
    bucket = scratch.table("ranked", bucket.join(meets, "id").select("key", "id", "meets"))
    scratch.drop("buckets")

    found = scratch.table("candidates", bucket.select("id").distinct())
    few = found.count() <= BROADCAST_IDS
    sets = scratch.table("sets", texts.join(F.broadcast(found) if few else found, "id", "left_semi").mapInArrow(_sets, "id long, shingles binary").groupBy("id").agg(F.min("shingles").alias("shingles")))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        return scratch.table(name, pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long"))

    links = spark.createDataFrame([], "a long, b long")
    label = F.coalesce("component", "id")
    comps = None
    left = bucket
    linked = True
    for turn in itertools.count():  # centers double, so a bucket of n members is through after about log2(n) rounds
        if comps is not None:
            left = left.drop("component").join(comps, "id", "left").withColumn("component", label)
        else:
            left = left.withColumn("component", F.col("id"))
        open_ = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max_by("id", F.struct("meets", -F.col("id"))).alias("center"), F.count(F.lit(1)).alias("size")).filter("lo < hi")
        open_ = scratch.table(f"open-{turn}", open_.select("key", "center", "size"))
        left = scratch.table(f"left-{turn}", left.join(open_, "key"))
        scratch.drop(f"left-{turn - 1}", f"open-{turn}")
        if left.isEmpty():
            break
        if not linked or turn == STAR_ROUNDS:
            links = links.union(_rest(left, sets, percent, scratch))
            comps = connected_components(links, scratch, f"cc-{turn}")
            break
        more = 2 ** (turn - 1) - 1 if turn else 0
        mid = (F.col("id") == F.col("center")) | (F.pmod(F.xxhash64("id", F.lit(turn)), F.col("size")) < more)
        heart = left.filter(mid).select("key", F.col("id").alias("hub"), F.col("component").alias("heart"))
        rim = left.join(heart, "key").filter("component <> heart")
        pairs = rim.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        found = confirmed(pairs, f"links-{turn}")
        linked = not found.isEmpty()
        left = left.filter(~mid).drop("center", "size")
        if linked:
            links = links.union(found)
            comps = connected_components(links, scratch, f"cc-{turn}")
    rows = member.select("id", "n", "rep")
    if comps is not None:
        rows = rows.join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        rows = rows.withColumn("component", F.lit(None).cast("long"))
    rows = rows.select("id", "n", F.coalesce("component", "rep").alias("component"))
    alone = seen.filter("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component"))
    out = rows.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The input's columns, of one document of each group: the one of smallest id, once even if its row repeats.

    Documents without shingles and rows with a null id belong to no group and stay.
    """
    scratch = Scratch(docs.sparkSession, "minhash-kept")
    (own,) = unused(docs.columns, "_id")
    found = near_duplicates(docs, id_col, text_col, percent).filter(f"`{id_col}` IS NOT NULL")
    found = scratch.table("found", found.groupBy(F.col(id_col).alias(own)).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")))

    def ids(condition: str, name: str) -> DataFrame:
        some = scratch.table(name, found.filter(condition).select(own))
        return F.broadcast(some) if some.count() <= BROADCAST_IDS else some

    here = docs[id_col].cast("long") == F.col(own)
    single = docs.join(ids("NOT kept OR rows > 1", "others"), here, "left_anti")
    if found.filter("kept AND rows > 1").isEmpty():
        return single
    return single.unionByName(docs.join(ids("kept AND rows > 1", "repeated"), here, "left_semi").dropDuplicates([id_col]))


def _rest(left: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links of the buckets that stars didn't resolve: every pair of different components, in pairs of blocks of about ``BLOCK`` members."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = left.join(sets, "id").select("key", "id", "component", "shingles", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    low = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    groups = low.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "shingles")
    return scratch.table("rest", groups.groupBy("key", "i", "j").applyInArrow(_block_links(percent), "a long, b long"))
