"""Near-duplicate embeddings by counting collisions in sorted one-dimensional projections.

Vectors of one label are dealt into cells: each of several tables gives a vector the largest (signed)
of ``POLES`` random projections, ``depth`` times over.  The depth follows the size of the largest label so that
cells stay small, and the number of tables follows the depth so that two vectors at the limit share no
cell with a probability of at most ``MISS``.

Within a cell, ``LINES`` projections are sorted.  A query's window on a line reaches one standard deviation of the difference
of two vectors at the limit to either side; a pair's collisions are the lines on whose windows it meets.  Pairs
with at least the count that a pair at the limit misses with a probability of at most ``MISS`` are verified by
their cosine in double precision.  A pair that meets in several tables counts in the first of them.

A large cell is worked off in pairs of blocks, and a task reports sums for each vector, never pairs.

Tight groups are not compared within themselves.  Where many vectors share their cells in the first two tables, those that lie
within half the limit's angle of their mean are a *ball*: by the triangle inequality all its members link.  So do the members of two balls whose
distance and radii add up to no more than the limit's angle.  These links are counted by size, and
blocks of such balls are not paired; balls meet all other blocks of their cells as anyone does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.llm.scratch import Scratch

POLES = 32
LINES = 48
BLOCK = 512
MISS = 1e-4
#: Vectors of a label for which one level of cells is enough.
LEVEL = 50_000
SEED = 20_240
#: Vectors that share two cells before a ball is tried.
BALL = 64
#: Angle by which the certain side of a bound is kept clear of rounding.
MARGIN = 1e-6


def _normal_share(z: float) -> float:
    return math.erf(z / math.sqrt(2))


def least_count(lines: int = LINES, miss: float = MISS) -> int:
    """The largest count that a pair at the limit, which meets on a line with the chance of one standard deviation, reaches but with the probability ``miss``."""
    p, below = _normal_share(1.0), 0.0
    for k in range(lines + 1):
        below += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > miss:
            return k
    return lines


def cell_chance(cosine: float, draws: int = 100_000) -> float:
    """Chance that two vectors of this cosine fall into one cell of one level, less four standard errors."""
    r = np.random.default_rng(SEED)
    a = r.standard_normal((draws, POLES))
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine**2)) * r.standard_normal((draws, POLES))
    p = float((_pole(a) == _pole(b)).mean())
    return p - 4 * math.sqrt(p * (1 - p) / draws)


def layout(largest: int, cosine: float) -> tuple[int, int]:
    """Depth of the cells and number of tables for labels of at most so many vectors."""
    depth = 1 + max(0, math.ceil(math.log(max(largest, 1) / LEVEL, 2 * POLES)))
    p = cell_chance(cosine) ** depth
    return depth, max(1, math.ceil(math.log(MISS) / math.log(1 - p)))


def _pole(x: np.ndarray) -> np.ndarray:
    """Index of the entry of largest size along the last axis, with its sign."""
    at = np.abs(x).argmax(-1)
    return 2 * at + (np.take_along_axis(x, at[..., None], -1)[..., 0] < 0)


def _placed(depth: int, tables: int):
    """(id, label, copies, v) → unit vectors in double precision with their cell in each table; other vectors are dropped."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poles: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column(3)
            size = raw.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                v = raw.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
                scale = np.abs(v).max(1, keepdims=True)
                v = v / scale
                v /= np.sqrt((v * v).sum(1, keepdims=True))
                if dim not in poles:
                    poles[dim] = np.random.default_rng([SEED, int(dim)]).standard_normal((tables * depth * POLES, dim))
                for at in range(0, len(rows), 1000):
                    part = v[at : at + 1000]
                    cell = np.zeros((len(part), tables), np.int64)
                    pole = _pole((part @ poles[dim].T).reshape(len(part), tables, depth, POLES))
                    for k in range(depth):
                        cell = cell * (2 * POLES) + pole[:, :, k]
                    cell = cell * 31 + dim  # vectors of another length never meet
                    keep = batch.take(pa.array(rows[at : at + 1000]))
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables), pa.array(cell.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*keep.columns[:3], pa.array([x.tobytes() for x in part], pa.binary()), cells], ["id", "label", "copies", "v", "cells"])

    return placed


def collisions(query: np.ndarray, target: np.ndarray, width: float) -> np.ndarray:
    """For each query and target, the number of lines (columns) on which the target lies in the query's window."""
    n, m = len(query), len(target)
    count = np.zeros(n * m, np.int32)
    for line in range(query.shape[1]):
        order = np.argsort(target[:, line])
        ranked = target[order, line]
        lo = np.searchsorted(ranked, query[:, line] - width, "left")
        hi = np.searchsorted(ranked, query[:, line] + width, "right")
        each = hi - lo
        inside = np.arange(each.sum()) + np.repeat(lo - (np.cumsum(each) - each), each)
        count += np.bincount(np.repeat(np.arange(n) * m, each) + order[inside], minlength=n * m).astype(np.int32)
    return count.reshape(n, m)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ball, v) → the sum of the vectors of each ball in a batch."""
    for batch in batches:
        ball = np.asarray(batch.column(0))
        raw = batch.column(1).to_pylist()
        for f in np.unique(ball):
            rows = np.flatnonzero(ball == f)
            total = np.frombuffer(b"".join(raw[k] for k in rows), np.float64).reshape(len(rows), -1).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([total.tobytes()], pa.binary())], ["ball", "v"])


def _center(table: pa.Table) -> pa.Table:
    """The direction of a ball's mean; its rows are one for each batch that had members."""
    total = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(table.num_rows, -1).sum(0)
    size = float(np.sqrt(total @ total))
    return pa.table({"ball": table.column("ball").slice(0, 1), "center": pa.array([(total / size if size else total).tobytes()], pa.binary())})


def _angles(limit: float, given: int):
    """Keeps rows whose last two columns, both vectors, enclose an angle that with the column ``radii`` (0 if there is none) is at most ``limit``; passes ``given`` columns on, and the angle."""

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column(batch.num_columns - 1).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()
            dot = [float(np.frombuffer(p) @ np.frombuffer(q)) for p, q in zip(x, y, strict=True)]
            angle = np.arccos(np.clip(dot, -1, 1))
            radii = np.asarray(batch.column("radii")) if "radii" in batch.schema.names else 0.0
            keep = pa.array(angle + radii <= limit - MARGIN)
            out = [*batch.columns[:given], pa.array(angle)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in out], [*batch.schema.names[:given], "angle"])

    return angles


def _linked(cosine: float):
    """One pair of blocks of one cell: links of each vector (with copies) and the smallest id it hangs together with here."""
    width, least = math.sqrt(2 - 2 * cosine), least_count()

    def linked(table: pa.Table) -> pa.Table:
        turn, alone = table.column("turn")[0].as_py(), table.column("alone")[0].as_py()
        ids, side, copies = (np.asarray(table.column(c)) for c in ("id", "side", "copies"))
        v = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(len(ids), -1)
        cells = np.asarray(table.column("cells").combine_chunks().flatten()).reshape(len(ids), -1)
        lines = v @ np.random.default_rng([SEED + 1, v.shape[1]]).standard_normal((v.shape[1], LINES))
        first = np.flatnonzero(side == 0)
        second = first if alone else np.flatnonzero(side == 1)
        a, b = np.nonzero(collisions(lines[first], lines[second], width) >= least)
        a, b = first[a], second[b]
        if alone:
            a, b = a[ids[a] < ids[b]], b[ids[a] < ids[b]]
        keep = []
        for at in range(0, len(a), 100_000):
            x, y = a[at : at + 100_000], b[at : at + 100_000]
            keep.append((np.einsum("ij,ij->i", v[x], v[y]) >= cosine) & ~(cells[x, :turn] == cells[y, :turn]).any(1))
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        a, b = a[keep], b[keep]
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        low = rank.copy()
        while True:
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            if (new == low).all():
                break
            low = new
        some = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some].astype(np.int64)), "low": pa.array(np.sort(ids)[low[some]], pa.int64())})

    return linked


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """Link vectors of equal label whose cosine is at least ``cosine``.

    Returns ``(id_col, n_links, component_id, kept)``, one row for each input row.  A vector that is null, empty, zero or holds a null or
    non-finite component, a null label and a null id link with nothing, and are kept.  Vectors of different lengths
    never link.  Equal vectors are one class with its number of copies; they are compared once, and each copy's
    links count the other copies.  A row that repeats with its id is a copy like any other; an id should name one vector: of
    rows that share id and label but not the vector, the smallest vector is compared for all.  An empty table gives an empty table.
    """
    scratch = Scratch(vectors.sparkSession, "collisions")
    v = F.col(vector_col).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    able = sound & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"), able.alias("sound"))
    rows = scratch.table("rows", rows.withColumns({"d1": F.xxhash64("v"), "d2": F.xxhash64(F.lit(1), "v")}))
    able = rows.filter("sound")
    largest = able.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth, tables = layout(int(largest), cosine)

    key = ["label", "d1", "d2"]
    classes = scratch.table("classes", able.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    member = able.select("id", "v", *key).join(classes, key, "left").select("id", "label", "v", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    member = scratch.table("members", member)
    reps = member.filter("id = rep").groupBy("id", "label").agg(F.min(F.struct("v", "copies")).alias("one")).select("id", "label", "one.copies", "one.v")
    kind = reps.schema["label"].dataType.simpleString()
    placed = scratch.table("placed", reps.mapInArrow(_placed(depth, tables), f"id long, label {kind}, copies long, v binary, cells array<long>"))

    placed = _balled(placed, cosine, scratch)
    balls = placed.filter("ball <> 0").groupBy("label", "ball").agg(F.min("id").alias("low"), F.sum("copies").alias("weight"), F.max("angle").alias("radius"))
    balls = scratch.table("balls", balls.join(scratch.read("centers"), "ball"))
    near = _certain(placed, balls, cosine, scratch)
    reach = near.select("ball", "weight2").unionByName(balls.select("ball", F.col("weight").alias("weight2"))).groupBy("ball").agg(F.sum("weight2").alias("reach"))
    inside = placed.filter("ball <> 0").select("id", "ball", "copies").join(reach, "ball").join(balls.select("ball", "low"), "ball")
    inside = inside.select("id", (F.col("reach") - F.col("copies")).alias("links"), "low")

    cell = ["label", "turn", "cell"]
    spread = placed.select("*", F.posexplode("cells").alias("turn", "cell"))
    sizes = scratch.table("sizes", spread.groupBy(*cell, "ball").agg(F.count(F.lit(1)).alias("size")))
    shared = sizes.groupBy(*cell).agg(F.sum("size").alias("all")).filter("all > 1").drop("all")
    sizes = sizes.join(shared, cell).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    blocks = sizes.select(*cell, "ball", F.explode(F.expr("sequence(0, blocks - 1)")).alias("k")).select(*cell, F.struct("ball", "k").alias("b"))
    pairs = blocks.withColumnRenamed("b", "i").join(blocks.withColumnRenamed("b", "j"), cell).filter("i <= j AND NOT (i.ball <> 0 AND i.ball = j.ball)")
    sure = near.select(F.least("ball", "ball2").alias("s1"), F.greatest("ball", "ball2").alias("s2")).distinct()
    pairs = pairs.join(sure, (F.col("i.ball") == F.col("s1")) & (F.col("j.ball") == F.col("s2")), "left_anti")
    pairs = scratch.table("pairs", pairs.withColumn("pair", F.monotonically_increasing_id()))
    dealt = spread.join(sizes.select(*cell, "ball", "blocks"), [*cell, "ball"])
    dealt = dealt.withColumn("b", F.struct("ball", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("k"))).select(*cell, "b", "id", "copies", "v", "cells")
    alone = F.col("i") == F.col("j")
    one = pairs.select(*cell, F.col("i").alias("b"), "pair", F.lit(0).alias("side"), alone.alias("alone"))
    two = pairs.filter("i <> j").select(*cell, F.col("j").alias("b"), "pair", F.lit(1).alias("side"), F.lit(False).alias("alone"))
    groups = dealt.join(one.unionByName(two), [*cell, "b"]).select("pair", "turn", "side", "alone", "id", "copies", "v", "cells")
    found = scratch.table("found", groups.groupBy("pair").applyInArrow(_linked(cosine), "id long, links long, low long").unionByName(inside))

    sums = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    joined = near.join(balls.select("ball", F.col("low").alias("a")), "ball").join(balls.select(F.col("ball").alias("ball2"), F.col("low").alias("b")), "ball2").select("a", "b")
    edges = found.filter("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).unionByName(joined)
    comps = connected_components(edges, scratch)
    per_rep = scratch.table("per_rep", sums.join(comps.withColumnRenamed("id", "rep"), "rep", "full"))
    linked = member.select("id", "rep", "copies").join(per_rep, "rep", "left").select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    alone = rows.filter("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _balled(placed: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """Adds ``ball`` (0 for none) and the ``angle`` to its center; writes the table ``centers(ball, center)``."""
    second = F.get("cells", F.lit(1))
    keyed = placed.withColumn("ball", F.xxhash64("label", F.get("cells", F.lit(0)), F.coalesce(second, F.lit(0))))
    full = scratch.table("full", keyed.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= BALL).drop("n"))
    tight = keyed.join(full, "ball").select("ball", "v")
    centers = scratch.table("centers", tight.mapInArrow(_sums, "ball long, v binary").groupBy("ball").applyInArrow(_center, "ball long, center binary"))
    half = math.acos(cosine) / 2
    kind = placed.schema["label"].dataType.simpleString()
    member = keyed.join(centers, "ball").select("id", "label", "ball", "v", "center").mapInArrow(_angles(half, 3), f"id long, label {kind}, ball long, angle double")
    member = scratch.table("tight", member)
    out = placed.join(member, ["id", "label"], "left").withColumn("ball", F.coalesce("ball", F.lit(0).cast("long")))
    return scratch.table("balled", out)


def _certain(placed: DataFrame, balls: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """``(ball, ball2, weight2)``, both ways: balls of a label that share a cell and all of whose members link."""
    where = placed.filter("ball <> 0").select("label", "ball", F.posexplode("cells").alias("turn", "cell")).distinct()
    both = where.join(where.withColumnRenamed("ball", "ball2"), ["label", "turn", "cell"]).filter("ball < ball2").select("ball", "ball2").distinct()
    left = balls.select("ball", F.col("radius").alias("r1"), F.col("center").alias("c1"))
    right = balls.select(F.col("ball").alias("ball2"), F.col("radius").alias("r2"), F.col("center").alias("c2"))
    tested = both.join(left, "ball").join(right, "ball2").select("ball", "ball2", (F.col("r1") + F.col("r2")).alias("radii"), "c1", "c2")
    sure = tested.mapInArrow(_angles(math.acos(cosine), 2), "ball long, ball2 long, angle double").select("ball", "ball2")
    ways = sure.unionByName(sure.select(F.col("ball2").alias("ball"), F.col("ball").alias("ball2")))
    return scratch.table("certain", ways.join(balls.select(F.col("ball").alias("ball2"), F.col("weight").alias("weight2")), "ball2").select("ball", "ball2", "weight2"))
