"""Near-duplicates of documents and embeddings, and components."""

import math
import random

import numpy as np
import pytest

from corvane.llm import collisions, minhash
from corvane.llm.components import connected_components
from corvane.llm.scratch import Scratch
from tests.llm import brute, data


def _found(df, key="doc_id"):
    return sorted(((r[key], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_near_duplicates_equal_all_pairs(spark):
    rows = data.documents()
    df = data.clashing(spark.createDataFrame(rows, data.DOCS))
    out = minhash.near_duplicates(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert _found(out) == brute.near_duplicates([(i, t) for i, t, *_ in rows])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_near_duplicates_odd_rows(spark):
    rows = [(3, "x y z"), (3, "x y z"), (None, "x y z"), (None, None), (7, "X y Z"), (9, None), (1, "q " * 30000), (2, "Q " * 30000)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert _found(out) == sorted([(3, 1, 3), (3, 1, 3), (None, 1, None), (None, 0, None), (7, 1, 3), (9, 0, 9), (1, 1, 1), (2, 1, 1)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_families_are_resolved_whatever_the_way(spark, monkeypatch):
    """A family whose members link only partly: by stars, and without any star by blocks."""
    rng = random.Random(3)
    base = data.prose(rng, 120).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            w[rng.randrange(len(w))] = data.word(rng)
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_duplicates(rows)
    assert len({c for _, _, c in want}) > 1
    assert _found(minhash.near_duplicates(df)) == want
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    assert _found(minhash.near_duplicates(df)) == want
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    assert _found(minhash.near_duplicates(df)) == want


def test_kept_documents(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (4, "q r s"), (4, "q r s"), (None, "a b"), (5, None)]
    out = minhash.kept_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a b c d e f"), (4, "q r s"), (None, "a b"), (5, None)], key=str)
    names = ("_id", "__id", "kept", "rows", "id", "component", "n")
    clashing = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"'{c}' AS {c}" for c in names))
    again = minhash.kept_documents(clashing)
    assert again.columns == clashing.columns and sorted(map(str, again.select("doc_id", "text").collect())) == sorted(map(str, out.collect()))


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from corvane.llm import scratch

    unset = {}
    conf = SimpleNamespace(get=lambda k, d=None: unset.get(k, d), set=unset.__setitem__)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(cluster)
    assert not unset
    assert scratch.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file:")
    unset["spark.checkpoint.dir"] = "hdfs://shared/c/"
    assert scratch.shared_dir(cluster) == "hdfs://shared/c"


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (8000, 1000, 1000))
    s = minhash.signatures([np.unique(np.concatenate((shared, a))), np.unique(np.concatenate((shared, b)))])
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.2


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(5, 5), (3, 2), (2, 3), (2, 3)]
    rng.shuffle(links)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == brute.components({x for pair in links for x in pair}, links)
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


VECS = "vec_id long, embedding array<float>, label int"


def _vectors(n=240, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i >= 8 and rng.random() < 0.5:
            v = np.array(rows[int(rng.integers(0, len(rows)))][1]) + rng.normal(0, rng.choice([0.0, 0.03, 0.08, 0.1]), dim)
        else:
            v = rng.normal(0, 1, dim)
            v /= np.linalg.norm(v)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
    return rows


def _links(rows, cosine=0.93):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = []
    for k, (a, v, x) in enumerate(rows):
        for b, w, y in rows[k + 1 :]:
            if x is not None and x == y and ok(v) and ok(w) and len(v) == len(w):
                p, q = np.array(v, float), np.array(w, float)
                if p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= cosine:
                    links.append((a, b))
    return links


def _expected(rows):
    links = _links(rows)
    comp = brute.components({r[0] for r in rows}, links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return sorted((i, n[i], comp[i]) for i in n)


@pytest.mark.parametrize("block,level", [(512, 50_000), (16, 50_000), (512, 20)])
def test_embeddings_equal_all_pairs(spark, monkeypatch, block, level):
    monkeypatch.setattr(collisions, "BLOCK", block)
    monkeypatch.setattr(collisions, "LEVEL", level)  # a small level makes deeper cells and more tables
    rows = _vectors()
    df = data.clashing(spark.createDataFrame(rows, VECS)).drop("label2")
    out = collisions.near_duplicates(df)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()) == _expected(rows)


@pytest.mark.parametrize("ball,block", [(4, 512), (4, 8), (2, 16)])
def test_tight_groups_equal_all_pairs(spark, monkeypatch, ball, block):
    """Groups so tight that all their members link, groups that only partly do, and vectors about them."""
    monkeypatch.setattr(collisions, "BALL", ball)
    monkeypatch.setattr(collisions, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = []
    for center, (many, noise) in enumerate([(70, 0.02), (40, 0.05), (40, 0.07), (30, 0.09), (20, 0.12)]):
        c = rng.normal(0, 1, 12)
        for _ in range(many):
            v = c / np.linalg.norm(c) + rng.normal(0, noise, 12)
            rows.append((len(rows), [float(np.float32(x)) for x in v], center % 2))
    rows += [(1000 + k, v, label) for k, (_, v, label) in enumerate(rows[:9])]  # equal vectors
    out = collisions.near_duplicates(spark.createDataFrame(rows, VECS))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()) == _expected(rows)


def test_embedding_odd_rows(spark):
    one = [1.0, 0.0, 2.0]
    rows = [(1, one, 0), (2, [2.0, 0.0, 4.0], 0), (3, one, 0), (4, one, 1), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [None, 1.0, 0.0], 0), (8, [float("nan"), 1.0, 0.0], 0), (9, [float("inf"), 1.0, 0.0], 0), (10, one, None), (11, [1.0, 0.0], 0), (12, [1.0, 0.0], 0), (13, [], 0), (14, [1e-30, 0.0, 2e-30], 0), (15, [1e30, 0.0, 2e30], 0)]
    out = collisions.near_duplicates(spark.createDataFrame(rows, VECS))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()) == _expected(rows)
    assert collisions.near_duplicates(spark.createDataFrame([], VECS)).count() == 0


def test_recall_of_the_count_at_the_limit():
    """Pairs exactly at the limit reach the least count, and share a cell, as often as calibrated."""
    rng = np.random.default_rng(3)
    n, dim = 4000, 32
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=(n, dim))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * o
    lines = rng.normal(size=(dim, collisions.LINES))
    met = (np.abs(a @ lines - b @ lines) <= math.sqrt(2 - 2 * 0.93)).sum(1)
    assert (met >= collisions.least_count()).mean() >= 0.999
    depth, tables = collisions.layout(10_000_000, 0.93)
    assert depth == 3 and tables > 12
    poles = rng.normal(size=(dim, collisions.POLES))
    assert (collisions._pole(a @ poles) == collisions._pole(b @ poles)).mean() >= collisions.cell_chance(0.93) - 0.03


def test_collisions_count_windows():
    rng = np.random.default_rng(4)
    q, t = rng.normal(size=(20, 5)), rng.normal(size=(30, 5))
    want = (np.abs(q[:, None, :] - t[None, :, :]) <= 0.4).sum(2)
    assert (collisions.collisions(q, t, 0.4) == want).all()


def test_kept_documents_at_80_percent(spark):
    """Two changed words of 100 leave a similarity of 0.81, three 0.73."""
    rng = random.Random(11)
    rows = []
    for k in range(15):
        base = [f"w{k}x{i}" for i in range(100)]
        for changed in ((), (20, 60), (20, 50, 80)):
            rows.append((len(rows), " ".join(f"new{rng.random()}" if i in changed else w for i, w in enumerate(base))))
    want = {i for i, _, c in brute.near_duplicates(rows, 80) if i == c}
    assert len(want) == 30 and len({c for *_, c in brute.near_duplicates(rows, 85)}) == 45
    got = minhash.kept_documents(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)
    assert {r.doc_id for r in got.collect()} == want


def test_bands_suit_the_limit():
    for percent in (70, 80, 85, 90):
        bands = minhash.permutations(percent) // minhash.BAND_PERMUTATIONS
        assert (1 - (percent / 100) ** (2 * minhash.BAND_PERMUTATIONS)) ** bands <= 1e-5
    assert minhash.permutations(85) == 32


def test_signature_filter_loses_less_than_the_bands():
    for percent in (80, 85):
        s, values = percent / 100, 2 * minhash.permutations(percent)
        need = math.ceil((s - minhash.SLACK) * values)
        lost = sum(math.comb(values, k) * s**k * (1 - s) ** (values - k) for k in range(need))
        assert lost < (1 - s**4) ** (minhash.permutations(percent) // 2)
