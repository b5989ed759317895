"""Commits chosen by a threshold, and names followed through renames, against plain Python."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from corvane.sources import churn

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)


@pytest.mark.parametrize("limit", [0, 1, 7, 40, 199, 200, 500])
def test_newest_equals_sorting(spark, limit):
    """Many rows share an hour, a second or a time."""
    rng = random.Random(limit)
    rows = [(i, NOW - timedelta(seconds=rng.choice([0, 0.25, 0.5, 1, 30, 3600, 7200, 90000]))) for i in range(200)]
    table = spark.createDataFrame(rows + [(900, None)], "commit long, ts timestamp")
    want = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)[:limit]
    assert sorted(r["commit"] for r in churn.newest(table, "ts", "commit", limit).collect()) == sorted(r[0] for r in want)


def history(seed):
    """Files that are made, changed, renamed (also to names that others gave up, in rings too) and removed: changes with the file they belong to."""
    rng, files, changes, renames, gone = random.Random(seed), {f"n{i}": i for i in range(4)}, [], [], []
    for seq in range(1, 60):
        if rng.random() < 0.5 and files:
            old = rng.choice(sorted(files))
            free = [n for n in [f"n{i}" for i in range(8)] if n not in files]
            if rng.random() < 0.2 and len(files) > 1:  # two files swap their names in one commit
                other = rng.choice(sorted(set(files) - {old}))
                renames += [(seq, old, other), (seq, other, old)]
                files[old], files[other] = files[other], files[old]
            elif free:
                new = rng.choice(free)
                renames.append((seq, old, new))
                files[new] = files.pop(old)
        for name in sorted(files):
            if rng.random() < 0.4:
                changes.append((name, seq, files[name]))
    return files, changes, renames


@pytest.mark.parametrize("seed", range(4))
def test_moved_follows_files(spark, seed):
    files, changes, renames = history(seed)
    now = {of: name for name, of in files.items()}
    rows = spark.createDataFrame([c[:2] for c in changes], "path string, seq long")
    got = churn.moved(rows, spark.createDataFrame(renames, "seq long, old_path string, path string"))
    assert sorted((r["path"], r["seq"], r["now"]) for r in got.collect()) == sorted((p, s, now[of]) for p, s, of in changes)


def test_moved_reads_its_rows_once(spark):
    """Rows may be costly to make, so they are written once; other columns stay, and rows without a name or a place are kept."""
    seen = spark.sparkContext.accumulator(0)
    renames = spark.createDataFrame([(2, "a", "b"), (5, "b", "c"), (7, "c", "d")], "seq long, old_path string, path string")

    def read(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("b", 3, 12), ("b", 5, 13), (None, 3, 14), ("c", None, 15)], "path string, seq int, loc int")
    got = churn.moved(rows.mapInArrow(read, rows.schema), renames)
    assert got.columns == ["path", "seq", "loc", "now"]
    assert sorted((r["loc"], r["now"]) for r in got.collect()) == [(10, "d"), (11, "d"), (12, "d"), (13, "b"), (14, None), (15, "c")]
    assert seen.value == 6


def test_collect(spark):
    commits = [(1, 1, NOW - timedelta(days=20), False), (2, 2, NOW - timedelta(days=14), None), (3, 3, NOW - timedelta(days=3), True), (4, 4, NOW - timedelta(days=2), False), (5, 5, NOW - timedelta(days=1), False), (6, 6, NOW, False)]
    diffs = [(1, "src/a", None, 100, 0), (2, "src/a", None, 1, 1), (3, "src/a", None, 50, 0), (4, "src/b", "src/a", 3, 0), (4, "bin", None, None, None), (5, "src/c", "src/b", 0, 4), (5, "doc", None, 9, 9), (6, "doc", None, 1, 0), (6, "src/c", None, None, None)]
    commits = spark.createDataFrame(commits, "commit long, seq long, ts timestamp, merge boolean")
    diffs = spark.createDataFrame(diffs, "commit long, path string, old_path string, added long, deleted long")
    read = lambda **how: {r["path"]: r["churn_loc"] for r in churn.collect(commits, diffs, NOW, **how).collect()}
    assert read() == {"src/a": 2, "src/b": 3, "src/c": 4, "doc": 19}
    assert read(follow=True) == {"src/c": 9, "doc": 19}
    assert read(under="src/", limit=2) == {"src/c": 4}  # the binary change counts as a commit that touches the folder
    assert read(limit=1) == {"doc": 1}
    assert churn.collect(commits.limit(0), diffs, NOW, follow=True).count() == 0
