"""Versions of tables and what leads from one to the next, against plain Python and against the versions themselves."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest

from corvane.streaming import capture, changes

KINDS = {
    "health": "file string, composite double, bucket string",
    "diagnostics": "file string, id string, message string, line int",
    "capabilities": "capability string, available boolean, reason string",
    "notes": "id string, title string",
    "files": "path string, blob_sha string",
}


def test_captured(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, None), (None, "n", "n"), (5, "s", "t")], "k int, v string, w string")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (None, "n", "m"), (6, None, None), (5, "s", "t"), (5, "s", "t")], "k int, v string, w string")
    got = {r["k"]: (r["kind"], tuple(r["before"] or ()), tuple(r["after"] or ())) for r in capture.captured(old, new, ["k"]).collect()}
    assert got == {2: ("modify", ("b", "x"), ("b", None)), 3: ("remove", (None, None), ()), None: ("modify", ("n", "n"), ("n", "m")), 6: ("create", (), (None, None))}
    assert capture.captured(old.limit(0), new.limit(0), ["k"]).count() == 0
    assert {(r["k"], r["kind"]) for r in capture.captured(old.select("k"), new.select("k"), ["k"]).collect()} == {(3, "remove"), (6, "create")}


def version(rng):
    some = lambda n: rng.sample(range(6), rng.randint(0, n))
    return {
        "health": [(f"f{i}", rng.choice([0.1, 0.5, None]), "green") for i in some(6)],
        "diagnostics": [(f"f{rng.randint(0, 1)}", f"d{rng.randint(0, 2)}", rng.choice(["m", "größer \"x\"", None]), rng.randint(0, 1)) for _ in range(rng.randint(0, 9))],
        "capabilities": [(f"c{i}", rng.random() < 0.5, rng.choice(["none", "old"])) for i in range(4)],
        "notes": [(f"n{i}", rng.choice("ab")) for i in some(6)],
        "files": [(f"p{i}", rng.choice("xy")) for i in some(6)],
    }


def state(v):
    """A version in the shape of a folded state."""
    say = lambda **kw: json.dumps({k: x for k, x in kw.items() if x is not None}, ensure_ascii=False, separators=(",", ":"))
    out = [("healthUpdated", f, say(composite=c, bucket=b), None) for f, c, b in v["health"]] + [("notesUpdated", i, say(title=t), None) for i, t in v["notes"]]
    out += [("capability", c, say(available=a, reason="restored" if a else r), None) for c, a, r in v["capabilities"]]
    rows = [(f, say(id=i, message=m, line=n)) for f, i, m, n in v["diagnostics"]]
    return sorted(map(repr, out + [("diagnosticsUpdated", f, p, rows.count((f, p))) for f, p in set(rows)]))


@pytest.mark.parametrize("seed", [1, 2])
def test_events_lead_to_each_version(spark, tmp_path, seed):
    rng = random.Random(seed)
    versions = [{k: [] for k in KINDS}] + [version(rng) for _ in range(4)]
    tables = [{k: spark.createDataFrame(rows, KINDS[k]) for k, rows in v.items()} for v in versions]
    schema = capture.EVENTS + ", version long"
    for n, (old, new) in enumerate(zip(tables, tables[1:])):
        capture.events(old, new, 2).selectExpr("*", f"{n}L AS version").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        told = spark.read.schema(schema).parquet(f"{tmp_path}/events")
        assert sorted(repr((r["slot"], r["key"], r["payload"], r["copies"])) for r in capture.folded(told).collect()) == state(versions[n + 1])
        was, now = dict(versions[n]["files"]), versions[n + 1]["files"]
        total = sum(was.get(p) != s for p, s in now)
        ticks = sorted(json.loads(r["payload"])["filesDone"] for r in told.filter(f"type = 'indexProgress' AND version = {n}").collect())
        assert ticks == sorted({0, total, *range(2, total, 2)})
    stream = capture.folded(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"))
    q = stream.writeStream.format("memory").queryName(f"folded_{seed}").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(repr, map(tuple, spark.table(f"folded_{seed}").collect()))) == sorted(map(repr, map(tuple, capture.folded(told).collect())))
    assert capture.events(tables[1], tables[1]).filter("type <> 'indexProgress'").count() == 0


def test_watch_tells_changes_of_a_tree(spark, tmp_path):
    root, folder = tmp_path / "tree", f"file://{tmp_path}/watch"
    root.mkdir()
    steps = [{"a.py": "1", "b.rs": "1", "c.md": "1"}, {}, {"a.py": "2", "b.rs": None, "d.ts": "1"}, {"a.py": None, "d.ts": None}, {"a.py": "2"}]
    want = [{("a.py", "create"), ("b.rs", "create")}, set(), {("a.py", "modify"), ("b.rs", "remove"), ("d.ts", "create")}, {("a.py", "remove"), ("d.ts", "remove")}, {("a.py", "create")}]
    for files in steps:
        for name, text in files.items():
            (root / name).unlink() if text is None else (root / name).write_text(text)
        capture.watch(capture.listing(spark, str(root)), folder)
    told = spark.read.schema(capture.CHANGES).parquet(f"{folder}/changes")
    got = [{(r["path"], r["kind"]) for r in told.filter(f"version = {v}").collect()} for v in range(len(steps))]
    assert got == want and told.select("seq").distinct().count() == told.count()
    assert {r["path"] for r in changes.relevant(told).collect()} == {"a.py", "b.rs", "d.ts"}


def test_failed_look_is_done_again(spark, tmp_path):
    """A look that wrote its listing and its changes but no mark: its repetition tells the same, though the tree has changed, and a stream takes it once."""
    folder, kind = f"file://{tmp_path}/watch", "path string, blob_sha string"
    listed = lambda *names: spark.createDataFrame([(n, "x") for n in names], kind)
    assert capture.watch(listed("a.py"), folder) == 1
    spark.createDataFrame([("a.py", "x", datetime(2024, 1, 1, tzinfo=timezone.utc), 1), ("b.py", "x", datetime(2024, 1, 1, tzinfo=timezone.utc), 1)], capture.LISTING).write.mode("append").partitionBy("version").parquet(f"{folder}/listing")
    seq = (1 << 32) + 1
    spark.createDataFrame([(seq, "b.py", "create", datetime(2024, 1, 1, tzinfo=timezone.utc), 1)], capture.CHANGES).write.mode("append").partitionBy("version").parquet(f"{folder}/changes")
    assert capture.watch(listed("a.py", "b.py", "c.py"), folder) == 1  # the failed look's own change
    assert capture.watch(listed("a.py", "b.py", "c.py"), folder) == 1
    told = spark.read.schema(capture.CHANGES).parquet(f"{folder}/changes")
    assert sorted((r["version"], r["seq"], r["path"]) for r in told.collect()) == [(0, 1, "a.py"), (1, seq, "b.py"), (2, (2 << 32) + 1, "c.py")]


def test_bursts_over_batches_are_one(spark, tmp_path):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(k, "a.py" if k % 2 else "b.py", "remove" if k % 10 > 7 else "modify", at + timedelta(milliseconds=100 * k + (5000 if k > 9 else 0))) for k in range(20)]
    rows.append((99, "z.py", "modify", at + timedelta(hours=1)))
    for n, part in enumerate((rows[:7], rows[7:13], rows[13:])):  # the files cut both bursts
        spark.createDataFrame(part, changes.CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed = capture.debounced(spark.readStream.schema(changes.CHANGE).parquet(f"{tmp_path}/in"), "300 milliseconds", "1 minute")
        q = feed.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).outputMode("append").start(path=f"{tmp_path}/out", format="parquet")
        q.awaitTermination(120)
    got = sorted((r["path"], r["kind"], r["seq"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a.py", "remove", 9, 5), ("a.py", "remove", 19, 5), ("b.py", "remove", 8, 5), ("b.py", "remove", 18, 5)]
