"""The jobs: growing input, repeated batches, runs after a failure, odd rows, the command line."""

import datetime as dt
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.operators import gate
from jobs import change_digest, common, grounding_audit
from jobs.change_digest import ChangeDigest
from jobs.grounding_audit import GroundingAudit

LOG = "seq long, path string, kind string, ts timestamp"
START = dt.datetime(2024, 3, 1, 8, 0)


def log_rows(seed, first, n):
    rng = random.Random(seed)
    at = START + dt.timedelta(hours=20 * seed)
    rows = []
    for i in range(first, first + n):
        at += dt.timedelta(minutes=rng.choice((1, 5, 29, 30, 31, 200)))
        rows.append((i, rng.choice(("a.py", "b/c.rs", "d.tsx", "e.md", "node_modules/x.py", ".corvane/y.py")), rng.choice(("create", "modify", "modify", "remove", "access")), at))
    return rows


def brute_digest(rows, gap=dt.timedelta(minutes=30)):
    groups = defaultdict(list)
    for seq, path, kind, ts in rows:
        if ts and path in ("a.py", "b/c.rs", "d.tsx") and kind in ("create", "modify", "remove"):
            groups[ts.date(), path].append((seq, kind, ts))
    out = set()
    for (day, path), found in groups.items():
        times = sorted(t for _, _, t in found)
        bursts = 1 + sum(b - a > gap for a, b in zip(times, times[1:], strict=False))
        seq, kind, _ = max(found)
        out.add((path, kind, seq, len(found), bursts, times[0], times[-1], day))
    return out


def put(spark, rows, folder):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_digest_follows_a_growing_log(spark, tmp_path):
    s = ChangeDigest(str(tmp_path / "log"), str(tmp_path / "out"))
    first, second = log_rows(1, 0, 150), log_rows(9, 500, 60) + [(999, "a.py", "remove", START + dt.timedelta(days=1)), (1000, None, "modify", START), (1001, "a.py", None, START), (1002, "a.py", "modify", None)]
    put(spark, first, s.input)
    assert {tuple(r) for r in change_digest.run(spark, s).collect()} == brute_digest(first)
    before = files(tmp_path / "out" / "digest")
    put(spark, second, s.input)
    assert {tuple(r) for r in change_digest.run(spark, s).collect()} == brute_digest(first + second)
    # Only what the second batch touches was written again: its own days, and that of the late change.
    days = {r[-1] for r in brute_digest(second)}
    after = files(tmp_path / "out" / "digest")
    kept = {p for p in before if p in after and before[p] == after[p]}
    assert {p.parent.name for p in kept} == {p.parent.name for p in before} - {f"day={d}" for d in days}
    batches = spark.read.schema(change_digest.CHANGES).parquet(f"{s.output}/changes").groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["batch"] for r in batches} == {0, 1}
    # A third run finds nothing new and leaves everything as it is.
    assert {tuple(r) for r in change_digest.run(spark, s).collect()} == brute_digest(first + second)
    assert files(tmp_path / "out" / "digest") == after


def test_digest_batches_may_be_repeated(spark, tmp_path):
    s = ChangeDigest(str(tmp_path / "log"), str(tmp_path / "out"), files=1)
    parts = [log_rows(k, 100 * k, 40) for k in range(3)]
    for rows in parts:
        put(spark, rows, s.input)
    got = {tuple(r) for r in change_digest.run(spark, s).collect()}
    assert got == brute_digest(sum(parts, []))
    ids = [r["batch"] for r in spark.read.schema(change_digest.CHANGES).parquet(f"{s.output}/changes").select("batch").distinct().collect()]
    assert len(ids) == 3  # one file a batch
    for i in ids:
        own = spark.read.schema(change_digest.CHANGES).parquet(f"{s.output}/changes").filter(F.col("batch") == i).select("seq", "path", "kind", "ts").collect()
        change_digest.absorb(spark.createDataFrame(own, LOG), i, s)
    assert {tuple(r) for r in spark.read.schema(change_digest.DIGEST).parquet(f"{s.output}/digest").collect()} == got


def test_digest_of_a_batch_that_broke_off(spark, tmp_path, monkeypatch):
    s = ChangeDigest(str(tmp_path / "log"), str(tmp_path / "out"))
    rows = log_rows(4, 0, 50)
    put(spark, rows, s.input)
    with monkeypatch.context() as m:
        m.setattr(change_digest, "digest", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            change_digest.run(spark, s)
    assert {tuple(r) for r in change_digest.run(spark, s).collect()} == brute_digest(rows)


def test_digest_of_an_empty_log(spark, tmp_path):
    s = ChangeDigest(str(tmp_path / "log"), str(tmp_path / "out"))
    put(spark, [], s.input)
    assert change_digest.run(spark, s).count() == 0
    assert change_digest.run(spark, s).count() == 0


SUMMARIES = [
    (1, "Reads the ledger. It sends mail! And the end", "f", "en", "x"),
    (2, "Nothing known here.", "f", "en", "y"),
    (3, "reads THE Ledger", "f", None, None),
    (4, None, "f", "", "x"),
    (5, "  ", "f", "de", "x"),
    (6, "Reads the ledger.", "no such symbol", "de", "x"),
    (7, "Reads the ledger.", None, "1", "x"),
    (1, "Reads the ledger. It sends mail! And the end", "g", "en", "x"),
]
FACTS = [("f", "f1", "function reads ledger"), ("f", "f2", "calls mail"), ("f", "f0", None), ("g", "g1", "the end and all"), (None, "n", "ledger")]


def audit(spark, folder, floor=0.7):
    spark.createDataFrame(SUMMARIES, "doc_id long, text string, symbol string, lang string, source string").repartition(3).write.mode("overwrite").parquet(f"{folder}/summaries")
    spark.createDataFrame(FACTS, "symbol string, fact_id string, content string").write.mode("overwrite").parquet(f"{folder}/facts")
    return GroundingAudit(f"{folder}/summaries", f"{folder}/facts", f"{folder}/out", floor=floor)


def test_audit_tables(spark, tmp_path):
    s = audit(spark, tmp_path, 0.5)
    got = {(r["lang"], r["source"], r["summary"], r["claims"], r["supported"], r["low_confidence"]) for r in grounding_audit.run(spark, s).collect()}
    assert got == {
        ("en", "x", "1", 6, 3, False),  # both rows of this id: three sentences by each symbol's facts
        ("en", "y", "2", 1, 0, True),
        ("und", "und", "3", 1, 1, False),
        ("und", "x", "4", 0, 0, False),
        ("de", "x", "5", 0, 0, False),
        ("de", "x", "6", 1, 0, True),
        ("1", "x", "7", 1, 0, True),
    }
    claims = spark.read.schema(grounding_audit.CLAIMS).parquet(f"{s.output}/claims")
    first = claims.filter("summary = '1' AND entailed").select("claim", F.array_join("supporting_fact_ids", ",").alias("ids")).collect()
    assert sorted(map(tuple, first)) == [("And the end", "g1"), ("It sends mail!", "f2"), ("Reads the ledger.", "f1")]
    assert {p.name for p in (tmp_path / "out" / "claims").glob("lang=*")} == {"lang=en", "lang=und", "lang=de", "lang=1"}
    totals = {(r["lang"], r["source"]): (r["summaries"], r["claims"], r["supported"], r["low_confidence"]) for r in spark.read.parquet(f"{s.output}/totals").collect()}
    assert totals["de", "x"] == (2, 1, 0, 1)


def test_audit_runs_again_over_what_is_left(spark, tmp_path):
    s = audit(spark, tmp_path)
    spark.createDataFrame([("junk", "1", 0, "c", True, ["x"], "xx")], grounding_audit.CLAIMS).write.partitionBy("lang").parquet(f"{s.output}/claims")  # of a run that broke off
    one = sorted(map(tuple, grounding_audit.run(spark, s).collect()))
    assert sorted(map(tuple, grounding_audit.run(spark, s).collect())) == one
    assert all(r[0] != "junk" for r in one)


def test_audit_of_empty_tables(spark, tmp_path):
    s = audit(spark, tmp_path)
    spark.createDataFrame([], "doc_id long, text string, symbol string, lang string, source string").write.mode("overwrite").parquet(s.summaries)
    assert grounding_audit.run(spark, s).count() == 0


def test_verdicts_equal_the_gate_by_sentence(spark):
    rows = spark.createDataFrame([("Reads x1 ledger. Sends; mail!", [("a", "ledger"), ("b", "sends mail"), ("c", None)])], "text string, facts array<struct<id:string,content:string>>")
    got = [(r["ord"], r["claim"], r["entailed"], r["supporting_fact_ids"], r["reason"]) for r in gate.gated(rows, "text", "facts").collect()]
    assert got == [(0, "Reads x1 ledger.", True, ["a"], None), (1, "Sends; mail!", True, ["b"], None)]


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"summaries": "s", "facts": "f", "output": "o", "floor": 0.25}))
    s = common.settings_of(GroundingAudit, spark, str(tmp_path / "c.json"), {"output": "elsewhere", "facts": None})
    assert (s.summaries, s.facts, s.output, s.floor) == ("s", "f", "elsewhere", 0.25)
    with pytest.raises(ValueError, match="no such setting: flour"):
        common.settings_of(GroundingAudit, spark, None, {"flour": "1"})
    for kind, name in ((GroundingAudit, "grounding_audit"), (ChangeDigest, "change_digest")):
        assert common.settings_of(kind, spark, f"jobs/{name}.json", {}).output.startswith("/shared/")


def test_command_line(spark, tmp_path, monkeypatch):
    s = ChangeDigest(str(tmp_path / "log"), str(tmp_path / "out"))
    put(spark, log_rows(2, 0, 20), s.input)
    stopped = []

    class Kept:
        """The session of the tests, which this command line must not end."""

        def __getattr__(self, name):
            return (lambda: stopped.append(True)) if name == "stop" else getattr(spark, name)

    monkeypatch.setattr(common, "session", lambda name: Kept())
    common.main(ChangeDigest, lambda own, got: change_digest.run(spark, got), "", ["--config", "jobs/change_digest.json", "--input", s.input, "--output", s.output, "--files", "5"])
    assert stopped and spark.read.schema(change_digest.DIGEST).parquet(f"{s.output}/digest").count() > 0
