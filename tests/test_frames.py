"""Byte streams of language servers: however they are cut, delivered and spread over batches, a session gives what reading it at once gives."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest

from corvane.sources import reports
from corvane.streaming import frames

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def frame(body, header="Content-Length: {}\r\n\r\n"):
    raw = body if isinstance(body, bytes) else json.dumps(body, ensure_ascii=False).encode()
    return header.format(len(raw)).encode() + raw


def entry(line, code, message):
    return {"range": {"start": {"line": line, "character": 0}, "end": {"line": line, "character": 1}}, "severity": 2, "code": code, "message": message}


def publish(file, *entries):
    return {"jsonrpc": "2.0", "method": "textDocument/publishDiagnostics", "params": {"uri": f"file:///w/{file}", "diagnostics": list(entries)}}


def talk(rng, opening=True):
    """Frames of a session, with what no reader may stumble over."""
    out = [frame(publish("early.rs", entry(1, "E0", "before it opens")))]
    if opening:
        out.append(frame({"id": 1, "result": {}}, "Content-Type: x\r\nContent-Length: {}\r\n\r\n"))
    for i in range(rng.randint(1, 12)):
        out.append(frame(publish(f"f{rng.randint(0, 2)}.rs", *(entry(rng.randint(0, 2), f"E{rng.randint(0, 1)}", f"größer {i}.{j}") for j in range(rng.randint(0, 3))))))
        out += rng.choice([[], [frame(b"{not json")], [frame(b"")], [frame({"id": 7, "method": "textDocument/publishDiagnostics"})], [frame(b'"Content-Length: 3\\r\\n\\r\\n"')], [frame(publish("odd.rs", 5, {"message": "nowhere"}), "Content-Length:{}\n\n")], [frame([1])]])
    if rng.random() < 0.3:
        out.append(b"Content-Type: none\r\n\r\n" + frame(publish("late.rs", entry(1, "E9", "after the end"))))
    return out


def cut(rng, data):
    at = sorted({0, len(data), *(rng.randint(0, len(data)) for _ in range(rng.randint(0, 30)))})
    return [data[a:b] for a, b in zip(at, at[1:])]


def sessions(seed, n=12):
    """Rows of chunks, and what plain reading of the chunks' joined bytes gives: a frame counts if the chunk that ends it comes within 15 s of the opening."""
    rng, rows, want = random.Random(seed), [], set()
    for s in range(n):
        parts, name = talk(rng, opening=s % 5 != 4), f"s{s}"
        pieces = cut(rng, b"".join(parts))
        ends, size, times, at = [], 0, [], START + timedelta(seconds=rng.randint(0, 30))
        for k, piece in enumerate(pieces):
            size += len(piece)
            ends.append(size)
            times.append(at)
            rows.append((name, k, piece, at, k == len(pieces) - 1 and s % 3 == 0))
            at += timedelta(milliseconds=rng.choice([0, 10, 3000]))
        place, opened, latest = 0, None, {}
        for n_, part in enumerate(parts):
            if part.startswith(b"Content-Type: none"):
                break
            place += len(part)
            when = next(t for e, t in zip(ends, times) if e >= place)
            if when >= (opened + timedelta(seconds=15) if opened else times[0] + timedelta(seconds=10)):
                break
            try:
                said = json.loads(part.replace(b"\r\n\r\n", b"\n\n", 1).split(b"\n\n", 1)[1])
            except ValueError:
                continue
            if not isinstance(said, dict):
                continue
            if said.get("id") == 1 and opened is None:
                opened = when
            elif opened and "id" not in said:
                for k, e in enumerate(said["params"]["diagnostics"]):
                    if isinstance(e, dict):
                        line = e["range"]["start"]["line"] if "range" in e else None
                        latest[said["params"]["uri"][10:], line, e.get("code", "rust-analyzer")] = e["message"]
        want |= {(name, *key, message) for key, message in latest.items()}
    return rows, want


def found(entries):
    rows = reports.rust_analyzer(entries, root="/w", session="session", at=("n", "k"))
    return {(r["session"], r["file"], r["range"]["start"]["line"], r["code"], r["message"]) for r in rows.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_table_equals_plain_reading(spark, seed):
    rows, want = sessions(seed)
    assert want
    random.Random(seed).shuffle(rows)
    again = rows + rows[::3] + [("s0", None, b"x", START, False), (None, 0, b"x", START, False), ("s0", 0, b"x", None, False)]
    distinct = spark.createDataFrame(again, frames.CHUNKS).repartition(3)
    assert found(frames.published(distinct)) == want


def test_gap_stops_a_session_and_empty_tables(spark):
    data = frame({"id": 1}) + frame(publish("a.rs", entry(0, "A", "x"))), frame(publish("b.rs", entry(0, "B", "y")))
    rows = [("s", 0, data[0], START, False), ("s", 2, data[1], START, True), ("t", 0, None, START, None)]
    chunks = spark.createDataFrame(rows, frames.CHUNKS)
    assert {r[1] for r in found(frames.published(chunks))} == {"a.rs"}
    assert found(frames.published(chunks.limit(0))) == set()


def test_a_task_sorts_a_bounded_share(spark, monkeypatch):
    """Sessions are dealt out by the number of their chunks, not by their size in the shuffle."""
    monkeypatch.setattr(frames, "CHUNKS_A_TASK", 10)
    rows, want = sessions(6)
    out = frames.published(spark.createDataFrame(rows, frames.CHUNKS))
    assert out.rdd.getNumPartitions() == max(8, -(-len(rows) // 10)) > 8
    assert found(out) == want


class Kept(dict):
    """A state variable that counts what is put into it."""

    puts = 0

    def get(self):
        return super().get(())

    exists = dict.__len__

    def update(self, value):
        self.updateValue((), value)

    def updateValue(self, key, value):
        self.puts += 1
        self[key] = value

    def containsKey(self, key):
        return key in self

    getValue = dict.__getitem__
    removeKey = dict.pop


class Handle(dict):
    def getValueState(self, name, _):
        return self.setdefault(name, Kept())

    def getMapState(self, name, *_):
        return self.setdefault(name, Kept())

    def registerTimer(self, at):
        self.setdefault("timers", []).append(at)


@pytest.mark.parametrize("order", [(0, 1, 2), (0, 2, 1)])
def test_a_session_that_comes_at_once_keeps_no_entries(order):
    """Its entries are given out as they are read; only that it is over is remembered, and that with one timer."""
    data = frame({"id": 1}) + frame(publish("a.rs", entry(0, "A", "x"))), frame(publish("a.rs", entry(0, "A", "y"))), frame(publish("b.rs", entry(0, "B", "z")))
    row = type("R", (), {})
    rows = []
    for k in order:
        r = row()
        r.seq, r.chunk, r.ms, r.last = k, data[k], 1000 + k, k == 2
        rows.append(r)
    handle, state = Handle(), frames._Settling(15_000, 10_000, 60_000)
    state.init(handle)
    got = [json.loads(r["json"])["diagnostics"][0]["message"] for r in state.handleInputRows(("s",), iter(rows), None)]
    assert sorted(got) == ["y", "z"] and handle["entries"].puts == 0 and not handle["early"]
    assert handle["head"].puts == 1 and handle["timers"] == [1000 + 15_000 + 60_000]
    assert list(state.handleInputRows(("s",), iter(rows), None)) == []


@pytest.fixture
def store(spark):
    old = {k: spark.conf.get(k, None) for k in frames.STORE}
    for k, v in frames.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("seed", [4, 5])
def test_stream_equals_plain_reading(spark, store, tmp_path, seed):
    """Chunks come within a minute of their place in time, in files of any cut; a last session far ahead in time lets the watermark pass all others."""
    rows, want = sessions(seed)
    rng, folder = random.Random(seed), f"{tmp_path}/chunks"
    rows.sort(key=lambda r: r[3] + timedelta(seconds=rng.randint(0, 20)))
    rows.append(("end", 0, b"", START + timedelta(hours=3), True))
    read = lambda: frames.settled(spark.readStream.schema(frames.CHUNKS).option("maxFilesPerTrigger", 1).parquet(folder))
    thirds = [rows[: len(rows) // 3], rows[len(rows) // 3 : -1], rows[:5] + rows[-1:]]
    for part in thirds:  # a run for each growth of the log, which takes up where the last one ended
        spark.createDataFrame(part, frames.CHUNKS).coalesce(1).write.mode("append").parquet(folder)
        query = read().writeStream.option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start(path=f"{tmp_path}/out", format="parquet")
        query.awaitTermination(180)
        assert query.exception() is None
    out = spark.read.schema(frames.PUBLISHED).parquet(f"{tmp_path}/out")
    assert found(out) == want
    assert out.count() == out.distinct().count()
