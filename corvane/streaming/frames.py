"""Output of language servers, which comes as chunks of a byte stream: frames, messages, and the diagnostics of a session once it has settled.

``chunks(session, seq, chunk, ts, last)``: places count from 0, ``ts`` is the time of arrival, ``last`` marks a session's end.  Frames may be cut anywhere, and
chunks may come in any order and more than once.  Rows without session, place or time are left out.  A session is read up to the first place that is missing.

A session opens with the response to request 1, which must come within ``wait`` of its first chunk.  From then on it publishes diagnostics for the time
``settle``; later ones don't count.  A message has the time of the chunk that completes it.  Frames that aren't JSON are skipped; one without a length ends the session.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from corvane.shipping import ship, tasks_for

CHUNKS = "session string, seq long, chunk binary, ts timestamp, last boolean"
#: Published entries: an object with one diagnostic a row, with the number of its message and its place there.
PUBLISHED = "session string, n long, k int, json string"

#: Chunks that a task sorts, about.
CHUNKS_A_TASK = 250_000

#: The state store that state by key and timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: The header of a frame, the number of the opening request and the method that publishes.
_LENGTH, _OPENING, _METHOD = "Content-Length:", 1, "textDocument/publishDiagnostics"
_SETTLE, _WAIT = "15 seconds", "10 seconds"


def _header(data: bytearray, at: int) -> tuple[int | None, int] | None:
    """The length that a header gives and where its body begins; nothing if the header isn't whole yet."""
    size = None
    while (end := data.find(b"\n", at)) >= 0:
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        at = end + 1
        if not line:
            return size, at
        if line.startswith(_LENGTH):
            given = line[len(_LENGTH) :].strip()
            size = int(given) if re.fullmatch(r"\+?[0-9]{1,18}", given) else None
    return None


def _message(body: bytes) -> dict:
    """A body's object; an empty one for what isn't JSON or no object."""
    try:
        found = json.loads(body.decode("utf-8"))
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


class Session:
    """What has been read of a session.  It holds no more than the frame that isn't whole yet."""

    def __init__(self, settle: int, wait: int, next_: int = 0, n: int = 0, deadline: int | None = None, opened: bool = False, over: bool = False, pending: bytes = b""):
        self.settle, self.wait = settle, wait
        self.next, self.n, self.deadline, self.opened, self.over, self.pending = next_, n, deadline, opened, over, bytearray(pending)

    def state(self) -> tuple:
        return self.next, self.n, self.deadline, self.opened, self.over, bytes(self.pending)

    def take(self, chunk: bytes | None, ms: int, last: bool) -> Iterator[tuple[int, int, str, str]]:
        """Entries ``(n, k, key, json)`` that the next chunk completes; of entries with one key the last one counts."""
        self.next += 1
        if self.deadline is None:
            self.deadline = ms + self.wait
        if not self.over and ms < self.deadline:
            self.pending += chunk or b""
            yield from self._entries(ms)
        if last or ms >= self.deadline:
            self.over = True
        if self.over:
            self.pending = bytearray()

    def _entries(self, ms: int) -> Iterator[tuple[int, int, str, str]]:
        at = 0
        while (head := _header(self.pending, at)) is not None:
            size, start = head
            if size is None:
                self.over = True
                return
            if len(self.pending) < start + size:
                break
            said = _message(bytes(self.pending[start : start + size]))
            at = start + size
            asked = said.get("id")
            if isinstance(asked, int) and not isinstance(asked, bool):
                if asked == _OPENING and not self.opened:
                    self.opened, self.deadline = True, ms + self.settle
            elif self.opened and said.get("method") == _METHOD:
                yield from self._published(said.get("params"))
        del self.pending[:at]

    def _published(self, params) -> Iterator[tuple[int, int, str, str]]:
        uri, entries = (params.get("uri"), params.get("diagnostics")) if isinstance(params, dict) else (None, None)
        if not isinstance(uri, str) or not isinstance(entries, list):
            return
        self.n += 1
        for k, entry in enumerate(entries):
            if isinstance(entry, dict):
                start = entry["range"].get("start") if isinstance(entry.get("range"), dict) else None
                line = start.get("line") if isinstance(start, dict) else None
                yield self.n, k, json.dumps([uri, line, entry.get("code"), entry.get("source")]), json.dumps({"uri": uri, "diagnostics": [entry]})


def _millis(spark, interval: str) -> int:
    return int(spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"INTERVAL {interval}"))).first()[0])


def _whole(chunks: DataFrame) -> tuple[DataFrame, Column]:
    kept = chunks.filter("session IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL")
    return kept, F.unix_millis("ts").alias("ms")


def published(chunks: DataFrame, settle: str = _SETTLE, wait: str = _WAIT, tasks: int | None = None) -> DataFrame:
    """All entries that a table of chunks publishes in time.

    A session's chunks are sorted by Spark and read in order, as a stream through one task that holds one frame: what a session says can only be read from
    its beginning.  Sessions are dealt out to so many ``tasks``, by default as many as the counted chunks take: joined by their size in the shuffle, where
    such texts are a small part of what they are in memory, a task's share would grow with the table.
    """
    spark = chunks.sparkSession
    ship(spark)
    for_, within = _millis(spark, settle), _millis(spark, wait)
    kept, ms = _whole(chunks)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, now = None, None
        for batch in batches:
            out = []
            for session, seq, chunk, at, last in zip(batch["session"], batch["seq"], batch["chunk"], batch["ms"], batch["last"]):
                if session != name:
                    name, now = session, Session(for_, within)
                if seq == now.next:
                    out += [(session, n, k, text) for n, k, _, text in now.take(chunk, at, last)]
            if out:
                yield pd.DataFrame(out, columns=["session", "n", "k", "json"])

    rows = kept.select("session", "seq", "chunk", ms, F.coalesce("last", F.lit(False)).alias("last"))
    return rows.repartition(tasks or tasks_for(kept, CHUNKS_A_TASK), "session").sortWithinPartitions("session", "seq").mapInPandas(read, PUBLISHED)


class _Settling(StatefulProcessor):
    """Keeps of each session the frame that isn't whole yet, chunks that came early and the last entry of each key, and gives these out once, when it is over."""

    def __init__(self, settle: int, wait: int, keep: int):
        self.settle, self.wait, self.keep = settle, wait, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "next long, n long, deadline long, opened boolean, over boolean, pending binary")
        self.early = handle.getMapState("early", "seq long", "chunk binary, ms long, last boolean")
        self.entries = handle.getMapState("entries", "key string", "n long, k int, json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        head = self.head.get()
        now = Session(self.settle, self.wait, *(head or ()))
        if now.over:  # it has been given out already
            return
        before, come, held = now.deadline, {}, now.next  # places below ``held`` are done
        early = False if head is None else self.early.exists()
        for r in rows:
            if now.over or r.seq < held:
                continue
            if r.seq > now.next:
                self.early.updateValue((r.seq,), (r.chunk, r.ms, r.last))
                early = True
                continue
            for n, k, of, text in now.take(r.chunk, r.ms, r.last):
                come[of] = (n, k, text)
            while early and not now.over and self.early.containsKey((now.next,)):
                place = now.next
                chunk, ms, last = self.early.getValue((place,))
                for n, k, of, text in now.take(chunk, ms, last):
                    come[of] = (n, k, text)
                self.early.removeKey((place,))
            held = now.next
        self.head.update(now.state())
        if now.over and head is None:  # all of it came at once, so none of its entries was put by
            yield from (Row(session=key[0], n=n, k=k, json=text) for n, k, text in come.values())
            if early:
                self.early.clear()
            self.handle.registerTimer(now.deadline + self.keep)
            return
        for of, entry in come.items():
            self.entries.updateValue((of,), entry)
        if now.over:
            yield from self._out(key, now)
        elif now.deadline is not None and now.deadline != before:
            self.handle.registerTimer(now.deadline)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head = self.head.get()
        if head is None:
            return
        now = Session(self.settle, self.wait, *head)
        if now.over:
            if expiredTimerInfo.getExpiryTimeInMs() >= now.deadline + self.keep:
                self.head.clear()
        elif expiredTimerInfo.getExpiryTimeInMs() >= now.deadline:
            now.over, now.pending = True, bytearray()
            self.head.update(now.state())
            yield from self._out(key, now)

    def _out(self, key, now: Session) -> Iterator[Row]:
        if self.entries.exists():
            for _, (n, k, text) in self.entries.iterator():
                yield Row(session=key[0], n=n, k=k, json=text)
            self.entries.clear()
        if self.early.exists():
            self.early.clear()
        self.handle.registerTimer(now.deadline + self.keep)

    def close(self) -> None:
        pass


def settled(chunks: DataFrame, settle: str = _SETTLE, wait: str = _WAIT, late: str = "1 minute", keep: str = "1 hour") -> DataFrame:
    """A stream's entries, those of a session at once: when it ends, or when the watermark passes its deadline.  Of entries for one place and code the last is given.

    ``late`` is how late chunks may come.  That a session is over is remembered for ``keep`` after its deadline, so chunks that come then don't open it again.
    The session needs the settings ``STORE`` when the stream starts.
    """
    spark = chunks.sparkSession
    ship(spark)
    kept, ms = _whole(chunks.withWatermark("ts", late))
    rows = kept.select("session", "seq", "chunk", "ts", ms, F.coalesce("last", F.lit(False)).alias("last"))
    state = _Settling(_millis(spark, settle), _millis(spark, wait), _millis(spark, keep))
    return rows.groupBy("session").transformWithState(state, PUBLISHED, "append", "eventTime")
