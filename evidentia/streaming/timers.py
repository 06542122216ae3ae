"""Stateful operators with event-time timers, and the batch forms that they equal.

They run on transformWithState, so a session needs the RocksDB state store: STORE says which settings. State ends with its key: a timer
that fires, or the row that ends a call, clears it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Session settings that the streams of this module need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Fixed values of coalescing: milliseconds between two pieces, and characters that don't wait for them.
PAUSE_MS, FULL = 50, 16_384


class _Pending:
    """What a call has not given out yet. last is the time of the last piece, in milliseconds; None before the first."""

    def __init__(self, pause: int, full: int, state: tuple | None = None):
        self.pause, self.full = pause, full
        self.first, self.n, self.body, self.last = state or (None, 0, "", None)

    def add(self, seq: int, ms: int, text: str | None, ends: bool) -> Iterator[tuple[int, int, str]]:
        """Take up a delta; gives (first seq, deltas, text) of the pieces that it completes. Empty deltas count for nothing."""
        if text:
            self.first = seq if self.first is None else self.first
            self.n, self.body = self.n + 1, self.body + text
            if self.last is None or ms - self.last >= self.pause or len(self.body) >= self.full:
                yield from self.flush(ms)
        if ends:
            yield from self.flush(ms)

    def flush(self, ms: int | None) -> Iterator[tuple[int, int, str]]:
        if self.n:
            yield self.first, self.n, self.body
            self.first, self.n, self.body, self.last = None, 0, "", ms

    def state(self) -> tuple:
        return self.first, self.n, self.body, self.last


def coalesce(deltas: DataFrame, pause: int = PAUSE_MS, full: int = FULL) -> DataFrame:
    """(call, first, n, body) of (call, seq, ts, text, ends): a call's first delta at once, then what has come until pause milliseconds
    after the last piece or full characters, and the rest where the call ends or its rows do.

    Rows stream by call and seq through the tasks, which hold one piece. Null and empty texts count for nothing.
    """
    kind = deltas.schema["call"].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        none = call = object()
        held = _Pending(pause, full)
        for batch in batches:
            out = []
            for own, seq, ms, text, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if own != call:
                    out += [(call, *p) for p in held.flush(None)] if call is not none else []
                    call, held = own, _Pending(pause, full)
                out += [(call, *p) for p in held.add(seq, ms, text, ends)]
            yield rows(out)
        yield rows([(call, *p) for p in held.flush(None)])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (arrow, pa.int64(), pa.int64(), pa.string()))], ["call", "first", "n", "body"])

    ordered = deltas.select("call", "seq", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "text", F.coalesce("ends", F.lit(False)).alias("ends")).repartition("call").sortWithinPartitions("call", "seq")
    return ordered.mapInArrow(run, f"call {kind.simpleString()}, first bigint, n bigint, body string")


class _Coalescer(StatefulProcessor):
    def __init__(self, kind: str, pause: int, full: int, idle: int):
        self.kind, self.pause, self.full, self.idle = kind, pause, full, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "first bigint, n bigint, body string, last bigint")

    def _rows(self, key: tuple, pieces: Iterable[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *p) for p in pieces], columns=["call", "first", "n", "body"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.held.get() if self.held.exists() else None
        pending = _Pending(self.pause, self.full, state and tuple(state))
        pdf = pd.concat(list(rows)).sort_values("seq")
        out, over, latest = [], False, 0
        for seq, ms, text, ends in zip(pdf["seq"].tolist(), pdf["ms"].tolist(), pdf["text"].tolist(), pdf["ends"].tolist()):
            out += pending.add(seq, ms, text if isinstance(text, str) else None, bool(ends))
            over, latest = over or bool(ends), max(latest, ms)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if over:
            self.held.clear()
        else:
            self.held.update(pending.state())
            self.handle.registerTimer(latest + self.idle)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.held.exists():
            out = list(_Pending(self.pause, self.full, tuple(self.held.get())).flush(None))
            self.held.clear()
        yield self._rows(key, out)

    def close(self) -> None:
        pass


def coalesce_stream(deltas: DataFrame, late: str = "10 seconds", idle_ms: int = 10_000, pause: int = PAUSE_MS, full: int = FULL) -> DataFrame:
    """The same over a stream. Deltas of a call come in order; the rest of a call that never ends is given out, and its state cleared,
    once the watermark is idle_ms past its last delta."""
    kind = deltas.schema["call"].dataType.simpleString()
    timed = deltas.withWatermark("ts", late).select("call", "seq", "ts", F.unix_millis("ts").alias("ms"), "text", F.coalesce("ends", F.lit(False)).alias("ends"))
    return timed.groupBy("call").transformWithStateInPandas(_Coalescer(kind, pause, full, idle_ms), f"call {kind}, first bigint, n bigint, body string", "Append", "EventTime")


def idle_spells(beats: DataFrame, idle_ms: int, until: Column) -> DataFrame:
    """(key, since, beats) of (key, ts): each spell of beats that idle_ms without another have followed, until a given time."""
    ms = beats.select("key", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    by = Window.partitionBy("key").orderBy("ms")
    opens = F.coalesce(F.col("ms") - F.lag("ms").over(by) >= idle_ms, F.lit(True))
    spells = ms.withColumn("opens", opens).withColumn("spell", F.sum(F.col("opens").cast("int")).over(by))
    last = spells.groupBy("key", "spell").agg(F.max("ms").alias("ms"), F.count("*").alias("beats"))
    return last.where(F.col("ms") + idle_ms <= F.unix_millis(until)).select("key", F.timestamp_millis("ms").alias("since"), "beats")


class _Idle(StatefulProcessor):
    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ms bigint, beats bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.seen.get() if self.seen.exists() else (None, 0)
        out = []
        for ms in sorted(pd.concat(list(rows))["ms"].tolist()):
            if last is not None and ms - last >= self.idle:
                out.append((key[0], last, n))
                n = 0
            last, n = max(ms, last or ms), n + 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.seen.update((last, n))
        self.handle.registerTimer(last + self.idle)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [(key[0], *self.seen.get())] if self.seen.exists() else []
        self.seen.clear()
        yield self._rows(out)

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["key", "since", "beats"])
        rows["since"] = pd.to_datetime(rows["since"], unit="ms")
        return rows

    def close(self) -> None:
        pass


def idle_stream(beats: DataFrame, idle_ms: int, late: str = "0 seconds") -> DataFrame:
    """(key, since, beats) of a stream of (key, ts), once for each spell, when the watermark is idle_ms past its last beat; a key's
    state is gone then."""
    kind = beats.schema["key"].dataType.simpleString()
    timed = beats.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("key").transformWithStateInPandas(_Idle(idle_ms), f"key {kind}, since timestamp, beats bigint", "Append", "EventTime")
