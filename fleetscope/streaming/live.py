"""Live scoring: the batch operators over Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetscope.functions.numbers import robust_z


def binned_means(stream: DataFrame, session: str, ts: str, node: str, value: str, width: str, late: str) -> DataFrame:
    """Mean per session, node and epoch-anchored bin; rows later than ``late`` are dropped.

    The result is the same for a batch DataFrame, where nothing is late.
    """
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(session, node, F.window("__ts", width).alias("bin")).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")
    )


def scored(stream: DataFrame, stats: DataFrame, by: list[str], value: str, alarm: float = 3.0) -> DataFrame:
    """Adds ``z`` from calibrated statistics and ``alarm``; a stream-static join."""
    joined = stream.join(stats.select(*by, "med", "iqr"), by)
    z: Column = robust_z(F.col(value), F.col("med"), F.col("iqr"))
    return joined.withColumn("z", z).withColumn("alarm", z > alarm).drop("med", "iqr")


def live_windows(stream: DataFrame, session: str, seq: str, value: str, width: int, stride: int) -> DataFrame:
    """Count windows per session as rows arrive: ``session, k, total``.

    State per session is the last ``width`` rows and the next window's number.
    Rows of a session must arrive in order of ``seq`` across triggers.
    """
    state = "seqs array<long>, values array<double>, next long"

    def step(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        seqs, values, k = (list(held.get[0]), list(held.get[1]), held.get[2]) if held.exists else ([], [], 0)
        new = pd.concat(list(parts)).sort_values("seq")
        seqs += new["seq"].tolist()
        values += new["value"].tolist()
        out = []
        while seqs and k * stride + width <= seqs[-1] + 1:
            inside = [v for s, v in zip(seqs, values, strict=True) if k * stride <= s < k * stride + width]
            if len(inside) == width:
                out.append((key[0], k, float(sum(inside))))
            k += 1
        keep = [i for i, s in enumerate(seqs) if s >= k * stride]
        held.update(([seqs[i] for i in keep], [values[i] for i in keep], k))
        yield pd.DataFrame(out, columns=["session", "k", "total"])

    rows = stream.select(F.col(session).cast("long").alias("session"), F.col(seq).cast("long").alias("seq"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("session").applyInPandasWithState(
        step, "session long, k long, total double", state, "append", GroupStateTimeout.NoTimeout
    )


#: State store that expiring state needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOW_SCHEMA = "session long, k long, total double, late long"


class CountWindows(StatefulProcessor):
    """Windows of ``width`` rows every ``stride`` rows of a session, whatever the order its rows arrive in.

    A session's state is the rows that wait, as two arrays, and the number of the
    next window: one read and one write per trigger, however many rows came.  A
    window is put out as soon as its rows and all windows
    before it are there.  A gap holds later windows back until the session's
    timer fires, ``idle`` of event time after its newest row: then the complete
    windows that are left come out and the session's state goes.  A row before
    the next window's start comes too late, as does a row of a session whose
    state went; the numbers of such rows come out with the next window, or at
    the end with window -1.
    """

    def __init__(self, width: int, stride: int, idle: timedelta):
        self.width, self.stride = width, stride
        self.idle_ms = int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, late long, newest long, seqs array<long>, values array<double>")

    def _state(self) -> tuple[int, int, int | None, dict[int, float]]:
        """The next window, late rows not yet put out, the newest time (none without state) and the rows that wait."""
        known = self.place.get()
        if known is None:
            return 0, 0, None, {}
        k, late, newest, seqs, values = known
        return k, late, newest, dict(zip(seqs, values, strict=True))

    def _total(self, held: dict[int, float], k: int) -> float | None:
        """The sum of a window, none where a row is missing."""
        places = range(k * self.stride, k * self.stride + self.width)
        return float(sum(held[s] for s in places)) if all(s in held for s in places) else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        k, late, before, held = self._state()
        newest = before or 0
        for part in rows:
            due = part["seq"] >= k * self.stride
            late += int((~due).sum())
            held |= zip(part["seq"][due].tolist(), part["value"][due].tolist(), strict=True)
            newest = max(newest, int(part["ts"].max().timestamp() * 1000))
        found = []
        while (total := self._total(held, k)) is not None:
            found.append((k, total))
            k += 1
        if newest != before:
            if before is not None:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(newest + self.idle_ms)
        if found:
            yield self._frame(key, found, late)
            late = 0
        left = {s: v for s, v in held.items() if s >= k * self.stride}
        self.place.update((k, late, newest, list(left), list(left.values())))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        k, late, _, held = self._state()
        later = sorted(s // self.stride for s in held if s % self.stride == 0 and s >= k * self.stride)
        found = [(w, total) for w in later if (total := self._total(held, w)) is not None]
        self.place.clear()
        if found or late:
            yield self._frame(key, found or [(-1, 0.0)], late)

    def _frame(self, key: tuple, found: list[tuple[int, float]], late: int) -> pd.DataFrame:
        counts = [late] + [0] * (len(found) - 1)
        return pd.DataFrame({"session": key[0], "k": [k for k, _ in found], "total": [t for _, t in found], "late": counts})

    def close(self) -> None:
        pass


def expiring_windows(stream: DataFrame, session: str, seq: str, ts: str, value: str, width: int, stride: int, late: str, idle: timedelta) -> DataFrame:
    """Count windows ``session, k, total, late`` of a stream, with state that expires; see ``CountWindows``.

    ``late`` is the watermark's delay.  Rows with a null session, number, time
    or value are left out.  The session must use ``STATE_STORE``.
    """
    rows = stream.select(
        F.col(session).cast("long").alias("session"), F.col(seq).cast("long").alias("seq"), F.col(value).cast("double").alias("value"), F.col(ts).cast("timestamp").alias("ts")
    ).dropna()
    timed = rows.withWatermark("ts", late)
    return timed.groupBy("session").transformWithStateInPandas(CountWindows(width, stride, idle), WINDOW_SCHEMA, "append", "EventTime")
