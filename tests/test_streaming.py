"""Count windows over a stream: order of arrival, gaps, late rows, expiring state."""

import os
from datetime import datetime, timedelta

import pandas as pd
import pytest

from fleetscope.plans.live import run_to_end
from fleetscope.streaming import live

START = datetime(2024, 1, 1)


def arrivals(folder, files):
    """One Parquet file per trigger, in order of modification time."""
    for i, rows in enumerate(files):
        frame = pd.DataFrame([(s, q, START + timedelta(minutes=m), float(v)) for s, q, m, v in rows], columns=["session", "seq", "ts", "value"])
        path = folder / f"{i}.parquet"
        frame.astype({"session": "Int64"}).to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def stream(spark, folder, idle=timedelta(hours=1), late="10 minutes"):
    source = spark.readStream.schema("session long, seq long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    return live.expiring_windows(source, "session", "seq", "ts", "value", 4, 2, late, idle)


def test_order_gaps_and_late_rows(spark, tmp_path):
    one = lambda *seqs: [(1, q, q, 10 + q) for q in seqs]
    two = lambda *seqs: [(2, q, q, q) for q in seqs]
    later = 3 * 24 * 60
    files = [
        one(0, 1, 3) + two(0, 1),
        one(2, 7, 6) + two(7, 3, 4, 5, 6),  # 1 completes its first window; 2 lacks row 2
        one(5, 4, 1) + [(None, 0, 1, 1.0)],  # row 1 comes again, too late
        one(8, 9),
        [(3, 0, later, 1.0)],  # far ahead in time: the timers of 1 and 2 fire
        [(3, 1, later + 1, 1.0)],
    ]
    arrivals(tmp_path, files)
    got = sorted((r.session, r.k, r.total, r.late) for r in run_to_end(stream(spark, tmp_path), spark).collect())
    sums = {k: sum(10 + q for q in range(2 * k, 2 * k + 4)) for k in range(4)}
    assert [r[:3] for r in got] == [(1, k, float(sums[k])) for k in range(4)] + [(2, 2, float(4 + 5 + 6 + 7))]
    assert sum(r[3] for r in got if r[0] == 1) == 1 and got[-1][3] == 0


def test_rows_of_no_window_are_counted_at_the_end(spark, tmp_path):
    later = 3 * 24 * 60
    rows = [(1, q, q, 1.0) for q in range(4)]
    arrivals(tmp_path, [rows, [(1, 0, 4, 1.0), (1, 1, 4, 1.0)], [(2, 0, later, 1.0)], [(2, 1, later + 1, 1.0)]])
    got = sorted((r.k, r.total, r.late) for r in run_to_end(stream(spark, tmp_path), spark).collect())
    assert got == [(-1, 0.0, 2), (0, 4.0, 0)]


def test_state_goes_with_its_session(spark, tmp_path):
    files = [[(s, q, 24 * 60 * s + q, 1.0) for q in range(3)] for s in range(6)]
    arrivals(tmp_path, files)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    try:
        query = stream(spark, tmp_path).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    one = kept[0]
    assert one > 0 and max(kept) <= 3 * one  # not six sessions' worth


@pytest.mark.parametrize("files", [[[(1, 0, 0, 1.0)]]])
def test_a_short_session_has_no_window(spark, tmp_path, files):
    arrivals(tmp_path, files)
    assert run_to_end(stream(spark, tmp_path), spark).count() == 0
