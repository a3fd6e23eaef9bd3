"""Steps whose work must grow no faster than the table: plans and equal results of the cheaper forms."""

from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyarrow.parquet import ParquetFile
from pyspark.sql import functions as F

from fleetscope.operators import parameters, training, windows
from fleetscope.operators.parameters import applied, autoencoder, gradient_sums, parameter_table, row_blocks
from fleetscope.plans import catalog
from fleetscope.plans.learned import STEPS, forecast_rows
from fleetscope.plans.storage import stored
from fleetscope.plans.views import prototypes
from fleetscope.streaming import live


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width,stride", [(6, 3), (8, 4), (9, 3), (5, 5), (1, 1), (7, 2), (4, 6), (60, 32)])
def test_count_windows_do_not_copy_rows(spark, width, stride):
    rng = np.random.default_rng(width)
    rows = [(s, i, None if i == 11 else float(rng.normal())) for s in (1, 2, None) for i in range(150) if rng.random() > 0.02]
    df = spark.createDataFrame(rows, "session long, seq long, v double").repartition(3)
    found = windows.count_windows(df, ["session"], "seq", F.col("v"), width, stride)
    assert "Generate" not in planned(found) and "Aggregate" not in planned(found)
    copied = windows._copied_windows(df, ["session"], "seq", F.col("v"), width, stride)
    key = lambda r: (str(r.session), r.k)
    assert sorted(found.collect(), key=key) == sorted(copied.collect(), key=key) and found.schema.simpleString() == copied.schema.simpleString()


def test_first_step_joins_without_a_shuffle_of_the_rows(spark):
    rows = spark.range(400).select((F.col("id") % 2).alias("client"), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.sin(i + F.col("id"))).alias("x"))
    net = autoencoder(5, 2)
    packed, plain = (stored(row_blocks(rows, "client", packed=p), "blocks") for p in (True, False))
    assert packed.schema["x"].dataType.simpleString() == "binary"
    got, known = ({r.owner: r for r in gradient_sums(b, parameter_table(b, net), net).collect()} for b in (packed, plain))
    assert got.keys() == known.keys() and all(got[o].n == known[o].n and np.allclose(got[o].grad, known[o].grad) for o in got)
    assert "BroadcastHashJoin" in planned(gradient_sums(packed, parameter_table(packed, net), net))


@pytest.fixture
def no_broadcast_by_threshold(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_rows_meet_parameters_without_being_dealt_out_by_owner(spark, sf_dir, monkeypatch, no_broadcast_by_threshold):
    plans = []
    monkeypatch.setattr(parameters, "gradient_sums", lambda b, p, n: plans.append(planned(found := gradient_sums(b, p, n))) or found)
    residual = planned(catalog.QUERIES["fcs02_learned_residual"](spark, sf_dir))
    assert "BroadcastHashJoin" in residual and "hashpartitioning" not in residual
    rows = spark.range(60).select((F.col("id") % 2).alias("client"), F.array(F.sin("id"), F.cos("id")).alias("x"))
    rounds = parameters.ClusteredRounds(autoencoder(2, 1), replicas=1, rounds=1)  # its parameters are a join of clients and replicas
    rounds.run(stored(row_blocks(rows, "client", packed=True), "blocks"))
    above_blocks = [p.split("MapInArrow")[1].split("FileScan")[0] for p in plans]
    assert len(plans) == STEPS + 1 and all("BroadcastHashJoin" in p and "hashpartitioning" not in p for p in above_blocks)


def test_parameters_too_large_to_broadcast_are_copied_for_parts_of_the_rows(spark, monkeypatch, no_broadcast_by_threshold):
    rows = spark.range(900).select(F.when(F.col("id") < 800, F.col("id") % 2).otherwise(F.col("id")).alias("client"), F.array(F.sin("id"), F.cos("id")).alias("x"))
    params = parameter_table(rows.select(F.col("client").alias("owner")), autoencoder(2, 1)).withColumn("params", F.transform("params", lambda v: v + F.col("owner")))
    run = lambda: applied(rows, params, "client", "x", "z", lambda x, p: x * p[:1])
    known = sorted((r.client, r.x, r.z) for r in run().collect())
    monkeypatch.setattr(parameters, "MOST_BYTES", 0)
    monkeypatch.setattr(parameters, "COPY_ROWS", 50)
    assert sorted((r.client, r.x, r.z) for r in run().collect()) == known and len(known) == 900
    joined = parameters.beside(rows, params.withColumnRenamed("owner", "client"), "client")
    assert joined.columns == ["client", "x", "params"] and "hashpartitioning(client" in planned(joined) and "__salt" in planned(joined)


def test_parts_of_sessions_grow_in_number_with_the_table(spark, sf_dir, monkeypatch):
    known = {(r.session, r.k): r.x for r in forecast_rows(spark, sf_dir).collect()}
    monkeypatch.setattr(windows, "PART_ROWS", 500)
    found = forecast_rows(spark, sf_dir)
    assert "REPARTITION_BY_NUM" in planned(found) and planned(found).count("hashpartitioning(session") == 1
    assert {(r.session, r.k): r.x for r in found.collect()} == known
    rows = spark.range(20_000).select((F.col("id") % 400).alias("session"))
    sizes = windows.dealt(rows, ["session"], 20_000).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(sizes) == 40 and max(r["count"] for r in sizes) <= 1500
    assert "Exchange" not in planned(windows.dealt(rows, ["session"], 2000))  # the session's own number is enough


def test_a_reader_of_blocks_holds_few_of_them(spark, monkeypatch):
    monkeypatch.setattr(parameters, "GROUP_BLOCKS", 4)
    rows = spark.range(20_000).coalesce(1).select((F.col("id") % 2).alias("client"), F.array(F.sin("id")).alias("x"))
    blocks = parameters.stored_blocks(rows, "client")
    (path,) = blocks.inputFiles()
    found = ParquetFile(path.removeprefix("file://")).metadata
    assert found.num_rows == 20 and [found.row_group(i).num_rows for i in range(found.num_row_groups)] == [4] * 5
    assert blocks.agg(F.sum("n")).first()[0] == 20_000


def test_vectors_of_several_rows(spark):
    df = spark.createDataFrame([(1, [float(v) for v in range(6 * i, 6 * i + 6)]) for i in range(3)], "client long, x array<double>").coalesce(1)
    block = row_blocks(df, "client", packed=True, per=2).first()
    assert block.n == 6 and np.array_equal(np.frombuffer(block.x), np.arange(18.0))


class _Handle:
    """Counts the calls that a processor makes to its state and timers."""

    def __init__(self):
        self.calls, self.kept, self.timers = 0, {}, set()

    def _counted(self, result=None):
        self.calls += 1
        return result

    def getValueState(self, name, schema):  # noqa: N802
        handle = self

        class State:
            exists = staticmethod(lambda: handle._counted(name in handle.kept))
            get = staticmethod(lambda: handle._counted(handle.kept.get(name)))
            update = staticmethod(lambda v: handle._counted(handle.kept.__setitem__(name, v)))
            clear = staticmethod(lambda: handle._counted(handle.kept.pop(name, None)))

        return State

    registerTimer = lambda self, at: self._counted(self.timers.add(at))  # noqa: E731, N815
    deleteTimer = lambda self, at: self._counted(self.timers.remove(at))  # noqa: E731, N815


def test_calls_to_the_state_do_not_grow_with_the_rows():
    calls = {}
    for n in (30, 3000):
        handle, windows_of = _Handle(), live.CountWindows(8, 4, timedelta(days=30))
        windows_of.init(handle)
        found = []
        for step in range(3):  # as the query's files: no window is whole before the last
            part = pd.DataFrame({"seq": range(step, n, 3), "value": 1.0, "ts": pd.Timestamp(2024, 1, 1) + pd.to_timedelta(range(step, n, 3), unit="s")})
            found += [k for frame in windows_of.handleInputRows((1,), iter([part]), None) for k in frame["k"]]
        assert found == list(range((n - 8) // 4 + 1)) and len(handle.timers) == 1
        calls[n] = handle.calls
    assert calls[30] == calls[3000] <= 12


def test_first_centres_leave_the_rows_where_they_are(spark, sf_dir, monkeypatch):
    plans = []
    monkeypatch.setattr(training, "stored", lambda df, name: plans.append(planned(df)) or stored(df, name))
    rows = spark.range(200).select((F.col("id") % 2).alias("group"), F.col("id").alias("key"), F.array(F.sin("id"), F.cos("id")).alias("vec"))
    centres = training.kmeans(rows, 3, 0)
    assert sorted((r.group, r.c, r.n, round(r.vec[0], 12)) for r in centres.collect()) == [(g, c, 0, round(float(np.sin(2 * c + g)), 12)) for g in (0, 1) for c in range(3)]
    training.kmeans_grid(rows, [2, 3], 0)
    assert len(plans) == 2 and all("WindowGroupLimit" in p for p in plans)
    assert "WindowGroupLimit" in planned(prototypes(spark, sf_dir))


def test_rows_are_not_dealt_out_by_their_few_groups(spark):
    rows = stored(spark.range(1000).select((F.col("id") % 2).alias("client"), F.col("id").alias("v")), "rows")
    plan = planned(windows.same_group(rows, rows.groupBy("client").agg(F.count("v").alias("n")), ["client"]))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
