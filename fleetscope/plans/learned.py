"""Learned parts on the test tables: encoder, attention heads, forecasts, clustered rounds.

No SQL can train; each is compared with plain numpy in ``tests/test_parameters.py``
and ``tests/test_learned.py``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.vectors import sq_distance, total
from fleetscope.operators import memory, parameters, projection, windows
from fleetscope.plans.registry import register, table
from fleetscope.plans.storage import stored
from fleetscope.plans.views import NODES, WIDTH, embedded, prototypes

STEPS, RATE = 6, 0.02
ENCODER = parameters.autoencoder(WIDTH, 4)
#: Declared edges of the fleet: each node hears from the one before it.
RING = np.eye(NODES)[[(i - 1) % NODES for i in range(NODES)]]
NEIGHBOURS = 3
STRUCTURE = parameters.graph_attention(NODES, WIDTH, WIDTH, NEIGHBOURS, RING)
#: Forecasts: four sensors, windows of six rows every three, three rows ahead.
SENSORS, SPAN, STRIDE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), 6, 3
FORECAST = parameters.graph_attention(len(SENSORS), SPAN, STRIDE, 3)


def node_windows(spark, sf_dir) -> DataFrame:
    """One row per window and node, ``x`` its values: the encoder is shared by all nodes."""
    return embedded(spark, sf_dir).select("vec_id", "client", F.posexplode("z").alias("node", "x"))


def node_encoder(spark, sf_dir) -> DataFrame:
    """``owner, params``: per client trained from one shared start, then averaged by rows as one round of federation."""
    blocks = parameters.stored_blocks(node_windows(spark, sf_dir), "client")
    local, history = parameters.trained(blocks, parameters.parameter_table(blocks, ENCODER), ENCODER, STEPS, RATE, adam=True)
    sizes = history.where(F.col("step") == 0).select("owner", "n")
    mean = parameters.averaged(local.join(sizes, "owner").withColumn("all", F.lit(0)), "all").select("params")
    return stored(local.select("owner").crossJoin(F.broadcast(mean)), "encoder")  # one row


def _encoded(x: np.ndarray, flat: np.ndarray) -> np.ndarray:
    return parameters.encoded(x, ENCODER.unpack(flat))


def _decoded(x: np.ndarray, flat: np.ndarray) -> np.ndarray:
    p = ENCODER.unpack(flat)
    return parameters.encoded(x, p) @ p["w3"] + p["b3"]


@register("enc01_node_encoder")
def enc01(spark, sf_dir):
    """Embeddings of every node of every window by the frozen, averaged encoder."""
    found = parameters.applied(node_windows(spark, sf_dir), node_encoder(spark, sf_dir), "client", "x", "z", _encoded)
    return found.select("vec_id", "client", F.col("node").cast("long").alias("node"), F.transform("z", lambda v: F.round(v, 6)).alias("z"))


@register("enc02_decoder_error")
def enc02(spark, sf_dir):
    """Mean squared error of the linear decoder per window and node."""
    found = parameters.applied(node_windows(spark, sf_dir), node_encoder(spark, sf_dir), "client", "x", "back", _decoded)
    error = sq_distance(F.col("x"), F.col("back")) / WIDTH
    return found.select("vec_id", "client", F.col("node").cast("long").alias("node"), F.round(error, 6).alias("error"))


def deviations(spark, sf_dir) -> DataFrame:
    """Per window the nodes' differences from the nearest prototype, as one flat vector, and again as the targets."""
    assigned = memory.assign(embedded(spark, sf_dir), prototypes(spark, sf_dir))
    codes = prototypes(spark, sf_dir).select("client", "m", F.flatten("z").alias("code"))
    d = F.zip_with(F.flatten("z"), "code", lambda a, b: a - b)
    return assigned.join(codes, ["client", "m"]).select("vec_id", "client", F.concat(d, d).alias("x"))


def _structure(x: np.ndarray, flat: np.ndarray) -> np.ndarray:
    return parameters.attention_output(STRUCTURE, x, STRUCTURE.unpack(flat), NEIGHBOURS, RING)


@register("att02_learned_attention")
def att02(spark, sf_dir):
    """Residual per window and node of a graph attention head trained per client: neighbours and weights are learned."""
    rows = stored(deviations(spark, sf_dir), "deviations")
    blocks = parameters.stored_blocks(rows, "client")
    params, _ = parameters.trained(blocks, parameters.parameter_table(blocks, STRUCTURE), STRUCTURE, STEPS, RATE, adam=True)
    found = parameters.applied(rows, params, "client", "x", "expected", _structure)
    gap = lambda i: sq_distance(F.slice("x", i * WIDTH + 1, WIDTH), F.slice("expected", i * WIDTH + 1, WIDTH))
    residuals = F.transform(F.sequence(F.lit(0), F.lit(NODES - 1)), gap)
    out = found.select("vec_id", "client", F.posexplode(residuals).alias("node", "residual"))
    return out.select("vec_id", "client", F.col("node").cast("long").alias("node"), F.round("residual", 6).alias("residual"))


@register("att01_learned_neighbours")
def att01(spark, sf_dir):
    """The neighbours that each client's trained node embeddings choose, nearest first."""
    blocks = parameters.stored_blocks(deviations(spark, sf_dir), "client")
    params, _ = parameters.trained(blocks, parameters.parameter_table(blocks, STRUCTURE), STRUCTURE, STEPS, RATE, adam=True)
    size = NODES * WIDTH
    nodes = params.select("owner", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(NODES - 1)), lambda i: F.slice(F.slice("params", 1, size), i * WIDTH + 1, WIDTH))).alias("node", "vec"))
    pairs = nodes.join(nodes.select("owner", F.col("node").alias("neighbour"), F.col("vec").alias("other")), "owner").where("node <> neighbour")  # nodes x nodes a client
    norm = lambda v: F.greatest(F.sqrt(total(F.transform(v, lambda x: x * x))), F.lit(1e-12))
    similar = F.round(total(F.zip_with("vec", "other", lambda a, b: a * b)) / (norm(F.col("vec")) * norm(F.col("other"))), 12)
    chosen = F.slice(F.array_sort(F.collect_list(F.struct((-similar).alias("minus"), F.col("neighbour").cast("long").alias("neighbour")))), 1, NEIGHBOURS)
    return pairs.groupBy(F.col("owner").alias("client"), F.col("node").cast("long").alias("node")).agg(F.transform(chosen, lambda s: s["neighbour"]).alias("neighbours"))


def standardized_rows(spark, sf_dir, flag=None) -> DataFrame:
    """Sensor rows ``session, seq, v, flag``, standardized by the sensors' mean and deviation over all rows."""
    rows = table(spark, sf_dir, "lineitem").withColumn("flag", F.lit(False) if flag is None else flag)
    moments = rows.agg(*[f(s).alias(f"{s}_{n}") for s in SENSORS for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    scaled = [(F.col(s) - F.col(f"{s}_mean")) / F.greatest(F.col(f"{s}_std"), F.lit(1e-8)) for s in SENSORS]
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    values = rows.crossJoin(F.broadcast(moments)).select(F.col("l_suppkey").alias("session"), *order, F.array(*scaled).alias("v"), "flag")  # one row
    return windows.numbered(windows.dealt(values, ["session"], rows.count()), ["session"], order)


def forecast_rows(spark, sf_dir) -> DataFrame:
    """Per supplier's windows: ``client, session, k, x``, the sensors' last values and, behind them, their values ahead.

    A window and its successor are together one window that is a stride longer.
    """
    pairs = windows.count_windows(standardized_rows(spark, sf_dir), ["session"], "seq", F.col("v"), SPAN + STRIDE, STRIDE)
    by_node = [F.col("x")[row][i] for part in (range(SPAN), range(SPAN, SPAN + STRIDE)) for i in range(len(SENSORS)) for row in part]
    return pairs.select((F.col("session") % 4).alias("client"), "session", "k", F.array(*by_node).alias("x"))


def _forecast(x: np.ndarray, flat: np.ndarray) -> np.ndarray:
    return parameters.attention_output(FORECAST, x, FORECAST.unpack(flat), 3)


def forecast_head(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trained parameters of each client and the losses of the training steps."""
    blocks = parameters.stored_blocks(rows, "client")
    return parameters.trained(blocks, parameters.parameter_table(blocks, FORECAST), FORECAST, STEPS, RATE, adam=True)


@register("fcs01_attention_forecast")
def fcs01(spark, sf_dir):
    """Losses of the forecast head per client and training step."""
    _, history = forecast_head(forecast_rows(spark, sf_dir))
    return history.select(F.col("owner").alias("client"), "step", "n", F.round("loss", 9).alias("loss"))


@register("fcs02_learned_residual")
def fcs02(spark, sf_dir):
    """Summed squared forecast error per window and sensor, over the rows ahead, for whole series."""
    rows = stored(forecast_rows(spark, sf_dir), "forecast-rows")
    found = parameters.applied(rows, forecast_head(rows)[0], "client", "x", "ahead", _forecast)
    start = len(SENSORS) * SPAN
    gap = lambda i: sq_distance(F.slice("x", start + i * STRIDE + 1, STRIDE), F.slice("ahead", i * STRIDE + 1, STRIDE))
    residuals = F.transform(F.sequence(F.lit(0), F.lit(len(SENSORS) - 1)), gap)
    out = found.select("session", "k", F.posexplode(residuals).alias("node", "residual"))
    return out.select("session", "k", F.col("node").cast("long").alias("node"), F.round("residual", 6).alias("residual"))


@register("fed13_clustered_rounds")
def fed13(spark, sf_dir):
    """Rounds of clustered federation: warm-up, choice of a replica, local steps, means per cluster, respawn."""
    rows = embedded(spark, sf_dir).select("client", F.col("v").alias("x"))
    plan = parameters.ClusteredRounds(parameters.autoencoder(NODES * WIDTH, 4), replicas=3, rounds=4, rate=0.2, patience=1)
    history, _ = plan.run(parameters.stored_blocks(rows, "client"))
    return history.withColumnRenamed("owner", "client").withColumn("loss", F.round("loss", 9))


@register("plt01_kernel_projection")
def plt01_kernel(spark, sf_dir):
    """The two leading components of every window under a Gaussian kernel, fitted on all windows."""
    rows = embedded(spark, sf_dir).select("vec_id", "label", F.col("v").alias("x"))
    found = projection.projected(rows, projection.fit_kernel_projection(rows, features=256))
    axis = lambda k: F.round(F.col("axes")[k], 6)
    return found.select("vec_id", "label", axis(0).alias("first"), axis(1).alias("second"))
