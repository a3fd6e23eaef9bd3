"""Learned parts without automatic differentiation.

Training is data-parallel: a step is one aggregation of gradient or moment sums
over all rows, and only parameter tables, whose size does not depend on the
data, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.vectors import cosine, sq_distance
from fleetscope.operators.parameters import margin_prototypes, row_blocks, trained
from fleetscope.plans.storage import discard, stored


def linear_encoder(rows: DataFrame, width: int) -> DataFrame:
    """``key, z``: the ``width`` leading principal components of ``vec``; a linear stand-in for the encoder."""
    data = rows.select("key", array_to_vector("vec").alias("features"))
    model = PCA(k=width, inputCol="features", outputCol="pca").fit(data)
    return model.transform(data).select("key", vector_to_array("pca").alias("z"))


def _forward(x: np.ndarray, p: dict[str, np.ndarray]):
    hidden = np.maximum(x @ p["w1"] + p["b1"], 0)
    z = hidden @ p["w2"] + p["b2"]
    return hidden, z, z @ p["w3"] + p["b3"]


def gradients(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Summed squared reconstruction error of a two-layer encoder with linear decoder, and its gradient."""
    hidden, z, out = _forward(x, p)
    error = out - x
    back_z = 2 * error @ p["w3"].T
    back_h = (back_z @ p["w2"].T) * (hidden > 0)
    grad = {
        "w1": x.T @ back_h, "b1": back_h.sum(0), "w2": hidden.T @ back_z, "b2": back_z.sum(0),
        "w3": z.T @ (2 * error), "b3": 2 * error.sum(0),
    }
    return float((error**2).sum()), grad


def _shapes(features: int, width: int) -> dict[str, tuple[int, ...]]:
    hidden = 2 * width
    return {"w1": (features, hidden), "b1": (hidden,), "w2": (hidden, width), "b2": (width,), "w3": (width, features), "b3": (features,)}


def _unpack(flat: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def train_autoencoders(rows: DataFrame, client: str, width: int, rounds: int, rate: float = 0.1, federate: bool = False, seed: int = 42) -> DataFrame:
    """``client, round, loss, n, params``: one gradient step per round on rows ``client, x``.

    Every client starts from the same parameters.  Tasks add up gradients of
    their rows per client; the step is applied to the sums.  With ``federate``
    the clients' parameters are averaged by size after every round.
    """
    spark = rows.sparkSession
    sample = rows.select(F.size("x")).first()
    features = int(sample[0]) if sample else 1
    shapes = _shapes(features, width)
    rng = np.random.default_rng(seed)
    flat = np.concatenate([(rng.normal(size=s) / np.sqrt(s[0]) if len(s) > 1 else np.zeros(s)).ravel() for s in shapes.values()])
    start: dict = {}
    history: list[tuple] = []
    for step in range(rounds):
        sent = spark.sparkContext.broadcast((flat, start))

        def add(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            common, own = sent.value
            sums: dict = {}
            for batch in batches:
                clients = np.asarray(batch.column(0))
                x = np.asarray(batch.column(1).flatten()).reshape(len(clients), features)
                for c in np.unique(clients):
                    loss, grad = gradients(x[clients == c], _unpack(own.get(int(c), common), shapes))
                    part = np.concatenate([[loss, float((clients == c).sum())], *[g.ravel() for g in grad.values()]])
                    sums[int(c)] = sums.get(int(c), 0) + part
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([list(s) for s in sums.values()], pa.list_(pa.float64()))], names=["client", "sums"])

        parts = rows.select(F.col(client).cast("long").alias("client"), "x").mapInArrow(add, "client long, sums array<double>")
        cells = parts.select("client", F.posexplode("sums").alias("at", "v")).groupBy("client", "at").agg(F.sum("v").alias("v"))
        packed = cells.groupBy("client").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("sums"))
        results = {r["client"]: np.array(r["sums"]) for r in packed.toLocalIterator()}  # one parameter vector per client
        for c, sums in results.items():
            loss, n, grad = sums[0], sums[1], sums[2:]
            start[c] = start.get(c, flat) - rate * grad / (n * features)
            history.append((c, step, float(loss / (n * features)), int(n), start[c].tolist()))
        if federate and results:
            sizes = np.array([results[c][1] for c in results])
            mean = np.average([start[c] for c in results], axis=0, weights=sizes)
            start = dict.fromkeys(results, mean)
    return spark.createDataFrame(history, "client long, round int, loss double, n long, params array<double>")


def ridge_forecast(rows: DataFrame, client: str, ridge: float = 1e-2) -> DataFrame:
    """``client, node, weights, n``: each node's next value from the other nodes' state, by ridge regression.

    Rows have ``x`` (state per node) and ``y`` (next value per node).  Only the
    normal equations are gathered: nodes x nodes sums per client.
    """
    cells = rows.select(client, "x", "y", F.posexplode("x").alias("i", "a"))
    cells = cells.select(client, "i", "a", "y", F.posexplode("x").alias("j", "b"))
    sums = cells.groupBy(client, "i", "j").agg(
        F.sum(F.col("a") * F.col("b")).alias("xx"), F.sum(F.col("a") * F.col("y")[F.col("j")]).alias("xy"), F.count(F.lit(1)).alias("n")
    )

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        size = int(part["i"].max()) + 1
        xx, xy = np.zeros((size, size)), np.zeros((size, size))
        xx[part["i"], part["j"]], xy[part["i"], part["j"]] = part["xx"], part["xy"]
        out = []
        for node in range(size):
            other = [k for k in range(size) if k != node]
            w = np.zeros(size)
            w[other] = np.linalg.solve(xx[np.ix_(other, other)] + ridge * np.eye(size - 1), xy[other, node])
            out.append((part[client].iloc[0], node, w.tolist(), int(part["n"].iloc[0])))
        return pd.DataFrame(out, columns=[client, "node", "weights", "n"])

    kind = rows.schema[client].dataType.simpleString()
    return sums.groupBy(client).applyInPandas(solve, f"{client} {kind}, node int, weights array<double>, n long")


def kmeans(rows: DataFrame, k: int, rounds: int = 5) -> DataFrame:
    """``group, c, vec, n``: Lloyd's rounds within each group of rows ``group, key, vec``.

    Centres start at the group's lowest keys and travel as one row of arrays
    per group; the new means are one aggregation.
    """
    order = Window.partitionBy("group").orderBy("key")
    first = rows.withColumn("c", F.row_number().over(order)).where(F.col("c") <= k)  # so each task keeps k rows of a group only
    centres = stored(first.select("group", (F.col("c") - 1).alias("c"), "vec", F.lit(0).cast("long").alias("n")), "centres")
    for _ in range(rounds):
        book = centres.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("c", "vec"))).alias("codes"))
        best = F.array_min(F.transform("codes", lambda p: F.struct(sq_distance(F.col("vec"), p["vec"]).alias("d"), p["c"].alias("c"))))
        placed = rows.join(book, "group").select("group", best["c"].alias("c"), F.posexplode("vec").alias("dim", "v"))
        means = placed.groupBy("group", "c", "dim").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
        packed = means.groupBy("group", "c").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("vec"), F.max("n").alias("n")
        )
        centres = stored(packed, "centres")
    return centres


def refine_by_margin(rows: DataFrame, prototypes: DataFrame, rounds: int = 5, rate: float = 0.1, margin: float = 0.2) -> DataFrame:
    """``pid, label, vec``: prototypes moved so that samples are closer to their class than to others by a margin.

    Each round pulls the nearest own prototype towards, and pushes the nearest
    other one from, the samples that violate the margin (hinge on cosine).
    """
    current = prototypes.select("pid", "label", "vec")
    for _ in range(rounds):
        book = current.agg(F.sort_array(F.collect_list(F.struct("pid", "label", "vec"))).alias("bank"))
        joined = rows.crossJoin(book)  # one row
        near = lambda own: F.array_max(
            F.transform(
                F.filter("bank", lambda p: (p["label"] == F.col("label")) == F.lit(own)),
                lambda p: F.struct(F.round(cosine(F.col("vec"), p["vec"]), 12).alias("s"), (-p["pid"]).alias("minus")),
            )
        )
        pairs = joined.select("vec", near(True).alias("own"), near(False).alias("other")).where(
            F.col("own").isNotNull() & F.col("other").isNotNull() & (F.col("own.s") - F.col("other.s") < margin)
        )
        moves = pairs.select(F.explode(F.array(F.struct((-F.col("own.minus")).alias("pid"), F.lit(1.0).alias("sign")), F.struct((-F.col("other.minus")).alias("pid"), F.lit(-1.0).alias("sign")))).alias("m"), "vec")
        cells = moves.select("m.pid", F.posexplode("vec").alias("dim", "v"), F.col("m.sign").alias("sign"))
        shift = cells.groupBy("pid", "dim").agg(F.avg(F.col("sign") * F.col("v")).alias("g"))
        packed = shift.groupBy("pid").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "g"))), lambda s: s["g"]).alias("g"))
        moved = current.join(packed, "pid", "left")
        new = F.when(F.col("g").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "g", lambda v, g: v + rate * g))
        current = stored(moved.select("pid", "label", new.alias("vec")), "refined")
    return current


def refine_with_adam(rows: DataFrame, prototypes: DataFrame, client: str, margin: float = 0.1, steps: int = 50, rate: float = 1e-3) -> DataFrame:
    """``client, pid, label, vec``: each client's prototypes after Adam on the margin loss over its own rows.

    Rows are ``client, label, vec``, prototypes ``client, pid, label, vec``; the
    optimizer's moments are columns of the parameter table, carried from step
    to step.  The loss is the mean over a client's rows.  A client without rows
    keeps its prototypes.
    """
    listed = prototypes.where("vec is not null").groupBy(client).agg(F.sort_array(F.collect_list(F.struct("pid", "label", "vec"))).alias("bank"))
    listed = stored(listed, "bank")
    most, width = listed.agg(F.max(F.size("bank")), F.max(F.size(F.col("bank")[0]["vec"]))).first()
    if not most:
        return prototypes.select(client, "pid", "label", "vec").limit(0)
    net = margin_prototypes(most, width, margin)
    missing = F.lit(most) - F.size("bank")
    codes = F.concat(F.flatten(F.transform("bank", lambda b: b["vec"].cast("array<double>"))), F.array_repeat(F.lit(0.0), (missing * width).cast("int")))
    labels = F.concat(F.transform("bank", lambda b: b["label"].cast("double")), F.array_repeat(F.lit(float("nan")), missing.cast("int")))
    start = listed.select(F.col(client).alias("owner"), F.concat(codes, labels).alias("params"))
    blocks = row_blocks(rows.where("label is not null").select(client, F.concat(F.col("vec").cast("array<double>"), F.array(F.col("label").cast("double"))).alias("x")), client, packed=True)
    moved, _ = trained(stored(blocks, "blocks"), start, net, steps, rate, adam=True)
    joined = listed.join(moved.select(F.col("owner").alias(client), "params"), client, "left")
    each = joined.select(client, "params", F.posexplode("bank").alias("at", "b"))
    vector = F.when(F.col("params").isNull(), F.col("b.vec")).otherwise(F.slice("params", F.col("at") * width + 1, F.lit(width)))
    return each.select(client, "b.pid", "b.label", vector.alias("vec"))


def kmeans_grid(rows: DataFrame, grid: Sequence[int], rounds: int = 5) -> DataFrame:
    """``group, size, c, vec, n``: Lloyd's rounds of every group with every number of centres of ``grid``, in common jobs.

    As ``kmeans``, whose centres each cell's are.  The centres of a group's
    whole grid are one row; each row of data is compared with all of them and
    counted once per size.  ``grid`` and the groups' centres must be few.
    """
    sizes = sorted(set(grid))
    order = Window.partitionBy("group").orderBy("key")
    first = rows.withColumn("c", F.row_number().over(order)).where(F.col("c") <= max(sizes)).withColumn("c", F.col("c") - 1)
    centres = first.select(F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"), "group", "c", "vec").where("c < size")
    centres = stored(centres.select("group", "size", "c", "vec", F.lit(0).cast("long").alias("n")), "centres")
    for _ in range(rounds):
        placed = nearest_in_grid(rows, centres, sizes).select("group", F.explode("nearest").alias("at"), "vec")
        cells = placed.select("group", "at.size", "at.c", F.posexplode("vec").alias("dim", "v"))
        means = cells.groupBy("group", "size", "c", "dim").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
        packed = means.groupBy("group", "size", "c").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("vec"), F.max("n").alias("n")
        )
        following = stored(packed, "centres")
        discard(centres)
        centres = following
    return centres


def nearest_in_grid(rows: DataFrame, centres: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Adds ``nearest``: per size the nearest centre (``size, d, c``); ties to the lowest."""
    book = centres.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("size", "c", "vec"))).alias("codes"))
    best = lambda size: F.array_min(
        F.transform(
            F.filter("codes", lambda p: p["size"] == size),
            lambda p: F.struct(sq_distance(F.col("vec"), p["vec"]).alias("d"), p["c"].alias("c")),
        )
    )
    found = F.array(*[F.struct(F.lit(s).alias("size"), best(s)["d"].alias("d"), best(s)["c"].alias("c")) for s in sizes])
    return rows.join(book, "group").withColumn("nearest", found).drop("codes")
