"""The composed detector as a Spark ML estimator and a model that can be saved.

Fitting learns, per client, a codebook, the covariance of node deviations around
each prototype, the robust statistics of every node, and on request a graph
attention head.  The model is those tables: saved as Parquet beside the
parameters, loaded on another day, and applied to new windows in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.vectors import mean, sq_distance
from fleetscope.operators import memory, parameters, scoring, training
from fleetscope.plans.storage import stored

#: The tables of a model; ``attention`` only where a head was trained.
TABLES = ("codebook", "by_prototype", "by_client", "node_stats", "attention")


class _DetectorParams(Params):
    """Parameters that the estimator and its model share."""

    client = Param(Params._dummy(), "client", "column of the client", TypeConverters.toString)
    key = Param(Params._dummy(), "key", "column that orders a client's windows", TypeConverters.toString)
    calibration = Param(Params._dummy(), "calibration", "boolean column: rows that calibrate, not train; empty: all rows do both", TypeConverters.toString)
    prototypes = Param(Params._dummy(), "prototypes", "prototypes of a client", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "rounds of k-means", TypeConverters.toInt)
    ridge = Param(Params._dummy(), "ridge", "ridge of the covariances", TypeConverters.toFloat)
    steps = Param(Params._dummy(), "steps", "training steps of the attention head, 0 for none", TypeConverters.toInt)
    neighbours = Param(Params._dummy(), "neighbours", "nodes that a node attends to", TypeConverters.toInt)
    nodes = Param(Params._dummy(), "nodes", "nodes of a window, set by fitting", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "values of a node, set by fitting", TypeConverters.toInt)

    def _with_defaults(self) -> None:
        self._setDefault(client="client", key="key", calibration="", prototypes=4, rounds=4, ridge=0.01, steps=0, neighbours=3, nodes=0, width=0)

    def _head(self) -> parameters.Network:
        nodes, width = self.getOrDefault("nodes"), self.getOrDefault("width")
        return parameters.graph_attention(nodes, width, width, self.getOrDefault("neighbours"))


def _deviations(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """The assigned windows with ``__x``: the nodes' differences from their prototype, and again as targets."""
    codes = codebook.select("client", "m", F.flatten("z").alias("__code"))
    gap = F.zip_with(F.flatten("z"), "__code", lambda a, b: a - b)
    return assigned.join(codes, ["client", "m"]).withColumn("__x", F.concat(gap, gap)).drop("__code")


class JointDetector(Estimator, _DetectorParams):
    """Fits a ``JointDetectorModel`` on windows with ``z``, an array of node vectors of equal lengths.

    Prototypes are the centres of k-means over the training rows of a client,
    unless ``codebook`` (``client, m, z``) is given.  Rows without a client or
    vector are left out.  Each client needs a training row; without calibration
    rows it has no statistics and its windows no robust scores.
    """

    def __init__(self, codebook: DataFrame | None = None, **values) -> None:
        super().__init__()
        self._with_defaults()
        self._set(**values)
        self.codebook = codebook

    def _fit(self, dataset: DataFrame) -> JointDetectorModel:
        flag = self.getOrDefault("calibration")
        rows = dataset.select(
            F.col(self.getOrDefault("client")).alias("client"), F.col(self.getOrDefault("key")).alias("key"), "z",
            (F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(True)).alias("calib"),
        ).where("client is not null and z is not null")
        rows = stored(rows, "windows")
        training_rows = rows.where(~F.col("calib")) if flag else rows
        sizes = rows.select(F.size("z").alias("nodes"), F.size(F.col("z")[0]).alias("width")).first()
        if sizes is None:
            raise ValueError("no windows to fit on")
        codebook = self.codebook if self.codebook is not None else self._codebook(training_rows, sizes["width"])
        codebook = stored(codebook.select("client", "m", "z"), "codebook")
        assigned = stored(memory.assign(rows, codebook), "assigned")
        calib = assigned.where("calib")
        ridge = self.getOrDefault("ridge")
        tables = {
            "codebook": codebook,
            "by_prototype": stored(memory.covariance_stats(calib, ["client", "m"], ridge), "by-prototype"),
            "by_client": stored(memory.covariance_stats(calib, ["client"], ridge), "by-client"),
            "node_stats": stored(scoring.robust_stats(calib.select("client", F.posexplode("d_node").alias("node", "d")), ["client", "node"], "d"), "node-stats"),
        }
        model = JointDetectorModel(tables)
        model._set(**{p.name: self.getOrDefault(p) for p in self.params})
        model._set(nodes=sizes["nodes"], width=sizes["width"])
        if self.getOrDefault("steps"):
            fitted = _deviations(assigned.where(~F.col("calib")) if flag else assigned, codebook)
            blocks = parameters.stored_blocks(fitted, "client", "__x")
            net = model._head()
            trained, _ = parameters.trained(blocks, parameters.parameter_table(blocks, net), net, self.getOrDefault("steps"), 0.02, adam=True)
            tables["attention"] = trained.select(F.col("owner").alias("client"), "params")
        return model

    def _codebook(self, rows: DataFrame, width: int) -> DataFrame:
        flat = rows.select(F.col("client").alias("group"), "key", F.flatten("z").alias("vec"))
        centres = training.kmeans(flat, self.getOrDefault("prototypes"), self.getOrDefault("rounds"))
        nodes = F.transform(F.sequence(F.lit(0), (F.size("vec") / width).cast("int") - 1), lambda i: F.slice("vec", i * width + 1, width))
        return centres.select(F.col("group").alias("client"), F.col("c").cast("long").alias("m"), nodes.alias("z"))


class _Writer(MLWriter):
    def __init__(self, instance: JointDetectorModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"tables": sorted(self.instance.tables)})
        for name, table in self.instance.tables.items():
            table.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def load(self, path: str) -> JointDetectorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = JointDetectorModel({name: self.sparkSession.read.parquet(f"{path}/{name}") for name in metadata["tables"]})
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class JointDetectorModel(Model, _DetectorParams, MLReadable, MLWritable):
    """Scores windows; the tables may come from fitting or from ``load``."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        super().__init__()
        self._with_defaults()
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        self.tables = tables

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """All rows and columns of clients that the model knows, with its signals.

        ``m``, ``d_proto``, ``d_node`` (nearest prototype), ``exemplar`` (per
        node the nearest code of that node), ``d_mahal`` and ``h_node``,
        ``z_node`` (robust z of ``d_node``, null without statistics),
        ``resid_struct`` with an attention head, and ``device_score``, the sum
        of the mean deviation and the mean structural residual.
        """
        client = self.getOrDefault("client")
        added = ["m", "d_proto", "d_node", "exemplar", "d_mahal", "h_node", "z_node", "resid_struct", "device_score"]
        rows = dataset.drop(*added)
        if client != "client":
            rows = rows.drop("client") if "client" in rows.columns else rows
            rows = rows.withColumnRenamed(client, "client")
        codebook = self.tables["codebook"]
        found = memory.assign(rows, codebook)
        codes = memory.codebook(codebook)
        nearest = F.transform(F.col("z"), lambda z, i: F.array_min(F.transform("codes", lambda code: sq_distance(z, code["z"][i]))))
        found = found.join(codes, "client").withColumn("exemplar", nearest).drop("codes")
        found = memory.mahalanobis(found, self.tables["by_prototype"], self.tables["by_client"])
        stats = self.tables["node_stats"].groupBy("client").agg(F.sort_array(F.collect_list(F.struct("node", "med", "iqr"))).alias("__stats"))
        floor = F.lit(1e-8)
        z = F.transform("__stats", lambda s: (F.col("d_node")[s["node"]] - s["med"]) / F.greatest(s["iqr"], floor))
        found = found.join(stats, "client", "left").withColumn("z_node", z).drop("__stats")
        score = mean(F.col("d_node"))
        if "attention" in self.tables:
            found = self._attended(found, codebook)
            score = score + mean(F.col("resid_struct"))
        found = found.withColumn("device_score", score)
        return found.withColumnRenamed("client", client) if client != "client" else found

    def _attended(self, found: DataFrame, codebook: DataFrame) -> DataFrame:
        net, k = self._head(), self.getOrDefault("neighbours")
        nodes, width = self.getOrDefault("nodes"), self.getOrDefault("width")
        params = self.tables["attention"].withColumnRenamed("client", "owner")
        expected = parameters.applied(_deviations(found, codebook), params, "client", "__x", "__expected", _head_function(net, k))
        gap = lambda i: sq_distance(F.slice("__x", i * width + 1, width), F.slice("__expected", i * width + 1, width))
        residuals = F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), gap)
        return expected.withColumn("resid_struct", residuals).drop("__x", "__expected")


def _head_function(net: parameters.Network, k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda x, flat: parameters.attention_output(net, x, net.unpack(flat), k)


def signal_scores(scored: DataFrame, keep: list[str]) -> DataFrame:
    """``keep.., signal, score``: joint distance, worst and mean exemplar deviation of each window, one row each."""
    total = F.aggregate("exemplar", F.lit(0.0), lambda s, v: s + v)
    signals = F.map_from_arrays(
        F.array(F.lit("joint"), F.lit("worst_node"), F.lit("mean_node")), F.array("d_proto", F.array_max("exemplar"), total / F.size("exemplar"))
    )
    return scored.select(*keep, F.explode(signals).alias("signal", "score"))


def ranked_windows(scored: DataFrame, client: str, key: str, score: str = "device_score", k: int = 10) -> DataFrame:
    """The ``k`` windows of each client with the highest score; ties by key."""
    order = Window.partitionBy(client).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
