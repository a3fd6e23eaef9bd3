"""The fitted detector: saved, loaded and applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.vectors import top_mean, total
from fleetscope.operators import evaluate, parameters, windows
from fleetscope.operators.model import JointDetector, JointDetectorModel, ranked_windows, signal_scores
from fleetscope.plans.learned import SENSORS, SPAN, STRIDE, standardized_rows
from fleetscope.plans.registry import ORACLES, register
from fleetscope.plans.storage import new_path, stored
from fleetscope.plans.sweeps import metrics
from fleetscope.plans.views import EMBEDDED, embedded, prototypes


def reloaded(spark, sf_dir, **values) -> JointDetectorModel:
    """A detector fitted on all windows with the clients' prototypes, written and read again."""
    model = JointDetector(codebook=prototypes(spark, sf_dir), key="vec_id", **values).fit(embedded(spark, sf_dir))
    path = new_path(spark, "model")
    model.save(path)
    return JointDetectorModel.load(path)


@register("mdl01_detection_report", ORACLES["slice_detection_report"])
def detection_report(spark, sf_dir):
    """The detection report from a saved and reloaded model."""
    scores = signal_scores(reloaded(spark, sf_dir).transform(embedded(spark, sf_dir)), ["client", "label"])
    rows = scores.select("client", "signal", F.round("score", 6).alias("score"), (F.col("label") < 3).alias("bad"))
    return metrics(rows, ["client", "signal"])


@register("mdl01_device_scores", f"""
    WITH {EMBEDDED}, s AS (SELECT client, vec_id, round(avg(g), 6) AS score FROM dn GROUP BY ALL),
    q AS (SELECT client, node, quantile_cont(g, 0.5) AS med, quantile_cont(g, 0.75) - quantile_cont(g, 0.25) AS iqr FROM dn GROUP BY ALL),
    z AS (SELECT vec_id, round(sum((g - med) / greatest(iqr, 1e-8)), 5) AS z_total FROM dn JOIN q USING (client, node) GROUP BY vec_id)
    SELECT client, vec_id, score, z_total, row_number() OVER (PARTITION BY client ORDER BY score DESC, vec_id) AS rank FROM s JOIN z USING (vec_id)
    QUALIFY rank <= 10
""")
def device_scores(spark, sf_dir):
    """The ten windows of each client that the reloaded model finds most deviant, with the sum of their nodes' robust scores."""
    scored = reloaded(spark, sf_dir).transform(embedded(spark, sf_dir))
    rounded = scored.select("client", "vec_id", F.round("device_score", 6).alias("score"), F.round(total(F.col("z_node")), 5).alias("z_total"))
    return ranked_windows(rounded, "client", "vec_id", "score", 10).withColumn("rank", F.col("rank").cast("long"))


#: Embedding of a node of the federated run.
CODER = parameters.autoencoder(SPAN, 3)


def labelled_windows(spark, sf_dir) -> DataFrame:
    """``client, session, k, x`` (an array per sensor), ``fault`` (any row of the window is) and ``split``.

    Normal windows are split by time per client; windows with a fault are only tested.
    """
    rows = standardized_rows(spark, sf_dir, F.col("l_returnflag") == "R")
    packed = windows.count_windows(rows, ["session"], "seq", F.struct("v", "flag"), SPAN, STRIDE)
    by_node = F.transform(F.sequence(F.lit(0), F.lit(len(SENSORS) - 1)), lambda i: F.transform("x", lambda row: row["v"][i]))
    found = packed.select((F.col("session") % 4).alias("client"), "session", "k", by_node.alias("nodes"), F.exists("x", lambda row: row["flag"]).alias("fault"))
    found = stored(found, "labelled-windows")
    normal = windows.chronological_split(found.where("not fault"), ["client"], ["k", "session"])
    return normal.unionByName(found.where("fault").withColumn("split", F.lit("test")))


def federated_scores(spark, sf_dir) -> DataFrame:
    """``client, session, k, fault, score`` of the tested windows, from sensor rows to scores.

    The clients train a shared node encoder in rounds on their fit windows, each
    fits its detector on its own embeddings, and a window's score is the mean of
    its three largest robust node scores.
    """
    found = stored(labelled_windows(spark, sf_dir), "windows")
    fit = found.where("split = 'fit'").select("client", F.flatten("nodes").alias("x"))
    blocks = parameters.stored_blocks(fit, "client", per=len(SENSORS))
    encoder, _ = parameters.federated_rounds(blocks, CODER, rounds=3, local_steps=2, rate=0.2)
    flat = found.withColumn("x", F.flatten("nodes"))
    coded = parameters.applied(flat, encoder, "client", "x", "codes", lambda x, p: parameters.encoded(x.reshape(-1, SPAN), CODER.unpack(p)))
    width = 3
    z = F.transform(F.sequence(F.lit(0), F.lit(len(SENSORS) - 1)), lambda i: F.slice("codes", i * width + 1, width))
    embedded_windows = stored(coded.select("client", "session", "k", "fault", "split", z.alias("z"), F.struct("k", "session").alias("key")), "embedded")
    learned = embedded_windows.where("split <> 'test'").withColumn("calib", F.col("split") == "calib")
    model = JointDetector(calibration="calib", prototypes=3, rounds=3).fit(learned)
    scored = model.transform(embedded_windows.where("split = 'test'"))
    return scored.select("client", "session", "k", "fault", top_mean(F.col("z_node"), 3).alias("score"))


@register("slice_federated_detection")
def federated_detection(spark, sf_dir):
    """Rounds in front of the scores: how well each client's tested windows with faults stand out."""
    rows = stored(federated_scores(spark, sf_dir), "scores").withColumn("score", F.round("score", 6))
    out = evaluate.detection_metrics(rows, ["client"], "score", F.col("fault"))
    return out.select("client", "n", F.round("auroc", 4).alias("auroc"))
