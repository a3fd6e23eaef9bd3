"""Detection metrics as aggregations over distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.operators.scoring import ranked_quantiles
from fleetscope.operators.windows import running_sums, same_group


def score_counts(df: DataFrame, by: Sequence[str], score: str, truth: Column) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg")
    )


def detection_metrics(df: DataFrame, by: Sequence[str], score: str, truth: Column) -> DataFrame:
    """Per group: n, auroc, auprc and the best-F1 point (threshold, precision, recall, f1).

    AUROC counts ties half; AUPRC is the step-wise sum over distinct
    thresholds.  Of equal F1 the lowest threshold is taken.  Groups without
    both classes have null metrics; a null group is one too.
    """
    counts = score_counts(df, by, score, truth).withColumn("minus", -F.col("score"))
    sums = running_sums(counts, by, ["minus"], ["pos", "neg"])
    curve = same_group(sums, sums.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")), by)
    curve = curve.withColumnsRenamed({"run_pos": "tp", "run_neg": "fp"})
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp"), F.col("P"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P")), F.lit(0.0))
    below = F.col("N") - F.col("fp")
    both = (F.max("P") > 0) & (F.max("N") > 0)
    best = F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("minus"), precision.alias("p"), recall.alias("r")))
    out = curve.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.when(both, F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))) / (F.max("P") * F.max("N"))).alias("auroc"),
        F.when(both, F.sum(F.try_divide(F.col("pos"), F.col("P")) * precision)).alias("auprc"),
        F.when(both, best).alias("__best"),
    )
    return out.select(
        *by, "n", "auroc", "auprc", (-F.col("__best.minus")).alias("threshold"),
        F.col("__best.p").alias("precision"), F.col("__best.r").alias("recall"), F.col("__best.f1").alias("f1"),
    )


def threshold_metrics(df: DataFrame, by: Sequence[str], predicted: Column, truth: Column) -> DataFrame:
    """Precision, recall and F1 of a decision; divisions by zero give 0."""
    tp, fp, fn = F.count_if(truth & predicted), F.count_if(~truth & predicted), F.count_if(truth & ~predicted)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sums = df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return sums.select(
        *by, "tp", "fp", "fn", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def normal_threshold(df: DataFrame, by: Sequence[str], score: str, normal: Column, share: float = 0.95) -> DataFrame:
    """The share's percentile of normal scores; scores above it are alarms."""
    return ranked_quantiles(df.where(normal), by, score, [share]).select(*by, F.col("q")[0].alias("threshold"))


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column, name: str = "island") -> DataFrame:
    """Adds the number of the run of equal flags that a row is in."""
    ahead = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__flag", flag)
    change = F.coalesce((F.col("__flag") != F.lag("__flag").over(ahead)).cast("int"), F.lit(0))
    return marked.withColumn("__c", change).withColumn(name, F.sum("__c").over(ahead)).drop("__flag", "__c")


def point_adjusted(df: DataFrame, by: Sequence[str], order: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """Adds ``adjusted``: a true segment with any alarm is detected as a whole."""
    runs = islands(df, by, order, F.col(truth), "__island")
    hit = F.max(F.col(predicted).cast("int")).over(Window.partitionBy(*by, "__island")) == 1
    return runs.withColumn("adjusted", F.when(F.col(truth), hit).otherwise(F.col(predicted))).drop("__island")


def errors(df: DataFrame, by: Sequence[str], actual: str, expected: str) -> DataFrame:
    gap = F.col(actual) - F.col(expected)
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"))


def accuracy(df: DataFrame, by: Sequence[str], truth: str, predicted: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
