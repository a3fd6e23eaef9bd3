"""Node relations, forecasts and clustered models on the test tables."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fleetscope.operators import relations, windows
from fleetscope.plans.calibration import node_rows
from fleetscope.plans.cleaning import WINDOWS_8_4, windows_8_4
from fleetscope.plans.registry import register, table
from fleetscope.plans.storage import stored
from fleetscope.plans.views import EMBEDDED, embedded

RING = "nb AS (SELECT n AS node, (n + o) % 8 AS neighbour, (o - 2) * 0.5::DOUBLE AS logit FROM (SELECT unnest(range(8)) AS n), (SELECT unnest([1, 2, 4]) AS o))"


def cells(spark, sf_dir):
    return node_rows(spark, sf_dir).select("vec_id", "client", F.col("node").cast("long").alias("node"), F.col("g").alias("d"))


def ring(spark):
    offsets = F.explode(F.array(*[F.lit(o) for o in (1, 2, 4)]))
    rows = spark.range(8).select(F.col("id").alias("node"), offsets.alias("o"))
    return rows.select("node", ((F.col("node") + F.col("o")) % 8).alias("neighbour"), ((F.col("o") - 2) * 0.5).alias("logit"))


@register("att02_attention_residual", f"""
    WITH {EMBEDDED}, {RING}, lr AS (SELECT node, neighbour, CASE WHEN logit > 0 THEN logit ELSE 0.2 * logit END AS l FROM nb),
    wt AS (SELECT node, neighbour, exp(l) / sum(exp(l)) OVER (PARTITION BY node) AS w FROM lr),
    ex AS (SELECT dn.vec_id, wt.node, sum(w * g) AS expected FROM dn JOIN wt ON wt.neighbour = dn.node GROUP BY ALL)
    SELECT vec_id, node, round(expected, 6) AS expected, round(pow(g - expected, 2), 6) AS residual FROM dn JOIN ex USING (vec_id, node)
""")
def att02(spark, sf_dir):
    out = relations.attended(cells(spark, sf_dir), ring(spark), ["vec_id"])
    return out.select("vec_id", "node", F.round("expected", 6).alias("expected"), F.round("residual", 6).alias("residual"))


@register("att03_edge_residual", f"""
    WITH {EMBEDDED}, eg AS (SELECT unnest([0, 1, 2, 5]) AS src, unnest([1, 2, 3, 3]) AS dst),
    pq AS (SELECT a.vec_id, a.client, src, dst, a.g AS x, b.g AS y FROM dn a JOIN eg ON src = a.node JOIN dn b ON b.vec_id = a.vec_id AND b.node = dst),
    ft AS (SELECT client, src, dst, regr_slope(y, x) AS k, regr_intercept(y, x) AS c FROM pq WHERE vec_id % 3 = 0 GROUP BY ALL HAVING count(*) >= 5),
    sp AS (SELECT client, src, dst, k, c, avg(y - c - k * x) AS m, stddev_pop(y - c - k * x) + 1e-8 AS s FROM pq JOIN ft USING (client, src, dst) WHERE vec_id % 3 = 0 GROUP BY ALL),
    wr AS (SELECT vec_id, dst AS node, max(greatest((y - c - k * x - m) / s, 0)) AS r FROM pq JOIN sp USING (client, src, dst) GROUP BY ALL)
    SELECT dn.vec_id, dn.node, round(coalesce(r, 0), 4) AS r_edge FROM dn LEFT JOIN wr USING (vec_id, node)
""")
def att03(spark, sf_dir):
    rows = stored(cells(spark, sf_dir), "cells")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 3)], "src long, dst long")
    maps = relations.edge_maps(rows.where("vec_id % 3 = 0"), edges, "client", ["vec_id"])
    out = relations.edge_residuals(rows, edges, maps, "client", ["vec_id"])
    return out.select("vec_id", "node", F.round("r_edge", 4).alias("r_edge"))


@register("fcs02_forecast_residual", f"""
    WITH {WINDOWS_8_4}, pairs AS (SELECT session, k, tail FROM full_w a WHERE EXISTS (SELECT 1 FROM full_w b WHERE b.session = a.session AND b.k = a.k + 2))
    SELECT pairs.session, k, round(sum(pow(value - pairs.tail, 2)), 4) AS k_resid
    FROM pairs JOIN ev ON ev.session = pairs.session AND ev.seq >= k * 4 + 8 AND ev.seq < k * 4 + 16 GROUP BY ALL
""")
def fcs02(spark, sf_dir):
    """The forecast is the window's last value."""
    paired = windows.forecast_pairs(windows_8_4(spark, sf_dir), ["session"], "k", 2)
    ahead = windows.future_values(paired, ["session"], "k", "x", 4, 2).where("paired")
    held = ahead.withColumn("guess", F.transform("future", lambda _: F.col("x")[7]))
    return relations.forecast_residual(held, ["session", "k"], "future", "guess").withColumn("k_resid", F.round("k_resid", 4))


@register("loc05_series_residual", f"""
    WITH {WINDOWS_8_4}, h AS (SELECT session, k, s, lead(s) OVER (PARTITION BY session ORDER BY k) AS next_s FROM full_w)
    SELECT session, count(*) AS n, round(sum(pow(next_s - s, 2)), 3) AS total FROM h WHERE next_s IS NOT NULL GROUP BY session
""")
def loc05(spark, sf_dir):
    from pyspark.sql import Window

    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    rows = windows_8_4(spark, sf_dir).select("session", "k", total.alias("s"))
    ahead = rows.withColumn("next_s", F.lead("s").over(Window.partitionBy("session").orderBy("k"))).where("next_s is not null")
    gap = F.col("next_s") - F.col("s")
    return ahead.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(gap * gap), 3).alias("total"))


@register("fed13_nearest_replica", f"""
    WITH {EMBEDDED}, ls AS (SELECT client, m AS replica, avg(d) AS loss FROM (SELECT vec_id, client, m, sum(g) AS d FROM gaps GROUP BY ALL) GROUP BY ALL)
    SELECT client, replica, round(loss, 6) AS loss FROM ls QUALIFY row_number() OVER (PARTITION BY client ORDER BY loss, replica) = 1
""")
def fed13(spark, sf_dir):
    from fleetscope.functions import vectors as V
    from fleetscope.operators.memory import codebook
    from fleetscope.plans.views import prototypes

    joined = embedded(spark, sf_dir).join(codebook(prototypes(spark, sf_dir)), "client")
    each = joined.select("client", "z", F.explode("codes").alias("code"))
    apart = V.total(F.zip_with("z", F.col("code.z"), V.sq_distance))
    losses = each.groupBy("client", F.col("code.m").alias("replica")).agg(F.avg(apart).alias("loss"))
    return relations.nearest_replica(losses).withColumn("loss", F.round("loss", 6))


@register("phy01_regression", """
    SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY ALL
""")
def phy01(spark, sf_dir):
    out = relations.regression_residuals(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"))


@register("plt01_explained_variance")
def plt01(spark, sf_dir):
    data = embedded(spark, sf_dir).select(array_to_vector("v").alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="z").fit(data)
    shares = [float(v) for v in model.explainedVariance]
    return spark.createDataFrame(list(enumerate(shares)), "component long, share double")


@register("src10_dataset_without_dead_columns", "SELECT o_orderstatus AS client, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY ALL")
def src10(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").drop("o_orderpriority", "o_orderdate")
    return rows.where("o_totalprice > 1000").groupBy(F.col("o_orderstatus").alias("client")).agg(F.count(F.lit(1)).alias("n"))
