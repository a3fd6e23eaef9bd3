"""Prototype memory, calibration, scores and fusion on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetscope.functions import vectors as V
from fleetscope.operators import memory, scoring
from fleetscope.plans.cleaning import split_rows
from fleetscope.plans.registry import register
from fleetscope.plans.storage import stored
from fleetscope.plans.views import EMBEDDED, EVENTS, WIDE, embedded, melted, prototypes, telemetry

LONG = f"""
    {WIDE}, lng AS (
        SELECT client, split, node, x FROM (
            UNPIVOT (SELECT client, split, quantity, price, discount, tax FROM marked) ON quantity, price, discount, tax INTO NAME node VALUE x)
    ), st AS (
        SELECT client, node, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, count(*) AS n
        FROM lng WHERE split = 'calib' GROUP BY ALL
    )"""


def long_rows(spark, sf_dir):
    return melted(split_rows(spark, sf_dir).select("client", "split", "quantity", "price", "discount", "tax"))


def calib_stats(spark, sf_dir):
    return scoring.robust_stats(long_rows(spark, sf_dir).where("split = 'calib'"), ["client", "node"], "x")


def assigned(spark, sf_dir):
    return memory.assign(embedded(spark, sf_dir), prototypes(spark, sf_dir))


def node_rows(spark, sf_dir):
    return assigned(spark, sf_dir).select("vec_id", "client", "label", "m", "d_proto", F.posexplode("d_node").alias("node", "g"))


@register("vq01_nearest_prototype", f"WITH {EMBEDDED} SELECT vec_id, client, m, round(d_proto, 6) AS d_proto FROM near")
def vq01(spark, sf_dir):
    return assigned(spark, sf_dir).select("vec_id", "client", "m", F.round("d_proto", 6).alias("d_proto"))


@register("jon02_nearest_node_distances", f"WITH {EMBEDDED} SELECT vec_id, m, node, round(g, 6) AS d_node FROM dn")
def jon02(spark, sf_dir):
    return node_rows(spark, sf_dir).select("vec_id", "m", F.col("node").cast("long").alias("node"), F.round("g", 6).alias("d_node"))


@register("vq02_usage", f"WITH {EMBEDDED} SELECT pr.client, pr.m, count(near.vec_id) AS n FROM pr LEFT JOIN near USING (client, m) GROUP BY ALL")
def vq02(spark, sf_dir):
    return memory.usage(assigned(spark, sf_dir), prototypes(spark, sf_dir))


@register("vq03_commitment", f"""
    WITH {EMBEDDED} SELECT client, round(sum(d_proto) / (64 * count(*)), 8) AS loss FROM near GROUP BY client
""")
def vq03(spark, sf_dir):
    return memory.commitment(assigned(spark, sf_dir), prototypes(spark, sf_dir)).withColumn("loss", F.round("loss", 8))


@register("vq04_utilization", f"""
    WITH {EMBEDDED}, u AS (SELECT pr.client, pr.m, count(near.vec_id) AS n FROM pr LEFT JOIN near USING (client, m) GROUP BY ALL)
    SELECT client, avg((n > 1)::INT)::DOUBLE AS utilization FROM u GROUP BY client
""")
def vq04(spark, sf_dir):
    used = memory.usage(assigned(spark, sf_dir), prototypes(spark, sf_dir))
    return memory.utilization(used.withColumn("n", F.col("n") - 1))


@register("vq05_replaced_codebook", f"""
    WITH {EMBEDDED} SELECT m, count(*) AS clients, 0::BIGINT AS n FROM pr GROUP BY m
""")
def vq05(spark, sf_dir):
    fresh = prototypes(spark, sf_dir).groupBy("m").agg(F.count(F.lit(1)).alias("clients"))
    return fresh.withColumn("n", F.lit(0).cast("long"))


COV2 = f"""
    {EMBEDDED}, two AS (
        SELECT vec_id, client, m, max(g) FILTER (node = 0) AS a, max(g) FILTER (node = 1) AS b FROM dn GROUP BY ALL
    ), own AS (
        SELECT client, m, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) + 0.01 AS vaa, var_samp(b) + 0.01 AS vbb, covar_samp(a, b) AS vab
        FROM two GROUP BY ALL
    ), whole AS (
        SELECT client, avg(a) AS ma, avg(b) AS mb, var_samp(a) + 0.01 AS vaa, var_samp(b) + 0.01 AS vbb, covar_samp(a, b) AS vab
        FROM two GROUP BY ALL
    ), used AS (
        SELECT two.*, CASE WHEN own.n >= 20 THEN own.ma ELSE whole.ma END AS ma, CASE WHEN own.n >= 20 THEN own.mb ELSE whole.mb END AS mb,
               CASE WHEN own.n >= 20 THEN own.vaa ELSE whole.vaa END AS vaa, CASE WHEN own.n >= 20 THEN own.vbb ELSE whole.vbb END AS vbb,
               CASE WHEN own.n >= 20 THEN own.vab ELSE whole.vab END AS vab
        FROM two JOIN own USING (client, m) JOIN whole USING (client)
    ), h AS (
        SELECT *, (vbb * (a - ma) - vab * (b - mb)) / (vaa * vbb - vab * vab) * (a - ma) AS ha,
                  (vaa * (b - mb) - vab * (a - ma)) / (vaa * vbb - vab * vab) * (b - mb) AS hb FROM used
    )"""


def two_nodes(spark, sf_dir):
    return assigned(spark, sf_dir).withColumn("d_node", F.slice("d_node", 1, 2))


def joint(spark, sf_dir):
    rows = stored(two_nodes(spark, sf_dir), "assigned")
    own = memory.covariance_stats(rows, ["client", "m"], min_samples=20)
    return memory.mahalanobis(rows, own, memory.covariance_stats(rows, ["client"]))


@register("cov01_covariance", f"""
    WITH {COV2} SELECT client, m, n, n >= 20 AS valid, round(ma, 6) AS mu0, round(vbb / (vaa * vbb - vab * vab), 4) AS p00,
                       round(-vab / (vaa * vbb - vab * vab), 4) AS p01 FROM own WHERE n > 1
""")
def cov01(spark, sf_dir):
    stats = memory.covariance_stats(two_nodes(spark, sf_dir), ["client", "m"], min_samples=20).where("n > 1")
    return stats.select(
        "client", "m", "n", "valid", F.round(F.col("mu")[0], 6).alias("mu0"),
        F.round(F.col("precision")[0][0], 4).alias("p00"), F.round(F.col("precision")[0][1], 4).alias("p01"),
    )


@register("cov02_mahalanobis", f"WITH {COV2} SELECT vec_id, round(ha + hb, 5) AS d_mahal FROM h")
def cov02(spark, sf_dir):
    return joint(spark, sf_dir).select("vec_id", F.round("d_mahal", 5).alias("d_mahal"))


@register("cov03_contributions", f"WITH {COV2} SELECT vec_id, round(ha, 5) AS h0, round(hb, 5) AS h1 FROM h")
def cov03(spark, sf_dir):
    return joint(spark, sf_dir).select(
        "vec_id", F.round(F.col("h_node")[0], 5).alias("h0"), F.round(F.col("h_node")[1], 5).alias("h1")
    )


@register("cov02_full_rank")
def cov02_full(spark, sf_dir):
    """All eight nodes; SQL has no matrix inverse."""
    rows = stored(assigned(spark, sf_dir), "assigned")
    own = memory.covariance_stats(rows, ["client", "m"], min_samples=9)
    out = memory.mahalanobis(rows, own, memory.covariance_stats(rows, ["client"]))
    return out.select("vec_id", "client", "m", "d_mahal", "h_node")


@register("att01_neighbours", f"""
    WITH {EMBEDDED}, nv AS (SELECT m AS proto, node, list_transform(range(1, 9), lambda k: pv[node * 8 + k]) AS vec
                            FROM pr, (SELECT unnest(range(8)) AS node) WHERE client = 0 AND m = 0),
    s AS (SELECT a.node, b.node AS neighbour, round(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), 12) AS sim
          FROM nv a JOIN nv b ON a.node <> b.node)
    SELECT node, row_number() OVER (PARTITION BY node ORDER BY sim DESC, neighbour) AS rank, neighbour, round(sim, 6) AS sim FROM s
    QUALIFY row_number() OVER (PARTITION BY node ORDER BY sim DESC, neighbour) <= 3
""")
def att01(spark, sf_dir):
    one = prototypes(spark, sf_dir).where("client = 0 and m = 0").select(F.posexplode("z").alias("node", "vec"))
    out = memory.nearest_nodes(one, 3)
    return out.select(
        F.col("node").cast("long").alias("node"), F.col("rank").cast("long").alias("rank"),
        F.col("neighbour").cast("long").alias("neighbour"), F.round("sim", 6).alias("sim"),
    )


@register("scr02_device_score", f"WITH {EMBEDDED} SELECT vec_id, round(sum(g * (1 + node)) / 8, 6) AS score FROM dn GROUP BY vec_id")
def scr02(spark, sf_dir):
    weighed = F.transform("d_node", lambda d, i: d * (i + 1))
    return assigned(spark, sf_dir).select("vec_id", F.round(V.total(weighed) / F.size("d_node"), 6).alias("score"))


@register("scr03_node_reconstruction", f"""
    WITH {EMBEDDED} SELECT client, node, round(avg(g / 8), 8) AS loss FROM dn GROUP BY ALL
""")
def scr03(spark, sf_dir):
    out = node_rows(spark, sf_dir).groupBy("client", F.col("node").cast("long").alias("node"))
    return out.agg(F.round(F.avg(F.col("g") / 8), 8).alias("loss"))


@register("scr01_scores", f"""
    WITH {EMBEDDED} SELECT vec_id, m, round(d_proto, 6) AS d_proto, round(max(g), 6) AS largest, arg_max(node, (round(g, 9), -node)) AS worst
    FROM dn GROUP BY vec_id, m, d_proto
""")
def scr01(spark, sf_dir):
    rounded = F.transform("d_node", lambda d, i: F.struct(F.round(d, 9).alias("d"), (-i).alias("i")))
    return assigned(spark, sf_dir).select(
        "vec_id", "m", F.round("d_proto", 6).alias("d_proto"), F.round(F.array_max("d_node"), 6).alias("largest"),
        (-F.array_max(rounded)["i"]).cast("long").alias("worst"),
    )


@register("agg01_robust_stats", f"WITH {LONG} SELECT client, node, n, round(med, 6) AS med, round(iqr, 6) AS iqr FROM st")
def agg01(spark, sf_dir):
    return calib_stats(spark, sf_dir).select("client", "node", "n", F.round("med", 6).alias("med"), F.round("iqr", 6).alias("iqr"))


@register("agg01_robust_stats_ranked", f"WITH {LONG} SELECT client, node, n, round(med, 6) AS med, round(iqr, 6) AS iqr FROM st")
def agg01_ranked(spark, sf_dir):
    rows = long_rows(spark, sf_dir).where("split = 'calib'")
    out = scoring.robust_stats(rows, ["client", "node"], "x", method="ranked")
    return out.select("client", "node", "n", F.round("med", 6).alias("med"), F.round("iqr", 6).alias("iqr"))


@register("agg02_informative_floor", f"""
    WITH {LONG} SELECT client, node, round(greatest(iqr, 0.4 * quantile_cont(iqr, 0.5) FILTER (iqr > 1e-6) OVER (PARTITION BY client), 1e-8), 6) AS iqr FROM st
""")
def agg02(spark, sf_dir):
    out = scoring.informative_floor(calib_stats(spark, sf_dir), "client", 0.4)
    return out.select("client", "node", F.round("iqr", 6).alias("iqr"))


WORST = f"""
    {LONG}, z AS (
        SELECT m.client, m.fault, m.split, greatest(
            (quantity - q.med) / greatest(q.iqr, 1e-8), (price - p.med) / greatest(p.iqr, 1e-8),
            (discount - d.med) / greatest(d.iqr, 1e-8), (tax - t.med) / greatest(t.iqr, 1e-8)) AS score
        FROM marked m JOIN st q ON q.client = m.client AND q.node = 'quantity' JOIN st p ON p.client = m.client AND p.node = 'price'
             JOIN st d ON d.client = m.client AND d.node = 'discount' JOIN st t ON t.client = m.client AND t.node = 'tax'
    )"""


def wide_scores(spark, sf_dir):
    """Largest node z of each wide row; four statistics per client arrive as one map."""
    stats = calib_stats(spark, sf_dir).groupBy("client").agg(
        F.map_from_entries(F.collect_list(F.struct("node", F.struct("med", "iqr").alias("s")))).alias("st")
    )
    rows = split_rows(spark, sf_dir).join(F.broadcast(stats), "client")  # one row per line status
    z = [
        (F.col(c) - F.col("st")[c]["med"]) / F.greatest(F.col("st")[c]["iqr"], F.lit(1e-8))
        for c in ("quantity", "price", "discount", "tax")
    ]
    return rows.withColumn("score", F.greatest(*z)).select("client", "fault", "split", "score")


@register("agg03_largest_node_z", f"WITH {WORST} SELECT client, split, count(*) AS n, round(avg(score), 6) AS mean, round(max(score), 6) AS largest FROM z GROUP BY ALL")
def agg03(spark, sf_dir):
    return wide_scores(spark, sf_dir).groupBy("client", "split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("largest")
    )


NODE_Z = f"""
    {EMBEDDED}, cal AS (SELECT *, vec_id % 3 = 0 AS calib FROM dn), ns AS (
        SELECT client, node, quantile_cont(g, 0.5) AS med, quantile_cont(g, 0.75) - quantile_cont(g, 0.25) AS iqr FROM cal WHERE calib GROUP BY ALL
    ), nz AS (SELECT cal.*, iqr, (g - med) / greatest(iqr, 1e-8) AS z FROM cal JOIN ns USING (client, node)),
    tk AS (SELECT vec_id, client, calib, avg(z) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC) AS r FROM nz) WHERE r <= 3 GROUP BY ALL),
    s2 AS (SELECT client, quantile_cont(score, 0.5) AS med, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM tk WHERE calib GROUP BY ALL)"""


def node_z(spark, sf_dir):
    rows = node_rows(spark, sf_dir)
    stats = scoring.robust_stats(rows.where("vec_id % 3 = 0"), ["client", "node"], "g")
    return scoring.z_scores(rows, stats, ["client", "node"], "g")


@register("agg04_top_k_mean", f"WITH {NODE_Z} SELECT vec_id, round(score, 5) AS score FROM tk")
def agg04(spark, sf_dir):
    return scoring.top_k_mean(node_z(spark, sf_dir), ["vec_id"], 3).select("vec_id", F.round("score", 5).alias("score"))


@register("agg05_two_stage", f"WITH {NODE_Z} SELECT vec_id, round((score - med) / greatest(iqr, 1e-8), 5) AS z FROM tk JOIN s2 USING (client)")
def agg05(spark, sf_dir):
    out = scoring.two_stage(node_rows(spark, sf_dir), F.col("vec_id") % 3 == 0, "client", ["vec_id"], "node", "g", 3)
    return out.select("vec_id", F.round("z", 5).alias("z"))


PROTO_Z = f"""
    {EMBEDDED}, cal AS (SELECT * FROM dn WHERE vec_id % 3 = 0), ps AS (
        SELECT client, m, node, count(*) AS n, quantile_cont(g, 0.5) AS med, quantile_cont(g, 0.75) - quantile_cont(g, 0.25) AS iqr FROM cal GROUP BY ALL
    ), gs AS (
        SELECT client, node, count(*) AS n, quantile_cont(g, 0.5) AS med, quantile_cont(g, 0.75) - quantile_cont(g, 0.25) AS iqr FROM cal GROUP BY ALL
    ), pz AS (
        SELECT dn.vec_id, dn.client, dn.m, dn.node, CASE WHEN ps.n >= 5 THEN (g - ps.med) / greatest(ps.iqr, 1e-8) ELSE (g - gs.med) / greatest(gs.iqr, 1e-8) END AS z
        FROM dn LEFT JOIN ps USING (client, m, node) JOIN gs USING (client, node)
    )"""


def proto_stats(spark, sf_dir):
    return scoring.prototype_stats(node_rows(spark, sf_dir).where("vec_id % 3 = 0"), "client", "m", "node", "g")


def proto_z(spark, sf_dir):
    rows = stored(node_rows(spark, sf_dir), "node-rows")
    stats = stored(scoring.prototype_stats(rows.where("vec_id % 3 = 0"), "client", "m", "node", "g"), "stats")
    return scoring.prototype_z(rows, stats, "client", "m", "node", "g")


@register("agg06_prototype_stats", f"""
    WITH {PROTO_Z} SELECT client, m, node, n, round(med, 6) AS med, n >= 5 AS valid FROM ps
    UNION ALL SELECT client, NULL, node, n, round(med, 6), true FROM gs
""")
def agg06(spark, sf_dir):
    return proto_stats(spark, sf_dir).select(
        "client", "m", F.col("node").cast("long").alias("node"), "n", F.round("med", 6).alias("med"), "valid"
    )


@register("agg07_prototype_z", f"WITH {PROTO_Z} SELECT vec_id, node, round(z, 4) AS z FROM pz")
def agg07(spark, sf_dir):
    return proto_z(spark, sf_dir).select("vec_id", F.col("node").cast("long").alias("node"), F.round("z", 4).alias("z"))


@register("jon01_fallback_lookup", f"""
    WITH {PROTO_Z} SELECT dn.client, dn.m, count(*) AS cells, count(*) FILTER (coalesce(ps.n, 0) < 5) AS fallbacks
    FROM dn LEFT JOIN ps USING (client, m, node) GROUP BY ALL
""")
def jon01(spark, sf_dir):
    stats = proto_stats(spark, sf_dir).where("not overall").select("client", "m", "node", "valid")
    joined = node_rows(spark, sf_dir).join(stats, ["client", "m", "node"], "left")
    return joined.groupBy("client", "m").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(~F.coalesce("valid", F.lit(False))).alias("fallbacks")
    )


@register("agg08_prototype_two_stage", f"""
    WITH {PROTO_Z}, tk AS (SELECT vec_id, client, avg(z) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC) AS r FROM pz) WHERE r <= 3 GROUP BY ALL),
    s2 AS (SELECT client, quantile_cont(score, 0.5) AS med, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM tk WHERE vec_id % 3 = 0 GROUP BY ALL)
    SELECT vec_id, round((score - med) / greatest(iqr, 1e-8), 4) AS z FROM tk JOIN s2 USING (client)
""")
def agg08(spark, sf_dir):
    means = scoring.top_k_mean(proto_z(spark, sf_dir), ["vec_id", "client"], 3)
    stats = scoring.robust_stats(means.where("vec_id % 3 = 0"), ["client"], "score")
    return scoring.z_scores(means, stats, ["client"], "score").select("vec_id", F.round("z", 4).alias("z"))


@register("agg09_prototype_max", f"WITH {PROTO_Z} SELECT vec_id, round(max(z), 4) AS score FROM pz GROUP BY vec_id")
def agg09(spark, sf_dir):
    return scoring.max_over_nodes(proto_z(spark, sf_dir), ["vec_id"]).select("vec_id", F.round("score", 4).alias("score"))


@register("agg10_macro_mean", f"""
    WITH {EMBEDDED}, c AS (SELECT client, label, avg(d_proto) AS a FROM near GROUP BY ALL) SELECT round(avg(a), 6) AS mean, count(*) AS groups FROM c
""")
def agg10(spark, sf_dir):
    out = scoring.mean_of_means(assigned(spark, sf_dir), [], ["client", "label"], "d_proto")
    return out.select(F.round("mean", 6).alias("mean"), "groups")


@register("agg11_two_level_mean", """
    WITH n AS (SELECT n_regionkey, n_nationkey, avg(s_acctbal) AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
    SELECT n_regionkey, round(avg(a), 6) AS mean, count(*) AS groups FROM n GROUP BY n_regionkey
""")
def agg11(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(
        spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    out = scoring.mean_of_means(rows, ["n_regionkey"], ["n_nationkey"], "s_acctbal")
    return out.select("n_regionkey", F.round("mean", 6).alias("mean"), "groups")


@register("agg12_class_counts", f"WITH {EVENTS} SELECT client, node, count(*) AS n, count(DISTINCT session) AS sessions FROM ev GROUP BY ALL")
def agg12(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("client", "node").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("session").alias("sessions")
    )


@register("agg13_most_common", f"""
    WITH {EVENTS}, c AS (SELECT session, node, count(*) AS n FROM ev GROUP BY ALL)
    SELECT session, node, n, row_number() OVER (PARTITION BY session ORDER BY n DESC, node) AS rank FROM c
    QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC, node) <= 2
""")
def agg13(spark, sf_dir):
    return scoring.most_common(telemetry(spark, sf_dir), ["session"], "node", 2).withColumn("rank", F.col("rank").cast("long"))


SIGNALS = f"""
    {EMBEDDED}, sg AS (
        SELECT vec_id, client, 'FD' AS signal, d_proto AS score FROM near UNION ALL
        SELECT vec_id, client, 'MX', max(g) FROM dn GROUP BY ALL UNION ALL
        SELECT vec_id, client, 'PD', sum(g) FILTER (node < 4) FROM dn WHERE vec_id % 2 = 0 GROUP BY vec_id, client
    ), ls AS (SELECT client, signal, avg(score) AS loss FROM sg GROUP BY ALL),
    lz AS (SELECT client, signal, -(loss - avg(loss) OVER s) / (stddev_pop(loss) OVER s + 1e-8) AS z FROM ls WINDOW s AS (PARTITION BY signal)),
    cw AS (SELECT client, signal, exp(z - max(z) OVER c) / sum(exp(z)) OVER c * exp(max(z) OVER c) AS weight FROM lz WINDOW c AS (PARTITION BY client))"""


def signals(spark, sf_dir):
    """Three scores per window in long form; PD exists for even ids only, and no row means no score."""
    rows = assigned(spark, sf_dir)
    each = rows.select(
        "vec_id", "client",
        F.explode(
            F.array(
                F.struct(F.lit("FD").alias("signal"), F.col("d_proto").alias("score")),
                F.struct(F.lit("MX").alias("signal"), F.array_max("d_node").alias("score")),
                F.struct(F.lit("PD").alias("signal"), F.when(F.col("vec_id") % 2 == 0, V.total(F.slice("d_node", 1, 4))).alias("score")),
            )
        ).alias("s"),
    )
    return each.select("vec_id", "client", "s.signal", "s.score").where("score is not null")


def weights(spark, sf_dir):
    losses = signals(spark, sf_dir).groupBy("client", "signal").agg(F.avg("score").alias("loss"))
    return scoring.confidence_weights(losses, "client", "signal", "loss")


@register("fus01_smooth_max", f"""
    WITH {SIGNALS}, w AS (SELECT vec_id, score, exp(score - max(score) OVER (PARTITION BY vec_id)) AS w FROM sg)
    SELECT vec_id, round(sum(w * score) / sum(w), 6) AS score FROM w GROUP BY vec_id
""")
def fus01(spark, sf_dir):
    return scoring.smooth_max_over(signals(spark, sf_dir), ["vec_id"], "score").select("vec_id", F.round("score", 6).alias("score"))


@register("fus02_confidence_weights", f"WITH {SIGNALS} SELECT client, signal, round(weight, 5) AS weight FROM cw")
def fus02(spark, sf_dir):
    return weights(spark, sf_dir).select("client", "signal", F.round("weight", 5).alias("weight"))


@register("fus03_weighted_sum", f"WITH {SIGNALS} SELECT vec_id, round(sum(weight * score), 5) AS score FROM sg JOIN cw USING (client, signal) GROUP BY vec_id")
def fus03(spark, sf_dir):
    out = scoring.weighted_combination(signals(spark, sf_dir), weights(spark, sf_dir), ["vec_id"], "client", "signal", "score")
    return out.select("vec_id", F.round("score", 5).alias("score"))


@register("fus04_score_sets", f"""
    WITH {SIGNALS}, p AS (SELECT vec_id, max(score) FILTER (signal = 'FD') AS fd, max(score) FILTER (signal = 'MX') AS mx, max(score) FILTER (signal = 'PD') AS pd FROM sg GROUP BY vec_id),
    s AS (SELECT vec_id, 'FD' AS set_name, fd AS score FROM p UNION ALL SELECT vec_id, 'FD+MX', greatest(fd, mx) FROM p
          UNION ALL SELECT vec_id, 'FD+PD', greatest(fd, pd) FROM p WHERE pd IS NOT NULL)
    SELECT set_name, count(*) AS n, round(sum(score), 4) AS total FROM s GROUP BY set_name
""")
def fus04(spark, sf_dir):
    wide_form = signals(spark, sf_dir).groupBy("vec_id").pivot("signal", ["FD", "MX", "PD"]).agg(F.max("score"))
    sets = wide_form.select(
        "vec_id", F.col("FD").alias("FD"), F.greatest("FD", "MX").alias("FD+MX"),
        F.when(F.col("PD").isNotNull(), F.greatest("FD", "PD")).alias("FD+PD"),
    ).unpivot(["vec_id"], ["FD", "FD+MX", "FD+PD"], "set_name", "score")
    return sets.where("score is not null").groupBy("set_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


@register("fus05_guarded_weights", f"""
    WITH {SIGNALS}, k AS (SELECT client, count(DISTINCT signal) = 3 AS complete FROM sg GROUP BY client), g AS (SELECT bool_and(complete) AS every FROM k)
    SELECT client, signal, round(CASE WHEN every THEN weight END, 5) AS weight FROM cw, g
""")
def fus05(spark, sf_dir):
    complete = signals(spark, sf_dir).groupBy("client").agg((F.count_distinct("signal") == 3).alias("complete"))
    every = complete.agg(F.bool_and("complete").alias("every"))
    joined = weights(spark, sf_dir).crossJoin(F.broadcast(every))  # one row
    return joined.select("client", "signal", F.round(F.when(F.col("every"), F.col("weight")), 5).alias("weight"))


@register("ana01_score_order", f"WITH {EMBEDDED} SELECT vec_id, client, row_number() OVER (PARTITION BY client ORDER BY round(d_proto, 9) DESC, vec_id) AS place FROM near")
def ana01(spark, sf_dir):
    order = Window.partitionBy("client").orderBy(F.round("d_proto", 9).desc(), "vec_id")
    return assigned(spark, sf_dir).select("vec_id", "client", F.row_number().over(order).cast("long").alias("place"))
