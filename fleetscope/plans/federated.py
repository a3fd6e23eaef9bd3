"""Server-side federation, skewed client sizes and learned parts on the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fleetscope.functions import vectors as V
from fleetscope.operators import federation, skew, training
from fleetscope.plans.registry import register, table
from fleetscope.plans.storage import stored
from fleetscope.plans.views import EMBEDDED, EVENTS, embedded, prototype_nodes, prototypes, telemetry

PARAMS = """
    pm AS (SELECT s_nationkey AS client, CASE s_suppkey % 3 WHEN 0 THEN 'encoder.w' WHEN 1 THEN 'head.w' ELSE 'steps' END AS name,
                  s_suppkey // 25 AS idx, avg(s_acctbal) AS value FROM supplier GROUP BY ALL),
    cn AS (SELECT c_nationkey AS client, count(*) AS n FROM customer GROUP BY ALL)"""


def parameters(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 3 == 0, "encoder.w").when(F.col("s_suppkey") % 3 == 1, "head.w").otherwise("steps")
    rows = table(spark, sf_dir, "supplier").groupBy(
        F.col("s_nationkey").alias("client"), name.alias("name"), F.floor(F.col("s_suppkey") / 25).alias("idx")
    )
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("client")).agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.avg("s_acctbal").alias("value")), counts


@register("fed01_weighted_average", f"""
    WITH {PARAMS} SELECT name, idx, round(sum(n * value) / sum(n), 5) AS value FROM pm JOIN cn USING (client) WHERE name LIKE 'encoder.%' GROUP BY ALL
""")
def fed01(spark, sf_dir):
    params, counts = parameters(spark, sf_dir)
    return federation.average_parameters(params, counts, prefixes=["encoder."]).withColumn("value", F.round("value", 5))


@register("fed02_full_average", f"""
    WITH {PARAMS}, a AS (SELECT name, idx, sum(n * value) / sum(n) AS value FROM pm JOIN cn USING (client) GROUP BY ALL)
    SELECT name, idx, round(CASE WHEN name = 'steps' THEN trunc(round(value, 6)) ELSE value END, 5) AS value FROM a
""")
def fed02(spark, sf_dir):
    params, counts = parameters(spark, sf_dir)
    return federation.average_parameters(params, counts, integers=["steps"]).withColumn("value", F.round("value", 5))


@register("fed14_payload_bytes", f"WITH {PARAMS} SELECT client, count(*) * 4 AS bytes FROM pm GROUP BY client")
def fed14(spark, sf_dir):
    return federation.payload_bytes(parameters(spark, sf_dir)[0], ["client"])


PAIRS = f"""
    {EMBEDDED}, pn AS (SELECT pid, client, node, list_transform(range(1, 9), lambda k: pv[node * 8 + k]) AS vec FROM pr, (SELECT unnest(range(8)) AS node)),
    pairs AS (SELECT a.pid AS a, b.pid AS b, avg(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)))) AS sim
              FROM pn a JOIN pn b ON a.node = b.node AND a.pid < b.pid AND a.client <> b.client GROUP BY ALL),
    lk AS (SELECT * FROM pairs WHERE sim > 0.05::DOUBLE)"""


def pair_table(spark, sf_dir, metric="cosine"):
    return federation.agreement(prototype_nodes(spark, sf_dir), metric)


def linked(spark, sf_dir):
    """Prototype ids, their links and clusters."""
    pairs = stored(pair_table(spark, sf_dir), "pairs")
    edges = federation.links(pairs, delta=0.05)
    return pairs, edges, federation.clusters(prototypes(spark, sf_dir).select("gid"), edges)


@register("fed03_cosine_agreement", f"WITH {PAIRS} SELECT a, b, round(sim, 6) AS sim FROM pairs")
def fed03(spark, sf_dir):
    return pair_table(spark, sf_dir).select("a", "b", F.round("sim", 6).alias("sim"))


@register("fed03_distance_agreement", f"""
    WITH {PAIRS} SELECT a.pid AS a, b.pid AS b, round(-avg(list_sum(list_transform(range(1, 9), lambda k: pow(a.vec[k] - b.vec[k], 2)))), 6) AS sim
    FROM pn a JOIN pn b ON a.node = b.node AND a.pid < b.pid AND a.client <> b.client GROUP BY ALL
""")
def fed03_l2(spark, sf_dir):
    return pair_table(spark, sf_dir, "l2").select("a", "b", F.round("sim", 6).alias("sim"))


@register("fed03_hyperbolic_agreement", f"""
    WITH {PAIRS}, len AS (SELECT *, greatest(sqrt(list_dot_product(vec, vec)), 1e-5) AS l FROM pn),
    bent AS (SELECT pid, client, node, list_transform(vec, lambda x: x * tanh(l) / l) AS vec FROM len),
    ball AS (SELECT pid, client, node, list_transform(vec, lambda x: x * least(1.0, (1 - 1e-5) / greatest(sqrt(list_dot_product(vec, vec)), 1e-5))) AS vec FROM bent)
    SELECT a.pid AS a, b.pid AS b, round(-avg(acosh(greatest(1.0, 1 + 2 * list_sum(list_transform(range(1, 9), lambda k: pow(a.vec[k] - b.vec[k], 2)))
               / greatest((1 - list_dot_product(a.vec, a.vec)) * (1 - list_dot_product(b.vec, b.vec)), 1e-12)))), 5) AS sim
    FROM ball a JOIN ball b ON a.node = b.node AND a.pid < b.pid AND a.client <> b.client GROUP BY ALL
""")
def fed03_poincare(spark, sf_dir):
    return pair_table(spark, sf_dir, "poincare").select("a", "b", F.round("sim", 5).alias("sim"))


@register("fed03_blocked_agreement", f"WITH {PAIRS} SELECT a, b, round(sim, 6) AS sim FROM lk")
def fed03_blocked(spark, sf_dir):
    """Pairs above the threshold by products of blocks."""
    found = federation.blocked_agreement(prototype_nodes(spark, sf_dir), delta=0.05)
    return found.select("a", "b", F.round("sim", 6).alias("sim"))


@register("fed03_mahalanobis_agreement")
def fed03_mahalanobis(spark, sf_dir):
    """Negated Mahalanobis distances under one pooled precision; compared with numpy in the tests."""
    found = federation.blocked_agreement(prototype_nodes(spark, sf_dir), "mahalanobis")
    return found.select("a", "b", F.round("sim", 6).alias("sim"))


@register("jon03_similar_pairs", f"WITH {PAIRS} SELECT a, b FROM lk")
def jon03(spark, sf_dir):
    return federation.links(pair_table(spark, sf_dir), delta=0.05).select("a", "b")


@register("fed04_quantile_links", f"""
    WITH {PAIRS} SELECT a, b FROM pairs, (SELECT quantile_cont(sim, 0.9) AS cut FROM pairs) WHERE sim > cut
""")
def fed04(spark, sf_dir):
    return federation.links(pair_table(spark, sf_dir), quantile=0.1).select("a", "b")


COMPONENTS = f"""
    {PAIRS}, ends AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
    reach(gid, other) AS (SELECT pid, pid FROM pr UNION SELECT reach.gid, ends.b FROM reach JOIN ends ON ends.a = reach.other),
    cl AS (SELECT gid, min(other) AS cluster FROM reach GROUP BY gid)"""


@register("fed05_components", f"WITH RECURSIVE {COMPONENTS} SELECT gid, cluster FROM cl")
def fed05(spark, sf_dir):
    return linked(spark, sf_dir)[2]


@register("fed06_complete_linkage", f"""
    WITH RECURSIVE {COMPONENTS}, s AS (SELECT cluster, count(*) AS size FROM cl GROUP BY cluster),
    e AS (SELECT cluster, count(*) AS edges FROM lk JOIN cl ON cl.gid = lk.a GROUP BY cluster)
    SELECT cluster, size FROM s LEFT JOIN e USING (cluster) WHERE coalesce(edges, 0) = size * (size - 1) / 2
""")
def fed06(spark, sf_dir):
    _, edges, members = linked(spark, sf_dir)
    return federation.complete_clusters(members, edges)


@register("fed07_shared_prototypes", f"""
    WITH RECURSIVE {COMPONENTS}, s AS (SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, cluster) - 1 AS slot FROM cl GROUP BY cluster HAVING count(*) > 1
        QUALIFY row_number() OVER (ORDER BY count(*) DESC, cluster) <= 2)
    SELECT slot, node, round(avg(list_sum(vec)), 6) AS total FROM s JOIN cl USING (cluster) JOIN pn ON pn.pid = cl.gid GROUP BY ALL
""")
def fed07(spark, sf_dir):
    out = federation.shared_prototypes(prototype_nodes(spark, sf_dir), linked(spark, sf_dir)[2], 2)
    return out.groupBy(F.col("slot").cast("long").alias("slot"), F.col("node").cast("long").alias("node")).agg(F.round(F.sum("value"), 6).alias("total"))


@register("srt02_clusters_by_size", f"""
    WITH RECURSIVE {COMPONENTS} SELECT cluster, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, cluster) AS place FROM cl GROUP BY cluster
""")
def srt02(spark, sf_dir):
    from pyspark.sql import Window

    sizes = linked(spark, sf_dir)[2].groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "cluster")).cast("long"))


@register("fed08_cluster_agreement", f"""
    WITH RECURSIVE {COMPONENTS} SELECT cluster, count(*) AS pairs, round(avg(sim), 6) AS sim
    FROM pairs JOIN cl x ON x.gid = a JOIN (SELECT gid AS g2, cluster AS c2 FROM cl) y ON g2 = b AND c2 = cluster GROUP BY cluster
""")
def fed08(spark, sf_dir):
    pairs, _, members = linked(spark, sf_dir)
    a = members.select(F.col("gid").alias("a"), "cluster")
    b = members.select(F.col("gid").alias("b"), F.col("cluster").alias("other"))
    inside = pairs.join(a, "a").join(b, "b").where("cluster = other")
    return inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("sim"), 6).alias("sim"))


PERSONAL = f"""
    {COMPONENTS}, sh AS (SELECT cluster FROM cl GROUP BY cluster HAVING count(*) > 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, cluster) <= 2),
    us AS (SELECT pid AS gid, client, (pid * 7 % 11 + 1)::DOUBLE AS n FROM pr),
    fr AS (SELECT gid, client, n / greatest(max(n) OVER (PARTITION BY client), 1) AS freq, gid IN (SELECT gid FROM cl WHERE cluster IN (FROM sh)) AS taken FROM us),
    rv AS (SELECT gid, max(sim) AS rival FROM (SELECT a AS gid, b AS other, sim FROM pairs UNION ALL SELECT b, a, sim FROM pairs)
           WHERE other IN (SELECT gid FROM fr WHERE NOT taken) GROUP BY gid),
    ut AS (SELECT client, gid, taken, freq, CASE WHEN NOT taken THEN freq - coalesce(rival, 0) END AS utility FROM fr LEFT JOIN rv USING (gid)),
    sl AS (SELECT client, gid, taken, utility, row_number() OVER (PARTITION BY client ORDER BY taken, coalesce(utility, freq) DESC, gid) - 1 AS slot FROM ut)"""


def personal(spark, sf_dir):
    pairs, _, members = linked(spark, sf_dir)
    protos = prototype_nodes(spark, sf_dir)
    used = prototypes(spark, sf_dir).select("gid", (F.col("gid") * 7 % 11 + 1).alias("n"))
    shared = federation.shared_prototypes(protos, members, 2)
    out = federation.personal_slots(protos, members, pairs, used, shared, 3)
    return out.select("client", F.col("slot").cast("long").alias("slot"), "gid", F.round("utility", 6).alias("utility"))


@register("fed09_personal_slots", f"WITH RECURSIVE {PERSONAL} SELECT client, slot, gid, round(utility, 6) AS utility FROM sl WHERE slot < 3")
def fed09(spark, sf_dir):
    return personal(spark, sf_dir)


@register("srt03_unshared_by_utility", f"WITH RECURSIVE {PERSONAL} SELECT client, slot, gid FROM sl WHERE slot < 3 AND NOT taken")
def srt03(spark, sf_dir):
    """The slots that unshared prototypes take, by utility; the padding by use comes behind them."""
    return personal(spark, sf_dir).where("utility is not null").select("client", "slot", "gid")


@register("fed10_capacity_clusters")
def fed10(spark, sf_dir):
    return federation.capacity_clusters(prototype_nodes(spark, sf_dir), 4)


@register("fed15_class_prototypes", f"""
    WITH {EMBEDDED}, k AS (SELECT client, label, d.k, avg(v[d.k]) AS value, count(*) AS n FROM em, (SELECT unnest(range(1, 65)) AS k) d GROUP BY ALL)
    SELECT label, k - 1 AS dim, round(sum(value * n) / sum(n), 6) AS value, sum(n)::BIGINT AS n FROM k GROUP BY ALL
""")
def fed15(spark, sf_dir):
    local = federation.class_prototypes(embedded(spark, sf_dir), ["client"], "label", "v")
    out = federation.merge_class_prototypes(local, "label")
    return out.select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"), "n")


VOTES = f"""
    {EMBEDDED}, bank AS (SELECT pid, em.label AS lab, pv FROM pr JOIN em ON em.vec_id = pid),
    sm AS (SELECT em.vec_id, pid, lab, round(list_dot_product(v, pv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(pv, pv))), 12) AS s FROM em, bank),
    tk AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, pid) <= 3)"""


def votes(spark, sf_dir):
    bank = prototypes(spark, sf_dir).select(F.col("gid").alias("pid"), "label", F.flatten("z").alias("vec"))
    samples = embedded(spark, sf_dir).select(F.col("vec_id").alias("key"), F.col("v").alias("vec"))
    return federation.retrieval_vote(samples, bank, 3)


@register("fed19_retrieval_vote", f"""
    WITH {VOTES}, g AS (SELECT vec_id AS key, lab AS label, sum(greatest(s, 0)) AS t FROM tk GROUP BY ALL)
    SELECT key, label, round(CASE WHEN sum(t) OVER k > 0 THEN t / sum(t) OVER k ELSE 0 END, 6) AS vote FROM g WINDOW k AS (PARTITION BY key)
""")
def fed19(spark, sf_dir):
    return votes(spark, sf_dir).select("key", "label", F.round("vote", 6).alias("vote"))


@register("jon08_top_k_retrieval", f"WITH {VOTES} SELECT vec_id AS key, round(max(s), 6) AS alpha, count(DISTINCT lab) AS labels FROM tk GROUP BY vec_id")
def jon08(spark, sf_dir):
    return votes(spark, sf_dir).groupBy("key").agg(F.round(F.max("alpha"), 6).alias("alpha"), F.count_distinct("label").alias("labels"))


@register("fed20_ensemble", f"""
    WITH {VOTES}, g AS (SELECT key, label, t, max(m) OVER (PARTITION BY key) AS alpha FROM (
        SELECT vec_id AS key, lab AS label, sum(greatest(s, 0)) AS t, max(s) AS m FROM tk GROUP BY vec_id, lab)),
    v AS (SELECT key, label, alpha, CASE WHEN sum(t) OVER k > 0 THEN t / sum(t) OVER k ELSE 0 END AS vote FROM g WINDOW k AS (PARTITION BY key))
    SELECT key, round(1 - coalesce(sum(alpha * vote + (1 - alpha) * 0.1) FILTER (label = 0), 0), 6) AS score FROM v GROUP BY key
""")
def fed20(spark, sf_dir):
    mixed = F.col("alpha") * F.col("vote") + (1 - F.col("alpha")) * 0.1
    normal = F.sum(F.when(F.col("label") == 0, mixed))
    return votes(spark, sf_dir).groupBy("key").agg(F.round(1 - F.coalesce(normal, F.lit(0.0)), 6).alias("score"))


@register("fed16_contrastive_loss", f"""
    WITH {EMBEDDED}, mu AS (SELECT label AS c, list_transform(range(1, 65), lambda k: 0.0) AS z, d.k, avg(v[d.k]) AS x FROM em, (SELECT unnest(range(1, 65)) AS k) d GROUP BY ALL),
    cp AS (SELECT c, list(x ORDER BY k) AS p FROM mu GROUP BY c),
    lg AS (SELECT vec_id, label, c, 10 * list_dot_product(v, p) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(p, p))) AS s FROM em, cp)
    SELECT round(avg(t - o), 6) AS loss FROM (SELECT vec_id, ln(sum(exp(s))) AS t, max(s) FILTER (label = c) AS o FROM lg GROUP BY vec_id)
""")
def fed16(spark, sf_dir):
    cells = federation.class_prototypes(embedded(spark, sf_dir), [], "label", "v")
    mean = cells.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("vec"))
    samples = embedded(spark, sf_dir).select("label", F.col("v").alias("vec"))
    return federation.contrastive_loss(samples, mean).withColumn("loss", F.round("loss", 6))


@register("fed17_class_kmeans")
def fed17(spark, sf_dir):
    rows = embedded(spark, sf_dir).select(F.col("label").alias("group"), F.col("vec_id").alias("key"), F.col("v").alias("vec"))
    return training.kmeans(rows, 3, rounds=4)


@register("fed18_margin_refinement")
def fed18(spark, sf_dir):
    rows = embedded(spark, sf_dir).select("label", F.col("v").alias("vec"))
    start = prototypes(spark, sf_dir).select(F.col("gid").alias("pid"), "label", F.flatten("z").alias("vec"))
    return training.refine_by_margin(rows, start, rounds=3)


@register("fed18_adam_refinement")
def fed18_adam(spark, sf_dir):
    """Each client's prototypes after twelve Adam steps on the margin loss; compared with numpy in the tests."""
    rows = embedded(spark, sf_dir).select("client", "label", F.col("v").alias("vec"))
    start = prototypes(spark, sf_dir).select("client", F.col("gid").alias("pid"), "label", F.flatten("z").alias("vec"))
    out = training.refine_with_adam(rows, start, "client", margin=0.1, steps=12, rate=1e-3)
    return out.withColumn("vec", F.transform("vec", lambda x: F.round(x, 8)))


@register("skw01_quantity_skew", f"""
    WITH {EVENTS}, b AS (SELECT client, floor((client + 1) * 0.1::DOUBLE * count(*))::BIGINT AS budget FROM ev GROUP BY client),
    r AS (SELECT ev.*, row_number() OVER (PARTITION BY client ORDER BY t_us, event_id) - 1 AS p FROM ev)
    SELECT client, count(*) AS n, min(event_id) AS first_id FROM r JOIN b USING (client) WHERE p < budget GROUP BY client
""")
def skw01(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    sizes = rows.groupBy("client").agg(F.count(F.lit(1)).alias("n"))
    budget = sizes.select("client", F.floor((F.col("client") + 1).cast("double") * F.lit(0.1) * F.col("n")).alias("budget"))
    out = skew.take_slices(rows, budget, "client", ["t_us", "event_id"])
    return out.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def drawn(values: dict) -> str:
    """A seeded draw per client as rows of a VALUES list."""
    return ", ".join(f"({c}, {v!r}::DOUBLE)" for c, v in values.items())


SHARES = dict(zip(range(4), np.random.default_rng(42).dirichlet([0.5] * 4).tolist(), strict=True))


@register("skw01_dirichlet_skew", f"""
    WITH {EVENTS}, sh(client, share) AS (VALUES {drawn(SHARES)}),
    b AS (SELECT client, greatest(20, floor(share * (SELECT count(*) FROM ev)))::BIGINT AS budget FROM sh),
    r AS (SELECT ev.*, row_number() OVER (PARTITION BY client ORDER BY t_us, event_id) - 1 AS p FROM ev)
    SELECT client, count(*) AS n, min(event_id) AS first_id FROM r JOIN b USING (client) WHERE p < budget GROUP BY client
""")
def skw01_dirichlet(spark, sf_dir):
    """Budgets drawn from a symmetric Dirichlet law with a fixed seed; a client has at most the rows it holds."""
    rows = stored(telemetry(spark, sf_dir), "telemetry")
    budgets = skew.dirichlet_budgets(range(4), rows.count(), alpha=0.5, least=20, seed=42)
    out = skew.take_slices(rows, spark.createDataFrame(list(budgets.items()), "client long, budget long"), "client", ["t_us", "event_id"])
    return out.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@register("skw02_scenario_skew", f"""
    WITH {EVENTS}, sh(client, share) AS (VALUES {drawn(skew.beta_shares(range(4), 0.5))}),
    s AS (SELECT client, CASE WHEN session % 2 = 0 THEN 'inside' ELSE 'outside' END AS scenario, count(*) AS available FROM ev GROUP BY ALL),
    w AS (SELECT client, scenario, available, least(floor(sum(available) OVER (PARTITION BY client) / 2
              * CASE WHEN scenario = 'inside' THEN share ELSE 1 - share END), available) AS wanted FROM s JOIN sh USING (client))
    SELECT client, scenario, available, (CASE WHEN wanted >= 20 THEN wanted ELSE 0 END)::BIGINT AS taken FROM w
""")
def skw02(spark, sf_dir):
    rows = telemetry(spark, sf_dir).withColumn("scenario", F.when(F.col("session") % 2 == 0, "inside").otherwise("outside"))
    return skew.scenario_mix(rows, "client", "scenario", "inside", ["t_us", "event_id"], alpha=0.5, seed=42)


@register("fed12_averaging_mode", f"""
    WITH {PARAMS}, a AS (SELECT name, idx, sum(n * value) / sum(n) AS value FROM pm JOIN cn USING (client) GROUP BY ALL)
    SELECT pm.client, name, idx, round(CASE WHEN name = 'steps' THEN trunc(round(a.value, 6)) ELSE a.value END, 5) AS value,
           round(pm.value - a.value, 5) AS drift FROM pm JOIN a USING (name, idx)
""")
def fed12(spark, sf_dir):
    """Averaging mode: every client's parameters are replaced by the weighted mean of all; ``drift`` is what it gives up."""
    params, counts = parameters(spark, sf_dir)
    mean = federation.average_parameters(params, counts).withColumnRenamed("value", "mean")
    whole = F.when(F.col("name") == "steps", F.col("mean").cast("long").cast("double")).otherwise(F.col("mean"))
    return params.join(mean, ["name", "idx"]).select(
        "client", "name", "idx", F.round(whole, 5).alias("value"), F.round(F.col("value") - F.col("mean"), 5).alias("drift")
    )


@register("set03_prototype_bank", f"""
    WITH {EMBEDDED} SELECT client, m, count(*) AS cells, round(sum(x), 6) AS total FROM (SELECT client, m, unnest(pv) AS x FROM pr) GROUP BY ALL
""")
def set03(spark, sf_dir):
    """The clients' prototypes as one bank, without alignment: the table of all clients is the bank."""
    cells = prototypes(spark, sf_dir).select("client", "m", F.explode(F.flatten("z")).alias("x"))
    return cells.groupBy("client", "m").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("x"), 6).alias("total"))


@register("enc01_linear_encoder")
def enc01(spark, sf_dir):
    return training.linear_encoder(embedded(spark, sf_dir).select(F.col("vec_id").alias("key"), F.col("v").alias("vec")), 4)


@register("trn01_local_training")
def trn01(spark, sf_dir):
    rows = embedded(spark, sf_dir).select("client", F.col("v").alias("x"))
    return training.train_autoencoders(rows, "client", width=4, rounds=4).select("client", "round", "loss", "n")


@register("fed11_federated_rounds")
def fed11(spark, sf_dir):
    rows = embedded(spark, sf_dir).select("client", F.col("v").alias("x"))
    return training.train_autoencoders(rows, "client", width=4, rounds=3, federate=True).select("client", "round", "loss", "n")


@register("fcs01_ridge_forecast")
def fcs01(spark, sf_dir):
    x = V.split_nodes(F.col("v"), 8, 8)
    rows = embedded(spark, sf_dir).select(
        "client", F.transform(x, lambda z: V.mean(F.slice(z, 1, 7))).alias("x"), F.transform(x, lambda z: z[7]).alias("y")
    )
    return training.ridge_forecast(rows, "client")
