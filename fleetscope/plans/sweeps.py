"""Scores by number of prototypes, and detection by client and signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions.vectors import sq_distance, total
from fleetscope.operators import evaluate, memory, skew, training, windows
from fleetscope.plans.registry import register
from fleetscope.plans.storage import stored
from fleetscope.plans.views import EMBEDDED, embedded, prototypes

GRID = (1, 2, 4)
AUROC = """
    c AS (SELECT {by}, score, count(*) FILTER (bad) AS pos, count(*) FILTER (NOT bad) AS neg FROM s GROUP BY ALL),
    v AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score) - neg AS below, sum(pos) OVER w AS P, sum(neg) OVER w AS N FROM c WINDOW w AS (PARTITION BY {by}))
    SELECT {by}, sum(pos + neg)::BIGINT AS n, round(sum(pos * (below + 0.5 * neg)) / nullif(max(P) * max(N), 0), 6)::DOUBLE AS auroc FROM v GROUP BY {by}"""


def metrics(rows, by):
    out = evaluate.detection_metrics(stored(rows, "scores"), by, "score", F.col("bad"))
    return out.select(*by, "n", F.round("auroc", 6).alias("auroc"))


@register("rpt03_prototype_sweep", f"""
    WITH {EMBEDDED}, g AS (SELECT vec_id, client, label, m, sum(g) AS d FROM gaps GROUP BY ALL),
    s AS (SELECT k.prototypes, client, round(min(d), 6) AS score, any_value(label) < 3 AS bad
          FROM g, (SELECT unnest([1, 2, 4]) AS prototypes) k WHERE m < k.prototypes GROUP BY k.prototypes, client, vec_id), {AUROC.format(by="prototypes, client")}
""")
def rpt03(spark, sf_dir):
    """Detection by distance to the nearest of the first 1, 2 and 4 prototypes of the client: one pass for the whole grid."""
    joined = embedded(spark, sf_dir).join(memory.codebook(prototypes(spark, sf_dir)), "client")
    apart = F.transform("codes", lambda code: total(F.zip_with(F.col("z"), code["z"], sq_distance)))
    each = joined.select("client", "vec_id", "label", apart.alias("d")).select(
        "*", F.explode(F.array(*[F.lit(k).cast("long") for k in GRID])).alias("prototypes")
    )
    nearest = F.array_min(F.slice("d", F.lit(1), F.col("prototypes").cast("int")))
    rows = each.select("prototypes", "client", F.round(nearest, 6).alias("score"), (F.col("label") < 3).alias("bad"))
    return metrics(rows, ["prototypes", "client"])


def refit_scores(rows, grid):
    """Per row of ``group, key, vec, label`` and size of the grid the distance to the nearest centre of its group's k-means."""
    rows = stored(rows, "rows")
    centres = training.kmeans_grid(rows, grid, rounds=3)
    found = training.nearest_in_grid(rows, centres, sorted(set(grid)))
    return found.select("group", F.explode("nearest").alias("at"), "label").select(
        "group", F.col("at.size").alias("prototypes"), F.round("at.d", 6).alias("score"), (F.col("label") < 3).alias("bad")
    )


@register("rpt03_refitted_sweep")
def rpt03_refit(spark, sf_dir):
    """Detection by number of prototypes, with k-means of every (client, number) cell fitted anew, in common jobs."""
    rows = embedded(spark, sf_dir).select(F.col("client").alias("group"), F.col("vec_id").alias("key"), F.col("v").alias("vec"), "label")
    return metrics(refit_scores(rows, GRID), ["prototypes", "group"]).withColumnRenamed("group", "client")


#: Concentrations of the Dirichlet law that deals rows to clients.
ALPHAS = (0.1, 0.5, 5.0)


@register("rpt03_skew_sweep")
def rpt03_skew(spark, sf_dir):
    """Detection by skew: for each concentration the clients get budgets, are fitted anew on their slice and scored on it."""
    rows = stored(embedded(spark, sf_dir).select("client", "vec_id", "v", "label"), "windows")
    total = rows.count()
    drawn = [(a, c, n) for a in ALPHAS for c, n in skew.dirichlet_budgets(range(4), total, a, least=20, seed=42).items()]
    budgets = spark.createDataFrame(drawn, "alpha double, client long, budget long")
    placed = windows.numbered_at_scale(rows, ["client"], ["vec_id"], "place")
    slices = placed.join(F.broadcast(budgets), "client").where("place < budget")  # alphas x clients rows
    cells = slices.select(F.struct("alpha", "client").alias("group"), F.col("vec_id").alias("key"), F.col("v").alias("vec"), "label")
    out = metrics(refit_scores(cells, [4]), ["group"])
    return out.select("group.alpha", "group.client", "n", "auroc")


@register("scr04_exemplar_deviation", f"""
    WITH {EMBEDDED}, x AS (SELECT vec_id, client, label, node, min(g) AS d FROM gaps GROUP BY ALL)
    SELECT vec_id, node, round(d, 6) AS deviation FROM x
""")
def scr04(spark, sf_dir):
    """Per node the distance to the nearest exemplar of that node, whichever prototype it belongs to."""
    return exemplar_deviation(spark, sf_dir).select("vec_id", "node", F.round("deviation", 6).alias("deviation"))


def exemplar_deviation(spark, sf_dir):
    joined = embedded(spark, sf_dir).join(memory.codebook(prototypes(spark, sf_dir)), "client")
    nodes = F.transform(F.col("z"), lambda z, i: F.array_min(F.transform("codes", lambda code: sq_distance(z, code["z"][i]))))
    out = joined.select("vec_id", "client", "label", F.posexplode(nodes).alias("node", "deviation"))
    return out.withColumn("node", F.col("node").cast("long"))


@register("slice_detection_report", f"""
    WITH {EMBEDDED}, x AS (SELECT vec_id, client, label, node, min(g) AS d FROM gaps GROUP BY ALL),
    s AS (SELECT client, signal, round(score, 6) AS score, label < 3 AS bad FROM (
        SELECT vec_id, client, label, 'joint' AS signal, d_proto AS score FROM near
        UNION ALL SELECT vec_id, client, label, 'worst_node', max(d) FROM x GROUP BY vec_id, client, label
        UNION ALL SELECT vec_id, client, label, 'mean_node', avg(d) FROM x GROUP BY vec_id, client, label)), {AUROC.format(by="client, signal")}
""")
def detection_report(spark, sf_dir):
    """End to end: windows are assigned and scored by three signals, and each is evaluated per client."""
    nodes = stored(exemplar_deviation(spark, sf_dir), "deviations").groupBy("vec_id", "client", "label")
    near = memory.assign(embedded(spark, sf_dir), prototypes(spark, sf_dir))
    signals = near.select("client", "label", F.lit("joint").alias("signal"), F.col("d_proto").alias("score"))
    for name, value in (("worst_node", F.max("deviation")), ("mean_node", F.avg("deviation"))):
        signals = signals.unionByName(nodes.agg(value.alias("score")).select("client", "label", F.lit(name).alias("signal"), "score"))
    rows = signals.select("client", "signal", F.round("score", 6).alias("score"), (F.col("label") < 3).alias("bad"))
    return metrics(rows, ["client", "signal"])


@register("slice_localization_report", f"""
    WITH {EMBEDDED}, x AS (SELECT vec_id, client, label, node, min(g) AS d FROM gaps GROUP BY ALL),
    t AS (SELECT vec_id, client, label, node, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 6) DESC, node) AS r FROM x),
    h AS (SELECT vec_id, client, label, bool_or(node IN (label % 8, (label + 3) % 8) AND r <= 1) AS first, bool_or(node IN (label % 8, (label + 3) % 8)) AS hit
          FROM t WHERE r <= 3 GROUP BY ALL)
    SELECT client, label, count(*) AS windows, round(avg(hit::INT), 6) AS top3, round(avg(first::INT), 6) AS top1 FROM h GROUP BY ALL
""")
def localization_report(spark, sf_dir):
    """End to end: deviation per node, the three worst nodes of each window, and how often they lie in the fault's domain."""
    rows = exemplar_deviation(spark, sf_dir).withColumn("deviation", F.round("deviation", 6))
    worst = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("deviation")).alias("minus"), "node"))), 1, 3)
    top = rows.groupBy("vec_id", "client", "label").agg(worst.alias("top"))
    domain = F.array(F.col("label") % 8, (F.col("label") + 3) % 8)
    inside = lambda t: F.array_contains(domain.cast("array<bigint>"), t["node"]).cast("int")
    scored = top.select("client", "label", inside(F.col("top")[0]).alias("first"), F.array_max(F.transform("top", inside)).alias("hit"))
    return scored.groupBy("client", "label").agg(
        F.count(F.lit(1)).alias("windows"), F.round(F.avg("hit"), 6).alias("top3"), F.round(F.avg("first"), 6).alias("top1")
    )
