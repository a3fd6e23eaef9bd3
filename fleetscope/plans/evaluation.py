"""Detection metrics, localization, ranking and set operations on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetscope.operators import evaluate, localize, report, windows
from fleetscope.plans.calibration import NODE_Z, WORST, node_z, wide_scores
from fleetscope.plans.registry import register, table
from fleetscope.plans.storage import stored
from fleetscope.plans.views import EMBEDDED, EVENTS, embedded, prototypes, telemetry

LABELLED = """
    ld AS (SELECT d.doc_id, d.lang, d.n_chars::DOUBLE AS score, l.quality = 0 AS bad FROM documents d JOIN labels l USING (doc_id))"""
CURVE = f"""
    {LABELLED}, sc AS (SELECT lang, score, count(*) FILTER (bad) AS pos, count(*) FILTER (NOT bad) AS neg FROM ld GROUP BY ALL),
    cv AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER w AS P, sum(neg) OVER w AS N FROM sc
           WINDOW d AS (PARTITION BY lang ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w AS (PARTITION BY lang))"""


def labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    marks = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    return docs.join(marks, "doc_id")


def curve(spark, sf_dir):
    return evaluate.detection_metrics(labelled(spark, sf_dir), ["lang"], "score", F.col("bad"))


@register("met01_auroc", f"""
    WITH {CURVE} SELECT lang, sum(pos + neg)::BIGINT AS n,
        round(CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - fp + 0.5 * neg)) / (max(P) * max(N)) END, 6)::DOUBLE AS auroc FROM cv GROUP BY lang
""")
def met01(spark, sf_dir):
    return curve(spark, sf_dir).select("lang", "n", F.round("auroc", 6).alias("auroc"))


@register("met02_average_precision", f"""
    WITH {CURVE} SELECT lang, round(CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos / P * (tp / (tp + fp))) END, 6)::DOUBLE AS auprc FROM cv GROUP BY lang
""")
def met02(spark, sf_dir):
    return curve(spark, sf_dir).select("lang", F.round("auprc", 6).alias("auprc"))


@register("met03_best_f1", f"""
    WITH {CURVE}, f AS (SELECT lang, score, tp / "P" AS rc, tp / (tp + fp) AS pc, round(2 * tp / (tp + fp + P), 12) AS f1, "P" AS pos_all, "N" AS neg_all FROM cv)
    SELECT lang, CASE WHEN has_both THEN score END AS threshold, CASE WHEN has_both THEN round(pc, 6)::DOUBLE END AS "precision",
           CASE WHEN has_both THEN round(rc, 6)::DOUBLE END AS recall, CASE WHEN has_both THEN round(f1, 6)::DOUBLE END AS f1
    FROM (SELECT *, pos_all > 0 AND neg_all > 0 AS has_both FROM f) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, score) = 1
""")
def met03(spark, sf_dir):
    out = curve(spark, sf_dir)
    return out.select("lang", "threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


DECIDED = f"""
    {LABELLED}, th AS (SELECT lang, quantile_cont(score, 0.95) AS threshold FROM ld WHERE NOT bad GROUP BY lang),
    dc AS (SELECT ld.*, threshold, score > threshold AS alarm FROM ld JOIN th USING (lang))"""


def decided(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    cut = evaluate.normal_threshold(rows, ["lang"], "score", ~F.col("bad"))
    return rows.join(cut, "lang").withColumn("alarm", F.col("score") > F.col("threshold"))


@register("met04_threshold_metrics", f"""
    WITH {DECIDED}, s AS (SELECT lang, count(*) FILTER (bad AND alarm) AS tp, count(*) FILTER (NOT bad AND alarm) AS fp, count(*) FILTER (bad AND NOT alarm) AS fn FROM dc GROUP BY lang)
    SELECT lang, tp, fp, fn, coalesce(round(tp / nullif(tp + fp, 0), 6), 0)::DOUBLE AS "precision", coalesce(round(tp / nullif(tp + fn, 0), 6), 0)::DOUBLE AS recall,
           coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0)::DOUBLE AS f1 FROM s
""")
def met04(spark, sf_dir):
    out = evaluate.threshold_metrics(decided(spark, sf_dir), ["lang"], F.col("alarm"), F.col("bad"))
    return out.select("lang", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("met05_normal_threshold", f"WITH {DECIDED} SELECT lang, round(max(threshold), 6) AS threshold, count(*) FILTER (alarm) AS alarms FROM dc GROUP BY lang")
def met05(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("lang").agg(
        F.round(F.max("threshold"), 6).alias("threshold"), F.count_if("alarm").alias("alarms")
    )


SEGMENTS = f"""
    {EVENTS}, fl AS (SELECT session, seq, node IN ('error', 'view', 'click') AS truth, value > 120 AS pred FROM ev),
    ch AS (SELECT *, coalesce((truth <> lag(truth) OVER (PARTITION BY session ORDER BY seq))::INT, 0) AS c FROM fl),
    il AS (SELECT *, sum(c) OVER (PARTITION BY session ORDER BY seq) AS island FROM ch),
    pa AS (SELECT *, CASE WHEN truth THEN max(pred::INT) OVER (PARTITION BY session, island) = 1 ELSE pred END AS adjusted FROM il)"""


def flagged(spark, sf_dir):
    truth = F.col("node").isin("error", "view", "click")
    return telemetry(spark, sf_dir).select("session", "seq", truth.alias("truth"), (F.col("value") > 120).alias("pred"))


@register("ana04_segments", f"WITH {SEGMENTS} SELECT session, island::BIGINT AS island, min(seq) AS first_seq, count(*) AS n FROM il WHERE truth GROUP BY ALL")
def ana04(spark, sf_dir):
    runs = evaluate.islands(flagged(spark, sf_dir), ["session"], ["seq"], F.col("truth"))
    return runs.where("truth").groupBy("session", F.col("island").cast("long").alias("island")).agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n")
    )


@register("met06_point_adjusted", f"""
    WITH {SEGMENTS}, s AS (SELECT session, count(*) FILTER (truth AND adjusted) AS tp, count(*) FILTER (NOT truth AND adjusted) AS fp, count(*) FILTER (truth AND NOT adjusted) AS fn FROM pa GROUP BY session)
    SELECT session, tp, fp, fn, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0)::DOUBLE AS f1 FROM s
""")
def met06(spark, sf_dir):
    rows = evaluate.point_adjusted(flagged(spark, sf_dir), ["session"], ["seq"], "truth", "pred")
    out = evaluate.threshold_metrics(rows, ["session"], F.col("adjusted"), F.col("truth"))
    return out.select("session", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@register("met07_errors", f"""
    WITH {EVENTS}, g AS (SELECT session, value, lag(value) OVER (PARTITION BY session ORDER BY seq) AS before FROM ev)
    SELECT session, round(avg(pow(value - before, 2)), 4) AS mse, round(avg(abs(value - before)), 6) AS mae FROM g WHERE before IS NOT NULL GROUP BY session
""")
def met07(spark, sf_dir):
    before = F.lag("value").over(Window.partitionBy("session").orderBy("seq"))
    rows = telemetry(spark, sf_dir).withColumn("before", before).where("before is not null")
    out = evaluate.errors(rows, ["session"], "value", "before")
    return out.select("session", F.round("mse", 4).alias("mse"), F.round("mae", 6).alias("mae"))


@register("met08_accuracy", f"WITH {DECIDED} SELECT lang, round(avg((bad = alarm)::INT), 6)::DOUBLE AS accuracy FROM dc GROUP BY lang")
def met08(spark, sf_dir):
    return evaluate.accuracy(decided(spark, sf_dir), ["lang"], "bad", "alarm").withColumn("accuracy", F.round("accuracy", 6))


@register("met09_one_class", f"""
    WITH {LABELLED}, c AS (SELECT lang, bad AS cls, count(*) AS n FROM ld GROUP BY ALL) SELECT lang, n, NULL::DOUBLE AS auroc, NULL::DOUBLE AS f1 FROM c WHERE NOT cls
""")
def met09(spark, sf_dir):
    out = evaluate.detection_metrics(labelled(spark, sf_dir).where("not bad"), ["lang"], "score", F.col("bad"))
    return out.select("lang", "n", "auroc", "f1")


@register("slice_client_auroc", f"""
    WITH {WORST}, s AS (SELECT client, fault, round(score, 9) AS score FROM z WHERE split IN ('test', 'fault')),
    c AS (SELECT client, score, count(*) FILTER (fault) AS pos, count(*) FILTER (NOT fault) AS neg FROM s GROUP BY ALL),
    v AS (SELECT *, sum(neg) OVER (PARTITION BY client ORDER BY score) - neg AS below, sum(pos) OVER w AS P, sum(neg) OVER w AS N FROM c WINDOW w AS (PARTITION BY client))
    SELECT client, sum(pos + neg)::BIGINT AS n, round(sum(pos * (below + 0.5 * neg)) / (max(P) * max(N)), 6)::DOUBLE AS auroc FROM v GROUP BY client
""")
def client_auroc(spark, sf_dir):
    """Which rows of which client look anomalous, and how well that separates the labelled faults."""
    rows = wide_scores(spark, sf_dir).where(F.col("split").isin("test", "fault"))
    out = evaluate.detection_metrics(rows.withColumn("score", F.round("score", 9)), ["client"], "score", F.col("fault"))
    return out.select("client", "n", F.round("auroc", 6).alias("auroc"))


@register("ana03_running_counts", f"WITH {CURVE} SELECT lang, score, tp::BIGINT AS tp, fp::BIGINT AS fp FROM cv")
def ana03(spark, sf_dir):
    counts = evaluate.score_counts(labelled(spark, sf_dir), ["lang"], "score", F.col("bad"))
    sums = windows.running_sums(counts, ["lang"], [F.desc("score")], ["pos", "neg"])
    return sums.select("lang", "score", F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"))


ROUND_Z = f"{NODE_Z}, rz AS (SELECT vec_id, client, label, node, round(z, 6) AS z, iqr >= 0.9::DOUBLE * quantile_cont(iqr, 0.5) OVER (PARTITION BY vec_id) AS reliable FROM nz)"


def rounded_z(spark, sf_dir):
    from fleetscope.operators import clean, scoring
    from fleetscope.plans.calibration import node_rows

    rows = stored(node_rows(spark, sf_dir), "node-rows")
    stats = scoring.robust_stats(rows.where("vec_id % 3 = 0"), ["client", "node"], "g")
    marks = clean.reliable_nodes(stats, share=0.9).select("client", "node", "reliable")
    z = scoring.z_scores(rows, stats, ["client", "node"], "g").join(marks, ["client", "node"])
    return z.select("vec_id", "client", "label", F.col("node").cast("long").alias("node"), F.round("z", 6).alias("z"), "reliable")


@register("top01_reliable_top_k", f"""
    WITH {ROUND_Z} SELECT vec_id, node, z, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, node) AS rank FROM rz WHERE reliable
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, node) <= 3
""")
def top01(spark, sf_dir):
    out = localize.top_nodes(rounded_z(spark, sf_dir), ["vec_id"], "node", "z", 3, F.col("reliable"))
    return out.select("vec_id", "node", "z", F.col("rank").cast("long").alias("rank"))


@register("top02_masked_argmax", f"""
    WITH {ROUND_Z} SELECT vec_id, node, z FROM rz WHERE reliable QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, node) = 1
""")
def top02(spark, sf_dir):
    out = localize.top_node(rounded_z(spark, sf_dir), ["vec_id"], "node", "z", F.col("reliable"))
    return out.select("vec_id", "node", F.col("value").alias("z"))


@register("loc01_top_nodes", f"""
    WITH {NODE_Z} SELECT client, node, count(*) AS times FROM (
        SELECT vec_id, client, node, row_number() OVER (PARTITION BY vec_id ORDER BY round(z, 6) DESC, node) AS r FROM nz) WHERE r <= 3 GROUP BY ALL
""")
def loc01(spark, sf_dir):
    rows = node_z(spark, sf_dir).withColumn("z", F.round("z", 6))
    top = localize.top_nodes(rows, ["vec_id", "client"], "node", "z", 3)
    return top.groupBy("client", F.col("node").cast("long").alias("node")).agg(F.count(F.lit(1)).alias("times"))


@register("loc02_blended", f"""
    WITH {ROUND_Z}, pf AS (SELECT vec_id, 'a' AS signal, node, z, reliable FROM rz UNION ALL SELECT vec_id, 'b', node, -z, node < 7 FROM rz),
    sl AS (SELECT vec_id, signal, max(z) AS score FROM pf GROUP BY ALL),
    ew AS (SELECT vec_id, signal, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e FROM sl),
    nw AS (SELECT vec_id, signal, e / sum(e) OVER (PARTITION BY vec_id) AS w FROM ew)
    SELECT vec_id, node, round(sum(w * z), 4) AS z, bool_and(reliable) AS reliable FROM pf JOIN nw USING (vec_id, signal) GROUP BY ALL
""")
def loc02(spark, sf_dir):
    rows = stored(rounded_z(spark, sf_dir), "profiles")
    profiles = rows.select("vec_id", F.lit("a").alias("signal"), "node", "z", "reliable").unionByName(
        rows.select("vec_id", F.lit("b").alias("signal"), "node", (-F.col("z")).alias("z"), (F.col("node") < 7).alias("reliable"))
    )
    scalars = profiles.groupBy("vec_id", "signal").agg(F.max("z").alias("score"))
    return localize.blended(scalars, profiles, ["vec_id"], "signal", "node").withColumn("z", F.round("z", 4))


@register("loc03_hit_rate", f"""
    WITH {NODE_Z}, t AS (SELECT vec_id, label, node FROM nz QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(z, 6) DESC, node) <= 3)
    SELECT label, count(*) AS windows, count(*) FILTER (hit) AS hits FROM (
        SELECT vec_id, label, bool_or(node IN (label % 8, (label + 3) % 8)) AS hit FROM t GROUP BY ALL) GROUP BY label
""")
def loc03(spark, sf_dir):
    top = localize.top_nodes(node_z(spark, sf_dir).withColumn("z", F.round("z", 6)), ["vec_id", "label"], "node", "z", 3)
    domains = embedded(spark, sf_dir).select("label").distinct().withColumn(
        "domain", F.array((F.col("label") % 8).cast("int"), ((F.col("label") + 3) % 8).cast("int"))
    )
    out = localize.hits(top.withColumn("node", F.col("node").cast("int")), domains, ["vec_id"], "label", "node")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("windows"), F.count_if("hit").alias("hits"))


@register("loc03_hit_kinds", f"""
    WITH {NODE_Z}, t AS (SELECT vec_id, label, node FROM nz QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(z, 6) DESC, node) = 1)
    SELECT CASE WHEN node = label % 8 THEN 'direct' WHEN node = (label + 3) % 8 THEN 'indirect' ELSE 'other' END AS kind, count(*) AS n FROM t GROUP BY ALL
""")
def loc03_kinds(spark, sf_dir):
    top = localize.top_node(node_z(spark, sf_dir).withColumn("z", F.round("z", 6)), ["vec_id", "label"], "node", "z")
    kind = localize.hit_kind(F.col("node").cast("long"), F.array((F.col("label") % 8).cast("long")), F.array(((F.col("label") + 3) % 8).cast("long")))
    return top.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("loc04_chance_of_hit", """
    SELECT n_nationkey AS d, round(1 - list_product(list_transform(range(3), lambda i: greatest(26 - n_nationkey - i, 0)::DOUBLE / (26 - i))), 6) AS chance FROM nation
""")
def loc04(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("d"))
    return rows.select("d", F.round(localize.chance_of_hit(F.lit(26), F.col("d"), 3), 6).alias("chance"))


@register("jon04_anti_join", f"WITH {EMBEDDED} SELECT vec_id FROM em WHERE vec_id NOT IN (SELECT pid FROM pr)")
def jon04(spark, sf_dir):
    ids = prototypes(spark, sf_dir).select(F.col("gid").alias("vec_id"))
    return embedded(spark, sf_dir).select("vec_id").join(ids, "vec_id", "left_anti")


@register("jon05_semi_join", f"WITH {EMBEDDED} SELECT vec_id, label FROM em WHERE label IN (SELECT em.label FROM pr JOIN em ON em.vec_id = pid)")
def jon05(spark, sf_dir):
    kinds = prototypes(spark, sf_dir).select("label")
    return embedded(spark, sf_dir).select("vec_id", "label").join(kinds, "label", "left_semi")


@register("jon06_every_model", f"WITH {EMBEDDED} SELECT vec_id, c.client AS model FROM em, (SELECT DISTINCT client FROM pr) c WHERE label = 9")
def jon06(spark, sf_dir):
    models = prototypes(spark, sf_dir).select(F.col("client").alias("model")).distinct().agg(F.collect_set("model").alias("models"))
    faulty = embedded(spark, sf_dir).where("label = 9").select("vec_id")
    return faulty.crossJoin(F.broadcast(models)).select("vec_id", F.explode("models").alias("model"))  # one row


@register("jon09_membership", f"""
    WITH {NODE_Z}, t AS (SELECT vec_id, label, list(node) AS nodes FROM (
        SELECT vec_id, label, node FROM nz QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(z, 6) DESC, node) <= 2) GROUP BY ALL)
    SELECT vec_id, list_has_any(nodes, [label % 8, (label + 1) % 8]) AS inside FROM t
""")
def jon09(spark, sf_dir):
    top = localize.top_nodes(node_z(spark, sf_dir).withColumn("z", F.round("z", 6)), ["vec_id", "label"], "node", "z", 2)
    nodes = top.groupBy("vec_id", "label").agg(F.collect_list(F.col("node").cast("long")).alias("nodes"))
    near = F.array((F.col("label") % 8).cast("long"), ((F.col("label") + 1) % 8).cast("long"))
    return nodes.select("vec_id", F.arrays_overlap("nodes", near).alias("inside"))


@register("srt01_stable_client_order", f"WITH {EVENTS} SELECT client, session, row_number() OVER (PARTITION BY client ORDER BY session) AS place FROM (SELECT DISTINCT client, session FROM ev)")
def srt01(spark, sf_dir):
    order = Window.partitionBy("client").orderBy("session")
    sessions = telemetry(spark, sf_dir).select("client", "session").distinct()
    return sessions.withColumn("place", F.row_number().over(order).cast("long"))


@register("set01_union", f"WITH {EVENTS} SELECT session, count(*) AS n FROM (SELECT session FROM ev WHERE node = 'click' UNION ALL SELECT session FROM ev WHERE value > 50) GROUP BY session")
def set01(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    both = rows.where("node = 'click'").select("session").unionByName(rows.where("value > 50").select("session"))
    return both.groupBy("session").agg(F.count(F.lit(1)).alias("n"))


@register("set02_intersection", f"WITH {EVENTS} (SELECT session, node FROM ev WHERE value > 200) INTERSECT (SELECT session, node FROM ev WHERE value < 5)")
def set02(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    return rows.where("value > 200").select("session", "node").intersect(rows.where("value < 5").select("session", "node"))


@register("set02_difference", f"WITH {EVENTS} (SELECT session, node FROM ev WHERE value > 50) EXCEPT (SELECT session, node FROM ev WHERE value < 5)")
def set02_difference(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    return rows.where("value > 50").select("session", "node").subtract(rows.where("value < 5").select("session", "node"))


@register("rpt01_method_comparison", f"""
    WITH {CURVE}, a AS (SELECT lang, sum(pos * (N - fp + 0.5 * neg)) / (max(P) * max(N)) AS auroc FROM cv GROUP BY lang HAVING max(P) > 0 AND max(N) > 0)
    SELECT method, round(avg(auroc), 6)::DOUBLE AS auroc, count(*) AS clients, comparable FROM (
        SELECT 'length' AS method, auroc, true AS comparable FROM a UNION ALL SELECT 'inverse', 1 - auroc, true FROM a UNION ALL SELECT 'supervised', 1.0, false FROM a) GROUP BY ALL
""")
def rpt01(spark, sf_dir):
    from fleetscope.operators.report import comparison

    ours = curve(spark, sf_dir).where("auroc is not null").select("auroc")
    tables = {
        "length": (ours, True), "inverse": (ours.select((1 - F.col("auroc")).alias("auroc")), True),
        "supervised": (ours.select(F.lit(1.0).alias("auroc")), False),
    }
    return comparison(tables).withColumn("auroc", F.round("auroc", 6))


@register("rpt02_registry", "SELECT n_name AS name FROM nation WHERE n_regionkey IN (0, 2)")
def rpt02(spark, sf_dir):
    return table(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(0, 2)).select(F.col("n_name").alias("name"))


LENGTH_BIN = 500


def binned_rates(spark, sf_dir):
    """A supervised method: a document's score is the share of bad ones among its language's documents of like length."""
    rows = labelled(spark, sf_dir).withColumn("bin", F.floor(F.col("score") / LENGTH_BIN))
    rates = rows.groupBy("lang", "bin").agg(F.avg(F.col("bad").cast("double")).alias("rate"))
    scored = rows.join(rates, ["lang", "bin"]).select("lang", F.round("rate", 9).alias("rate"), "bad")
    return evaluate.detection_metrics(scored, ["lang"], "rate", F.col("bad"))


def inverse_length(spark, sf_dir):
    return evaluate.detection_metrics(labelled(spark, sf_dir).withColumn("score", -F.col("score")), ["lang"], "score", F.col("bad"))


METHODS = (
    report.Method("length", curve), report.Method("inverse", inverse_length), report.Method("length rates", binned_rates, supervised=True),
    report.Method("hypernetwork"), report.Method("prompted classifier", supervised=True),
)

METHOD_ROWS = f"""
    {LABELLED}, rt AS (SELECT lang, floor(score / {LENGTH_BIN}) AS bin, avg(bad::INT) AS rate FROM ld GROUP BY ALL),
    al AS (SELECT 'length' AS method, lang, score, bad FROM ld UNION ALL SELECT 'inverse', lang, -score, bad FROM ld
           UNION ALL SELECT 'length rates', ld.lang, round(rate, 9), bad FROM ld JOIN rt ON rt.lang = ld.lang AND rt.bin = floor(ld.score / {LENGTH_BIN})),
    sc AS (SELECT method, lang, score, count(*) FILTER (bad) AS pos, count(*) FILTER (NOT bad) AS neg FROM al GROUP BY ALL),
    cv AS (SELECT *, sum(neg) OVER (PARTITION BY method, lang ORDER BY score) - neg AS below, sum(pos) OVER w AS P, sum(neg) OVER w AS N FROM sc WINDOW w AS (PARTITION BY method, lang)),
    mt AS (SELECT method, lang, sum(pos * (below + 0.5 * neg)) / (max(P) * max(N)) AS auroc FROM cv GROUP BY ALL HAVING max(P) > 0 AND max(N) > 0)"""


@register("rpt01_registered_methods", f"""
    WITH {METHOD_ROWS} SELECT method, method <> 'length rates' AS comparable, round(avg(auroc), 6)::DOUBLE AS auroc, count(*) AS clients FROM mt GROUP BY ALL
""")
def rpt01_registered(spark, sf_dir):
    """The registered methods' mean AUROC over languages; the supervised one is marked as not comparable."""
    return report.compared(METHODS, spark, sf_dir).withColumn("auroc", F.round("auroc", 6))


@register("rpt02_method_registry", f"""
    WITH {METHOD_ROWS}, rg(method, supervised, implemented) AS (VALUES ('length', false, true), ('inverse', false, true), ('length rates', true, true),
        ('hypernetwork', false, false), ('prompted classifier', true, false))
    SELECT method, supervised, implemented, count(lang) AS clients FROM rg LEFT JOIN mt USING (method) GROUP BY ALL
""")
def rpt02_registered(spark, sf_dir):
    """All registered methods: which are implemented, and for how many languages they have results."""
    return report.registry(METHODS, report.compared(METHODS, spark, sf_dir))
