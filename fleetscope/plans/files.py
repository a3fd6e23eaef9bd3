"""Sources and sinks, on files written from the test tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fleetscope.functions.vectors import total
from fleetscope.operators.report import sweep
from fleetscope.plans.registry import register, table
from fleetscope.plans.storage import new_path
from fleetscope.plans.views import EVENTS, NODES, WIDTH, embedded, telemetry
from fleetscope.sources import archives, sessions


@register("src01_session_csv", "SELECT o_orderkey AS id, o_totalprice AS load FROM orders")
def src01(spark, sf_dir):
    path = new_path(spark, "orders-csv")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.option("header", True).csv(path)
    rows = sessions.read_sessions(spark, path, {"o_orderkey": "id", "o_totalprice": "load"})
    return rows.select(F.col("id").cast("long").alias("id"), F.col("load").cast("double").alias("load"))


@register("src02_recursive_discovery", "SELECT count(*) AS n FROM nation")
def src02(spark, sf_dir):
    path = new_path(spark, "nation-csv")
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), "n_name")
    rows.write.option("header", True).partitionBy("region").csv(path)
    return sessions.read_sessions(spark, path, {"n_name": "name"}).agg(F.count(F.lit(1)).alias("n"))


@register("src03_label_from_path", "SELECT n_name AS name, n_regionkey * 10 AS label FROM nation")
def src03(spark, sf_dir):
    path = new_path(spark, "labelled-csv")
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), "n_name")
    rows.write.option("header", True).partitionBy("region").csv(path)
    read = sessions.read_sessions(spark, path, {"n_name": "name"})
    label = sessions.coded(sessions.path_part(F.col("file"), -2), {f"region={i}": i * 10 for i in range(5)}, "region")
    return read.select("name", label.cast("long").alias("label"))


@register("src04_nanosecond_time", "SELECT event_id, epoch_us(ts) AS t_us FROM events")
def src04(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    nanos = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 7).cast("string")
    return rows.select("event_id", F.unix_micros(sessions.nanosecond_time(nanos)).alias("t_us"))


@register("src05_fault_onset", """
    SELECT user_id AS session, min(epoch_us(ts)) AS onset, array_to_string(list_sort(list(DISTINCT CASE event_type WHEN 'error' THEN 'aileron' ELSE 'rudder' END)), ',') AS surfaces
    FROM events WHERE event_type IN ('error', 'view') AND value > 80 GROUP BY user_id
""")
def src05(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type in ('error', 'view') and value > 80")
    topics = rows.select(F.col("user_id").alias("session"), F.col("event_type").alias("topic"), F.col("ts").cast("timestamp").alias("ts"))
    out = sessions.fault_onsets(topics, {"error": "aileron", "view": "rudder"})
    return out.select("session", F.unix_micros("onset").alias("onset"), F.array_join("surfaces", ",").alias("surfaces"))


@register("src07_archive_members", f"""
    WITH {EVENTS}, s AS (SELECT client, session, count(*) AS n, round(sum(value), 6) AS total, max(seq) AS last_row FROM ev GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY session) AS r, count(*) OVER (PARTITION BY client) AS cycles FROM s)
    SELECT 'OP' || client AS code, session AS cycle, 'first' AS side, n, total, last_row FROM r WHERE r <= 3
    UNION ALL SELECT 'OP' || client, session, 'last', n, total, last_row FROM r WHERE r > cycles - 2
""")
def src07_archive(spark, sf_dir):
    """All sessions are written as cycles of their client's archives; the first three and the last two of each are read."""
    rows = telemetry(spark, sf_dir).select(F.concat(F.lit("OP"), F.col("client")).alias("code"), F.col("session").alias("cycle"), "seq", "t_us", "value")
    path = new_path(spark, "archives")
    archives.write_archives(rows, path, ["seq"])
    found = archives.read_archives(spark, path, "code string, cycle long, side string, row long, value double", first=3, last=2)
    return found.groupBy("code", "cycle", "side").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("row").alias("last_row")
    )


@register("src07_first_and_last", """
    SELECT c_nationkey, c_custkey, r <= 3 AS healthy FROM (
        SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    WHERE r <= 3 OR r > n - 2
""")
def src07(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return sessions.first_and_last(rows, ["c_nationkey"], ["c_custkey"], 3, 2)


@register("src08_name_parts", "SELECT s_suppkey, regexp_extract(s_name, '^([A-Za-z]+)#0*([0-9]+)$', 1) AS kind, regexp_extract(s_name, '^([A-Za-z]+)#0*([0-9]+)$', 2) AS number FROM supplier")
def src08(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", *sessions.parse_name(F.col("s_name"), r"^([A-Za-z]+)#0*([0-9]+)$", ["kind", "number"]))


@register("src09_code_category", """
    SELECT o_orderstatus AS code, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'partial' END AS category, count(*) AS n FROM orders GROUP BY ALL
""")
def src09(spark, sf_dir):
    category = sessions.coded(F.col("o_orderstatus"), {"F": "final", "O": "open", "P": "partial"}, "status")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("code"), category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@register("src11_domains", "SELECT CASE r_regionkey WHEN 0 THEN 'first' ELSE 'f' || r_regionkey END AS fault, count(*) AS nodes FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def src11(spark, sf_dir):
    nested = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    entry = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")), "names")))
    path = new_path(spark, "domains")
    nested.agg(F.to_json(entry).alias("value")).coalesce(1).write.text(path)
    out = sessions.read_domains(spark, path, {"f0": "first"})
    return out.select("fault", F.size("domain").cast("long").alias("nodes"))


@register("snk01_dataset", "SELECT o_orderstatus AS client, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def snk01(spark, sf_dir):
    path = new_path(spark, "dataset")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("client"), "o_totalprice", "o_orderdate")
    sessions.write_dataset(rows, path, {"window": 60, "stride": 32, "nodes": json.dumps(["o_totalprice"])})
    back = sessions.read_dataset(spark, path, drop=["o_orderdate"])
    return back.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("src10_prebuilt_windows", f"""
    WITH em AS (SELECT vec_id, vec_id % 4 AS client, embedding::DOUBLE[] AS v FROM embeddings),
    nd AS (SELECT vec_id, client, k, list_sum(v[k * 8 + 1:k * 8 + 8]) AS s FROM em, (SELECT unnest(range(8)) AS k) WHERE k NOT IN (2, 5))
    SELECT client, 'n' || k AS node, count(*) AS windows, round(sum(s), 6) AS total FROM nd GROUP BY ALL
""")
def src10_prebuilt(spark, sf_dir):
    """A dataset of windows is written with its metadata and loaded without two dead nodes."""
    path, names = new_path(spark, "dataset"), [f"n{i}" for i in range(NODES)]
    sessions.write_dataset(embedded(spark, sf_dir).select("vec_id", "client", "z"), path, {"nodes": json.dumps(names), "width": WIDTH})
    windows, kept = sessions.read_prebuilt(spark, path, "z", dead=["n2", "n5"])
    cells = windows.select("client", F.posexplode("z").alias("at", "values"))
    node = F.element_at(F.array(*[F.lit(n) for n in kept]), F.col("at") + 1).alias("node")
    return cells.groupBy(F.col("client").cast("long").alias("client"), node).agg(
        F.count(F.lit(1)).alias("windows"), F.round(F.sum(total(F.col("values"))), 6).alias("total")
    )


@register("snk02_report", "SELECT n_regionkey AS client, count(*) AS n FROM nation GROUP BY ALL")
def snk02(spark, sf_dir):
    path = new_path(spark, "report")
    metrics = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("client")).agg(F.count(F.lit(1)).alias("n"))
    sessions.write_report(metrics, path, ["client"])
    return spark.read.schema("client long, metrics struct<n: long>").json(path).select("client", "metrics.n")


@register("snk03_sweep", """
    SELECT cut::DOUBLE AS cut, count(*) FILTER (o_totalprice > cut) AS n FROM orders, (SELECT unnest([1000, 100000, 400000]) AS cut) GROUP BY cut
""")
def snk03(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    run = lambda cut: orders.agg(F.count_if(F.col("o_totalprice") > cut).alias("n"))
    return sweep(run, [1000, 100000, 400000], "cut", new_path(spark, "sweep"))
