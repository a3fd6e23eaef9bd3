"""Test tables in the roles of fleet data, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.functions.vectors import split_nodes
from fleetscope.plans.registry import table

NODES, WIDTH, CLIENTS, PROTOTYPES = 8, 8, 4, 4
TYPES = ("click", "error", "purchase", "signup", "view")

EVENTS = """
    ev AS (
        SELECT event_id, user_id AS session, user_id % 4 AS client, epoch_us(ts) AS t_us, event_type AS node, value,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq
        FROM events
    )"""

#: Embeddings as 8 nodes of 8 values; the first 4 ids of each client are its prototypes.
EMBEDDED = """
    em AS (
        SELECT vec_id, vec_id % 4 AS client, label, embedding::DOUBLE[] AS v FROM embeddings
    ), pr AS (
        SELECT client, row_number() OVER (PARTITION BY client ORDER BY vec_id) - 1 AS m, v AS pv, vec_id AS pid
        FROM em QUALIFY row_number() OVER (PARTITION BY client ORDER BY vec_id) <= 4
    ), gaps AS (
        SELECT vec_id, em.client, label, m, n.node,
               list_sum(list_transform(range(1, 9), lambda k: pow(v[n.node * 8 + k] - pv[n.node * 8 + k], 2))) AS g
        FROM em JOIN pr USING (client), (SELECT unnest(range(8)) AS node) n
    ), near AS (
        SELECT vec_id, client, label, m, sum(g) AS d_proto FROM gaps GROUP BY vec_id, client, label, m
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sum(g), m) = 1
    ), dn AS (
        SELECT near.vec_id, near.client, near.label, near.m, near.d_proto, gaps.node, gaps.g
        FROM near JOIN gaps USING (vec_id, m)
    )"""

#: Wide sensor rows: client, total order, four nodes, fault flag.
WIDE = """
    wide AS (
        SELECT l_linestatus AS client, l_returnflag = 'R' AS fault, l_quantity AS quantity, l_extendedprice AS price,
               l_discount AS discount, l_tax AS tax, l_shipdate, l_orderkey, l_linenumber
        FROM lineitem
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY client ORDER BY l_shipdate, l_orderkey, l_linenumber, quantity, price, discount, tax) - 1 AS place,
               count(*) OVER (PARTITION BY client) AS n
        FROM wide WHERE NOT fault
    ), parted AS (
        SELECT *, CASE WHEN place < floor(n::DOUBLE * 0.7::DOUBLE) THEN 'fit'
                       WHEN place < floor(n::DOUBLE * 0.7::DOUBLE) + floor(n::DOUBLE * 0.15::DOUBLE) THEN 'calib'
                       ELSE 'test' END AS split
        FROM placed
    ), marked AS (
        SELECT client, fault, quantity, price, discount, tax, split FROM parted
        UNION ALL
        SELECT client, fault, quantity, price, discount, tax, 'fault' FROM wide WHERE fault
    )"""
SENSORS = ("quantity", "price", "discount", "tax")
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", *SENSORS)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    t_us = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        "event_id", F.col("user_id").alias("session"), (F.col("user_id") % 4).alias("client"), t_us.alias("t_us"),
        F.col("event_type").alias("node"), "value", (F.row_number().over(order) - 1).cast("long").alias("seq"),
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vector = F.col("embedding").cast("array<double>")
    return rows.select("vec_id", (F.col("vec_id") % CLIENTS).alias("client"), "label", vector.alias("v")).withColumn(
        "z", split_nodes(F.col("v"), NODES, WIDTH)
    )


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("client").orderBy("vec_id")
    ranked = embedded(spark, sf_dir).withColumn("m", F.row_number().over(order)).where(F.col("m") <= PROTOTYPES)
    return ranked.select("client", (F.col("m") - 1).cast("long").alias("m"), "z", F.col("vec_id").alias("gid"), "label")


def prototype_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prototypes(spark, sf_dir).select("gid", "client", "m", F.posexplode("z").alias("node", "vec"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_linestatus").alias("client"), (F.col("l_returnflag") == "R").alias("fault"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), "l_shipdate", "l_orderkey", "l_linenumber",
    )


def melted(df: DataFrame, columns: tuple[str, ...] = SENSORS) -> DataFrame:
    """Long form: ``node, x`` for each of the columns."""
    keep = [c for c in df.columns if c not in columns]
    return df.unpivot(keep, list(columns), "node", "x")
