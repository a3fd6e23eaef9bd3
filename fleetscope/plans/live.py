"""Streaming forms, run to completion over the events table."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.plans.cleaning import WINDOWS_8_4
from fleetscope.plans.registry import register, table
from fleetscope.plans.storage import new_path, stored
from fleetscope.plans.views import telemetry
from fleetscope.streaming import live


@register("stream_binned_means", """
    SELECT user_id AS session, event_type AS node, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS bin, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL
""")
def stream_binned_means(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    means = live.binned_means(source, "user_id", "ts", "event_type", "value", "1 day", "60 days")
    name, out = f"bins_{uuid.uuid4().hex}", new_path(spark, "bins")

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(out)

    query = means.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", new_path(spark, name)).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select(
        F.col("user_id").alias("session"), F.col("event_type").alias("node"), F.unix_micros("bin.start").alias("bin"),
        F.round("mean", 6).alias("mean"), "n",
    )


def run_to_end(windows: DataFrame, spark) -> DataFrame:
    """All rows that a stream of appended rows gives until its source is exhausted."""
    out = new_path(spark, "live")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    try:
        query = windows.writeStream.outputMode("append").option("checkpointLocation", new_path(spark, "checkpoint")).option("path", out).format("parquet").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(windows.schema).parquet(out)


@register("stream_count_windows", f"WITH {WINDOWS_8_4} SELECT session, k, round(s, 6) AS total, 0 AS late FROM full_w")
def stream_count_windows(spark, sf_dir):
    """Count windows over a stream of the telemetry in several files and triggers: the batch windows, none late."""
    rows = telemetry(spark, sf_dir).select("session", "seq", F.timestamp_micros("t_us").alias("ts"), "value")
    source = stored(rows.repartition(3, "seq"), "telemetry")
    folder = source.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    windows = live.expiring_windows(stream, "session", "seq", "ts", "value", 8, 4, late="4000 days", idle=timedelta(days=30))
    return run_to_end(windows, spark).withColumn("total", F.round("total", 6))
