"""Cleaning, resampling, standardization and filters on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetscope.functions.numbers import to_number
from fleetscope.operators import clean, windows
from fleetscope.plans.registry import register, table
from fleetscope.plans.views import EVENTS, TYPES, WIDE, SENSORS, ORDER, telemetry, wide

RAW = """CASE event_type WHEN 'error' THEN ' TRUE ' WHEN 'click' THEN 'False' WHEN 'view' THEN 'n/a'
         ELSE json_extract_string(props, '$.k') END"""


@register("prj01_numeric_coercion", f"""
    WITH r AS (SELECT event_id, lower(trim({RAW})) AS t FROM events)
    SELECT event_id, CASE t WHEN 'true' THEN 1.0::DOUBLE WHEN 'false' THEN 0.0::DOUBLE ELSE try_cast(t AS DOUBLE) END AS x FROM r
""")
def prj01(spark, sf_dir):
    kind = F.col("event_type")
    raw = F.when(kind == "error", " TRUE ").when(kind == "click", "False").when(kind == "view", "n/a")
    raw = raw.otherwise(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", to_number(raw).alias("x"))


@register("prj02_fill_gaps", f"""
    WITH {EVENTS}, g AS (SELECT session, seq, CASE WHEN node = 'click' THEN value END AS x FROM ev)
    SELECT session, seq, round(coalesce(
        last_value(x IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(x IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        0.0), 6)::DOUBLE AS x FROM g
""")
def prj02(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("session", "seq", F.when(F.col("node") == "click", F.col("value")).alias("x"))
    filled = clean.fill_gaps(rows, ["x"], ["session"], ["seq"])
    return filled.select("session", "seq", F.round("x", 6).alias("x"))


@register("prj03_node_selection", "SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem")
def prj03(spark, sf_dir):
    rows = wide(spark, sf_dir)
    names = clean.select_nodes(rows.columns, {"load": ["tax", "quantity"], "rate": ["discount"]}, ["rate", "load"])
    return rows.select("l_orderkey", "l_linenumber", *names)


@register("prj04_node_exclusion", "SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_tax AS tax FROM lineitem")
def prj04(spark, sf_dir):
    rows = wide(spark, sf_dir)
    names = clean.select_nodes(rows.columns, {"all": ["quantity", "discount", "tax"]}, ["all"], exclude_prefix="disc")
    return rows.select("l_orderkey", "l_linenumber", *names)


@register("prj05_stacked_nodes", """
    SELECT l_orderkey, l_linenumber, round(l_quantity + 2 * l_extendedprice + 3 * l_discount + 4 * l_tax, 4) AS checksum FROM lineitem
""")
def prj05(spark, sf_dir):
    stacked = clean.stack_nodes(wide(spark, sf_dir), SENSORS)
    weighed = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return stacked.select("l_orderkey", "l_linenumber", F.round(weighed, 4).alias("checksum"))


SIX_HOURS = 6 * 3600 * 1_000_000
GRID = f"""
    {EVENTS}, b AS (
        SELECT *, (t_us - min(t_us) OVER (PARTITION BY session)) // {SIX_HOURS} AS bin FROM ev
    ), means AS (
        SELECT session, bin, {', '.join(f"avg(value) FILTER (node = '{t}') AS {t}" for t in TYPES)} FROM b GROUP BY ALL
    ), grid AS (
        SELECT session, unnest(range(max(bin) + 1)) AS bin FROM means GROUP BY session
    ), full_grid AS (SELECT grid.session, grid.bin, {', '.join(TYPES)} FROM grid LEFT JOIN means USING (session, bin))"""


@register("rsm01_resample", f"""
    WITH {GRID}
    SELECT session, bin, {', '.join(f'''round(coalesce(
        last_value({t} IGNORE NULLS) OVER (PARTITION BY session ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value({t} IGNORE NULLS) OVER (PARTITION BY session ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        0.0), 6)::DOUBLE AS {t}''' for t in TYPES)}
    FROM full_grid
""")
def rsm01(spark, sf_dir):
    grid = clean.resample(telemetry(spark, sf_dir), "session", "t_us", "node", "value", TYPES, SIX_HOURS)
    return grid.select("session", "bin", *[F.round(t, 6).alias(t) for t in TYPES])


@register("jon10_full_grid", f"""
    WITH {GRID} SELECT session, count(*) AS bins, count(*) FILTER (click IS NULL) AS without_click FROM full_grid GROUP BY session
""")
def jon10(spark, sf_dir):
    grid = clean.resample(telemetry(spark, sf_dir), "session", "t_us", "node", "value", TYPES, SIX_HOURS, fill=False)
    return grid.groupBy("session").agg(F.count(F.lit(1)).alias("bins"), F.count_if(F.col("click").isNull()).alias("without_click"))


BLOCKS = f"""
    {EVENTS}, l AS (SELECT session, seq, value, count(*) OVER (PARTITION BY session) AS n FROM ev),
    k AS (SELECT *, CASE WHEN seq < (n % 7) * (n // 7 + 1) THEN seq // (n // 7 + 1)
                         ELSE n % 7 + (seq - (n % 7) * (n // 7 + 1)) // greatest(n // 7, 1) END AS block FROM l)"""


@register("rsm02_block_rms", f"WITH {BLOCKS} SELECT session, block, round(sqrt(avg(value * value)), 6) AS value, count(*) AS n FROM k GROUP BY ALL")
def rsm02(spark, sf_dir):
    out = clean.decimate_blocks(telemetry(spark, sf_dir), ["session"], "seq", "value", 7, "rms")
    return out.select("session", "block", F.round("value", 6).alias("value"), "n")


@register("rsm02_block_mean", f"WITH {BLOCKS} SELECT session, block, round(avg(value), 6) AS value, count(*) AS n FROM k GROUP BY ALL")
def rsm02_mean(spark, sf_dir):
    out = clean.decimate_blocks(telemetry(spark, sf_dir), ["session"], "seq", "value", 7)
    return out.select("session", "block", F.round("value", 6).alias("value"), "n")


@register("rsm03_box_average", f"WITH {EVENTS} SELECT session, seq // 5 AS block, round(avg(value), 6) AS value, count(*) AS n FROM ev GROUP BY ALL")
def rsm03(spark, sf_dir):
    out = clean.decimate_factor(telemetry(spark, sf_dir), ["session"], "seq", "value", 5)
    return out.select("session", "block", F.round("value", 6).alias("value"), "n")


@register("rsm04_truncate", f"""
    WITH {EVENTS}, l AS (SELECT client, session, count(*) AS n FROM ev GROUP BY ALL), s AS (SELECT client, min(n) AS shortest FROM l GROUP BY client)
    SELECT session, seq, event_id FROM ev JOIN s USING (client) WHERE seq < shortest
""")
def rsm04(spark, sf_dir):
    return clean.truncate_to_shortest(telemetry(spark, sf_dir), ["client"], ["session"], "seq").select("session", "seq", "event_id")


@register("std01_global_standardization", """
    SELECT l_orderkey, l_linenumber,
           round((l_quantity - avg(l_quantity) OVER ()) / CASE WHEN stddev_pop(l_quantity) OVER () < 1e-8 THEN 1 ELSE stddev_pop(l_quantity) OVER () END, 6) AS quantity,
           round((l_tax - avg(l_tax) OVER ()) / CASE WHEN stddev_pop(l_tax) OVER () < 1e-8 THEN 1 ELSE stddev_pop(l_tax) OVER () END, 6) AS tax
    FROM lineitem
""")
def std01(spark, sf_dir):
    out = clean.standardize(wide(spark, sf_dir), ["quantity", "tax"])
    return out.select("l_orderkey", "l_linenumber", F.round("quantity", 6).alias("quantity"), F.round("tax", 6).alias("tax"))


@register("std02_client_standardization", f"""
    WITH {WIDE}, s AS (
        SELECT client, avg(price) AS m, stddev_pop(price) AS sd FROM marked WHERE split = 'fit' GROUP BY client
    ) SELECT client, split, count(*) AS n, round(sum((price - m) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END), 3) AS total,
             round(max((price - m) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END), 6) AS largest
      FROM marked JOIN s USING (client) GROUP BY ALL
""")
def std02(spark, sf_dir):
    out = clean.standardize(split_rows(spark, sf_dir), ["price"], ["client"], F.col("split") == "fit")
    return out.groupBy("client", "split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 3).alias("total"), F.round(F.max("price"), 6).alias("largest")
    )


def split_rows(spark, sf_dir):
    """Wide rows with split fit, calib, test or fault."""
    rows = wide(spark, sf_dir)
    normal = windows.chronological_split(rows.where(~F.col("fault")), ["client"], ORDER)
    return normal.unionByName(rows.where("fault").withColumn("split", F.lit("fault")))


@register("win07_chronological_split", f"""
    WITH {WIDE} SELECT client, split, count(*) AS n, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM parted GROUP BY ALL
""")
def win07(spark, sf_dir):
    rows = wide(spark, sf_dir).where(~F.col("fault"))
    return windows.chronological_split(rows, ["client"], ORDER).groupBy("client", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day")
    )


@register("win08_build_split", f"""
    WITH {EVENTS}, c AS (SELECT client, session, row_number() OVER (PARTITION BY client ORDER BY session) - 1 AS p, count(*) OVER (PARTITION BY client) AS n
                         FROM (SELECT DISTINCT client, session FROM ev))
    SELECT client, session, CASE WHEN p < floor(n::DOUBLE * 0.75::DOUBLE) THEN 'fit' ELSE 'test' END AS split FROM c
""")
def win08(spark, sf_dir):
    sessions = telemetry(spark, sf_dir).select("client", "session").distinct()
    return windows.chronological_split(sessions, ["client"], ["session"], fit=0.75, calib=0.0)


@register("win10_hashed_split", """
    WITH p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1 AS p,
                      count(*) OVER (PARTITION BY label) AS n FROM embeddings)
    SELECT vec_id, label, CASE WHEN p < floor(n::DOUBLE * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM p
""")
def win10(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return windows.hashed_split(rows, ["label"], "vec_id")


@register("win11_round_robin", """
    SELECT c_nationkey, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 6 AS client FROM customer
""")
def win11(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return windows.round_robin(rows, ["c_nationkey"], ["c_custkey"], 6)


@register("flt01_long_sessions", f"WITH {EVENTS} SELECT session, count(*) AS n FROM ev GROUP BY session HAVING count(*) >= 60")
def flt01(spark, sf_dir):
    return clean.long_enough(telemetry(spark, sf_dir), ["session"], 60).groupBy("session").agg(F.count(F.lit(1)).alias("n"))


@register("flt02_faulty_windows", f"""
    WITH {EVENTS}, o AS (SELECT session, min(t_us) AS onset FROM ev WHERE node = 'error' AND value > 100 GROUP BY session)
    SELECT session, seq // 8 AS k, coalesce(bool_or(t_us >= onset), false) AS fault FROM ev LEFT JOIN o USING (session)
    GROUP BY ALL HAVING count(*) = 8
""")
def flt02(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    onset = rows.where("node = 'error' and value > 100").groupBy("session").agg(F.min("t_us").alias("onset"))
    joined = rows.join(onset, "session", "left").withColumn("k", F.floor(F.col("seq") / 8))
    out = joined.groupBy("session", "k").agg(
        F.coalesce(F.bool_or(F.col("t_us") >= F.col("onset")), F.lit(False)).alias("fault"), F.count(F.lit(1)).alias("n")
    )
    return out.where("n = 8").select("session", "k", "fault")


@register("flt03_reliable_nodes", f"""
    WITH {EVENTS}, q AS (SELECT client, node, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM ev GROUP BY ALL)
    SELECT client, node, iqr >= 0.98::DOUBLE * quantile_cont(iqr, 0.5) OVER (PARTITION BY client) AS reliable FROM q
""")
def flt03(spark, sf_dir):
    from fleetscope.operators.scoring import robust_stats

    stats = robust_stats(telemetry(spark, sf_dir), ["client", "node"], "value")
    return clean.reliable_nodes(stats, share=0.98).select("client", "node", "reliable")


WINDOWS_8_4 = f"""
    {EVENTS}, w AS (
        SELECT client, session, k, ev.seq, value FROM ev,
               LATERAL (SELECT unnest(range(greatest(0, ceil((seq - 7) / 4.0)::BIGINT), seq // 4 + 1)) AS k)
    ), full_w AS (
        SELECT client, session, k, count(*) AS n, sum(value) AS s, first(value ORDER BY seq) AS head, last(value ORDER BY seq) AS tail
        FROM w GROUP BY ALL HAVING count(*) = 8
    )"""


def windows_8_4(spark, sf_dir):
    return windows.count_windows(telemetry(spark, sf_dir), ["client", "session"], "seq", F.col("value"), 8, 4)


@register("win01_count_windows", f"WITH {WINDOWS_8_4} SELECT session, k, round(s, 6) AS total, head, tail FROM full_w")
def win01(spark, sf_dir):
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return windows_8_4(spark, sf_dir).select(
        "session", "k", F.round(total, 6).alias("total"), F.col("x")[0].alias("head"), F.col("x")[7].alias("tail")
    )


@register("win02_windows_per_session", f"""
    WITH {EVENTS} SELECT session, greatest((count(*) - 8) // 4 + 1, 0) AS expected FROM ev GROUP BY session
""")
def win02(spark, sf_dir):
    counted = telemetry(spark, sf_dir).groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("session", windows.expected_windows(F.col("n"), 8, 4).alias("expected"))


@register("win03_grid_windows", f"""
    WITH {GRID}, w AS (SELECT session, k, bin, coalesce(click, 0) AS v FROM full_grid,
               LATERAL (SELECT unnest(range(greatest(0, ceil((bin - 14) / 8.0)::BIGINT), bin // 8 + 1)) AS k))
    SELECT session, k, round(sum(v), 6) AS total FROM w GROUP BY ALL HAVING count(*) = 15
""")
def win03(spark, sf_dir):
    grid = clean.resample(telemetry(spark, sf_dir), "session", "t_us", "node", "value", TYPES, SIX_HOURS, fill=False)
    out = windows.count_windows(grid, ["session"], "bin", F.coalesce("click", F.lit(0.0)), 15, 8)
    return out.select("session", "k", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@register("win04_forecast_pairs", f"""
    WITH {WINDOWS_8_4}, g AS (SELECT *, s < 700 AS ok FROM full_w)
    SELECT session, k, coalesce(count(*) OVER f = 2 AND bool_and(ok) OVER f AND max(k) OVER f = k + 2, false) AS paired
    FROM g WINDOW f AS (PARTITION BY session ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)
""")
def win04(spark, sf_dir):
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    out = windows.forecast_pairs(windows_8_4(spark, sf_dir), ["session"], "k", 2, total < 700)
    return out.select("session", "k", "paired")


@register("win05_position_pairs", f"""
    WITH {WINDOWS_8_4} SELECT session, k, k < count(*) OVER (PARTITION BY session) - 3 AS paired FROM full_w
""")
def win05(spark, sf_dir):
    n = F.count(F.lit(1)).over(Window.partitionBy("session"))
    return windows_8_4(spark, sf_dir).select("session", "k", windows.position_pairs(F.col("k"), n, 3).alias("paired"))


@register("win06_future", f"""
    WITH {WINDOWS_8_4}, pairs AS (SELECT session, k FROM full_w a WHERE EXISTS (SELECT 1 FROM full_w b WHERE b.session = a.session AND b.k = a.k + 2))
    SELECT pairs.session, k, count(*) AS n, round(sum(value), 6) AS total
    FROM pairs JOIN ev ON ev.session = pairs.session AND ev.seq >= k * 4 + 8 AND ev.seq < k * 4 + 16 GROUP BY ALL
""")
def win06(spark, sf_dir):
    paired = windows.forecast_pairs(windows_8_4(spark, sf_dir), ["session"], "k", 2)
    out = windows.future_values(paired, ["session"], "k", "x", 4, 2).where("paired")
    return out.select(
        "session", "k", F.size("future").cast("long").alias("n"),
        F.round(F.aggregate("future", F.lit(0.0), lambda s, v: s + v), 6).alias("total"),
    )


@register("win09_client_order", f"""
    WITH {EVENTS} SELECT event_id, client, row_number() OVER (ORDER BY client, event_id) - 1 AS place FROM ev
""")
def win09(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("event_id", "client").withColumn("__all", F.lit(0))
    return windows.numbered_at_scale(rows, ["__all"], ["client", "event_id"], "place").select("event_id", "client", "place")


@register("ana02_lead", f"WITH {EVENTS} SELECT session, seq, lead(value, 3) OVER (PARTITION BY session ORDER BY seq) AS ahead FROM ev")
def ana02(spark, sf_dir):
    ahead = F.lead("value", 3).over(Window.partitionBy("session").orderBy("seq"))
    return telemetry(spark, sf_dir).select("session", "seq", ahead.alias("ahead"))


@register("jon07_offset_join", f"""
    WITH {EVENTS} SELECT a.session, a.seq, round(b.value - a.value, 6) AS gap FROM ev a JOIN ev b ON a.session = b.session AND b.seq = a.seq + 2
""")
def jon07(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("session", "seq", "value")
    later = rows.select("session", (F.col("seq") - 2).alias("seq"), F.col("value").alias("later"))
    return rows.join(later, ["session", "seq"]).select("session", "seq", F.round(F.col("later") - F.col("value"), 6).alias("gap"))
