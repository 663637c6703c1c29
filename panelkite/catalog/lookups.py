"""Joins between panels and set operations on dates and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkite.catalog.registry import query, r, rounded
from panelkite.catalog.signals import MOMENTUM_SQL, momentum_weights
from panelkite.catalog.tables import BARS, CURVES_TYPE, PANEL, with_
from panelkite.operators import joins as jn
from panelkite.operators import panel as pn
from panelkite.plans import testbed as tb


@query(
    "next_session",
    with_(PANEL)
    + """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ts,
       (SELECT min(s.ts) FROM sess s WHERE s.ts > CAST(o_orderdate AS DATE)) AS next_ts FROM orders""",
)
def next_session(spark, sf_dir):
    decisions = tb.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("ts")
    )
    out = jn.next_session(decisions, pn.session_index(tb.bars_daily(spark, sf_dir)))
    return out.select("o_orderkey", "ts", "next_ts")


@query(
    "lost_weight",
    with_(PANEL, MOMENTUM_SQL)
    + f"""SELECT ts, {r('sum(abs(weight))')} AS lost FROM weights
       WHERE symbol_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000)
       GROUP BY ts HAVING sum(abs(weight)) > 0""",
)
def lost_weight(spark, sf_dir):
    rich = tb.table(spark, sf_dir, "supplier").where("s_acctbal > 1000")
    out = jn.lost_weight(momentum_weights(tb.bars_daily(spark, sf_dir)), rich.select(F.col("s_suppkey").alias("symbol_id")))
    return out.select("ts", rounded("lost").alias("lost"))


@query(
    "union_dates",
    with_(BARS, CURVES_TYPE)
    + "SELECT ts FROM bars UNION SELECT ts FROM curves UNION SELECT CAST(o_orderdate AS DATE) FROM orders",
)
def union_dates(spark, sf_dir):
    orders = tb.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("ts"))
    return jn.union_dates([tb.bars_daily(spark, sf_dir), tb.curves_by_type(spark, sf_dir), orders])


@query(
    "date_sets",
    with_(BARS)
    + """, o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ts FROM orders)
       SELECT 'missing' AS part, ts FROM (SELECT ts FROM bars EXCEPT SELECT ts FROM o)
       UNION ALL SELECT 'common', ts FROM (SELECT ts FROM bars INTERSECT SELECT ts FROM o)""",
)
def date_sets(spark, sf_dir):
    bars = tb.bars_daily(spark, sf_dir)
    orders = tb.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("ts"))
    missing = jn.missing_from(bars, orders, ["ts"]).select(F.lit("missing").alias("part"), "ts")
    return missing.unionByName(
        jn.common_to(bars, orders, ["ts"]).select(F.lit("common").alias("part"), "ts")
    )


@query(
    "union_by_name",
    with_(BARS, CURVES_TYPE)
    + """SELECT CAST(symbol_id AS VARCHAR) AS name, ts, close, CAST(NULL AS DOUBLE) AS equity FROM bars
       UNION ALL SELECT name, ts, NULL, equity FROM curves""",
)
def union_by_name(spark, sf_dir):
    bars = tb.bars_daily(spark, sf_dir).select(F.col("symbol_id").cast("string").alias("name"), "ts", "close")
    return jn.union_frames([bars, tb.curves_by_type(spark, sf_dir)])


@query(
    "resume_worklist",
    """SELECT DISTINCT c_custkey AS code FROM customer WHERE c_custkey NOT IN (
         SELECT o_custkey FROM (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY 1)
         WHERE st <> 'F')""",
)
def resume_worklist(spark, sf_dir):
    universe = tb.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"))
    attempts = tb.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("code"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").alias("attempted_at"),
    )
    return jn.resume_worklist(universe, attempts, F.col("status") == "F")


@query(
    "asof_point_in_time",
    """SELECT o.o_orderkey, o.o_orderdate AS decided,
       (SELECT arg_max(v.price, v.pd) FROM
          (SELECT o_custkey, CAST(o_orderdate AS DATE) AS pd, max(o_totalprice) AS price,
                  CAST(CAST(o_orderdate AS DATE) + INTERVAL 45 DAY AS TIMESTAMP) AS av FROM orders GROUP BY 1, 2) v
        WHERE v.o_custkey = o.o_custkey AND v.av <= o.o_orderdate) AS price
       FROM orders o""",
)
def asof_point_in_time(spark, sf_dir):
    """The customer's last order value known at each decision, 45 days after it was placed."""
    orders = tb.table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    known = (
        orders.groupBy("o_custkey", day.alias("placed"))
        .agg(F.max("o_totalprice").alias("price"))
        .withColumn("available_utc", F.date_add("placed", 45).cast("timestamp_ntz"))
    )
    decisions = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("decided"))
    return jn.asof_join(
        decisions, known, ["o_custkey"], "decided", "available_utc", ["price"], latest_by="placed", block="year"
    ).select("o_orderkey", "decided", "price")
