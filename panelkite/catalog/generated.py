"""Known-answer panels for the suppliers on the sessions of the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkite.catalog.registry import query, r, rounded
from panelkite.catalog.tables import with_
from panelkite.operators import cleaning as cl
from panelkite.plans import testbed as tb
from panelkite.sources import synthetic as sy


def u(text: str, slot: int = 0) -> str:
    return f"((('0x' || substr(md5({text}), {13 * slot + 1}, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"


def z(text: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({u(text)})) * cos({u(text, 1)} * (2 * 3.141592653589793::DOUBLE)))"


GEN = f"""
gs AS MATERIALIZED (SELECT s_suppkey AS symbol_id, 'X' || (s_suppkey % 3) AS exchange,
    60.0::DOUBLE + s_nationkey * 2 AS init_price, 0.0002::DOUBLE AS mu,
    0.01::DOUBLE + s_nationkey / 5000.0::DOUBLE AS sigma FROM supplier),
sessd AS MATERIALIZED (SELECT ts, idx FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ts FROM orders WHERE isodow(o_orderdate) <= 5))),
li AS MATERIALIZED (SELECT l_suppkey AS symbol_id, CAST(l_shipdate AS DATE) AS ts,
    max(CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN 2.0::DOUBLE END) AS ratio,
    max(CASE WHEN l_quantity = 49 AND l_linenumber = 7 THEN l_tax END) AS cash,
    bool_or(l_quantity = 1 AND l_linenumber = 6) AS halt, bool_or(l_quantity = 2 AND l_linenumber = 6) AS fail
  FROM lineitem GROUP BY 1, 2),
cell AS MATERIALIZED (SELECT s.symbol_id, d.ts, d.idx, init_price, coalesce(l.halt, false) AS halt,
    coalesce(l.fail, false) AS fail,
    CASE WHEN coalesce(l.halt, false) OR d.idx = 0 THEN 1.0::DOUBLE
         ELSE exp(mu + sigma * {z("'7|' || s.symbol_id || '|' || d.idx")}) END AS g,
    CASE WHEN d.idx = 0 THEN 1.0 ELSE coalesce(l.ratio, 1.0) END AS r,
    CASE WHEN d.idx = 0 THEN 0.0 ELSE coalesce(l.cash, 0.0) END AS d
  FROM gs s CROSS JOIN sessd d LEFT JOIN li l ON l.symbol_id = s.symbol_id AND l.ts = d.ts),
prod AS (SELECT *, product(g / r) OVER w AS a, product(g) OVER w AS tri FROM cell
  WINDOW w AS (PARTITION BY symbol_id ORDER BY ts)),
gen AS MATERIALIZED (SELECT *, a * (init_price - sum(d / a) OVER (PARTITION BY symbol_id ORDER BY ts)) AS close FROM prod)"""


def parts(spark, sf_dir):
    key = F.col("s_suppkey")
    symbols = tb.table(spark, sf_dir, "supplier").select(
        key.alias("symbol_id"),
        F.concat(F.lit("X"), key % 3).alias("exchange"),
        (60.0 + F.col("s_nationkey") * 2).alias("init_price"),
        F.lit(0.0002).alias("mu"),
        (0.01 + F.col("s_nationkey") / 5000.0).alias("sigma"),
    )
    orders = tb.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("ts"))
    sessions = orders.where(F.dayofweek("ts").between(2, 6)).distinct().select(
        F.explode(F.array(*[F.lit(f"X{i}") for i in range(3)])).alias("exchange"), "ts"
    )
    items = tb.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol_id"),
        F.col("l_shipdate").cast("date").alias("ts"),
        "l_quantity",
        "l_linenumber",
        "l_tax",
    )
    line, quantity = F.col("l_linenumber"), F.col("l_quantity")
    actions = (
        items.where((line == 7) & quantity.isin(49, 50))
        .groupBy("symbol_id", "ts")
        .agg(
            F.max(F.when(quantity == 50, 2.0)).alias("split_ratio"),
            F.max(F.when(quantity == 49, F.col("l_tax"))).alias("dividend"),
        )
    )
    halts = items.where((line == 6) & (quantity == 1)).select("symbol_id", "ts").distinct()
    failures = items.where((line == 6) & (quantity == 2)).select("symbol_id", "ts").distinct()
    return symbols, sessions, actions, halts, failures


@query(
    "generated_panel",
    with_(GEN, f"""pv AS (SELECT *, CASE WHEN halt THEN close ELSE close * (1 + ({u("'7|' || symbol_id || '|' || idx || '|a'")} - 0.5) * 0.016) END AS op
      FROM gen WHERE NOT fail)""")
    + f"""SELECT symbol_id, ts, {r('close')} AS close, {r('tri')} AS tri, {r('op')} AS open,
       {r(f'''CASE WHEN halt THEN close ELSE greatest(op, close) * (1 + {u("'7|' || symbol_id || '|' || idx || '|a'", 1)} * 0.01) END''')} AS high,
       {r(f'''CASE WHEN halt THEN close ELSE least(op, close) * (1 - {u("'7|' || symbol_id || '|' || idx || '|b'")} * 0.01) END''')} AS low,
       CASE WHEN halt THEN 0 ELSE round(1e6 * exp(({u("'7|' || symbol_id || '|' || idx || '|b'", 1)} - 0.5) * 0.6)) END AS volume,
       NOT halt AS traded FROM pv""",
)
def generated_panel(spark, sf_dir):
    panel = sy.price_panel(*parts(spark, sf_dir), seed=7)
    return panel.select(
        "symbol_id",
        "ts",
        "volume",
        "traded",
        *[rounded(c).alias(c) for c in ("open", "high", "low", "close", "tri")],
    )


@query(
    "known_answer_nav",
    # off only where an action fell into a gap, the first session failed, or both kinds met on a day
    with_(GEN, "lastobs AS (SELECT symbol_id, max(idx) AS li FROM cell WHERE NOT fail GROUP BY 1)")
    + """SELECT symbol_id, count(*) FILTER (WHERE fail) AS missing,
       NOT bool_or((fail AND idx < li AND (idx = 0 OR r <> 1 OR d <> 0))
                   OR (idx > 0 AND r <> 1 AND d <> 0)) AS agrees
       FROM cell JOIN lastobs USING (symbol_id) GROUP BY symbol_id""",
)
def known_answer_nav(spark, sf_dir):
    """The total return recomputed from prices and actions against the declared one."""
    symbols, sessions, actions, halts, failures = parts(spark, sf_dir)
    tasks = sy.series_tasks(symbols)
    bars = sy.price_panel(symbols, sessions, actions, halts, failures, seed=7, tasks=tasks)
    kinds = F.inline(
        F.array(
            F.struct(F.lit("split").alias("kind"), F.col("split_ratio").alias("ratio"), F.lit(None).cast("double").alias("cash")),
            F.struct(F.lit("dividend").alias("kind"), F.lit(None).cast("double").alias("ratio"), F.col("dividend").alias("cash")),
        )
    )
    long = actions.select("symbol_id", F.col("ts").alias("ex_date"), kinds)
    navs = cl.total_return_index(bars, long)
    expected = sy.session_grid(symbols, sessions, tasks).select("symbol_id", "ts")
    return sy.answer_check(bars, navs, expected, tasks).select(
        "symbol_id", "missing", (F.col("max_dev") < 1e-9).alias("agrees")
    )


@query(
    "generated_rates",
    with_(
        """np AS (SELECT n_name AS base, 'CNY' AS quote, 1.0::DOUBLE + n_nationkey AS init_rate, 0.01::DOUBLE AS drift,
             0.003::DOUBLE AS sigma FROM nation)""",
        "sd AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ts FROM orders))",
    )
    + f"""SELECT base, quote, ts, {r("init_rate * exp(sum(drift / 252.0 + sigma * " + z("'3|' || base || quote || '|' || idx") + ") OVER (PARTITION BY base ORDER BY ts))")} AS rate,
       CAST(ts + INTERVAL 1 DAY AS TIMESTAMP) AS available_utc FROM np CROSS JOIN sd""",
)
def generated_rates(spark, sf_dir):
    pairs = tb.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("base"),
        F.lit("CNY").alias("quote"),
        (1.0 + F.col("n_nationkey")).alias("init_rate"),
        F.lit(0.01).alias("drift"),
        F.lit(0.003).alias("sigma"),
    )
    days = tb.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("ts"))
    return sy.rate_series(pairs, days, seed=3).withColumn("rate", rounded("rate"))


@query(
    "generated_macro",
    with_(
        """ms AS (SELECT 'P' || p_partkey AS series_id, 'percent' AS unit, p_retailprice / 1000 AS init_value,
             0.05::DOUBLE AS drift, 0.15::DOUBLE AS sigma, p_size AS lag FROM part)""",
        """mm AS (SELECT last_day(m::DATE) AS ts, row_number() OVER (ORDER BY m) - 1 AS idx FROM (
             SELECT unnest(generate_series(DATE '1998-01-01', DATE '2000-12-31', INTERVAL 1 MONTH)) AS m))""",
    )
    + f"""SELECT series_id, ts, {r("init_value + sum(drift / 12.0 + sigma * " + z("'5|' || series_id || '|' || idx") + ") OVER (PARTITION BY series_id ORDER BY ts)")} AS value,
       unit, CAST(ts + lag AS TIMESTAMP) AS available_utc FROM ms CROSS JOIN mm""",
)
def generated_macro(spark, sf_dir):
    series = tb.table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), "p_partkey").alias("series_id"),
        F.lit("percent").alias("unit"),
        (F.col("p_retailprice") / 1000).alias("init_value"),
        F.lit(0.05).alias("drift"),
        F.lit(0.15).alias("sigma"),
        F.col("p_size").alias("lag"),
    )
    return sy.macro_levels(series, "1998-01-01", "2000-12-31", seed=5).withColumn("value", rounded("value"))


@query(
    "generated_fundamentals",
    f"""SELECT s_suppkey AS symbol_id, make_date(y, 12, 31) AS period_end, make_date(y, 12, 31) + 45 AS as_of_date,
       'revenue' AS item, {r("(60.0::DOUBLE + s_nationkey * 2) * 10000 * exp(0.05 + 0.08 * " + z("'9|' || s_suppkey || '|' || y") + ")", 4)} AS value,
       CAST(make_date(y, 12, 31) + 45 AS TIMESTAMP) + INTERVAL 9 HOUR AS available_utc
       FROM supplier CROSS JOIN (SELECT unnest(range(1995, 2002))::INTEGER AS y)""",
)
def generated_fundamentals(spark, sf_dir):
    symbols = parts(spark, sf_dir)[0]
    return sy.yearly_fundamentals(symbols, 1995, 2001, seed=9).withColumn("value", rounded("value", 4))


@query(
    "generated_calendar",
    with_(
        "x AS (SELECT DISTINCT o_orderpriority AS exchange, CAST(o_orderdate AS DATE) AS ts FROM orders)",
        """d AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY))::DATE AS ts)""",
    )
    + """SELECT e.exchange, d.ts, x.ts IS NOT NULL AS is_open,
       CASE WHEN x.ts IS NOT NULL THEN CAST(d.ts AS TIMESTAMP) + INTERVAL 7 HOUR END AS session_close_utc
       FROM (SELECT DISTINCT exchange FROM x) e CROSS JOIN d
       LEFT JOIN x ON x.exchange = e.exchange AND x.ts = d.ts""",
)
def generated_calendar(spark, sf_dir):
    sessions = tb.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("exchange"), F.col("o_orderdate").cast("date").alias("ts")
    )
    return sy.full_calendar(sessions, "1995-01-01", "2001-12-31")
