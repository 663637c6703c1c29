"""Adjustment, total return and currency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkite.catalog.registry import query, r, rounded
from panelkite.catalog.tables import ACTIONS, BARS, CURVES_TYPE, FUND_FACTORS, FX, OLD_BARS, OLD_SNAPSHOT, with_
from panelkite.operators import cleaning as cl
from panelkite.operators import joins as jn
from panelkite.operators import portfolio as pf
from panelkite.plans import testbed as tb

BY = "(PARTITION BY symbol_id ORDER BY ts)"
WHOLE = "(PARTITION BY symbol_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"

FACTORS = """sf AS MATERIALIZED (SELECT b.*, coalesce((SELECT product(a.ratio) FROM actions a
    WHERE a.symbol_id = b.symbol_id AND a.kind = 'split' AND a.ex_date <= b.ts), 1.0) AS f FROM bars b)"""


def adjusted_sql(anchor: str) -> str:
    # factors reach 2^150 on the larger tables, so prices are compared by their logarithm
    cols = ", ".join(f"{r(f'ln({c} * m)')} AS log_{c}_adj" for c in ("open", "high", "low", "close"))
    return (
        with_(BARS, ACTIONS, FACTORS, f"am AS (SELECT *, f / {anchor}(f) OVER {WHOLE} AS m FROM sf)")
        + f"SELECT symbol_id, ts, {r('log2(f)')} AS log_factor, {r('log2(m)')} AS log_multiplier, {cols} FROM am"
    )


def adjusted(spark, sf_dir, method):
    out = cl.adjust_prices(tb.bars_daily(spark, sf_dir), tb.corporate_actions(spark, sf_dir), method)
    return out.select(
        "symbol_id",
        "ts",
        rounded(F.log2("split_factor")).alias("log_factor"),
        rounded(F.log2("adjust_multiplier")).alias("log_multiplier"),
        *[rounded(F.ln(f"{c}_adj")).alias(f"log_{c}_adj") for c in cl.PRICES],
    )


@query("split_adjust_backward", adjusted_sql("last_value"))
def split_adjust_backward(spark, sf_dir):
    return adjusted(spark, sf_dir, "backward")


@query("split_adjust_forward", adjusted_sql("first_value"))
def split_adjust_forward(spark, sf_dir):
    return adjusted(spark, sf_dir, "forward")


@query(
    "split_forward_close",
    with_(BARS, ACTIONS, FACTORS, f"am AS (SELECT *, f / first_value(f) OVER {WHOLE} AS m FROM sf)")
    + f"""SELECT symbol_id, ts, {r('ln(close * m)')} AS log_close_adj, {r('log2(m)')} AS log_factor,
       'split_forward' AS method FROM am""",
)
def split_forward_close(spark, sf_dir):
    out = cl.forward_adjust_close(tb.bars_daily(spark, sf_dir), tb.corporate_actions(spark, sf_dir))
    return out.select(
        "symbol_id",
        "ts",
        rounded(F.ln("close_adj")).alias("log_close_adj"),
        rounded(F.log2("adj_factor")).alias("log_factor"),
        "method",
    )


@query(
    "fund_adj_forward",
    with_(
        BARS,
        FUND_FACTORS,
        """j AS (SELECT b.symbol_id, b.ts, close, coalesce(adj_factor, 1.0) AS f
             FROM bars b LEFT JOIN factors a ON a.symbol_id = b.symbol_id AND a.ts = b.ts)""",
        f"n AS (SELECT *, f / first_value(f) OVER {BY} AS norm FROM j)",
    )
    + f"""SELECT symbol_id, ts, {r('close * norm', 4)} AS close_adj, {r('norm')} AS adj_factor,
       'fund_adj_forward' AS method FROM n""",
)
def fund_adj_forward(spark, sf_dir):
    out = cl.forward_adjust_close(
        tb.bars_daily(spark, sf_dir), factors=tb.fund_factors(spark, sf_dir)
    )
    return out.select(
        "symbol_id",
        "ts",
        rounded("close_adj", 4).alias("close_adj"),
        rounded("adj_factor").alias("adj_factor"),
        "method",
    )


NAV_SQL = f"""ev AS (SELECT symbol_id, ex_date AS ts, max(ratio) AS ratio, max(cash) AS cash
    FROM actions GROUP BY 1, 2),
gr AS (SELECT b.*, coalesce((close * coalesce(ratio, 1) + coalesce(cash, 0))
    / lag(close) OVER (PARTITION BY b.symbol_id ORDER BY b.ts), 1) AS g
  FROM bars b LEFT JOIN ev ON ev.symbol_id = b.symbol_id AND ev.ts = b.ts),
navs AS (SELECT *, product(g) OVER {BY} AS nav FROM gr)"""


@query(
    "total_return_index",
    with_(BARS, ACTIONS, NAV_SQL) + f"SELECT symbol_id, ts, {r('ln(nav)')} AS log_nav FROM navs",
)
def total_return_index(spark, sf_dir):
    out = cl.total_return_index(tb.bars_daily(spark, sf_dir), tb.corporate_actions(spark, sf_dir))
    return out.select("symbol_id", "ts", rounded(F.ln("total_return_nav")).alias("log_nav"))


@query(
    "gold_view",
    with_(
        OLD_BARS,
        ACTIONS,
        FACTORS,
        NAV_SQL,
        f"am AS (SELECT symbol_id, ts, f / last_value(f) OVER {WHOLE} AS m FROM sf)",
    )
    + f"""SELECT symbol_id, ts, close, {r('ln(close * m)')} AS log_close_adj, available_utc, traded,
       {r('ln(nav)')} AS log_nav, CASE WHEN traded THEN 'traded' ELSE 'halted' END AS status
       FROM navs JOIN am USING (symbol_id, ts)""",
)
def gold_view(spark, sf_dir):
    view = cl.gold_backtest_view(
        tb.snapshots(spark, sf_dir), tb.corporate_actions(spark, sf_dir), OLD_SNAPSHOT
    )
    return view.select(
        "symbol_id",
        "ts",
        "close",
        rounded(F.ln("close_adj")).alias("log_close_adj"),
        "available_utc",
        "traded",
        rounded(F.ln("total_return_nav")).alias("log_nav"),
        "status",
    )


@query(
    "fx_normalize",
    with_(FX)
    + f"""SELECT CASE WHEN base = 'CNY' THEN quote ELSE base END AS base, 'CNY' AS quote, ts,
       {r("CASE WHEN base = 'CNY' THEN 1 / rate ELSE rate END")} AS rate FROM fx""",
)
def fx_normalize(spark, sf_dir):
    return cl.normalize_fx_direction(tb.fx_rates(spark, sf_dir)).select(
        "base", "quote", "ts", rounded("rate").alias("rate")
    )


def by_count(spark, sf_dir):
    """Rates between event types: no pair quotes the base currency, so row counts decide."""
    return tb.fx_rates(spark, sf_dir).replace("CNY", "zzz")


@query(
    "fx_normalize_by_count",
    with_(
        FX,
        "z AS (SELECT replace(base, 'CNY', 'zzz') AS base, replace(quote, 'CNY', 'zzz') AS quote, ts, rate FROM fx)",
        "n AS (SELECT base, quote, count(*) AS n FROM z GROUP BY 1, 2)",
        """m AS (SELECT a.base, a.quote, a.n, coalesce(b.n, 0) AS back FROM n a
             LEFT JOIN n b ON b.base = a.quote AND b.quote = a.base)""",
    )
    + f"""SELECT CASE WHEN turn THEN quote ELSE base END AS base,
       CASE WHEN turn THEN base ELSE quote END AS quote, ts,
       {r('CASE WHEN turn THEN 1 / rate ELSE rate END')} AS rate
       FROM (SELECT z.*, back > n OR (back = n AND base > quote) AS turn
             FROM z JOIN m USING (base, quote))""",
)
def fx_normalize_by_count(spark, sf_dir):
    return cl.normalize_fx_direction(by_count(spark, sf_dir)).select(
        "base", "quote", "ts", rounded("rate").alias("rate")
    )


@query(
    "fx_direction_log",
    with_(FX)
    + """SELECT CASE WHEN base = 'CNY' THEN quote ELSE base END AS base, 'CNY' AS quote,
       CASE WHEN count(DISTINCT base) > 1 THEN 'inverted' ELSE 'kept' END AS action,
       count(*) FILTER (WHERE quote = 'CNY') AS forward_rows,
       count(*) FILTER (WHERE base = 'CNY') AS reverse_rows FROM fx GROUP BY 1
       UNION ALL SELECT 'CNY', 'CNY', 'kept', 0, 0""",
)
def fx_direction_log(spark, sf_dir):
    return cl.fx_direction_log(tb.fx_rates(spark, sf_dir))


@query(
    "fx_collisions",
    with_(FX)
    + """SELECT base, quote, ts FROM (SELECT base, quote, ts FROM fx0
         UNION ALL SELECT base, quote, ts FROM fx WHERE base = 'CNY') a
       WHERE base < quote AND EXISTS (SELECT 1 FROM (SELECT base, quote, ts FROM fx0
         UNION ALL SELECT base, quote, ts FROM fx WHERE base = 'CNY') b
         WHERE b.base = a.quote AND b.quote = a.base AND b.ts = a.ts)""",
)
def fx_collisions(spark, sf_dir):
    straight = tb.fx_rates(spark, sf_dir, reverse=False)
    turned = tb.fx_rates(spark, sf_dir).where("base = 'CNY'")
    return cl.fx_collisions(straight.unionByName(turned))


@query(
    "fx_cross_rate",
    with_(FX)
    + f"""SELECT 'click' AS base, 'CNY' AS quote, a.ts, {r('a.rate / nullif(b.rate, 0)')} AS rate
       FROM fx0 a JOIN (SELECT ts, p.rate / c.rate AS rate FROM fx0 p JOIN fx0 c USING (ts)
                        WHERE p.base = 'purchase' AND c.base = 'click') b ON b.ts = a.ts
       WHERE a.base = 'purchase'""",
)
def fx_cross_rate(spark, sf_dir):
    return jn.cross_rate(three_way(spark, sf_dir), "click", "purchase", "CNY").withColumn(
        "rate", rounded("rate")
    )


def three_way(spark, sf_dir):
    """Rates to CNY plus purchase/click, so that click/CNY can also be derived over purchase."""
    fx = tb.fx_rates(spark, sf_dir, reverse=False)
    p = fx.where("base = 'purchase'").select("ts", F.col("rate").alias("_p"))
    c = fx.where("base = 'click'").select("ts", F.col("rate").alias("_c"))
    direct = p.join(c, "ts").select(
        F.lit("purchase").alias("base"),
        F.lit("click").alias("quote"),
        "ts",
        (F.col("_p") / F.col("_c")).alias("rate"),
    )
    return fx.unionByName(direct)


@query(
    "fx_cross_breaks",
    with_(FX)
    + f"""SELECT a.ts, {r('a.rate * 1.01')} AS quoted, {r('a.rate')} AS derived
       FROM fx0 a JOIN fx0 p ON p.ts = a.ts AND p.base = 'purchase'
       WHERE a.base = 'click' AND day(a.ts) % 5 = 0""",
)
def fx_cross_breaks(spark, sf_dir):
    off = (F.col("base") == "click") & (F.dayofmonth("ts") % 5 == 0)
    fx = three_way(spark, sf_dir).withColumn(
        "rate", F.when(off, F.col("rate") * 1.01).otherwise(F.col("rate"))
    )
    return jn.cross_rate_breaks(fx, "click", "purchase", "CNY").select(
        "ts", rounded("quoted").alias("quoted"), rounded("derived").alias("derived")
    )


# rates become available two days after their date
CONVERT = """av AS (SELECT base, ts, rate, CAST(ts + INTERVAL 2 DAY AS TIMESTAMP) AS available_utc FROM fx0),
c AS (SELECT user_id AS run_id, CAST(ts AS DATE) AS ts, round(avg(value) + 1.23e-9, 6) AS equity,
      min(event_type) AS currency FROM events GROUP BY 1, 2),
pr AS (SELECT c.*, (SELECT arg_max(a.rate, a.ts) FROM av a WHERE a.base = c.currency
       AND a.available_utc <= CAST(c.ts AS TIMESTAMP)) AS rate FROM c),
rt AS (SELECT *, equity / nullif(lag(equity) OVER w, 0) - 1 AS l, rate / nullif(lag(rate) OVER w, 0) - 1 AS f
  FROM pr WINDOW w AS (PARTITION BY run_id ORDER BY ts))"""


@query(
    "fx_convert_asof",
    with_(FX, CONVERT)
    + f"""SELECT run_id, ts, equity, rate, {r('l')} AS "local", {r('f')} AS fx,
       {r('l * f')} AS interaction, {r('(1 + l) * (1 + f) - 1')} AS total FROM rt""",
)
def fx_convert_asof(spark, sf_dir):
    curves = (
        tb.table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("run_id"), F.col("ts").cast("date").alias("ts"))
        .agg(F.round(F.avg("value") + 1.23e-9, 6).alias("equity"), F.min("event_type").alias("currency"))
    )
    fx = tb.fx_rates(spark, sf_dir, reverse=False).withColumn(
        "available_utc", F.date_add("ts", 2).cast("timestamp_ntz")
    )
    return cl.convert_curves(curves, fx).select(
        "run_id",
        "ts",
        "equity",
        "rate",
        *[rounded(c).alias(c) for c in ("local", "fx", "interaction", "total")],
    )


@query(
    "return_attribution",
    with_(CURVES_TYPE)
    + f"""SELECT name, ts, {r('l')} AS "local", {r('f')} AS fx, {r('l * f')} AS interaction,
       {r('(1 + l) * (1 + f) - 1')} AS total FROM (
       SELECT name, ts, equity / lag(equity) OVER (PARTITION BY name ORDER BY ts) - 1 AS l,
              (day(ts) % 5 - 2) / 100.0::DOUBLE AS f FROM curves)""",
)
def return_attribution(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("name").orderBy("ts")
    rows = tb.curves_by_type(spark, sf_dir).select(
        "name",
        "ts",
        (F.col("equity") / F.lag("equity").over(w) - 1).alias("_l"),
        ((F.dayofmonth("ts") % 5 - 2) / 100.0).alias("_f"),
    )
    parts = pf.attribute_returns("_l", "_f")
    names = ("local", "fx", "interaction", "total")
    return rows.select("name", "ts", *parts).select(
        "name", "ts", *[rounded(n).alias(n) for n in names]
    )
