"""Performance metrics over many curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkite.catalog.registry import query, r, rounded
from panelkite.catalog.tables import ACTIVITY, BARS, CURVES_USER, with_
from panelkite.operators import metrics as mt
from panelkite.plans import testbed as tb

CURVE_SQL = """pts AS (SELECT *, equity / nullif(lag(equity) OVER w, 0) - 1 AS ret,
    equity / max(equity) OVER w - 1 AS dd FROM curves WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
base AS (SELECT run_id, count(*) AS n, arg_min(equity, ts) AS e0, arg_max(equity, ts) AS e1,
    max(ts) - min(ts) AS days, min(dd) AS mdd, stddev_samp(ret) AS sd, avg(ret) AS mu
  FROM pts GROUP BY run_id),
met AS (SELECT *, CASE WHEN n >= 2 AND days > 0 THEN n / (days / 365.25::DOUBLE) END AS ppy,
    e1 / nullif(e0, 0) AS ratio FROM base),
ann AS (SELECT *, CASE WHEN ratio > 0 THEN pow(ratio, ppy / n) - 1 END AS ar FROM met)"""


@query(
    "perf_metrics",
    with_(CURVES_USER, CURVE_SQL)
    + f"""SELECT run_id, e0 AS initial_equity, e1 AS final_equity, {r('ratio - 1')} AS total_return,
       {r('asinh(ar)')} AS asinh_annualized_return, {r('sd * sqrt(ppy)')} AS annualized_volatility,
       {r('(mu - 0.02::DOUBLE / ppy) / nullif(sd, 0) * sqrt(ppy)')} AS sharpe_ratio,
       {r('mdd')} AS max_drawdown, {r('asinh(ar / nullif(abs(mdd), 0))')} AS asinh_calmar,
       0.02::DOUBLE AS risk_free_rate, {r('ppy')} AS annualization_periods FROM ann""",
)
def perf_metrics(spark, sf_dir):
    out = mt.performance(tb.curves_by_user(spark, sf_dir), risk_free=0.02)
    return out.select(
        "run_id",
        "initial_equity",
        "final_equity",
        rounded("total_return").alias("total_return"),
        rounded(F.asinh("annualized_return")).alias("asinh_annualized_return"),
        rounded("annualized_volatility").alias("annualized_volatility"),
        rounded("sharpe_ratio").alias("sharpe_ratio"),
        rounded("max_drawdown").alias("max_drawdown"),
        rounded(F.asinh("calmar_ratio")).alias("asinh_calmar"),
        "risk_free_rate",
        rounded("annualization_periods").alias("annualization_periods"),
    )


@query(
    "perf_metrics_symbols",
    with_(BARS, "curves AS (SELECT symbol_id AS run_id, ts, close AS equity FROM bars)", CURVE_SQL)
    + f"""SELECT run_id, {r('ratio - 1')} AS total_return, {r('ar')} AS annualized_return,
       {r('sd * sqrt(ppy)')} AS annualized_volatility,
       {r('mu / nullif(sd, 0) * sqrt(ppy)')} AS sharpe_ratio, {r('mdd')} AS max_drawdown,
       {r('ar / nullif(abs(mdd), 0)')} AS calmar_ratio FROM ann""",
)
def perf_metrics_symbols(spark, sf_dir):
    curves = tb.bars_daily(spark, sf_dir).select(
        F.col("symbol_id").alias("run_id"), "ts", F.col("close").alias("equity")
    )
    columns = (
        "total_return annualized_return annualized_volatility sharpe_ratio max_drawdown calmar_ratio"
    ).split()
    return mt.performance(curves).select("run_id", *[rounded(c).alias(c) for c in columns])


@query(
    "curve_returns",
    with_(CURVES_USER, CURVE_SQL) + f"SELECT run_id, ts, {r('ret')} AS ret, {r('dd')} AS dd FROM pts",
)
def curve_returns(spark, sf_dir):
    return mt.with_returns(tb.curves_by_user(spark, sf_dir)).select(
        "run_id", "ts", rounded("ret").alias("ret"), rounded("dd").alias("dd")
    )


@query(
    "turnover",
    with_(ACTIVITY)
    + f"""SELECT run_id, {r('sum(change)')} AS turnover,
       count(*) FILTER (WHERE change > 1e-12) AS n_rebalances FROM changes GROUP BY run_id""",
)
def turnover(spark, sf_dir):
    return mt.turnover(tb.activity_weights(spark, sf_dir)).withColumn("turnover", rounded("turnover"))


@query(
    "weight_changes",
    with_(ACTIVITY) + f"SELECT run_id, ts, {r('change')} AS change FROM changes",
)
def weight_changes(spark, sf_dir):
    return mt.weight_changes(tb.activity_weights(spark, sf_dir)).withColumn("change", rounded("change"))


@query(
    "trade_summary",
    f"""SELECT count(*) AS n_trades, {r('sum(l_extendedprice * l_tax)', 2)} AS total_cost,
       {r('min(l_extendedprice * (1 - l_discount))', 4)} AS min_cash FROM lineitem""",
)
def trade_summary(spark, sf_dir):
    fills = tb.table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") * F.col("l_tax")).alias("cost"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cash"),
    )
    return mt.trade_summary(fills).select(
        "n_trades", rounded("total_cost", 2).alias("total_cost"), rounded("min_cash", 4).alias("min_cash")
    )


@query(
    "symbol_statistics",
    with_(BARS)
    + """SELECT symbol_id, count(*) AS "rows", count(DISTINCT ts) AS dates, min(ts) AS first_ts,
       max(ts) AS last_ts FROM bars GROUP BY symbol_id""",
)
def symbol_statistics(spark, sf_dir):
    return tb.bars_daily(spark, sf_dir).groupBy("symbol_id").agg(
        F.count("*").alias("rows"),
        F.count_distinct("ts").alias("dates"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
