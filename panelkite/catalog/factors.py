"""Factor expressions over the daily panel; ranks over the weekly panel of all suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.catalog.registry import query, r, rounded
from panelkite.catalog.tables import PANEL, WEEKLY, with_
from panelkite.functions import crosssection, recursive
from panelkite.functions import factors as fx
from panelkite.operators.panel import densify
from panelkite.plans import testbed as tb
from panelkite.session import settle

KEY = ["symbol_id", "ts"]
W20 = "(PARTITION BY symbol_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
BY = "(PARTITION BY symbol_id ORDER BY ts)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(tb.bars_daily(spark, sf_dir))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(tb.bars_weekly(spark, sf_dir))


@query(
    "field_const_shift",
    with_(PANEL)
    + f"""SELECT symbol_id, ts, close AS price, 2.5::DOUBLE AS two_half,
       lag(close) OVER {BY} AS prev, lag(close, 5) OVER {BY} AS prev5 FROM panel""",
)
def field_const_shift(spark, sf_dir):
    return daily(spark, sf_dir).select(
        *KEY,
        fx.field("close").alias("price"),
        fx.const(2.5).alias("two_half"),
        fx.shift("close").alias("prev"),
        fx.shift("close", 5).alias("prev5"),
    )


@query(
    "sma_20",
    with_(PANEL)
    + f"""SELECT symbol_id, ts,
       CASE WHEN count(close) OVER {W20} = 20 THEN {r(f'avg(close) OVER {W20}', 4)} END AS sma_20
       FROM panel""",
)
def sma_20(spark, sf_dir):
    return daily(spark, sf_dir).select(*KEY, rounded(fx.sma("close", 20), 4).alias("sma_20"))


@query(
    "std_20",
    with_(PANEL)
    + f"""SELECT symbol_id, ts,
       CASE WHEN count(close) OVER {W20} = 20 THEN {r(f'stddev_samp(close) OVER {W20}', 4)} END AS std_20
       FROM panel""",
)
def std_20(spark, sf_dir):
    return daily(spark, sf_dir).select(*KEY, rounded(fx.std("close", 20), 4).alias("std_20"))


@query(
    "zscore_20",
    with_(PANEL)
    + f"""SELECT symbol_id, ts, CASE WHEN count(close) OVER {W20} = 20 THEN
       {r(f'(close - avg(close) OVER {W20}) / nullif(stddev_samp(close) OVER {W20}, 0)')} END AS zscore_20
       FROM panel""",
)
def zscore_20(spark, sf_dir):
    return daily(spark, sf_dir).select(*KEY, rounded(fx.zscore("close", 20)).alias("zscore_20"))


@query(
    "momentum_63",
    with_(PANEL)
    + f"""SELECT symbol_id, ts, {r(f'close / nullif(lag(close, 63) OVER {BY}, 0) - 1')} AS momentum_63
       FROM panel""",
)
def momentum_63(spark, sf_dir):
    return daily(spark, sf_dir).select(*KEY, rounded(fx.momentum("close", 63)).alias("momentum_63"))


@query(
    "linreg_20",
    with_(PANEL, "y AS (SELECT *, ln(close) AS y FROM panel)")
    + f"""SELECT symbol_id, ts,
       CASE WHEN count(y) OVER {W20} = 20 THEN {r(f'regr_slope(y, idx) OVER {W20}', 8)} END AS slope,
       CASE WHEN count(y) OVER {W20} = 20 AND max(y) OVER {W20} <> min(y) OVER {W20}
            THEN {r(f'regr_r2(y, idx) OVER {W20}')} END AS r2
       FROM y""",
)
def linreg_20(spark, sf_dir):
    return daily(spark, sf_dir).select(
        *KEY,
        rounded(fx.linreg_slope("close", 20), 8).alias("slope"),
        rounded(fx.linreg_r2("close", 20)).alias("r2"),
    )


@query(
    "lagged_sma_std",
    with_(PANEL, f"l AS (SELECT *, lag(close) OVER {BY} AS p FROM panel)")
    + f"""SELECT symbol_id, ts,
       CASE WHEN count(p) OVER {W20} = 20 THEN {r(f'avg(p) OVER {W20}', 4)} END AS sma_lagged,
       CASE WHEN count(p) OVER {W20} = 20 THEN {r(f'stddev_samp(p) OVER {W20}', 4)} END AS std_lagged
       FROM l""",
)
def lagged_sma_std(spark, sf_dir):
    return daily(spark, sf_dir).select(
        *KEY,
        rounded(fx.sma("close", 20, lag=1), 4).alias("sma_lagged"),
        rounded(fx.std("close", 20, lag=1), 4).alias("std_lagged"),
    )


ALPHA = "(2.0::DOUBLE / 13)"


@query(
    "ema_12",
    with_(
        PANEL,
        # m is the running mean, ow the decayed weight of the past, k the observations so far
        f"""rec AS (
  SELECT symbol_id, ts, idx, close AS m, CASE WHEN close IS NULL THEN 0 ELSE 1 END::DOUBLE AS ow,
         CASE WHEN close IS NULL THEN 0 ELSE 1 END AS k
  FROM panel WHERE idx = 0
  UNION ALL
  SELECT p.symbol_id, p.ts, p.idx,
         CASE WHEN p.close IS NULL THEN c.m WHEN c.k = 0 THEN p.close
              ELSE (c.ow * (1 - {ALPHA}) * c.m + {ALPHA} * p.close) / (c.ow * (1 - {ALPHA}) + {ALPHA}) END,
         CASE WHEN p.close IS NOT NULL THEN 1 ELSE c.ow * (1 - {ALPHA}) END,
         c.k + CASE WHEN p.close IS NULL THEN 0 ELSE 1 END
  FROM rec c JOIN panel p ON p.symbol_id = c.symbol_id AND p.idx = c.idx + 1)""",
        recursive=True,
    )
    + f"SELECT symbol_id, ts, CASE WHEN k >= 12 THEN {r('m', 4)} END AS ema_12 FROM rec",
)
def ema_12(spark, sf_dir):
    out = recursive.ema(daily(spark, sf_dir).select(*KEY, "close"), "close", 12)
    return out.select(*KEY, rounded("ema", 4).alias("ema_12"))


A20 = "(2.0::DOUBLE / 21)"


@query(
    "ewm_std_20",
    with_(
        PANEL,
        f"ret AS MATERIALIZED (SELECT *, close / nullif(lag(close) OVER {BY}, 0) - 1 AS x FROM panel)",
        f"""rec AS (
  SELECT symbol_id, ts, idx, x AS m, 0.0::DOUBLE AS cov, 1.0::DOUBLE AS sw, 1.0::DOUBLE AS sw2,
         1.0::DOUBLE AS ow, 0 AS k
  FROM ret WHERE idx = 0
  UNION ALL
  SELECT symbol_id, ts, idx,
    CASE WHEN x IS NULL THEN m WHEN k = 0 THEN x ELSE nm END,
    CASE WHEN x IS NULL OR k = 0 THEN cov
         ELSE (ow * (cov + (m - nm) * (m - nm)) + {A20} * (x - nm) * (x - nm)) / (ow + {A20}) END,
    CASE WHEN k = 0 THEN 1 WHEN x IS NULL THEN sw ELSE (sw + {A20}) / (ow + {A20}) END,
    CASE WHEN k = 0 THEN 1 WHEN x IS NULL THEN sw2
         ELSE (sw2 + {A20} * {A20}) / ((ow + {A20}) * (ow + {A20})) END,
    CASE WHEN x IS NOT NULL OR k = 0 THEN 1 ELSE ow END,
    k + CASE WHEN x IS NULL THEN 0 ELSE 1 END
  FROM (SELECT p.symbol_id, p.ts, p.idx, p.x, c.m, c.cov, c.k,
               c.sw * (1 - {A20}) AS sw, c.sw2 * (1 - {A20}) * (1 - {A20}) AS sw2,
               c.ow * (1 - {A20}) AS ow,
               (c.ow * (1 - {A20}) * c.m + {A20} * p.x) / (c.ow * (1 - {A20}) + {A20}) AS nm
        FROM rec c JOIN ret p ON p.symbol_id = c.symbol_id AND p.idx = c.idx + 1))""",
        recursive=True,
    )
    + f"""SELECT symbol_id, ts, CASE WHEN k >= 20 AND sw * sw - sw2 > 0
       THEN {r('sqrt(sw * sw / (sw * sw - sw2) * cov)')} END AS ewm_std_20 FROM rec""",
)
def ewm_std_20(spark, sf_dir):
    out = recursive.ewm_std(daily(spark, sf_dir).select(*KEY, "close"), "close", 20)
    return out.select(*KEY, rounded("ewm_std").alias("ewm_std_20"))


@query(
    "llt_01",
    with_(
        PANEL,
        f"""dr AS MATERIALIZED (SELECT symbol_id, ts, idx,
  (0.1::DOUBLE - 0.0025) * close + 0.005::DOUBLE * lag(close, 1) OVER {BY}
  - (0.1::DOUBLE - 0.0075) * lag(close, 2) OVER {BY} AS d FROM panel)""",
        """rec AS (
  SELECT symbol_id, ts, idx, CAST(NULL AS DOUBLE) AS y, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2
  FROM dr WHERE idx = 0
  UNION ALL
  SELECT symbol_id, ts, idx, ny, coalesce(ny, y1), CASE WHEN ny IS NULL THEN y2 ELSE y1 END
  FROM (SELECT p.symbol_id, p.ts, p.idx, c.y1, c.y2,
               p.d + 1.8::DOUBLE * c.y1 - 0.81::DOUBLE * c.y2 AS ny
        FROM rec c JOIN dr p ON p.symbol_id = c.symbol_id AND p.idx = c.idx + 1))""",
        recursive=True,
    )
    + f"SELECT symbol_id, ts, {r('y', 4)} AS llt FROM rec",
)
def llt_01(spark, sf_dir):
    out = recursive.llt(daily(spark, sf_dir).select(*KEY, "close"), "close", 0.1)
    return out.select(*KEY, rounded("llt", 4).alias("llt"))


@query(
    "comparisons",
    with_(PANEL, f"l AS (SELECT *, lag(close) OVER {BY} AS p FROM panel)")
    + """SELECT symbol_id, ts, coalesce(close > p, false) AS gt, coalesce(close < p, false) AS lt,
       coalesce(close >= p, false) AS ge, coalesce(close <= p, false) AS le,
       coalesce(abs(close - round(close, 3)) <= 1e-8 + 1e-5 * abs(round(close, 3)), false) AS eq_round,
       coalesce(abs(close - p) <= 1e-8 + 1e-5 * abs(p), false) AS eq_prev
       FROM l""",
)
def comparisons(spark, sf_dir):
    prev = fx.shift("close")
    return daily(spark, sf_dir).select(
        *KEY,
        fx.gt("close", prev).alias("gt"),
        fx.lt("close", prev).alias("lt"),
        fx.ge("close", prev).alias("ge"),
        fx.le("close", prev).alias("le"),
        fx.eq("close", F.round("close", 3)).alias("eq_round"),
        fx.eq("close", prev).alias("eq_prev"),
    )


CROSS = f"""m AS (SELECT *,
  CASE WHEN count(close) OVER w5 = 5 THEN {r('avg(close) OVER w5', 4)} END AS fast,
  CASE WHEN count(close) OVER {W20} = 20 THEN {r(f'avg(close) OVER {W20}', 4)} END AS slow
  FROM panel WINDOW w5 AS (PARTITION BY symbol_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, coalesce(fast > slow AND lag(fast) OVER {BY} <= lag(slow) OVER {BY}, false) AS up,
  coalesce(fast < slow AND lag(fast) OVER {BY} >= lag(slow) OVER {BY}, false) AS down FROM m)"""


@query("cross_signals", with_(PANEL, CROSS) + "SELECT symbol_id, ts, up, down FROM c")
def cross_signals(spark, sf_dir):
    fast, slow = rounded(fx.sma("close", 5), 4), rounded(fx.sma("close", 20), 4)
    return daily(spark, sf_dir).select(
        *KEY, fx.cross_above(fast, slow).alias("up"), fx.cross_below(fast, slow).alias("down")
    )


@query(
    "condition_logic",
    with_(PANEL, f"l AS (SELECT *, lag(close) OVER {BY} AS p FROM panel)")
    + """SELECT symbol_id, ts,
       coalesce(close > p, false) AND coalesce(close > 1500, false) AS both_true,
       coalesce(close > p, false) OR coalesce(close > 1500, false) AS any_true,
       NOT coalesce(close > p, false) AS not_up,
       coalesce(close <> 0, false) AS number_true,
       CASE WHEN coalesce(close > p, false) THEN close ELSE p END AS higher
       FROM l""",
)
def condition_logic(spark, sf_dir):
    prev = fx.shift("close")
    up, large = F.col("close") > prev, F.col("close") > 1500
    return daily(spark, sf_dir).select(
        *KEY,
        fx.and_(up, large).alias("both_true"),
        fx.or_(up, large).alias("any_true"),
        fx.not_(up).alias("not_up"),
        fx.truth("close").alias("number_true"),
        fx.condition(up, "close", prev).alias("higher"),
    )


@query(
    "arith_chain",
    with_(PANEL, f"l AS (SELECT *, lag(close) OVER {BY} AS p FROM panel)")
    + f"""SELECT symbol_id, ts, {r('close + p')} AS added, {r('close - p')} AS diff,
       {r('close * p', 4)} AS product, {r('close / nullif(p, 0)')} AS ratio, {r('-close')} AS negated,
       {r('CASE WHEN close > 0 THEN ln(close) END')} AS logged, {r('exp(close / 100000.0)')} AS expd,
       {r('close / nullif(close - close, 0)')} AS by_zero
       FROM l""",
)
def arith_chain(spark, sf_dir):
    prev = fx.shift("close")
    return daily(spark, sf_dir).select(
        *KEY,
        rounded(fx.add("close", prev)).alias("added"),
        rounded(fx.sub("close", prev)).alias("diff"),
        rounded(fx.mul("close", prev), 4).alias("product"),
        rounded(fx.div("close", prev)).alias("ratio"),
        rounded(fx.neg("close")).alias("negated"),
        rounded(fx.log("close")).alias("logged"),
        rounded(fx.exp(fx.div("close", 100000.0))).alias("expd"),
        rounded(fx.div("close", fx.sub("close", "close"))).alias("by_zero"),
    )


def rank_sql(order: str) -> str:
    return f"""m AS (SELECT symbol_id, ts,
    {r(f'close / nullif(lag(close, 4) OVER {BY}, 0) - 1', 3)} AS mom FROM panel)
SELECT symbol_id, ts, CASE WHEN mom IS NOT NULL THEN
  rank() OVER (PARTITION BY ts, mom IS NULL ORDER BY mom {order})
  + (count(*) OVER (PARTITION BY ts, mom) - 1) / 2.0::DOUBLE END AS rank
FROM m"""


def scored(spark, sf_dir):
    """Momentum with three decimals, so that many symbols tie."""
    mom = rounded(fx.momentum("close", 4), 3).alias("mom")
    return settle(weekly(spark, sf_dir).select(*KEY, mom), "scored")


@query("xs_rank", with_(WEEKLY, rank_sql("DESC")))
def xs_rank(spark, sf_dir):
    return crosssection.cross_sectional_rank(scored(spark, sf_dir), "mom").select(*KEY, "rank")


@query("xs_rank_ascending", with_(WEEKLY, rank_sql("")))
def xs_rank_ascending(spark, sf_dir):
    ranked = crosssection.cross_sectional_rank(scored(spark, sf_dir), "mom", ascending=True)
    return ranked.select(*KEY, "rank")


@query(
    "weekly_factor_sheet",
    with_(WEEKLY)
    + f"""SELECT symbol_id, ts,
       CASE WHEN count(close) OVER {W20} = 20 THEN {r(f'avg(close) OVER {W20}', 4)} END AS sma_20,
       CASE WHEN count(close) OVER {W20} = 20 THEN {r(f'stddev_samp(close) OVER {W20}', 4)} END AS std_20,
       {r(f'close / nullif(lag(close, 12) OVER {BY}, 0) - 1')} AS momentum_12
       FROM panel""",
)
def weekly_factor_sheet(spark, sf_dir):
    return weekly(spark, sf_dir).select(
        *KEY,
        rounded(fx.sma("close", 20), 4).alias("sma_20"),
        rounded(fx.std("close", 20), 4).alias("std_20"),
        rounded(fx.momentum("close", 12)).alias("momentum_12"),
    )
