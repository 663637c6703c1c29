"""Fills, portfolio curves, costs and screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkite.catalog.registry import query, r, rounded
from panelkite.catalog.signals import MOMENTUM_SQL, momentum_weights
from panelkite.catalog.tables import BARS, CURVES_TYPE, MIX, PANEL, SYMBOLS, with_
from panelkite.operators import metrics as mt
from panelkite.operators import panel as pn
from panelkite.operators import portfolio as pf
from panelkite.operators import signals as sg
from panelkite.plans import testbed as tb


def fills_sql(price: str) -> str:
    return f"""
nextd AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nxt FROM reb),
cand AS (SELECT w.ts, w.symbol_id, w.weight, d.idx,
    (SELECT min(p.ts) FROM panel p WHERE p.symbol_id = w.symbol_id AND p.ts > w.ts
       AND (n.nxt IS NULL OR p.ts <= n.nxt) AND p.traded AND p.{price} > 0) AS fill_ts
  FROM weights w JOIN nextd n ON n.ts = w.ts JOIN sess d ON d.ts = w.ts),
fills AS MATERIALIZED (SELECT c.ts, c.symbol_id, c.weight, c.fill_ts, p.{price} AS fill_price,
    CAST(p.idx - c.idx AS BIGINT) AS wait,
    CASE WHEN c.fill_ts IS NULL THEN 'unfilled' WHEN p.idx - c.idx > 1 THEN 'deferred'
         ELSE 'next_session' END AS outcome
  FROM cand c LEFT JOIN panel p ON p.symbol_id = c.symbol_id AND p.ts = c.fill_ts)"""


def fills(spark, sf_dir, fill_at="open"):
    bars = tb.bars_daily(spark, sf_dir)
    panel = pn.densify(bars, ("open", "close"))
    return pf.fill_resolution(panel, momentum_weights(bars), fill_at)


FILL_COLUMNS = "ts, symbol_id, fill_ts, fill_price, wait, outcome"


@query(
    "fill_resolution",
    with_(PANEL, MOMENTUM_SQL, fills_sql("open"))
    + f"SELECT {FILL_COLUMNS}, {r('weight')} AS weight FROM fills",
)
def fill_resolution(spark, sf_dir):
    return fills(spark, sf_dir).withColumn("weight", rounded("weight"))


@query(
    "fill_at_close",
    with_(PANEL, MOMENTUM_SQL, fills_sql("close"))
    + f"SELECT {FILL_COLUMNS}, {r('weight')} AS weight FROM fills",
)
def fill_at_close(spark, sf_dir):
    return fills(spark, sf_dir, "close").withColumn("weight", rounded("weight"))


@query(
    "unfilled_orders",
    with_(PANEL, MOMENTUM_SQL, fills_sql("open"))
    + "SELECT ts, symbol_id, wait, outcome FROM fills WHERE outcome <> 'next_session'",
)
def unfilled_orders(spark, sf_dir):
    return pf.unfilled_orders(fills(spark, sf_dir)).select("ts", "symbol_id", "wait", "outcome")


@query(
    "compose_nav",
    with_(CURVES_TYPE, MIX) + f"SELECT run_id, ts, {r('equity')} AS equity FROM nav",
)
def compose_nav(spark, sf_dir):
    nav = pf.compose(tb.mix_curves(spark, sf_dir), tb.mix_weights(spark, sf_dir))
    return nav.select("run_id", "ts", rounded("equity").alias("equity"))


@query(
    "weights_used",
    with_(
        CURVES_TYPE,
        MIX,
        """v AS (SELECT *, w * coalesce(lag(g) OVER (PARTITION BY run_id, name, seg ORDER BY ts), 1) AS v
             FROM grown)""",
    )
    + f"""SELECT run_id, ts, name,
       {r('v / nullif(1 + sum(v - w) OVER (PARTITION BY run_id, ts), 0)')} AS weight FROM v""",
)
def weights_used(spark, sf_dir):
    used = pf.weights_used(tb.mix_curves(spark, sf_dir), tb.mix_weights(spark, sf_dir))
    return used.select("run_id", "ts", "name", rounded("weight").alias("weight"))


@query(
    "over_invested",
    with_(CURVES_TYPE, MIX)
    + f"""SELECT run_id, ts, {r('sum(abs(weight)) * 1.2')} AS gross FROM mixw GROUP BY 1, 2
       HAVING sum(abs(weight)) * 1.2 > 1 + 1e-9""",
)
def over_invested(spark, sf_dir):
    levered = tb.mix_weights(spark, sf_dir).withColumn("weight", F.col("weight") * 1.2)
    return pf.over_invested(levered).select("run_id", "ts", rounded("gross").alias("gross"))


@query(
    "cost_scenarios",
    with_(
        CURVES_TYPE,
        MIX,
        """chg AS (SELECT run_id, ts, sum(abs(coalesce(weight - prev, 0))) AS traded FROM (
  SELECT *, lag(weight) OVER (PARTITION BY run_id, name ORDER BY ts) AS prev FROM mixw) GROUP BY 1, 2)""",
        """gr AS (SELECT n.run_id, n.ts, coalesce(c.traded, 0) AS traded,
  n.equity / lag(n.equity) OVER (PARTITION BY n.run_id ORDER BY n.ts) - 1 AS gross
  FROM nav n LEFT JOIN chg c ON c.run_id = n.run_id AND c.ts = n.ts)""",
    )
    + f"""SELECT run_id, ts, bps, {r('traded')} AS traded, {r('gross')} AS gross,
       {r('(1 - bps / 1e4 * traded) * (1 + gross) - 1')} AS net
       FROM gr CROSS JOIN (SELECT unnest([0.0, 10.0, 30.0])::DOUBLE AS bps)""",
)
def cost_scenarios(spark, sf_dir):
    weights = tb.mix_weights(spark, sf_dir)
    nav = mt.with_returns(pf.compose(tb.mix_curves(spark, sf_dir), weights))
    traded = mt.weight_changes(weights, name="name")
    returns = nav.join(traded, ["run_id", "ts"], "left").select(
        "run_id",
        "ts",
        F.col("ret").alias("gross"),
        F.coalesce("change", F.lit(0.0)).alias("traded"),
    )
    return pf.cost_scenarios(returns).select(
        "run_id",
        "ts",
        "bps",
        *[rounded(c).alias(c) for c in ("traded", "gross", "net")],
    )


GRID_SQL = f"""ms AS MATERIALIZED (SELECT symbol_id, ts, close, """ + ", ".join(
    f"CASE WHEN count(close) OVER w{n} = {n} THEN avg(close) OVER w{n} END AS m{n}"
    for n in (5, 10, 20, 30, 60)
) + " FROM bars WINDOW " + ", ".join(
    f"w{n} AS (PARTITION BY symbol_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    for n in (5, 10, 20, 30, 60)
) + "),\npairs AS (" + " UNION ALL ".join(
    f"SELECT symbol_id, ts, close, {a} AS fast, {b} AS slow, coalesce(m{a} > m{b}, false) AS above FROM ms"
    for a in (5, 10, 20)
    for b in (30, 60)
) + """),
held AS (SELECT *, coalesce(lag(above) OVER p, false) AS was, close / lag(close) OVER p - 1 AS ret
  FROM pairs WINDOW p AS (PARTITION BY symbol_id, fast, slow ORDER BY ts)),
navs AS (SELECT *, product(1 + CASE WHEN was THEN coalesce(ret, 0) ELSE 0 END) OVER p AS nav
  FROM held WINDOW p AS (PARTITION BY symbol_id, fast, slow ORDER BY ts)),
dds AS (SELECT *, nav / max(nav) OVER (PARTITION BY symbol_id, fast, slow ORDER BY ts) - 1 AS dd FROM navs)"""


@query(
    "sma_grid_screen",
    with_(BARS, GRID_SQL)
    + f"""SELECT symbol_id, CAST(fast AS BIGINT) AS fast, CAST(slow AS BIGINT) AS slow,
       {r('arg_max(nav, ts) - 1')} AS total_return,
       count(*) FILTER (WHERE above AND NOT was) AS n_trades, {r('min(dd)')} AS max_drawdown
       FROM dds GROUP BY ALL HAVING count(*) FILTER (WHERE above AND NOT was) > 0""",
)
def sma_grid_screen(spark, sf_dir):
    return pf.sma_grid_screen(tb.bars_daily(spark, sf_dir)).select(
        "symbol_id",
        F.col("fast").cast("long").alias("fast"),
        F.col("slow").cast("long").alias("slow"),
        rounded("total_return").alias("total_return"),
        "n_trades",
        rounded("max_drawdown").alias("max_drawdown"),
    )


@query(
    "curve_deviation",
    with_(BARS)
    + f"""SELECT symbol_id, count(*) AS common, {r('max(abs(close / open - 1))')} AS max_rel_dev
       FROM bars GROUP BY symbol_id""",
)
def curve_deviation(spark, sf_dir):
    bars = tb.bars_daily(spark, sf_dir)
    a = bars.select("symbol_id", "ts", F.col("close").alias("equity"))
    b = bars.select("symbol_id", "ts", F.col("open").alias("equity"))
    return pf.curve_deviation(a, b, "symbol_id").withColumn("max_rel_dev", rounded("max_rel_dev"))


EQUAL = """reb AS (SELECT min(ts) AS ts FROM sess GROUP BY date_trunc('week', ts - INTERVAL 1 DAY)),
eq AS (SELECT ts, symbol_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY ts) AS weight
  FROM panel WHERE ts IN (SELECT ts FROM reb) AND traded AND close IS NOT NULL)"""


def benchmark(spark, sf_dir):
    bars = tb.bars_daily(spark, sf_dir)
    return pf.equal_weights(bars, sg.rebalance_dates(pn.session_index(bars)))


@query(
    "equal_weight_benchmark",
    with_(PANEL, EQUAL) + f"SELECT ts, symbol_id, {r('weight')} AS weight FROM eq",
)
def equal_weight_benchmark(spark, sf_dir):
    return benchmark(spark, sf_dir).select("ts", "symbol_id", rounded("weight").alias("weight"))


@query(
    "exposure_by_exchange",
    with_(PANEL, SYMBOLS, EQUAL)
    + f"""SELECT ts, exchange, {r('sum(weight)')} AS weight
       FROM eq JOIN symbols USING (symbol_id) GROUP BY ts, exchange""",
)
def exposure_by_exchange(spark, sf_dir):
    out = pf.exposure(benchmark(spark, sf_dir), tb.symbols(spark, sf_dir), "exchange")
    return out.select("ts", "exchange", rounded("weight").alias("weight"))
