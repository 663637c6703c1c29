"""Signals, states and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkite.catalog.factors import CROSS, daily
from panelkite.catalog.registry import query, r, rounded
from panelkite.catalog.tables import BARS, PANEL, SYMBOLS, WEEKLY, with_
from panelkite.functions import factors as fx
from panelkite.operators import holdings as hd
from panelkite.operators import panel as pn
from panelkite.operators import signals as sg
from panelkite.plans import testbed as tb
from panelkite.session import settle

BY = "(PARTITION BY symbol_id ORDER BY ts)"
CUM = "(PARTITION BY symbol_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

SIGNAL = f"""sig AS (SELECT *, CASE WHEN idx >= 20 AND traded THEN
    CASE WHEN down THEN -1 WHEN up THEN 1 ELSE 0 END END AS signal FROM c),
st AS (SELECT *, CASE WHEN last_value(CASE WHEN signal IN (1, -1) THEN signal END IGNORE NULLS)
    OVER {CUM} = 1 THEN 1 ELSE 0 END AS state FROM sig)"""


def crossing():
    fast, slow = rounded(fx.sma("close", 5), 4), rounded(fx.sma("close", 20), 4)
    return fx.cross_above(fast, slow), fx.cross_below(fast, slow)


@query(
    "emit_signals",
    with_(PANEL, CROSS, SIGNAL) + "SELECT symbol_id, ts, CAST(signal AS BIGINT) AS signal FROM sig",
)
def emit_signals(spark, sf_dir):
    up, down = crossing()
    return daily(spark, sf_dir).select(
        "symbol_id", "ts", sg.signal(up, down, 20).cast("long").alias("signal")
    )


@query(
    "position_state",
    with_(PANEL, CROSS, SIGNAL) + "SELECT symbol_id, ts, CAST(state AS BIGINT) AS state FROM st",
)
def position_state(spark, sf_dir):
    up, down = crossing()
    return daily(spark, sf_dir).select(
        "symbol_id", "ts", sg.position_state(sg.signal(up, down, 20)).cast("long").alias("state")
    )


@query(
    "rebalance_dates",
    with_(PANEL)
    + """SELECT 'W-MON' AS rule, min(ts) AS ts FROM sess GROUP BY date_trunc('week', ts - INTERVAL 1 DAY)
       UNION ALL SELECT 'W-FRI', min(ts) FROM sess GROUP BY date_trunc('week', ts - INTERVAL 5 DAY)
       UNION ALL SELECT 'M', min(ts) FROM sess GROUP BY date_trunc('month', ts)
       UNION ALL SELECT 'Q', min(ts) FROM sess GROUP BY date_trunc('quarter', ts)""",
)
def rebalance_dates(spark, sf_dir):
    sessions = pn.session_index(tb.bars_daily(spark, sf_dir))
    parts = [
        sg.rebalance_dates(sessions, rule).select(F.lit(rule).alias("rule"), "ts")
        for rule in ("W-MON", "W-FRI", "M", "Q")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Starts of periods in SQL: the rule, and what its dates are grouped by.
PERIODS = {
    "B": "ts + CASE isodow(ts) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END::INTEGER",
    "2W": "date_trunc('week', ts - INTERVAL 7 DAY)",
    "3W-WED": "date_trunc('week', ts - INTERVAL 3 DAY)",
    "3M": "date_trunc('month', ts)",
    "Q-NOV": "date_trunc('quarter', ts + INTERVAL 1 MONTH)",
    "2Q-JAN": "date_trunc('quarter', ts - INTERVAL 1 MONTH)",
    "Y-JUN": "year(ts) + (month(ts) > 6)::INTEGER",
}


@query(
    "rebalance_rules",
    with_(PANEL)
    + " UNION ALL ".join(f"SELECT '{k}' AS rule, min(ts) AS ts FROM sess GROUP BY {v}" for k, v in PERIODS.items()),
)
def rebalance_rules(spark, sf_dir):
    """Business days, multiples and anchored periods, from one pass over the sessions."""
    sessions = pn.session_index(tb.bars_daily(spark, sf_dir)).select("ts")
    keys = F.array(*(F.struct(F.lit(k).alias("rule"), sg.period_key("ts", k).alias("period")) for k in PERIODS))
    by_rule = sessions.select("ts", F.explode(keys).alias("k"))
    return by_rule.groupBy("k.rule", "k.period").agg(F.min("ts").alias("ts")).select("rule", "ts")


def weights_sql(score: str, allowance: int, held: str, top_n: int, floor: float, source: str) -> str:
    """CTEs ending in `weights` (ts, symbol_id, weight)."""
    return f"""
reb AS MATERIALIZED (SELECT min(ts) AS ts FROM sess GROUP BY date_trunc('week', ts - INTERVAL 1 DAY)),
scored AS MATERIALIZED (SELECT *, {score} AS score, {held} AS held, coalesce(idx - max(CASE WHEN close IS NOT NULL
    AND traded THEN idx END) OVER {CUM} <= {allowance}, false) AS fresh FROM {source}),
chosen AS MATERIALIZED (SELECT * FROM (
    SELECT ts, symbol_id, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol_id) AS n
    FROM scored WHERE ts IN (SELECT ts FROM reb) AND traded AND score IS NOT NULL AND fresh AND held = 1)
  WHERE n <= {top_n}),
weights AS MATERIALIZED (SELECT g.ts, g.symbol_id,
    coalesce({1.0 - floor}::DOUBLE / count(c.symbol_id) OVER (PARTITION BY g.ts)
             * CASE WHEN c.symbol_id IS NOT NULL THEN 1 END, 0.0) AS weight
  FROM (SELECT ts, symbol_id FROM scored WHERE ts IN (SELECT ts FROM reb)) g
  LEFT JOIN chosen c ON c.ts = g.ts AND c.symbol_id = g.symbol_id)"""


MOM63 = f"close / nullif(lag(close, 63) OVER {BY}, 0) - 1"


def momentum_weights(bars):
    return sg.target_weights(pn.densify(bars), pn.session_index(bars), bars)


MOMENTUM_SQL = weights_sql(MOM63, 63, "1", 3, 0.0, "panel")


@query(
    "weekly_top3_weights",
    with_(PANEL, MOMENTUM_SQL) + f"SELECT ts, symbol_id, {r('weight')} AS weight FROM weights",
)
def weekly_top3_weights(spark, sf_dir):
    return momentum_weights(tb.bars_daily(spark, sf_dir)).select("ts", "symbol_id", rounded("weight").alias("weight"))


CROSS_SQL = weights_sql(MOM63, 63, "state", 3, 0.1, "st")


def cross_holdings(spark, sf_dir):
    bars = tb.bars_daily(spark, sf_dir)
    up, down = crossing()
    return sg.target_holdings(
        pn.densify(bars), pn.session_index(bars), entry=up, exit_=down, lookback=20, cash_floor=0.1
    )


def cross_weights(spark, sf_dir):
    return hd.export(cross_holdings(spark, sf_dir), tb.bars_daily(spark, sf_dir))


@query(
    "ma_cross_weights",
    with_(PANEL, CROSS, SIGNAL, CROSS_SQL) + f"SELECT ts, symbol_id, {r('weight')} AS weight FROM weights",
)
def ma_cross_weights(spark, sf_dir):
    return cross_weights(spark, sf_dir).select("ts", "symbol_id", rounded("weight").alias("weight"))


@query(
    "ranked_universe_weights",
    with_(
        WEEKLY,
        weights_sql(r(f"close / nullif(lag(close, 12) OVER {BY}, 0) - 1"), 12, "1", 20, 0.0, "panel"),
    )
    + f"SELECT ts, symbol_id, {r('weight')} AS weight FROM weights WHERE weight > 0",
)
def ranked_universe_weights(spark, sf_dir):
    bars = settle(tb.bars_weekly(spark, sf_dir), "bars-weekly")
    tasks = pn.panel_tasks(bars)
    weights = sg.target_weights(
        pn.densify(bars, tasks=tasks),
        pn.session_index(bars),
        bars,
        score=rounded(fx.momentum("close", 12)),
        lookback=12,
        top_n=20,
        tasks=tasks,
    )
    return weights.where("weight > 0").select("ts", "symbol_id", rounded("weight").alias("weight"))


EVENTS_SQL = f"""moved AS (SELECT ts FROM (
    SELECT ts, coalesce(weight <> lag(weight) OVER {BY}, true) AS m FROM weights)
  GROUP BY ts HAVING bool_or(m)),
ev AS MATERIALIZED (SELECT * FROM weights WHERE ts IN (SELECT ts FROM moved))"""


@query(
    "event_panel",
    with_(PANEL, CROSS, SIGNAL, CROSS_SQL, EVENTS_SQL)
    + f"SELECT ts, symbol_id, {r('weight')} AS weight FROM ev",
)
def event_panel(spark, sf_dir):
    moved = hd.events(hd.settled(cross_holdings(spark, sf_dir)))
    return hd.export(moved, tb.bars_daily(spark, sf_dir)).select(
        "ts", "symbol_id", rounded("weight").alias("weight")
    )


@query(
    "episode",
    with_(
        PANEL,
        CROSS,
        SIGNAL,
        CROSS_SQL,
        """full_weights AS (SELECT ts, symbol_id, CASE WHEN month(ts) % 2 = 1 THEN weight ELSE 0.0 END AS weight
             FROM weights)""",
        EVENTS_SQL.replace("FROM weights", "FROM full_weights"),
        "tot AS (SELECT ts, sum(weight) AS t FROM ev GROUP BY ts)",
        "st0 AS (SELECT min(ts) AS a FROM tot WHERE t > 0)",
        "st1 AS (SELECT min(ts) AS b FROM tot, st0 WHERE t = 0 AND ts > a)",
    )
    + f"SELECT ts, symbol_id, {r('weight')} AS weight FROM ev, st0, st1 WHERE ts BETWEEN a AND b",
)
def episode(spark, sf_dir):
    # invested only in every second month, in cash otherwise
    odd = F.month("ts") % 2 == 1
    found = hd.settled(cross_holdings(spark, sf_dir))
    moved = hd.events(hd.Holdings(found.dates, found.held.where(odd)))
    return hd.export(hd.first_episode(moved), tb.bars_daily(spark, sf_dir)).select(
        "ts", "symbol_id", rounded("weight").alias("weight")
    )


@query(
    "weight_intervals",
    with_(
        PANEL,
        CROSS,
        SIGNAL,
        CROSS_SQL,
        "nth AS (SELECT ts, row_number() OVER (ORDER BY ts) AS n, lead(ts) OVER (ORDER BY ts) AS nxt FROM reb)",
        """runs AS (SELECT symbol_id, weight, ts, n, nxt,
             n - row_number() OVER (PARTITION BY symbol_id, weight ORDER BY n) AS run
             FROM weights JOIN nth USING (ts) WHERE weight <> 0)""",
    )
    + f"""SELECT symbol_id, {r('weight')} AS weight, min(ts) AS from_ts, arg_max_null(nxt, n) AS to_ts
       FROM runs GROUP BY symbol_id, runs.weight, run""",
)
def weight_intervals(spark, sf_dir):
    found = hd.intervals(hd.settled(cross_holdings(spark, sf_dir)))
    return found.withColumn("weight", rounded("weight"))


@query(
    "weight_events",
    with_(PANEL, CROSS, SIGNAL, CROSS_SQL, EVENTS_SQL)
    + f"""SELECT ts, count(*) FILTER (weight <> 0) AS names, {r('sum(weight)')} AS invested FROM ev GROUP BY ts""",
)
def weight_events(spark, sf_dir):
    """Event dates without the symbol grid: what is held on them, dates in cash included."""
    moved = hd.events(hd.settled(cross_holdings(spark, sf_dir)))
    held = moved.held.groupBy("ts").agg(F.count("*").alias("names"), F.sum("weight").alias("invested"))
    return moved.dates.join(held, "ts", "left").na.fill(0).withColumn("invested", rounded("invested"))


@query(
    "universe_filter",
    with_(PANEL, SYMBOLS)
    + """SELECT symbol_id, ts, close FROM panel
       WHERE symbol_id IN (SELECT symbol_id FROM symbols WHERE exchange = 'X1')""",
)
def universe_filter(spark, sf_dir):
    chosen = tb.symbols(spark, sf_dir).where("exchange = 'X1'")
    return sg.in_universe(daily(spark, sf_dir), chosen).select("symbol_id", "ts", "close")


@query(
    "universe_unknown",
    with_(BARS)
    + """SELECT c_custkey AS symbol_id FROM customer WHERE c_custkey NOT IN (SELECT symbol_id FROM bars)""",
)
def universe_unknown(spark, sf_dir):
    chosen = tb.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol_id"))
    return sg.unknown_universe(chosen, tb.bars_daily(spark, sf_dir))
