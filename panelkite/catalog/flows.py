"""Whole flows: a strategy run and an ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkite.catalog.metrics import CURVE_SQL
from panelkite.catalog.registry import query, r, rounded
from panelkite.catalog.signals import BY, CUM, MOMENTUM_SQL, weights_sql
from panelkite.catalog.tables import BARS, FX, PANEL, WEEKLY, with_
from panelkite.functions import rules as rl
from panelkite.plans import testbed as tb
from panelkite.plans.ingest import ingest, status_of
from panelkite.plans.strategy import run_strategy
from panelkite.session import scratch_dir

NAV = """
eff AS (SELECT (SELECT min(s.ts) FROM sess s WHERE s.ts > w.ts) AS ts, symbol_id, weight FROM weights w),
ff AS (SELECT symbol_id, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol_id ORDER BY ts) AS px FROM panel),
rr AS (SELECT symbol_id, ts, coalesce(px / lag(px) OVER (PARTITION BY symbol_id ORDER BY ts) - 1, 0) AS r FROM ff),
cl AS (SELECT rr.*, e.weight, count(e.ts) OVER (PARTITION BY rr.symbol_id ORDER BY rr.ts) AS seg
  FROM rr LEFT JOIN eff e ON e.symbol_id = rr.symbol_id AND e.ts = rr.ts),
gr AS (SELECT *, coalesce(first_value(weight) OVER s, 0) AS w, product(1 + r) OVER s AS g
  FROM cl WINDOW s AS (PARTITION BY symbol_id, seg ORDER BY ts)),
nd AS (SELECT seg, ts, 1 + sum(w * (g - 1)) AS f FROM gr GROUP BY 1, 2),
nb AS (SELECT seg, coalesce(product(e) OVER (ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS b
  FROM (SELECT seg, arg_max(f, ts) AS e FROM nd GROUP BY 1)),
curves AS MATERIALIZED (SELECT 'run' AS run_id, ts, f * b AS equity FROM nd JOIN nb USING (seg))"""


@query(
    "strategy_equity",
    with_(PANEL, MOMENTUM_SQL, NAV) + f"SELECT run_id, ts, {r('ln(equity)')} AS log_equity FROM curves",
)
def strategy_equity(spark, sf_dir):
    out = run_strategy(tb.bars_daily(spark, sf_dir), window=63)
    return out["equity"].select("run_id", "ts", rounded(F.ln("equity")).alias("log_equity"))


TRADED = """
moves AS (SELECT ts, sum(abs(coalesce(weight - prev, 0))) AS change FROM (
  SELECT *, lag(weight) OVER (PARTITION BY symbol_id ORDER BY ts) AS prev FROM weights) GROUP BY ts)"""


@query(
    "strategy_metrics",
    with_(PANEL, MOMENTUM_SQL, NAV, TRADED, CURVE_SQL)
    + f"""SELECT run_id, {r('asinh(ratio - 1)')} AS total_return, {r('sd * sqrt(ppy)')} AS annualized_volatility,
       {r('mu / nullif(sd, 0) * sqrt(ppy)')} AS sharpe_ratio, {r('mdd')} AS max_drawdown,
       (SELECT {r('sum(change)')} FROM moves) AS turnover,
       (SELECT count(*) FROM moves WHERE change > 1e-12) AS n_rebalances FROM ann""",
)
def strategy_metrics(spark, sf_dir):
    row = run_strategy(tb.bars_daily(spark, sf_dir), window=63)["metrics"]
    same = ("annualized_volatility", "sharpe_ratio", "max_drawdown", "turnover")
    return row.select(
        "run_id",
        rounded(F.asinh("total_return")).alias("total_return"),
        *[rounded(c).alias(c) for c in same],
        "n_rebalances",
    )


@query(
    "strategy_net_equity",
    with_(
        PANEL,
        MOMENTUM_SQL,
        NAV,
        TRADED,
        """g AS (SELECT c.ts, coalesce(equity / lag(equity) OVER (ORDER BY c.ts) - 1, 0) AS gross, coalesce(m.change, 0) AS traded
             FROM curves c LEFT JOIN (SELECT (SELECT min(s.ts) FROM sess s WHERE s.ts > moves.ts) AS ts, change FROM moves) m
             ON m.ts = c.ts)""",
    )
    + f"""SELECT 'run' AS run_id, ts, {r('ln(product((1 - 0.001::DOUBLE * traded) * (1 + gross)) OVER (ORDER BY ts))')} AS log_equity
       FROM g""",
)
def strategy_net_equity(spark, sf_dir):
    out = run_strategy(tb.bars_daily(spark, sf_dir), window=63, bps=10.0)
    return out["equity"].select("run_id", "ts", rounded(F.ln("equity")).alias("log_equity"))


def ema_sql(n: int) -> str:
    """Columns of a recursion over the sessions: mean, decayed weight of the past, observations."""
    a, m, w, k = f"(2.0::DOUBLE / {n + 1})", f"m{n}", f"w{n}", f"k{n}"
    return f"""CASE WHEN p.close IS NULL THEN c.{m} WHEN c.{k} = 0 THEN p.close
       ELSE (c.{w} * (1 - {a}) * c.{m} + {a} * p.close) / (c.{w} * (1 - {a}) + {a}) END,
     CASE WHEN p.close IS NOT NULL THEN 1 ELSE c.{w} * (1 - {a}) END,
     c.{k} + CASE WHEN p.close IS NULL THEN 0 ELSE 1 END"""


def ema_start(n: int) -> str:
    seen = "CASE WHEN close IS NULL THEN 0 ELSE 1 END"
    return f"close AS m{n}, {seen}::DOUBLE AS w{n}, {seen} AS k{n}"


def state_sql(lookback: int, up: str, down: str, source: str) -> str:
    return f"""sig AS (SELECT *, CASE WHEN idx >= {lookback} AND traded THEN
    CASE WHEN {down} THEN -1 WHEN {up} THEN 1 ELSE 0 END END AS signal FROM {source}),
st AS MATERIALIZED (SELECT *, CASE WHEN last_value(CASE WHEN signal IN (1, -1) THEN signal END IGNORE NULLS)
    OVER {CUM} = 1 THEN 1 ELSE 0 END AS state FROM sig)"""


@query(
    "strategy_ema_cross",
    with_(
        PANEL,
        f"""rec AS (SELECT symbol_id, ts, idx, traded, close, {ema_start(12)}, {ema_start(26)} FROM panel WHERE idx = 0
  UNION ALL SELECT p.symbol_id, p.ts, p.idx, p.traded, p.close, {ema_sql(12)}, {ema_sql(26)}
  FROM rec c JOIN panel p ON p.symbol_id = c.symbol_id AND p.idx = c.idx + 1)""",
        f"""lines AS (SELECT symbol_id, ts, idx, traded, close, CASE WHEN k12 >= 12 THEN {r('m12', 4)} END AS fast,
             CASE WHEN k26 >= 26 THEN {r('m26', 4)} END AS slow FROM rec)""",
        f"""crossed AS (SELECT *, coalesce(fast > slow AND lag(fast) OVER {BY} <= lag(slow) OVER {BY}, false) AS up,
             coalesce(fast < slow AND lag(fast) OVER {BY} >= lag(slow) OVER {BY}, false) AS down FROM lines)""",
        state_sql(26, "up", "down", "crossed"),
        weights_sql(f"close / nullif(lag(close, 26) OVER {BY}, 0) - 1", 26, "state", 3, 0.0, "st"),
        NAV,
        recursive=True,
    )
    + f"SELECT ts, {r('ln(equity)')} AS log_equity FROM curves",
)
def strategy_ema_cross(spark, sf_dir):
    """In from a cross of two exponential means to the next one back; the look-back follows from the rules."""
    fast, slow = (rl.ema(rl.close(), n).map(lambda c: rounded(c, 4)) for n in (12, 26))
    out = run_strategy(
        tb.bars_daily(spark, sf_dir), entry=rl.cross_above(fast, slow), exit_=rl.cross_below(fast, slow)
    )
    return out["equity"].select("ts", rounded(F.ln("equity")).alias("log_equity"))


@query(
    "strategy_rank_rotation",
    with_(
        WEEKLY,
        f"""past AS (SELECT *, lag(close) OVER {BY} AS prev FROM panel)""",
        f"""moms AS (SELECT *, {r(f'prev / nullif(lag(prev, 12) OVER {BY}, 0) - 1', 3)} AS mom FROM past)""",
        """placed AS (SELECT *, CASE WHEN mom IS NOT NULL THEN rank() OVER (PARTITION BY ts, mom IS NULL ORDER BY mom)
             + (count(*) OVER (PARTITION BY ts, mom) - 1) / 2.0::DOUBLE END AS place FROM moms)""",
        state_sql(12, "true", "false", "placed"),
        weights_sql("place", 12, "state", 20, 0.0, "st"),
        NAV,
    )
    + f"SELECT ts, {r('ln(equity)')} AS log_equity FROM curves",
)
def strategy_rank_rotation(spark, sf_dir):
    """The 20 symbols of all suppliers that rank highest by momentum of the session before."""
    past = rl.momentum(rl.shift(rl.close()), 12).map(lambda c: rounded(c, 3))
    out = run_strategy(
        tb.bars_weekly(spark, sf_dir), entry=rl.const(1.0), score=rl.rank(past, ascending=True), top_n=20
    )
    return out["equity"].select("ts", rounded(F.ln("equity")).alias("log_equity"))


@query(
    "ingest_flow",
    with_(BARS, FX)
    + """SELECT 'bars_daily' AS dataset, 'ok' AS status, count(*) AS "rows", max(ts) AS watermark, 'exists' AS again FROM bars
       UNION ALL SELECT 'fx_rates', 'ok', count(*), max(ts), 'exists' FROM fx""",
)
def ingest_flow(spark, sf_dir):
    """Ingest twice; the second time the content is recognised."""
    root = scratch_dir(spark, "ingest")
    bars = tb.bars_daily(spark, sf_dir).withColumns(
        {"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")}
    )
    rates = tb.fx_rates(spark, sf_dir).withColumn("available_utc", F.date_add("ts", 1).cast("timestamp_ntz"))
    tables = {"bars_daily": bars, "fx_rates": rates}
    times = ("2024-02-01 00:00:00", "2024-02-01 00:05:00")
    ingest(tables, "vendor", root, *times)
    again = ingest(tables, "vendor", root, *times)
    ledger = spark.read.parquet(f"{root}/_ledger").select("snapshot_id", "dataset", "rows", "watermark")
    return (
        status_of(spark, root)
        .join(ledger, ["snapshot_id", "dataset"])
        .select("dataset", "status", "rows", "watermark", F.lit(again.status).alias("again"))
    )
