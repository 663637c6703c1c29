"""Panel shaping and session state."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkite.catalog.registry import query, r, rounded
from panelkite.catalog.tables import BARS, CALENDAR, PANEL, SYMBOLS, WEEKLY, with_
from panelkite.operators import panel as pn
from panelkite.operators import signals as sg
from panelkite.plans import testbed as tb

BY = "(PARTITION BY symbol_id ORDER BY ts)"
CUM = "(PARTITION BY symbol_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    "bars_from_lineitem",
    with_(BARS)
    + """SELECT symbol_id, ts, open, high, low, close, volume, amount, traded, available_utc FROM bars""",
)
def bars_from_lineitem(spark, sf_dir):
    return tb.bars_daily(spark, sf_dir).select(
        "symbol_id", "ts", "open", "high", "low", "close", "volume", "amount", "traded", "available_utc"
    )


@query(
    "densify_panel",
    with_(PANEL) + "SELECT symbol_id, ts, CAST(idx AS BIGINT) AS idx, traded, close, volume FROM panel",
)
def densify_panel(spark, sf_dir):
    return pn.densify(tb.bars_daily(spark, sf_dir), ("close", "volume")).select(
        "symbol_id", "ts", F.col("idx").cast("long").alias("idx"), "traded", "close", "volume"
    )


@query("session_index", with_(PANEL) + "SELECT CAST(idx AS BIGINT) AS idx, ts FROM sess")
def session_index(spark, sf_dir):
    return pn.session_index(tb.bars_daily(spark, sf_dir)).select(
        F.col("idx").cast("long").alias("idx"), "ts"
    )


@query(
    "densify_wide_universe",
    with_(WEEKLY)
    + """SELECT symbol_id, count(*) AS cells, count(close) AS quoted,
       CAST(sum(CASE WHEN traded THEN 1 ELSE 0 END) AS BIGINT) AS traded FROM panel GROUP BY symbol_id""",
)
def densify_wide_universe(spark, sf_dir):
    return pn.densify(tb.bars_weekly(spark, sf_dir)).groupBy("symbol_id").agg(
        F.count("*").alias("cells"), F.count("close").alias("quoted"), F.count_if("traded").alias("traded")
    )


@query(
    "pivot_wide",
    with_(BARS)
    + "SELECT ts, symbol_id // 8 AS page, "
    + ", ".join(f"{r(f'avg(close) FILTER (WHERE symbol_id % 8 = {i})', 4)} AS s{i}" for i in range(8))
    + " FROM bars GROUP BY ts, symbol_id // 8",
)
def pivot_wide(spark, sf_dir):
    """All symbols, eight to a page."""
    paged = tb.bars_daily(spark, sf_dir).withColumns(
        {"page": F.floor(F.col("symbol_id") / 8), "place": F.col("symbol_id") % 8}
    )
    wide = pn.to_wide(paged, range(8), rows=("ts", "page"), columns="place")
    return wide.select("ts", "page", *[rounded(F.col(f"`{i}`"), 4).alias(f"s{i}") for i in range(8)])


@query(
    "pivot_long",
    with_(BARS)
    + f"""SELECT ts, symbol_id, {r('avg(close)', 4)} AS close FROM bars GROUP BY ts, symbol_id""",
)
def pivot_long(spark, sf_dir):
    """Every cell of the date x symbol layout; `pivot_wide` exports them in pages of eight symbols."""
    return pn.cells(tb.bars_daily(spark, sf_dir)).withColumn("close", rounded("close", 4))


STATUS = """
span AS (SELECT symbol_id, min(ts) AS a, max(ts) AS b FROM bars GROUP BY symbol_id),
days AS (SELECT s.symbol_id, s.exchange, unnest(generate_series(p.a, p.b, INTERVAL 1 DAY))::DATE AS ts
         FROM span p JOIN symbols s USING (symbol_id)),
status AS (SELECT d.symbol_id, d.ts, CASE WHEN b.traded THEN 'traded' WHEN NOT b.traded THEN 'halted'
         WHEN c.is_open THEN 'missing' ELSE 'closed' END AS status
  FROM days d LEFT JOIN bars b ON b.symbol_id = d.symbol_id AND b.ts = d.ts
  LEFT JOIN calendar c ON c.exchange = d.exchange AND c.ts = d.ts)"""


@query(
    "session_status",
    with_(BARS, SYMBOLS, CALENDAR, STATUS) + "SELECT symbol_id, ts, status FROM status",
)
def session_status(spark, sf_dir):
    return pn.session_status(
        tb.bars_daily(spark, sf_dir), tb.symbols(spark, sf_dir), tb.trading_calendar(spark, sf_dir)
    )


STUDY = ("1996-01-01", "2001-06-30")
EXPECTED = f"""expected AS (
  SELECT s.symbol_id, c.ts FROM symbols s JOIN calendar c ON c.exchange = s.exchange AND c.is_open
  WHERE c.ts >= greatest(coalesce(s.listed_on, DATE '{STUDY[0]}'), DATE '{STUDY[0]}')
    AND c.ts <= least(coalesce(s.delisted_on, DATE '{STUDY[1]}'), DATE '{STUDY[1]}'))"""


@query(
    "unobserved_sessions",
    with_(BARS, SYMBOLS, CALENDAR, EXPECTED)
    + """SELECT symbol_id, ts FROM expected e
       WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol_id = e.symbol_id AND b.ts = e.ts)""",
)
def unobserved_sessions(spark, sf_dir):
    return pn.unobserved_sessions(
        tb.bars_daily(spark, sf_dir),
        tb.symbols(spark, sf_dir),
        tb.trading_calendar(spark, sf_dir),
        *STUDY,
    )


@query(
    "gap_classes",
    with_(BARS, SYMBOLS, CALENDAR, EXPECTED)
    + f"""SELECT s.symbol_id, coalesce(e.n, 0) AS expected, coalesce(a.n, 0) AS actual,
       CASE WHEN listed_on IS NULL THEN 'no_listing_date'
            WHEN listed_on > DATE '{STUDY[1]}' THEN 'listed_after_window'
            WHEN delisted_on < DATE '{STUDY[0]}' THEN 'delisted_before_window'
            WHEN coalesce(e.n, 0) > coalesce(a.n, 0) THEN 'gap'
            WHEN coalesce(e.n, 0) < coalesce(a.n, 0) THEN 'surplus' ELSE 'complete' END AS gap_class
       FROM symbols s
       LEFT JOIN (SELECT symbol_id, count(*) AS n FROM expected GROUP BY 1) e USING (symbol_id)
       LEFT JOIN (SELECT symbol_id, count(*) AS n FROM bars
                  WHERE ts BETWEEN DATE '{STUDY[0]}' AND DATE '{STUDY[1]}' GROUP BY 1) a USING (symbol_id)""",
)
def gap_classes(spark, sf_dir):
    return pn.session_reconciliation(
        tb.bars_daily(spark, sf_dir),
        tb.symbols(spark, sf_dir),
        tb.trading_calendar(spark, sf_dir),
        *STUDY,
    )


@query(
    "carry_forward",
    with_(PANEL)
    + f"""SELECT symbol_id, ts, last_value(close IGNORE NULLS) OVER {CUM} AS close_ff,
       last_value(open IGNORE NULLS) OVER {CUM} AS open_ff FROM panel""",
)
def carry_forward(spark, sf_dir):
    return pn.densify(tb.bars_daily(spark, sf_dir), ("open", "close")).select(
        "symbol_id",
        "ts",
        pn.carry_forward("close").alias("close_ff"),
        pn.carry_forward("open").alias("open_ff"),
    )


@query(
    "freshness_warmup",
    with_(PANEL)
    + f"""SELECT symbol_id, ts, coalesce(idx - max(CASE WHEN close IS NOT NULL AND traded THEN idx END)
       OVER {CUM} <= 2, false) AS fresh, idx >= 63 AS warm FROM panel""",
)
def freshness_warmup(spark, sf_dir):
    valid = F.col("close").isNotNull() & F.col("traded")
    return pn.densify(tb.bars_daily(spark, sf_dir)).select(
        "symbol_id", "ts", pn.is_fresh(valid, 2).alias("fresh"), pn.is_warm(63).alias("warm")
    )


@query(
    "carried_halts",
    with_(
        PANEL,
        f"""l AS (SELECT *, last_value(CASE WHEN traded THEN close END IGNORE NULLS) OVER {CUM} AS lc
             FROM panel)""",
    )
    + "SELECT symbol_id, ts, traded, "
    + ", ".join(
        f"CASE WHEN traded THEN {c} ELSE coalesce(lc, {c}) END AS {c}"
        for c in ("open", "high", "low", "close")
    )
    + ", CASE WHEN traded THEN volume ELSE 0 END AS volume FROM l",
)
def carried_halts(spark, sf_dir):
    columns = ("open", "high", "low", "close", "volume")
    return pn.carried_halts(pn.densify(tb.bars_daily(spark, sf_dir), columns))


@query(
    "tradable_default",
    with_(BARS) + "SELECT symbol_id, count(*) AS tradable FROM bars GROUP BY symbol_id",
)
def tradable_default(spark, sf_dir):
    bare = tb.bars_daily(spark, sf_dir).drop("traded")
    return bare.groupBy("symbol_id").agg(F.count_if(pn.tradable(bare)).alias("tradable"))


@query(
    "halted_sessions",
    with_(
        PANEL,
        "reb AS (SELECT min(ts) AS ts FROM sess GROUP BY date_trunc('week', ts - INTERVAL 1 DAY))",
    )
    + """SELECT count(*) AS halted_sessions FROM (
       SELECT ts FROM panel WHERE ts BETWEEN (SELECT min(ts) FROM reb) AND (SELECT max(ts) FROM reb)
       GROUP BY ts HAVING bool_or(NOT traded))""",
)
def halted_sessions(spark, sf_dir):
    bars = tb.bars_daily(spark, sf_dir)
    dates = sg.rebalance_dates(pn.session_index(bars))
    return pn.halted_session_count(pn.densify(bars), dates)
