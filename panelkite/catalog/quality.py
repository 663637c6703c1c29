"""Quality rules, each over data in which it finds something."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkite.catalog.registry import query, r, rounded
from panelkite.catalog.signals import MOMENTUM_SQL, SIGNAL, crossing, momentum_weights
from panelkite.catalog.factors import CROSS, daily
from panelkite.catalog.tables import (
    ACTIONS,
    BARS,
    CALENDAR,
    FUND_FACTORS,
    FX,
    LEDGER,
    OLD_SNAPSHOT,
    PANEL,
    SNAPSHOT_BARS,
    SYMBOLS,
    with_,
)
from panelkite.functions import factors as fx
from panelkite.operators import cleaning as cl
from panelkite.operators import constraints as ct
from panelkite.operators import joins as jn
from panelkite.operators import quality as qc
from panelkite.operators import signals as sg
from panelkite.operators.panel import densify, panel_tasks
from panelkite.plans import testbed as tb
from panelkite.session import settle

KEY = ["symbol_id", "ts"]
BY = "(PARTITION BY symbol_id ORDER BY ts)"


def found_sql(check: str, source: str, key: str, count: str = "count(*)") -> str:
    """The result row of one rule; `source` holds the violations."""
    return f"""SELECT '{check}' AS "check", coalesce({count}, 0) = 0 AS ok,
       CAST(coalesce({count}, 0) AS BIGINT) AS violations,
       coalesce((SELECT string_agg(k, ';' ORDER BY k) FROM (
         SELECT {key} AS k FROM {source} ORDER BY k LIMIT 5)), '') AS samples
       FROM {source}"""


def shown(df):
    return df.select("check", "ok", "violations", F.array_join("samples", ";").alias("samples"))


DAY_KEY = "symbol_id || '|' || ts"


def after_payout(spark, sf_dir):
    """Bars after a payout of 100 per share, which leaves some prices below zero."""
    bars = tb.bars_daily(spark, sf_dir)
    return bars.withColumns({c: F.col(c) - 100.0 for c in qc.PRICES})


@query(
    "dq_positive_prices",
    with_(BARS, "bad AS (SELECT * FROM bars WHERE least(open, high, low, close) - 100.0 <= 0)")
    + found_sql("positive_prices", "bad", DAY_KEY),
)
def dq_positive_prices(spark, sf_dir):
    return shown(qc.finding("positive_prices", qc.non_positive_prices(after_payout(spark, sf_dir)), KEY))


@query(
    "dq_ohlc_relations",
    with_(
        BARS,
        "bad AS (SELECT * FROM bars WHERE low > least(open, close) OR high < greatest(open, close))",
    )
    + found_sql("ohlc_relations", "bad", DAY_KEY),
)
def dq_ohlc_relations(spark, sf_dir):
    return shown(qc.finding("ohlc_relations", qc.bad_ohlc(tb.bars_daily(spark, sf_dir)), KEY))


@query(
    "dq_unique_keys",
    with_(BARS, "bad AS (SELECT symbol_id, ts, count(*) AS n FROM items GROUP BY 1, 2 HAVING count(*) > 1)")
    + found_sql("unique_keys", "bad", DAY_KEY, "sum(n)"),
)
def dq_unique_keys(spark, sf_dir):
    return shown(qc.check_unique_keys(tb.trades(spark, sf_dir), KEY))


ORDER_SEQ = """bad AS (SELECT DISTINCT symbol_id FROM (
  SELECT o_custkey AS symbol_id, o_orderdate,
         lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders)
  WHERE prev > o_orderdate)"""


@query(
    "dq_sorted",
    "WITH " + ORDER_SEQ + "\n" + found_sql("sorted_by_ts", "bad", "symbol_id::VARCHAR"),
)
def dq_sorted(spark, sf_dir):
    arrivals = tb.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("symbol_id"), F.col("o_orderdate").alias("ts"), "o_orderkey"
    )
    bad = qc.unsorted_symbols(arrivals, "o_orderkey", block=1_000)
    return shown(qc.finding("sorted_by_ts", bad, ["symbol_id"]))


GAPS = """gaps AS (SELECT s.symbol_id, c.ts FROM symbols s
  JOIN (SELECT symbol_id, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1) p USING (symbol_id)
  JOIN calendar c ON c.exchange = s.exchange AND c.is_open AND c.ts BETWEEN a AND b
  WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol_id = s.symbol_id AND b.ts = c.ts))"""


@query(
    "dq_calendar_gaps",
    with_(BARS, SYMBOLS, CALENDAR, GAPS) + found_sql("calendar_gaps", "gaps", DAY_KEY),
)
def dq_calendar_gaps(spark, sf_dir):
    gaps = qc.calendar_gaps(
        tb.bars_daily(spark, sf_dir), tb.symbols(spark, sf_dir), tb.trading_calendar(spark, sf_dir)
    )
    return shown(qc.finding("calendar_gaps", gaps, KEY))


def jumps_sql(source: str, price: str, sigma: float) -> str:
    return f"""rets AS (SELECT symbol_id, ts, count(*) OVER (PARTITION BY symbol_id) AS n,
    ln({price}) - lag(ln({price})) OVER {BY} AS lr FROM {source}),
sig AS (SELECT *, CASE WHEN count(lr) OVER b >= 20 THEN stddev_samp(lr) OVER b END AS sd FROM rets
  WINDOW b AS (PARTITION BY symbol_id ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
jumps AS (SELECT * FROM sig WHERE n >= 62 AND sd > 0 AND abs(lr) > 0.15 AND abs(lr) > {sigma} * sd)"""


JUMP_COLUMNS = f"symbol_id, ts, {r('lr')} AS log_return, {r('sd')} AS rolling_sigma"


def jump_columns(df):
    return df.select(
        *KEY, rounded("log_return").alias("log_return"), rounded("rolling_sigma").alias("rolling_sigma")
    )


@query(
    "dq_price_jumps",
    with_(BARS, jumps_sql("bars", "close", 2.5)) + f"SELECT {JUMP_COLUMNS} FROM jumps",
)
def dq_price_jumps(spark, sf_dir):
    return jump_columns(qc.price_jumps(tb.bars_daily(spark, sf_dir), sigma=2.5))


@query(
    "dq_price_jumps_injected",
    with_(
        BARS,
        "inj AS (SELECT *, close * CASE WHEN day(ts) = 15 THEN exp(20) ELSE 1 END AS close_adj FROM bars)",
        jumps_sql("inj", "close_adj", 8.0),
    )
    + f"SELECT {JUMP_COLUMNS} FROM jumps",
)
def dq_price_jumps_injected(spark, sf_dir):
    scale = F.when(F.dayofmonth("ts") == 15, F.exp(F.lit(20))).otherwise(1.0)
    bars = tb.bars_daily(spark, sf_dir).withColumn("close_adj", F.col("close") * scale)
    return jump_columns(qc.price_jumps(bars))


@query(
    "dq_fx_staleness",
    with_(
        FX,
        "coarse AS (SELECT base, quote, ts, round(rate / 20) AS rate FROM fx0)",
        """runs AS (SELECT base, quote, rate, ts, sum(chg) OVER (PARTITION BY base ORDER BY ts) AS run FROM (
  SELECT *, CASE WHEN rate = lag(rate) OVER (PARTITION BY base ORDER BY ts) THEN 0 ELSE 1 END AS chg FROM coarse))""",
    )
    + """SELECT base, quote, max(n) AS longest_flat_run, max(n) > 2 AS stale FROM (
       SELECT base, quote, run, count(*) AS n FROM runs GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def dq_fx_staleness(spark, sf_dir):
    coarse = tb.fx_rates(spark, sf_dir, reverse=False).withColumn("rate", F.round(F.col("rate") / 20))
    stale = qc.stale_pairs(coarse, 2).select("base", "quote", F.lit(True).alias("stale"))
    return qc.flat_runs(coarse).join(stale, ["base", "quote"], "left").select(
        "base", "quote", "longest_flat_run", F.coalesce("stale", F.lit(False)).alias("stale")
    )


TWO_WAY = """two AS (SELECT base, quote, ts, CASE WHEN base = 'error' AND day(ts) = 9 THEN -rate ELSE rate END AS rate
  FROM fx0 UNION ALL
  SELECT quote, base, ts, CASE WHEN day(ts) % 3 = 0 THEN 1.01 ELSE 1.0 END / rate FROM fx0 WHERE base <> 'view')"""


def two_way(spark, sf_dir):
    fx0 = tb.fx_rates(spark, sf_dir, reverse=False)
    negative = (F.col("base") == "error") & (F.dayofmonth("ts") == 9)
    back = fx0.where("base <> 'view'").select(
        F.col("quote").alias("base"),
        F.col("base").alias("quote"),
        "ts",
        (F.when(F.dayofmonth("ts") % 3 == 0, 1.01).otherwise(1.0) / F.col("rate")).alias("rate"),
    )
    return fx0.withColumn(
        "rate", F.when(negative, -F.col("rate")).otherwise(F.col("rate"))
    ).unionByName(back)


@query(
    "dq_fx_direction",
    with_(FX, TWO_WAY)
    + """SELECT 'non_positive_rate' AS issue, '' AS pair, count(*) AS "rows" FROM two WHERE rate <= 0
       HAVING count(*) > 0
       UNION ALL SELECT 'inconsistent_direction', a.base || '/' || a.quote, count(*)
       FROM two a JOIN two b ON a.base = b.quote AND a.quote = b.base AND a.ts = b.ts
       WHERE abs(a.rate * b.rate - 1) > 1e-6 GROUP BY a.base, a.quote""",
)
def dq_fx_direction(spark, sf_dir):
    return qc.fx_direction_issues(two_way(spark, sf_dir))


def all_sql() -> str:
    """Counts of every rule on the daily bars."""
    return """
SELECT 'positive_prices' AS "check", count(*) AS violations FROM bars WHERE least(open, high, low, close) <= 0
UNION ALL SELECT 'ohlc_relations', count(*) FROM bars WHERE low > least(open, close) OR high < greatest(open, close)
UNION ALL SELECT 'unique_keys', 0
UNION ALL SELECT 'sorted_by_ts', 0
UNION ALL SELECT 'price_jumps', count(*) FROM jumps
UNION ALL SELECT 'calendar_gaps', count(*) FROM gaps
UNION ALL SELECT 'fx_staleness', 0
UNION ALL SELECT 'fx_direction', 0"""


@query(
    "dq_all",
    with_(BARS, SYMBOLS, CALENDAR, GAPS, jumps_sql("bars", "close", 8.0))
    + f'SELECT "check", violations = 0 AS ok, CAST(violations AS BIGINT) AS violations FROM ({all_sql()})',
)
def dq_all(spark, sf_dir):
    bars = tb.bars_daily(spark, sf_dir).withColumn("snapshot_id", F.lit("s1"))
    report = qc.run_all_checks(
        bars.withColumn("seq", F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("long")),
        "seq",
        tb.symbols(spark, sf_dir),
        tb.trading_calendar(spark, sf_dir),
        tb.fx_rates(spark, sf_dir, reverse=False),
    )
    return report.select("check", "ok", "violations")


@query(
    "dq_skipped",
    with_(BARS, jumps_sql("bars", "close", 8.0))
    + f"""SELECT "check", CASE WHEN "check" IN ('calendar_gaps', 'fx_staleness', 'fx_direction')
       THEN "check" || ': skipped, not passed'
       ELSE "check" || ': ' || violations END AS detail FROM ({all_sql().replace("count(*) FROM gaps", "0")})""",
)
def dq_skipped(spark, sf_dir):
    bars = tb.bars_daily(spark, sf_dir).withColumn("snapshot_id", F.lit("s1"))
    seq = F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("long")
    return qc.run_all_checks(bars.withColumn("seq", seq), "seq").select("check", "detail")


def counts(*rules: tuple[str, str]) -> str:
    """UNION of (check, violations) rows from (name, SELECT count) pairs."""
    return "\nUNION ALL ".join(
        f'SELECT \'{n}\' AS "check", CAST(({q}) AS BIGINT) AS violations' for n, q in rules
    )


def ohlc_counts(prefix: str, source: str):
    rules = [(f"{prefix}_nonpositive_{c}", f"SELECT count(*) FROM {source} WHERE {c} <= 0") for c in qc.PRICES]
    rules.append((f"{prefix}_low_above", f"SELECT count(*) FROM {source} WHERE low > least(open, close)"))
    rules.append((f"{prefix}_high_below", f"SELECT count(*) FROM {source} WHERE high < greatest(open, close)"))
    return rules


def copies(source: str, keys: str) -> str:
    return f"SELECT count(*) - count(DISTINCT ({keys})) FROM {source}"


@query(
    "dq_bundle_bars",
    with_(BARS, "pay AS (SELECT symbol_id, ts, open - 100 AS open, high - 100 AS high, low - 100 AS low, close - 100 AS close, available_utc FROM bars)",
          """twice AS (SELECT * FROM pay UNION ALL
               SELECT * REPLACE (CAST(ts - INTERVAL 1 DAY AS TIMESTAMP) AS available_utc) FROM pay WHERE close > 3000)""")
    + counts(
        *ohlc_counts("bars", "twice"),
        ("bars_available_early", "SELECT count(*) FROM twice WHERE available_utc < ts"),
        ("bars_duplicates", copies("twice", "symbol_id, ts")),
    ),
)
def dq_bundle_bars(spark, sf_dir):
    pay = after_payout(spark, sf_dir)
    early = pay.where("close > 3000").withColumn(
        "available_utc", F.date_sub("ts", 1).cast("timestamp_ntz")
    )
    return ct.bundle_invariants({"bars_daily": pay.unionByName(early)})


@query(
    "dq_bundle_actions",
    with_(BARS, ACTIONS, """late AS (SELECT * FROM actions UNION ALL
      SELECT * REPLACE (CAST(ex_date + INTERVAL 1 DAY AS TIMESTAMP) AS available_utc) FROM actions WHERE kind = 'split')""")
    + counts(
        ("actions_announced_late", "SELECT count(*) FROM late WHERE available_utc > ex_date"),
        ("actions_duplicates", copies("late", "symbol_id, ex_date, kind")),
    ),
)
def dq_bundle_actions(spark, sf_dir):
    actions = tb.corporate_actions(spark, sf_dir)
    late = actions.where("kind = 'split'").withColumn(
        "available_utc", F.date_add("ex_date", 1).cast("timestamp_ntz")
    )
    return ct.bundle_invariants({"corporate_actions": actions.unionByName(late)})


@query(
    "dq_bundle_others",
    with_(
        BARS,
        FUND_FACTORS,
        FX,
        "idx AS (SELECT 'I' || symbol_id AS ts_code, ts, open, high, low, close FROM bars)",
        "mac AS (SELECT base AS series_id, ts, CAST(ts - INTERVAL (day(ts) % 2) DAY AS TIMESTAMP) AS available_utc FROM fx0)",
        "codes AS (SELECT c_mktsegment AS ts_code FROM customer)",
    )
    + counts(
        ("symbols_duplicates", "SELECT count(*) - count(DISTINCT symbol_id) FROM items"),
        ("factors_nonpositive", "SELECT count(*) FROM factors WHERE adj_factor - 1.04 <= 0"),
        ("factors_duplicates", "SELECT 0"),
        *ohlc_counts("index", "idx"),
        ("index_duplicates", "SELECT 0"),
        ("macro_available_early", "SELECT count(*) FROM mac WHERE available_utc < ts"),
        ("macro_duplicates", copies("mac", "series_id, ts")),
        ("index_symbols_duplicates", copies("codes", "ts_code")),
        ("hk_symbols_duplicates", copies("codes", "ts_code")),
    ),
)
def dq_bundle_others(spark, sf_dir):
    codes = tb.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("ts_code"))
    index = tb.bars_daily(spark, sf_dir).withColumn("ts_code", F.concat(F.lit("I"), "symbol_id"))
    macro = tb.fx_rates(spark, sf_dir, reverse=False).select(
        F.col("base").alias("series_id"),
        "ts",
        F.date_sub("ts", F.dayofmonth("ts") % 2).cast("timestamp_ntz").alias("available_utc"),
    )
    factors = tb.fund_factors(spark, sf_dir).withColumn("adj_factor", F.col("adj_factor") - 1.04)
    return ct.bundle_invariants(
        {
            "symbols": tb.trades(spark, sf_dir),
            "fund_adj": factors,
            "index_daily": index,
            "macro_series": macro,
            "index_symbols": codes,
            "hk_symbols": codes,
        }
    )


@query(
    "dq_halted_volume",
    with_(BARS) + "SELECT symbol_id, ts, volume FROM bars WHERE NOT traded AND volume <> 0",
)
def dq_halted_volume(spark, sf_dir):
    return ct.halted_with_volume(tb.bars_daily(spark, sf_dir)).select(*KEY, "volume")


@query(
    "dq_outside_listing",
    with_(BARS, SYMBOLS)
    + """SELECT symbol_id, ts FROM bars JOIN symbols USING (symbol_id)
       WHERE ts < listed_on OR ts > delisted_on""",
)
def dq_outside_listing(spark, sf_dir):
    return ct.bars_outside_listing(tb.bars_daily(spark, sf_dir), tb.symbols(spark, sf_dir)).select(*KEY)


@query(
    "dq_validate_normalized",
    with_(BARS, "v AS (SELECT *, CASE WHEN traded THEN available_utc END AS av FROM bars)")
    + counts(
        ("bars_daily.symbol_id is null", "SELECT count(*) FROM v WHERE symbol_id IS NULL"),
        ("bars_daily.ts is null", "SELECT count(*) FROM v WHERE ts IS NULL"),
        ("bars_daily.available_utc is null", "SELECT count(*) FROM v WHERE av IS NULL"),
    ),
)
def dq_validate_normalized(spark, sf_dir):
    bars = tb.bars_daily(spark, sf_dir).withColumns(
        {
            "available_utc": F.when(F.col("traded"), F.col("available_utc")),
            "close_utc": F.col("ts").cast("timestamp_ntz"),
            "currency": F.lit("CNY"),
        }
    )
    return ct.validate_normalized(bars, "bars_daily")


@query(
    "dq_primary_keys",
    with_(BARS, FX)
    + counts(
        ("pk_bars_daily", "SELECT count(*) - count(DISTINCT (symbol_id, ts)) FROM items"),
        ("pk_fx_rates", "SELECT count(*) - count(DISTINCT (base, quote, ts)) FROM fx"),
        ("pk_trading_calendar", "SELECT count(*) - count(DISTINCT (o_orderpriority, CAST(o_orderdate AS DATE))) FROM orders"),
    ),
)
def dq_primary_keys(spark, sf_dir):
    s = F.lit("s1").alias("snapshot_id")
    bars = tb.trades(spark, sf_dir).select(*KEY, s)
    rates = tb.fx_rates(spark, sf_dir).select("base", "quote", "ts", s)
    days = tb.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("exchange"), F.col("o_orderdate").cast("date").alias("ts")
    )
    return (
        ct.primary_key_violations(bars, "bars_daily")
        .unionByName(ct.primary_key_violations(rates, "fx_rates"))
        .unionByName(ct.primary_key_violations(days, "trading_calendar"))
    )


@query(
    "dq_foreign_keys",
    counts(
        ("orders_customer", "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
        (
            "items_rich_supplier",
            """SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN
               (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)""",
        ),
    ),
)
def dq_foreign_keys(spark, sf_dir):
    orders = tb.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol_id"))
    customers = tb.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol_id"))
    items = tb.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol_id"))
    rich = tb.table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(
        F.col("s_suppkey").alias("symbol_id")
    )
    return ct.foreign_key_violations(orders, customers, "symbol_id", "orders_customer").unionByName(
        ct.foreign_key_violations(items, rich, "symbol_id", "items_rich_supplier")
    )


@query(
    "dq_value_rules",
    with_(
        BARS,
        ACTIONS,
        FX,
        SYMBOLS,
        LEDGER,
        """act AS (SELECT *, CASE WHEN cash > 0.03 THEN NULL ELSE cash END AS c2,
             CASE WHEN day(ex_date) > 20 THEN NULL ELSE ratio END AS r2,
             CASE WHEN day(ex_date) < 5 THEN 'merger' ELSE kind END AS k2 FROM actions)""",
    )
    + counts(
        ("symbols.delisted_before_listed", "SELECT count(*) FROM symbols WHERE listed_on > DATE '1995-03-01'"),
        ("symbols.invest_type", "SELECT count(*) FROM symbols WHERE symbol_id > 5"),
        ("corporate_actions.kind", "SELECT count(*) FROM act WHERE k2 NOT IN ('dividend', 'split')"),
        ("corporate_actions.split_without_ratio", "SELECT count(*) FROM act WHERE k2 = 'split' AND r2 IS NULL"),
        ("corporate_actions.dividend_without_cash", "SELECT count(*) FROM act WHERE k2 = 'dividend' AND c2 IS NULL"),
        ("fx_rates.rate_not_positive", "SELECT count(*) FROM fx0 WHERE rate - 60 <= 0"),
        ("trading_calendar.closed_with_close_time", "SELECT count(*) FROM orders WHERE o_orderstatus <> 'O'"),
        ("fundamentals.known_before_period_end", "SELECT count(*) FROM bars WHERE day(ts) < 10"),
        ("fundamentals.available_before_known", "SELECT count(*) FROM bars WHERE day(ts) > 11"),
        ("ingest_runs.status", "SELECT count(*) FROM orders WHERE o_orderstatus <> 'F'"),
        ("close_adj.method", "SELECT count(*) FROM bars WHERE NOT traded"),
        ("runs.status", "SELECT count(*) FROM customer WHERE c_acctbal < 0"),
    ),
)
def dq_value_rules(spark, sf_dir):
    bars = tb.bars_daily(spark, sf_dir)
    orders = tb.table(spark, sf_dir, "orders")
    first = F.lit("1995-03-01").cast("date")
    symbols = tb.symbols(spark, sf_dir).select(
        "symbol_id",
        "listed_on",
        first.alias("delisted_on"),
        F.when(F.col("symbol_id") > 5, "unknown").otherwise("其他").alias("invest_type"),
    )
    day = F.dayofmonth("ex_date")
    actions = tb.corporate_actions(spark, sf_dir).withColumns(
        {
            "cash": F.when(F.col("cash") > 0.03, F.lit(None)).otherwise(F.col("cash")),
            "ratio": F.when(day <= 20, F.col("ratio")),
            "kind": F.when(day < 5, "merger").otherwise(F.col("kind")),
        }
    )
    rates = tb.fx_rates(spark, sf_dir, reverse=False).withColumn("rate", F.col("rate") - 60)
    calendar = orders.select(
        (F.col("o_orderstatus") == "O").alias("is_open"), F.col("o_orderdate").alias("session_close_utc")
    )
    month_day = F.dayofmonth("ts")
    reports = bars.select(
        F.col("ts").alias("as_of_date"),
        F.date_add("ts", F.when(month_day < 10, 1).otherwise(0)).alias("period_end"),
        F.date_sub("ts", F.when(month_day > 11, 1).otherwise(0)).cast("timestamp_ntz").alias("available_utc"),
    )
    runs = orders.select(F.when(F.col("o_orderstatus") == "F", "failed").otherwise("?").alias("status"))
    adjusted = bars.select(F.when(F.col("traded"), "none").otherwise("other").alias("method"))
    tables = {
        "symbols": symbols,
        "corporate_actions": actions,
        "fx_rates": rates,
        "trading_calendar": calendar,
        "fundamentals": reports,
        "ingest_runs": runs,
        "close_adj": adjusted,
        "runs": tb.table(spark, sf_dir, "customer").select(
            F.when(F.col("c_acctbal") < 0, "lost").otherwise("ok").alias("status")
        ),
    }
    return jn.union_frames([ct.value_violations(df, name) for name, df in tables.items()])


@query(
    "dq_single_snapshot",
    with_(BARS, LEDGER, SNAPSHOT_BARS)
    + f"""SELECT 'one' AS frame, min(snapshot_id) = max(snapshot_id) AS ok, count(*) AS "rows"
       FROM snapbars WHERE snapshot_id = '{OLD_SNAPSHOT}'
       UNION ALL SELECT 'all', min(snapshot_id) = max(snapshot_id), count(*) FROM snapbars""",
)
def dq_single_snapshot(spark, sf_dir):
    snaps = tb.snapshots(spark, sf_dir)
    one = ct.single_snapshot(snaps.where(F.col("snapshot_id") == OLD_SNAPSHOT)).select(F.lit("one").alias("frame"), "ok", "rows")
    return one.unionByName(ct.single_snapshot(snaps).select(F.lit("all").alias("frame"), "ok", "rows"))


@query(
    "dq_signals",
    with_(PANEL, CROSS, SIGNAL)
    + counts(
        ("signal_value", "SELECT count(*) FROM sig WHERE signal * 2 NOT IN (-1, 0, 1)"),
        ("signal_duplicates", "SELECT count(*) FROM panel"),
    ),
)
def dq_signals(spark, sf_dir):
    up, down = crossing()
    good = daily(spark, sf_dir).select(*KEY, (sg.signal(up, down, 20) * 2).alias("signal"))
    return ct.signal_violations(good.unionByName(good.withColumn("signal", F.lit(0))))


@query(
    "dq_weights",
    with_(PANEL, MOMENTUM_SQL, "w AS (SELECT ts, symbol_id, weight * 1.5 - 0.1 AS weight FROM weights)")
    + counts(
        ("row_sum", "SELECT count(*) FROM (SELECT ts FROM w GROUP BY ts HAVING sum(weight) > 0.5 + 1e-9)"),
        ("negative_weight", "SELECT count(*) FROM w WHERE weight < -1e-9"),
        ("after_as_of", "SELECT count(*) FROM w WHERE ts > DATE '2000-12-31'"),
    ),
)
def dq_weights(spark, sf_dir):
    odd = settle(momentum_weights(tb.bars_daily(spark, sf_dir)), "weights").withColumn("weight", F.col("weight") * 1.5 - 0.1)
    return ct.weight_violations(odd, as_of="2000-12-31", max_row_sum=0.5)


@query(
    "dq_listing_gate",
    with_(BARS, SYMBOLS)
    + """SELECT s_suppkey AS symbol_id, listed_on, CASE WHEN symbol_id IS NULL THEN 'unknown'
       WHEN listed_on IS NULL THEN 'no_listing_date' ELSE 'listed_later' END AS reason
       FROM supplier LEFT JOIN symbols ON symbol_id = s_suppkey
       WHERE symbol_id IS NULL OR listed_on IS NULL OR listed_on > DATE '1995-03-15'""",
)
def dq_listing_gate(spark, sf_dir):
    universe = tb.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol_id"))
    return ct.listing_gate(universe, tb.symbols(spark, sf_dir), "1995-03-15")


@query(
    "dq_lookahead",
    with_(BARS)
    + counts(("lookahead", "SELECT count(*) FROM bars WHERE available_utc > CAST(ts AS TIMESTAMP) + INTERVAL (day(ts)) HOUR")),
)
def dq_lookahead(spark, sf_dir):
    decided = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.dayofmonth("ts"))
    return ct.lookahead_violations(tb.bars_daily(spark, sf_dir).withColumn("decision_utc", decided))


@query(
    "dq_future_leak",
    with_(PANEL)
    + f"""SELECT symbol_id, ts, {r('nxt')} AS nxt FROM (
       SELECT symbol_id, ts, lead(close) OVER {BY} AS nxt, lead(ts) OVER {BY} AS nts FROM panel)
       WHERE ts <= DATE '1999-06-30' AND nts > DATE '1999-06-30' AND nxt IS NOT NULL""",
)
def dq_future_leak(spark, sf_dir):
    from pyspark.sql import Window

    def peeking(bars):
        """An operator that looks one session ahead, next to causal ones that must not show up."""
        nxt = F.lead("close").over(Window.partitionBy("symbol_id").orderBy("ts"))
        return densify(bars, tasks=tasks).select(
            *KEY,
            rounded(fx.sma("close", 20)).alias("sma"),
            rounded(fx.momentum("close", 63)).alias("momentum"),
            rounded(nxt).alias("nxt"),
        )

    bars = settle(tb.bars_daily(spark, sf_dir), "bars-daily")
    tasks = panel_tasks(bars)
    return ct.future_leak(bars, peeking, "1999-06-30", tasks=tasks).select(*KEY, "nxt")


@query(
    "adjusted_price_jumps",
    with_(
        BARS,
        ACTIONS,
        """sf AS MATERIALIZED (SELECT b.*, coalesce((SELECT product(a.ratio) FROM actions a
           WHERE a.symbol_id = b.symbol_id AND a.kind = 'split' AND a.ex_date <= b.ts), 1.0) AS f FROM bars b)""",
        f"am AS (SELECT *, close * f / first_value(f) OVER {BY} AS close_adj FROM sf)",
        jumps_sql("am", "close_adj", 2.5),
    )
    + f"SELECT {JUMP_COLUMNS} FROM jumps",
)
def adjusted_price_jumps(spark, sf_dir):
    adjusted = cl.adjust_prices(
        tb.bars_daily(spark, sf_dir), tb.corporate_actions(spark, sf_dir), "forward"
    )
    return jump_columns(qc.price_jumps(adjusted, sigma=2.5))
