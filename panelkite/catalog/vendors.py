"""Vendor tables, shaped from the driver tables, through the contract jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkite.catalog.registry import query, r, rounded
from panelkite.catalog.tables import BARS, FX, with_
from panelkite.operators import joins as jn
from panelkite.plans import testbed as tb
from panelkite.sources import abroad, cn
from panelkite.sources import common as cm

DAY = "yyyyMMdd"

CODES = """
codes AS MATERIALIZED (
  SELECT s_suppkey, s_name, s_nationkey, lpad(s_suppkey::VARCHAR, 6, '0')
         || CASE WHEN s_suppkey % 2 = 0 THEN '.SH' ELSE '.SZ' END AS ts_code,
         ['股票型', '债券型', '货币型', '商品型', '黄金型', 'QDII', 'REITs', '混合型'][s_nationkey % 8 + 1] AS fund_type,
         DATE '2010-01-04' + s_suppkey::INTEGER AS listed,
         CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN NULL
              ELSE strftime(DATE '2020-01-01' + s_suppkey::INTEGER, '%Y%m%d') END AS delist_date
  FROM supplier),
ids AS MATERIALIZED (
  SELECT ts_code AS code, row_number() OVER (ORDER BY ts_code) AS symbol_id FROM codes WHERE fund_type <> 'REITs')"""

# a bar symbol carries the code of the supplier with its number; some of those funds have no id
RAW_BARS = """
raw AS MATERIALIZED (
  SELECT lpad(symbol_id::VARCHAR, 6, '0') || CASE WHEN symbol_id % 2 = 0 THEN '.SH' ELSE '.SZ' END AS ts_code, *
  FROM bars)"""


def fund_list(spark, sf_dir):
    """Raw fund list: one fund per supplier."""
    kinds = F.array(
        *[F.lit(k) for k in ("股票型", "债券型", "货币型", "商品型", "黄金型", "QDII", "REITs", "混合型")]
    )
    key = F.col("s_suppkey")
    late = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), key.cast("int")), DAY)
    return tb.table(spark, sf_dir, "supplier").select(
        code_of(key).alias("ts_code"),
        F.col("s_name").alias("name"),
        F.element_at(kinds, F.col("s_nationkey") % 8 + 1).alias("fund_type"),
        F.date_format(F.date_add(F.lit("2010-01-04").cast("date"), key.cast("int")), DAY).alias("list_date"),
        F.when(key % 4 == 0, "").when(key % 4 == 1, "nan").when(key % 4 == 3, late).alias("delist_date"),
    )


def code_of(key):
    suffix = F.when(key % 2 == 0, ".SH").otherwise(".SZ")
    return F.concat(F.lpad(key.cast("string"), 6, "0"), suffix)


def ids(spark, sf_dir):
    return cn.fund_ids(fund_list(spark, sf_dir))


def with_id(df):
    """Rows whose code has an id, for the queries of clean rows; nothing that loads a table calls this."""
    return df.where(F.col("symbol_id").isNotNull())


def with_status(df):
    """Every row, those without an id included, and which of the two a row is."""
    return df.withColumn("status", F.when(F.col("symbol_id").isNull(), "unmapped").otherwise("mapped"))


STATUS = "CASE WHEN i.symbol_id IS NULL THEN 'unmapped' ELSE 'mapped' END AS status"


def raw_bars(spark, sf_dir):
    return tb.bars_daily(spark, sf_dir).select(
        code_of(F.col("symbol_id")).alias("ts_code"),
        F.date_format("ts", DAY).alias("trade_date"),
        *["open", "high", "low", "close"],
        F.col("volume").cast("string").alias("vol"),
        "amount",
    )


@query("symbol_ids", with_(CODES) + "SELECT code, symbol_id FROM ids")
def symbol_ids(spark, sf_dir):
    return ids(spark, sf_dir)


@query(
    "symbol_ids_appended",
    with_(
        CODES,
        """old AS (SELECT ts_code AS code, row_number() OVER (ORDER BY ts_code) AS symbol_id FROM codes
             WHERE fund_type = '股票型')""",
    )
    + """SELECT code, symbol_id FROM old UNION ALL
       SELECT ts_code, (SELECT max(symbol_id) FROM old) + row_number() OVER (ORDER BY ts_code)
       FROM codes WHERE ts_code NOT IN (SELECT code FROM old)""",
)
def symbol_ids_appended(spark, sf_dir):
    funds = fund_list(spark, sf_dir)
    return cm.append_ids(cm.assign_ids(funds.where("fund_type = '股票型'")), funds)


@query(
    "cn_bars",
    with_(BARS, CODES, RAW_BARS)
    + """SELECT i.symbol_id, ts, open, high, low, close, volume, amount, 'CNY' AS currency,
       CAST(ts AS TIMESTAMP) + INTERVAL 7 HOUR AS close_utc, available_utc
       FROM raw JOIN ids i ON i.code = raw.ts_code""",
)
def cn_bars(spark, sf_dir):
    return with_id(cn.bars(raw_bars(spark, sf_dir), ids(spark, sf_dir)))


@query(
    "cn_bars_whole",
    with_(BARS, CODES, RAW_BARS)
    + f"""SELECT i.symbol_id, ts, open, high, low, close, volume, amount, 'CNY' AS currency,
       CAST(ts AS TIMESTAMP) + INTERVAL 7 HOUR AS close_utc, available_utc, {STATUS}
       FROM raw LEFT JOIN ids i ON i.code = raw.ts_code""",
)
def cn_bars_whole(spark, sf_dir):
    return with_status(cn.bars(raw_bars(spark, sf_dir), ids(spark, sf_dir)))


@query(
    "unmapped_codes",
    with_(BARS, CODES, RAW_BARS)
    + """SELECT ts_code AS code, count(*) AS "rows" FROM raw
       WHERE ts_code NOT IN (SELECT code FROM ids) GROUP BY 1""",
)
def unmapped_codes(spark, sf_dir):
    return jn.unmapped_codes(raw_bars(spark, sf_dir), "ts_code", ids(spark, sf_dir))


RAW_DIVIDENDS = """
rawdiv AS MATERIALIZED (
  SELECT lpad(l_suppkey::VARCHAR, 6, '0') || CASE WHEN l_suppkey % 2 = 0 THEN '.SH' ELSE '.SZ' END AS ts_code,
         CAST(l_shipdate AS DATE) AS ex_date,
         CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_shipdate AS DATE) + (5 - l_linenumber) END AS ann,
         CAST(l_shipdate AS DATE) + l_quantity::INTEGER AS pay_date, l_tax AS cash
  FROM lineitem WHERE l_linestatus = 'F')"""


@query(
    "dividend_dedupe",
    with_(CODES, RAW_DIVIDENDS)
    + """SELECT symbol_id, ex_date, 'dividend' AS kind, CAST(NULL AS DOUBLE) AS ratio, cash, pay_date,
       CAST(least(coalesce(ann, ex_date), ex_date) AS TIMESTAMP) AS available_utc
       FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, ex_date
               ORDER BY ann NULLS LAST, pay_date NULLS LAST, cash) AS n FROM rawdiv) d
       JOIN ids ON code = ts_code WHERE n = 1""",
)
def dividend_dedupe(spark, sf_dir):
    return with_id(cn.dividends(raw_dividends(spark, sf_dir), ids(spark, sf_dir)))


@query(
    "dividend_dedupe_whole",
    with_(CODES, RAW_DIVIDENDS)
    + f"""SELECT i.symbol_id, ex_date, 'dividend' AS kind, CAST(NULL AS DOUBLE) AS ratio, cash, pay_date,
       CAST(least(coalesce(ann, ex_date), ex_date) AS TIMESTAMP) AS available_utc, {STATUS}
       FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, ex_date
               ORDER BY ann NULLS LAST, pay_date NULLS LAST, cash) AS n FROM rawdiv) d
       LEFT JOIN ids i ON i.code = ts_code WHERE n = 1""",
)
def dividend_dedupe_whole(spark, sf_dir):
    return with_status(cn.dividends(raw_dividends(spark, sf_dir), ids(spark, sf_dir)))


def raw_dividends(spark, sf_dir):
    ship = F.col("l_shipdate").cast("date")
    return tb.table(spark, sf_dir, "lineitem").select(
        code_of(F.col("l_suppkey")).alias("ts_code"),
        F.date_format(ship, DAY).alias("ex_date"),
        F.when(F.col("l_returnflag") == "N", "None")
        .otherwise(F.date_format(F.date_add(ship, 5 - F.col("l_linenumber")), DAY))
        .alias("ann_date"),
        F.date_format(F.date_add(ship, F.col("l_quantity").cast("int")), DAY).alias("pay_date"),
        F.when(F.col("l_linestatus") == "F", " 实施 ").otherwise("预案").alias("div_proc"),
        F.col("l_tax").alias("div_cash"),
    )


@query(
    "cn_symbols",
    with_(CODES)
    + """SELECT symbol_id, ts_code AS ticker, 'XSHG' AS exchange, 'XSHG' AS calendar, 'CNY' AS currency,
       CAST(NULL AS VARCHAR) AS isin, 100 AS lot_size, listed AS listed_on,
       CASE WHEN s_suppkey % 4 = 3 THEN DATE '2020-01-01' + s_suppkey::INTEGER END AS delisted_on, s_name AS name,
       CASE fund_type WHEN '股票型' THEN '股票' WHEN '债券型' THEN '债券' WHEN '货币型' THEN '货币'
         WHEN '商品型' THEN '商品' WHEN '黄金型' THEN '商品' WHEN 'QDII' THEN 'qdii' ELSE '其他' END AS invest_type
       FROM codes JOIN ids ON code = ts_code""",
)
def cn_symbols(spark, sf_dir):
    return cn.fund_symbols(fund_list(spark, sf_dir), ids(spark, sf_dir))


@query(
    "cn_unknown_suffix",
    with_(CODES)
    + """SELECT replace(ts_code, '.SZ', '.BJ') AS ts_code FROM codes
       WHERE fund_type <> 'REITs' AND ts_code LIKE '%.SZ'""",
)
def cn_unknown_suffix(spark, sf_dir):
    moved = fund_list(spark, sf_dir).withColumn("ts_code", F.replace("ts_code", F.lit(".SZ"), F.lit(".BJ")))
    return cn.unknown_suffixes(moved)


@query(
    "cn_adjustment_factors",
    with_(BARS, CODES, RAW_BARS)
    + f"""SELECT i.symbol_id, ts, {r('close / 1000')} AS adj_factor FROM raw JOIN ids i ON i.code = raw.ts_code""",
)
def cn_adjustment_factors(spark, sf_dir):
    return with_id(adjustment_rows(spark, sf_dir))


@query(
    "cn_adjustment_factors_whole",
    with_(BARS, CODES, RAW_BARS)
    + f"""SELECT i.symbol_id, ts, {r('close / 1000')} AS adj_factor, {STATUS}
       FROM raw LEFT JOIN ids i ON i.code = raw.ts_code""",
)
def cn_adjustment_factors_whole(spark, sf_dir):
    return with_status(adjustment_rows(spark, sf_dir))


def adjustment_rows(spark, sf_dir):
    raw = raw_bars(spark, sf_dir).withColumn("adj_factor", rounded(F.col("close") / 1000))
    return cn.adjustment_factors(raw, ids(spark, sf_dir))


@query(
    "cn_index_catalogue",
    """SELECT p_partkey::VARCHAR || '.CSI' AS ts_code, p_name AS name, p_brand AS market, p_type AS publisher,
       p_size::VARCHAR AS category, DATE '2004-12-31' + p_size AS base_date, p_retailprice AS base_point,
       CASE WHEN p_size % 5 <> 0 THEN DATE '2005-04-08' + p_size END AS list_date FROM part""",
)
def cn_index_catalogue(spark, sf_dir):
    size = F.col("p_size")

    def day(start):
        return F.date_format(F.date_add(F.lit(start).cast("date"), size), DAY)

    raw = tb.table(spark, sf_dir, "part").select(
        F.concat("p_partkey", F.lit(".CSI")).alias("ts_code"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("market"),
        F.col("p_type").alias("publisher"),
        size.alias("category"),
        day("2004-12-31").alias("base_date"),
        F.col("p_retailprice").cast("string").alias("base_point"),
        F.when(size % 5 == 0, " ").otherwise(day("2005-04-08")).alias("list_date"),
    )
    return cn.index_catalogue(raw)


@query(
    "cn_index_bars",
    with_(BARS, RAW_BARS)
    + f"""SELECT ts_code, ts, open, high, low, close, open AS pre_close, {r('close - open')} AS change,
       {r('(close / open - 1) * 100')} AS pct_chg, volume, amount FROM raw""",
)
def cn_index_bars(spark, sf_dir):
    raw = raw_bars(spark, sf_dir).withColumns(
        {
            "pre_close": F.col("open"),
            "change": rounded(F.col("close") - F.col("open")),
            "pct_chg": rounded((F.col("close") / F.col("open") - 1) * 100),
        }
    )
    return cn.index_bars(raw)


@query(
    "cn_header_bars",
    with_(BARS, CODES, RAW_BARS)
    + """SELECT 'lag' AS variant, i.symbol_id, ts, open, high, low, close, volume, amount, 'CNY' AS currency,
       CAST(ts AS TIMESTAMP) + INTERVAL 7 HOUR AS close_utc, available_utc
       FROM raw JOIN ids i ON i.code = raw.ts_code
       UNION ALL SELECT 'own', i.symbol_id, ts, open, high, low, close, volume, amount, 'CNY',
       CAST(ts AS TIMESTAMP) + INTERVAL 7 HOUR, CAST(ts AS TIMESTAMP) + INTERVAL 10 HOUR
       FROM raw JOIN ids i ON i.code = raw.ts_code""",
)
def cn_header_bars(spark, sf_dir):
    return with_id(header_bars(spark, sf_dir))


@query(
    "cn_header_bars_whole",
    with_(BARS, CODES, RAW_BARS)
    + f"""SELECT 'lag' AS variant, i.symbol_id, ts, open, high, low, close, volume, amount, 'CNY' AS currency,
       CAST(ts AS TIMESTAMP) + INTERVAL 7 HOUR AS close_utc, available_utc, {STATUS}
       FROM raw LEFT JOIN ids i ON i.code = raw.ts_code
       UNION ALL SELECT 'own', i.symbol_id, ts, open, high, low, close, volume, amount, 'CNY',
       CAST(ts AS TIMESTAMP) + INTERVAL 7 HOUR, CAST(ts AS TIMESTAMP) + INTERVAL 10 HOUR, {STATUS}
       FROM raw LEFT JOIN ids i ON i.code = raw.ts_code""",
)
def cn_header_bars_whole(spark, sf_dir):
    return with_status(header_bars(spark, sf_dir))


def header_bars(spark, sf_dir):
    names = {v: k for k, v in cn.HEADERS.items()}
    raw = tb.bars_daily(spark, sf_dir).select(
        code_of(F.col("symbol_id")).alias(cn.CODE_HEADER),
        F.col("ts").cast("string").alias(names["ts"]),
        *[F.col(c).alias(names[c]) for c in ("open", "high", "low", "close", "volume", "amount")],
    )
    known = ids(spark, sf_dir)
    own = raw.withColumn(cn.AVAILABLE_HEADER, F.concat(F.col(names["ts"]), F.lit("T18:00:00+08:00")))
    lagged = cn.bars_with_headers(raw, known).withColumn("variant", F.lit("lag"))
    return lagged.unionByName(cn.bars_with_headers(own, known).withColumn("variant", F.lit("own")))


MACRO_SQL = """
m AS MATERIALIZED (SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders),
mac AS (
  SELECT 'CN_CPI_YOY' AS series_id, last_day(d) AS ts, round(avg(v) + 1.23e-7, 4) AS value, 15 AS lag FROM m GROUP BY last_day(d)
  UNION ALL SELECT 'CN_PPI_YOY', last_day(d), CASE WHEN month(last_day(d)) <> 2 THEN max(v) END, 15 FROM m GROUP BY last_day(d)
  UNION ALL SELECT 'CN_GDP_YOY', q, max(v), 30 FROM (SELECT *, last_day(make_date(year(d), quarter(d) * 3, 1)) AS q FROM m) GROUP BY q
  UNION ALL SELECT 'CN_SHIBOR_3M', d, min(v), 1 FROM m GROUP BY d)"""


def macro_raws(spark, sf_dir):
    orders = tb.table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("v")
    )
    month = F.date_format("d", "yyyyMM")
    quarter = F.concat(F.year("d"), F.lit("Q"), F.quarter("d"))
    return {
        "CN_CPI_YOY": orders.groupBy(month.alias("month")).agg(F.round(F.avg("v") + 1.23e-7, 4).alias("nt_yoy")),
        "CN_PPI_YOY": orders.groupBy(month.alias("month"))
        .agg(F.max("v").alias("_v"))
        .withColumn("ppi_yoy", F.when(~F.col("month").endswith("02"), F.col("_v"))),
        "CN_GDP_YOY": orders.groupBy(quarter.alias("quarter")).agg(F.max("v").alias("gdp_yoy")),
        "CN_SHIBOR_3M": cm.merge_pages([daily_page(orders, "1998-06-30", None), daily_page(orders, None, "1998-07-31")]),
    }


def daily_page(orders, first, last):
    """One page of the daily series; neighbouring pages overlap."""
    page = orders.groupBy("d").agg(F.min("v").alias("3m"))
    if first:
        page = page.where(F.col("d") >= F.lit(first).cast("date"))
    if last:
        page = page.where(F.col("d") <= F.lit(last).cast("date"))
    return page.select(F.date_format("d", DAY).alias("date"), "3m")


@query(
    "cn_macro",
    with_(MACRO_SQL)
    + """SELECT series_id, ts, value, 'percent' AS unit, CAST(ts + lag AS TIMESTAMP) AS available_utc
       FROM mac WHERE value IS NOT NULL AND ts BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
)
def cn_macro(spark, sf_dir):
    return cn.macro_series(macro_raws(spark, sf_dir), "1996-01-01", "2000-12-31")


@query(
    "macro_dates",
    """SELECT o_orderkey, last_day(o_orderdate) AS month_end,
       last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS quarter_end,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS obs_day FROM orders""",
)
def macro_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    return tb.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        cn.macro_date(F.date_format(d, "yyyyMM"), "month").alias("month_end"),
        cn.macro_date(F.concat(F.year(d), F.lit("Q"), F.quarter(d)), "quarter").alias("quarter_end"),
        cn.macro_date(
            F.when(F.col("o_orderstatus") == "P", "NaT").otherwise(F.date_format(d, DAY)), "day"
        ).alias("obs_day"),
    )


@query(
    "paged_pulls",
    "WITH " + MACRO_SQL + "SELECT strftime(ts, '%Y%m%d') AS date, value AS rate FROM mac WHERE series_id = 'CN_SHIBOR_3M'",
)
def paged_pulls(spark, sf_dir):
    return macro_raws(spark, sf_dir)["CN_SHIBOR_3M"].select("date", F.col("3m").alias("rate"))


HK = """
hk AS MATERIALIZED (
  SELECT lpad(c_custkey::VARCHAR, 5, '0') || '.HK' AS ts_code, c_name AS name, c_mktsegment AS market,
         CASE WHEN c_acctbal < 0 THEN 'D' ELSE 'L' END AS list_status, 'HK' || c_custkey AS isin,
         'HKD' AS curr_type, DATE '2001-01-02' + c_nationkey AS list_date,
         CASE WHEN c_acctbal < 0 THEN DATE '2019-05-06' + c_nationkey END AS delist_date,
         CASE c_nationkey % 3 WHEN 0 THEN NULL ELSE (c_nationkey * 100)::DOUBLE END AS trade_unit
  FROM customer),
hkids AS MATERIALIZED (
  SELECT ts_code AS code, 1000000000 + row_number() OVER (ORDER BY ts_code) AS symbol_id FROM hk)"""


def hk_raw(spark, sf_dir):
    nation = F.col("c_nationkey")
    gone = F.col("c_acctbal") < 0

    def day(start):
        return F.date_format(F.date_add(F.lit(start).cast("date"), nation), DAY)

    return tb.table(spark, sf_dir, "customer").select(
        F.concat(F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit(".HK")).alias("ts_code"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("market"),
        F.when(gone, "D").otherwise("L").alias("list_status"),
        day("2001-01-02").alias("list_date"),
        F.when(gone, day("2019-05-06")).otherwise("").alias("delist_date"),
        F.when(nation % 3 == 0, "n/a").otherwise((nation * 100).cast("string")).alias("trade_unit"),
        F.concat(F.lit("HK"), "c_custkey").alias("isin"),
        F.lit("HKD").alias("curr_type"),
    )


@query("hk_list", with_(HK) + "SELECT * FROM hk")
def hk_list(spark, sf_dir):
    return abroad.hk_list(hk_raw(spark, sf_dir))


@query(
    "hk_symbols",
    with_(HK)
    + """SELECT symbol_id, ts_code AS ticker, 'XHKG' AS exchange, 'XHKG' AS calendar, curr_type AS currency,
       isin, trade_unit AS lot_size, list_date AS listed_on, delist_date AS delisted_on, name,
       '其他' AS invest_type FROM hk JOIN hkids ON code = ts_code""",
)
def hk_symbols(spark, sf_dir):
    listed = abroad.hk_list(hk_raw(spark, sf_dir))
    return abroad.hk_symbols(listed, abroad.hk_ids(listed))


@query(
    "hk_bars",
    with_(BARS, HK)
    + """SELECT i.symbol_id, ts, open, high, low, close, volume, amount, 'HKD' AS currency,
       CAST(ts AS TIMESTAMP) + INTERVAL 8 HOUR AS close_utc, available_utc
       FROM bars b LEFT JOIN hkids i ON i.code = lpad(b.symbol_id::VARCHAR, 5, '0') || '.HK'""",
)
def hk_bars(spark, sf_dir):
    raw = tb.bars_daily(spark, sf_dir).select(
        F.concat(F.lit("HK."), F.lpad(F.col("symbol_id").cast("string"), 5, "0")).alias("code"),
        F.date_format("ts", "yyyy-MM-dd 00:00:00").alias("time_key"),
        *["open", "high", "low", "close", "volume"],
        F.col("amount").alias("turnover"),
    )
    listed = abroad.hk_list(hk_raw(spark, sf_dir))
    return abroad.hk_bars(raw, abroad.hk_ids(listed))


@query(
    "hk_code",
    """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN lpad(c_custkey::VARCHAR, 5, '0') || '.HK' END AS ticker
       FROM customer""",
)
def hk_code(spark, sf_dir):
    market = F.when(F.col("c_nationkey") % 2 == 0, "HK.").otherwise("US.")
    code = F.concat(market, F.lpad(F.col("c_custkey").cast("string"), 5, "0"))
    return tb.table(spark, sf_dir, "customer").select("c_custkey", abroad.hk_ticker(code).alias("ticker"))


@query(
    "us_bars",
    with_(BARS, CODES, RAW_BARS)
    + f"""SELECT i.symbol_id, ts, open, high, low, {r('close * 0.9')} AS close, volume,
       {r('close * volume', 2)} AS amount, 'USD' AS currency, available_utc AS close_utc, available_utc,
       'total_return' AS return_kind FROM raw JOIN ids i ON i.code = raw.ts_code
       UNION ALL SELECT i.symbol_id, ts, open, high, low, close, 0.0, 0.0, 'USD', available_utc, available_utc,
       'price_return' FROM raw JOIN ids i ON i.code = raw.ts_code""",
)
def us_bars(spark, sf_dir):
    return with_id(wide_bars(spark, sf_dir))


@query(
    "us_bars_whole",
    with_(BARS, CODES, RAW_BARS)
    + f"""SELECT i.symbol_id, ts, open, high, low, {r('close * 0.9')} AS close, volume,
       {r('close * volume', 2)} AS amount, 'USD' AS currency, available_utc AS close_utc, available_utc,
       'total_return' AS return_kind, {STATUS} FROM raw LEFT JOIN ids i ON i.code = raw.ts_code
       UNION ALL SELECT i.symbol_id, ts, open, high, low, close, 0.0, 0.0, 'USD', available_utc, available_utc,
       'price_return', {STATUS} FROM raw LEFT JOIN ids i ON i.code = raw.ts_code""",
)
def us_bars_whole(spark, sf_dir):
    return with_status(wide_bars(spark, sf_dir))


def wide_bars(spark, sf_dir):
    bars = tb.bars_daily(spark, sf_dir)
    raw = bars.select(
        F.col("ts").cast("string").alias("Date"),
        code_of(F.col("symbol_id")).alias("Ticker"),
        *[F.col(c.lower()).alias(c) for c in abroad.WIDE_PRICES],
    )
    full = bars.select(
        F.col("ts").cast("string").alias("Date"),
        code_of(F.col("symbol_id")).alias("Ticker"),
        *[F.col(c.lower()).alias(c) for c in abroad.WIDE_PRICES],
        rounded(F.col("close") * 0.9).alias("Adj Close"),
        F.col("volume").alias("Volume"),
    )
    known = ids(spark, sf_dir)
    both = abroad.wide_bars(full, known).unionByName(abroad.wide_bars(raw, known))
    return both.withColumn("amount", rounded("amount", 2))


@query(
    "fx_series",
    with_(FX)
    + """SELECT 'USD' AS base, 'CNY' AS quote, ts, round(avg(rate) + 1.23e-9, 6) AS rate,
       CAST(ts + INTERVAL 1 DAY AS TIMESTAMP) AS available_utc FROM fx0 GROUP BY ts""",
)
def fx_series(spark, sf_dir):
    """One pair under a name that the caller gives: its rate is the day's mean over all event types."""
    raw = tb.fx_rates(spark, sf_dir, reverse=False).groupBy("ts").agg(F.round(F.avg("rate") + 1.23e-9, 6).alias("Close"))
    return abroad.fx_series(raw.withColumn("Date", F.col("ts").cast("string")).drop("ts"), "USD", "CNY")


@query(
    "fx_series_pairs",
    with_(FX)
    + "SELECT base, quote, ts, rate, CAST(ts + INTERVAL 1 DAY AS TIMESTAMP) AS available_utc FROM fx0",
)
def fx_series_pairs(spark, sf_dir):
    """The series of every pair of the table."""
    raw = tb.fx_rates(spark, sf_dir, reverse=False).select(
        "base", "quote", F.col("ts").cast("string").alias("Date"), F.col("rate").alias("Close")
    )
    return abroad.fx_series(raw, F.col("base"), F.col("quote"))


@query(
    "macro_units",
    with_(FX)
    + """SELECT 'lag' AS variant, base AS series_id, ts, rate AS value,
       CASE base WHEN 'click' THEN 'count' WHEN 'view' THEN 'percent' ELSE 'unknown' END AS unit,
       CAST(ts + INTERVAL 30 DAY AS TIMESTAMP) AS available_utc FROM fx0
       UNION ALL SELECT 'own', base, ts, rate,
       CASE base WHEN 'click' THEN 'count' WHEN 'view' THEN 'percent' ELSE 'unknown' END,
       CAST(ts AS TIMESTAMP) + INTERVAL 4 HOUR FROM fx0""",
)
def macro_units(spark, sf_dir):
    raw = tb.fx_rates(spark, sf_dir, reverse=False).select(
        F.col("base").alias("series_id"), "ts", F.col("rate").alias("value")
    )
    units = (
        raw.select("series_id")
        .distinct()
        .withColumn("unit", cm.lookup("series_id", {"click": "count", "view": "percent"}, None))
        .where("unit IS NOT NULL")
    )
    own = raw.withColumn("available_utc", F.concat(F.col("ts").cast("string"), F.lit("T09:00:00+05:00")))
    lagged = abroad.macro_series(raw, units).withColumn("variant", F.lit("lag"))
    return lagged.unionByName(abroad.macro_series(own, units).withColumn("variant", F.lit("own")))


@query(
    "naive_utc",
    """SELECT event_id, CAST(ts - INTERVAL 8 HOUR AS TIMESTAMP) AS utc FROM events""",
)
def naive_utc(spark, sf_dir):
    zoned = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+08:00"))
    return tb.table(spark, sf_dir, "events").select("event_id", cm.to_naive_utc(zoned).alias("utc"))


@query(
    "release_buffer",
    with_(BARS)
    + """SELECT symbol_id, ts, CAST(ts AS TIMESTAMP) + INTERVAL 7 HOUR
       + INTERVAL (CASE symbol_id % 3 WHEN 2 THEN 15 ELSE 30 END) MINUTE AS available_utc FROM bars""",
)
def release_buffer(spark, sf_dir):
    names = F.array(F.lit("XSHG"), F.lit("XHKG"), F.lit("XNYS"))
    exchange = F.element_at(names, (F.col("symbol_id") % 3 + 1).cast("int"))
    return tb.bars_daily(spark, sf_dir).select(
        "symbol_id",
        "ts",
        cm.release_time(cm.at_hour("ts", cm.CLOSE_HOURS_CN), exchange).alias("available_utc"),
    )


@query(
    "stamped_window",
    with_(FX)
    + """SELECT base, quote, ts, rate, 'vendor' AS source, 'v-1' AS snapshot_id,
       TIMESTAMP '2024-12-31 00:00:00' AS downloaded_at
       FROM fx0 WHERE ts BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)
def stamped_window(spark, sf_dir):
    cropped = cm.crop(tb.fx_rates(spark, sf_dir, reverse=False), "2024-01-05", "2024-01-20")
    return cm.stamp(cropped, "vendor", "v-1", "2024-12-31 00:00:00")
