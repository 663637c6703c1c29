"""Mainland funds, indices and macro series: raw vendor tables to the contract."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkite.operators.joins import map_symbols, union_frames
from panelkite.sources import common as cm

SOURCE = "cn"

# Fixed values of the vendor and of the contract.
EXCLUDED_TYPES = ["REITs"]
INVEST_TYPES = {
    "股票型": "股票",
    "债券型": "债券",
    "货币型": "货币",
    "商品型": "商品",
    "黄金型": "商品",
    "QDII": "qdii",
}
OTHER = "其他"
IMPLEMENTED = "实施"
SUFFIX_EXCHANGE = {"SH": "XSHG", "SZ": "XSHG"}
LOT_SIZE = 100
# series_id: (unit, value column, date column, date kind, release lag in days)
MACRO = {
    "CN_CPI_YOY": ("percent", "nt_yoy", "month", "month", 15),
    "CN_PPI_YOY": ("percent", "ppi_yoy", "month", "month", 15),
    "CN_GDP_YOY": ("percent", "gdp_yoy", "quarter", "quarter", 30),
    "CN_SHIBOR_3M": ("percent", "3m", "date", "day", 1),
}
HEADERS = {
    "日期": "ts",
    "开盘": "open",
    "最高": "high",
    "最低": "low",
    "收盘": "close",
    "成交量": "volume",
    "成交额": "amount",
}
CODE_HEADER = "代码"
AVAILABLE_HEADER = "可用时间"


def bars(raw: DataFrame, ids: DataFrame, currency: str = "CNY") -> DataFrame:
    """Daily bars. Volume stays in lots and amount in thousands, as the vendor gives them."""
    cm.require_columns(
        raw, ("ts_code", "trade_date", "open", "high", "low", "close", "vol", "amount"), SOURCE
    )
    return map_symbols(raw, "ts_code", ids).withColumn("ts", cm.to_day("trade_date")).select(
        "symbol_id",
        "ts",
        *cm.numbers("open", "high", "low", "close"),
        F.col("vol").cast("double").alias("volume"),
        F.col("amount").cast("double").alias("amount"),
        F.lit(currency).alias("currency"),
        cm.at_hour("ts", cm.CLOSE_HOURS_CN).alias("close_utc"),
        cm.available_after("ts").alias("available_utc"),
    )


def dividends(raw: DataFrame, ids: DataFrame) -> DataFrame:
    """Implemented dividends, one per code and ex-date.

    Repeated rows resolve to the earliest announcement, then pay date, then amount. The available
    time is the announcement, but never after the ex-date.
    """
    cm.require_columns(raw, ("ts_code", "ex_date", "div_cash"), SOURCE)
    rows = raw
    if "div_proc" in raw.columns:
        rows = rows.where(F.trim("div_proc") == IMPLEMENTED)
    missing = F.lit(None).cast("date")
    ann = cm.to_day("ann_date") if "ann_date" in raw.columns else missing
    pay = cm.to_day("pay_date") if "pay_date" in raw.columns else missing
    rows = rows.select(
        "ts_code",
        cm.to_day("ex_date").alias("ex_date"),
        ann.alias("ann"),
        pay.alias("pay_date"),
        F.col("div_cash").cast("double").alias("cash"),
    )
    late = F.lit("9999-12-31").cast("date")
    order = F.struct(F.coalesce("ann", late), F.coalesce("pay_date", late), F.col("cash"))
    one = rows.groupBy("ts_code", "ex_date").agg(
        F.min_by(F.struct("ann", "pay_date", "cash"), order).alias("_r")
    )
    return map_symbols(one, "ts_code", ids).select(
        "symbol_id",
        "ex_date",
        F.lit("dividend").alias("kind"),
        F.lit(None).cast("double").alias("ratio"),
        "_r.cash",
        "_r.pay_date",
        F.least(F.coalesce("_r.ann", "ex_date"), "ex_date").cast("timestamp_ntz").alias("available_utc"),
    )


def listed_funds(raw: DataFrame) -> DataFrame:
    return raw.where(~F.col("fund_type").isin(EXCLUDED_TYPES))


def unknown_suffixes(raw: DataFrame) -> DataFrame:
    """Codes whose suffix names no known exchange. They are an error, not a guess."""
    suffix = F.substring_index("ts_code", ".", -1)
    return listed_funds(raw).where(~suffix.isin(list(SUFFIX_EXCHANGE))).select("ts_code")


def fund_symbols(raw: DataFrame, ids: DataFrame, currency: str = "CNY") -> DataFrame:
    """Fund list without the excluded types."""
    cm.require_columns(raw, ("ts_code", "fund_type", "list_date", "name"), SOURCE)
    exchange = cm.lookup(F.substring_index("ts_code", ".", -1), SUFFIX_EXCHANGE, None)
    delisted = cm.to_day("delist_date") if "delist_date" in raw.columns else F.lit(None).cast("date")
    return map_symbols(listed_funds(raw), "ts_code", ids).select(
        "symbol_id",
        F.col("ts_code").alias("ticker"),
        exchange.alias("exchange"),
        exchange.alias("calendar"),
        F.lit(currency).alias("currency"),
        F.lit(None).cast("string").alias("isin"),
        F.lit(LOT_SIZE).alias("lot_size"),
        cm.to_day("list_date").alias("listed_on"),
        delisted.alias("delisted_on"),
        F.col("name").cast("string").alias("name"),
        cm.lookup(F.trim("fund_type"), INVEST_TYPES, OTHER).alias("invest_type"),
    )


def fund_ids(raw: DataFrame) -> DataFrame:
    return cm.assign_ids(listed_funds(raw))


def adjustment_factors(raw: DataFrame, ids: DataFrame) -> DataFrame:
    cm.require_columns(raw, ("ts_code", "trade_date", "adj_factor"), SOURCE)
    return map_symbols(raw, "ts_code", ids).select(
        "symbol_id", cm.to_day("trade_date").alias("ts"), *cm.numbers("adj_factor")
    )


def index_catalogue(raw: DataFrame) -> DataFrame:
    text = ("ts_code", "name", "market", "publisher", "category")
    cm.require_columns(raw, (*text, "base_date", "base_point", "list_date"), SOURCE)
    return raw.select(
        *[F.col(c).cast("string").alias(c) for c in text],
        cm.to_day("base_date").alias("base_date"),
        *cm.numbers("base_point"),
        cm.to_day("list_date").alias("list_date"),
    )


def index_bars(raw: DataFrame) -> DataFrame:
    prices = ("open", "high", "low", "close", "pre_close", "change", "pct_chg")
    cm.require_columns(raw, ("ts_code", "trade_date", *prices, "vol", "amount"), SOURCE)
    return raw.select(
        F.col("ts_code").cast("string").alias("ts_code"),
        cm.to_day("trade_date").alias("ts"),
        *cm.numbers(*prices),
        F.col("vol").cast("double").alias("volume"),
        *cm.numbers("amount"),
    )


def bars_with_headers(raw: DataFrame, ids: DataFrame, currency: str = "CNY") -> DataFrame:
    """Daily bars of the vendor with Chinese headers; its own availability time wins if present."""
    cm.require_columns(raw, tuple(HEADERS), SOURCE)
    code = CODE_HEADER if CODE_HEADER in raw.columns else "symbol"
    named = map_symbols(raw.withColumnsRenamed({**HEADERS, code: "code_"}), "code_", ids).withColumn(
        "ts", F.col("ts").cast("date")
    )
    available = cm.available_after("ts")
    if AVAILABLE_HEADER in raw.columns:
        available = cm.to_naive_utc(AVAILABLE_HEADER)
    return named.select(
        "symbol_id",
        "ts",
        *cm.numbers("open", "high", "low", "close", "volume", "amount"),
        F.lit(currency).alias("currency"),
        cm.at_hour("ts", cm.CLOSE_HOURS_CN).alias("close_utc"),
        available.alias("available_utc"),
    )


def macro_date(c: Column | str, kind: str) -> Column:
    """Observation day: the end of a yyyyMM month, of a yyyyQn quarter, or the day itself."""
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    text = F.when(~F.lower(text).isin("", "nan", "none", "nat"), text)
    if kind == "month":
        return F.last_day(F.to_date(text, "yyyyMM"))
    if kind == "quarter":
        year, quarter = F.substring_index(text, "Q", 1), F.substring_index(text, "Q", -1)
        return F.last_day(F.make_date(year.cast("int"), quarter.cast("int") * 3, F.lit(1)))
    if kind == "day":
        return F.to_date(text, "yyyyMMdd")
    raise ValueError(f"unknown macro date kind {kind!r}")


def macro_series(raws: Mapping[str, DataFrame], start: str, end: str) -> DataFrame:
    """Union of the raw series given by id, cropped to the window, without empty values."""
    parts = []
    for series_id, raw in raws.items():
        unit, value, day, kind, lag = MACRO[series_id]
        part = raw.select(
            F.lit(series_id).alias("series_id"),
            macro_date(day, kind).alias("ts"),
            F.col(f"`{value}`").cast("double").alias("value"),
            F.lit(unit).alias("unit"),
        ).withColumn("available_utc", cm.available_after("ts", lag))
        parts.append(part.where(F.col("value").isNotNull() & ~F.isnan("value")))
    return cm.crop(union_frames(parts), start, end)
