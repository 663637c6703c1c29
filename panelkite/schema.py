"""The data contract: columns, keys and enumerations of every table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values of the data contract.
COLUMNS = {
    "symbols": "symbol_id BIGINT, ticker STRING, exchange STRING, calendar STRING, currency STRING, "
    "isin STRING, lot_size INT, listed_on DATE, delisted_on DATE, name STRING, invest_type STRING",
    "bars_daily": "symbol_id BIGINT, ts DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
    "volume DOUBLE, amount DOUBLE, currency STRING, close_utc TIMESTAMP_NTZ, "
    "available_utc TIMESTAMP_NTZ, source STRING, downloaded_at TIMESTAMP_NTZ, snapshot_id STRING",
    "corporate_actions": "symbol_id BIGINT, ex_date DATE, kind STRING, ratio DOUBLE, cash DOUBLE, "
    "pay_date DATE, available_utc TIMESTAMP_NTZ, source STRING, snapshot_id STRING",
    "fx_rates": "base STRING, quote STRING, ts DATE, rate DOUBLE, available_utc TIMESTAMP_NTZ, "
    "source STRING, snapshot_id STRING",
    "trading_calendar": "exchange STRING, ts DATE, is_open BOOLEAN, session_close_utc TIMESTAMP_NTZ, "
    "source STRING",
    "macro_series": "series_id STRING, source STRING, ts DATE, value DOUBLE, unit STRING, "
    "available_utc TIMESTAMP_NTZ, snapshot_id STRING",
    "fundamentals": "symbol_id BIGINT, period_end DATE, as_of_date DATE, item STRING, value DOUBLE, "
    "available_utc TIMESTAMP_NTZ, source STRING, snapshot_id STRING",
    "ingest_runs": "snapshot_id STRING, source STRING, dataset STRING, started_at TIMESTAMP_NTZ, "
    "finished_at TIMESTAMP_NTZ, rows BIGINT, watermark DATE, file_hash STRING, status STRING, "
    "note STRING",
    "close_adj": "symbol_id BIGINT, ts DATE, close_adj DOUBLE, adj_factor DOUBLE, method STRING, "
    "available_utc TIMESTAMP_NTZ, source STRING, snapshot_id STRING",
    "run_metrics": "run_id STRING, metric STRING, value DOUBLE",
    "runs": "run_id STRING, spec_id STRING, engine STRING, origin STRING, created_at TIMESTAMP_NTZ, "
    "data_snapshot_id STRING, env_lock_hash STRING, git_sha STRING, params_json STRING, status STRING",
}

# Fixed values of the data contract: columns that may be NULL; all others must be given.
NULLABLE = {
    "symbols": ["isin", "lot_size", "listed_on", "delisted_on", "name", "invest_type"],
    "bars_daily": ["open", "high", "low", "close", "volume", "amount", "currency", "close_utc"],
    "corporate_actions": ["ratio", "cash", "pay_date"],
    "fx_rates": [],
    "trading_calendar": ["session_close_utc"],
    "macro_series": ["value", "unit"],
    "fundamentals": ["value"],
    "ingest_runs": ["finished_at", "rows", "watermark", "file_hash", "note"],
    "close_adj": ["close_adj", "adj_factor"],
    "run_metrics": [],
    "runs": [],
}

# Fixed values of the data contract: primary keys.
KEYS = {
    "symbols": ["symbol_id"],
    "bars_daily": ["symbol_id", "ts", "snapshot_id"],
    "corporate_actions": ["symbol_id", "ex_date", "kind", "snapshot_id"],
    "fx_rates": ["base", "quote", "ts", "snapshot_id"],
    "trading_calendar": ["exchange", "ts"],
    "macro_series": ["series_id", "ts", "snapshot_id"],
    "fundamentals": ["symbol_id", "period_end", "as_of_date", "item", "snapshot_id"],
    "ingest_runs": ["snapshot_id", "dataset"],
    "close_adj": ["symbol_id", "ts", "snapshot_id"],
    "run_metrics": ["run_id", "metric"],
    "runs": ["run_id"],
}

# Fixed values of the data contract: (table, column) -> (parent table, its key).
LINKS = {
    ("bars_daily", "symbol_id"): ("symbols", "symbol_id"),
    ("corporate_actions", "symbol_id"): ("symbols", "symbol_id"),
    ("fundamentals", "symbol_id"): ("symbols", "symbol_id"),
    ("close_adj", "symbol_id"): ("symbols", "symbol_id"),
    ("run_metrics", "run_id"): ("runs", "run_id"),
}

# Fixed values of the data contract: what a column may hold.
ENUMS = {
    ("symbols", "invest_type"): ["股票", "债券", "货币", "商品", "qdii", "其他"],
    ("corporate_actions", "kind"): ["dividend", "split"],
    ("ingest_runs", "status"): ["running", "ok", "failed", "partial", "aborted"],
    ("close_adj", "method"): ["fund_adj_forward", "split_forward", "none"],
    ("runs", "status"): ["ok", "failed", "partial"],
}

# Fixed values of the data contract: (table, rule) -> what breaks it, and the columns that says so.
CHECKS = {
    ("symbols", "delisted_before_listed"): ("delisted_on < listed_on", ["delisted_on", "listed_on"]),
    ("corporate_actions", "split_without_ratio"): ("kind = 'split' AND ratio IS NULL", ["kind", "ratio"]),
    ("corporate_actions", "dividend_without_cash"): ("kind = 'dividend' AND cash IS NULL", ["kind", "cash"]),
    ("fx_rates", "rate_not_positive"): ("rate <= 0", ["rate"]),
    ("trading_calendar", "closed_with_close_time"): (
        "NOT is_open AND session_close_utc IS NOT NULL",
        ["is_open", "session_close_utc"],
    ),
    ("fundamentals", "known_before_period_end"): ("as_of_date < period_end", ["as_of_date", "period_end"]),
    ("fundamentals", "available_before_known"): (
        "CAST(available_utc AS DATE) < as_of_date",
        ["available_utc", "as_of_date"],
    ),
}

AUDIT_COLUMNS = ["downloaded_at", "snapshot_id"]


def struct_of(table: str) -> StructType:
    return StructType.fromDDL(COLUMNS[table])


def columns_of(table: str) -> dict[str, str]:
    """Column -> type of a contract table; needs no session."""
    return dict(column.split() for column in COLUMNS[table].split(", "))


def required(table: str) -> list[str]:
    """Columns of a contract table that must not be NULL."""
    return [c for c in columns_of(table) if c not in NULLABLE[table]]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project to the contract columns: extras drop, absent nullable ones become NULL.

    Absent required ones become NULL as well; whoever stores the rows checks `required`.
    """
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in struct_of(table).fields
        ]
    )


def null_nan(c: Column) -> Column:
    """NaN sorts above every number in Spark, so panels carry NULL instead."""
    return F.when(~F.isnan(c), c)
