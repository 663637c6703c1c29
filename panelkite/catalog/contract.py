"""The data contract over all of its tables, filled from the given data and spoiled by rule.

Table expressions are plain SQL that both engines read, so a table is written down once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite import schema
from panelkite.catalog.registry import query
from panelkite.operators import contract
from panelkite.plans import testbed as tb

LINE = "l_orderkey * 8 + l_linenumber"
DAY = "CAST(l_shipdate AS DATE)"
UNIT = "l_extendedprice / l_quantity"
LISTED = "DATE '1995-01-01' + CAST(s_suppkey % 400 AS INT)"

#: Contract table -> (given table, number of a row, column expressions).
FILLED = {
    "symbols": ("supplier", "s_suppkey", {
        "symbol_id": "s_suppkey", "ticker": "s_name", "exchange": "'X' || (s_suppkey % 3)", "calendar": "'K' || s_nationkey",
        "currency": "'C' || s_nationkey", "isin": "s_name", "lot_size": "CAST(s_nationkey AS INT)", "listed_on": LISTED,
        "delisted_on": f"CASE WHEN s_suppkey % 7 = 3 THEN {LISTED} - 1 WHEN s_suppkey % 7 = 4 THEN {LISTED} + 900 END",
        "name": "s_name", "invest_type": "CASE WHEN s_acctbal < 0 THEN 'unknown' WHEN s_acctbal < 5000 THEN '股票' END",
    }),
    "bars_daily": ("lineitem", LINE, {
        "symbol_id": "l_suppkey", "ts": DAY, "open": UNIT, "high": UNIT, "low": UNIT, "close": UNIT,
        "volume": "l_quantity", "amount": "l_extendedprice", "currency": "l_returnflag", "close_utc": "l_shipdate",
        "available_utc": "l_shipdate", "source": "l_returnflag", "downloaded_at": "l_shipdate",
        "snapshot_id": "'s' || l_linestatus",
    }),
    "corporate_actions": ("lineitem", LINE, {
        "symbol_id": "l_suppkey", "ex_date": DAY,
        "kind": "CASE WHEN l_linenumber < 4 THEN 'dividend' WHEN l_linenumber < 7 THEN 'split' ELSE 'merger' END",
        "ratio": "CASE WHEN l_quantity < 45 THEN 2.0e0 END", "cash": "CASE WHEN l_quantity > 5 THEN l_tax END",
        "pay_date": DAY, "available_utc": "l_shipdate", "source": "l_returnflag", "snapshot_id": "'s' || l_linestatus",
    }),
    "fx_rates": ("events", "event_id", {
        "base": "event_type", "quote": "'C' || (user_id % 3)", "ts": "CAST(ts AS DATE)", "rate": "value - 20",
        "available_utc": "ts", "source": "event_type", "snapshot_id": "'s' || (user_id % 5)",
    }),
    "trading_calendar": ("orders", "o_orderkey", {
        "exchange": "o_orderpriority", "ts": "CAST(o_orderdate AS DATE)", "is_open": "o_orderstatus = 'O'",
        "session_close_utc": "CASE WHEN o_totalprice > 50000 THEN o_orderdate END", "source": "o_orderstatus",
    }),
    "macro_series": ("events", "event_id", {
        "series_id": "event_type", "source": "event_type", "ts": "CAST(ts AS DATE)", "value": "value", "unit": "event_type",
        "available_utc": "ts", "snapshot_id": "'s' || (user_id % 5)",
    }),
    "fundamentals": ("orders", "o_orderkey", {
        "symbol_id": "o_custkey", "period_end": "CAST(o_orderdate AS DATE)",
        "as_of_date": "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 - 2 AS INT)", "item": "o_orderpriority",
        "value": "o_totalprice", "available_utc": "o_orderdate", "source": "o_orderstatus", "snapshot_id": "o_orderstatus",
    }),
    "ingest_runs": ("orders", "o_orderkey", {
        "snapshot_id": "'s' || o_custkey", "source": "o_orderstatus", "dataset": "o_orderpriority",
        "started_at": "o_orderdate", "finished_at": "o_orderdate", "rows": "o_custkey", "watermark": "CAST(o_orderdate AS DATE)",
        "file_hash": "o_orderstatus",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'running' ELSE 'lost' END", "note": "o_orderstatus",
    }),
    "close_adj": ("lineitem", LINE, {
        "symbol_id": "l_suppkey", "ts": DAY, "close_adj": UNIT, "adj_factor": "1 + l_tax",
        "method": "CASE l_returnflag WHEN 'A' THEN 'none' WHEN 'N' THEN 'split_forward' ELSE 'other' END",
        "available_utc": "l_shipdate", "source": "l_returnflag", "snapshot_id": "'s' || l_linestatus",
    }),
    "run_metrics": ("orders", "o_orderkey", {
        "run_id": "'r' || o_custkey", "metric": "o_orderpriority", "value": "o_totalprice",
    }),
    "runs": ("customer", "c_custkey", {
        "run_id": "'r' || c_custkey", "spec_id": "c_name", "engine": "c_mktsegment", "origin": "c_mktsegment",
        "created_at": "TIMESTAMP '2000-01-01 00:00:00'", "data_snapshot_id": "'s' || c_nationkey", "env_lock_hash": "c_name",
        "git_sha": "c_name", "params_json": "c_mktsegment", "status": "CASE WHEN c_acctbal < 0 THEN 'lost' ELSE 'ok' END",
    }),
}

#: Of this many rows one loses a required column; one of the next number holds no number.
EVERY_NULL, EVERY_NAN = 41, 43


def doubles(table: str) -> list[str]:
    return [c for c, kind in schema.columns_of(table).items() if kind == "DOUBLE"]


def spoiled_columns(table: str) -> tuple[str, str, list[str]]:
    """Given table, row number and select list; each rule of the contract is broken by some rows."""
    source, number, columns = FILLED[table]
    required = schema.required(table)
    out = []
    for name, value in columns.items():
        if name in doubles(table):
            at = doubles(table).index(name)
            value = f"CASE WHEN ({number}) % {EVERY_NAN} = {at} THEN CAST('NaN' AS DOUBLE) ELSE {value} END"
        if name in required:
            value = f"CASE WHEN ({number}) % {EVERY_NULL} = {required.index(name)} THEN NULL ELSE {value} END"
        out.append(f'{value} AS {name}')
    return source, number, out


def contract_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = {}
    for table in FILLED:
        source, number, columns = spoiled_columns(table)
        rows = tb.table(spark, sf_dir, source)
        again = rows.where(f"({number}) % {EVERY_NULL} = {EVERY_NULL - 1}")
        tables[table] = rows.unionByName(again).selectExpr(*columns)
    return tables


def table_sql(table: str) -> str:
    source, number, columns = spoiled_columns(table)
    again = f"SELECT * FROM {source} UNION ALL SELECT * FROM {source} WHERE ({number}) % {EVERY_NULL} = {EVERY_NULL - 1}"
    return f"c_{table} AS MATERIALIZED (SELECT {', '.join(columns)} FROM ({again}))"


def rules_sql() -> list[tuple[str, str]]:
    """(check, SELECT count) for every rule, written out table by table."""
    rules = []
    for table in FILLED:
        t = f"c_{table}"
        rules += [(f"{c} is null", f"SELECT count(*) FROM {t} WHERE {c} IS NULL", table) for c in schema.required(table)]
        rules += [(f"{c} is not a number", f"SELECT count(*) FROM {t} WHERE isnan({c})", table) for c in doubles(table)]
        keys = schema.KEYS[table]
        given = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        distinct = f"SELECT count(*) - count(DISTINCT ({', '.join(keys)})) FROM {t} WHERE {given}"
        rules.append((contract.KEY_RULE, distinct, table))
        for (of, column), members in schema.ENUMS.items():
            if of == table:
                listed = ", ".join(f"'{m}'" for m in members)
                rules.append((column, f"SELECT count(*) FROM {t} WHERE {column} NOT IN ({listed})", table))
        for (of, rule), (broken, _) in schema.CHECKS.items():
            if of == table:
                rules.append((rule, f"SELECT count(*) FROM {t} WHERE {broken}", table))
    named = [(f"{table}.{rule}", sql) for rule, sql, table in rules]
    for (child, column), (parent, key) in schema.LINKS.items():
        orphan = f"SELECT count(*) FROM c_{child} c WHERE c.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c_{parent} p WHERE p.{key} = c.{column})"
        named.append((f"{child}.{column} in {parent}", orphan))
    return named


def contract_sql() -> str:
    tables = ",\n".join(table_sql(t) for t in FILLED)
    rules = "\nUNION ALL ".join(
        f'SELECT \'{name}\' AS "check", CAST(({sql}) AS BIGINT) AS violations' for name, sql in rules_sql()
    )
    return f"WITH {tables}\n{rules}"


@query("dq_contract", contract_sql())
def dq_contract(spark, sf_dir):
    """Every rule of all eleven contract tables, each broken by some rows of the given data."""
    return contract.contract_violations(contract_tables(spark, sf_dir))


@query(
    "dq_contract_sound",
    "WITH " + ",\n".join(
        f"s_{t} AS (SELECT {', '.join(f'{v} AS {c}' for c, v in FILLED[t][2].items())} FROM {FILLED[t][0]})" for t in ("runs", "run_metrics")
    ) + """
SELECT "check", CAST(violations AS BIGINT) AS violations FROM (
  SELECT 'runs.primary key' AS "check", count(*) - count(DISTINCT run_id) AS violations FROM s_runs
  UNION ALL SELECT 'run_metrics.primary key', count(*) - count(DISTINCT (run_id, metric)) FROM s_run_metrics
  UNION ALL SELECT 'runs.status', count(*) FROM s_runs WHERE status NOT IN ('ok', 'failed', 'partial')
  UNION ALL SELECT 'run_metrics.run_id in runs', count(*) FROM s_run_metrics WHERE run_id NOT IN (SELECT run_id FROM s_runs))
WHERE violations > 0""",
)
def dq_contract_sound(spark, sf_dir):
    """The run tables as they are given: rules that hold stay out of the list."""
    tables = {t: tb.table(spark, sf_dir, FILLED[t][0]).selectExpr(*[f"{v} AS {c}" for c, v in FILLED[t][2].items()]) for t in ("runs", "run_metrics")}
    return contract.contract_violations(tables).where(F.col("violations") > 0)
