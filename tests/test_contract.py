"""The compiled data contract on hand-made tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkite import schema
from panelkite.operators import contract

DAY = dt.date(2024, 1, 2)
RATES = "base STRING, quote STRING, ts DATE, rate DOUBLE, available_utc TIMESTAMP_NTZ, source STRING, snapshot_id STRING"
AT = dt.datetime(2024, 1, 3)


def found(df):
    return {r.check: r.violations for r in df.collect() if r.violations}


def test_every_kind_of_rule(frame):
    rows = [
        ("USD", "CNY", DAY, 7.0, AT, "v", "s"), ("USD", "CNY", DAY, 7.1, AT, "v", "s"), ("EUR", "CNY", DAY, -1.0, AT, "v", "s"),
        ("EUR", "CNY", None, 1.0, AT, None, "s"), ("EUR", "CNY", None, 1.0, AT, "v", "s"), ("GBP", "CNY", DAY, float("nan"), AT, "v", "s"),
    ]
    assert found(contract.table_violations(frame(rows, RATES), "fx_rates")) == {
        "fx_rates.ts is null": 2, "fx_rates.source is null": 1, "fx_rates.rate is not a number": 1,
        "fx_rates.primary key": 1, "fx_rates.rate_not_positive": 1,
    }


def test_absent_columns_and_no_rows(frame):
    rates = frame([("USD", 7.0)], "base STRING, rate DOUBLE")
    report = found(contract.table_violations(rates, "fx_rates"))
    assert report == {f"fx_rates.{c} is absent": 1 for c in ("quote", "ts", "available_utc", "source", "snapshot_id")}
    assert found(contract.table_violations(frame([], RATES), "fx_rates")) == {}
    assert contract.table_violations(frame([(1,)], "x INT"), "runs").where("violations > 0").count() == 10


def test_links_meet_their_parent_once(frame):
    symbols = frame([(1,), (2,), (None,)], "symbol_id BIGINT")
    children = {t: frame([(1,), (3,), (3,), (None,)], "symbol_id BIGINT") for t in ("bars_daily", "close_adj")}
    links = contract.link_violations({"symbols": symbols, **children})
    assert {r.check: r.violations for r in links.collect()} == {
        "bars_daily.symbol_id in symbols": 2, "close_adj.symbol_id in symbols": 2
    }
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert contract.link_violations({"symbols": symbols}) is None


def test_unknown_tables_and_broken_ones_are_refused(frame):
    runs = frame([("r", "lost")], "run_id STRING, status STRING")
    with pytest.raises(ValueError, match="not tables of the contract"):
        contract.contract_violations({"run": runs})
    with pytest.raises(ValueError, match="runs.status=1"):
        contract.refuse({"runs": runs})
    whole = runs.withColumns({c: F.lit("x") for c in schema.columns_of("runs") if c not in runs.columns})
    contract.refuse({"runs": whole.withColumn("status", F.lit("ok"))})


def test_the_rules_are_those_of_the_contract():
    assert set(schema.KEYS) == set(schema.COLUMNS) == set(schema.NULLABLE)
    for table, keys in schema.KEYS.items():
        assert set(keys) <= set(schema.required(table))
    for table, column in [*schema.ENUMS, *schema.LINKS]:
        assert column in schema.columns_of(table)
    for (table, _), (_, columns) in schema.CHECKS.items():
        assert set(columns) <= set(schema.columns_of(table))
