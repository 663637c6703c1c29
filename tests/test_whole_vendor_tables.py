"""Vendor queries, wide layouts and rates over all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelkite.catalog import panels, vendors
from panelkite.operators import panel as pn
from panelkite.plans import testbed as tb
from panelkite.plans.ingest import refuse_broken
from panelkite.session import settle

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def fewer_ids(spark, monkeypatch):
    """Every second code has no id."""
    few = settle(vendors.ids(spark, SMALL).where("symbol_id % 2 = 0"), "few-ids")
    monkeypatch.setattr(vendors, "ids", lambda *_: few)


def test_rows_without_an_id_are_kept_and_stop_a_load(spark, fewer_ids):
    whole = vendors.cn_bars_whole(spark, SMALL)
    refused = vendors.unmapped_codes(spark, SMALL).agg(F.sum("rows")).first()[0]
    assert whole.where("status = 'unmapped' AND symbol_id IS NULL").count() == refused > 0
    assert whole.count() == vendors.raw_bars(spark, SMALL).count()
    with pytest.raises(ValueError, match=f"bars_daily.symbol_id is null={refused}"):
        refuse_broken({"bars_daily": whole.drop("status")})


def test_clean_and_refused_dividends_are_all(spark, fewer_ids):
    by_status = dict(vendors.dividend_dedupe_whole(spark, SMALL).groupBy("status").count().collect())
    raw = vendors.raw_dividends(spark, SMALL).where("trim(div_proc) = '实施'").select("ts_code", "ex_date").distinct()
    assert vendors.dividend_dedupe(spark, SMALL).count() == by_status["mapped"]
    assert sum(by_status.values()) == raw.count() and by_status["unmapped"] > 0


def test_every_symbol_has_its_cells(spark):
    keys = tb.bars_daily(spark, SMALL).select("ts", "symbol_id").distinct()
    cells = panels.pivot_long(spark, SMALL)
    assert cells.count() == keys.count() and keys.exceptAll(cells.select("ts", "symbol_id")).isEmpty()


def test_wide_and_long_cells_agree_beyond_eight_symbols(frame):
    rows = [(s, f"2024-01-0{d}", float(10 * s + d)) for s in range(12) for d in (1, 2)]
    bars = frame([*rows, (11, "2024-01-01", 113.0)], "symbol_id BIGINT, ts DATE, close DOUBLE")
    found = {(r.ts.day, r.symbol_id): r.close for r in pn.cells(bars).collect()}
    wide = pn.to_wide(bars, range(12)).collect()
    assert found == {(r.ts.day, s): r[str(s)] for r in wide for s in range(12)} and found[1, 11] == 112.0


def test_every_pair_has_its_series(spark):
    rates = tb.fx_rates(spark, SMALL, reverse=False).select("base", "quote", "ts", "rate")
    series = vendors.fx_series_pairs(spark, SMALL).select("base", "quote", "ts", "rate")
    assert rates.select("base").distinct().count() > 1
    assert rates.exceptAll(series).isEmpty() and series.exceptAll(rates).isEmpty()
