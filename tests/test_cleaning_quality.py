"""Adjustment hand answers, currency direction and one injected defect per rule."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkite.operators import cleaning as cl
from panelkite.operators import constraints as ct
from panelkite.operators import joins as jn
from panelkite.operators import panel as pn
from panelkite.operators import quality as qc

BARS = "symbol_id BIGINT, ts DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, snapshot_id STRING, seq BIGINT"
ACTIONS = "symbol_id BIGINT, ex_date DATE, kind STRING, ratio DOUBLE, cash DOUBLE"
FX = "base STRING, quote STRING, ts DATE, rate DOUBLE"


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def closes(frame, values, symbol=1):
    rows = [(symbol, day(i), v, v, v, v, "s", i) for i, v in enumerate(map(float, values))]
    return frame(rows, BARS)


@pytest.mark.parametrize("method, want", [("forward", [400, 400, 440]), ("backward", [100, 100, 110])])
def test_split_adjustment(frame, method, want):
    actions = frame([(1, day(1), "split", 4.0, None)], ACTIONS)
    out = cl.adjust_prices(closes(frame, [400, 100, 110]), actions, method)
    assert [r.close_adj for r in out.orderBy("ts").collect()] == pytest.approx(want)


def test_split_between_sessions_counts(frame):
    bars = closes(frame, [400, 100, 110]).where(F.col("ts") != day(1))
    actions = frame([(1, day(1), "split", 4.0, None)], ACTIONS)
    out = cl.adjust_prices(bars, actions, "forward")
    assert [r.close_adj for r in out.orderBy("ts").collect()] == pytest.approx([400, 440])


def test_factor_adjustment(frame):
    factors = frame([(1, day(0), 1.0), (1, day(1), 1.1), (1, day(2), 1.05)], "symbol_id BIGINT, ts DATE, adj_factor DOUBLE")
    out = cl.forward_adjust_close(closes(frame, [100, 110, 105]), factors=factors)
    assert [r.close_adj for r in out.orderBy("ts").collect()] == pytest.approx([100, 121, 110.25])
    zero = factors.withColumn("adj_factor", F.when(F.col("ts") == day(0), 0.0).otherwise(F.col("adj_factor")))
    out = cl.forward_adjust_close(closes(frame, [100, 110, 105]), factors=zero)
    assert [r.close_adj for r in out.orderBy("ts").collect()] == pytest.approx([100, 110, 105])


def test_no_actions_leaves_prices(frame):
    out = cl.forward_adjust_close(closes(frame, [3, 4]))
    assert [r.close_adj for r in out.orderBy("ts").collect()] == [3, 4]


def test_total_return(frame):
    actions = frame([(1, day(1), "split", 4.0, None), (1, day(2), "dividend", None, 1.0)], ACTIONS)
    out = cl.total_return_index(closes(frame, [400, 100, 109]), actions)
    assert [r.total_return_nav for r in out.orderBy("ts").collect()] == pytest.approx([1, 1, 1.1])


def test_fx_direction_prefers_base_currency(frame):
    rows = [("CNY", "USD", day(i), 0.14) for i in range(3)] + [("USD", "CNY", day(5), 7.0)]
    fx = frame(rows + [("EUR", "JPY", day(0), 160.0)], FX)
    out = cl.normalize_fx_direction(fx)
    assert out.where("base = 'CNY'").isEmpty()
    assert [r.rate for r in out.where("base = 'USD'").orderBy("ts").collect()] == pytest.approx([1 / 0.14] * 3 + [7.0])
    log = {(r.base, r.quote): r.action for r in cl.fx_direction_log(fx).collect()}
    assert log == {("USD", "CNY"): "inverted", ("EUR", "JPY"): "kept", ("CNY", "CNY"): "kept"}


def test_fx_collision_is_listed(frame):
    fx = frame([("USD", "CNY", day(0), 7.0), ("CNY", "USD", day(0), 0.14), ("CNY", "USD", day(1), 0.14)], FX)
    assert [r.ts for r in cl.fx_collisions(fx).collect()] == [day(0)]
    with pytest.raises(Exception, match="quoted both ways on one date"):
        cl.normalize_fx_direction(fx).collect()
    apart = fx.where(F.col("ts") != day(0)).unionByName(frame([("USD", "CNY", day(2), 7.0)], FX))
    assert {(r.base, r.ts) for r in cl.normalize_fx_direction(apart).collect()} == {("USD", day(1)), ("USD", day(2))}


def test_four_session_states(frame):
    bars = frame([(1, day(0), True), (1, day(1), False), (1, day(4), True)], "symbol_id BIGINT, ts DATE, traded BOOLEAN")
    symbols = frame([(1, "X")], "symbol_id BIGINT, exchange STRING")
    calendar = frame([("X", day(i), i != 3) for i in range(5)] + [("Y", day(3), True)], "exchange STRING, ts DATE, is_open BOOLEAN")
    got = [r.status for r in pn.session_status(bars, symbols, calendar).orderBy("ts").collect()]
    assert got == ["traded", "halted", "missing", "closed", "traded"]


def test_clean_bars_pass(frame):
    report = qc.run_all_checks(closes(frame, [100 + i % 3 for i in range(80)]), "seq")
    assert qc.failed_checks(report) == []
    qc.assert_clean(report)
    skipped = report.where("detail LIKE '%skipped%'").count()
    assert skipped == 3


def broken(frame, **change):
    bars = closes(frame, [100 + i % 3 for i in range(80)])
    at = F.col("ts") == day(40)
    for name, value in change.items():
        bars = bars.withColumn(name, F.when(at, value).otherwise(F.col(name)))
    return bars


@pytest.mark.parametrize(
    "check, change",
    [
        ("positive_prices", {"low": F.lit}),
        ("ohlc_relations", {"high": F.lit}),
        ("price_jumps", {"close": F.lit}),
    ],
)
def test_injected_price_defects(frame, check, change):
    value = {"positive_prices": 0.0, "ohlc_relations": 1.0, "price_jumps": 300.0}[check]
    bars = broken(frame, **{name: make(value) for name, make in change.items()})
    assert check in qc.failed_checks(qc.run_all_checks(bars, "seq"))


def test_duplicates_count_every_row(frame):
    bars = closes(frame, [1, 2, 3])
    row = qc.check_unique_keys(bars.unionByName(bars.where(F.col("ts") == day(1)))).first()
    assert row.violations == 2 and row.samples == ["1|2024-01-02|s"]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_unsorted_symbols_in_blocks(frame, block):
    falls = [(1, day(d), i) for i, d in enumerate([0, 1, 2, 3, 4, 2, 6, 7])]
    level = [(2, day(d), 100 + i) for i, d in enumerate([0, 1, 1, 1, 4, 5])]
    df = frame(falls + level, "symbol_id BIGINT, ts DATE, seq BIGINT")
    assert [r.symbol_id for r in qc.unsorted_symbols(df, "seq", block).collect()] == [1]


def test_jump_does_not_hide_itself(frame):
    """The day under test is not part of its own volatility."""
    rng = np.random.default_rng(4)
    x = list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 70))))
    x[65:] = [v * 1.5 for v in x[65:]]
    hits = qc.price_jumps(closes(frame, x)).collect()
    assert [r.ts for r in hits] == [day(65)]
    assert qc.price_jumps(closes(frame, x[:61])).isEmpty()


def test_calendar_gap_uses_own_exchange(frame):
    bars = frame([(1, day(0)), (1, day(3)), (2, day(0)), (2, day(3))], "symbol_id BIGINT, ts DATE")
    symbols = frame([(1, "X"), (2, "Y")], "symbol_id BIGINT, exchange STRING")
    rows = [(e, day(i), not (e == "Y" and i == 2)) for e in "XY" for i in range(4)]
    calendar = frame(rows, "exchange STRING, ts DATE, is_open BOOLEAN")
    got = {(r.symbol_id, r.ts) for r in qc.calendar_gaps(bars, symbols, calendar).collect()}
    assert got == {(1, day(1)), (1, day(2)), (2, day(1))}


def test_fx_rules(frame):
    flat = [("A", "B", day(i), 1.0 if i < 11 else 2.0) for i in range(14)]
    assert qc.stale_pairs(frame(flat, FX)).first().longest_flat_run == 11
    assert qc.stale_pairs(frame(flat[1:], FX)).isEmpty()
    bad = frame([("A", "B", day(0), 2.0), ("B", "A", day(0), 0.6), ("A", "C", day(0), -1.0)], FX)
    got = {(r.issue, r.pair, r.rows) for r in qc.fx_direction_issues(bad).collect()}
    assert got == {
        ("non_positive_rate", "", 1),
        ("inconsistent_direction", "A/B", 1),
        ("inconsistent_direction", "B/A", 1),
    }


def test_missing_contract_column_is_an_error(frame):
    with pytest.raises(ValueError, match="rate"):
        ct.validate_normalized(frame([("A", "B", day(0))], "base STRING, quote STRING, ts DATE"), "fx_rates")


def test_weight_rules(frame):
    w = frame([(day(0), 1, 0.7), (day(0), 2, 0.5), (day(1), 1, -0.1)], "ts DATE, symbol_id BIGINT, weight DOUBLE")
    got = {r.check: r.violations for r in ct.weight_violations(w, as_of="2024-01-01").collect()}
    assert got == {"row_sum": 1, "negative_weight": 1, "after_as_of": 1}
    short = {r.check: r.violations for r in ct.weight_violations(w, allow_short=True).collect()}
    assert short == {"row_sum": 1}


@pytest.mark.parametrize("block", ["day", "month", "year"])
def test_asof_join_matches_brute_force(frame, block):
    rng = np.random.default_rng(8)
    base = dt.datetime(2024, 1, 1)
    known = [("k%d" % (i % 2), base + dt.timedelta(hours=int(h)), float(i), i) for i, h in enumerate(rng.integers(0, 2400, 60))]
    probes = [("k%d" % (i % 3), base + dt.timedelta(hours=int(h)), i) for i, h in enumerate(rng.integers(0, 2600, 90))]
    right = frame(known, "k STRING, av TIMESTAMP_NTZ, v DOUBLE, n INT")
    left = frame(probes, "k STRING, t TIMESTAMP_NTZ, i INT")
    got = {r.i: r.v for r in jn.asof_join(left, right, ["k"], "t", "av", ["v"], latest_by="n", block=block).collect()}
    for k, t, i in probes:
        seen = [(av, n, v) for kk, av, v, n in known if kk == k and av <= t]
        assert got[i] == (max(seen)[2] if seen else None)


def test_asof_join_edges(frame):
    """Updates of one time at the end of a block, keys and times that are not known, clashing names."""
    jan, feb = dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 3)
    known = [("a", jan, 1.0, 1), ("a", jan, 3.0, 3), ("a", jan, 2.0, 2), ("a", jan, 9.0, None), (None, jan, 7.0, 1), ("b", None, 8.0, 1)]
    right = frame(known, "k STRING, av TIMESTAMP_NTZ, v DOUBLE, n INT")
    probes = [("a", feb, 1), ("a", feb, 1), (None, feb, 2), ("b", feb, 3), ("a", None, 4), ("a", jan, 5)]
    left = frame(probes, "k STRING, t TIMESTAMP_NTZ, n INT").withColumn("_b", F.lit("mine"))
    out = jn.asof_join(left, right, ["k"], "t", "av", ["v"], latest_by="n")
    assert out.columns == ["k", "t", "n", "_b", "v"]
    got = sorted((r.n, r.v) for r in out.collect() if r.v is not None)
    assert got == [(1, 3.0), (1, 3.0), (5, 3.0)] and out.count() == 6
    assert jn.asof_join(left, right.limit(0), ["k"], "t", "av", ["v"], latest_by="n").where("v IS NOT NULL").isEmpty()


def test_next_session(frame):
    sessions = frame([(day(0),), (day(3),)], "ts DATE")
    got = {r.ts: r.next_ts for r in jn.next_session(frame([(day(-1),), (day(0),), (day(1),), (day(3),)], "ts DATE"), sessions).collect()}
    assert got == {day(-1): day(0), day(0): day(3), day(1): day(3), day(3): None}


def test_convert_never_uses_later_rates(frame):
    curves = frame([("r", day(i), 100.0 + 10 * i, "USD") for i in range(3)], "run_id STRING, ts DATE, equity DOUBLE, currency STRING")
    fx = frame([("USD", "CNY", day(i), 7.0 + i) for i in range(3)], FX).withColumn(
        "available_utc", F.date_add("ts", 1).cast("timestamp_ntz")
    )
    rows = cl.convert_curves(curves, fx).orderBy("ts").collect()
    assert [r.rate for r in rows] == [None, 7.0, 8.0]
    assert rows[2].total == pytest.approx((120 / 110) * (8 / 7) - 1)


def test_jump_sigma_matches_pandas(frame):
    rng = np.random.default_rng(9)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.05, 120)))
    r = pd.Series(np.diff(np.log(x)))
    sigma = r.rolling(60, min_periods=20).std().shift(1)
    want = {day(i + 1) for i in range(len(r)) if abs(r[i]) > 0.05 and abs(r[i]) > 1.2 * sigma[i]}
    got = qc.price_jumps(closes(frame, x), sigma=1.2, floor=0.05)
    assert {row.ts for row in got.collect()} == want and not math.isnan(sigma.iloc[-1])
