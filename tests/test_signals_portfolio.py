"""Signals, weights, fills, curves and metrics: hand answers and day-by-day walks."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkite.functions import factors as fx
from panelkite.operators import metrics as mt
from panelkite.operators import panel as pn
from panelkite.operators import portfolio as pf
from panelkite.operators import signals as sg


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_state_vector(frame):
    rows = [(1, day(i), s) for i, s in enumerate([None, 0, 1, 0, 0, -1])]
    df = frame(rows, "symbol_id BIGINT, ts DATE, sig INT").select("ts", sg.position_state("sig").alias("s"))
    assert [r.s for r in df.orderBy("ts").collect()] == [0, 0, 1, 1, 1, 0]


def test_exit_wins_and_warmup_is_null(panel_of, column):
    df = panel_of({1: [1, 2, None, 4]}).select(
        "symbol_id", "ts", sg.signal(F.col("close") > 1, F.col("close") > 3, 1).alias("sig")
    )
    assert column(df, "sig") == [None, 1, None, -1]


def test_monday_weeks_start_on_tuesday(frame):
    # 2024-01-01 is a Monday, the last day of its period
    df = frame([(day(i),) for i in range(14)], "ts DATE")
    got = sorted(r.ts for r in sg.rebalance_dates(df).collect())
    assert got == [day(0), day(1), day(8)]


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        sg.period_key("ts", "W-XYZ")


RULES = ["D", "2D", "B", "2B", "W", "2W", "W-MON", "3W-WED", "W-SAT", "M", "3M", "Q", "Q-NOV", "2Q-JAN", "Q-JUN", "Y", "Y-JUN", "2Y-MAR"]


def test_rebalance_rules_against_pandas(frame):
    every = [dt.date(2019, 10, 5) + dt.timedelta(days=i) for i in range(1200)]
    days = [d for d in every if (d.toordinal() * 7919) % 11 not in (2, 5, 6)]  # holes of up to some days
    sessions = frame([(d,) for d in days], "ts DATE").cache()
    index = pd.DatetimeIndex(days)
    series = pd.Series(index, index=index)
    for rule in RULES:
        expected = sorted(t.date() for t in series.groupby(index.to_period(rule)).min())
        assert sorted(r.ts for r in sg.rebalance_dates(sessions, rule).collect()) == expected, rule


@pytest.mark.parametrize("rule", ["", "2", "0W", "-1W", "W-", "W-XYZ", "Q-XYZ", "BM", "QS", "M-JAN", "SM", "D-MON"])
def test_unknown_rebalance_rules_are_refused(rule):
    with pytest.raises(ValueError, match="unknown rebalance rule"):
        sg.period_key("ts", rule)


def flat_panel(panel_of, symbols, n=20):
    return panel_of({s: [100 + i for i in range(n)] for s in symbols})


def test_ties_go_to_smaller_ids(panel_of):
    panel = flat_panel(panel_of, (9, 2, 5))
    weights = sg.target_weights(
        panel, panel.select("ts").distinct(), panel, score=F.lit(1.0), lookback=5, top_n=2
    )
    held = {r.symbol_id for r in weights.where("weight > 0").collect()}
    assert held == {2, 5}
    assert {r.weight for r in weights.where("weight > 0").collect()} == {0.5}


def test_infinite_score_ranks_by_id(panel_of):
    panel = flat_panel(panel_of, (1, 2, 3, 4))
    score = F.when(F.col("symbol_id") == 4, float("inf")).otherwise(F.col("symbol_id").cast("double"))
    weights = sg.target_weights(panel, panel.select("ts").distinct(), panel, score=score, lookback=5, top_n=2)
    assert {r.symbol_id for r in weights.where("weight > 0").collect()} == {1, 2}


def test_no_candidate_holds_cash(panel_of):
    panel = flat_panel(panel_of, (1, 2), 30)
    weights = sg.target_weights(panel, panel.select("ts").distinct(), panel, window=63)
    assert weights.count() > 0 and weights.where("weight <> 0").isEmpty()


def test_mid_week_cross_is_carried(panel_of):
    v = [100 - 0.3 * i for i in range(100)] + [70 + 0.3 * i for i in range(200)]
    panel = panel_of({1: v})
    fast, slow = fx.sma("close", 5, lag=1), fx.sma("close", 20, lag=1)
    weights = sg.target_weights(
        panel,
        panel.select("ts").distinct(),
        panel,
        entry=fx.cross_above(fast, slow),
        exit_=fx.cross_below(fast, slow),
        score=fx.momentum("close", 10),
        lookback=21,
    )
    held = [r.ts for r in weights.where("weight > 0").orderBy("ts").collect()]
    assert held and all(d > day(100) for d in held) and held[-1] > day(290)


def test_event_panel_and_episode(frame):
    plan = [(0, 0.0), (7, 0.5), (14, 0.5), (21, 0.0), (28, 0.4)]
    df = frame([(day(d), 1, w) for d, w in plan], "ts DATE, symbol_id BIGINT, weight DOUBLE")
    events = sg.event_panel(df)
    assert sorted(r.ts for r in events.collect()) == [day(0), day(7), day(21), day(28)]
    assert sorted(r.ts for r in sg.first_episode(events).collect()) == [day(7), day(21)]


def test_episode_without_clearing_is_empty(frame):
    df = frame([(day(0), 1, 0.5), (day(7), 1, 0.4)], "ts DATE, symbol_id BIGINT, weight DOUBLE")
    assert sg.first_episode(df).isEmpty()


def test_fills_wait_for_trading_and_are_replaced(frame):
    rows = [(1, day(i), i, t, 10.0 + i) for i, t in enumerate([True, False, True, True, False, False, True])]
    panel = frame(rows, "symbol_id BIGINT, ts DATE, idx INT, traded BOOLEAN, open DOUBLE")
    decisions = frame([(day(0), 1, 0.5), (day(3), 1, 0.2), (day(5), 1, 0.0), (day(6), 1, 1.0)], "ts DATE, symbol_id BIGINT, weight DOUBLE")
    got = {r.ts: (r.fill_ts, r.wait, r.outcome) for r in pf.fill_resolution(panel, decisions).collect()}
    assert got == {
        day(0): (day(2), 2, "deferred"),
        day(3): (None, None, "unfilled"),
        day(5): (day(6), 1, "next_session"),
        day(6): (None, None, "unfilled"),
    }


CURVES = "run_id STRING, name STRING, ts DATE, equity DOUBLE"
WEIGHTS = "run_id STRING, ts DATE, name STRING, weight DOUBLE"


def test_compose_hand_walk(frame):
    a, b = [1, 1.1, 0.99, 0.99], [1, 1, 1.2, 1.2]
    curves = frame([("r", n, day(i), float(x)) for n, xs in (("A", a), ("B", b)) for i, x in enumerate(xs)], CURVES)
    weights = frame([("r", day(0), "A", 1.0), ("r", day(2), "B", 1.0)], WEIGHTS)
    got = [r.equity for r in pf.compose(curves, weights).orderBy("ts").collect()]
    assert got == pytest.approx([1, 1.1, 1.32, 1.32])


def walk(curves, weights, n):
    """Day-by-day drift over dictionaries {name: {day: equity}} and {day: {name: weight}}."""
    nav, held, navs, used = 1.0, {}, [], []
    for t in range(n):
        if t in weights:
            held = dict(weights[t])
        ret = {
            k: c[t] / c[t - 1] - 1 if t in c and t - 1 in c else 0.0 for k, c in curves.items()
        }
        used.append(dict(held))
        total = sum(w * ret[k] for k, w in held.items())
        nav *= 1 + total
        navs.append(nav)
        held = {k: w * (1 + ret[k]) / (1 + total) for k, w in held.items()}
    return navs, used


def test_compose_matches_walk_with_gaps(frame):
    rng = np.random.default_rng(11)
    n, names = 40, ["a", "b", "c"]
    curves = {}
    for k in names:
        path = np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        curves[k] = {t: float(path[t]) for t in range(n) if not (k == "b" and t in (12, 13, 25))}
    weights = {t: {k: float(w) for k, w in zip(names, rng.dirichlet([1, 1, 1]) * 0.9)} for t in (2, 9, 21, 33)}
    navs, used = walk(curves, weights, n)
    c = frame([("r", k, day(t), v) for k, xs in curves.items() for t, v in xs.items()], CURVES)
    w = frame([("r", day(t), k, v) for t, ws in weights.items() for k, v in ws.items()], WEIGHTS)
    got = [r.equity for r in pf.compose(c, w).orderBy("ts").collect()]
    assert got == pytest.approx(navs, abs=1e-12)
    for r in pf.weights_used(c, w).collect():
        assert r.weight == pytest.approx(used[(r.ts - day(0)).days].get(r.name, 0.0), abs=1e-12)


def test_leverage_is_reported(frame):
    w = frame([("r", day(0), "a", 1.1), ("r", day(0), "b", 0.1)], WEIGHTS)
    assert pf.over_invested(w).count() == 1


def curve(frame, values, step=1):
    return frame([("r", day(i * step), float(v)) for i, v in enumerate(values)], "run_id STRING, ts DATE, equity DOUBLE")


def test_metrics(frame):
    row = mt.performance(curve(frame, [1, 1.2, 0.9, 1.1])).first()
    assert row.max_drawdown == pytest.approx(-0.25) and row.total_return == pytest.approx(0.1)
    row = mt.performance(curve(frame, [1, 1.1, 1.2, 0.9, 1.1, 1.3]), ppy=4).first()
    assert row.calmar_ratio == pytest.approx((1.3 ** (1 / 1.5) - 1) / 0.25)
    row = mt.performance(curve(frame, [1, 1.1, 1.2]), ppy=4).first()
    assert row.calmar_ratio is None
    row = mt.performance(curve(frame, [1, 1, 1])).first()
    assert row.sharpe_ratio is None and row.annualized_volatility == 0
    row = mt.performance(curve(frame, [1])).first()
    assert row.annualization_periods is None and row.annualized_return is None
    row = mt.performance(curve(frame, [1, 1.01, 0.99, 1.03], step=7)).first()
    assert row.annualization_periods == pytest.approx(4 / (21 / 365.25))


def test_turnover(frame):
    plan = {"a": [0, 1, 0], "b": [0, 0, 1]}
    dense = [("r", day(7 * i), n, float(w)) for n, ws in plan.items() for i, w in enumerate(ws)]
    ddl = "run_id STRING, ts DATE, symbol_id STRING, weight DOUBLE"
    # absent rows count as zero, so the sparse table tells the same
    sparse = [r for r in dense if r[3] or r[1] == day(0)]
    for rows in (dense, sparse):
        got = mt.turnover(frame(rows, ddl)).first()
        assert got.turnover == pytest.approx(3.0) and got.n_rebalances == 2


def test_attribution(frame):
    row = frame([(0.1, 0.2)], "l DOUBLE, f DOUBLE").select(*pf.attribute_returns("l", "f")).first()
    assert row.interaction == pytest.approx(0.02) and row.total == pytest.approx(0.32)


def test_costs(frame):
    df = frame([(0.05, 0.5)], "gross DOUBLE, traded DOUBLE")
    got = {r.bps: r.net for r in pf.cost_scenarios(df).collect()}
    assert got[0.0] == pytest.approx(0.05) and got[30.0] == pytest.approx((1 - 0.003 * 0.5) * 1.05 - 1)


def test_grid_screen_matches_loop(frame):
    rng = np.random.default_rng(2)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 150)))
    bars = frame([(1, day(i), float(v)) for i, v in enumerate(x)], "symbol_id BIGINT, ts DATE, close DOUBLE")
    for r in pf.sma_grid_screen(bars, (3, 5), (10, 20)).collect():
        nav, peak, dd, trades, was = 1.0, 1.0, 0.0, 0, False
        for t in range(len(x)):
            if was:
                nav *= x[t] / x[t - 1]
            peak = max(peak, nav)
            dd = min(dd, nav / peak - 1)
            above = t >= r.slow - 1 and x[t - r.fast + 1 : t + 1].mean() > x[t - r.slow + 1 : t + 1].mean()
            trades += above and not was
            was = above
        assert r.total_return == pytest.approx(nav - 1) and r.max_drawdown == pytest.approx(dd)
        assert r.n_trades == trades
    assert math.isfinite(nav)


def test_densify_grid(frame):
    rows = [(1, day(0), True, 1.0), (1, day(3), True, 4.0), (2, day(1), True, 2.0), (2, day(2), False, 9.0)]
    bars = frame(rows, "symbol_id BIGINT, ts DATE, traded BOOLEAN, close DOUBLE")
    got = {(r.symbol_id, r.ts): (r.idx, r.traded, r.close) for r in pn.densify(bars).collect()}
    # day 2 saw no trading anywhere and is no session
    assert got == {
        (1, day(0)): (0, True, 1.0),
        (1, day(1)): (1, False, None),
        (1, day(3)): (2, True, 4.0),
        (2, day(0)): (0, False, None),
        (2, day(1)): (1, True, 2.0),
        (2, day(3)): (2, False, None),
    }


def test_equal_weights_of_bars_and_panel(frame):
    rows = [(1, day(0), 5.0, True), (2, day(0), 6.0, True), (3, day(0), None, True), (1, day(1), 5.0, False), (2, day(1), 6.0, True)]
    bars = frame(rows, "symbol_id BIGINT, ts DATE, close DOUBLE, traded BOOLEAN")
    dates = frame([(day(0),), (day(1),)], "ts DATE")
    expected = [(day(0), 1, 0.45), (day(0), 2, 0.45), (day(1), 2, 0.9)]
    for source in (bars, pn.densify(bars)):
        got = sorted(tuple(r) for r in pf.equal_weights(source, dates, 0.1).collect())
        assert [(t, s, pytest.approx(w)) for t, s, w in expected] == got
    again = bars.unionByName(bars.where("symbol_id = 2 AND ts = DATE '2024-01-01'"))
    with pytest.raises(Exception, match="two bars on one date"):
        pf.equal_weights(again, dates).collect()
