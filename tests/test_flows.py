"""Ingest: gate, idempotence, recovery. Strategy: curve against a walk."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkite.functions import crosssection, recursive
from panelkite.functions import factors as fx
from panelkite.functions import rules as rl
from panelkite.operators import panel as pn
from panelkite.plans import ingest as ig
from panelkite.plans import strategy as st

TIMES = ("2024-02-01 00:00:00", "2024-02-01 00:05:00")


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


@pytest.fixture
def tables(frame):
    rows = [(1, day(i), 10.0, 11.0, 9.0, 10.5, dt.datetime(2024, 3, 1)) for i in range(5)]
    bars = frame(rows, "symbol_id BIGINT, ts DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, available_utc TIMESTAMP_NTZ")
    rates = frame([("USD", "CNY", day(0), 7.0)], "base STRING, quote STRING, ts DATE, rate DOUBLE")
    return {"bars_daily": bars, "fx_rates": rates.withColumn("available_utc", F.col("ts").cast("timestamp_ntz"))}


def states(spark, root):
    return {(r.dataset, r.status) for r in ig.status_of(spark, root).collect()}


def test_ingest_is_idempotent(spark, tables, tmp_path):
    root = str(tmp_path)
    assert ig.status_of(spark, root).isEmpty()
    first = ig.ingest(tables, "v", root, *TIMES)
    again = ig.ingest(tables, "v", root, *TIMES)
    assert first.status == "ok" and again.status == "exists" and first.snapshot_id == again.snapshot_id
    assert states(spark, root) == {("bars_daily", "ok"), ("fx_rates", "ok")}
    assert spark.read.parquet(f"{root}/_ledger").count() == 2
    changed = {**tables, "fx_rates": tables["fx_rates"].withColumn("rate", F.lit(7.1))}
    assert ig.ingest(changed, "v", root, *TIMES).snapshot_id != first.snapshot_id


def test_broken_tables_leave_no_trace(spark, tables, tmp_path):
    bad = {**tables, "bars_daily": tables["bars_daily"].withColumn("low", F.lit(-1.0))}
    with pytest.raises(ValueError, match="bars_nonpositive_low=5"):
        ig.ingest(bad, "v", str(tmp_path), *TIMES)
    assert ig.status_of(spark, str(tmp_path)).isEmpty()


def test_failed_write_is_recorded(spark, tables, tmp_path, monkeypatch):
    def fail(*_):
        raise OSError("disk")

    monkeypatch.setattr(ig, "write_table", fail)
    with pytest.raises(OSError):
        ig.ingest(tables, "v", str(tmp_path), *TIMES)
    assert {s for _, s in states(spark, str(tmp_path))} == {"aborted"}
    monkeypatch.undo()
    assert ig.ingest(tables, "v", str(tmp_path), *TIMES).status == "ok"


@pytest.mark.parametrize("cut", ["one table", "no data file", "wrong rows", "no ledger"])
def test_cut_short_ingest_is_repeated(spark, tables, tmp_path, cut):
    root = str(tmp_path / "root")
    name = ig.ingest(tables, "v", str(tmp_path / "other"), *TIMES).snapshot_id
    bars = tables["bars_daily"]
    if cut == "no data file":
        (tmp_path / "root" / "bars_daily" / f"snapshot_id={name}" / "_temporary").mkdir(parents=True)
    else:
        ig.write_table(ig.stamp(bars if cut != "wrong rows" else bars.limit(2), "v", name, TIMES[0]), root, "bars_daily", name)
    if cut == "no ledger":
        ig.write_table(ig.stamp(tables["fx_rates"], "v", name), root, "fx_rates", name)
    for status in ("ok", "exists"):
        assert ig.ingest(tables, "v", root, *TIMES) == ig.IngestResult(name, status)
    assert states(spark, root) == {("bars_daily", "ok"), ("fx_rates", "ok")}
    assert sorted((r.dataset, r["rows"]) for r in ig.ledger_of(spark, root).collect()) == [("bars_daily", 5), ("fx_rates", 1)]
    assert ig.read_table(spark, root, "bars_daily", name).count() == 5


@pytest.mark.parametrize("table, column, value, said", [
    ("bars_daily", "symbol_id", "CAST(NULL AS BIGINT)", "bars_daily.symbol_id is null=5"),
    ("bars_daily", "available_utc", "CAST(NULL AS TIMESTAMP_NTZ)", "bars_daily.available_utc is null=5"),
    ("bars_daily", "close", "CAST('NaN' AS DOUBLE)", "bars_daily.close is not a number=5"),
    ("fx_rates", "rate", "-1.0D", "fx_rates.rate_not_positive=1"),
])
def test_the_gate_fails_closed(spark, tables, tmp_path, table, column, value, said):
    bad = {**tables, table: tables[table].withColumn(column, F.expr(value))}
    with pytest.raises(ValueError, match=said):
        ig.ingest(bad, "v", str(tmp_path), *TIMES)
    assert ig.ledger_of(spark, str(tmp_path)).isEmpty()


def test_rates_quoted_both_ways_are_refused(spark, tables, tmp_path, frame):
    both = frame([("CNY", "USD", day(0), 0.14), ("USD", "CNY", day(0), 7.0)], "base STRING, quote STRING, ts DATE, rate DOUBLE")
    both = both.withColumn("available_utc", F.col("ts").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="quoted both ways=1"):
        ig.ingest({**tables, "fx_rates": both}, "v", str(tmp_path), *TIMES)


def test_tables_without_a_required_column_are_refused(spark, tables, tmp_path):
    late = {**tables, "fx_rates": tables["fx_rates"].drop("available_utc")}
    with pytest.raises(ValueError, match="lacks the required columns"):
        ig.ingest(late, "v", str(tmp_path), *TIMES)
    assert ig.status_of(spark, str(tmp_path)).isEmpty()


def test_leverage_is_refused(frame):
    curves = frame([("r", "a", day(i), 1.0 + i) for i in range(3)], "run_id STRING, name STRING, ts DATE, equity DOUBLE")
    weights = frame([("r", day(0), "a", 3.0)], "run_id STRING, ts DATE, name STRING, weight DOUBLE")
    with pytest.raises(Exception, match="add up to too much"):
        st.pf.compose(curves, weights).collect()


def test_gross_leverage_is_refused(frame):
    """Long and short weights do not cancel: 2 and -1 are 3 times the portfolio."""
    curves = frame([("r", n, day(i), 1.0 + i) for i in range(3) for n in "ab"], "run_id STRING, name STRING, ts DATE, equity DOUBLE")
    ddl = "run_id STRING, ts DATE, name STRING, weight DOUBLE"
    with pytest.raises(Exception, match="add up to too much"):
        st.pf.compose(curves, frame([("r", day(0), "a", 2.0), ("r", day(0), "b", -1.0)], ddl)).collect()
    fine = frame([("r", day(0), "a", 0.6), ("r", day(0), "b", -0.4)], ddl)
    assert [r.equity for r in st.pf.compose(curves, fine).orderBy("ts").collect()] == pytest.approx([1.0, 1.2, 1.4])


def test_odd_bars_of_a_panel(frame):
    ddl = "symbol_id BIGINT, ts DATE, open DOUBLE, close DOUBLE, traded BOOLEAN"
    rows = [(1, day(0), 1.0, 1.0, True), (1, day(2), 2.0, 2.0, True), (2, day(1), 9.0, 9.0, False)]
    got = {(r.symbol_id, r.ts): r.close for r in pn.densify(frame(rows, ddl)).collect()}
    assert got == {(1, day(0)): 1.0, (1, day(2)): 2.0, (2, day(0)): None, (2, day(2)): None}
    for twice in (rows[:1] * 2, rows[1:2] * 2):
        with pytest.raises(Exception, match="two bars on one date"):
            pn.densify(frame(rows + twice, ddl)).collect()


def test_strategy_holds_the_winner(frame):
    n = 60
    rows = [
        (s, day(i), 100 * g**i, 100 * g**i, True)
        for s, g in ((1, 1.01), (2, 1.02), (3, 0.99))
        for i in range(n)
    ]
    bars = frame(rows, "symbol_id BIGINT, ts DATE, open DOUBLE, close DOUBLE, traded BOOLEAN")
    out = st.run_strategy(bars, score=fx.momentum("close", 5), lookback=5, top_n=1)
    held = {r.symbol_id for r in out["weights"].where("weight > 0").collect()}
    assert held == {2}
    start = out["weights"].where("weight > 0").agg(F.min("ts")).first()[0]
    equity = {r.ts: r.equity for r in out["equity"].collect()}
    assert equity[start] == pytest.approx(1.0)
    last = day(n - 1)
    assert equity[last] == pytest.approx(1.02 ** (last - start).days)
    assert out["metrics"].first().n_rebalances == 1
    assert out["fills"].where("outcome = 'deferred'").isEmpty()


def test_factors_and_universe_of_a_strategy(frame):
    rows = [(s, day(i), 100 * g**i, 100 * g**i, True) for s, g in ((1, 1.01), (2, 1.02), (3, 1.03)) for i in range(40)]
    bars = frame(rows, "symbol_id BIGINT, ts DATE, open DOUBLE, close DOUBLE, traded BOOLEAN")
    some = frame([(1,), (2,)], "symbol_id BIGINT")
    factors = [
        lambda p: recursive.ema(p, "close", 3, out="fast"),
        lambda p: recursive.ema(p, "close", 9, out="slow"),
        lambda p: crosssection.cross_sectional_rank(p, "fast", out="place"),
    ]
    rules = {"entry": F.col("fast") > F.col("slow"), "score": -F.col("place"), "lookback": 9, "top_n": 1}
    out = st.run_strategy(bars, factors=factors, universe=some, **rules)
    assert {r.symbol_id for r in out["weights"].where("weight > 0").collect()} == {2}
    with pytest.raises(ValueError, match="without bars"):
        st.run_strategy(bars, universe=frame([(9,)], "symbol_id BIGINT"), **rules)
    with pytest.raises(ValueError, match="look-back"):
        st.run_strategy(bars, factors=factors)


def test_look_back_follows_from_the_rules(frame):
    rows = [(s, day(i), 100 * g**i, 100 * g**i, True) for s, g in ((1, 1.01), (2, 1.02), (3, 1.03)) for i in range(40)]
    bars = frame(rows, "symbol_id BIGINT, ts DATE, open DOUBLE, close DOUBLE, traded BOOLEAN")
    fast, slow = rl.ema(rl.close(), 3), rl.ema(rl.close(), 9)
    rules = {"entry": rl.gt(fast, slow), "exit_": rl.lt(fast, slow), "score": rl.rank(fast, ascending=True)}
    assert rl.longest(*rules.values()) == 9
    assert rl.prepare(pn.densify(bars), *rules.values()).columns[-3:] == [
        x.steps[-1].name for x in (fast, slow, rules["score"])
    ]
    derived = st.run_strategy(bars, top_n=1, **rules)["weights"]
    stated = st.run_strategy(bars, top_n=1, lookback=9, **rules)["weights"]
    assert derived.exceptAll(stated).isEmpty() and stated.exceptAll(derived).isEmpty()
    assert {r.symbol_id for r in derived.where("weight > 0").collect()} == {3}
    first = derived.where("weight > 0").agg(F.min("ts")).first()[0]
    assert first >= day(9)
    with pytest.raises(ValueError, match="shorter than the longest window, 9"):
        st.run_strategy(bars, top_n=1, lookback=8, **rules)


def test_reach_of_rules():
    past = rl.shift(rl.close())
    assert [
        x.reach
        for x in (
            past, rl.const(2), rl.momentum(past, 63), rl.rank(rl.momentum(past, 63)), rl.llt(past, 0.1),
            rl.ewm_std(past, 20), rl.condition(rl.gt(rl.sma(past, 5), past), rl.zscore(past, 30), rl.const(0)),
            rl.sma(rl.ema(rl.close(), 26), 5),
        )
    ] == [0, 0, 63, 63, 20, 20, 30, 26]
    for bad in (lambda: rl.sma(past, 0), lambda: rl.momentum(past, 1.5), lambda: rl.shift(past, 0), lambda: rl.llt(past, 2)):
        with pytest.raises(ValueError):
            bad()


def test_costs_lower_the_curve(frame):
    rows = [(1, day(i), 100.0, 100.0, True) for i in range(30)]
    bars = frame(rows, "symbol_id BIGINT, ts DATE, open DOUBLE, close DOUBLE, traded BOOLEAN")
    score = fx.momentum("close", 2)
    # entered once after a first row in cash: the whole portfolio is traded once
    out = st.run_strategy(bars, score=score, lookback=10, top_n=1, bps=100.0)
    final = out["equity"].orderBy(F.col("ts").desc()).first().equity
    assert final == pytest.approx(0.99)


def test_splits_do_not_move_the_adjusted_panel(frame):
    rows = [(1, day(i), 400.0 if i < 3 else 100.0, 400.0 if i < 3 else 100.0, True) for i in range(6)]
    bars = frame(rows, "symbol_id BIGINT, ts DATE, open DOUBLE, close DOUBLE, traded BOOLEAN")
    actions = frame([(1, day(3), "split", 4.0)], "symbol_id BIGINT, ex_date DATE, kind STRING, ratio DOUBLE")
    got = [r.close for r in st.adjusted_panel(bars, actions).orderBy("ts").collect()]
    assert got == [100.0] * 6
    assert pn.densify(bars).count() == 6
