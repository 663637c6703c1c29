"""Factor operators: hand answers and brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkite.functions import crosssection, recursive
from panelkite.functions import factors as fx
from panelkite.operators import constraints as ct
from panelkite.operators.panel import densify

NULL = None


def near(got, want, tol=1e-9):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a is None) == (b is None), (got, want)
        if a is not None:
            assert a == pytest.approx(b, abs=tol)


def test_arithmetic(panel_of, column):
    df = panel_of({1: [10, 20, 30], 2: [1, 2, 3]}).select(
        "symbol_id",
        "ts",
        fx.add("close", 1.0).alias("add"),
        fx.div("close", 0.0).alias("div0"),
        fx.neg("close").alias("neg"),
        fx.log(fx.sub("close", "close")).alias("log0"),
        fx.exp(fx.log("close")).alias("same"),
    )
    near(column(df, "add"), [11, 21, 31])
    assert column(df, "div0") == [NULL] * 3
    near(column(df, "neg", 2), [-1, -2, -3])
    assert column(df, "log0") == [NULL] * 3
    near(column(df, "same"), [10, 20, 30], 1e-9)


def test_geometric_growth_regression(panel_of, column):
    panel = panel_of({1: [1.01**t for t in range(60)], 2: [1.03**t for t in range(60)]})
    df = panel.select(
        "symbol_id", "ts", fx.linreg_slope("close", 20).alias("slope"), fx.linreg_r2("close", 20).alias("r2")
    )
    for symbol, growth in ((1, 1.01), (2, 1.03)):
        near(column(df, "slope", symbol), [NULL] * 19 + [math.log(growth)] * 41)
        near(column(df, "r2", symbol), [NULL] * 19 + [1.0] * 41)


def test_r2_of_flat_window_is_null(panel_of, column):
    df = panel_of({1: [5] * 6}).select("symbol_id", "ts", fx.linreg_r2("close", 3).alias("r2"))
    assert column(df, "r2") == [NULL] * 6


def test_zscore(panel_of, column):
    df = panel_of({1: [1, 2, 3, 4, 5], 2: [5, 4, 3, 2, 1]}).select(
        "symbol_id", "ts", fx.zscore("close", 2).alias("z")
    )
    near(column(df, "z"), [NULL] + [math.sqrt(2) / 2] * 4)
    near(column(df, "z", 2), [NULL] + [-math.sqrt(2) / 2] * 4)


def test_gap_in_window_is_null(panel_of, column):
    df = panel_of({1: [1, 2, NULL, 4, 5, 6]}).select("symbol_id", "ts", fx.sma("close", 3).alias("m"))
    assert column(df, "m") == [NULL, NULL, NULL, NULL, NULL, 5.0]


def test_llt(panel_of, column):
    near(column(recursive.llt(panel_of({1: [1] * 6}), "close", 0.1), "llt")[:4], [NULL, NULL, 0.01, 0.028])
    settled = column(recursive.llt(panel_of({1: [100] * 200}), "close", 0.1), "llt")
    assert settled[-1] == pytest.approx(100, abs=1e-4)


def test_llt_keeps_state_over_gap(panel_of, column):
    got = column(recursive.llt(panel_of({1: [1, 1, 1, NULL, 1, 1, 1]}), "close", 0.1), "llt")
    assert got[:2] == [NULL, NULL] and got[3:6] == [NULL] * 3
    assert got[2] == pytest.approx(0.01) and got[6] == pytest.approx(0.028)


def test_ewm_std_of_constant_growth(panel_of, column):
    got = column(recursive.ewm_std(panel_of({1: [1.01**t for t in range(40)]}), "close", 20), "ewm_std")
    assert got[:20] == [NULL] * 20
    near(got[20:], [0.0] * 20, 1e-7)


def test_filters_match_pandas_with_gaps(panel_of, column):
    rng = np.random.default_rng(3)
    x = list(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 80))))
    for i in (0, 7, 30, 31, 55):
        x[i] = NULL
    s = pd.Series(x, dtype="float64")
    panel = panel_of({1: x})
    want = s.ewm(span=5, min_periods=5, adjust=False).mean()
    near(column(recursive.ema(panel, "close", 5), "ema"), [NULL if np.isnan(v) else v for v in want])


@pytest.mark.parametrize("bad", [0, -1, 2.5, True])
def test_bad_windows(spark, bad):
    with pytest.raises(ValueError):
        fx.sma("close", bad)
    with pytest.raises(ValueError):
        fx.shift("close", -1)


def test_unknown_field(spark):
    with pytest.raises(ValueError):
        fx.field("volume")


def test_null_is_false(panel_of, column):
    df = panel_of({1: [1, NULL, 3]}).select(
        "symbol_id",
        "ts",
        fx.gt("close", 2.0).alias("gt"),
        fx.not_(fx.gt("close", 2.0)).alias("not_gt"),
        fx.condition(F.col("close") > 2, 1.0, 0.0).alias("cond"),
    )
    assert column(df, "gt") == [False, False, True]
    assert column(df, "not_gt") == [True, True, False]
    assert column(df, "cond") == [0.0, 0.0, 1.0]


def test_eq_is_relative(panel_of, column):
    df = panel_of({1: [100.0, 100.0005, 100.1]}).select("symbol_id", "ts", fx.eq("close", 100.0).alias("eq"))
    assert column(df, "eq") == [True, True, False]


def test_rank_ties_and_nulls(frame):
    rows = [("2024-01-02", s, v) for s, v in ((1, 10.0), (2, 10.0), (3, 5.0), (4, NULL))]
    df = frame(rows, "ts DATE, symbol_id BIGINT, x DOUBLE")
    ranked = {r.symbol_id: r["rank"] for r in crosssection.cross_sectional_rank(df, "x").collect()}
    assert ranked == {1: 1.5, 2: 1.5, 3: 3.0, 4: NULL}


@pytest.mark.parametrize("ascending", [True, False])
def test_rank_in_pieces_matches_pandas(frame, ascending):
    rng = random.Random(5)
    # one date holds most rows and one value a third of them
    rows = []
    for s in range(900):
        day = "2024-01-02" if s % 5 else "2024-01-03"
        value = 0.0 if s % 3 == 0 else round(rng.gauss(0, 1), 2)
        rows.append((day, s, NULL if s % 50 == 7 else value))
    df = frame(rows, "ts DATE, symbol_id BIGINT, x DOUBLE")
    got = crosssection.cross_sectional_rank(df, "x", ascending=ascending, pieces=5).toPandas()
    pdf = pd.DataFrame(rows, columns=["ts", "symbol_id", "x"])
    want = pdf.assign(w=pdf.groupby("ts")["x"].rank(ascending=ascending)).set_index("symbol_id")["w"]
    got = got.set_index("symbol_id")["rank"].astype("float64")
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def causal_columns(bars):
    up = fx.cross_above(fx.sma("close", 3), fx.sma("close", 8))
    out = densify(bars).select(
        "symbol_id",
        "ts",
        "close",
        fx.sma("close", 5).alias("a"),
        fx.std("close", 5).alias("b"),
        fx.momentum("close", 5).alias("c"),
        fx.zscore("close", 5).alias("d"),
        fx.linreg_slope("close", 5).alias("e"),
        up.alias("f"),
    )
    out = recursive.ema(out, "close", 5)
    out = recursive.ewm_std(out, "close", 5)
    return recursive.llt(out, "close", 0.2)


def test_no_operator_looks_ahead(panel_of):
    rng = np.random.default_rng(1)
    walks = {s: list(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60)))) for s in (1, 2, 3)}
    bars = panel_of(walks).drop("idx")
    assert ct.future_leak(bars, causal_columns, "2024-02-10").isEmpty()


def test_lookahead_is_found(panel_of):
    from pyspark.sql import Window

    def peek(bars):
        w = Window.partitionBy("symbol_id").orderBy("ts")
        return bars.withColumn("n", F.lead("close").over(w))

    bars = panel_of({1: [1, 2, 3, 4, 5]}).drop("idx")
    assert ct.future_leak(bars, peek, "2024-01-03").count() == 1
