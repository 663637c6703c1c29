"""Exponential and second-order filters: folds over a series in session order.

A filter needs its own previous output, which no window frame can give. The rows of a series are
gathered in order and folded inside Spark; on a dense panel a series has one row per session date, so
its length is bounded by the calendar whatever the number of symbols, and a panel that is partitioned
by symbol already is not shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 64  # outputs that are appended one by one before they join the series' outputs


def known(x: Column | str) -> Column:
    """The value as a double; NaN is not known."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(~F.isnan(x), x)


def fold(
    df: DataFrame,
    value: Column,
    out: str,
    start: Column,
    step: Callable[[Column, Column], Column],
    result: Callable[[Column, Column], Column],
    key: str = "symbol_id",
    order: str = "ts",
) -> DataFrame:
    """Add `out` = result(state, x) after each step of `value` = x, by `order` within `key`.

    `start` is a struct, and `step` gives a struct of the same type.
    """
    row = F.struct(F.col(order).alias("_o"), value.alias("_x"), F.struct(*df.columns).alias("_row"))
    series = df.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    empty = F.array().cast("array<double>")

    def one(acc: Column, r: Column) -> Column:
        state = step(acc["s"], r["_x"])
        return F.struct(state.alias("s"), F.array_append(acc["o"], result(state, r["_x"])).alias("o"))

    def some(acc: Column, k: Column) -> Column:
        part = F.aggregate(
            F.slice("_rows", k * STEPS + 1, STEPS), F.struct(acc["s"].alias("s"), empty.alias("o")), one
        )
        return F.struct(part["s"].alias("s"), F.concat(acc["o"], part["o"]).alias("o"))

    parts = F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / STEPS).cast("int"))
    outs = F.aggregate(parts, F.struct(start.alias("s"), empty.alias("o")), some, lambda acc: acc["o"])
    both = F.arrays_zip(F.col("_rows._row").alias("row"), outs.alias("out"))
    return series.select(F.explode(both).alias("_z")).select("_z.row.*", F.col("_z.out").alias(out))


def _state(**values: float) -> Column:
    return F.struct(*(F.lit(float(v)).alias(k) for k, v in values.items()))


def ema(df: DataFrame, value: str, n: int, out: str = "ema", **by) -> DataFrame:
    """Exponential mean, decay 2/(n+1), from the n-th observation on.

    A missing value keeps the mean and makes the next observation weigh more.
    """
    if isinstance(n, bool) or n < 1 or n != int(n):
        raise ValueError(f"window must be an integer of at least 1, got {n!r}")
    a = 2.0 / (n + 1)

    def step(s: Column, x: Column) -> Column:
        past = s["past"] * (1 - a)
        mean = F.when(s["seen"] == 0, x).otherwise((past * s["mean"] + a * x) / (past + a))
        return F.struct(
            F.coalesce(mean, s["mean"]).alias("mean"),
            F.when(x.isNull(), past).otherwise(F.lit(1.0)).alias("past"),
            (s["seen"] + x.isNotNull().cast("double")).alias("seen"),
        )

    return fold(
        df, known(value), out, _state(mean=0, past=1, seen=0), step, lambda s, x: F.when(s["seen"] >= n, s["mean"]), **by
    )


def ewm_std(df: DataFrame, value: str, span: float, out: str = "ewm_std", **by) -> DataFrame:
    """Exponential standard deviation of the returns of `value`, corrected for bias.

    `all` and `squares` are the sum of the weights and of their squares, relative to the latest one.
    """
    if isinstance(span, bool) or span < 1:
        raise ValueError(f"span must be at least 1, got {span!r}")
    a = 2.0 / (span + 1)
    key, order = by.get("key", "symbol_id"), by.get("order", "ts")
    before = F.lag(known(value)).over(Window.partitionBy(key).orderBy(order))
    returns = known(value) / F.when(before != 0, before) - 1

    def step(s: Column, x: Column) -> Column:
        first, past = s["seen"] == 0, s["past"] * (1 - a)
        mean = F.when(first, x).otherwise((past * s["mean"] + a * x) / (past + a))
        spread = past * (s["spread"] + (s["mean"] - mean) ** 2) + a * (x - mean) ** 2
        total, squares = s["all"] * (1 - a), s["squares"] * (1 - a) ** 2

        def moved(new: Column, decayed: Column, at_first: float | Column) -> Column:
            return F.when(first, F.lit(at_first) if isinstance(at_first, float) else at_first).otherwise(
                F.when(x.isNull(), decayed).otherwise(new)
            )

        return F.struct(
            F.coalesce(mean, s["mean"]).alias("mean"),
            moved(spread / (past + a), s["spread"], 0.0).alias("spread"),
            moved((total + a) / (past + a), total, 1.0).alias("all"),
            moved((squares + a * a) / (past + a) ** 2, squares, 1.0).alias("squares"),
            moved(F.lit(1.0), past, 1.0).alias("past"),
            (s["seen"] + x.isNotNull().cast("double")).alias("seen"),
        )

    def result(s: Column, x: Column) -> Column:
        room = s["all"] ** 2 - s["squares"]
        deviation = F.sqrt(s["all"] ** 2 / room * s["spread"])
        return F.when((s["seen"] >= int(span)) & (room > 0), deviation)

    marked = df.withColumn("_return", returns)
    start = _state(mean=0, spread=0, all=1, squares=1, past=1, seen=0)
    return fold(marked, F.col("_return"), out, start, step, result, **by).drop("_return")


def llt(df: DataFrame, value: str, alpha: float, out: str = "llt", **by) -> DataFrame:
    """Low-lag trend line: a second-order filter with unit gain.

    It needs three consecutive inputs; across a gap the output is NULL and the state is kept.
    """
    if isinstance(alpha, bool) or not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must lie in (0, 1), got {alpha!r}")
    w = Window.partitionBy(by.get("key", "symbol_id")).orderBy(by.get("order", "ts"))
    x0, x1, x2 = known(value), F.lag(known(value), 1).over(w), F.lag(known(value), 2).over(w)
    square = alpha * alpha
    drive = (alpha - square / 4) * x0 + (square / 2) * x1 - (alpha - 3 * square / 4) * x2

    def step(s: Column, d: Column) -> Column:
        new = d + 2 * (1 - alpha) * s["last"] - (1 - alpha) ** 2 * s["before"]
        return F.struct(
            F.coalesce(new, s["last"]).alias("last"),
            F.when(d.isNull(), s["before"]).otherwise(s["last"]).alias("before"),
        )

    marked = df.withColumn("_drive", drive)
    result = lambda s, d: F.when(d.isNotNull(), s["last"])
    return fold(marked, F.col("_drive"), out, _state(last=0, before=0), step, result, **by).drop("_drive")
