"""Panel shaping: the session grid, session state and valuation carried over gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelkite.session import tasks_of


def so_far() -> WindowSpec:
    by_symbol = Window.partitionBy("symbol_id").orderBy("ts")
    return by_symbol.rowsBetween(Window.unboundedPreceding, 0)


def tradable(df: DataFrame) -> Column:
    """The trading mask; a table without one is tradable throughout."""
    return F.coalesce(F.col("traded"), F.lit(True)) if "traded" in df.columns else F.lit(True)


def session_list(bars: DataFrame) -> DataFrame:
    """One row holding the sorted dates on which at least one symbol traded.

    Its length is bounded by the number of calendar days.
    """
    return bars.where(tradable(bars)).agg(F.array_sort(F.collect_set("ts")).alias("sessions"))


def session_index(bars: DataFrame) -> DataFrame:
    """(idx, ts): position of every session in the union calendar."""
    return session_list(bars).select(F.posexplode("sessions").alias("idx", "ts"))


def panel_tasks(stored: DataFrame) -> int:
    """Tasks for the dense panel of stored bars, by its cells: about symbols times dates."""
    n = stored.agg(F.approx_count_distinct("symbol_id").alias("symbols"), F.approx_count_distinct("ts").alias("dates")).first()
    return tasks_of(stored.sparkSession, n.symbols * n.dates)


def densify(bars: DataFrame, values: Sequence[str] = ("close",), tasks: int | None = None) -> DataFrame:
    """One row per symbol and session: (symbol_id, ts, idx, traded, *values).

    Cells without a bar have NULL values and traded=false. Only the bars that exist are shuffled, by
    symbol_id; each then fills the sessions up to its symbol's next bar, and the first one those
    before it. Later windows over the symbol need no further shuffle. Two bars of a
    symbol on one session are refused. Every symbol ends with one row per session, also one whose bars
    all lie outside the sessions, so none is larger than another. With `tasks`, so many tasks share the
    symbols (`panel_tasks`), otherwise as many as the session has shuffle partitions.
    """
    index = session_index(bars).withColumnRenamed("idx", "_at")
    days = session_list(bars).scalar()
    w = Window.partitionBy("symbol_id").orderBy("_at", "ts")
    # bars outside the sessions sort first; a symbol keeps one of them if it has no other
    inside = F.count("_at").over(Window.partitionBy("symbol_id"))
    first = F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.col("_at"))
    own = F.coalesce(F.col("idx") == F.col("_at"), F.lit(False))
    twice = F.raise_error(F.lit("a symbol has two bars on one date"))
    cells = F.when(F.col("_next") == F.col("_at"), twice).when(F.col("_b") >= F.col("_a"), F.sequence("_a", "_b"))
    rows = bars.select("symbol_id", "ts", tradable(bars).alias("traded"), *values)
    if tasks is not None:
        rows = rows.repartition(tasks, "symbol_id")
    return (
        rows
        # one row per session date: bounded by the calendar
        .join(F.broadcast(index), "ts", "left")
        .withColumns({"_inside": inside, "_n": F.row_number().over(w)})
        .where("_at IS NOT NULL OR (_inside = 0 AND _n = 1)")
        .select("symbol_id", "ts", "traded", *values, "_at", first.alias("_a"), F.lead("_at").over(w).alias("_next"))
        .withColumn("_b", F.coalesce("_next", F.size(days)) - 1)
        .select("symbol_id", "traded", *values, "_at", F.explode(cells).alias("idx"))
        .select(
            "symbol_id",
            F.element_at(days, F.col("idx") + 1).alias("ts"),
            "idx",
            (own & F.col("traded")).alias("traded"),
            *[F.when(own, F.col(c)).alias(c) for c in values],
        )
    )


def carry_forward(x: Column | str) -> Column:
    """Last valid value so far."""
    return F.last(x, ignorenulls=True).over(so_far())


def is_fresh(valid: Column, allowance: int) -> Column:
    """At most `allowance` sessions since the last valid quote."""
    last = F.last(F.when(valid, F.col("idx")), ignorenulls=True).over(so_far())
    return F.coalesce(F.col("idx") - last <= allowance, F.lit(False))


def is_warm(lookback: int) -> Column:
    return F.col("idx") >= max(int(lookback), 1)


def carried_halts(panel: DataFrame) -> DataFrame:
    """Halted sessions quote the last traded close in all four prices, with volume 0."""
    halted = ~F.col("traded")
    last = carry_forward(F.when(F.col("traded"), F.col("close")))
    return panel.withColumn("_last", last).select(
        "symbol_id",
        "ts",
        "traded",
        *[
            F.when(halted, F.coalesce("_last", c)).otherwise(F.col(c)).alias(c)
            for c in ("open", "high", "low", "close")
        ],
        F.when(halted, F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
    )


def to_wide(
    df: DataFrame,
    symbols: Sequence[int],
    value: str = "close",
    rows: Sequence[str] = ("ts",),
    columns: str = "symbol_id",
) -> DataFrame:
    """Date x symbol layout for export; duplicate keys are averaged.

    Where symbols are too many for columns, `rows` and `columns` may spread them over pages.
    """
    return df.groupBy(*rows).pivot(columns, list(symbols)).agg(F.avg(value))


def cells(df: DataFrame, value: str = "close") -> DataFrame:
    """(ts, symbol_id, value) of every filled cell of the date x symbol layout, for any number of symbols.

    `to_wide` has the same cells for the symbols it is given. Duplicate keys are averaged.
    """
    return df.groupBy("ts", "symbol_id").agg(F.avg(value).alias(value))


def session_status(bars: DataFrame, symbols: DataFrame, calendar: DataFrame) -> DataFrame:
    """(symbol_id, ts, status) for every natural day a symbol spans.

    A row decides between traded and halted; without one the calendar decides between missing
    (market open) and closed.
    """
    spans = bars.groupBy("symbol_id").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    days = spans.join(symbols.select("symbol_id", "exchange"), "symbol_id").select(
        "symbol_id", "exchange", F.explode(F.sequence("_a", "_b")).alias("ts")
    )
    opens = calendar.where("is_open").select("exchange", "ts", F.lit(True).alias("_open"))
    seen = bars.select("symbol_id", "ts", F.col("traded").alias("_traded"))
    return (
        days.join(opens, ["exchange", "ts"], "left")
        .join(seen, ["symbol_id", "ts"], "left")
        .select(
            "symbol_id",
            "ts",
            F.when(F.col("_traded"), "traded")
            .when(~F.col("_traded"), "halted")
            .when(F.col("_open"), "missing")
            .otherwise("closed")
            .alias("status"),
        )
    )


def expected_sessions(symbols: DataFrame, calendar: DataFrame, start: Column, end: Column) -> DataFrame:
    """(symbol_id, ts): open sessions of each symbol's exchange within [start, end].

    The bounds may use the symbol's columns. Each symbol expands to its own days first, so the
    calendar is met by equality and not by a range comparison.
    """
    days = symbols.where(start <= end).select(
        "symbol_id", "exchange", F.explode(F.sequence(start, end)).alias("ts")
    )
    opens = calendar.where("is_open").select("exchange", "ts").distinct()
    return days.join(opens, ["exchange", "ts"], "left_semi").select("symbol_id", "ts")


def unobserved_sessions(
    bars: DataFrame, symbols: DataFrame, calendar: DataFrame, start: str, end: str
) -> DataFrame:
    """Open sessions within a symbol's listing and the study window that have no bar."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    expected = expected_sessions(
        symbols,
        calendar,
        F.greatest(F.col("listed_on"), lo),
        F.least(F.coalesce(F.col("delisted_on"), hi), hi),
    )
    return expected.join(bars.select("symbol_id", "ts"), ["symbol_id", "ts"], "left_anti")


def session_reconciliation(
    bars: DataFrame, symbols: DataFrame, calendar: DataFrame, start: str, end: str
) -> DataFrame:
    """Expected against actual sessions per symbol, with the class of the difference."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    expected = (
        expected_sessions(
            symbols,
            calendar,
            F.greatest(F.coalesce(F.col("listed_on"), lo), lo),
            F.least(F.coalesce(F.col("delisted_on"), hi), hi),
        )
        .groupBy("symbol_id")
        .agg(F.count("*").alias("expected"))
    )
    actual = (
        bars.where(F.col("ts").between(lo, hi)).groupBy("symbol_id").agg(F.count("*").alias("actual"))
    )
    zero = F.lit(0).cast("long")
    gap = F.col("expected") - F.col("actual")
    return (
        symbols.select("symbol_id", "listed_on", "delisted_on")
        .join(expected, "symbol_id", "left")
        .join(actual, "symbol_id", "left")
        .withColumn("expected", F.coalesce("expected", zero))
        .withColumn("actual", F.coalesce("actual", zero))
        .select(
            "symbol_id",
            "expected",
            "actual",
            F.when(F.col("listed_on").isNull(), "no_listing_date")
            .when(F.col("listed_on") > hi, "listed_after_window")
            .when(F.col("delisted_on") < lo, "delisted_before_window")
            .when(gap > 0, "gap")
            .when(gap < 0, "surplus")
            .otherwise("complete")
            .alias("gap_class"),
        )
    )


def halted_session_count(panel: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sessions within the span of the decisions on which any symbol could not trade."""
    span = decisions.agg(F.struct(F.min("ts").alias("a"), F.max("ts").alias("b"))).scalar()
    return (
        panel.where(F.col("ts").between(span["a"], span["b"]))
        .groupBy("ts")
        .agg(F.max(~F.col("traded")).alias("halted"))
        .agg(F.count_if("halted").alias("halted_sessions"))
    )
