"""Signals, position states and target weights."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.functions.factors import momentum, truth
from panelkite.operators.holdings import Holdings, episode_span, event_dates, export, sparse
from panelkite.operators.panel import is_fresh, is_warm, so_far
from panelkite.session import partitions_of

# Names of the days a week and of the months a quarter or year may end on.
DAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def signal(entry: Column, exit_: Column, lookback: int, traded: Column | str = "traded") -> Column:
    """+1 on entry, -1 on exit (which wins), 0 otherwise; NULL before warm-up or when halted."""
    known = is_warm(lookback) & truth(traded)
    return F.when(known, F.when(truth(exit_), -1).when(truth(entry), 1).otherwise(0))


def position_state(sig: Column | str) -> Column:
    """1 from an entry to the next exit; 0 and NULL signals keep the state."""
    sig = F.col(sig) if isinstance(sig, str) else sig
    event = F.last(F.when(sig.isin(1, -1), sig), ignorenulls=True).over(so_far())
    return F.when(event == 1, 1).otherwise(0)


def period_key(ts: Column | str, rule: str) -> Column:
    """First day of the calendar period that `ts` falls into, or a date that stands for it alone.

    Rules are D, B (days, business days; a weekend belongs to the Monday after it), W, M, Q and Y. A week
    may name the day it ends on (W-FRI), a quarter or year its last month (Q-NOV, Y-JUN). A multiple (2W)
    is the length of a period, not the distance between periods: one begins in every unit, so the dates
    are those of the unit.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    parts = re.fullmatch(r"([0-9]*)(D|B|M|W(?:-[A-Z]{3})?|[QY](?:-[A-Z]{3})?)", rule)
    if parts is None or (parts[1] and int(parts[1]) < 1):
        raise ValueError(f"unknown rebalance rule {rule!r}")
    unit, _, anchor = parts[2].partition("-")
    if unit == "W" and (anchor or "SUN") in DAYS:
        return F.date_trunc("week", F.date_sub(ts, DAYS.index(anchor or "SUN") + 1)).cast("date")
    if unit in "QY" and (anchor or "DEC") in MONTHS:
        # moved so that the last month is December
        ahead = 11 - MONTHS.index(anchor or "DEC")
        moved = F.add_months(F.trunc(ts, "month"), ahead)
        return F.add_months(F.trunc(moved, "quarter" if unit == "Q" else "year"), -ahead)
    if unit == "B":
        return F.date_add(ts, F.when(F.weekday(ts) > 4, 7 - F.weekday(ts)).otherwise(0))
    if unit in "DM":
        return F.trunc(ts, "month") if unit == "M" else ts.cast("date")
    raise ValueError(f"unknown rebalance rule {rule!r}")


def rebalance_dates(sessions: DataFrame, rule: str = "W-MON") -> DataFrame:
    """First session of each period. A W-MON period runs Tuesday to Monday."""
    return sessions.groupBy(period_key("ts", rule).alias("_period")).agg(F.min("ts").alias("ts")).select("ts")


def fallback_score(window: int = 63) -> Column:
    return momentum("close", window)


def top_n_weights(
    eligible: DataFrame,
    score: str = "score",
    top_n: int = 3,
    cash_floor: float = 0.0,
    pieces: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Equal weights of the best `top_n` rows per date: (ts, symbol_id, weight).

    Ties go to the smaller id; a date with any infinite score is chosen by id alone. Each date is
    first cut down within `pieces` hash groups, as many as shuffle partitions unless given, so no task
    ranks all symbols of a date. With `tasks`, so many tasks share the groups.
    """
    pieces = pieces or partitions_of(eligible.sparkSession)
    s, by_score, by_id = F.col(score), [F.col(score).desc(), F.col("symbol_id")], [F.col("symbol_id")]
    part = Window.partitionBy("ts", "_piece")
    known = (
        eligible.where(s.isNotNull() & ~F.isnan(s))
        .select("ts", "symbol_id", s)
        .withColumn("_piece", F.pmod(F.xxhash64("symbol_id"), F.lit(pieces)))
    )
    if tasks is not None:
        known = known.repartition(tasks, "ts", "_piece")
    first = (
        known.withColumn("_odd", F.max(F.abs(s) == float("inf")).over(part))
        .withColumn("_a", F.row_number().over(part.orderBy(*by_score)))
        .withColumn("_b", F.row_number().over(part.orderBy(*by_id)))
        .where((F.col("_a") <= top_n) | (F.col("_b") <= top_n))
    )
    date = Window.partitionBy("ts")
    return (
        first.withColumn("_odd", F.max("_odd").over(date))
        .withColumn("_key", F.when(~F.col("_odd"), s))
        .withColumn("_n", F.row_number().over(date.orderBy(F.col("_key").desc(), "symbol_id")))
        .where(F.col("_n") <= top_n)
        .select(
            "ts", "symbol_id", (F.lit(1.0 - cash_floor) / F.count("*").over(date)).alias("weight")
        )
    )


def target_holdings(
    panel: DataFrame,
    sessions: DataFrame,
    entry: Column | None = None,
    exit_: Column | None = None,
    score: Column | None = None,
    lookback: int = 1,
    window: int = 63,
    top_n: int = 3,
    cash_floor: float = 0.0,
    rule: str = "W-MON",
    tasks: int | None = None,
) -> Holdings:
    """What is held at every rebalance date.

    A symbol is eligible when it can trade, has a score, its quote is fresh and its state is long.
    Dates without one hold cash. Without an entry rule every symbol is long; without a score the
    momentum over `window` sessions ranks. `lookback` is the longest window of the rules and, with 5 as
    the least, the freshness allowance. `tasks` as in ``top_n_weights``.
    """
    dates = rebalance_dates(sessions, rule)
    allowance = max(lookback if score is not None else window, 5)
    valid = F.col("close").isNotNull() & F.col("traded")
    held = F.lit(1)
    if entry is not None:
        held = position_state(signal(entry, F.lit(False) if exit_ is None else exit_, lookback))
    # one row per period: bounded by the calendar
    at_dates = panel.select(
        "symbol_id",
        "ts",
        "traded",
        (fallback_score(window) if score is None else score).alias("score"),
        held.alias("_held"),
        is_fresh(valid, allowance).alias("_fresh"),
    ).join(F.broadcast(dates), "ts", "left_semi")
    eligible = at_dates.where("traded AND score IS NOT NULL AND _fresh AND _held = 1")
    return Holdings(dates, top_n_weights(eligible, "score", top_n, cash_floor, tasks=tasks))


def target_weights(panel: DataFrame, sessions: DataFrame, universe: DataFrame, **rules) -> DataFrame:
    """(ts, symbol_id, weight) of ``target_holdings``, with a zero for each symbol of `universe` not held."""
    return export(target_holdings(panel, sessions, **rules), universe)


def event_panel(weights: DataFrame) -> DataFrame:
    """Rebalance dates whose weights differ from the previous ones; the first is kept."""
    # one row per rebalance date
    return weights.join(F.broadcast(event_dates(sparse(weights))), "ts", "left_semi")


def first_episode(events: DataFrame) -> DataFrame:
    """From the first invested date to the first later date in cash; empty when it never clears."""
    span = episode_span(sparse(events))
    return events.where(F.col("ts").between(span["start"], span["clear"]))


def in_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows of the chosen symbols."""
    return df.join(universe.select("symbol_id"), "symbol_id", "left_semi")


def unknown_universe(universe: DataFrame, df: DataFrame) -> DataFrame:
    """Chosen symbols that the data does not hold."""
    return universe.select("symbol_id").distinct().join(df.select("symbol_id"), "symbol_id", "left_anti")
