"""Weights as they are held: rows for what is held, the dates apart, zeros only when exported.

A portfolio of a few names out of many symbols is a few rows per rebalance date. Dates on which
nothing is held still count, so they are kept as a frame of their own, which the calendar bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.session import partitions_of, settle


@dataclass(frozen=True)
class Holdings:
    """`dates` (ts): the rebalance dates. `held` (ts, symbol_id, weight): weights other than zero."""

    dates: DataFrame
    held: DataFrame


def sparse(weights: DataFrame) -> Holdings:
    """Holdings of a frame with zeros, whose dates are all rebalance dates."""
    held = weights.where(F.coalesce(F.col("weight") != 0, F.lit(False))).select("ts", "symbol_id", "weight")
    return Holdings(weights.select("ts").distinct(), held)


def settled(holdings: Holdings) -> Holdings:
    """Both frames written once, for several readers."""
    return Holdings(settle(holdings.dates, "weight-dates"), settle(holdings.held, "held-weights"))


def export(holdings: Holdings, universe: DataFrame) -> DataFrame:
    """(ts, symbol_id, weight) for every date and symbol, zeros included.

    What a symbol holds meets its zeros as one row, so the zeros, by far the most rows, are neither
    grouped nor shuffled. The fixed number of partitions keeps them from being written by a single task.
    """
    # one row, an entry per rebalance date: bounded by the calendar
    dates = holdings.dates.agg(F.collect_set("ts").alias("_dates"))
    cells = holdings.held.groupBy("ts", "symbol_id").agg(F.sum(F.col("weight").cast("double") + 0.0).alias("weight"))
    held = cells.select("symbol_id", F.struct("ts", "weight").alias("_cell"))
    known = universe.select("symbol_id").distinct().withColumn("_known", F.lit(True))
    by_symbol = (
        known.unionByName(held, allowMissingColumns=True)
        .repartition(partitions_of(universe.sparkSession), "symbol_id")
        .groupBy("symbol_id")
        .agg(F.coalesce(F.max("_known"), F.lit(False)).alias("_known"), F.collect_list("_cell").alias("_cells"))
        .crossJoin(F.broadcast(dates))
        # rows held outside the universe come back as well: none is dropped
        .withColumn("_dates", F.when(F.col("_known"), F.col("_dates")).otherwise(F.array_except("_dates", "_dates")))
    )
    rest = F.array_except("_dates", F.transform("_cells", lambda c: c["ts"]))

    def cell(ts: Column, weight: Column) -> Column:
        return F.struct(ts.alias("ts"), weight.alias("weight"))

    zeros = F.transform(rest, lambda d: cell(d, F.lit(0.0)))
    filled = F.transform(
        "_cells",
        lambda c: cell(c["ts"], F.coalesce(c["weight"], F.when(F.array_contains("_dates", c["ts"]), 0.0))),
    )
    return by_symbol.select("symbol_id", F.inline(F.concat(filled, zeros))).select("ts", "symbol_id", "weight")


def _lanes(*values: Column) -> list[Column]:
    return [F.xxhash64(F.lit(lane), *values) for lane in (1, 2)]


def date_digests(holdings: Holdings) -> DataFrame:
    """(ts, n, digest, digest2) of each date: what is held, whatever the order of the rows.

    128 bits of the exclusive or of row digests; a date in cash has n = 0.
    """
    one, two = _lanes(F.col("symbol_id"), F.col("weight") + F.lit(0.0))
    found = holdings.held.groupBy("ts").agg(
        F.count("*").alias("n"), F.bit_xor(one).alias("digest"), F.bit_xor(two).alias("digest2")
    )
    return holdings.dates.join(found, "ts", "left").na.fill(0, ["n", "digest", "digest2"])


def event_dates(holdings: Holdings) -> DataFrame:
    """Dates whose weights differ from those of the date before; the first is kept.

    Only one row per date is compared, so no symbol needs its zeros.
    """
    before = F.lag(F.struct("n", "digest", "digest2")).over(Window.orderBy("ts"))  # one row per rebalance date
    moved = date_digests(holdings).withColumn("_same", F.struct("n", "digest", "digest2") == before)
    return moved.where(~F.coalesce("_same", F.lit(False))).select("ts")


def events(holdings: Holdings) -> Holdings:
    """The holdings on their event dates."""
    dates = settle(event_dates(holdings), "event-dates")
    return Holdings(dates, holdings.held.join(dates, "ts", "left_semi"))


def episode_span(holdings: Holdings) -> Column:
    """(start, clear): the first invested date and the first later date in cash, NULL if there is none."""
    totals = holdings.dates.join(holdings.held.groupBy("ts").agg(F.sum("weight").alias("total")), "ts", "left")
    totals = totals.na.fill(0.0, ["total"])
    # one entry per rebalance date: bounded by the calendar
    days = totals.agg(F.collect_list(F.struct("ts", "total")).alias("days"))

    def first(keep) -> Column:
        return F.array_min(F.transform(F.filter("days", keep), lambda d: d["ts"]))

    return (
        days.select("days", first(lambda d: d["total"] > 0).alias("start"))
        .select(F.struct("start", first(lambda d: (d["total"] == 0) & (d["ts"] > F.col("start"))).alias("clear")))
        .scalar()
    )


def first_episode(holdings: Holdings) -> Holdings:
    """From the first invested date to the first later date in cash; empty when it never clears."""
    span = episode_span(holdings)
    inside = F.col("ts").between(span["start"], span["clear"])
    return Holdings(holdings.dates.where(inside), holdings.held.where(inside))


def intervals(holdings: Holdings) -> DataFrame:
    """(symbol_id, weight, from_ts, to_ts): stretches of dates on which a symbol keeps one weight.

    `to_ts` is the first date on which it does not hold any more, NULL while it is still held. A symbol's
    rows are bounded by the calendar.
    """
    every = Window.orderBy("ts")  # one row per rebalance date
    order = holdings.dates.select(
        "ts", F.row_number().over(every).alias("_n"), F.lead("ts").over(every).alias("_next")
    )
    run = F.col("_n") - F.row_number().over(Window.partitionBy("symbol_id", "weight").orderBy("_n"))
    return (
        holdings.held.join(F.broadcast(order), "ts")
        .withColumn("_run", run)
        .groupBy("symbol_id", "weight", "_run")
        .agg(F.min("ts").alias("from_ts"), F.max_by("_next", "_n").alias("to_ts"))
        .drop("_run")
    )


def at_dates(stretches: DataFrame, dates: DataFrame) -> Holdings:
    """The holdings that `intervals` coded."""
    # one row per rebalance date
    inside = (F.col("ts") >= F.col("from_ts")) & (F.col("to_ts").isNull() | (F.col("ts") < F.col("to_ts")))
    held = stretches.join(F.broadcast(dates.select("ts")), inside).select("ts", "symbol_id", "weight")
    return Holdings(dates.select("ts"), held)
