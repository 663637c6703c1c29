"""Portfolio curves, fills, costs and parameter screens as declarative jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.functions.factors import sma
from panelkite.operators.panel import tradable


def fill_resolution(panel: DataFrame, decisions: DataFrame, fill_at: str = "open") -> DataFrame:
    """Where each decision fills.

    A decision at T fills at the first later session that trades with a positive price, up to and
    including the next decision date; a newer decision replaces what is still pending.
    Columns: ts, symbol_id, weight, fill_ts, fill_price, wait (sessions), outcome.
    """
    if fill_at not in ("open", "close"):
        raise ValueError("fill_at must be 'open' or 'close'")
    price = F.col(fill_at)
    # reading backwards, "the nearest later row" is a running last value
    later = (
        Window.partitionBy("symbol_id")
        .orderBy(F.col("idx").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # panel and decisions meet in one shuffle by symbol, which serves the windows too
    columns = ("idx", "traded", fill_at)
    marked = (
        panel.select("symbol_id", "ts", *columns)
        .unionByName(decisions.select("symbol_id", "ts", "weight"), allowMissingColumns=True)
        .repartition("symbol_id")
        .groupBy("symbol_id", "ts")
        .agg(*[F.max(c).alias(c) for c in (*columns, "weight")])
        .where("idx IS NOT NULL")
        .withColumn("_decided", F.col("weight").isNotNull())
    )
    can_fill = F.col("traded") & (price > 0)
    nearest = F.last(
        F.when(can_fill, F.struct("ts", "idx", price.alias("price"))), ignorenulls=True
    ).over(later)
    replaced = F.last(F.when(F.col("_decided"), F.col("ts")), ignorenulls=True).over(later)
    out = (
        marked.withColumn("_fill", nearest)
        .withColumn("_next", replaced)
        .where("_decided")
        .withColumn(
            "_fill",
            F.when(F.col("_next").isNull() | (F.col("_fill.ts") <= F.col("_next")), F.col("_fill")),
        )
        .withColumn("wait", (F.col("_fill.idx") - F.col("idx")).cast("long"))
    )
    return out.select(
        "ts",
        "symbol_id",
        "weight",
        F.col("_fill.ts").alias("fill_ts"),
        F.col("_fill.price").alias("fill_price"),
        "wait",
        F.when(F.col("wait").isNull(), "unfilled")
        .when(F.col("wait") > 1, "deferred")
        .otherwise("next_session")
        .alias("outcome"),
    )


def unfilled_orders(fills: DataFrame) -> DataFrame:
    """Decisions that never filled or filled after the next session."""
    return fills.where(F.col("outcome") != "next_session")


def over_invested(weights: DataFrame, keys: Sequence[str] = ("run_id", "ts")) -> DataFrame:
    """Rebalance dates whose gross weight exceeds 1; `compose` must not see any."""
    return (
        weights.groupBy(*keys)
        .agg(F.sum(F.abs("weight")).alias("gross"))
        .where(F.col("gross") > 1.0 + 1e-9)
    )


def _segments(curves: DataFrame, weights: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """Dense (run_id, name, ts) rows with the return r, segment number and its target weight.

    Segments are counted on the dates of a run alone. Grid, curves and weights then meet in one
    shuffle by (run_id, name), which also serves the windows after it.
    """
    resets = (weights if resets is None else resets).select("run_id", "ts").distinct().withColumn("_reset", F.lit(1))
    upto = Window.partitionBy("run_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    # dates of a run: bounded by the calendar
    days = (
        curves.select("run_id", "ts")
        .distinct()
        .join(resets, ["run_id", "ts"], "left")
        .select("run_id", "ts", F.sum(F.coalesce("_reset", F.lit(0))).over(upto).alias("_seg"))
        .groupBy("run_id")
        .agg(F.collect_list(F.struct("ts", "_seg")).alias("_days"))
    )
    names = curves.select("run_id", "name").distinct()
    grid = names.join(days, "run_id").select("run_id", "name", F.inline("_days"))
    key = ["run_id", "name", "ts"]
    cells = (
        grid.unionByName(curves.select(*key, "equity"), allowMissingColumns=True)
        .unionByName(weights.select(*key, "weight"), allowMissingColumns=True)
        .repartition("run_id", "name")
        .groupBy(*key)
        .agg(*[F.max(c).alias(c) for c in ("_seg", "equity", "weight")])
        .where("_seg IS NOT NULL")
    )
    w = Window.partitionBy("run_id", "name").orderBy("ts")
    ret = F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1.0
    in_seg = Window.partitionBy("run_id", "name", "_seg").orderBy("ts")
    return (
        cells.select(*key, "weight", "_seg", F.coalesce(ret, F.lit(0.0)).alias("r"))
        .withColumn("_w", F.coalesce(F.first("weight").over(in_seg), F.lit(0.0)))
        .withColumn(
            "_g",
            F.product(1.0 + F.col("r")).over(in_seg.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn("_g0", F.coalesce(F.lag("_g").over(in_seg), F.lit(1.0)))
    )


def compose(
    curves: DataFrame,
    weights: DataFrame,
    initial: float = 1.0,
    max_weight: float = 1.0,
    resets: DataFrame | None = None,
) -> DataFrame:
    """Portfolio curve (run_id, ts, equity) of `curves` (run_id, name, ts, equity).

    Weights (run_id, ts, name, weight) apply from their date's own return on and drift until the
    next rebalance; the rest is cash at zero return. Within a segment that starts at value V the
    portfolio is V * (1 - sum w + sum w*G), G the growth of each name since the segment began, so
    days need no sequential walk. Gross weights, long and short together, of more than `max_weight` are
    refused. `resets` (run_id, ts) are the rebalance dates where weights have no rows for zeros: a date
    without any weight is all cash.
    """
    seg = _segments(curves, weights, resets)
    grown = 1.0 + F.sum(F.col("_w") * (F.col("_g") - 1.0))
    levered = F.raise_error(F.lit("weights of one date add up to too much")).cast("double")
    daily = seg.groupBy("run_id", "_seg", "ts").agg(
        F.when(F.sum(F.abs("_w")) > max_weight + 1e-9, levered).otherwise(grown).alias("_f")
    )
    ends = daily.groupBy("run_id", "_seg").agg(F.max_by("_f", "ts").alias("_end"))
    before = Window.partitionBy("run_id").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select(
        "run_id", "_seg", F.coalesce(F.product("_end").over(before), F.lit(1.0)).alias("_base")
    )
    return daily.join(bases, ["run_id", "_seg"]).select(
        "run_id", "ts", (F.lit(float(initial)) * F.col("_base") * F.col("_f")).alias("equity")
    )


def weights_used(curves: DataFrame, weights: DataFrame) -> DataFrame:
    """Drifted weight of each name at each date, before that date's return."""
    seg = _segments(curves, weights).withColumn("_v", F.col("_w") * F.col("_g0"))
    total = seg.groupBy("run_id", "ts").agg(
        (1.0 + F.sum(F.col("_v") - F.col("_w"))).alias("_total")
    )
    return seg.join(total, ["run_id", "ts"]).select(
        "run_id", "ts", "name", F.try_divide("_v", "_total").alias("weight")
    )


def cost_scenarios(returns: DataFrame, bps: Sequence[float] = (0.0, 10.0, 30.0)) -> DataFrame:
    """Net returns under several total costs: `gross` return and `traded` share of the portfolio."""
    net = (1.0 - F.col("bps") / 1e4 * F.col("traded")) * (1.0 + F.col("gross")) - 1.0
    return returns.withColumn(
        "bps", F.explode(F.array(*[F.lit(float(b)) for b in bps]))
    ).withColumn("net", net)


def sma_grid_screen(
    bars: DataFrame, fast: Sequence[int] = (5, 10, 20), slow: Sequence[int] = (30, 60)
) -> DataFrame:
    """Long while the fast mean is above the slow one, for every pair with fast < slow.

    Reads each symbol's own rows. All pairs share the one shuffle by symbol.
    """
    pairs = [(a, b) for a in fast for b in slow if a < b]
    windows = sorted({n for p in pairs for n in p})
    means = bars.select("symbol_id", "ts", "close", *[sma("close", n).alias(f"_m{n}") for n in windows])
    options = F.array(
        *[
            F.struct(
                F.lit(a).alias("fast"),
                F.lit(b).alias("slow"),
                F.coalesce(F.col(f"_m{a}") > F.col(f"_m{b}"), F.lit(False)).alias("above"),
            )
            for a, b in pairs
        ]
    )
    w = Window.partitionBy("symbol_id", "fast", "slow").orderBy("ts")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    was = F.coalesce(F.lag("above").over(w), F.lit(False))
    ret = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1.0
    return (
        means.select("symbol_id", "ts", "close", F.inline(options))
        .withColumn("_entry", F.col("above") & ~was)
        .withColumn("_r", F.when(was, F.coalesce(ret, F.lit(0.0))).otherwise(0.0))
        .withColumn("_nav", F.product(1.0 + F.col("_r")).over(so_far))
        .withColumn("_dd", F.col("_nav") / F.max("_nav").over(so_far) - 1.0)
        .groupBy("symbol_id", "fast", "slow")
        .agg(
            (F.max_by("_nav", "ts") - 1.0).alias("total_return"),
            F.count_if("_entry").alias("n_trades"),
            F.min("_dd").alias("max_drawdown"),
        )
        .where("n_trades > 0")
    )


def curve_deviation(a: DataFrame, b: DataFrame, key: str = "run_id") -> DataFrame:
    """Largest |a/b - 1| over the common dates of two sets of curves."""
    joined = a.select(key, "ts", F.col("equity").alias("_a")).join(
        b.select(key, "ts", F.col("equity").alias("_b")), [key, "ts"]
    )
    return joined.groupBy(key).agg(
        F.count("*").alias("common"),
        F.max(F.abs(F.try_divide(F.col("_a"), F.col("_b")) - 1.0)).alias("max_rel_dev"),
    )


def equal_weights(bars: DataFrame, dates: DataFrame, cash_floor: float = 0.0) -> DataFrame:
    """Benchmark weights: all symbols that can trade on a rebalance date share it equally.

    A symbol can trade where it has a bar with a close that is not halted, so bars do; the cells that
    a dense panel adds have none. Two such bars of a symbol on one date are refused.
    """
    twice = F.raise_error(F.lit("a symbol has two bars on one date"))
    # dates: one row per period, bounded by the calendar
    pool = (
        bars.where(tradable(bars) & F.col("close").isNotNull())
        .select("ts", "symbol_id")
        .join(F.broadcast(dates), "ts", "left_semi")
        .groupBy("ts", "symbol_id")
        .agg(F.count("*").alias("_rows"))
        .select("ts", F.when(F.col("_rows") > 1, twice).otherwise(F.col("symbol_id")).alias("symbol_id"))
    )
    # one count per date
    counts = pool.groupBy("ts").agg(F.count("symbol_id").alias("_n"))
    return pool.join(F.broadcast(counts), "ts").select(
        "ts", "symbol_id", (F.lit(1.0 - cash_floor) / F.col("_n")).alias("weight")
    )


def exposure(weights: DataFrame, symbols: DataFrame, by: str = "currency") -> DataFrame:
    """Weight per date and `by` (currency, exchange, ...)."""
    return (
        weights.join(symbols.select("symbol_id", by), "symbol_id", "left")
        .groupBy("ts", by)
        .agg(F.sum("weight").alias("weight"))
    )


def attribute_returns(local: Column | str, foreign: Column | str) -> list[Column]:
    """Local, currency and interaction parts of a return, and the exact total."""
    a = F.col(local) if isinstance(local, str) else local
    b = F.col(foreign) if isinstance(foreign, str) else foreign
    return [
        a.alias("local"),
        b.alias("fx"),
        (a * b).alias("interaction"),
        ((1.0 + a) * (1.0 + b) - 1.0).alias("total"),
    ]
