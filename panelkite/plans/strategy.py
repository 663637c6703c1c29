"""A strategy from bars to weights, fills, portfolio curve and metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.functions import rules as rl
from panelkite.functions.rules import Rule
from panelkite.operators import metrics as mt
from panelkite.operators import panel as pn
from panelkite.operators import portfolio as pf
from panelkite.operators import signals as sg
from panelkite.operators.cleaning import adjust_prices
from panelkite.operators.holdings import Holdings, events, export, settled
from panelkite.operators.joins import next_session
from panelkite.session import settle


def adjusted_panel(bars: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Dense panel of split-adjusted open and close."""
    if actions is not None:
        bars = adjust_prices(bars, actions).withColumns(
            {"open": F.col("open_adj"), "close": F.col("close_adj")}
        )
    return pn.densify(bars, ("open", "close"))


def portfolio_curve(panel: DataFrame, holdings: Holdings, sessions: DataFrame, run_id: str = "run") -> DataFrame:
    """Curve of a portfolio that moves to the weights at the close they were decided on.

    The weights earn from the next session on. Symbols without a quote keep their last one.
    """
    name = F.col("symbol_id").cast("string")
    curves = panel.select(
        F.lit(run_id).alias("run_id"), name.alias("name"), "ts", pn.carry_forward("close").alias("equity")
    ).where("equity IS NOT NULL")
    run, start = F.lit(run_id).alias("run_id"), F.col("next_ts").alias("ts")
    resets = next_session(holdings.dates, sessions).where("next_ts IS NOT NULL").select(run, start)
    effective = (
        next_session(holdings.held, sessions)
        .where("next_ts IS NOT NULL")
        .select(run, start, name.alias("name"), "weight")
    )
    # names that are never held add nothing to the sum of gains; a flat one brings all dates
    kept = settle(curves.join(effective.select("name").distinct(), "name", "left_semi").select(*curves.columns), "held-curves")
    first = panel.where("close IS NOT NULL").agg(F.min("ts")).scalar()
    flat = sessions.where(F.col("ts") >= first).select(run, F.lit("").alias("name"), "ts", F.lit(1.0).alias("equity"))
    return pf.compose(kept.unionByName(flat), effective, resets=resets)


def net_curve(equity: DataFrame, holdings: Holdings, sessions: DataFrame, bps: float) -> DataFrame:
    """The curve after a one-way cost on everything traded, charged on the day the weights start."""
    run = F.lit("run")
    changes = mt.weight_changes(
        holdings.held.withColumn("run_id", run), dates=holdings.dates.withColumn("run_id", run)
    )
    traded = next_session(changes, sessions).select(
        F.col("next_ts").alias("ts"), F.col("change").alias("traded")
    )
    # one row per rebalance date
    gross = mt.with_returns(equity).join(F.broadcast(traded), "ts", "left")
    returns = gross.select(
        "run_id",
        "ts",
        F.coalesce("ret", F.lit(0.0)).alias("gross"),
        F.coalesce("traded", F.lit(0.0)).alias("traded"),
    )
    w = Window.partitionBy("run_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return pf.cost_scenarios(returns, [bps]).select(
        "run_id", "ts", F.product(1.0 + F.col("net")).over(w).alias("equity")
    )


def run_strategy(
    bars: DataFrame,
    actions: DataFrame | None = None,
    entry: Column | Rule | None = None,
    exit_: Column | Rule | None = None,
    score: Column | Rule | None = None,
    lookback: int | None = None,
    window: int | None = None,
    top_n: int = 3,
    cash_floor: float = 0.0,
    rule: str = "W-MON",
    bps: float = 0.0,
    run_id: str = "run",
    factors: Sequence[Callable[[DataFrame], DataFrame]] = (),
    universe: DataFrame | None = None,
) -> Mapping[str, DataFrame]:
    """weights, events, fills, equity and metrics of one strategy over the symbols of `bars`.

    `factors` add columns to the dense panel that entry, exit and score may name: exponential filters,
    trend lines, ranks. `lookback` is the longest window of rules and factors, which warm-up and freshness
    follow. Where entry, exit and score are ``rules.Rule``, it is derived from them, and one that is stated
    may be longer but not shorter; a score that is a plain column, and factors, need it stated. `universe`
    limits the symbols; ids that the bars lack are refused. Without a score the momentum over `window`
    sessions ranks, by default over the look-back. The panel and the weights are written once, as several
    results read them.
    """
    rules = [x for x in (entry, exit_, score) if isinstance(x, Rule)]
    needed = rl.longest(*rules)
    if (lookback or 1) < 2 and (factors or (score is not None and not isinstance(score, Rule))):
        raise ValueError("a score or factors need the look-back of their windows")
    if lookback is None:
        lookback = max(needed, 1)
    elif rules and lookback < needed:
        raise ValueError(f"a look-back of {lookback} is shorter than the longest window, {needed}")
    if universe is not None:
        unknown = sg.unknown_universe(universe, bars).limit(5).collect()
        if unknown:
            raise ValueError(f"symbols without bars: {[r.symbol_id for r in unknown]}")
        bars = sg.in_universe(bars, universe)
    panel = adjusted_panel(bars, actions)
    for add in factors:
        panel = add(panel)
    panel = rl.prepare(panel, *rules)
    entry, exit_, score = (x.column if isinstance(x, Rule) else x for x in (entry, exit_, score))
    panel = settle(panel, "panel")
    sessions = settle(pn.session_index(bars), "sessions")
    holdings = sg.target_holdings(
        panel,
        sessions,
        entry=entry,
        exit_=exit_,
        score=score,
        lookback=lookback,
        window=max(1, lookback) if window is None else window,
        top_n=top_n,
        cash_floor=cash_floor,
        rule=rule,
    )
    holdings = settled(holdings)
    equity = portfolio_curve(panel, holdings, sessions, run_id)
    if bps:
        equity = net_curve(equity, holdings, sessions, bps)
    run = F.lit(run_id)
    metrics = mt.performance(
        equity, weights=holdings.held.withColumn("run_id", run), dates=holdings.dates.withColumn("run_id", run)
    )
    symbols = panel.select("symbol_id").distinct()
    weights = export(holdings, symbols)
    return {
        "holdings": holdings,
        "weights": weights,
        "events": export(events(holdings), symbols),
        "fills": pf.fill_resolution(panel, weights),
        "equity": equity,
        "metrics": metrics,
    }
