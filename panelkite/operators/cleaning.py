"""Price adjustment, total return and currency direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkite.operators.joins import asof_join

PRICES = ("open", "high", "low", "close")


def split_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Add split_factor: the product of all ratios with ex_date <= ts.

    Bars and actions share one ordered pass per symbol, so an ex-date need not be a session and no
    range join is made.
    """
    splits = actions.where("kind = 'split'").select(
        "symbol_id", F.col("ex_date").alias("ts"), F.col("ratio").alias("_ratio"), F.lit(0).alias("_bar")
    )
    so_far = (
        Window.partitionBy("symbol_id")
        .orderBy("ts", "_bar")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        bars.withColumn("_bar", F.lit(1))
        .withColumn("_ratio", F.lit(1.0))
        .unionByName(splits, allowMissingColumns=True)
        .withColumn("split_factor", F.product("_ratio").over(so_far))
        .where("_bar = 1")
        .drop("_bar", "_ratio")
    )


def adjust_prices(bars: DataFrame, actions: DataFrame, method: str = "backward") -> DataFrame:
    """Split-adjusted OHLC. Backward keeps the latest price, forward the first one.

    Dividends never enter prices; they enter the total return.
    """
    if method not in ("backward", "forward"):
        raise ValueError(f"unknown adjustment {method!r}")
    whole = (
        Window.partitionBy("symbol_id")
        .orderBy("ts")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    anchor = F.last("split_factor") if method == "backward" else F.first("split_factor")
    out = split_factors(bars, actions).withColumn(
        "adjust_multiplier", F.col("split_factor") / anchor.over(whole)
    )
    return out.withColumns(
        {f"{c}_adj": F.col(c) * F.col("adjust_multiplier") for c in PRICES if c in bars.columns}
    )


def forward_adjust_close(
    bars: DataFrame, actions: DataFrame | None = None, factors: DataFrame | None = None
) -> DataFrame:
    """(symbol_id, ts, close_adj, adj_factor, method), the first price unchanged.

    With vendor `factors` (symbol_id, ts, adj_factor) those decide, absent ones counting as 1;
    otherwise the splits in `actions`.
    """
    if factors is None:
        if actions is None:
            actions = bars.sparkSession.createDataFrame(
                [], "symbol_id BIGINT, ex_date DATE, kind STRING, ratio DOUBLE"
            )
        return adjust_prices(bars.select("symbol_id", "ts", "close"), actions, "forward").select(
            "symbol_id",
            "ts",
            "close_adj",
            F.col("adjust_multiplier").alias("adj_factor"),
            F.lit("split_forward").alias("method"),
        )
    anchor = F.first("_f").over(Window.partitionBy("symbol_id").orderBy("ts"))
    return (
        bars.select("symbol_id", "ts", "close")
        .join(factors.select("symbol_id", "ts", "adj_factor"), ["symbol_id", "ts"], "left")
        .withColumn("_f", F.coalesce(F.col("adj_factor").cast("double"), F.lit(1.0)))
        .withColumn("_anchor", anchor)
        .withColumn(
            "adj_factor",
            F.when(F.col("_anchor") == 0, 1.0).otherwise(F.try_divide("_f", "_anchor")),
        )
        .select(
            "symbol_id",
            "ts",
            (F.col("close") * F.col("adj_factor")).alias("close_adj"),
            "adj_factor",
            F.lit("fund_adj_forward").alias("method"),
        )
    )


def actions_by_date(actions: DataFrame) -> DataFrame:
    """(symbol_id, ts, split_ratio, dividend): one row per symbol and ex-date."""
    return actions.groupBy("symbol_id", F.col("ex_date").alias("ts")).agg(
        F.max(F.when(F.col("kind") == "split", F.col("ratio"))).alias("split_ratio"),
        F.max(F.when(F.col("kind") == "dividend", F.col("cash"))).alias("dividend"),
    )


def total_return_index(bars: DataFrame, actions: DataFrame, base: float = 1.0) -> DataFrame:
    """Add total_return_nav from raw closes and actions on session dates; the first row is `base`.

    The actions of a symbol, bounded by its calendar, meet its bars by symbol alone, so the bars are dealt
    as the window needs them and not by symbol and date before.
    """
    day = F.struct("ts", F.struct("split_ratio", "dividend"))
    known = (
        actions_by_date(actions)
        .where("ts IS NOT NULL")
        .groupBy("symbol_id")
        .agg(F.map_from_entries(F.collect_list(day)).alias("_actions"))
    )
    w = Window.partitionBy("symbol_id").orderBy("ts")
    value = F.col("close") * F.coalesce("split_ratio", F.lit(1.0)) + F.coalesce("dividend", F.lit(0.0))
    growth = F.when(F.row_number().over(w) == 1, F.lit(1.0)).otherwise(
        F.try_divide(value, F.lag("close").over(w))
    )
    return (
        bars.join(known, "symbol_id", "left")
        .withColumn("_action", F.try_element_at("_actions", F.col("ts")))
        .select(*bars.columns, "_action.split_ratio", "_action.dividend")
        .withColumn("_growth", growth)
        .withColumn(
            "total_return_nav",
            F.lit(float(base))
            * F.product("_growth").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .drop("_growth", "split_ratio", "dividend")
    )


def gold_backtest_view(bars: DataFrame, actions: DataFrame, snapshot_id: str) -> DataFrame:
    """Backtest input of one snapshot, all symbols at once.

    Every row has a bar, so its session status is traded or halted; days without a bar are the
    business of `panel.session_status`.
    """
    one = bars.where(F.col("snapshot_id") == snapshot_id)
    navs = total_return_index(one, actions)
    return adjust_prices(navs, actions).select(
        "symbol_id",
        "ts",
        "close",
        "close_adj",
        "available_utc",
        "traded",
        "total_return_nav",
        F.when(F.col("traded"), "traded").otherwise("halted").alias("status"),
    )


def _orientation(fx: DataFrame, base_currency: str) -> DataFrame:
    """Per unordered pair: the direction to keep, the rows quoted each way and the dates quoted both ways."""
    lo, hi = F.least("base", "quote"), F.greatest("base", "quote")
    pairs = (
        fx.where(F.col("base") != F.col("quote"))
        .groupBy(lo.alias("_lo"), hi.alias("_hi"), "ts")
        .agg(
            F.count_if(F.col("base") < F.col("quote")).alias("_up"),
            F.count_if(F.col("base") > F.col("quote")).alias("_down"),
        )
        .groupBy("_lo", "_hi")
        .agg(
            F.sum("_up").alias("_up"),
            F.sum("_down").alias("_down"),
            F.count_if((F.col("_up") > 0) & (F.col("_down") > 0)).alias("_clashes"),
        )
    )
    both = (F.col("_up") > 0) & (F.col("_down") > 0)
    keep_down = (
        F.when(~both, F.col("_down") > 0)
        .when(F.col("_lo") == base_currency, True)
        .when(F.col("_hi") == base_currency, False)
        .otherwise(F.col("_down") > F.col("_up"))
    )
    return pairs.withColumn("_both", both).withColumn("_keep_down", keep_down)


def normalize_fx_direction(fx: DataFrame, base_currency: str = "CNY") -> DataFrame:
    """Quote every pair in one direction: 1 base = rate quote.

    Pairs quoted one way stay. For the others a quote in `base_currency` wins, then the side with
    more rows, then alphabetical order; the losing side is inverted. A pair with dates on which both
    sides were quoted would get two rates for a date, so its rows stop the query; `fx_collisions` lists
    those dates.
    """
    named = F.concat(F.lit("quoted both ways on one date: "), "base", F.lit("/"), "quote")
    clash = F.raise_error(named).cast("double")
    turn = F.col("_both") & ((F.col("base") > F.col("quote")) != F.col("_keep_down"))
    lo, hi = F.least("base", "quote"), F.greatest("base", "quote")
    return (
        fx.withColumns({"_lo": lo, "_hi": hi})
        .join(_orientation(fx, base_currency), ["_lo", "_hi"], "left")
        .withColumn("_turn", F.coalesce(turn, F.lit(False)))
        .withColumn(
            "rate",
            F.when(F.col("_clashes") > 0, clash)
            .when(F.col("_turn"), F.try_divide(F.lit(1.0), "rate"))
            .otherwise(F.col("rate")),
        )
        .withColumn("_base", F.when(F.col("_turn"), F.col("quote")).otherwise(F.col("base")))
        .withColumn("quote", F.when(F.col("_turn"), F.col("base")).otherwise(F.col("quote")))
        .withColumn("base", F.col("_base"))
        .select(*fx.columns)
    )


def fx_collisions(fx: DataFrame) -> DataFrame:
    """Pairs and dates quoted in both directions."""
    back = fx.select(F.col("quote").alias("base"), F.col("base").alias("quote"), "ts").distinct()
    return (
        fx.where(F.col("base") < F.col("quote"))
        .select("base", "quote", "ts")
        .distinct()
        .join(back, ["base", "quote", "ts"], "left_semi")
    )


def fx_direction_log(fx: DataFrame, base_currency: str = "CNY") -> DataFrame:
    """What happened to each pair, and the identity row of the base currency."""
    base = F.when(F.col("_keep_down"), F.col("_hi")).otherwise(F.col("_lo"))
    quote = F.when(F.col("_keep_down"), F.col("_lo")).otherwise(F.col("_hi"))
    kept = F.when(F.col("_keep_down"), F.col("_down")).otherwise(F.col("_up"))
    turned = F.when(F.col("_keep_down"), F.col("_up")).otherwise(F.col("_down"))
    rows = _orientation(fx, base_currency).select(
        base.alias("base"),
        quote.alias("quote"),
        F.when(F.col("_both"), "inverted").otherwise("kept").alias("action"),
        kept.alias("forward_rows"),
        turned.alias("reverse_rows"),
    )
    zero = F.lit(0).cast("long")
    own = F.lit(base_currency)
    identity = fx.agg(F.lit(1)).select(
        own.alias("base"),
        own.alias("quote"),
        F.lit("kept").alias("action"),
        zero.alias("forward_rows"),
        zero.alias("reverse_rows"),
    )
    return rows.unionByName(identity)


def convert_curves(curves: DataFrame, fx: DataFrame, quote: str = "CNY") -> DataFrame:
    """Returns of local curves (run_id, ts, equity, currency) seen in `quote`.

    The rate at each date is the last one available by then, never a later one. Columns: local, fx
    and interaction parts, and `total` with 1 + total = (1 + local)(1 + fx).
    """
    rates = fx.where(F.col("quote") == quote).select(
        F.col("base").alias("currency"), "available_utc", "ts", "rate"
    )
    priced = asof_join(
        curves,
        rates.withColumnRenamed("ts", "_seen"),
        ["currency"],
        "ts",
        "available_utc",
        ["rate"],
        latest_by="_seen",
    )
    w = Window.partitionBy("run_id").orderBy("ts")
    local = F.try_divide("equity", F.lag("equity").over(w)) - 1.0
    move = F.try_divide("rate", F.lag("rate").over(w)) - 1.0
    return priced.select(
        "run_id", "ts", "equity", "rate", local.alias("local"), move.alias("fx")
    ).withColumns(
        {
            "interaction": F.col("local") * F.col("fx"),
            "total": (1.0 + F.col("local")) * (1.0 + F.col("fx")) - 1.0,
        }
    )
