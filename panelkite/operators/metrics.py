"""Performance metrics, grouped by run: one shuffle, whatever the number of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def with_returns(curves: DataFrame, key: str = "run_id") -> DataFrame:
    """Add `ret` (change against the previous point) and `dd` (loss against the running peak)."""
    w = Window.partitionBy(key).orderBy("ts")
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        curves.where(F.col("equity").isNotNull())
        .withColumn("ret", F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1.0)
        .withColumn("dd", F.try_divide(F.col("equity"), peak) - 1.0)
    )


def periods_per_year() -> Column:
    """Points per year from their own density; NULL below two points or without a span."""
    days = F.datediff(F.max("ts"), F.min("ts"))
    return F.when(
        (F.count("*") >= 2) & (days > 0), F.count("*") / (days / F.lit(DAYS_PER_YEAR))
    )


def total_return() -> Column:
    return F.try_divide(F.max_by("equity", "ts"), F.min_by("equity", "ts")) - 1.0


def max_drawdown() -> Column:
    """Signed: never above zero."""
    return F.min("dd")


def annualized_return(ppy: Column) -> Column:
    ratio = F.try_divide(F.max_by("equity", "ts"), F.min_by("equity", "ts"))
    return F.when(ratio > 0, F.pow(ratio, ppy / F.count("*")) - 1.0)


def annualized_volatility(ppy: Column) -> Column:
    return F.stddev_samp("ret") * F.sqrt(ppy)


def sharpe_ratio(ppy: Column, risk_free: float = 0.0) -> Column:
    excess = F.avg("ret") - F.lit(float(risk_free)) / ppy
    return F.try_divide(excess, F.stddev_samp("ret")) * F.sqrt(ppy)


def calmar_ratio(ppy: Column) -> Column:
    """NULL for a curve that never falls."""
    return F.try_divide(annualized_return(ppy), F.abs(F.min("dd")))


def performance(
    curves: DataFrame,
    key: str = "run_id",
    risk_free: float = 0.0,
    ppy: float | None = None,
    weights: DataFrame | None = None,
    dates: DataFrame | None = None,
) -> DataFrame:
    """One row of metrics per run; with `weights` (and their `dates`) also turnover and rebalance count."""
    per_year = periods_per_year() if ppy is None else F.lit(float(ppy))
    out = with_returns(curves, key).groupBy(key).agg(
        F.min_by("equity", "ts").alias("initial_equity"),
        F.max_by("equity", "ts").alias("final_equity"),
        total_return().alias("total_return"),
        annualized_return(per_year).alias("annualized_return"),
        annualized_volatility(per_year).alias("annualized_volatility"),
        sharpe_ratio(per_year, risk_free).alias("sharpe_ratio"),
        max_drawdown().alias("max_drawdown"),
        calmar_ratio(per_year).alias("calmar_ratio"),
        F.lit(float(risk_free)).alias("risk_free_rate"),
        per_year.alias("annualization_periods"),
    )
    return out if weights is None else out.join(turnover(weights, key, dates=dates), key, "left")


def weight_changes(
    weights: DataFrame, key: str = "run_id", name: str = "symbol_id", dates: DataFrame | None = None
) -> DataFrame:
    """Sum of |change of weight| per run and rebalance date; absent weights are 0, the first date is 0.

    Each name only meets its own rows: where it was absent on the date before, or is on the date
    after, the missing side counts as 0, so the date x name grid is not needed. `dates` (run, ts) are the
    rebalance dates where weights have no rows for zeros; without them, the dates of the weights.
    """
    dates = (weights if dates is None else dates).select(key, "ts").distinct()
    by_date = Window.partitionBy(key).orderBy("ts")
    order = dates.withColumn("_n", F.row_number().over(by_date)).withColumn(
        "_next", F.lead("ts").over(by_date)
    )
    w = Window.partitionBy(key, name).orderBy("ts")
    rows = weights.select(key, "ts", name, F.coalesce("weight", F.lit(0.0)).alias("weight")).join(
        order, [key, "ts"]
    )
    near = (F.lag("_n").over(w) == F.col("_n") - 1) & (F.col("_n") > 1)
    entered = F.when(F.col("_n") == 1, 0.0).otherwise(
        F.abs(F.col("weight") - F.when(near, F.lag("weight").over(w)).otherwise(0.0))
    )
    left = F.when(
        F.col("_next").isNotNull()
        & ~F.coalesce(F.lead("_n").over(w) == F.col("_n") + 1, F.lit(False)),
        F.abs("weight"),
    ).otherwise(0.0)
    parts = rows.select(
        key, "ts", "_next", entered.alias("_entered"), left.alias("_left")
    ).select(
        key,
        F.inline(
            F.array(
                F.struct(F.col("ts").alias("ts"), F.col("_entered").alias("change")),
                F.struct(F.coalesce("_next", "ts").alias("ts"), F.col("_left").alias("change")),
            )
        ),
    )
    parts = parts.unionByName(dates.withColumn("change", F.lit(0.0)))
    return parts.groupBy(key, "ts").agg(F.sum("change").alias("change"))


def turnover(
    weights: DataFrame, key: str = "run_id", name: str = "symbol_id", dates: DataFrame | None = None
) -> DataFrame:
    """Total |change of weight| and the number of rebalances that moved anything."""
    return (
        weight_changes(weights, key, name, dates)
        .groupBy(key)
        .agg(
            F.sum("change").alias("turnover"),
            F.count_if(F.col("change") > 1e-12).alias("n_rebalances"),
        )
    )


def trade_summary(fills: DataFrame) -> DataFrame:
    """Count, total cost and smallest cash over a fill table (cost, cash)."""
    return fills.agg(
        F.count("*").alias("n_trades"),
        F.sum("cost").alias("total_cost"),
        F.min("cash").alias("min_cash"),
    )
