"""Market tables derived from the driver's star schema (lineitem, orders, events)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkite.session import settle

N_EXCHANGES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fixed(c: Column) -> Column:
    """Six decimals; the offset keeps exact ties from rounding differently in another engine."""
    return F.round(c + 1.23e-9, 6)


def _bars(items: DataFrame) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    w = Window.partitionBy("symbol_id").orderBy("ts")
    return (
        items.groupBy("symbol_id", "ts")
        .agg(
            _fixed(F.max(unit)).alias("high"),
            _fixed(F.min(unit)).alias("low"),
            _fixed(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.round(F.sum("l_extendedprice"), 2).alias("amount"),
        )
        .withColumn("open", F.coalesce(F.lag("close").over(w), "close"))
        .withColumn("traded", F.col("volume") >= 20)
        .withColumn("available_utc", F.date_add("ts", 1).cast("timestamp_ntz"))
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a trade, on its ship date, of the symbol that its supplier belongs to.

    About twelve suppliers make a symbol, so that it trades on most days and the number of symbols
    grows with the suppliers.
    """
    symbols = table(spark, sf_dir, "supplier").agg(F.greatest(F.lit(8), F.floor(F.count("*") / 12))).scalar()
    return table(spark, sf_dir, "lineitem").withColumns(
        {"ts": F.col("l_shipdate").cast("date"), "symbol_id": F.col("l_suppkey") % symbols}
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of all symbols."""
    return _bars(trades(spark, sf_dir))


def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars, one symbol per supplier."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_extendedprice",
        "l_quantity",
        F.col("l_suppkey").alias("symbol_id"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("ts"),
    )
    return _bars(items)


def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits (ratio 2) and dividends, at most one row per symbol, date and kind.

    A day has a split where one of its trades is of 50 units as a seventh line, a dividend where one
    is of 49.
    """
    line7 = F.col("l_linenumber") == 7
    marks = F.inline(
        F.array(
            *[
                F.struct(F.lit(kind).alias("kind"), F.col(f"_{kind}").alias("_tax"))
                for kind in ("split", "dividend")
            ]
        )
    )
    return (
        trades(spark, sf_dir)
        .groupBy("symbol_id", F.col("ts").alias("ex_date"))
        .agg(
            F.max(F.when(line7 & (F.col("l_quantity") == 50), F.col("l_tax"))).alias("_split"),
            F.max(F.when(line7 & (F.col("l_quantity") == 49), F.col("l_tax"))).alias("_dividend"),
        )
        .select("symbol_id", "ex_date", marks)
        .where("_tax IS NOT NULL")
        .select(
            "symbol_id",
            "ex_date",
            "kind",
            F.when(F.col("kind") == "split", F.lit(2.0)).alias("ratio"),
            F.when(F.col("kind") == "dividend", F.col("_tax")).alias("cash"),
            F.date_sub("ex_date", 10).cast("timestamp_ntz").alias("available_utc"),
        )
    )


def fx_rates(spark: SparkSession, sf_dir: str, reverse: bool = True) -> DataFrame:
    """Daily rate per event type against CNY; 'view' is quoted the other way on odd days."""
    rates = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("base"), F.col("ts").cast("date").alias("ts"))
        .agg(_fixed(F.avg("value")).alias("rate"))
        .select("base", F.lit("CNY").alias("quote"), "ts", "rate")
    )
    if not reverse:
        return rates
    flip = (F.col("base") == "view") & (F.dayofmonth("ts") % 2 == 1)
    return rates.select(
        F.when(flip, F.col("quote")).otherwise(F.col("base")).alias("base"),
        F.when(flip, F.col("base")).otherwise(F.col("quote")).alias("quote"),
        "ts",
        F.when(flip, 1.0 / F.col("rate")).otherwise(F.col("rate")).alias("rate"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols; listed some time after their first trade, symbol 5 delisted in 2000."""
    return (
        trades(spark, sf_dir)
        .groupBy("symbol_id")
        .agg(F.min("ts").alias("_first"))
        .select(
            "symbol_id",
            F.concat(F.lit("SYM"), F.col("symbol_id")).alias("ticker"),
            F.concat(F.lit("X"), F.col("symbol_id") % N_EXCHANGES).alias("exchange"),
            F.when(F.col("symbol_id") != 7, F.date_add("_first", (F.col("symbol_id") % 8 * 30).cast("int")))
            .alias("listed_on"),
            F.when(F.col("symbol_id") == 5, F.lit("2000-06-30").cast("date")).alias("delisted_on"),
        )
    )


def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every natural day per exchange; open on weekdays with at least one order."""
    days = (
        table(spark, sf_dir, "lineitem")
        .agg(F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b"))
        .select(F.explode(F.sequence("a", "b")).alias("ts"))
    )
    opens = (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderdate").cast("date").alias("ts"), F.lit(True).alias("_open"))
        .where(F.dayofweek("ts").between(2, 6))
        .distinct()
    )
    names = F.explode(F.array(*[F.lit(f"X{i}") for i in range(N_EXCHANGES)]))
    return days.join(opens, "ts", "left").select(
        names.alias("exchange"), "ts", F.coalesce("_open", F.lit(False)).alias("is_open")
    )


def curves_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One equity curve per event type."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("name"), F.col("ts").cast("date").alias("ts"))
        .agg(_fixed(F.avg("value")).alias("equity"))
    )


def curves_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One equity curve per user: many runs for the metric operators."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("run_id"), F.col("ts").cast("date").alias("ts"))
        .agg(_fixed(F.avg("value")).alias("equity"))
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily bars as they stood in yearly snapshots: each holds the bars up to its year's end.

    Closes of earlier snapshots differ, so a wrong pick shows in the values.
    """
    runs = ledger(spark, sf_dir).select("snapshot_id", F.substring("snapshot_id", 2, 4).cast("int").alias("_year"))
    bars = bars_daily(spark, sf_dir).withColumn("_own", F.year("ts"))
    # one row per year of orders
    known = bars.join(F.broadcast(runs), F.col("_own") <= F.col("_year"))
    return known.withColumn("close", _fixed(F.col("close") + (F.col("_year") - F.col("_own")))).drop("_year", "_own")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run ledger of the yearly snapshots, from all orders: a year with more open than filled orders failed."""
    year = F.year("o_orderdate")
    filled = F.count_if(F.col("o_orderstatus") == "F")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.concat(F.lit("s"), year).alias("snapshot_id"))
        .agg(
            F.when(filled >= F.count_if(F.col("o_orderstatus") == "O"), "ok").otherwise("failed").alias("status"),
            F.max("o_orderdate").cast("timestamp_ntz").alias("finished_at"),
        )
        .select("snapshot_id", F.lit("bars_daily").alias("dataset"), "status", "finished_at")
    )


def fund_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor adjustment factors, absent on dates without a trade in the first three lines."""
    early = F.when(F.col("l_linenumber") <= 3, F.col("l_tax"))
    return (
        trades(spark, sf_dir)
        .groupBy("symbol_id", "ts")
        .agg(_fixed(1.0 + F.avg(early)).alias("adj_factor"))
        .where("adj_factor IS NOT NULL")
    )


def mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly weights of the event types in two portfolios: by activity, and equal.

    A week's weights come from all its events and stand at its first day with any.
    """
    week = F.date_trunc("week", "ts").alias("_week")
    weekly = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("name"), week)
        .agg(F.count("*").alias("_n"), F.min(F.col("ts").cast("date")).alias("_first"))
    )
    totals = weekly.groupBy("_week").agg(F.sum("_n").alias("_all"), F.min("_first").alias("ts"))
    both = F.inline(
        F.array(
            F.struct(
                F.lit("activity").alias("run_id"),
                _fixed(0.9 * F.col("_n") / F.col("_all")).alias("weight"),
            ),
            F.struct(F.lit("equal").alias("run_id"), F.lit(0.15).alias("weight")),
        )
    )
    return settle(weekly.join(totals, "_week").select("ts", "name", both), "mix-weights")


def mix_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event-type curves, once per portfolio."""
    runs = F.explode(F.array(F.lit("activity"), F.lit("equal"))).alias("run_id")
    return settle(curves_by_type(spark, sf_dir).select(runs, "name", "ts", "equity"), "mix-curves")


def activity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each user in a type's daily activity: (run_id = type, symbol_id = user)."""
    daily = (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("run_id"),
            F.col("ts").cast("date").alias("ts"),
            F.col("user_id").alias("symbol_id"),
        )
        .agg(F.count("*").alias("_n"))
    )
    totals = daily.groupBy("run_id", "ts").agg(F.sum("_n").alias("_all"))
    return daily.join(totals, ["run_id", "ts"]).select(
        "run_id", "ts", "symbol_id", (F.col("_n") / F.col("_all")).alias("weight")
    )
