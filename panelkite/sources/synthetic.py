"""Known-answer panels: prices that follow from declared returns, actions, halts and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.session import partitions_of


def digest(*parts: Column) -> Column:
    """Hex text fixed by the parts; `uniform` and `normal` read numbers from it."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def uniform(hexes: Column | str, slot: int = 0) -> Column:
    """In (0, 1), from 13 hex digits; a digest has two slots of them."""
    digits = F.conv(F.substring(hexes, 13 * slot + 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / float(2**52)


def normal(hexes: Column | str) -> Column:
    """Standard normal by the Box-Muller transform."""
    return F.sqrt(-2.0 * F.ln(uniform(hexes))) * F.cos(uniform(hexes, 1) * (2 * 3.141592653589793))


#: Series of the same calendar that one task makes.
SERIES_PER_TASK = 200


def series_tasks(series: DataFrame) -> int:
    """Tasks for a small table whose rows each become a whole series, in proportion to its rows."""
    return max(partitions_of(series.sparkSession), -(-series.count() // SERIES_PER_TASK))


def spread(df: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Hash by `key` into a number of partitions that grows with the rows, unless it is given.

    For a small table whose rows each become a whole series: the rows are shuffled before they
    multiply, the series need no shuffle after, and the fixed number keeps them from being merged.
    """
    return df.repartition(series_tasks(df) if tasks is None else tasks, key)


def session_grid(symbols: DataFrame, sessions: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every symbol on its exchange's sessions, with the position idx; dealt by symbol over `tasks`."""
    # one row per exchange and day, held as one sorted array per exchange
    days = sessions.groupBy("exchange").agg(F.array_sort(F.collect_set("ts")).alias("_days"))
    tasks = series_tasks(symbols) if tasks is None else tasks
    rows = spread(symbols.join(days, "exchange"), "symbol_id", tasks)
    return rows.select(*symbols.columns, F.posexplode("_days").alias("idx", "ts"))


def price_panel(
    symbols: DataFrame,
    sessions: DataFrame,
    actions: DataFrame | None = None,
    halts: DataFrame | None = None,
    failures: DataFrame | None = None,
    seed: int = 0,
    tasks: int | None = None,
) -> DataFrame:
    """Bars and analytic total return of every symbol on its exchange's sessions.

    symbols: symbol_id, exchange, init_price, mu, sigma; sessions: exchange, ts;
    actions: symbol_id, ts, split_ratio, dividend; halts and failures: symbol_id, ts.
    With growth g, split r and dividend d the close is g * previous / r - d. Unrolled, that is
    A * (first - sum of d / A), A the running product of g / r, so no walk over days is needed.
    `tasks` share the symbols, a number in proportion to the symbols unless given. Halted days do not move and have no volume; failed days have no row but do move the return.
    """
    tasks = series_tasks(symbols) if tasks is None else tasks
    key = ["symbol_id", "ts"]
    empty = "symbol_id BIGINT, ts DATE"
    spark = symbols.sparkSession
    actions = actions or spark.createDataFrame([], f"{empty}, split_ratio DOUBLE, dividend DOUBLE")
    halts = halts or spark.createDataFrame([], empty)
    failures = failures or spark.createDataFrame([], empty)
    marked = symbols.select("symbol_id", "exchange", "init_price", "mu", "sigma")
    marks = {"_actions": actions.select(*key, "split_ratio", "dividend"), "_halts": halts.select(*key), "_failures": failures.select(*key)}
    # the marks of a symbol, bounded by its calendar, meet it before its row becomes a series, which is then not shuffled
    for name, mark in marks.items():
        rows = F.collect_list(F.struct(*[c for c in mark.columns if c != "symbol_id"]))
        marked = marked.join(mark.groupBy("symbol_id").agg(rows.alias(name)), "symbol_id", "left")
    marked = session_grid(marked, sessions, tasks)

    def on_day(name: str) -> Column:
        return F.filter(name, lambda m: m["ts"] == F.col("ts"))

    marked = marked.select("*", F.explode_outer(on_day("_actions")).alias("_action"))
    marked = marked.select("*", F.explode_outer(on_day("_halts")).alias("_halted"))
    marked = marked.select("*", F.explode_outer(on_day("_failures")).alias("_failed")).select(
        *key,
        *("idx", "init_price", "mu", "sigma", "_action.split_ratio", "_action.dividend"),
        F.when(F.col("_halted").isNotNull(), True).alias("_halt"),
        F.when(F.col("_failed").isNotNull(), True).alias("_fail"),
    )
    w = Window.partitionBy("symbol_id").orderBy("ts")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    halted = F.coalesce("_halt", F.lit(False))
    g = F.when(halted | (F.col("idx") == 0), 1.0).otherwise(
        F.exp(F.col("mu") + F.col("sigma") * normal(digest(F.lit(seed), F.col("symbol_id"), F.col("idx"))))
    )
    first = F.col("idx") == 0
    r = F.when(first, 1.0).otherwise(F.coalesce("split_ratio", F.lit(1.0)))
    d = F.when(first, 0.0).otherwise(F.coalesce("dividend", F.lit(0.0)))
    grown = (
        marked.select(*key, "idx", "init_price", "_fail", halted.alias("_halt"), g.alias("_g"), r.alias("_r"), d.alias("_d"))
        .withColumn("_a", F.product(F.col("_g") / F.col("_r")).over(so_far))
        .withColumn("tri", F.product("_g").over(so_far))
        .withColumn("_paid", F.sum(F.col("_d") / F.col("_a")).over(so_far))
        .withColumn("close", F.col("_a") * (F.col("init_price") - F.col("_paid")))
    )
    noise = {t: digest(F.lit(seed), F.col("symbol_id"), F.col("idx"), F.lit(t)) for t in "ab"}
    high = F.greatest("_open", "close") * (1.0 + uniform("a", 1) * 0.01)
    low = F.least("_open", "close") * (1.0 - uniform("b") * 0.01)
    volume = F.round(1e6 * F.exp((uniform("b", 1) - 0.5) * 0.6))
    seen = (
        grown.where(F.col("_fail").isNull())
        .withColumns(noise)
        .withColumn("_open", F.col("close") * (1.0 + (uniform("a") - 0.5) * 0.016))
    )

    def unless_halted(c: Column, other: Column) -> Column:
        return F.when(F.col("_halt"), other).otherwise(c)

    return seen.select(
        *key,
        unless_halted(F.col("_open"), F.col("close")).alias("open"),
        unless_halted(high, F.col("close")).alias("high"),
        unless_halted(low, F.col("close")).alias("low"),
        "close",
        unless_halted(volume, F.lit(0.0)).alias("volume"),
        (~F.col("_halt")).alias("traded"),
        "tri",
    )


def rate_series(pairs: DataFrame, sessions: DataFrame, seed: int = 0) -> DataFrame:
    """Currency rates: pairs (base, quote, init_rate, drift, sigma) on the given days, known a day later."""
    days = sessions.agg(F.array_sort(F.collect_set("ts"))).scalar()
    # the pair as one key, so that the window finds its rows already together
    pairs = spread(pairs.withColumn("_pair", F.concat_ws("/", "base", "quote")), "_pair")
    w = Window.partitionBy("_pair").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("drift") / 252.0 + F.col("sigma") * normal(
        digest(F.lit(seed), F.concat("base", "quote"), F.col("idx"))
    )
    return (
        pairs.select("*", F.posexplode(days).alias("idx", "ts"))
        .withColumn("rate", F.col("init_rate") * F.exp(F.sum(step).over(w)))
        .select(
            "base", "quote", "ts", "rate", F.date_add("ts", 1).cast("timestamp_ntz").alias("available_utc")
        )
    )


def macro_levels(series: DataFrame, start: str, end: str, seed: int = 0) -> DataFrame:
    """Monthly levels: series (series_id, unit, init_value, drift, sigma, lag), released `lag` days later."""
    months = F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    w = Window.partitionBy("series_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("drift") / 12.0 + F.col("sigma") * normal(digest(F.lit(seed), F.col("series_id"), F.col("idx")))
    return (
        spread(series, "series_id").select("*", F.posexplode(months).alias("idx", "_m"))
        .withColumn("ts", F.last_day("_m"))
        .withColumn("value", F.col("init_value") + F.sum(step).over(w))
        .select(
            "series_id",
            "ts",
            "value",
            "unit",
            F.date_add("ts", F.col("lag")).cast("timestamp_ntz").alias("available_utc"),
        )
    )


def yearly_fundamentals(symbols: DataFrame, first: int, last: int, seed: int = 0) -> DataFrame:
    """One revenue figure per symbol and year, known 45 days after the year and published at nine."""
    base = F.col("init_price") * 10_000
    return (
        symbols.select("symbol_id", "init_price", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("_y"))
        .withColumn("period_end", F.make_date("_y", F.lit(12), F.lit(31)))
        .withColumn("as_of_date", F.date_add("period_end", 45))
        .select(
            "symbol_id",
            "period_end",
            "as_of_date",
            F.lit("revenue").alias("item"),
            (base * F.exp(0.05 + 0.08 * normal(digest(F.lit(seed), F.col("symbol_id"), F.col("_y"))))).alias("value"),
            (F.col("as_of_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(9))).alias(
                "available_utc"
            ),
        )
    )


def full_calendar(sessions: DataFrame, start: str, end: str, close_hour: int = 7) -> DataFrame:
    """Every natural day per exchange, with the close time of its sessions."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    opens = sessions.select("exchange", "ts").distinct().withColumn("_open", F.lit(True))
    close = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(close_hour))
    return (
        sessions.select("exchange")
        .distinct()
        .select("exchange", F.explode(days).alias("ts"))
        .join(opens, ["exchange", "ts"], "left")
        .select(
            "exchange",
            "ts",
            F.coalesce("_open", F.lit(False)).alias("is_open"),
            F.when(F.col("_open"), close).alias("session_close_utc"),
        )
    )


def answer_check(bars: DataFrame, navs: DataFrame, sessions: DataFrame, tasks: int | None = None) -> DataFrame:
    """Whether a recomputed total return gives the declared one back.

    Per symbol: the sessions without a bar, and the largest relative distance on the dates seen.
    A symbol with missing sessions cannot be reproduced day by day. On the dates it does have, only
    an action that fell into the gap makes a difference. With `tasks`, so many tasks share the dates.
    """
    key = ["symbol_id", "ts"]
    declared, found = bars.select(*key, "tri"), navs.select(*key, "total_return_nav")
    if tasks is not None:
        declared, found = declared.repartition(tasks, *key), found.repartition(tasks, *key)
    expected = sessions.groupBy("symbol_id").agg(F.count_distinct("ts").alias("_sessions"))
    return (
        declared
        # a generated series looks small to the planner, which does not see its rows multiply: never broadcast it
        .join(found.hint("merge"), key)
        .groupBy("symbol_id")
        .agg(
            F.count("*").alias("_seen"),
            F.max(F.abs(F.try_divide("total_return_nav", "tri") - 1.0)).alias("max_dev"),
        )
        .join(expected, "symbol_id")
        .select("symbol_id", (F.col("_sessions") - F.col("_seen")).alias("missing"), "max_dev")
    )
