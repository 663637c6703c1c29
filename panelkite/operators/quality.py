"""Data-quality rules.

A rule is a DataFrame of violating rows; `summarise` turns the violations of one or more rules into
rows (check, ok, violations, detail, samples). Nothing is collected: counts and at most five samples
are computed by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.operators.joins import union_frames
from panelkite.operators.panel import expected_sessions
from panelkite.session import settle, tasks_for

# Fixed thresholds of the rules.
JUMP_SIGMA = 8.0
JUMP_FLOOR = 0.15
JUMP_WINDOW = 60
JUMP_MIN_HISTORY = 20
FX_STALE_RUN = 10
PRICES = ("open", "high", "low", "close")


def violation_rows(
    check: str, violations: DataFrame, keys: Sequence[str], n: Column | None = None
) -> DataFrame:
    """(check, key, n): the violations of one rule with their key as text."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return violations.select(
        F.lit(check).alias("check"), text.alias("key"), (F.lit(1).cast("long") if n is None else n).alias("n")
    )


def summarise(violations: DataFrame, checks: Sequence[str]) -> DataFrame:
    """One row per check, also for those without a violation.

    The violations are written first: they are read twice, for the counts and for the five
    smallest keys, while the tables behind them are read once.
    """
    rows = settle(violations, "violations")
    names = rows.sparkSession.createDataFrame([(c,) for c in checks], "check STRING")
    counts = rows.groupBy("check").agg(F.sum("n").alias("violations"))
    first = Window.partitionBy("check").orderBy("key")
    samples = (
        rows.select("check", "key")
        .withColumn("_n", F.row_number().over(first))
        .where("_n <= 5")
        .groupBy("check")
        .agg(F.array_sort(F.collect_list("key")).alias("samples"))
    )
    n = F.coalesce("violations", F.lit(0).cast("long"))
    return (
        names.join(counts, "check", "left")
        .join(samples, "check", "left")
        .select(
            "check",
            (n == 0).alias("ok"),
            n.alias("violations"),
            F.concat(F.col("check"), F.lit(": "), n.cast("string")).alias("detail"),
            F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        )
    )


def finding(
    check: str, violations: DataFrame, keys: Sequence[str], n: Column | None = None
) -> DataFrame:
    """The result row of one rule."""
    return summarise(violation_rows(check, violations, keys, n), [check])


def skipped(anchor: DataFrame, check: str) -> DataFrame:
    """A rule that could not run for lack of its table; it is not a pass."""
    return anchor.sparkSession.createDataFrame([(check,)], "check STRING").select(
        "check",
        F.lit(True).alias("ok"),
        F.lit(0).cast("long").alias("violations"),
        F.concat(F.col("check"), F.lit(": skipped, not passed")).alias("detail"),
        F.array().cast("array<string>").alias("samples"),
    )


# --- rules on bars -----------------------------------------------------------------------------


def _has_bad_price() -> Column:
    return F.coalesce(F.least(*PRICES) <= 0, F.lit(False))


def _breaks_ohlc() -> Column:
    low = F.col("low") > F.least("open", "close")
    return F.coalesce(low | (F.col("high") < F.greatest("open", "close")), F.lit(False))


def non_positive_prices(bars: DataFrame) -> DataFrame:
    return bars.where(_has_bad_price())


def bad_ohlc(bars: DataFrame) -> DataFrame:
    return bars.where(_breaks_ohlc())


def price_rule_rows(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both rules on single bars in one pass."""
    broken = F.array_compact(
        F.array(
            F.when(_has_bad_price(), "positive_prices"), F.when(_breaks_ohlc(), "ohlc_relations")
        )
    )
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return bars.select(F.explode(broken).alias("check"), text.alias("key"), F.lit(1).cast("long").alias("n"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows. Copies are counted before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def check_unique_keys(bars: DataFrame, keys: Sequence[str] = ("symbol_id", "ts", "snapshot_id")) -> DataFrame:
    """All rows of duplicated keys count."""
    return finding("unique_keys", duplicate_keys(bars, keys), keys, F.col("rows"))


def unsorted_symbols(bars: DataFrame, seq: str, block: int = 1_000_000, tasks: int | None = None) -> DataFrame:
    """Symbols whose ts ever falls along the arrival sequence `seq`.

    The sequence is cut into blocks that are checked apart; then only the first and last ts of
    neighbouring blocks are compared, so a symbol with most of the rows is spread over its blocks.
    With `tasks`, so many tasks share the blocks.
    """
    rows = bars.select("symbol_id", "ts", seq, F.floor(F.col(seq) / block).alias("_b"))
    if tasks is not None:
        rows = rows.repartition(tasks, "symbol_id", "_b")
    inside = Window.partitionBy("symbol_id", "_b").orderBy(seq)
    blocks = (
        rows.withColumn("_falls", F.lag("ts").over(inside) > F.col("ts"))
        .groupBy("symbol_id", "_b")
        .agg(
            F.max("_falls").alias("_falls"),
            F.min_by("ts", seq).alias("_first"),
            F.max_by("ts", seq).alias("_last"),
        )
    )
    between = F.lag("_last").over(Window.partitionBy("symbol_id").orderBy("_b")) > F.col("_first")
    return (
        blocks.withColumn("_bad", F.coalesce("_falls", F.lit(False)) | F.coalesce(between, F.lit(False)))
        .groupBy("symbol_id")
        .agg(F.max("_bad").alias("_bad"))
        .where("_bad")
        .select("symbol_id")
    )


def calendar_gaps(bars: DataFrame, symbols: DataFrame, calendar: DataFrame) -> DataFrame:
    """Open days of a symbol's own exchange within its observed span that have no row."""
    spans = bars.groupBy("symbol_id").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    expected = expected_sessions(
        symbols.select("symbol_id", "exchange").join(spans, "symbol_id"),
        calendar,
        F.col("_a"),
        F.col("_b"),
    )
    return expected.join(bars.select("symbol_id", "ts"), ["symbol_id", "ts"], "left_anti")


def price_jumps(
    bars: DataFrame,
    price: str = "close_adj",
    sigma: float = JUMP_SIGMA,
    floor: float = JUMP_FLOOR,
    tasks: int | None = None,
) -> DataFrame:
    """Log returns beyond `floor` and beyond `sigma` deviations of the returns *before* that day.

    With `tasks`, so many tasks share the symbols.
    """
    price = price if price in bars.columns else "close"
    if tasks is not None:
        bars = bars.select("symbol_id", "ts", price).repartition(tasks, "symbol_id")
    w = Window.partitionBy("symbol_id").orderBy("ts")
    before = w.rowsBetween(-JUMP_WINDOW, -1)
    everything = Window.partitionBy("symbol_id")
    p = F.ln(F.col(price))
    return (
        bars.withColumn("_rows", F.count("*").over(everything))
        .withColumn("log_return", p - F.lag(p).over(w))
        .withColumn(
            "rolling_sigma",
            F.when(
                F.count("log_return").over(before) >= JUMP_MIN_HISTORY,
                F.stddev_samp("log_return").over(before),
            ),
        )
        .where(
            (F.col("_rows") >= JUMP_WINDOW + 2)
            & (F.col("rolling_sigma") > 0)
            & (F.abs("log_return") > floor)
            & (F.abs("log_return") > sigma * F.col("rolling_sigma"))
        )
        .select("symbol_id", "ts", "log_return", "rolling_sigma")
    )


# --- rules on currency rates -------------------------------------------------------------------


def flat_runs(fx: DataFrame) -> DataFrame:
    """Longest run of exactly equal consecutive rates per pair."""
    w = Window.partitionBy("base", "quote").orderBy("ts")
    changed = F.coalesce((F.col("rate") != F.lag("rate").over(w)).cast("int"), F.lit(1))
    return (
        fx.withColumn("_changed", changed)
        .withColumn("_run", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("base", "quote", "_run")
        .agg(F.count("*").alias("_n"))
        .groupBy("base", "quote")
        .agg(F.max("_n").alias("longest_flat_run"))
    )


def stale_pairs(fx: DataFrame, max_run: int = FX_STALE_RUN) -> DataFrame:
    return flat_runs(fx).where(F.col("longest_flat_run") > max_run)


def fx_direction_issues(fx: DataFrame) -> DataFrame:
    """One row if any rate is not positive, and one per ordered pair contradicting its reverse."""
    bad = (
        fx.agg(F.count_if(F.col("rate") <= 0).alias("rows"))
        .where("rows > 0")
        .select(F.lit("non_positive_rate").alias("issue"), F.lit("").alias("pair"), "rows")
    )
    mean = fx.groupBy("base", "quote", "ts").agg(F.avg("rate").alias("rate"))
    back = mean.select(
        F.col("quote").alias("base"), F.col("base").alias("quote"), "ts", F.col("rate").alias("_back")
    )
    pairs = (
        mean.join(back, ["base", "quote", "ts"])
        .where(F.abs(F.col("rate") * F.col("_back") - 1.0) > 1e-6)
        .groupBy("base", "quote")
        .agg(F.count("*").alias("rows"))
        .select(
            F.lit("inconsistent_direction").alias("issue"),
            F.concat_ws("/", "base", "quote").alias("pair"),
            "rows",
        )
    )
    return bad.unionByName(pairs)


def run_all_checks(
    bars: DataFrame,
    seq: str,
    symbols: DataFrame | None = None,
    calendar: DataFrame | None = None,
    fx: DataFrame | None = None,
    adjusted: DataFrame | None = None,
) -> DataFrame:
    """All rules, one row each; rules without their table report as skipped.

    The bars are written once, as every rule reads them, and dealt over tasks by their number.
    """
    bars = settle(bars, "checked-bars")
    tasks = tasks_for(bars)
    key = ["symbol_id", "ts"]
    unique = [*key, "snapshot_id"]
    ran = ["positive_prices", "ohlc_relations", "unique_keys", "sorted_by_ts", "price_jumps"]
    rows = [
        price_rule_rows(bars, key),
        violation_rows("unique_keys", duplicate_keys(bars, unique), unique, F.col("rows")),
        violation_rows("sorted_by_ts", unsorted_symbols(bars, seq, tasks=tasks), ["symbol_id"]),
        violation_rows("price_jumps", price_jumps(bars if adjusted is None else adjusted, tasks=tasks), key),
    ]
    left_out = []
    if calendar is None or symbols is None:
        left_out.append("calendar_gaps")
    else:
        ran.append("calendar_gaps")
        rows.append(violation_rows("calendar_gaps", calendar_gaps(bars, symbols, calendar), key))
    if fx is None:
        left_out += ["fx_staleness", "fx_direction"]
    else:
        ran += ["fx_staleness", "fx_direction"]
        rows.append(violation_rows("fx_staleness", stale_pairs(fx), ["base", "quote"]))
        rows.append(violation_rows("fx_direction", fx_direction_issues(fx), ["issue", "pair"]))
    return union_frames([summarise(union_frames(rows), ran), *[skipped(bars, c) for c in left_out]])


def failed_checks(report: DataFrame) -> list[str]:
    """Names of failed checks. Runs one action over the few report rows."""
    return [row["check"] for row in report.where(~F.col("ok")).select("check").collect()]


def assert_clean(report: DataFrame) -> None:
    failed = failed_checks(report)
    if failed:
        raise ValueError(f"failed checks: {', '.join(sorted(failed))}")
