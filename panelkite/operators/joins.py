"""Lookups, as-of joins and set operations over panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.session import settle


def map_symbols(df: DataFrame, code: str, ids: DataFrame) -> DataFrame:
    """Attach symbol_id for vendor code `code`; `ids` is (code, symbol_id).

    Unmapped codes keep a NULL id and are listed by `unmapped_codes`; none is dropped. The plan
    broadcasts `ids` only while its measured size allows it.
    """
    return df.join(ids.select(F.col("code").alias(code), "symbol_id"), code, "left")


def unmapped_codes(df: DataFrame, code: str, ids: DataFrame) -> DataFrame:
    """Distinct codes without an id, with their row counts."""
    return (
        df.groupBy(F.col(code).alias("code"))
        .agg(F.count("*").alias("rows"))
        .join(ids.select("code"), "code", "left_anti")
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    latest_by: str,
    block: str = "month",
) -> DataFrame:
    """Attach the last right row with right_time <= left_time; NULL when none is available yet.

    Rows that become available together resolve to the greatest `latest_by`, then to the greatest
    values. Both sides meet in one shuffle by key and time block and are read through in order of time;
    left rows pass through it, so `left` is evaluated once. A block starts from the last value of the
    blocks before it, which takes one row per key and block. A key with most of the rows is thus spread
    over its blocks. Left rows without a key or a time find nothing, right ones are never found.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    time = lambda c: F.col(c).cast("timestamp_ntz").alias("_t")
    updates = right.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], time(right_time), F.lit(0).alias("_side"),
        F.col(latest_by).alias("_order"), F.struct(*values).alias("_v"),
    ).dropna(subset=[*names, "_t"])
    probes = left.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], time(left_time), F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_row"),
    )
    parts = [*names, "_b"]
    within = Window.partitionBy(*parts).orderBy("_t", "_side", "_order", "_v")
    seen = F.last("_v", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    events = (
        updates.unionByName(probes, allowMissingColumns=True)
        .withColumn("_b", F.date_trunc(block, "_t"))
        .withColumn("_last", seen)
        .select(*parts, "_t", "_side", "_order", "_row", "_last")
    )
    read = settle(events, "asof-events")
    closing = read.groupBy(*parts).agg(F.max_by("_last", F.struct("_t", "_side", "_order", "_last")).alias("_close"))
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = closing.select(*parts, F.last("_close", ignorenulls=True).over(before).alias("_carry"))
    found = F.coalesce("_last", "_carry")
    out = read.where("_side = 1").join(carried.where("_carry IS NOT NULL"), parts, "left")
    return out.select("_row.*", *[found[v].alias(v) for v in values])


def cross_rate(fx: DataFrame, base: str, via: str, quote: str) -> DataFrame:
    """base/quote = via/quote divided by via/base, per date."""
    top = fx.where((F.col("base") == via) & (F.col("quote") == quote)).select(
        "ts", F.col("rate").alias("_top")
    )
    bottom = fx.where((F.col("base") == via) & (F.col("quote") == base)).select(
        "ts", F.col("rate").alias("_bottom")
    )
    return top.join(bottom, "ts").select(
        F.lit(base).alias("base"),
        F.lit(quote).alias("quote"),
        "ts",
        F.try_divide("_top", "_bottom").alias("rate"),
    )


def cross_rate_breaks(fx: DataFrame, base: str, via: str, quote: str, rtol: float = 1e-12) -> DataFrame:
    """Dates on which the quoted base/quote differs from the one derived over `via`."""
    derived = cross_rate(fx, base, via, quote).select("ts", F.col("rate").alias("derived"))
    quoted = fx.where((F.col("base") == base) & (F.col("quote") == quote)).select(
        "ts", F.col("rate").alias("quoted")
    )
    return quoted.join(derived, "ts").where(
        F.abs(F.col("quoted") - F.col("derived")) > F.lit(rtol) * F.abs("derived")
    )


def next_session(decisions: DataFrame, sessions: DataFrame, ts: str = "ts") -> DataFrame:
    """Attach the first session strictly after `ts`; NULL at the end of the sample and without a date.

    `sessions` has one row per date, so its ordered list is short; decisions may fall on any day.
    """
    later = sessions.agg(F.array_sort(F.collect_set("ts")).alias("_days"))
    dates = decisions.select(ts).where(F.col(ts).isNotNull()).distinct()
    following = dates.withColumn("_days", later.scalar()).select(
        ts, F.get(F.filter("_days", lambda d: d > F.col(ts)), F.lit(0)).alias("next_ts")
    )
    # one row per date of the calendar
    return decisions.join(F.broadcast(following), ts, "left")


def lost_weight(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """Dates on which a non-zero weight belongs to no symbol of the universe."""
    return (
        weights.join(universe.select("symbol_id"), "symbol_id", "left_anti")
        .groupBy("ts")
        .agg(F.sum(F.abs("weight")).alias("lost"))
        .where("lost > 0")
    )


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by name; absent columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_dates(frames: Sequence[DataFrame], key: str = "ts") -> DataFrame:
    """Distinct dates of all frames."""
    return union_frames([f.select(key) for f in frames]).distinct()


def missing_from(wanted: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(have.select(*keys), list(keys), "left_anti")


def common_to(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def resume_worklist(universe: DataFrame, attempts: DataFrame, retry: Column) -> DataFrame:
    """Codes still to fetch: never attempted, or last seen in a state that `retry` accepts.

    `attempts` is (code, status, attempted_at); the latest attempt of a code counts.
    """
    latest = attempts.groupBy("code").agg(F.max_by("status", "attempted_at").alias("status"))
    done = latest.where(~retry).select("code")
    return universe.select("code").distinct().join(done, "code", "left_anti")
