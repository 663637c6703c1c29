"""Steps shared by the vendor jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkite.functions.crosssection import cross_sectional_rank

# Fixed values.
BLANK_DATES = ["", "nan", "None", "NaT"]
CLOSE_HOURS_CN = 7
CLOSE_HOURS_HK = 8
LAG_DAYS = 1
XHKG_ID_BASE = 1_000_000_000
RELEASE_BUFFER_MINUTES = {"XSHG": 30, "XHKG": 30, "XNYS": 15}


def require_columns(df: DataFrame, columns: Sequence[str], source: str) -> None:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"{source}: raw table lacks {gone}")


def numbers(*columns: str) -> list[Column]:
    return [F.col(c).cast("double").alias(c) for c in columns]


def to_day(c: Column | str, fmt: str = "yyyyMMdd") -> Column:
    """Text date; blanks and the usual words for a missing value become NULL."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.to_date(F.when(~text.isin(BLANK_DATES), text), fmt)


def at_hour(ts: Column | str, hours: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hours))


def available_after(ts: Column | str, days: Column | int = LAG_DAYS) -> Column:
    """Midnight of the day `days` later: the cautious assumption without a release time."""
    return F.date_add(ts, days).cast("timestamp_ntz")


def to_naive_utc(c: Column | str) -> Column:
    """Time with a zone, as text or timestamp, to UTC without one."""
    local = (F.col(c) if isinstance(c, str) else c).cast("timestamp").cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)


def release_time(close: Column | str, exchange: Column | str) -> Column:
    """Close plus the publication buffer of the exchange; NULL for an unknown exchange."""
    exchange = F.col(exchange) if isinstance(exchange, str) else exchange
    minutes = F.lit(None).cast("int")
    for name, m in RELEASE_BUFFER_MINUTES.items():
        minutes = F.when(exchange == name, m).otherwise(minutes)
    close = F.col(close) if isinstance(close, str) else close
    return close + F.make_dt_interval(mins=minutes)


def crop(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def stamp(df: DataFrame, source: str, snapshot_id: str, downloaded_at: str | None = None) -> DataFrame:
    """Audit columns; `downloaded_at` only where the table has it."""
    columns = {"source": F.lit(source), "snapshot_id": F.lit(snapshot_id)}
    if downloaded_at is not None:
        columns["downloaded_at"] = F.lit(downloaded_at).cast("timestamp_ntz")
    return df.withColumns(columns)


def assign_ids(codes: DataFrame, code: str = "ts_code", base: int = 0, pieces: int | None = None) -> DataFrame:
    """(code, symbol_id): base + position among the sorted distinct codes.

    For the first load of an exchange block; later codes are appended by `append_ids`, because a
    new code that sorts early would shift every id after it.
    """
    distinct = codes.select(F.col(code).cast("string").alias("code")).distinct()
    ranked = cross_sectional_rank(
        distinct.withColumn("_all", F.lit(0)), "code", "_n", "_all", ascending=True, pieces=pieces
    )
    return ranked.select("code", (F.col("_n") + base).cast("long").alias("symbol_id"))


def append_ids(known: DataFrame, codes: DataFrame, code: str = "ts_code") -> DataFrame:
    """Keep the ids of `known` (code, symbol_id) and number new codes after the greatest one."""
    fresh = (
        codes.select(F.col(code).cast("string").alias("code"))
        .distinct()
        .join(known.select("code"), "code", "left_anti")
    )
    top = known.agg(F.coalesce(F.max("symbol_id"), F.lit(0))).scalar()
    added = assign_ids(fresh, "code").withColumn("symbol_id", F.col("symbol_id") + top)
    return known.select("code", "symbol_id").unionByName(added)


def merge_pages(pages: Sequence[DataFrame], key: str = "date") -> DataFrame:
    """Union of overlapping pages, one row per key: that of the earliest page."""
    out = None
    for i, page in enumerate(pages):
        part = page.withColumn("_page", F.lit(i))
        out = part if out is None else out.unionByName(part)
    rest = [F.struct(*[c for c in out.columns if c not in (key, "_page")])]
    best = out.groupBy(key).agg(F.min_by(rest[0], F.struct("_page", *rest)).alias("_row"))
    return best.select(key, "_row.*")


def lookup(c: Column | str, values: Mapping[str, str], default: str | None) -> Column:
    """Constant mapping of a text column."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out
