"""Ingest ledger, keyed tables and the newest good snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkite.operators.joins import union_frames
from panelkite.sources.fingerprint import fingerprint


def latest_snapshot(ledger: DataFrame, dataset: str = "bars_daily") -> DataFrame:
    """Id of the newest successful run of a dataset, as one row."""
    good = ledger.where((F.col("dataset") == dataset) & (F.col("status") == "ok"))
    return good.agg(F.max_by("snapshot_id", "finished_at").alias("snapshot_id"))


def latest_rows(table: DataFrame, ledger: DataFrame, dataset: str = "bars_daily") -> DataFrame:
    """Rows of that one snapshot. On a table partitioned by snapshot_id only its files are read."""
    return table.where(F.col("snapshot_id") == latest_snapshot(ledger, dataset).scalar())


def ledger_rows(tables: Mapping[str, DataFrame], snapshot_id: str, source: str) -> DataFrame:
    """One ok row per table: row count, last date and content fingerprint."""
    parts = []
    for name, df in tables.items():
        mark = F.lit(None).cast("date")
        if "ts" in df.columns:
            mark = df.agg(F.max("ts").cast("date")).scalar()
        parts.append(
            fingerprint(df)
            .select(
                F.lit(snapshot_id).alias("snapshot_id"),
                F.lit(source).alias("source"),
                F.lit(name).alias("dataset"),
                "rows",
                mark.alias("watermark"),
                F.col("fingerprint").alias("file_hash"),
                F.lit("ok").alias("status"),
            )
        )
    return union_frames(parts)


def current_status(events: DataFrame) -> DataFrame:
    """Latest state per (snapshot_id, dataset) of an append-only event table.

    Of events at one time a final state counts, not the running one, and ok before the others.
    """
    final = F.when(F.col("status") == "ok", 2).when(F.col("status") == "running", 0).otherwise(1)
    return events.groupBy("snapshot_id", "dataset").agg(
        F.max_by("status", F.struct("event_ts", final, "status")).alias("status"),
        F.max("event_ts").alias("event_ts"),
    )


def watermark(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Latest date over the bars, rates and macro tables present."""
    dated = [df for n, df in tables.items() if n in ("bars_daily", "fx_rates", "macro_series")]
    return union_frames([df.agg(F.max("ts").alias("ts")) for df in dated]).agg(
        F.max("ts").alias("watermark")
    )


def insert_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new` whose key the table does not hold yet."""
    return new.join(existing.select(*keys), list(keys), "left_anti").select(*new.columns)


def upsert_latest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Newest version per key, over old and new rows together.

    A maximum per key combines before the shuffle, so a key rewritten very often stays cheap.
    """
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(version, *rest)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*rows.columns)
    )


def runs_of(runs: DataFrame, run_id: str) -> DataFrame:
    """The record of one run."""
    return runs.where(F.col("run_id") == run_id)


def run_metrics_of(metrics: DataFrame, run_id: str) -> DataFrame:
    return metrics.where(F.col("run_id") == run_id).orderBy("metric")
