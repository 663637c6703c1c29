"""Ingest of normalised tables: gate, identity, snapshot, ledger."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite import schema
from panelkite.operators.constraints import ingest_gate
from panelkite.session import settle
from panelkite.sources.common import stamp
from panelkite.sources.fingerprint import fingerprint, snapshot_id
from panelkite.sources.ledger import current_status, insert_absent, ledger_rows
from panelkite.sources.snapshots import publish, read_table, rows_at, write_table

STATES = "snapshot_id STRING, dataset STRING, status STRING, event_ts TIMESTAMP_NTZ, note STRING"
DATED = {"bars_daily"}


@dataclass(frozen=True)
class IngestResult:
    snapshot_id: str
    status: str


def _log(spark: SparkSession, root: str, snapshot: str, tables, status: str, at: str, note: str = "") -> None:
    rows = [(snapshot, name, status) for name in tables]
    events = spark.createDataFrame(rows, "snapshot_id STRING, dataset STRING, status STRING")
    events.withColumns(
        {"event_ts": F.lit(at).cast("timestamp_ntz"), "note": F.lit(note)}
    ).write.mode("append").parquet(f"{root}/_events")


def status_of(spark: SparkSession, root: str) -> DataFrame:
    """Latest state of every (snapshot, dataset)."""
    return current_status(rows_at(spark, f"{root}/_events", STATES))


def ledger_of(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the ledger: the snapshots that readers may follow."""
    return rows_at(spark, f"{root}/_ledger", schema.COLUMNS["ingest_runs"])


def refuse_broken(tables: Mapping[str, DataFrame]) -> None:
    """Raise when an invariant fails. One small row per rule comes back."""
    broken = ingest_gate(tables).where("violations > 0").collect()
    if broken:
        lines = ", ".join(sorted(f"{r.check}={r.violations}" for r in broken))
        raise ValueError(f"refused: {lines}")


def ingest(
    tables: Mapping[str, DataFrame], source: str, root: str, started_at: str, finished_at: str
) -> IngestResult:
    """Store `tables` as one immutable snapshot named by its content.

    A snapshot is complete with its ledger rows, one for each table, and then published. The same content
    again is recognised by them and not rewritten. Without them an earlier attempt was cut short; its
    tables are kept where their content is right and written anew where not. The events say running
    before the write and ok after it, or aborted when the write fails. The tables are computed once and
    written to the scratch folder, as the gate, the fingerprint and the snapshot each read them.
    """
    spark = next(iter(tables.values())).sparkSession
    tables = {t: settle(df, f"ingest-{t}") for t, df in tables.items()}
    refuse_broken(tables)
    name = snapshot_id(source, tables).first().snapshot_id
    listed = ledger_of(spark, root).where(F.col("snapshot_id") == name).select("dataset").collect()
    if set(tables) <= {r.dataset for r in listed}:
        known = status_of(spark, root).where((F.col("snapshot_id") == name) & (F.col("status") == "ok"))
        if known.count() < len(tables):
            _log(spark, root, name, tables, "ok", finished_at, "registered again")
        publish(spark, root, name, tables)
        return IngestResult(name, "exists")
    _log(spark, root, name, tables, "running", started_at)
    try:
        for t, df in tables.items():
            if not _holds(read_table(spark, root, t, name), df):
                write_table(stamp(df, source, name, started_at if t in DATED else None), root, t, name)
    except Exception as exc:
        _log(spark, root, name, tables, "aborted", finished_at, type(exc).__name__)
        raise
    stored = {t: read_table(spark, root, t, name) for t in tables}
    rows = ledger_rows(stored, name, source).withColumns(
        {
            "started_at": F.lit(started_at).cast("timestamp_ntz"),
            "finished_at": F.lit(finished_at).cast("timestamp_ntz"),
            "note": F.lit(None).cast("string"),
        }
    )
    fresh = insert_absent(ledger_of(spark, root), rows, ["snapshot_id", "dataset"])
    fresh.write.mode("append").parquet(f"{root}/_ledger")
    publish(spark, root, name, tables)
    _log(spark, root, name, tables, "ok", finished_at)
    return IngestResult(name, "ok")


def _holds(stored: DataFrame | None, df: DataFrame) -> bool:
    """Whether a stored table has the content of `df`, apart from the columns stamped on it."""
    if stored is None or not set(df.columns) <= set(stored.columns):
        return False
    return fingerprint(stored.select(df.columns)).first() == fingerprint(df).first()
