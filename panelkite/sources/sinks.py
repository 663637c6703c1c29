"""Result tables and metrics of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_run_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Equity, positions, trades, weights ... as Parquet and as CSV with a header."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/parquet/{name}")
        df.write.mode("errorifexists").option("header", True).csv(f"{path}/csv/{name}")


NUMBERS = ("double", "float", "long", "integer", "short", "byte")


def _long(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value) of all metrics that are known; a column that holds no numbers is refused."""
    names = [f for f in metrics.schema.fields if f.name not in keys]
    odd = [f.name for f in names if f.dataType.typeName() not in NUMBERS and not f.dataType.typeName().startswith("decimal")]
    if odd:
        raise ValueError(f"metrics must be numbers: {odd}")
    wide = metrics.select(*keys, *[F.col(f.name).cast("double").alias(f.name) for f in names])
    return wide.unpivot(list(keys), [f.name for f in names], "metric", "value").where("value IS NOT NULL")


def _not_finite() -> Column:
    return F.isnan("value") | (F.abs("value") == float("inf"))


def metric_refusals(metrics: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """The metrics that `metric_rows` refuses, with their value as text."""
    return _long(metrics, keys).where(_not_finite()).withColumn("value", F.col("value").cast("string"))


def metric_rows(metrics: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """(run_id, metric, value) from one wide row per run.

    NULL is "not known" and gives no row. A value that is not finite stops the query, and a column that
    holds no numbers (text, booleans) is refused at once.
    """
    named = F.concat(F.lit("metric "), "metric", F.lit(" is not finite: "), F.col("value").cast("string"))
    value = F.when(_not_finite(), F.raise_error(named).cast("double")).otherwise(F.col("value"))
    return _long(metrics, keys).withColumn("value", value)
