"""Ranking across symbols on each date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkite.schema import null_nan
from panelkite.session import partitions_of, settle

NUMERIC = ("double", "float", "long", "integer", "short", "byte")


def cross_sectional_rank(
    df: DataFrame,
    value: str,
    out: str = "rank",
    by: str = "ts",
    ascending: bool = False,
    pieces: int | None = None,
) -> DataFrame:
    """Rank of `value` among the rows of each `by`, ties averaged, NULL and NaN unranked.

    One range shuffle puts the rows in order of (by, value) over `pieces` partitions, as many as shuffle
    partitions unless given, so a large date is not ranked in one task. Equal values share a partition;
    a row's place in its partition, and the rows of its date in the partitions before, make the rank.
    Nothing is joined on values. The ordered rows are written once, as the partitions are counted first;
    `df` is evaluated once, but for the sample of its last stage that the ranges are cut from.

    Rows without a value, however many, are spread at random behind the dates.
    """
    if not isinstance(ascending, bool):
        raise ValueError("ascending must be a bool")
    kind = df.schema[value].dataType.typeName()
    if kind in ("double", "float"):
        df = df.withColumn(value, null_nan(F.col(value)))
    v = F.col(value)
    anywhere = F.xxhash64(F.monotonically_increasing_id()).cast(df.schema[value].dataType) if kind in NUMERIC else v
    keyed = df.withColumns({"_by": F.when(v.isNotNull(), F.col(by)), "_value": F.coalesce(v, anywhere)})
    order = [F.col("_by"), F.col("_value").asc() if ascending else F.col("_value").desc()]
    # the ranges cluster equal (_by, _value), so the window needs no shuffle of its own
    ties = Window.partitionBy("_by", "_value")
    placed = (
        keyed.repartitionByRange(pieces or partitions_of(df.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
        .withColumns({"_first": F.min("_place").over(ties), "_same": F.count("*").over(ties)})
        .drop("_value", "_place")
    )
    rows = settle(placed, "ranked-rows")
    before = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most a row per date and one more per partition
    starts = (
        rows.where("_by IS NOT NULL")
        .groupBy("_by", "_part")
        .agg(F.min("_first").alias("_start"), F.count("*").alias("_n"))
        .select("_by", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start")).alias("_shift"))
    )
    rank = F.col("_shift") + F.col("_first") + (F.col("_same") + 1) / 2.0
    return rows.join(starts, ["_by", "_part"], "left").select(*df.columns, rank.alias(out))
