"""Consecutive numbers in an order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled

#: monotonically_increasing_id puts the partition above this many bits.
PART_BITS = 33


def in_order(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """`df` with `seq`, a long that ascends with `order` over the whole table; nulls come first.

    One range shuffle; the result is written, so that the numbers stay as they are. `df` should be cheap
    to read, as the ranges are sampled from it.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return settled(rows.withColumn("seq", F.monotonically_increasing_id()), label)


def numbered(df: DataFrame, group: str, order: Sequence[str], label: str) -> DataFrame:
    """`df` with `pos`, from 0 and gapless by `order` in each `group`, and `total`, the group's rows.

    `group` must not hold nulls. A group may fill many partitions: only a row per group and partition is
    summed up in order.
    """
    rows = in_order(df, [group, *order], label).withColumn("_part", F.shiftright("seq", PART_BITS))
    parts = rows.groupBy(group, "_part").agg(F.min("seq").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("total"),
    )
    placed = rows.join(settled(offsets, f"{label}-offsets"), [group, "_part"])
    return placed.withColumn("pos", F.col("seq") + F.col("_shift")).drop("seq", "_part", "_shift")
