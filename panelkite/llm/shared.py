"""What the operators share: the written tables of a run, and document identity."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, as in tests, the warehouse folder of the session is used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, outlives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_of(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which is set to grow with the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def one_row_per_doc(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text`, with one row for each doc_id that is not null.

    Where a doc_id comes on several rows, equal or not, its greatest text counts; otherwise the rows
    pass without a shuffle. Only the ids are read to tell the two cases apart.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.max("text").alias("text"))
