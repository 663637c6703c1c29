"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str = "panelkite", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the library's settings; `conf` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, the warehouse folder of the session, which is shared as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def partitions_of(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which is set to grow with the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Small tables are dealt over so many tasks, or the shuffle partitions if those are fewer.
MIN_TASKS = 8
#: Rows that one task sorts or groups. Memory of a task is then bounded however large the table is.
ROWS_PER_TASK = 200_000


def tasks_of(spark: SparkSession, rows: int) -> int:
    """Tasks to deal `rows` over, in proportion to them.

    The session's number of shuffle partitions may be too small for a large table, and tasks merged by
    their compressed size hold too many rows; ``repartition`` with this number is neither.
    """
    return max(min(MIN_TASKS, partitions_of(spark)), -(-rows // ROWS_PER_TASK))


def tasks_for(stored: DataFrame) -> int:
    """Tasks for the rows of a stored table, which are counted from the footers of its files."""
    return tasks_of(stored.sparkSession, stored.count())


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    For a result that several branches of a plan read: without it every branch repeats the scans
    and shuffles below. The table outlives lost executors, and its measured size lets Spark choose
    joins.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
