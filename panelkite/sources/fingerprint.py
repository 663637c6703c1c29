"""Content fingerprints that depend on the rows alone: not on order, files or partitioning."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkite.schema import AUDIT_COLUMNS

MISSING = "<NA>"
SEPARATOR = "\x1f"
PIECES = 8  # eight hex digits each, added as two 16-bit lanes
DIGITS = 8
SHIFTS = (16, 0)
MASK = 2**16 - 1


def dtype_class(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int64"
    if isinstance(dtype, T.FractionalType):
        return "float64"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "text"


def normalise(df: DataFrame) -> DataFrame:
    """Every integer to 64 bits, every fraction to double, times to zone-less; the rest as text."""
    targets = {"int64": "bigint", "float64": "double", "bool": "boolean", "datetime": "timestamp_ntz"}
    return df.select(
        *[
            F.col(f.name).cast(targets.get(dtype_class(f.dataType), "string")).alias(f.name)
            for f in df.schema.fields
        ]
    )


def row_digest(df: DataFrame) -> Column:
    """sha-256 of the canonical text of a row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in df.columns]
    return F.sha2(F.concat_ws(SEPARATOR, *cells), 256)


def header(df: DataFrame) -> str:
    fields = df.schema.fields
    return SEPARATOR.join([f.name for f in fields] + [dtype_class(f.dataType) for f in fields])


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (fingerprint, rows).

    Row digests are added lane by lane and the sums hashed with the header. Addition needs no
    order and no shuffle of rows, and identical rows count as often as they occur, however many.
    """
    flat = normalise(df)
    digests = flat.select(row_digest(flat).alias("_h"))
    numbers = digests.select(
        *[
            F.conv(F.substring("_h", DIGITS * i + 1, DIGITS), 16, 10).cast("bigint").alias(f"_{i}")
            for i in range(PIECES)
        ]
    )
    parts = [
        F.shiftright(f"_{i}", shift).bitwiseAND(F.lit(MASK)) for i in range(PIECES) for shift in SHIFTS
    ]
    lanes = [F.coalesce(F.sum(p), F.lit(0)).alias(f"_s{i}") for i, p in enumerate(parts)]
    total = numbers.agg(F.count("*").alias("rows"), *lanes)
    text = F.concat_ws(
        SEPARATOR, F.lit(header(df)), F.col("rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(len(lanes))]
    )
    return total.select(F.sha2(text, 256).alias("fingerprint"), "rows")


def bundle_fingerprint(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One fingerprint of several tables: the hash of their sorted name:fingerprint lines."""
    parts = None
    for name, df in tables.items():
        line = F.concat(F.lit(f"{name}:"), F.col("fingerprint"))
        row = fingerprint(df).select(line.alias("line"))
        parts = row if parts is None else parts.unionByName(row)
    lines = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return parts.agg(F.sha2(lines, 256).alias("fingerprint"))


def snapshot_id(source: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """<source>-<16 hex digits> of the content without the columns stamped after it is known."""
    bare = {n: df.drop(*AUDIT_COLUMNS) for n, df in tables.items()}
    salted = F.sha2(F.concat(F.lit(f"{source}\n"), F.col("fingerprint")), 256)
    return bundle_fingerprint(bare).select(
        F.concat(F.lit(f"{source}-"), F.substring(salted, 1, 16)).alias("snapshot_id")
    )
