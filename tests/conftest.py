from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from panelkite.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(shared / "tables"),
            "spark.sql.warehouse.dir": str(shared / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows and a DDL schema to a DataFrame; dates may be given as text."""

    def make(rows, ddl):
        import datetime as dt

        from pyspark.sql.types import DateType, StructType

        fields = StructType.fromDDL(ddl).fields
        fixed = [
            tuple(
                dt.date.fromisoformat(v) if isinstance(f.dataType, DateType) and isinstance(v, str) else v
                for v, f in zip(row, fields)
            )
            for row in rows
        ]
        return spark.createDataFrame(fixed, ddl)

    return make


@pytest.fixture(scope="session")
def panel_of(frame):
    """Columns of closes per symbol on consecutive days from 2024-01-01, dense, with idx."""
    import datetime as dt

    def make(columns: dict[int, list]):
        start = dt.date(2024, 1, 1)
        rows = [
            (s, start + dt.timedelta(days=i), i, x is not None, None if x is None else float(x))
            for s, xs in columns.items()
            for i, x in enumerate(xs)
        ]
        return frame(rows, "symbol_id BIGINT, ts DATE, idx INT, traded BOOLEAN, close DOUBLE")

    return make


@pytest.fixture(scope="session")
def column():
    """Values of one symbol in date order."""

    def read(df, name, symbol=1):
        return [r[name] for r in df.where(f"symbol_id = {symbol}").orderBy("ts").collect()]

    return read
