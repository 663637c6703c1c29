"""Run registered queries against their SQL on the same files and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, [tuple(cell(row[c]) for c in cols) for row in df.collect()]


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(cell(row[i]) for i in order) for row in cur.fetchall()]


def differences(spark, con, fn, sql, sf_dir, limit=4):
    """'' when equal, else a short description."""
    cols, got = spark_rows(fn(spark, sf_dir))
    want_cols, want = duck_rows(con, sql)
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    a, b = Counter(got), Counter(want)
    if a == b:
        return "" if got else "EMPTY"
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    key = lambda row: tuple((v is None, str(v)) for v in row)
    return (
        f"rows {len(got)} vs {len(want)}; {len(only_a)} differ\n  {cols}\n  spark "
        f"{sorted(only_a, key=key)[:limit]}\n  sql   {sorted(only_b, key=key)[:limit]}"
    )


def main(argv: list[str]) -> None:
    import __spark_entry__ as entry
    from panelkite.session import build_session

    sf_dir = f"/root/testdata/sf{argv[0]}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if len(argv) > 1 and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in argv[1:]):
            continue
        start = time.time()
        try:
            if name in sqls:
                diff = differences(spark, con, fn, sqls[name], sf_dir)
            else:
                diff = f"(no sql) {len(fn(spark, sf_dir).collect())} rows"
        except Exception as exc:  # noqa: BLE001
            diff = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        bad += bool(diff) and not diff.startswith("(no sql)")
        print(f"{'ok ' if not diff else '-- '} {name} {time.time() - start:.1f}s {diff}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
