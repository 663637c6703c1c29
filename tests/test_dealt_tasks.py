"""Tasks in proportion to the rows: no task holds a share of a table that grows with it."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkite import session
from panelkite.operators import cleaning as cl
from panelkite.operators import constraints as ct
from panelkite.operators import holdings as hd
from panelkite.operators import panel as pn
from panelkite.operators import quality as qc
from panelkite.operators import signals as sg
from panelkite.plans import ingest as ig
from panelkite.sources import synthetic as sy

START = dt.date(2024, 1, 1)


def tasks_with_rows(df):
    """Rows of every partition that has any."""
    return {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}


@pytest.fixture
def bars(spark):
    days = F.explode(F.sequence(F.lit(START), F.lit(START + dt.timedelta(days=29)))).alias("ts")
    grid = spark.range(64).select(F.col("id").alias("symbol_id"), days)
    price = (F.col("symbol_id") + F.dayofmonth("ts")).cast("double")
    return grid.select(*grid.columns, *[price.alias(c) for c in qc.PRICES], F.lit("s").alias("snapshot_id"))


def test_tasks_grow_with_the_rows(spark, monkeypatch, bars):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    stored = session.settle(bars, "bars")
    assert session.tasks_for(stored) == 20 and pn.panel_tasks(stored) >= 18
    assert session.tasks_of(spark, 0) == 4


# F2, F3, F4, F5
def test_windows_over_a_symbol_are_dealt_over_the_tasks(bars):
    dense = pn.densify(bars, tasks=24)
    assert len(tasks_with_rows(dense)) > 12
    assert sorted(dense.collect()) == sorted(pn.densify(bars).collect())
    jumps = [sorted(qc.price_jumps(bars, sigma=0.1, floor=0.0, tasks=t).collect()) for t in (None, 24)]
    assert jumps[0] == jumps[1]
    falls = bars.withColumn("seq", -F.datediff("ts", F.lit(START)))
    assert qc.unsorted_symbols(falls, "seq", block=7, tasks=24).count() == 64


# F2
def test_leaks_are_counted_like_a_difference_of_bags(frame):
    rows = [(1, "2024-01-01", 1.0), (1, "2024-01-01", 1.0), (1, "2024-01-02", 2.0), (None, "2024-01-01", 0.0), (2, "2024-01-01", None)]
    bars = frame(rows, "symbol_id BIGINT, ts DATE, close DOUBLE")

    def peeking(df):
        return df.withColumn("top", df.agg(F.max("close")).scalar())

    found = [ct.future_leak(bars, peeking, "2024-01-01", tasks=t) for t in (None, 5)]
    assert sorted(map(str, found[0].collect())) == sorted(map(str, found[1].collect()))
    assert found[1].count() == 4 and ct.future_leak(bars, lambda df: df, "2024-01-01", tasks=5).isEmpty()


# F3
def test_zeros_are_written_by_many_tasks(spark, frame, bars):
    dates = spark.createDataFrame([(START + dt.timedelta(days=i),) for i in range(6)], "ts DATE")
    held = frame(
        [(1, "2024-01-01", 0.25), (1, "2024-01-01", 0.25), (2, "2024-01-02", None), (99, "2024-01-03", 0.5), (3, "2023-01-01", None)],
        "symbol_id BIGINT, ts DATE, weight DOUBLE",
    )
    out = hd.export(hd.Holdings(dates, held), bars)
    assert len(tasks_with_rows(out)) == 4
    rows = {(r.symbol_id, r.ts.isoformat()): r.weight for r in out.collect()}
    assert len(rows) == out.count() == 64 * 6 + 2
    assert rows[1, "2024-01-01"] == 0.5 and rows[2, "2024-01-02"] == 0.0 and rows[1, "2024-01-02"] == 0.0
    assert rows[99, "2024-01-03"] == 0.5 and rows[3, "2023-01-01"] is None


def test_best_rows_of_a_date_do_not_depend_on_the_tasks(bars):
    scored = bars.select("ts", "symbol_id", (F.col("symbol_id") % 7).cast("double").alias("score"))
    a, b = (sorted(sg.top_n_weights(scored, top_n=3, pieces=4, tasks=t).collect()) for t in (None, 24))
    assert a == b and len(a) == 90


# F1
def test_generated_series_are_dealt_by_their_number(spark, monkeypatch, frame):
    monkeypatch.setattr(sy, "SERIES_PER_TASK", 10)
    symbols = spark.range(200).selectExpr("id AS symbol_id", "'X' AS exchange", "10D AS init_price", "0D AS mu", "0.01D AS sigma")
    sessions = spark.createDataFrame([("X", START + dt.timedelta(days=i)) for i in range(5)], "exchange STRING, ts DATE")
    actions = frame([(1, "2024-01-03", 2.0, None), (2, "2024-01-04", None, 0.5), (2, "2025-01-04", None, 0.5)],
                    "symbol_id BIGINT, ts DATE, split_ratio DOUBLE, dividend DOUBLE")
    fails = frame([(3, "2024-01-02")], "symbol_id BIGINT, ts DATE")
    bars = sy.price_panel(symbols, sessions, actions, None, fails, seed=7)
    assert len(tasks_with_rows(bars)) > 12 and bars.count() == 999
    long = actions.select("symbol_id", F.col("ts").alias("ex_date"),
                          F.when(F.col("dividend").isNull(), "split").otherwise("dividend").alias("kind"),
                          F.col("split_ratio").alias("ratio"), F.col("dividend").alias("cash"))
    navs = cl.total_return_index(bars, long)
    check = sy.answer_check(bars, navs, sy.session_grid(symbols, sessions), tasks=20)
    found = {r.symbol_id: r for r in check.collect()}
    assert len(found) == 200 and found[3].missing == 1 and all(r.missing == 0 for s, r in found.items() if s != 3)
    assert max(r.max_dev for r in found.values()) < 1e-9


# F4, F5, F6
def test_tables_are_computed_once(spark, bars, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    known = bars.withColumn("available_utc", F.date_add("ts", 1).cast("timestamp_ntz"))
    once = known.mapInArrow(counted, known.schema)
    result = ig.ingest({"bars_daily": once}, "v", str(tmp_path), "2024-02-01 00:00:00", "2024-02-01 00:05:00")
    assert result.status == "ok" and seen.value == known.count()
    seen.value = 0
    report = qc.run_all_checks(once.withColumn("seq", F.datediff("ts", F.lit(START)).cast("long")), "seq")
    assert report.where("ok").count() == 8 and seen.value == known.count()
