"""Snapshots, ledgers, fingerprints, generated panels and vendor samples."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from panelkite import schema
from panelkite.operators import cleaning as cl
from panelkite.sources import abroad, cn, sinks
from panelkite.sources import common as cm
from panelkite.sources import fingerprint as fp
from panelkite.sources import ledger as lg
from panelkite.sources import snapshots as sn
from panelkite.sources import synthetic as sy


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


@pytest.fixture
def rates(frame):
    return frame([("USD", "CNY", day(i), 7.0 + i) for i in range(4)], "base STRING, quote STRING, ts DATE, rate DOUBLE")


def test_snapshot_is_immutable(spark, rates, tmp_path):
    root = str(tmp_path)
    sn.write_snapshot({"fx_rates": rates}, root, "s1")
    with pytest.raises(FileExistsError):
        sn.write_snapshot({"fx_rates": rates.limit(1)}, root, "s1")
    sn.write_snapshot({"fx_rates": rates.limit(1)}, root, "s2")
    assert list(sn.read_snapshot(spark, root, "s1")) == ["fx_rates"]
    assert sn.read_table(spark, root, "fx_rates", "s1").count() == 4
    assert sn.register_views(spark, root, "s2", "t_") == ["t_fx_rates"]
    assert spark.table("t_fx_rates").count() == 1
    with pytest.raises(FileNotFoundError):
        sn.read_snapshot(spark, root, "nothing")


def test_a_write_cut_short_is_not_read_and_can_be_repeated(spark, rates, tmp_path, monkeypatch):
    root = str(tmp_path)
    written = []

    def cut(df, *where):
        if written:
            raise OSError("disk")
        written.append(where)
        write(df, *where)

    write = sn.write_table
    monkeypatch.setattr(sn, "write_table", cut)
    tables = {"fx_rates": rates, "macro_series": rates}
    with pytest.raises(OSError):
        sn.write_snapshot(tables, root, "s1")
    assert sn.read_table(spark, root, "fx_rates", "s1").count() == 4
    for read in (sn.read_snapshot, sn.register_views):
        with pytest.raises(FileNotFoundError):
            read(spark, root, "s1")
    with pytest.raises(FileNotFoundError):
        sn.audit_scan(spark, f"{root}/fx_rates", root=root)
    monkeypatch.setattr(sn, "write_table", write)
    sn.write_snapshot({**tables, "fx_rates": rates.limit(3)}, root, "s1")
    assert {t: df.count() for t, df in sn.read_snapshot(spark, root, "s1").items()} == {"fx_rates": 3, "macro_series": 4}
    with pytest.raises(FileExistsError, match="macro_series"):
        sn.write_snapshot({"macro_series": rates}, root, "s1")


def test_audit_scan_widens_types(spark, frame, tmp_path):
    for k, (kind, value) in enumerate([("INT", 1), ("BIGINT", 2**40), ("DOUBLE", 0.5), ("STRING", "n/a")]):
        sn.write_snapshot({"t": frame([(value,)], f"x {kind}")}, str(tmp_path / "all"), f"s{k}")
        if k < 3:
            sn.write_snapshot({"t": frame([(value,)], f"x {kind}")}, str(tmp_path / "numbers"), f"s{k}")
    text, numbers = (sn.audit_scan(spark, str(tmp_path / name / "t")) for name in ("all", "numbers"))
    assert sorted(r.x for r in text.collect()) == ["0.5", "1", str(2**40), "n/a"]
    assert sorted(r.x for r in numbers.collect()) == [0.5, 1.0, float(2**40)]


def test_audit_scan_aligns_schemas(spark, rates, tmp_path):
    sn.write_snapshot({"fx_rates": rates}, str(tmp_path), "s1")
    sn.write_snapshot({"fx_rates": rates.withColumn("note", F.lit("x"))}, str(tmp_path), "s2")
    scan = sn.audit_scan(spark, f"{tmp_path}/fx_rates")
    assert scan.count() == 8 and scan.where("note IS NULL").count() == 4
    assert scan.select("filename").distinct().count() >= 2


def test_contract_load_projects_and_refuses(spark, rates, tmp_path):
    target = str(tmp_path / "fx")
    for column in ("available_utc", "source"):
        with pytest.raises(ValueError, match=f"{column}"):
            sn.load_contract(rates.withColumns({c: F.lit(None) for c in (column,)}), "fx_rates", target, "s1")
    rates = rates.withColumns({"available_utc": F.current_timestamp().cast("timestamp_ntz"), "source": F.lit("v")})
    sn.load_contract(rates.withColumn("extra", F.lit(1)), "fx_rates", target, "s1")
    assert "extra" not in spark.read.parquet(target).columns
    with pytest.raises(AnalysisException):
        sn.load_contract(rates, "fx_rates", target, "s1")
    with pytest.raises(ValueError, match="repeated"):
        sn.load_contract(rates.unionByName(rates), "fx_rates", target, "s2")


def value(df):
    return df.first().fingerprint


def test_fingerprint_depends_on_rows_only(rates):
    want = value(fp.fingerprint(rates))
    assert value(fp.fingerprint(rates.orderBy(F.col("ts").desc()).repartition(3))) == want
    assert value(fp.fingerprint(rates.withColumn("rate", F.col("rate").cast("float")))) == want
    for other in (
        rates.limit(3),
        rates.unionByName(rates.limit(1)),
        rates.withColumnRenamed("rate", "r"),
        rates.withColumn("rate", F.col("rate").cast("string")),
        rates.withColumn("rate", F.col("rate") + 1e-12),
        rates.withColumn("rate", F.lit(None).cast("double")),
    ):
        assert value(fp.fingerprint(other)) != want


def test_snapshot_id_ignores_stamps(rates):
    a = cm.stamp(rates, "v", "one", "2024-01-01 00:00:00").drop("source")
    b = cm.stamp(rates, "v", "two", "2024-02-01 00:00:00").drop("source")
    ids = [fp.snapshot_id(s, {"fx_rates": t}).first().snapshot_id for s, t in (("v", a), ("v", b), ("w", a))]
    assert ids[0] == ids[1] != ids[2] and ids[0].startswith("v-") and len(ids[0]) == 18


def test_latest_snapshot_ignores_failures(frame):
    ledger = frame(
        [("a", "bars_daily", "ok", 1), ("b", "bars_daily", "ok", 2), ("c", "bars_daily", "failed", 3), ("d", "fx", "ok", 4)],
        "snapshot_id STRING, dataset STRING, status STRING, finished_at INT",
    )
    assert lg.latest_snapshot(ledger).first().snapshot_id == "b"
    assert lg.latest_snapshot(ledger, "fx").first().snapshot_id == "d"
    table = frame([("a", 1), ("b", 2)], "snapshot_id STRING, x INT")
    assert [r.x for r in lg.latest_rows(table, ledger).collect()] == [2]


def test_keyed_tables(frame):
    ddl = "k INT, v STRING, version INT"
    old, new = frame([(1, "a", 1)], ddl), frame([(1, "b", 2), (2, "c", 1)], ddl)
    assert [r.k for r in lg.insert_absent(old, new, ["k"]).collect()] == [2]
    got = {r.k: r.v for r in lg.upsert_latest(old.unionByName(new), ["k"], "version").collect()}
    assert got == {1: "b", 2: "c"}


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_metrics_that_are_not_finite_are_refused(frame, bad):
    df = frame([("r", 1.0, bad, None), ("q", 2.0, None, 3)], "run_id STRING, a DOUBLE, b DOUBLE, c INT")
    with pytest.raises(Exception, match="metric b is not finite"):
        sinks.metric_rows(df).collect()
    assert [(r.run_id, r.metric) for r in sinks.metric_refusals(df).collect()] == [("r", "b")]
    fine = sinks.metric_rows(df.where("run_id = 'q'")).collect()
    assert sorted((r.metric, r.value) for r in fine) == [("a", 2.0), ("c", 3.0)]


@pytest.mark.parametrize("kind, value", [("STRING", "net of costs"), ("BOOLEAN", True)])
def test_metrics_that_are_no_numbers_are_refused(frame, kind, value):
    with pytest.raises(ValueError, match="must be numbers"):
        sinks.metric_rows(frame([("r", 1.0, value)], f"run_id STRING, a DOUBLE, note {kind}"))


def test_conform_adds_and_drops_columns(frame):
    out = schema.conform(frame([(1, 2)], "symbol_id INT, extra INT"), "symbols")
    assert out.columns == [f.name for f in schema.struct_of("symbols").fields]
    assert out.first().symbol_id == 1 and out.first().name is None


def known(frame, failed):
    symbols = frame([(1, "X", 100.0, 0.0002, 0.012), (2, "X", 40.0, 0.0003, 0.015)], "symbol_id BIGINT, exchange STRING, init_price DOUBLE, mu DOUBLE, sigma DOUBLE")
    sessions = frame([("X", day(i)) for i in range(300)], "exchange STRING, ts DATE")
    actions = frame([(1, day(50), None, 0.35), (2, day(90), 4.0, None)], "symbol_id BIGINT, ts DATE, split_ratio DOUBLE, dividend DOUBLE")
    halts = frame([(2, day(i)) for i in (20, 21, 22)], "symbol_id BIGINT, ts DATE")
    failures = frame([(1, day(i)) for i in failed], "symbol_id BIGINT, ts DATE")
    bars = sy.price_panel(symbols, sessions, actions, halts, failures, seed=1)
    long = frame([(1, day(50), "dividend", None, 0.35), (2, day(90), "split", 4.0, None)], "symbol_id BIGINT, ex_date DATE, kind STRING, ratio DOUBLE, cash DOUBLE")
    navs = cl.total_return_index(bars, long)
    expected = symbols.join(sessions, "exchange").select("symbol_id", "ts")
    return bars, {r.symbol_id: r for r in sy.answer_check(bars, navs, expected).collect()}


def test_known_answer(frame):
    bars, answers = known(frame, failed=range(49, 53))
    assert answers[2].missing == 0 and answers[2].max_dev < 1e-9
    # the dividend fell into the gap
    assert answers[1].missing == 4 and answers[1].max_dev > 1e-6
    halted = bars.where("NOT traded").collect()
    assert len(halted) == 3 and all(r.volume == 0 and r.open == r.close == r.high for r in halted)
    _, answers = known(frame, failed=[])
    assert answers[1].missing == 0 and answers[1].max_dev < 1e-9


IDS = "code STRING, symbol_id BIGINT"


def test_dividends_keep_one_implemented_row(frame):
    rows = [("510300.SH", "20240110", "20240115", "20240120", p, 0.5) for p in ("实施", "实施", " 实施")]
    raw = frame(rows + [("510300.SH", None, "20240301", "", "预案", 0.9)], "ts_code STRING, ann_date STRING, ex_date STRING, pay_date STRING, div_proc STRING, div_cash DOUBLE")
    out = cn.dividends(raw, frame([("510300.SH", 7)], IDS)).collect()
    assert len(out) == 1 and out[0].symbol_id == 7 and out[0].available_utc == dt.datetime(2024, 1, 10)


def test_availability_is_never_after_ex_date(frame):
    raw = frame([("a.SH", "20240120", "20240115", 0.5)], "ts_code STRING, ann_date STRING, ex_date STRING, div_cash DOUBLE")
    assert cn.dividends(raw, frame([("a.SH", 1)], IDS)).first().available_utc == dt.datetime(2024, 1, 15)


def test_fund_list(frame):
    raw = frame(
        [("2.SZ", "二", "黄金型", "20200101", "nan"), ("1.SH", "一", "FOF", "20200101", "20230101"), ("3.SH", "三", "REITs", "20200101", None)],
        "ts_code STRING, name STRING, fund_type STRING, list_date STRING, delist_date STRING",
    )
    out = {r.ticker: r for r in cn.fund_symbols(raw, cn.fund_ids(raw)).collect()}
    assert set(out) == {"1.SH", "2.SZ"} and out["1.SH"].symbol_id == 1 and out["2.SZ"].symbol_id == 2
    assert out["2.SZ"].invest_type == "商品" and out["1.SH"].invest_type == "其他"
    assert out["2.SZ"].delisted_on is None and out["1.SH"].delisted_on == dt.date(2023, 1, 1)


def test_appended_ids_are_stable(frame):
    old = frame([("b",), ("d",)], "ts_code STRING")
    ids = cm.append_ids(cm.assign_ids(old), frame([("a",), ("b",), ("c",), ("d",)], "ts_code STRING"))
    assert {r.code: r.symbol_id for r in ids.collect()} == {"b": 1, "d": 2, "a": 3, "c": 4}


def test_hong_kong(frame):
    listed = abroad.hk_list(
        frame([("00700.HK", "T", "主板", "L", "20040616", None, "100", "KYG", "HKD"), ("00001.HK", "C", "主板", "L", "", None, "x", "K2", "HKD")],
              "ts_code STRING, name STRING, market STRING, list_status STRING, list_date STRING, delist_date STRING, trade_unit STRING, isin STRING, curr_type STRING")
    )
    ids = abroad.hk_ids(listed)
    out = {r.ticker: r for r in abroad.hk_symbols(listed, ids).collect()}
    assert out["00001.HK"].symbol_id == 1_000_000_001 and out["00001.HK"].lot_size is None
    raw = frame([("HK.00700", "2024-01-02 00:00:00", 1.0, 2.0, 0.5, 1.5, 10.0, 15.0)], "code STRING, time_key STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, turnover DOUBLE")
    bar = abroad.hk_bars(raw, ids).first()
    assert bar.symbol_id == 1_000_000_002 and bar.close_utc == dt.datetime(2024, 1, 2, 8) and bar.amount == 15


def test_us_kinds(frame):
    ddl = "Date STRING, Ticker STRING, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE"
    raw = frame([("2024-01-02", "SPY", 1.0, 2.0, 0.5, 1.5)], ddl)
    ids = frame([("SPY", 3)], IDS)
    bar = abroad.wide_bars(raw, ids).first()
    assert bar.return_kind == "price_return" and bar.volume == 0
    bar = abroad.wide_bars(raw.withColumn("Adj Close", F.lit(1.4)).withColumn("Volume", F.lit(10)), ids).first()
    assert bar.return_kind == "total_return" and bar.close == 1.4 and bar.amount == 15
    with pytest.raises(ValueError):
        abroad.fx_series(raw, "USD", "")


def test_naive_utc_in_any_session_zone(spark, frame):
    df = frame([("2024-01-01T08:00:00+08:00",)], "t STRING")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(cm.to_naive_utc("t").alias("u")).first().u == dt.datetime(2024, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_blank_dates(frame):
    df = frame([("20240102",), (" ",), ("nan",), ("None",), (None,)], "d STRING")
    assert [r.d for r in df.select(cm.to_day("d").alias("d")).collect()] == [day(1), None, None, None, None]


def test_first_page_wins(frame):
    ddl = "date STRING, v DOUBLE"
    pages = [frame([("20240103", 3.0), ("20240102", 2.0)], ddl), frame([("20240102", 9.0), ("20240101", 1.0)], ddl)]
    assert {r.date: r.v for r in cm.merge_pages(pages).collect()} == {"20240101": 1.0, "20240102": 2.0, "20240103": 3.0}
