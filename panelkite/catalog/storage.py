"""Snapshots, ledgers, keyed tables and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkite import schema
from panelkite.catalog.registry import query, r, rounded
from panelkite.catalog.metrics import CURVE_SQL
from panelkite.catalog.tables import BARS, CURVES_USER, FUND_FACTORS, FX, LEDGER, SNAPSHOT_BARS, with_
from panelkite.operators import metrics as mt
from panelkite.plans import testbed as tb
from panelkite.session import scratch_dir, settle
from panelkite.sources.common import stamp
from panelkite.sources import fingerprint as fp
from panelkite.sources import ledger as lg
from panelkite.sources import sinks
from panelkite.sources import snapshots as sn


def stored(spark, sf_dir, label):
    """A fresh root with snapshot s1: bars and rates."""
    root = scratch_dir(spark, label)
    bars = tb.bars_daily(spark, sf_dir).withColumn("source", F.lit("vendor"))
    sn.write_snapshot({"bars_daily": bars, "fx_rates": tb.fx_rates(spark, sf_dir)}, root, "s1")
    return root


@query(
    "snapshot_roundtrip",
    with_(BARS, FX)
    + """SELECT 'bars_daily' AS "table", symbol_id::VARCHAR AS key, ts, close AS value, 's1' AS snapshot_id FROM bars
       UNION ALL SELECT 'fx_rates', base || quote, ts, rate, 's1' FROM fx""",
)
def snapshot_roundtrip(spark, sf_dir):
    tables = sn.read_snapshot(spark, stored(spark, sf_dir, "roundtrip"), "s1")
    bars = tables["bars_daily"].select(
        F.lit("bars_daily").alias("table"), F.col("symbol_id").cast("string").alias("key"), "ts",
        F.col("close").alias("value"), "snapshot_id",
    )
    rates = tables["fx_rates"].select(
        F.lit("fx_rates").alias("table"), F.concat("base", "quote").alias("key"), "ts",
        F.col("rate").alias("value"), "snapshot_id",
    )
    return bars.unionByName(rates)


@query(
    "snapshot_views",
    with_(BARS)
    + f"""SELECT symbol_id, count(*) AS n, {r('avg(close)', 4)} AS mean_close FROM bars GROUP BY symbol_id""",
)
def snapshot_views(spark, sf_dir):
    sn.register_views(spark, stored(spark, sf_dir, "views"), "s1")
    out = spark.sql("SELECT symbol_id, count(*) AS n, avg(close) AS mean_close FROM raw_bars_daily GROUP BY 1")
    return out.withColumn("mean_close", rounded("mean_close", 4))


@query(
    "audit_scan",
    with_(BARS, FX)
    + """SELECT (SELECT count(*) FROM bars) + (SELECT count(*) FROM fx) AS "rows",
       (SELECT count(*) FROM bars) AS with_close, (SELECT count(*) FROM fx) AS with_rate, true AS named""",
)
def audit_scan(spark, sf_dir):
    root = stored(spark, sf_dir, "audit")
    scan = sn.audit_scan(spark, f"{root}/bars_daily", f"{root}/fx_rates", root=root)
    return scan.agg(
        F.count("*").alias("rows"),
        F.count("close").alias("with_close"),
        F.count("rate").alias("with_rate"),
        F.min(F.col("filename").contains("snapshot_id=s1")).alias("named"),
    )


@query(
    "audit_scan_widened",
    with_(BARS)
    + f"""SELECT 's' || (symbol_id % 3) AS snapshot, count(*) AS "rows", count(volume) AS volumes,
       {r('sum(CASE WHEN symbol_id % 3 = 0 THEN trunc(volume) ELSE volume END)', 2)} AS total,
       count(*) FILTER (symbol_id % 3 = 2) AS with_note FROM bars GROUP BY symbol_id % 3""",
)
def audit_scan_widened(spark, sf_dir):
    """Three snapshots that hold volumes as whole numbers, fractions and text; a fourth was cut short."""
    root = scratch_dir(spark, "widened")
    bars = settle(tb.bars_daily(spark, sf_dir), "bars")
    kinds = {"s0": "int", "s1": "double", "s2": "string"}
    for k, (name, kind) in enumerate(kinds.items()):
        part = bars.where(F.col("symbol_id") % 3 == k).withColumn("volume", F.col("volume").cast(kind))
        sn.write_snapshot({"bars_daily": part.withColumn("note", F.lit("x")) if k == 2 else part}, root, name)
    sn.write_table(bars, root, "bars_daily", "cut")
    scan = sn.audit_scan(spark, f"{root}/bars_daily", root=root)
    snapshot = F.regexp_extract("filename", "snapshot_id=([^/]+)/", 1).alias("snapshot")
    return scan.groupBy(snapshot).agg(
        F.count("*").alias("rows"),
        F.count("volume").alias("volumes"),
        rounded(F.sum(F.col("volume").cast("double")), 2).alias("total"),
        F.count("note").alias("with_note"),
    )


@query(
    "contract_load",
    with_(BARS)
    + """SELECT symbol_id, ts, open, high, low, close, volume, amount, CAST(NULL AS VARCHAR) AS currency,
       available_utc, 's1' AS snapshot_id FROM bars""",
)
def contract_load(spark, sf_dir):
    target = scratch_dir(spark, "contract")
    stamped = stamp(tb.bars_daily(spark, sf_dir), "vendor", "s1", "2024-02-01 00:00:00")
    sn.load_contract(stamped, "bars_daily", target, "s1")
    columns = "symbol_id ts open high low close volume amount currency available_utc snapshot_id".split()
    return spark.read.parquet(target).select(*columns)


@query(
    "close_adj_table",
    with_(
        BARS,
        FUND_FACTORS,
        """j AS (SELECT b.*, coalesce(adj_factor, 1.0) AS f FROM bars b
             LEFT JOIN factors a ON a.symbol_id = b.symbol_id AND a.ts = b.ts)""",
        "n AS (SELECT *, f / first_value(f) OVER (PARTITION BY symbol_id ORDER BY ts) AS norm FROM j)",
    )
    + f"""SELECT symbol_id, ts, {r('close * norm', 4)} AS close_adj, {r('norm')} AS adj_factor,
       'fund_adj_forward' AS method, available_utc, 'synthetic' AS source, 's1' AS snapshot_id FROM n""",
)
def close_adj_table(spark, sf_dir):
    target = scratch_dir(spark, "close-adj")
    sn.materialize_close_adj(
        tb.bars_daily(spark, sf_dir), target, "s1", factors=tb.fund_factors(spark, sf_dir)
    )
    stored_rows = spark.read.schema(schema.struct_of("close_adj")).parquet(target)
    return stored_rows.withColumns(
        {"close_adj": rounded("close_adj", 4), "adj_factor": rounded("adj_factor")}
    )


@query(
    "run_tables",
    with_(CURVES_USER)
    + """SELECT 'csv' AS kind, run_id, ts, equity FROM curves
       UNION ALL SELECT 'parquet', run_id, ts, equity FROM curves""",
)
def run_tables(spark, sf_dir):
    path = scratch_dir(spark, "run")
    curves = tb.curves_by_user(spark, sf_dir)
    sinks.write_run_tables({"equity": curves}, path)
    csv = spark.read.schema(curves.schema).option("header", True).csv(f"{path}/csv/equity")
    back = spark.read.parquet(f"{path}/parquet/equity")
    return csv.select(F.lit("csv").alias("kind"), "*").unionByName(back.select(F.lit("parquet").alias("kind"), "*"))


WIDE_METRICS = """wide AS (SELECT run_id::VARCHAR AS run_id, ratio - 1 AS total_return, mdd AS max_drawdown,
  sd * sqrt(ppy) AS vol, mu AS mean FROM ann)"""


@query(
    "metric_rows",
    with_(
        CURVES_USER,
        CURVE_SQL,
        WIDE_METRICS,
    )
    + f"""SELECT run_id, metric, {r('value')} AS value FROM (UNPIVOT wide ON total_return, max_drawdown, vol, mean
       INTO NAME metric VALUE value) WHERE value IS NOT NULL""",
)
def metric_rows(spark, sf_dir):
    rows = sinks.metric_rows(wide_metrics(spark, sf_dir))
    return rows.select("run_id", "metric", rounded("value").alias("value"))


@query(
    "metric_refusals",
    with_(CURVES_USER, CURVE_SQL, WIDE_METRICS)
    + """SELECT run_id, 'max_drawdown' AS metric, CASE WHEN run_id::BIGINT % 3 = 0 THEN 'NaN' ELSE '-Infinity' END AS value
       FROM wide WHERE max_drawdown IS NOT NULL AND run_id::BIGINT % 3 < 2""",
)
def metric_refusals(spark, sf_dir):
    """Every third run's drawdown is not a number, another third's is infinite: each is named."""
    third = F.col("run_id").cast("long") % 3
    known = F.col("max_drawdown").isNotNull()
    spoiled = F.when(known & (third == 0), float("nan")).when(known & (third == 1), float("-inf")).otherwise(F.col("max_drawdown"))
    return sinks.metric_refusals(wide_metrics(spark, sf_dir).withColumn("max_drawdown", spoiled))


def wide_metrics(spark, sf_dir):
    ppy = mt.periods_per_year()
    wide = mt.with_returns(tb.curves_by_user(spark, sf_dir)).groupBy("run_id").agg(
        mt.total_return().alias("total_return"),
        mt.max_drawdown().alias("max_drawdown"),
        mt.annualized_volatility(ppy).alias("vol"),
        F.avg("ret").alias("mean"),
    )
    return wide.withColumn("run_id", F.col("run_id").cast("string"))


@query("latest_snapshot", with_(LEDGER) + "SELECT s AS snapshot_id FROM newest")
def latest_snapshot(spark, sf_dir):
    return lg.latest_snapshot(tb.ledger(spark, sf_dir))


@query(
    "latest_bars",
    with_(BARS, LEDGER, SNAPSHOT_BARS)
    + "SELECT symbol_id, ts, close, snapshot_id FROM snapbars JOIN newest ON snapshot_id = s",
)
def latest_bars(spark, sf_dir):
    rows = lg.latest_rows(tb.snapshots(spark, sf_dir), tb.ledger(spark, sf_dir))
    return rows.select("symbol_id", "ts", "close", "snapshot_id")


@query(
    "ledger_status",
    """SELECT o_custkey::VARCHAR AS snapshot_id, o_orderpriority AS dataset,
       arg_max(CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'partial' ELSE 'ok' END, o_orderkey) AS status,
       max(o_orderkey) AS event_ts FROM orders GROUP BY 1, 2""",
)
def ledger_status(spark, sf_dir):
    status = F.col("o_orderstatus")
    events = tb.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("snapshot_id"),
        F.col("o_orderpriority").alias("dataset"),
        F.when(status == "O", "running").when(status == "P", "partial").otherwise("ok").alias("status"),
        F.col("o_orderkey").alias("event_ts"),
    )
    return lg.current_status(events)


@query(
    "watermark",
    with_(BARS, FX) + "SELECT greatest((SELECT max(ts) FROM bars), (SELECT max(ts) FROM fx)) AS watermark",
)
def watermark(spark, sf_dir):
    return lg.watermark(
        {"bars_daily": tb.bars_daily(spark, sf_dir), "fx_rates": tb.fx_rates(spark, sf_dir)}
    )


@query(
    "insert_absent",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def insert_absent(spark, sf_dir):
    existing = tb.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey")
    )
    new = tb.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return lg.insert_absent(existing, new, ["o_custkey"])


@query(
    "upsert_latest",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
       SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC, o_totalprice DESC) AS n FROM orders)
       WHERE n = 1""",
)
def upsert_latest(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return lg.upsert_latest(rows, ["o_custkey"], "o_orderkey")


@query(
    "metrics_of_run",
    with_(CURVES_USER, CURVE_SQL)
    + f"""SELECT 'r7' AS run_id, metric, {r('value')} AS value FROM (
       SELECT 'max_drawdown' AS metric, mdd AS value FROM ann WHERE run_id = 7
       UNION ALL SELECT 'total_return', ratio - 1 FROM ann WHERE run_id = 7)""",
)
def metrics_of_run(spark, sf_dir):
    wide = mt.with_returns(tb.curves_by_user(spark, sf_dir)).groupBy("run_id").agg(
        mt.total_return().alias("total_return"), mt.max_drawdown().alias("max_drawdown")
    )
    named = wide.withColumn("run_id", F.concat(F.lit("r"), "run_id"))
    out = lg.run_metrics_of(sinks.metric_rows(named), "r7")
    return out.select("run_id", "metric", rounded("value").alias("value"))


def fingerprint_sql(source: str, columns: list[tuple[str, str]], where: str = "") -> str:
    """Lane sums of the row digests, as in the Spark query."""
    cells = " || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), '<NA>')" for c, _ in columns)
    head = "\x1f".join([c for c, _ in columns] + [t for _, t in columns])
    numbers = [f"CAST('0x' || substr(h, {fp.DIGITS * i + 1}, {fp.DIGITS}) AS BIGINT)" for i in range(fp.PIECES)]
    lanes = " || chr(31) || ".join(
        f"CAST(CAST(sum(({n} >> {shift}) & {fp.MASK}) AS BIGINT) AS VARCHAR)"
        for n in numbers
        for shift in fp.SHIFTS
    )
    return f"""SELECT sha256('{head}' || chr(31) || count(*)::VARCHAR || chr(31) || {lanes}) AS fingerprint,
       count(*) AS "rows" FROM (SELECT sha256({cells}) AS h FROM {source} {where})"""


ITEM_COLUMNS = [
    ("l_orderkey", "int64"),
    ("l_partkey", "int64"),
    ("l_suppkey", "int64"),
    ("l_linenumber", "int64"),
    ("l_quantity", "float64"),
    ("l_extendedprice", "float64"),
    ("l_discount", "float64"),
    ("l_tax", "float64"),
    ("l_returnflag", "text"),
    ("l_linestatus", "text"),
    ("l_shipdate", "datetime"),
]
ORDER_COLUMNS = [
    ("o_orderkey", "int64"),
    ("o_custkey", "int64"),
    ("o_orderstatus", "text"),
    ("o_totalprice", "float64"),
    ("o_orderdate", "datetime"),
    ("o_orderpriority", "text"),
]


@query("table_fingerprint", fingerprint_sql("lineitem", ITEM_COLUMNS))
def table_fingerprint(spark, sf_dir):
    return fp.fingerprint(tb.table(spark, sf_dir, "lineitem").select(*[c for c, _ in ITEM_COLUMNS]))


BUNDLE = f"""lines AS (
  SELECT 'items:' || fingerprint AS line FROM ({fingerprint_sql('lineitem', ITEM_COLUMNS)})
  UNION ALL SELECT 'orders:' || fingerprint FROM ({fingerprint_sql('orders', ORDER_COLUMNS)})),
whole AS (SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM lines)"""


def bundle(spark, sf_dir):
    return {
        "items": tb.table(spark, sf_dir, "lineitem").select(*[c for c, _ in ITEM_COLUMNS]),
        "orders": tb.table(spark, sf_dir, "orders").select(*[c for c, _ in ORDER_COLUMNS]),
    }


@query("bundle_fingerprint", "WITH " + BUNDLE + " SELECT fingerprint FROM whole")
def bundle_fingerprint(spark, sf_dir):
    return fp.bundle_fingerprint(bundle(spark, sf_dir))


@query(
    "snapshot_identity",
    "WITH "
    + BUNDLE
    + " SELECT 'vendor-' || substr(sha256('vendor' || chr(10) || fingerprint), 1, 16) AS snapshot_id FROM whole",
)
def snapshot_identity(spark, sf_dir):
    stamped = {
        n: df.withColumns({"snapshot_id": F.lit("old"), "downloaded_at": F.lit("2024-01-01")})
        for n, df in bundle(spark, sf_dir).items()
    }
    return fp.snapshot_id("vendor", stamped)


@query(
    "ledger_rows",
    "WITH "
    + f"""a AS ({fingerprint_sql('lineitem', ITEM_COLUMNS)}), b AS ({fingerprint_sql('orders', ORDER_COLUMNS)})"""
    + """ SELECT 's9' AS snapshot_id, 'vendor' AS source, 'items' AS dataset, "rows", CAST(NULL AS DATE) AS watermark,
       fingerprint AS file_hash, 'ok' AS status FROM a
       UNION ALL SELECT 's9', 'vendor', 'orders', "rows", NULL, fingerprint, 'ok' FROM b""",
)
def ledger_rows(spark, sf_dir):
    return lg.ledger_rows(bundle(spark, sf_dir), "s9", "vendor")


@query(
    "latest_close_adj",
    with_(
        BARS,
        LEDGER,
        SNAPSHOT_BARS,
        FUND_FACTORS,
        """n AS (SELECT b.symbol_id, b.ts, close, snapshot_id, coalesce(adj_factor, 1.0)
             / first_value(coalesce(adj_factor, 1.0)) OVER (PARTITION BY b.symbol_id ORDER BY b.ts) AS norm
           FROM snapbars b JOIN newest ON snapshot_id = s
           LEFT JOIN factors a ON a.symbol_id = b.symbol_id AND a.ts = b.ts)""",
    )
    + f"""SELECT symbol_id, ts, {r('close * norm', 4)} AS close_adj, snapshot_id FROM n""",
)
def latest_close_adj(spark, sf_dir):
    """Adjusted closes stored for the snapshots of two good runs; only the newest is read."""
    target = scratch_dir(spark, "close-adj")
    bars, factors, ledger = tb.snapshots(spark, sf_dir), tb.fund_factors(spark, sf_dir), tb.ledger(spark, sf_dir)
    newest = ledger.where("status = 'ok'").orderBy(F.desc("finished_at")).select("snapshot_id").limit(2).collect()
    for r_ in newest:
        own = bars.where(F.col("snapshot_id") == r_.snapshot_id).drop("snapshot_id")
        sn.materialize_close_adj(own, target, r_.snapshot_id, factors=factors)
    rows = lg.latest_rows(spark.read.parquet(target), ledger)
    return rows.select("symbol_id", "ts", rounded("close_adj", 4).alias("close_adj"), "snapshot_id")


@query(
    "latest_dataset",
    """WITH last AS (SELECT o_orderpriority AS p, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O'
         GROUP BY 1)
       SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey =
         (SELECT o_custkey FROM orders JOIN last ON k = o_orderkey WHERE p = '1-URGENT')""",
)
def latest_dataset(spark, sf_dir):
    """Rows of the snapshot (here: customer) with the newest good run of one dataset (priority)."""
    orders = tb.table(spark, sf_dir, "orders")
    ledger = orders.select(
        F.col("o_custkey").alias("snapshot_id"),
        F.col("o_orderpriority").alias("dataset"),
        F.when(F.col("o_orderstatus") == "O", "ok").otherwise("failed").alias("status"),
        F.col("o_orderkey").alias("finished_at"),
    )
    rows = orders.withColumn("snapshot_id", F.col("o_custkey"))
    return lg.latest_rows(rows, ledger, "1-URGENT").select("o_orderkey", "o_custkey")
