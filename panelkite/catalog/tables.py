"""SQL text of the derived tables, shared by the oracles."""

BARS = """
items AS MATERIALIZED (
  SELECT l_suppkey % (SELECT greatest(8, count(*) // 12) FROM supplier) AS symbol_id, CAST(l_shipdate AS DATE) AS ts, l_suppkey, l_linenumber,
         l_quantity, l_extendedprice, l_tax
  FROM lineitem),
bars AS MATERIALIZED (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol_id ORDER BY ts), close) AS open,
         volume >= 20 AS traded, CAST(ts + INTERVAL 1 DAY AS TIMESTAMP) AS available_utc
  FROM (SELECT symbol_id, ts,
               round(max(l_extendedprice / l_quantity) + 1.23e-9, 6) AS high,
               round(min(l_extendedprice / l_quantity) + 1.23e-9, 6) AS low,
               round(sum(l_extendedprice) / sum(l_quantity) + 1.23e-9, 6) AS close,
               sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
        FROM items GROUP BY symbol_id, ts))"""

PANEL = (
    BARS
    + """,
sess AS MATERIALIZED (
  SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx
  FROM (SELECT DISTINCT ts FROM bars WHERE traded)),
panel AS MATERIALIZED (
  SELECT s.symbol_id, d.ts, d.idx, coalesce(b.traded, false) AS traded,
         b.open, b.high, b.low, b.close, b.volume
  FROM (SELECT DISTINCT symbol_id FROM bars) s CROSS JOIN sess d
  LEFT JOIN bars b ON b.symbol_id = s.symbol_id AND b.ts = d.ts)"""
)

WEEKLY = """
bars AS MATERIALIZED (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol_id ORDER BY ts), close) AS open,
         volume >= 20 AS traded
  FROM (SELECT l_suppkey AS symbol_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts,
               round(sum(l_extendedprice) / sum(l_quantity) + 1.23e-9, 6) AS close, sum(l_quantity) AS volume
        FROM lineitem GROUP BY 1, 2)),
sess AS MATERIALIZED (
  SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx
  FROM (SELECT DISTINCT ts FROM bars WHERE traded)),
panel AS MATERIALIZED (
  SELECT s.symbol_id, d.ts, d.idx, coalesce(b.traded, false) AS traded, b.close
  FROM (SELECT DISTINCT symbol_id FROM bars) s CROSS JOIN sess d
  LEFT JOIN bars b ON b.symbol_id = s.symbol_id AND b.ts = d.ts)"""

ACTIONS = """
actions AS MATERIALIZED (
  SELECT symbol_id, ts AS ex_date, kind,
         CASE WHEN kind = 'split' THEN 2.0::DOUBLE END AS ratio,
         CASE WHEN kind = 'dividend' THEN max(l_tax) END AS cash,
         CAST(ts - INTERVAL 10 DAY AS TIMESTAMP) AS available_utc
  FROM (SELECT *, CASE WHEN l_quantity = 50 THEN 'split' ELSE 'dividend' END AS kind
        FROM items WHERE l_linenumber = 7 AND l_quantity IN (49, 50))
  GROUP BY symbol_id, ts, kind)"""

FX = """
fx0 AS MATERIALIZED (
  SELECT event_type AS base, 'CNY' AS quote, CAST(ts AS DATE) AS ts, round(avg(value) + 1.23e-9, 6) AS rate
  FROM events GROUP BY 1, 2, 3),
fx AS MATERIALIZED (
  SELECT CASE WHEN flip THEN quote ELSE base END AS base,
         CASE WHEN flip THEN base ELSE quote END AS quote, ts,
         CASE WHEN flip THEN 1.0::DOUBLE / rate ELSE rate END AS rate
  FROM (SELECT *, base = 'view' AND day(ts) % 2 = 1 AS flip FROM fx0))"""

SYMBOLS = """
symbols AS MATERIALIZED (
  SELECT symbol_id, 'SYM' || symbol_id AS ticker, 'X' || (symbol_id % 3) AS exchange,
         CASE WHEN symbol_id <> 7 THEN CAST(min(ts) + CAST(symbol_id % 8 * 30 AS INTEGER) AS DATE) END
           AS listed_on,
         CASE WHEN symbol_id = 5 THEN DATE '2000-06-30' END AS delisted_on
  FROM items GROUP BY symbol_id)"""

CALENDAR = """
calendar AS MATERIALIZED (
  SELECT e.exchange, d.ts, o.ts IS NOT NULL AS is_open
  FROM (SELECT unnest(generate_series(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)),
               INTERVAL 1 DAY))::DATE AS ts FROM lineitem) d
  CROSS JOIN (SELECT unnest(['X0', 'X1', 'X2']) AS exchange) e
  LEFT JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ts FROM orders
             WHERE isodow(o_orderdate) <= 5) o ON o.ts = d.ts)"""

CURVES_TYPE = """
curves AS MATERIALIZED (
  SELECT event_type AS name, CAST(ts AS DATE) AS ts, round(avg(value) + 1.23e-9, 6) AS equity
  FROM events GROUP BY 1, 2)"""

CURVES_USER = """
curves AS MATERIALIZED (
  SELECT user_id AS run_id, CAST(ts AS DATE) AS ts, round(avg(value) + 1.23e-9, 6) AS equity
  FROM events GROUP BY 1, 2)"""

LEDGER = """
ledger AS MATERIALIZED (
  SELECT 's' || year(o_orderdate) AS snapshot_id, 'bars_daily' AS dataset, year(o_orderdate) AS run_year,
         CASE WHEN count(*) FILTER (o_orderstatus = 'F') >= count(*) FILTER (o_orderstatus = 'O')
              THEN 'ok' ELSE 'failed' END AS status,
         CAST(max(o_orderdate) AS TIMESTAMP) AS finished_at
  FROM orders GROUP BY 1, 3),
newest AS MATERIALIZED (
  SELECT arg_max(snapshot_id, finished_at) AS s, arg_max(run_year, finished_at) AS y FROM ledger WHERE status = 'ok')"""

SNAPSHOT_BARS = """
snapbars AS MATERIALIZED (
  SELECT b.* REPLACE (round(close + (run_year - year(ts)) + 1.23e-9, 6) AS close), snapshot_id, run_year
  FROM bars b JOIN ledger ON year(ts) <= run_year)"""


#: `bars` as one snapshot holds them.
OLD_SNAPSHOT = "s1999"
OLD_BARS = ",".join(
    [
        BARS.replace("\nbars AS MATERIALIZED", "\nbars0 AS MATERIALIZED"),
        LEDGER,
        SNAPSHOT_BARS.replace("FROM bars b", "FROM bars0 b"),
        "\nbars AS MATERIALIZED (SELECT * EXCLUDE (snapshot_id, run_year) FROM snapbars "
        f"WHERE snapshot_id = '{OLD_SNAPSHOT}')",
    ]
)


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n"

FUND_FACTORS = """
factors AS MATERIALIZED (
  SELECT symbol_id, ts, round(1.0 + avg(l_tax) + 1.23e-9, 6) AS adj_factor
  FROM items WHERE l_linenumber <= 3 GROUP BY symbol_id, ts)"""

MIX = """
weekly AS (SELECT event_type AS name, date_trunc('week', ts) AS week, count(*) AS n, min(CAST(ts AS DATE)) AS d
           FROM events GROUP BY 1, 2),
daily AS (SELECT name, min(d) OVER (PARTITION BY week) AS ts, n FROM weekly),
mixw AS MATERIALIZED (
  SELECT 'activity' AS run_id, ts, name,
         round(0.9::DOUBLE * n / sum(n) OVER (PARTITION BY ts) + 1.23e-9, 6) AS weight FROM daily
  UNION ALL SELECT 'equal', ts, name, 0.15::DOUBLE FROM daily),
mixc AS MATERIALIZED (
  SELECT run_id, name, ts, equity FROM curves CROSS JOIN (SELECT unnest(['activity', 'equal']) AS run_id)),
grid AS (SELECT n.run_id, n.name, d.ts FROM (SELECT DISTINCT run_id, name FROM mixc) n
         JOIN (SELECT DISTINCT run_id, ts FROM mixc) d ON d.run_id = n.run_id),
cells AS (SELECT g.run_id, g.name, g.ts, w.weight,
    coalesce(c.equity / lag(c.equity) OVER (PARTITION BY g.run_id, g.name ORDER BY g.ts) - 1, 0) AS r,
    sum(CASE WHEN x.ts IS NULL THEN 0 ELSE 1 END)
      OVER (PARTITION BY g.run_id, g.name ORDER BY g.ts) AS seg
  FROM grid g
  LEFT JOIN mixc c ON c.run_id = g.run_id AND c.name = g.name AND c.ts = g.ts
  LEFT JOIN mixw w ON w.run_id = g.run_id AND w.name = g.name AND w.ts = g.ts
  LEFT JOIN (SELECT DISTINCT run_id, ts FROM mixw) x ON x.run_id = g.run_id AND x.ts = g.ts),
grown AS MATERIALIZED (SELECT *,
    coalesce(first_value(weight) OVER s, 0) AS w, product(1 + r) OVER s AS g
  FROM cells WINDOW s AS (PARTITION BY run_id, name, seg ORDER BY ts)),
navday AS (SELECT run_id, seg, ts, 1 + sum(w * (g - 1)) AS f FROM grown GROUP BY 1, 2, 3),
bases AS (SELECT run_id, seg, coalesce(product(e) OVER (PARTITION BY run_id ORDER BY seg
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS base
  FROM (SELECT run_id, seg, arg_max(f, ts) AS e FROM navday GROUP BY 1, 2)),
nav AS MATERIALIZED (SELECT d.run_id, d.ts, d.f * b.base AS equity
  FROM navday d JOIN bases b ON b.run_id = d.run_id AND b.seg = d.seg)"""

ACTIVITY = """
act AS MATERIALIZED (
  SELECT run_id, ts, symbol_id, n::DOUBLE / sum(n) OVER (PARTITION BY run_id, ts) AS weight
  FROM (SELECT event_type AS run_id, CAST(ts AS DATE) AS ts, user_id AS symbol_id, count(*) AS n
        FROM events GROUP BY 1, 2, 3)),
actgrid AS (SELECT s.run_id, d.ts, s.symbol_id, coalesce(a.weight, 0) AS weight
  FROM (SELECT DISTINCT run_id, symbol_id FROM act) s
  JOIN (SELECT DISTINCT run_id, ts FROM act) d ON d.run_id = s.run_id
  LEFT JOIN act a ON a.run_id = s.run_id AND a.ts = d.ts AND a.symbol_id = s.symbol_id),
changes AS (SELECT run_id, ts, sum(abs(coalesce(weight - prev, 0))) AS change
  FROM (SELECT *, lag(weight) OVER (PARTITION BY run_id, symbol_id ORDER BY ts) AS prev FROM actgrid)
  GROUP BY 1, 2)"""
