"""SQL of the derived tables, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TICKS = """ticks AS (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS tm, event_id AS seq, value AS price FROM events)"""


def _roll(name: str, where: str = "") -> str:
    return f"""{name} AS (SELECT symbol, CAST((floor(tm / 3600) + 1) * 3600 AS BIGINT) AS ts, arg_min(price, seq) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, seq) AS close, count(*) AS volume, CAST((floor(tm / 3600) + 1) * 3600 AS BIGINT) AS avail_ts FROM ticks {where} GROUP BY 1, 2)"""


BARS = f"{TICKS}, {_roll('bars', 'WHERE price > 0')}"
DIRTY = f"""{TICKS}, {_roll('allbars')}, dirty AS (
  SELECT *, ts * 4 AS row_seq FROM allbars
  UNION ALL SELECT symbol, ts, open, low - 1.0, low, close, volume, avail_ts, ts * 4 + 1 FROM allbars WHERE ts % 86400 = 7200
  UNION ALL SELECT *, ts * 4 + 2 FROM allbars WHERE ts % 86400 = 10800)"""
MONTHLY = """mrows AS (SELECT n_name AS symbol, r_name AS sector, o_orderdate, o_orderkey, o_totalprice,
    CAST(epoch(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) AS BIGINT) AS ts
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
monthly AS (SELECT symbol, sector, ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*) AS volume, ts AS avail_ts FROM mrows GROUP BY 1, 2, 3)"""
FILLS = """fills AS (SELECT 'run' AS run_id, user_id AS instrument, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS fill_seq,
  CASE WHEN event_type IN ('purchase', 'view', 'signup') THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS quantity, value AS price, value * 0.001::DOUBLE AS commission FROM events WHERE value > 0)"""
ORDERS = """orows AS (SELECT p_brand AS symbol, strftime(l_shipdate, '%Y-%m') AS month, l_orderkey, l_linenumber, l_quantity, l_extendedprice / l_quantity AS unit,
    CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity, l_linenumber % 2 = 0 AS is_limit
  FROM lineitem JOIN part ON l_partkey = p_partkey),
obars AS (SELECT symbol, month, max(unit) AS high, min(unit) AS low, round(sum(unit * l_quantity) / sum(l_quantity) + 1.234567e-9::DOUBLE, 6) AS close, sum(l_quantity) AS volume FROM orows GROUP BY 1, 2),
corders AS (SELECT * FROM orows JOIN obars USING (symbol, month))"""
#: Momentum of hourly bars as a model's predictions.
PREDICTIONS = f"""{BARS}, rets AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars),
predictions AS (SELECT symbol, ts AS as_of, close, value FROM (SELECT symbol, ts, close,
    CASE WHEN count(r) OVER w = 5 THEN round(avg(r) OVER w, 9) END AS value FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  WHERE value IS NOT NULL)"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(q: Query) -> Query:
        QUERIES[name] = q
        if sql is not None:
            SQL[name] = sql
        return q

    return add


#: Added where values have few digits and so often lie in the middle between two rounded ones.
OFF = 1.234567e-9


def rounded(df: DataFrame, digits: int = 6, off: float = 0.0) -> DataFrame:
    """Doubles rounded, so that the order in which an engine adds does not show; no negative zero."""
    moved = lambda c: F.col(c) + off if off else F.col(c)
    return df.select(*((F.round(moved(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rnd(cols: str, digits: int = 6, off: float = 0.0) -> str:
    """``round(x, 6) AS x`` for each of the names."""
    return ", ".join(f"round({c}{f' + {off!r}::DOUBLE' if off else ''}, {digits}) AS {c}" for c in cols.split())
