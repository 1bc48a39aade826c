"""Filters, data quality, time joins, top-k and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import core, dq, joins
from ..operators import features as f
from ..sources import fixtures as x
from .base import BARS, DIRTY, MONTHLY, PREDICTIONS, register, rnd, rounded
from .feature_queries import _BASE, W, predictions

T0, T1 = 1704070800, 1704671000


@register("pf1_range", f"WITH {BARS} SELECT symbol, ts, close FROM bars WHERE symbol = 'click' AND ts BETWEEN (SELECT min(ts) + 36000 FROM bars) AND (SELECT min(ts) + 720000 FROM bars)")
def pf1(spark, d):
    bars = x.hourly_bars(spark, d)
    bars = bars.join(F.broadcast(bars.agg(F.min("ts").alias("start"))))
    return core.between(bars, "click", F.col("start") + 36000, F.col("start") + 720000).select("symbol", "ts", "close")


@register("pf2_as_of", f"WITH {BARS} SELECT symbol, ts, close FROM bars WHERE ts <= (SELECT min(ts) + 720000 FROM bars) AND symbol IN ('click', 'view')")
def pf2(spark, d):
    bars = x.hourly_bars(spark, d)
    bars = bars.join(F.broadcast(bars.agg(F.min("ts").alias("start"))))
    return core.as_of(bars, F.col("start") + 720000, ["click", "view"]).select("symbol", "ts", "close")


@register("pf3_ordered", f"WITH {_BASE} SELECT symbol, ts, {rnd('rsi_14 sma_20 log_return_1')} FROM features")
def pf3(spark, d):
    return rounded(core.ordered(f.baseline(x.hourly_bars(spark, d)), ["symbol", "ts"], ["rsi_14", "sma_20", "log_return_1"]))


_SESSIONS = """sessions AS (SELECT day AS date, CAST(epoch(day) AS BIGINT) + 52200 AS open_ts, CAST(epoch(day) AS BIGINT) + 75600 AS close_ts
  FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) WHERE isodow(day) <= 5)"""


def sessions(spark, d):
    """Weekdays of the events, 14:30 to 21:00 UTC."""
    days = x.table(spark, d, "events").select(F.to_date("ts").alias("date")).distinct().where(F.weekday("date") < 5)
    at = F.unix_seconds(F.col("date").cast("timestamp"))
    return days.select("date", (at + 52200).alias("open_ts"), (at + 75600).alias("close_ts"))


_MINUTES = "SELECT event_id, event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 AS ts FROM events"


def minutes(spark, d):
    e = x.table(spark, d, "events")
    return e.select("event_id", F.col("event_type").alias("symbol"), (F.floor(x.seconds("ts") / 60) * 60).alias("ts"))


@register("pf4_regular_minutes", f"""WITH {_SESSIONS}, m AS ({_MINUTES}) SELECT event_id, symbol, ts FROM m JOIN sessions ON CAST(to_timestamp(ts) AT TIME ZONE 'UTC' AS DATE) = date WHERE ts > open_ts AND ts <= close_ts""")
def pf4(spark, d):
    return core.regular_minutes(minutes(spark, d), sessions(spark, d))


@register("pf5_freshness", """WITH l AS (SELECT user_id AS symbol, max(CAST(floor(epoch(ts)) AS BIGINT) * 1000) AS at_ms FROM events GROUP BY 1),
n AS (SELECT max(CAST(floor(epoch(ts)) AS BIGINT) * 1000) AS now FROM events)
SELECT now - at_ms BETWEEN 0 AND 86400000 AS fresh, count(*) AS n, string_agg(CAST(symbol AS VARCHAR), ',' ORDER BY CAST(symbol AS VARCHAR)) AS symbols FROM l, n GROUP BY 1""")
def pf5(spark, d):
    e = x.table(spark, d, "events").select(F.col("user_id").cast("string").alias("symbol"), (x.seconds("ts") * 1000).alias("at_ms"))
    return core.freshness(e, e.agg(F.max("at_ms").alias("now")), 86_400_000)


_SRC = "CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 7 = 1 THEN 'Mock ' || p_brand WHEN p_size % 7 = 2 THEN 'unknown' WHEN p_size % 7 = 3 THEN p_name || ' FIXTURE' ELSE p_type END"


_MODEL = "CASE WHEN p_partkey % 5 = 0 THEN 'Synthetic ' || p_brand WHEN p_partkey % 5 = 1 THEN '' WHEN p_partkey % 5 = 2 THEN 'unknown' WHEN p_partkey % 5 = 3 THEN NULL ELSE p_brand END"


@register("pf6_provenance", f"""WITH s AS (SELECT p_partkey, coalesce({_SRC}, '') AS src, coalesce({_MODEL}, '') AS model, p_size % 2 = 0 AS live FROM part)
SELECT p_partkey, CASE WHEN contains(lower(src), 'synthetic') OR contains(lower(src), 'fixture') OR contains(lower(src), 'mock') OR contains(lower(model), 'synthetic') OR contains(lower(model), 'fixture') OR contains(lower(model), 'mock') THEN 'synthetic'
  WHEN src = '' OR src = 'unknown' OR model = '' OR model = 'unknown' THEN 'rejected' WHEN live THEN 'live' ELSE 'recorded_real' END AS provenance FROM s""")
def pf6(spark, d):
    p = x.table(spark, d, "part").withColumns({"src": F.expr(_SRC), "model": F.expr(_MODEL)})
    return p.select("p_partkey", core.provenance(F.col("src"), F.col("model"), F.col("p_size") % 2 == 0).alias("provenance"))


_NAME = "CASE WHEN p_size % 5 = 0 THEN p_brand || '.' WHEN p_size % 5 = 1 THEN 'con.' || p_partkey WHEN p_size % 5 = 2 THEN '-' || p_brand WHEN p_size % 5 = 3 THEN replace(p_brand, '#', '_') ELSE 'run.' || p_partkey END"


@register("pf7_identifier", rf"""WITH s AS (SELECT p_partkey, {_NAME} AS name FROM part)
SELECT p_partkey, name, regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9_.\-]{{0,127}}$') AND NOT name LIKE '%.' AND NOT regexp_matches(upper(split_part(name, '.', 1)), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') AS ok FROM s""")
def pf7(spark, d):
    p = x.table(spark, d, "part").select("p_partkey", F.expr(_NAME.replace("'con.' || p_partkey", "concat('con.', p_partkey)").replace("'run.' || p_partkey", "concat('run.', p_partkey)")).alias("name"))
    return p.withColumn("ok", core.portable_id(F.col("name")))


_CATALOG = "SELECT s_name AS symbol, n_name AS name, r_name AS exchange FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def catalog(spark, d):
    s = x.table(spark, d, "supplier")
    n = x.nations(spark, d).select("n_nationkey", F.col("symbol").alias("name"), F.col("sector").alias("exchange"))
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_name").alias("symbol"), "name", "exchange")


@register("pf8_catalog", f"""WITH c AS ({_CATALOG}), h AS (SELECT * FROM c WHERE exchange = 'EUROPE' AND contains(lower(symbol || ' ' || name || ' ' || exchange), 'an')),
m AS (SELECT (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM c) AS catalog_total, (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT exchange AS e FROM c)) AS exchanges)
SELECT * FROM m LEFT JOIN (SELECT * FROM h ORDER BY symbol, name, exchange LIMIT 50 OFFSET 0) ON true""")
def pf8(spark, d):
    return core.search(catalog(spark, d), ["symbol", "name", "exchange"], " AN ", "EUROPE", 0, 50)


@register("pf8_empty_page", f"""WITH c AS ({_CATALOG}) SELECT count(*) FILTER (WHERE contains(lower(symbol || ' ' || name || ' ' || exchange), 'an')) AS total, count(*) AS catalog_total, string_agg(DISTINCT exchange, ',' ORDER BY exchange) AS exchanges,
  NULL AS symbol, NULL AS name, NULL AS exchange FROM c""")
def pf8b(spark, d):
    return core.search(catalog(spark, d), ["symbol", "name", "exchange"], "AN", None, 1_000_000, 50)


_PRODUCT = "c_mktsegment || '-' || CASE WHEN c_custkey % 3 = 0 THEN 'usd' WHEN c_custkey % 7 = 0 THEN 'U' ELSE 'USD' END"


@register("pf9_market_catalog", f"""SELECT c_custkey, {_PRODUCT} AS id, CASE WHEN c_custkey % 4 = 0 THEN {_PRODUCT} ELSE c_name END AS name FROM customer
WHERE c_acctbal > 0 AND c_nationkey <> 3 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND NOT regexp_matches({_PRODUCT}, '[^A-Z0-9-]') AND length(split_part({_PRODUCT}, '-', 1)) > 0 AND length(split_part({_PRODUCT}, '-', 2)) > 0""")
def pf9(spark, d):
    c = x.table(spark, d, "customer")
    rows = c.select(
        "c_custkey",
        F.expr(_PRODUCT).alias("id"),
        F.when(F.col("c_acctbal") > 0, "online").otherwise("offline").alias("status"),
        F.when(F.col("c_nationkey") == 3, True).alias("disabled"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("base"),
        F.when(F.col("c_custkey") % 13 != 0, "USD").alias("quote"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"),
    )
    return core.tradable(rows).select("c_custkey", "id", "name")


@register("pf10_model_compat", """WITH m AS (SELECT s_nationkey AS symbol, s_suppkey % 2 AS interval, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 3 END AS source FROM supplier),
d AS (SELECT c_nationkey AS symbol, c_custkey % 2 AS interval, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 3 END AS source FROM customer),
j AS (SELECT m.symbol, m.interval AS model_interval, m.source AS model_source, d.interval AS dataset_interval, d.source AS dataset_source FROM m JOIN d ON m.symbol = d.symbol WHERE m.interval <> d.interval OR m.source IS DISTINCT FROM d.source),
k AS (SELECT DISTINCT * FROM j)
SELECT *, (SELECT count(*) FROM m WHERE m.symbol = k.symbol AND interval = model_interval AND source IS NOT DISTINCT FROM model_source) AS models, (SELECT count(*) FROM d WHERE d.symbol = k.symbol AND interval = dataset_interval AND source IS NOT DISTINCT FROM dataset_source) AS datasets,
  CASE WHEN model_interval = dataset_interval THEN 'source' WHEN model_source IS NOT DISTINCT FROM dataset_source THEN 'interval' ELSE 'interval,source' END AS differs FROM k""")
def pf10(spark, d):
    s, c = x.table(spark, d, "supplier"), x.table(spark, d, "customer")
    m = s.selectExpr("s_suppkey AS model_id", "s_nationkey AS symbol", "s_suppkey % 2 AS interval", "CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 3 END AS source")
    n = c.selectExpr("c_custkey AS dataset_id", "c_nationkey AS symbol", "c_custkey % 2 AS interval", "CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 3 END AS source")
    return core.incompatible(m, n, ["interval", "source"])


@register("dq1_bars_sound", f"""WITH {DIRTY}, b AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY row_seq) AS before FROM dirty),
v AS (SELECT symbol, ts, unnest(list_filter([CASE WHEN before IS NOT NULL AND ts <= before THEN 'not increasing' END, CASE WHEN least(open, high, low, close) <= 0 THEN 'bad price' END,
  CASE WHEN high < low THEN 'high below low' END, CASE WHEN high < greatest(open, close) THEN 'high below body' END, CASE WHEN low > least(open, close) THEN 'low above body' END], lambda r: r IS NOT NULL)) AS rule FROM b)
SELECT * FROM v""")
def dq1(spark, d):
    return dq.bars_sound(x.dirty_bars(spark, d))


@register("dq2_duplicates", f"WITH {DIRTY} SELECT symbol, ts, count(*) AS n FROM dirty GROUP BY 1, 2 HAVING count(*) > 1")
def dq2(spark, d):
    return dq.duplicates(x.dirty_bars(spark, d))


_LATE = "CASE WHEN ts % 86400 = 0 THEN ts - 60 WHEN ts % 86400 = 3600 THEN ts + 7200 ELSE ts END"


@register("dq3_availability", f"""WITH {BARS}, a AS (SELECT symbol, ts, {_LATE} AS avail_ts FROM bars), n AS (SELECT max(ts) - 86400 AS now FROM bars),
b AS (SELECT *, lag(avail_ts) OVER ({W}) AS before FROM a, n)
SELECT symbol, ts, unnest(list_filter([CASE WHEN avail_ts < ts THEN 'before end' END, CASE WHEN avail_ts <= before THEN 'not increasing' END, CASE WHEN avail_ts > now THEN 'future' END], lambda r: r IS NOT NULL)) AS rule FROM b""")
def dq3(spark, d):
    bars = x.hourly_bars(spark, d).withColumn("avail_ts", F.expr(_LATE))
    bars = bars.join(F.broadcast(bars.agg((F.max("ts") - 86400).alias("now"))))
    return dq.availability(bars, F.col("now"))


@register("dq4_leakage", f"""WITH {BARS}, t AS (SELECT symbol, ts AS feature_ts, lead(ts) OVER ({W}) - CASE WHEN ts % 86400 = 0 THEN 7200 ELSE 3600 END AS target_start FROM bars) SELECT * FROM t WHERE feature_ts > target_start""")
def dq4(spark, d):
    start = F.lead("ts").over(f.by_symbol()) - F.when(F.col("ts") % 86400 == 0, 7200).otherwise(3600)
    return dq.leakage(x.hourly_bars(spark, d).select("symbol", F.col("ts").alias("feature_ts"), start.alias("target_start")))


@register("dq5_split_overlap", """WITH r AS (SELECT o_orderkey AS row_id, o_custkey % 3 AS role FROM orders UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 10 = 0)
SELECT row_id, count(DISTINCT role) AS roles FROM r GROUP BY 1 HAVING count(DISTINCT role) > 1""")
def dq5(spark, d):
    o = x.table(spark, d, "orders")
    rows = o.selectExpr("o_orderkey AS row_id", "o_custkey % 3 AS role").union(o.where("o_orderkey % 10 = 0").selectExpr("o_orderkey", "0L"))
    return dq.split_overlap(rows)


def journal_rows(spark, d):
    """Every event as a journal record of some kind, many of them with a fault."""
    e = x.table(spark, d, "events").withColumns({"k": F.col("event_id") % 8, "t": F.floor(x.seconds("ts") / 60) * 60, "v": F.col("value")})
    kind = F.element_at(F.array(*map(F.lit, ("t", "q", "b", "u", "c", "x", "zz", "b"))), (F.col("k") + 1).cast("int"))
    at = F.when(F.col("event_id") % 17 == 0, "yesterday").otherwise(F.date_format(F.timestamp_seconds(F.col("t") + F.when(F.col("event_id") % 13 == 0, 7).otherwise(0)), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    odd = F.when(F.col("event_id") % 11 == 0, -1.0).otherwise(F.col("v"))
    event = F.struct(
        kind.alias("kind"), F.col("event_type").alias("symbol"), at.alias("time"), F.when(F.col("event_id") % 3 > 0, "C").otherwise("?").alias("action"), F.col("v").alias("o"), (F.col("v") + 1).alias("h"), odd.alias("l"), F.col("v").alias("c"), odd.alias("v"),
        odd.alias("p"), F.lit(1.0).alias("size"), F.col("v").alias("bp"), F.col("v").alias("ap"), odd.alias("bs"), F.lit(0.0).alias("as_size"), F.col("v").alias("op"), odd.alias("cp"),
    )
    received = (F.col("t") + F.when(F.col("event_id") % 19 == 0, -10).when(F.col("event_id") % 23 == 0, 30).otherwise(61)) * 1000
    return e.select("event_id", received.alias("received_at_ms"), event.alias("event"))


@register("dq7_event_rules", """WITH e AS (SELECT event_id, ['t','q','b','u','c','x','zz','b'][event_id % 8 + 1] AS kind, CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 AS t, value AS v, CASE WHEN event_id % 11 = 0 THEN -1.0 ELSE value END AS odd FROM events),
f AS (SELECT *, event_id % 17 = 0 AS bad_time, t + CASE WHEN event_id % 13 = 0 THEN 7 ELSE 0 END AS due, t + CASE WHEN event_id % 19 = 0 THEN -10 WHEN event_id % 23 = 0 THEN 30 ELSE 61 END AS got FROM e),
r AS (SELECT event_id, 'bad time' AS rule FROM f WHERE bad_time UNION ALL SELECT event_id, 'unknown kind' FROM f WHERE kind = 'zz' UNION ALL SELECT event_id, 'future' FROM f WHERE bad_time OR due > got + 5
  UNION ALL SELECT event_id, 'bad trade' FROM f WHERE kind = 't' AND odd <= 0 UNION ALL SELECT event_id, 'bad quote' FROM f WHERE kind = 'q' AND (v <= 0 OR odd < 0)
  UNION ALL SELECT event_id, 'bad bar' FROM f WHERE kind IN ('b', 'u') AND (v <= 0 OR odd <= 0 OR odd > v) UNION ALL SELECT event_id, 'unaligned bar' FROM f WHERE kind IN ('b', 'u') AND (bad_time OR due % 60 <> 0)
  UNION ALL SELECT event_id, 'early bar' FROM f WHERE kind IN ('b', 'u') AND (bad_time OR got < due + 60) UNION ALL SELECT event_id, 'bad correction' FROM f WHERE kind = 'c' AND (v <= 0 OR odd <= 0)
  UNION ALL SELECT event_id, 'bad cancel' FROM f WHERE kind = 'x' AND event_id % 3 = 0)
SELECT * FROM r""")
def dq7(spark, d):
    out = dq.event_rules(journal_rows(spark, d))
    return out.select("event_id", F.explode("faults").alias("rule"))


def minute_rows(spark, d):
    """Minute bars of the events inside sessions, available half a minute after their end, some too late."""
    m = minutes(spark, d).groupBy("symbol", "ts").agg(F.count("*").alias("n"))
    late = F.when(F.col("n") > 2, 90).otherwise(30)
    return core.regular_minutes(m, sessions(spark, d)).withColumn("avail_ts", F.col("ts") + late)


@register("dq9_minutes_continue", f"""WITH {_SESSIONS}, nx AS (SELECT *, lead(open_ts) OVER (ORDER BY date) AS next_open FROM sessions), m AS (SELECT symbol, ts, count(*) AS n FROM ({_MINUTES}) GROUP BY 1, 2),
r AS (SELECT symbol, ts, ts + CASE WHEN n > 2 THEN 90 ELSE 30 END AS avail, close_ts, next_open FROM m JOIN nx ON ts > open_ts AND ts <= close_ts),
p AS (SELECT *, lag(ts) OVER w AS b, lag(avail) OVER w AS pa, lag(close_ts) OVER w AS pc, lag(next_open) OVER w AS pn FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, 'gap' AS rule FROM p WHERE b IS NOT NULL AND ts IS DISTINCT FROM CASE WHEN b < pc THEN b + 60 ELSE pn + 60 END UNION ALL SELECT symbol, ts, 'not increasing' FROM p WHERE avail <= pa UNION ALL SELECT symbol, ts, 'late' FROM p WHERE pa >= ts""")
def dq9(spark, d):
    s = sessions(spark, d)
    ahead = F.lead("open_ts").over(joins.Window.partitionBy(F.lit(0)).orderBy("date"))
    return dq.minutes_continue(minute_rows(spark, d), s.withColumn("next_open_ts", ahead))


@register("dq10_import_gate", f"""WITH {_SESSIONS}, s AS (SELECT user_id AS session_id, count(*) FILTER (WHERE event_type = 'click') AS gaps, arg_max(event_type, event_id) IN ('purchase', 'view') AS clean, count(*) FILTER (WHERE value > 90) AS faults, CASE user_id % 3 WHEN 0 THEN 'iex' WHEN 1 THEN 'sip' ELSE 'test' END AS feed FROM events GROUP BY 1),
m AS (SELECT count(*) AS n, count(DISTINCT (symbol, ts)) AS u FROM ({_MINUTES}) JOIN sessions ON ts > open_ts AND ts <= close_ts)
SELECT session_id, 'no clean stop' AS rule FROM s WHERE NOT clean UNION ALL SELECT session_id, 'gaps' FROM s WHERE gaps > 0 UNION ALL SELECT session_id, 'faults' FROM s WHERE faults > 0 UNION ALL SELECT session_id, 'delayed' FROM s WHERE feed = 'test'
UNION ALL SELECT session_id, 'repeated minutes' FROM s, m WHERE n > u UNION ALL SELECT session_id, 'empty' FROM s, m WHERE n = 0""")
def dq10(spark, d):
    e = x.table(spark, d, "events")
    summary = e.groupBy(F.col("user_id").alias("session_id")).agg(
        F.count_if(F.col("event_type") == "click").alias("gaps"), F.max_by("event_type", "event_id").isin("purchase", "view").alias("clean_shutdown"), F.count_if(F.col("value") > 90).alias("faults"), F.lit(False).alias("missing")
    )
    feed = F.when(F.col("session_id") % 3 == 0, "iex").when(F.col("session_id") % 3 == 1, "sip").otherwise("test")
    return dq.import_gate(summary.withColumn("feed", feed), core.regular_minutes(minutes(spark, d), sessions(spark, d)))


@register("dq11_candles", """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS symbol, c_acctbal AS a, c_nationkey AS k FROM customer),
v AS (SELECT symbol, k AS t, CASE WHEN k % 7 = 0 THEN 0 ELSE a - 1 END AS lo, CASE WHEN k % 5 = 0 THEN a - 2 ELSE a + 1 END AS hi, a, CASE WHEN k % 6 = 0 THEN 0 ELSE k END AS vol FROM c)
SELECT symbol, CAST(t AS BIGINT) AS ts, 'not finite' AS rule FROM v WHERE lo < 0 OR hi < 0 OR a < 0 UNION ALL SELECT symbol, t, 'no time' FROM v WHERE t = 0 UNION ALL SELECT symbol, t, 'no price' FROM v WHERE lo = 0
UNION ALL SELECT symbol, t, 'bounds' FROM v WHERE lo > a OR hi < a""")
def dq11(spark, d):
    c = x.table(spark, d, "customer")
    a, k = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    low = F.when(F.col("c_nationkey") % 7 == 0, 0.0).otherwise(a - 1)
    candle = F.array(k, low, F.when(F.col("c_nationkey") % 5 == 0, a - 2).otherwise(a + 1), a, a, F.when(F.col("c_nationkey") % 6 == 0, 0.0).otherwise(k))
    return dq.candle_rules(c.select(F.col("c_custkey").cast("string").alias("symbol"), candle.alias("candle")))


@register("dq12_reference_rates", """WITH r AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, 'EUR' AS base, CASE WHEN o_orderkey % 60 = 0 THEN 'GBP' ELSE 'USD' END AS quote,
  CASE WHEN o_orderkey % 70 = 0 THEN 0.0 ELSE o_totalprice END AS rate FROM orders),
n AS (SELECT *, count(*) OVER (PARTITION BY day) AS n, try_cast(day AS DATE) AS dt FROM r)
SELECT day, unnest(list_filter([CASE WHEN dt IS NULL THEN 'bad date' END, CASE WHEN dt < DATE '1993-01-01' OR dt > DATE '1997-12-31' THEN 'out of range' END, CASE WHEN quote <> 'USD' THEN 'other pair' END,
  CASE WHEN rate <= 0 THEN 'bad rate' END, CASE WHEN n > 1 THEN 'repeated' END], lambda v: v IS NOT NULL)) AS rule FROM n""")
def dq12(spark, d):
    o = x.table(spark, d, "orders")
    rows = o.select(
        F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.lit("EUR").alias("base"),
        F.when(F.col("o_orderkey") % 60 == 0, "GBP").otherwise("USD").alias("quote"),
        F.when(F.col("o_orderkey") % 70 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("rate"),
    )
    return dq.rate_rules(rows, "EUR", "USD", "1993-01-01", "1997-12-31")


@register("dq13_report_sane", f"""WITH {BARS}, r AS (SELECT symbol, ts, (close - lag(close) OVER ({W})) / 40.0 AS ret FROM bars)
SELECT symbol, ts, unnest(list_filter([CASE WHEN ret IS NULL THEN 'not finite' END, CASE WHEN ret < -1 THEN 'below -1' END], lambda v: v IS NOT NULL)) AS rule FROM r""")
def dq13(spark, d):
    ret = (F.col("close") - F.lag("close").over(f.by_symbol())) / 40.0
    return dq.report_sane(x.hourly_bars(spark, d).select("symbol", "ts", ret.alias("ret")), 252.0)


_ACTIONS = """actions AS (SELECT symbol, CAST(ts + 1800 AS BIGINT) AS effective_ts, CASE WHEN ts % 172800 = 0 THEN 'split' ELSE 'dividend' END AS kind, CASE WHEN ts % 172800 = 0 THEN 2.0::DOUBLE ELSE 0.125::DOUBLE END AS amount
  FROM bars WHERE ts % 604800 = 86400 OR ts % 1209600 = 345600)"""


def actions(bars):
    """A split or dividend half an hour after some bars."""
    even = F.col("ts") % 172800 == 0
    rows = bars.where("ts % 604800 = 86400 or ts % 1209600 = 345600")
    return rows.select("symbol", (F.col("ts") + 1800).alias("effective_ts"), F.when(even, "split").otherwise("dividend").alias("kind"), F.when(even, 2.0).otherwise(0.125).alias("amount"))


@register("j2_adjusted_bars", f"""WITH {BARS}, {_ACTIONS}, f AS (SELECT b.symbol, b.ts, any_value(open) AS open, any_value(high) AS high, any_value(low) AS low, any_value(close) AS close, any_value(volume) AS volume,
    product(CASE WHEN kind = 'split' THEN 1.0 / amount ELSE 1.0 END) AS factor, sum(CASE WHEN kind = 'dividend' THEN amount ELSE 0.0 END) AS paid
  FROM bars b LEFT JOIN actions a ON b.symbol = a.symbol AND b.ts < a.effective_ts AND a.effective_ts <= (SELECT max(ts) - 86400 FROM bars) GROUP BY 1, 2)
SELECT symbol, ts, round(open * factor - paid, 6) AS open, round(high * factor - paid, 6) AS high, round(low * factor - paid, 6) AS low, round(close * factor - paid, 6) AS close, CAST(round(volume / factor) AS BIGINT) AS volume FROM f""")
def j2(spark, d):
    bars = x.hourly_bars(spark, d)
    known = actions(bars).join(F.broadcast(bars.agg((F.max("ts") - 86400).alias("end"))))
    return rounded(joins.adjust(bars.drop("avail_ts"), known, F.col("end"))).select("symbol", "ts", "open", "high", "low", "close", "volume")


_SIGNALS = f"""{PREDICTIONS}, signals AS (SELECT symbol, as_of AS seq, as_of + CASE WHEN as_of % 10800 = 0 THEN 900 WHEN as_of % 10800 = 3600 THEN 0 ELSE -7200 END AS as_of, value FROM predictions)"""


@register("j3_delivered_signals", f"""WITH {_SIGNALS}, m AS (SELECT s.symbol, s.as_of, s.seq, s.value, min(b.ts) AS ts FROM signals s JOIN (SELECT symbol, ts FROM bars QUALIFY row_number() OVER ({W}) > 1) b ON s.symbol = b.symbol AND b.ts > s.as_of GROUP BY ALL),
one AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY as_of DESC, seq DESC) = 1)
SELECT symbol, ts, as_of, seq, round(value, 6) AS value FROM one""")
def j3(spark, d):
    shift = F.when(F.col("as_of") % 10800 == 0, 900).when(F.col("as_of") % 10800 == 3600, 0).otherwise(-7200)
    s = predictions(spark, d).select("symbol", (F.col("as_of") + shift).alias("as_of"), F.col("as_of").alias("seq"), "value")
    return rounded(joins.deliver(x.hourly_bars(spark, d), s, seq="seq"))


@register("j4_recent_window", f"""WITH {BARS}, q AS (SELECT DISTINCT symbol, ts + 1800 AS as_of FROM bars WHERE ts % 86400 = 0),
w AS (SELECT symbol, ts, list(close) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l, coalesce(lead(ts) OVER ({W}), 9000000000000000000) AS nxt FROM bars)
SELECT q.symbol, as_of, round(list_sum(l), 6) AS total, l[1] AS oldest FROM q JOIN w ON q.symbol = w.symbol AND w.ts <= as_of AND as_of < nxt WHERE len(l) = 5""")
def j4(spark, d):
    bars = x.hourly_bars(spark, d)
    q = bars.where("ts % 86400 = 0").select("symbol", (F.col("ts") + 1800).alias("as_of"))
    out = joins.pull(q, bars, 5, "close")
    return rounded(out.select("symbol", "as_of", F.aggregate("window", F.lit(0.0), lambda a, v: a + v).alias("total"), F.get("window", F.lit(0)).alias("oldest")))


@register("j5_outcomes", f"""WITH {PREDICTIONS}, a AS (SELECT symbol, avail_ts AS as_of, lead(avail_ts, 3) OVER ({W}) AS observed_ts, ln(lead(close, 3) OVER ({W}) / close) AS realized FROM bars)
SELECT symbol, as_of, round(value, 6) AS expected_return, observed_ts, round(realized, 6) AS realized, round(realized - value, 6) AS residual FROM predictions JOIN a USING (symbol, as_of) WHERE observed_ts IS NOT NULL""")
def j5(spark, d):
    s = predictions(spark, d).select("symbol", "as_of", F.col("value").alias("expected_return"))
    return rounded(joins.outcomes(s, x.hourly_bars(spark, d), 3))


@register("j6_matched_outcomes", """WITH d AS (SELECT event_id AS decision_id, CAST(floor(epoch(ts)) AS BIGINT) AS as_of, value AS predicted FROM events),
f AS (SELECT CASE WHEN event_id % 7 = 3 THEN -event_id - 1 ELSE event_id - CASE WHEN event_id % 6 = 1 THEN 1 ELSE 0 END END AS decision_id, CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN event_id % 4 = 0 THEN 10 ELSE 0 END AS observed_ts, CASE WHEN event_id % 5 > 0 THEN value END AS realized FROM events),
j AS (SELECT f.*, d.as_of, d.predicted, count(*) OVER (PARTITION BY f.decision_id) AS n FROM f LEFT JOIN d USING (decision_id))
SELECT decision_id, observed_ts, realized, as_of, predicted, CASE WHEN as_of IS NULL THEN 'orphan' WHEN n > 1 THEN 'duplicate' WHEN observed_ts <= as_of THEN 'early' WHEN realized IS NULL THEN 'not finite' ELSE 'ok' END AS verdict FROM j""")
def j6(spark, d):
    e = x.table(spark, d, "events").withColumn("t", x.seconds("ts"))
    dec = e.selectExpr("event_id AS decision_id", "t AS as_of", "value AS predicted")
    found = e.selectExpr("CASE WHEN event_id % 7 = 3 THEN -event_id - 1 ELSE event_id - CASE WHEN event_id % 6 = 1 THEN 1 ELSE 0 END END AS decision_id", "t - CASE WHEN event_id % 4 = 0 THEN 10 ELSE 0 END AS observed_ts", "CASE WHEN event_id % 5 > 0 THEN value END AS realized")
    return joins.match_outcomes(dec, found)


@register("j7_next_prices", f"""WITH {BARS}, t AS (SELECT symbol, ts, lead(avail_ts, 2) OVER ({W}) AS target_ts FROM bars)
SELECT t.symbol, t.ts, target_ts, b.open AS next_open, b.close AS next_close FROM t JOIN bars b ON t.symbol = b.symbol AND target_ts = b.avail_ts""")
def j7(spark, d):
    bars = x.hourly_bars(spark, d)
    rows = f.targets(bars, 2).select("symbol", "ts", "target_ts")
    return joins.next_prices(rows, bars)


@register("j8_complete_dates", f"""WITH {BARS}, k AS (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)) SELECT symbol, ts, close FROM bars JOIN k USING (ts)""")
def j8(spark, d):
    return joins.complete_dates(x.hourly_bars(spark, d)).select("symbol", "ts", "close")


@register("j8_excluded_dates", f"""WITH {BARS}, k AS (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars))
SELECT symbol, count(*) FILTER (WHERE ts NOT IN (SELECT ts FROM k)) AS excluded FROM bars GROUP BY 1""")
def j8b(spark, d):
    bars = x.hourly_bars(spark, d)
    keep = joins.complete_dates(bars).groupBy("symbol").agg(F.count("*").alias("k"))
    return bars.groupBy("symbol").agg(F.count("*").alias("n")).join(keep, "symbol", "left").select("symbol", (F.col("n") - F.coalesce("k", F.lit(0))).alias("excluded"))


@register("j9_splice", f"""WITH {BARS}, cut AS (SELECT max(ts) - 86400 AS t FROM bars), live AS (SELECT symbol, ts, close, avail_ts FROM bars, cut WHERE ts >= t AND symbol <> 'view' AND NOT (symbol = 'click' AND ts < t + 14400)),
fst AS (SELECT symbol, min(ts) AS t, min(avail_ts) AS a FROM live GROUP BY 1), old AS (SELECT symbol, ts, close + 1 AS close, t FROM bars LEFT JOIN fst USING (symbol) WHERE t IS NULL OR (ts < t AND avail_ts < a AND NOT (symbol = 'click' AND ts > t - 14400))),
joins AS (SELECT symbol, any_value(t) - max(ts) = 3600 AS ok FROM old WHERE t IS NOT NULL GROUP BY 1)
SELECT symbol, ts, close FROM old LEFT JOIN joins USING (symbol) WHERE t IS NULL OR ok UNION ALL SELECT symbol, ts, close FROM live""")
def j9(spark, d):
    bars = x.hourly_bars(spark, d).select("symbol", "ts", "close", "avail_ts").join(F.broadcast(x.hourly_bars(spark, d).agg((F.max("ts") - 86400).alias("t"))))
    late = (F.col("symbol") == "click") & (F.col("ts") < F.col("t") + 14400)
    live = bars.where((F.col("ts") >= F.col("t")) & (F.col("symbol") != "view") & ~late).drop("t")
    history = bars.withColumn("close", F.col("close") + 1).where(~((F.col("symbol") == "click") & (F.col("ts") > F.col("t")))).drop("t")
    return joins.splice(history, live, 3600).select("symbol", "ts", "close")


_RAW = "CASE n_nationkey % 7 WHEN 1 THEN 'TECH' WHEN 2 THEN 'Fin' WHEN 3 THEN 'reit' WHEN 4 THEN 'Telecom' WHEN 5 THEN 'Staples' WHEN 6 THEN r_name END"


@register("j10_sectors", f"""SELECT s_suppkey, CASE n_nationkey % 7 WHEN 1 THEN 'Technology' WHEN 2 THEN 'Financials' WHEN 3 THEN 'RealEstate' WHEN 4 THEN 'CommunicationServices' WHEN 5 THEN 'ConsumerStaples' WHEN 6 THEN lower(r_name) ELSE 'Unassigned' END AS sector
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def j10(spark, d):
    n = x.nations(spark, d).withColumnRenamed("sector", "r_name")
    m = n.where("n_nationkey % 7 > 0").select(F.col("n_nationkey").alias("symbol"), F.expr(_RAW).alias("sector"))
    s = x.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("symbol"))
    return joins.with_sector(s, m).select("s_suppkey", "sector")


@register("j11_latest_price", f"""WITH {BARS}, p AS (SELECT symbol, arg_max(close, ts) AS price FROM bars WHERE symbol <> 'view' GROUP BY 1)
SELECT DISTINCT event_type AS symbol, greatest(coalesce(price, 1.0), 1e-4::DOUBLE) AS price FROM events LEFT JOIN p ON event_type = symbol""")
def j11(spark, d):
    rows = x.table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct()
    return joins.latest_price(rows, x.hourly_bars(spark, d).where("symbol <> 'view'"))


@register("tk1_recent", f"WITH {BARS} SELECT symbol, ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 30")
def tk1(spark, d):
    return core.recent(x.hourly_bars(spark, d), 30).select("symbol", "ts", "close")


@register("tk2_latest", "SELECT event_type AS symbol, arg_max(value, (CAST(floor(epoch(ts)) AS BIGINT) // 600, event_id)) AS price, arg_max(event_id, (CAST(floor(epoch(ts)) AS BIGINT) // 600, event_id)) AS arrival FROM events GROUP BY 1")
def tk2(spark, d):
    e = x.table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("symbol"), F.floor(x.seconds("ts") / 600).alias("at"), F.col("event_id").alias("arrival"), F.col("value").alias("price"))
    return core.latest(rows, "symbol", ["at", "arrival"]).select("symbol", "price", "arrival")


_LEVELS = "SELECT p_brand AS product, CASE WHEN p_partkey % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, p_retailprice + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 2000 END AS price, CAST(p_size % 10 AS DOUBLE) AS size FROM part"


@register("tk3_book", f"""WITH l AS ({_LEVELS}), t AS (SELECT * FROM l WHERE size > 0 QUALIFY row_number() OVER (PARTITION BY product, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, size) <= 10)
SELECT product, max(price) FILTER (WHERE side = 'bid') AS best_bid, min(price) FILTER (WHERE side = 'ask') AS best_ask, sum(size) FILTER (WHERE side = 'bid') AS bid_depth, sum(size) FILTER (WHERE side = 'ask') AS ask_depth,
  count(*) AS levels, round(min(price) FILTER (WHERE side = 'ask') - max(price) FILTER (WHERE side = 'bid'), 6) AS spread FROM t GROUP BY 1""")
def tk3(spark, d):
    p = x.table(spark, d, "part")
    rows = p.select(
        F.col("p_brand").alias("product"),
        F.when(F.col("p_partkey") % 2 == 0, "bid").otherwise("ask").alias("side"),
        (F.col("p_retailprice") + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(2000)).alias("price"),
        (F.col("p_size") % 10).cast("double").alias("size"),
    )
    return rounded(core.book(rows))


@register("tk4_candles", """WITH c AS (SELECT user_id AS symbol, CAST(floor(epoch(ts)) AS BIGINT) // 86400 * 86400 AS ts, event_id AS arrival, value AS close FROM events),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY arrival DESC) = 1) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 5""")
def tk4(spark, d):
    e = x.table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("symbol"), (F.floor(x.seconds("ts") / 86400) * 86400).alias("ts"), F.col("event_id").alias("arrival"), F.col("value").alias("close"))
    return core.candles(rows, 5)


@register("tk5_decisions", """WITH c AS (SELECT event_type AS dataset, CAST(floor(epoch(ts)) AS BIGINT) // 7200 AS as_of, event_id AS seq FROM events),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dataset, as_of ORDER BY seq DESC) = 1) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY as_of DESC) <= 40""")
def tk5(spark, d):
    e = x.table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("dataset"), F.floor(x.seconds("ts") / 7200).alias("as_of"), F.col("event_id").alias("seq"))
    return core.distinct_decisions(rows, 40)


@register("so1_union", f"WITH {BARS} SELECT symbol, ts, close, NULL::BIGINT AS volume FROM bars UNION ALL SELECT symbol, ts, NULL, volume FROM bars")
def so1(spark, d):
    bars = x.hourly_bars(spark, d)
    return core.union_all(bars.select("symbol", "ts", "close"), bars.select("volume", "ts", "symbol"))


@register("so2_common_times", f"WITH {BARS} SELECT ts FROM bars WHERE symbol = 'click' INTERSECT SELECT ts FROM bars WHERE symbol = 'view' INTERSECT SELECT ts FROM bars WHERE symbol = 'signup'")
def so2(spark, d):
    bars = x.hourly_bars(spark, d)
    return core.common_times(bars, spark.createDataFrame([("click",), ("view",), ("signup",)], "symbol string"))


@register("so3_disjoint", "SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1")
def so3(spark, d):
    o = x.table(spark, d, "orders")
    return o.where("o_orderkey % 2 = 0").select("o_custkey").intersect(o.where("o_orderkey % 2 = 1").select("o_custkey"))


@register("so4_counts", f"WITH {BARS} SELECT symbol, count(*) AS n FROM bars GROUP BY 1")
def so4(spark, d):
    return x.hourly_bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n"))


@register("sp8_downsample", f"""WITH {BARS}, i AS (SELECT *, row_number() OVER ({W}) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
k AS (SELECT DISTINCT symbol, n FROM i WHERE n > 100), b AS (SELECT symbol, n, 1 + t * (n - 2) // 24 AS a, 1 + (t + 1) * (n - 2) // 24 AS z FROM k, range(24) r(t)),
e AS (SELECT b.symbol, b.a, v.v, v.idx FROM b JOIN (SELECT symbol, idx, unnest([close, volume::DOUBLE]) AS v, unnest(['close', 'volume']) AS c FROM i) v ON v.symbol = b.symbol AND v.idx >= b.a AND v.idx < b.z, LATERAL (SELECT v.c) c(c)
  QUALIFY row_number() OVER (PARTITION BY b.symbol, b.a, c.c ORDER BY v.v, v.idx) = 1 OR row_number() OVER (PARTITION BY b.symbol, b.a, c.c ORDER BY v.v DESC, v.idx DESC) = 1),
s AS (SELECT symbol, idx FROM e UNION SELECT symbol, 0 FROM k UNION SELECT symbol, n - 1 FROM k UNION SELECT symbol, idx FROM i WHERE n <= 100)
SELECT symbol, ts, close, idx FROM i JOIN s USING (symbol, idx)""")
def sp8(spark, d):
    out = core.downsample(x.hourly_bars(spark, d), ["close", "volume"], 100)
    return out.select("symbol", "ts", "close", F.col("idx").cast("long").alias("idx"))


@register("sp9_page", f"WITH {BARS} SELECT symbol, ts, close, (SELECT count(*) FROM bars) AS total, 100::BIGINT AS \"offset\", least(25, greatest((SELECT count(*) FROM bars) - 100, 0))::BIGINT AS returned FROM bars ORDER BY ts, symbol LIMIT 25 OFFSET 100")
def sp9(spark, d):
    return core.page(x.hourly_bars(spark, d).select("symbol", "ts", "close"), ["ts", "symbol"], 100, 25)


@register("sp7_even_sample", f"""WITH {BARS}, i AS (SELECT symbol, ts, close, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
k AS (SELECT DISTINCT symbol, CASE WHEN n <= 64 THEN j ELSE (j * (n - 1)) // 63 END AS i FROM (SELECT DISTINCT symbol, n FROM i), unnest(range(64)) t(j) WHERE j < n)
SELECT symbol, ts, close FROM i JOIN k USING (symbol, i)""")
def sp7(spark, d):
    return core.even_sample(x.hourly_bars(spark, d).select("symbol", "ts", "close"), 64)
