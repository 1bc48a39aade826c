"""Splits, performance, risk, drift and calibration over the derived series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.taps import fracdiff_taps
from ..operators import core, dq, joins, metrics, splits
from ..operators import features as f
from ..sources import fixtures as x
from .base import BARS, MONTHLY, PREDICTIONS, register, rnd, rounded
from .feature_queries import _NAV, W, _PPF, nav_curve, predictions

P = 6048.0
SQ = repr(math.sqrt(P))

_IDX = f"i AS (SELECT symbol, ts, close, row_number() OVER ({W}) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"
_HOLD = f"""{_IDX}, h0 AS (SELECT *, CAST(floor(n * 0.6) AS BIGINT) AS nt, CAST(floor(n * 0.2) AS BIGINT) AS nv FROM i),
hold AS (SELECT symbol, ts, idx, n, CASE WHEN idx < greatest(nt - 5, 1) THEN 'train'
  WHEN nt + 8 < n AND nt + 8 < least(greatest(nt + 9, nt + nv - 5), n) AND idx >= nt + 8 AND idx < least(greatest(nt + 9, nt + nv - 5), n) THEN 'val'
  WHEN idx >= nt + nv + 8 THEN 'test' END AS role FROM h0)"""


@register("sp1_holdout", f"WITH {BARS}, {_HOLD} SELECT symbol, ts, idx, role FROM hold")
def sp1(spark, d):
    return splits.holdout(x.hourly_bars(spark, d), 5, 8).select("symbol", "ts", F.col("idx").cast("long").alias("idx"), "role")


_FOLDS = """f AS (SELECT i.*, k AS fold, n - (4 - k) * (n // 5) AS a, n // 5 AS t FROM i, range(4) r(k)),
fold AS (SELECT symbol, ts, idx, fold, CASE WHEN idx < a - 13 THEN 'train' WHEN idx >= a AND idx < a + t THEN 'test' END AS role FROM f WHERE a > 5 AND a - 13 > 0)"""


@register("sp2_walk_forward", f"WITH {BARS}, {_IDX}, {_FOLDS} SELECT symbol, fold, role, count(*) AS n, min(idx) AS first, max(idx) AS last FROM fold WHERE role IS NOT NULL GROUP BY ALL")
def sp2(spark, d):
    rows = splits.walk_forward(x.hourly_bars(spark, d), 4, 5, 8)
    return rows.groupBy("symbol", F.col("fold").cast("long").alias("fold"), "role").agg(F.count("*").alias("n"), F.min("idx").cast("long").alias("first"), F.max("idx").cast("long").alias("last"))


@register("sp3_inner_split", f"""WITH {BARS}, {_IDX}, {_FOLDS}, j AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY ts) - 1 AS k, floor(0.85 * count(*) OVER (PARTITION BY symbol, fold)) AS b FROM fold WHERE role = 'train'),
r AS (SELECT *, CASE WHEN k < greatest(b - 5, 0) THEN 'train' WHEN k >= b + 8 THEN 'val' END AS inner_role FROM j) SELECT symbol, fold, inner_role, count(*) AS n, min(ts) AS from_ts FROM r GROUP BY ALL""")
def sp3(spark, d):
    rows = splits.walk_forward(x.hourly_bars(spark, d), 4, 5, 8).where("role = 'train'")
    return splits.inner(rows, 5, 8).groupBy("symbol", F.col("fold").cast("long").alias("fold"), "inner_role").agg(F.count("*").alias("n"), F.min("ts").alias("from_ts"))


_CF = f"""{BARS}, t AS (SELECT symbol, avail_ts AS ts, lead(avail_ts) OVER ({W}) AS target_ts FROM bars), u AS (SELECT * FROM t WHERE target_ts IS NOT NULL),
c AS (SELECT (min(ts) // 86400 + 3) * 86400 AS c0, (min(ts) // 86400 + 8) * 86400 AS c1, (min(ts) // 86400 + 14) * 86400 AS c2 FROM bars),
i AS (SELECT symbol, ts, target_ts, c2, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM u, c),
k AS (SELECT symbol, count(*) FILTER (WHERE ts < c0) AS k0, count(*) FILTER (WHERE ts < c1) AS k1, count(*) FILTER (WHERE ts < c2) AS k2 FROM u, c GROUP BY 1),
folds AS (SELECT i.symbol, ts, target_ts, 'train' AS role FROM i JOIN k USING (symbol) WHERE idx < greatest(0, k0 - 5)
  UNION ALL SELECT i.symbol, ts, target_ts, 'val' FROM i JOIN k USING (symbol) WHERE idx >= k0 + 8 AND idx < greatest(k0 + 8, k1 - 5)
  UNION ALL SELECT i.symbol, ts, target_ts, 'test' FROM i JOIN k USING (symbol) WHERE idx >= k1 + 8 AND idx < k2 AND target_ts < c2)"""


@register("sp4_calendar_folds", f"WITH {_CF} SELECT symbol, role, count(*) AS n, min(ts) AS from_ts, max(ts) AS to_ts FROM folds GROUP BY ALL")
def sp4(spark, d):
    return calendar(spark, d).groupBy("symbol", "role").agg(F.count("*").alias("n"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))


def calendar(spark, d):
    bars = x.hourly_bars(spark, d)
    rows = f.targets(bars).select("symbol", "ts", "target_ts").join(F.broadcast(bars.agg(F.floor(F.min("ts") / 86400).alias("day"))))
    return splits.calendar_folds(rows, tuple((F.col("day") + k) * 86400 for k in (3, 8, 14)), 5, 8).drop("day")


@register("sp4_calendar_faults", f"""WITH {_CF}, n AS (SELECT s.symbol, (SELECT count(*) FROM folds f WHERE f.symbol = s.symbol AND f.role = r.role) AS n FROM (SELECT DISTINCT symbol FROM bars) s, (VALUES ('train'), ('val'), ('test')) r(role)),
o AS (SELECT a.symbol FROM folds a JOIN folds b ON a.symbol = b.symbol AND (a.role, b.role) IN (('train', 'val'), ('val', 'test')) GROUP BY a.symbol, a.role HAVING arg_max(a.target_ts, a.ts) >= min(b.ts))
SELECT symbol, 'coverage' AS rule FROM n GROUP BY symbol HAVING min(n) < 105 UNION ALL SELECT DISTINCT symbol, 'overlap' FROM o""")
def sp4b(spark, d):
    return splits.calendar_faults(calendar(spark, d), x.hourly_bars(spark, d), 105)


@register("sp5_timeline", f"""WITH {BARS}, {_HOLD}, r AS (SELECT symbol, role, min(idx) AS first, max(idx) AS last FROM hold WHERE role IS NOT NULL GROUP BY ALL),
g AS (SELECT symbol, 'gap after ' || role AS role, last + 1 AS first, lead(first) OVER (PARTITION BY symbol ORDER BY first) - 1 AS last FROM r),
s AS (SELECT * FROM r UNION ALL SELECT * FROM g WHERE last >= first)
SELECT s.symbol, s.role, s.first, s.last, a.ts AS from_ts, z.ts AS to_ts FROM s JOIN hold a ON a.symbol = s.symbol AND a.idx = s.first JOIN hold z ON z.symbol = s.symbol AND z.idx = s.last""")
def sp5(spark, d):
    out = splits.timeline(splits.holdout(x.hourly_bars(spark, d), 5, 8))
    return out.withColumns({c: F.col(c).cast("long") for c in ("first", "last")})


@register("sp6_scaled", f"""WITH {BARS}, {_HOLD}, v AS (SELECT h.*, b.close, b.volume::DOUBLE AS volume FROM hold h JOIN bars b USING (symbol, ts)),
s AS (SELECT avg(close) AS cm, stddev_pop(close) AS cs, avg(volume) AS vm, stddev_pop(volume) AS vs FROM v WHERE role = 'train')
SELECT symbol, ts, round((close - cm) / cs, 6) AS close, round((volume - vm) / vs, 6) AS volume FROM v, s WHERE role = 'test'""")
def sp6(spark, d):
    rows = splits.holdout(x.hourly_bars(spark, d).withColumn("volume", F.col("volume").cast("double")), 5, 8)
    scaler = splits.fit_scaler(rows.where("role = 'train'"), ["close", "volume"])
    return rounded(splits.scale(rows.where("role = 'test'"), scaler, ["close", "volume"]).select("symbol", "ts", "close", "volume"))


@register("dq6_split_geometry", f"""WITH {BARS}, {_HOLD}, l AS (SELECT h.*, lead(ts, 12) OVER ({W}) AS target_ts FROM hold h),
r AS (SELECT symbol, role, count(*) AS n, min(idx) AS first, max(idx) AS last, min(ts) AS from_ts, max(target_ts) AS label_end FROM l WHERE role IS NOT NULL GROUP BY ALL),
x AS (SELECT *, lead(first) OVER w AS nf, lead(from_ts) OVER w AS nt FROM r WINDOW w AS (PARTITION BY symbol ORDER BY first))
SELECT symbol, role, n, first, last, n < 40 AS small, coalesce(nf - last - 1 < 13, false) AS near, coalesce(label_end > nt, false) AS leaks FROM x""")
def dq6(spark, d):
    rows = splits.holdout(x.hourly_bars(spark, d), 5, 8).withColumn("target_ts", F.lead("ts", 12).over(f.by_symbol()))
    out = dq.split_geometry(rows.where("role is not null"), 13, 40)
    return out.select("symbol", "role", "n", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "small", "near", "leaks")


_R = f"""{_NAV}, ret AS (SELECT symbol, ts, nav, nav / lag(nav) OVER ({W}) - 1 AS ret FROM nav)"""


@register("a1_performance", f"""WITH {_R}, dd AS (SELECT symbol, ts, nav, greatest(max(nav) OVER ({W} ROWS UNBOUNDED PRECEDING), 1000.0) AS peak FROM nav),
m AS (SELECT symbol, max((peak - nav) / peak) AS max_drawdown, arg_max(nav, ts) AS final FROM dd GROUP BY 1),
s AS (SELECT symbol, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS vol, sum(CASE WHEN ret < 0.02 / {P} THEN (ret - 0.02 / {P}) ** 2 ELSE 0 END) AS down FROM ret GROUP BY 1),
t AS (SELECT *, (final - 1000) / 1000 AS total_return FROM m JOIN s USING (symbol)),
c AS (SELECT *, CASE WHEN n >= 2 AND final > 0 AND n / {P} > 0.05 THEN pow(final / 1000, 1.0 / (n / {P})) - 1 ELSE total_return END AS cagr FROM t)
SELECT symbol, n, round(total_return, 6) AS total_return, round(cagr, 4) AS cagr, round((mean - 0.02 / {P}) / vol * {SQ}, 6) AS sharpe, round((mean - 0.02 / {P}) / sqrt(down / (n - 1)) * {SQ}, 6) AS sortino,
  round(CASE WHEN max_drawdown > 1e-4 THEN cagr / max_drawdown ELSE 0 END, 4) AS calmar, round(max_drawdown, 6) AS max_drawdown FROM c""")
def a1(spark, d):
    out = metrics.performance(nav_curve(spark, d), 1000.0, P, 0.02)
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("cagr", "calmar")}))


@register("a3_deflated", f"""WITH {_R} SELECT symbol, round(greatest(avg(ret) / stddev_samp(ret) * {SQ} - sqrt(ln(count(*)::DOUBLE)) * 0.15, -5.0), 6) AS deflated FROM ret GROUP BY 1""")
def a3(spark, d):
    r = returns(spark, d)
    s = r.groupBy("symbol").agg((F.avg("ret") / F.stddev_samp("ret") * math.sqrt(P)).alias("s"), (F.count("*") + 1).alias("n"))
    return rounded(s.select("symbol", metrics.deflated(F.col("s"), F.col("n")).alias("deflated")))


def returns(spark, d):
    return f.curve_returns(nav_curve(spark, d))


@register("a4_deflated_probability")
def a4(spark, d):
    return rounded(metrics.deflated_probability(returns(spark, d), 20, 0.0004))


@register("a5_risk", f"""WITH {_R}, b AS (SELECT symbol, ts, ret, avg(ret) OVER (PARTITION BY ts) AS benchmark FROM ret WHERE ret IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ret, ts) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM b),
s AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS v, avg(ret) FILTER (WHERE k <= ceil(n * 0.05)) AS tail, covar_samp(ret, benchmark) / var_samp(benchmark) AS beta FROM k GROUP BY 1),
n AS (SELECT symbol, arg_max(nav, ts) AS nav FROM nav GROUP BY 1)
SELECT symbol, round(greatest(1.6448536269514722 * v - m, 0) * nav, 4) AS var_95, round(greatest(-tail * nav, greatest(1.6448536269514722 * v - m, 0) * nav), 4) AS cvar_95, round(v * {SQ}, 4) AS annual_vol, round(beta, 6) AS beta FROM s JOIN n USING (symbol)""")
def a5(spark, d):
    r = returns(spark, d).withColumn("benchmark", F.avg("ret").over(f.Window.partitionBy("ts")))
    nav = nav_curve(spark, d).groupBy("symbol").agg(F.max_by("nav", "ts").alias("nav"))
    out = metrics.risk(r, nav, P)
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("var_95", "cvar_95", "annual_vol")}))


@register("a6_factor_exposure", f"""WITH {_R}, b AS (SELECT symbol, ts, ret, avg(ret) OVER (PARTITION BY ts) AS benchmark FROM ret WHERE ret IS NOT NULL),
g AS (SELECT symbol, arg_max(close, ts) * 3.0 AS held FROM bars GROUP BY 1)
SELECT symbol, round(covar_samp(ret, benchmark) / var_samp(benchmark), 6) AS market, round(any_value(held) / (any_value(held) + 50.0), 6) AS gross_leverage FROM b JOIN g USING (symbol) GROUP BY 1""")
def a6(spark, d):
    r = returns(spark, d).withColumn("benchmark", F.avg("ret").over(f.Window.partitionBy("ts")))
    nav = nav_curve(spark, d).groupBy("symbol").agg(F.max_by("nav", "ts").alias("nav"))
    held = x.hourly_bars(spark, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("price")).select("symbol", F.lit(0).alias("ts"), F.lit(3.0).alias("quantity"), "price")
    book = metrics.exposures(held, held.select("symbol", "ts", F.lit(50.0).alias("cash")))
    out = metrics.factor_exposure(metrics.risk(r, nav, P), book)
    return rounded(out.select("symbol", F.col("exposure")["market"].alias("market"), F.col("exposure")["gross_leverage"].alias("gross_leverage")))


@register("a7_stress", """WITH b AS (SELECT c_nationkey AS symbol, sum(abs(c_acctbal)) AS nav, sum(c_acctbal) AS net_value FROM customer GROUP BY 1)
SELECT symbol, scenario, round(move * net_value, 4) AS pnl, round(move * net_value / nav, 6) AS pnl_pct FROM b, (VALUES ('MarketCrash_10Pct', -0.10::DOUBLE), ('MarketRally_10Pct', 0.10::DOUBLE), ('SevereCrisis_20Pct', -0.20::DOUBLE)) s(scenario, move)""")
def a7(spark, d):
    b = x.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("symbol")).agg(F.sum(F.abs("c_acctbal")).alias("nav"), F.sum("c_acctbal").alias("net_value"))
    out = metrics.stress(b)
    return out.select("symbol", "scenario", F.round("pnl", 4).alias("pnl"), F.round("pnl_pct", 6).alias("pnl_pct"))


@register("a8_exposures", """WITH p AS (SELECT o_orderpriority AS symbol, CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) AS ts, o_custkey % 9 - 4 AS q, o_totalprice AS price FROM orders),
s AS (SELECT symbol, ts, sum(q * price) AS net_value, sum(abs(q * price)) AS gross_value FROM p GROUP BY 1, 2)
SELECT symbol, ts, round(net_value, 2) AS net_value, round(gross_value, 2) AS gross_value, round(1e9 + net_value, 2) AS nav, round(gross_value / (1e9 + net_value), 6) AS gross_exposure, round(net_value / (1e9 + net_value), 6) AS net_exposure FROM s""")
def a8(spark, d):
    o = x.table(spark, d, "orders")
    ts = F.unix_seconds(F.trunc("o_orderdate", "month").cast("timestamp"))
    p = o.select(F.col("o_orderpriority").alias("symbol"), ts.alias("ts"), (F.col("o_custkey") % 9 - 4).alias("quantity"), F.col("o_totalprice").alias("price"))
    cash = p.select("symbol", "ts").distinct().withColumn("cash", F.lit(1e9))
    out = metrics.exposures(p, cash).drop("cash")
    return rounded(out.withColumns({c: F.round(c, 2) for c in ("net_value", "gross_value", "nav")}))


_PT = f"""{PREDICTIONS}, pt AS (SELECT symbol, as_of AS ts, value AS pred, target FROM predictions JOIN
  (SELECT symbol, ts AS as_of, round(CASE WHEN r IS NOT NULL THEN greatest(least(r, 0.5), -0.5) END, 9) AS target FROM (SELECT symbol, ts, ln(lead(close) OVER ({W}) / close) AS r FROM bars)) USING (symbol, as_of) WHERE target IS NOT NULL)"""


def pairs(spark, d):
    """Predictions and their clipped next returns."""
    bars = x.hourly_bars(spark, d)
    t = f.targets(bars).select("symbol", "ts", F.round(F.greatest(F.least("target", F.lit(0.5)), F.lit(-0.5)), 9).alias("target"))
    return predictions(spark, d).select("symbol", F.col("as_of").alias("ts"), F.col("value").alias("pred")).join(t, ["symbol", "ts"])


@register("a9_information", f"""WITH {_PT}, k AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY pred) + (count(*) OVER (PARTITION BY symbol, pred) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY target) + (count(*) OVER (PARTITION BY symbol, target) - 1) / 2.0 AS b FROM pt)
SELECT symbol, round(corr(pred, target), 6) AS ic, round(corr(a::DOUBLE, b::DOUBLE), 6) AS rank_ic FROM k GROUP BY 1""")
def a9(spark, d):
    return rounded(metrics.information(pairs(spark, d)))


@register("a10_direction", f"WITH {_PT} SELECT symbol, round(coalesce(avg(CASE WHEN target <> 0 THEN CASE WHEN sign(pred) = sign(target) THEN 1.0 ELSE 0.0 END END), 0.5), 6) AS accuracy FROM pt GROUP BY 1")
def a10(spark, d):
    return rounded(metrics.direction(pairs(spark, d)))


_FC = f"""{_PT}, r AS (SELECT *, tanh(pred) * target AS ret FROM pt), e AS (SELECT *, exp(sum(ln(1 + ret)) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS e FROM r),
dd AS (SELECT *, e / max(e) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)"""


_REPORT = """SELECT symbol, round(corr(pred, target), 6) AS ic, round(corr(ra, rb), 6) AS rank_ic, round(avg(CASE WHEN target <> 0 THEN CASE WHEN sign(pred) = sign(target) THEN 1.0 ELSE 0.0 END END), 6) AS accuracy,
  round((avg(ret) - 0.04 / {p}) / stddev_pop(ret) * {sq}, 6) AS sharpe, round(min(dd), 6) AS max_drawdown, round(avg(ret), 6) AS mean_return, round(stddev_pop(ret) * {sq}, 6) AS volatility FROM dd GROUP BY 1""".format(p=P, sq=SQ)
_RK = """k AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY pred) + (count(*) OVER (PARTITION BY symbol, pred) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY symbol ORDER BY target) + (count(*) OVER (PARTITION BY symbol, target) - 1) / 2.0::DOUBLE AS rb FROM q),
r AS (SELECT *, tanh(pred) * target AS ret FROM k), e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS e FROM r),
dd AS (SELECT *, e / max(e) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)"""


@register("a11_forecast", f"WITH {_PT}, q AS (SELECT * FROM pt), {_RK} {_REPORT}")
def a11(spark, d):
    return rounded(metrics.forecast(pairs(spark, d), P))


@register("ml6_pooled_forecast", f"WITH {_PT}, q AS (SELECT 'momentum' AS symbol, ts * 16 + (ascii(symbol) % 16) AS ts, pred, target FROM pt), {_RK} {_REPORT}")
def ml6(spark, d):
    rows = pairs(spark, d).select(F.lit("momentum").alias("symbol"), (F.col("ts") * 16 + F.ascii("symbol") % 16).alias("ts"), "pred", "target")
    return rounded(metrics.forecast(rows, P))


@register("a13_hac", f"""WITH {_R}, g AS (SELECT symbol, ts, CASE WHEN symbol = 'click' AND ts % 7200 = 0 OR symbol = 'view' AND ts > (SELECT min(ts) FROM bars) + 25200 THEN NULL ELSE ret END AS ret FROM ret),
x AS (SELECT symbol, row_number() OVER ({W}) AS i, ret - avg(ret) OVER (PARTITION BY symbol) AS d, avg(ret) OVER (PARTITION BY symbol) AS m, count(*) OVER (PARTITION BY symbol) AS n FROM g WHERE ret IS NOT NULL),
v AS (SELECT a.symbol, any_value(a.n) AS n, any_value(a.m) AS mean, sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / 6.0::DOUBLE) END * a.d * b.d) / any_value(a.n) AS var FROM x a JOIN x b ON a.symbol = b.symbol AND a.i - b.i BETWEEN 0 AND 5 GROUP BY 1)
SELECT symbol, n, round(mean, 6) AS mean, round(CASE WHEN n > 7 AND var > 0 THEN mean / sqrt(var / n) END, 5) AS t FROM v""")
def a13(spark, d):
    r = returns(spark, d).join(F.broadcast(x.hourly_bars(spark, d).agg(F.min("ts").alias("t0"))))
    gone = ((F.col("symbol") == "click") & (F.col("ts") % 7200 == 0)) | ((F.col("symbol") == "view") & (F.col("ts") > F.col("t0") + 25200))
    out = metrics.hac_t(r.withColumn("ret", F.when(~gone, F.col("ret"))).drop("t0"), "ret")
    return out.select("symbol", "n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


@register("a14_date_information", f"WITH {_PT} SELECT ts, round(corr(pred, target), 6) AS ic, count(*) AS n FROM pt GROUP BY 1 HAVING count(*) >= 3 AND corr(pred, target) IS NOT NULL AND NOT isnan(corr(pred, target))")
def a14(spark, d):
    return rounded(metrics.date_information(pairs(spark, d).withColumn("model_id", F.lit("m"))).drop("model_id"))


@register("a15_across_seeds", f"""WITH {_PT}, s AS (SELECT symbol AS model_id, ts % 5 AS seed, avg(pred * target) / stddev_samp(pred * target) AS sharpe FROM pt GROUP BY 1, 2)
SELECT model_id, round(avg(sharpe), 6) AS mean, round(stddev_samp(sharpe), 6) AS std, round(var_samp(sharpe), 6) AS variance, count(*) AS n FROM s GROUP BY 1""")
def a15(spark, d):
    r = F.col("pred") * F.col("target")
    s = pairs(spark, d).groupBy(F.col("symbol").alias("model_id"), (F.col("ts") % 5).alias("seed")).agg((F.avg(r) / F.stddev_samp(r)).alias("sharpe"))
    return rounded(metrics.across_seeds(s))


@register("a16_losses", f"""WITH {_PT}, e AS (SELECT *, abs(pred - target) AS e, tanh(pred) * target AS r FROM pt)
SELECT symbol, round(avg(CASE WHEN e <= 1 THEN 0.5 * e * e ELSE e - 0.5 END * CASE WHEN pred * target < 0 THEN 2.0 ELSE 1.0 END), 6) AS directional, round(-avg(r) / (stddev_samp(r) + 1e-6::DOUBLE), 5) AS neg_sharpe,
  round(-avg(r) / sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END) + 1e-6::DOUBLE), 5) AS neg_sortino FROM e GROUP BY 1""")
def a16(spark, d):
    out = metrics.losses(pairs(spark, d))
    return out.select("symbol", F.round("directional", 6).alias("directional"), F.round("neg_sharpe", 5).alias("neg_sharpe"), F.round("neg_sortino", 5).alias("neg_sortino"))


@register("a16_multi_horizon", f"""WITH {BARS}, t AS (SELECT symbol, ts, ln(lead(close, 1) OVER w / close) AS h1, ln(lead(close, 5) OVER w / close) AS h5, ln(lead(close, 20) OVER w / close) AS h20 FROM bars WINDOW w AS ({W})),
l AS (SELECT symbol, unnest([5.0, 3.0, 2.0])::DOUBLE / 10 AS w, unnest([0.01, 0.02, 0.03])::DOUBLE AS p, unnest([h1, h5, h20]) AS y FROM t WHERE h20 IS NOT NULL),
d AS (SELECT symbol, w, CASE WHEN abs(p - y) <= 1 THEN (p - y) ** 2 / 2 ELSE abs(p - y) - 0.5 END * CASE WHEN p * y < 0 THEN 2 ELSE 1 END AS loss FROM l), h AS (SELECT symbol, w, avg(loss) AS loss FROM d GROUP BY 1, 2)
SELECT symbol, round(sum(w * loss), 6) AS loss FROM h GROUP BY 1""")
def a16m(spark, d):
    rows = f.multi_targets(x.hourly_bars(spark, d)).withColumn("preds", F.array(F.lit(0.01), F.lit(0.02), F.lit(0.03)))
    return rounded(metrics.multi_horizon_loss(rows, [5.0, 3.0, 2.0]))


_DIST = "max(CASE WHEN k = floor((n - 1) * {p} + 0.5) + 1 THEN v END)"


@register("a17_distribution", "WITH r AS (SELECT event_type AS symbol, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT symbol, "
  + ", ".join(f"{_DIST.format(p=p)} AS p{int(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", round(avg(v), 6) AS mean FROM r GROUP BY 1")
def a17(spark, d):
    e = x.table(spark, d, "events").select(F.col("event_type").alias("symbol"), "value")
    out = metrics.distribution(e, "value", "symbol")
    return out.withColumn("mean", F.round("mean", 6))


_LABEL = """CASE WHEN n < 5 THEN 'MeanReverting' WHEN worst < -0.06 OR vol > 0.45 THEN 'Crisis' WHEN vol > 0.25 THEN 'HighVol' WHEN mean > {b} THEN 'Bull' WHEN mean < -{b} THEN 'Bear' WHEN vol < 0.10 THEN 'LowVol' ELSE 'MeanReverting' END"""


@register("a18_regimes", f"""WITH {MONTHLY}, r AS (SELECT symbol, ts, (volume - lag(volume) OVER ({W})) / lag(volume) OVER ({W}) / 20.0 AS ret FROM monthly),
s AS (SELECT symbol, count(*) AS n, min(ret) AS worst, coalesce(stddev_samp(ret), 0) * sqrt(12.0) AS vol, avg(ret) AS mean FROM r WHERE ret IS NOT NULL GROUP BY 1) SELECT symbol, n, {_LABEL.format(b=repr(0.0008 * 21))} AS regime FROM s""")
def a18(spark, d):
    return metrics.regimes(monthly_returns(spark, d), 12.0)


def monthly_returns(spark, d):
    before = F.lag("volume").over(f.by_symbol())
    return x.monthly_bars(spark, d).select("symbol", "ts", ((F.col("volume") - before) / before / 20.0).alias("ret")).where("ret is not null")


@register("a18_rolling_regimes", f"""WITH {MONTHLY}, r AS (SELECT symbol, ts, (volume - lag(volume) OVER ({W})) / lag(volume) OVER ({W}) / 20.0 AS ret FROM monthly),
s AS (SELECT symbol, ts, count(ret) OVER w AS n, min(ret) OVER w AS worst, coalesce(stddev_samp(ret) OVER w, 0) * sqrt(12.0) AS vol, avg(ret) OVER w AS mean FROM r WHERE ret IS NOT NULL WINDOW w AS ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT symbol, ts, {_LABEL.format(b=repr(0.0008 * 21))} AS regime FROM s""")
def a18r(spark, d):
    return metrics.rolling_regimes(monthly_returns(spark, d), 12, 12.0)


_KS = """e AS (SELECT label, unnest(embedding)::DOUBLE AS value, unnest(range(len(embedding))) AS feature FROM embeddings),
c AS (SELECT feature, value, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN label <> 0 THEN 1 ELSE 0 END) AS b FROM e GROUP BY 1, 2),
k AS (SELECT feature, max(abs(sa / ta - sb / tb)) AS ks FROM (SELECT feature, sum(a) OVER w::DOUBLE AS sa, sum(b) OVER w::DOUBLE AS sb, sum(a) OVER p::DOUBLE AS ta, sum(b) OVER p::DOUBLE AS tb FROM c
  WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature)) GROUP BY 1)"""


def embedded(spark, d):
    e = x.table(spark, d, "embeddings")
    return e.select("label", F.posexplode("embedding").alias("feature", "v")).select("label", F.col("feature").cast("long").alias("feature"), F.col("v").cast("double").alias("value"))


@register("a19_ks", f"WITH {_KS} SELECT feature, round(ks, 6) AS ks FROM k")
def a19(spark, d):
    e = embedded(spark, d)
    return rounded(metrics.ks(e.where("label = 0"), e.where("label <> 0")))


@register("a20_drift", f"""WITH {_PT}, lg AS (SELECT symbol AS dataset, ts AS as_of, pred AS predicted, target AS realized, ts AS seq FROM pt WHERE ts % 10800 > 0 AND NOT (symbol = 'view' AND ts > (SELECT min(ts) FROM bars) + 90000)),
dec AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY seq DESC) <= 100),
ref AS (SELECT symbol AS dataset, pred AS value FROM pt QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) <= 150),
pts AS (SELECT dataset, predicted AS v FROM dec UNION SELECT dataset, value FROM ref WHERE dataset IN (SELECT dataset FROM dec)),
k AS (SELECT dataset, max(abs((SELECT count(*) FROM ref r WHERE r.dataset = pts.dataset AND r.value <= pts.v) / (SELECT count(*) FROM ref r WHERE r.dataset = pts.dataset)::DOUBLE
  - (SELECT count(*) FROM dec d WHERE d.dataset = pts.dataset AND d.predicted <= pts.v) / (SELECT count(*) FROM dec d WHERE d.dataset = pts.dataset)::DOUBLE)) AS max_ks FROM pts GROUP BY 1),
q AS (SELECT dataset, count(*) AS n, corr(predicted, realized) AS ic, avg(CASE WHEN (predicted < 0) = (realized < 0) THEN 1.0 ELSE 0.0 END) AS hit_rate FROM dec GROUP BY 1)
SELECT dataset, n, n AS outcomes, round(max_ks, 6) AS max_ks, round(ic, 6) AS ic, round(hit_rate, 6) AS hit_rate, CASE WHEN n < 100 THEN 'insufficient_data' WHEN max_ks >= 0.4 THEN 'halt' WHEN max_ks >= 0.2 THEN 'warn' ELSE 'ok' END AS status FROM q JOIN k USING (dataset)""")
def a20(spark, d):
    p = pairs(spark, d).withColumn("decision_id", F.struct("symbol", "ts")).join(F.broadcast(x.hourly_bars(spark, d).agg(F.min("ts").alias("t0"))))
    kinds = F.when(F.col("ts") % 10800 == 0, "synthetic").when(F.col("ts") % 10800 == 3600, "live").otherwise("recorded_real")
    model = F.when((F.col("symbol") == "view") & (F.col("ts") > F.col("t0") + 90000), "other").otherwise("momentum")
    dec = p.select(F.col("symbol").alias("dataset"), F.col("ts").alias("as_of"), F.col("ts").alias("seq"), "decision_id", kinds.alias("provenance"), model.alias("model"), F.col("pred").alias("predicted"), F.create_map(F.lit("momentum"), F.col("pred")).alias("features"))
    out = p.select("decision_id", F.col("target").alias("realized"))
    first = p.withColumn("k", F.row_number().over(f.by_symbol())).where("k <= 150")
    ref = first.select(F.col("symbol").alias("dataset"), F.lit("momentum").alias("feature"), F.col("pred").alias("value"))
    return rounded(metrics.monitor(dec, out, ref, identity={"model": "momentum"}))


def _conf(score: str) -> str:
    return f"""{_PT}, sp AS (SELECT *, abs(target - pred) AS residual, 0.01 + abs(pred) * 2 AS sigma FROM pt), sc AS (SELECT *, {score} AS score FROM sp),
n AS (SELECT symbol, count(*) AS n, avg(residual) AS mean_residual, median(residual) AS median_residual, list_sort(list(score)) AS l FROM sc GROUP BY 1 HAVING count(*) >= 10),
q AS (SELECT symbol, n, mean_residual, median_residual, l[CAST(ceil(least(1.0, ceil((n + 1) * 0.9::DOUBLE) / n) * (n - 1)) AS BIGINT) + 1] AS q FROM n)"""


_ADAPT = "residual / greatest(sigma, 1e-6)"


@register("a21_conformal", f"WITH {_conf('residual')} SELECT symbol, {rnd('q mean_residual median_residual')}, n FROM q")
def a21(spark, d):
    return rounded(metrics.conformal(pairs(spark, d), 0.1))


def spread(spark, d):
    return pairs(spark, d).withColumn("sigma", 0.01 + F.abs("pred") * 2)


@register("a21_adaptive", f"WITH {_conf(_ADAPT)} SELECT symbol, {rnd('q mean_residual median_residual')}, n FROM q")
def a21b(spark, d):
    return rounded(metrics.conformal(spread(spark, d), 0.1, normalised=True))


def _int(score: str, half: str) -> str:
    return f"{_conf(score)}, i AS (SELECT sp.*, {half} AS half, pred - {half} AS lower, pred + {half} AS upper FROM sp JOIN q USING (symbol))"


_SURE = "round(least(greatest(abs(pred) / greatest(abs(pred) + half, 1e-8::DOUBLE) * CASE WHEN abs(pred) <= half THEN 0.5 ELSE 1.0 END, 0), 1), 5) AS confidence"


@register("a22_intervals", f"WITH {_int('residual', 'q')} SELECT symbol, ts, {rnd('lower upper')}, {_SURE} FROM i")
def a22(spark, d):
    p = pairs(spark, d)
    out = metrics.intervals(p, metrics.conformal(p, 0.1)).select("symbol", "ts", "lower", "upper", "confidence")
    return rounded(out.withColumn("confidence", F.round("confidence", 5)))


@register("a22_adaptive_intervals", f"WITH {_int(_ADAPT, 'q * sigma')} SELECT symbol, ts, {rnd('lower upper')}, {_SURE} FROM i")
def a22b(spark, d):
    p = spread(spark, d)
    out = metrics.intervals(p, metrics.conformal(p, 0.1, normalised=True), normalised=True).select("symbol", "ts", "lower", "upper", "confidence")
    return rounded(out.withColumn("confidence", F.round("confidence", 5)))


@register("a22_coverage", f"""WITH {_int(_ADAPT, 'q * sigma')}, s AS (SELECT symbol, sum(CASE WHEN target >= lower AND target <= upper THEN 1 ELSE 0 END) / count(*)::DOUBLE AS c, avg(upper - lower) AS w, median(upper - lower) AS m FROM i GROUP BY 1)
SELECT symbol, round(c, 6) AS coverage, round(c - 0.9::DOUBLE, 6) AS coverage_error, round(w, 6) AS mean_width, round(m, 6) AS median_width FROM s""")
def a22c(spark, d):
    p = spread(spark, d)
    return rounded(metrics.coverage(metrics.intervals(p, metrics.conformal(p, 0.1, normalised=True), normalised=True)))


def _weights() -> str:
    """(d, k, w): the weights of each d = 0, 0.1 ... 1."""
    grid, d = [], 0.0
    while d <= 1.0:
        grid.append(d)
        d += 0.1
    return ", ".join(f"({d!r}::DOUBLE, {k}, {w!r}::DOUBLE)" for d in dict.fromkeys([*grid, 1.0]) for k, w in enumerate(fracdiff_taps(d, 1e-3, 500)))


@register("a23_minimum_d", f"""WITH {BARS}, i AS (SELECT symbol, close, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), tw AS (SELECT * FROM (VALUES {_weights()}) t(d, k, w)), tn AS (SELECT d, count(*) AS size FROM tw GROUP BY 1),
z AS (SELECT a.symbol, a.i, tw.d, least(any_value(size), any_value(a.n)) AS win, sum(tw.w * b.close) AS v FROM i a JOIN i b ON a.symbol = b.symbol AND b.i <= a.i JOIN tw ON tw.k = a.i - b.i JOIN tn ON tn.d = tw.d WHERE tw.k < least(size, a.n) GROUP BY 1, 2, 3 HAVING a.i >= least(any_value(size), any_value(a.n))),
h AS (SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY i) AS k, count(*) OVER (PARTITION BY symbol, d) AS m FROM z),
s AS (SELECT symbol, d, any_value(win) AS win, max(m) AS m, var_samp(v) FILTER (WHERE k <= m // 2) AS a, var_samp(v) FILTER (WHERE k > m // 2) AS b, avg(v) AS mean, stddev_samp(v) AS std FROM h GROUP BY 1, 2),
ok AS (SELECT symbol, min(d) AS d, arg_min(win, d) AS win FROM s WHERE m >= 20 AND a > 1e-12 AND b > 1e-12 AND greatest(a / b, b / a) < 2 AND std > 1e-12 AND abs(mean / std) < 2 GROUP BY 1)
SELECT DISTINCT bars.symbol, coalesce(d, 1.0) AS minimum_d, CAST(coalesce(win, 2) AS BIGINT) AS "window" FROM bars LEFT JOIN ok USING (symbol)""")
def a23(spark, d):
    out = metrics.minimum_d(x.hourly_bars(spark, d))
    return out.select("symbol", "minimum_d", F.col("window").cast("long").alias("window"))


@register("a24_reference_rate", """WITH r AS (SELECT o_orderpriority AS pair, CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 4) AS rate FROM orders GROUP BY 1, 2), m AS (SELECT max(day) + 3 AS today FROM r),
k AS (SELECT *, row_number() OVER w AS k, lead(rate) OVER w AS before FROM r WINDOW w AS (PARTITION BY pair ORDER BY day DESC))
SELECT pair, max(rate) FILTER (WHERE k = 1) AS last, round((max(rate) FILTER (WHERE k = 1) / max(before) FILTER (WHERE k = 1) - 1) * 100, 6) AS change_pct, min(rate) FILTER (WHERE k <= 30) AS low, max(rate) FILTER (WHERE k <= 30) AS high,
  round(avg(rate) FILTER (WHERE k <= 30), 4) AS mean, count(*) AS n, any_value(today) - max(day) > 7 AS stale FROM k, m GROUP BY 1""")
def a24(spark, d):
    o = x.table(spark, d, "orders")
    r = o.groupBy(F.col("o_orderpriority").alias("pair"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 4).alias("rate"))
    r = r.join(F.broadcast(r.agg(F.max("day").alias("newest"))))
    out = metrics.reference_rate(r, F.date_add("newest", 3))
    return out.withColumns({"change_pct": F.round("change_pct", 6), "mean": F.round("mean", 4)})


@register("a25_verdict", f"""WITH {_R}, dd AS (SELECT symbol, ts, nav, greatest(max(nav) OVER ({W} ROWS UNBOUNDED PRECEDING), 1000.0) AS peak FROM nav), m AS (SELECT symbol, max((peak - nav) / peak) AS mdd, arg_max(nav, ts) AS final FROM dd GROUP BY 1),
s AS (SELECT symbol, avg(ret) / stddev_samp(ret) * {SQ} AS sharpe FROM ret GROUP BY 1) SELECT symbol, CASE WHEN sharpe > 0.5 AND mdd < 0.35 AND final > 1000 THEN 'pass' ELSE 'fail' END AS verdict FROM m JOIN s USING (symbol)""")
def a25(spark, d):
    return metrics.verdict(metrics.performance(nav_curve(spark, d), 1000.0, P)).select("symbol", "verdict")


_AC = f"""{PREDICTIONS}, ac AS (SELECT p.symbol, as_of, value, n.open AS o, n.close AS c FROM predictions p JOIN (SELECT symbol, ts AS as_of, lead(ts) OVER ({W}) AS nxt FROM bars) l USING (symbol, as_of) JOIN bars n ON n.symbol = p.symbol AND n.ts = nxt),
cost AS (SELECT symbol, as_of AS ts, CASE WHEN value > 0 THEN c / o * (1 - 0.0012::DOUBLE) / (1 + 0.0012::DOUBLE) - 1 ELSE 0 END AS ret, CASE WHEN value > 0 THEN 1 + c / o ELSE 0 END AS turnover FROM ac)"""


def costed(spark, d):
    bars = x.hourly_bars(spark, d)
    t = f.targets(bars).select("symbol", "ts", "target_ts")
    p = predictions(spark, d).select("symbol", F.col("as_of").alias("ts"), F.col("value").alias("pred")).join(t, ["symbol", "ts"])
    return metrics.after_cost(joins.next_prices(p, bars), 12.0)


@register("a26_after_cost", f"WITH {_AC} SELECT symbol, ts, {rnd('ret turnover')} FROM cost")
def a26(spark, d):
    return rounded(costed(spark, d).select("symbol", "ts", "ret", "turnover"))


@register("a27_equal_weight", f"WITH {_AC}, k AS (SELECT ts FROM cost GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM cost)) SELECT ts, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('ret', 'turnover'))}, count(*) AS n FROM cost JOIN k USING (ts) GROUP BY 1")
def a27(spark, d):
    return rounded(metrics.equal_weight(joins.complete_dates(costed(spark, d))))


@register("a12_study_summary")
def a12(spark, d):
    from ..operators.bootstrap import study_summary

    rows = costed(spark, d).select("symbol", "ts", "ret", "turnover").join(pairs(spark, d), ["symbol", "ts"])
    return rounded(study_summary(rows.withColumn("ret", F.greatest("ret", F.lit(-0.9))), P, 2000))
