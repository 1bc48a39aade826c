"""Indicators, targets, cross-sections and curves over the derived bars."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.taps import ema_taps, fracdiff_taps, macd_taps, wilder_taps
from ..operators import features as f
from ..sources import fixtures as x
from .base import BARS, MONTHLY, PREDICTIONS, register, rnd, rounded

N = f.WINDOW
AF = repr(math.sqrt(f.HOURS_A_YEAR))
W = "PARTITION BY symbol ORDER BY ts"


def _list(t: list[float]) -> str:
    return "[" + ", ".join(repr(v) for v in t) + "]::DOUBLE[]"


def _frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _simple(name: str, make, select: str, source: str = "bars") -> None:
    """A query of hourly bars with one computed column, null rows kept."""

    @register(name, f"WITH {BARS}, c AS (SELECT *, {N} AS n FROM {source}) SELECT symbol, ts, round({select}, 6) AS value FROM c")
    def q(spark, d):
        return rounded(x.hourly_bars(spark, d).select("symbol", "ts", make().alias("value")))


def _full(n: int, value: str, of: str = "close") -> str:
    return f"CASE WHEN count({of}) OVER {_frame(n)} = {n} THEN {value} END"


def _window_dot(taps: list[float], n: int = N) -> str:
    return f"CASE WHEN count(*) OVER {_frame(n)} = {n} THEN list_inner_product(list(close) OVER {_frame(n)}, {_list(taps)}) END"


_simple("w1_sma", lambda: f.sma(20), _full(20, f"avg(close) OVER {_frame(20)}"))
_simple("w2_ema", lambda: f.ema(12), _window_dot(ema_taps(12, N)))
_simple("w3_macd_line", lambda: f.macd()[0], _window_dot(macd_taps(N)[0]))
_simple("w6_true_range", f.true_range, f"""CASE WHEN lag(close) OVER ({W}) IS NOT NULL THEN
  greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) END""")
_simple("w9_log_return", lambda: f.log_return(3), f"ln(close / lag(close, 3) OVER ({W}))")
_simple("w11_parkinson", lambda: f.parkinson(20, f.HOURS_A_YEAR), _full(20, f"sqrt(sum(ln(high / low) ** 2) OVER {_frame(20)} / (4.0 * ln(2.0::DOUBLE) * 20)) * {AF}"))
_simple("w12_garman_klass", lambda: f.garman_klass(20, f.HOURS_A_YEAR), _full(20, f"sqrt(greatest(avg(0.5 * ln(high / low) ** 2 - (2.0 * ln(2.0::DOUBLE) - 1.0) * ln(close / open) ** 2) OVER {_frame(20)}, 0.0)) * {AF}"))
_simple("w14_rolling_sum", lambda: f.rolling_sum(10, "volume"), _full(10, f"sum(volume) OVER {_frame(10)}", "volume"))
_FD = fracdiff_taps(0.4, 1e-3, 60)
_simple("w13_fracdiff", lambda: f.fracdiff(0.4, 1e-3, 60), f"CASE WHEN count(*) OVER {_frame(len(_FD))} = {len(_FD)} THEN list_inner_product(list(ln(close)) OVER {_frame(len(_FD))}, {_list(_FD[::-1])}) END")
_simple("w13_fracdiff_raw", lambda: f.fracdiff(1.0, log=False), f"CASE WHEN count(*) OVER {_frame(2)} = 2 THEN list_inner_product(list(close) OVER {_frame(2)}, {_list([-1.0, 1.0])}) END")
_simple("w14_rolling_mean", lambda: f.rolling_mean(10, "volume"), _full(10, f"avg(volume) OVER {_frame(10)}", "volume"))


@register("w4_macd", f"""WITH {BARS}, c AS (SELECT symbol, ts, list(close) OVER {_frame(N)} AS l FROM bars)
SELECT symbol, ts, round(list_inner_product(l, {_list(macd_taps(N)[0])}), 6) AS line, round(list_inner_product(l, {_list(macd_taps(N)[1])}), 6) AS signal,
  round(list_inner_product(l, {_list(macd_taps(N)[2])}), 6) AS histogram FROM c WHERE len(l) = {N}""")
def w4(spark, d):
    line, signal, hist = f.macd()
    out = x.hourly_bars(spark, d).select("symbol", "ts", line.alias("line"), signal.alias("signal"), hist.alias("histogram"))
    return rounded(out.where("line is not null"))


_RSI = f"""steps AS (SELECT *, close - lag(close) OVER ({W}) AS step FROM bars),
moves AS (SELECT *, list(greatest(step, 0.0)) OVER {_frame(N - 1)} AS gains, list(greatest(-step, 0.0)) OVER {_frame(N - 1)} AS losses, row_number() OVER ({W}) AS k FROM steps),
gl AS (SELECT symbol, ts, list_inner_product(gains, {_list(wilder_taps(14, N - 1))}) AS g, list_inner_product(losses, {_list(wilder_taps(14, N - 1))}) AS l FROM moves WHERE k >= {N}),
rsi AS (SELECT symbol, ts, CASE WHEN g = 0 AND l = 0 THEN 50.0 WHEN l = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + g / l) END AS rsi_14 FROM gl)"""


@register("w5_rsi", f"WITH {BARS}, {_RSI} SELECT symbol, ts, round(rsi_14, 6) AS rsi FROM rsi")
def w5(spark, d):
    return rounded(x.hourly_bars(spark, d).select("symbol", "ts", f.rsi(14).alias("rsi")).where("rsi is not null"))


_ATR = f"""tr AS (SELECT *, CASE WHEN lag(close) OVER ({W}) IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) END AS tr,
  row_number() OVER ({W}) AS k FROM bars),
atr AS (SELECT symbol, ts, list_inner_product(l, {_list(wilder_taps(14, N - 1))}) AS atr_14 FROM (SELECT *, list(coalesce(tr, 0.0)) OVER {_frame(N - 1)} AS l FROM tr) WHERE k >= {N})"""


@register("w7_atr", f"WITH {BARS}, {_ATR} SELECT symbol, ts, round(atr_14, 6) AS atr FROM atr")
def w7(spark, d):
    return rounded(f.atr(x.hourly_bars(spark, d), 14).select("symbol", "ts", "atr").where("atr is not null"))


@register("w8_bollinger", f"""WITH {BARS}, b AS (SELECT symbol, ts, close, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s, count(*) OVER w AS n FROM bars WINDOW w AS {_frame(20)})
SELECT symbol, ts, round(m, 6) AS middle, round(m + 2 * s, 6) AS upper, round(m - 2 * s, 6) AS lower, round(4 * s / m, 6) AS bandwidth,
  round(CASE WHEN 4 * s < 1e-10 THEN 0.5 ELSE (close - (m - 2 * s)) / (4 * s) END, 6) AS percent_b FROM b WHERE n = 20""")
def w8(spark, d):
    parts = f.bollinger(20, 2.0)
    out = x.hourly_bars(spark, d).select("symbol", "ts", *(c.alias(k) for k, c in parts.items()))
    return rounded(out.where("middle is not null"))


@register("w10_volatility", f"""WITH {BARS}, r AS (SELECT symbol, ts, ln(close / lag(close) OVER ({W})) AS r FROM bars)
SELECT symbol, ts, round({_full(20, f"stddev_samp(r) OVER {_frame(20)} * {AF}", "r")}, 6) AS volatility FROM r""")
def w10(spark, d):
    return rounded(f.rolling_volatility(x.hourly_bars(spark, d), 20, f.HOURS_A_YEAR).select("symbol", "ts", "volatility"))


@register("w15_full_ema", f"""WITH RECURSIVE {BARS}, i AS (SELECT symbol, ts, close, row_number() OVER ({W}) AS i, avg(close) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS m FROM bars),
e AS (SELECT symbol, ts, i, m AS ema FROM i WHERE i = 12 UNION ALL SELECT i.symbol, i.ts, i.i, e.ema + 2 / 13.0::DOUBLE * (i.close - e.ema) FROM e JOIN i ON i.symbol = e.symbol AND i.i = e.i + 1)
SELECT symbol, ts, round(ema, 6) AS ema FROM e""")
def w15(spark, d):
    return rounded(f.full_ema(x.hourly_bars(spark, d), 12))


_BASE = f"""{BARS}, {_RSI}, {_ATR}, ret AS (SELECT *, ln(close / lag(close) OVER ({W})) AS r FROM bars),
base AS (SELECT symbol, ts, avail_ts, close, avg(close) OVER w20 AS sma_20, list(close) OVER wn AS l, 4 * stddev_pop(close) OVER w20 / avg(close) OVER w20 AS bollinger_bw,
  stddev_samp(r) OVER w20 * {AF} AS volatility_20, r AS log_return_1 FROM ret WINDOW w20 AS {_frame(20)}, wn AS {_frame(N)}),
features AS (SELECT symbol, base.avail_ts AS ts, close, sma_20, list_inner_product(l, {_list(ema_taps(12, N))}) AS ema_12, rsi_14, list_inner_product(l, {_list(macd_taps(N)[2])}) AS macd_hist,
  bollinger_bw, atr_14, volatility_20, log_return_1 FROM base JOIN rsi USING (symbol, ts) JOIN atr USING (symbol, ts) WHERE len(l) = {N})"""
_TARGET = f"""targets AS (SELECT symbol, avail_ts AS ts, lead(avail_ts) OVER ({W}) AS target_ts, ln(lead(close) OVER ({W}) / close) AS target FROM bars)"""
_FEATURES = rnd(" ".join(f.BASELINE))


@register("w16_baseline", f"WITH {_BASE} SELECT symbol, ts, close, {_FEATURES} FROM features")
def w16(spark, d):
    return rounded(f.baseline(x.hourly_bars(spark, d)))


@register("w17_targets", f"""WITH {BARS}, {_TARGET} SELECT symbol, ts, target_ts, round(target, 6) AS target,
  CASE WHEN target > 0.001 THEN 1 WHEN target < -0.001 THEN -1 ELSE 0 END AS direction FROM targets WHERE target_ts IS NOT NULL""")
def w17(spark, d):
    return rounded(f.targets(x.hourly_bars(spark, d), 1, 0.001))


@register("w18_multi_targets", f"""WITH {BARS}, t AS (SELECT symbol, ts, ln(lead(close, 1) OVER w / close) AS h1, ln(lead(close, 5) OVER w / close) AS h5, ln(lead(close, 20) OVER w / close) AS h20
  FROM bars WINDOW w AS ({W})) SELECT symbol, ts, {rnd("h1 h5 h20")} FROM t WHERE h20 IS NOT NULL""")
def w18(spark, d):
    out = f.multi_targets(x.hourly_bars(spark, d))
    return rounded(out.select("symbol", "ts", *(F.get("targets", F.lit(i)).alias(f"h{h}") for i, h in enumerate((1, 5, 20)))))


@register("w19_sliding_windows", f"""WITH {BARS}, w AS (SELECT symbol, ts, list(close) OVER w AS c, list(volume) OVER w AS v FROM bars WINDOW w AS {_frame(8)})
SELECT symbol, ts, round(list_sum(c), 6) AS sum_close, CAST(list_sum(v) AS DOUBLE) AS sum_volume, c[1] AS first_close, len(c) AS length FROM w WHERE len(c) = 8""")
def w19(spark, d):
    bars = x.hourly_bars(spark, d).withColumn("v", F.col("volume").cast("double"))
    out = f.sliding(bars, ["close", "v"], 8)
    total = lambda i: F.aggregate("window", F.lit(0.0), lambda a, r: a + r[i])
    return rounded(out.select("symbol", "ts", total(0).alias("sum_close"), total(1).alias("sum_volume"), F.col("window")[0][0].alias("first_close"), F.size("window").cast("long").alias("length")))


@register("w20_momentum", f"""WITH {BARS}, r AS (SELECT symbol, ts, ln(close / lag(close) OVER ({W})) AS r FROM bars)
SELECT symbol, ts, round({_full(20, f"avg(r) OVER {_frame(20)}", "r")}, 6) AS momentum FROM r""")
def w20(spark, d):
    return rounded(f.momentum(x.hourly_bars(spark, d), 20).select("symbol", "ts", "momentum"))


_XS = f"""{MONTHLY}, v AS (SELECT symbol, ts, volume::DOUBLE AS value FROM monthly),
xs AS (SELECT symbol, ts, value, avg(value) OVER (PARTITION BY ts) AS mean, stddev_samp(value) OVER (PARTITION BY ts) AS std, count(*) OVER (PARTITION BY ts) AS universe FROM v),
z AS (SELECT *, CASE WHEN std <= 1e-12 THEN 0.0 ELSE (value - mean) / std END AS z FROM xs WHERE universe >= 2)"""


def _values(spark, d):
    return x.monthly_bars(spark, d).select("symbol", "ts", F.col("volume").cast("double").alias("value"))


@register("w21_cross_section", f"WITH {_XS} SELECT symbol, ts, {rnd('value mean std z')}, universe FROM z")
def w21(spark, d):
    return rounded(f.cross_section(_values(spark, d)))


@register("w21_cross_section_many", f"""WITH {MONTHLY}, v AS (UNPIVOT (SELECT symbol, ts, open, close, volume::DOUBLE AS volume FROM monthly) ON open, close, volume INTO NAME feature VALUE value),
xs AS (SELECT symbol, ts, feature, value, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS std, count(*) OVER w AS universe FROM v WINDOW w AS (PARTITION BY ts, feature))
SELECT symbol, ts, feature, CASE WHEN std <= 1e-12 THEN 0.0::DOUBLE ELSE round((value - mean) / std, 6) END AS z FROM xs WHERE universe >= 2""")
def w21_many(spark, d):
    rows = x.monthly_bars(spark, d).select("symbol", "ts", "open", "close", F.col("volume").cast("double").alias("volume"))
    rows = f.melt(rows, ["symbol", "ts"], ["open", "close", "volume"]).withColumn("ts", F.struct("ts", "feature"))
    out = f.cross_section(rows)
    return rounded(out.select("symbol", "ts.ts", "feature", "z"))


@register("w22_winsorized", f"WITH {_XS} SELECT symbol, ts, round(least(greatest(z, -1.5), 1.5), 6) AS z FROM z")
def w22(spark, d):
    return rounded(f.cross_section(_values(spark, d), clamp=1.5).select("symbol", "ts", "z"))


_PPF = """(CASE WHEN abs(p - 0.5) < 0.42 THEN (p - 0.5) * (((-25.44106049637 * r + 41.39119773534) * r - 18.61500062529) * r + 2.50662823884)
  / ((((3.13082909833 * r - 21.06224101826) * r + 23.08336743743) * r - 8.47351093090) * r + 1.0)
  ELSE sign(p - 0.5) * (t - ((0.010328 * t + 0.802853) * t + 2.515517) / (((0.001308 * t + 0.189269) * t + 1.432788) * t + 1.0)) END)"""


@register("w23_rank_normal", f"""WITH {MONTHLY}, v AS (SELECT symbol, ts, volume::DOUBLE AS value FROM monthly),
k AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY value) + (count(*) OVER (PARTITION BY ts, value) - 1) / 2.0::DOUBLE AS avg_rank, count(*) OVER (PARTITION BY ts) AS universe FROM v),
p AS (SELECT *, avg_rank / (universe + 1.0::DOUBLE) AS p FROM k WHERE universe >= 2),
q AS (SELECT *, (p - 0.5) * (p - 0.5) AS r, sqrt(-2.0 * ln(least(p, 1.0 - p))) AS t FROM p)
SELECT symbol, ts, value, avg_rank, universe, round({_PPF}, 6) AS z FROM q""")
def w23(spark, d):
    return rounded(f.rank_normal(_values(spark, d)))


@register("w24_top_bottom", f"""WITH {PREDICTIONS}, s AS (SELECT symbol, as_of, round(value, 2) AS expected_return, 0.5::DOUBLE AS confidence, -ascii(symbol) * 1000 - length(symbol) AS seq FROM predictions),
k AS (SELECT *, (SELECT count(*) FROM s o WHERE o.as_of = s.as_of AND (o.expected_return > s.expected_return OR o.expected_return = s.expected_return AND o.seq < s.seq)) AS k, (SELECT count(*) FROM s o WHERE o.as_of = s.as_of) AS n FROM s),
t AS (SELECT *, CASE WHEN k < least(2, n) AND expected_return > 0 THEN 1 WHEN k >= greatest(n - 2, 0) AND expected_return < 0 THEN -1 ELSE 0 END AS direction FROM k)
SELECT symbol, as_of, direction, CASE WHEN direction = 0 THEN 0.0::DOUBLE ELSE expected_return END AS expected_return, CASE WHEN direction = 0 THEN 0.0::DOUBLE ELSE confidence END AS confidence FROM t""")
def w24(spark, d):
    seq = -F.ascii("symbol") * 1000 - F.length("symbol")
    rows = predictions(spark, d).select("symbol", "as_of", F.round("value", 2).alias("expected_return"), F.lit(0.5).alias("confidence"), seq.alias("seq"))
    return rounded(f.top_bottom(rows, 2, 2).drop("seq"))


def predictions(spark, d):
    """Mean of the last five log returns as a model's predictions."""
    bars = x.hourly_bars(spark, d)
    out = f.momentum(bars, 5).select("symbol", F.col("ts").alias("as_of"), "close", F.round("momentum", 9).alias("value"))
    return out.where("value is not null")


_NAV = f"""{BARS}, nav AS (SELECT symbol, ts, close, 1000.0::DOUBLE * close / first_value(close) OVER ({W}) AS nav FROM bars)"""


def nav_curve(spark, d):
    return f.buy_and_hold(x.hourly_bars(spark, d), 1000.0).select("symbol", "ts", F.col("benchmark_nav").alias("nav"))


@register("w25_drawdown", f"""WITH {_NAV}, p AS (SELECT *, greatest(max(nav) OVER ({W} ROWS UNBOUNDED PRECEDING), 1000.0) AS peak FROM nav)
SELECT symbol, ts, {rnd("nav peak", 4)}, round((peak - nav) / peak, 6) AS drawdown FROM p""")
def w25(spark, d):
    out = f.drawdown(nav_curve(spark, d), F.lit(1000.0))
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("nav", "peak")}))


@register("w26_equity", f"""WITH {BARS}, r AS (SELECT symbol, ts, greatest(least(ln(close / lag(close) OVER ({W})), 0.05), -0.05) AS ret FROM bars)
SELECT symbol, ts, round(ret, 6) AS ret, round(exp(sum(ln(1 + ret)) OVER ({W} ROWS UNBOUNDED PRECEDING)), 4) AS equity FROM r WHERE ret IS NOT NULL""")
def w26(spark, d):
    ret = F.greatest(F.least(f.log_return(), F.lit(0.05)), F.lit(-0.05))
    rows = x.hourly_bars(spark, d).select("symbol", "ts", ret.alias("ret")).where("ret is not null")
    out = f.equity(rows)
    return out.select("symbol", "ts", F.round("ret", 6).alias("ret"), F.round("equity", 4).alias("equity"))


@register("w27_buy_and_hold", f"""WITH {_NAV} SELECT symbol, ts, round(nav, 4) AS benchmark_nav, round(coalesce(close / lag(close) OVER ({W}) - 1.0, 0.0), 6) AS benchmark_return FROM nav""")
def w27(spark, d):
    out = f.buy_and_hold(x.hourly_bars(spark, d), 1000.0)
    return out.select("symbol", "ts", F.round("benchmark_nav", 4).alias("benchmark_nav"), F.round("benchmark_return", 6).alias("benchmark_return"))


@register("w28_curve_returns", f"""WITH {_NAV}, b AS (SELECT *, lag(nav) OVER ({W}) AS before FROM nav)
SELECT symbol, ts, round(nav, 4) AS nav, round(CASE WHEN before > 1e-8 THEN (nav - before) / before ELSE 0.0 END, 6) AS ret FROM b WHERE before IS NOT NULL""")
def w28(spark, d):
    out = f.curve_returns(nav_curve(spark, d))
    return out.select("symbol", "ts", F.round("nav", 4).alias("nav"), F.round("ret", 6).alias("ret"))


@register("j1_training_rows", f"""WITH {_BASE}, {_TARGET} SELECT symbol, f.ts, close, {_FEATURES}, target_ts, round(target, 6) AS target,
  CASE WHEN target > 0 THEN 1 WHEN target < 0 THEN -1 ELSE 0 END AS direction FROM features f JOIN targets t USING (symbol, ts) WHERE target_ts IS NOT NULL""")
def j1(spark, d):
    from ..operators.joins import label

    bars = x.hourly_bars(spark, d)
    return rounded(label(f.baseline(bars), f.targets(bars)))
