"""Signals, weights, costs, ledgers and bootstrap over the derived series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import bootstrap as bs
from ..operators import features as f
from ..operators import portfolio as p
from ..sources import fixtures as x
from .base import BARS, FILLS, MONTHLY, OFF, ORDERS, PREDICTIONS, register, rnd, rounded
from .feature_queries import W, predictions

_SIG = f"""{PREDICTIONS}, sig AS (SELECT symbol, as_of, value AS expected_return, CASE WHEN value > 0.01 THEN 1 WHEN value < -0.01 THEN -1 ELSE 0 END AS direction,
  CASE WHEN value BETWEEN -0.01 AND 0.01 THEN 0.0 ELSE least(greatest(tanh(abs(value) / 0.05), 0.0), 1.0) END AS confidence FROM predictions)"""


def signals(spark, d):
    rows = predictions(spark, d).drop("close").withColumn("confidence", F.lit(None).cast("double"))
    return p.calibrate(rows, 0.01, 0.05)


@register("sg1_calibrated", f"WITH {_SIG} SELECT symbol, as_of, direction, {rnd('expected_return confidence')}, 1 AS horizon FROM sig")
def sg1(spark, d):
    return rounded(signals(spark, d))


_TH = "CASE WHEN abs(expected_return) < 0.03 OR confidence < 0.6 THEN 0 ELSE {} END"


@register("sg2_threshold", f"WITH {_SIG} SELECT symbol, as_of, {_TH.format('direction')} AS direction, round({_TH.format('expected_return')}, 6) AS expected_return, round({_TH.format('confidence')}, 6) AS confidence FROM sig")
def sg2(spark, d):
    return rounded(p.threshold(signals(spark, d), 0.03, 0.6).drop("horizon"))


@register("sg3_confidence_weighted", f"WITH {_SIG} SELECT symbol, as_of, round(expected_return * pow(confidence, 1.5), 6) + 0.0 AS expected_return FROM sig")
def sg3(spark, d):
    return rounded(p.weight_by_confidence(signals(spark, d), 1.5).select("symbol", "as_of", "expected_return"))


@register("sg4_chain", f"WITH {_SIG} SELECT symbol, as_of, round({_TH.format('expected_return * confidence')}, 6) AS expected_return FROM sig")
def sg4(spark, d):
    out = p.chain(signals(spark, d), lambda s: p.threshold(s, 0.03, 0.6), lambda s: p.weight_by_confidence(s, 1.0))
    return rounded(out.select("symbol", "as_of", "expected_return"))


@register("sg5_price_projection", f"WITH {PREDICTIONS} SELECT symbol, as_of, round(exp(value) - 1, 6) AS predicted_return, round(close * exp(value), 5) AS implied_close FROM predictions")
def sg5(spark, d):
    out = p.project_price(predictions(spark, d))
    return out.select("symbol", "as_of", F.round("predicted_return", 6).alias("predicted_return"), F.round("implied_close", 5).alias("implied_close"))


_MS = f"""{MONTHLY}, ms AS (SELECT symbol, sector, ts AS as_of, close AS price, CASE WHEN volume % 3 = 0 THEN 0 WHEN volume % 3 = 1 THEN 1 ELSE -1 END AS direction, (volume % 10) / 10.0::DOUBLE AS confidence,
  (volume % 7) / 100.0::DOUBLE AS expected_return, CASE WHEN ts % 5 = 0 THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END AS drawdown, 1e6::DOUBLE AS nav FROM monthly)"""


def month_signals(spark, d):
    v, ts = F.col("volume"), F.col("ts")
    direction = F.when(v % 3 == 0, 0).when(v % 3 == 1, 1).otherwise(-1)
    return x.monthly_bars(spark, d).select("symbol", "sector", ts.alias("as_of"), F.col("close").alias("price"), direction.alias("direction"), ((v % 10) / 10.0).alias("confidence"), ((v % 7) / 100.0).alias("expected_return"),
                                           F.when(ts % 5 == 0, 0.2).otherwise(0.05).alias("drawdown"), F.lit(1e6).alias("nav"))


_DR = "CASE WHEN drawdown > 0.1 THEN 0.5 ELSE 1.0 END"
_PW1 = f"{_MS}, pw1 AS (SELECT *, least(greatest(direction * confidence * 0.75, -0.2), 0.2) * {_DR} AS weight FROM ms)"
LS = p.Limits(mode="long_short")


@register("pw1_volatility_weights", f"WITH {_MS} SELECT symbol, as_of, round(least(greatest(greatest(direction, 0) * confidence * 0.75, -0.2), 0.2) * {_DR}, 6) + 0.0 AS weight FROM ms")
def pw1(spark, d):
    return rounded(p.volatility_weights(month_signals(spark, d), p.Limits()).select("symbol", "as_of", "weight"))


@register("pw2_kelly_weights", f"WITH {_MS} SELECT symbol, as_of, round(least(greatest(direction * (0.5 * (greatest(abs(expected_return) - 0.04 / 252.0::DOUBLE, 0) / (0.04 / 252.0::DOUBLE)) * confidence), -0.2), 0.2) * {_DR}, 6) + 0.0 AS weight FROM ms")
def pw2(spark, d):
    return rounded(p.kelly_weights(month_signals(spark, d), LS).select("symbol", "as_of", "weight"))


@register("pw3_dollar_neutral", f"WITH {_PW1}, a AS (SELECT *, sum(weight) OVER (PARTITION BY as_of) / nullif(count(*) FILTER (WHERE abs(weight) > 1e-8) OVER (PARTITION BY as_of), 0) AS m FROM pw1) SELECT symbol, as_of, round(CASE WHEN abs(weight) > 1e-8 THEN weight - m ELSE weight END, 6) AS weight FROM a")
def pw3(spark, d):
    rows = p.volatility_weights(month_signals(spark, d), LS)
    return rounded(p.dollar_neutral(rows).select("symbol", "as_of", "weight"))


_PW4 = f"""{_PW1}, g AS (SELECT *, sum(abs(weight)) OVER (PARTITION BY as_of) AS g, abs(sum(weight) OVER (PARTITION BY as_of)) AS n FROM pw1),
s AS (SELECT *, CASE WHEN g > 1 THEN 1 / g ELSE 1.0 END AS s0 FROM g), pw4 AS (SELECT *, weight * least(s0, CASE WHEN n * s0 > 0.5 THEN 0.5 / n ELSE s0 END) AS w FROM s)"""


def scaled(spark, d):
    return p.scale_exposure(p.volatility_weights(month_signals(spark, d), LS), 1.0, 0.5)


@register("pw4_scaled_exposure", f"WITH {_PW4} SELECT symbol, as_of, round(w, 6) AS weight FROM pw4")
def pw4(spark, d):
    return rounded(scaled(spark, d).select("symbol", "as_of", "weight"))


@register("pw5_targets", f"WITH {_PW4} SELECT symbol, as_of, round(w * nav, 4) + 0.0 AS target_value, round(w * nav / greatest(price, 1e-4)) + 0.0 AS target_quantity FROM pw4")
def pw5(spark, d):
    out = p.to_targets(scaled(spark, d))
    return out.select("symbol", "as_of", (F.round("target_value", 4) + 0.0).alias("target_value"), (F.col("target_quantity") + 0.0).alias("target_quantity"))


@register("pw6_sector_neutral", f"WITH {_PW1} SELECT symbol, as_of, round(CASE WHEN count(*) OVER w = 1 THEN 0 ELSE weight - avg(weight) OVER w END, 6) AS weight FROM pw1 WINDOW w AS (PARTITION BY as_of, sector)")
def pw6(spark, d):
    return rounded(p.sector_neutral(p.volatility_weights(month_signals(spark, d), LS)).select("symbol", "as_of", "weight"))


@register("pw7_l1_ball", f"""WITH {_PW1}, a AS (SELECT *, abs(weight) AS a, sum(abs(weight)) OVER (PARTITION BY as_of) AS t, row_number() OVER w AS k, sum(abs(weight)) OVER (PARTITION BY as_of ORDER BY abs(weight) DESC, symbol ROWS UNBOUNDED PRECEDING) AS c FROM pw1 WINDOW w AS (PARTITION BY as_of ORDER BY abs(weight) DESC, symbol)),
h AS (SELECT as_of, arg_max((c - 1.0) / k, k) AS theta FROM a WHERE a - (c - 1.0) / k > 0 GROUP BY 1)
SELECT symbol, as_of, round(CASE WHEN t <= 1.0 THEN weight ELSE CASE WHEN weight >= 0 THEN 1 ELSE -1 END * greatest(a - theta, 0) END, 6) + 0.0 AS weight FROM a LEFT JOIN h USING (as_of)""")
def pw7(spark, d):
    return rounded(p.l1_ball(p.volatility_weights(month_signals(spark, d), LS), 1.0).select("symbol", "as_of", "weight"))


_RL = "lim AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {', '.join(f'{v}::DOUBLE' for v in vs)})" for k, vs in p.REGIME_LIMITS.items()) + ") t(regime, max_gross, max_net, max_single, sizing, max_dd))"
_REG = "CASE volume % 6 WHEN 0 THEN 'Bull' WHEN 1 THEN 'Bear' WHEN 2 THEN 'Crisis' WHEN 3 THEN 'HighVol' WHEN 4 THEN 'LowVol' ELSE 'Trending' END"


def regime_rows(spark, d):
    v = F.col("volume")
    rows = x.monthly_bars(spark, d).withColumn("regime", F.expr(_REG))
    return rows.select("symbol", "ts", "regime", ((v % 16) / 10.0).alias("gross_exposure"), ((v % 13) / 10.0 - 0.6).alias("net_exposure"), ((v % 25) / 100.0).alias("drawdown"), (v * 100.0 - 1500.0).alias("desired"), F.col("close").alias("price"), F.lit(1e8).alias("nav"))


@register("pw8_compliance", f"""WITH {MONTHLY}, {_RL}, b AS (SELECT symbol, ts, {_REG} AS regime, (volume % 16) / 10.0::DOUBLE AS g, (volume % 13) / 10.0::DOUBLE - 0.6 AS n, (volume % 25) / 100.0::DOUBLE AS dd FROM monthly),
v AS (SELECT symbol, ts, regime, concat_ws(',', CASE WHEN g > max_gross + 1e-4 THEN 'gross' END, CASE WHEN abs(n) > max_net + 1e-4 THEN 'net' END, CASE WHEN dd > max_dd + 1e-4 THEN 'drawdown' END) AS breaches FROM b JOIN lim USING (regime))
SELECT *, breaches = '' AS compliant FROM v""")
def pw8(spark, d):
    return p.compliance(regime_rows(spark, d)).select("symbol", "ts", "regime", "breaches", "compliant")


@register("pw9_clamped_quantity", f"""WITH {MONTHLY}, {_RL}, b AS (SELECT symbol, ts, {_REG} AS regime, volume * 100.0::DOUBLE - 1500 AS q, close FROM monthly)
SELECT symbol, ts, round(CASE WHEN abs(q * sizing) < 1e-6 THEN 0 ELSE least(greatest(q * sizing, -1e8 * max_single / close), 1e8 * max_single / close) END, 6) AS allowed FROM b JOIN lim USING (regime)""")
def pw9(spark, d):
    return rounded(p.clamp_quantity(regime_rows(spark, d)).select("symbol", "ts", "allowed"))


_ELIG = f"""{ORDERS}, p AS (SELECT *, close * 0.99::DOUBLE AS limit_price, volume * CASE WHEN l_linenumber % 3 = 0 THEN 0.02 WHEN l_linenumber % 3 = 1 THEN 0.001 ELSE 0.05 END::DOUBLE AS most FROM corders),
o AS (SELECT *, least(greatest(quantity, -most), most) AS q0 FROM p),
e AS (SELECT *, CASE WHEN abs(quantity) < 1e-8 OR abs(q0) < 1e-8 OR (is_limit AND quantity > 0 AND low > limit_price) OR (is_limit AND quantity < 0 AND high < limit_price) THEN 0 ELSE q0 END AS q FROM o)"""
_FP = "CASE WHEN q = 0 THEN CASE WHEN is_limit THEN limit_price ELSE close END ELSE close + sign(q) * slip END"


def orders(spark, d):
    cap = F.when(F.col("l_linenumber") % 3 == 0, 0.02).when(F.col("l_linenumber") % 3 == 1, 0.0001)
    return x.cost_orders(spark, d).withColumns({"limit_price": F.col("close") * 0.99, "participation_cap": cap})


def cost_summary(rows, extra):
    out = rows.groupBy("symbol", "month").agg(F.count("*").alias("n"), F.count_if(F.col("fill_quantity") == 0).alias("unfilled"), F.round(F.sum("fill_quantity"), 4).alias("quantity"),
                                              F.round(F.sum(F.abs("fill_quantity") * F.col("slippage")), 2).alias("slippage_cost"), F.round(F.avg("fill_price"), 4).alias("mean_price"), *extra)
    return out


_SUM = "SELECT symbol, month, count(*) AS n, count(*) FILTER (WHERE q = 0) AS unfilled, round(sum(q), 4) AS quantity, round(sum(abs(q) * CASE WHEN q = 0 THEN 0 ELSE slip END), 2) AS slippage_cost, round(avg(" + _FP + "), 4) AS mean_price"


@register("tc1_linear_costs", f"WITH {_ELIG}, s AS (SELECT *, close * (2e-4::DOUBLE + 0.1 * (abs(q) / greatest(volume, 1))) AS slip FROM e) {_SUM}, round(sum(CASE WHEN q = 0 THEN 0 ELSE greatest(abs(q) * {_FP} * 5e-4::DOUBLE, 1) END), 2) AS commission FROM s GROUP BY 1, 2")
def tc1(spark, d):
    return cost_summary(p.linear_costs(orders(spark, d)), [F.round(F.sum("commission"), 2).alias("commission")])


_IMPACT = "s AS (SELECT *, close * (2e-4::DOUBLE + CASE WHEN high > low THEN greatest((high - low) / close, 0.02) ELSE 0.02 END * (0.314 * least(abs(q) / 1e6, 1) + 0.142 * sqrt(least(abs(q) / greatest(volume, 1), 1)))) AS slip FROM e)"
_TIER = "abs(q) * CASE WHEN is_limit THEN -0.0015 ELSE 0.0030 END::DOUBLE"


@register("tc2_impact_costs", f"WITH {_ELIG}, {_IMPACT} {_SUM}, round(sum(CASE WHEN q = 0 THEN 0 WHEN is_limit THEN {_TIER} ELSE greatest({_TIER}, 0.5) END) + 1.234567e-9::DOUBLE, 6) AS commission FROM s GROUP BY 1, 2")
def tc2(spark, d):
    return cost_summary(p.impact_costs(orders(spark, d)), [F.round(F.sum("commission") + OFF, 6).alias("commission")])


@register("tc2_impact_fills", f"WITH {_ELIG}, {_IMPACT} SELECT l_orderkey, l_linenumber, round(q + 1.234567e-9::DOUBLE, 6) AS fill_quantity, round({_FP} + 1.234567e-9::DOUBLE, 6) AS fill_price, round(CASE WHEN q = 0 THEN 0 ELSE slip END + 1.234567e-9::DOUBLE, 6) AS slippage, round(1.234567e-9::DOUBLE + CASE WHEN q = 0 THEN 0 WHEN abs(q) * ({_FP}) > 0 THEN greatest(abs(q) * ({_FP}) * 3e-4::DOUBLE, 0.25) ELSE abs(q) * ({_FP}) * 3e-4::DOUBLE END, 5) AS commission FROM s")
def tc2b(spark, d):
    out = p.impact_costs(orders(spark, d), schedule=p.Schedule.flat(3.0, 0.25))
    off = lambda c, digits: (F.round(F.col(c) + OFF, digits) + 0.0).alias(c)
    return out.select("l_orderkey", "l_linenumber", *(off(c, 6) for c in ("fill_quantity", "fill_price", "slippage")), off("commission", 5))


@register("tc3_tiered_fees", f"""WITH {FILLS}, c AS (SELECT instrument, fill_seq, quantity * price * 100 AS quantity, price, fill_seq % 2 = 0 AS is_maker FROM fills),
r AS (SELECT *, coalesce(sum(abs(quantity)) OVER (PARTITION BY instrument ORDER BY fill_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM c),
t AS (SELECT * FROM (VALUES (0.0, 0.0030, -0.0015, 0.0), (20000.0, 0.0020, -0.0020, 0.5), (200000.0, 0.0010, -0.0025, 1.5)) t(low, taker, maker, bps)),
s AS (SELECT instrument, fill_seq, any_value(cum) AS cum, arg_max(abs(quantity) * CASE WHEN is_maker THEN maker ELSE taker END + abs(quantity) * price * bps * 1e-4, low)::DOUBLE AS raw FROM r JOIN t ON cum >= low GROUP BY 1, 2)
SELECT instrument, fill_seq, round(cum, 4) AS cumulative, round(CASE WHEN raw > 0 THEN greatest(raw, 0.5) ELSE raw END + 1.234567e-9::DOUBLE, 6) AS fee FROM s""")
def tc3(spark, d):
    rows = x.fills(spark, d).select("instrument", "fill_seq", (F.col("quantity") * F.col("price") * 100).alias("quantity"), "price", (F.col("fill_seq") % 2 == 0).alias("is_maker"))
    out = p.tiered_fees(rows, p.Schedule(((0.0, 0.0030, -0.0015, 0.0), (20_000.0, 0.0020, -0.0020, 0.5), (200_000.0, 0.0010, -0.0025, 1.5))))
    return out.select("instrument", "fill_seq", F.round("cumulative", 4).alias("cumulative"), (F.round(F.col("fee") + OFF, 6) + 0.0).alias("fee"))


@register("tc4_borrow_fee", "SELECT c_custkey, round(abs(c_acctbal) * (0.015 / 365.25::DOUBLE), 6) AS fee FROM customer WHERE c_acctbal < 0")
def tc4(spark, d):
    return rounded(x.table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey", p.borrow_fee(F.col("c_acctbal")).alias("fee")))


@register("lg1_cash_curve", f"""WITH {FILLS} SELECT fill_seq, round(1000 - sum(quantity * price + commission) OVER w, 6) AS cash, round(sum(commission) OVER w, 6) AS commissions, sum(quantity) OVER (PARTITION BY instrument ORDER BY fill_seq ROWS UNBOUNDED PRECEDING) AS position
FROM fills WINDOW w AS (ORDER BY fill_seq ROWS UNBOUNDED PRECEDING)""")
def lg1(spark, d):
    out = p.cash_curve(x.fills(spark, d), 1000.0)
    return out.select("fill_seq", F.round("cash", 6).alias("cash"), F.round("commissions", 6).alias("commissions"), "position")


_LED = f"""{FILLS}, o AS (SELECT run_id, instrument, fill_seq, quantity AS q, price AS p, commission AS c, row_number() OVER (PARTITION BY run_id, instrument ORDER BY fill_seq) AS i FROM fills),
led AS (SELECT run_id, instrument, fill_seq AS seq, i, q AS qty, p AS price, c AS fees, 0.0::DOUBLE AS realized, 0.0::DOUBLE AS closed, NULL::DOUBLE AS pnl, NULL::DOUBLE AS entry FROM o WHERE i = 1
  UNION ALL SELECT o.run_id, o.instrument, o.fill_seq, o.i, CASE WHEN adds OR abs(l.qty + o.q) >= 1e-8 THEN l.qty + o.q ELSE 0 END,
    CASE WHEN adds THEN (abs(l.qty) * l.price + abs(o.q) * o.p) / abs(l.qty + o.q) WHEN abs(l.qty + o.q) < 1e-8 THEN 0 WHEN sign(l.qty + o.q) = sign(l.qty) THEN l.price ELSE o.p END,
    CASE WHEN adds THEN l.fees + o.c WHEN abs(l.qty + o.q) < 1e-8 THEN 0 WHEN sign(l.qty + o.q) = sign(l.qty) THEN l.fees - l.fees * shut / abs(l.qty) ELSE o.c - o.c * shut / abs(o.q) END,
    CASE WHEN adds THEN l.realized ELSE l.realized + shut * sign(l.qty) * (o.p - l.price) END, CASE WHEN adds THEN 0 ELSE shut END,
    CASE WHEN NOT adds THEN shut * sign(l.qty) * (o.p - l.price) - l.fees * shut / abs(l.qty) - o.c * shut / abs(o.q) END, CASE WHEN NOT adds THEN l.price END
  FROM led l JOIN o ON o.run_id = l.run_id AND o.instrument = l.instrument AND o.i = l.i + 1, LATERAL (SELECT abs(l.qty) < 1e-8 OR sign(l.qty) = sign(o.q) AS adds, least(abs(l.qty), abs(o.q)) AS shut) z)"""


@register("lg2_ledger", f"WITH RECURSIVE {_LED} SELECT run_id, instrument, seq, {rnd('qty price fees realized closed pnl entry', 5, OFF)} FROM led")
def lg2(spark, d):
    return rounded(p.fold_fills(x.fills(spark, d)), 5, OFF)


@register("a2_trades", f"""WITH RECURSIVE {_LED}, t AS (SELECT run_id, count(*) AS closed_trades, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl < 0) AS losing, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS profits, coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0) AS losses,
  coalesce(avg(pnl / (closed * entry)) FILTER (WHERE pnl > 0), 0) AS avg_win, coalesce(avg(pnl / (closed * entry)) FILTER (WHERE pnl < 0), 0) AS avg_loss FROM led WHERE pnl IS NOT NULL GROUP BY 1),
f AS (SELECT run_id, count(*) AS total_trades, sum(abs(quantity * price)) / 1000 AS turnover FROM fills GROUP BY 1)
SELECT run_id, total_trades, {rnd('turnover profits losses', 4)}, closed_trades, wins, losing, {rnd('avg_win avg_loss', 4)}, round(wins / closed_trades, 4) AS hit_rate, round(CASE WHEN losses > 1e-8 THEN profits / losses WHEN profits > 1e-8 THEN 10 ELSE 1 END, 4) AS profit_factor FROM f JOIN t USING (run_id)""")
def a2(spark, d):
    fills = x.fills(spark, d)
    return rounded(p.trade_statistics(p.fold_fills(fills), fills, 1000.0), 4)


@register("lg3_marks", f"""WITH {FILLS}, q AS (SELECT instrument, sum(quantity) AS qty, avg(price) AS price, arg_max(price, fill_seq) AS current FROM fills GROUP BY 1)
SELECT instrument, round(qty * current, 6) AS market_value, round(qty * (current - price), 5) + 0.0 AS unrealized, CASE WHEN abs(qty) < 1e-8 THEN 'flat' WHEN qty > 0 THEN 'long' ELSE 'short' END AS side FROM q""")
def lg3(spark, d):
    q = x.fills(spark, d).groupBy("instrument").agg(F.sum("quantity").alias("qty"), F.avg("price").alias("price"), F.max_by("price", "fill_seq").alias("current"))
    out = p.marks(q)
    return out.select("instrument", F.round("market_value", 6).alias("market_value"), (F.round("unrealized", 5) + 0.0).alias("unrealized"), "side")


@register("lg4_weight_backtest", f"""WITH {_SIG}, r AS (SELECT symbol, ts AS as_of, greatest(least(ln(close / lag(close) OVER ({W})), 0.1), -0.1) AS ret FROM bars QUALIFY lag(close) OVER ({W}) IS NOT NULL),
w AS (SELECT symbol, as_of, direction * 0.2::DOUBLE AS weight, ret FROM sig JOIN r USING (symbol, as_of)), b AS (SELECT as_of AS ts, ret, coalesce(lag(weight, 1) OVER v, 0) AS w1, coalesce(lag(weight, 2) OVER v, 0) AS w2 FROM w WINDOW v AS (PARTITION BY symbol ORDER BY as_of))
SELECT ts, round(sum(w1 * ret - abs(w1 - w2) * 0.001::DOUBLE), 6) AS ret FROM b GROUP BY 1""")
def lg4(spark, d):
    w = signals(spark, d).select(F.lit("r").alias("run_id"), "symbol", F.col("as_of").alias("ts"), (F.col("direction") * 0.2).alias("weight"))
    return rounded(p.weight_backtest(w, clipped(spark, d, 0.1), 0.001).select("ts", "ret"))


def clipped(spark, d, limit):
    ret = F.greatest(F.least(f.log_return(), F.lit(limit)), F.lit(-limit))
    bars = x.hourly_bars(spark, d)
    return bars.select("symbol", "ts", ret.alias("ret"), f.log_return().alias("_r")).where("_r is not null").drop("_r")


_MR = f"""{MONTHLY}, mr AS (SELECT symbol, ts, greatest(least((volume - lag(volume) OVER ({W})) / lag(volume) OVER ({W}) / 20.0::DOUBLE, 0.05), -0.05) AS ret FROM monthly QUALIFY lag(volume) OVER ({W}) IS NOT NULL),
ix AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n, ret FROM mr), sz AS (SELECT DISTINCT symbol, n FROM ix)"""


def month_returns(spark, d):
    before = F.lag("volume").over(f.by_symbol())
    ret = F.greatest(F.least((F.col("volume") - before) / before / 20.0, F.lit(0.05)), F.lit(-0.05))
    rows = x.monthly_bars(spark, d).select("symbol", "ts", before.alias("_b"), ret.alias("ret"))
    return rows.where("_b is not null").drop("_b")


def _u(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


_PATHS = f"""{_MR}, st AS (SELECT symbol, n, path, step, CASE WHEN step = 1 OR {_u("'mc'", 'path', 'step', "'r'")} < 0.2 THEN least(CAST(floor({_u("'mc'", 'path', 'step', "'i'")} * n) AS BIGINT), n - 1) - step END AS s
  FROM sz, unnest(range(1000)) p(path), unnest(range(1, n + 1)) q(step)),
lo AS (SELECT symbol, path, step, n, last_value(s IGNORE NULLS) OVER (PARTITION BY symbol, path ORDER BY step ROWS UNBOUNDED PRECEDING) AS o FROM st),
paths AS (SELECT lo.symbol, path, step, ret FROM lo JOIN ix ON lo.symbol = ix.symbol AND ix.idx = ((o + step) % lo.n + lo.n) % lo.n),
cu AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol, path ORDER BY step ROWS UNBOUNDED PRECEDING)) AS nav FROM paths)"""


@register("bs1_bootstrap", f"""WITH {_PATHS}, dd AS (SELECT *, 1 - nav / greatest(max(nav) OVER (PARTITION BY symbol, path ORDER BY step ROWS UNBOUNDED PRECEDING), 1) AS dd FROM cu),
s AS (SELECT symbol, path, count(*) AS n, CASE WHEN stddev_samp(ret) > 1e-8 THEN avg(ret) / stddev_samp(ret) * sqrt(12.0::DOUBLE) ELSE 0 END AS sharpe, max(dd) AS mdd, arg_max(nav, step) AS fin FROM dd GROUP BY 1, 2)
SELECT symbol, path, round(sharpe, 6) AS sharpe, round(mdd + 1.234567e-9::DOUBLE, 6) AS max_drawdown, round(pow(fin, 1 / (n / 12.0::DOUBLE)) - 1, 6) AS cagr, mdd >= 0.5 AS ruin FROM s""")
def bs1(spark, d):
    out = bs.whole_statistics(bs.whole_paths(month_returns(spark, d), 1000), 12.0)
    # clipped returns make drawdowns of few digits: moved off the middle between two rounded values
    return rounded(out.withColumn("max_drawdown", F.col("max_drawdown") + OFF))


_Q = "max(CASE WHEN k = floor((n - 1) * {p} + 0.5) + 1 THEN round(nav + 1.234567e-9::DOUBLE, 4) END)"


@register("bs3_nav_bands", f"""WITH {_PATHS}, a AS (SELECT symbol, step, 1000 * nav AS nav FROM cu UNION ALL SELECT DISTINCT symbol, 0, 1000.0 FROM cu, range(1)),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, step ORDER BY nav) AS k, count(*) OVER (PARTITION BY symbol, step) AS n FROM a)
SELECT symbol, step, {', '.join(f"{_Q.format(p=v)} AS p{int(v * 100)}" for v in (0.05, 0.25, 0.5, 0.75, 0.95))}, round(avg(nav) + 1.234567e-9::DOUBLE, 4) AS mean FROM r GROUP BY 1, 2""")
def bs3(spark, d):
    out = bs.whole_bands(bs.whole_paths(month_returns(spark, d), 1000), 1000.0)
    return rounded(out.withColumn("step", F.col("step").cast("long")), 4, OFF)


_MB = f"""{_MR}, mb AS (SELECT symbol, n, rep, blk, CAST(floor({_u("'mb'", 'rep', 'blk')} * greatest(n - 19, 1)) AS BIGINT) AS a FROM sz, unnest(range(2000)) p(rep), unnest(range(CAST(ceil(n / 20.0) AS BIGINT))) q(blk)),
smp AS (SELECT mb.symbol, rep, ret FROM mb, unnest(range(20)) o(o) JOIN ix ON ix.symbol = mb.symbol AND ix.idx = a + o WHERE blk * 20 + o < mb.n AND a + o < mb.n),
sh AS (SELECT symbol, rep, avg(ret) / stddev_samp(ret) * sqrt(12.0::DOUBLE) AS sharpe FROM smp GROUP BY 1, 2)"""


@register("bs2_sharpe_interval", f"WITH {_MB} SELECT symbol, round(quantile_cont(sharpe, 0.025), 6) AS low, round(quantile_cont(sharpe, 0.975), 6) AS high, count(*) AS replicates FROM sh GROUP BY 1")
def bs2(spark, d):
    return rounded(bs.sharpe_interval(bs.moving_blocks(month_returns(spark, d), 2000, 20), 12.0).drop("defined"))


@register("bs4_paired_difference", f"WITH {_MB}, dd AS (SELECT a.sharpe - b.sharpe AS d FROM sh a JOIN sh b USING (rep) WHERE a.symbol = 'CHINA' AND b.symbol = 'INDIA') SELECT round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM dd")
def bs4(spark, d):
    return rounded(bs.paired_difference(month_returns(spark, d), "CHINA", "INDIA", 12.0))
