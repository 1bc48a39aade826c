"""Signals, weights, exposure limits, transaction costs and trade ledgers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(c: Column, low, high) -> Column:
    wrap = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(c, wrap(low)), wrap(high))


# signals


def calibrate(predictions: DataFrame, threshold: float = 0.0002, scale: float = 0.01, horizon: int = 1) -> DataFrame:
    """Direction with a dead band; confidence as given, else tanh(|r| / scale), 0 when flat.

    ``predictions(..., value, confidence)``.
    """
    v = F.col("value")
    direction = F.when(v > threshold, 1).when(v < -threshold, -1).otherwise(0)
    own = F.when(direction == 0, 0.0).otherwise(clamp(F.tanh(F.abs(v) / max(scale, 1e-6)), 0, 1))
    confidence = F.when(F.col("confidence").isNotNull(), clamp(F.col("confidence"), 0, 1)).otherwise(own)
    return predictions.withColumns({"direction": direction, "expected_return": v, "confidence": confidence, "horizon": F.lit(horizon)}).drop("value")


def threshold(signals: DataFrame, least_return: float, least_confidence: float) -> DataFrame:
    """Weak signals become flat, with zeros."""
    weak = (F.abs("expected_return") < least_return) | (F.col("confidence") < least_confidence)
    zero = {"direction": F.lit(0), "expected_return": F.lit(0.0), "confidence": F.lit(0.0)}
    return signals.withColumn("_weak", weak).withColumns({c: F.when(F.col("_weak"), z).otherwise(F.col(c)) for c, z in zero.items()}).drop("_weak")


def weight_by_confidence(signals: DataFrame, power: float) -> DataFrame:
    return signals.withColumn("expected_return", F.col("expected_return") * F.pow("confidence", F.lit(power)))


def chain(signals: DataFrame, *steps) -> DataFrame:
    """The steps, DataFrame to DataFrame, one after another."""
    for step in steps:
        signals = signals.transform(step)
    return signals


def project_price(forecasts: DataFrame) -> DataFrame:
    """Simple return and implied close of a predicted log return."""
    return forecasts.withColumns({"predicted_return": F.expm1("value"), "implied_close": F.col("close") * F.exp("value")})


# weights


@dataclass(frozen=True)
class Limits:
    gross: float = 1.0
    net: float = 0.5
    position: float = 0.20
    volatility: float | None = 0.15
    asset_volatility: float = 0.20
    derisk_above: float = 0.10
    derisk: float = 0.5
    mode: str = "long_only"  # or long_short, dollar_neutral


def _side(limits: Limits) -> Column:
    d = F.col("direction").cast("double")
    return F.greatest(d, F.lit(0.0)) if limits.mode == "long_only" else d


def _derisk(limits: Limits) -> Column:
    return F.when(F.col("drawdown") > limits.derisk_above, min(max(limits.derisk, 0.1), 1.0)).otherwise(1.0)


def volatility_weights(signals: DataFrame, limits: Limits) -> DataFrame:
    """``weight`` by confidence and volatility target, clamped, less in a drawdown; ``signals(as_of, symbol, direction, confidence, drawdown)``."""
    scale = 1.0 if limits.volatility is None else min(max(limits.volatility / max(limits.asset_volatility, 0.01), 0.2), 2.5)
    return signals.withColumn("weight", clamp(_side(limits) * F.col("confidence") * scale, -limits.position, limits.position) * _derisk(limits))


def kelly_weights(signals: DataFrame, limits: Limits, shrink: float = 0.5, risk_free: float = 0.04) -> DataFrame:
    """``weight`` by a shrunk Kelly fraction of the expected return over the daily rate, clamped, less in a drawdown."""
    variance = max(limits.asset_volatility**2 / 252.0, 1e-6)
    edge = F.greatest(F.abs("expected_return") - risk_free / 252.0, F.lit(0.0)) / variance
    raw = clamp(_side(limits) * min(max(shrink, 0.05), 1.0) * edge * F.col("confidence"), -limits.position, limits.position)
    return signals.withColumn("weight", raw * _derisk(limits))


def dollar_neutral(weights: DataFrame) -> DataFrame:
    """Active weights less their mean, per date."""
    w = Window.partitionBy("as_of")
    active = F.abs("weight") > 1e-8
    mean = F.sum("weight").over(w) / F.count_if(active).over(w)
    return weights.withColumn("weight", F.when(active, F.col("weight") - mean).otherwise(F.col("weight")))


def scale_exposure(weights: DataFrame, gross: float, net: float | None = None) -> DataFrame:
    """Weights scaled so that gross, and net if given, stay within their limits, per date."""
    w = Window.partitionBy("as_of")
    g, n = F.sum(F.abs("weight")).over(w), F.abs(F.sum("weight").over(w))
    scale = F.when((g > gross) & (g > 1e-8), gross / g).otherwise(1.0)
    weights = weights.withColumns({"_s": scale, "_n": n})
    if net is not None:
        weights = weights.withColumn("_s", F.least("_s", F.when(F.col("_n") * F.col("_s") > net, net / F.col("_n")).otherwise(F.col("_s"))))
    return weights.withColumn("weight", F.col("weight") * F.col("_s")).drop("_s", "_n")


def to_targets(weights: DataFrame) -> DataFrame:
    """Value and whole quantity of each weight; ``weights(..., nav, price)``."""
    value = F.col("weight") * F.col("nav")
    price = F.greatest(F.coalesce("price", F.lit(1.0)), F.lit(1e-4))
    return weights.withColumns({"target_value": value, "target_quantity": F.round(value / price)})


def sector_neutral(weights: DataFrame) -> DataFrame:
    """Weights less their sector's mean per date; the only one of a sector becomes 0."""
    w = Window.partitionBy("as_of", F.coalesce("sector", F.lit("Unassigned")))
    return weights.withColumn("weight", F.when(F.count("*").over(w) == 1, 0.0).otherwise(F.col("weight") - F.avg("weight").over(w)))


def l1_ball(weights: DataFrame, radius: float) -> DataFrame:
    """Projection of each date's weights on the L1 ball: a soft threshold from sorted running sums."""
    w = Window.partitionBy("as_of")
    down = w.orderBy(F.desc("_a"), "symbol")
    rows = weights.withColumn("_a", F.abs("weight"))
    rows = rows.withColumns({"_c": F.sum("_a").over(down.rowsBetween(Window.unboundedPreceding, 0)), "_k": F.row_number().over(down), "_t": F.sum("_a").over(w)})
    rows = rows.withColumn("_ok", F.col("_a") - (F.col("_c") - radius) / F.col("_k") > 0)
    theta = F.max(F.when(F.col("_ok"), F.struct("_k", ((F.col("_c") - radius) / F.col("_k")).alias("theta")))).over(w)["theta"]
    sign = F.when(F.col("weight") >= 0, 1.0).otherwise(-1.0)
    out = F.when(F.col("_t") <= radius, F.col("weight")).otherwise(sign * F.greatest(F.col("_a") - theta, F.lit(0.0)))
    return rows.withColumn("weight", out).drop("_a", "_c", "_k", "_t", "_ok")


# Per regime gross, net, single position, sizing and drawdown limits.
REGIME_LIMITS = {
    "Bull": (1.5, 1.0, 0.30, 1.0, 0.20),
    "Bear": (0.8, 0.3, 0.15, 0.6, 0.10),
    "Crisis": (0.1, 0.05, 0.05, 0.0, 0.05),
    "HighVol": (0.7, 0.4, 0.15, 0.5, 0.12),
    "LowVol": (1.3, 0.9, 0.25, 1.1, 0.15),
    "MeanReverting": (1.0, 0.5, 0.20, 0.8, 0.15),
    "Trending": (1.0, 0.5, 0.20, 0.8, 0.15),
}


def regime_limits(rows: DataFrame) -> DataFrame:
    table = F.create_map(*(x for k, v in REGIME_LIMITS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    got = table[F.col("regime")]
    return rows.withColumns({c: got[i] for i, c in enumerate(("max_gross", "max_net", "max_single", "sizing", "max_drawdown_limit"))})


def compliance(books: DataFrame) -> DataFrame:
    """Breaches of the regime's limits, with a slack of 1e-4; ``books(..., regime, gross_exposure, net_exposure, drawdown)``."""
    rows = regime_limits(books)
    rules = {
        "gross": F.col("gross_exposure") > F.col("max_gross") + 1e-4,
        "net": F.abs("net_exposure") > F.col("max_net") + 1e-4,
        "drawdown": F.col("drawdown") > F.col("max_drawdown_limit") + 1e-4,
    }
    broken = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return rows.withColumn("breaches", F.array_join(broken, ",")).withColumn("compliant", F.col("breaches") == "")


def clamp_quantity(orders: DataFrame) -> DataFrame:
    """Desired quantities after the regime's sizing and single-position limit; ``orders(..., regime, desired, price, nav)``."""
    rows = regime_limits(orders)
    scaled = F.col("desired") * F.col("sizing")
    most = F.when(F.col("price") > 1e-6, F.col("nav") * F.col("max_single") / F.col("price")).otherwise(0.0)
    return rows.withColumn("allowed", F.when(F.abs(scaled) < 1e-6, 0.0).otherwise(clamp(scaled, -most, most)))


# costs


def _eligible(cap: Column) -> Column:
    most = F.col("volume") * clamp(cap, 0.001, 1.0)
    q = clamp(F.col("quantity"), -most, most)
    touched = F.when(F.col("is_limit") & (F.col("quantity") > 0) & (F.col("low") > F.col("limit_price")), False).when(F.col("is_limit") & (F.col("quantity") < 0) & (F.col("high") < F.col("limit_price")), False).otherwise(True)
    return F.when((F.abs("quantity") < 1e-8) | (F.abs(q) < 1e-8) | ~touched, 0.0).otherwise(q)


def _filled(orders: DataFrame, cap: float, slippage: Column) -> DataFrame:
    own = F.coalesce("participation_cap", F.lit(cap)) if "participation_cap" in orders.columns else F.lit(cap)
    rows = orders.withColumn("fill_quantity", _eligible(own))
    none = F.col("fill_quantity") == 0
    rows = rows.withColumn("slippage", F.when(none, 0.0).otherwise(slippage))
    away = F.when(none & F.col("is_limit"), F.col("limit_price")).otherwise(F.col("close"))
    return rows.withColumn("fill_price", F.when(none, away).otherwise(F.col("close") + F.signum("fill_quantity") * F.col("slippage")))


def linear_costs(orders: DataFrame, rate: float = 5e-4, least: float = 1.0, spread_bps: float = 2.0, slope: float = 0.10, cap: float = 0.05) -> DataFrame:
    """Fill quantity, price, slippage and commission: capped participation, half spread and linear impact.

    ``orders(..., quantity, is_limit, limit_price, high, low, close, volume)``; a
    column ``participation_cap`` overrides ``cap`` where it isn't null.
    """
    share = F.abs("fill_quantity") / F.greatest(F.col("volume").cast("double"), F.lit(1.0))
    out = _filled(orders, cap, F.col("close") * (spread_bps * 1e-4 + slope * share))
    fee = F.greatest(F.abs("fill_quantity") * F.col("fill_price") * rate, F.lit(least))
    return out.withColumn("commission", F.when(F.col("fill_quantity") == 0, 0.0).otherwise(fee))


def impact_costs(
    orders: DataFrame, gamma: float = 0.314, eta: float = 0.142, alpha: float = 1.0, beta: float = 0.5, floor: float = 0.02, adv: float = 1e6, spread_bps: float = 2.0, cap: float = 0.05, schedule: Schedule | None = None, traded: Column | float = 0.0
) -> DataFrame:
    """Fill quantity, price, slippage and commission: permanent and square-root temporary impact on the bar's range volatility.

    Commission is the fee of ``schedule`` at a volume of ``traded`` so far; limit
    orders are makers.  Caps as in :func:`linear_costs`.
    """
    q = F.abs("fill_quantity")
    sigma = F.when((F.col("high") > F.col("low")) & (F.col("close") > 0), F.greatest((F.col("high") - F.col("low")) / F.col("close"), F.lit(floor))).otherwise(floor)
    lasting = gamma * F.pow(clamp(q / max(adv, 1.0), 0, 1), F.lit(alpha))
    passing = eta * F.pow(clamp(q / F.greatest(F.col("volume").cast("double"), F.lit(1.0)), 0, 1), F.lit(beta))
    out = _filled(orders, cap, F.col("close") * (spread_bps * 1e-4 + sigma * (lasting + passing)))
    fee = trade_fee(F.col("fill_quantity"), F.col("fill_price"), F.col("is_limit"), traded if isinstance(traded, Column) else F.lit(traded), schedule or Schedule())
    return out.withColumn("commission", F.when(F.col("fill_quantity") == 0, 0.0).otherwise(fee))


#: Least cumulative volume, taker and maker fee a share, and basis points of the value.
TIERS = ((0.0, 0.0030, -0.0015, 0.0), (100_000.0, 0.0020, -0.0020, 0.0), (1_000_000.0, 0.0010, -0.0025, 0.0))


@dataclass(frozen=True)
class Schedule:
    """Fee tiers from the lowest volume up, and the least fee of a trade that isn't a rebate."""

    tiers: tuple[tuple[float, float, float, float], ...] = TIERS
    least: float = 0.5

    @classmethod
    def flat(cls, bps: float, least: float) -> Schedule:
        return cls(((0.0, 0.0, 0.0, bps),), least)


def trade_fee(quantity: Column, price: Column, is_maker: Column, traded: Column, schedule: Schedule) -> Column:
    """The fee of a trade by the tier of the volume traded before it; rebates have no minimum."""
    shares, raw = F.abs(quantity), None
    for low, taker, maker, bps in schedule.tiers:
        tier = shares * F.when(is_maker, maker).otherwise(taker) + shares * price * (bps * 1e-4)
        raw = tier if raw is None else F.when(traded >= low, tier).otherwise(raw)
    return F.when(raw > 0, F.greatest(raw, F.lit(schedule.least))).otherwise(raw)


def tiered_fees(fills: DataFrame, schedule: Schedule | None = None) -> DataFrame:
    """``cumulative`` volume before each fill and its ``fee``; ``fills(instrument, fill_seq, quantity, price, is_maker)``."""
    before = Window.partitionBy("instrument").orderBy("fill_seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = fills.withColumn("cumulative", F.coalesce(F.sum(F.abs("quantity")).over(before), F.lit(0.0)))
    return rows.withColumn("fee", trade_fee(F.col("quantity"), F.col("price"), F.col("is_maker"), F.col("cumulative"), schedule or Schedule()))


def borrow_fee(notional: Column, rate: float = 0.015) -> Column:
    return F.abs(notional) * (rate / 365.25)


# ledger


def cash_curve(fills: DataFrame, initial: float, width: int = 65_536) -> DataFrame:
    """Cash, commissions and position after each fill; ``fills(run_id, instrument, fill_seq, quantity, price, commission)``.

    A run is cut into ranges of ``width`` numbers of fill_seq.  Each range is summed
    on its own, and what the ranges before it come to is added from a table of one
    row per range, so no task holds a whole run.
    """
    at = Window.partitionBy("run_id", "_range").orderBy("fill_seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("run_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    one = Window.partitionBy("run_id", "instrument").orderBy("fill_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = fills.withColumns({"_range": F.floor(F.col("fill_seq") / width), "_spent": F.col("quantity") * F.col("price") + F.col("commission")})
    totals = rows.groupBy("run_id", "_range").agg(F.sum("_spent").alias("_s"), F.sum("commission").alias("_c"))
    totals = totals.select(
        F.col("run_id").alias("_run"), F.col("_range").alias("_r"), *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in ("_s", "_c"))
    )
    rows = rows.withColumns({"_sum": F.sum("_spent").over(at), "_fees": F.sum("commission").over(at)})
    same = F.col("run_id").eqNullSafe(F.col("_run")) & F.col("_range").eqNullSafe(F.col("_r"))
    done = rows.join(totals, same).withColumns(
        {
            "cash": F.lit(initial) - (F.coalesce("_sum", F.lit(0.0)) + F.col("_s")),
            "commissions": F.coalesce("_fees", F.lit(0.0)) + F.col("_c"),
            "position": F.sum("quantity").over(one),
        }
    )
    return done.select(*fills.columns, "cash", "commissions", "position")


def fold_fills(fills: DataFrame) -> DataFrame:
    """Each fill with the state after it and, where it closes something, the closed trade.

    Per (run, instrument): average entry price, realized profit, entry and exit fees
    shared by what is closed.  A fill that reverses a position is one that closes
    it and one that opens the other side at its price.  An episode lasts from flat
    to flat; in it, cost and fees grow with what is added and shrink in proportion
    with what is closed, so they are running sums of what was added, each divided
    by the share that is still held since the episode's begin.  Windows only: no row
    holds a pair's fills.
    """
    pair = Window.partitionBy("run_id", "instrument").orderBy("fill_seq")
    rows = fills.where(F.abs("quantity") >= 1e-8).select("run_id", "instrument", "fill_seq", F.col("quantity").alias("q"), F.col("price").alias("p"), F.col("commission").alias("c"))
    snap = lambda c: F.when(F.abs(c) < 1e-8, 0.0).otherwise(c)
    rows = rows.withColumn("to", snap(F.sum("q").over(pair.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("was", F.coalesce(F.lag("to").over(pair), F.lit(0.0)))
    turns = F.col("was") * F.col("to") < 0
    share = F.abs("was") / F.abs("q")
    part = lambda k, was, to, c: F.struct(F.lit(k).alias("part"), was.alias("was"), to.alias("to"), c.alias("c"))
    zero = F.lit(0.0)
    both = F.array(part(0, F.col("was"), zero, F.col("c") * share), part(1, zero, F.col("to"), F.col("c") - F.col("c") * share))
    rows = rows.withColumn("x", F.explode(F.when(turns, both).otherwise(F.array(part(0, F.col("was"), F.col("to"), F.col("c")))))).select("run_id", "instrument", "fill_seq", "p", "x.*")

    along = Window.partitionBy("run_id", "instrument").orderBy("fill_seq", "part")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    adds = (F.col("was") == 0) | (F.abs("to") > F.abs("was"))
    rows = rows.withColumns({"adds": adds, "episode": F.count_if(F.col("was") == 0).over(so_far)})
    one = Window.partitionBy("run_id", "instrument", "episode").orderBy("fill_seq", "part")
    up_to = one.rowsBetween(Window.unboundedPreceding, 0)
    left = F.when(~F.col("adds") & (F.col("to") != 0), F.log(F.abs("to") / F.abs("was"))).otherwise(0.0)
    rows = rows.withColumn("held", F.exp(F.sum(left).over(up_to)))
    put = lambda c: F.sum(F.when(F.col("adds"), c / F.col("held")).otherwise(0.0)).over(up_to) * F.col("held")
    rows = rows.withColumns({"cost": put(F.abs(F.col("to") - F.col("was")) * F.col("p")), "fees": put(F.col("c"))})
    before = lambda c: F.lag(c).over(one)
    rows = rows.withColumns({"entry": before("cost") / F.abs("was"), "paid": before("fees"), "closed": F.when(F.col("adds"), 0.0).otherwise(F.abs("was") - F.abs("to"))})
    gross = F.when(F.col("adds"), 0.0).otherwise(F.col("closed") * F.signum("was") * (F.col("p") - F.col("entry")))
    pnl = F.when(~F.col("adds"), gross - F.col("paid") * F.col("closed") / F.abs("was") - F.col("c"))
    rows = rows.withColumns({"gross": gross, "pnl": pnl}).withColumn("realized", F.sum("gross").over(so_far))
    state = lambda c, v: F.max_by(v, "part").alias(c)
    open_ = F.col("to") != 0
    return rows.groupBy("run_id", "instrument", F.col("fill_seq").alias("seq")).agg(
        state("qty", F.col("to")),
        state("price", F.when(open_, F.col("cost") / F.abs("to")).otherwise(0.0)),
        state("fees", F.when(open_, F.col("fees")).otherwise(0.0)),
        state("realized", F.col("realized")),
        F.max("closed").alias("closed"),
        F.max("pnl").alias("pnl"),
        F.max(F.when(~F.col("adds"), F.col("entry"))).alias("entry"),
    )


def trade_statistics(trades: DataFrame, fills: DataFrame, initial: float) -> DataFrame:
    """Turnover, fills, closed trades, hit rate, profit factor, mean win and loss of each run of ``fills``.

    ``trades`` as of :func:`fold_fills`.  A run that closed nothing has 0 throughout
    and a profit factor of 1.
    """
    notional = F.sum(F.abs(F.col("quantity") * F.col("price")))
    runs = fills.groupBy("run_id").agg(F.count("*").alias("total_trades"), (notional / initial if initial > 0 else F.lit(0.0)).alias("turnover"))
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    share = F.try_divide(F.col("pnl"), F.col("closed") * F.col("entry"))
    s = trades.where("pnl is not null").groupBy("run_id").agg(
        F.count("*").alias("closed_trades"),
        F.count_if(win).alias("wins"),
        F.count_if(loss).alias("losing"),
        F.sum(F.when(win, F.col("pnl"))).alias("profits"),
        (-F.sum(F.when(loss, F.col("pnl")))).alias("losses"),
        F.avg(F.when(win, share)).alias("avg_win"),
        F.avg(F.when(loss, share)).alias("avg_loss"),
    )
    s = runs.join(s, "run_id", "left").na.fill(0)
    factor = F.when(F.col("losses") > 1e-8, F.try_divide(F.col("profits"), F.col("losses"))).when(F.col("profits") > 1e-8, 10.0).otherwise(1.0)
    hits = F.when(F.col("closed_trades") > 0, F.try_divide(F.col("wins"), F.col("closed_trades"))).otherwise(0.0)
    return s.withColumns({"hit_rate": hits, "profit_factor": factor})


def marks(positions: DataFrame) -> DataFrame:
    """Market value, unrealized profit and side; ``positions(..., qty, price, current)``."""
    side = F.when(F.abs("qty") < 1e-8, "flat").when(F.col("qty") > 0, "long").otherwise("short")
    return positions.withColumns({"market_value": F.col("qty") * F.col("current"), "unrealized": F.col("qty") * (F.col("current") - F.col("price")), "side": side})


def weight_backtest(weights: DataFrame, returns: DataFrame, cost: float) -> DataFrame:
    """Return per (run, ts): each bar earns the weight of the bar before, less the cost of what it changed.

    ``weights(run_id, symbol, ts, weight)``, ``returns(symbol, ts, ret)``.
    """
    w = Window.partitionBy("run_id", "symbol").orderBy("ts")
    rows = weights.join(returns, ["symbol", "ts"]).withColumns({"_w": F.coalesce(F.lag("weight", 1).over(w), F.lit(0.0)), "_v": F.coalesce(F.lag("weight", 2).over(w), F.lit(0.0))})
    return rows.groupBy("run_id", "ts").agg(F.sum(F.col("_w") * F.col("ret") - F.abs(F.col("_w") - F.col("_v")) * cost).alias("ret"))
