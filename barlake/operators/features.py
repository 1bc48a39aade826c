"""Windowed indicators, targets, cross-sections and curves.

Every indicator is a function of a bounded row frame per symbol, so all of them
share one window specification: one shuffle and one sort.  ``WINDOW`` is the
number of bars that recursive indicators see.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.normal import quantile
from ..functions.taps import ema_taps, fracdiff_taps, macd_taps, wilder_taps
from .graph import FeatureRegistry, FeatureSpec, Past, compile_features
from .ordered import MOST, numbered

WINDOW = 35
HOURS_A_YEAR = 252.0 * 24


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def last(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def full(n: int, value: Column, of: str | Column = "close") -> Column:
    """The value where n rows of ``of`` are in the frame, else null."""
    return F.when(F.count(of).over(last(n)) == n, value)


def dot(values: Column, taps: list[float]) -> Column:
    """A dot product spelled out, so that it is compiled."""
    return sum((F.get(values, F.lit(i)) * F.lit(w) for i, w in enumerate(taps)), F.lit(0.0))


def newest(c: str, n: int) -> Column:
    """The last n values, oldest first; null before there are n.

    Made of offsets into the sorted partition: each is a step of one pointer, where
    a collected frame would gather n values anew at every row.
    """
    w = by_symbol()
    back = [F.lag(c, k).over(w) for k in range(n - 1, 0, -1)]
    return F.when(F.lag(c, n - 1).over(w).isNotNull() if n > 1 else F.col(c).isNotNull(), F.array(*back, F.col(c)))


def closes(n: int = WINDOW) -> Column:
    return newest("close", n)


def on_window(of: Callable[[list[Column]], Column], n: int = WINDOW) -> Column:
    """``of`` the last n closes, oldest first; null before there are n."""
    w = by_symbol()
    values = [F.lag("close", k).over(w) for k in range(n - 1, 0, -1)] + [F.col("close")]
    return F.when(values[0].isNotNull(), of(values))


def weighted(values: list[Column], taps: list[float]) -> Column:
    return sum((v * F.lit(t) for v, t in zip(values, taps)), F.lit(0.0))


def sma(p: int) -> Column:
    return full(p, F.avg("close").over(last(p)))


def rolling_sum(p: int, c: str = "close") -> Column:
    return full(p, F.sum(c).over(last(p)), c)


def rolling_mean(p: int, c: str = "close") -> Column:
    return full(p, F.avg(c).over(last(p)), c)


def ema(p: int, n: int = WINDOW) -> Column:
    return on_window(lambda c: weighted(c, ema_taps(p, n)), n)


def macd(n: int = WINDOW) -> tuple[Column, Column, Column]:
    """Line, signal, histogram."""
    return tuple(on_window(lambda c, t=t: weighted(c, t), n) for t in macd_taps(n))


def _wilder(values: list[Column], p: int) -> Column:
    return weighted(values, wilder_taps(p, len(values)))


def rsi(p: int, n: int = WINDOW) -> Column:
    """50 without movement, 100 without losses."""

    def of(c: list[Column]) -> Column:
        steps = [b - a for a, b in zip(c, c[1:])]
        gain = _wilder([F.greatest(s, F.lit(0.0)) for s in steps], p)
        loss = _wilder([F.greatest(-s, F.lit(0.0)) for s in steps], p)
        return F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / loss))

    return on_window(of, n)


def true_range() -> Column:
    """Null for a symbol's first bar."""
    before = F.lag("close").over(by_symbol())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(bars: DataFrame, p: int, n: int = WINDOW, name: str = "atr") -> DataFrame:
    bars = bars.withColumn("_tr", true_range())
    value = F.when(F.lag("close", n - 1).over(by_symbol()).isNotNull(), dot(newest("_tr", n - 1), wilder_taps(p, n - 1)))
    return bars.withColumn(name, value).drop("_tr")


def bollinger(p: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, dev = F.avg("close").over(last(p)), F.stddev_pop("close").over(last(p))
    band = 2.0 * k * dev
    parts = {
        "middle": mid,
        "upper": mid + k * dev,
        "lower": mid - k * dev,
        "bandwidth": F.when(mid > 0, band / mid).otherwise(0.0),
        "percent_b": F.when(band < 1e-10, 0.5).otherwise((F.col("close") - (mid - k * dev)) / band),
    }
    return {name: full(p, c) for name, c in parts.items()}


def log_return(k: int = 1) -> Column:
    return F.log(F.col("close") / F.lag("close", k).over(by_symbol()))


def rolling_volatility(bars: DataFrame, p: int, periods: float, name: str = "volatility") -> DataFrame:
    bars = bars.withColumn("_r", log_return())
    return bars.withColumn(name, full(p, F.stddev_samp("_r").over(last(p)) * math.sqrt(periods), "_r")).drop("_r")


def parkinson(p: int, periods: float) -> Column:
    term = F.pow(F.log(F.col("high") / F.col("low")), 2)
    return full(p, F.sqrt(F.sum(term).over(last(p)) / (4.0 * math.log(2.0) * p)) * math.sqrt(periods))


def garman_klass(p: int, periods: float) -> Column:
    term = 0.5 * F.pow(F.log(F.col("high") / F.col("low")), 2) - (2.0 * math.log(2.0) - 1.0) * F.pow(F.log(F.col("close") / F.col("open")), 2)
    return full(p, F.sqrt(F.greatest(F.avg(term).over(last(p)), F.lit(0.0))) * math.sqrt(periods))


def fracdiff(d: float, threshold: float = 1e-5, cap: int = 500, log: bool = True) -> Column:
    """The fractional difference of closes or their logs; null before there are as many as weights."""
    w = by_symbol()
    value = F.log("close") if log else F.col("close")
    return sum((F.lag(value, k).over(w) * F.lit(t) for k, t in enumerate(fracdiff_taps(d, threshold, cap)) if k), value)


def full_ema(bars: DataFrame, p: int) -> DataFrame:
    """EMA over the whole series of a symbol, seeded with the mean of its first ``p`` closes.

    Bars are numbered and cut into blocks so long that a value fades to less than
    1e-17 over one.  In a block the recursion is a sum of values scaled by its
    fading; of earlier blocks only the end of the one before still counts.
    """
    alpha = 2.0 / (p + 1.0)
    fade = 1.0 - alpha
    length = max(p, math.ceil(math.log(1e-17) / math.log(fade))) if fade > 0 else p
    w = Window.partitionBy("symbol").orderBy("ts")
    i = F.row_number().over(w) - p  # 0 is the seed
    rows = bars.select("symbol", "ts", "close", i.alias("i"), F.avg("close").over(w.rowsBetween(1 - p, 0)).alias("mean")).where("i >= 0")
    at = F.pmod("i", F.lit(length))
    value = F.when(F.col("i") == 0, F.col("mean")).otherwise(alpha * F.col("close"))
    rows = rows.withColumns({"block": F.floor(F.col("i") / length), "at": at, "scaled": value * F.pow(F.lit(fade), -at) if fade > 0 else value})
    inside = Window.partitionBy("symbol", "block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.sum("scaled").over(inside) * F.pow(F.lit(fade), "at") if fade > 0 else F.col("scaled"))
    ends = rows.where(F.col("at") == length - 1).select("symbol", (F.col("block") + 1).alias("block"), F.col("own").alias("end"))
    before = F.lag("end").over(Window.partitionBy("symbol").orderBy("block"))
    ends = ends.withColumn("end", F.col("end") + F.coalesce(before, F.lit(0.0)) * fade**length)
    rows = rows.join(ends, ["symbol", "block"], "left")
    return rows.select("symbol", "ts", (F.col("own") + F.coalesce("end", F.lit(0.0)) * F.pow(F.lit(fade), F.col("at") + 1)).alias("ema"))


BASELINE = ("sma_20", "ema_12", "rsi_14", "macd_hist", "bollinger_bw", "atr_14", "volatility_20", "log_return_1")


def baseline_registry(periods: float = HOURS_A_YEAR, n: int = WINDOW) -> FeatureRegistry:
    """The features of baseline_v1, recursive ones over a window of n bars."""

    def change(past: Past) -> Column:
        return F.log(past("close") / past("close", 1))

    def spread(past: Past) -> Column:
        before = past("close", 1)
        return F.greatest(past("high") - past("low"), F.abs(past("high") - before), F.abs(past("low") - before))

    def bandwidth(past: Past) -> Column:
        mid = past.frame("avg", "close", 20)
        return F.when(mid > 0, 4.0 * past.frame("stddev_pop", "close", 20) / mid).otherwise(0.0)

    def strength(past: Past) -> Column:
        """Smoothed gains and losses are half the sum and half the difference of the smoothed |steps| and steps."""
        moved, net = past("rsi_moved"), past("rsi_net")
        return F.when(moved == 0, 50.0).when(moved == net, 100.0).otherwise(100.0 - 100.0 / (1.0 + (moved + net) / (moved - net)))

    wilder = wilder_taps(14, n - 1)
    known = FeatureRegistry()
    for spec in (
        FeatureSpec("step", 1, 2, ("close",), lambda p: p("close") - p("close", 1), helper=True),
        FeatureSpec("true_range", 1, 2, ("high", "low", "close"), spread, helper=True),
        FeatureSpec("log_return_1", 1, 2, ("close",), change),
        FeatureSpec("sma_20", 1, 20, ("close",), lambda p: p.frame("avg", "close", 20)),
        FeatureSpec("ema_12", 1, n, ("close",), lambda p: weighted(p.values("close", n), ema_taps(12, n))),
        FeatureSpec("macd_hist", 1, n, ("close",), lambda p: weighted(p.values("close", n), macd_taps(n)[2])),
        FeatureSpec("rsi_net", 1, n - 1, ("step",), lambda p: weighted(p.values("step", n - 1), wilder), helper=True),
        FeatureSpec("rsi_moved", 1, n - 1, ("step",), lambda p: weighted([F.abs(s) for s in p.values("step", n - 1)], wilder), helper=True),
        FeatureSpec("rsi_14", 1, 1, ("rsi_net", "rsi_moved"), strength),
        FeatureSpec("bollinger_bw", 1, 20, ("close",), bandwidth),
        FeatureSpec("atr_14", 1, n - 1, ("true_range",), lambda p: weighted(p.values("true_range", n - 1), wilder)),
        FeatureSpec("volatility_20", 1, 20, ("log_return_1",), lambda p: p.frame("stddev_samp", "log_return_1", 20) * math.sqrt(periods)),
    ):
        known.add(spec)
    return known


def baseline(bars: DataFrame, periods: float = HOURS_A_YEAR, n: int = WINDOW) -> DataFrame:
    """The baseline_v1 feature set: rows on which every feature is defined, at the time a bar may be used."""
    return compile_features(bars, BASELINE, baseline_registry(periods, n))


def in_chunks(bars: DataFrame, make: Callable[[DataFrame], DataFrame], rows: int, lookback: int = WINDOW, most: int = MOST) -> DataFrame:
    """``make`` over chunks of ``rows`` successive bars, so that one long symbol is no single task.

    Bars are numbered; the last ``lookback`` - 1 of a chunk also go, as a halo, to the
    next one, whatever time lies between them.  ``make`` gives each bar's row the bar's
    ``avail_ts`` as ``ts``, which must increase with it; rows of the halo are dropped.
    """
    halo = lookback - 1
    if rows <= halo:
        raise ValueError("a chunk must be longer than the halo")
    numbers = numbered(bars, "symbol", "ts", most)
    chunk, place = F.floor(F.col("_n") / rows), F.col("_n") % rows
    begins = numbers.where(place == 0).select("symbol", chunk.alias("_chunk"), F.col("avail_ts").alias("_from"))
    both = F.when(place >= rows - halo, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    parts = numbers.withColumn("_chunk", F.explode(both)).join(begins, ["symbol", "_chunk"])
    parts = parts.withColumn("symbol", F.struct("symbol", "_chunk", "_from")).drop("_chunk", "_from", "_n")
    done = make(parts).where(F.col("ts") >= F.col("symbol._from"))
    return done.withColumn("symbol", F.col("symbol.symbol"))


def targets(bars: DataFrame, horizon: int = 1, neutral: float = 0.0) -> DataFrame:
    """Forward log return from a bar's availability to the bar ``horizon`` later; the last bars have none."""
    w = by_symbol()
    r = F.log(F.lead("close", horizon).over(w) / F.col("close"))
    out = bars.select("symbol", F.col("avail_ts").alias("ts"), F.lead("avail_ts", horizon).over(w).alias("target_ts"), r.alias("target"))
    direction = F.when(F.col("target") > neutral, 1).when(F.col("target") < -neutral, -1).otherwise(0)
    return out.where("target_ts is not null").withColumn("direction", direction)


def multi_targets(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    w = by_symbol()
    rets = [F.log(F.lead("close", h).over(w) / F.col("close")) for h in horizons]
    out = bars.select("symbol", "ts", F.array(*rets).alias("targets"), rets[-1].alias("_last"))
    return out.where("_last is not null").drop("_last")


def sliding(rows: DataFrame, features: list[str], length: int) -> DataFrame:
    """Windows [length, features] that end at each row."""
    w = by_symbol().rowsBetween(-(length - 1), 0)
    return rows.withColumn("window", F.collect_list(F.array(*features)).over(w)).where(F.size("window") == length)


def momentum(bars: DataFrame, k: int = 20) -> DataFrame:
    bars = bars.withColumn("_r", log_return())
    return bars.withColumn("momentum", full(k, F.avg("_r").over(last(k)), "_r")).drop("_r")


def cross_section(rows: DataFrame, value: str = "value", clamp: float | None = None) -> DataFrame:
    """z, mean, std and universe per ts, for at least two instruments; a std within 1e-12 of 0 gives z 0."""
    w = Window.partitionBy("ts")
    rows = rows.withColumns({"mean": F.avg(value).over(w), "std": F.stddev_samp(value).over(w), "universe": F.count(value).over(w)}).where("universe >= 2")
    z = F.when(F.col("std") <= 1e-12, 0.0).otherwise((F.col(value) - F.col("mean")) / F.col("std"))
    if clamp is not None:
        z = F.least(F.greatest(z, F.lit(-clamp)), F.lit(clamp))
    return rows.withColumn("z", z)


def melt(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Several feature columns as rows (feature, value)."""
    return rows.unpivot(keys, features, "feature", "value")


def rank_normal(rows: DataFrame, value: str = "value") -> DataFrame:
    """Normal quantile of average rank / (n + 1) per ts."""
    order = Window.partitionBy("ts").orderBy(value)
    ties = Window.partitionBy("ts", value)
    rank = F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0
    n = F.count("*").over(Window.partitionBy("ts"))
    return rows.withColumns({"avg_rank": rank, "universe": n}).where("universe >= 2").withColumn("z", quantile(F.col("avg_rank") / (F.col("universe") + 1.0)))


def top_bottom(signals: DataFrame, top: int, bottom: int, arrival: str = "seq") -> DataFrame:
    """The ``top`` best with positive and the ``bottom`` worst with negative expected return; all others flat.

    Equal returns stay in the order in which they came, by the column ``arrival``.
    """
    w = Window.partitionBy("as_of")
    rank = F.row_number().over(w.orderBy(F.desc("expected_return"), arrival)) - 1
    out = signals.withColumn("_rank", rank).withColumn("_n", F.count("*").over(w))
    long = (F.col("_rank") < top) & (F.col("expected_return") > 0)
    short = (F.col("_rank") >= F.greatest(F.col("_n") - bottom, F.lit(0))) & (F.col("expected_return") < 0)
    out = out.withColumn("direction", F.when(long, 1).when(short, -1).otherwise(0))
    flat = F.col("direction") == 0
    out = out.withColumn("expected_return", F.when(flat, 0.0).otherwise(F.col("expected_return")))
    return out.withColumn("confidence", F.when(flat, 0.0).otherwise(F.col("confidence"))).drop("_rank", "_n")


def curve_returns(curve: DataFrame, key: str = "symbol", nav: str = "nav") -> DataFrame:
    """Period returns of a value curve; 0 where the value before is not above 1e-8; the first row has none."""
    before = F.lag(nav).over(Window.partitionBy(key).orderBy("ts"))
    out = curve.withColumn("_before", before).where("_before is not null")
    return out.withColumn("ret", F.when(F.col("_before") > 1e-8, (F.col(nav) - F.col("_before")) / F.col("_before")).otherwise(0.0)).drop("_before")


def drawdown(curve: DataFrame, initial: Column, key: str = "symbol", nav: str = "nav") -> DataFrame:
    """Running peak, from the initial cash on, and the fraction below it."""
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = curve.withColumn("peak", F.greatest(F.max(nav).over(w), initial))
    return out.withColumn("drawdown", F.when(F.col("peak") > 1e-8, (F.col("peak") - F.col(nav)) / F.col("peak")).otherwise(0.0))


def equity(returns: DataFrame, key: str = "symbol") -> DataFrame:
    """Cumulated product of 1 + ret, for returns above -1."""
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(w)))


def buy_and_hold(bars: DataFrame, cash: float) -> DataFrame:
    """Value of cash put into the first close, and its returns (0 at first)."""
    w = Window.partitionBy("symbol").orderBy("ts")
    first = F.first("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = bars.withColumn("benchmark_nav", F.lit(cash) * F.col("close") / first)
    before = F.lag("close").over(w)
    return out.withColumn("benchmark_return", F.when(before > 0, F.col("close") / before - 1.0).otherwise(0.0))
