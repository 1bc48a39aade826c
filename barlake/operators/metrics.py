"""Performance, risk, forecast quality, drift and calibration, for all runs at once."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import cdf
from .features import curve_returns, drawdown


def ratio(top: Column, bottom: Column, least: float, other=0.0) -> Column:
    return F.when(bottom > least, top / bottom).otherwise(other)


def corr(a: str, b: str) -> Column:
    """Pearson correlation; null where a side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def performance(curve: DataFrame, cash: float, periods: float, risk_free: float = 0.0, key: str = "symbol") -> DataFrame:
    """One row a run from its value curve: returns, growth rate, Sharpe, Sortino, Calmar, drawdown."""
    daily = risk_free / periods
    top = drawdown(curve, F.lit(cash), key).groupBy(key).agg(F.max("drawdown").alias("max_drawdown"), F.max_by("nav", "ts").alias("final"))
    r = F.col("ret")
    down = F.when(r < daily, F.pow(r - daily, 2)).otherwise(0.0)
    stats = curve_returns(curve, key).groupBy(key).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("vol"), F.sum(down).alias("down"))
    out = top.join(stats, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = (F.col("final") - cash) / cash if cash > 1e-8 else F.lit(0.0)
    years = F.col("n") / periods
    out = out.withColumn("total_return", total)
    out = out.withColumn("cagr", F.when((F.col("n") >= 2) & (F.col("final") > 0) & (years > 0.05), F.pow(F.col("final") / cash, 1.0 / years) - 1.0).otherwise(F.col("total_return")))
    excess, enough = F.col("mean") - daily, F.col("n") >= 2
    out = out.withColumn("sharpe", F.when(enough, ratio(excess, F.col("vol"), 1e-8) * math.sqrt(periods)).otherwise(0.0))
    lower = F.sqrt(F.col("down") / (F.col("n") - 1))
    out = out.withColumn("sortino", F.when(enough, ratio(excess, lower, 1e-8) * math.sqrt(periods)).otherwise(0.0))
    out = out.withColumn("calmar", ratio(F.col("cagr"), F.col("max_drawdown"), 1e-4))
    return out.select(key, "n", "total_return", "cagr", "sharpe", "sortino", "calmar", "max_drawdown")


def deflated(sharpe: Column, trials: Column) -> Column:
    """Sharpe less a penalty that grows with the number of trials, at least -5."""
    return F.greatest(sharpe - F.sqrt(F.log(F.greatest(trials, F.lit(1)).cast("double"))) * 0.15, F.lit(-5.0))


def deflated_probability(returns: DataFrame, trials: int, variance: float, key: str = "symbol") -> DataFrame:
    """Probability that the Sharpe ratio beats the best of ``trials`` by chance, with skew and kurtosis.

    Null when undefined: fewer than two trials, no variance between them, fewer
    than four returns or returns that don't vary.
    """
    if trials < 2 or not variance > 0:
        return returns.select(key).distinct().withColumn("probability", F.lit(None).cast("double"))
    r = F.col("ret")
    sums = returns.where("ret is not null").groupBy(key).agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.var_pop("ret").alias("m2"), F.avg(F.pow(r, 3)).alias("r3"), F.avg(F.pow(r, 4)).alias("r4"), F.avg(F.pow(r, 2)).alias("r2"))
    n, m = F.col("n"), F.col("m")
    m3 = F.col("r3") - 3 * m * F.col("r2") + 2 * F.pow(m, 3)
    m4 = F.col("r4") - 4 * m * F.col("r3") + 6 * m * m * F.col("r2") - 3 * F.pow(m, 4)
    skew = F.sqrt(n * (n - 1.0)) / (n - 2) * m3 / F.pow("m2", 1.5)
    kurt = (n - 1.0) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / (F.col("m2") * F.col("m2")) - 3 * (n - 1)) + 3
    euler = 0.5772156649015329
    best = math.sqrt(variance) * ((1 - euler) * NormalDist().inv_cdf(1 - 1 / trials) + euler * NormalDist().inv_cdf(1 - 1 / (trials * math.e)))
    sr = m / F.col("s")
    inside = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    p = F.when((n > 3) & (F.col("s") > 0) & (inside > 0), cdf((sr - best) * F.sqrt(n - 1.0) / F.sqrt(inside)))
    return sums.select(key, p.alias("probability"))


def risk(returns: DataFrame, nav: DataFrame, periods: float, key: str = "symbol") -> DataFrame:
    """Value at risk and expected shortfall at 95 %, volatility and beta.

    ``returns(key, ts, ret, benchmark)``; ``nav(key, nav)``.  The shortfall is the
    mean of the worst ceil(5 %) returns, not below the value at risk; with fewer
    than five returns it is 1.25 times that.
    """
    # Fixed value: the 95 % quantile of the normal distribution.
    z = 1.6448536269514722
    w = Window.partitionBy(key)
    rows = returns.withColumns({"_k": F.row_number().over(w.orderBy("ret", "ts")), "_n": F.count("*").over(w)})
    tail = F.col("_k") <= F.greatest(F.ceil(F.col("_n") * 0.05), F.lit(1))
    out = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("vol"),
        F.avg(F.when(tail, F.col("ret"))).alias("tail"),
        F.covar_samp("ret", "benchmark").alias("cov"),
        F.var_samp("benchmark").alias("var_b"),
        F.count("benchmark").alias("n_b"),
    )
    out = out.join(nav, key)
    vol = F.when(F.col("n") >= 2, F.col("vol")).otherwise(0.0)
    mean = F.when(F.col("n") >= 2, F.col("mean")).otherwise(0.0)
    out = out.withColumn("var_95", F.greatest(z * vol - mean, F.lit(0.0)) * F.col("nav"))
    out = out.withColumn("cvar_95", F.when(F.col("n") >= 5, F.greatest(-F.col("tail") * F.col("nav"), F.col("var_95"))).otherwise(F.col("var_95") * 1.25))
    beta = F.when((F.col("n") >= 5) & (F.col("n") == F.col("n_b")) & (F.col("var_b") * (F.col("n") - 1) > 1e-10), F.col("cov") / F.col("var_b")).otherwise(1.0)
    return out.select(key, "var_95", "cvar_95", (vol * math.sqrt(periods)).alias("annual_vol"), beta.alias("beta"))


def factor_exposure(risks: DataFrame, book: DataFrame, key: str = "symbol") -> DataFrame:
    """The map of factor exposures of each book: beta to the market and gross leverage; ``risks`` as of :func:`risk`, ``book(key, gross_exposure)``."""
    factors = F.create_map(F.lit("market"), F.col("beta"), F.lit("gross_leverage"), F.coalesce("gross_exposure", F.lit(0.0)))
    return risks.join(book.select(key, "gross_exposure"), key, "left").select(key, factors.alias("exposure"))


#: The stress scenarios and their market moves.
SCENARIOS = {"MarketCrash_10Pct": -0.10, "MarketRally_10Pct": 0.10, "SevereCrisis_20Pct": -0.20}


def stress(books: DataFrame, key: str = "symbol") -> DataFrame:
    """Profit and its share of the value under each scenario, from ``books(key, nav, net_value)``."""
    moves = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("move")) for k, v in SCENARIOS.items())))
    rows = books.withColumn("x", moves).select(key, "nav", "net_value", "x.*")
    pnl = F.col("move") * F.col("net_value")
    return rows.select(key, "scenario", pnl.alias("pnl"), ratio(pnl, F.col("nav"), 1e-8).alias("pnl_pct"))


def exposures(positions: DataFrame, cash: DataFrame, key: str = "symbol") -> DataFrame:
    """Value, gross and net market value and exposure per (key, ts) from ``positions(key, ts, quantity, price)`` and ``cash(key, ts, cash)``."""
    value = F.col("quantity") * F.col("price")
    sums = positions.groupBy(key, "ts").agg(F.sum(value).alias("net_value"), F.sum(F.abs(value)).alias("gross_value"))
    out = cash.join(sums, [key, "ts"], "left").na.fill(0.0, ["net_value", "gross_value"])
    out = out.withColumn("nav", F.col("cash") + F.col("net_value"))
    return out.withColumns({"gross_exposure": ratio(F.col("gross_value"), F.col("nav"), 1e-8), "net_exposure": ratio(F.col("net_value"), F.col("nav"), 1e-8)})


def ranks(c: str, key: str) -> Column:
    """Average rank within the key."""
    return F.rank().over(Window.partitionBy(key).orderBy(c)) + (F.count("*").over(Window.partitionBy(key, c)) - 1) / 2.0


def information(rows: DataFrame, key: str = "symbol", undefined: float | None = 0.0) -> DataFrame:
    """Pearson and rank correlation of ``pred`` and ``target``; ``undefined`` where there is none."""
    rows = rows.withColumns({"_a": ranks("pred", key), "_b": ranks("target", key)})
    fix = lambda c: F.coalesce(F.when(~F.isnan(c), c), F.lit(undefined).cast("double"))
    return rows.groupBy(key).agg(fix(corr("pred", "target")).alias("ic"), fix(corr("_a", "_b")).alias("rank_ic"))


def direction(rows: DataFrame, key: str = "symbol") -> DataFrame:
    """Share of right signs over targets that aren't 0; one half without any."""
    hit = F.when(F.col("target") != 0, (F.signum("pred") == F.signum("target")).cast("double"))
    return rows.groupBy(key).agg(F.coalesce(F.avg(hit), F.lit(0.5)).alias("accuracy"))


def forecast(rows: DataFrame, periods: float, key: str = "symbol", risk_free: float = 0.04) -> DataFrame:
    """Evaluation of predictions traded with position tanh(pred): correlations, hits, drawdown, mean, and Sharpe and volatility a year.

    Sharpe is of returns less ``risk_free`` / ``periods``; deviations are of the population.
    """
    rows = rows.withColumns({"ret": F.tanh("pred") * F.col("target"), "_a": ranks("pred", key), "_b": ranks("target", key)})
    along = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    curve = rows.withColumn("_e", F.exp(F.sum(F.log1p("ret")).over(along)))
    peak = F.max("_e").over(along)
    curve = curve.withColumn("_d", (F.col("_e") - peak) / F.greatest(peak, F.lit(1e-8)))
    hit = F.when(F.col("target") != 0, (F.signum("pred") == F.signum("target")).cast("double"))
    std, year = F.stddev_pop("ret"), math.sqrt(periods)
    return curve.groupBy(key).agg(
        F.coalesce(corr("pred", "target"), F.lit(0.0)).alias("ic"),
        F.coalesce(corr("_a", "_b"), F.lit(0.0)).alias("rank_ic"),
        F.coalesce(F.avg(hit), F.lit(0.5)).alias("accuracy"),
        F.when(std >= 1e-8, (F.avg("ret") - risk_free / periods) / std * year).otherwise(0.0).alias("sharpe"),
        F.min("_d").alias("max_drawdown"),
        F.avg("ret").alias("mean_return"),
        (std * year).alias("volatility"),
    )


def hac_t(rows: DataFrame, value: str, lag: int = 5, key: str = "symbol") -> DataFrame:
    """t of the mean with Bartlett-weighted autocovariances up to ``lag``; null unless there are more than ``lag`` + 2 values.

    Null values are left out before neighbours are taken.
    """
    w = Window.partitionBy(key)
    d = rows.where(F.col(value).isNotNull()).withColumns({"_n": F.count(value).over(w), "_m": F.avg(value).over(w)}).withColumn("_d", F.col(value) - F.col("_m"))
    lags = {f"_p{k}": F.col("_d") * F.lag("_d", k).over(w.orderBy("ts")) for k in range(1, lag + 1)}
    s = d.withColumns(lags).groupBy(key).agg(F.max("_n").alias("n"), F.max("_m").alias("mean"), F.sum(F.col("_d") * F.col("_d")).alias("s0"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in lags))
    var = (F.col("s0") + sum((2.0 * (1 - k / (lag + 1)) * F.col(f"_p{k}") for k in range(1, lag + 1)), F.lit(0.0))) / F.col("n")
    return s.select(key, "n", "mean", F.when((F.col("n") > lag + 2) & (var > 0), F.col("mean") / F.sqrt(var / F.col("n"))).alias("t"))


def date_information(rows: DataFrame, key: str = "model_id") -> DataFrame:
    """The correlation of predictions and targets across instruments on each date, as ``ic``."""
    out = rows.groupBy(key, "ts").agg(corr("pred", "target").alias("ic"), F.count("*").alias("n"))
    return out.where("n >= 3 and ic is not null and not isnan(ic)")


def directional_huber(pred: Column, target: Column, delta: float = 1.0, wrong: float = 2.0) -> Column:
    """Huber loss, ``wrong`` times as much where the signs differ."""
    e = F.abs(pred - target)
    huber = F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))
    return huber * F.when(pred * target < 0, wrong).otherwise(1.0)


def losses(rows: DataFrame, delta: float = 1.0, wrong: float = 2.0, least: float = 0.0, eps: float = 1e-6, key: str = "symbol") -> DataFrame:
    """Values of the training losses: directional Huber, negative Sharpe, negative Sortino above a target return ``least``."""
    r = F.tanh("pred") * F.col("target")
    down = F.sqrt(F.avg(F.pow(F.greatest(F.lit(least) - r, F.lit(0.0)), 2)) + eps)
    return rows.groupBy(key).agg(
        F.avg(directional_huber(F.col("pred"), F.col("target"), delta, wrong)).alias("directional"),
        (-F.avg(r) / (F.stddev_samp(r) + eps)).alias("neg_sharpe"),
        (-(F.avg(r) - least) / down).alias("neg_sortino"),
    )


def multi_horizon_loss(rows: DataFrame, weights: list[float] | None = None, key: str = "symbol", delta: float = 1.0, wrong: float = 2.0) -> DataFrame:
    """Weighted mean of the horizons' directional Huber losses over ``preds`` and ``targets``, arrays of one value a horizon; equal weights by default."""
    w = F.array(*map(F.lit, weights)) if weights else F.transform("preds", lambda _: F.lit(1.0))
    parts = F.zip_with(F.zip_with("preds", "targets", lambda p, t: directional_huber(p, t, delta, wrong)), w, lambda x, k: x * k)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy(key).agg(F.avg(add(parts) / add(w)).alias("loss"))


def nearest(p: float) -> Column:
    """Place (from 1) of the nearest-rank percentile in ``n`` sorted values, halves away from 0."""
    return F.floor((F.col("n") - 1) * p + 0.5) + 1


def distribution(rows: DataFrame, value: str, key: str) -> DataFrame:
    """p5, p25, p50, p75, p95 by nearest rank, and mean; by ranks, so that no group is held whole."""
    w = Window.partitionBy(key)
    r = rows.withColumns({"k": F.row_number().over(w.orderBy(value)), "n": F.count("*").over(w)})
    at = {f"p{int(p * 100)}": F.max(F.when(F.col("k") == nearest(p), F.col(value))) for p in (0.05, 0.25, 0.5, 0.75, 0.95)}
    return r.groupBy(key).agg(*(c.alias(k) for k, c in at.items()), F.avg(value).alias("mean"))


def regime_of(n: Column, worst: Column, vol: Column, mean: Column, high: float = 0.25, scale: float = 1.0) -> Column:
    """The regime label of a run of returns; ``vol`` annualised, ``scale`` = 252 / periods a year."""
    drift = 0.0008 * scale
    return (
        F.when(n < 5, "MeanReverting")
        .when((worst < -0.06) | (vol > 0.45), "Crisis")
        .when(vol > max(high, 0.25), "HighVol")
        .when(mean > drift, "Bull")
        .when(mean < -drift, "Bear")
        .when(vol < 0.10, "LowVol")
        .otherwise("MeanReverting")
    )


def regimes(returns: DataFrame, periods: float, key: str = "symbol") -> DataFrame:
    s = returns.groupBy(key).agg(F.count("*").alias("n"), F.min("ret").alias("worst"), (F.coalesce(F.stddev_samp("ret"), F.lit(0.0)) * math.sqrt(periods)).alias("vol"), F.avg("ret").alias("mean"))
    return s.select(key, "n", regime_of(F.col("n"), F.col("worst"), F.col("vol"), F.col("mean"), scale=252.0 / periods).alias("regime"))


def rolling_regimes(returns: DataFrame, length: int, periods: float) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(length - 1), 0)
    label = regime_of(F.count("ret").over(w), F.min("ret").over(w), F.coalesce(F.stddev_samp("ret").over(w), F.lit(0.0)) * math.sqrt(periods), F.avg("ret").over(w), scale=252.0 / periods)
    return returns.select("symbol", "ts", label.alias("regime"))


def ks(reference: DataFrame, current: DataFrame, key: str = "feature") -> DataFrame:
    """Largest distance of the two empirical distributions of ``value``, per feature."""
    both = reference.select(key, "value", F.lit(1).alias("a"), F.lit(0).alias("b")).union(current.select(key, "value", F.lit(0).alias("a"), F.lit(1).alias("b")))
    steps = both.groupBy(key, "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    every, so_far = Window.partitionBy(key), Window.partitionBy(key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    d = F.abs(F.sum("a").over(so_far) / F.sum("a").over(every) - F.sum("b").over(so_far) / F.sum("b").over(every))
    return steps.select(key, d.alias("d")).groupBy(key).agg(F.max("d").alias("ks"))


def drift_status(n: Column, worst: Column, window: int = 100, warn: float = 0.2, halt: float = 0.4) -> Column:
    return F.when(n < window, "insufficient_data").when(worst >= halt, "halt").when(worst >= warn, "warn").otherwise("ok")


def counted(decisions: DataFrame, identity: dict[str, str] | None = None) -> DataFrame:
    """Decisions of live or recorded real data whose columns have the values of ``identity``."""
    for column, value in (identity or {}).items():
        decisions = decisions.where(F.col(column) == value)
    return decisions.where(F.col("provenance").isin("live", "recorded_real"))


def monitor(decisions: DataFrame, outcomes: DataFrame, reference: DataFrame, window: int = 100, identity: dict[str, str] | None = None) -> DataFrame:
    """Status of each dataset's newest distinct decisions against the reference features.

    ``decisions(dataset, as_of, seq, decision_id, provenance, predicted, features
    map)``, ``outcomes(decision_id, realized)``, ``reference(dataset, feature, value)``.
    Only decisions of live or recorded real data count, and only those that
    ``identity`` names: columns such as model, package and schema with the value
    that each must have.  A prediction or outcome of 0 counts as positive.  Without
    outcomes the correlation and hit rate are null.
    """
    from .core import distinct_decisions

    some = distinct_decisions(counted(decisions, identity), window)
    own = some.select("dataset", F.explode("features").alias("feature", "value"))
    key = lambda r: r.select(F.struct("dataset", "feature").alias("feature"), "value")
    worst = ks(key(reference.join(own.select("dataset", "feature").distinct(), ["dataset", "feature"], "left_semi")), key(own))
    worst = worst.groupBy(F.col("feature.dataset").alias("dataset")).agg(F.max("ks").alias("max_ks"))
    sign = lambda c: F.when(F.col(c) < 0, -1).otherwise(1)
    pairs = some.join(outcomes, "decision_id")
    quality = pairs.groupBy("dataset").agg(F.count("*").alias("outcomes"), corr("predicted", "realized").alias("ic"), F.avg((sign("predicted") == sign("realized")).cast("double")).alias("hit_rate"))
    n = some.groupBy("dataset").agg(F.count("*").alias("n"))
    out = n.join(worst, "dataset", "left").join(quality, "dataset", "left").na.fill(0, ["max_ks", "outcomes"])
    return out.withColumn("status", drift_status(F.col("n"), F.col("max_ks"), window))


def conformal(rows: DataFrame, alpha: float = 0.1, normalised: bool = False, key: str = "symbol") -> DataFrame:
    """Quantile of the calibration scores |residual| (over sigma), the rank taken upwards; keys of fewer than ten rows go.

    ``rows(key, ts, pred, target[, sigma])``.
    """
    residual = F.abs(F.col("target") - F.col("pred"))
    score = residual / F.greatest(F.col("sigma"), F.lit(1e-6)) if normalised else residual
    w = Window.partitionBy(key)
    r = rows.withColumns({"residual": residual, "score": score}).withColumns({"k": F.row_number().over(w.orderBy("score", "ts")), "n": F.count("*").over(w)}).where("n >= 10")
    level = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"), F.lit(1.0))
    place = F.ceil(level * (F.col("n") - 1)) + 1
    return r.groupBy(key).agg(F.max(F.when(F.col("k") == place, F.col("score"))).alias("q"), F.avg("residual").alias("mean_residual"), F.median("residual").alias("median_residual"), F.count("*").alias("n"))


def intervals(rows: DataFrame, quantiles: DataFrame, key: str = "symbol", normalised: bool = False) -> DataFrame:
    """Bounds around each prediction and its confidence: its share of itself and the half width, halved where the band holds 0.

    Normalised quantiles are scaled by each row's ``sigma``.
    """
    half = F.col("q") * F.col("sigma") if normalised else F.col("q")
    out = rows.join(quantiles.select(key, "q"), key).withColumns({"lower": F.col("pred") - half, "upper": F.col("pred") + half})
    size, width = F.abs("pred"), 0.5 * (F.col("upper") - F.col("lower"))
    inside = (F.col("lower") <= 0) & (F.col("upper") >= 0)
    sure = size / F.greatest(size + width, F.lit(1e-8)) * F.when(inside, 0.5).otherwise(1.0)
    return out.withColumn("confidence", F.least(F.greatest(sure, F.lit(0.0)), F.lit(1.0)))


def coverage(rows: DataFrame, target: float = 0.9, key: str = "symbol") -> DataFrame:
    """Share of targets inside their bounds, how far that is from ``target``, and the mean and median width."""
    inside = F.avg(F.col("target").between(F.col("lower"), F.col("upper")).cast("double"))
    width = F.col("upper") - F.col("lower")
    return rows.groupBy(key).agg(inside.alias("coverage"), (inside - target).alias("coverage_error"), F.avg(width).alias("mean_width"), F.median(width).alias("median_width"))


def minimum_d(bars: DataFrame, step: float = 0.1, threshold: float = 1e-3, cap: int = 500) -> DataFrame:
    """The least d = 0, step, 2 step ... up to 1 whose differenced closes look stationary, and its number of weights; 1 if none does.

    At least 20 values; variances of the halves above 1e-12 and within a factor 2;
    |mean| below 2 deviations.  A series shorter than ``cap`` has no more weights
    than values.
    """
    from ..functions.taps import fracdiff_taps

    grid, d = [], 0.0
    while d <= 1.0:
        grid.append(d)
        d += step
    every = Window.partitionBy("symbol")
    back = every.orderBy("ts")
    rows = bars.select("symbol", "ts", "close", F.row_number().over(back).alias("_i"), F.count("*").over(every).alias("_all"))
    all_d = list(dict.fromkeys([*grid, 1.0]))
    kept, made = rows.columns, []
    # a few differences at a time share one set of offsets; all steps share one sort
    for at in range(0, len(all_d), 3):
        few = [fracdiff_taps(d, threshold, cap) for d in all_d[at : at + 3]]
        longest = max(map(len, few))
        rows = rows.select("*", *(F.lag("close", k, 0.0).over(back).alias(f"_c{k}") for k in range(1, longest)))
        past = [F.coalesce("close", F.lit(0.0)), *(F.coalesce(f"_c{k}", F.lit(0.0)) for k in range(1, longest))]
        new = []
        for d, taps in zip(all_d[at : at + 3], few):
            value = sum((past[k] * F.lit(t) for k, t in enumerate(taps)), F.lit(0.0))
            size = F.least(F.lit(len(taps)), F.col("_all"), F.lit(cap))
            new.append(F.struct(F.lit(d).alias("d"), size.alias("window"), value.alias("v")).alias(f"_d{len(made) + len(new)}"))
        rows = rows.select(*kept, *made, *new)
        made += [f"_d{len(made) + k}" for k in range(len(new))]
    outs = rows.select("symbol", "ts", "_i", F.explode(F.array(*made)).alias("x")).where(F.col("_i") >= F.col("x.window")).select("symbol", "ts", "x.*")
    w = Window.partitionBy("symbol", "d")
    r = outs.withColumns({"k": F.row_number().over(w.orderBy("ts")), "n": F.count("*").over(w)})
    half = F.floor(F.col("n") / 2)
    s = r.groupBy("symbol", "d").agg(
        F.max("n").alias("n"), F.max("window").alias("window"), F.var_samp(F.when(F.col("k") <= half, F.col("v"))).alias("a"), F.var_samp(F.when(F.col("k") > half, F.col("v"))).alias("b"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")
    )
    ok = (F.col("n") >= 20) & (F.least("a", "b") > 1e-12) & (F.greatest("a", "b") / F.least("a", "b") < 2) & (F.col("s") > 1e-12) & (F.abs("m") / F.col("s") < 2)
    ok = ok & F.col("d").isin(*grid)
    fits = F.when(ok, F.struct("d", "window"))
    best = s.groupBy("symbol").agg(F.min(fits).alias("x"), F.max(F.struct("d", "window")).alias("last"))
    best = bars.select("symbol").distinct().join(best, "symbol", "left")
    return best.select("symbol", F.coalesce("x.d", F.lit(1.0)).alias("minimum_d"), F.coalesce("x.window", "last.window", F.lit(len(fracdiff_taps(1.0, threshold, cap)))).alias("window"))


def reference_rate(rates: DataFrame, today: Column, key: str = "pair") -> DataFrame:
    """Last rate, change in percent, low, high and mean of the newest 30, and whether the last is older than a week; ``rates(key, day, rate)``."""
    w = Window.partitionBy(key).orderBy(F.desc("day"))
    rows = rates.withColumns({"_k": F.row_number().over(w), "_before": F.lead("rate").over(w)})
    new = F.col("_k") <= 30
    last = F.max(F.when(F.col("_k") == 1, F.col("rate")))
    before = F.max(F.when(F.col("_k") == 1, F.col("_before")))
    return rows.groupBy(key).agg(
        last.alias("last"),
        ((last / before - 1) * 100).alias("change_pct"),
        F.min(F.when(new, F.col("rate"))).alias("low"),
        F.max(F.when(new, F.col("rate"))).alias("high"),
        F.avg(F.when(new, F.col("rate"))).alias("mean"),
        F.count("*").alias("n"),
        (F.datediff(F.max(today), F.max("day")) > 7).alias("stale"),
    )


def verdict(report: DataFrame) -> DataFrame:
    """A run passes with Sharpe above 0.5, drawdown below 35 % and a positive return."""
    ok = (F.col("sharpe") > 0.5) & (F.col("max_drawdown") < 0.35) & (F.col("total_return") > 0)
    return report.withColumn("verdict", F.when(ok, "pass").otherwise("fail"))


def after_cost(rows: DataFrame, cost_bps: float) -> DataFrame:
    """Long for one bar where ``pred`` > 0: return after costs on both sides, and turnover."""
    c = cost_bps * 1e-4
    long, gross = F.col("pred") > 0, F.col("next_close") / F.col("next_open")
    return rows.withColumns({"ret": F.when(long, gross * (1 - c) / (1 + c) - 1).otherwise(0.0), "turnover": F.when(long, 1 + gross).otherwise(0.0)})


def equal_weight(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ts").agg(F.avg("ret").alias("ret"), F.avg("turnover").alias("turnover"), F.count("*").alias("n"))


def across_seeds(rows: DataFrame) -> DataFrame:
    """Mean, deviation and variance of Sharpe over a model's seeds."""
    return rows.groupBy("model_id").agg(F.avg("sharpe").alias("mean"), F.stddev_samp("sharpe").alias("std"), F.var_samp("sharpe").alias("variance"), F.count("*").alias("n"))
