"""Block bootstrap of return series.

Draws come from counters, md5(seed:path:step), not from shared state: each path is
the same wherever and whenever it is made.  A path of a series that fits a row is
made whole inside one row; :func:`stationary_paths` makes any path by joins and windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import distribution


def draw(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) from 32 bits of the parts' md5."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def indexed(returns: DataFrame, key: str = "symbol") -> DataFrame:
    """``(key, idx, n, ret)``, idx from 0 in order of time."""
    w = Window.partitionBy(key)
    return returns.select(key, (F.row_number().over(w.orderBy("ts")) - 1).alias("idx"), F.count("*").over(w).alias("n"), "ret")


def stationary_paths(returns: DataFrame, paths: int, seed: str = "mc", restart: float = 0.2, key: str = "symbol") -> DataFrame:
    """``(key, path, step, ret)``: blocks of geometric length, wrapped around the end.

    A step starts a new block with probability ``restart`` at a drawn index, else
    it follows the step before; so its index is that of the last start plus the
    distance, modulo n.
    """
    base = indexed(returns, key)
    sizes = base.groupBy(key).agg(F.count("*").alias("n"))
    steps = sizes.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    begin = (F.col("step") == 1) | (draw(seed, F.col("path"), F.col("step"), "r") < restart)
    at = F.least(F.floor(draw(seed, F.col("path"), F.col("step"), "i") * F.col("n")), F.col("n") - 1)
    along = Window.partitionBy(key, "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("_s", F.when(begin, at - F.col("step"))).withColumn("_o", F.last("_s", ignorenulls=True).over(along))
    steps = steps.withColumn("idx", F.pmod(F.col("_o") + F.col("step"), F.col("n")))
    return steps.select(key, "path", "step", "idx").join(base.select(key, "idx", "ret"), [key, "idx"]).select(key, "path", "step", "ret")


#: The longest series that travels as one array, and the paths that are made together.
LONGEST, TOGETHER = 1 << 17, 16


def whole_paths(returns: DataFrame, paths: int, seed: str = "mc", restart: float = 0.2, key: str = "symbol") -> DataFrame:
    """``(key, part, path, n, rets)``: the paths of :func:`stationary_paths`, each in a row.

    A key's returns are gathered to one array, dealt once to parts of ``TOGETHER``
    paths, and each path looks its steps up there: one exchange, and rows as many as
    paths.  A series above ``LONGEST`` is an error; for those there is the other way.
    """
    series = returns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ts", "ret"))).alias("s"))
    n = F.size("s")
    short = F.when(n > LONGEST, F.raise_error(F.lit(f"a series is longer than {LONGEST}: use stationary_paths")).cast("array<double>")).otherwise(F.transform("s", lambda x: x["ret"]))
    parts = -(-paths // TOGETHER)
    rows = series.select(key, n.alias("n"), short.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(key, "part")
    last = F.least((F.col("part") + 1) * TOGETHER, F.lit(paths)) - 1
    rows = rows.select(key, "part", "n", "r", F.explode(F.sequence(F.col("part") * TOGETHER, last)).alias("path"))
    begins = lambda s: (s == 1) | (draw(seed, F.col("path"), s, "r") < restart)
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(1), F.col("n")), begins))
    at = lambda s: F.least(F.floor(draw(seed, F.col("path"), s, "i") * F.col("n")), F.col("n") - 1)

    def block(s: Column, i: Column) -> Column:
        """The steps from a start to the one before the next: successive returns, wrapped around the end."""
        end = F.coalesce(F.get("starts", i + 1), F.col("n") + 1)
        return F.transform(F.arrays_zip(F.sequence(F.lit(0), end - s - 1).alias("k"), F.array_repeat(at(s), end - s).alias("a")), lambda x: F.get("r", F.pmod(x["a"] + x["k"], F.col("n")).cast("int")))

    return rows.select(key, "part", "path", "n", F.flatten(F.transform("starts", block)).alias("rets"))


def whole_statistics(paths: DataFrame, periods: float, risk_free: float = 0.0, key: str = "symbol") -> DataFrame:
    """As :func:`path_statistics`, of :func:`whole_paths`: running value, peak and drawdown by one fold over each row."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("log"), F.lit(1.0).alias("peak"), zero.alias("dd"), zero.alias("sum"))

    def step(s: Column, r: Column) -> Column:
        log = s["log"] + F.log1p(r)
        peak = F.greatest(s["peak"], F.exp(log))
        return F.struct(log.alias("log"), peak.alias("peak"), F.greatest(s["dd"], 1.0 - F.exp(log) / peak).alias("dd"), (s["sum"] + r).alias("sum"))

    rows = paths.withColumn("s", F.aggregate("rets", start, step)).withColumn("mean", F.col("s.sum") / F.col("n"))
    spread = F.aggregate("rets", zero, lambda a, r: a + (r - F.col("mean")) * (r - F.col("mean")))
    rows = rows.select(key, "path", "n", "mean", F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("vol"), F.col("s.dd").alias("max_drawdown"), F.exp("s.log").alias("final"))
    return _judged(rows, periods, risk_free, key)


def whole_bands(paths: DataFrame, cash: float, key: str = "symbol") -> DataFrame:
    """As :func:`nav_bands`, of :func:`whole_paths`: a path's steps stay where its row is, only the bands are dealt anew."""
    steps = paths.select(key, "part", "path", F.posexplode(F.concat(F.array(F.lit(0.0)), "rets")).alias("step", "ret"))
    along = Window.partitionBy(key, "part", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.select(F.struct(key, "step").alias("at"), (F.lit(cash) * F.exp(F.sum(F.log1p("ret")).over(along))).alias("nav"))
    return distribution(rows, "nav", "at").select(F.col(f"at.{key}").alias(key), "at.step", "p5", "p25", "p50", "p75", "p95", "mean")


def path_statistics(paths: DataFrame, periods: float, risk_free: float = 0.0, key: str = "symbol") -> DataFrame:
    """Sharpe, largest drawdown, growth rate and ruin of each path (returns above -1)."""
    along = Window.partitionBy(key, "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = paths.withColumn("nav", F.exp(F.sum(F.log1p("ret")).over(along)))
    rows = rows.withColumn("dd", 1.0 - F.col("nav") / F.greatest(F.max("nav").over(along), F.lit(1.0)))
    s = rows.groupBy(key, "path").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("vol"), F.max("dd").alias("max_drawdown"), F.max_by("nav", "step").alias("final"))
    return _judged(s, periods, risk_free, key)


def _judged(s: DataFrame, periods: float, risk_free: float, key: str) -> DataFrame:
    """Sharpe, growth rate and ruin from length, mean, deviation, drawdown and final value."""
    years = F.col("n") / periods
    cagr = F.when(years <= 0.05, F.col("final") - 1).when(F.col("final") > 0, F.pow("final", 1 / years) - 1).otherwise(-1.0)
    sharpe = F.when(F.col("vol") > 1e-8, (F.col("mean") - risk_free / periods) / F.col("vol") * math.sqrt(periods)).otherwise(0.0)
    return s.select(key, "path", sharpe.alias("sharpe"), "max_drawdown", cagr.alias("cagr"), (F.col("max_drawdown") >= 0.5).alias("ruin"))


def nav_bands(paths: DataFrame, cash: float, key: str = "symbol") -> DataFrame:
    """Percentile bands of the value at each step, step 0 being the cash."""
    along = Window.partitionBy(key, "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = paths.select(key, "path", "step", (F.lit(cash) * F.exp(F.sum(F.log1p("ret")).over(along))).alias("nav"))
    start = paths.select(key, "path").distinct().select(key, "path", F.lit(0).alias("step"), F.lit(cash).alias("nav"))
    both = rows.union(start).withColumn("at", F.struct(key, "step"))
    return distribution(both, "nav", "at").select(F.col(f"at.{key}").alias(key), "at.step", "p5", "p25", "p50", "p75", "p95", "mean")


def moving_blocks(returns: DataFrame, replicates: int, block: int, seed: str = "mb", key: str = "symbol") -> DataFrame:
    """``(key, rep, pos, ret)``: drawn blocks of ``block`` successive returns, cut to the series' length."""
    base = indexed(returns, key)
    sizes = base.groupBy(key).agg(F.count("*").alias("n"))
    rep = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rep = rep.withColumn("blk", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))))
    at = F.floor(draw(seed, F.col("rep"), F.col("blk")) * F.greatest(F.col("n") - block + 1, F.lit(1)))
    rows = rep.withColumn("at", at).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    rows = rows.withColumns({"pos": F.col("blk") * block + F.col("o"), "idx": F.col("at") + F.col("o")}).where("pos < n and idx < n")
    return rows.select(key, "rep", "pos", "idx").join(base.select(key, "idx", "ret"), [key, "idx"]).select(key, "rep", "pos", "ret")


def sharpe_interval(samples: DataFrame, periods: float, confidence: float = 0.95, key: str = "symbol") -> DataFrame:
    """Linear percentiles of the replicates' Sharpe ratios, and how many replicates have one (``defined``)."""
    s = samples.groupBy(key, "rep").agg(F.try_divide(F.avg("ret") * math.sqrt(periods), F.stddev_samp("ret")).alias("sharpe"))
    tail = (1 - confidence) / 2
    return s.groupBy(key).agg(F.percentile("sharpe", tail).alias("low"), F.percentile("sharpe", 1 - tail).alias("high"), F.count("*").alias("replicates"), F.count("sharpe").alias("defined"))


def paired_difference(returns: DataFrame, a: str, b: str, periods: float, replicates: int = 2000, block: int = 20, confidence: float = 0.95, key: str = "symbol") -> DataFrame:
    """Interval of the Sharpe difference of two candidates drawn with the same indices; only their series are drawn from."""
    samples = moving_blocks(returns.where(F.col(key).isin(a, b)), replicates, block, key=key)
    s = samples.groupBy("rep").pivot(key, [a, b]).agg(F.avg("ret") / F.stddev_samp("ret") * math.sqrt(periods))
    d = s.select((F.col(a) - F.col(b)).alias("d"))
    tail = (1 - confidence) / 2
    return d.agg(F.avg("d").alias("mean"), F.percentile("d", tail).alias("low"), F.percentile("d", 1 - tail).alias("high"))


def study_summary(rows: DataFrame, periods: float, replicates: int = 200, block: int = 20, key: str = "symbol") -> DataFrame:
    """One row a model: correlations, hit rate, after-cost Sharpe with its interval, turnover, drawdown and counts.

    ``rows(key, ts, pred, target, ret, turnover)``, ``ret`` being after costs.
    Undefined statistics are null; targets of 0 don't count for the hit rate.
    """
    from .metrics import information

    along = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    curve = rows.withColumn("_e", F.exp(F.sum(F.log1p("ret")).over(along)))
    curve = curve.withColumn("_d", F.col("_e") / F.greatest(F.max("_e").over(along), F.lit(1.0)) - 1.0)
    hit = F.when(F.col("target") != 0, (F.signum("pred") == F.signum("target")).cast("double"))
    s = curve.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg(hit).alias("hit_rate"),
        F.try_divide(F.avg("ret") * math.sqrt(periods), F.stddev_samp("ret")).alias("sharpe"),
        F.avg("turnover").alias("mean_turnover"),
        F.min("_d").alias("max_drawdown"),
    )
    ci = sharpe_interval(moving_blocks(rows, replicates, block, key=key), periods, key=key)
    ci = ci.select(key, F.col("low").alias("sharpe_low"), F.col("high").alias("sharpe_high"), F.col("defined").alias("defined_draws"))
    return s.join(information(rows, key, undefined=None), key).join(ci, key, "left")
