import math

import pytest
from barlake.functions import taps
from barlake.functions.normal import cdf, quantile
from barlake.operators import features as f
from pyspark.sql import functions as F

DAY = 86_400


def frame(spark, closes, symbol="a"):
    rows = [(symbol, i * DAY, c * 0.99, c * 1.02, c * 0.98, float(c), 1_000_000, i * DAY) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume long, avail_ts long")


def last_value(df, c):
    return df.orderBy("ts").select(c.alias("v")).collect()[-1]["v"]


def test_golden_values(spark):
    # Published example series with their indicators
    sma = frame(spark, [22.27, 22.19, 22.08, 22.17, 22.18, 22.13, 22.23, 22.43, 22.24, 22.29])
    assert last_value(sma, f.sma(5)) == pytest.approx(22.264)
    bands = frame(spark, [20, 22, 21, 23, 24])
    got = {k: last_value(bands, c) for k, c in f.bollinger(5).items()}
    assert (got["middle"], got["upper"], got["lower"]) == pytest.approx((22, 24.82842712, 19.17157288))
    assert last_value(frame(spark, [100, 110]), f.log_return()) == pytest.approx(math.log(1.1))


def recursion(values, p, alpha):
    e = sum(values[:p]) / p
    for v in values[p:]:
        e = alpha * v + (1 - alpha) * e
    return e


def test_taps_equal_recursions():
    v = [math.sin(i) * 5 + 20 + i * 0.1 for i in range(35)]
    assert sum(a * b for a, b in zip(taps.ema_taps(12, 35), v)) == pytest.approx(recursion(v, 12, 2 / 13))
    assert sum(a * b for a, b in zip(taps.wilder_taps(14, 34), v[:34])) == pytest.approx(recursion(v[:34], 14, 1 / 14))
    lines = [recursion(v[:n], 12, 2 / 13) - recursion(v[:n], 26, 2 / 27) for n in range(26, 36)]
    hist = lines[-1] - recursion(lines, 9, 2 / 10)
    assert sum(a * b for a, b in zip(taps.macd_taps(35)[2], v)) == pytest.approx(hist)


def test_fracdiff_weights():
    assert taps.fracdiff_taps(0.0) == [1.0]
    assert taps.fracdiff_taps(1.0) == [1.0, -1.0]
    assert taps.fracdiff_taps(0.5)[:3] == [1.0, -0.5, -0.125]


def test_rsi_edges(spark):
    assert last_value(frame(spark, [5.0] * 40), f.rsi(14)) == 50.0
    assert last_value(frame(spark, range(1, 41)), f.rsi(14)) == 100.0


def test_no_feature_sees_the_future(spark):
    closes = [50 + math.sin(i) * 3 for i in range(60)]
    a = f.baseline(frame(spark, closes)).where(F.col("ts") < 50 * DAY).orderBy("ts").collect()
    closes[50:] = [c * 7 for c in closes[50:]]
    assert f.baseline(frame(spark, closes)).where(F.col("ts") < 50 * DAY).orderBy("ts").collect() == a


def test_chunks_change_nothing(spark):
    """A series with holes and a burst, cut by the number of its rows, in numbering cells smaller than it."""
    bars = frame(spark, [50 + math.sin(i) * 3 for i in range(300)])
    gone = bars.where(~F.col("ts").between(80 * DAY, 230 * DAY)).withColumn("ts", F.when(F.col("ts") > 250 * DAY, F.col("ts") + 9000 * DAY).otherwise(F.col("ts")))
    bars = gone.union(gone.withColumn("symbol", F.lit("short")).where(F.col("ts") < 40 * DAY)).withColumn("avail_ts", F.col("ts"))
    a = f.baseline(bars).orderBy("symbol", "ts").collect()
    for size, most in ((40, 50), (37, 1 << 20), (1000, 50)):
        assert f.in_chunks(bars, f.baseline, size, most=most).orderBy("symbol", "ts").collect() == a
    with pytest.raises(ValueError):
        f.in_chunks(bars, f.baseline, 34)


def test_normal_functions(spark):
    row = spark.range(1).select(quantile(F.lit(0.975)).alias("q"), cdf(F.lit(1.959963985)).alias("p")).first()
    assert row["q"] == pytest.approx(1.96, abs=2e-3) and row["p"] == pytest.approx(0.975, abs=1e-6)


def test_one_shuffle_for_the_feature_set(spark):
    plan = f.baseline(frame(spark, range(1, 60)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
