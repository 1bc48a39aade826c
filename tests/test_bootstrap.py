"""Paths made within a row equal those of joins and windows; plans of the bootstrap and of the minimum d."""

import math
import random

import pytest
from barlake.operators import bootstrap as bs
from barlake.operators import metrics
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def returns(spark):
    rng = random.Random(6)
    rows = [(s, i * 10, rng.uniform(-0.1, 0.1)) for s, n in (("a", 40), ("b", 7), ("c", 1)) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts long, ret double").repartition(4)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_whole_paths_have_the_same_draws(returns):
    want = {}
    for r in bs.stationary_paths(returns, 50).orderBy("step").collect():
        want.setdefault((r["symbol"], r["path"]), []).append(r["ret"])
    got = {(r["symbol"], r["path"]): r["rets"] for r in bs.whole_paths(returns, 50).collect()}
    assert got == want and len(got) == 150


def test_whole_statistics_and_bands_equal_those_by_windows(returns):
    slow, fast = bs.stationary_paths(returns, 50), bs.whole_paths(returns, 50)
    key = lambda df, *c: {tuple(r[k] for k in c): r.asDict() for r in df.collect()}
    for a, b in ((key(bs.path_statistics(slow, 252.0), "symbol", "path"), key(bs.whole_statistics(fast, 252.0), "symbol", "path")), (key(bs.nav_bands(slow, 100.0), "symbol", "step"), key(bs.whole_bands(fast, 100.0), "symbol", "step"))):
        assert a.keys() == b.keys()
        for k in a:
            assert {c: pytest.approx(v, abs=1e-12) if isinstance(v, float) else v for c, v in a[k].items()} == b[k]


def test_paths_are_dealt_once(returns):
    """One exchange gathers a series, one deals its paths; bands need one more, of the values themselves."""
    paths = bs.whole_paths(returns, 50)
    assert exchanges(paths) == exchanges(bs.whole_statistics(paths, 252.0)) == 2
    assert exchanges(bs.whole_bands(paths, 1.0)) == 3


def test_a_series_too_long_for_a_row_is_an_error(returns, monkeypatch):
    monkeypatch.setattr(bs, "LONGEST", 20)
    with pytest.raises(Exception, match="stationary_paths"):
        bs.whole_paths(returns, 2).collect()


def test_study_summary_by_hand(spark):
    """Two models: one whose returns never change, so that no draw has a Sharpe ratio."""
    rng = random.Random(1)
    rows = [("m", i, rng.uniform(-1, 1), rng.uniform(-1, 1) if i else 0.0, rng.uniform(-0.02, 0.02), 0.5) for i in range(60)]
    rows += [("flat", i, 1.0, 1.0, 0.01, 0.1) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, ts long, pred double, target double, ret double, turnover double")
    got = {r["symbol"]: r for r in bs.study_summary(df, 252.0, 100, 20).collect()}
    m = [r for r in rows if r[0] == "m"]
    mean = sum(r[4] for r in m) / 60
    dev = math.sqrt(sum((r[4] - mean) ** 2 for r in m) / 59)
    hits = [(r[2] > 0) == (r[3] > 0) for r in m if r[3] != 0]
    assert got["m"]["sharpe"] == pytest.approx(mean / dev * math.sqrt(252)) and got["m"]["hit_rate"] == pytest.approx(sum(hits) / 59)
    assert got["m"]["defined_draws"] == 100 and got["m"]["sharpe_low"] < got["m"]["sharpe"] < got["m"]["sharpe_high"]
    assert got["flat"]["defined_draws"] == 0 and got["flat"]["sharpe_low"] is None and got["flat"]["mean_turnover"] == pytest.approx(0.1)


def test_minimum_d_reads_the_bars_once(spark, tmp_path):
    rng = random.Random(2)
    rows, c = [], 100.0
    for i in range(300):
        c *= 1 + rng.uniform(-0.01, 0.01)
        rows.append(("a", i, c))
    rows += [("b", i, 10.0 + i % 5) for i in range(30)]
    spark.createDataFrame(rows, "symbol string, ts long, close double").write.parquet(f"{tmp_path}/bars")
    out = metrics.minimum_d(spark.read.parquet(f"{tmp_path}/bars"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2  # the bars, and their symbols for those without any d
    got = {r["symbol"]: (r["minimum_d"], r["window"]) for r in out.collect()}
    assert set(got) == {"a", "b"} and 0 <= got["a"][0] <= 1
