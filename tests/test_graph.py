"""The feature compiler and scans in cells."""

import random

import pytest
from barlake.operators import features as f
from barlake.operators import graph, joins, ordered
from pyspark.sql import functions as F


def bars(spark, n, symbols="ab"):
    rng = random.Random(3)
    rows, at = [], 1_700_000_000
    for s in symbols:
        close = 50.0
        for i in range(n):
            close *= 1 + rng.uniform(-0.02, 0.02)
            at += 3600 * rng.choice([1, 1, 1, 30])
            rows.append((s, at, at + 5, close, close * 1.01, close * 0.99, close, i))
    return spark.createDataFrame(rows, "symbol string, ts long, avail_ts long, open double, high double, low double, close double, volume long")


def specs(**over):
    known = graph.FeatureRegistry()
    for s in (
        graph.FeatureSpec("change", 1, 2, ("close",), lambda p: p("close") - p("close", 1), helper=True),
        graph.FeatureSpec("mean_change", 2, 5, ("change",), lambda p: p.frame("avg", "change", 5), offset=60),
        graph.FeatureSpec("twice", 1, 3, ("mean_change", "close"), lambda p: p("mean_change", 2) * 2 + p("close")),
    ):
        known.add(s)
    return known


def test_levels_lookbacks_and_offsets(spark):
    known = specs()
    assert [s.name for s in known.needed(["twice"])] == ["change", "mean_change", "twice"]
    assert graph.depth(known.needed(["twice"])) == {"change": (0, 2, 0), "mean_change": (1, 6, 60), "twice": (2, 8, 60)}
    rows = bars(spark, 30)
    got = graph.compile_features(rows, ["twice", "mean_change"], known).orderBy("symbol", "ts").collect()
    want = []
    for s in "ab":
        r = rows.where(F.col("symbol") == s).orderBy("ts").collect()
        c = [x["close"] for x in r]
        mean = lambda i: (c[i] - c[i - 5]) / 5
        want += [(s, r[i]["avail_ts"] + 60, mean(i - 2) * 2 + c[i], mean(i)) for i in range(7, 30)]
    assert [(r["symbol"], r["ts"]) for r in got] == [w[:2] for w in want]
    assert [x for r in got for x in (r["twice"], r["mean_change"])] == pytest.approx([x for w in want for x in w[2:]])


def test_one_exchange_and_one_sort_over_all_levels(spark):
    plan = graph.compile_features(bars(spark, 30), ["twice"], specs())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    plan = f.baseline(bars(spark, 60))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_baseline_methods_are_small_enough_for_the_jvm(spark):
    """Methods above 8000 bytes of bytecode are never compiled to machine code."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = f.baseline(bars(spark, 60).drop("volume"))._jdf.queryExecution().executedPlan()
        stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length())]
    assert sizes and max(sizes) < 8000, sizes


def test_a_row_with_a_missing_value_in_reach_goes(spark):
    rows = bars(spark, 80, "a").withColumn("close", F.when(F.col("volume") == 40, None).otherwise(F.col("close")))
    at = [r["n"] for r in f.compile_features(rows.withColumn("n", F.col("volume").cast("double")), f.BASELINE, f.baseline_registry(), keep=("n",)).collect()]
    assert sorted(at) == [34.0, 35.0, 36.0, 37.0, 38.0, 39.0, 75.0, 76.0, 77.0, 78.0, 79.0]


def test_faulty_specifications_are_refused(spark):
    known = specs()
    with pytest.raises(ValueError, match="registered as"):
        known.add(graph.FeatureSpec("change", 2, 2, ("close",), lambda p: p("close")))
    known["change"] = graph.FeatureSpec("change", 1, 2, ("twice",), lambda p: p("twice"))
    with pytest.raises(ValueError, match="look at each other"):
        known.needed(["twice"])
    with pytest.raises(ValueError, match="no such columns"):
        graph.compile_features(bars(spark, 5).drop("high"), f.BASELINE, f.baseline_registry())


def test_stored_versions_are_checked_on_read(spark, tmp_path):
    path = f"{tmp_path}/features"
    f.baseline(bars(spark, 60)).write.parquet(path)
    known = f.baseline_registry()
    back = graph.read_features(spark, path, known)
    assert graph.stored_ids(back) == {n: f"{n}@v1" for n in f.BASELINE} and back.schema["rsi_14"].metadata["lookback"] == 35
    known["rsi_14"] = graph.FeatureSpec("rsi_14", 2, 35, ("close",), known["rsi_14"].expr)
    with pytest.raises(ValueError, match="rsi_14@v1"):
        graph.read_features(spark, path, known)


def test_numbers_do_not_depend_on_cells(spark):
    rows = bars(spark, 500, "abc").where("symbol <> 'c' or volume < 3")
    want = {(r["symbol"], r["ts"]): r["volume"] for r in rows.collect()}
    for most in (1, 7, 100, 1 << 20):
        got = ordered.numbered(rows, "symbol", "ts", most).collect()
        assert {(r["symbol"], r["ts"]): r["_n"] for r in got} == want


def brute_delivery(times, signals):
    out = {}
    for k, v, seq in signals:
        later = [t for t in times[1:] if t > k]
        if later:
            out.setdefault(later[0], []).append((k, seq, v))
    return {t: max(s)[::2] for t, s in out.items()}


@pytest.mark.parametrize("most", [3, 50, 1 << 20])
def test_delivery_in_cells_equals_brute_force(spark, most):
    rng = random.Random(most)
    times = sorted(rng.sample(range(10_000), 200))
    signals = [(rng.choice(times) + rng.choice([-1, 0, 0, 1]) if rng.random() < 0.7 else rng.randrange(10_100), float(i), i) for i in range(300)]
    b = spark.createDataFrame([("a", t) for t in times] + [("b", 5)], "symbol string, ts long")
    s = spark.createDataFrame([("a", *x) for x in signals] + [("b", 1, 0.0, 0), ("c", 1, 0.0, 0)], "symbol string, as_of long, v double, seq long")
    got = {r["ts"]: (r["as_of"], r["v"]) for r in joins.deliver(b, s, seq="seq", most=most).collect()}
    assert got == brute_delivery(times, signals)


@pytest.mark.parametrize("most", [4, 60, 1 << 20])
def test_adjustment_in_cells_equals_brute_force(spark, most):
    rng = random.Random(most)
    rows = bars(spark, 120, "ab")
    times = [r["ts"] for r in rows.where("symbol = 'a'").orderBy("ts").collect()]
    news = [("a", rng.choice(times) + rng.choice([0, 0, 1800]), k, amount) for k, amount in [("split", 2.0), ("split", 0.5), ("dividend", 0.25), ("dividend", 0.1)] * 6] + [("a", max(times) + 10**9, "split", 100.0)]
    end = max(times) + 10
    got = {(r["symbol"], r["ts"]): r for r in joins.adjust(rows.drop("avail_ts"), spark.createDataFrame(news, "symbol string, effective_ts long, kind string, amount double"), end, most).collect()}
    for r in rows.collect():
        factor, paid = 1.0, 0.0
        for s, at, kind, amount in news:
            if s == r["symbol"] and r["ts"] < at <= end:
                factor, paid = (factor / amount, paid) if kind == "split" else (factor, paid + amount)
        g = got[r["symbol"], r["ts"]]
        assert g["close"] == pytest.approx(r["close"] * factor - paid) and g["volume"] == pytest.approx(r["volume"] / factor, abs=0.51)
    with pytest.raises(Exception, match="positive"):
        joins.adjust(rows.drop("avail_ts"), spark.createDataFrame([("a", 1 << 33, "split", 0.0)], "symbol string, effective_ts long, kind string, amount double"), 1 << 40, most).collect()


def test_scans_are_linear(spark):
    """No frame reaches to the end of its partition, so no row looks at all later ones."""
    rows = bars(spark, 10)
    news = spark.createDataFrame([("a", 1, "split", 2.0)], "symbol string, effective_ts long, kind string, amount double")
    signals = rows.select("symbol", F.col("ts").alias("as_of"), F.col("close").alias("v"))
    for df in (joins.adjust(rows, news, 1 << 40), joins.deliver(rows, signals)):
        assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString()
