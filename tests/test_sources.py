"""Envelopes, feature tables, training manifests, runs and catalogues as files."""

import json

import pytest
from barlake.operators import features as f
from barlake.operators import graph
from barlake.sources import io
from pyspark.sql import functions as F


def envelope(symbol, interval, values, status="ok", **meta):
    meta = {"symbol": symbol, "exchange": "X", "currency": "USD", "exchange_timezone": "America/New_York", "interval": interval, "type": "stock", **meta}
    return {"status": status, "meta": meta, "values": [dict(zip(("datetime", "open", "high", "low", "close", "volume"), v)) for v in values]}


def test_vendor_envelopes(spark, tmp_path):
    """A minute's bar ends a minute after its start, a day's at the next local midnight; text prices, other markets and future bars."""
    day = lambda d, c="2.0": (d, "1.0", "3.0", "0.5", c, "10")
    files = [
        envelope("A", "1min", [day("2024-01-02 09:31:00"), day("2024-01-02 09:30:00")]),
        envelope("B", "1day", [day("2024-03-08"), day("2024-03-11")]),
        envelope("C", "1min", [day("2024-01-02 09:30:00")], exchange="Y"),
        envelope("D", "1min", [day("2024-01-02 09:30:00")], status="error"),
    ]
    for i, x in enumerate(files):
        (tmp_path / f"{i}.json").write_text(json.dumps(x, indent=1))
    now = 1_710_129_599  # a second before the day of 11 March ends in New York's summer time
    got = io.read_envelopes(spark, str(tmp_path), {"exchange": "X"}, now, 0, 1 << 40)
    assert [(r["symbol"], r["ts"], r["close"], r["volume"]) for r in got.collect()] == [("A", 1704205860, 2.0, 10), ("A", 1704205920, 2.0, 10), ("B", 1709960400, 2.0, 10)]
    assert io.read_envelopes(spark, str(tmp_path), {"exchange": "X"}, now, 1704205900, 1704206000).count() == 1
    (tmp_path / "bad.json").write_text(json.dumps(envelope("E", "1min", [day("2024-01-02 09:30:00", "9.0")])))
    with pytest.raises(ValueError):
        io.read_envelopes(spark, str(tmp_path), {"exchange": "X"}, now, 0, 1 << 40)


def bars(spark):
    rows = [(s, 3600 * i, 3600 * i, 1.0, 2.0, 0.5, 1.0 + i % 7 / 10, i) for s in "ab" for i in range(60)]
    return spark.createDataFrame(rows, "symbol string, ts long, avail_ts long, open double, high double, low double, close double, volume long")


def test_feature_tables_are_written_once_by_set_and_version(spark, tmp_path):
    made = f.baseline(bars(spark))
    root = f"{tmp_path}/features"
    io.write_features(made, root, "baseline", 1)
    io.write_features(made, root, "baseline", 2)
    with pytest.raises(Exception):
        io.write_features(made, root, "baseline", 1)
    back = graph.read_features(spark, f"{root}/feature_set=baseline/version=2", f.baseline_registry())
    key = lambda df: sorted(tuple(r) for r in df.select(*made.columns).collect())
    assert key(back) == key(made) and spark.read.parquet(root).select("version").distinct().count() == 2
    with pytest.raises(Exception, match="no time"):
        io.write_features(made.withColumn("ts", F.lit(None).cast("long")), root, "timeless", 1)


def test_training_tables_are_held_against_their_manifest(spark):
    made = f.baseline(bars(spark)).withColumns({"target_ts": F.col("ts") + 3600, "target": F.lit(0.5)})
    rows = io.training_table(made, ["rsi_14", "sma_20"], 1, 1)
    manifest = io.training_manifest(rows, ["sma_20", "rsi_14"])
    rules = lambda df, names=("rsi_14", "sma_20"): {r["rule"] for r in io.training_differs(df, list(names), manifest).collect()}
    assert rules(rows) == rules(rows.repartition(7)) == set()
    assert rules(rows.where("timestamp > 130000")) == {"row count", "content"}
    assert rules(rows.withColumn("target", F.lit(0.25).cast("float"))) == {"content"}
    assert rules(rows, ["rsi_14"]) == {"feature columns", "content"}
    assert rules(rows.limit(0)) == {"empty", "row count", "content"}


def test_a_run_written_again_replaces_its_own(spark, tmp_path):
    root = f"{tmp_path}/runs"
    frame = lambda run, n: spark.createDataFrame([(run, i, float(i)) for i in range(n)], "run_id string, ts long, nav double")
    io.write_run({"equity": frame("a", 5), "trades": frame("a", 2)}, root)
    io.write_run({"equity": frame("b", 3), "trades": frame("b", 1)}, root)
    io.write_run({"equity": frame("a", 4), "trades": frame("a", 2)}, root)
    assert {(r["run_id"], r["count"]) for r in spark.read.parquet(f"{root}/equity").groupBy("run_id").count().collect()} == {("a", 4), ("b", 3)}
    assert io.completed_runs(spark, root).first()["completed_runs"] == 2
    assert {(r["run_id"], r["table"], r["rows"]) for r in spark.read.parquet(f"{root}/manifest").collect()} == {("a", "equity", 4), ("a", "trades", 2), ("b", "equity", 3), ("b", "trades", 1)}


def test_catalogue_lists_versions(spark, tmp_path):
    schema = "symbol string, ts long, open double, high double, low double, close double, volume long"
    for v, n in (("v2", 5), ("v1", 3)):
        io.write_version(spark.createDataFrame([("a", i, 1.0, 2.0, 0.5, 1.5, 10) for i in range(n)], schema), f"{tmp_path}/data", v)
    assert [(r["version"], r["symbol"], r["rows"]) for r in io.catalogue(spark, f"{tmp_path}/data").collect()] == [("v1", "a", 3), ("v2", "a", 5)]
