"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Besides the registered queries, whose derived series are short, the same operators
run over $BENCH_COPIES copies of all symbols (10 million bars or more), some over one
symbol of a million bars, and the bootstrap over 1,000 paths of 252 steps, with rows
and rows a second of each.
"""

import json
import os
import tempfile
import time

from barlake.operators import bootstrap, features, joins, metrics, portfolio
from barlake.plans import all_queries
from barlake.sources import fixtures
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

QUERIES = (
    "w16_baseline",
    "j1_training_rows",
    "w13_fracdiff",
    "w21_cross_section_many",
    "w23_rank_normal",
    "j2_adjusted_bars",
    "j3_delivered_signals",
    "a1_performance",
    "a18_rolling_regimes",
    "a19_ks",
    "bs1_bootstrap",
    "bs3_nav_bands",
    "tc2_impact_costs",
    "lg2_ledger",
)


def copied(bars, copies: int):
    """All symbols ``copies`` times under names of their own."""
    names = bars.sparkSession.range(copies).select(F.col("id").alias("copy"))
    return bars.crossJoin(names).withColumn("symbol", F.concat_ws("-", "symbol", "copy")).drop("copy")


def scaled(bars) -> dict:
    """Name and plan of the operators over many bars."""
    curve = features.buy_and_hold(bars, 1000.0).select("symbol", "ts", F.col("benchmark_nav").alias("nav"))
    actions = bars.where("ts % 604800 = 86400").select("symbol", (F.col("ts") + 1800).alias("effective_ts"), F.lit("split").alias("kind"), F.lit(2.0).alias("amount"))
    fills = bars.select(F.lit("run").alias("run_id"), F.col("symbol").alias("instrument"), F.col("ts").alias("fill_seq"), F.when(F.col("volume") % 2 == 0, 1.0).otherwise(-1.0).alias("quantity"), F.col("close").alias("price"), F.lit(0.1).alias("commission"))
    signals = bars.where("ts % 10800 = 0").select("symbol", (F.col("ts") - 900).alias("as_of"), F.col("close").alias("value"))
    return {
        "w16_baseline_many": features.baseline(bars),
        "w13_fracdiff_many": bars.select("symbol", "ts", features.fracdiff(0.4, 1e-3, 60).alias("v")),
        "w15_full_ema_many": features.full_ema(bars, 12),
        "w23_rank_normal_many": features.rank_normal(bars.select("symbol", "ts", "close"), "close"),
        "j2_adjusted_many": joins.adjust(bars.drop("avail_ts"), actions, 1 << 40),
        "j3_delivered_many": joins.deliver(bars, signals),
        "a1_performance_many": metrics.performance(curve, 1000.0, 6048.0),
        "lg2_ledger_many": portfolio.fold_fills(fills),
    }


def one_symbol(bars, n: int):
    """The first n bars of all symbols as the bars of one, an hour apart."""
    seq = F.row_number().over(Window.orderBy("symbol", "ts"))  # one task: a single series is what is made here
    at = (seq * 3600).cast("long")
    return bars.limit(n).withColumn("_at", at).withColumns({"symbol": F.lit("one"), "ts": F.col("_at"), "avail_ts": F.col("_at")}).drop("_at")


def long_series(bars) -> dict:
    """Name and plan of the operators that cut a single long series."""
    actions = bars.where("ts % 604800 = 86400").select("symbol", (F.col("ts") + 1800).alias("effective_ts"), F.lit("dividend").alias("kind"), F.lit(0.001).alias("amount"))
    signals = bars.select("symbol", (F.col("ts") - 900).alias("as_of"), F.col("close").alias("value"))
    return {
        "w16_baseline_one_long": features.in_chunks(bars, features.baseline, 50_000, most=100_000),
        "j2_adjusted_one_long": joins.adjust(bars.drop("avail_ts"), actions, 1 << 40, most=100_000),
        "j3_delivered_one_long": joins.deliver(bars, signals, most=100_000),
    }


def main() -> None:
    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took, rows = all_queries(), {}, {}

    def timed(name: str, plan, n: int | None = None) -> None:
        began = time.time()
        plan().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        if n:
            rows[name] = n

    known[QUERIES[0]](spark, where).write.format("noop").mode("overwrite").save()  # warm-up
    bars = fixtures.hourly_bars(spark, where)
    base = bars.count()
    for name in QUERIES:
        timed(name, lambda: known[name](spark, where))
    with tempfile.TemporaryDirectory(prefix="barlake-bench-") as folder:
        copies = int(os.environ.get("BENCH_COPIES", str(-(-10_000_000 // max(base, 1)))))
        copied(bars, copies).write.parquet(f"{folder}/bars")
        many = spark.read.parquet(f"{folder}/bars")
        n = many.count()
        spark.conf.set("spark.sql.shuffle.partitions", str(8 * int(cpus)))
        for name, plan in scaled(many).items():
            timed(name, lambda: plan, n)
        one_symbol(many, 1_000_000).write.parquet(f"{folder}/one")
        one = spark.read.parquet(f"{folder}/one")
        m = one.count()
        for name, plan in long_series(one).items():
            timed(name, lambda: plan, m)
        year = many.where(F.col("symbol") == many.agg(F.min("symbol")).first()[0]).orderBy("ts").limit(252)
        returns = year.select("symbol", "ts", (F.col("close") / 1e4 - 0.005).alias("ret"))
        timed("bs1_paths_1000x252", lambda: bootstrap.whole_statistics(bootstrap.whole_paths(returns, 1000), 252.0), 252_000)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(where.rstrip("/")),
                "bars": base,
                "input_rows": rows,
                "rows_per_sec": {k: round(v / took[k]) for k, v in rows.items()},
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
