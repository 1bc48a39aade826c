"""Bars, fills and orders derived from the given tables.

Times are epoch seconds (``ts`` of a bar is its end, ``avail_ts`` when it may be
used), so they compare alike in every engine and session zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c) -> F.Column:
    return F.unix_seconds(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def rollup(rows: DataFrame, width: int) -> DataFrame:
    """OHLCV bars of ``width`` seconds from (symbol, at, seq, price); map-side combined, one shuffle."""
    end = (F.floor(F.col("at") / width) + 1) * width
    bars = rows.groupBy("symbol", end.cast("long").alias("ts")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.count("*").alias("volume"),
    )
    return bars.withColumn("avail_ts", F.col("ts"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), seconds("ts").alias("at"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(ticks(spark, sf_dir).where("price > 0"), 3600)


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of all ticks, and some of them again with faults; ``row_seq`` is the order of arrival."""
    bars = rollup(ticks(spark, sf_dir), 3600)
    day = F.col("ts") % 86400
    swapped = bars.where(day == 7200).withColumn("high", F.col("low") - 1.0)
    twice = bars.where(day == 10800)
    bars = bars.withColumn("k", F.lit(0)).union(swapped.withColumn("k", F.lit(1))).union(twice.withColumn("k", F.lit(2)))
    return bars.withColumn("row_seq", F.col("ts") * 4 + F.col("k")).drop("k")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of order prices per nation, with its region as sector."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(nations(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    end = F.unix_seconds(F.add_months(F.trunc("o_orderdate", "month"), 1).cast("timestamp"))
    order = F.struct("o_orderdate", "o_orderkey")
    bars = rows.groupBy("symbol", "sector", end.alias("ts")).agg(
        F.min_by("o_totalprice", order).alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", order).alias("close"),
        F.count("*").alias("volume"),
    )
    return bars.withColumn("avail_ts", F.col("ts"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signed unit per event: bought on purchase, view and signup, sold else; fee 0.1 % of the price."""
    e = table(spark, sf_dir, "events").where("value > 0")
    side = F.when(F.col("event_type").isin("purchase", "view", "signup"), 1.0).otherwise(-1.0)
    return e.select(
        F.lit("run").alias("run_id"),
        F.col("user_id").alias("instrument"),
        seconds("ts").alias("ts"),
        F.col("event_id").alias("fill_seq"),
        side.alias("quantity"),
        F.col("value").alias("price"),
        (F.col("value") * 0.001).alias("commission"),
    )


def cost_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as orders against the monthly bar of their brand.

    The mean price is moved a little, as it often lies in the middle between two rounded ones.
    """
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        F.col("p_brand").alias("symbol"),
        F.date_format(F.trunc("l_shipdate", "month"), "yyyy-MM").alias("month"),
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        (F.col("l_linenumber") % 2 == 0).alias("is_limit"),
    )
    bars = rows.groupBy("symbol", "month").agg(
        F.max("unit").alias("high"), F.min("unit").alias("low"), F.round(F.sum(F.col("unit") * F.col("l_quantity")) / F.sum("l_quantity") + 1.234567e-9, 6).alias("close"), F.sum("l_quantity").alias("volume")
    )
    return rows.join(bars, ["symbol", "month"])
