"""Chronological splits with purge and embargo, fold timelines and train-only scaling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame) -> DataFrame:
    """``idx`` from 0 in order of time, and ``n``, per symbol."""
    w = Window.partitionBy("symbol")
    return rows.withColumns({"idx": F.row_number().over(w.orderBy("ts")) - 1, "n": F.count("*").over(w)})


def holdout(rows: DataFrame, purge: int, embargo: int, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Rows with role train, val, test, or null in the gaps between them."""
    n, i = F.col("n"), F.col("idx")
    nt, nv = F.floor(n * train), F.floor(n * val)
    start = nt + embargo
    stop = F.least(F.greatest(start + 1, nt + nv - purge), n)
    role = (
        F.when(i < F.greatest(nt - purge, F.lit(1)), "train").when((start < n) & (start < stop) & (i >= start) & (i < stop), "val").when(i >= nt + nv + embargo, "test")
    )
    return numbered(rows).withColumn("role", role)


def fold_bounds(n: Column, k: int, purge: int, embargo: int, test_size: int | None = None, train_size: int | None = None, expanding: bool = True) -> Column:
    """An array of (fold, train_start, train_end, test_start, test_end), without degenerate folds."""
    test = F.lit(test_size) if test_size else F.floor(n / (k + 1))
    length = F.lit(train_size) if train_size else 2 * test

    def fold(i: Column) -> Column:
        at = n - (k - i) * test
        end = at - purge - embargo
        begin = F.lit(0) if expanding else F.greatest(end - length, F.lit(0))
        return F.struct(i.alias("fold"), begin.cast("long").alias("train_start"), end.cast("long").alias("train_end"), at.cast("long").alias("test_start"), (at + test).cast("long").alias("test_end"))

    folds = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), fold)
    return F.filter(folds, lambda x: (x["test_start"] > purge) & (x["train_end"] > x["train_start"]) & (x["test_end"] > x["test_start"]))


def walk_forward(rows: DataFrame, k: int, purge: int, embargo: int, **how) -> DataFrame:
    """Rows of each fold's train and test, once for each fold that they belong to."""
    out = numbered(rows).withColumn("f", F.explode(fold_bounds(F.col("n"), k, purge, embargo, **how))).select("*", "f.*").drop("f")
    role = F.when(F.col("idx").between(F.col("train_start"), F.col("train_end") - 1), "train").when(F.col("idx").between(F.col("test_start"), F.col("test_end") - 1), "test")
    return out.withColumn("role", role).where("role is not null")


def inner(rows: DataFrame, purge: int, embargo: int, share: float = 0.85) -> DataFrame:
    """The development rows of each (symbol, fold) as inner train and val."""
    w = Window.partitionBy("symbol", "fold")
    i, n = F.row_number().over(w.orderBy("ts")) - 1, F.count("*").over(w)
    rows = rows.withColumns({"_i": i, "_n": n})
    b = F.floor(F.col("_n") * share)
    role = F.when(F.col("_i") < F.greatest(b - purge, F.lit(0)), "train").when(F.col("_i") >= b + embargo, "val")
    return rows.withColumn("inner_role", role).drop("_i", "_n")


def calendar_folds(rows: DataFrame, cuts: tuple[int | Column, ...], purge: int, embargo: int) -> DataFrame:
    """Rows of train, val and test between the calendar times ``cuts``, which end them.

    Train and val end ``purge`` rows early, val and test begin ``embargo`` rows late;
    test rows whose label isn't known before the end go.  ``rows(symbol, ts, target_ts)``.
    """
    rows = numbered(rows)
    every = Window.partitionBy("symbol")
    rows = rows.withColumns({f"_c{i}": F.count_if(F.col("ts") < c).over(every) for i, c in enumerate(cuts)})
    i, a, b, c = F.col("idx"), F.col("_c0"), F.col("_c1"), F.col("_c2")
    role = (
        F.when(i < F.greatest(a - purge, F.lit(0)), "train")
        .when((i >= a + embargo) & (i < F.greatest(a + embargo, b - purge)), "val")
        .when((i >= b + embargo) & (i < c) & (F.col("target_ts") < cuts[2]), "test")
    )
    return rows.withColumn("role", role).where("role is not null").drop("_c0", "_c1", "_c2")


def calendar_faults(folds: DataFrame, symbols: DataFrame, least: int) -> DataFrame:
    """``(symbol, rule)``: too few rows in a role, or labels of one that reach into the next; ``folds`` as of :func:`calendar_folds`."""
    of = lambda r, c: F.when(F.col("role") == r, F.col(c))
    s = folds.groupBy("symbol").agg(
        *(F.count(of(r, "ts")).alias(r) for r in ("train", "val", "test")), *(F.max_by(of(r, "target_ts"), of(r, "ts")).alias(f"{r}_end") for r in ("train", "val")), *(F.min(of(r, "ts")).alias(f"{r}_from") for r in ("val", "test"))
    )
    s = symbols.select("symbol").distinct().join(s, "symbol", "left").na.fill(0, ["train", "val", "test"])
    rules = {"coverage": F.least("train", "val", "test") < least, "overlap": F.coalesce((F.col("train_end") >= F.col("val_from")) | (F.col("val_end") >= F.col("test_from")), F.lit(False))}
    return s.select("symbol", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))


def timeline(rows: DataFrame) -> DataFrame:
    """Segments per symbol, roles and the gaps after them, with bounds in rows and time; ``rows`` as of :func:`holdout`."""
    roles = rows.where("role is not null").groupBy("symbol", "role").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))
    ahead = F.lead("first").over(Window.partitionBy("symbol").orderBy("first"))
    gaps = roles.withColumn("nxt", ahead).where("nxt > last + 1").select("symbol", F.concat(F.lit("gap after "), F.col("role")).alias("role"), (F.col("last") + 1).alias("first"), (F.col("nxt") - 1).alias("last"))
    at = rows.select(F.col("symbol").alias("_s"), "idx", "ts")
    a = gaps.join(at, (gaps["symbol"] == at["_s"]) & (gaps["first"] == at["idx"])).select("symbol", "role", "first", "last", F.col("ts").alias("from_ts"))
    z = at.withColumnRenamed("idx", "_i").withColumnRenamed("ts", "to_ts")
    both = a.join(z, (a["symbol"] == z["_s"]) & (a["last"] == z["_i"])).select("symbol", "role", "first", "last", "from_ts", "to_ts")
    return roles.unionByName(both)


def fit_scaler(train: DataFrame, features: list[str], floor: float = 1e-8) -> DataFrame:
    """One row of means and population deviations; a deviation below ``floor`` becomes 1."""
    std = lambda c: F.when(F.stddev_pop(c) < floor, 1.0).otherwise(F.stddev_pop(c))
    return train.agg(*(F.avg(c).alias(f"{c}_mean") for c in features), *(std(c).alias(f"{c}_std") for c in features))


def scale(rows: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    done: Mapping[str, Column] = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in features}
    return rows.join(F.broadcast(scaler)).withColumns(done).drop(*(f"{c}_{k}" for c in features for k in ("mean", "std")))
