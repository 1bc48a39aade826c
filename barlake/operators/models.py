"""Baselines and regressions per fold on ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zero(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pred", F.lit(0.0))


def flattened(rows: DataFrame, features: list[str], lookback: int) -> tuple[DataFrame, list[str]]:
    """Rows with the features of their last ``lookback`` bars as columns of their own, and these columns' names; the first rows go."""
    w = Window.partitionBy("symbol").orderBy("ts")
    names = {f"{c}_{k}": F.lag(c, k).over(w) if k else F.col(c) for c in features for k in range(lookback)}
    out = rows.withColumns(names)
    return out.where(" and ".join(f"{c}_{lookback - 1} is not null" for c in features)), list(names)


def assemble(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows)


def ridge(train: DataFrame, features: list[str], alpha: float):
    """Ridge with penalty ``alpha`` on the sum of squares.

    Spark's loss is a mean and its penalty is divided by the label's deviation, so
    the penalty is given over the rows and times the deviation.
    """
    rows = assemble(train, features)
    n, std = rows.agg(F.count("*"), F.coalesce(F.stddev_pop("target"), F.lit(1.0))).first()
    return LinearRegression(labelCol="target", regParam=alpha / max(1, n) * std, elasticNetParam=0.0, standardization=False, solver="normal").fit(rows)


def boosted(train: DataFrame, features: list[str], rounds: int = 20, depth: int = 3):
    return GBTRegressor(labelCol="target", maxIter=rounds, maxDepth=depth, seed=7).fit(assemble(train, features))


def score(model, rows: DataFrame, features: list[str], model_id: str) -> DataFrame:
    """Predictions of all rows, with the model's id."""
    out = model.transform(assemble(rows, features)).withColumn("pred", F.col("prediction"))
    return out.drop("features", "prediction").withColumn("model_id", F.lit(model_id))


def walk(rows: DataFrame, fit, features: list[str], model_id: str, folds: list[int]) -> DataFrame:
    """Out-of-sample predictions of every fold; ``rows`` as of walk_forward with ``target``.

    Features are scaled by the means and deviations of each fold's training rows.
    """
    from .splits import fit_scaler, scale

    out = None
    for k in folds:
        train, test = (rows.where((F.col("fold") == k) & (F.col("role") == r)) for r in ("train", "test"))
        scaler = fit_scaler(train, features)
        model = fit(scale(train, scaler, features))
        part = score(model, scale(test, scaler, features), features, model_id)
        out = part if out is None else out.unionByName(part)
    return out


def trial_grid(spark, candidates: list[str], symbols: DataFrame, folds: int, seeds: list[int]) -> DataFrame:
    """Every (candidate, symbol, fold, seed) of a study, each with its trial id."""
    one = spark.range(1).select(
        F.explode(F.array(*map(F.lit, candidates))).alias("candidate"), F.lit(0).alias("_")
    ).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    grid = symbols.select("symbol").distinct().withColumn("_", F.lit(0)).join(F.broadcast(one), "_").drop("_")
    return grid.withColumn("trial_id", F.sha2(F.concat_ws(":", "candidate", "symbol", "fold", "seed"), 256))


def record(trials: DataFrame, state: str, ledger: str) -> None:
    """Append a state (started, completed, failed) of trials to the ledger."""
    if state not in ("started", "completed", "failed"):
        raise ValueError("not a state of a trial")
    trials.select("trial_id").withColumns({"state": F.lit(state), "at": F.current_timestamp()}).write.mode("append").parquet(ledger)


def open_trials(grid: DataFrame, ledger: DataFrame, attempts: int) -> DataFrame:
    """Trials that aren't completed and were started fewer than ``attempts`` times."""
    seen = ledger.groupBy("trial_id").agg(F.count_if(F.col("state") == "started").alias("tries"), F.max((F.col("state") == "completed").cast("int")).alias("done"))
    return grid.join(seen, "trial_id", "left").where(f"coalesce(done, 0) = 0 and coalesce(tries, 0) < {int(attempts)}").drop("tries", "done")
