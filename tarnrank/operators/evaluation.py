"""Evaluation of predictions (rating, prediction): errors in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def errors(predictions: DataFrame) -> DataFrame:
    """One row: n, mse and rmse (its root)."""
    square = F.pow(F.col("rating") - F.col("prediction"), 2)
    return predictions.agg(F.count("*").alias("n"), F.avg(square).alias("mse"), F.sqrt(F.avg(square)).alias("rmse"))


def error_histogram(predictions: DataFrame) -> DataFrame:
    """bucket 0 to 4 and n: absolute errors in [0,1), [1,2), [2,3), [3,4) and from 4 on; empty ones too."""
    bucket = F.least(F.floor(F.abs(F.col("rating") - F.col("prediction"))), F.lit(4)).cast("int")
    counted = predictions.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = predictions.sparkSession.range(5).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def report(predictions: DataFrame, test: DataFrame | None = None, seconds: float | None = None) -> list[str]:
    """Lines for a console: the histogram, the errors, then pairs of ``test`` without a prediction and elapsed time where given."""
    names = [">=0 and <1", ">=1 and <2", ">=2 and <3", ">=3 and <4", ">=4"]
    rows = {r["bucket"]: r["n"] for r in error_histogram(predictions).collect()}
    total = errors(predictions).first()
    lines = [f"{name}: {rows[i]}" for i, name in enumerate(names)] + [f"MSE: {total['mse']}", f"RMSE: {total['rmse']}"]
    if test is not None:
        lines.append(f"Dropped test pairs: {dropped(test, predictions).first()['dropped']}")
    return lines + ([f"Time: {seconds:.1f} sec"] if seconds is not None else [])


def dropped(test: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: pairs of ``test`` (user, item; a set), and how many of them have no prediction."""
    pairs = test.select("user", "item").distinct()
    met = pairs.join(predictions.select("user", "item", F.lit(1).alias("met")).distinct(), ["user", "item"], "left")
    return met.agg(F.count("*").alias("pairs"), F.sum(F.when(F.col("met").isNull(), 1).otherwise(0)).alias("dropped"))
