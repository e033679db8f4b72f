"""Rating prediction by alternating least squares, with the library's distributed solver and a fixed seed."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clamp


def fit(train: DataFrame, rank: int = 10, iterations: int = 12, regularisation: float = 0.1, seed: int = 1) -> ALSModel:
    """ids must be within 32 bits, as the solver takes them."""
    return ALS(rank=rank, maxIter=iterations, regParam=regularisation, userCol="user", itemCol="item", ratingCol="rating", coldStartStrategy="drop", seed=seed).fit(train)


def predict(model: ALSModel, test: DataFrame, clamped: bool = True) -> DataFrame:
    """user, item, rating, prediction; rows with an unknown user or item vanish."""
    scored = model.transform(test.select("user", "item", "rating")).withColumn("prediction", F.col("prediction").cast("double"))
    return scored.withColumn("prediction", clamp(F.col("prediction"))) if clamped else scored
