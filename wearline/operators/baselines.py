"""Linear and random-forest baselines on MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="error").transform(df)


def linear_predict(train: DataFrame, test: DataFrame, features: Sequence[str], target: str = "rul", name: str = "pred_linear") -> DataFrame:
    """``test`` with ordinary least squares predictions; null throughout if the fit fails."""
    from pyspark.ml.regression import LinearRegression

    try:
        fitted = LinearRegression(featuresCol="__features", labelCol="__label", predictionCol=name, regParam=0.0, solver="normal").fit(_assembled(train, features).withColumn("__label", F.col(target).cast("double")))
    except Exception as e:
        if "singular" not in str(e).lower():
            raise
        return test.withColumn(name, F.lit(None).cast("double"))
    return fitted.transform(_assembled(test, features)).drop("__features")


def forest_predict(train: DataFrame, test: DataFrame, features: Sequence[str], target: str = "rul", name: str = "pred_rf", trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """``test`` with random-forest predictions.  Its random draws are MLlib's own."""
    from pyspark.ml.regression import RandomForestRegressor

    fitted = RandomForestRegressor(featuresCol="__features", labelCol="__label", predictionCol=name, numTrees=trees, maxDepth=depth, seed=seed).fit(_assembled(train, features).withColumn("__label", F.col(target).cast("double")))
    return fitted.transform(_assembled(test, features)).drop("__features")
