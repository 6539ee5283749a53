"""Evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the asymmetric score: decay of early and of late errors.
EARLY_SCALE, LATE_SCALE = 13.0, 10.0


def score(df: DataFrame, pred: str = "pred", true: str = "true_rul") -> DataFrame:
    """n, rmse (null without rows), phm08 (0 without rows), late and early counts; equality is late."""
    d = F.col(pred) - F.col(true)
    penalty = F.when(d < 0, F.exp(-d / EARLY_SCALE) - 1).otherwise(F.exp(d / LATE_SCALE) - 1)
    return df.agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.coalesce(F.sum(penalty), F.lit(0.0)).alias("phm08"),
        F.count_if(d >= 0).alias("late"),
        F.count_if(d < 0).alias("early"),
    )


def rmse(df: DataFrame, pred: str = "pred", true: str = "true_rul") -> float:
    """Root mean squared error; raises without rows."""
    row = score(df, pred, true).first()
    if not row["n"]:
        raise ValueError("rmse of no predictions")
    return row["rmse"]


def residuals(df: DataFrame, pred: str = "pred", true: str = "true_rul") -> DataFrame:
    """``df`` with error = pred - true and side ('late' if not below the truth, else 'early')."""
    d = F.col(pred) - F.col(true)
    return df.withColumn("error", d).withColumn("side", F.when(d >= 0, "late").otherwise("early"))


def worst(df: DataFrame, n: int = 3, pred: str = "pred", true: str = "true_rul", unit: str = "unit") -> DataFrame:
    """The ``n`` rows with the largest absolute error; ties to the lower unit."""
    return residuals(df, pred, true).orderBy(F.desc(F.abs("error")), unit).limit(n)
