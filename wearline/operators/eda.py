"""Summaries of runs and sensors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FILES, NEAR_CONSTANT_STD, ZERO_VARIATION, Layout


def _long(df: DataFrame, layout: Layout, columns: dict[str, str]) -> DataFrame:
    """One-row aggregate with columns <prefix><n> -> one row a sensor (1-based)."""
    structs = [F.struct(F.lit(i).alias("sensor"), *(F.col(f"{p}{i}").alias(name) for p, name in columns.items())) for i in range(1, len(layout.sensors) + 1)]
    return df.select(F.inline(F.array(*structs)))


def run_lengths(df: DataFrame, layout: Layout = FILES, cycle: str = "cycle") -> DataFrame:
    """min, mean and max over the runs' last cycles (not their numbers of rows)."""
    last = df.groupBy(*layout.run).agg(F.max(cycle).alias("last_cycle"))
    return last.agg(F.min("last_cycle").alias("min_cycles"), F.avg("last_cycle").alias("mean_cycles"), F.max("last_cycle").alias("max_cycles"))


def sensor_stats(df: DataFrame, layout: Layout = FILES) -> DataFrame:
    """(sensor, mean, std_dev): sample deviation over all rows, in one pass for all sensors."""
    parts = [x for i, s in enumerate(layout.sensors, 1) for x in (F.avg(s).alias(f"m{i}"), F.stddev_samp(s).alias(f"s{i}"))]
    return _long(df.agg(*parts), layout, {"m": "mean", "s": "std_dev"})


def near_constant(stats: DataFrame, least: float = NEAR_CONSTANT_STD) -> DataFrame:
    """(sensor) whose deviation is below ``least``."""
    return stats.where(F.col("std_dev") < least).select("sensor")


def excluded_sensors(df: DataFrame, layout: Layout = FILES) -> list[int]:
    """Near-constant sensors as a list; at most one entry a sensor reaches the driver.  Take it from raw training rows."""
    return sorted(r.sensor for r in near_constant(sensor_stats(df, layout)).collect())


def rul_correlation(df: DataFrame, layout: Layout = FILES, label: str = "rul") -> DataFrame:
    """(sensor, corr): Pearson with the label, exactly 0 where either side hardly varies."""
    y = F.col(label).cast("double")
    parts = [F.count("*").alias("n"), F.var_pop(y).alias("vy")]
    parts += [x for i, s in enumerate(layout.sensors, 1) for x in (F.var_pop(s).alias(f"v{i}"), F.covar_pop(s, y).alias(f"c{i}"))]
    one = df.agg(*parts)
    for i in range(1, len(layout.sensors) + 1):
        scale = F.sqrt(F.col(f"v{i}") * F.col("vy"))
        one = one.withColumn(f"r{i}", F.when(F.col("n") * scale < ZERO_VARIATION, F.lit(0.0)).otherwise(F.col(f"c{i}") / scale))
    return _long(one, layout, {"r": "corr"})


def top_sensors(corr: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` sensors with the largest absolute correlation; ties to the lower number; ``rank`` from 1."""
    top = corr.orderBy(F.desc(F.abs("corr")), "sensor").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("corr")), "sensor")))


def longest_run(df: DataFrame, layout: Layout = FILES, cycle: str = "cycle") -> DataFrame:
    """(run columns, last_cycle) of the longest run; ties to the highest unit."""
    last = df.groupBy(*layout.run).agg(F.max(cycle).alias("last_cycle"))
    return last.orderBy(F.desc("last_cycle"), *(F.desc(c) for c in reversed(layout.run))).limit(1)


def bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """(series, low, high, abs_high) for chart axes."""
    one = df.agg(*(x for c in columns for x in (F.min(c).cast("double").alias(f"l_{c}"), F.max(c).cast("double").alias(f"h_{c}"), F.max(F.abs(F.col(c))).cast("double").alias(f"a_{c}"))))
    return reduce(DataFrame.unionByName, (one.select(F.lit(c).alias("series"), F.col(f"l_{c}").alias("low"), F.col(f"h_{c}").alias("high"), F.col(f"a_{c}").alias("abs_high")) for c in columns))
