"""Trailing-window features and raw sequences, by row position within a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_WINDOW, FILES, Layout

KINDS = ("raw", "mean", "std", "slope")


def _checked(window: int, least: int) -> None:
    if window < least:
        raise ValueError(f"window must be at least {least}, not {window}")


def rolling(sensor: str, frame, position: str, kind: str) -> Column:
    """mean, sample deviation, or least-squares slope against the row position (its origin does not matter)."""
    if kind == "raw":
        return F.col(sensor)
    if kind == "slope":
        return F.regr_slope(F.col(sensor), F.col(position)).over(frame)
    return (F.avg(sensor) if kind == "mean" else F.stddev_samp(sensor)).over(frame)


def windowed_features(df: DataFrame, window: int = DEFAULT_WINDOW, layout: Layout = FILES, sensors: Sequence[str] | None = None, kinds: Sequence[str] = KINDS, last_only: bool = False) -> DataFrame:
    """One row for each row with ``window`` rows of history: its columns and <sensor>_<kind>.

    Sensors that are not asked for are pruned before the window.  All columns
    share one sort.  ``last_only``: the last such row of each run; only the last
    ``window`` rows of a run then enter the window.
    """
    _checked(window, 2)
    sensors = list(layout.sensors if sensors is None else sensors)
    w = layout.window()
    others = [c for c in df.columns if c not in layout.sensors]
    rows = df.select(*others, *sensors)
    if last_only:
        back = Window.partitionBy(*layout.run).orderBy(*(F.desc(c) for c in layout.order))
        rows = rows.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= window)
    rows = rows.withColumn("__at", F.row_number().over(w))
    frame = w.rowsBetween(-(window - 1), 0)
    out = rows.select(*others, "__at", *(rolling(s, frame, "__at", k).alias(f"{s}_{k}") for s in sensors for k in kinds))
    return out.where(F.col("__at") >= window).drop("__at")


def feature_names(layout: Layout = FILES, excluded: Sequence[int] = (), kinds: Sequence[str] = KINDS) -> list[str]:
    """sensor_<n>_<kind> in blocks raw, mean, std, slope; settings are no features."""
    return [f"{layout.sensors[i - 1]}_{k}" for k in kinds for i in layout.kept(list(excluded))]


def sequences(df: DataFrame, window: int = DEFAULT_WINDOW, layout: Layout = FILES, sensors: Sequence[str] | None = None, last_only: bool = False) -> DataFrame:
    """run columns, order columns, rul and ``sequence``: the last ``window`` rows' sensors, oldest first, time-major."""
    _checked(window, 1)
    sensors = list(layout.sensors if sensors is None else sensors)
    w = layout.window()
    kept = [c for c in (*layout.run, *layout.order, "rul") if c in df.columns]
    rows = df.select(*dict.fromkeys(kept), F.array(*sensors).alias("__row"))
    if last_only:
        back = Window.partitionBy(*layout.run).orderBy(*(F.desc(c) for c in layout.order))
        rows = rows.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= window)
    out = rows.withColumn("__at", F.row_number().over(w)).withColumn("sequence", F.flatten(F.collect_list("__row").over(w.rowsBetween(-(window - 1), 0))))
    return out.where(F.col("__at") >= window).select(*dict.fromkeys(kept), "sequence")


def last_rows(df: DataFrame, layout: Layout = FILES) -> DataFrame:
    """The last row of each run."""
    back = Window.partitionBy(*layout.run).orderBy(*(F.desc(c) for c in layout.order))
    return df.withColumn("__back", F.row_number().over(back)).where("__back = 1").drop("__back")


def short_runs(df: DataFrame, window: int = DEFAULT_WINDOW, layout: Layout = FILES) -> DataFrame:
    """(run columns, rows) of the runs that have fewer rows than the window and so no windowed row."""
    return df.groupBy(*layout.run).agg(F.count("*").alias("rows")).where(F.col("rows") < window)


def window_count(df: DataFrame, window: int = DEFAULT_WINDOW, layout: Layout = FILES) -> DataFrame:
    """units, cycles and windowed rows, without computing a window."""
    runs = df.groupBy(*layout.run).agg(F.count("*").alias("n"))
    return runs.agg(F.count("*").alias("units"), F.coalesce(F.sum("n"), F.lit(0)).alias("cycles"), F.coalesce(F.sum(F.greatest(F.col("n") - window + 1, F.lit(0))), F.lit(0)).alias("windows"))
