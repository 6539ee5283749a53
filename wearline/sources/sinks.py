"""CSV sinks with the layouts of the reference's files, and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FILES, Layout


def labelled(df: DataFrame, layout: Layout = FILES) -> DataFrame:
    """unit, cycle, settings, sensors, rul."""
    return df.select("unit", "cycle", *layout.settings, *layout.sensors, "rul")


def featured(df: DataFrame, layout: Layout = FILES) -> DataFrame:
    """unit, cycle, settings, raw, mean, std and slope of each sensor, rul."""
    kinds = [f"{s}_{kind}" for s in layout.sensors for kind in ("raw", "mean", "std", "slope")]
    return df.select("unit", "cycle", *layout.settings, *kinds, "rul")


def predictions(df: DataFrame, models: dict[str, str]) -> DataFrame:
    """unit, true_rul, pred_<name>..., error_<name>... for {name: prediction column}."""
    return df.select("unit", "true_rul", *(F.col(c).alias(f"pred_{n}") for n, c in models.items()), *((F.col(c) - F.col("true_rul")).alias(f"error_{n}") for n, c in models.items()))


def write_csv(df: DataFrame, path: str, order: tuple[str, ...] = ("unit", "cycle"), one_file: bool = False, null: str = "NA") -> None:
    """Sorted CSV with a header; ``one_file`` for small results only."""
    out = df.orderBy(*[c for c in order if c in df.columns])
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("nullValue", null).csv(path, header=True)


def prediction_path(out_dir: str, subset: str, kind: str, normalized: bool) -> str:
    """``<out_dir>/<subset>_<kind>[_normalized].csv``; the suffix keeps a normalised run from replacing a raw one."""
    return f"{out_dir.rstrip('/')}/{subset}_{kind}{'_normalized' if normalized else ''}.csv"
