"""Remaining-useful-life labels, and the positional join of end-of-life values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_CAP, FILES, Layout


def label_train(df: DataFrame, layout: Layout = FILES, cap: int = DEFAULT_CAP, cycle: str = "cycle") -> DataFrame:
    """``df`` with rul = min(last cycle of the run - cycle, cap)."""
    return df.withColumn("rul", F.least(F.max(cycle).over(layout.runs()) - F.col(cycle), F.lit(cap)).cast("long"))


def with_ordinals(df: DataFrame, layout: Layout = FILES) -> DataFrame:
    """(run columns, ord): the rank of each unit among the units of its subset.

    One row a unit reaches the rank's sort, however long the histories are.
    """
    *group, unit = layout.run
    return df.select(*layout.run).distinct().withColumn("ord", F.row_number().over(Window.partitionBy(*group).orderBy(unit)))


def join_truth(df: DataFrame, truth: DataFrame, layout: Layout = FILES, strict: bool = False) -> DataFrame:
    """``df`` with final_rul: the i-th value goes to the i-th unit; what has no partner is left out.

    ``truth``: ord, final_rul and those run columns that it shares with ``df``.
    ``strict``: raise if the number of units and of values differ.
    """
    ranked = with_ordinals(df, layout)
    shared = [c for c in layout.run[:-1] if c in truth.columns]
    if strict:
        units, values = ranked.count(), truth.count()
        if units != values:
            raise ValueError(f"{values} end-of-life values for {units} units")
    paired = ranked.join(truth.select(*shared, "ord", "final_rul"), [*shared, "ord"]).drop("ord")
    return df.join(paired, list(layout.run))


def label_test(df: DataFrame, layout: Layout = FILES, cap: int = DEFAULT_CAP, cycle: str = "cycle") -> DataFrame:
    """``df`` (with final_rul) with rul = min(final_rul + last cycle - cycle, cap)."""
    return df.withColumn("rul", F.least(F.col("final_rul") + F.max(cycle).over(layout.runs()) - F.col(cycle), F.lit(cap)).cast("long"))


def label_breaks(df: DataFrame, layout: Layout = FILES) -> DataFrame:
    """Rows whose label is above the one before, and last rows of training runs whose label is not 0: none in sound data."""
    w = layout.window()
    marked = df.withColumn("__before", F.lag("rul").over(w)).withColumn("__after", F.lead("rul").over(w))
    return marked.where("rul > __before or (__after is null and rul <> 0)").drop("__before", "__after")


def unit_count_check(df: DataFrame, expected: DataFrame, layout: Layout = FILES) -> DataFrame:
    """Groups whose number of units differs from ``expected`` (group columns, expected)."""
    *group, unit = layout.run
    counts = df.groupBy(*group).agg(F.count_distinct(unit).alias("units"))
    return counts.join(expected, group).where("units <> expected")
