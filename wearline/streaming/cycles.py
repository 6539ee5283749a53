"""Readings that arrive as text: the parser as a streaming transformation.

Labels need a run's end, and trailing windows by row need its order, so both stay
batch work; a stream's part is to parse, keep the bad lines apart and store the
readings by unit for the batch plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.text import parsed


def read_cycle_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """(path, line, reason, readings) of the lines of files that arrive in ``folder``; blank lines are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).select(F.input_file_name().alias("path"), F.col("value").alias("line"))
    return parsed(lines.where(F.trim(F.regexp_replace("line", r"\s+", " ")) != ""))


def store_cycles(stream: DataFrame, good: str, bad: str, checkpoint: str):
    """Start a query that appends good readings and bad lines to two Parquet tables, each batch once."""

    def batch(df: DataFrame, epoch: int) -> None:
        # a batch that is run again replaces what its first run left
        df.where("reason is null").drop("reason", "line").write.mode("overwrite").parquet(f"{good}/epoch={epoch}")
        df.where("reason is not null").select("path", "line", "reason").write.mode("overwrite").parquet(f"{bad}/epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
