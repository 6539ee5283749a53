"""Tables and files between jobs, in the folder that driver and executors share.

The folder is the one that the session names in ``spark.checkpoint.dir``.  Where
that is unset and the master is this machine alone, as in tests, it is a
temporary folder that goes when the process ends; on a cluster it is an error,
since executors would not see each other's files.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = f"{tempfile.gettempdir()}/wearline-{spark.sparkContext.applicationId}"
        if own not in _own:
            _own.add(own)
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    return (base if "://" in base or base.startswith("file:") else f"file://{base}").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh URI in the shared folder, below one folder for each application."""
    return f"{shared_dir(spark)}/wearline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cleared(spark: SparkSession) -> None:
    """Delete all that this application has left in the shared folder; results that are not written elsewhere go too."""
    delete(spark, f"{shared_dir(spark)}/wearline/{spark.sparkContext.applicationId}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wearline_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what :func:`stored` wrote, once nothing reads it any more."""
    for df in tables:
        delete(df.sparkSession, df._wearline_path)


def delete(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
