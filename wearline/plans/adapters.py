"""The driver's tables as run-to-failure histories.

L: suppliers as units, their line items in order as cycles, four measures and a
constant as sensors.  E: users as units, their events as cycles.  Every fifth
unit is a test unit; it is cut 7 + unit % 20 rows before its end, which is then
its known remaining life.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import Layout

L_LAYOUT = Layout(run=("unit",), order=("cycle",), settings=("op_setting_1", "op_setting_2", "op_setting_3"), sensors=tuple(f"sensor_{i}" for i in range(1, 6)))
E_LAYOUT = Layout(run=("unit",), order=("cycle",), settings=(), sensors=("sensor_1", "sensor_2"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("unit"), F.row_number().over(order).cast("long").alias("cycle"),
        F.col("l_discount").alias("op_setting_1"), F.col("l_tax").alias("op_setting_2"), F.col("l_quantity").alias("op_setting_3"),
        F.col("l_quantity").alias("sensor_1"), F.col("l_extendedprice").alias("sensor_2"), F.col("l_discount").alias("sensor_3"), F.col("l_tax").alias("sensor_4"), F.lit(1.0).alias("sensor_5"),
    )


L_SQL = """l AS (
  SELECT l_suppkey AS unit, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS cycle,
    l_discount AS op_setting_1, l_tax AS op_setting_2, l_quantity AS op_setting_3,
    l_quantity AS sensor_1, l_extendedprice AS sensor_2, l_discount AS sensor_3, l_tax AS sensor_4, 1.0::DOUBLE AS sensor_5
  FROM lineitem)"""


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("unit"), F.row_number().over(order).cast("long").alias("cycle"), F.col("value").alias("sensor_1"), F.get_json_object("props", "$.k").cast("double").alias("sensor_2"))


E_SQL = """e AS (
  SELECT user_id AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle, value AS sensor_1,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS sensor_2
  FROM events)"""


def training(df: DataFrame) -> DataFrame:
    return df.where("unit % 5 <> 0")


def test(df: DataFrame) -> DataFrame:
    cut = df.where("unit % 5 = 0").withColumn("__end", F.max("cycle").over(Window.partitionBy("unit")) - (F.lit(7) + F.col("unit") % 20))
    return cut.where("cycle <= __end").drop("__end")


def truth(df: DataFrame) -> DataFrame:
    """(ord, final_rul) of the test units, in their order."""
    units = test(df).select("unit").distinct()
    return units.select(F.row_number().over(Window.orderBy("unit")).alias("ord"), (F.lit(7) + F.col("unit") % 20).cast("long").alias("final_rul"))


def split_sql(name: str) -> str:
    """CTEs tr (training rows), te (cut test rows) and truth over the CTE ``name``."""
    return f"""tr AS (SELECT * FROM {name} WHERE unit % 5 <> 0),
te0 AS (SELECT *, max(cycle) OVER (PARTITION BY unit) - (7 + unit % 20) AS e FROM {name} WHERE unit % 5 = 0),
te AS (SELECT * EXCLUDE (e) FROM te0 WHERE cycle <= e),
truth AS (SELECT row_number() OVER (ORDER BY unit) AS ord, 7 + unit % 20 AS final_rul FROM (SELECT DISTINCT unit FROM te))"""
