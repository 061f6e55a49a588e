"""The sensor record (id, ts, vc) and the ways to get it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENSOR = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("vc", T.IntegerType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parse_lines(lines: DataFrame, separator: str = ",", permissive: bool = False) -> DataFrame:
    """Lines "id,ts,vc" as sensor records. A malformed line fails, or gives nulls if permissive."""
    parts = F.split(F.col("value"), f"[{separator}]")
    as_type = (lambda c, t: F.get(parts, c).try_cast(t)) if permissive else (lambda c, t: parts[c].cast(t))
    return lines.select(F.get(parts, 0).alias("id"), as_type(1, "long").alias("ts"), as_type(2, "int").alias("vc"))


def with_event_time(sensors: DataFrame, column: str = "et") -> DataFrame:
    """ts in seconds as a timestamp column."""
    return sensors.withColumn(column, F.timestamp_seconds("ts"))


def sensor_view(events: DataFrame) -> DataFrame:
    """events as sensor records in arrival order: seq, id, user_id, ts, vc."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("id"),
        "user_id",
        "ts",
        F.floor("value").cast("int").alias("vc"),
    )


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000
