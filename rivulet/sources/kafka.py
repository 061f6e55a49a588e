"""Options of the Kafka source. Its connector is not among Spark's own jars; only options are built here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_options(servers: str, topics: list[str], start: str = "earliest", group: str | None = None) -> dict[str, str]:
    """start: earliest, latest or a JSON of offsets; it counts when there is no checkpoint, which keeps progress."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": start,
        "failOnDataLoss": "true",
    }
    return options | ({"kafka.group.id": group} if group else {})


def kafka_lines(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """The values of a topic as text."""
    stream = spark.readStream.format("kafka").options(**options).load()
    return stream.select(F.col("value").cast("string").alias("value"))
