"""Records for Kafka: key and value as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def value_record(df: DataFrame, value: Column) -> DataFrame:
    return df.select(value.cast("string").cast("binary").alias("value"))


def keyed_record(lines: DataFrame, separator: str = ",", place: int = 1) -> DataFrame:
    """The second field of a line as key, the whole line as value."""
    key = F.get(F.split("value", separator), place)
    return lines.select(key.cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))


def sink_options(servers: str, topic: str) -> dict[str, str]:
    """Delivery is at least once; readers drop repeats by the record's key."""
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def kafka_writer(records: DataFrame, options: dict[str, str]) -> DataStreamWriter | DataFrameWriter:
    """A writer of records (value, and key if there is one) to a topic: of a stream or of a batch."""
    writer = records.writeStream if records.isStreaming else records.write
    return writer.format("kafka").options(**options)
