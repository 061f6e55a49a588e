"""Text and Parquet files, as a batch or as a stream, and sockets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def text_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None
                   ) -> DataFrame:
    """A stream over a folder of Parquet files; its schema is given, never inferred."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket: for trials alone, since a socket cannot be read again after a failure."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def as_view(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """df as a view for SQL, with its columns renamed if names are given."""
    named = df.toDF(*columns) if columns else df
    named.createOrReplaceTempView(name)
    return named


def source_watermark(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark declared where the stream is read. A timestamp without zone is taken as UTC."""
    typed = stream.withColumn(ts, stream[ts].cast("timestamp"))
    return typed.withWatermark(ts, delay)
