"""Rows that are made, not read: literals, counters and field generators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def elements(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    """Rows given in the program."""
    return spark.createDataFrame(list(rows), schema)


def generate(spark: SparkSession, count: int, make: Callable[[Column], Column], rate: int | None = None) -> DataFrame:
    """(n, value) for n from 0 to count - 1; with a rate, an unbounded stream of that many rows a second."""
    if rate is None:
        numbers = spark.range(count).withColumnRenamed("id", "n")
    else:
        numbers = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
        numbers = numbers.select(F.col("value").alias("n")).where(F.col("n") < count)
    return numbers.select("n", make(F.col("n")).alias("value"))


def datagen(spark: SparkSession, count: int, fields: dict[str, tuple[str, int, int, int]], rate: int | None = None
            ) -> DataFrame:
    """A table of generated fields: name -> (kind, low, high, seed).

    sequence counts from low to high and ends the rows there; random is spread over [low, high]
    by a digest of the row's number and the seed, so that a row is the same whenever it is made.
    """
    ends = [high - low + 1 for kind, low, high, _ in fields.values() if kind == "sequence"]
    rows = generate(spark, min([count, *ends]), lambda n: n, rate)

    def field(kind: str, low: int, high: int, seed: int) -> Column:
        if kind == "sequence":
            return F.col("n") + low
        digest = F.md5(F.concat_ws(":", F.col("n").cast("string"), F.lit(str(seed))).cast("binary"))
        return low + F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (high - low + 1)

    return rows.select(*[field(*spec).alias(name) for name, spec in fields.items()])
