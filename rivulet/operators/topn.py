"""Top-N: counts first, ranks of the counts after, so the shuffle carries counts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.operators.windows import time_windows


def window_top(df: DataFrame, value: str, n: int, size: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """The n most frequent values of each window with their counts; ties by the smaller value."""
    return top_counts(time_windows(df, [value], [F.count("*").alias("n")], size, slide, ts), value, n)


def top_counts(counts: DataFrame, value: str, n: int) -> DataFrame:
    """The n highest counts of each window, for counts of whole windows."""
    place = F.row_number().over(Window.partitionBy("w_start", "w_end").orderBy(F.desc("n"), value))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def table_top(df: DataFrame, keys: list[str], value: str, n: int = 2) -> DataFrame:
    """The n highest values of each key (none: of all) with their ranks; equal values fill ranks.

    The rank filter is a limit within each task before the shuffle as well, so
    that n rows of a key and task are all that one window sees.
    """
    best = Window.partitionBy(*keys).orderBy(F.desc(value))
    if keys:
        return df.select(*keys, value).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    top = df.select(value).orderBy(F.desc(value)).limit(n)
    return top.withColumn("rank", F.row_number().over(best))
