"""Element-wise operators, splitting, merging and partitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_fields(df: DataFrame, *fields: str | Column) -> DataFrame:
    """One record to one record."""
    return df.select(*fields)


def filter_equal(df: DataFrame, value: str, field: str = "id") -> DataFrame:
    """Records whose field equals value; null never does."""
    return df.where(F.col(field) == F.lit(value))


def flat_map_cases(df: DataFrame, cases: dict[str, list[str]], field: str = "id") -> DataFrame:
    """For each record the listed columns of its case as strings, a row each; other records give none."""
    whole = F.lit(None).cast("array<string>")
    for value, columns in cases.items():
        whole = F.when(F.col(field) == value, F.array(*[F.col(c).cast("string") for c in columns])).otherwise(whole)
    return df.select("*", F.explode(whole).alias("value"))


def java_split(text: Column) -> Column:
    """Words between single spaces; trailing empty words are dropped, one of an empty text is kept."""
    blank = (text != "") & (F.trim(text) == "")
    none = F.array().cast("array<string>")
    return F.when(blank, none).otherwise(F.split(F.regexp_replace(text, " +$", ""), " "))


def tokenise(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, 1) for every word of every line."""
    return lines.select(F.explode(java_split(F.col(column))).alias("word"), F.lit(1).alias("n"))


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """Final count of each word: partial sums before the shuffle, so a frequent word is no hot key."""
    return tokenise(lines, column).groupBy("word").agg(F.sum("n").alias("n"))


def per_subtask(df: DataFrame, body: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str,
                opened: Callable[[int], None] = lambda _: None, closed: Callable[[int], None] = lambda _: None
                ) -> DataFrame:
    """map with a life cycle: opened and closed run once for each task, around all its batches."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        index = context.partitionId() if context else 0
        opened(index)
        try:
            for batch in batches:
                yield body(batch, index)
        finally:
            closed(index)

    return df.mapInPandas(run, schema)


def even_odd(df: DataFrame, field: str = "vc") -> tuple[DataFrame, DataFrame]:
    """Two filters over one frame. The remainder keeps the sign: negative odd numbers are in neither."""
    return df.where(F.col(field) % 2 == 0), df.where(F.col(field) % 2 == 1)


def route(df: DataFrame, routes: dict[str, Column], rest: str = "main", column: str = "route") -> DataFrame:
    """A column that names the first route whose condition holds, else rest: one pass for all outputs."""
    named = F.lit(rest)
    for name, condition in reversed(routes.items()):
        named = F.when(condition, F.lit(name)).otherwise(named)
    return df.withColumn(column, named)


def side_outputs(df: DataFrame, names: Iterable[str], column: str = "route") -> dict[str, DataFrame]:
    return {name: df.where(F.col(column) == name).drop(column) for name in names}


def threshold_warnings(df: DataFrame, limit: int = 10) -> DataFrame:
    """Every record, and for those above the limit a warning text."""
    routed = route(df, {"warning": F.col("vc") > limit})
    text = F.concat(F.lit("vc="), F.col("vc").cast("string"), F.lit(f" is above {limit}"))
    return routed.withColumn("warning", F.when(F.col("route") == "warning", text))


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, by name, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def connect_map(left: DataFrame, right: DataFrame, from_left: Column, from_right: Column, name: str = "value"
                ) -> DataFrame:
    """Two inputs of different types, each mapped on its own, in one output."""
    return left.select(from_left.alias(name)).unionByName(right.select(from_right.alias(name)))


def key_by(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """Rows with equal keys share a partition."""
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def custom_partition(df: DataFrame, n: int, key: Column) -> DataFrame:
    """Partition number key mod n, never negative."""
    return df.repartitionById(n, F.pmod(key.cast("int"), F.lit(n)))


def shuffle(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return df.repartition(n, F.rand(seed))


def rebalance(df: DataFrame, n: int) -> DataFrame:
    """Round robin."""
    return df.repartition(n)


def rescale(df: DataFrame, n: int) -> DataFrame:
    """Fewer partitions without a shuffle."""
    return df.coalesce(n)


def to_all(df: DataFrame, n: int) -> DataFrame:
    """Every row once for each of n subtasks, dealt by subtask."""
    copies = df.withColumn("subtask", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return copies.repartitionById(n, F.col("subtask"))


def to_one(df: DataFrame) -> DataFrame:
    """All rows in one partition: for small results alone."""
    return df.coalesce(1)
