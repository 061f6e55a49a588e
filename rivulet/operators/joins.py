"""Two-input operators."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.accumulators import Accumulator
from rivulet.model import seconds
from rivulet.operators.accumulate import processed, running_accumulate
from rivulet.operators.running import WIDTH, Width, running


def keyed_connect(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair with equal keys, once, whichever side came second."""
    return left.join(right, keys)


def window_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, how: str = "inner", ts: str = "ts"
                ) -> DataFrame:
    """Pairs of one key and one tumbling window; left and right outer too. Other columns must differ in name."""
    a = left.withColumn("window", F.window(ts, size)).drop(ts)
    b = right.withColumn("window", F.window(ts, size)).drop(ts)
    joined = a.join(b, [*keys, "window"], how)
    rest = [c for c in joined.columns if c not in (*keys, "window")]
    return joined.select(*keys, F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), *rest)


def window_cogroup(left: DataFrame, right: DataFrame, keys: list[str], size: str,
                   body: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, ts: str = "ts"
                   ) -> DataFrame:
    """Both sides' rows of a key and window go to body: for what no join expresses."""
    start = F.window(ts, size)["start"]
    a, b = (df.withColumn("w_start", start).groupBy(*keys, "w_start") for df in (left, right))
    return a.cogroup(b).applyInPandas(body, schema)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], low: float, high: float,
                  left_ts: str = "l_ts", right_ts: str = "r_ts") -> DataFrame:
    """Pairs of one key with right_ts in [left_ts + low, left_ts + high] (seconds, both ends in).

    Joined by key and time bucket: a left row asks for the buckets that its interval
    meets, so a frequent key is spread over its buckets.
    """
    size = max(high - low, 1.0)
    a = left.withColumn("__s", seconds(F.col(left_ts))).withColumn(
        "__b", F.explode(F.sequence(F.floor((F.col("__s") + low) / size), F.floor((F.col("__s") + high) / size)))
    )
    b = right.withColumn("__t", seconds(F.col(right_ts))).withColumn("__b", F.floor(F.col("__t") / size))
    apart = F.round((F.col("__t") - F.col("__s")) * 1_000_000)
    return (
        a.join(b, [*keys, "__b"])
        .where(apart.between(round(low * 1_000_000), round(high * 1_000_000)))
        .drop("__b", "__s", "__t")
    )


def broadcast_as_of(data: DataFrame, config: DataFrame, seq: str, value: str, default: int,
                    width: Width = WIDTH) -> DataFrame:
    """data with the last config value that arrived before each row, else the default. A null value sets the default."""
    kind = config.schema[value].dataType
    rows = data.withColumns({"__set": F.lit(None).cast(kind), "__config": F.lit(False)})
    sets = config.select(F.col(seq), F.col(value).alias("__set"), F.lit(True).alias("__config"))
    last = F.when(F.col("__config"), F.struct(F.col(seq).alias("at"), F.col("__set").alias("v")))
    got = running(rows.unionByName(sets, allowMissingColumns=True), [], seq, {"__last": ("max", last)}, width)
    return got.where(~F.col("__config")).select(
        *data.columns, F.coalesce(F.col("__last.v"), F.lit(default)).alias(value)
    )


class _Broadcast(Accumulator):
    """Entries of broadcast state, which config rows put and data rows read, and the last row seen."""

    def __init__(self, puts: Callable[[tuple], dict], reads: Callable[[dict, tuple], tuple], schema: str, width: int,
                 columns: list[str]) -> None:
        self.puts, self.reads, self.schema, self.width = puts, reads, schema, width
        self.record = namedtuple("Row", columns)

    def create(self) -> tuple[dict, tuple | None]:
        return {}, None

    def add(self, state: tuple, row: tuple) -> tuple:
        return ({**state[0], **self.puts(row)}, tuple(row)) if row[0] else (state[0], tuple(row))

    def merge(self, a: tuple, b: tuple) -> tuple:
        return {**a[0], **b[0]}, None

    def result(self, state: tuple) -> tuple:
        entries, row = state
        return (None,) * self.width if row[0] else self.reads(entries, self.record(*row))


def broadcast_process(data: DataFrame, config: DataFrame, seq: str, columns: list[str], puts: Callable[[tuple], dict],
                      reads: Callable[[dict, tuple], tuple], schema: str, width: Width = WIDTH) -> DataFrame:
    """A function of the user over data rows with broadcast state, which config rows write in the order of arrival.

    puts(row) gives the entries that a config row sets (None takes one out, as far as reads is concerned);
    reads(entries, row) gives the data row's tuple of `schema`. Rows are (is_config, *columns). The result has seq and
    the tuple's fields. The entries, like any broadcast state, fit a task.
    """
    sides = [df.select(seq, *columns, F.lit(flag).alias("config")) for df, flag in ((data, False), (config, True))]
    seen = ["config", *columns]
    acc = _Broadcast(puts, reads, schema, len(data.sparkSession.createDataFrame([], schema).columns), seen)
    got = running_accumulate(sides[0].unionByName(sides[1]), [], seq, seen, acc, width, carry=["config"])
    return got.where(~F.col("config")).drop("config")


def interval_process(left: DataFrame, right: DataFrame, keys: list[str], low: float, high: float, columns: list[str],
                     body: Callable[[tuple], Iterator[tuple]], schema: str) -> DataFrame:
    """What a process function of the user gives for each pair of an interval join on l_ts and r_ts."""
    return processed(interval_join(left, right, keys, low, high), columns, body, schema)


def lateral_split(df: DataFrame, words: Column, outer: bool = True) -> DataFrame:
    """Each row with every (word, length) of its words; outer keeps rows without any."""
    rows = F.transform(words, lambda w: F.struct(w.alias("word"), F.length(w).alias("length")))
    return df.select("*", (F.inline_outer if outer else F.inline)(rows))

