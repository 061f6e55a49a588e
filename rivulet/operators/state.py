"""Keyed state in replay: what a stateful operator would emit, from the arrival order alone."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.accumulators import Accumulator
from rivulet.operators.accumulate import running_accumulate
from rivulet.operators.running import WIDTH, Width, previous, running


def jump_alerts(df: DataFrame, keys: list[str], seq: str, value: str, limit: int, width: Width = WIDTH) -> DataFrame:
    """Records whose value differs from the key's previous one by more than limit; never the first."""
    got = previous(df, keys, seq, [value], width)
    return got.where(F.abs(F.col(value) - F.col(f"prev_{value}")) > limit)


def map_counts(df: DataFrame, key: str, seq: str, value: str, width: Width = WIDTH) -> DataFrame:
    """The count of each (key, value) after each of its records: the entry of the map that changed."""
    return running(df, [key, value], seq, {"n": ("sum", F.lit(1).cast("long"))}, width)


def running_average(df: DataFrame, keys: list[str], seq: str, value: str, width: Width = WIDTH) -> DataFrame:
    sums = {"__s": ("sum", F.col(value).cast("long")), "__n": ("sum", F.when(F.col(value).isNotNull(), 1).cast("long"))}
    got = running(df, keys, seq, sums, width)
    return got.withColumn("avg_so_far", F.try_divide(F.col("__s").cast("double"), F.col("__n"))).drop(*sums)


def with_ttl(df: DataFrame, keys: list[str], seq: str, value: str, clock: str, ttl: float, width: Width = WIDTH
             ) -> DataFrame:
    """The state each record finds (the previous value), null if it lay untouched for ttl or longer.

    Every record reads and writes, and both refresh, so the last access is the previous record's.
    """
    got = previous(df, keys, seq, [value, clock], width)
    fresh = F.col(clock) - F.col(f"prev_{clock}") < ttl
    return got.withColumn("state", F.when(fresh, F.col(f"prev_{value}"))).drop(f"prev_{value}", f"prev_{clock}")


def timer_firings(df: DataFrame, keys: list[str], ts: str, at: str) -> DataFrame:
    """Keys whose event-time timer, set at column `at` by any record, has fired by the end of the input.

    A timer fires once for each key and time, when the watermark (the highest event time) has passed it.
    """
    mark = df.agg(F.max(ts).alias("__mark"))
    timers = df.select(*keys, F.col(at).alias("fires_at")).distinct()
    return timers.join(F.broadcast(mark), F.col("fires_at") < F.col("__mark")).drop("__mark")


def changelog(df: DataFrame, keys: list[str], seq: str, value: str, width: Width = WIDTH) -> DataFrame:
    """The updates of sum(value) by key as a changelog: +I first, then -U with the old and +U with the new sum.

    A null value changes no sum, but it is an update; the sum is null until a value that is not.
    """
    v = F.col(value).cast("long")
    sums = {
        "__new": ("sum", v),
        "__n": ("sum", F.lit(1).cast("long")),
        "__values": ("sum", v.isNotNull().cast("long")),
    }
    got = running(df, keys, seq, sums, width)
    earlier = F.col("__values") - v.isNotNull().cast("long") > 0
    old = F.when(earlier, F.col("__new") - F.coalesce(v, F.lit(0)))
    first = F.array(F.struct(F.lit("+I").alias("op"), F.col("__new").alias("total")))
    later = F.array(
        F.struct(F.lit("-U").alias("op"), old.alias("total")),
        F.struct(F.lit("+U").alias("op"), F.col("__new").alias("total")),
    )
    return got.select(*keys, seq, F.inline(F.when(F.col("__n") > 1, later).otherwise(first)))


class _Counts(Accumulator):
    """How often each value has occurred, as entries in the order of the values."""

    def __init__(self, value: str, kind: str) -> None:
        self.value, self.schema = value, f"entries array<struct<value:{kind},n:long>>"

    def create(self) -> Counter:
        return Counter()

    def add(self, state: Counter, row: tuple) -> Counter:
        state[getattr(row, self.value)] += 1
        return state

    def merge(self, a: Counter, b: Counter) -> Counter:
        return a + b

    def result(self, state: Counter) -> tuple:
        ordered = sorted(state, key=lambda v: (v is not None, v))
        return ([{"value": v, "n": state[v]} for v in ordered],)


def map_states(df: DataFrame, key: str, seq: str, value: str, width: Width = WIDTH) -> DataFrame:
    """The whole map after each record: how often each value of the key has occurred so far, as entries by value.

    The map at the start of each (key, chunk) is what the key's earlier chunks count; null values come first.
    """
    counts = _Counts(value, df.schema[value].dataType.simpleString())
    return running_accumulate(df, [key], seq, [value], counts, width)


def running_subtask_count(df: DataFrame, subtask: str, seq: str, width: Width = WIDTH) -> DataFrame:
    """The count of its subtask after each record: what restored operator list state goes on from."""
    return running(df, [subtask], seq, {"n": ("sum", F.lit(1).cast("long"))}, width)


def per_subtask_count(df: DataFrame) -> DataFrame:
    """Exact counts of each task: what restored operator list state must add up to."""
    return df.groupBy(F.spark_partition_id().alias("subtask")).agg(F.count("*").alias("n"))
