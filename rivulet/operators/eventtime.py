"""Event time in replay: watermarks judged record by record, as a batch over an arrival order.

A live query fixes its watermark once a micro-batch; the replay lets it advance
with every record, so its sets of late records are exact. The watermark before a
record is the highest event time so far less the delay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.accumulators import Accumulator
from rivulet.operators.accumulate import running_accumulate
from rivulet.operators.running import WIDTH, Width, running


def with_watermark(df: DataFrame, seq: str, delay: int, ts: str = "ts", keys: list[str] | None = None,
                   width: Width = WIDTH) -> DataFrame:
    """df with wm: the watermark that stands when the record arrives; null before the first record.

    delay in seconds, not negative. keys: a watermark for each source partition.
    """
    if delay < 0:
        raise ValueError("a delay is not negative")
    got = running(df, keys or [], seq, {"__seen": ("max", F.col(ts))}, width, inclusive=False)
    return got.withColumn("wm", F.col("__seen") - F.make_dt_interval(secs=F.lit(float(delay)))).drop("__seen")


def joint_watermark(marks: list[Column]) -> Column:
    """Of several inputs the lowest; null while one has none."""
    return F.when(reduce(lambda a, b: a & b, [m.isNotNull() for m in marks]), F.least(*marks))


def lateness(df: DataFrame, size: str, allowed: int = 0, ts: str = "ts") -> DataFrame:
    """df (with wm) and its tumbling window, with fate: "on time", "again" (a firing after the first) or "late"."""
    window = F.window(ts, size)
    end = window["end"]
    discard = end + F.make_dt_interval(secs=F.lit(float(allowed)))
    fate = F.when(F.col("wm") >= discard, "late").when(F.col("wm") >= end, "again").otherwise("on time")
    return df.select("*", window["start"].alias("w_start"), end.alias("w_end"), fate.alias("fate"))


def refires(fated: DataFrame, keys: list[str], seq: str, value: str, width: Width = WIDTH) -> DataFrame:
    """What every firing after a window's first gives: for each "again" record the sum and count so far."""
    kept = fated.where(F.col("fate") != "late")
    got = running(
        kept,
        [*keys, "w_start"],
        seq,
        {"sum_so_far": ("sum", F.col(value)), "n_so_far": ("sum", F.lit(1).cast("long"))},
        width,
    )
    return got.where(F.col("fate") == "again")


def cogroup_refires(fated: DataFrame, keys: list[str], seq: str, left: Column, width: Width = WIDTH) -> DataFrame:
    """What every firing of a window co-group after its first sees: for each "again" record both sides' rows so far.

    left tells the left side's records from the right side's.
    """
    kept = fated.where(F.col("fate") != "late")
    sides = {"n_left": ("sum", left.cast("long")), "n_right": ("sum", (~left).cast("long"))}
    return running(kept, [*keys, "w_start"], seq, sides, width).where(F.col("fate") == "again")


def refires_by(fated: DataFrame, keys: list[str], seq: str, columns: list[str], acc: Accumulator,
               width: Width = WIDTH) -> DataFrame:
    """What every firing after a window's first gives by an accumulator of the user, with w_start: also of whole rows."""
    kept = fated.where(F.col("fate") != "late")
    got = running_accumulate(kept, [*keys, "w_start"], seq, columns, acc, width, carry=["fate"])
    return got.where(F.col("fate") == "again").drop("fate")


def interval_late(df: DataFrame, seq: str, side: str, delay: int, ts: str = "ts", width: Width = WIDTH) -> DataFrame:
    """Records of a two-sided stream that are late: event time before the joint watermark.

    side is the column that names the input; both inputs' records are numbered by seq together.
    """
    seen = {
        f"__{s}": ("max", F.when(F.col(side) == s, F.col(ts)))
        for s in ("left", "right")
    }
    got = running(df, [], seq, seen, width, inclusive=False)
    mark = joint_watermark([F.col(f"__{s}") for s in ("left", "right")])
    limit = mark - F.make_dt_interval(secs=F.lit(float(delay))) - F.expr("INTERVAL '0.001' SECOND")
    return got.withColumn("late", F.coalesce(F.col(ts) < limit, F.lit(False))).drop(*seen)


def idle_watermark(df: DataFrame, seq: str, partition: str, n: int, clock: str, idle: int, delay: int, ts: str = "ts",
                   width: Width = WIDTH) -> DataFrame:
    """df with wm over n source partitions: the lowest of those that gave a record in the last idle seconds.

    clock is the processing time in seconds. A partition that is silent for longer does not hold the others.
    """
    seen = {}
    for k in range(n):
        here = F.col(partition) == k
        seen[f"__last{k}"] = ("max", F.when(here, F.col(clock)))
        seen[f"__top{k}"] = ("max", F.when(here, F.col(ts)))
    got = running(df, [], seq, seen, width)
    active = [F.col(clock) - F.col(f"__last{k}") <= idle for k in range(n)]
    # a partition that has given nothing yet counts as idle
    tops = [F.when(F.coalesce(a, F.lit(False)), F.col(f"__top{k}")) for k, a in enumerate(active)]
    lowest = F.least(*tops) if n > 1 else tops[0]
    return got.withColumn("wm", lowest - F.make_dt_interval(secs=F.lit(float(delay)))).drop(*seen)
