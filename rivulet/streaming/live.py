"""Live forms of the windowed operators: Structured Streaming with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.eventtime import idle_watermark, interval_late
from rivulet.operators.joins import broadcast_as_of
from rivulet.operators.topn import top_counts
from rivulet.streaming.runtime import delete_checkpoint


def windowed(stream: DataFrame, keys: list[str], aggregates: list[Column], size: str, slide: str | None = None,
             delay: str = "0 seconds", allowed: str | None = None, ts: str = "ts") -> DataFrame:
    """Window aggregates under a watermark. Allowed lateness is more delay: the same final values, later.

    Windows that fire again for each late row are streaming/windows.refiring_windows.
    """
    wait = f"{delay} {allowed}" if allowed else delay
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, wait)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = timed.groupBy(window.alias("window"), *keys).agg(*aggregates)
    rest = [c for c in grouped.columns if c not in (*keys, "window")]
    return grouped.select(*keys, F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), *rest)


def interval_join(left: DataFrame, right: DataFrame, key: str, low: str, high: str, delay: str) -> DataFrame:
    """Stream-stream join on (key, l_ts) and (r_key, r_ts); the watermarks bound its state."""
    a = left.withWatermark("l_ts", delay)
    b = right.withColumnRenamed(key, "r_key").withWatermark("r_ts", delay)
    near = F.expr(f"r_ts >= l_ts + INTERVAL {low} AND r_ts <= l_ts + INTERVAL {high}")
    return a.join(b, (F.col(key) == F.col("r_key")) & near).drop("r_key")


def window_join(left: DataFrame, right: DataFrame, key: str, size: str, delay: str, how: str = "inner",
                allowed: str | None = None) -> DataFrame:
    """Stream-stream join of one key and window; outer rows come once the watermark has passed the window.

    Pairs come as soon as both rows are there, as a co-group that fires again would give them. Allowed lateness is
    more delay: the same final rows, later.
    """
    delay = f"{delay} {allowed}" if allowed else delay
    a = left.withWatermark("l_ts", delay).withColumn("w", F.window("l_ts", size))
    b = right.withWatermark("r_ts", delay).withColumn("r_w", F.window("r_ts", size)).withColumnRenamed(key, "r_key")
    return a.join(b, (F.col(key) == F.col("r_key")) & (F.col("w") == F.col("r_w")), how)


def late_rows(ts: str, delay_seconds: float, marks: str, on_time: Callable[[DataFrame, int], None],
              late: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: late rows to their own sink before any operator drops them.

    The mark is the highest event time of all earlier batches. It is written under marks for each batch, so that it
    outlives a restart and a batch that is run again finds the mark that it found before.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            mark = _mark(batch, marks, number)
            is_late = F.lit(False) if mark is None else F.col(ts) < F.lit(mark) - F.make_dt_interval(
                secs=F.lit(float(delay_seconds))
            )
            on_time(kept.where(~is_late), number)
            late(kept.where(is_late), number)
            top = kept.agg(F.greatest(F.max(ts), F.lit(mark).cast("timestamp")).alias("mark"))
            top.coalesce(1).write.mode("overwrite").parquet(f"{marks}/{number}")
            _forget(batch, marks, number - 2)
        finally:
            kept.unpersist()

    return write


def _mark(batch: DataFrame, marks: str, number: int) -> object:
    """The mark that the batch before left; none before the first."""
    if number == 0:
        return None
    return batch.sparkSession.read.schema("mark timestamp").parquet(f"{marks}/{number - 1}").first()[0]


def replayed(states: str, replay: Callable[[DataFrame], DataFrame], summary: Callable[[DataFrame], DataFrame],
             sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a replay over arrival order that goes on from batch to batch, whatever the batches' sizes.

    replay keeps the rows' columns and adds its own; summary gives the few rows (of all so far) on which later ones
    depend. They are written under states for each batch and put before the next one's rows; so a batch that is run
    again, and a restart, find what the batch before has left. Earlier states are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("__new", F.lit(True))
        if number:
            kept = spark.read.schema(batch.schema).parquet(f"{states}/{number - 1}")
            rows = rows.unionByName(kept.withColumn("__new", F.lit(False)))
        rows = rows.persist()
        try:
            sink(replay(rows).where("__new").drop("__new"), number)
            summary(rows.drop("__new")).coalesce(1).write.mode("overwrite").parquet(f"{states}/{number}")
            _forget(batch, states, number - 2)
        finally:
            rows.unpersist()

    return write


def _forget(batch: DataFrame, states: str, number: int) -> None:
    """What a batch left is not needed once the next but one is done."""
    if number >= 0:
        delete_checkpoint(batch.sparkSession, f"{states}/{number}")


def _last_by(df: DataFrame, keys: list[Column], by: str) -> DataFrame:
    """Of each key the row with the highest value in a column."""
    row = F.struct(*df.columns)
    found = df.where(F.col(by).isNotNull()).groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    return found.agg(F.max_by(row, by).alias("__row")).select("__row.*")


def subtask_counts(tasks: int, states: str, sink: Callable[[DataFrame, int], None], union: bool = False
                   ) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: how many records each of `tasks` tasks has had, as list state that outlives other numbers of tasks.

    Each batch is dealt out to the tasks, and each task counts what it got. What all tasks of the batch before left is a
    list; it is split, an element to each task in turn, or with union goes whole to every task. sink gets (subtask, n).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = batch.select(F.lit(1).alias("__one")).repartition(tasks).select(F.spark_partition_id().alias("subtask"))
        rows = dealt.select("subtask", F.lit(1).cast("long").alias("n"))
        if number:
            left = spark.read.schema("subtask int, n long").parquet(f"{states}/{number - 1}")
            every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))) if union else F.col("subtask") % tasks
            rows = rows.unionByName(left.select(every.alias("subtask"), "n"))
        rows = rows.unionByName(spark.range(tasks).select(F.col("id").cast("int").alias("subtask"), F.lit(0).cast("long").alias("n")))
        counts = rows.groupBy("subtask").agg(F.sum("n").alias("n"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{states}/{number}")
        sink(spark.read.schema("subtask int, n long").parquet(f"{states}/{number}"), number)
        _forget(batch, states, number - 2)

    return write


def config_in_order(seq: str, is_config: str, value: str, name: str, default: int, states: str,
                    sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over data and config as one stream: each data row with the config that stood when it arrived.

    seq orders both; is_config tells config rows, whose value becomes the column `name`; a null value sets the default.
    """

    def replay(rows: DataFrame) -> DataFrame:
        config = rows.where(is_config).select(seq, F.col(value).alias(name))
        return broadcast_as_of(rows.where(~F.col(is_config)), config, seq, name, default)

    return replayed(states, replay, lambda rows: _last_by(rows.where(is_config), [F.lit(0)], seq), sink)


def idle_partitions(seq: str, partition: str, n: int, clock: str, idle: int, delay: int, states: str,
                    sink: Callable[[DataFrame, int], None], ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each row with wm, the watermark over n partitions of which silent ones do not hold the others.

    Kept for each partition: its highest event time, and its last clock.
    """

    def summary(rows: DataFrame) -> DataFrame:
        return _last_by(rows, [F.col(partition)], ts).union(_last_by(rows, [F.col(partition)], clock)).distinct()

    return replayed(
        states, lambda rows: idle_watermark(rows, seq, partition, n, clock, idle, delay, ts), summary, sink
    )


def joint_late(seq: str, side: str, delay: int, states: str, on_time: Callable[[DataFrame, int], None],
               late: Callable[[DataFrame, int], None], ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """For foreachBatch over both inputs of an interval join as one stream: late rows of either side to their own sink.

    The lower of both sides' marks decides for both, record by record. Kept for each side: its highest event time.
    """

    def route(rows: DataFrame, number: int) -> None:
        on_time(rows.where(~F.col("late")).drop("late"), number)
        late(rows.where("late").drop("late"), number)

    return replayed(
        states, lambda rows: interval_late(rows, seq, side, delay, ts), lambda rows: _last_by(rows, [F.col(side)], ts), route
    )


def window_counts(stream: DataFrame, value: str, size: str, slide: str | None = None, delay: str = "0 seconds",
                  ts: str = "ts") -> DataFrame:
    """The count of each value and window, for ranked. To be written in append mode: once, when the window is over."""
    return windowed(stream, [value], [F.count("*").alias("n")], size, slide, delay, ts=ts)


def ranked(value: str, n: int, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over window_counts: the Top-N of the windows that a batch finishes, ties by the smaller value.

    The watermark ends all counts of a window in one batch, so that a window is ranked once and whole.
    """
    return lambda batch, number: sink(top_counts(batch, value, n), number)


def with_latest(config: Callable[[], DataFrame], value: str, default: int, sink: Callable[[DataFrame, int], None]
                ) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch with the config value that stands when it begins (one row)."""

    def write(batch: DataFrame, number: int) -> None:
        row = config().select(value).first()
        sink(batch.withColumn(value, F.lit(row[0] if row and row[0] is not None else default)), number)

    return write
