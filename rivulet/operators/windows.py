"""Time, session and count windows. Windows are half open and never empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from rivulet.operators.running import _CHUNK, WIDTH, Width, _chunked, measured, numbered


def bounds(window: str = "window") -> list[Column]:
    return [F.col(f"{window}.start").alias("w_start"), F.col(f"{window}.end").alias("w_end")]


def time_windows(df: DataFrame, keys: list[str], aggregates: list[Column], size: str, slide: str | None = None,
                 ts: str = "ts") -> DataFrame:
    """Incremental aggregates of tumbling or (with slide) sliding windows; no keys: over all rows."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = df.groupBy(*keys, window.alias("window")).agg(*aggregates)
    return grouped.select(*keys, *bounds(), *[c for c in grouped.columns if c not in (*keys, "window")])


def processing_time_windows(df: DataFrame, keys: list[str], aggregates: list[Column], size: str,
                            slide: str | None = None, clock: Column | None = None) -> DataFrame:
    """Tumbling or sliding windows over the time of processing. clock: a column in its place, for tests."""
    return time_windows(ingestion_time(df, "processed", clock), keys, aggregates, size, slide, ts="processed")


def ingestion_time(df: DataFrame, name: str = "ingested", clock: Column | None = None) -> DataFrame:
    """df with the time at which its batch is read: event time for records that carry none."""
    return df.withColumn(name, clock if clock is not None else F.current_timestamp())


def session_windows(df: DataFrame, keys: list[str], aggregates: list[Column], gap: str | Column,
                    ts: str = "ts", width: Width | None = None) -> DataFrame:
    """Sessions with a fixed gap, or one for each record. Sessions that touch are one.

    Times are cut into chunks of `width` microseconds (measured, if not given). Within (key, chunk) a record begins a
    session if it comes after all earlier records' gaps, those of earlier chunks included; the records are numbered by
    the sessions begun up to them. So no task has more than a chunk of a key, and a row for each of its chunks. Of
    records that are one chunk altogether Spark's own session window makes the same sessions in one pass.
    Records without a time, or whose gap is null or not positive, take no part. No name may begin with "__".
    """
    end = F.col(ts) + (F.expr(f"INTERVAL {gap}") if isinstance(gap, str) else gap)
    timed = df.select("*", F.unix_micros(F.col(ts).cast("timestamp")).alias("__at"), end.alias("__end"))
    if width is None:
        n, width = measured(timed, "__at")
        if n <= WIDTH:
            grouped = df.groupBy(*keys, F.session_window(ts, gap).alias("window")).agg(*aggregates)
            return grouped.select(*keys, *bounds(), *[c for c in grouped.columns if c not in (*keys, "window")])
    rows, plain = _chunked(timed.where(F.col("__end") > F.col(ts)), keys, "__at", width)
    inside = Window.partitionBy(*plain).orderBy("__at")
    others = [k for k in plain if k != _CHUNK]
    earlier = Window.partitionBy(*others).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)

    ends = rows.groupBy(*plain).agg(F.max("__end").alias("__last"))
    ends = ends.select(*plain, F.max("__last").over(earlier).alias("__before"))
    last = F.max("__end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    open_until = F.greatest(last, F.col("__before"))
    fresh = F.when(open_until.isNull() | (F.col(ts) > open_until), 1).otherwise(0)
    marked = rows.join(ends, plain).withColumn("__fresh", fresh.cast("long"))

    begun = marked.groupBy(*plain).agg(F.sum("__fresh").alias("__begun"))
    begun = begun.select(*plain, F.coalesce(F.sum("__begun").over(earlier), F.lit(0)).alias("__base"))
    # records of one time are in one session, whichever of them counts as its first
    number = F.sum("__fresh").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = marked.withColumn("__no", number).join(begun, plain)
    grouped = placed.groupBy(*keys, (F.col("__base") + F.col("__no")).alias("__session")).agg(
        F.min(ts).alias("w_start"), F.max("__end").alias("w_end"), *aggregates
    )
    return grouped.drop("__session")


def seconds_gap(seconds: Column) -> Column:
    return F.make_interval(secs=seconds)


def count_windows(df: DataFrame, keys: list[str], seq: str, size: int, aggregates: list[Column],
                  width: Width = WIDTH) -> DataFrame:
    """Tumbling windows of size records of a key; an incomplete one never fires."""
    placed = numbered(df, keys, seq, "__rn", width).withColumn("window_no", F.floor((F.col("__rn") - 1) / size))
    grouped = placed.groupBy(*keys, "window_no").agg(*aggregates, F.count("*").alias("__n"))
    return grouped.where(F.col("__n") == size).drop("__n")


def sliding_count_windows(df: DataFrame, keys: list[str], seq: str, size: int, slide: int, aggregates: list[Column],
                          width: Width = WIDTH) -> DataFrame:
    """Fires at every slide-th record of a key, over its last size records at most."""
    placed = numbered(df, keys, seq, "__rn", width)
    first = F.ceil(F.col("__rn") / slide) * slide
    fired = placed.withColumn(
        "fired_at", F.explode(F.filter(F.sequence(first, first + size, F.lit(slide)), lambda f: f < F.col("__rn") + size))
    )
    grouped = fired.groupBy(*keys, "fired_at").agg(*aggregates, F.max("__rn").alias("__last"))
    return grouped.where(F.col("__last") == F.col("fired_at")).drop("__last")


def elements(columns: list[str], seq: str) -> Column:
    """All records of a window in arrival order: only for full-window functions, whose result they are."""
    return F.sort_array(F.collect_list(F.struct(seq, *columns))).alias("elements")
