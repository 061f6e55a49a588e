"""Live streams against the replay of the same records."""

import time

import pytest
from pyspark.sql import functions as F

from rivulet.operators import joins, running, state, topn, transforms, windows
from rivulet.sinks import writers
from rivulet.sources import files, generators
from rivulet.streaming import live, processors, runtime

SCHEMA = "seq long, id string, ts timestamp, vc int"


@pytest.fixture
def folder(spark, tmp_path):
    """Sensor records in several files, in arrival order."""
    rows = [(i, f"s{i % 3}", (i * 7) % 40) for i in range(30)]
    for k in range(3):
        part = spark.createDataFrame(rows[10 * k : 10 * k + 10], "seq long, id string, vc int")
        part.withColumn("ts", F.timestamp_seconds(F.col("seq") * 2)).select("seq", "id", "ts", "vc").coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def collected(spark, df, tmp_path, name, mode="append"):
    runtime.available_now(writers.in_memory(df, name, mode), str(tmp_path / name), None)
    return spark.table(name)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(
    ("processor", "replay", "columns"),
    [
        (processors.JumpAlerts, lambda d: state.jump_alerts(d, ["id"], "seq", "vc", 10), ("seq", "prev_vc")),
        (processors.TopList, lambda d: running.running_top(d, "id", "seq", "vc"), ("seq", "top")),
        (processors.ValueCounts, lambda d: state.map_counts(d, "id", "seq", "vc"), ("seq", "n")),
        (processors.SumAndAverage, lambda d: running.running_sum(d, ["id"], "seq", "vc", "total"), ("seq", "total")),
        (processors.Changelog, lambda d: state.changelog(d, ["id"], "seq", "vc"), ("seq", "op", "total")),
    ],
)
def test_live_state_equals_replay(spark, folder, tmp_path, processor, replay, columns):
    stream = files.parquet_stream(spark, folder, SCHEMA, 1)
    got = collected(spark, processors.stateful(stream, processor()), tmp_path, processor.__name__)
    assert pairs(got, *columns) == pairs(replay(spark.read.parquet(folder)), *columns)


def test_global_window_fires_by_its_own_trigger(spark, folder, tmp_path):
    stream = files.parquet_stream(spark, folder, SCHEMA, 1)
    got = collected(spark, processors.stateful(stream, processors.GlobalWindow()), tmp_path, "global")
    want = windows.count_windows(spark.read.parquet(folder), ["id"], "seq", 4, [F.sum("vc").alias("total")])
    assert pairs(got, "id", "total") == pairs(want, "id", "total")


def polled(spark, df, tmp_path, name, n, seconds=60):
    """For state that lives by the clock: such a query never runs out of batches, so it is stopped."""
    query = writers.in_memory(df, name).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        until = time.monotonic() + seconds
        while spark.table(name).count() < n and time.monotonic() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    return spark.table(name)


def test_expiring_state(spark, folder, tmp_path):
    stream = files.parquet_stream(spark, folder, SCHEMA)
    kept = polled(spark, processors.stateful(stream, processors.Expiring(), time="processingTime"), tmp_path, "ttl", 30)
    want = [(i, None if i < 3 else ((i - 3) * 7) % 40) for i in range(30)]
    assert pairs(kept, "seq", "found") == want


def test_event_timer_fires_once(spark, folder, tmp_path):
    timed = files.parquet_stream(spark, folder, SCHEMA, 1).withWatermark("ts", "0 seconds")
    fired = polled(spark, processors.stateful(timed, processors.EventTimer(), time="eventTime"), tmp_path, "timer", 3)
    assert pairs(fired, "id") == [("s0",), ("s1",), ("s2",)]


def test_windows_with_enough_delay(spark, folder, tmp_path):
    stream = files.parquet_stream(spark, folder, SCHEMA, 1)
    got = collected(spark, live.windowed(stream, ["id"], [F.sum("vc").alias("s")], "10 seconds", delay="60 seconds"), tmp_path, "w", "complete")
    want = spark.read.parquet(folder).groupBy("id", F.window("ts", "10 seconds")).agg(F.sum("vc").alias("s"))
    assert pairs(got, "id", "s") == pairs(want, "id", "s")


def test_live_top_equals_replay(spark, tmp_path):
    """Windows whose rows come in several batches, one file each."""
    data = [(i, (i * 5) % 40 if i < 30 else 200, (i * 7) % 4) for i in range(36)]
    folder = str(tmp_path / "in")
    for k in range(0, 36, 6):
        part = spark.createDataFrame(data[k : k + 6], "seq long, s long, vc int")
        part.select("seq", F.lit("a").alias("id"), F.timestamp_seconds("s").alias("ts"), "vc").coalesce(1).write.mode("append").parquet(folder)
    found = []
    sink = live.ranked("vc", 2, lambda batch, _: found.extend(pairs(batch, "w_start", "vc", "n", "place")))
    counts = live.window_counts(files.parquet_stream(spark, folder, SCHEMA, 1), "vc", "10 seconds", delay="60 seconds")
    runtime.available_now(counts.writeStream.outputMode("append").foreachBatch(sink), str(tmp_path / "cp"))
    replay = topn.window_top(spark.read.parquet(folder), "vc", 2, "10 seconds")
    over = replay.where(F.col("w_start") < F.timestamp_seconds(F.lit(100)))
    assert found and sorted(found) == pairs(over, "w_start", "vc", "n", "place")


def test_restart_goes_on_where_it_stopped(spark, folder, tmp_path):
    def run():
        stream = files.parquet_stream(spark, folder, SCHEMA)
        sink = writers.once_per_batch(str(tmp_path / "out"))
        return runtime.available_now(stream.writeStream.foreachBatch(sink), str(tmp_path / "cp"))

    run()
    runtime.savepoint(spark, str(tmp_path / "cp"), str(tmp_path / "saved"))
    spark.createDataFrame([(99, "s9", 1)], "seq long, id string, vc int").withColumn("ts", F.timestamp_seconds("seq")).select(
        "seq", "id", "ts", "vc"
    ).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 31


def test_supervisor_gives_up_after_too_many_failures():
    class Failing:
        def awaitTermination(self):
            raise RuntimeError("lost")

    starts = []
    with pytest.raises(RuntimeError):
        runtime.supervised(lambda: starts.append(1) or Failing(), failures=3, sleep=lambda _: None)
    assert len(starts) == 4


def test_late_rows_survive_a_restart(spark, tmp_path):
    """A file a batch, with a restart after each; the replay judges whole batches by the mark before them."""
    seconds = [[10, 12, 11], [13, 3, 30], [29, 31, 19], [5, 40, 30]]
    found = {"ok": [], "late": []}

    def keep(name):
        return lambda batch, _: found[name].extend(r.s for r in batch.select("s").collect())

    for part in seconds:
        rows = spark.createDataFrame([(s,) for s in part], "s long").withColumn("ts", F.timestamp_seconds("s"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = files.parquet_stream(spark, str(tmp_path / "in"), "s long, ts timestamp", 1)
        sink = live.late_rows("ts", 5, str(tmp_path / "marks"), keep("ok"), keep("late"))
        runtime.available_now(stream.writeStream.foreachBatch(sink), str(tmp_path / "cp"))
    late, mark = [], None
    for part in seconds:
        late += [s for s in part if mark is not None and s < mark - 5]
        mark = max(part + [mark] if mark is not None else part)
    assert sorted(found["late"]) == sorted(late) == [3, 5, 19]
    assert len(found["ok"]) + len(found["late"]) == 12


def test_fan_out(spark, folder, tmp_path):
    seen = {}

    def count(name):
        return lambda batch, _: seen.__setitem__(name, seen.get(name, 0) + batch.count())

    stream = transforms.route(files.parquet_stream(spark, folder, SCHEMA, 1), {"low": F.col("vc") < 10})
    sink = writers.fan_out({"low": count("low"), "main": count("main")})
    runtime.available_now(stream.writeStream.foreachBatch(sink), str(tmp_path / "c1"))
    low = spark.read.parquet(folder).where("vc < 10").count()
    assert seen == {"low": low, "main": 30 - low}


def sides(spark, folder):
    """s0's records on the left and s1's on the right, as streams and as tables. Time 0 counts as late from the start."""
    stream, table = (d.where("seq > 0") for d in (files.parquet_stream(spark, folder, SCHEMA, 1), spark.read.parquet(folder)))
    left = lambda d: d.where("id = 's0'").select(F.lit("k").alias("k"), F.col("ts").alias("l_ts"), F.col("seq").alias("l"))
    right = lambda d: d.where("id = 's1'").select(F.lit("k").alias("k"), F.col("ts").alias("r_ts"), F.col("seq").alias("r"))
    return left(stream), right(stream), left(table), right(table)


def test_live_interval_join_equals_replay(spark, folder, tmp_path):
    a, b, left, right = sides(spark, folder)
    got = collected(spark, live.interval_join(a, b, "k", "-4 seconds", "9 seconds", "60 seconds").select("l", "r"), tmp_path, "ij")
    assert pairs(got, "l", "r") == pairs(joins.interval_join(left, right, ["k"], -4, 9), "l", "r")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_live_window_join_equals_replay(spark, folder, tmp_path, how):
    a, b, left, right = sides(spark, folder)
    got = collected(spark, live.window_join(a, b, "k", "6 seconds", "0 seconds", how).select("l", "r"), tmp_path, f"wj_{how}")
    want = joins.window_join(left.withColumnRenamed("l_ts", "ts"), right.withColumnRenamed("r_ts", "ts"), ["k"], "6 seconds", how)
    found, want = {tuple(r) for r in got.collect()}, {tuple(r) for r in want.select("l", "r").collect()}
    assert {p for p in found if None not in p} == {p for p in want if None not in p}
    # outer rows of windows that the last watermark has not passed are still to come
    assert found <= want and (how == "inner" or any(r is None for _, r in found) or not any(r is None for _, r in want))


def test_live_latest_config(spark, folder, tmp_path):
    found = []
    limits = iter([None, 7, 20])

    def config():
        limit = next(limits)
        return spark.createDataFrame([(limit,)] if limit is not None else [], "limit int")

    sink = live.with_latest(config, "limit", 3, lambda batch, _: found.extend(r.limit for r in batch.select("limit").collect()))
    stream = files.parquet_stream(spark, folder, SCHEMA, 1)
    runtime.available_now(stream.writeStream.foreachBatch(sink), str(tmp_path / "cp"))
    assert found == [3] * 10 + [7] * 10 + [20] * 10


def test_processing_timer_fires_unless_deleted(spark, tmp_path):
    folder = str(tmp_path / "in")
    part = lambda rows: spark.createDataFrame(rows, "seq long, id string, vc int").withColumn("ts", F.timestamp_seconds("seq"))
    part([(1, "a", 1), (2, "b", 1), (3, "c", -1)]).select("seq", "id", "ts", "vc").coalesce(1).write.parquet(folder)
    stream = files.parquet_stream(spark, folder, SCHEMA)
    got = polled(spark, processors.stateful(stream, processors.ProcessingTimer(), time="processingTime"), tmp_path, "ptimer", 2)
    assert pairs(got, "id") == [("a",), ("b",)]


def test_processors_see_the_watermark(spark, folder, tmp_path):
    stream = files.parquet_stream(spark, folder, SCHEMA, 1).withWatermark("ts", "0 seconds")
    got = polled(spark, processors.stateful(stream, processors.WatermarkNow(), time="eventTime"), tmp_path, "wmnow", 29)
    seen = {r.seq: r.watermark for r in got.collect()}
    assert seen[1] == 0 and seen[10] == 18_000 and seen[20] == 38_000


def test_start_from_a_savepoint(spark, folder, tmp_path):
    """The original goes on; another query starts from the savepoint and sees what came after it."""

    def run(checkpoint, out):
        stream = files.parquet_stream(spark, folder, SCHEMA)
        writer = stream.writeStream.foreachBatch(writers.once_per_batch(str(tmp_path / out)))
        return runtime.available_now(writer, str(tmp_path / checkpoint))

    run("cp", "one")
    runtime.savepoint(spark, str(tmp_path / "cp"), str(tmp_path / "saved"))
    more = spark.createDataFrame([(99, "s9", 1)], "seq long, id string, vc int").withColumn("ts", F.timestamp_seconds("seq"))
    more.select("seq", "id", "ts", "vc").coalesce(1).write.mode("append").parquet(folder)
    run("cp", "one")
    runtime.delete_checkpoint(spark, str(tmp_path / "cp"))
    assert not (tmp_path / "cp").exists()
    run("saved", "two")
    assert [r.seq for r in spark.read.parquet(str(tmp_path / "two")).collect()] == [99]


def test_jdbc_sink(spark, folder, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    options = {"url": url, "dbtable": "ws", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    sink = writers.jdbc(options)
    sink(spark.read.parquet(folder).select("id", "seq", "vc"), 0)
    assert spark.read.format("jdbc").options(**options).load().count() == 30


def test_jdbc_batches_count_once(spark, folder, tmp_path):
    options = {
        "url": f"jdbc:derby:memory:{tmp_path.name};create=true", "dbtable": "once",
        "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver",
    }
    sink = writers.jdbc(options, batch_column="batch")
    rows = spark.read.parquet(folder).select("id", "seq", "vc")
    for number in (0, 1, 1, 0):
        sink(rows.where(F.col("seq") % 2 == number), number)
    got = spark.read.format("jdbc").options(**options).load()
    assert sorted(r.seq for r in got.collect()) == list(range(30))


def test_console_tables_and_several_queries(spark, folder, tmp_path):
    stream = files.parquet_stream(spark, folder, SCHEMA, 1)
    runtime.available_now(writers.printed(stream, "> "), str(tmp_path / "c0"))
    named = [
        writers.in_memory(stream, f"many{k}").option("checkpointLocation", str(tmp_path / f"m{k}")).trigger(availableNow=True)
        for k in range(2)
    ]
    for query in runtime.run_all(named):
        query.awaitTermination()
    assert [spark.table(f"many{k}").count() for k in range(2)] == [30, 30]
    spark.createDataFrame([], "a long").write.mode("overwrite").saveAsTable("inserted")
    writers.insert_into(spark.range(3), "inserted")
    assert spark.table("inserted").count() == 3
    spark.sql("DROP TABLE inserted")


@pytest.mark.parametrize("streaming", [False, True])
def test_either_mode(spark, folder, tmp_path, streaming):
    made = runtime.either(
        lambda: spark.read.parquet(folder), lambda: files.parquet_stream(spark, folder, SCHEMA), streaming, lambda d: d.where("vc > 20")
    )
    assert made.isStreaming == streaming
    got = collected(spark, made, tmp_path, "either") if streaming else made
    assert got.count() == spark.read.parquet(folder).where("vc > 20").count()


def test_row_files_are_in_hourly_folders(spark, tmp_path):
    generators.elements(spark, [("a",)], "value string").write.text(str(tmp_path / "lines"))
    stream = files.text_stream(spark, str(tmp_path / "lines"))
    runtime.available_now(writers.row_files(stream, str(tmp_path / "rows"), str(tmp_path / "cp2")), str(tmp_path / "cp2"))
    hours = [p.name for p in (tmp_path / "rows").iterdir() if p.name.startswith("hour=")]
    assert len(hours) == 1 and len(hours[0].removeprefix("hour=")) == len("2024-01-01 00")


def test_row_files_and_generators(spark, tmp_path):
    lines = generators.elements(spark, [("a",), ("b",)], "value string")
    lines.write.text(str(tmp_path / "lines"))
    stream = files.text_stream(spark, str(tmp_path / "lines"))
    runtime.available_now(writers.row_files(stream, str(tmp_path / "rows"), str(tmp_path / "cp2")), str(tmp_path / "cp2"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "rows")).collect()) == ["a", "b"]
    assert files.as_view(lines, "named", "word").columns == ["word"]
