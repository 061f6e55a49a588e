"""Windows that fire again, sessions, count windows, two inputs and ordered state, live against the replay."""

import os
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rivulet.functions import accumulators
from rivulet.operators import eventtime, joins, running, windows
from rivulet.sinks import writers
from rivulet.sources import files
from rivulet.streaming import live, runtime
from rivulet.streaming import windows as live_windows

SCHEMA = "seq long, id string, ts timestamp, vc int"
SUMS = accumulators.SumAndCount("vc")


def batches(folder, parts, start=0):
    """A file for each part, in order of time; a part is rows of (seq, id, seconds, vc, ...)."""
    os.makedirs(folder, exist_ok=True)
    for k, part in enumerate(parts, start):
        at = [datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=r[2]) for r in part]
        columns = {
            "seq": pa.array([r[0] for r in part], pa.int64()),
            "id": pa.array([r[1] for r in part], pa.string()),
            "ts": pa.array(at, pa.timestamp("us", tz="UTC")),
            "vc": pa.array([r[3] for r in part], pa.int32()),
        }
        path = f"{folder}/part-{k:05d}.parquet"
        pq.write_table(pa.table(columns), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))


def ran(spark, stream, tmp_path, name="out"):
    """What a query gives until its input is used up; a second run goes on from the first's checkpoint."""
    sink = writers.once_per_batch(str(tmp_path / name))
    runtime.available_now(stream.writeStream.foreachBatch(sink), str(tmp_path / f"{name}-cp"))
    return spark.read.parquet(str(tmp_path / name))


def streamed(spark, folder, per_batch=1):
    return files.parquet_stream(spark, folder, SCHEMA, per_batch)


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


#: seconds and keys in arrival order: windows [0,10), [10,20), ... with lateness of 5 s
ARRIVALS = [(1, "a"), (4, "b"), (9, "a"), (12, "a"), (3, "a"), (8, "b"), (16, "b"), (2, "a"), (11, "a"), (24, "a"), (13, "b"), (19, "a"), (41, "b"), (22, "a")]


def arrivals():
    return [[(k, key, s, None if k == 4 else k)] for k, (s, key) in enumerate(ARRIVALS)]


def test_windows_fire_again_as_the_replay(spark, tmp_path):
    folder = str(tmp_path / "in")
    batches(folder, arrivals())
    got = ran(spark, live_windows.refiring_windows(streamed(spark, folder), "id", SUMS, ["vc"], 10, 0, 5), tmp_path)
    marked = eventtime.with_watermark(spark.read.parquet(folder), "seq", 0)
    fated = eventtime.lateness(marked, "10 seconds", 5)
    again = eventtime.refires(fated, ["id"], "seq", "vc")
    assert again.count() >= 3 and fated.where("fate = 'late'").count() >= 2
    assert tuples(got.where("kind = 'again'"), "seq", "id", "w_start", "sum_vc", "n") == tuples(
        again, "seq", "id", "w_start", "sum_so_far", "n_so_far"
    )
    assert tuples(got.where("kind = 'late'"), "seq", "w_start") == tuples(fated.where("fate = 'late'"), "seq", "w_start")
    first = fated.where("fate = 'on time'").groupBy("id", "w_start", "w_end").agg(F.sum("vc").alias("s"), F.count("*").alias("n"))
    over = first.where(F.col("w_end") <= F.timestamp_seconds(F.lit(41)))
    assert tuples(got.where("kind = 'fire'"), "id", "w_start", "sum_vc", "n") == tuples(over, "id", "w_start", "s", "n")


def test_cogroup_fires_again_with_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    batches(folder, arrivals())
    side = F.when(F.col("seq") % 3 == 0, "left").otherwise("right")

    def body(left, right):
        yield len(left), len(right), ",".join(str(r.seq_of) for r in sorted([*left, *right]))

    stream = streamed(spark, folder).withColumns({"side": side, "seq_of": F.col("seq")})
    schema = "n_left long, n_right long, seqs string"
    got = ran(spark, live_windows.refiring_cogroup(stream, "id", body, schema, ["seq_of"], 10, 0, 5), tmp_path)
    fated = eventtime.lateness(eventtime.with_watermark(spark.read.parquet(folder), "seq", 0), "10 seconds", 5)
    want = eventtime.cogroup_refires(fated.withColumn("side", side), ["id"], "seq", F.col("side") == "left")
    assert tuples(got.where("kind = 'again'"), "seq", "id", "n_left", "n_right") == tuples(want, "seq", "id", "n_left", "n_right")
    kept = [(r.seq, r.id, r.w_start) for r in fated.where("fate <> 'late'").collect()]
    for r in got.where("kind = 'again'").collect():
        assert r.seqs == ",".join(str(s) for s, key, w in sorted(kept) if key == r.id and w == r.w_start and s <= r.seq)


@pytest.mark.parametrize("dynamic", [False, True])
def test_live_sessions_equal_the_replay(spark, tmp_path, dynamic):
    """Records that bridge two sessions come late, in another batch; the last one closes all."""
    folder = str(tmp_path / "in")
    rows = [(1, "a", 0, 3), (2, "a", 20, 1), (3, "b", 2, 9), (4, "a", 11, 5), (5, "b", 40, 4), (6, "a", 55, 2), (7, "b", 33, 12), (8, "a", 46, 9)]
    batches(folder, [rows[:3], rows[3:5], rows[5:7], rows[7:], [(9, "z", 500, 1)], [(10, "z", 900, 1)]])
    gap = F.col("vc") + 6 if dynamic else 9
    got = ran(spark, live_windows.sessions(streamed(spark, folder), "id", SUMS, ["vc"], gap, delay=60), tmp_path)
    seconds = windows.seconds_gap((F.col("vc") + 6).cast("decimal(18,6)")) if dynamic else "9 seconds"
    want = windows.session_windows(
        spark.read.parquet(folder), ["id"], [F.sum("vc").alias("s"), F.count("*").alias("n")], seconds
    ).where("id <> 'z' OR w_start < TIMESTAMP '1970-01-01 00:10:00'")
    assert {r.kind for r in got.collect()} == {"fire"}
    assert tuples(got, "id", "w_start", "w_end", "sum_vc", "n") == tuples(want, "id", "w_start", "w_end", "s", "n")


def test_live_sessions_fire_again_and_drop(spark, tmp_path):
    folder = str(tmp_path / "in")
    batches(folder, [[(1, "a", 0, 1)], [(2, "a", 20, 1)], [(3, "a", 3, 1)], [(4, "a", 40, 1)], [(5, "a", 2, 1)], [(6, "a", 90, 1)]])
    got = ran(spark, live_windows.sessions(streamed(spark, folder), "id", SUMS, ["vc"], 5, allowed=17), tmp_path)
    found = [(r.seq, r.kind, r.n) for r in sorted(got.collect(), key=lambda r: (r.w_start, r.n or 9))]
    # [0, 5) fires when 20 has come; 3 stretches it to [0, 8), over by then; 2 comes after it is discarded
    assert (None, "fire", 1) in found and (3, "again", 2) in found and (5, "late", None) in found


@pytest.mark.parametrize(("size", "slide"), [(4, None), (5, 2), (2, 3)])
def test_live_count_windows_equal_the_replay(spark, tmp_path, size, slide):
    folder = str(tmp_path / "in")
    rows = [(k, f"s{k * k % 3}", k, k * 7 % 11) for k in range(40)]
    batches(folder, [rows[:7], rows[7:9], rows[9:30], rows[30:]])
    got = ran(spark, live_windows.count_windows(streamed(spark, folder), "id", SUMS, ["vc"], size, slide), tmp_path)
    table, aggregates = spark.read.parquet(folder), [F.sum("vc").alias("s"), F.count("*").alias("n")]
    if slide:
        want = windows.sliding_count_windows(table, ["id"], "seq", size, slide, aggregates)
        assert tuples(got, "id", "fired_at", "sum_vc", "n") == tuples(want, "id", "fired_at", "s", "n")
    else:
        want = windows.count_windows(table, ["id"], "seq", size, aggregates)
        at = ((F.col("window_no") + 1) * size).cast("long").alias("fired_at")
        assert tuples(got, "id", "fired_at", "sum_vc") == tuples(want.select("id", at, "s"), "id", "fired_at", "s")


def test_two_inputs_pair_once_across_a_restart(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(k, f"s{k % 2}", k, k % 3) for k in range(20)]

    def once():
        stream = streamed(spark, folder)
        left = stream.where("vc = 0").select("id", "seq", F.col("seq").alias("l"))
        right = streamed(spark, folder).where("vc <> 0").select("id", "seq", F.col("seq").alias("r"))
        return ran(spark, live_windows.connected(left, right, "id", live_windows.Pairs("id string, l long, r long", ["l"], ["r"])), tmp_path)

    batches(folder, [rows[:8], rows[8:11]])
    once()
    batches(folder, [rows[11:]], start=2)
    got = once()
    want = [(a[1], a[0], b[0]) for a in rows for b in rows if a[3] == 0 and b[3] != 0 and a[1] == b[1]]
    assert tuples(got, "id", "l", "r") == sorted(want, key=str)


def in_batches(spark, tmp_path, rows, sizes, sink_of):
    """Runs a foreachBatch function over rows in batches of the given sizes, with a restart after each."""
    folder, found, at = str(tmp_path / "in"), [], 0
    for k, size in enumerate(sizes):
        batches(folder, [rows[at : at + size]], start=k)
        at += size
        write = sink_of(lambda batch, _: found.extend(batch.collect()))
        runtime.available_now(streamed(spark, folder).writeStream.foreachBatch(write), str(tmp_path / "cp"))
    assert at == len(rows)
    return found, spark.read.parquet(folder)


@pytest.mark.parametrize("sizes", [[1] * 6 + [6], [5, 7], [12]])
def test_config_in_order_equals_the_replay(spark, tmp_path, sizes):
    rows = [(k, "cfg" if k in (3, 6, 8) else "data", k, None if k == 8 else k) for k in range(12)]
    config = lambda df: df.withColumn("config", F.col("id") == "cfg")

    def sink_of(keep):
        write = live.config_in_order("seq", "config", "vc", "limit", 2, str(tmp_path / "states"), keep)
        return lambda batch, number: write(config(batch), number)

    found, table = in_batches(spark, tmp_path, rows, sizes, sink_of)
    sets = table.where("id = 'cfg'").select("seq", F.col("vc").alias("limit"))
    want = joins.broadcast_as_of(table.where("id <> 'cfg'"), sets, "seq", "limit", 2)
    assert sorted((r.seq, r.limit) for r in found) == tuples(want, "seq", "limit") or sorted((r.seq, r.limit) for r in found) == sorted(
        (r.seq, r.limit) for r in want.collect()
    )
    assert {r.seq: r.limit for r in found} == {0: 2, 1: 2, 2: 2, 4: 3, 5: 3, 7: 6, 9: 2, 10: 2, 11: 2}
    assert len(os.listdir(tmp_path / "states")) <= 2


@pytest.mark.parametrize("sizes", [[1] * 4 + [8], [5, 7]])
def test_idle_partitions_equal_the_replay(spark, tmp_path, sizes):
    rows = [(k, "x", [5, 9, 7, 30, 8, 31, 33, 12, 40, 41, 2, 50][k], k % 2 if k < 5 else 1 - (k in (9, 10))) for k in range(12)]
    clocked = lambda df: df.withColumn("clock", F.floor(F.col("seq") / 2))

    def sink_of(keep):
        write = live.idle_partitions("seq", "vc", 2, "clock", 1, 3, str(tmp_path / "states"), keep)
        return lambda batch, number: write(clocked(batch), number)

    found, table = in_batches(spark, tmp_path, rows, sizes, sink_of)
    want = eventtime.idle_watermark(clocked(table), "seq", "vc", 2, "clock", 1, 3)
    assert {r.seq: r.wm for r in found} == {r.seq: r.wm for r in want.collect()}


@pytest.mark.parametrize("sizes", [[1] * 4 + [8], [5, 7]])
def test_joint_late_rows_equal_the_replay(spark, tmp_path, sizes):
    seconds = [5, 9, 7, 30, 8, 31, 12, 6, 40, 41, 2, 50]
    rows = [(k, ["left", "right"][k % 2], s, k) for k, s in enumerate(seconds)]
    late = []

    def sink_of(keep):
        return live.joint_late("seq", "id", 3, str(tmp_path / "states"), keep, lambda b, _: late.extend(b.collect()))

    found, table = in_batches(spark, tmp_path, rows, sizes, sink_of)
    want = {r.seq for r in eventtime.interval_late(table, "seq", "id", 3).where("late").collect()}
    assert want and {r.seq for r in late} == want and len(found) + len(late) == 12


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_jdbc_exactly_once(spark, tmp_path, monkeypatch):
    """A batch that fails after its tasks have written, and batches run again after a restart, count once."""
    options = {"url": f"jdbc:derby:memory:{tmp_path.name};create=true", "dbtable": "exact", "driver": DERBY}
    rows = spark.range(10).select("id", (F.col("id") % 3).alias("Group"))
    failing = [True]
    real = writers.commit_statements

    def broken(*a):
        sql = real(*a)
        return sql | {"commit": "INSERT INTO nowhere VALUES (1)"} if failing and failing.pop() else sql

    monkeypatch.setattr(writers, "commit_statements", broken)
    for number in (0, 1, 1, 0):  # a new sink each, as after a restart
        writers.jdbc_once(options, "q", pause=0.0)(rows.where(F.col("id") % 2 == number), number)
    writers.jdbc_once(options, "other", pause=0.0)(rows.where("id = 1"), 0)  # another query's batch of that number
    got = spark.read.format("jdbc").options(**options).load()
    assert sorted(r["id"] for r in got.collect()) == sorted([*range(10), 1]) and got.columns == ["id", "Group"]


def test_names_are_quoted_by_the_dialect(spark):
    dialects = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects
    for url, mark in (("jdbc:mysql://h/d", "`"), ("jdbc:derby:memory:x", '"'), ("jdbc:postgresql://h/d", '"')):
        sql = writers.commit_statements(dialects.get(url), "t", "s", "c", ["a b"], "it's", 3)
        assert sql["move"] == f"INSERT INTO t ({mark}a b{mark}) SELECT {mark}a b{mark} FROM s"
        assert f"{mark}batch{mark} = 3" in sql["done"] and "'it''s'" in sql["done"]


def test_live_state_with_nulls(spark, tmp_path):
    from rivulet.operators import state
    from rivulet.streaming import processors

    folder = str(tmp_path / "in")
    rows = [(1, "a", 1, None), (2, "a", 2, 5), (3, "a", 3, None), (4, "a", 4, 30), (5, "b", 5, None)]
    batches(folder, [rows[:3], rows[3:]])
    table = spark.read.parquet(folder)
    cases = [
        (processors.Changelog(), state.changelog(table, ["id"], "seq", "vc"), ("seq", "op", "total")),
        (processors.TopList(), running.running_top(table, "id", "seq", "vc"), ("seq", "top")),
        (processors.ValueCounts(), state.map_counts(table, "id", "seq", "vc"), ("seq", "n")),
        (processors.SumAndAverage(), running.running_sum(table, ["id"], "seq", "vc", "total"), ("seq", "total")),
        (processors.JumpAlerts(), state.jump_alerts(table, ["id"], "seq", "vc", 10), ("seq", "prev_vc")),
    ]
    for k, (processor, want, columns) in enumerate(cases):
        got = ran(spark, processors.stateful(streamed(spark, folder), processor), tmp_path, f"null{k}")
        assert tuples(got, *columns) == tuples(want, *columns), type(processor).__name__


@pytest.mark.parametrize("union", [False, True])
def test_subtask_counts_outlive_another_number_of_tasks(spark, tmp_path, union):
    rows = [(k, "x", k, k) for k in range(30)]
    tasks, seen = iter([2, 3, 5]), []

    def sink_of(keep):
        write = live.subtask_counts(next(tasks), str(tmp_path / "states"), keep, union)
        return lambda batch, number: (write(batch, number), seen.append(number))

    found, _ = in_batches(spark, tmp_path, rows, [12, 10, 8], sink_of)
    at, totals = 0, []
    for n in (2, 3, 5):
        totals.append((n, sum(r.n for r in found[at : at + n])))
        at += n
    # split: every record counts once; union: each task goes on from what all tasks before have counted
    assert totals == ([(2, 12), (3, 22), (5, 30)] if not union else [(2, 12), (3, 12 * 3 + 10), (5, (12 * 3 + 10) * 5 + 8)])


def test_socket_and_records(spark, tmp_path):
    import socket
    import threading

    from rivulet.model import SENSOR, with_event_time
    from rivulet.sinks.records import kafka_writer, sink_options, value_record
    from rivulet.sources.kafka import kafka_lines, source_options

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        link, _ = server.accept()
        link.sendall(b"s1,1,5\ns2,2,6\n")
        done.wait(60)
        link.close()

    done = threading.Event()
    threading.Thread(target=serve, daemon=True).start()
    lines, got = files.socket_lines(spark, "127.0.0.1", server.getsockname()[1]), []
    writer = lines.writeStream.foreachBatch(lambda b, _: got.extend(r.value for r in b.collect()))
    query = writers.started(writer.option("checkpointLocation", str(tmp_path / "cp")), "from_socket")
    try:
        query.processAllAvailable()
        assert query.name == "from_socket" and sorted(got) == ["s1,1,5", "s2,2,6"]
    finally:
        query.stop()
        done.set()
        server.close()
    sensors = with_event_time(spark.createDataFrame([("s1", 61, 5)], SENSOR))
    assert sensors.select(F.col("et").cast("string")).first()[0] == "1970-01-01 00:01:01"
    assert bytes(value_record(sensors, F.col("vc")).first().value) == b"5"
    options = sink_options("h:9092", "t")
    with pytest.raises(Exception, match="kafka"):  # the connector is not among Spark's own jars
        kafka_lines(spark, source_options("h:9092", ["t"]))
    with pytest.raises(Exception, match="kafka"):
        kafka_writer(value_record(sensors, F.col("vc")), options).save()
    stream = spark.readStream.format("rate").load().select(F.col("value").cast("string"))
    with pytest.raises(Exception, match="kafka"):
        kafka_writer(value_record(stream, F.col("value")), options | {"checkpointLocation": str(tmp_path / "k")}).start()


def test_batches_come_in_intervals(spark, tmp_path):
    stream, times = spark.readStream.format("rate").option("rowsPerSecond", 50).load(), []
    writer = runtime.every(stream.writeStream.foreachBatch(lambda b, n: times.append((n, b.count()))), 1.5)
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.awaitTermination(10)
    finally:
        query.stop()
    assert 2 <= len(times) <= 8  # a rate of 50 rows a second would give many more without the interval
