"""Small inputs with results worked out by hand, and properties over random arrivals."""

import datetime as dt
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulet.functions import udfs
from rivulet.model import parse_lines
from rivulet.operators import eventtime, joins, running, state, topn, transforms, windows
from rivulet.sinks import records
from rivulet.sinks.records import keyed_record
from rivulet.sources import files, kafka
from rivulet.sources.generators import datagen, generate

SENSOR = "seq long, id string, ts long, vc int"
FIVE = [(1, "s1", 1, 1), (2, "s1", 11, 11), (3, "s1", 9, 11), (4, "s2", 2, 2), (5, "s3", 3, 3)]
SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def made(spark, rows, schema=SENSOR):
    return spark.createDataFrame(rows, schema)


def got(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def test_word_count(spark):
    lines = made(spark, [("hello java",), ("hello world",), ("hello scala",)], "value string")
    assert sorted(got(transforms.word_count(lines), "word", "n")) == [("hello", 3), ("java", 1), ("scala", 1), ("world", 1)]


def test_words_are_split_as_java_does(spark):
    df = made(spark, [("a b  ",), ("",), ("   ",), (" a",), (None,)], "v string")
    assert got(df.select(transforms.java_split(F.col("v")).alias("w")), "w") == [
        (["a", "b"],), ([""],), ([],), (["", "a"],), (None,),
    ]


def test_flat_map(spark):
    df = made(spark, [(1, "s1", 1, 1), (2, "s2", 2, 2), (3, "s3", 3, 3)])
    out = transforms.flat_map_cases(df, {"s1": ["vc"], "s2": ["ts", "vc"]})
    assert got(out, "value") == [("1",), ("2",), ("2",)]


def test_even_and_odd_keep_the_sign_of_the_remainder(spark):
    df = made(spark, [(v,) for v in (-3, -2, 0, 1)], "vc int")
    even, odd = transforms.even_odd(df)
    assert (got(even, "vc"), got(odd, "vc")) == ([(-2,), (0,)], [(1,)])


def test_running_extremes(spark):
    df = made(spark, FIVE)
    by = running.running_extreme_by(df, ["id"], "seq", "vc", "max", ["ts"], width=2)
    assert sorted(got(by, "seq", "max_vc", "at_ts")) == [(1, 1, 1), (2, 11, 11), (3, 11, 11), (4, 2, 2), (5, 3, 3)]
    plain = running.running_extreme(df, ["id"], "seq", "vc", "max", ["ts"], width=2)
    assert sorted(got(plain, "seq", "max_vc", "first_ts")) == [(1, 1, 1), (2, 11, 1), (3, 11, 1), (4, 2, 2), (5, 3, 3)]


def test_running_sum_with_null_keys_and_values(spark):
    df = made(spark, [(1, None, 1, None), (2, None, 1, 4), (3, None, 1, None), (4, "a", 1, 1)])
    out = running.running_sum(df, ["id"], "seq", "vc", "s", width=1)
    assert sorted(got(out, "seq", "s"), key=str) == [(1, None), (2, 4), (3, 4), (4, 1)]


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-9, 9)), min_size=1, max_size=30), st.integers(1, 40))
def test_chunks_do_not_change_running_results(spark, data, width):
    df = made(spark, [(i, k, i, v) for i, (k, v) in enumerate(data)])
    out = sorted(got(running.running_sum(df, ["id"], "seq", "vc", "s", width), "seq", "s"))
    sums, want = {}, []
    for i, (k, v) in enumerate(data):
        sums[k] = sums.get(k, 0) + v
        want.append((i, sums[k]))
    assert out == want
    tops = sorted(got(running.running_top(df, "id", "seq", "vc", 3, width), "seq", "top"))
    for i, top in tops:
        seen = sorted((v for k, v in data[: i + 1] if k == data[i][0]), reverse=True)[:3]
        assert top == ",".join(map(str, seen))


def test_top_list(spark):
    df = made(spark, [(i, "s1", i, v) for i, v in enumerate((9, 1, 7, 8))])
    assert [t for _, t in sorted(got(running.running_top(df, "id", "seq", "vc"), "seq", "top"))] == ["9", "9,1", "9,7,1", "9,8,7"]


def test_sliding_count_window(spark):
    df = made(spark, [(i, "s1", i, 10 * i) for i in range(1, 8)])
    out = windows.sliding_count_windows(df, ["id"], "seq", 5, 2, [F.sort_array(F.collect_list("vc")).alias("vcs")])
    assert sorted(got(out, "fired_at", "vcs")) == [(2, [10, 20]), (4, [10, 20, 30, 40]), (6, [20, 30, 40, 50, 60])]


def test_sessions_that_touch_are_one(spark):
    df = made(spark, [("a", at(s)) for s in (0, 5, 11)], "id string, ts timestamp_ntz")
    out = windows.session_windows(df, ["id"], [F.count("*").alias("n")], "5 seconds")
    assert sorted(got(out, "w_start", "w_end", "n")) == [(at(0), at(10), 2), (at(11), at(16), 1)]


def test_interval_join_has_both_ends(spark):
    left = made(spark, [(k, at(t)) for k, t in (("a", 1), ("a", 2), ("b", 3), ("c", 4))], "k string, l_ts timestamp")
    right = made(
        spark,
        [(k, at(t)) for k, t in (("a", 1), ("a", 11), ("b", 2), ("b", 12), ("c", 14), ("d", 15))],
        "k string, r_ts timestamp",
    )
    out = joins.interval_join(left, right, ["k"], -2, 1)
    assert sorted(got(out, "k", "l_ts", "r_ts")) == [("a", at(1), at(1)), ("a", at(2), at(1)), ("b", at(3), at(2))]


@SLOW
@given(st.lists(st.integers(0, 40), max_size=12), st.lists(st.integers(0, 40), max_size=12), st.integers(-9, 3), st.integers(0, 9))
def test_interval_join_is_a_filtered_product(spark, a, b, low, more):
    left = made(spark, [("k", at(t)) for t in a], "k string, l_ts timestamp")
    right = made(spark, [("k", at(t)) for t in b], "k string, r_ts timestamp")
    out = joins.interval_join(left, right, ["k"], low, low + more)
    want = sorted((at(x), at(y)) for x in a for y in b if x + low <= y <= x + low + more)
    assert sorted(got(out, "l_ts", "r_ts")) == want


def test_window_joins(spark):
    left = made(spark, [(k, at(t), t) for k, t in (("a", 1), ("a", 2), ("b", 3), ("c", 4))], "k string, ts timestamp, l int")
    right = made(
        spark,
        [(k, at(t), t) for k, t in (("a", 4), ("a", 11), ("b", 4), ("c", 6), ("c", 12), ("d", 13))],
        "k string, ts timestamp, r int",
    )
    inner = [("a", 1, 4), ("a", 2, 4), ("b", 3, 4), ("c", 4, 6)]
    for how, more in (("inner", []), ("left", []), ("right", [("a", None, 11), ("c", None, 12), ("d", None, 13)])):
        out = joins.window_join(left, right, ["k"], "10 seconds", how)
        assert sorted(got(out, "k", "l", "r"), key=str) == sorted([*inner, *more], key=str)


def test_window_cogroup(spark):
    import pandas as pd

    left = made(spark, [("a", at(1)), ("a", at(2)), ("b", at(3))], "k string, ts timestamp")
    right = made(spark, [("a", at(4)), ("c", at(4))], "k string, ts timestamp")

    def sizes(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [(a if len(a) else b)["k"].iloc[0]], "n": [len(a)], "m": [len(b)]})

    out = joins.window_cogroup(left, right, ["k"], "10 seconds", sizes, "k string, n long, m long")
    assert sorted(got(out, "k", "n", "m")) == [("a", 2, 1), ("b", 1, 0), ("c", 0, 1)]


def test_late_records(spark):
    arrivals = [1, 5, 13, 9, 4, 30, 2, 50]
    df = made(spark, [(i, at(t), t) for i, t in enumerate(arrivals)], "seq long, ts timestamp, t int")
    fated = eventtime.lateness(eventtime.with_watermark(df, "seq", 3, width=3), "10 seconds")
    assert sorted(got(fated.where("fate = 'late'"), "t")) == [(2,), (4,), (9,)]


@SLOW
@given(st.permutations(list(range(12))), st.integers(0, 12))
def test_enough_delay_leaves_nothing_late(spark, order, delay):
    df = made(spark, [(i, at(t), t) for i, t in enumerate(order)], "seq long, ts timestamp, t int")
    fated = eventtime.lateness(eventtime.with_watermark(df, "seq", delay, width=4), "5 seconds")
    counts = dict(got(fated.groupBy("fate").count(), "fate", "count"))
    assert sum(counts.values()) == len(order)
    if delay >= 12:
        assert "late" not in counts and "again" not in counts


def test_alerts_have_a_previous_value(spark):
    df = made(spark, [(i, "s1", i, v) for i, v in enumerate((5, 16, 10, 30))])
    assert sorted(got(state.jump_alerts(df, ["id"], "seq", "vc", 10, width=2), "vc", "prev_vc")) == [(16, 5), (30, 10)]


def test_dynamic_threshold(spark):
    data = made(spark, [(1, 3), (3, 8), (4, 12)], "seq long, vc int")
    config = made(spark, [(2, 10)], "seq long, threshold int")
    out = joins.broadcast_as_of(data, config, "seq", "threshold", 0, width=2)
    assert sorted(got(out.where("vc > threshold"), "vc", "threshold")) == [(3, 0), (12, 10)]


def test_changelog(spark):
    rows = [("s1", 1), ("s1", 2), ("s2", 2), ("s3", 3), ("s3", 4)]
    df = made(spark, [(i, k, i, v) for i, (k, v) in enumerate(rows)])
    out = sorted(got(state.changelog(df, ["id"], "seq", "vc", width=2), "id", "seq", "op", "total"))
    assert [(i, o, t) for i, _, o, t in out] == [
        ("s1", "+I", 1), ("s1", "+U", 3), ("s1", "-U", 1), ("s2", "+I", 2), ("s3", "+I", 3), ("s3", "+U", 7), ("s3", "-U", 3),
    ]


def test_time_to_live(spark):
    df = made(spark, [(0, "a", 0, 1), (1, "a", 3, 2), (2, "a", 8, 3)])
    assert sorted(got(state.with_ttl(df, ["id"], "seq", "vc", "ts", 5), "seq", "state"), key=str) == [(0, None), (1, 1), (2, None)]


def test_idle_partitions_do_not_hold_the_watermark(spark):
    rows = [(0, at(10), 0, 0), (1, at(5), 1, 1), (2, at(20), 0, 3), (3, at(40), 0, 9)]
    df = made(spark, rows, "seq long, ts timestamp, part int, clock int")
    out = dict(got(eventtime.idle_watermark(df, "seq", "part", 2, "clock", 5, 0), "seq", "wm"))
    assert out == {0: at(10), 1: at(5), 2: at(5), 3: at(40)}


def test_functions(spark):
    udfs.register(spark)
    df = made(spark, [("s1",), ("",), ("polygenelubricants",), ("é𝄞",)], "s string")
    java = {"s1": 3614, "": 0, "polygenelubricants": -2147483648}
    units = [int.from_bytes("é𝄞".encode("utf-16-be")[i : i + 2], "big") for i in range(0, 6, 2)]
    h = 0
    for u in units:
        h = (31 * h + u + 2**31) % 2**32 - 2**31
    java["é𝄞"] = h
    assert dict(got(df.select("s", udfs.java_hash(F.col("s")).alias("h")), "s", "h")) == java
    df.createOrReplaceTempView("strings")
    assert dict(got(spark.sql("SELECT s, java_hash(s) AS h FROM strings"), "s", "h")) == java
    scores = made(spark, [("zs", 80, 2), ("zs", 95, 4), ("zs", 100, 4), ("n", 1, 0)], "n string, s int, w int")
    out = scores.groupBy("n").agg(udfs.weighted_avg(F.col("s"), F.col("w")).alias("a"))
    assert dict(got(out, "n", "a")) == {"zs": 94.0, "n": None}
    scores.createOrReplaceTempView("scores")
    assert got(spark.sql("SELECT weighted_avg(s, w) AS a FROM scores WHERE n = 'zs'"), "a") == [(94.0,)]
    split = spark.sql("SELECT s, word, length FROM strings LEFT JOIN LATERAL split_words(s) ON TRUE WHERE s = 's1'")
    assert got(split, "word", "length") == [("s1", 2)]


def test_top_two_keeps_ties(spark):
    df = made(spark, [(v,) for v in (3, 6, 12, 5, 8, 9, 4)], "num int")
    assert sorted(got(topn.table_top(df, [], "num"), "num", "rank")) == [(9, 2), (12, 1)]
    assert sorted(got(topn.table_top(made(spark, [(5,), (5,), (1,)], "num int"), [], "num"), "num", "rank")) == [(5, 1), (5, 2)]


def test_partitioning(spark):
    df = made(spark, [(i,) for i in range(-4, 6)], "k int")
    dealt = transforms.custom_partition(df, 2, F.col("k")).select("k", F.spark_partition_id().alias("p")).collect()
    assert all(r.p == r.k % 2 for r in dealt)
    assert transforms.to_all(df, 3).count() == 30
    assert transforms.to_one(df).rdd.getNumPartitions() == 1


def test_life_cycle(spark):
    import pandas as pd

    df = made(spark, [(i,) for i in range(6)], "v int").repartition(2)
    out = transforms.per_subtask(df, lambda b, i: pd.DataFrame({"v": b["v"] + 1, "task": i}), "v int, task int")
    assert sorted(r.v for r in out.collect()) == [1, 2, 3, 4, 5, 6]


def test_records_and_lines(spark):
    lines = made(spark, [("s1,1,2",), ("s2,x,3",)], "value string")
    assert got(parse_lines(lines, permissive=True), "id", "ts", "vc") == [("s1", 1, 2), ("s2", None, 3)]
    assert [bytes(k) for (k,) in got(keyed_record(lines), "key")] == [b"1", b"x"]


def test_running_top_of_null_keys_and_doubles(spark):
    rows = [(1, None, 1.9), (2, None, 1.2), (3, "a", None), (4, "a", 2.5), (5, None, 1.5)]
    df = spark.createDataFrame(rows, "seq long, id string, vc double")
    for width in (running.even_width(df, "seq"), 1, 2, 100):
        tops = sorted(got(running.running_top(df, "id", "seq", "vc", 2, width), "seq", "top"))
        assert tops == [(1, "1.9"), (2, "1.9,1.2"), (3, ""), (4, "2.5"), (5, "1.9,1.5")]


def test_running_sum_keeps_the_first_record(spark):
    rows = [(1, "s1", 1, 10), (2, "s1", 11, 5), (3, "s1", 9, 7)]
    df = spark.createDataFrame(rows, "seq long, id string, ts long, vc int")
    assert sorted(got(running.running_sum(df, ["id"], "seq", "vc", "total", others=["ts"]), "seq", "total", "first_ts")) == [(1, 10, 1), (2, 15, 1), (3, 22, 1)]


@pytest.mark.parametrize("step", [1, 1_000_003, 1 << 40])
def test_chunks_are_even_whatever_the_numbers(spark, monkeypatch, step):
    monkeypatch.setattr(running, "WIDTH", 10)
    df = spark.range(100).select((F.col("id") * step + 5).alias("seq"), (F.col("id") % 3).alias("k"))
    rows, _ = running._chunked(df, ["k"], "seq", running.even_width(df, "seq"))
    sizes = [r["count"] for r in rows.groupBy(running._CHUNK).count().collect()]
    assert 10 <= len(sizes) <= 11 and max(sizes) <= 11


def test_rows_are_shuffled_once(spark):
    """Only the running window's own exchange carries the records; all others carry sums of chunks."""
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.lit("payload").alias("p"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (running.running_sum(df, ["k"], "id", "id", "s"), state.changelog(df, ["k"], "id", "id"), running.numbered(df, [], "id")):
            text = plan._jdf.queryExecution().executedPlan().toString()
            exchanges = [line for line in text.split("\n") if "Exchange hashpartitioning" in line]
            sorts = [line for line in text.split("\n") if " Sort [" in line]
            assert 1 <= len(exchanges) <= 4 and len(sorts) <= 4
            assert sum("__chunk" in line and "__k0" in line or "__chunk" in line for line in exchanges) <= 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_map_after_each_record(spark):
    rows = [(1, "a", 7), (2, "a", None), (3, "b", 7), (4, "a", 7), (5, None, 1)]
    df = spark.createDataFrame(rows, "seq long, id string, vc int")
    found = {r["seq"]: [tuple(e) for e in r["entries"]] for r in state.map_states(df, "id", "seq", "vc").collect()}
    assert found == {1: [(7, 1)], 2: [(None, 1), (7, 1)], 3: [(7, 1)], 4: [(None, 1), (7, 2)], 5: [(1, 1)]}


def test_processing_time_windows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (9, "b")], "s long, id string")
    clock = F.timestamp_seconds("s")
    tumbling = windows.processing_time_windows(df, ["id"], [F.count("*").alias("n")], "5 seconds", clock=clock)
    assert sorted(got(tumbling, "id", "n")) == [("a", 2), ("b", 1)]
    sliding = windows.processing_time_windows(df, ["id"], [F.count("*").alias("n")], "4 seconds", "2 seconds", clock=clock)
    assert sorted(got(sliding, "id", "n")) == [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 1)]
    assert windows.processing_time_windows(df, [], [F.count("*").alias("n")], "1 day").agg(F.sum("n")).first()[0] == 3
    assert windows.ingestion_time(df).schema["ingested"].dataType.simpleString() == "timestamp"


def test_partitions_and_side_outputs(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 5)
    assert transforms.shuffle(df, 3).rdd.getNumPartitions() == transforms.rebalance(df, 3).rdd.getNumPartitions() == 3
    assert transforms.rescale(transforms.rebalance(df, 4), 2).rdd.getNumPartitions() == 2
    placed = transforms.key_by(df, "k", n=4).withColumn("p", F.spark_partition_id())
    assert {r.n for r in placed.groupBy("k").agg(F.count_distinct("p").alias("n")).collect()} == {1}
    assert sorted(r.id for r in transforms.shuffle(df, 3).collect()) == list(range(100))
    outputs = transforms.side_outputs(transforms.route(df, {"low": F.col("id") < 10}), ["low", "main"])
    assert {name: out.count() for name, out in outputs.items()} == {"low": 10, "main": 90}
    assert sum(r.n for r in state.per_subtask_count(df).collect()) == 100


def test_kafka_options():
    options = kafka.source_options("h:1", ["a", "b"], "latest", "g")
    assert options["subscribe"] == "a,b" and options["startingOffsets"] == "latest" and options["kafka.group.id"] == "g"
    assert "kafka.group.id" not in kafka.source_options("h:1", ["a"])
    assert records.sink_options("h:1", "t") == {"kafka.bootstrap.servers": "h:1", "topic": "t"}


def test_generated_fields_are_spread(spark):
    made = datagen(spark, 2000, {"a": ("random", 1, 10, 1), "b": ("random", 1, 10, 2), "n": ("sequence", 5, 900, 0)}).collect()
    assert len(made) == 896 and [r.n for r in made] == list(range(5, 901))
    assert {r.a for r in made} == set(range(1, 11)) and 0.05 < sum(r.a == r.b for r in made) / len(made) < 0.2


def test_rate_source(spark, tmp_path):
    stream = generate(spark, 5, lambda n: n * 2, rate=50)
    query = stream.writeStream.format("memory").queryName("rated").option("checkpointLocation", str(tmp_path)).start()
    try:
        until = time.monotonic() + 40
        while spark.table("rated").count() < 5 and time.monotonic() < until:
            time.sleep(0.3)
    finally:
        query.stop()
    assert sorted(tuple(r) for r in spark.table("rated").collect()) == [(k, 2 * k) for k in range(5)]


def test_files_and_views(spark, tmp_path):
    spark.createDataFrame([("a,1,2",)], "value string").write.text(str(tmp_path / "t"))
    assert [r.value for r in files.text_lines(spark, str(tmp_path / "t")).collect()] == ["a,1,2"]
    stream = files.text_stream(spark, str(tmp_path / "t"))
    marked = files.source_watermark(stream.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "ts", "1 second")
    assert marked.isStreaming and marked.schema["ts"].dataType.simpleString() == "timestamp"
    assert [r.w for r in joins.lateral_split(spark.createDataFrame([("",)], "t string"), F.array().cast("array<string>"), outer=False).select(F.col("word").alias("w")).collect()] == []
