"""Accumulators of the user, sessions in chunks, and nulls in running operators, against plain Python."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.functions import accumulators
from rivulet.operators import accumulate, joins, running, state, windows


def folded(acc, rows):
    s = acc.create()
    for r in rows:
        s = acc.add(s, r)
    return s


class Value(tuple):
    vc = property(lambda self: self[0])


@pytest.mark.parametrize("acc", [accumulators.RisingStreak("vc"), accumulators.SumAndCount("vc")])
def test_merging_gives_what_adding_gives(acc):
    rng = np.random.default_rng(4)
    for _ in range(200):
        rows = [Value([None if x == 0 else int(x)]) for x in rng.integers(0, 6, rng.integers(0, 12))]
        cut = sorted(rng.integers(0, len(rows) + 1, 2))
        parts = [rows[: cut[0]], rows[cut[0] : cut[1]], rows[cut[1] :]]
        merged = acc.create()
        for part in parts:
            merged = acc.merge(merged, folded(acc, part))
        assert acc.result(merged) == acc.result(folded(acc, rows))


def test_longest_rise():
    acc = accumulators.RisingStreak("vc")
    of = lambda *v: acc.result(folded(acc, [Value([x]) for x in v]))[0]
    assert (of(), of(None), of(3), of(3, 3), of(1, 2, 3, 2, 3), of(1, None, 2, 3), of(3, 2, 1)) == (0, 0, 1, 1, 3, 2, 1)


@pytest.mark.parametrize("width", [1, 7, 1 << 18])
def test_running_reducer_in_chunks(spark, width):
    """Text that is put together in order, for keys with nulls, one of which has most rows."""
    rng = np.random.default_rng(5)
    keys = [None if k == 0 else int(k) for k in rng.choice([0, 1, 1, 1, 1, 2, 3], 80)]
    data = [(k, i * 3, f"{i}") for i, k in enumerate(keys)]
    reducer = accumulators.Reducer(lambda a, b: (a[0] + "," + b[0],), "path string")
    df = spark.createDataFrame(data, "k int, seq long, word string").repartition(5)
    got = accumulate.running_accumulate(df, ["k"], "seq", ["word"], reducer, width)
    want, paths = {}, defaultdict(list)
    for k, seq, word in data:
        paths[k].append(word)
        want[seq] = (k, ",".join(paths[k]))
    assert {r.seq: (r.k, r.path) for r in got.collect()} == want
    assert accumulate.running_accumulate(df.limit(0), ["k"], "seq", ["word"], reducer, width).count() == 0


@pytest.mark.parametrize("width", [3, 1 << 18])
@pytest.mark.parametrize("slide", [None, "5 seconds"])
def test_window_accumulator_in_chunks(spark, width, slide):
    rng = np.random.default_rng(6)
    data = [(int(k), i, int(t), None if v == 0 else int(v)) for i, (k, t, v) in enumerate(zip(rng.integers(0, 2, 60), rng.integers(0, 40, 60), rng.integers(0, 9, 60), strict=True))]
    df = spark.createDataFrame(data, "k int, seq long, s long, vc int").withColumn("ts", F.timestamp_seconds("s"))
    acc = accumulators.RisingStreak("vc")
    got = accumulate.window_accumulate(df, ["k"], "seq", ["vc"], acc, "10 seconds", slide, width=width)
    held = defaultdict(list)
    for k, _, s, vc in data:
        step = 5 if slide else 10
        for start in range(s - s % step - (10 - step), s + 1, step):
            held[k, start].append(Value([vc]))
    found = {(r.k, int(r.w_start.timestamp())): r.longest_rise for r in got.collect()}
    assert found == {at: acc.result(folded(acc, rows))[0] for at, rows in held.items()}


@pytest.mark.parametrize("width", [1_000_000, 7_000_000, None])
@pytest.mark.parametrize("dynamic", [False, True])
def test_sessions_in_chunks_equal_the_built_in(spark, width, dynamic):
    """Ties, null keys, times and gaps, gaps of zero, and sessions that reach over many chunks."""
    rng = np.random.default_rng(7)
    data = [
        (None if k == 3 else int(k), None if t == 0 else int(t), None if g == 9 else int(g))
        for k, t, g in zip(rng.integers(0, 4, 150), rng.integers(0, 400, 150), rng.integers(0, 10, 150), strict=True)
    ]
    df = spark.createDataFrame([*data, *data[:20]], "k int, s long, g int").withColumn("ts", F.timestamp_seconds("s"))
    gap = windows.seconds_gap(F.col("g").cast("decimal(18,6)")) if dynamic else "4 seconds"
    built_in = df.groupBy("k", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    want = built_in.select("k", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n")
    got = windows.session_windows(df, ["k"], [F.count("*").alias("n")], gap, width=width)
    assert got.columns == want.columns
    as_set = lambda d: sorted(map(str, d.collect()))
    assert as_set(got) == as_set(want)
    assert windows.session_windows(df.limit(0), ["k"], [F.count("*").alias("n")], gap, width=width).count() == 0


def test_null_config_sets_the_default(spark):
    data = spark.createDataFrame([(1, "a"), (3, "b"), (5, "c")], "seq long, v string")
    config = spark.createDataFrame([(2, 7), (4, None)], "seq long, cfg int")
    got = joins.broadcast_as_of(data, config, "seq", "cfg", 0)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 0), (3, "b", 7), (5, "c", 0)]


def test_changelog_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 2)], "seq long, vc int").withColumn("id", F.lit("a"))
    got = sorted((r.seq, r.op, r.total) for r in state.changelog(df, ["id"], "seq", "vc").collect())
    assert got == [(1, "+I", None), (2, "+U", 5), (2, "-U", None), (3, "+U", 5), (3, "-U", 5), (4, "+U", 7), (4, "-U", 5)]


@pytest.mark.parametrize(("kind", "want"), [("min", [None, 5, 5, 2]), ("max", [None, 5, 5, 5])])
def test_extreme_by_leaves_nulls_out(spark, kind, want):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 2)], "seq long, vc int").withColumn("id", F.lit("a"))
    got = running.running_extreme_by(df, ["id"], "seq", "vc", kind, ["seq"])
    assert [r[f"{kind}_vc"] for r in sorted(got.collect(), key=lambda r: r.seq)] == want


def test_even_width(spark):
    df = spark.range(100).select((F.col("id") * 10**9).alias("seq"))
    assert running.even_width(df, "seq") == 99 * 10**9 + 1 and running.even_width(df.limit(0), "seq") == running.WIDTH


@pytest.mark.parametrize("width", [4, 1 << 18])
def test_table_aggregate_in_chunks(spark, width):
    rng = np.random.default_rng(8)
    data = [(None if k == 2 else int(k), i, None if v == 0 else int(v)) for i, (k, v) in enumerate(rng.integers(0, [4, 9], (70, 2)))] + [(9, 99, None)]
    df = spark.createDataFrame(data, "k int, seq long, vc long")
    got = accumulate.table_accumulate(df, ["k"], "seq", ["vc"], accumulators.TopDistinct("vc", 2), width)
    want = []
    for k in {r[0] for r in data}:
        values = sorted({r[2] for r in data if r[0] == k and r[2] is not None}, reverse=True)[:2]
        want += [(k, v, place) for place, v in enumerate(values, 1)]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("width", [3, 1 << 18])
def test_broadcast_process_in_chunks(spark, width):
    """Config of several names, one of them taken out again, before and after the data it is for."""
    data = spark.createDataFrame([(k, "ab"[k % 2], k) for k in range(0, 30, 2)] + [(k, "b", None) for k in (7, 19)], "seq long, name string, v int")
    config = spark.createDataFrame([(1, "a", 5), (9, "b", 7), (11, "a", None), (23, "a", 1)], "seq long, name string, v int")
    got = joins.broadcast_process(
        data, config, "seq", ["name", "v"], lambda r: {r.name: r.v}, lambda e, r: (e.get(r.name) or 0, sum(v is not None for v in e.values())),
        "limit int, n int", width,
    )
    want, held, rows = {}, {}, sorted([*((r.seq, False, r.name, r.v) for r in data.collect()), *((r.seq, True, r.name, r.v) for r in config.collect())])
    for seq, is_config, name, v in rows:
        if is_config:
            held[name] = v
        else:
            want[seq] = (held.get(name) or 0, sum(x is not None for x in held.values()))
    assert {r.seq: (r.limit, r.n) for r in got.collect()} == want
