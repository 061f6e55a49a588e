"""The registered queries: every operator over the driver's tables, with DuckDB SQL for the same rows.

Stream operators run as replays: event_id is the arrival order, or, where
lateness matters, an order in which records come up to two hours after their event time.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import accumulators, udfs
from rivulet.model import parse_lines, sensor_view, table
from rivulet.operators import accumulate, eventtime, joins, running, state, topn, transforms, windows
from rivulet.sinks.records import keyed_record
from rivulet.sinks.writers import once_per_batch
from rivulet.sources import files
from rivulet.sources.generators import datagen, generate
from rivulet.streaming import live, processors, runtime
from rivulet.streaming import windows as live_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SENSORS = """s AS (
    SELECT event_id AS seq, event_type AS id, user_id, ts, CAST(floor(value) AS INT) AS vc FROM events
)"""
HOUR = "time_bucket(INTERVAL 1 HOUR, ts)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL. {s} stands for the sensor view."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{s}", SENSORS)
        return f

    return register


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_view(table(spark, sf_dir, "events"))


#: Seconds that a record comes after its event time at most, and places for records of one second.
DISORDER, PLACES = 7200, 1 << 31


def disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors that arrive up to DISORDER seconds after their event time, so that some are late at every scale."""
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) + (F.col("seq") * 7919) % DISORDER
    return sensors(spark, sf_dir).withColumn("arrival", second * PLACES + F.col("seq"))


def even(spark: SparkSession, sf_dir: str) -> int:
    """The width of chunks of the disordered arrival order, measured once for each query."""
    return running.even_width(disordered(spark, sf_dir), "arrival")


DISORDERED = f"""{{s}}, d AS (
    SELECT *, (epoch_us(ts) // 1000000 + (seq * 7919) % {DISORDER}) * {PLACES} + seq AS arrival FROM s
)"""


# element-wise operators and splits


@query("WITH {s} SELECT seq, id FROM s")
def map_id(spark, sf_dir):
    return transforms.map_fields(sensors(spark, sf_dir), "seq", "id")


@query("WITH {s} SELECT seq, id, vc FROM s WHERE id = 'click'")
def filter_type(spark, sf_dir):
    return transforms.filter_equal(sensors(spark, sf_dir), "click").select("seq", "id", "vc")


@query("""WITH {s} SELECT seq, CAST(vc AS VARCHAR) AS value FROM s WHERE id IN ('click', 'view')
UNION ALL SELECT seq, CAST(user_id AS VARCHAR) FROM s WHERE id = 'view'""")
def flatmap_cases(spark, sf_dir):
    cases = {"click": ["vc"], "view": ["user_id", "vc"]}
    return transforms.flat_map_cases(sensors(spark, sf_dir), cases).select("seq", "value")


@query("""WITH l AS (SELECT event_id, event_type || ',' || event_id || ',' || CAST(floor(value) AS INT) AS v FROM events)
SELECT split_part(v, ',', 1) AS id, CAST(split_part(v, ',', 2) AS BIGINT) AS ts,
       CAST(split_part(v, ',', 3) AS INT) AS vc FROM l""")
def parse_sensor_lines(spark, sf_dir):
    s = sensors(spark, sf_dir)
    return parse_lines(s.select(F.concat_ws(",", "id", "seq", "vc").alias("value")))


@query("""WITH {s} SELECT seq, vc, CASE WHEN vc % 2 = 0 THEN 'even' ELSE 'odd' END AS side
FROM s WHERE vc % 2 IN (0, 1)""")
def split_even_odd(spark, sf_dir):
    even, odd = transforms.even_odd(sensors(spark, sf_dir).select("seq", "vc"))
    return even.withColumn("side", F.lit("even")).union(odd.withColumn("side", F.lit("odd")))


@query("""WITH {s} SELECT seq, CASE WHEN id = 'click' THEN 'a' WHEN id = 'view' THEN 'b' ELSE 'main' END AS route FROM s""")
def split_side_output(spark, sf_dir):
    routes = {"a": F.col("id") == "click", "b": F.col("id") == "view"}
    return transforms.route(sensors(spark, sf_dir), routes).select("seq", "route")


@query("""WITH {s} SELECT seq, CASE WHEN vc > 10 THEN 'warning' ELSE 'main' END AS route,
CASE WHEN vc > 10 THEN 'vc=' || vc || ' is above 10' END AS warning FROM s""")
def route_threshold(spark, sf_dir):
    return transforms.threshold_warnings(sensors(spark, sf_dir)).select("seq", "route", "warning")


@query("""SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem
UNION ALL SELECT CAST(c_custkey AS BIGINT) FROM customer""")
def union_all(spark, sf_dir):
    one = lambda t, c: table(spark, sf_dir, t).select(F.col(c).cast("long").alias("k"))
    return transforms.union_all(one("orders", "o_orderkey"), one("lineitem", "l_orderkey"), one("customer", "c_custkey"))


@query("""SELECT 'order ' || o_orderkey AS value FROM orders UNION ALL SELECT 'customer ' || c_custkey FROM customer""")
def comap_union(spark, sf_dir):
    return transforms.connect_map(
        table(spark, sf_dir, "orders"),
        table(spark, sf_dir, "customer"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")),
        F.concat(F.lit("customer "), F.col("c_custkey").cast("string")),
    )


JAVA_WORDS = """w AS (
    SELECT doc_id, unnest(string_split(regexp_replace(text, ' +$', ''), ' ')) AS word,
           generate_subscripts(string_split(regexp_replace(text, ' +$', ''), ' '), 1) AS place
    FROM documents WHERE text IS NOT NULL AND (text = '' OR trim(text, ' ') <> '')
)"""


@query(f"WITH {JAVA_WORDS} SELECT word, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY word")
def wordcount_final(spark, sf_dir):
    return transforms.word_count(table(spark, sf_dir, "documents"), "text")


@query(f"""WITH {JAVA_WORDS} SELECT doc_id, place, word,
count(*) OVER (PARTITION BY word ORDER BY doc_id, place ROWS UNBOUNDED PRECEDING) AS n FROM w""")
def wordcount_running(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    placed = docs.select("doc_id", F.posexplode(transforms.java_split(F.col("text"))).alias("place", "word"))
    placed = placed.select("doc_id", (F.col("place") + 1).cast("long").alias("place"), "word")
    first = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31)  # a text has fewer words
    placed = placed.withColumn("seq", first + F.col("place"))
    width = running.even_width(docs.select(first.alias("seq")), "seq")
    got = running.numbered(placed, ["word"], "seq", "n", width)
    return got.select("doc_id", "place", "word", "n")


# running aggregates


@query("""WITH {s} SELECT seq, id, CAST(sum(vc) OVER (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT)
AS sum_vc FROM s""")
def running_sum(spark, sf_dir):
    return running.running_sum(sensors(spark, sf_dir), ["id"], "seq", "vc", "sum_vc").select("seq", "id", "sum_vc")


@query("""WITH {s} SELECT seq, id, CAST(sum(vc) OVER w AS BIGINT) AS sum_vc, first_value(user_id) OVER w AS first_user_id
FROM s WINDOW w AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def running_sum_first(spark, sf_dir):
    got = running.running_sum(sensors(spark, sf_dir), ["id"], "seq", "vc", "sum_vc", others=["user_id"])
    return got.select("seq", "id", "sum_vc", "first_user_id")


def _extreme_sql(kind: str) -> str:
    return f"""WITH {{s}} SELECT seq, id, {kind}(vc) OVER w AS {kind}_vc, first_value(user_id) OVER w AS first_user_id
    FROM s WINDOW w AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING)"""


@query(_extreme_sql("max"))
def running_max(spark, sf_dir):
    got = running.running_extreme(sensors(spark, sf_dir), ["id"], "seq", "vc", "max", ["user_id"])
    return got.select("seq", "id", "max_vc", "first_user_id")


@query(_extreme_sql("min"))
def running_min(spark, sf_dir):
    got = running.running_extreme(sensors(spark, sf_dir), ["id"], "seq", "vc", "min", ["user_id"])
    return got.select("seq", "id", "min_vc", "first_user_id")


def _extreme_by_sql(kind: str) -> str:
    return f"""WITH {{s}}, best AS (
        SELECT *, {kind}(vc) OVER (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS b FROM s
    ), firsts AS (SELECT id, vc, min(seq) AS at FROM s GROUP BY id, vc)
    SELECT best.seq, best.id, b AS {kind}_vc, f.at AS at_seq, s.user_id AS at_user_id
    FROM best JOIN firsts f ON f.id = best.id AND f.vc = b JOIN s ON s.seq = f.at"""


@query(_extreme_by_sql("max"))
def running_maxby(spark, sf_dir):
    got = running.running_extreme_by(sensors(spark, sf_dir), ["id"], "seq", "vc", "max", ["seq", "user_id"])
    return got.select("seq", "id", "max_vc", "at_seq", "at_user_id")


@query(_extreme_by_sql("min"))
def running_minby(spark, sf_dir):
    got = running.running_extreme_by(sensors(spark, sf_dir), ["id"], "seq", "vc", "min", ["seq", "user_id"])
    return got.select("seq", "id", "min_vc", "at_seq", "at_user_id")


@query("""WITH {s} SELECT user_id, ts, CAST(sum(vc) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)
AS BIGINT) AS sum_vc FROM s""")
def reduce_running(spark, sf_dir):
    return running.running_reduce(sensors(spark, sf_dir), ["user_id"], "seq", "vc").select("user_id", "ts", "sum_vc")


@query("""WITH {s} SELECT seq, user_id, CAST(list_reduce(list(abs(vc)) OVER (PARTITION BY user_id ORDER BY seq
ROWS UNBOUNDED PRECEDING), lambda h, v: (h * 31 + v) % 1000003) AS BIGINT) AS code FROM s""")
def reduce_user(spark, sf_dir):
    """A reducer of the user that is no sum and not commutative: steps x -> 31 x + v, put together modulo a prime."""
    s = sensors(spark, sf_dir).select("user_id", "seq", F.lit(31).alias("times"), F.abs("vc").alias("plus"))
    step = lambda a, b: (a[0] * b[0] % 1_000_003, (a[1] * b[0] + b[1]) % 1_000_003)
    reducer = accumulators.Reducer(step, "times long, code long")
    got = accumulate.running_accumulate(s, ["user_id"], "seq", ["times", "plus"], reducer)
    return got.select("seq", "user_id", "code")


def _rise_sql(keys: str, hour: str = "") -> str:
    return f"""WITH {{s}}, k AS (SELECT *{hour} FROM s), f AS (
        SELECT *, CASE WHEN vc > lag(vc) OVER (PARTITION BY {keys} ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM k
    ), g AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS no FROM f
    ), r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, no ORDER BY seq) AS run FROM g)
    """


@query(_rise_sql("user_id") + """SELECT seq, user_id, max(run) OVER (PARTITION BY user_id ORDER BY seq
ROWS UNBOUNDED PRECEDING) AS longest_rise FROM r""")
def accumulate_running(spark, sf_dir):
    acc = accumulators.RisingStreak("vc")
    return accumulate.running_accumulate(sensors(spark, sf_dir), ["user_id"], "seq", ["vc"], acc)


@query(_rise_sql("id, w_start", f", {HOUR} AS w_start") + """SELECT id, w_start, w_start + INTERVAL 1 HOUR AS w_end,
max(run) AS longest_rise FROM r GROUP BY id, w_start""")
def accumulate_window(spark, sf_dir):
    acc = accumulators.RisingStreak("vc")
    return accumulate.window_accumulate(sensors(spark, sf_dir), ["id"], "seq", ["vc"], acc, "1 hour")


# windows


@query(f"""WITH {{s}} SELECT id, {HOUR} AS w_start, {HOUR} + INTERVAL 1 HOUR AS w_end,
count(*) AS n, CAST(sum(vc) AS BIGINT) AS sum_vc FROM s GROUP BY ALL""")
def tumbling_agg(spark, sf_dir):
    aggregates = [F.count("*").alias("n"), F.sum("vc").alias("sum_vc")]
    return windows.time_windows(sensors(spark, sf_dir), ["id"], aggregates, "1 hour")


@query(f"""WITH {{s}} SELECT user_id % 10 AS part, {HOUR} AS w_start, {HOUR} + INTERVAL 1 HOUR AS w_end, count(*) AS n
FROM s GROUP BY ALL""")
def processing_time_agg(spark, sf_dir):
    """Windows over the time of processing, for which a clock stands in."""
    s = sensors(spark, sf_dir).withColumn("part", F.col("user_id") % 10)
    return windows.processing_time_windows(s, ["part"], [F.count("*").alias("n")], "1 hour", clock=F.col("ts"))


@query("""WITH {s}, e AS (
    SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS w_start FROM s, range(0, 2) AS r(k)
) SELECT id, w_start, w_start + INTERVAL 1 HOUR AS w_end, count(*) AS n, max(vc) AS max_vc FROM e GROUP BY ALL""")
def sliding_agg(spark, sf_dir):
    aggregates = [F.count("*").alias("n"), F.max("vc").alias("max_vc")]
    return windows.time_windows(sensors(spark, sf_dir), ["id"], aggregates, "1 hour", "30 minutes")


@query("""WITH {s}, p AS (SELECT *, ts + to_seconds(1800) AS ends FROM s), q AS (
    SELECT *, CASE WHEN ts <= max(ends) OVER (PARTITION BY user_id ORDER BY ts, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM p
), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS no FROM q)
SELECT user_id, min(ts) AS w_start, max(ends) AS w_end, count(*) AS n FROM g GROUP BY user_id, no""")
def session_fixed(spark, sf_dir):
    return windows.session_windows(sensors(spark, sf_dir), ["user_id"], [F.count("*").alias("n")], "30 minutes")


@query("""WITH {s}, p AS (SELECT *, ts + to_seconds(600 + 60 * (abs(vc) % 30)) AS ends FROM s), q AS (
    SELECT *, CASE WHEN ts <= max(ends) OVER (PARTITION BY user_id ORDER BY ts, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM p
), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS no FROM q)
SELECT user_id, min(ts) AS w_start, max(ends) AS w_end, count(*) AS n FROM g GROUP BY user_id, no""")
def session_dynamic(spark, sf_dir):
    gap = windows.seconds_gap((600 + 60 * (F.abs("vc") % 30)).cast("decimal(18,6)"))
    return windows.session_windows(sensors(spark, sf_dir), ["user_id"], [F.count("*").alias("n")], gap)


@query("""WITH {s}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM s)
SELECT user_id, CAST((rn - 1) // 5 AS BIGINT) AS window_no, CAST(sum(vc) AS BIGINT) AS sum_vc, min(seq) AS first_seq
FROM r GROUP BY user_id, (rn - 1) // 5 HAVING count(*) = 5""")
def count_tumbling(spark, sf_dir):
    aggregates = [F.sum("vc").alias("sum_vc"), F.min("seq").alias("first_seq")]
    return windows.count_windows(sensors(spark, sf_dir), ["user_id"], "seq", 5, aggregates)


@query("""WITH {s}, r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn,
    sum(vc) OVER w AS sum_vc, count(*) OVER w AS n FROM s
    WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT user_id, rn AS fired_at, CAST(sum_vc AS BIGINT) AS sum_vc, n FROM r WHERE rn % 2 = 0""")
def count_sliding(spark, sf_dir):
    aggregates = [F.sum("vc").alias("sum_vc"), F.count("*").alias("n")]
    return windows.sliding_count_windows(sensors(spark, sf_dir), ["user_id"], "seq", 5, 2, aggregates)


@query(f"""WITH {{s}} SELECT {HOUR} AS w_start, {HOUR} + INTERVAL 1 HOUR AS w_end, count(*) AS n FROM s GROUP BY ALL""")
def window_all(spark, sf_dir):
    return windows.time_windows(sensors(spark, sf_dir), [], [F.count("*").alias("n")], "1 hour")


@query(f"""WITH {{s}} SELECT id, {HOUR} AS w_start, {HOUR} + INTERVAL 1 HOUR AS w_end, CAST(sum(vc) AS BIGINT) AS sum_vc,
arg_max(user_id, seq) AS last_user_id FROM s GROUP BY ALL""")
def window_reduce(spark, sf_dir):
    aggregates = [F.sum("vc").alias("sum_vc"), F.max_by("user_id", "seq").alias("last_user_id")]
    return windows.time_windows(sensors(spark, sf_dir), ["id"], aggregates, "1 hour")


@query(f"""WITH {{s}} SELECT id, {HOUR} AS w_start, {HOUR} + INTERVAL 1 HOUR AS w_end, count(*) AS n,
string_agg(vc, ',' ORDER BY seq) AS vcs FROM s GROUP BY ALL""")
def window_process(spark, sf_dir):
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "vc"))), lambda e: e["vc"]), ",")
    aggregates = [F.count("*").alias("n"), listed.alias("vcs")]
    return windows.time_windows(sensors(spark, sf_dir), ["id"], aggregates, "1 hour")


# top N

TOP_SQL = """WITH {s}, e AS (
    SELECT vc, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS w_start FROM s, range(0, 2) AS r(k)
), c AS (SELECT w_start, vc, count(*) AS n FROM e GROUP BY ALL)
SELECT w_start, w_start + INTERVAL 1 HOUR AS w_end, vc, n, CAST(place AS INT) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY w_start ORDER BY n DESC, vc) AS place FROM c
) WHERE place <= 2"""


@query(TOP_SQL)
def window_all_topn(spark, sf_dir):
    return topn.window_top(sensors(spark, sf_dir), "vc", 2, "1 hour", "30 minutes")


@query("""WITH {s}, r AS (SELECT a.user_id, a.seq, b.vc,
    row_number() OVER (PARTITION BY a.seq ORDER BY b.vc DESC, b.seq) AS k
    FROM s a JOIN s b ON a.user_id = b.user_id AND b.seq <= a.seq)
SELECT user_id, seq, string_agg(vc, ',' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY user_id, seq""")
def top3_per_key(spark, sf_dir):
    return running.running_top(sensors(spark, sf_dir), "user_id", "seq", "vc", 3)


@query("""SELECT l_quantity, rank FROM (
    SELECT l_quantity, CAST(row_number() OVER (ORDER BY l_quantity DESC) AS INT) AS rank FROM lineitem) WHERE rank <= 2""")
def top2_table_agg(spark, sf_dir):
    return udfs.top2(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("""WITH {s} SELECT user_id, vc, CAST(place AS INT) AS place FROM (
    SELECT DISTINCT user_id, vc, dense_rank() OVER (PARTITION BY user_id ORDER BY vc DESC) AS place FROM s) WHERE place <= 3""")
def table_accumulate(spark, sf_dir):
    acc = accumulators.TopDistinct("vc", 3, "int")
    return accumulate.table_accumulate(sensors(spark, sf_dir), ["user_id"], "seq", ["vc"], acc)


# joins


@query("""SELECT o_orderkey AS k, o_custkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def keyed_connect(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    right = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey")
    return joins.keyed_connect(left, right, ["k"])


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = sensors(spark, sf_dir)
    left = s.where("id = 'click'").select("user_id", "ts", F.col("seq").alias("l_seq"))
    return left, s.where("id = 'purchase'").select("user_id", "ts", F.col("seq").alias("r_seq"))


def _window_join_sql(how: str) -> str:
    return f"""WITH {{s}}, a AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS w, seq AS l_seq FROM s WHERE id = 'click'),
    b AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS w, seq AS r_seq FROM s WHERE id = 'purchase')
    SELECT user_id, w AS w_start, w + INTERVAL 1 DAY AS w_end, l_seq, r_seq FROM a {how} JOIN b USING (user_id, w)"""


@query(_window_join_sql("INNER"))
def window_join_inner(spark, sf_dir):
    return joins.window_join(*_sides(spark, sf_dir), ["user_id"], "1 day")


@query(_window_join_sql("LEFT"))
def window_join_left(spark, sf_dir):
    return joins.window_join(*_sides(spark, sf_dir), ["user_id"], "1 day", "left")


@query(_window_join_sql("RIGHT"))
def window_join_right(spark, sf_dir):
    return joins.window_join(*_sides(spark, sf_dir), ["user_id"], "1 day", "right")


@query("""WITH {s}, e AS (SELECT user_id % 5 AS part, time_bucket(INTERVAL 1 DAY, ts) AS w_start, id, seq FROM s
    WHERE id IN ('click', 'purchase'))
SELECT part, w_start, count(*) FILTER (id = 'click') AS n_left, count(*) FILTER (id = 'purchase') AS n_right,
       CAST(sum(seq) AS BIGINT) AS sum_seq FROM e GROUP BY part, w_start""")
def window_cogroup(spark, sf_dir):
    """All rows of both sides of each key and window, by a function of the user."""
    left, right = (
        df.select((F.col("user_id") % 5).alias("part"), "ts", F.col(c).alias("seq")) for df, c in zip(_sides(spark, sf_dir), ("l_seq", "r_seq"), strict=True)
    )

    def body(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        one = a if len(a) else b
        return pd.DataFrame(
            {"part": one["part"][:1], "w_start": one["w_start"][:1], "n_left": len(a), "n_right": len(b), "sum_seq": a["seq"].sum() + b["seq"].sum()}
        )

    return joins.window_cogroup(left, right, ["part"], "1 day", body, "part long, w_start timestamp_ntz, n_left long, n_right long, sum_seq long")


@query("""WITH {s} SELECT a.user_id, a.seq AS l_seq, b.seq AS r_seq FROM s a JOIN s b ON a.user_id = b.user_id
AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 1 HOUR WHERE a.id = 'click' AND b.id = 'purchase'""")
def interval_join(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    got = joins.interval_join(
        left.withColumnRenamed("ts", "l_ts"), right.withColumnRenamed("ts", "r_ts"), ["user_id"], -7200, 3600
    )
    return got.select("user_id", "l_seq", "r_seq")


@query("""WITH {s} SELECT a.seq AS l_seq, b.seq AS r_seq, 'bought ' || CASE WHEN b.ts < a.ts THEN 'before' ELSE 'after' END AS told
FROM s a JOIN s b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 1 HOUR
WHERE a.id = 'click' AND b.id = 'purchase'""")
def interval_process(spark, sf_dir):
    """A process function of the user over the pairs of an interval join."""
    left, right = _sides(spark, sf_dir)

    def told(pair):
        yield pair.l_seq, pair.r_seq, "bought " + ("before" if pair.r_ts < pair.l_ts else "after")

    return joins.interval_process(
        left.withColumnRenamed("ts", "l_ts"),
        right.withColumnRenamed("ts", "r_ts"),
        ["user_id"],
        -7200,
        3600,
        ["l_seq", "r_seq", "l_ts", "r_ts"],
        told,
        "l_seq long, r_seq long, told string",
    )


INTERVAL_LATE_SQL = f"""WITH {DISORDERED}, n AS (SELECT *, CASE id WHEN 'click' THEN 'left' ELSE 'right' END AS side
    FROM d WHERE id IN ('click', 'purchase')), m AS (
    SELECT *, max(CASE WHEN side = 'left' THEN ts END) OVER w AS a, max(CASE WHEN side = 'right' THEN ts END) OVER w AS b
    FROM n WINDOW w AS (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, side FROM m WHERE a IS NOT NULL AND b IS NOT NULL
AND ts < least(a, b) - INTERVAL 10 MINUTE - INTERVAL 1 MILLISECOND AND side = """


def _interval_late(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    both = disordered(spark, sf_dir).where("id IN ('click', 'purchase')")
    both = both.withColumn("side", F.when(F.col("id") == "click", "left").otherwise("right"))
    late = eventtime.interval_late(both, "arrival", "side", 600, width=even(spark, sf_dir))
    return late.where(F.col("late") & (F.col("side") == side)).select("seq", "side")


@query(INTERVAL_LATE_SQL + "'left'")
def interval_join_late_left(spark, sf_dir):
    return _interval_late(spark, sf_dir, "left")


@query(INTERVAL_LATE_SQL + "'right'")
def interval_join_late_right(spark, sf_dir):
    return _interval_late(spark, sf_dir, "right")


# event time

FATES_SQL = f"""WITH {DISORDERED}, m AS (
    SELECT *, max(ts) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 30 MINUTE AS wm,
           {HOUR} AS w_start FROM d
), f AS (SELECT *, CASE WHEN wm >= w_start + INTERVAL 80 MINUTE THEN 'late'
    WHEN wm >= w_start + INTERVAL 60 MINUTE THEN 'again' ELSE 'on time' END AS fate FROM m)
"""


def _fates(spark: SparkSession, sf_dir: str, width: int | None = None) -> DataFrame:
    width = width or even(spark, sf_dir)
    marked = eventtime.with_watermark(disordered(spark, sf_dir), "arrival", 1800, width=width)
    return eventtime.lateness(marked, "1 hour", 1200)


@query(FATES_SQL + "SELECT seq, w_start, fate FROM f WHERE fate = 'late'")
def late_side_output(spark, sf_dir):
    return _fates(spark, sf_dir).where("fate = 'late'").select("seq", "w_start", "fate")


@query(FATES_SQL + """SELECT id, w_start, count(*) AS n, CAST(sum(vc) AS BIGINT) AS sum_vc FROM f WHERE fate <> 'late'
GROUP BY ALL""")
def allowed_lateness_final(spark, sf_dir):
    kept = _fates(spark, sf_dir).where("fate <> 'late'")
    return kept.groupBy("id", "w_start").agg(F.count("*").alias("n"), F.sum("vc").alias("sum_vc"))


@query(FATES_SQL + """, g AS (SELECT seq, id, w_start, fate,
    sum(vc) OVER w AS sum_so_far, count(*) OVER w AS n_so_far FROM f WHERE fate <> 'late'
    WINDOW w AS (PARTITION BY id, w_start ORDER BY arrival ROWS UNBOUNDED PRECEDING))
SELECT seq, id, w_start, CAST(sum_so_far AS BIGINT) AS sum_so_far, n_so_far FROM g WHERE fate = 'again'""")
def lateness_refire(spark, sf_dir):
    width = even(spark, sf_dir)
    fired = eventtime.refires(_fates(spark, sf_dir, width), ["id"], "arrival", "vc", width)
    return fired.select("seq", "id", "w_start", "sum_so_far", "n_so_far")


@query(FATES_SQL + """, g AS (SELECT seq, user_id, w_start, fate,
    count(*) FILTER (id = 'click') OVER w AS n_left, count(*) FILTER (id = 'purchase') OVER w AS n_right
    FROM f WHERE fate <> 'late' AND id IN ('click', 'purchase')
    WINDOW w AS (PARTITION BY user_id, w_start ORDER BY arrival ROWS UNBOUNDED PRECEDING))
SELECT seq, user_id, w_start, n_left, n_right FROM g WHERE fate = 'again'""")
def cogroup_refire(spark, sf_dir):
    width = even(spark, sf_dir)
    sides = _fates(spark, sf_dir, width).where("id IN ('click', 'purchase')")
    fired = eventtime.cogroup_refires(sides, ["user_id"], "arrival", F.col("id") == "click", width)
    return fired.select("seq", "user_id", "w_start", "n_left", "n_right")


@query(FATES_SQL + """, g AS (SELECT seq, user_id, w_start, fate,
    string_agg(seq, ',' ORDER BY arrival) FILTER (id = 'click') OVER w AS lefts,
    string_agg(seq, ',' ORDER BY arrival) FILTER (id = 'purchase') OVER w AS rights
    FROM f WHERE fate <> 'late' AND id IN ('click', 'purchase')
    WINDOW w AS (PARTITION BY user_id, w_start ORDER BY arrival ROWS UNBOUNDED PRECEDING))
SELECT seq, user_id, w_start, coalesce(lefts, '') AS lefts, coalesce(rights, '') AS rights FROM g WHERE fate = 'again'""")
def cogroup_refire_rows(spark, sf_dir):
    """Each firing of a window co-group after its first, with all rows of both sides so far."""
    width = even(spark, sf_dir)
    sides = _fates(spark, sf_dir, width).where("id IN ('click', 'purchase')")
    sides = sides.withColumn("side", F.when(F.col("id") == "click", "left").otherwise("right"))
    listed = lambda rows: ",".join(str(r[0]) for r in rows)
    acc = accumulators.CoGroup("side", lambda a, b: (listed(a), listed(b)), "lefts string, rights string")
    fired = eventtime.refires_by(sides, ["user_id"], "arrival", ["seq", "side"], acc, width)
    arrived = F.col("arrival") % PLACES  # the record's own number
    return fired.select(arrived.alias("seq"), "user_id", "w_start", "lefts", "rights")


@query(f"""WITH {DISORDERED} SELECT seq, max(ts) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
AS wm FROM d""")
def watermark_mono(spark, sf_dir):
    return eventtime.with_watermark(disordered(spark, sf_dir), "arrival", 0, width=even(spark, sf_dir)).select("seq", "wm")


@query(f"""WITH {DISORDERED}, p AS (SELECT *, abs(vc) % 2 AS part, arrival // {PLACES * 3600} AS clock FROM d), m AS (
    SELECT *, max(CASE WHEN part = 0 THEN clock END) OVER w AS l0, max(CASE WHEN part = 1 THEN clock END) OVER w AS l1,
           max(CASE WHEN part = 0 THEN ts END) OVER w AS t0, max(CASE WHEN part = 1 THEN ts END) OVER w AS t1
    FROM p WINDOW w AS (ORDER BY arrival ROWS UNBOUNDED PRECEDING))
SELECT seq, least(CASE WHEN clock - l0 <= 0 THEN t0 END, CASE WHEN clock - l1 <= 0 THEN t1 END)
    - INTERVAL 3 SECOND AS wm FROM m""")
def watermark_idle(spark, sf_dir):
    d = disordered(spark, sf_dir).withColumn("part", F.abs("vc") % 2)
    d = d.withColumn("clock", F.floor(F.col("arrival") / (PLACES * 3600)))
    got = eventtime.idle_watermark(d, "arrival", "part", 2, "clock", 0, 3, width=even(spark, sf_dir))
    return got.select("seq", "wm")


# keyed state


@query("""WITH {s}, p AS (SELECT *, lag(vc) OVER (PARTITION BY user_id ORDER BY seq) AS prev_vc FROM s)
SELECT seq, user_id, vc, prev_vc FROM p WHERE abs(vc - prev_vc) > 10""")
def value_state_alert(spark, sf_dir):
    return state.jump_alerts(sensors(spark, sf_dir), ["user_id"], "seq", "vc", 10).select("seq", "user_id", "vc", "prev_vc")


@query("""WITH {s} SELECT seq, id, vc, count(*) OVER (PARTITION BY id, vc ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM s""")
def map_state_counts(spark, sf_dir):
    return state.map_counts(sensors(spark, sf_dir), "id", "seq", "vc").select("seq", "id", "vc", "n")


@query("""WITH {s}, c AS (SELECT a.user_id, a.seq, b.id, count(*) AS n FROM s a JOIN s b
    ON a.user_id = b.user_id AND b.seq <= a.seq GROUP BY ALL)
SELECT user_id, seq, string_agg(id || '=' || n, ',' ORDER BY id) AS counts FROM c GROUP BY user_id, seq""")
def map_state_whole(spark, sf_dir):
    got = state.map_states(sensors(spark, sf_dir), "user_id", "seq", "id")
    shown = F.transform("entries", lambda e: F.concat_ws("=", e["value"], e["n"]))
    return got.select("user_id", "seq", F.array_join(shown, ",").alias("counts"))


@query("""WITH {s} SELECT seq, abs(vc) % 4 AS subtask, count(*) OVER (PARTITION BY abs(vc) % 4 ORDER BY seq
ROWS UNBOUNDED PRECEDING) AS n FROM s""")
def subtask_running_count(spark, sf_dir):
    dealt = sensors(spark, sf_dir).withColumn("subtask", F.abs("vc") % 4)
    return state.running_subtask_count(dealt, "subtask", "seq").select("seq", "subtask", "n")


@query("""WITH {s} SELECT seq, user_id, CAST(sum(vc) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)
AS BIGINT) AS total FROM s""")
def reducing_state_sum(spark, sf_dir):
    return running.running_sum(sensors(spark, sf_dir), ["user_id"], "seq", "vc", "total").select("seq", "user_id", "total")


@query("""WITH {s} SELECT seq, user_id, round(avg(vc) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 6)
AS avg_so_far FROM s""")
def aggregating_state_avg(spark, sf_dir):
    got = state.running_average(sensors(spark, sf_dir), ["user_id"], "seq", "vc")
    return got.select("seq", "user_id", F.round("avg_so_far", 6).alias("avg_so_far"))


@query("""WITH {s}, t AS (SELECT *, CASE WHEN id = 'signup' THEN vc END AS cfg FROM s), p AS (
    SELECT *, coalesce(last_value(cfg IGNORE NULLS) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS threshold FROM t)
SELECT seq, vc, threshold, vc - threshold AS excess FROM p WHERE id <> 'signup' AND vc > threshold""")
def broadcast_threshold(spark, sf_dir):
    s = sensors(spark, sf_dir)
    config = s.where("id = 'signup'").select("seq", F.col("vc").alias("threshold"))
    width = running.even_width(s, "seq")
    got = joins.broadcast_as_of(s.where("id <> 'signup'"), config, "seq", "threshold", 0, width)
    return got.where("vc > threshold").select("seq", "vc", "threshold", (F.col("vc") - F.col("threshold")).alias("excess"))


@query("""WITH {s}, t AS (SELECT *, user_id % 3 AS part, CASE WHEN id = 'signup' THEN vc END AS cfg FROM s), p AS (
    SELECT *, coalesce(last_value(cfg IGNORE NULLS) OVER (PARTITION BY part ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS threshold
    FROM t)
SELECT seq, CAST(vc - threshold AS BIGINT) AS excess, CAST((SELECT count(DISTINCT b.user_id % 3) FROM s b
    WHERE b.id = 'signup' AND b.seq < p.seq) AS BIGINT) AS entries FROM p WHERE id <> 'signup'""")
def broadcast_entries(spark, sf_dir):
    """Broadcast state of several entries: a threshold for each third of the users, and how many there are so far."""
    s = sensors(spark, sf_dir)
    got = joins.broadcast_process(
        s.where("id <> 'signup'"),
        s.where("id = 'signup'"),
        "seq",
        ["user_id", "vc"],
        lambda row: {row.user_id % 3: row.vc},
        lambda entries, row: (row.vc - entries.get(row.user_id % 3, 0), len(entries)),
        "excess long, entries long",
        running.even_width(s, "seq"),
    )
    return got


@query("""WITH {s}, p AS (SELECT seq, user_id, lag(vc) OVER w AS v, lag(seq) OVER w AS prev_seq FROM s
    WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT seq, user_id, CASE WHEN seq - prev_seq < 100 THEN v END AS state FROM p""")
def ttl_replay(spark, sf_dir):
    s = sensors(spark, sf_dir).withColumn("clock", F.col("seq"))
    return state.with_ttl(s, ["user_id"], "seq", "vc", "clock", 100).select("seq", "user_id", "state")


@query(f"""WITH {{s}}, m AS (SELECT max(ts) AS mark FROM s)
SELECT DISTINCT id, {HOUR} + INTERVAL 1 HOUR AS fires_at FROM s, m WHERE {HOUR} + INTERVAL 1 HOUR < mark""")
def timer_replay(spark, sf_dir):
    s = sensors(spark, sf_dir).withColumn("at", F.window("ts", "1 hour")["end"])
    return state.timer_firings(s, ["id"], "ts", "at")


# tables, SQL and functions


@query("WITH {s} SELECT seq, id, vc FROM s WHERE vc > 2")
def sql_filter(spark, sf_dir):
    return spark.sql("SELECT seq, id, vc FROM {s} WHERE vc > 2", s=sensors(spark, sf_dir))


@query("WITH {s} SELECT id, CAST(sum(vc) AS BIGINT) AS sum_vc FROM s GROUP BY id")
def sql_group_sum(spark, sf_dir):
    return spark.sql("SELECT id, sum(vc) AS sum_vc FROM {s} GROUP BY id", s=sensors(spark, sf_dir))


@query("""WITH {s} SELECT user_id, CAST(sum(vc) AS INT) AS sum_vc FROM s WHERE user_id > 5 GROUP BY user_id""")
def table_api_group(spark, sf_dir):
    s = sensors(spark, sf_dir).where("user_id > 5")
    return s.groupBy("user_id").agg(F.sum("vc").cast("int").alias("sum_vc"))


@query("""WITH {s}, r AS (SELECT id, seq, sum(vc) OVER w AS now, row_number() OVER w AS n, sum(vc) OVER (PARTITION BY id
    ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM s
    WINDOW w AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT id, seq, CASE WHEN n = 1 THEN '+I' ELSE '+U' END AS op, CAST(now AS BIGINT) AS total FROM r
UNION ALL SELECT id, seq, '-U', CAST(old AS BIGINT) FROM r WHERE n > 1""")
def changelog(spark, sf_dir):
    return state.changelog(sensors(spark, sf_dir), ["id"], "seq", "vc")


@query("""WITH RECURSIVE w AS (SELECT DISTINCT c_name AS t FROM customer), h AS (
    SELECT t, 0 AS i, CAST(0 AS BIGINT) AS v FROM w UNION ALL
    SELECT t, i + 1, ((v * 31 + ascii(substring(t, i + 1, 1))) + 2147483648) % 4294967296
        + CASE WHEN ((v * 31 + ascii(substring(t, i + 1, 1))) + 2147483648) % 4294967296 < 0 THEN 4294967296 ELSE 0 END
        - 2147483648 FROM h WHERE i < length(t)
) SELECT t AS name, CAST(v AS INT) AS hash FROM h WHERE i = length(t)""")
def scalar_hash(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).distinct()
    return names.select("name", udfs.java_hash(F.col("name")).alias("hash"))


@query("""SELECT p_partkey, word, CAST(length(word) AS INT) AS length
FROM part, unnest(string_split(p_name, ' ')) AS u(word)""")
def lateral_split_left(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return joins.lateral_split(parts, transforms.java_split(F.col("p_name"))).select("p_partkey", "word", "length")


@query("""SELECT p_partkey, word, CAST(length(word) AS INT) AS length
FROM part, unnest(string_split(p_name, ' ')) AS u(word) WHERE p_size > 10""")
def lateral_split_inner(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_name")
    got = joins.lateral_split(parts, transforms.java_split(F.col("p_name")), outer=False)
    return got.select("p_partkey", "word", "length")


@query("""SELECT l_suppkey, round(CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS DOUBLE) / sum(l_linenumber), 6)
AS w_avg FROM lineitem GROUP BY l_suppkey""")
def weighted_avg(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    got = udfs.weighted_avg(F.col("l_quantity"), F.col("l_linenumber"))
    return items.groupBy("l_suppkey").agg(F.round(got, 6).alias("w_avg"))


@query("""WITH {s} SELECT seq, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(CAST(floor(extract('millisecond' FROM ts))
AS INT) % 1000 AS VARCHAR), 3, '0') AS shown FROM s""")
def format_time(spark, sf_dir):
    return sensors(spark, sf_dir).select("seq", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("shown"))


# sources, partitions and sinks that give rows


@query("SELECT 'Number：' || i AS value FROM range(0, (SELECT count(*) FROM events)) AS r(i)")
def generator_source(spark, sf_dir):
    """As many generated records as there are events."""
    n = table(spark, sf_dir, "events").count()
    return generate(spark, n, lambda n: F.concat(F.lit("Number："), n.cast("string"))).select("value")


@query("""SELECT CAST(1 + ('0x' || md5(i || ':7')[1:8])::BIGINT % 10 AS INT) AS id, CAST(1 + i AS BIGINT) AS ts,
CAST(1 + ('0x' || md5(i || ':8')[1:8])::BIGINT % 100 AS INT) AS vc FROM range(0, (SELECT count(*) FROM orders)) AS r(i)""")
def datagen_table(spark, sf_dir):
    """As many generated rows as there are orders."""
    n = table(spark, sf_dir, "orders").count()
    got = datagen(spark, n, {"id": ("random", 1, 10, 7), "ts": ("sequence", 1, n, 0), "vc": ("random", 1, 100, 8)})
    return got.select(F.col("id").cast("int").alias("id"), "ts", F.col("vc").cast("int").alias("vc"))


@query("WITH {s} SELECT abs(vc) % 4 AS subtask, count(*) AS n FROM s GROUP BY ALL")
def partition_custom(spark, sf_dir):
    dealt = transforms.custom_partition(sensors(spark, sf_dir), 4, F.abs("vc"))
    return dealt.groupBy(F.spark_partition_id().alias("subtask")).agg(F.count("*").alias("n"))


@query("""WITH {s} SELECT CAST(seq AS VARCHAR) AS key, id || ',' || seq || ',' || vc AS value FROM s""")
def keyed_records(spark, sf_dir):
    lines = sensors(spark, sf_dir).select(F.concat_ws(",", "id", "seq", "vc").alias("value"))
    return keyed_record(lines).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


# live forms, over the table as a stream


def live_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of sensor records, in a session beside the given one."""
    schema = table(spark, sf_dir, "events").schema
    # a pattern, as a stream's plain path must be a folder, and the table may be a file
    stream = files.parquet_stream(runtime.live_session(spark), f"{sf_dir}/events.[p]arquet", schema)
    return sensor_view(stream).withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH {s} SELECT seq, vc, prev_vc FROM (
    SELECT *, lag(vc) OVER (PARTITION BY user_id ORDER BY seq) AS prev_vc FROM s) WHERE abs(vc - prev_vc) > 10""")
def live_value_state(spark, sf_dir):
    keyed = live_sensors(spark, sf_dir).select(F.col("user_id").cast("string").alias("id"), "seq", "vc")
    return runtime.finished(processors.stateful(keyed, processors.JumpAlerts())).select("seq", "vc", "prev_vc")


@query("""WITH {s}, r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn,
    sum(vc) OVER w AS sum_vc, count(*) OVER w AS n FROM s
    WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT user_id, rn AS fired_at, CAST(sum_vc AS BIGINT) AS sum_vc, n FROM r WHERE rn % 2 = 0""")
def live_count_sliding(spark, sf_dir):
    stream = live_sensors(spark, sf_dir)
    return runtime.finished(live_windows.count_windows(stream, "user_id", accumulators.SumAndCount("vc"), ["vc"], 5, 2))


@query("""WITH {s}, p AS (SELECT *, ts + to_seconds(1800) AS ends FROM s), q AS (
    SELECT *, CASE WHEN ts <= max(ends) OVER (PARTITION BY user_id ORDER BY ts, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM p
), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS no FROM q), w AS (
    SELECT user_id, min(ts) AS w_start, max(ends) AS w_end, CAST(sum(vc) AS BIGINT) AS sum_vc, count(*) AS n FROM g GROUP BY user_id, no)
SELECT user_id, epoch_us(w_start) // 1000 AS w_start, epoch_us(w_end) // 1000 AS w_end, sum_vc, n FROM w
WHERE epoch_us(w_end) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 FROM s)""")
def live_sessions(spark, sf_dir):
    """Sessions that the end of the input has closed."""
    stream = live_sensors(spark, sf_dir)
    found = runtime.finished(live_windows.sessions(stream, "user_id", accumulators.SumAndCount("vc"), ["vc"], 1800))
    return found.select("user_id", F.unix_millis("w_start").alias("w_start"), F.unix_millis("w_end").alias("w_end"), "sum_vc", "n")


@query(f"""WITH {{s}}, w AS (SELECT id, {HOUR} AS w_start, count(*) AS n, CAST(sum(vc) AS BIGINT) AS sum_vc FROM s GROUP BY ALL)
SELECT id, epoch_ms(w_start) AS w_start, sum_vc, n FROM w WHERE w_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM s)""")
def live_tumbling(spark, sf_dir):
    """First firings of the windows that the end of the input has closed, by an accumulator of the user."""
    stream = live_sensors(spark, sf_dir)
    found = runtime.finished(live_windows.refiring_windows(stream, "id", accumulators.SumAndCount("vc"), ["vc"], 3600))
    return found.where("kind = 'fire'").select("id", F.unix_millis("w_start").alias("w_start"), "sum_vc", "n")


@query("""WITH {s} SELECT a.user_id, a.seq AS l_seq, b.seq AS r_seq FROM s a JOIN s b ON a.user_id = b.user_id
WHERE a.id = 'click' AND b.id = 'purchase'""")
def live_connect(spark, sf_dir):
    """Every pair of a key's two inputs, once, by a two-input function with state of its own."""
    stream = live_sensors(spark, sf_dir).select("user_id", "id", "seq")
    left = stream.where("id = 'click'").select("user_id", "seq", F.col("seq").alias("l_seq"))
    right = stream.where("id = 'purchase'").select("user_id", "seq", F.col("seq").alias("r_seq"))
    function = live_windows.Pairs("user_id long, l_seq long, r_seq long", ["l_seq"], ["r_seq"])
    return runtime.finished(live_windows.connected(left, right, "user_id", function))


@query("""WITH {s}, t AS (SELECT *, CASE WHEN id = 'signup' THEN vc END AS cfg FROM s), p AS (
    SELECT *, coalesce(last_value(cfg IGNORE NULLS) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS threshold FROM t)
SELECT seq, vc, threshold FROM p WHERE id <> 'signup'""")
def live_config(spark, sf_dir):
    """Broadcast state in the order of arrival: each record with the threshold that stood."""
    stream = live_sensors(spark, sf_dir).select("seq", "vc", (F.col("id") == "signup").alias("config"))
    states = runtime.scratch(spark)

    def sink(path):
        return live.config_in_order("seq", "config", "vc", "threshold", 0, states, once_per_batch(path))

    found = runtime.finished(stream, sink=sink, schema="seq long, vc int, config boolean, threshold int")
    return found.select("seq", "vc", "threshold")
