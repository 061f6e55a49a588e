"""Running and windowed aggregates by accumulators of the user.

The arrival order is cut into chunks as for the built-in running aggregates: each (key, chunk) is folded to a partial
state, a key's partial states are merged in the order of the chunks, and each chunk is then walked again from what the
earlier ones merge to. So a key with a third of all rows is spread over its chunks. Every step is a shuffle by its groups,
a sort within partitions, and Python over the sorted rows as they stream by: a task holds one state at a time.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rivulet.functions.accumulators import Accumulator
from rivulet.operators.running import WIDTH, Width

_CHUNK, _STATE, _FIRST = "__chunk", "__state", "__first"
#: Rows that a task hands on at once.
SENT_ROWS = 10_000

Body = Callable[[tuple, Iterator[tuple]], Iterator[tuple]]


def _with_chunk(df: DataFrame, seq: str, width: Width) -> DataFrame:
    return df.withColumn(_CHUNK, F.coalesce(F.floor(F.col(seq) / width), F.lit(-1)))


def _schema(df: DataFrame, names: list[str], more: str) -> T.StructType:
    fields = [T.StructField(n, df.schema[n].dataType) for n in names]
    return T.StructType([*fields, *df.sparkSession.createDataFrame([], more).schema.fields])


def _streamed(df: DataFrame, groups: list[str], order: list[str], body: Body, schema: T.StructType) -> DataFrame:
    """body(group, rows) for each group of df, whose columns are the groups and what a row is; rows come in order."""
    arrow, n = to_arrow_schema(schema), len(groups)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], field.type) for k, field in enumerate(arrow)]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for b in batches for line in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        # NaN, which equals nothing, is one key
        for _, own in groupby(lines, key=lambda r: tuple("NaN" if v != v else v for v in r[:n])):
            first = next(own)
            for made in body(first[:n], (r[n:] for r in _chained(first, own))):
                out.append(made)
                if len(out) == SENT_ROWS:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    rest = [c for c in df.columns if c not in groups]
    placed = df.select(*groups, *rest)
    placed = placed.repartition(*groups) if groups else placed.coalesce(1)
    return placed.sortWithinPartitions(*groups, *order).mapInArrow(run, schema)


def processed(df: DataFrame, columns: list[str], body: Callable[[tuple], Iterator[tuple]], schema: str) -> DataFrame:
    """What a process function of the user gives for each row: any number of tuples of `schema`, no shuffle."""
    record, arrow = namedtuple("Row", columns), to_arrow_schema(_schema(df, [], schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [made for line in zip(*(c.to_pylist() for c in b.columns), strict=True) for made in body(record(*line))]
            columns_ = [pa.array([r[k] for r in out], field.type) for k, field in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(columns_, schema=arrow)

    named = [F.col(c).alias(f"__{k}") for k, c in enumerate(columns)]
    return df.select(*named).mapInArrow(run, _schema(df, [], schema))


def _chained(first: tuple, others: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from others


def _partial(df: DataFrame, groups: list[str], seq: str, columns: list[str], acc: Accumulator) -> DataFrame:
    """groups, the chunk, and the pickled state of the rows of each."""
    record = namedtuple("Row", columns)
    named = [F.col(c).alias(f"__{k}") for k, c in enumerate(columns)]

    def fold(group: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        state = acc.create()
        for _, *values in rows:
            state = acc.add(state, record(*values))
        yield (*group, pickle.dumps(state))

    keys = [*groups, _CHUNK]
    rows = df.select(*keys, F.col(seq).alias("__seq"), *named)
    return _streamed(rows, keys, ["__seq"], fold, _schema(df, keys, f"{_STATE} binary"))


def _finished(partial: DataFrame, groups: list[str], results: Callable, schema: T.StructType, acc: Accumulator) -> DataFrame:
    """groups and the rows that results(state) gives, of each group's states merged in the order of the chunks."""

    def finish(group: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        state = acc.create()
        for _, part in rows:
            state = acc.merge(state, pickle.loads(part))
        for out in results(state):
            yield (*group, *out)

    return _streamed(partial.select(*groups, _CHUNK, _STATE), groups, [_CHUNK], finish, schema)


def running_accumulate(df: DataFrame, keys: list[str], seq: str, columns: list[str], acc: Accumulator,
                       width: Width = WIDTH, carry: list[str] | None = None) -> DataFrame:
    """keys, seq and the accumulator's result over the key's rows up to each one.

    seq numbers the arrivals, without ties within a key. columns: what acc sees; carry: columns that the result has
    besides. Null keys are a key of their own.
    """
    record, carry = namedtuple("Row", columns), carry or []
    rows = _with_chunk(df.select(*dict.fromkeys([*keys, seq, *carry, *columns])), seq, width)

    def before(group: tuple, parts: Iterator[tuple]) -> Iterator[tuple]:
        """Each chunk with what the earlier ones merge to."""
        state = acc.create()
        for chunk, part in parts:
            yield (*group, chunk, pickle.dumps(state))
            state = acc.merge(state, pickle.loads(part))

    partial = _partial(rows, keys, seq, columns, acc)
    earlier = _streamed(partial, keys, [_CHUNK], before, partial.schema)

    # a chunk's state comes before its rows: they are one table, and the states have no seq
    n = 1 + len(carry)
    kept = [F.col(c).alias(f"__kept{k}") for k, c in enumerate([seq, *carry])]
    seen = [F.col(c).alias(f"__{k}") for k, c in enumerate(columns)]
    walked = rows.select(*keys, _CHUNK, *kept, *seen, F.lit(None).cast("binary").alias(_STATE))
    both = walked.unionByName(earlier, allowMissingColumns=True)

    def emit(group: tuple, lines: Iterator[tuple]) -> Iterator[tuple]:
        state = None
        for *values, given in lines:
            if given is not None:
                state = pickle.loads(given)
                continue
            state = acc.add(state, record(*values[n:]))
            yield (*group[:-1], *values[:n], *acc.result(state))

    order = both.withColumn(_FIRST, F.col(_STATE).isNull()).select(*keys, _CHUNK, *both.columns[len(keys) + 1 :], _FIRST)
    schema = _schema(rows, [*keys, seq, *carry], acc.schema)
    body = lambda group, lines: emit(group, (line[:-1] for line in lines))
    return _streamed(order, [*keys, _CHUNK], [_FIRST, "__kept0"], body, schema)


def window_accumulate(df: DataFrame, keys: list[str], seq: str, columns: list[str], acc: Accumulator, size: str,
                      slide: str | None = None, ts: str = "ts", width: Width = WIDTH) -> DataFrame:
    """keys, w_start, w_end and the accumulator's result over each tumbling or (with slide) sliding window."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    groups = [*keys, "w_start", "w_end"]
    placed = df.select(*dict.fromkeys([*keys, seq, *columns]), window.alias("__w"))
    placed = placed.withColumns({"w_start": F.col("__w.start"), "w_end": F.col("__w.end")}).drop("__w")
    partial = _partial(_with_chunk(placed, seq, width), groups, seq, columns, acc)
    return _finished(partial, groups, lambda state: [acc.result(state)], _schema(partial, groups, acc.schema), acc)


def table_accumulate(df: DataFrame, keys: list[str], seq: str, columns: list[str], acc: Accumulator,
                     width: Width = WIDTH) -> DataFrame:
    """keys and the rows of a table aggregate of the user: an accumulator whose result is a list of tuples of its schema."""
    rows = _with_chunk(df.select(*dict.fromkeys([*keys, seq, *columns])), seq, width)
    partial = _partial(rows, keys, seq, columns, acc)
    return _finished(partial, keys, acc.result, _schema(partial, keys, acc.schema), acc)
