"""Running aggregates by key: one updated record for each input record, in arrival order.

A window over the key alone would give a frequent key to one task. So the order
is cut into chunks: what the key's earlier chunks add up to, one row for each
(key, chunk), is put before the chunk's records, and a window over (key, chunk)
aggregates both. The largest task holds one chunk of one key.

A chunk is WIDTH arrival numbers, which fits arrivals that are numbered without
large gaps. For other numbers (times, ids of several makers) and for more than
CHUNKS * WIDTH records, even_width measures what makes chunks of WIDTH records on
average, but CHUNKS of them at most: by one aggregate over the numbers alone. Then
the window over a key's chunks, and over all chunks where there is no key, has
about CHUNKS rows at most.

Keys become columns without nulls before the window, so that records and the rows
before them meet; the records themselves are shuffled and sorted once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

#: Numbers in a chunk, or records on average where the width is measured, and chunks at most.
WIDTH, CHUNKS = 1 << 18, 1 << 16
#: The column that holds a row's chunk.
_CHUNK = "__chunk"
Width = int | Column

#: Aggregates of which the results of parts can be aggregated again.
_KINDS: dict[str, Callable] = {"sum": F.sum, "max": F.max, "min": F.min}
#: 0 for what a key's earlier chunks add up to, 1 for a record.
_ROW = "__row"


def measured(df: DataFrame, seq: str) -> tuple[int, int]:
    """The records of df that are numbered, and the numbers in a chunk: by one aggregate."""
    low, high, n = df.agg(F.min(seq), F.max(seq), F.count(seq)).first()
    chunks = min(max(-(-n // WIDTH), 1), CHUNKS)
    return n, max(-(-int(high - low + 1) // chunks), 1) if n else WIDTH


def even_width(df: DataFrame, seq: str) -> int:
    """The numbers in a chunk of df, for the width of the functions below: measured once."""
    return measured(df, seq)[1]


def _chunked(df: DataFrame, keys: list[str], seq: str, width: Width) -> tuple[DataFrame, list[str]]:
    """df with its chunk and with keys that are never null, and the names of those."""
    chunk = F.floor(F.col(seq) / width)
    plain, nulls = {}, []
    for i, key in enumerate(keys):
        kind = df.schema[key].dataType
        if isinstance(kind, T.NumericType | T.StringType):
            plain[f"__k{i}"] = F.coalesce(F.col(key), F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind))
            nulls.append(F.col(key).isNull().cast("int") * (1 << i))
        else:
            plain[f"__k{i}"] = F.struct(F.col(key))
    if nulls:
        plain["__nulls"] = sum(nulls[1:], nulls[0])
    plain[_CHUNK] = F.coalesce(chunk, F.lit(-1))
    return df.select("*", *[c.alias(n) for n, c in plain.items()]), list(plain)


def _upto(keys: list[str], seq: str, inclusive: bool = True) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def running(
    df: DataFrame,
    keys: list[str],
    seq: str,
    aggregates: dict[str, tuple[str, Column]],
    width: Width = WIDTH,
    inclusive: bool = True,
) -> DataFrame:
    """df with a column for each name -> (kind, value): the aggregate over the key's rows up to this one.

    seq numbers the arrivals, without ties within a key. inclusive False leaves the row itself out.
    A value may be a struct, which min and max compare field by field. width: numbers in a chunk.
    """
    rows, plain = _chunked(df, keys, seq, width)
    values = {n: (_KINDS[kind], value) for n, (kind, value) in aggregates.items()}
    earlier = _upto([k for k in plain if k != _CHUNK], _CHUNK, inclusive=False)
    sums = rows.groupBy(*plain).agg(*[fold(value).alias(f"__{n}") for n, (fold, value) in values.items()])
    heads = sums.select(*plain, *[fold(f"__{n}").over(earlier).alias(f"__{n}") for n, (fold, _) in values.items()])
    typed = {n: value.cast(sums.schema[f"__{n}"].dataType) for n, (_, value) in values.items()}
    lines = rows.select("*", *[value.alias(f"__{n}") for n, value in typed.items()], F.lit(1).alias(_ROW))
    lines = lines.unionByName(heads.withColumn(_ROW, F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(*plain).orderBy(_ROW, seq).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    got = lines.select("*", *[fold(f"__{n}").over(inside).alias(n) for n, (fold, _) in values.items()])
    return got.where(F.col(_ROW) == 1).select(*df.columns, *values)


def previous(df: DataFrame, keys: list[str], seq: str, values: list[str], width: Width = WIDTH) -> DataFrame:
    """df with prev_<value> of the key's record before this one, null for its first."""
    last = F.struct(F.col(seq).alias("at"), *[F.col(v) for v in values])
    got = running(df, keys, seq, {"__last": ("max", last)}, width, inclusive=False)
    return got.select(*df.columns, *[F.col(f"__last.{v}").alias(f"prev_{v}") for v in values])


def running_sum(df: DataFrame, keys: list[str], seq: str, value: str, name: str, width: Width = WIDTH,
                others: list[str] | None = None) -> DataFrame:
    """The sum of one field; the others, if given, stay those of the key's first record, as first_<field>."""
    sums = {name: ("sum", F.col(value))}
    if not others:
        return running(df, keys, seq, sums, width)
    got = running(df, keys, seq, sums | {"__first": ("min", _record(seq, others))}, width)
    return got.select(*df.columns, name, *_first(others))


def _record(seq: str, others: list[str]) -> Column:
    return F.struct(F.col(seq).alias("at"), *[F.col(c) for c in others])


def _first(others: list[str]) -> list[Column]:
    return [F.col(f"__first.{c}").alias(f"first_{c}") for c in others]


def running_extreme(df: DataFrame, keys: list[str], seq: str, value: str, kind: str, others: list[str],
                    width: Width = WIDTH) -> DataFrame:
    """max or min of one field; the other fields stay those of the key's first record."""
    extreme = {f"{kind}_{value}": (kind, F.col(value)), "__first": ("min", _record(seq, others))}
    return running(df, keys, seq, extreme, width).select(*df.columns, f"{kind}_{value}", *_first(others))


def running_extreme_by(df: DataFrame, keys: list[str], seq: str, value: str, kind: str, others: list[str],
                       width: Width = WIDTH) -> DataFrame:
    """The whole record that has the highest or lowest field; of equal ones the first. Null fields do not count."""
    tie = -F.col(seq) if kind == "max" else F.col(seq)
    record = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("by"), tie.alias("tie"), *[F.col(c) for c in others]))
    got = running(df, keys, seq, {"__best": (kind, record)}, width)
    return got.select(
        *df.columns, F.col("__best.by").alias(f"{kind}_{value}"), *[F.col(f"__best.{c}").alias(f"at_{c}") for c in others]
    )


def running_reduce(df: DataFrame, keys: list[str], seq: str, value: str, width: Width = WIDTH) -> DataFrame:
    """The reducer (key, latest time, summed value): the first record of a key passes unchanged."""
    return running_sum(df, keys, seq, value, f"sum_{value}", width=width)


def numbered(df: DataFrame, keys: list[str], seq: str, name: str = "rn", width: Width = WIDTH) -> DataFrame:
    """row_number by key."""
    return running(df, keys, seq, {name: ("sum", F.lit(1).cast("long"))}, width)


def _tops(df: DataFrame, value: str, n: int, upto: WindowSpec, before: WindowSpec) -> DataFrame:
    """df with __top1 to __topn: the highest values so far, highest first.

    What a value keeps out of a place, itself or what it displaces, is the next place's value.
    """
    left = F.col(value)
    for k in range(1, n + 1):
        df = df.withColumn("__left", left).withColumn(f"__top{k}", F.max("__left").over(upto))
        last = F.max("__left").over(before)
        left = F.when(F.col("__left").isNotNull() & last.isNotNull(), F.least(F.col("__left"), last))
    return df.drop("__left")


def running_top(df: DataFrame, key: str, seq: str, value: str, n: int = 3, width: Width = WIDTH) -> DataFrame:
    """After each record, the key's n highest values so far, highest first, as "a,b,c". Null values do not count."""
    rows, plain = _chunked(df.select(key, seq, value), [key], seq, width)
    names = [f"__top{k}" for k in range(1, n + 1)]
    local = _tops(rows, value, n, _upto(plain, seq), _upto(plain, seq, inclusive=False))
    # the n highest of each chunk, in places of their own; the tops up to the last place are the chunk's and all earlier
    best = local.groupBy(*plain).agg(F.max_by(F.array(*names), F.col(seq)).alias("__best"))
    placed = best.select(*plain, F.posexplode("__best").alias("__place", "__v"))
    keys = [k for k in plain if k != _CHUNK]
    order = Window.partitionBy(*keys).orderBy(_CHUNK, "__place")
    upto, before = (order.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    until = _tops(placed, "__v", n, upto, before).where(F.col("__place") == n - 1)
    earlier = until.select(*plain, F.lag(F.array(*names)).over(Window.partitionBy(*keys).orderBy(_CHUNK)).alias("__before"))
    both = F.concat(F.coalesce("__before", F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>")), F.array(*names))
    top = F.slice(F.sort_array(F.filter(both, lambda v: v.isNotNull()), asc=False), 1, n)
    return local.join(earlier, plain).select(key, seq, F.array_join(top.cast("array<string>"), ",").alias("top"))
