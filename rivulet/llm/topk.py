"""Exact top-k search by inner product: every query against every vector, a term at a time.

A term is a place in the vectors. In a block of rows, each term has postings: the rows that are not zero there, and
their weights. A query is a sparse row of (term, weight); for each of its terms the weighted postings are scattered
into a dense array of scores, one for each row of the block. Each block's best k are selected by partition, and Spark
merges the blocks' selections by rank.

Queries and rows are dealt to a grid of (query block, row block) groups of bounded size, so that neither side is ever
whole in one place. The work is queries times rows by the contract; a row is shuffled once for each query block, that
is once for every QUERY_BLOCK queries.

Defined results: rows with a null vector, or one with a null or non-finite component, take no part. Empty vectors do,
with scores of 0; of vectors of different lengths the common places count. A row without an id is no query, and a
candidate after all others of the same score. Rows with the query's id are no candidates of it; repeated query rows
give repeated rows, repeated candidates take a rank each. Scores past the range of long are ranked and given as its
limits. An empty table gives none. Columns other than the two named are never read. The blocks are told by the place
of a row in its partition, which a table read again after a loss gives again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024

#: Most rows and queries of a group; the least rows for which a group of its own is worth while.
BLOCK, QUERY_BLOCK, LEAST = 65_536, 32_768, 512

#: Queries and rows of one dense array of scores: about 1 MB.
QUERY_ROWS, ROWS = 64, 2_048

LOW, HIGH = -(2**63) + 1, 2**63 - 1


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: finite(x.cast("double")))


def search(
    vectors: DataFrame,
    k: int,
    every: int,
    scale: int = SCALE,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row whose vec_id is divisible by `every`."""
    rows = vectors.select("vec_id", "embedding").where(usable(F.col("embedding")))
    asked = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    n, n_asked = rows.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(math.ceil(n / block), min(parts, math.ceil(n / LEAST)), 1)
    query_blocks = max(math.ceil(n_asked / query_block), 1)

    placed = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = lambda number: F.pmod(F.xxhash64("row", "vec_id"), F.lit(number)).cast("int")
    every_block = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    left = placed.where(asked).select(
        F.col("vec_id").alias("query_id"),
        F.col("row").alias("query_row"),
        "embedding",
        dealt(query_blocks).alias("q"),
        every_block(blocks).alias("b"),
    )
    right = placed.select("vec_id", "embedding", dealt(blocks).alias("b"), every_block(query_blocks).alias("q"))

    def best(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        return _block_best(queries, candidates, k, scale)

    found = (
        left.groupBy("q", "b")
        .cogroup(right.groupBy("q", "b"))
        .applyInArrow(best, "query_id long, query_row long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _sparse(column: pa.ChunkedArray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every component that is not zero."""
    lengths = pc.list_value_length(column).to_numpy().astype(np.int64)
    values = pc.list_flatten(column).to_numpy().astype(np.float64)
    terms = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        weights = np.nan_to_num(np.floor(scale * values))
    there = weights != 0
    return np.repeat(np.arange(len(lengths)), lengths)[there], terms[there], weights[there]


def _postings(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each term: the rows that have it, and their weights."""
    order = np.argsort(terms, kind="stable")
    found, starts = np.unique(terms[order], return_index=True)
    cut = lambda x: np.split(x[order], starts[1:])
    return dict(zip(found.tolist(), zip(cut(rows), cut(weights), strict=True), strict=True)) if len(found) else {}


def _chunks(column: pa.ChunkedArray, scale: int, size: int) -> Iterator[tuple[int, int, tuple]]:
    """Start, end and components of `size` rows at a time."""
    for start in range(0, len(column), size):
        part = column.slice(start, size)
        yield start, start + len(part), _sparse(part, scale)


def _number_kind(queries: tuple, candidates: tuple) -> type:
    """The narrowest kind of number that no score of the two can leave."""
    largest = [max((abs(int(w)) for w in (x[2].min(), x[2].max())), default=0) if len(x[2]) else 0 for x in (queries, candidates)]
    bound = largest[0] * largest[1] * (1 + int(queries[1].max(initial=0)))
    return np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object


def _weights(parts: tuple, kind: type) -> tuple:
    rows, terms, weights = parts
    if kind is object:
        return rows, terms, np.array([int(w) for w in weights], dtype=object)
    return rows, terms, weights.astype(kind)


def _scores(queries: dict, postings: dict, shape: tuple[int, int], kind: type) -> np.ndarray:
    """Each term of the queries scatters its weighted postings into the array of scores."""
    scores = np.zeros(shape, dtype=kind)
    for term, (which, weights) in queries.items():
        if term in postings:
            rows, held = postings[term]
            added = np.multiply.outer(weights, held)
            if added.shape == shape:
                scores += added
            else:
                scores[np.ix_(which, rows)] += added
    return np.clip(scores, LOW, HIGH).astype(np.int64)


def _select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of the k best of each query's scores, earlier rows first where they tie."""
    if scores.shape[1] <= k:
        return np.nonzero(scores >= LOW)
    at = scores.shape[1] - k
    edge = np.partition(scores, at, axis=1)[:, at : at + 1]
    above, level = scores > edge, scores == edge
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero((above | (level & (np.cumsum(level, axis=1) <= room))) & (scores >= LOW))


def _block_best(queries: pa.Table, candidates: pa.Table, k: int, scale: int) -> pa.Table:
    """The k best of a block of rows for each query of a block of queries."""
    candidates = candidates.select(["vec_id", "embedding"]).sort_by([("vec_id", "ascending")])  # nulls come last
    ids, asked = candidates["vec_id"].combine_chunks(), queries["query_id"].to_numpy()
    known = ids.drop_null().to_numpy()
    out: list[pa.Table] = []
    blocks = [(lo, hi, parts) for lo, hi, parts in _chunks(candidates["embedding"], scale, ROWS)]
    for start, end, parts in _chunks(queries["embedding"], scale, QUERY_ROWS):
        own = np.searchsorted(known, asked[start:end], "left"), np.searchsorted(known, asked[start:end], "right")
        for lo, hi, held in blocks:
            kind = _number_kind(parts, held)
            terms, postings = _postings(*_weights(parts, kind)), _postings(*_weights(held, kind))
            scores = _scores(terms, postings, (end - start, hi - lo), kind)
            for q in np.flatnonzero((own[0] < hi) & (own[1] > lo)):
                scores[q, max(own[0][q] - lo, 0) : max(own[1][q] - lo, 0)] = LOW - 1
            which, rows = _select(scores, k)
            out.append(
                pa.table(
                    {
                        "query_id": queries["query_id"].take(pa.array(start + which)),
                        "query_row": queries["query_row"].take(pa.array(start + which)),
                        "vec_id": ids.take(pa.array(lo + rows)),
                        "score": scores[which, rows],
                    }
                )
            )
    schema = pa.schema([(name, pa.int64()) for name in ("query_id", "query_row", "vec_id", "score")])
    return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()
