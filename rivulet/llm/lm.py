"""LM scoring by a weighted backoff automaton.

Training counts every token of every training text and every pair of adjacent
tokens. A pair that occurs `least` times or more is an arc, at any size of the
corpus (1 keeps every pair); a state is the last token (or none, the root). An arc
holds the discounted log-probability of its pair; the failure arc to the root holds
the state's backoff weight, so that the probabilities after any state sum to 1. The
root has every known token, add-one smoothed, and one unseen token.

No machine is held whole and walked, as its arcs grow with the corpus. With order 2
the state after a token is that token, so that a text's traversal is its adjacent
tokens from left to right, and its log-probability a sum: for each token what the
root and the failure arc from the token give, and for each arc taken what it gives
beyond those. Both are rows of
tables that grow with the corpus. Tokens and pairs that make up RATE of the
training tokens or more, 1 / RATE of each at most, are broadcast and looked up in
the task that reads the text; all others by a join: each task emits (token or
pair, text, times) for those and sums come back by text. RATE decides only where
an arc is looked up. A bitmap of a fixed size spares the join most pairs that are
no arcs; a pair that it lets through by chance meets nothing.

Broadcast tokens go by their places, so that a pair of two of them is one small
number: it is counted, weighed and looked up as that, and a broadcast join finds
its tokens' counts. Other tokens go by negative hashes. Python reads the texts, to
count and to score; what is between is joins of Spark, so that no task has more
than one Python worker.

Defined results: a null or empty text is its end token alone; a null doc_id
trains and is not held out; repeated rows count as often as they occur and each
gets its row; an empty table gives an empty result; only the id and the text are
read. Tokens and pairs are told apart by 63-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rivulet.llm.common import PART_ROWS, remainder, shared_folder

FOLDS, HELD_OUT = 7, 2
#: The share of the training tokens that puts a token or a pair into the broadcast tables.
RATE = 2.5e-7
#: The times that make a pair an arc, where the caller does not say.
LEAST = 2
#: The bitmap of pairs has this power of two of bits, in words of 64.
BITMAP = 27
DISCOUNT = 0.75
#: No word can contain it.
END = b"\n"
#: Tokens that a task counts before it hands the counts on.
FLUSH = 750_000
#: Rows of counts that a task hands on at once.
SENT_ROWS = 200_000
#: Counts from here on are added up in the task, until there are SENT_ROWS of them.
OFTEN = 64
#: The primes of XXH64.
PRIMES = [
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
]
#: The sign bit: set in every hash, never in a place.
HASHED = np.uint64(1 << 63)


def token_ids(text: str | None) -> np.ndarray:
    w = (text or "").encode().lower().split()
    w.append(END)
    return (np.fromiter(map(xxh64_intdigest, w), dtype=np.uint64, count=len(w)) | HASHED).view(np.int64)


END_ID = int(token_ids(None)[0])


def places(ids: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The place of each id in the sorted head, or -1."""
    if not len(head):
        return np.full(len(ids), -1, dtype=np.int64)
    at = np.minimum(head.searchsorted(ids), len(head) - 1)
    return np.where(head[at] == ids, at, -1)


def xxhash64(*columns: np.ndarray) -> np.ndarray:
    """What Spark's function of this name gives for columns of longs, as unsigned numbers."""
    h = np.uint64(42)
    for column in columns:
        x = column.view(np.uint64) * PRIMES[1]
        x = ((x << np.uint64(31)) | (x >> np.uint64(33))) * PRIMES[0]
        x ^= h + PRIMES[4] + np.uint64(8)
        h = ((x << np.uint64(27)) | (x >> np.uint64(37))) * PRIMES[0] + PRIMES[3]
        h = (h ^ (h >> np.uint64(33))) * PRIMES[1]
        h = (h ^ (h >> np.uint64(29))) * PRIMES[2]
        h ^= h >> np.uint64(32)
    return h


def pair_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 63-bit id of each pair of names."""
    return (xxhash64(a, b) | HASHED).view(np.int64)


def pair_id(x: str, y: str) -> Column:
    """The same by Spark."""
    return F.xxhash64(x, y).bitwiseOR(F.lit(-(1 << 63)))


def bit_places(ids: np.ndarray) -> np.ndarray:
    """The bit of each pair's id in the bitmap."""
    return (xxhash64(ids) >> np.uint64(64 - BITMAP)).view(np.int64)


def bit_place(of: Column) -> Column:
    """The same by Spark."""
    return F.shiftrightunsigned(F.xxhash64(of), 64 - BITMAP)


def named_pairs(ids: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent tokens as (x, y): one number and 0 if both are in the head, which has size tokens, else two names.

    A name is the place plus one for a token of the head, else its hash.
    """
    both = (at[:-1] >= 0) & (at[1:] >= 0)
    names = np.where(at >= 0, at + 1, ids)
    return np.where(both, at[:-1] * size + at[1:], names[:-1]), np.where(both, 0, names[1:])


def _counted(count: Callable[..., list[np.ndarray]], columns: list[str]) -> Callable:
    """A function for mapInPandas that counts the ids of FLUSH tokens at a time and hands the counts on in slices.

    What is frequent in the corpus comes again with every FLUSH tokens, so such counts are first added up.
    """

    def over(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = []
        for ids in flushed(batches):
            found = count(ids)
            many = found[-1] >= OFTEN
            often.append(pd.DataFrame({k: x[many] for k, x in zip(columns, found)}))
            yield from sliced([x[~many] for x in found])
            if sum(map(len, often)) >= SENT_ROWS:
                yield added(often)
                often = []
        if often:
            yield added(often)

    def flushed(batches: Iterable[pd.DataFrame]) -> Iterator[np.ndarray]:
        waiting, n = [], 0
        for batch in batches:
            for text in batch["text"]:
                waiting.append(token_ids(text))
                n += len(waiting[-1])
                if n >= FLUSH:
                    ids, waiting, n = np.concatenate(waiting), [], 0
                    yield ids
        if n:
            yield np.concatenate(waiting)

    def sliced(found: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(found[0]), SENT_ROWS):
            yield pd.DataFrame({k: x[at : at + SENT_ROWS] for k, x in zip(columns, found)})

    def added(often: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(often).groupby(columns[:-1], as_index=False).sum()

    return over


def _token_counts(texts: DataFrame) -> DataFrame:
    """(id, c): how often each token occurs over all texts."""

    def count(ids: np.ndarray) -> list[np.ndarray]:
        return list(np.unique(ids, return_counts=True))

    counted = texts.mapInPandas(_counted(count, ["id", "c"]), "id long, c long")
    return counted.groupBy("id").agg(F.sum("c").alias("c"))


def _pair_counts(texts: DataFrame, head) -> DataFrame:
    """(x, y, c): how often each pair of adjacent tokens occurs over all texts, named as in named_pairs."""

    def count(ids: np.ndarray) -> list[np.ndarray]:
        ends = head.value["id"]
        x, y = named_pairs(ids, places(ids, ends), len(ends))
        inside = ids[:-1] != END_ID
        x, y = x[inside], y[inside]
        near, times = np.unique(x[y == 0], return_counts=True)
        x, y = x[y != 0], y[y != 0]
        _, at, others = np.unique(pair_ids(x, y), return_index=True, return_counts=True)
        names = np.concatenate([near, x[at]]), np.concatenate([np.zeros(len(near), np.int64), y[at]])
        return [*names, np.concatenate([times, others])]

    counted = texts.mapInPandas(_counted(count, ["x", "y", "c"]), "x long, y long, c long")
    # most pairs are new to a task: a hash table of them before the shuffle takes memory and saves few rows
    return counted.repartition("x", "y").groupBy("x", "y").agg(F.sum("c").alias("c"))


def _arrays(df: DataFrame, by: str = "id") -> dict[str, np.ndarray]:
    found = df.toArrow()
    order = np.argsort(found.column(by).to_numpy())
    return {k: found.column(k).to_numpy()[order] for k in df.columns}


def train(docs: DataFrame, fewest: int = LEAST) -> tuple[DataFrame, dict, int, int]:
    """The table of tokens and arcs that are not broadcast, what is, and the numbers of tokens and of distinct ones.

    The table has id, known (1 for a token), and what id adds to base and score.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/lm-{uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    texts = docs.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).select("text")
    counts = stored(_token_counts(texts), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = max(fewest, math.ceil(n * RATE))
    frequent, rare = counts.where(F.col("c") >= least), counts.where(F.col("c") < least)
    head = _arrays(frequent)
    size = max(len(head["id"]), 1)
    sent = spark.sparkContext.broadcast(head)
    arcs = stored(_pair_counts(texts, sent).where(F.col("c") >= fewest), "arcs")

    head_counts = stored(spark.createDataFrame(pa.table({"place": np.arange(len(head["c"])), "c": head["c"]})), "places")

    def at_place(place: str, c: str) -> DataFrame:
        return F.broadcast(head_counts.select(F.col("place").alias(place), F.col("c").alias(c)))

    def root(c: Column) -> Column:
        return F.log10((c + 1) / F.lit(float(n + v + 1)))

    # the counts of an arc's two tokens: ca of its state, cb of its end
    near = arcs.where(F.col("y") == 0).select(
        "x", "y", "c", F.floor(F.col("x") / size).alias("a"), (F.col("x") % size).alias("to")
    )
    near = near.join(at_place("a", "ca"), "a").join(at_place("to", "cb"), "to").select("x", "y", "c", "a", "ca", "cb")
    # a pair meets its rare token, a pair of two its first and then its second; so no frequent token is a join's key
    first, second = F.col("x") < 0, F.col("y") < 0
    meets = arcs.where(F.col("y") != 0).withColumn("k", F.when(first, F.col("x")).otherwise(F.col("y")))
    meets = meets.join(rare.select(F.col("id").alias("k"), F.col("c").alias("ck")), "k")
    twos = meets.where(first & second).join(rare.select(F.col("id").alias("y"), F.col("c").alias("cb")), "y")
    ones = meets.where(~(first & second)).withColumn("place", F.when(first, F.col("y")).otherwise(F.col("x")) - 1)
    ones = ones.join(at_place("place", "cp"), "place")
    ca, cb = F.when(first, F.col("ck")).otherwise(F.col("cp")), F.when(first, F.col("cp")).otherwise(F.col("ck"))
    a = F.when(first, F.col("x")).otherwise(F.col("x") - 1)
    far = ones.select("x", "y", "c", a.alias("a"), ca.alias("ca"), cb.alias("cb")).unionByName(
        twos.select("x", "y", "c", F.col("x").alias("a"), F.col("ck").alias("ca"), "cb")
    )
    far = stored(far, "far")

    states = near.unionByName(far).groupBy("a").agg(
        F.sum((F.col("c") - DISCOUNT) / F.col("ca")).alias("taken"),
        F.sum((F.col("cb") + 1) / F.lit(float(n + v + 1))).alias("freed"),
    )
    rest = lambda x: F.greatest(1 - F.col(x), F.lit(1e-12))
    states = stored(states.select("a", F.log10(rest("taken") / rest("freed")).alias("fail")), "states")
    fails = np.zeros(size)
    head_states, rare_states = F.broadcast(states.where(F.col("a") >= 0)), states.where(F.col("a") < 0)
    known = _arrays(states.where(F.col("a") >= 0), "a")
    fails[known["a"]] = known["fail"]

    beyond = F.log10((F.col("c") - DISCOUNT) / F.col("ca")) - root(F.col("cb")) - F.col("fail")
    near = near.join(head_states, "a").withColumn("id", F.col("x"))
    far = far.withColumn("id", pair_id("x", "y"))
    far = far.where(~first).join(head_states, "a").unionByName(far.where(first).join(rare_states, "a"))
    near, far = near.select("id", "c", beyond.alias("score")), far.select("id", "c", beyond.alias("score"))

    ids = arcs.where(F.col("c") < least).select(
        bit_place(F.when(F.col("y") == 0, F.col("x")).otherwise(pair_id("x", "y"))).alias("bit")
    )
    bit = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = ids.groupBy(F.shiftright("bit", 6).alias("id")).agg(F.bit_or(bit).alias("bits"))
    words = _arrays(words)
    bitmap = np.zeros(1 << BITMAP - 6, dtype=np.int64)
    bitmap[words["id"]] = words["bits"]
    base = np.log10((head["c"] + 1) / (n + v + 1))
    walked = {
        "tokens": {"id": head["id"], "base": base, "score": base + fails[: len(base)]},
        "pairs": _arrays(near.where(F.col("c") >= least).drop("c")),
        "bitmap": bitmap,
    }
    fail = F.coalesce("fail", F.lit(0.0))
    tokens = rare.join(rare_states.withColumnRenamed("a", "id"), "id", "left").select(
        "id", F.lit(1).alias("known"), root(F.col("c")).alias("base"), (root(F.col("c")) + fail).alias("score")
    )
    pairs = near.unionByName(far).where(F.col("c") < least)
    table = tokens.unionByName(pairs.select("id", F.lit(0).alias("known"), F.lit(0.0).alias("base"), "score"))
    return table, walked, n, v


def traverse(head: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For adjacent texts: each token's place or -1, what the broadcast tables give to its base and score,
    the id of the pair that ends in it, and whether that must be looked up elsewhere.
    """
    tokens, arcs = head["tokens"], head["pairs"]
    at = places(ids, tokens["id"])
    base, score = np.zeros(len(ids)), np.zeros(len(ids))
    known = at >= 0
    base[known], score[known] = tokens["base"][at[known]], tokens["score"][at[known]]
    x, y = named_pairs(ids, at, max(len(tokens["id"]), 1))
    pair = np.concatenate([ids[:1], np.where(y == 0, x, pair_ids(x, y))])
    paired = np.concatenate([[False], ids[:-1] != END_ID])
    arc = places(pair, arcs["id"])
    taken = paired & (arc >= 0)
    score[taken] += arcs["score"][arc[taken]]
    place = bit_places(pair)
    maybe = (head["bitmap"][place >> 6] >> (place & 63)) & 1
    return at, base, score, pair, paired & ~taken & (maybe == 1)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    least: the times that make a pair an arc.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    model, head, n, v = train(rows, least)
    sent = spark.sparkContext.broadcast(head)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in (b.slice(at, PART_ROWS) for b in batches for at in range(0, b.num_rows, PART_ROWS)):
            ids = [token_ids(t) for t in batch.column("text").to_pylist()]
            lengths = np.array([len(i) for i in ids])
            starts = np.concatenate([[0], lengths.cumsum()[:-1]])
            flat = np.concatenate(ids)
            at, base, got, pair, missing = traverse(machine, flat)
            sums = [lengths, *[np.add.reduceat(x, starts) for x in ((at >= 0).astype(np.int64), base, got)]]
            row = np.repeat(np.arange(len(ids)), lengths)
            rare = at < 0
            of = np.concatenate([row[rare], row[missing]])
            names = np.concatenate([flat[rare], pair[missing]])
            # a pair's times are negative: unknown tokens count, unknown pairs do not
            sign = np.repeat(np.array([1, -1], np.int32), [rare.sum(), missing.sum()])
            order = np.lexsort((names, of))
            of, names, sign = of[order], names[order], sign[order]
            new = np.nonzero(np.r_[len(of) > 0, (of[1:] != of[:-1]) | (names[1:] != names[:-1])][: len(of)])[0]
            times = np.diff(np.r_[new, len(of)]).astype(np.int32) * sign[new]
            key = batch.column("key").to_numpy()
            own = np.column_stack([x.astype(np.float64) for x in sums])
            offsets = np.r_[np.arange(len(ids) + 1) * 4, np.full(len(new), len(ids) * 4)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key, names[new]])),
                    pa.array(np.concatenate([key, key[of[new]]])),
                    pa.array(np.concatenate([np.zeros(len(ids), np.int32), times])),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(own.ravel())),
                ],
                names=["id", "key", "times", "own"],
            )

    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    parts = keyed.select("key", "text").mapInArrow(walk, "id long, key long, times int, own array<double>")
    # a row with times = 0 is a text's own; its id is no token and what it may meet is not used
    met = parts.join(model, "id", "left")
    unseen = F.when(F.col("times") > 0, -math.log10(n + v + 1)).otherwise(0.0)
    times = F.abs("times")
    own = lambda k: F.coalesce(F.get("own", F.lit(k)), F.lit(0.0))
    sums = met.groupBy("key").agg(
        F.sum(F.when(F.col("times") == 0, 1).otherwise(0)).alias("copies"),
        F.sum(own(0)).alias("n_tokens"),
        F.sum(own(1) + times * F.coalesce("known", F.lit(0))).alias("n_known"),
        F.sum(own(2) + times * F.coalesce("base", unseen)).alias("base_score"),
        F.sum(own(3) + times * F.coalesce("score", unseen)).alias("score"),
    )
    per_text = sums.select(
        "key",
        *[(F.col(c) / F.col("copies")).cast("long").alias(c) for c in ("n_tokens", "n_known")],
        *[(F.col(c) / F.col("copies")).alias(c) for c in ("base_score", "score")],
    )
    held_out = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    return (
        keyed.select("doc_id", "key")
        .join(per_text, "key")
        .select(
            "doc_id",
            held_out.alias("held_out"),
            "n_tokens",
            "n_known",
            F.lit(int(n)).cast("long").alias("train_tokens"),
            "base_score",
            "score",
        )
    )
