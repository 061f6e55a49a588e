"""Importance resampling towards a target: documents weighed by hashed n-grams, drawn by Gumbel keys.

Each task walks its texts through tries of words, PATHS words at a time. A node is a run of up to `order` words and
holds its count and the state of the CRC-32 of its bytes, which a child continues: CRC-32 is linear, so that a step by
a word is a table for the word's length and the CRC of what the word adds, for all children of a level at once. Words'
own nodes stay until there are MAX_NODES of them; the nodes below them, most of which occur once in a corpus, go when
their counts are added to the task's bucket totals, which Spark merges, at most `buckets` rows a task. Then the
documents are read again; each walks its paths in a trie whose nodes have the gains of their buckets attached.

The gains, `buckets` numbers, are the only thing that passes the driver and is broadcast. Ranks come from one sort of
all documents' scores by range, the sizes of its partitions, and places within them, so that no task orders all rows.

Defined results: a null or empty text has no words, no features and weight 0. A null id is hashed as an empty one and
comes last where scores tie. Repeated rows are drawn each for itself and count each time, as they are rows. An empty
table gives none, an empty target has no counts. Columns other than the id and the text are never read.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import checkpointed

BUCKETS, ORDER, SEED = 10_000, 2, 7
MIN_WORDS, PERCENT = 20, 25

#: Words with a node of their own in a task (about 200 bytes each), words of a text and of texts that are walked
#: together, and texts of a batch.
MAX_NODES, PIECE, PATHS, ROWS = 400_000, 50_000, 250_000, 512

#: a-z and 0-9 and what is beyond ASCII as they are, A-Z in lower case, a space for all else.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case, as UTF-8."""
    return text.translate(_KEPT).split() if text else []


@lru_cache(maxsize=4_096)
def _after_zeros(n: int) -> np.ndarray:
    """What n zero bytes make of a CRC-32, as four tables, one for each of its bytes."""
    if n == 1:
        images = np.array([zlib.crc32(bytes([0]), 1 << bit) ^ zlib.crc32(bytes([0])) for bit in range(32)], np.uint64)
    else:
        half = _shifted(_after_zeros(n // 2), _after_zeros(n // 2)[:, 1 << np.arange(8)].ravel())
        images = _shifted(_after_zeros(1), half) if n % 2 else half
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.stack([np.bitwise_xor.reduce(np.where(bits, images[8 * k : 8 * k + 8], 0), axis=1) for k in range(4)]).astype(np.uint64)


def _shifted(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    parts = [tables[k][(crc >> np.uint64(8 * k)) & np.uint64(255)] for k in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


def continued(crc: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of bytes that go on with a tail, from theirs and the tail's own one and its length."""
    out = np.empty_like(crc)
    for n in np.unique(length):
        same = length == n
        out[same] = _shifted(_after_zeros(int(n)), crc[same]) ^ tail[same]
    return out


class Trie:
    """Runs of words. A word's node holds its CRC state and what a step to it from another node needs."""

    def __init__(self) -> None:
        self._state, self._tail, self._length = array("L"), array("L"), array("L")
        self._root = _Made(self._word)

    def __len__(self) -> int:
        return len(self._state)

    def _word(self, word: bytes) -> int:
        self._state.append(zlib.crc32(word))
        self._tail.append(zlib.crc32(b" " + word))
        self._length.append(len(word) + 1)
        return len(self._state) - 1

    def walk(self, pieces: list[Piece], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level: the nodes' CRC states, and for each run its node and its piece.

        The nodes below the first level are those of these pieces: a child is a node and the next word's node.
        """
        single = np.fromiter(map(self._root.__getitem__, chain.from_iterable(p.words for p in pieces)), np.int64)
        states, tails, lengths = (np.array(x, np.uint64) for x in (self._state, self._tail, self._length))
        sizes = np.array([len(p.words) for p in pieces])
        piece = np.repeat(np.arange(len(pieces)), sizes)
        place = np.arange(len(single)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(place < np.array([p.begun for p in pieces])[piece])
        crc, nodes = states, single[at]
        yield crc, nodes, piece[at]
        for k in range(1, order):
            goes_on = place[at] + k < sizes[piece[at]]
            at, nodes = at[goes_on], nodes[goes_on]
            children, nodes = np.unique(nodes << 32 | single[at + k], return_inverse=True)
            words_ = children & 0xFFFFFFFF
            crc = continued(crc[children >> 32], tails[words_], lengths[words_])
            yield crc, nodes, piece[at]


class _Made(dict):
    """A dict that makes what it lacks."""

    def __init__(self, make) -> None:
        self._make = make

    def __missing__(self, key):
        self[key] = made = self._make(key)
        return made


class Piece(NamedTuple):
    """Words of a text, and how many of them begin a run here: the last ones only end runs."""

    text: int
    words: list[bytes]
    begun: int


def _walked(texts: pa.Array, order: int) -> Iterator[list[Piece]]:
    """Texts in pieces of PIECE words, about PATHS words at a time; a text without words has none."""
    waiting, n = [], 0
    for k, text in enumerate(texts.to_pylist()):
        found = words(text)
        for start in range(0, len(found), PIECE):
            part = found[start : start + PIECE + order - 1]
            waiting.append(Piece(k, part, min(PIECE, len(part))))
            n += len(part)
            if n >= PATHS:
                yield waiting
                waiting, n = [], 0
    if waiting:
        yield waiting


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))


def bucket_totals(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts each bucket has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie = np.zeros(buckets, np.int64), Trie()
        for batch in _batches(batches):
            for pieces in _walked(batch.column(0), order):
                for crc, nodes, _ in trie.walk(pieces, order):
                    held = np.bincount(nodes, minlength=len(crc))
                    totals += np.bincount(crc.astype(np.int64) % buckets, held, buckets).astype(np.int64)
                if len(trie) > MAX_NODES:
                    trie = Trie()
        there = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(totals[there])], ["bucket", "n"])

    texts = docs.select(F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    all_s, all_t = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1) * all_s / ((source.get(b, 0) + 1) * all_t)))
        for b in range(buckets)
    ]


def weighed(docs: DataFrame, gain: list[int], order: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket, trie = np.array(sent.value, np.int64), Trie()
        for batch in _batches(batches):
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for pieces in _walked(batch.column(1), order):
                text = np.array([p.text for p in pieces])
                np.add.at(n_words, text, [p.begun for p in pieces])
                for crc, nodes, piece in trie.walk(pieces, order):
                    gained = by_bucket[crc.astype(np.int64) % len(by_bucket)]
                    np.add.at(n_features, text, np.bincount(piece, minlength=len(text)))
                    np.add.at(total, text, np.bincount(piece, gained[nodes], len(text)).astype(np.int64))
                if len(trie) > MAX_NODES:
                    trie = Trie()
            weights = total // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x) for x in (n_words, n_features, weights))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate, times 1000 and rounded down, from the hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    order: int = ORDER,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it isn't drawn."""
    source, wanted = ({r.bucket: r.n for r in bucket_totals(x, order, buckets).collect()} for x in (docs, target))
    scored = checkpointed(
        weighed(docs, gains(source, wanted, buckets), order).select(
            "doc_id",
            "n_features",
            "weight",
            (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"),
            (F.col("n_words") >= min_words).alias("able"),
        )
    )
    drawn = F.lit(scored.where("able").count() * percent // 100)
    ordered = ranked(scored, [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id")])
    return ordered.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with its rank in the given order, from 1; rows that tie in all of it are spread over tasks, too."""
    lines = checkpointed(df.withColumn("spread", F.monotonically_increasing_id()).orderBy(*order, "spread"))
    here = F.monotonically_increasing_id()  # the partition, and below 33 bits the place in it
    placed = lines.withColumns({"part": F.shiftright(here, 33).cast("int"), "place": here.bitwiseAND(F.lit(2**33 - 1))})
    starts, before = [], 0
    for part, n in placed.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "part int, before long")
    return (
        placed.join(F.broadcast(offsets), "part")
        .withColumn("rank", F.col("before") + F.col("place") + 1)
        .drop("part", "place", "before", "spread")
    )
