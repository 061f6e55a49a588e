"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

Every word falls into one of BUCKETS by hash, and so does its shape (letters,
digits and marks with runs joined). A bucket has a fixed sparse random index
vector; its context vector is the sum of the index vectors of the words up to
REACH places away, over the whole corpus. Tasks add up context vectors for the
texts they hold and Spark sums them by bucket: the table has BUCKETS + SHAPES
rows whatever the corpus, which bounds what is collected and broadcast.

A document is the mean of its words' and of its shapes' unit context vectors,
the spread of the words', and a few counts. A network of two layers, in numpy,
is fitted on the pooled vectors of a bounded sample of labelled documents
(PER_CLASS of each class, outside the held-out fold); a temperature, fitted on
a part of the sample that training has not seen, calibrates its probabilities.

Defined results: a null or empty text is pooled to zeros and gets the score of
that; without labels of both classes every score is 1; where the part for
training lacks a class, the whole sample trains and the temperature is 1; of
several labels of one id the highest counts; a null doc_id is not held out; a text
of any length is pooled whole, BLOCK words at a time; repeated rows give repeated
rows and an empty table none; labels, lang, source and ids are never inputs of a
score, and no other column is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rivulet.llm.common import in_parts, labelled_sample, remainder

FOLDS, HELD_OUT = 5, 0
PER_CLASS = 4000
CUT_OFF = 0.3

BUCKETS, SHAPES = 1 << 13, 1 << 9
SIZE = 24
NONZERO = 4
REACH = 2
HIDDEN = 24
EPOCHS, RATE, DECAY = 400, 0.01, 1e-3
#: Words that are indexed at once, and shapes of words that are remembered.
BLOCK, REMEMBERED = 200_000, 300_000

_RUNS = re.compile(r"(.)\1+", re.S)
_KINDS = {i: "0" if chr(i).isdigit() else "A" if chr(i).isupper() else "a" for i in range(0x250) if chr(i).isalnum()}


class Units(dict):
    """word -> bucket of the word, and of its shape behind the words' buckets, as one number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        shape = _RUNS.sub(r"\1", word.translate(_KINDS))
        value = (xxh64_intdigest(word) % BUCKETS) * SHAPES + xxh64_intdigest(shape, 1) % SHAPES
        self[word] = value
        return value


def index_vectors() -> np.ndarray:
    """NONZERO entries of +1 or -1 in each row, the same everywhere."""
    rng = np.random.default_rng(4)
    out = np.zeros((BUCKETS + SHAPES, SIZE), dtype=np.float32)
    place = rng.random(out.shape).argpartition(NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(out, place, rng.choice(np.float32([-1, 1]), place.shape), axis=1)
    return out


def units(texts: Iterable[str | None], known: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, buckets of all shapes, and each text's number of words."""
    lists = [(t or "").split() for t in texts]
    lengths = np.array([len(w) for w in lists], dtype=np.int64)
    flat = np.fromiter((known[w] for ws in lists for w in ws), dtype=np.int64, count=int(lengths.sum()))
    return flat // SHAPES, flat % SHAPES + BUCKETS, lengths


def context_sums(words: np.ndarray, shapes: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each bucket, the sum of the index vectors around its words. Never across texts."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((BUCKETS + SHAPES, SIZE))
    for at in range(0, len(words), BLOCK):
        low, high = max(at - REACH, 0), at + BLOCK + REACH
        row, given = rows[low:high], index[words[low:high]] + index[shapes[low:high]]
        around = np.zeros_like(given)
        for k in range(1, REACH + 1):
            same = (row[k:] == row[:-k])[:, None]
            around[k:] += given[:-k] * same
            around[:-k] += given[k:] * same
        around = around[at - low : at - low + BLOCK]
        both = np.concatenate([words[at : at + BLOCK], shapes[at : at + BLOCK]])
        for d in range(SIZE):
            out[:, d] += np.bincount(both, np.tile(around[:, d], 2), BUCKETS + SHAPES)
    return out


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The unit context vector of every bucket, over all texts of docs."""
    names = [f"c{d}" for d in range(SIZE)]

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, index = Units(), index_vectors()
        total = np.zeros((BUCKETS + SHAPES, SIZE))
        for texts in in_parts(batch["text"] for batch in batches):
            total += context_sums(*units(texts, known), index)
        met = np.nonzero(total.any(axis=1))[0]
        yield pd.DataFrame(total[met].astype(np.int64), columns=names).assign(bucket=met)

    sums = (
        docs.select("text")
        .mapInPandas(count, ", ".join(f"{c} long" for c in names) + ", bucket long")
        .groupBy("bucket")
        .agg(*[F.sum(c).alias(c) for c in names])
        .toArrow()
    )
    out = np.zeros((BUCKETS + SHAPES, SIZE), dtype=np.float32)
    out[sums.column("bucket").to_numpy()] = np.stack([sums.column(c).to_numpy() for c in names], axis=1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str | None], vectors: np.ndarray, known: Units) -> np.ndarray:
    """One row for each text: means, spread and counts."""
    words, shapes, lengths = units(texts, known)
    out = np.zeros((len(lengths), 3 * SIZE + 4), dtype=np.float64)
    start = 0
    for i, n in enumerate(lengths):
        if n:
            w, s = words[start : start + n], shapes[start : start + n]
            sums, squares = np.zeros((2, SIZE)), np.zeros(SIZE)
            for at in range(0, n, BLOCK):
                v = vectors[w[at : at + BLOCK]]
                sums[0] += v.sum(0)
                squares += (v * v).sum(0)
                sums[1] += vectors[s[at : at + BLOCK]].sum(0)
            mean = sums / n
            out[i, :SIZE], out[i, SIZE : 2 * SIZE] = mean
            out[i, 2 * SIZE : 3 * SIZE] = np.sqrt(np.maximum(squares / n - mean[0] ** 2, 0))
            out[i, 3 * SIZE :] = (
                np.log(n),
                len(np.unique(w)) / n,
                (w[1:] == w[:-1]).mean() if n > 1 else 0.0,
                len(np.unique(s)) / np.sqrt(n),
            )
            start += n
    return out


class Network:
    """tanh layer, then a logistic output divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        rng = np.random.default_rng(4)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        self.p = [
            rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
            rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(()),
        ]
        self.temperature, self.shift = 1.0, 0.0
        z = (x - self.mean) / self.spread
        seen = [[np.zeros_like(p), np.zeros_like(p)] for p in self.p]
        for step in range(1, EPOCHS + 1):
            w1, b1, w2, b2 = self.p
            h = np.tanh(z @ w1 + b1)
            d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y) * weight / weight.sum()
            dh = np.outer(d, w2) * (1 - h * h)
            for p, g, (m, v) in zip(self.p, (z.T @ dh, dh.sum(0), h.T @ d, d.sum()), seen, strict=True):
                g = g + DECAY * p * (p.ndim > 0)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return np.tanh((x - self.mean) / self.spread @ w1 + b1) @ w2 + b2

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature with the least weighted log loss."""
        z = self.logits(x)

        def loss(t: float) -> float:
            p = np.clip(1 / (1 + np.exp(-np.clip(z / t, -30, 30))), 1e-9, 1 - 1e-9)
            return -float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

        self.temperature = min(np.geomspace(0.2, 10, 80), key=loss)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    sent = spark.sparkContext.broadcast(context_vectors(rows))

    @F.pandas_udf("array<double>")
    def pool(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Units()
        for texts in in_parts(batches):
            yield pd.Series(list(pooled(list(texts), sent.value, known)), dtype=object)

    sample = labelled_sample(rows, labels, "quality", FOLDS, HELD_OUT, PER_CLASS, "quality")
    found = sample.select("doc_id", "label", pool("text").alias("x")).toArrow().to_pandas().sort_values("doc_id")
    network = None
    if found["label"].nunique() == 2:
        x, y = np.stack(found["x"]), found["label"].to_numpy(dtype=np.float64)
        part = found["doc_id"].map(lambda i: xxh64_intdigest(f"part {i}") % 10 < 7).to_numpy(dtype=bool)
        labelled = labels.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
        share = float(labelled.agg(F.avg("quality")).first()[0])
        weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
        if len(set(y[part])) < 2:  # too few to set some apart: the temperature stays 1
            part[:] = True
        network = Network(x[part], y[part], weight[part])
        if not part.all():
            network.calibrate(x[~part], y[~part], weight[~part])
    trained = spark.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, net = Units(), trained.value
        for texts in in_parts(batches):
            yield pd.Series(net.score(pooled(list(texts), sent.value, known)) if net else np.ones(len(texts)))

    return rows.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        judge("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= CUT_OFF).cast("int"))
