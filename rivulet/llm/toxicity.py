"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what
sets toxic text apart from it: the words of toxic documents, or their beginnings,
that occur significantly more often in toxic than in ordinary documents. A
window of words is compressed with the ordinary dictionary alone and with the
toxic one put before it; the bytes that the second saves measure how toxic the
window is, and nothing else differs. Letters are keyed by their place in the
word before compression, so that a match must begin at the same place of a word.

A document's highest savings, the windows above each of a few thresholds, and
their share go into a logistic calibration, fitted on labelled documents that
the dictionaries have not seen.

The fit takes a bounded sample: PER_CLASS labelled documents of each class, of
MAX_CHARS characters at most, outside the held-out fold. Scoring reads whole
texts.

Defined results: a null or empty text has no windows and gets the score of that;
without labels of both classes every score is 0; a null doc_id is not held out;
repeated rows give repeated rows and an empty table none; labels, lang, source
and ids are never inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rivulet.llm.common import in_parts, labelled_sample, remainder

FOLDS, HELD_OUT = 4, 2
PER_CLASS, MAX_CHARS = 1500, 20_000
CUT_OFF = 0.3

WINDOW = 12
LEVEL = 4
ORDINARY_BYTES, TOXIC_BYTES = 8192, 2048
#: The trainer's segments for toxic text: about a word, so that each is kept once.
WORDY = {"k": 16, "d": 6}
#: Savings in bytes that a window is counted above.
THRESHOLDS = (2, 3, 4, 5)
PREFIX = range(4, 10)
LEAST_DOCS, LEAST_Z, LEAST_RATIO = 3, 6.0, 3.0
RIDGE = 0.1

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_STEP = 37


def words(text: str | None) -> list[bytes]:
    """The runs of letters, in lower case."""
    return (text or "").lower().encode().translate(_LETTERS).split()


def keyed(w: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words, each ended by a zero byte, with bytes keyed by their place; and the words' ends."""
    if not w:
        return b"", np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(b"\0".join(w) + b"\0", dtype=np.uint8)
    ends = np.nonzero(raw == 0)[0]
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    out = (raw + (_STEP * (place + 1)).astype(np.uint8)).astype(np.uint8)
    out[ends] = 0
    return out.tobytes(), ends + 1


def windows(text: str | None) -> list[bytes]:
    data, ends = keyed(words(text))
    cuts = [0, *ends[WINDOW - 1 :: WINDOW].tolist()]
    if len(data) > cuts[-1]:
        cuts.append(len(data))
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _units(w: bytes) -> Iterator[bytes]:
    yield w + b" "
    for k in PREFIX:
        if k <= len(w):
            yield w[:k]


def contrast(toxic: list[str], ordinary: list[str]) -> set[bytes]:
    """Whole words and prefixes that are significantly more frequent among toxic documents."""
    units = lambda t: {u for w in set(words(t)) for u in _units(w)}
    there: Counter[bytes] = Counter()
    for t in toxic:
        there.update(units(t))
    there = Counter({u: c for u, c in there.items() if c >= LEAST_DOCS})
    away: Counter[bytes] = Counter()
    for t in ordinary:
        away.update(u for u in units(t) if u in there)
    n, m = len(toxic), len(ordinary)
    found = set()
    for u, c in there.items():
        p = (c + away[u]) / (n + m)
        z = (c / n - away[u] / m) / max((p * (1 - p) * (1 / n + 1 / m)) ** 0.5, 1e-9)
        if z >= LEAST_Z and c / n >= LEAST_RATIO * (away[u] + 0.5) / m:
            found.add(u)
    return found


def _mark(w: bytes, marks: set[bytes]) -> bytes:
    """The longest unit of the word that is among marks; empty if none is."""
    return max((u for u in _units(w) if u in marks), key=len, default=b"").strip()


def _dictionary(size: int, samples: list[bytes], **segments: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, **segments).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(samples)


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary's content."""
    marks = contrast(toxic, ordinary)
    samples = [keyed([u for w in words(t) if (u := _mark(w, marks))])[0] for t in toxic]
    # each sample counts several times, since the trainer asks for many times the dictionary's size
    return (
        _dictionary(TOXIC_BYTES, [s for s in samples if s] * 3, **WORDY),
        _dictionary(ORDINARY_BYTES, [w for t in ordinary for w in windows(t)]),
    )


class Savings:
    """Bytes that the toxic dictionary saves on a window."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.plain, self.mixed = self._compressor(ordinary), self._compressor(toxic + ordinary)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(content), source_size=64, min_match=4,
            write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        if len(content) < 8:
            return zstandard.ZstdCompressor(compression_params=params)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=params)

    def features(self, text: str | None) -> list[float]:
        a, b = self.plain.compress, self.mixed.compress
        d = np.array([len(a(w)) - len(b(w)) for w in windows(text)], dtype=np.float64)
        if not len(d):
            d = np.zeros(1)
        top = np.sort(d)[::-1][:3].tolist()
        top += [0.0] * (3 - len(top))
        above = [float(np.log1p((d >= k).sum())) for k in THRESHOLDS]
        return [*top, *above, float(d.mean()), float(np.log(len(d))), float((d >= THRESHOLDS[2]).mean())]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression (the last column is the intercept), by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (p - y) + RIDGE * w
        )
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict | None:
    """The dictionaries and the calibration, or None without labels of both classes."""
    sample = labelled_sample(docs, labels, label, FOLDS, HELD_OUT, PER_CLASS, "toxicity", MAX_CHARS)
    rows = sorted((r["doc_id"], r["text"], r["label"]) for r in sample.collect())
    part = lambda i: xxh64_intdigest(f"part {i}") % 10 < 6
    toxic = [t for i, t, y in rows if y and part(i)]
    ordinary = [t for i, t, y in rows if not y and part(i)]
    rest = [(t, y) for i, t, y in rows if not part(i)]
    if not toxic or not ordinary or len({y for _, y in rest}) < 2:
        return None
    total, base = (labels.where(F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
                   .agg(F.count("*"), F.sum(F.col(label))).first())
    share = min(max(base / total, 1e-3), 1 - 1e-3)
    a, b = train_dictionaries(toxic, ordinary)
    savings = Savings(a, b)
    x = np.array([savings.features(t) for t, _ in rest])
    y = np.array([k for _, k in rest], dtype=np.float64)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    w = logistic(np.c_[(x - mean) / spread, np.ones(len(x))], y)
    # the sample holds the classes in other shares than the labels do
    w[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return {"toxic": a, "ordinary": b, "mean": mean, "spread": spread, "weights": w}


def scored(docs: DataFrame, labels: DataFrame, text: Column) -> Column:
    """The probability that a text is toxic, learnt from docs and labels."""
    model = fit(docs, labels)
    if model is None:
        return F.lit(0.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        savings = Savings(m["toxic"], m["ordinary"])
        for texts in in_parts(batches):
            x = np.array([savings.features(t) for t in texts]).reshape(len(texts), len(m["mean"]))
            z = ((x - m["mean"]) / m["spread"]) @ m["weights"][:-1] + m["weights"][-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return judge(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    judged = rows.select("doc_id", scored(rows, labels, F.col("text")).alias("score"))
    return judged.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= CUT_OFF).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below CUT_OFF, with docs' columns."""
    return docs.where(scored(docs, labels, docs["text"]) < CUT_OFF)
