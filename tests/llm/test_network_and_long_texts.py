"""The quality network by plain loops, and texts of a megabyte for the operators that read them."""

import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rivulet.llm import bpe, lm, quality_classifier, quality_rules, simhash, toxicity
from rivulet.llm.queries import TOKENIZER


def test_network_by_loops():
    rng = np.random.default_rng(1)
    x = rng.choice([-1.0, 1.0], (400, 2)) + rng.normal(0, 0.1, (400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no line parts these
    net = quality_classifier.Network(x, y, np.ones(len(y)))
    assert ((net.score(x) > 0.5) == (y > 0.5)).mean() > 0.98
    w1, b1, w2, b2 = net.p
    for row in x[:10]:
        hidden = [math.tanh(sum((row[i] - net.mean[i]) / net.spread[i] * w1[i, j] for i in range(2)) + b1[j]) for j in range(len(b1))]
        logit = sum(h * w for h, w in zip(hidden, w2, strict=True)) + float(b2)
        assert net.logits(row[None])[0] == pytest.approx(logit)
        assert net.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-logit / net.temperature)))


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + rng.normal(0, 2, 300) > 0).astype(float)  # noisy labels: a sure network must be cooled
    net, weight = quality_classifier.Network(x[:100], y[:100], np.ones(100)), rng.uniform(0.5, 2, 200)

    def loss(t):
        total = 0.0
        for z, label, w in zip(net.logits(x[100:]), y[100:], weight, strict=True):
            p = 1 / (1 + math.exp(-z / t))
            total -= w * math.log(max(p if label else 1 - p, 1e-9))
        return total

    net.calibrate(x[100:], y[100:], weight)
    assert loss(net.temperature) <= min(loss(t) for t in np.geomspace(0.2, 10, 40)) * 1.001
    assert loss(net.temperature) < loss(1.0)


def test_pooling_by_loops():
    known = quality_classifier.Units()
    texts = ["a b a a c", "", None, "x", "b " * 40 + "c"]
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(quality_classifier.BUCKETS + quality_classifier.SHAPES, quality_classifier.SIZE))
    got, size = quality_classifier.pooled(texts, vectors, known), quality_classifier.SIZE
    for row, text in zip(got, texts, strict=True):
        words = (text or "").split()
        if not words:
            assert not row.any()
            continue
        ids = [known[w] for w in words]
        own = np.array([vectors[i // quality_classifier.SHAPES] for i in ids])
        assert np.allclose(row[:size], [sum(v[d] for v in own) / len(own) for d in range(size)])
        spread = [math.sqrt(max(sum((v[d] - row[d]) ** 2 for v in own) / len(own), 0)) for d in range(size)]
        assert np.allclose(row[2 * size : 3 * size], spread, atol=1e-6)
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words) - 1, 1)
        assert np.allclose(row[3 * size : 3 * size + 3], [math.log(len(words)), len(set(words)) / len(words), repeats])


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts of a megabyte, one of them a single word, beside short ones."""
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + k) for k in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(500)]
    data = [(i, " ".join(words[k] for k in rng.integers(0, 500, n))) for i, n in ((1, 180_000), (2, 170_000), (3, 12), (4, 60))]
    data += [(5, "x" * 1_200_000), (6, "y " * 600_000), (7, data[0][1] + " end"), (8, None)]
    return data, spark.createDataFrame(data, "doc_id long, text string")


def test_long_texts(spark, long_docs):
    data, docs = long_docs
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    base = {r.doc_id: r.n_words for r in quality_rules.quality_rules(docs).collect()}
    assert base == {i: len((t or "").split()) for i, t in data}
    for scored in (toxicity.toxicity(docs, labels), quality_classifier.quality(docs, labels)):
        assert all(0 <= r.score <= 1 for r in scored.collect())
    prints = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    text = dict(data)[1]
    w = text.split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    counts = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0)
    assert prints[1].fingerprint == f"{int(''.join('1' if 2 * c > len(hashes) else '0' for c in counts), 2):016x}"
    assert prints[7].component_id == 1
    scores = {r.doc_id: r for r in lm.score(docs).collect()}
    assert {i: r.n_tokens for i, r in scores.items()} == {i: len((t or "").split()) + 1 for i, t in data}
    trained = sum(len((t or "").split()) + 1 for i, t in data if zlib.crc32(str(i).encode()) % 7 != 2)
    assert all(r.train_tokens == trained and r.score <= 0 for r in scores.values())
    library = Tokenizer.from_file(TOKENIZER)
    coded = {r.doc_id: r for r in bpe.encode(docs.where("doc_id <> 5"), TOKENIZER).collect()}
    for i, t in data:
        if i != 5:
            assert coded[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids) and coded[i].decoded == (t or "")
    one = bpe.encode(docs.where(F.col("doc_id") == 5), TOKENIZER).first()
    assert one.decoded == dict(data)[5]
