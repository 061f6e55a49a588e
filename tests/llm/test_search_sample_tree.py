"""Top-k search, importance resampling and the prefix tree against brute force, and on odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import prefix_tree, resample, topk

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def with_clashes(df):
    for name in ("score", "rank", "row", "b", "q", "part", "place", "spread", "weight", "owner", "depth", "h", "size", "n_bytes"):
        df = df.withColumn(name, F.lit("x"))
    return df


def brute_top(data, k, every):
    good = [(i, [int(math.floor(1024 * x)) for x in v]) for i, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in good:
        if i is None or i % every:
            continue
        scores = [(max(min(sum(a * b for a, b in zip(v, w, strict=False)), 2**63 - 1), -(2**63) + 1), j) for j, w in good if j != i]
        best = sorted(scores, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(best)]
    return Counter(out)


def top(spark, data, k=4, every=3, **more):
    df = with_clashes(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    return Counter(tuple(r) for r in topk.search(df, k, every, **more).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "query_block": 3}])
def test_top_k_brute_force(spark, sizes):
    """Ties, repeated ids and rows, null ids, odd vectors, lengths that differ, and components beyond all integers."""
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(60)]
    data += [(100 + i, [0.5, 0.0, -0.25]) for i in range(40)]  # copies
    data += [(None, [0.5, 0.5]), (3, None), (6, [0.1, None]), (9, [float("nan")]), (12, [float("inf"), 1.0]), (15, []), (18, [0.0] * 6)]
    data += [(21, [1e-9, -1e-9]), (24, [1.0, 2.0]), (24, [1.0, 2.0]), (27, [3.0]), (27, [4.0]), (-3, [0.7]), (303, [2.0**60, 5.0]), (306, [-(2.0**61), 7.0])]
    assert top(spark, data, **sizes) == brute_top(data, 4, 3)


def test_top_k_few_rows(spark):
    assert top(spark, []) == Counter()
    assert top(spark, [(3, [1.0])]) == Counter()
    assert top(spark, [(3, [1.0]), (4, [0.001])]) == Counter({(3, 1, 4, 1024): 1})
    assert top(spark, [(4, [1.0])]) == Counter()


def test_top_k_over_several_arrays():
    """More queries and rows than one array of scores holds, sparse and with ties at the edge."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.integers(0, 2, 5)]) for i in range(topk.ROWS * 2 + 11)]
    asked = data[: topk.QUERY_ROWS + 5]
    kind = pa.list_(pa.float32())
    queries = pa.table({"query_id": [i for i, _ in asked], "query_row": [i for i, _ in asked], "embedding": pa.array([v for _, v in asked], kind)})
    rows = pa.table({"vec_id": [i for i, _ in data], "embedding": pa.array([v for _, v in data], kind)})
    best = defaultdict(list)
    for r in topk._block_best(queries, rows, 10, 1024).to_pylist():
        best[r["query_id"]].append((-r["score"], r["vec_id"]))
    for i, v in asked:
        want = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(v, w, strict=True)), j) for j, w in data if j != i)[:10]
        assert sorted(best[i])[:10] == want


DOCS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "the cat " * 30), (6, "the cat " * 30), (4, "one"), (7, "É ẞ 漢字 𝄞 'tis A1b2 x"),
    (None, "no id here " * 12), (8, "THE Cat_sat-on\x00the\x7fmat " * 9), (8, "THE Cat_sat-on\x00the\x7fmat " * 9), (9, "w " * 130_000), (10, "a" * 100_000),
]


def brute_features(text, order):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, order=2, buckets=10_000, percent=25, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in brute_features(text, order)[1])
    t = Counter(bucket(f) for text in target for f in brute_features(text, order)[1])
    all_s, all_t = s.total() + buckets, t.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    rows = []
    for i, text in docs:
        w, found = brute_features(text, order)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in rows)


def drawn(spark, docs, target, **more):
    d = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    t = with_clashes(spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string"))
    got = resample.resample(d, t, **more)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("more", [{}, {"order": 3, "buckets": 97, "percent": 70, "min_words": 2}])
def test_resample_brute_force(spark, more):
    target = ["The cat sat.", None, "", "on the mat"]
    assert drawn(spark, DOCS, target, **more) == brute_resample(DOCS, target, **more)


def test_resample_small_tries(spark, monkeypatch):
    """Tries that are emptied again and again, and texts walked in pieces, count and weigh alike."""
    import pyspark.cloudpickle

    monkeypatch.setattr(resample, "MAX_NODES", 3)
    monkeypatch.setattr(resample, "PIECE", 4)
    monkeypatch.setattr(resample, "PATHS", 5)
    pyspark.cloudpickle.register_pickle_by_value(resample)
    try:
        docs = [x for x in DOCS if x[0] not in (9, 10)]
        assert drawn(spark, docs, ["the cat"], order=3) == brute_resample(docs, ["the cat"], order=3)
    finally:
        pyspark.cloudpickle.unregister_pickle_by_value(resample)


def test_resample_empty_tables(spark):
    assert drawn(spark, [], ["x"]) == Counter()
    assert drawn(spark, DOCS[:6], []) == brute_resample(DOCS[:6], [])


def test_resample_copies(spark):
    """A third of the rows of one id: each has a rank of its own."""
    docs = [(5, "the cat " * 30)] * 50 + [(100 + k, f"word{k} " * 25) for k in range(100)]
    assert drawn(spark, docs, ["the cat"]) == brute_resample(docs, ["the cat"])


def brute_tree(data):
    h = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            own[c].append((turn is not None, turn or 0, h(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        n = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:n] + turns[n:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    return Counter(
        (
            min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(c for c in who if built[c] == p))).encode()).hexdigest(),
        )
        for p, who in members.items()
    )


def tree(spark, data):
    got = prefix_tree.prefix_tree(with_clashes(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")))
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return Counter(tuple(r[c] for c in names) for r in got.collect())


def test_prefix_tree_brute_force(spark):
    """Many shared beginnings, chains on chains, repeated rows, null fields, null and negative ids."""
    rng = np.random.default_rng(3)
    data = []
    for c in range(-12, 60):
        turns = rng.permutation(int(rng.integers(0, 14)))
        data += [(c, int(t), "ab"[int(t) % 2], "xyé"[int(rng.integers(0, 2))] * int(rng.integers(0, 2))) for t in turns]
    data += [(7, None, None, "first"), (7, None, "b", None), (8, 1, "a", "x"), (8, 1, "a", "x"), (None, 1, "a", "x"), (1_003, 0, "a", "z")]
    assert tree(spark, data) == brute_tree(data)


def test_prefix_tree_long_conversations(spark, monkeypatch):
    """One conversation holds most turns; running values are carried over chunks."""
    monkeypatch.setattr(prefix_tree, "CHUNK", 16)
    monkeypatch.setattr(prefix_tree, "ENDS", 4)
    data = [(0, t, "u", f"t{t}") for t in range(300)] + [(5, t, "u", f"t{t}") for t in range(290)] + [(5, 299, "u", "end")]
    data += [(c, t, "u", "t0") for c in range(10, 60) for t in range(1)]  # many that end alike
    assert tree(spark, data) == brute_tree(data)


def test_prefix_tree_few_rows(spark):
    assert tree(spark, []) == Counter()
    assert tree(spark, [(3, 0, "u", "x")]) == brute_tree([(3, 0, "u", "x")])
    assert tree(spark, [(3, 0, "u", "long " * 200_000), (4, 1, None, "")]) == brute_tree([(3, 0, "u", "long " * 200_000), (4, 1, None, "")])
