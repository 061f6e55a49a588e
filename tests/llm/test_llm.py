"""Operators of the llm subpackage against brute force, and on odd inputs."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rivulet.llm import (
    bpe,
    decontam,
    html_extract,
    lm,
    quality_classifier,
    quality_rules,
    secrets,
    simhash,
    toxicity,
    url_filter,
)
from rivulet.llm.common import table
from rivulet.llm.queries import ORACLES, QUERIES, TOKENIZER
from tests.compare import duck, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "the cat " * 3000), (6, "the cat " * 3000), (4, "one"),
    (7, "É ẞ 漢字 𝄞 <|endoftext|> 'tis"), (None, "no id here"), (8, "password = hunter2xyz AKIA" + "Q7" * 10),
]


def odd(spark, data=ODD):
    """Rows with columns whose names the operators use themselves."""
    df = spark.createDataFrame(data, "doc_id long, text string")
    for name in ("score", "spans", "hits", "kept", "w", "t", "h1", "fp", "key", "label", "lang", "source", "c", "n_chars"):
        df = df.withColumn(name, F.lit("x"))
    return df.withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def collected(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck(ORACLES[name], sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_quality_rules_brute_force(spark):
    def base(text):
        w = WORD.findall(text or "")
        spans = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(spans)
        covered = {i + k for i, s in enumerate(spans) if n[s] > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))

    data = [*ODD, (20, "a b c d e f g h " * 2 + "# & x\nx\nx\n\n"), (21, "q " * 7), (22, "\n".join("ab" * 3 for _ in range(9)))]
    got = collected(quality_rules.quality_rules(odd(spark, data)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in got) == sorted((str(i), *base(t)) for i, t in data)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)


def test_url_filter(spark):
    urls = [
        (1, None), (2, "no scheme"), (3, "http://WWW.Example.com/en/1?x"), (4, "http://a.example.com/en/"), (5, "ftp://x.net/es/a#b"),
        (6, "http://x.net/es"), (7, "http://example.com"), (8, "http://anet/fr/1"), (9, "http://net/fr/?q=://a"), (1, None),
    ]
    got = {r["page_id"]: r for r in collected(url_filter.url_filter(spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit(1))))}
    want = {1: None, 2: None, 3: "www.example.com/en/", 4: "example.com/en/", 5: "net/es/", 6: None, 7: None, 8: None, 9: "net/fr/"}
    assert {i: r["rule"] for i, r in got.items()} == want
    assert got[4]["verdict"] == got[5]["verdict"] == "block" and got[3]["verdict"] == got[6]["verdict"] == "allow"
    assert (got[3]["host"], got[3]["path"]) == ("www.example.com", "/en/1") and got[2]["host"] == ""


def test_url_rules_brute_force():
    """The longest of many rules below few hosts, as a scan over all rules finds it."""
    rng = np.random.default_rng(6)
    hosts, parts = ["com", "a.com", "b.a.com", "net"], ["x", "xy", "y", "x/y", "xyz/", ""]
    rules = [("allow" if rng.integers(2) else "block", f"{rng.choice(hosts)}/{rng.choice(parts)}{rng.choice(parts)}") for _ in range(60)]
    trie = url_filter.build_trie(rules)
    for _ in range(400):
        host, path = rng.choice([*hosts, "c.b.a.com", "xcom"]), f"/{rng.choice(parts)}{rng.choice(parts)}{rng.choice(parts)}"
        fit = [
            r for _, r in rules
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])
        ]
        rule, verdict = url_filter.longest(trie, host, path)
        assert (len(rule) if rule else 0) == max(map(len, fit), default=0) and (rule in fit if fit else rule is None)
        assert verdict == next((v for v, r in reversed(rules) if r == rule), None)
    begun = time.monotonic()
    trie = url_filter.build_trie(("block", f"com/p{k}") for k in range(1_000_000))
    assert url_filter.longest(trie, "a.com", "/p999999/x") == ("com/p999999", "block") and time.monotonic() - begun < 60


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps):
    """fps: list of (id, fingerprint)."""
    parent = {f: f for _, f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[top(a)] = top(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[top(f)] = min(least.get(top(f), i), i)
    return [(i, format(f, "016x"), least.get(top(f))) for i, f in fps]


def test_simhash_brute_force(spark, docs):
    data = [*ODD, *docs.items()]
    # near copies of one document: the fingerprint moves by a few bits
    base = next(t for t in docs.values() if len(t) > 3000)
    data += [(10_000 + k, base + f" extra{k}") for k in range(30)]
    got = collected(simhash.near_duplicates(odd(spark, data)))
    want = brute_components([(i, brute_fingerprint(t)) for i, t in data])
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)


def test_one_of_each_group_stays(spark):
    data = [(5, "a b c d"), (3, "A b c d"), (3, "A b c d"), (9, "quite another text here"), (None, "a b c d"), (None, "x y")]
    kept = simhash.keep_first(odd(spark, data))
    assert sorted(str(r["doc_id"]) for r in collected(kept)) == ["3", "9", "None", "None"]
    assert kept.columns == odd(spark).columns


def test_texts_of_one_id_are_judged_apart(spark):
    data = [(1, "a b c d"), (3, "totally other words here now"), (3, "a b c d"), (4, "a b c d")]
    kept = simhash.keep_first(odd(spark, data))
    assert sorted((r["doc_id"], r["text"]) for r in collected(kept)) == [(1, "a b c d"), (3, "totally other words here now")]


@pytest.mark.parametrize("shingles", [50, 2000])
def test_crowded_keys_in_blocks(spark, monkeypatch, shingles):
    """Crowds of texts that share some or all keys, walked in blocks of few texts: no link is lost."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", shingles)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5000, 60)]
    data = []
    for i in range(60):  # a chain of texts, each a word away from the one before, and some of other ends
        base = list(base)
        base[rng.integers(60)] = f"c{i}"
        data.append((i, " ".join(base)))
    data += [(100 + i, " ".join(base[:30] + [f"z{i}-{k}" for k in range(i)])) for i in range(20)]
    assert {r["doc_id"] for r in collected(simhash.keep_first(odd(spark, data)))} == brute_alike(data)


def brute_alike(texts):
    """texts: list of (id, text). The smallest ids of the components of five-word-shingle similarity 0.8 or more."""
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    least = {i: i for i in sets}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                least[b] = a
    return {i for i in ids if top(i) == i}


def test_stage_finds_near_copies(spark, docs):
    """Copies with edits far beyond op5's three bits, in few and in crowded keys, and texts just below the similarity."""
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    data, i = [*docs.items()], 20_000
    for size, copies, edits in ((400, 1, 6), (400, 1, 9), (400, 40, 4), (200, 25, 3), (60, 1, 1), (60, 1, 2), (5, 2, 0), (3, 2, 0)):
        base = words(size)
        for _ in range(copies + 1):
            copy = list(base)
            for at in rng.choice(size, edits, replace=False):
                copy[at] = f"edit{i}"
            data.append((i, " ".join(copy)))
            i += 1
    far = [a for a, b in zip(data[-110:], data[-109:]) if (brute_fingerprint(a[1]) ^ brute_fingerprint(b[1])).bit_count() > 3]
    assert far
    kept = {r["doc_id"] for r in collected(simhash.keep_first(odd(spark, data)))}
    assert kept == brute_alike(data)


def test_stage_links_come_from_fingerprints(spark, monkeypatch):
    """The stage's fingerprints are votes of the shingles, near texts meet in their balls, and nothing is found beside these."""
    rng = np.random.default_rng(3)
    missed = 0
    for size, gone in ((5, 1), (10, 2), (100, 20), (600, 120)):
        for _ in range(25):
            union = rng.integers(0, 1 << 64, size, dtype=np.uint64)
            sets = [union[gone // 2 :], union[: size - (gone - gone // 2)]]  # similarity 0.8
            margin = np.array([simhash.margins(s) for s in sets])
            one, two = simhash.balls(margin, np.array([len(s) for s in sets]))
            missed += not set(one.tolist()) & set(two.tolist())
            bits = (margin[:, simhash._BITS :] > 0).astype(int)
            assert (bits[0] != bits[1]).sum() <= simhash.STAGE_RADIUS
            blocks = (margin[0][: simhash._BITS] > 0).reshape(simhash.BLOCKS, simhash.WIDTH)
            own = [sum(1 << k for k in range(simhash.WIDTH) if b[k]) for b in blocks]
            for key in one.tolist():
                assert (key % (1 << simhash.WIDTH) ^ own[key >> simhash.WIDTH]).bit_count() <= simhash.WEAKEST
    assert not missed
    parts = [simhash.margins(union[:300]), simhash.margins(union[300:])]
    assert (simhash.margins(union) == parts[0] + parts[1]).all()  # votes of more shingles than a byte counts

    data = [(k, " ".join(f"w{x}" for x in range(200)) + f" end{k}") for k in range(3)]
    assert [r["doc_id"] for r in collected(simhash.keep_first(odd(spark, data)))] == [0]
    monkeypatch.setattr(simhash, "balls", lambda margin, sizes: [np.array([k], dtype=np.int32) for k in range(len(sizes))])
    assert {r["doc_id"] for r in collected(simhash.keep_first(odd(spark, data).coalesce(1)))} == {0, 1, 2}


def rows_made(spark, after, kind):
    """Rows that the operators of a kind (a part of their name) made in the executions after one."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, made = store.executionsList(), 0
    for k in range(runs.size()):
        run = runs.apply(k).executionId()
        if run <= after:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for metric in (node.metrics().apply(j) for j in range(node.metrics().size()) if kind in node.name()):
                found = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and found.isDefined():
                    made += int(found.get().replace(",", ""))
    return made


@pytest.mark.parametrize("alike", [False, True])
def test_rows_of_keys_grow_with_the_nodes(spark, monkeypatch, alike):
    """Unlike texts that share small keys make no pairs for a join; near copies in crowded keys are not handed on by key."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    data = []
    for i in range(240):
        text = list(base) if alike else [f"w{x}" for x in rng.integers(0, 5000, 150)]
        if alike:
            for at in rng.choice(150, 3 if i else 0, replace=False):
                text[at] = f"e{i}"
        data.append((i, " ".join(text)))
    if not alike:  # each text meets up to 7 others in each of 64 keys
        deals = [rng.permutation(240) // 8 for _ in range(64)]
        place = iter(range(240))
        dealt = lambda: [k << simhash.WIDTH | int(deal[i]) for i in [next(place)] for k, deal in enumerate(deals)]
        monkeypatch.setattr(simhash, "balls", lambda margin, sizes: [np.array(dealt(), dtype=np.int32) for _ in sizes])
    store = spark._jsparkSession.sharedState().statusStore()
    after = max((store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())), default=-1)
    kept = {r["doc_id"] for r in collected(simhash.keep_first(odd(spark, data).coalesce(1)))}
    assert kept == brute_alike(data)
    assert rows_made(spark, after, "FlatMapGroupsInPandas" if alike else "SortMergeJoin") < 240 * 20


def test_groups_in_several_batches():
    """A group's rows may come in any cuts."""
    rng = np.random.default_rng(6)
    frames = []
    for root in range(6):
        one = rng.integers(0, 1 << 62, 40)
        frames += [(root, 10 * root + k, np.unique(np.append(one, k))) for k in range(root + 1)]
    rows = pd.DataFrame(frames, columns=["root", "node", "found"])
    for size in (1, 2, 5, 100):
        cut = [rows.iloc[k : k + size] for k in range(0, len(rows), size)]
        links = pd.concat(simhash._walk_groups(iter(cut)))
        assert sorted(zip(links["a"], links["b"], strict=True)) == [(10 * r, 10 * r + k) for r in range(6) for k in range(1, r + 1)]


def test_split_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT_FROM", 20)
    rng = np.random.default_rng(4)
    values = sorted({int(sum(1 << int(b) for b in set(rng.integers(0, 24, rng.integers(0, 6))))) for _ in range(120)})
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    roots = {r["node"]: r["root"] for r in collected(simhash.components(edges))}
    want = brute_components(list(enumerate(values)))
    assert len({roots.get(v, v) for v in values}) == len({c for _, _, c in want})


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(30, 45), max_size=4), min_size=1, max_size=60))
def test_spanning_tree_reaches_all(flips):
    fps = np.unique(np.array([sum(1 << b for b in set(f)) for f in flips], dtype=np.uint64))
    want = brute_components([(i, int(f)) for i, f in enumerate(fps)])
    for limit in (0, 1000):
        tree = simhash.spanning_tree(fps, limit)
        assert all(int(fps[a] ^ fps[b]).bit_count() <= 3 for a, b in tree)
        assert len(tree) == len(fps) - len({c for _, _, c in want})


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(0, 63), max_size=4), min_size=2, max_size=80))
def test_links_find_every_pair(spark, flips):
    """Many fingerprints around one: keys with few and with many."""
    values = sorted({sum(1 << b for b in set(f)) for f in flips})
    signed = [(v - (1 << 64) * (v >> 63),) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    parent = {v: v for v, in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[top(a)] = top(b)
    want = brute_components(list(enumerate(values)))
    assert len({top(v) for v, in signed}) == len({c for _, _, c in want})


def brute_base(text):
    text, found = text or "", []
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_base_and_field(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in collected(QUERIES["op6_secrets"](spark, sf_dir))}
    names = ("assign", "access", "hex")
    for i, text in docs.items():
        want = brute_base(text)
        line = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{n}"] for n in names] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert set(filter(None, line.split(","))) <= set(got[i]["spans"].split(","))
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [f'word {k} mail a{k}b@mail{k}.example.com then token = "{secret[k:]}{secret[:k]}" end' for k in range(30)]
    field = secrets.Field.train([c for t in texts for c in secrets.chains(t)])
    hidden = "the key is 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B here, write to joe77@mail9.example.com"
    assert [hidden[a:b] for a, b in field.spans(hidden)] == ["9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B"]
    assert secrets.redact("a SECRET b", [{"start": 2, "end": 8}]) == "a [SECRET] b"


def test_field_finds_secrets_beyond_the_base(spark):
    """Secrets of forms that the base misses, planted in documents; and what is like them but none."""
    folder = "/root/testdata/sf0.01"
    documents = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    rng = np.random.default_rng(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    draw = lambda among, n: "".join(among[k] for k in rng.integers(0, len(among), n))
    forms = [
        lambda: ("aws_secret_access_key = ", draw(letters + "0123456789+/", 40)),
        lambda: ("", "ghp_" + draw(letters + "0123456789", 36)),
        lambda: ("Authorization: Bearer ", ".".join(draw(letters + "0123456789", n) for n in (30, 60, 43))),
        lambda: ("", draw("0123456789ABCDEF", 40)),
        lambda: ("pwd: ", draw(letters.lower(), 6) + draw("0123456789", 4)),
        lambda: ("private_key=", draw(letters + "0123456789", 32)),
    ]
    planted, where = [(i, t) for i, t in documents.items()], {}
    texts = [t for t in documents.values() if 300 < len(t) < 5000]
    for k in range(30):
        words = texts[rng.integers(len(texts))].split(" ")
        at = int(rng.integers(len(words)))
        lead, secret = forms[k % len(forms)]()
        left = " ".join(words[:at] + [""]) + lead
        where[10**6 + k] = (len(left), len(left) + len(secret))
        planted.append((10**6 + k, left + secret + " " + " ".join(words[at:])))
    got = {r["doc_id"]: r["spans"] for r in collected(secrets.secrets(odd(spark, planted)))}
    base_only = [i for i, (a, b) in where.items() if any(s < b and a < e for s, _, e in brute_base(dict(planted)[i]))]
    found = [i for i, (a, b) in where.items() if any(s["start"] <= a and s["end"] >= b for s in got[i])]
    assert not base_only and len(found) >= 0.9 * len(where)
    assert sum(s["kind"] == "crf" for i in documents for s in got[i]) <= 0.001 * len(documents)


def test_viterbi_finds_the_best_tags():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = 5
        field = secrets.Field({"": 0, **{str(i): i + 1 for i in range(n)}}, rng.normal(size=(n + 1, 3)), rng.normal(size=(3, 3)))
        names, may = [[str(i)] for i in range(n)], [bool(x) for x in rng.integers(0, 2, n)]

        def score(tags, field=field, may=may):
            if tags[0] == 2 or any(t and not m for t, m in zip(tags, may)) or any(a == 0 and b == 2 for a, b in zip(tags, tags[1:])):
                return -math.inf
            return sum(field.weights[i + 1, t] for i, t in enumerate(tags)) + sum(field.moves[a, b] for a, b in zip(tags, tags[1:]))

        best = max((tuple(t) for t in np.ndindex(*[3] * n)), key=score)
        assert tuple(field.decode(names, may)) == best


@pytest.mark.parametrize("least", [1, 2, 3])
def test_lm_brute_force(spark, docs, least):
    data = [*ODD, *list(docs.items())[:150]]
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), "\n"]
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 if i is not None else -1
    c, pairs = Counter(), Counter()
    for i, t in data:
        if fold(i) != 2:
            c.update(tokens(t))
            pairs.update(zip(tokens(t), tokens(t)[1:]))
    n, v = sum(c.values()), len(c)
    uni = lambda w: (c[w] + 1) / (n + v + 1)
    arcs = {p: (k - lm.DISCOUNT) / c[p[0]] for p, k in pairs.items() if k >= least}
    fail = {}
    for u in {p[0] for p in arcs}:
        mine = [p for p in arcs if p[0] == u]
        fail[u] = (1 - sum(arcs[p] for p in mine)) / (1 - sum(uni(p[1]) for p in mine))

    def model(t):
        w, total = tokens(t), 0.0
        for a, b in zip([None, *w], w):
            total += math.log10(arcs[a, b] if (a, b) in arcs else fail.get(a, 1.0) * uni(b))
        return total

    want = sorted(
        (str(i), fold(i) == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10(uni(w)) for w in tokens(t)), model(t))
        for i, t in data
    )
    got = sorted((str(r["doc_id"]), *list(r.values())[1:]) for r in collected(lm.score(odd(spark, data), least=least)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_lm_rate_does_not_choose_arcs(spark, docs, monkeypatch):
    """What is broadcast, little, some or all of it, changes no score: every pair that occurs twice is an arc."""
    data = [*ODD, *list(docs.items())[:60]]
    got = []
    for rate in (0.9, 1e-2, 1e-6):
        monkeypatch.setattr(lm, "RATE", rate)
        got.append(sorted((str(r["doc_id"]), *list(r.values())[1:]) for r in collected(lm.score(odd(spark, data)))))
    assert [g[:5] for g in got[0]] == [g[:5] for g in got[1]] == [g[:5] for g in got[2]]
    for other in got[:2]:
        assert np.allclose([g[5:] for g in other], [g[5:] for g in got[2]], rtol=1e-9)


def test_lm_hashes_equal_sparks(spark):
    rows = [(0, 0), (1, -1), (-(2**63), 2**63 - 1), (12345678901234, -987654321)]
    df = spark.createDataFrame(rows, "x long, y long").select("x", "y", lm.pair_id("x", "y"), lm.bit_place(F.col("x")))
    x, y, pair, bit = (np.array(c, dtype=np.int64) for c in zip(*df.collect()))
    assert (lm.pair_ids(x, y) == pair).all() and (lm.bit_places(x) == bit).all()
    assert ((bit >= 0) & (bit < 1 << lm.BITMAP)).all()


@pytest.mark.parametrize("least", [1, 2])
def test_lm_sums_to_one_after_every_state(spark, least):
    """p(b|a) from the scores of "a b", "a" and "b", over all tokens b, an unseen one and the end."""
    ids = lambda held: (i for i in range(10**6) if (zlib.crc32(str(i).encode()) % 7 == 2) == held)
    taught = ["a b a b c", "b a c", "a b", "c", "d a b"]
    known = ["a", "b", "c", "d"]
    asked = [*known, "unseen", *[f"{x} {y}" for x in [*known, "unseen"] for y in [*known, "unseen"]]]
    data = [*zip(ids(False), taught), *zip(ids(True), asked)]
    got = {i: r for i, r in zip([t for _, t in data], sorted(collected(lm.score(spark.createDataFrame(data, "doc_id long, text string"), least=least)), key=lambda r: [i for i, _ in data].index(r["doc_id"])))}
    counts = Counter(w for t in taught for w in [*t.split(), "end"])
    root = lambda w: math.log10((counts[w] + 1) / (counts.total() + len(counts) + 1))
    for x in [*known, "unseen"]:
        after = [got[f"{x} {y}"]["score"] - got[y]["score"] + root(y) - root(x) for y in [*known, "unseen"]]
        assert math.isclose(sum(10**p for p in [*after, got[x]["score"] - root(x)]), 1, rel_tol=1e-9)


def test_bpe_equals_the_library(spark, sf_dir, docs):
    library = Tokenizer.from_file(TOKENIZER)
    got = {r["doc_id"]: r for r in collected(QUERIES["op8_bpe"](spark, sf_dir))}
    for i, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the ", "a", " ", "\n", "  ", "é", "漢字", "'s", " ", "1234", "<|endoftext|>", "!?", " x", "\x1c", "\x85"]), max_size=40), st.integers(1, 60))
def test_bpe_joins(parts, times):
    library, ours = Tokenizer.from_file(TOKENIZER), bpe.vocabulary(TOKENIZER)
    text = "".join(parts) * times
    ids = ours.encode(text)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert ours.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False) == text


def test_decontamination(spark):
    item = "Thtieding. Onhe in haedea it ha with orbleat thesstea heerthly erensh oron nt thinorsh erresh that anonhath end."
    edited = item.replace("haedea", "haedxa").replace("oron nt", "oron n").upper()
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "short"), (1, item)], "item_id long, text string")
    data = [(1, f"before {item} after"), (2, f"x\n{edited}!!"), (3, item[:60]), (4, "clean text " * 50), (5, None), (6, "")]
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in collected(decontam.leaks(odd(spark, data), benchmark)))
    assert got == [(1, 1, 0), (1, 1, 0), (2, 1, 2), (2, 1, 2)]
    kept = decontam.without_leaks(odd(spark, data), benchmark)
    assert sorted(r["doc_id"] for r in collected(kept)) == [3, 4, 5, 6] and kept.columns == odd(spark).columns


def test_items_of_every_length_have_their_budget(spark):
    """One wrong letter for every twenty, from twenty on; 19 letters must be right."""
    phrases = {n: ("abcdefghij klmnopqrs tuvwxyz " * 3)[:n].strip() for n in (18, 20, 35, 40, 41, 60)}
    benchmark = spark.createDataFrame(list(phrases.items()), "item_id long, text string")
    for n, phrase in phrases.items():
        k = len(phrase) // 20
        wrong = lambda times, phrase=phrase: "".join("#0123"[i // 7] if i % 7 == 3 and 0 < i // 7 <= times else c for i, c in enumerate(phrase))
        data = [(1, f"x {wrong(k)} y"), (2, f"x {wrong(k + 1)} y")]
        only = benchmark.where(F.col("item_id") == n)
        got = {r["doc_id"]: r["distance"] for r in collected(decontam.leaks(odd(spark, data), only))}
        assert got == {1: k}, (n, got)
    empty = benchmark.limit(0)
    assert collected(decontam.leaks(odd(spark), empty)) == [] and decontam.without_leaks(odd(spark), empty).count() == len(ODD)


def test_short_items_are_found_as_whole_words(spark):
    benchmark = spark.createDataFrame([(1, "Short one!"), (2, "..."), (3, "x")], "item_id long, text string")
    data = [(1, "a SHORT, one b"), (2, "short ones"), (3, "x"), (4, "xx"), (5, "ashort one"), (6, None), (7, "short one")]
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in collected(decontam.leaks(odd(spark, data), benchmark)))
    assert got == [(1, 1, 0), (3, 3, 0), (7, 1, 0)]


def test_decontamination_brute_force(spark, sf_dir, docs, monkeypatch):
    """Each item's distance to each whole text, without pieces; the benchmark in one slice and in many."""
    items = [(r.item_id, decontam.normal(r.text)) for r in table(spark, sf_dir, "benchmark").collect()][:25]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    some = [(i, t) for i, t in docs.items() if len(t) < 4000][:40]
    texts, rng = [t for _, t in some], np.random.default_rng(2)
    for k, (_, item) in enumerate(items[:15]):  # with 0 to 14 letters changed
        letters = list(item)
        for at in rng.integers(0, len(item), k):
            letters[at] = "q"
        some.append((5000 + k, f"{texts[k][:300]} {''.join(letters)} {texts[k][300:600]}"))
    want = []
    for i, t in some:
        for item_id, item in items:
            distance, _ = decontam.myers(decontam.peq(item), len(item), decontam.normal(t))
            if distance <= decontam.budget(len(item)):
                want.append((i, item_id, distance))
    for size in (decontam.SLICE_CHARS, 600):
        monkeypatch.setattr(decontam, "SLICE_CHARS", size)
        got = [(r["doc_id"], r["item_id"], r["distance"]) for r in collected(decontam.leaks(odd(spark, some), benchmark))]
        assert sorted(got) == sorted(want)
        kept = decontam.without_leaks(odd(spark, some), benchmark)
        assert {r["doc_id"] for r in collected(kept)} == {i for i, _ in some} - {w[0] for w in want}


@settings(max_examples=100, deadline=None)
@given(st.text("ab ", min_size=1, max_size=12), st.text("ab ", max_size=25))
def test_myers_distance(pattern, text):
    last = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1))
        last = row
    assert decontam.myers(decontam.peq(pattern), len(pattern), text)[0] == min(last)


def test_html(spark, sf_dir):
    for r in table(spark, sf_dir, "pages").select("html").limit(60).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", article)]
        assert html_extract.main_text(r.html) == "\n\n".join(p for p in parts if p)
    page = (
        "<body><header>Top. Bar.</header><div class='menu'><a href=x>A</a></div><main><h1>Title</h1><div class=cookie-notice>We use"
        " cookies.</div><p>Long text, with &lt;marks&gt;, and more of it; enough.<p>Second <b>bold</b>\n <a href=y>link</a> part."
        "<form><p>Name, please.</p></form><section id='comments'><p>I like this, really.</p></section></main><aside>Side, bar.</aside>"
        "<script>var a = '<p>no</p>';</script><!-- <p>hidden</p> --></body>"
    )
    assert html_extract.main_text(page) == "Title\n\nLong text, with <marks>, and more of it; enough.\n\nSecond bold link part."
    assert html_extract.main_text("<div><div><p>Plain page, with a text. And more.</div></div>") == "Plain page, with a text. And more."
    pages = [(1, "u", None), (2, "u", ""), (3, None, "<p"), (4, "u", "<b>x"), (4, "u", "<b>x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in collected(html_extract.extract(df)))
    assert got == [(1, "", 0), (2, "", 0), (3, "", 0), (4, "x", 1), (4, "x", 1)]


LONG = "A long sentence of the article, with marks; and more words in it. " * 5


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<script>for(i=0;i<n;i++){}</script><p>Main text, here.</p>", ["Main text, here."]),
        (f"<div class='content with-sidebar'><article><p>{LONG}</p></article><div class=sidebar><p>Side, bar.</p></div></div>", [LONG]),
        (f"<body><form><nav><a href=x>Home</a></nav><div><h1>T</h1><p>{LONG}</p><p>Short.</p></div></form></body>", ["T", LONG, "Short."]),
        (f"<article><p>{LONG}</p><p class='share-price'>Price, 12.</p></article>", [LONG, "Price, 12."]),
        (f"<header><p>Site.</p></header><article><header><h1>Title</h1></header><p>{LONG}</p></article>", ["Title", LONG]),
        (f"<article><p>{LONG}<p>{LONG}<ul><li>Milk</ul><figure><figcaption>Cap</figcaption></figure><dl><dt>D<dd>E</dl></article>",
         [LONG, LONG, "Milk", "Cap", "D", "E"]),
    ],
)
def test_html_loses_no_main_text(page, want):
    assert html_extract.main_text(page) == "\n\n".join(w.strip() for w in want)


def test_html_ratios_decide(spark, sf_dir, monkeypatch):
    """Without marks the ratios find the content; without the ratios' threshold they do not."""
    menu = "".join(f"<p>Entry number {k}</p>" for k in range(40))
    page = f"<body><div class=m>{menu}</div><div class=a><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class=b><p>Terms</p></div></body>"
    want = "\n\n".join(["T", LONG.strip(), LONG.strip()])
    assert html_extract.main_text(page) == want
    for name in ("OUTSIDE", "OUTSIDE_WORDS", "INSIDE"):
        monkeypatch.setattr(html_extract, name, frozenset())
    assert html_extract.main_text(page) == want
    pages = [r.html for r in table(spark, sf_dir, "pages").select("html").limit(60).collect()]
    same = 0
    for html in pages:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", article)]
        same += html_extract.main_text(html) == "\n\n".join(p for p in parts if p)
    assert same >= 0.8 * len(pages)
    monkeypatch.setattr(html_extract.Page, "values", lambda self: [1.0] * len(self.texts))
    assert "Entry number 7" in html_extract.main_text(page)


@pytest.mark.parametrize("holder", ["article", "main", "div class=story"])
def test_html_keeps_short_blocks_between_long_ones(holder):
    long = "A long sentence of the article, with marks; and more words in it. " * 9
    page = (
        f"<html><body><nav><p>Home, more.</p></nav><{holder}><p>{long}</p><p>{long}</p><h2>What to buy</h2><ul><li>Milk<li>Flour"
        "<li>Two eggs</ul><h2>Sizes</h2><table><tr><th>Size<td>Number<tr><td>Small<td>12</table><h2>Code</h2><pre>x = 1</pre>"
        f"<figure><figcaption>A picture</figcaption></figure><div class=share>Share</div><h2>End</h2><p>{long}</p><p>{long}</p>"
        f"</{holder.split()[0]}><footer>Foot.</footer></body></html>"
    )
    short = ["What to buy", "Milk", "Flour", "Two eggs", "Sizes", "Size", "Number", "Small", "12", "Code", "x = 1", "A picture", "End"]
    want = [long.strip(), long.strip(), *short, long.strip(), long.strip()]
    assert html_extract.main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity", "toxic", 0.7), ("op4_quality_classifier", "quality", 0.9)])
def test_classifiers_on_held_out_labels(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    scored = QUERIES[name](spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out").toPandas()
    assert ((scored["score"] >= 0) & (scored["score"] <= 1)).all()
    pos, neg = scored[scored[label] == 1]["score"], scored[scored[label] == 0]["score"]
    auc = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert auc >= least
    assert (scored["predicted"] == (scored["score"] >= 0.3)).all()


def test_quality_of_few_labels(spark):
    """Four labelled documents, all of them in the part that calibrates."""
    ids = [i for i in range(1, 200) if xxhash.xxh64_intdigest(f"part {i}") % 10 >= 7 and zlib.crc32(str(i).encode()) % 5][:4]
    frame = spark.createDataFrame([(i, f"some words {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in collected(quality_classifier.quality(frame, labels)))


def test_context_vectors_brute_force(monkeypatch):
    """Context sums and pooled means by plain loops over the words, with blocks that cut texts."""
    texts = ["a b a c a", "", None, "b", "c a b " * 7]
    known, index = quality_classifier.Units(), quality_classifier.index_vectors()
    want = np.zeros((quality_classifier.BUCKETS + quality_classifier.SHAPES, quality_classifier.SIZE))
    cut = lambda w: (known[w] // quality_classifier.SHAPES, known[w] % quality_classifier.SHAPES + quality_classifier.BUCKETS)
    for t in texts:
        w = [cut(x) for x in (t or "").split()]
        for i, mine in enumerate(w):
            for j in range(max(i - 2, 0), min(i + 3, len(w))):
                for unit in mine if i != j else ():
                    want[unit] += index[w[j][0]] + index[w[j][1]]
    for block in (3, 1000):
        monkeypatch.setattr(quality_classifier, "BLOCK", block)
        assert np.allclose(quality_classifier.context_sums(*quality_classifier.units(texts, known), index), want)
    got = quality_classifier.pooled(texts, index, known)
    for row, t in zip(got, texts):
        vectors = [index[cut(w)[0]] for w in (t or "").split()]
        assert np.allclose(row[: quality_classifier.SIZE], np.mean(vectors, axis=0) if vectors else 0)


def test_toxicity_brute_force(spark, docs):
    """The query's scores from the fitted parts by plain loops; text that repeats a toxic document's words scores higher."""
    words = ["worth", "trash", "clown", "idiot"]
    rng = np.random.default_rng(3)
    clean = lambda: " ".join("".join(rng.choice(list("aeioustrnl"), 5)) for _ in range(60))
    data = [(i, clean() + (" " + " ".join(rng.choice(words, 6)) + " " + clean() if i % 2 else "")) for i in range(300)]
    data += [(400, None), (401, ""), (402, "the " * 5)]
    frame = odd(spark, data)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in collected(toxicity.toxicity(frame, labels))}
    model = toxicity.fit(frame.select("doc_id", "text"), labels)
    savings = toxicity.Savings(model["toxic"], model["ordinary"])
    for i, text in data[::25] + data[-3:]:
        cut = [w for w in re.sub("[^a-z]", " ", (text or "").lower()).split()]
        saved = []
        for at in range(0, len(cut), toxicity.WINDOW):
            raw = b""
            for w in cut[at : at + toxicity.WINDOW]:
                raw += bytes((ord(c) + 37 * (k + 1)) % 256 for k, c in enumerate(w)) + b"\0"
            saved.append(len(savings.plain.compress(raw)) - len(savings.mixed.compress(raw)))
        saved = saved or [0]
        top = (sorted(saved, reverse=True) + [0, 0])[:3]
        x = [*top, *[math.log1p(sum(d >= k for d in saved)) for k in toxicity.THRESHOLDS]]
        x += [sum(saved) / len(saved), math.log(len(saved)), sum(d >= toxicity.THRESHOLDS[2] for d in saved) / len(saved)]
        z = ((np.array(x) - model["mean"]) / model["spread"]) @ model["weights"][:-1] + model["weights"][-1]
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    held = [r for i, r in got.items() if i < 300 and r["held_out"]]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.9 * len(held)


@pytest.mark.parametrize("operator", ["quality_rules", "toxicity", "quality", "simhash", "secrets", "lm", "bpe", "leaks"])
def test_odd_and_empty_tables(spark, operator):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "x" * 50)], "item_id long, text string")
    run = {
        "quality_rules": quality_rules.quality_rules,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "quality": lambda d: quality_classifier.quality(d, labels),
        "simhash": simhash.near_duplicates,
        "secrets": secrets.secrets,
        "lm": lm.score,
        "bpe": lambda d: bpe.encode(d, TOKENIZER),
        "leaks": lambda d: decontam.leaks(d, benchmark),
    }[operator]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = Counter(r["doc_id"] for r in collected(run(odd(spark))))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert operator == "leaks" or ids == Counter(i for i, _ in ODD)
    assert collected(run(odd(spark).limit(0))) == []


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x" * 50)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        frame = odd(spark)
        got = stage(spark, frame, str(tmp_path))
        assert name == "encoding" or got.columns == frame.columns
        ids = Counter(r["doc_id"] for r in collected(got))
        if name == "near duplicates":  # 1, 2 and 3 have no words; 5 and 6, 4 and 4 are equal
            assert ids == Counter([1, 4, 5, 7, 8, None])
        else:
            assert ids == Counter(i for i, _ in ODD)
        assert collected(stage(spark, frame.limit(0), str(tmp_path))) == []


def test_pages_odd_and_empty(spark):
    frame = spark.createDataFrame([(1, None, None)] * 2, "page_id long, url string, html string").withColumn("rule", F.lit(1))
    for run in (url_filter.url_filter, html_extract.extract):
        assert [r["page_id"] for r in collected(run(frame))] == [1, 1]
        assert collected(run(frame.limit(0))) == []


def test_long_texts_in_linear_time():
    """Texts of megabytes, ordinary and hostile, within seconds."""
    field = secrets.Field.train([c for k in range(20) for c in secrets.chains(f'a token = "{"9f86d081884c7d659a2feaa0c55ad015" + str(k)}" b')])
    matcher = decontam.Matcher([(1, "x" * 100), (2, "ab cd")])
    for junk in ("word another. ", "a", "a1", "= ", "key=", '<a "', "<div>x", "<p><span>", "</i><i>", "<!--", "&", "<svg>", 'class="'):
        text, begun = junk * (1_000_000 // len(junk)), time.monotonic()
        html_extract.main_text(text)
        secrets.scan(text, field)
        matcher.matches(decontam.normal(text))
        simhash.shingle_set(text)
        assert time.monotonic() - begun < 40, junk


def test_pipeline_brute_force(spark, docs, tmp_path, sf_dir):
    """Each stage against what it should keep, on its own input."""
    frame = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    kept = corpus_pipeline.drop_toxic(spark, frame, sf_dir)
    scores = {r["doc_id"]: r["score"] for r in collected(toxicity.toxicity(frame, labels))}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, s in scores.items() if s < toxicity.CUT_OFF}
    first = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, sf_dir).select("doc_id").collect()}
    assert first == brute_alike([*docs.items()])
    clean = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, frame, sf_dir).select("doc_id").collect()}
    library = Tokenizer.from_file(TOKENIZER)
    for r in corpus_pipeline.encode(spark, frame, sf_dir).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, bytes(r.ids)) == (len(ids), np.array(ids, dtype="<u4").tobytes())
    items = [decontam.normal(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert clean <= set(docs) and clean != set(docs)
    some = [*sorted(set(docs) - clean)[:12], *sorted(clean)[:12]]
    for i in some:  # the distance of every item to the whole text, without pieces
        text = decontam.normal(docs[i])
        near = any(
            decontam.myers(decontam.peq(x), len(x), text)[0] <= decontam.budget(len(x))
            for x in items
            if len(x) >= decontam.MIN_CHARS
        )
        assert near == (i not in clean)
    redacted = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, frame, sf_dir).collect()}
    for i, text in docs.items():
        assert not brute_base(redacted[i].text) and redacted[i].n_chars == len(redacted[i].text)
        assert brute_base(text) or redacted[i].text == text or "[SECRET]" in redacted[i].text
    assert redacted[0].asDict().keys() == set(frame.columns)
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= len(docs)
