"""SimHash near-duplicates: 64-bit fingerprints, linked at 3 or fewer bits.

The links are found exactly, by meeting in the middle. A ball of half the
radius around every fingerprint, over all 64 bits, would take 2,081 variants a
fingerprint. The same guarantee is had from fewer rows, in two steps:

1. Folded balls. Of two fingerprints within 3 bits, one 32-bit half differs in
   at most 1 bit. If it is equal, one byte of the other half is equal too; if it
   differs in 1 bit, the other half differs in 2 at most, so that one of three
   blocks of it is equal. So every fingerprint emits its half (4 keys) and,
   because halves at distance 1 differ in parity, either the half itself (odd
   parity) or its 32 variants within the half radius (even parity), each with
   the three blocks. These keys have 40 bits and more; about 107 rows a
   fingerprint. Keys with a few fingerprints give pairs, which are verified.
2. Crowded keys. All pairs of a key with many fingerprints would grow with its
   square. There a task walks from fingerprint to fingerprint, each time to those
   not yet reached within 3 bits, and hands on the tree of its steps: a link less
   than it has fingerprints, and the same components. A key with more than SPLIT_FROM
   fingerprints is split first: of four interleaved quarters of the bits, two
   fingerprints within 3 bits have one in common, so each fingerprint goes to the
   four keys made of the key and a quarter. A key leaves about 24 bits open, 6 in a
   quarter, so that none of the four holds more than some 2^18 fingerprints; beyond
   WALK_UP_TO the walk looks up the variants of a fingerprint in the sorted key
   instead of comparing it with all, so that its time is linear in the key.

Groups are the connected components of the links, by repeated min-label
hooking and pointer jumping on tables of distinct fingerprints. Equal
fingerprints never expand: they are one node.

Defined results: a null text counts as empty; texts without words have the
fingerprint zero and link like any other; a null doc_id is never the smallest
id of a group; a text of any length is hashed whole, BLOCK shingles at a time; of
ids that tie for the smallest the group has one value; repeated rows give repeated
rows and an empty table none; only the id and the text are read, whatever other
columns are named.

keep_first, the pipeline's stage, has links of its own: texts whose sets of
five-word shingles have a Jaccard similarity of ALIKE or more. A text of fewer
words is its own shingle. At that similarity 10 of 64 bits of two fingerprints
differ, so that three bits find few of these links; the steps are the same, with
wider fingerprints and balls:

1. A fingerprint has BLOCKS blocks of WIDTH bits, each a vote of the set's shingles.
   The ball around it holds, of all blocks with up to WEAKEST flipped bits, the KEYS that
   a text of similarity ALIKE has most likely: a bit turns the easier the closer its vote
   was. Both texts flip, and so each half of the bits that differ: they meet in the middle.
2. Nodes of a key are near if of COMPARED further bits at most FINE_RADIUS differ, or STAGE_RADIUS if one of them has few
   shingles, whose votes are coarse. The bits go with the keys, so that only near pairs become rows: of a key with few nodes
   no more than connect its near ones, of a crowded key its least node, the hub, with each other one. Where a crowd is not
   in one piece by this, its nodes are compared in a task, once for all keys of its hub.
3. Every link lies within a component of the near pairs, a group. A group's sets meet in one task, once, and are walked there
   to a spanning tree of links, verified on the whole sets.

A pair of similarity 0.8 shares about 27 keys in 11 blocks, a more alike one more; what
is missed is in the README. Texts of equal sets are one node. Of a group of more than COMPARE_UP_TO
texts or BLOCK_SHINGLES shingles the crowds of the hubs are walked, in blocks of about BLOCK_SHINGLES shingles, which bounds
a task's memory. A crowd of several blocks needs links between them too: its texts are compared with one of them, and where
that leaves the crowd in several components every two blocks of it are walked together, so that no link is lost.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from rivulet.llm.common import checkpointed, in_parts, released

RADIUS = 3
SHINGLE = 3
SEED = 42

#: Shingles of one text that are hashed before their bits are added up.
BLOCK = 65536

#: Keys that hold more fingerprints than this are walked; than that, by looking up variants; than that, are split.
PAIRS_UP_TO = 8
WALK_UP_TO = 20_000
SPLIT_FROM = 1 << 16
#: Every fourth bit, from each of the first four.
QUARTERS = [0x1111111111111111, 0x2222222222222222, 0x4444444444444444, 0x8888888888888888 - (1 << 64)]

#: The pipeline's stage: words in a shingle, and the least similarity of a link.
STAGE_SHINGLE = 5
ALIKE = 0.8
#: Blocks of its fingerprints, bits in a block, and how many of these may flip.
BLOCKS, WIDTH, WEAKEST = 64, 24, 5
#: Keys in a ball; sets under FEW shingles, whose votes are coarse, have more.
KEYS, KEYS_OF_FEW, FEW = 256, 512, 16
#: Further bits that candidates are compared by, and how many may differ: of 128, 19 do at 0.8, and 64 of unlike texts.
COMPARED, STAGE_RADIUS = 128, 48
#: How many may differ of sets that both have FEW shingles or more: at 0.8 five standard deviations above the mean of 19.
FINE_RADIUS = 40
#: Shingles whose bits are added up at once, in bytes.
VOTES = 255
#: Nodes of a crowd or a group that are compared with each other, at most; shares of the crowds that are walked by turns.
COMPARE_UP_TO = 4096
TURNS = (16, 1)
#: Sets that a task remembers, to know copies.
SEEN = 1 << 18
#: Shingles in a group that is walked whole, at most, and in a block of a crowd.
BLOCK_SHINGLES = 4_000_000
_BITS = BLOCKS * WIDTH
_FLIP, _TIMES = np.random.default_rng(SEED).integers(0, 1 << 64, (2, (_BITS + COMPARED) // 64), dtype=np.uint64) | np.uint64(1)
_FLIPS = np.array([[s >> b & 1 for b in range(WEAKEST)] for s in range(1 << WEAKEST)])


def _likely() -> np.ndarray:
    """The chance that a bit stays in a text of similarity ALIKE, by hundredths of its margin over the square root of the votes."""
    cos = 2 * ALIKE / (1 + ALIKE)
    slope = cos / math.sqrt(1 - cos * cos)
    return np.array([min(0.5 * (1 + math.erf(slope * m / 100 / math.sqrt(2))), 1 - 1e-9) for m in range(400)])


_STAYS = -np.log(_likely()).astype(np.float32)
_TURNS = (-np.log(1 - _likely()) - _STAYS).astype(np.float32)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64 bits of a text; bytes.lower and bytes.split treat just A-Z and the contract's spaces."""
    w = (text or "").encode().lower().split()
    n = max(len(w) - size + 1, 1) if w else 0
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = w[at : at + BLOCK + size - 1]
        shingles = zip(*(part[k:] for k in range(size)), strict=False) if len(w) > size else [part]
        hashes = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in shingles], dtype=">u8")
        bits += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a long) for every row of docs."""

    @F.pandas_udf("long")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in in_parts(batches):
            yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).select(
        "doc_id", marked("text").alias("fp")
    )


def _blocks(half: str, other: str, widths: tuple[int, ...], flips: Column | None, tag: int) -> Column:
    """Keys (half, one block of the other half) for all blocks and, if given, all flips of the half."""
    keys, at = [], 0
    for q, width in enumerate(widths):
        block = F.shiftrightunsigned(other, at).bitwiseAND(F.lit((1 << width) - 1))
        low = block * 32 + F.lit(tag + q)
        keys.append(low)
        at += width
    lows = F.array(*keys)
    if flips is None:
        return F.transform(lows, lambda low: F.shiftleft(F.col(half), 19).bitwiseOR(low))
    each = lambda bit: F.transform(lows, lambda low: F.shiftleft(F.col(half).bitwiseXOR(bit), 19).bitwiseOR(low))
    return F.flatten(F.transform(flips, each))


def _bits(n: int, low: int = 0) -> Column:
    return F.array(*[F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long") for b in range(low, n)])


def folded_balls(fps: DataFrame) -> DataFrame:
    """(key, fp): fingerprints within RADIUS share a key."""
    halves = fps.select(
        "fp",
        F.shiftrightunsigned("fp", 32).alias("hi"),
        F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"),
    )
    parts = []
    for n, (half, other) in enumerate((("hi", "lo"), ("lo", "hi"))):
        tag = 16 * n
        odd = F.bit_count(half) % 2 == 1
        parts.append(_blocks(half, other, (8, 8, 8, 8), None, tag))
        parts.append(
            F.when(odd, _blocks(half, other, (11, 11, 10), None, tag + 8)).otherwise(
                _blocks(half, other, (11, 11, 10), _bits(32), tag + 8)
            )
        )
    return halves.select(F.explode(F.concat(*parts)).alias("key"), "fp")


def _near_all(fps: np.ndarray, left: np.ndarray, at: int) -> np.ndarray:
    """Of the places in left, those within RADIUS of the one at."""
    return left[np.bitwise_count(fps[left] ^ fps[at]) <= RADIUS]


def _near_variants(fps: np.ndarray, masks: np.ndarray, left: np.ndarray, at: int) -> np.ndarray:
    """The same by looking up every variant; left marks places that are not reached. fps: sorted."""
    variants = fps[at] ^ masks
    place = np.minimum(fps.searchsorted(variants), len(fps) - 1)
    place = place[fps[place] == variants]
    return place[left[place]]


def spanning_tree(fps: np.ndarray, walk_up_to: int = WALK_UP_TO) -> np.ndarray:
    """Rows (place, place) in distinct, sorted fps: links within RADIUS that reach all that such links reach."""
    from_, to = array("q"), array("q")
    few = len(fps) <= walk_up_to
    if few:
        left, masks = np.arange(len(fps)), np.zeros(0, dtype=np.uint64)
    else:
        left = np.ones(len(fps), dtype=bool)
        varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
        bits = [1 << b for b in range(64) if varying >> b & 1]
        masks = np.array([sum(c) for n in range(1, RADIUS + 1) for c in combinations(bits, n)], dtype=np.uint64)
    for start in range(len(fps)):
        if few:
            if not len(left):
                break
            if left[0] != start:
                continue
            left = left[1:]
        elif not left[start]:
            continue
        else:
            left[start] = False
        waiting = [start]
        while waiting:
            at = waiting.pop()
            if few:
                found = _near_all(fps, left, at)
                left = np.setdiff1d(left, found, assume_unique=True) if len(found) else left
            else:
                found = _near_variants(fps, masks, left, at)
                left[found] = False
            reached = found.tolist()
            from_.extend([at] * len(reached))
            to.extend(reached)
            waiting += reached
    return np.column_stack([np.frombuffer(x, dtype=np.int64) for x in (from_, to)])


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    fps = np.unique(rows["fp"].to_numpy().astype(np.int64).view(np.uint64))
    ends = fps.view(np.int64)[spanning_tree(fps)]
    return pd.DataFrame({"a": ends.min(axis=1), "b": ends.max(axis=1)})


def _pairs(met: DataFrame, node: str) -> DataFrame:
    """(a, b): all pairs of the nodes in keys that hold few."""
    few = met.where(F.col("n") <= PAIRS_UP_TO).groupBy("key").agg(F.sort_array(F.collect_list(node)).alias("g"))
    return few.select(
        F.explode(
            F.flatten(
                F.transform(
                    "g",
                    lambda a, i: F.transform(
                        F.slice(F.col("g"), i + 2, F.size("g")), lambda b: F.struct(a.alias("a"), b.alias("b"))
                    ),
                )
            )
        ).alias("p")
    ).select("p.a", "p.b")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs within RADIUS. fps: distinct."""
    by_key = Window.partitionBy("key")
    # the fingerprints are few bytes, their keys a hundred times as many: spread them first
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = folded_balls(fps.repartition(parts, "fp")).withColumn("n", F.count("*").over(by_key)).where("n > 1")
    met = checkpointed(met.select("key", "fp", "n"))

    paired = _pairs(met, "fp")
    crowds = met.where(F.col("n").between(PAIRS_UP_TO + 1, SPLIT_FROM)).select("key", "fp")
    quarters = F.array(*[F.xxhash64("key", F.lit(q), F.col("fp").bitwiseAND(F.lit(m))) for q, m in enumerate(QUARTERS)])
    split = met.where(F.col("n") > SPLIT_FROM).select(F.explode(quarters).alias("key"), "fp")
    walked = crowds.unionByName(split).groupBy("key").applyInPandas(_walk, "a long, b long")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    return paired.unionByName(walked).distinct().where(near)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable over the edges (a, b)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = checkpointed(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("root")
    )
    label = checkpointed(label)
    while True:
        # the smallest label next door, given to the node and to its root
        seen = both.join(label, both.v == label.node).groupBy("u").agg(F.min("root").alias("near"))
        offer = label.join(seen, label.node == seen.u, "left").select(
            "node", "root", F.least("root", F.coalesce("near", "root")).alias("low")
        )
        lifted = offer.select(F.col("node").alias("to"), "low").unionByName(
            offer.where("low < root").select(F.col("root").alias("to"), "low")
        )
        lowest = lifted.groupBy("to").agg(F.min("low").alias("low"))
        up = lowest.select(F.col("to").alias("via"), F.col("low").alias("top"))
        jumped = lowest.join(up, F.col("low") == F.col("via"), "left").select(
            F.col("to").alias("node"), F.least("low", F.coalesce("top", "low")).alias("root")
        )
        after = checkpointed(jumped)
        moved = after.join(label, "node").where(after.root != label.root).limit(1).count()
        label = after
        if not moved:
            return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs."""
    marked = checkpointed(fingerprints(docs, id_col, text_col))
    first = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = components(links(first.select("fp")))
    smallest = (
        groups.join(first, groups.node == first.fp)
        .groupBy("root")
        .agg(F.min("first").alias("least"))
        .join(groups, "root")
        .select("node", "least")
    )
    named = first.join(smallest, first.fp == smallest.node, "left").select(
        "fp", F.coalesce("least", "first").alias("component_id")
    )
    # read from a table, both sides are shuffled for this join alone, and Spark can split a fingerprint with many rows
    return marked.join(checkpointed(named), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: str | None, size: int = STAGE_SHINGLE) -> np.ndarray:
    """The distinct hashed shingles of a text, sorted; none of a text without words."""
    w = (text or "").encode().lower().split()
    shingles = zip(*(w[k:] for k in range(size)), strict=False) if len(w) > size else [w] if w else []
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(s), SEED) for s in shingles), dtype=np.uint64))


def margins(found: np.ndarray) -> np.ndarray:
    """For every bit of a set's fingerprint, the shingles that have it less those that do not: the bit is 1 above zero."""
    votes = np.zeros(_BITS + COMPARED, dtype=np.int64)
    for at in range(0, len(found), VOTES):
        bits = (found[at : at + VOTES, None] ^ _FLIP) * _TIMES
        bits = (bits ^ (bits >> np.uint64(32))) * _TIMES[::-1]
        bits ^= bits >> np.uint64(29)
        votes += np.unpackbits(bits.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return 2 * votes - len(found)


def balls(margin: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The keys (block, its bits) of each fingerprint, of sets of sizes above zero."""
    margin = margin[:, :_BITS].reshape(-1, BLOCKS, WIDTH)
    over = np.abs(margin) * (100 / np.sqrt(sizes))[:, None, None]
    over = np.minimum(over.astype(np.int64), len(_STAYS) - 1)
    weak = over.argpartition(WEAKEST - 1, axis=2)[:, :, :WEAKEST]
    turned = np.take_along_axis(_TURNS[over], weak, axis=2) @ _FLIPS.T.astype(np.float32)
    cost = (_STAYS[over].sum(axis=2)[:, :, None] + turned).reshape(-1, BLOCKS << WEAKEST)
    bits = (margin > 0) @ (1 << np.arange(WIDTH)) | np.arange(BLOCKS) << WIDTH
    keys = (bits[:, :, None] ^ (1 << weak) @ _FLIPS.T).astype(np.int32).reshape(-1, BLOCKS << WEAKEST)
    out = []
    for row, of_row, size in zip(cost, keys, sizes, strict=True):
        n = KEYS_OF_FEW if size < FEW else KEYS
        out.append(of_row[row.argpartition(n - 1)[:n]])
    return out


def alike_tree(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(place, place): links of similarity ALIKE or more that reach all that such links reach."""
    sizes = np.array([len(s) for s in sets])
    ends = sizes.cumsum()
    places = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], ends[:-1])
    known = np.zeros(int(ends[-1]), dtype=bool)
    steps: list[tuple[int, int]] = []
    left = np.arange(len(sets))
    while len(left):
        waiting, left = [int(left[0])], left[1:]
        flat = None
        while waiting and len(left):
            at = waiting.pop()
            if flat is None:
                flat = np.concatenate([places[k] for k in left])
                starts = np.concatenate([[0], sizes[left].cumsum()[:-1]])
            known[places[at]] = True
            shared = np.add.reduceat(known[flat], starts, dtype=np.int64)
            known[places[at]] = False
            near = shared / (sizes[left] + sizes[at] - shared) >= ALIKE
            if near.any():
                found, left, flat = left[near].tolist(), left[~near], None
                steps += [(at, f) for f in found]
                waiting += found
    return steps


def _walk_alike(rows: pd.DataFrame) -> pd.DataFrame:
    nodes = rows["node"].to_numpy().astype(np.int64)
    steps = np.array(alike_tree(rows["found"].tolist()), dtype=np.int64).reshape(-1, 2)
    ends = nodes[steps]
    return pd.DataFrame({"a": ends.min(axis=1), "b": ends.max(axis=1)})


def _walk_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links within each root's nodes, of rows (root, node, found) sorted by root; a group may lie in several batches."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        roots = batch["root"].to_numpy()
        if waiting and waiting[-1]["root"].iloc[-1] != roots[0]:
            yield _walk_alike(pd.concat(waiting))
            waiting = []
        cuts = [0, *(np.flatnonzero(roots[1:] != roots[:-1]) + 1).tolist()]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield _walk_alike(pd.concat([*waiting, batch.iloc[start:end]]))
            waiting = []
        waiting.append(batch.iloc[cuts[-1] :])
    if waiting:
        yield _walk_alike(pd.concat(waiting))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b), those whose sets have a similarity of ALIKE or more."""
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
        .where(shared / (F.size("x") + F.size("y") - shared) >= ALIKE)
        .select("a", "b")
    )


def _crowded_links(crowds: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within crowds (key, node, size). See the module's text for those of several blocks."""
    whole = Window.partitionBy("key")
    blocks = F.ceil(F.sum("size").over(whole) / BLOCK_SHINGLES).cast("int")
    dealt = crowds.withColumn("blocks", blocks).withColumn("hub", F.min("node").over(whole))
    dealt = checkpointed(dealt.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")))
    walk = lambda df, keys: df.join(sets, "node").groupBy(*keys).applyInPandas(_walk_alike, "a long, b long")
    inside = walk(dealt.select("key", "block", "node"), ["key", "block"])
    wide = dealt.where("blocks > 1")
    if not wide.limit(1).count():
        return inside
    stars = wide.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    known = checkpointed(inside.unionByName(_verified(stars, sets)).distinct())
    labelled = wide.join(components(known), "node", "left").withColumn("root", F.coalesce("root", "node"))
    parted = labelled.withColumn("apart", F.min("root").over(whole) != F.max("root").over(whole)).where("apart")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block"))
    both = parted.select("key", "node", "block", F.explode(others).alias("other")).select(
        "key", "node", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    return known.unionByName(walk(both, ["key", "low", "high"]))


def _near(a: Column, b: Column) -> Column:
    """Whether two prints (node, first, second, few) may belong to a link."""
    apart = F.bit_count(a["first"].bitwiseXOR(b["first"])) + F.bit_count(a["second"].bitwiseXOR(b["second"]))
    return apart <= F.when(a["few"] | b["few"], F.lit(STAGE_RADIUS)).otherwise(F.lit(FINE_RADIUS))


def _candidates(spread: DataFrame) -> DataFrame:
    """(a, b, near) of what meets in keys (key, node, first, second, few), a below b.

    Of keys that hold few, near pairs that connect all near pairs of the key: two nodes that are both near its least
    node, the hub, need no row of their own. Of crowded keys, the hub with every other node, near or not.
    """
    by_key = Window.partitionBy("key")
    met = spread.withColumn("n", F.count("*").over(by_key)).where("n > 1")
    met = met.select("key", "n", F.struct("node", "first", "second", "few").alias("p"))
    hub = F.col("g")[0]
    needed = lambda a, i, b: _near(a, b) & ((i == 0) | ~(_near(hub, a) & _near(hub, b)))
    later = lambda a, i: F.filter(F.slice("g", i + 2, F.size("g")), lambda b: needed(a, i, b))
    pair = lambda a, b: F.struct(a["node"].alias("a"), b["node"].alias("b"), _near(a, b).alias("near"))
    few = met.where(F.col("n") <= PAIRS_UP_TO).groupBy("key").agg(F.sort_array(F.collect_list("p")).alias("g"))
    few = few.select(
        F.explode(F.flatten(F.transform("g", lambda a, i: F.transform(later(a, i), lambda b: pair(a, b))))).alias("p")
    )
    many = met.where(F.col("n") > PAIRS_UP_TO).withColumn("hub", F.min("p").over(by_key))
    many = many.select(pair(F.col("hub"), F.col("p")).alias("p")).where("p.a != p.b")
    # one table of both, so that the keys are dealt once
    return few.unionByName(many).select("p.*").distinct()


def _thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b), a below b, with the same components: each b and its other neighbours below go to the least of these."""
    below = edges.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("g"))
    ends = F.concat(F.slice("g", 2, F.size("g")), F.array("b"))
    return below.select(F.col("g")[0].alias("a"), F.explode(ends).alias("b")).distinct()


def _near_tree(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a crowd, near pairs that reach all that such pairs reach."""
    first, second, nodes = (rows[c].to_numpy().astype(np.int64) for c in ("first", "second", "node"))
    few = rows["few"].to_numpy().astype(bool)
    ends, left = [], np.arange(len(nodes))
    while len(left):
        waiting, left = [int(left[0])], left[1:]
        while waiting and len(left):
            at = waiting.pop()
            apart = np.bitwise_count(first[left] ^ first[at]) + np.bitwise_count(second[left] ^ second[at])
            near = apart <= np.where(few[left] | few[at], STAGE_RADIUS, FINE_RADIUS)
            found, left = left[near].tolist(), left[~near]
            ends += [(nodes[at], nodes[f]) for f in found]
            waiting += found
    ends = np.array(ends, dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": ends.min(axis=1), "b": ends.max(axis=1)})


def _groups(met: DataFrame, prints: DataFrame) -> DataFrame:
    """(node, root): the components of the near pairs of met, _candidates' rows. No link between these leaves a group."""
    edges = _thinned(met.where("near").select("a", "b"))
    labels = components(edges)
    # a crowd is settled where its nodes that are far from the hub are in the hub's group
    of = lambda node: labels.select(F.col("node").alias(node), F.col("root").alias(f"of_{node}"))
    far = met.where("not near").join(of("a"), "a", "left").join(of("b"), "b", "left")
    hubs = checkpointed(far.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a").distinct())
    if not hubs.limit(1).count():
        return labels
    crowds = _crowds(met.join(hubs, "a", "left_semi")).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    small = crowds.where(F.col("n") <= COMPARE_UP_TO).join(prints, "node")
    large = crowds.where((F.col("n") > COMPARE_UP_TO) & (F.col("key") != F.col("node")))
    more = small.groupBy("key").applyInPandas(_near_tree, "a long, b long")
    more = more.unionByName(large.select(F.col("key").alias("a"), F.col("node").alias("b")))
    return components(checkpointed(_thinned(edges.unionByName(more))))


def _crowds(met: DataFrame) -> DataFrame:
    """(key, node): each hub with itself and all that it meets."""
    return met.select(F.col("a").alias("key"), F.explode(F.array("a", "b")).alias("node")).distinct()


def alike_links(first: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs of similarity ALIKE or more.

    first, a checkpoint that is deleted: node, row (id and text hash t of one of its documents), size (of its set), the
    compared bits (first, second) and keys; rows: doc_id, text.
    """

    @F.pandas_udf("array<long>")
    def sets_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in in_parts(batches):
            yield pd.Series([shingle_set(t).view(np.int64) for t in texts])

    few = (F.col("size") < FEW).alias("few")
    rest = checkpointed(first.drop("keys"))
    # the compared bits go with the keys, so that unlike nodes of a key never become rows of a join
    met = checkpointed(_candidates(first.select(F.explode("keys").alias("key"), "node", "first", "second", few)))
    released(first)
    groups = _groups(met, rest.select("node", "first", "second", few))
    whole = Window.partitionBy("root")
    groups = groups.join(rest.select("node", "row", "size"), "node").withColumn("n", F.count("*").over(whole))
    small = (F.col("n") <= COMPARE_UP_TO) & (F.sum("size").over(whole) <= BLOCK_SHINGLES)
    groups = checkpointed(groups.withColumn("small", small).drop("n"))

    # only texts of groups give their sets
    wanted = groups.select("node", "root", "small", "row")
    named = rows.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("row"), "text")
    texts = named.join(wanted, named["row"].eqNullSafe(wanted["row"]))
    texts = texts.select("node", "root", "small", sets_of("text").alias("found"))
    sets = checkpointed(texts.groupBy("node", "root", "small").agg(F.first("found").alias("found")))
    dealt = sets.where("small").select("root", "node", "found").repartition("root").sortWithinPartitions("root")
    known = checkpointed(dealt.mapInPandas(_walk_groups, "a long, b long"))

    # of larger groups, what meets in keys of one hub is walked
    large = groups.where("not small").select("node", "size")
    if not large.limit(1).count():
        return known
    by_key = Window.partitionBy("key")
    sets = sets.where("not small").select("node", "found")
    crowds = _crowds(met.join(large.select(F.col("node").alias("a")), "a", "left_semi"))
    crowds = checkpointed(crowds.join(large, "node"))
    for share in TURNS:
        labelled = crowds.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).join(components(known), "node", "left")
        labelled = labelled.withColumn("root", F.coalesce("root", "node"))
        apart = labelled.withColumn("apart", F.min("root").over(by_key) != F.max("root").over(by_key)).where("apart")
        apart = checkpointed(apart.select("key", "node", "size"))
        if apart.limit(1).count():
            known = checkpointed(known.unionByName(_crowded_links(apart, sets)).distinct())
    return known


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t): of every group of near copies the row with the smallest id, by the hash t of its text."""

    @F.pandas_udf("node long, size long, first long, second long, keys array<int>")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for texts in in_parts(batches):
            found = [shingle_set(t) for t in texts]
            sizes = np.array([len(f) for f in found])
            nodes = np.array([xxh64_intdigest(f.tobytes(), SEED) for f in found], dtype=np.uint64).view(np.int64)
            # copies that a task meets again need no keys
            seen = seen if len(seen) < SEEN else set()
            fresh = []
            for k, node in enumerate(nodes.tolist()):
                if sizes[k] and node not in seen:
                    fresh.append(k)
                    seen.add(node)
            keys: list[np.ndarray | None] = [None] * len(found)
            compared = np.zeros((len(found), COMPARED // 64), dtype=np.int64)
            if fresh:
                margin = np.array([margins(found[k]) for k in fresh])
                compared[fresh] = np.packbits(margin[:, _BITS:] > 0, axis=1).view(np.int64)
                for k, of_text in zip(fresh, balls(margin, sizes[fresh]), strict=True):
                    keys[k] = of_text
            yield pd.DataFrame(
                {"node": nodes, "size": sizes, "first": compared[:, 0], "second": compared[:, 1], "keys": keys}
            )

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    marked = rows.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("row"), sketched("text").alias("s"))
    marked = marked.select("row", "s.*", F.col("s.keys").isNull().alias("again"))
    # as many partitions as there are, since a row's keys are hundreds; one shuffle for both
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = marked.repartition(parts, "node").groupBy("node").agg(
        F.min("row").alias("row"), F.min_by(F.struct("size", "first", "second", "keys"), "again").alias("s")
    )
    # nodes are numbered, which their many rows take less room for
    first = checkpointed(sets.select(F.monotonically_increasing_id().alias("node"), "row", "s.*"))
    named = checkpointed(first.select("node", "row"))
    groups = components(alike_links(first, rows))
    named = named.join(groups, "node", "left")
    return named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row")).select("row.*")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every group of near copies the row of docs with the smallest id; one of equal rows.

    Rows are told apart by id and text: of several texts with one id each is judged by itself. A row without
    an id cannot be told from its copies by it and stays.
    """
    named = docs.where(docs[id_col].isNotNull())
    kept = representatives(named, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("t").alias("__kept"))
    rows = named.withColumn("__t", F.xxhash64(named[text_col]))
    same = (rows[id_col] == F.col("__id")) & (rows["__t"] == F.col("__kept"))
    rows = rows.join(kept, same, "left_semi").dropDuplicates([id_col, "__t"]).drop("__t")
    return rows.unionByName(docs.where(docs[id_col].isNull()))
