"""Prefix tree of rebuilt conversations: shared beginnings once, with what sharing them saves.

A conversation's prefix of d turns has a digest: the XOR of the hashes of its turns, each hashed with its place. The
least conversation of each digest owns that node. Who owns a prefix owns all longer ones of itself, so the first depth
that a conversation owns is found by binary search: in each round all conversations look one digest up by a join with
the digests' minima. From there on a conversation owns a chain of nodes down to its end. Each chain hangs on one node
of another; totals go up from chain to chain by doubling: after round r a chain has what lies below it by less than 2^r
chains, and its pointer is 2^r chains further up.

Rounds of the search grow with the logarithm of the longest conversation, those of the totals with that of the number
of chains above one another. Turns are numbered by one range sort of the table, and running values are made within
(conversation, CHUNK turns) and carried over, so that a conversation with a third of all turns is dealt to many tasks.
Texts are hashed where they are read and never shuffled. The ids of the conversations that end in a node are joined
within ranges of ENDS ids first, and then hashed in order as a stream of constant memory: SHA-256 knows no other way.

Defined results: null role or text is empty, turns without a number come first, turns of one number are in the order of
the SHA-256 of "<bytes of role>:<role><text>". Turns without conv_id take no part. Repeated rows are turns of their own. An
empty table gives no nodes, not even a root. Columns other than the four named are never read. Two prefixes are
told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import checkpointed, released

#: Every conversation takes its first turns from the one at the lower multiple of GROUP: crc32(id) modulo SHARED of them.
GROUP, SHARED = 5, 9

#: Turns whose running values are made in one task; the ids that are joined in one task.
CHUNK, ENDS = 1_024, 4_096


def prefix_tree(conversations: DataFrame) -> DataFrame:
    """One row a node, with its parent, members, children, leaves, saving and the digest of those that end there."""
    prefixes = checkpointed(prefix_digests(rebuilt(numbered(conversations))))
    digest = ["depth", "d1", "d2"]
    minima = checkpointed(
        prefixes.groupBy(*digest).agg(
            F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes")
        )
    )
    owned = first_owned(prefixes.select("conv_id", "size", *digest), minima.select(*digest, "owner"))
    chains = owned.where(F.col("top") <= F.col("size"))
    nodes = minima.select("owner", "depth", "n_convs", F.col("n_bytes") * (F.col("n_convs") - 1))
    return _assembled(nodes.toDF("owner", "depth", "n_convs", "own_saved"), chains, _ends(owned))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), h and n_bytes of every turn; h tells (role, text) apart."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("h"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    in_order = checkpointed(turns.orderBy("conv_id", F.asc_nulls_first("turn"), "h"))
    here = F.monotonically_increasing_id()  # rises along the sorted partitions, by one within each
    parts = in_order.withColumns({"part": F.shiftright(here, 33), "place": here.bitwiseAND(F.lit(2**33 - 1))})
    runs = parts.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.select(
        "conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift")
    )
    return parts.join(shift, ["conv_id", "part"]).select(
        "conv_id", (F.col("place") + F.col("shift")).alias("pos"), "h", "n_bytes"
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, size, depth, h and n_bytes of every turn of the rebuilt conversations, and the root's row of each."""
    turns = checkpointed(turns)
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    giver = F.col("conv_id") - F.col("conv_id") % GROUP
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    given = convs.select(F.col("conv_id").alias("giver"), F.col("n").alias("there"))
    convs = convs.withColumns({"giver": giver, "taken": taken}).join(given, "giver", "left")
    convs = convs.withColumn("given", F.least("taken", F.coalesce("there", F.lit(0))))
    size = F.col("given") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))
    convs = checkpointed(convs.select("conv_id", "giver", "taken", "given", size.alias("size")))
    lent = (
        convs.where(F.col("given") > 0)
        .withColumn("pos", F.explode(F.sequence(F.lit(1).cast("long"), F.col("given"))))
        .join(turns.where(F.col("pos") < SHARED).withColumnRenamed("conv_id", "giver"), ["giver", "pos"])
        .select("conv_id", "size", F.col("pos").alias("depth"), "h", "n_bytes")
    )
    own = (
        turns.join(convs, "conv_id")
        .where(F.col("pos") > F.col("taken"))
        .select("conv_id", "size", (F.col("pos") - F.col("taken") + F.col("given")).alias("depth"), "h", "n_bytes")
    )
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", "size", zero.alias("depth"), F.lit("").alias("h"), zero.alias("n_bytes"))
    return roots.unionByName(lent).unionByName(own)


def prefix_digests(turns: DataFrame) -> DataFrame:
    """conv_id, size, depth, n_bytes and the digest (d1, d2) of every prefix."""
    keyed = F.sha2(F.concat_ws(":", "depth", "h").cast("binary"), 256)
    half = lambda k: F.conv(F.substring(keyed, k, 16), 16, -10).cast("long")
    parts = turns.select("conv_id", "size", "depth", "n_bytes", half(1).alias("d1"), half(17).alias("d2"))
    return running(parts, F.bit_xor, lambda old, new: old.bitwiseXOR(new), ("d1", "d2"))


def running(rows: DataFrame, fold, joined, names: tuple[str, ...], down: bool = False) -> DataFrame:
    """The named columns folded over each conversation's rows up to its own by depth (down: from its own on).

    rows: conv_id, size and depth besides. Folds run within CHUNK depths; only conversations longer than that have
    anything carried over from other chunks, a row for each chunk.
    """
    along = F.desc if down else F.asc
    rows = rows.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    inside = Window.partitionBy("conv_id", "chunk").orderBy(along("depth"))
    folded = rows.withColumns({c: fold(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for c in names})
    earlier = Window.partitionBy("conv_id").orderBy(along("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    long = rows.where(F.col("size") >= CHUNK).groupBy("conv_id", "chunk").agg(*[fold(c).alias(c) for c in names])
    carried = long.select("conv_id", "chunk", *[fold(c).over(earlier).alias(f"{c}_before") for c in names])
    both = folded.join(carried, ["conv_id", "chunk"], "left")
    full = {c: F.when(F.col(f"{c}_before").isNull(), F.col(c)).otherwise(joined(F.col(c), F.col(f"{c}_before"))) for c in names}
    return both.withColumns(full).drop("chunk", *[f"{c}_before" for c in names])


def first_owned(prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """conv_id, size, top (first owned depth; size + 1: none) and above (who owns the prefix before top)."""
    nothing = F.lit(None).cast("long")
    ends = prefixes.groupBy("conv_id").agg(F.max("size").alias("size"))
    state = ends.select(
        "conv_id", "size", F.lit(-1).cast("long").alias("low"), (F.col("size") + 1).alias("top"), nothing.alias("above")
    )
    longest = ends.agg(F.max("size")).first()[0] or 0
    before = None
    for _ in range((longest + 1).bit_length()):  # low isn't owned, top is
        state = state.withColumn("depth", F.floor((F.col("low") + F.col("top")) / 2))
        asked = state.where(F.col("depth") > F.col("low")).select("conv_id", "depth")
        answers = asked.join(prefixes.drop("size"), ["conv_id", "depth"]).join(minima, ["depth", "d1", "d2"])
        state = state.join(answers.select("conv_id", "owner"), "conv_id", "left")
        mine, others = F.col("owner") == F.col("conv_id"), F.col("owner") != F.col("conv_id")
        state = checkpointed(
            state.select(
                "conv_id",
                "size",
                F.when(others, F.col("depth")).otherwise(F.col("low")).alias("low"),
                F.when(mine, F.col("depth")).otherwise(F.col("top")).alias("top"),
                F.when(others, F.col("owner")).otherwise(F.col("above")).alias("above"),
            )
        )
        if before is not None:
            released(before)
        before = state
    return state.select("conv_id", "size", "top", "above")


def _ends(owned: DataFrame) -> DataFrame:
    """owner, depth and ends_sha256 of the nodes in which conversations end."""
    owner = F.when(F.col("top") <= F.col("size"), F.col("conv_id")).otherwise(F.col("above"))
    ended = owned.select(owner.alias("owner"), F.col("size").alias("depth"), "conv_id")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ended.groupBy("owner", "depth", F.floor(F.col("conv_id") / ENDS).alias("piece")).agg(joined.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for b in batches for line in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        done: list[tuple] = []
        for (owner, depth), own in groupby(lines, key=lambda x: x[:2]):
            state = hashlib.sha256()
            for k, (_, _, ids) in enumerate(own):
                state.update((b"," if k else b"") + ids.encode())
            done.append((owner, depth, state.hexdigest()))
            if len(done) == 10_000:
                yield _batch(done)
                done = []
        yield _batch(done)

    lines = pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "piece")
    return lines.select("owner", "depth", "ids").mapInArrow(hashed, "owner long, depth long, ends_sha256 string")


def _batch(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    columns = [pa.array([x[k] for x in done], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, ["owner", "depth", "ends_sha256"])


def _assembled(nodes: DataFrame, chains: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes with the totals of the chains below them."""
    chains = checkpointed(chains)
    at_end = chains.select(F.col("above").alias("conv_id"), (F.col("top") - 1).alias("size")).distinct()
    leaf = chains.join(at_end, ["conv_id", "size"], "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    saved = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("own_saved").alias("saved"))
    own = chains.join(saved, "conv_id").join(leaf, "conv_id", "left").fillna(0, ["leaf"])
    own = checkpointed(own.select("conv_id", "size", "top", "above", "leaf", F.col("saved").cast("long").alias("saved")))
    whole = with_descendants(own.select("conv_id", F.col("above").alias("up"), "leaf", "saved"))
    hung = (
        own.select("conv_id", F.col("above").alias("owner"), (F.col("top") - 1).alias("depth"))
        .where("owner IS NOT NULL")
        .join(whole, "conv_id")
        .groupBy("owner", "depth")
        .agg(F.count(F.lit(1)).alias("hung"), F.sum("leaf").alias("hung_leaf"), F.sum("saved").alias("hung_saved"))
    )
    owner = own.select(F.col("conv_id").alias("owner"), "size", "top", "above", "leaf")
    lines = nodes.join(owner, "owner").join(hung, ["owner", "depth"], "left").fillna(0, ["hung", "hung_leaf", "hung_saved"])
    last = F.col("depth") == F.col("size")
    values = lines.select(
        F.col("owner").alias("conv_id"),
        "depth",
        "size",
        F.when(F.col("depth") == F.col("top"), F.col("above")).otherwise(F.col("owner")).alias("parent_conv_id"),
        "n_convs",
        (F.col("hung") + F.when(last, 0).otherwise(1)).alias("n_children"),
        (F.col("hung_leaf") + F.when(last, F.col("leaf")).otherwise(0)).alias("n_leaves"),
        (F.col("hung_saved") + F.col("own_saved")).alias("saved_tokens"),
    )
    summed = running(values, F.sum, lambda a, b: a + b, ("n_leaves", "saved_tokens"), down=True)
    ends = ends.withColumnRenamed("owner", "conv_id")
    return summed.join(ends, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        *[F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def with_descendants(chains: DataFrame) -> DataFrame:
    """conv_id, leaf and saved of every chain with all chains below it; up names the chain that it hangs on."""
    first = True
    while True:
        below = chains.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"))
        below = below.agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
        next_up = chains.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        higher = checkpointed(
            chains.join(below, "conv_id", "left")
            .join(next_up, "up", "left")
            .select("conv_id", F.col("next").alias("up"), _plus("leaf"), _plus("saved"))
        )
        if not first:
            released(chains)
        chains, first = higher, False
        if chains.where("up IS NOT NULL").isEmpty():
            return chains.select("conv_id", "leaf", "saved")


def _plus(name: str) -> Column:
    return (F.col(name) + F.coalesce(F.col(f"more_{name}"), F.lit(0))).cast("long").alias(name)
