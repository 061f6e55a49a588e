"""Benchmark decontamination: pigeonhole edit matching.

An item may occur in a document with up to k edits, k = one per EDIT_EVERY
characters. Cut into k + 1 pieces, at least one piece occurs unchanged, so an
Aho-Corasick scan for all pieces finds every candidate place, and Myers'
bit-parallel distance verifies the stretch around it. Both sides are compared
in a normal form: lower case, with one space for ASCII punctuation and spaces.

Items with fewer than EDIT_EVERY characters have no budget, and occur where whole
words do: a part of a word is no hit.

The benchmark passes through the driver a slice at a time, of SLICE_CHARS
characters or one item, and each slice is broadcast for a pass of its own over the
documents, so that a task holds one automaton of bounded size whatever the
benchmark's. Of more than one slice each pass is done, its hits written, and its
broadcast destroyed before the next begins. Places are verified as the scan meets
them; nothing is gathered for a document but its best distance for each item.

Defined results: null and empty texts match nothing, as do items without letters
or digits; of several places of an item in a document the nearest counts;
documents of any length are scanned whole; repeated items or documents give
repeated rows of a pair; empty tables give none; only ids and texts are read,
whatever other columns are named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import checkpointed, in_parts

EDIT_EVERY = 20
#: Items from here on have a budget.
MIN_CHARS = EDIT_EVERY
SLICE_CHARS = 4_000_000

#: ASCII characters other than letters and digits become spaces.
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normal(text: str | None) -> str:
    """Lower case, with one space for every run of ASCII characters that are no letters or digits."""
    return b" ".join((text or "").lower().encode().translate(_SPACED).split()).decode()


def budget(n_chars: int) -> int:
    return n_chars // EDIT_EVERY


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of even length that make up the item."""
    n = budget(len(item)) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def peq(pattern: str) -> dict[str, int]:
    """For each character, the bit mask of its places in the pattern."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any substring of text, and where that ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """The automaton of all pieces of some items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(i, t, peq(t), budget(len(t))) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(items):
            for offset, piece in pieces(text):
                places.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, int]:
        """The least distance of every item that occurs within its budget."""
        found: dict[int, int] = {}
        seen: dict[int, int] = {}
        for last, (length, at) in self.automaton.iter(text):
            for n, offset in at:
                _, item, masks, k = self.items[n]
                start = last + 1 - length - offset
                if found.get(n) == 0 or seen.get(n) == start:
                    continue
                if length < MIN_CHARS and len(item) == length:  # a short item, whole
                    if text[start - 1 : start] in ("", " ") and text[last + 1 : last + 2] in ("", " "):
                        found[n] = 0
                    continue
                seen[n] = start
                if text.startswith(item, max(start, 0)):
                    found[n] = 0
                    continue
                stretch = text[max(start - k, 0) : start + len(item) + k]
                distance, _ = myers(masks, len(item), stretch)
                if distance <= k:
                    found[n] = min(distance, found.get(n, distance))
        return found


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in normal form, a bounded number of characters at a time."""
    part: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.select(benchmark[id_col].alias("item_id"), benchmark[text_col].alias("text"))
    for row in rows.toLocalIterator():
        item = normal(row["text"])
        if not item:
            continue
        if part and size + len(item) > SLICE_CHARS:
            yield part
            part, size = [], 0
        part.append((row["item_id"], item))
        size += len(item)
    if part:
        yield part


KIND = "array<struct<item_id:long,distance:int>>"


def _search(sent: Broadcast):
    @F.pandas_udf(KIND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value)
        for texts in in_parts(batches):
            got = [sorted(matcher.matches(normal(t)).items()) for t in texts]
            rows = [[{"item_id": matcher.items[n][0], "distance": d} for n, d in g] for g in got]
            yield pd.Series(rows, dtype=object)

    # so declared, it is evaluated once, and not again for what a filter asks of it
    return search.asNondeterministic()


def _passes(texts: DataFrame, benchmark: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """keep(texts with hits, an array of (item_id, distance)) for the slices together; None without items.

    A single slice is left to the caller's job. With more, each is searched by a job of its own.
    """
    slices = _slices(benchmark, "item_id", "text")
    first, second = next(slices, None), next(slices, None)
    if first is None:
        return None
    context = texts.sparkSession.sparkContext
    if second is None:
        return keep(texts.withColumn("hits", _search(context.broadcast(first))("text")))
    parts = []
    for items in chain((first, second), slices):
        sent = context.broadcast(items)
        parts.append(checkpointed(keep(texts.withColumn("hits", _search(sent)("text")))))
        sent.destroy()
    return reduce(DataFrame.union, parts)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance: the benchmark items that documents hold, within the edit budget."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def hits(found: DataFrame) -> DataFrame:
        return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.distance")

    found = _passes(rows, benchmark, hits)
    return found if found is not None else hits(rows.limit(0).withColumn("hits", F.lit(None).cast(KIND)))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with docs' columns.

    One slice is a filter. With more, the texts that hold an item are found slice by slice, as two hashes, and
    their rows left out by a join.
    """
    slices = _slices(benchmark, "item_id", "text")
    first, second = next(slices, None), next(slices, None)
    if first is None:
        return docs
    if second is None:
        return docs.where(F.size(_search(docs.sparkSession.sparkContext.broadcast(first))(docs[text_col])) == 0)
    hashes = lambda text: [h.alias(f"__h{k}") for k, h in enumerate((F.xxhash64(text), F.xxhash64(text, F.lit(1))))]
    held = lambda found: found.where(F.size("hits") > 0).select(*hashes(F.col("text"))).distinct()
    bad = _passes(docs.select(docs[text_col].alias("text")), benchmark, held).distinct()
    same = [F.col(f"__h{k}") == h for k, h in enumerate((F.xxhash64(docs[text_col]), F.xxhash64(docs[text_col], F.lit(1))))]
    return docs.join(bad, same, "left_anti")
