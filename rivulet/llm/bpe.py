"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last 16 bytes says so, so that texts
which share a passage share its chunks. A chunk is encoded once and kept in a
bounded cache. A cut may fall inside what the tokenizer would not split; so the
stretch around it, out to the next places where the tokenizer always splits, is
encoded again. If the chunks' own tokens do not end exactly at these places the
stretch grows until they agree, at worst to the whole text.

The tokenizer splits before a single space between two printable ASCII
characters, whatever stands around them: these are the safe places.

Vocabulary and special tokens are read from a byte-level tokenizer.json, whose
path is a parameter; the merges run in tiktoken, which takes the same ranks.

Defined results: a null text counts as empty and has no tokens; a special
token's string is its one id; a text of any length is encoded whole; repeated rows
give repeated rows and an empty table none; only the id and the text are read,
whatever other columns are named.
"""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import in_parts

#: Fixed value: the pattern by which byte-level BPE splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WINDOW = 16
CUT_BITS = 11
MIN_CHUNK = 1024
CACHE_BYTES = 48_000_000

_GEAR = np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items()}
        for k, pair in enumerate(model["merges"]):
            joined = "".join(pair) if isinstance(pair, list) else pair.replace(" ", "")
            if model["vocab"].get(joined) != 256 + k:
                raise ValueError("the vocabulary's ids are not in the order of its merges")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for token, i in ranks.items():
            self.bytes[i] = token
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.cached = 0

    def plain(self, text: bytes) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text.decode()), dtype=np.uint32)

    def chunk(self, text: bytes) -> np.ndarray:
        """The ids of a chunk by itself, from the cache if it was met before."""
        if (ids := self.cache.get(text)) is not None:
            self.cache.move_to_end(text)
            return ids
        ids = self.plain(text)
        self.cache[text] = ids
        self.cached += len(text) + ids.nbytes + 200
        while self.cached > CACHE_BYTES:
            old, gone = self.cache.popitem(last=False)
            self.cached -= len(old) + gone.nbytes + 200
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        parts = []
        for part in self.splitter.split(text or "") if self.splitter else [text or ""]:
            if part in self.special:
                parts.append(np.array([self.special[part]], dtype=np.uint32))
            elif part:
                parts.append(self.segment(part.encode()))
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)

    def segment(self, data: bytes) -> np.ndarray:
        """The ids of a text without special tokens."""
        view = np.frombuffer(data, dtype=np.uint8)
        cuts = [0, *cut_points(view), len(data)]
        if len(cuts) == 2:
            return self.chunk(data)
        safe = safe_places(view)
        out: list[np.ndarray] = []
        sure = 0  # all before is encoded
        for start, end in zip(cuts, cuts[1:], strict=False):
            low, high = safe.searchsorted(start), safe.searchsorted(end, side="right")
            begin = 0 if start == 0 else int(safe[low]) if low < len(safe) else len(data)
            stop = end if end == len(data) else int(safe[high - 1]) if high else 0
            if begin >= stop or begin < sure:
                continue  # too short to hold two safe places: the next stretch covers it
            ids = self.chunk(data[start:end])
            ends = self.lengths[ids].cumsum()  # of its tokens, from its start
            a, b = ends.searchsorted(begin - start, side="right"), ends.searchsorted(stop - start)
            if begin > start and (a == 0 or ends[a - 1] != begin - start) or ends[b] != stop - start:
                continue  # no agreement there: the next stretch covers it
            if begin > sure:
                out.append(self.plain(data[sure:begin]))
            out.append(ids[a : b + 1])
            sure = stop
        if sure < len(data):
            out.append(self.plain(data[sure:]))
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def cut_points(view: np.ndarray) -> list[int]:
    """Ends of chunks: where the rolling hash of the last WINDOW bytes has CUT_BITS zeros."""
    if len(view) <= 2 * MIN_CHUNK:
        return []
    h, span = _GEAR[view], 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint64(span)
        span *= 2
    hit = np.nonzero((h >> np.uint64(64 - CUT_BITS)) == 0)[0] + 1
    cuts, last = [], 0
    for at in hit.tolist():
        if at - last >= MIN_CHUNK and len(view) - at >= MIN_CHUNK and view[at] & 0xC0 != 0x80:
            cuts.append(at)
            last = at
    return cuts


def safe_places(view: np.ndarray) -> np.ndarray:
    """Places of single spaces between printable ASCII characters: a token always begins there."""
    printable = (view > 0x20) & (view < 0x7F)
    return np.nonzero((view[1:-1] == 0x20) & printable[:-2] & printable[2:])[0] + 1


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def coded(text: Column, path: str) -> Column:
    """struct of ids (little-endian unsigned 32-bit integers) and decoded (their text)."""

    @F.pandas_udf("ids binary, decoded string")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        for texts in in_parts(batches):
            ids = [words.encode(t) for t in texts]
            yield pd.DataFrame(
                {"ids": [i.astype("<u4").tobytes() for i in ids], "decoded": [words.decode(i) for i in ids]}
            )

    return code(text)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary), decoded and n_tokens for every row of docs."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.select("doc_id", coded(F.col("text"), path).alias("c")).select(
        "doc_id", "c.ids", "c.decoded", (F.octet_length("c.ids") / 4).cast("long").alias("n_tokens")
    )
