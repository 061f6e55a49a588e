"""URL filters: a broadcast trie over reversed host labels, then path segments.

Rules form one trie: the labels of the rule's host from the right, then the
whole segments of its path, then the rest of its last segment, which is a prefix. A
url is walked once and the longest rule that fits decides, allow or block. A
node keeps the prefixes that end below it in a dictionary, with their lengths
apart, so that a lookup costs as many steps as there are lengths, whatever the
number of rules. The rules are a parameter of bounded size (MAX_RULES), which is
what is broadcast.

Defined results: a url that is null or has no :// has an empty host and path
and no rule; a url that no rule fits gets the default verdict; of two rules for
one host and path, the later one counts, of two of one length the one with more
of the host; a url of any length is walked whole; repeated rows give repeated rows
and an empty table none; only the id and the url are read, whatever other columns
are named.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import lower_ascii

#: The rules of the query, as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DEFAULT = "allow"
MAX_RULES = 1_000_000


class Node:
    """hosts and paths: the children by label and by segment; ends: prefix -> (rule, verdict); lengths: of the prefixes."""

    __slots__ = ("hosts", "paths", "ends", "lengths")

    def __init__(self) -> None:
        self.hosts: dict[str, Node] = {}
        self.paths: dict[str, Node] = {}
        self.ends: dict[str, tuple[str, str]] = {}
        self.lengths: set[int] = set()


def build_trie(rules: Iterable[tuple[str, str]]) -> Node:
    top = Node()
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a verdict is allow or block, not {verdict!r}")
        host, slash, path = rule.partition("/")
        node = top
        for label in reversed(host.lower().split(".")):
            node = node.hosts.setdefault(label, Node())
        prefix = ""
        if slash:
            *whole, prefix = path.split("/")
            for segment in ["", *whole]:
                node = node.paths.setdefault(segment, Node())
        node.ends[prefix] = (rule, verdict)
        node.lengths.add(len(prefix))
    return top


def longest(trie: Node, host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict."""
    best: tuple[str | None, str | None] = (None, None)
    size = -1
    segments = path.split("/")
    node: Node | None = trie
    for label in reversed(host.split(".")):
        node = node.hosts.get(label)
        if node is None:
            break
        below = node
        for depth, segment in enumerate(segments):
            for n in below.lengths:
                found = below.ends.get(segment[:n]) if n <= len(segment) else None
                if found and len(found[0]) >= size:
                    best, size = found, len(found[0])
            if depth + 1 == len(segments) or segment not in below.paths:
                break
            below = below.paths[segment]
    return best


def url_filter(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    default: str = DEFAULT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the broadcast trie takes {MAX_RULES} at most")
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        top = trie.value
        for hosts, paths in parts:
            found = [longest(top, h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    whole = pages.select(pages[id_col].alias("page_id"), F.coalesce(pages[url_col], F.lit("")).alias("url"))
    after = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    cut = whole.select("page_id", after.alias("rest"))
    split = cut.select(
        "page_id",
        lower_ascii(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    judged = split.withColumn("found", judge("host", "path"))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.lit(default)).alias("verdict"),
    )
