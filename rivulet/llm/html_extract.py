"""HTML extraction by tag-path ratios.

A page is cut into blocks. The blocks with one root-to-leaf tag path (with the
elements' classes) share what their path collects: characters outside links and
punctuation, both over the square root of its blocks, so that neither one long
notice nor many short entries pass for an article. The two ratios are smoothed
over neighbours below one element and fused by multiplication. Paths above SHARE
of the page's highest value are the content paths, and the innermost element that
holds all their blocks is the content region: the article or main around it, if
there is one.

Elements that are marked, by tag or class, as no part of an article have no
content paths, nor has a header above all articles; a page of nothing else has no
text, but for an article or main inside marked elements. A form that holds most of
a page's text is its frame and not marked. Marks on the region's own ancestors
count for nothing.

Within the region every block is content, however short, but for marked ones and
what the ratios of its path tell: paths whose text is links by LINKED or more are
menus, and trailing rows of two or more alike elements that begin with a short
line and a date are readers' comments. A heading below which all is dropped goes
with it. Where only the page itself holds all content paths, their blocks are
content, with the plain blocks between them and the headings before them. Kept
blocks are returned whole, in page order.

A page is read in one pass, in time linear in its length: script, style and the
like end at their own end tag alone, quotes that never end are plain characters,
and elements nested deeper than MAX_DEPTH count as their ancestor at that depth.

Defined results: a null or empty page, or one without content, has an empty
text; unclosed or crossed elements and a page cut off inside a tag are read as
far as they go; a page of any length is read whole; of paths with one value all
count; repeated rows give repeated rows, an empty table none; only the id, the url
and the html are read, whatever else the table's columns are named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import in_parts

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
SKIPPED = frozenset("noscript template svg math object canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN = HEADINGS | frozenset("p ul ol li dl dt dd table thead tbody tr td th caption pre blockquote figure figcaption".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button select fieldset head".split())
INSIDE = frozenset("article main".split())
#: Words in a class or an id that mark what is not the article, and words that may stand beside them.
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer footer masthead menu modal nav navbar navigation newsletter notice overlay "
    "pager pagination popup promo promoted recommended related replies respond share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar widget "
    "commentary commentlist discussion disqus feedback guestbook messages msg responses reviews thread".split()
)
BESIDE_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons container content customer entry form global group "
    "header inner item items left links list main page panel post posts reader readers right section site slot text top "
    "user users wrap wrapper".split()
)
#: What tells that a short line is the head of a comment.
_DATED = re.compile(
    r"(?i)\b\d{1,2}[:.]\d{2}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\bago\b|\byesterday\b|\bsays?\b|\bwrote\b"
    r"|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d{1,2}\b|\b\d{1,2}\.? (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
)
#: An element closed by the start of one of these, as in the HTML standard.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
_LISTS = frozenset(["ul", "ol", "dl", "table", "select"])
_HOLDERS = frozenset(["td", "th", "li", "dd", "div", "article", "section", "main", "blockquote"])
_P = frozenset(["p"])
_NONE: frozenset[str] = frozenset()

#: The weight of paths inside INSIDE; the share of the highest value that makes a content path.
INSIDE_WEIGHT = 3.0
SHARE = 0.3
#: The share of a path's text in links that makes it a menu; the share of a page's text that makes a form its frame.
LINKED, FRAME = 0.7, 0.5
#: Characters of a comment's first line, at most.
HEAD_CHARS = 60
#: The share of the content paths' text that makes one container of a page the content region.
MOST = 0.9
#: Weights of a block's neighbours and itself.
SMOOTH = (0.25, 0.5, 0.25)
#: Elements that are open at once.
MAX_DEPTH = 512

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_UNQUOTED = re.compile(r"[^\"'>]*")
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_ROWS = frozenset(["div", "section", "article", "li"])
_COMMENT_END = re.compile(r"--!?>")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")


def tags(html: str) -> Iterator[tuple[str, str, str]]:
    """(text before it, name, attributes) for each tag; names of end tags begin with /. The last has no name."""
    at, begun, quotes, endless = 0, 0, True, set()
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            yield html[begun:at], "", ""
            if html.startswith(("<!-->", "<!--->"), at):
                at = begun = html.index(">", at) + 1
                continue
            end = _COMMENT_END.search(html, at + 4)
            at = begun = end.end() if end else len(html)
            continue
        if html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at)
            yield html[begun:at], "", ""
            at = begun = len(html) if end < 0 else end + 1
            continue
        m = _NAME.match(html, at + 1)
        if m is None:
            at += 1
            continue
        end = m.end()
        while quotes:
            end = _UNQUOTED.match(html, end).end()
            if html[end : end + 1] == ">":
                break
            end = html.find(html[end], end + 1) + 1 if end < len(html) else 0
            if not end:
                quotes = False  # they do not pair up from here on
        if not quotes:
            end = html.find(">", m.end())
        yield html[begun:at], m[0].lower(), html[m.end() : max(end, m.end())]
        if end < 0:
            return
        at = begun = end + 1
        name = m[0].lower()
        if (name in RAW or name in SKIPPED) and name not in endless and html[end - 1] != "/":
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            if close:
                at = begun = close.end()
            elif name in RAW:
                return
            else:
                endless.add(name)
    yield html[begun:], "", ""


def is_marked(names: str) -> bool:
    """Whether a class or id says that an element is no part of an article: every word of it must be known."""
    for name in names.split():
        words = _WORDS.findall(name)
        known = [w in OUTSIDE_WORDS for w in words]
        if any(known) and all(k or w in BESIDE_WORDS for k, w in zip(known, words, strict=True)):
            return True
    return False


class Page:
    """The elements and the blocks of a page. An element's parent comes before it; the first is the page."""

    def __init__(self, html: str) -> None:
        self.parent, self.depth, self.tag, self.path = [0], [0], [""], [0]
        # the last marked element and the last header of its own chain, and whether an article or main is above it
        self.marked, self.headed, self.inside = [-1], [-1], [-1]
        self.element: list[int] = []
        self.texts: list[str] = []
        self.linked: list[int] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._read(html)
        self._unmark_frames()

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower() if attributes else ""
        me = len(self.parent)
        page = self.depth[parent] < 2 and tag in ("html", "body")
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        label = (self.path[parent], f"{tag}.{names}" if names and not page else tag)
        self.path.append(self._paths.setdefault(label, len(self._paths) + 1))
        marked = not page and (tag in OUTSIDE or bool(names) and tag not in HEADINGS and is_marked(names))
        self.marked.append(me if marked else self.marked[parent])
        self.headed.append(me if tag == "header" else self.headed[parent])
        self.inside.append(me if tag in INSIDE else self.inside[parent])
        return me

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = []
        open_tags: dict[str, int] = {}
        parts: list[str] = []
        links = 0

        def close(names: frozenset[str], within: frozenset[str]) -> None:
            if not any(open_tags.get(n) for n in names):
                return
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in names:
                    for tag, _ in stack[k:]:
                        open_tags[tag] -= 1
                    del stack[k:]
                    return
                if stack[k][0] in within:
                    return

        def end_block() -> None:
            nonlocal parts, links
            text = _SPACE.sub(" ", unescape("".join(parts))).strip() if parts else ""
            if text:
                self.element.append(stack[-1][1] if stack else 0)
                self.texts.append(text)
                self.linked.append(links)
            parts, links = [], 0

        for text, name, attributes in tags(html):
            if text:
                parts.append(text)
                if open_tags.get("a"):
                    links += len(text)
            if not name:
                continue
            if name == "br":
                parts.append(" ")
                continue
            ends = name[0] == "/"
            tag = name[1:] if ends else name
            inline = tag in INLINE
            if not inline and tag not in VOID and tag not in RAW and tag not in SKIPPED or tag == "hr":
                end_block()
            if ends:
                close(frozenset([tag]), _HOLDERS if inline else _NONE)
                continue
            if tag in VOID or tag in RAW or tag in SKIPPED:
                continue
            if tag in CLOSES:
                close(CLOSES[tag], _LISTS)
            elif not inline:
                close(_P, _HOLDERS)
            if attributes.endswith("/") and not inline or len(stack) >= MAX_DEPTH:
                continue
            above = stack[-1][1] if stack else 0
            stack.append((tag, above if inline else self._open(tag, attributes, above)))
            open_tags[tag] = open_tags.get(tag, 0) + 1
        end_block()

    def _unmark_frames(self) -> None:
        """A form with most of the page's text outside links is no form of the page but its frame."""
        if "form" not in self.tag:
            return
        chars = self._summed([max(len(t) - n, 0) for t, n in zip(self.texts, self.linked, strict=True)])
        for e in range(1, len(self.parent)):
            if self.marked[e] == e and self.tag[e] == "form" and chars[e] > FRAME * chars[0]:
                self.marked[e] = self.marked[self.parent[e]]
            elif self.marked[e] != e:
                self.marked[e] = self.marked[self.parent[e]]

    def _summed(self, of_blocks: list[int]) -> list[int]:
        """What each element's blocks add up to."""
        sums = [0] * len(self.parent)
        for e, n in zip(self.element, of_blocks, strict=True):
            sums[e] += n
        for e in range(len(sums) - 1, 0, -1):
            sums[self.parent[e]] += sums[e]
        return sums

    def possible(self) -> list[bool]:
        """Whether a block may be on a content path: not marked; if there are none of these, in an article below marks."""
        texts = [len(t) > n for t, n in zip(self.texts, self.linked, strict=True)]
        plain = [
            self.marked[e] < 0 and (self.headed[e] < 0 or self.inside[e] >= 0 and self.inside[e] < self.headed[e])
            for e in self.element
        ]
        if any(p and t for p, t in zip(plain, texts, strict=True)):
            return plain
        return [self.inside[e] > self.marked[e] for e in self.element]

    def ratios(self) -> list[tuple[float, float]]:
        """The two ratios of each block's path, smoothed over the block's neighbours below its element's parent."""
        paths = [self.path[e] for e in self.element]
        sums: dict[int, list[int]] = {}
        for p, text, linked in zip(paths, self.texts, self.linked, strict=True):
            s = sums.setdefault(p, [0, 0, 0])
            s[0] += max(len(text) - linked, 0)
            s[1] += len(_PUNCTUATION.findall(text))
            s[2] += 1
        holder = [self.parent[e] for e in self.element]
        out = []
        for i, p in enumerate(paths):
            total = [0.0, 0.0]
            for step, weight in zip((-1, 0, 1), SMOOTH, strict=True):
                j = i + step
                s = sums[paths[j] if 0 <= j < len(paths) and holder[j] == holder[i] else p]
                for k in (0, 1):
                    total[k] += weight * s[k] / s[2] ** 0.5
            out.append((total[0], total[1]))
        return out

    def values(self) -> list[float]:
        """The value of each block's path: its two ratios fused, where they are highest; 0 if it may be none of content."""
        best: dict[int, float] = {}
        may = self.possible()
        for e, (chars, marks), m in zip(self.element, self.ratios(), may, strict=True):
            weight = INSIDE_WEIGHT if self.inside[e] >= 0 else 1.0
            best[self.path[e]] = max(best.get(self.path[e], 0.0), chars * (1 + marks) * weight * m)
        return [best[self.path[e]] * m for e, m in zip(self.element, may, strict=True)]

    def menus(self) -> set[int]:
        """Paths whose text is links by LINKED or more, headings apart."""
        sums: dict[int, list[int]] = {}
        for e, text, linked in zip(self.element, self.texts, self.linked, strict=True):
            if self.tag[e] not in HEADINGS:
                s = sums.setdefault(self.path[e], [0, 0])
                s[0] += len(text)
                s[1] += min(linked, len(text))
        return {p for p, (chars, linked) in sums.items() if linked >= LINKED * chars}

    def comments(self, chosen: list[bool], region: int) -> list[bool]:
        """Blocks of trailing rows of alike elements, each of which begins with a short line and is dated."""
        n, blocks = len(self.parent), len(self.texts)
        first, last, heads = [blocks] * n, [-1] * n, [False] * n
        for i, e in enumerate(self.element):
            first[e], last[e] = min(first[e], i), max(last[e], i)
        rows: dict[tuple[int, int], list[int]] = {}
        for e in range(n - 1, 0, -1):
            above = self.parent[e]
            first[above], last[above] = min(first[above], first[e]), max(last[above], last[e])
            heads[above] = heads[above] or heads[e] or self.tag[e] in HEADINGS
            if self.tag[e] in _ROWS and last[e] > first[e] and e > region:
                rows.setdefault((above, self.path[e]), []).append(e)
        before = list(accumulate(chosen, initial=0))
        out = [False] * blocks
        for members in rows.values():
            start, end = first[members[-1]], last[members[0]]
            trails = before[start] > 0 and before[blocks] == before[end + 1]
            if len(members) > 1 and trails and not any(heads[e] for e in members) and all(map(self._signed, [first[e] for e in members])):
                for e in members:
                    out[first[e] : last[e] + 1] = [True] * (last[e] + 1 - first[e])
        return out

    def _signed(self, i: int) -> bool:
        head = self.texts[i]
        return len(head) <= HEAD_CHARS and bool(_DATED.search(head) or _DATED.search(self.texts[i + 1][:HEAD_CHARS]))

    def is_page(self, e: int) -> bool:
        return e == 0 or self.tag[e] in ("html", "body")

    def region(self, chosen: list[bool]) -> int:
        """The innermost element that holds all chosen blocks; the article or main around it, if there is one.

        Of the page, or of an element that holds nothing but containers, the container with MOST of the text counts.
        """
        n = len(self.parent)
        held, chars, mixed, largest = [0] * n, [0] * n, [False] * n, [0] * n
        for e, c, text, linked in zip(self.element, chosen, self.texts, self.linked, strict=True):
            held[e] += c
            chars[e] += max(len(text) - linked, 0) * c
            mixed[e] = True
        for e in range(n - 1, 0, -1):
            above = self.parent[e]
            held[above] += held[e]
            chars[above] += chars[e]
            if self.tag[e] in PLAIN:
                mixed[above] = mixed[above] or mixed[e]
            elif self.marked[e] != e and self.headed[e] != e and (chars[e] > chars[largest[above]] or not largest[above]):
                largest[above] = e
        at = max((e for e, h in enumerate(held) if h == held[0]), key=self.depth.__getitem__)
        while self.tag[at] in PLAIN and self.parent[at]:  # a single paragraph or list: what it stands in
            at = self.parent[at]
        while self.inside[at] < 0 and largest[at] and (self.is_page(at) or not mixed[at]):
            if chars[largest[at]] < MOST * chars[at]:
                break
            at = largest[at]
        return self.inside[at] if self.inside[at] >= 0 else at

    def within(self, e: int, region: int) -> bool:
        while self.depth[e] > self.depth[region]:
            e = self.parent[e]
        return e == region

    def kept(self) -> list[bool]:
        values = self.values()
        least = SHARE * max(values, default=0.0)
        chosen = [v > 0 and v >= least for v in values]
        if not any(chosen):
            return chosen
        region = self.region(chosen)
        depth = self.depth[region]
        whole = self.is_page(region)
        first, last = chosen.index(True), len(chosen) - chosen[::-1].index(True)
        menus, comments = self.menus(), self.comments(chosen, region)
        keep, dropped = [], []
        for i, e in enumerate(self.element):
            mark = max(self.marked[e], self.headed[e] if whole else -1)
            clear = self.within(e, region) and (mark < 0 or self.depth[mark] <= depth)
            if whole:
                clear = clear and (chosen[i] or first < i < last and self.tag[e] in PLAIN)
            dropped.append(clear and (comments[i] or self.path[e] in menus and not chosen[i]))
            keep.append(clear and not dropped[-1])
        if whole and not any(keep):
            keep = chosen
        for i in range(len(keep) - 2, -1, -1):  # a heading belongs to the block after it
            e = self.element[i]
            if self.tag[e] in HEADINGS and self.marked[e] < 0:
                keep[i] = keep[i] or keep[i + 1]
        below: bool | None = None  # of the blocks down to the next heading: whether one is kept, None if there are none
        for i in range(len(keep) - 1, -1, -1):
            if self.tag[self.element[i]] in HEADINGS:
                if below is False and self.tag[self.element[i]] != "h1":
                    keep[i] = False
                below = None
            elif keep[i] or dropped[i]:
                below = bool(below) or keep[i]
        return keep


def main_text(html: str | None) -> str:
    page = Page(html or "")
    return "\n\n".join(t for t, k in zip(page.texts, page.kept(), strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for every row of pages."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in in_parts(batches):
            yield htmls.map(main_text)

    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return rows.select("page_id", "url", read("html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
