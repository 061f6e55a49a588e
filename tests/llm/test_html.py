"""HTML extraction on pages whose marks, ratios and comments disagree, and its ratios by brute force."""

import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from rivulet.llm import html_extract
from rivulet.llm.common import table

LONG = "A long sentence of the article, with marks; and more words in it. " * 5
L = LONG.strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # short articles beside long marked text
        (f"<div id=content><h1>Hi</h1><p>Short.</p></div><footer><p>Copyright 2024, Some Company, Inc. {LONG}</p></footer>", ["Hi", "Short."]),
        (f"<article><h1>A</h1><p>One line.</p></article><aside class=sidebar><p>{LONG}</p></aside>", ["A", "One line."]),
        (f"<article><figure><img src=x><figcaption>A cat, asleep.</figcaption></figure></article><div class=cookie-notice><p>{LONG}</p></div>", ["A cat, asleep."]),
        (f"<nav><a href=x>Home</a></nav><footer><p>{LONG}</p></footer>", []),
        (f"<header><p>{LONG}</p></header><main><p>Word, one.</p></main>", ["Word, one."]),
        (f"<form id=page><nav><a href=x>Home</a></nav><div><p>{LONG}</p></div></form><form><p>Your name, please.</p></form>", [L]),
        (f"<div class=menu><article><p>{LONG}</p></article></div>", [L]),
        # readers' comments
        (f"<article><p>{LONG}</p><p>{LONG}</p><div id=disqus_thread><p>{LONG}</p></div></article>", [L, L]),
        (f"<article><p>{LONG}</p><ol class=commentlist><li><b>Ann</b><p>Nice.</p></li><li><b>Bob</b><p>Bad.</p></li></ol></article>", [L]),
        (f"<article><p>{LONG}</p><div class=thread><div class=msg>Nice post.</div><div class=msg>Bad, bad.</div></div></article>", [L]),
        (f"<article><p>{LONG}</p><div class=user-reviews><p>Nice.</p></div></article>", [L]),
        (f"<div class=c><p>{LONG}</p><div class=r><span>Ann, 3 days ago</span><p>{LONG}</p></div><div class=r><span>Bob, 12 May</span><p>No.</p></div></div>", [L]),
        # alike elements that are no comments
        (f"<div class=c><p>{LONG}</p><div class=s><b>Step 1</b><p>Mix, well.</p></div><div class=s><b>Step 2</b><p>Bake it.</p></div></div>",
         [L, "Step 1", "Mix, well.", "Step 2", "Bake it."]),
        (f"<article><div class=d><h3>12 May</h3><p>{LONG}</p></div><div class=d><h3>13 May</h3><p>{LONG}</p></div></article>", ["12 May", L, "13 May", L]),
        # menus and adverts in the article
        (f"<div id=content><h1>T</h1><p>{LONG}</p><div class=ad-slot>Buy!</div><h2>Related</h2><ul><li><a href=1>A story</a><li><a href=2>More</a></ul></div>", ["T", L]),
        (f"<article><h1><a href=x>Title</a></h1><p>{LONG}</p><p>See <a href=y>this long link of many words</a> here.</p></article>",
         ["Title", L, "See this long link of many words here."]),
        (f"<article><p>{LONG}</p><h2>Sources</h2><ul><li>The book, by <a href=x>A. B.</a>, on paper.</ul></article>", [L, "Sources", "The book, by A. B., on paper."]),
        # comments of the markup
        (f"<body><!--><article><p>{LONG}</p></article>", [L]),
        (f"<body><!---><article><p>{LONG}</p></article><!-- a --!><p class=x>And this, too.</p>", [L]),
        (f"<body><!-- <p>no</p> --><article><p>{LONG}</p></article><!-- never ended", [L]),
    ],
)
def test_main_text(page, want):
    assert html_extract.main_text(page) == "\n\n".join(want)


def test_lists_off(spark, monkeypatch):
    """Without any list of words, tags or dates the ratios still give the article of the most pages."""
    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").select("html").collect()]
    for name in ("OUTSIDE", "OUTSIDE_WORDS", "BESIDE_WORDS", "INSIDE"):
        monkeypatch.setattr(html_extract, name, frozenset())
    monkeypatch.setattr(html_extract, "_DATED", re.compile("(?!)"))
    same = 0
    for html in pages:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)[1]
        parts = [" ".join(html_extract.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", article)]
        same += html_extract.main_text(html) == "\n\n".join(p for p in parts if p)
    assert same >= 0.9 * len(pages)


class Paths(HTMLParser):
    """(path, holder, text, characters in links) of the blocks of a page without errors."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.text, self.linked, self.opened = [], [], "", 0, 0

    def end_block(self):
        if self.text.strip():
            path = tuple((t, c) for t, c, _ in self.stack if t != "a")
            self.blocks.append((path, self.stack[-2][2] if len(self.stack) > 1 else 0, " ".join(self.text.split()), self.linked))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag != "a":
            self.end_block()
        self.opened += 1
        self.stack.append((tag, dict(attrs).get("class", ""), self.opened))

    def handle_endtag(self, tag):
        if tag != "a":
            self.end_block()
        self.stack.pop()

    def handle_data(self, data):
        self.text += data
        if any(t == "a" for t, _, _ in self.stack):
            self.linked += len(data)


def test_ratios_by_brute_force():
    page = (
        "<html><body><div class=m><p><a href=x>One</a></p><p><a href=y>Two, three</a></p></div><div class=c><h1>Title</h1>"
        f"<p>{L}</p><p>Short, <a href=z>link</a>.</p><ul><li>Milk.</li><li>Eggs; two.</li></ul><p>Last!</p></div><div class=f><p>End.</p></div></body></html>"
    )
    parsed = Paths()
    parsed.feed(page)
    blocks = parsed.blocks
    of = {}
    for path, _, text, linked in blocks:
        chars, marks, n = of.get(path, (0, 0, 0))
        of[path] = (chars + len(text) - linked, marks + sum(text.count(c) for c in ".,;:!?"), n + 1)
    want = []
    for i, (path, holder, _, _) in enumerate(blocks):
        near = [blocks[j][0] if 0 <= j < len(blocks) and blocks[j][1] == holder else path for j in (i - 1, i, i + 1)]
        want.append(tuple(sum(w * of[p][k] / of[p][2] ** 0.5 for w, p in zip((0.25, 0.5, 0.25), near, strict=True)) for k in (0, 1)))
    got = html_extract.Page(page)
    assert got.texts == [b[2] for b in blocks] and len(blocks) == 9
    for a, b in zip(got.ratios(), want, strict=True):
        assert a == pytest.approx(b)
    assert html_extract.main_text(page).startswith("Title\n\nA long") and "Milk." in html_extract.main_text(page)


def test_odd_pages(spark):
    """Nulls, repeated rows, a page of 3 MB, endless comments and deep nesting, beside columns of clashing names."""
    big = "<article>" + f"<p>{LONG}</p>" * 9000 + "</article>"
    pages = [(1, None), (2, ""), (3, "<!-->"), (3, "<!-->"), (4, big), (5, "<div>" * 3000 + "Deep, text."), (6, "<!--" * 50_000), (None, "<p>x, y.</p>")]
    df = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string")
    for name in ("text", "n_chars", "kept", "path", "value"):
        df = df.withColumn(name, F.lit(1))
    got = html_extract.extract(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == sorted(
        (str(i), n) for i, n in [(1, 0), (2, 0), (3, 0), (3, 0), (4, 9000 * len(L) + 2 * 8999), (5, 11), (6, 0), (None, 5)]
    )
