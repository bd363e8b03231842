"""Main text of pages against a plain version on the standard library's parser, and defined cases."""

import os
import random
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from fluxgrain.llm import html


class Plain(HTMLParser):
    """Lines of well-formed pages with their lengths; what is open is known by counting."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.rows, self.text, self.linked = [], [], "", 0

    def end(self):
        words = self.text.split()
        if words:
            names = [n for n, _ in self.open]
            off = any(n in html.DROP or n == "header" and "article" not in names for n in names)
            named = any(c in html.NAMES for _, cs in self.open for c in cs)
            self.rows.append((" ".join(words), off, named, "article" in names or "main" in names, self.linked))
        self.text, self.linked = "", 0

    def handle_starttag(self, name, attributes):
        if name == "br":
            self.text += " "
        elif name not in html.VOID:
            if name in html.BLOCKS:
                self.end()
                if any(n == "p" for n, _ in self.open):
                    del self.open[max(i for i, (n, _) in enumerate(self.open) if n == "p") :]
            self.open.append((name, [c for k, v in attributes if k in ("class", "id") for c in (v or "").lower().split()]))

    def handle_endtag(self, name):
        if name in html.BLOCKS:
            self.end()
        if name in [n for n, _ in self.open]:
            del self.open[max(i for i, (n, _) in enumerate(self.open) if n == name) :]

    def handle_data(self, data):
        names = [n for n, _ in self.open]
        if not {"script", "style", "title"} & set(names):
            self.text += data
            if "a" in names and not html.HEADS & set(names):
                self.linked += len("".join(data.split()))


def plain(page):
    p = Plain()
    p.feed(page)
    p.end()
    size = [0 if off or named else len("".join(t.split())) - linked for t, off, named, _, linked in p.rows]
    if any(n and r[3] for n, r in zip(size, p.rows, strict=True)):
        size = [n * r[3] for n, r in zip(size, p.rows, strict=True)]
    w = html.WINDOW
    sums = [sum(size[i : i + w]) for i in range(len(size))]
    least = min(html.SURGE, max(sums, default=0) / 2)
    out = []
    for i, (t, off, named, *_) in enumerate(p.rows):
        a, b = i, i
        while a > 0 and sums[a - 1]:
            a -= 1
        while b + 1 < len(sums) and sums[b + 1]:
            b += 1
        if sums[i] and max(sums[a : b + 1]) >= least and any(size[a : i + 1]) and not off and not named:
            out.append(t)
    return "\n".join(out)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_agrees_with_plain_on_pages():
    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    for page in pages:
        assert html.extract(page) == plain(page)
    assert all("\n".join(x.text for x in html.lines(p) if not x.marked) != html.extract(p) for p in pages)  # the sums decide


def test_agrees_with_plain_on_random_pages():
    rng = random.Random(5)
    text = lambda n: " ".join("w" * rng.randrange(1, 9) for _ in range(n))
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 14)):
            kind = rng.randrange(6)
            parts.append((f"<p>{text(rng.randrange(1, 30))}</p>", f"<p><a href='#'>{text(3)}</a></p>", f"<div class='ad'>{text(9)}</div>", f"<ul><li><a>{text(1)}</a></li><li><a>{text(1)}</a></li></ul>", f"<h2><a>{text(2)}</a></h2>", f"<aside><p>{text(20)}</p></aside>")[kind])
        cut = rng.randrange(len(parts) + 1)
        body = "".join(parts[:cut]) + ("<article>" + "".join(parts[cut:]) + "</article>" if rng.random() < 0.6 else "".join(parts[cut:]))
        assert html.extract(body) == plain(body), body


def test_names_are_whole_and_attributes_parsed():
    body = '<p style="overflow: hidden">a</p><p title="the hidden valley">b</p><p data-id="ad-7">c</p><div class="related-work">d</div><p id="share-price">e</p><p>Formula <math>x</math> <svg><text>y</text></svg></p>'
    assert html.extract(f"<article>{body}</article>") == "a\nb\nc\nd\ne\nFormula x y"
    assert html.extract('<article><p>a</p><p hidden>b</p><p class="x ad y">c</p><div role="search">d</div><p>e</p></article>') == "a\ne"


def test_stretches():
    assert html.stretches([]) == [] and html.stretches([0, 0]) == []
    assert html.stretches([0, 3, 0, 0, 0, 200, 0, 5, 0]) == [(5, 7)]
    assert html.stretches([4, 3]) == [(0, 1)]


def test_long_and_broken_pages_are_read_once():
    for page in ('<a "' * 200_000, "<script>" * 100_000, "<p>" * 100_000 + "x", "<div>" * 50_000 + "y" + "</p>" * 50_000, "<!--" * 200_000, "&amp;" * 200_000):
        html.extract(page)
    long = "<article>" + "<p>word</p>" * 100_000 + "</article>"
    assert html.extract(long).count("word") == 100_000


def test_defined_cases(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("text", "n_chars", "kept", "size"):
        df = df.withColumn(c, F.lit("x"))
    got = sorted((tuple(r) for r in html.extract_pages(df).collect()), key=repr)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert html.extract_pages(df.limit(0)).count() == 0
