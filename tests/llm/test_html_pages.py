"""Odd markup, class names inside articles, long subsequences, and whole pages against a plain version."""

import time
from html.parser import HTMLParser

import numpy as np
import pytest

from loomwell.llm import html_text

ODD = {
    '<main><h1 class="banner-title">Head</h1><p>Text</p></main>': ["Head", "Text"],
    '<article><p class="social-history">Smokes</p><p class="alert-level">High</p><p>End</p></article>': ["Smokes", "High", "End"],
    '<article><div class="share-buttons">Share</div><div class="related-posts">More</div><p class="ad-728">Buy</p><p>End</p></article>': ["End"],
    '<div class="no-sidebar"><h2 class="banner-title">Head</h2><p>Text</p></div><div class="sidebar-left">Side</div>': ["Head", "Text"],
    "<article><p>Before</p><select><option>A<option>B<p>After</p><p>End</p></article>": ["Before", "After", "End"],
    "<article><p>Before</p><select><option>A</option></select> and more<p>End</p></article>": ["Before", "and more", "End"],
    "<article><video src=x><p>One</p><audio><textarea><p>Two</p></article>": ["One", "Two"],
    "<article><video src=x><p>One</p><video>no player</video><p>Two</p></article>": ["One", "Two"],
    "<article><object data=x>Said instead</object><p>Two</p></article>": ["Said instead", "Two"],
    "<article><textarea>form</textarea><svg><title>t</title></svg><svg/><p>Two</p></article>": ["Two"],
    "<article><video-player>Kept</video-player><p>Two</p></article>": ["Kept", "Two"],
    '<article><p class="a>text</p><p>b</p></article>': ["text", "b"],
    '<article><p class="a>text</p><p class="b">c</p></article>': ["text", "c"],
    "<article><a href=it's>x</a> y</article>": ["x y"],
    '<article><p title="1 > 0"data-x=\'<b>\'>fine</p></article>': ["fine"],
    "<head><title>Lost<body><article><p>Found</p></article>": ["Found"],
    "<article><p>One</p><!--> <p>Two</p><!-- x --!><p>Three</p><!-- never closed <p>Four</p></article>": ["One", "Two", "Three"],
    "<article><p>One</p><script>var a = '<p>';": ["One"],
    '<article><p>One</p>Rest <a href="http://x': ["One", "Rest"],
    "<article><p>1 < 2 and 3 <4 &lt;b&gt;</p></article>": ["1 < 2 and 3 <4 <b>"],
}


@pytest.mark.parametrize("page", ODD)
def test_odd_markup(page):
    assert [line for line, _, frame in html_text.blocks(page) if not frame] == ODD[page]


@pytest.mark.parametrize("page", ["<a " * 200_000, '<a b="' * 100_000, "<select><option>x" * 50_000, "<video>" * 100_000, "<!--" * 100_000, "<p class='x>y</p>" * 50_000])
def test_odd_markup_takes_no_longer_than_its_length_asks(page):
    began = time.monotonic()
    html_text.blocks(page + "<p>end</p>")
    assert time.monotonic() - began < 5


def _longest(a, b):
    rows = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1, j + 1] = rows[i, j] + 1 if x == y else max(rows[i, j + 1], rows[i + 1, j])
    return rows


def test_halved_subsequences_are_as_long(monkeypatch):
    r = np.random.default_rng(7)
    for bits in (1, 60, 1 << 26):
        monkeypatch.setattr(html_text, "TABLE_BITS", bits)
        for n, m, kinds in [(40, 30, 5), (1, 20, 3), (33, 1, 2), (64, 65, 2), (30, 30, 40), (0, 5, 2)]:
            a, b = r.integers(0, kinds, n), r.integers(0, kinds, m)
            at = html_text.shared_lines(a, b)
            assert len(at) == _longest(a, b)[-1, -1] and at == sorted(set(at))
            left = iter(b.tolist())
            assert all(x in left for x in a[at].tolist())


def test_many_equal_lines_are_quick():
    same = np.ones(20_000, np.int64)
    mixed = np.random.default_rng(1).integers(0, 3, 20_000)
    began = time.monotonic()
    assert html_text.shared_lines(same, same) == list(range(20_000))
    assert time.monotonic() - began < 1
    assert len(html_text.shared_lines(mixed, mixed[::-1].copy())) > 10_000


class _Lines(HTMLParser):
    """Lines of the test tables' pages by the standard library's parser; kinds as the operator names them."""

    VOID = {"br", "meta", "link", "img", "hr", "input"}
    ENDS = {"p", "div", "h1", "h2", "h3", "li", "ul", "article", "nav", "footer", "header", "aside", "body", "head", "title", "html", "section", "table", "tr"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.lines, self.now = [], [], ""
        self.feed(page)
        self.close()
        self.end()

    def kind(self):
        names = [t for t, _ in self.stack]
        framed = any(t in ("nav", "footer", "aside", "form", "head", "title", "button", "script", "style") or ad for t, ad in self.stack) or "header" in names and "article" not in names
        return html_text.FRAMED if framed else html_text.HELD if "article" in names or "main" in names else html_text.PLAIN

    def end(self):
        line = " ".join(self.now.split())
        if line:
            self.lines.append((line, self.kind()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            self.now += " " if tag == "br" else ""
            return
        if tag in self.ENDS:
            self.end()
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ("p", *(["li"] if tag == "li" else [])):
                    del self.stack[i:]
                    break
                if self.stack[i][0] in self.ENDS:
                    break
        self.stack.append((tag, dict(attrs).get("class") == "ad"))

    def handle_endtag(self, tag):
        if tag in self.ENDS:
            self.end()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if not self.stack or self.stack[-1][0] not in ("script", "style"):
            self.now += data


def _plain_texts(pages):
    """The text of each (page_id, url, html): every step over whole lists, pair by pair."""
    rows = []
    for page_id, url, page in pages:
        address = (url or "").split("://", 1)[-1].split("?")[0].split("#")[0]
        host, slash, path = address.partition("/")
        rows.append((host.lower(), slash + path, page_id, _Lines(page or "").lines))
    hosts = {}
    for host, path, page_id, lines in rows:
        kept = hosts.setdefault(host, {})
        kept[tuple(lines)] = min(kept.get(tuple(lines), (path, page_id)), (path, page_id))
    places = [(host, path, page_id, lines) for host in hosts for lines, (path, page_id) in hosts[host].items()]
    places.sort(key=lambda p: (p[0].encode(), p[1].encode(), p[2]))
    gone = {}
    for at, (host, path, _, lines) in enumerate(places):
        different = list(hosts[host])
        common = {line for line, _ in lines if len(different) >= 3 and sum(any(line == x for x, _ in other) for other in different) >= max(3, 0.8 * len(different))}
        near = [i for i in range(max(at - 4, 0), min(at + 5, len(places))) if places[i][0] == host and i != at]

        def alike(i, path=path):
            n = 0
            while n < min(len(path), len(places[i][1])) and path[n] == places[i][1][n]:
                n += 1
            return n

        out = set()
        for i in sorted(near, key=lambda i: (-alike(i), abs(i - at))):
            a, b = [x for x, _ in lines], [x for x, _ in places[i][3]]
            table, k, col, shared = _longest(a, b), len(a), len(b), []
            while k and col:
                if table[k, col] == table[k, col - 1]:
                    col -= 1
                elif table[k, col] == table[k - 1, col]:
                    k -= 1
                else:
                    k, col = k - 1, col - 1
                    shared.append(k)
            body = sum(kind != html_text.FRAMED for _, kind in lines)
            decides = sum(lines[k][1] != html_text.FRAMED for k in shared) < 0.8 * max(body, 1)
            out |= {k for k in shared if lines[k][1] == html_text.FRAMED or decides and lines[k][1] == html_text.PLAIN or lines[k][0] in common}
            if decides:
                break
        gone[host, lines] = out
    texts = []
    for host, _, page_id, lines in rows:
        left = [line for k, (line, kind) in enumerate(lines) if k not in gone[host, tuple(lines)] and kind == html_text.HELD]
        texts.append((page_id, "\n".join(left)))
    return sorted(texts)


def test_whole_pages_against_a_plain_version(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    assert sorted((r.page_id, r.text) for r in html_text.main_text(df).collect()) == _plain_texts(pages)
