import functools
import random
import re
from html.parser import HTMLParser

import pytest

from lodestone.llm import html as H
from lodestone.llm import queries as Q


def page(title, body, extra=""):
    return f"<html><head><title>t</title></head><body><div class='top'>Site of news</div><div><h1>{title}</h1>{body}<div class='x'>All rights kept</div></div>{extra}</body></html>"


def test_template_is_left_out(spark):
    rows = [(i, f"https://site.org/{i}", page(f"Title {i}", "".join(f"<p>Text {i} of {k}</p>" for k in range(1 + i % 4)))) for i in range(12)]
    rows += [(50, "https://SITE.org/copy", rows[0][2]), (60, "https://one.org/", page("Alone", "<p>x</p>")), (61, None, page("Nowhere", "<p>y</p>")), (62, "u", None), (63, "https://site.org/e", ""), (0, rows[0][1], rows[0][2])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as wrapper", "'z' as main_text")
    got = {(r.page_id, r.url): (r.main_text, r.n_main_chars) for r in H.main_text(table).collect()}
    assert H.main_text(table).count() == len(rows)
    for i in range(12):
        want = "\n\n".join([f"Title {i}", *(f"Text {i} of {k}" for k in range(1 + i % 4))])
        assert got[i, f"https://site.org/{i}"] == (want, len(want))
    assert got[50, "https://SITE.org/copy"] == got[0, "https://site.org/0"]
    assert "Alone" in got[60, "https://one.org/"][0] and "Nowhere" in got[61, None][0] and got[62, "u"] == ("", 0) and got[63, "https://site.org/e"] == ("", 0)
    assert H.main_text(table.limit(0)).count() == 0


def test_structure_alone():
    source = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a href="/">Home</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><script>var t="</p>";</script><!-- <p>hidden</p> --><div class=ad>Buy</div>
    <article><h1>A &amp; B&nbsp;C</h1><p>One <b>two</b><br>three&#33;<p>Four
      five<ul><li>six<li>seven</ul><form><input value="x"><p>Search</p></form><aside>Side</aside><table><tr><td>a<td>b</table><div id="comments"><p>Reader</p></div></article><footer>End</footer></body></html>"""
    assert H.extract(source)[0] == "A & B C\n\nOne two three!\n\nFour five\n\nsix\n\nseven\n\na\n\nb"


def test_odd_markup():
    assert H.extract("plain text &lt;x&gt;")[0] == "plain text <x>"
    assert H.extract('<p title="a > b">in</p> out')[0] == "in\n\nout"
    assert H.extract("<p>a<script>never closed <p>b")[0] == "a"
    assert H.extract("<p>1 < 2 and 3 > 2</p>")[0] == "1 < 2 and 3 > 2"
    assert H.extract("<div><p>a</div><p>b")[0] == "a\n\nb"
    assert H.extract("<p>" + "long " * 200_000)[0].startswith("long long")
    assert H.extract("<" * 5000)[0] == "<" * 5000
    assert H.extract("<b>" * 3000 + "x")[0] == "x"


def test_simple_tree_matching():
    a, b = H.Page("<div><p>1</p><p>2</p></div><ul><li>x</li></ul>"), H.Page("<div><p>1</p><h2>n</h2><p>2</p></div><section></section><ul><li>x</li><li>y</li></ul>")
    matched = H.align(a, b)
    assert [(a.labels[x], b.labels[y]) for y, x in sorted(matched.items())] == [("#", "#"), ("div", "div"), ("p", "p"), ("p", "p"), ("ul", "ul"), ("li", "li")]


def test_tree_matching_equals_plain_recursion():
    rng = random.Random(3)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1)}</{t}>" for t in rng.choices(["div", "ul", "section"], k=rng.randrange(4))) if depth else "x"

    for _ in range(150):
        a, b = H.Page(some(4)), H.Page(some(4))

        @functools.cache
        def plain(i, j):
            xs, ys = a.children[i], b.children[j]
            table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
            for m, x in enumerate(xs):
                for n, y in enumerate(ys):
                    table[m + 1][n + 1] = max(table[m][n + 1], table[m + 1][n], table[m][n] + (plain(x, y) if a.labels[x] == b.labels[y] else 0))
            return 1 + table[-1][-1]

        matched = H.align(a, b)
        assert len(matched) == plain(0, 0) == H._match(a, 0, b, 0)
        assert all(a.labels[x] == b.labels[y] and (not y or matched[b.parents[y]] == a.parents[x]) for y, x in matched.items())
        assert len(set(matched.values())) == len(matched)


def bare(i):
    """A page without any telling element or name: links, a notice, the article, words about it, more links, a footer."""
    links = "".join(f"<div><a href='/{(i * 7 + k) % 50}'>Word {(i * 7 + k) % 50}</a></div>" for k in range(6))
    body = "".join(f"<p>Paragraph {k} of story {i}, with <a href='/x'>a link</a> and rather many words in it.</p>" for k in range(1 + i % 5))
    return f"<html><body><div><div>Site of news</div></div><div>{links}</div><div><div>Read our terms</div><div><h2>Story {i}</h2>{body}<div>All rights reserved</div></div></div><div>Issue {i}</div></body></html>"


def test_the_wrapper_alone_decides(spark):
    rows = [(i, f"https://bare.org/{i}", bare(i)) for i in range(14)] + [(50, "https://bare.org/", ""), (51, "https://bare.org/error", "<html><body><p>Not found</p></body></html>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for marks in (False, True):
        got = {r.page_id: r for r in H.main_text(table, marks=marks).collect()}
        for i in range(14):
            want = [f"Story {i}", *(f"Paragraph {k} of story {i}, with a link and rather many words in it." for k in range(1 + i % 5))]
            assert got[i].main_text == "\n\n".join(want) and got[i].n_left_out == 10
        assert (got[50].main_text, got[51].main_text) == ("", "Not found")


def test_the_wrapper_equals_marks_on_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    alone = H.main_text(pages, marks=False).where("n_left_out > 0").collect()
    assert len(alone) > 100 and all(r.main_text == H.extract(r.html)[0] for r in alone)


def test_deep_and_long_pages(spark):
    deep = ["<div>" * n + f"text {n}" + "</div>" * n for n in (4000, 5000, 6000, 7000)]
    wide = ["<ul>" + "".join(f"<li><p>{i} {k}</p></li>" if (i + k) % 3 else f"<li>{k}</li>" for k in range(300)) + "</ul>" for i in range(4)]
    rows = [(i, f"http://{'deep' if i < 4 else 'wide'}.org/{i}", x) for i, x in enumerate(deep + wide)]
    got = {r.page_id: r.main_text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"text {n}" for n in (4000, 5000, 6000, 7000)] and all("299" in got[i] for i in range(4, 8))


class Article(HTMLParser):
    """The tables' pages by their marks alone, written apart from the library: blocks within article or main."""

    BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "ul", "ol", "li", "table", "tr", "td", "th", "section", "blockquote", "pre", "article", "main"}
    AWAY = {"nav", "header", "footer", "aside", "form", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.now = [], [], ""

    def ended(self):
        text = re.sub(r"[ \t\n\r\f]+", " ", self.now).strip(" \t\n\r\f")
        self.blocks += [text] if text else []
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "meta", "link", "img", "input", "hr"):
            self.now += " " if tag == "br" else ""
            return
        if tag in self.BLOCKS:
            self.ended()
        if tag == "p" and "p" in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index("p") :]
        named = " ".join(str(v) for k, v in attrs if k in ("class", "id"))
        away = tag in self.AWAY or re.search(r"\b(ad|ads|advert|comments?|cookie|notice|sidebar|menu|related|share)\b", named)
        self.open.append("!" + tag if away else tag)

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.ended()
        names = [x.lstrip("!") for x in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if {"article", "main"} & set(self.open) and not any(x.startswith("!") for x in self.open):
            self.now += data


def brute(page):
    parser = Article()
    parser.feed(page or "")
    parser.close()
    parser.ended()
    return "\n\n".join(parser.blocks)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    folder = f"/root/testdata/{sf}"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = Q.op5_html(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, brute(pages[r.page_id].html), len(r.text))
