"""Wrappers and main texts of pages of several templates, and of the test table."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from conftest import DATA

from tallyline.llm import html_wrapper as h
from tallyline.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, host string, text string"
LOREM = "Rivers run long past the old mill and the ground is wet in spring {n} and dry later on."


def article_page(n: int) -> str:
    paragraphs = "".join(f"<p>{LOREM.format(n=n * 10 + i)}" for i in range(1 + n % 4))
    extra = "<ul><li>one &amp; <b>two</b></li><li>th&eacute;<br>end</li></ul>" if n % 3 == 0 else ""
    return (
        f"<!DOCTYPE html><html><head><title>T{n}</title><style>p{{x}}</style><script>if (a < b) document.write('<p>no</p>')</script></head>"
        f"<body class='page-{n}'><div id=top><nav><a href=/>Home</a></nav></div><div class='cookie-notice'>We use cookies</div>"
        f"<main><article id='post-{n}'><h1>Title\n {n}</h1><div class=\"ad\">Buy {n}</div>{paragraphs}{extra}"
        f"<aside>See also</aside><form><input name=q>Search<button>Go</button></form></article>"
        f"<section class='comments'><article class='comment'><p>Nice {n}</p></article></section></main>"
        f"<footer>&copy; {n}</footer></body></html>"
    )


def article_text(n: int) -> str:
    blocks = [f"Title {n}", *(LOREM.format(n=n * 10 + i) for i in range(1 + n % 4))]
    return "\n".join(blocks + (["one & two", "thé end"] if n % 3 == 0 else []))


def plain_page(n: int) -> str:
    """No article element: template texts and link lists are told by the wrapper."""
    story = "".join(f"<div>{LOREM.format(n=n * 7 + i)} {'more ' * 5}</div>" for i in range(2 + n % 3))
    return (
        "<body><div><div><a href=1>News</a> <a href=2>Sport</a></div><div>This page is best seen with open eyes.</div></div>"
        f"<div><div><h2>Story {n} of the day</h2>{story}</div></div><div><div>All rights are with the makers of this page.</div></div></body>"
    )


def plain_text(n: int) -> str:
    return "\n".join([f"Story {n} of the day", *(" ".join(f"{LOREM.format(n=n * 7 + i)} {'more ' * 5}".split()) for i in range(2 + n % 3))])


def texts(spark, rows):
    df = spark.createDataFrame([(a, b, c, "h", "t") for a, b, c in rows], SCHEMA)
    return {(r.page_id, r.url): r.text for r in h.main_text(df).collect()}


def test_templates(spark):
    rows = [(n, f"http://a.com/{n}", article_page(n)) for n in range(12)]
    rows += [(100 + n, f"http://b.com/{n}", plain_page(n)) for n in range(12)]
    found = texts(spark, rows)
    for n in range(12):
        assert found[n, f"http://a.com/{n}"] == article_text(n)
        assert found[100 + n, f"http://b.com/{n}"] == plain_text(n)


def test_wrapper_has_slots_optional_and_repeated_elements():
    wrapper = None
    for n in range(1, 8):
        wrapper = h.merged(wrapper, h.wrapped(h.parsed(article_page(n))))
    body = wrapper[h.CHILDREN][0][h.CHILDREN][-1]
    article = body[h.CHILDREN][-1][h.CHILDREN][0]
    title, paragraph, listing = article[h.CHILDREN]
    assert (wrapper[h.PAGES], article[h.KEY], title[h.KEY]) == (7, "article", "h1")
    assert title[h.TEXT] == "*" and not title[h.REPEATED]
    assert paragraph[h.REPEATED] and paragraph[h.PAGES] == 7
    assert listing[h.KEY] == "ul" and listing[h.PAGES] == 2


def test_runs_of_neighbours_fold_into_groups():
    page = "<div>" + "<h3>a</h3><p>b</p><p>c</p>" * 3 + "</div>"
    inner = h.wrapped(h.parsed(page))[h.CHILDREN][0][h.CHILDREN]
    assert [e[h.KEY] for e in inner] == ["h3", "p"] and all(e[h.REPEATED] for e in inner)


def test_odd_pages(spark):
    deep = "<article>" + "<div>" * 400 + "deep" + "</div>" * 400 + "</article>"
    rows = [
        (1, "http://x.org/1", None), (2, "http://x.org/2", ""), (3, "http://x.org/3", "<p>"), (4, None, "<article>plain"),
        (5, "no url", "only &lt;text&gt; &#233;&nbsp;x"), (6, "http://x.org/6", "<article><p>a<script>x</p></article>"),
        (7, "http://x.org/7", "<article><!-- <p>no --><p title='a>b'>yes<p>and</article>tail<!-- open"),
        (8, "http://x.org/8", "<ARTICLE><P>Up</P></ARTICLE>"), (9, "http://x.org/9", "<form><article><p>in a form</p></article></form>"),
        (10, "http://x.org/10", "<article><p>" + "w " * 50_000 + "</p></article>"), (11, "http://x.org/11", deep),
        (None, "http://x.org/n", "<article>no id</article>"), (8, "http://x.org/8", "<ARTICLE><P>Up</P></ARTICLE>"),
        (12, "http://x.org/12", "<article><header><h1>H</h1></header><p>a<p class=notice>b<p hidden>c</article>"),
        (13, "http://x.org/13", "<article>a < b and <b>bold</b>face<span class=ad>x</span> c</article>"),
    ]
    found = texts(spark, rows)
    expected = {
        1: "", 2: "", 3: "", 4: "plain", 5: "only <text> é x", 6: "a", 7: "yes\nand", 8: "Up", 9: "in a form",
        10: ("w " * 50_000).strip(), 11: "deep", None: "no id", 12: "a", 13: "a < b and boldface\nc",
    }
    assert {k[0]: v for k, v in found.items()} == expected


def test_same_result_from_any_split_of_a_host(spark):
    rows = [(n, "http://a.com/", plain_page(n)) for n in range(20)]
    whole = texts(spark, rows)
    df = spark.createDataFrame([(a, b, c, "h", "t") for a, b, c in rows], SCHEMA)
    assert {(r.page_id, r.url): r.text for r in h.main_text(df.repartition(7)).collect()} == whole


def test_empty_table(spark):
    assert h.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_test_table(spark):
    """The pages of the table have one article element each: cut it out with a few substitutions."""

    def cut(html: str) -> str:
        inner = re.search(r"<article>(.*?)</article>", html, re.S).group(1).replace("<br>", " ")
        blocks = re.split(r"</?(?:p|h1|h2|ul|li|div)\b[^>]*>", inner)
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
        return "\n".join(b for b in blocks if b)

    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    found = QUERIES["op9_html_extraction"](spark, DATA).collect()
    expected = Counter((p.page_id, p.url, cut(p.html)) for p in pages)
    assert Counter((r.page_id, r.url, r.text) for r in found) == expected
    assert all(r.n_chars == len(r.text) for r in found)


def read_together(pages: list[str]) -> list[str]:
    """The main texts of one host's pages."""
    wrapper = None
    for page in pages:
        wrapper = h.merged(wrapper, h.wrapped(h.parsed(page)))
    reader = h.Reader(wrapper)
    return [reader.article(page) for page in pages]


def test_region_holds_all_main_text():
    pages, expected = [], []
    for n in range(8):
        story = [LOREM.format(n=n * 9 + i) for i in range(6)]
        pages.append(
            "<body><div><a href=1>News</a></div>"
            f"<div class=post><h1>Title {n}</h1><div class=intro><p>In short {n}</p></div>"
            f"<div class=text>{''.join(f'<p>{x}</p>' for x in story)}</div><div class=more><p>Second part {n}</p></div></div>"
            "<div><p>All rights are kept.</p></div></body>"
        )
        expected.append("\n".join([f"Title {n}", f"In short {n}", *story, f"Second part {n}"]))
    assert read_together(pages) == expected


def tagged_page(n: int) -> str:
    """A page whose elements have names of their own, and a template that begins to be one after the first pages."""
    own = "".join(f"<div class='tag-{a}{b}'><p>{LOREM.format(n=n)} {a}{b}</p></div>" for a in names(n) for b in "abcde")
    late = "<div class=late><p>This page is best seen with open eyes.</p></div>" if n > 20 else ""
    return f"<body><div class=post><h2>Story {n}</h2>{own}</div>{late}<div class=end><p>All rights are kept.</p></div></body>"


def names(n: int) -> list[str]:
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [letters[n % 26] + letters[n // 26] + letters[i] for i in range(6)]


def tagged_text(n: int) -> str:
    return "\n".join([f"Story {n}", *(f"{LOREM.format(n=n)} {a}{b}" for a in names(n) for b in "abcde")])


def test_all_pages_take_part_in_a_full_wrapper(monkeypatch):
    monkeypatch.setattr(h, "MOST_NODES", 200)
    pages = [tagged_page(n) for n in range(60)]
    expected = [tagged_text(n) for n in range(60)]
    assert read_together(pages) == expected
    assert read_together(pages[::-1]) == expected[::-1]
    wrapper = None
    for page in pages:
        wrapper = h.merged(wrapper, h.wrapped(h.parsed(page)))
    assert h.size_of(wrapper) <= 200 and wrapper[h.CHILDREN][0][h.PAGES] == 60


def test_full_wrapper_is_the_same_from_any_split(monkeypatch):
    monkeypatch.setattr(h, "MOST_NODES", 200)
    parts = [None] * 3
    for n in range(60):
        parts[n % 3] = h.merged(parts[n % 3], h.wrapped(h.parsed(tagged_page(n))))
    whole = h.merged(h.merged(parts[2], parts[0]), parts[1])
    assert [h.Reader(whole).article(tagged_page(n)) for n in range(60)] == [tagged_text(n) for n in range(60)]


def test_one_page_larger_than_a_wrapper(monkeypatch):
    monkeypatch.setattr(h, "MOST_NODES", 20)
    page = tagged_page(1)
    assert h.size_of(h.merged(None, h.wrapped(h.parsed(page)))) <= 20
    assert read_together([page])[0].startswith(tagged_text(1))


def test_names_drop_only_what_they_say():
    inner = "<p>one</p><p>two</p>"
    for page in (
        f"<html class=has-menu><body class='no-sidebar'><article>{inner}</article></body></html>",
        f"<body id=header><div class='content with-sidebar'><article>{inner}</article></div></body>",
        f"<article class='post has-comments'>{inner}</article>",
        f"<main class='skip-target'>{inner}</main>",
        f"<body><div class='content with-sidebar'>{inner}</div></body>",
        f"<div class=page-with-sidebar><div class=post>{inner}</div></div>",
        f"<div class=menu-open>{inner}</div>",
        f"<div class=overlay><div class=content-sidebar><article>{inner}</article></div></div>",
        f"<article>{inner}<div class='comments-area'>x</div><div id=ad-300x250>x</div><div class=sidebar>x</div></article>",
        f"<article>{inner}</article><div class=comments><article><p>Nice</p></article><article class=comment>x</article></div>",
        f"<article>{inner}</article><div class=sidebar><article>See also</article></div><article class=comment>x</article>",
    ):
        assert read_together([page]) == ["one\ntwo"], page


def test_copies_of_one_page_make_no_template():
    for inner in ("<h1>T</h1><p>one paragraph</p>", "<p>one paragraph</p>"):
        expected = "\n".join(re.findall(r">([^<]+)<", inner))
        for page in (f"<article>{inner}</article>", f"<body><div class=post>{inner}</div></body>"):
            for copies in (1, 4, 5, 30):
                assert read_together([page] * copies) == [expected] * copies
    pages = [plain_page(n) for n in range(6) for _ in range(3)]
    assert read_together(pages) == [plain_text(n) for n in range(6) for _ in range(3)]
    empty = [f"<body><article></article><div><p>Story {n}</p><p>End {n}</p></div></body>" for n in range(6)]
    assert read_together(empty) == [f"Story {n}\nEnd {n}" for n in range(6)]


def test_copies_in_several_tasks_make_no_template():
    page = "<body><div class=post><h1>T</h1><p>one paragraph</p></div></body>"
    parts = [h.json.loads(h.json.dumps(h.wrapped(h.parsed(page)))) for _ in range(8)]
    wrapper = None
    for part in parts:
        wrapper = h.merged(wrapper, part)
    assert wrapper[h.PAGES] == 8 and h.Reader(wrapper).article(page) == "T\none paragraph"
