"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free expression over a host's markup: elements in order,
some optional, some repeated groups, with text slots. It starts as one page and
is aligned with the next ones, level by level. Where both have the element, it
is aligned further down; an element only one side has becomes optional; equal
neighbours, or equal runs of neighbours, fold into one repeated group; and texts
that differ make a slot, while equal ones stay template text.

What is read off a wrapper: the article is its `article` or `main` part, or else
the smallest element that holds all texts that are neither template nor links.
From that region come all texts but those of elements whose names say menu,
header, footer, sidebar, notice, advert, form or comments; without an article
element template texts and lists of links go too. Copies of a page make no
template: pages of different texts are counted.

Every page of a host takes part. Each task aligns its own pages to one wrapper
per host; these are aligned with each other in two more steps, so a host with
very many pages is spread. A wrapper that grows too large folds its rarest
elements into rests. A page is read again with its host's wrapper; what the
wrapper doesn't know is judged by its names and links alone.

Cases: null, empty or text-less html gives an empty text; pages without a host
form one group; equal rows are treated alike; rows without id as well; an empty
table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import Scratch, small_batches
from tallyline.llm.url_filter import url_parts

# Template text is known as such from this many pages on; copies of a page count once.
LEAST_PAGES = 5
# A wrapper of more elements than this folds its rarest ones into rests.
MOST_NODES = 4096
# Hosts whose wrappers a task holds before handing them on.
HOSTS_HELD = 1000
SALTS = 32
# Longest run of neighbours that folds into a repeated group.
LONGEST_GROUP = 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var label".split()
)
# Elements whose start closes an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
               "th": ("td", "th"), "option": ("option",)}
# An implied end doesn't reach out of these.
SCOPES = frozenset("ul ol dl table article section div main aside nav body html select blockquote".split())
NEVER_TEXT = "script|style|noscript|template|textarea|title|iframe"
DROPPED_TAGS = frozenset(
    "nav header footer aside form menu button dialog fieldset select svg math object canvas audio video".split()
)
# Names tell nothing of these; an article element needs the word itself as its name.
WHOLE_PAGE = frozenset(("html", "body", "main"))
# Some sites put the whole page into one of these.
AROUND_ALL = frozenset(("form", "fieldset"))
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menus header masthead footer sidebar aside cookie cookies consent notice notices alert newsletter subscribe "
    "subscription share sharing social comment comments commentlist disqus respond replies related recommended "
    "breadcrumb breadcrumbs pagination pager popup modal overlay login signup search widget toolbar copyright skip".split()
)
# Names with one of these say what a page has or does, not what the element is.
STATES = frozenset("no not non with without has have is hide hides show shows".split())
# Last words of names that leave it to the word before.
HOLDERS = frozenset("slot box bar list item unit inner section area".split())
# What an element of these names holds is no main article, even in article elements.
REPLIES = frozenset("comment comments commentlist disqus respond replies related recommended".split())
ASIDES = frozenset("sidebar aside footer".split())
ARTICLE_NAMES = frozenset(
    "article-body article-content article-text post-content post-body entry-content story-body main-content".split()
)

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({NEVER_TEXT})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME = re.compile(r"[a-z][a-z_-]{0,30}")


class Node:
    """An element of a page: its key, what it is for, and texts and elements in order."""

    __slots__ = ("children", "dropped", "key", "links", "own", "tag")

    def __init__(self, tag: str, key: str, dropped: int):
        self.tag, self.key, self.dropped = tag, key, dropped
        self.children: list[Node | str] = []
        self.links = 0
        self.own: list | None = None

    def inner(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and not c.dropped]


# Why an element is outside the article: for what it is, or for its name or as
# something around the whole page, which an article element inside it outweighs.
BY_NAME, FIRMLY = 1, 2


def role_of(name: str) -> str:
    """What a class or id says the element is: its last word."""
    words = [w for w in re.split(r"[-_\d]+", name) if len(w) > 1]
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    return words[-1] if words and not STATES.intersection(words) else ""


def described(tag: str, attributes: str) -> tuple[str, int]:
    """An element's key, from its tag and names, and whether these put it outside the article."""
    by_tag = (BY_NAME if tag in AROUND_ALL else FIRMLY) if tag in DROPPED_TAGS else 0
    if not attributes.strip(" /\n\t"):
        return tag, by_tag
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    said = set(names) if tag == "article" else set() if tag in WHOLE_PAGE else set(map(role_of, names))
    said &= DROPPED_WORDS
    role = found.get("role", "").lower()
    hidden = found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    hidden = hidden or bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "", attributes)))
    firmly = role in DROPPED_ROLES or hidden or bool(said & REPLIES or said & ASIDES & set(names))
    dropped = FIRMLY if firmly else by_tag or (BY_NAME if said else 0)
    kept = sorted({n for n in names if NAME.fullmatch(n)})
    article = role == "main" or found.get("itemprop") == "articleBody" or any(n in ARTICLE_NAMES for n in names)
    return ".".join([tag, *kept]) + ("!" if article else ""), dropped


def parsed(html: str) -> Node:
    """The tree of block elements; inline elements melt into the text around them."""
    root = Node("", "", 0)
    stack = [root]
    link = 0

    def close(tags, scope=True) -> None:
        for n in range(len(stack) - 1, 0, -1):
            if stack[n].tag in tags:
                del stack[n:]
                return
            if scope and stack[n].tag in SCOPES:
                return

    for m in TOKEN.finditer(html):
        text = m[5]
        if text is not None:
            top = stack[-1]
            decoded = unescape(text) if "&" in text else text
            if top.children and isinstance(top.children[-1], str):
                top.children[-1] += decoded
            else:
                top.children.append(decoded)
            if link:
                top.links += len(decoded)
            continue
        if m[3] is None:
            if m[1]:  # a cut-out element parts the words around it
                if stack[-1].children and isinstance(stack[-1].children[-1], str) and m[1].lower() not in ("script", "style"):
                    stack[-1].children[-1] += " "
            continue
        tag, ends = m[3].lower(), bool(m[2])
        if tag == "a":
            link = 0 if ends else 1
        if ends:
            if tag in INLINE and not any(n.tag == tag for n in stack):
                continue
            close((tag,), scope=tag == "p" or tag in CLOSES_SAME)
            continue
        if tag == "br":
            if stack[-1].children and isinstance(stack[-1].children[-1], str):
                stack[-1].children[-1] += " "
            continue
        if tag in VOID and tag != "hr":
            continue
        key, dropped = described(tag, m[4])
        if tag in INLINE and not dropped:
            continue
        if tag in CLOSES_P:
            close(("p",))
        if tag in CLOSES_SAME:
            close(CLOSES_SAME[tag])
        node = Node(tag, key, dropped)
        stack[-1].children.append(node)
        if is_article(key) and not dropped and all(around.dropped != FIRMLY for around in stack):
            for around in stack:
                around.dropped = 0
        if tag != "hr" and not m[4].endswith("/"):
            stack.append(node)
    return root


# A wrapper element is a list: key, pages it is in, repeated or not, template text
# (its checksum; None before any text; "*" for a slot), characters in slots, of
# these in links, its elements, and checksums of the different pages it is in (none
# before a page is counted, None from LEAST_PAGES pages on).
KEY, PAGES, REPEATED, TEXT, CHARS, LINKS, CHILDREN, SEEN = range(8)
# Keys of rests, by the kind of article in them: the last elements of their parent,
# each a slot that stands for rare elements. No element of a page has such a key.
RESTS = ("*", "main.*", "article.*")


def text_of(node: Node) -> str:
    return " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())


def wrapped(node: Node) -> list:
    """The wrapper of one page's element; that of the whole page is counted as one page."""
    if node.own is None:
        text = text_of(node)
        below = folded([wrapped(c) for c in node.inner()])
        node.own = [node.key, 1, 0, crc32(text.encode()) if text else None, len(text), node.links, below, []]
        if not node.tag:
            counted(node.own, [checksum(node)])
    return node.own


def checksum(node: Node, start: int = 0) -> int:
    """Of an element's texts, but for those in dropped elements."""
    start = crc32(f"{text_of(node)}\n".encode(errors="replace"), start)
    for c in node.inner():
        start = checksum(c, start)
    return start


def counted(element: list, seen: list[int]) -> None:
    element[SEEN] = seen
    for e in element[CHILDREN]:
        counted(e, seen)


def all_seen(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return None
    if a == b:
        return a
    both = sorted({*a, *b})
    return both if len(both) < LEAST_PAGES else None


def paths(element: list, depth: int = 3) -> set[str]:
    """Keys on the ways down from an element."""
    found = set()
    for e in element[CHILDREN]:
        if e[KEY] in RESTS:
            continue
        found.add(e[KEY])
        if depth > 1 and e[CHILDREN]:
            found |= {f"{e[KEY]}>{p}" for p in paths(e, depth - 1)}
    return found


def likeness(a: list, b: list) -> float:
    """0 for elements of different keys, else 1 and the share of common paths inside."""
    if a[KEY] != b[KEY]:
        return 0.0
    x, y = paths(a), paths(b)
    if not x and not y:
        return 2.0
    return 1 + len(x & y) / len(x | y)


def alike(a: list, b: list) -> bool:
    return likeness(a, b) > 1.5


def folded(elements: list[list]) -> list[list]:
    """Like neighbours as one repeated element, then like runs of neighbours as one repeated group."""
    out: list[list] = []
    for e in elements:
        if out and alike(out[-1], e):
            out[-1] = joined(out[-1], e, same_page=True)
        else:
            out.append(e)
    for length in range(2, LONGEST_GROUP + 1):
        at = 0
        while at + 2 * length <= len(out):
            first, second = out[at : at + length], out[at + length : at + 2 * length]
            if all(map(alike, first, second)):
                out[at : at + 2 * length] = [joined(a, b, same_page=True) for a, b in zip(first, second)]
            else:
                at += 1
    return out


def joined(a: list, b: list, same_page: bool = False) -> list:
    """One element for both: texts that differ become a slot, elements are aligned.

    Different texts of one page are template together while all pages have them so.
    """
    text = a[TEXT] if a[TEXT] == b[TEXT] or b[TEXT] is None else b[TEXT] if a[TEXT] is None else "*"
    pages, repeated = a[PAGES] + b[PAGES], a[REPEATED] | b[REPEATED]
    if same_page:
        if text == "*" and a[TEXT] != "*" and b[TEXT] != "*":
            text = crc32(f"{a[TEXT]} {b[TEXT]}".encode())
        pages, repeated = max(a[PAGES], b[PAGES]), 1
    below = aligned(a[CHILDREN], b[CHILDREN], same_page)
    return [a[KEY], pages, repeated, text, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], below, all_seen(a[SEEN], b[SEEN])]


def matches(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """The alignment of two lists of elements with the greatest likeness, as index pairs."""
    if len(a) == len(b) and all(map(alike, a, b)):
        return [(i, i) for i in range(len(a))]
    like = [[likeness(x, y) for y in b] for x in a]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            both = best[i + 1][j + 1] + like[i][j] if like[i][j] else 0.0
            best[i][j] = max(best[i + 1][j], best[i][j + 1], both)
    found, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if like[i][j] and best[i][j] == best[i + 1][j + 1] + like[i][j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return found


def aligned(a: list[list], b: list[list], same_page: bool = False) -> list[list]:
    """Elements of both sides in order; those of one side only are in fewer pages, so optional. Rests stay last."""
    if any(side and side[-1][KEY] in RESTS for side in (a, b)):
        rests: dict[str, list] = {}
        for e in a + b:
            if e[KEY] in RESTS:
                rests[e[KEY]] = joined(rests[e[KEY]], e) if e[KEY] in rests else e
        a, b = ([e for e in side if e[KEY] not in RESTS] for side in (a, b))
        return aligned(a, b, same_page) + [rests[key] for key in RESTS if key in rests]
    out, i, j = [], 0, 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        out += a[i:x] + b[j:y]
        if x < len(a) and y < len(b):
            out.append(joined(a[x], b[y], same_page))
        i, j = x + 1, y + 1
    return out


def size_of(wrapper: list) -> int:
    """Elements of a wrapper, without rests."""
    return (wrapper[KEY] not in RESTS) + sum(map(size_of, wrapper[CHILDREN]))


def merged(wrapper: list | None, other: list) -> list:
    both = other if wrapper is None else joined(wrapper, other)
    return compacted(both) if size_of(both) > MOST_NODES else both


def compacted(wrapper: list) -> list:
    """The wrapper with its rarest elements, the deepest of them first, folded into rests.

    All pages go on counting: what is on many pages stays whatever page it came
    with, and a rest still says that its parent has text of its own there, and
    the strongest kind of article. So texts of rare elements are never taken for
    template or left out of the region.
    """
    ranks: list[tuple[int, int]] = []

    def rank(element: list, depth: int) -> None:
        ranks.append((element[PAGES], -depth))
        for e in element[CHILDREN]:
            if e[KEY] not in RESTS:
                rank(e, depth + 1)

    def fold(element: list, depth: int) -> list:
        kept, rests = [], {}
        for e in element[CHILDREN]:
            if e[KEY] not in RESTS and (e[PAGES], -depth - 1) > rarest:
                kept.append(fold(e, depth + 1))
                continue
            key = RESTS[article_kind(e)]
            pages, chars = rests.get(key, (0, 0))
            rests[key] = max(pages, e[PAGES]), chars + kept_chars(e)
        kept += [[key, rests[key][0], 1, "*", rests[key][1], 0, [], []] for key in RESTS if key in rests]
        return [*element[:CHILDREN], kept, element[SEEN]]

    rank(wrapper, 0)
    rarest = sorted(ranks, reverse=True)[MOST_NODES // 2]
    return fold(wrapper, 0)


def kept_chars(element: list) -> int:
    """Characters of an element's texts that are not mostly links."""
    own = element[CHARS] if element[LINKS] * 2 <= element[CHARS] else 0
    return own + sum(map(kept_chars, element[CHILDREN]))


def keeps(element: list) -> bool:
    """Whether the element, or one below it, has text that is neither template nor mostly links."""
    return bool(element[CHARS]) and not is_template(element) or any(map(keeps, element[CHILDREN]))


def is_article(key: str) -> int:
    """2 for an article, 1 for a main part."""
    tag = key.split(".")[0].rstrip("!")
    return 2 if tag == "article" or (key.endswith("!") and tag != "main") else 1 if tag == "main" or key.endswith("!") else 0


def has_text(element: list) -> bool:
    return bool(element[CHARS]) or element[KEY] in RESTS or any(map(has_text, element[CHILDREN]))


def article_kind(wrapper: list) -> int:
    """The strongest kind of article element in the wrapper that holds text."""
    own = is_article(wrapper[KEY])
    return max([own if own and has_text(wrapper) else 0, *map(article_kind, wrapper[CHILDREN])])


def region_of(wrapper: list) -> tuple[int, ...]:
    """Places, from the root, of the smallest element that holds all text that is not template or links."""
    path: list[int] = []
    while not wrapper[CHARS] or is_template(wrapper):
        holding = [place for place, e in enumerate(wrapper[CHILDREN]) if keeps(e)]
        if len(holding) != 1 or not wrapper[CHILDREN][holding[0]][CHILDREN]:
            break
        path += holding
        wrapper = wrapper[CHILDREN][holding[0]]
    return tuple(path)


def is_template(element: list) -> bool:
    """The same text on all of several different pages, or mostly links."""
    if element[CHARS] and element[LINKS] * 2 > element[CHARS]:
        return True
    return element[SEEN] is None and element[TEXT] not in (None, "*")


class Reader:
    """Takes the article out of pages of one host."""

    def __init__(self, wrapper: list):
        self.wrapper = wrapper
        self.kind = article_kind(wrapper)
        self.region = () if self.kind else region_of(wrapper)

    def article(self, html: str) -> str:
        root = parsed(html)
        blocks: list[str] = []
        found = self.articles(root, self.kind) if self.kind else []
        for node in found:
            self.collect(node, None, blocks)
        if not found:
            for node, known in self.in_region(root):
                self.collect(node, known, blocks)
        return "\n".join(blocks)

    def articles(self, node: Node, kind: int) -> list[Node]:
        """The outermost elements of the kind, in page order."""
        out = []
        for c in node.inner():
            out += [c] if is_article(c.key) == kind else self.articles(c, kind)
        return out

    def in_region(self, root: Node) -> list[tuple[Node, list]]:
        """The page's elements that the wrapper has as its region; the whole page if there is none."""
        level = [(root, self.wrapper)]
        for place in self.region:
            level = [
                (c, known[CHILDREN][place])
                for node, known in level
                for c, e in placed(node, known)
                if e is known[CHILDREN][place]
            ]
        return level or [(root, self.wrapper)]

    def collect(self, node: Node, known: list | None, blocks: list[str]) -> None:
        """Blocks of text below `node`; `known` is its wrapper element where template texts are left out."""
        of = {id(c): e for c, e in placed(node, known)} if known is not None else {}
        template = known is not None and is_template(known)
        for c in node.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                if text and not template:
                    blocks.append(text)
            elif not c.dropped:
                self.collect(c, of.get(id(c)) or (wrapped(c) if known is not None else None), blocks)


def placed(node: Node, known: list) -> list[tuple[Node, list]]:
    """The elements inside `node` that the wrapper knows, with its elements."""
    runs: list[list[Node]] = []
    for c in node.inner():
        if runs and alike(wrapped(runs[-1][-1]), wrapped(c)):
            runs[-1].append(c)
        else:
            runs.append([c])
    firsts = [wrapped(run[0]) for run in runs]
    return [(c, known[CHILDREN][a]) for a, b in matches(known[CHILDREN], firsts) for c in runs[b]]


def page_wrappers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, salt, wrapper): one per host from a task's pages."""
    from pyspark import TaskContext

    salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % SALTS
    held: dict[str, list] = {}

    def hand_on() -> pd.DataFrame:
        out = [(host, salt, json.dumps(w)) for host, w in held.items()]
        held.clear()
        return pd.DataFrame(out, columns=["host", "salt", "wrapper"])

    for batch in batches:
        for host, html in zip(batch["host"], batch["html"], strict=True):
            if html:
                held[host] = merged(held.get(host), wrapped(parsed(html)))
            if len(held) > HOSTS_HELD:
                yield hand_on()
    yield hand_on()


def one_wrapper(rows: pd.DataFrame) -> pd.DataFrame:
    wrapper = None
    for text in sorted(rows["wrapper"]):
        wrapper = merged(wrapper, json.loads(text))
    return rows.head(1).assign(wrapper=json.dumps(wrapper))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of every host, from all of its pages (host, html)."""
    schema = "host string, salt int, wrapper string"
    parts = pages.select("host", "html").mapInPandas(page_wrappers, schema)
    salted = parts.groupBy("host", "salt").applyInPandas(one_wrapper, schema)
    return salted.groupBy("host").applyInPandas(one_wrapper, schema).select("host", "wrapper")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    url = small_batches(pages).select("page_id", F.col("url").alias("shown"), F.coalesce("url", F.lit("")).alias("url"), "html")
    host, _ = url_parts(F.col("url"))
    rows = url.select("page_id", F.col("shown").alias("url"), host.alias("host"), "html")
    known = scratch.keep(wrappers(rows), "wrappers")

    @F.pandas_udf("string")
    def article(htmls: pd.Series, texts: pd.Series) -> pd.Series:
        readers: dict[str | None, Reader] = {}
        out = []
        for html, text in zip(htmls, texts, strict=True):
            if not html:
                out.append("")
                continue
            if text not in readers:
                if len(readers) > HOSTS_HELD:
                    readers.clear()
                readers[text] = Reader(json.loads(text) if text else wrapped(parsed(html)))
            out.append(readers[text].article(html))
        return pd.Series(out, dtype=object)

    joined_rows = rows.join(known, "host", "left")
    return joined_rows.select("page_id", "url", article("html", "wrapper").alias("text"))
