"""The rule index against trying every rule, and URL parts and host rules against plain Python."""

from __future__ import annotations

import re

from compare import difference, oracle_connection
from conftest import DATA

from tallyline.llm import url_filter as u
from tallyline.llm.queries import ORACLES, QUERIES

SCHEMA = "page_id long, url string, html string, rule int, host string"
URLS = [
    None, "", "no scheme/path", "http://", "http://net", "https://net/", "http://A.Example.NET/en/x?q=1#f",
    "http://example.net/en", "http://example.net/de/", "http://xexample.net/en/", "https://example.com/de/1",
    "https://m.example.com/de", "http://a.org/fr/", "http://org/fr/x", "http://a.org/FR/", "ftp://org?x=/fr/",
    "http://example.net?/en/", "http://example.net#/en/", "a://b://net/", "http://É.net/x", "http://x.net:80/",
    "http://spam-farm.example.org/", "http://www.cheap-pills.example.com", "http://spam-farmx.example.org/",
    "http://a.com/free-download/x", "http://a.com/x/free-download/", "http://best-casino.com/", "http://a.com/?u=/porn/",
    "http://a.com/ads/1/2/click", "http://a.com/ads/1/clicks", "http://a.com/wp-login.php", "http://malwarebytes.com/",
    "http://x/\n?é=ü#", "http://" + "a" * 50_000 + ".net/" + "b/" * 20_000,
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        of, slash, start = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith(slash + start):
            if best is None or len(rule) > len(best[0]):
                best = rule, verdict
    return host, path, best


def test_every_url(spark):
    rows = [*enumerate(URLS), (3, URLS[3]), (None, "http://net/")]
    df = spark.createDataFrame([(a, b, "", 1, "h") for a, b in rows], SCHEMA)
    found = {(r.page_id, r.url): r for r in u.judge(df).collect()}
    assert len(found) == len(set(rows)) and u.judge(df).count() == len(rows)
    for page_id, url in rows:
        r, (host, path, best) = found[page_id, url], plain(url)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        query = re.search(r"\A[^/?#]*[^?#]*(\?[^#]*)", (url or "").partition("://")[2])
        text = host + path + (query.group(1) if query else "")
        patterns = any(re.search(p.pattern, text, re.DOTALL) for p in u.PATTERN_RULES)
        assert r.verdict == (best[1] if best else "block" if patterns else "allow"), url


def test_tokens_of_a_rule_are_in_every_match():
    assert u.host_rule("example.net/en/", "block").tokens == ("example", "net", "en")
    assert u.host_rule("example.net/en", "block").tokens == ("example", "net")
    assert u.pattern_rule("||ads.*banner^").tokens == ("ads",)
    assert u.pattern_rule("/free-download/*").tokens == ("free", "download")
    assert u.pattern_rule("banner").tokens == ()
    assert u.pattern_rule("x*y-z^").tokens == ("z",)


def test_rarest_token_and_tried_rules(spark):
    rules = [u.pattern_rule(f"/common/rare{n}/") for n in range(100)] + [u.pattern_rule("anywhere")]
    counts = {"common": 1000, **{f"rare{n}": n for n in range(100)}}
    by_token, always = u.rule_index(rules, counts)
    assert sorted(by_token) == sorted(f"rare{n}" for n in range(100)) and always == [100]
    urls = [(n, f"http://h.com/common/rare{n}/x", "", 0, "") for n in range(120)] + [(200, "http://h.com/common/anywhere", "", 0, "")]
    found = {r.page_id: r for r in u.judge(spark.createDataFrame(urls, SCHEMA), [], rules).collect()}
    assert all(found[n].verdict == ("block" if n < 100 else "allow") for n in range(120))
    assert found[200].verdict == "block" and max(r.n_tried for r in found.values()) == 2


def test_empty_table(spark):
    assert u.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_oracle(spark):
    df = QUERIES["op7_url_filter"](spark, DATA)
    assert difference(df, oracle_connection(DATA), ORACLES["op7_url_filter"]) is None
