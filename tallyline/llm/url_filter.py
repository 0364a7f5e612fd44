"""URL filter: rules indexed by their rarest literal token.

A rule is a regular expression with a verdict. It is found through one token (a
run of ASCII letters and digits) that every URL it matches must contain: of its
literal tokens the one in the fewest URLs of the whole table. The tokens of a
URL fetch the rules worth trying, and only those run. Rules without a literal
token are tried on every URL.

Host rules (`net/`, `example.com/de/`) fit a host and its subdomains when the
path starts with the rule's; the longest that fits wins. They are rules of the
same index. If none fits, a URL is blocked when a pattern rule matches.

Cases: a null URL, or one without `://`, has an empty host and path; equal rows
are judged alike; an empty table gives an empty result; rows without id are
judged like any other. Only the id and URL columns are read.

The rules are a parameter, held by every task: at most `MOST_RULES` of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import Scratch

MOST_RULES = 200_000
TOKEN = re.compile("[A-Za-z0-9]+")


class Rule(NamedTuple):
    """`pattern` is searched in host + path + query; `tokens` are in every match. `name` only for host rules."""

    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    name: str | None = None


def literal_tokens(literal: str, open_start: bool, open_end: bool) -> tuple[str, ...]:
    """Tokens that a URL with `literal` in it has whole; those at an open end may go on."""
    found = []
    for m in TOKEN.finditer(literal):
        if not (open_start and m.start() == 0) and not (open_end and m.end() == len(literal)):
            found.append(m.group().lower())
    return tuple(dict.fromkeys(found))


def host_rule(name: str, verdict: str) -> Rule:
    """A rule `host/path`: for the host and all below it, and paths that start with the rule's."""
    host, slash, path = name.partition("/")
    pattern = rf"\A(?:[^/?#]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}"
    return Rule(pattern, verdict, literal_tokens(host.lower() + slash + path, False, True), name)


def pattern_rule(text: str, verdict: str = "block") -> Rule:
    """A rule of literals and `*`: `||` binds it to the start of a host name, `^` is any separator or the end."""
    anchored = text.startswith("||")
    body = text[2:] if anchored else text
    regex, tokens = (r"\A(?:[^/?#]*\.)?" if anchored else ""), []
    parts = re.split(r"([*^])", body)
    for n, part in enumerate(parts):
        if part == "*":
            regex += ".*"
        elif part == "^":
            regex += r"(?:[^A-Za-z0-9_.%-]|\Z)"
        elif part:
            # an open end touches a wildcard or the pattern's own edge
            open_start = not (anchored and n == 0) if n == 0 else parts[n - 1] == "*"
            open_end = n == len(parts) - 1 or parts[n + 1] == "*"
            regex += re.escape(part)
            tokens += literal_tokens(part, open_start, open_end)
    return Rule(regex, verdict, tuple(dict.fromkeys(tokens)))


# Rules of the production query. Host rules are the contract's.
HOST_RULES = [
    host_rule("net/", "block"),
    host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"),
    host_rule("org/fr/", "allow"),
]
PATTERN_RULES = [
    pattern_rule(text)
    for text in (
        "||spam-farm.example.*^",
        "||cheap-pills.example.*^",
        "-casino.*^",
        ".casino.*^",
        "/free-download/*",
        "/wp-login.php^",
        "/ads/*/click^",
        "^doubleclick.*^",
        "/porn/",
        "||malware.*^",
    )
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, its A-Z in lower case, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, lower.upper(), lower), path


def token_counts(urls: DataFrame, wanted: Iterable[str]) -> dict[str, int]:
    """In how many URLs each wanted token is; the answer has a row per token of the rules at most."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("judged_text"), F.lit("[a-z0-9]+"), 0))
    listed = urls.sparkSession.createDataFrame([(t,) for t in sorted(wanted)], "token string")
    seen = urls.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {r["token"]: r["n"] for r in seen.join(F.broadcast(listed), "token").collect()}


def rule_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token, and those to try always."""
    by_token: dict[str, list[int]] = {}
    always: list[int] = []
    for n, rule in enumerate(rules):
        if rule.tokens:
            rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
            by_token.setdefault(rarest, []).append(n)
        else:
            always.append(n)
    return by_token, always


def judge(
    pages: DataFrame, host_rules: list[Rule] = HOST_RULES, pattern_rules: list[Rule] = PATTERN_RULES
) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, n_tried) of every row of `pages` (page_id, url)."""
    rules = [*host_rules, *pattern_rules]
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; tasks hold {MOST_RULES} at most")
    url = F.coalesce("url", F.lit(""))
    rows = pages.select("page_id", "url", url.alias("given")).withColumnRenamed("url", "shown")
    rows = rows.withColumnRenamed("given", "url")
    host, path = url_parts(F.col("url"))
    rows = rows.select("page_id", F.col("shown"), F.col("url"), host.alias("host"), path.alias("path"))
    query = F.regexp_extract("url", r"://[^/?#]*[^?#]*(\?[^#]*)", 1)
    rows = rows.withColumn("judged_text", F.concat("host", "path", query))
    by_token, always = rule_index(rules, token_counts(rows, {t for r in rules for t in r.tokens}))
    plain = [tuple(r) for r in rules]

    @F.pandas_udf("rule string, verdict string, n_tried int")
    def verdicts(texts: pd.Series) -> pd.DataFrame:
        compiled: dict[int, re.Pattern] = {}

        def fits(n: int, text: str) -> bool:
            if n not in compiled:
                compiled[n] = re.compile(plain[n][0], re.DOTALL)
            return compiled[n].search(text) is not None

        out = []
        for text in texts:
            tokens = {t.lower() for t in re.findall("[A-Za-z0-9]+", text)}
            tried = [*always, *(n for t in tokens for n in by_token.get(t, ()))]
            matched = [plain[n] for n in tried if fits(n, text)]
            named = [m for m in matched if m[3] is not None]
            if named:
                best = max(named, key=lambda m: (len(m[3]), m[3]))
                out.append((best[3], best[1], len(tried)))
            else:
                out.append((None, "block" if any(m[1] == "block" for m in matched) else "allow", len(tried)))
        return pd.DataFrame(out, columns=["rule", "verdict", "n_tried"])

    judged = rows.withColumn("found", verdicts("judged_text"))
    return judged.select("page_id", F.col("shown").alias("url"), "host", "path", "found.rule", "found.verdict", "found.n_tried")
