"""Redaction: every pattern, its limits, key words, nesting."""

from __future__ import annotations

import json

import pytest

from pyspark.sql import functions as F

from tallyline.operators import redact

X16, X20, X32 = "a" * 16, "b" * 20, "c1" * 16
CLOUD = "AKIA" + "ABCDEFGH12345678"
LIVE = "sk_" + "live_" + "d" * 24
SK = "sk-" + X32
PAT = "ghp_" + "e" * 36
PEM = "-----BEGIN EC " + "PRIVATE KEY-----"
MAIL = "ann.lee+x@mail.example.org"


def apply(spark, text, style):
    return redact.redact_columns(spark.createDataFrame([(text,)], "text string"), ["text"], style).collect()[0].text


@pytest.mark.parametrize(
    "text, expected",
    [
        (f"my_key={X16}", "[REDACTED_KEY]"),
        (f"MY_KEY : '{X16}' rest", "[REDACTED_KEY] rest"),
        (f"my_key={'a' * 15}", f"my_key={'a' * 15}"),
        (f"_key={X16}", f"_key={X16}"),
        (f"auth_token = {X16}", "[REDACTED_TOKEN]"),
        (f'client_secret="{X16}"', "[REDACTED_SECRET]"),
        (SK, "[REDACTED_SK]"),
        (SK[:-1], SK[:-1]),
        (f"write to {MAIL}, or not", "write to [REDACTED_EMAIL], or not"),
        ("a@b.c", "a@b.c"),
        (f"{MAIL} {MAIL}", "[REDACTED_EMAIL] [REDACTED_EMAIL]"),
        ("", ""),
    ],
)
def test_typed(spark, text, expected):
    assert apply(spark, text, "typed") == expected


@pytest.mark.parametrize("secret", [CLOUD, LIVE, SK, PAT, PEM, f"x_key={X20}", f"x_token: {X20}", f"x_secret='{X20}'"])
def test_inline(spark, secret):
    assert apply(spark, f"before {secret} after", "inline") == "before [REDACTED] after"


def test_inline_leaves_mail(spark):
    assert apply(spark, MAIL, "inline") == MAIL


@pytest.mark.parametrize("secret", [CLOUD, LIVE, SK, PAT, PEM, MAIL])
def test_whole_value(spark, secret):
    assert apply(spark, f"before {secret} after", "whole") == "[REDACTED]"
    assert apply(spark, "nothing here", "whole") == "nothing here"


def test_pattern_list_and_extension(spark):
    assert apply(spark, f"{MAIL} {'f' * 24} {'f' * 23}", "list") == f"[REDACTED_EMAIL] [REDACTED_TOKEN] {'f' * 23}"
    df = spark.createDataFrame([("room 12",)], "text string")
    own = [("room", r"room \d+", "$room")]
    assert df.select(redact.redact_text(F.col("text"), "list", own)).collect()[0][0] == "$room"


def test_hits_count_what_is_left(spark):
    df = spark.createDataFrame([(1, f"a_key={X16} b_key={X16} {MAIL}"), (2, "clean")], "id int, text string")
    hits = {(r.id, r.pattern): r.hits for r in redact.redact_hits(df, ["id"], "text").collect()}
    assert hits == {(1, "key"): 2, (1, "email"): 1}


def test_typed_rows_by_name(spark):
    schema = "id int, Api_Key string, note string, who struct<name:string, passwordHash:string>, tags map<string,string>, list array<string>"
    row = (1, "x", f"mail {MAIL}", ("ann", "h"), {"secret_tag": "v", "ok": "v", "m": MAIL}, ["a", MAIL])
    out = redact.redact_row(spark.createDataFrame([row], schema)).collect()[0].asDict(recursive=True)
    assert out == {
        "id": 1,
        "Api_Key": "[REDACTED]",
        "note": "[REDACTED]",
        "who": {"name": "ann", "passwordHash": "[REDACTED]"},
        "tags": {"secret_tag": "[REDACTED]", "ok": "v", "m": "[REDACTED]"},
        "list": ["a", "[REDACTED]"],
    }


def test_payload_keys_at_any_depth(spark):
    payload = {"a": {"accessToken": {"x": 1}, "list": [{"AWS_SECRET_ID": 1}, MAIL, 2, None, True]}, "plain": "é"}
    df = spark.createDataFrame([(json.dumps(payload),), (None,), ('"' + MAIL + '"',)], "p string")
    out = [r[0] for r in df.select(redact.redact_payloads(F.col("p"))).collect()]
    assert json.loads(out[0]) == {
        "a": {"accessToken": "[REDACTED]", "list": [{"AWS_SECRET_ID": "[REDACTED]"}, "[REDACTED]", 2, None, True]},
        "plain": "é",
    }
    assert out[1] is None and out[2] == '"[REDACTED]"'


def test_values_of_any_type_under_sensitive_names(spark):
    rows = spark.range(1).selectExpr(
        "map('token', 5, 'n', 7) AS a", "map('k', named_struct('password', 'x', 'n', 1)) AS b", "map('password', array('x')) AS c",
        "parse_json('{\"password\":{\"x\":1},\"n\":2}') AS d", "array(parse_json('{\"secret\":1}')) AS e", "map(1, 'no') AS f",
    )
    out = redact.redact_row(rows)
    row = out.selectExpr("a", "b", "c", "to_json(d) AS d", "to_json(e) AS e", "f").collect()[0]
    assert row.a == {"token": "[REDACTED]", "n": "7"}
    assert row.b == {"k": '{"password":"[REDACTED]","n":1}'}
    assert row.c == {"password": "[REDACTED]"}
    assert json.loads(row.d) == {"password": "[REDACTED]", "n": 2}
    assert json.loads(row.e) == [{"secret": "[REDACTED]"}] and row.f == {1: "no"}


def test_payloads_that_are_not_json(spark):
    texts = ['{"token": "x"', "plain text", '{"a": 1}', None, '{"p\\u0061ssword":"x"}', f"broken {SK}", "[" * 100_000 + "token"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    out = [r.t for r in df.select("n", redact.redact_payloads(F.col("t")).alias("t")).orderBy("n").collect()]
    assert out == ["[REDACTED]", "plain text", '{"a": 1}', None, '{"password":"[REDACTED]"}', "[REDACTED]", "[REDACTED]"]


def test_extra_patterns(spark):
    df = spark.createDataFrame([(f"{MAIL} order 77-88",)], "text string")
    out = redact.redact_columns(df, ["text"], "typed", [("order", r"\d{2}-\d{2}", "[ORDER]")])
    assert out.collect()[0].text == "[REDACTED_EMAIL] order [ORDER]"
