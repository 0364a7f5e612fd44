"""Arrays of any size against a parser that reads the whole file."""

from __future__ import annotations

import json
import random

import pytest

from tallyline.sources import billing as files
from tallyline.sources import json_array

WORDS = ["plain", 'a "quoted" word', "}{][,", "\\", '\\"}', "é中😀", "line\nbreak", "", "ends in \\\\", '"', "}", "{", "tab\t", "\\u007d"]


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind < 3:
        return rng.choice(WORDS)
    if kind < 6:
        return rng.choice([1, -2.5, True, None, 10**12, {}, []])
    if kind < 8:
        return {rng.choice(WORDS) + str(n): value(rng, depth + 1) for n in range(rng.randrange(4))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


def written(rng, items):
    style = rng.choice([{}, {"indent": 1}, {"separators": (" , ", " : ")}, {"separators": (",", ":")}, {"ensure_ascii": False}])
    text = json.dumps(items, **style)
    return rng.choice(["", " ", "\n\r\t"]) + text + rng.choice(["", "\n", "  \n"])


KEY = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def blocks_of(spark, monkeypatch):
    """Lets the exports be scanned in blocks of so many bytes; the tables written on the way are read as ever."""

    def limit(size):
        scan, before = json_array.pieces, spark.conf.get(KEY)

        def pieces(*args):
            spark.conf.set(KEY, str(size))
            try:
                return scan(*args)
            finally:
                spark.conf.set(KEY, before)

        if size:
            monkeypatch.setattr(json_array, "pieces", pieces)

    return limit


def read(spark, folder):
    """Elements by file in order, and rejected files with their error."""
    rows = files.read_raw(spark, str(folder), "t", "p", "array").orderBy("ingest_seq").collect()
    names = sorted(f.name for f in folder.iterdir())
    found, errors = {}, {}
    for r in rows:
        if r.file_error:
            errors[r.raw.rsplit("/", 1)[1]] = r.file_error
        else:
            found.setdefault(names[r.ingest_seq >> files.FILE_PLACES], []).append(json.loads(r.raw))
    assert len({r.ingest_seq for r in rows}) == len(rows)
    return found, errors


def plain(items):
    """Numbers as the variant type keeps them."""
    return json.loads(json.dumps(items))


@pytest.mark.parametrize("block", [None, 150, 2000])
def test_equals_a_whole_parse(spark, tmp_path, blocks_of, block):
    blocks_of(block)
    rng = random.Random(block)
    expected = {}
    for n in range(6):
        items = [value(rng) for _ in range(rng.choice([0, 1, 2, 40]))]
        if n % 3 == 0:
            items = [{"event_id": f"e{k}", "text": rng.choice(WORDS), "inner": value(rng)} for k in range(40)]
        (tmp_path / f"f{n:02d}.json").write_text(written(rng, items), encoding="utf-8")
        if items:
            expected[f"f{n:02d}.json"] = plain(items)
    found, errors = read(spark, tmp_path)
    assert errors == {}
    assert found == expected


BROKEN = {
    "cut_in_string": '[{"a": "x',
    "cut_in_object": '[{"a": 1}, {"b": 2',
    "no_end": '[{"a": 1}',
    "no_end_number": "[1, 2",
    "comma_at_end": '[{"a": 1},]',
    "comma_first": '[,{"a": 1}]',
    "two_commas": '[{"a": 1},,{"b": 2}]',
    "no_comma": '[{"a": 1} {"b": 2}]',
    "colon": '[{"a" 1}]',
    "two_arrays": '[{"a": 1}][{"b": 2}]',
    "closed_twice": '[{"a": 1}]]',
    "rest": '[{"a": 1}] x',
    "rest_comma": '[{"a": 1}],',
    "brackets": '[{"a": [1}]]',
    "reopened": '[{"a": 1}],[{"b": 2}]',
    "empty": "",
    "blank": " \n ",
    "words": "no json",
    "object_cut": '{"a": {"b": 1}',
    "object_words": '{"a" 1}',
    "late": json.dumps([{"a": n} for n in range(300)])[:-1] + ', {"a" 1}]',
}
OTHER = {"object": '{"a": {"b": 1}}', "number": "42", "string": '"[1]"', "null": " null ", "object_open": '{"a": [{"b": 1}], "c": 2 }\n'}
GOOD = {"nothing": "[]", "spaces": " [ \n ] ", "scalars": '[1, "}", null, [2, {}], "]"]', "one": '[{"a": "}]"}]', "nested": '[[{"a": 1}], {"b": [{"c": {}}]}, 3]'}


@pytest.mark.parametrize("block", [None, 9])
def test_odd_files(spark, tmp_path, blocks_of, block):
    blocks_of(block)
    for name, text in (BROKEN | OTHER | GOOD).items():
        (tmp_path / name).write_text(text)
    for name, text in BROKEN.items():
        with pytest.raises(ValueError):
            json.loads(text)
    found, errors = read(spark, tmp_path)
    assert errors == {n: json_array.NOT_JSON for n in BROKEN} | {n: json_array.NOT_ARRAY for n in OTHER}
    assert found == {n: json.loads(t) for n, t in GOOD.items() if json.loads(t)}


def test_many_files_take_the_salted_joins(spark, tmp_path, blocks_of, monkeypatch):
    blocks_of(100)
    monkeypatch.setattr(json_array, "MOST_FILES", 0)
    for n in range(5):
        (tmp_path / f"{n}.json").write_text(json.dumps([{"a": k, "b": {"n": n}} for k in range(30)]))
    (tmp_path / "x.json").write_text("[1")
    found, errors = read(spark, tmp_path)
    assert errors == {"x.json": json_array.NOT_JSON}
    assert found == {f"{n}.json": [{"a": k, "b": {"n": n}} for k in range(30)] for n in range(5)}


def test_one_file_is_many_tasks(spark, tmp_path, blocks_of):
    """A single large array: read in many tasks, equal to the line layout."""
    records = [{"event_id": f"evt_{n}", "metadata": {"note": WORDS[n % len(WORDS)]}} for n in range(10_000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.json").write_text(json.dumps(records))
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, records)))
    blocks_of(64_000)
    assert json_array.pieces(spark, str(tmp_path / "in")).select("block").distinct().count() >= 8
    array = files.read_raw(spark, str(tmp_path / "in"), "t", "p", "array").orderBy("ingest_seq").select("raw").collect()
    lines = files.read_raw(spark, str(tmp_path / "lines.jsonl"), "t", "p", "lines").orderBy("ingest_seq").select("raw").collect()
    assert [json.loads(r.raw) for r in array] == [json.loads(r.raw) for r in lines] == records


def test_large_files_of_another_kind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_array, "PARSED_WHOLE", 3)
    (tmp_path / "a").write_text('{"a": 1}')
    (tmp_path / "b").write_text("{}")
    assert read(spark, tmp_path)[1] == {"a": json_array.NOT_ARRAY, "b": json_array.NOT_ARRAY}
