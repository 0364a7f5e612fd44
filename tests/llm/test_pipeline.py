"""The stages against plain Python on a small corpus, and the whole run on the test table."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from test_simhash import plain_components, plain_fingerprint
from test_suffix_dedup import brute
from tokenizers import Tokenizer

import corpus_pipeline as p
from tallyline.llm import cotraining, mixing
from tallyline.llm.common import read


def stage(name):
    return dict(p.STAGES)[name]


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, DATA, "documents")


def test_stage_names():
    assert [n for n, _ in p.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "best_fit_packing",
    ]


def test_quality_stage_keeps_what_the_classifier_keeps(spark, docs):
    out = stage("quality_classifier")(spark, docs, DATA)
    model = cotraining.trained(docs, read(spark, DATA, "labels"))
    kept = cotraining.scored(docs, model).where("quality.kept").select("doc_id").collect()
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in kept)
    assert 0.7 * docs.count() < out.count() <= docs.count()


def test_near_dedup_stage_keeps_one_of_each_group(spark, docs):
    rows = docs.collect()
    groups = plain_components([plain_fingerprint(r.text) for r in rows])
    least = {}
    for r, g in zip(rows, groups):
        least[g] = min(r.doc_id, least.get(g, r.doc_id))
    out = stage("simhash_near_dedup")(spark, docs, DATA)
    assert out.schema == docs.schema
    assert sorted(r.doc_id for r in out.collect()) == sorted(least.values())


def test_repeats_stage_cuts_texts(spark, docs):
    rows = docs.collect()
    expected = {r.doc_id: (b[3].decode("utf-8", "ignore"), r.lang, r.source) for r, b in zip(rows, brute([r.text for r in rows], 200))}
    out = stage("suffix_array_dedup")(spark, docs, DATA)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = out.collect()
    assert {r.doc_id: (r.text, r.lang, r.source) for r in got} == expected
    assert all(r.n_chars == len(r.text) for r in got)


def test_mixing_stage_repeats_rows(spark, docs):
    out = stage("source_mixing")(spark, docs, DATA)
    assert out.schema == docs.schema
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}


def test_packing_stage_holds_every_token(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            expected[(r.doc_id, n, zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()))] += 1
    out = stage("best_fit_packing")(spark, docs, DATA).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in out) == expected


def test_run(spark):
    out = p.run(spark, DATA)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(out.columns)
    rows = out.collect()
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert rows and max(filled.values()) <= 4096


def test_odd_rows_go_through_all_stages(spark, docs):
    schema = "row string, doc_id long, text string, lang string, source string, n_chars long, carried string, key string"
    odd = [
        ("r", 1, None, None, None, None, "c", "k"), ("r", 2, "", "en", "s", 0, "c", "k"), ("r", None, "no id at all", "en", "s", 1, "c", "k"),
        ("r", 3, "same", "en", None, 4, None, "k"), ("r", 3, "same", "en", None, 4, None, "k"), ("r", 4, "long " * 60_000, "en", "t", 9, "c", None),
    ]
    for rows in (odd, []):
        left = {r[1] for r in rows}
        table = spark.createDataFrame(rows, schema)
        for name, run in p.STAGES[:-1]:
            out = run(spark, table, DATA)
            assert out.columns == table.columns, name
            table = spark.createDataFrame([tuple(r) for r in out.collect()], schema)
            left -= {2} if name == "simhash_near_dedup" else set()  # without words, as the first row
            assert {r.doc_id for r in table.collect()} == left, name
        assert p.STAGES[-1][1](spark, table, DATA).count() >= len(left)
