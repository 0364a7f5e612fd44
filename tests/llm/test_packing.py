"""Packing against a plain best-fit decreasing, token ids against the tokenizer itself."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids int, length string"


def plain_best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    for length in sorted(lengths, reverse=True):
        fitting = [b for b in bins if sum(b) + length <= capacity]
        if fitting:
            max(fitting, key=sum).append(length)
        else:
            bins.append([length])
    return bins


def places(histogram, capacity):
    table = packing.run_table(packing.best_fit_decreasing(histogram, capacity))
    lengths = np.repeat(list(histogram), list(histogram.values())).astype(np.int64)
    ranks = np.concatenate([np.arange(n) for n in histogram.values()]).astype(np.int64)
    return lengths, *packing.placed(table, lengths, ranks)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=80))
def test_runs_are_best_fit_decreasing(lengths):
    lengths_out, bins, offsets = places(dict(Counter(lengths)), 40)
    filled = defaultdict(list)
    for length, bin_id, offset in zip(lengths_out, bins, offsets):
        filled[bin_id].append((offset, length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    # which of two equally tight bins is taken changes no bin's fill
    assert sorted(sum(int(x) for _, x in b) for b in filled.values()) == sorted(map(sum, plain_best_fit(lengths, 40)))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\x1c\x1fàÀİΣσ'’s<|>é"))))
def test_word_ids_are_the_tokenizers(text):
    assert packing.word_ids(PATH).of(text) == packing.WordIds(PATH).encoded(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcXYZÀéßÿ ,.!'’-é1\n")), max_size=6))
def test_words_have_the_tokenizers_ids_at_any_size_of_the_table(texts):
    known = packing.WordIds(PATH, room=3)
    for text in texts + texts:
        assert known.of(text) == known.encoded(text)
    assert len(known) <= 6 and len(known.older) <= 6


def test_special_token_text_is_encoded_as_by_default():
    for text in ("a <|endoftext|> b", "x<|startoftext|>y", "İstanbul ΣΑΣ ΣΑΣ."):
        assert packing.word_ids(PATH).of(text) == packing.WordIds(PATH).encoded(text)


def test_pack_cases(spark):
    rows = [
        (1, "Some words, here."), (2, None), (3, ""), (4, "word " * 9000), (5, "a"), (5, "a"), (None, "lost"),
        (7, "é " * 4095), (8, " ".join(f"w{i}" for i in range(3000))),
    ]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], SCHEMA)
    packed = packing.pack(packing.tokenized(df, tokenizer=PATH)).cache()
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4").tobytes()
            expected[(doc_id, piece, at, len(part) // 4, zlib.crc32(part))] += 1
    found = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in found) == expected
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for parts in by_sequence.values():
        parts.sort()
        assert [p[0] for p in parts] == list(np.cumsum([0, *(p[1] for p in parts[:-1])]))
        assert sum(p[1] for p in parts) <= 4096
    assert len(by_sequence) == len(plain_best_fit([r.length for r in found], 4096))
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert whole == {k: b"".join(p[2] for p in v) for k, v in by_sequence.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert packing.pack(packing.tokenized(df, tokenizer=PATH)).count() == 0
