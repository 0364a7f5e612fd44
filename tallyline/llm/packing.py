"""Best-fit decreasing packing of tokenised documents into training sequences.

Best-fit decreasing looks only at lengths, and there are at most `capacity` of
them. So the packing of the whole corpus is computed once, exactly, from the
histogram of piece lengths: lengths in decreasing order, and for each a segment
tree over remaining capacities gives the tightest open bin in logarithmic time.
Pieces of one length are interchangeable and placed in runs; a run says which
ranks among the pieces of its length go to which bins at which offset. Every
piece then finds its place from its rank alone, in parallel.

Cases: a null text is empty, an empty text is just the end token, equal rows
are packed each on its own, rows without id are packed too, an empty table
gives an empty result. Very long texts are cut into whole-capacity pieces and a
rest. The input is read by name (doc_id, text); other columns don't matter.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import Scratch, give_back, small_batches

CAPACITY = 4096
END_TOKEN = 1
TOKENIZER = "word_bpe_49k.json"
# Rows that share a rank counter; more rows than that get more counters.
COUNTED = 20_000
# Words whose ids a Python worker remembers, twice over.
REMEMBERED = 800_000

# A word of Latin letters, then perhaps points. The tokenizer lowers letters one by
# one and splits letters from points, so such words share the ids of their parts.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


class WordIds(dict):
    """Ids (little-endian, 32 bits) of white-space delimited words, computed once per word.

    Neither the normaliser nor the splitter of the tokenizer looks across white
    space, so a text's ids are those of its words one after another.
    """

    def __init__(self, path: str, room: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.older: dict[str, bytes] = {}
        self.room = room

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        known = self.older.get(word)
        self.make_room()
        if known is not None:
            self[word] = known
            return known
        plain = PLAIN.fullmatch(word)
        if plain and (plain[2] or plain[1] != plain[1].lower()):
            ids = self[plain[1].lower()] + (self[plain[2]] if plain[2] else b"")
        else:
            ids = self.encoded(word)
        if len(word) < 64:
            self[word] = ids
        return ids

    def make_room(self) -> None:
        """Words met since the last turn stay for one more, so common ones stay for good."""
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()

    def of(self, text: str) -> bytes:
        # these four are white space to str.split but not to the tokenizer
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.encoded(text)
        return b"".join(map(self.__getitem__, text.split()))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str, room: int = REMEMBERED) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    _WORD_IDS[path].room = room
    return _WORD_IDS[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(
    docs: DataFrame, capacity: int = CAPACITY, end: int = END_TOKEN, tokenizer: str | None = None,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """(doc_id, piece, start, length, ids) of all documents; ids as little-endian 32-bit numbers.

    `tokenizer` is the path of a tokenizers file on the executors; without it
    each executor looks up the public one. A worker that remembers fewer words needs
    less memory and more time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_ids(tokenizer or tokenizer_path(), remembered)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = known.of(text or "") + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, part))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
        give_back()

    # pandas has no whole number for null, so ids travel as text
    texts = small_batches(docs).select(F.col("doc_id").cast("string"), "text")
    pieces = texts.mapInPandas(run, "doc_id string, piece int, start long, length long, ids binary")
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


class TightestBin:
    """Segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def mark(self, remaining: int, is_open: bool) -> None:
        at = remaining + self.size
        while at and self.open[at] != is_open:
            self.open[at] = is_open
            at //= 2
            if at:
                is_open = self.open[2 * at] or self.open[2 * at + 1]

    def at_least(self, length: int) -> int | None:
        """The smallest remaining capacity of an open bin that holds `length`."""
        at = length + self.size
        while not self.open[at]:
            while at % 2:  # a right child: nothing further right below this parent
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


class Run(NamedTuple):
    """Pieces of one length, ranks first_rank and up: `each` per bin from `first_bin`, the first at `offset`."""

    length: int
    first_rank: int
    first_bin: int
    each: int
    offset: int


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing of histogram[length] pieces of every length.

    A placed piece makes its bin the tightest one that may still hold the next
    piece of the same length, so a bin takes as many of them as fit before the
    next bin's turn. Open bins are kept as ranges of equal bins.
    """
    tree, open_bins = TightestBin(capacity), defaultdict(deque)
    runs: list[Run] = []
    bins = 0

    def opened(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            if not open_bins[remaining]:
                tree.mark(remaining, True)
            open_bins[remaining].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = tree.at_least(length)
            if remaining is None:
                remaining, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = open_bins[remaining].popleft()
                if not open_bins[remaining]:
                    tree.mark(remaining, False)
            each = remaining // length
            full = min(count, left // each)
            over = left - full * each if full < count else 0  # pieces for one more bin, not filled
            runs.append(Run(length, rank, first, each, capacity - remaining))
            opened(remaining - each * length, first, full)
            if over:
                opened(remaining - over * length, first + full, 1)
            untouched = full + bool(over)
            opened(remaining, first + untouched, count - untouched)
            placed = full * each + over
            rank, left = rank + placed, left - placed
    return runs


def run_table(runs: list[Run]) -> np.ndarray:
    return np.array(sorted(runs), np.int64).reshape(-1, len(Run._fields))


def placed(table: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence_id, offset) of pieces by their length and rank."""
    at = np.empty(len(lengths), np.int64)
    for length in np.unique(lengths):
        low, high = np.searchsorted(table[:, 0], [length, length + 1])
        of = lengths == length
        at[of] = low + np.searchsorted(table[low:high, 1], ranks[of], "right") - 1
    run = table[at]
    nth = ranks - run[:, 1]
    return run[:, 2] + nth // run[:, 3], run[:, 4] + nth % run[:, 3] * lengths


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (doc_id, piece, length and more) with sequence_id and offset.

    Only the histogram of lengths, at most `capacity` rows, comes to the driver.
    A rank is a count inside a bucket of rows plus the counts of the buckets
    before, so a length that very many pieces have is counted in many tasks.
    """
    scratch = Scratch(pieces.sparkSession, "packing")
    rows = scratch.keep(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = run_table(best_fit_decreasing(histogram, capacity))
    buckets = 1 + sum(histogram.values()) // COUNTED * 8

    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    rows = rows.withColumn("bucket", bucket)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = counts.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece")) - 1
    ranked = rows.withColumn("within", within).join(earlier, ["bucket", "length"])
    ranked = ranked.withColumn("rank", F.col("within") + F.col("earlier"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, offset = placed(table, lengths.to_numpy(), ranks.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    found = ranked.withColumn("place", place("length", "rank"))
    return found.select(*pieces.columns, "place.sequence_id", "place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences: (sequence_id, length, ids) of packed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    joined = F.aggregate("parts.ids", F.lit(b""), lambda all_ids, ids: F.concat(all_ids, ids))
    return whole.select("sequence_id", "length", joined.alias("ids"))
