"""Repeated byte strings by a suffix array over anchors and its common-prefix interval tree.

Wanted are all bytes inside a string of LENGTH bytes that also starts elsewhere,
in the same or another document.

Anchors. Of the grams (GRAM bytes) in every string of LENGTH bytes, those with
the smallest hash are its anchors. Equal strings have equal anchors, so two
occurrences of a string meet at an anchor, and what matters of each is the
anchor's context: LENGTH - GRAM bytes before it and LENGTH bytes from it on.

Contexts. An anchor seen twice in the corpus puts its contexts up. A context seen
twice is repeated as a whole. Other contexts of the anchor go into a suffix
array, sorted by what follows the anchor; a stack scan over its common prefixes
gives the interval tree, whose nodes are the groups that share `right` bytes.
Inside a node the occurrences are split where what precedes them differs: those
that agree on `left` bytes, left + right >= LENGTH, are a maximal repeat, and all
of its occurrences are put out. The union of an occurrence's repeats is covered.

Spread. Documents are dealt to chunks of about CHUNK bytes, and every chunk sends
each distinct (anchor, context) once, as hashes, to the anchor's bucket. Only
contexts that a bucket asks for travel as bytes. An anchor with more than CROWD
contexts in some chunk, or MOST in all (a passage that a large share of all
documents has), isn't sorted: its strings of LENGTH bytes are counted one by one
instead, again each distinct one once per chunk, so a sorted group has a bound
and no bucket grows with the passage's occurrences.
The chunks' texts are shuffled once; the three passes read the same shuffle.

Hashes are 128 bits wide where their equality stands for that of strings: anchor
and context, or anchor, place and string.

Cases: a null text is empty; texts shorter than LENGTH repeat nothing; equal rows
repeat each other; rows without id count like any other; an empty table gives
an empty result. Columns other than doc_id and text are only carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import give_back, small_batches

LENGTH = 200
GRAM = 64
CHUNK = 4 << 20
CROWD = 256
MOST = 1 << 16
# Buckets grow with the square root of the text, a bucket's chunks likewise.
BUCKET = 1 << 16
# Strings that are hashed at once.
BLOCK = 1 << 18
# Crowded anchors whose strings are listed at once.
LISTED = 1 << 12

RESOLVED, SEND, CROWDED = 1, 2, 4
CONTEXTS, STRINGS, VERDICT = 0, 1, 2


class Repeats(NamedTuple):
    """The sizes that passes and buckets have to agree on."""

    length: int = LENGTH
    gram: int = GRAM
    crowd: int = CROWD
    most: int = MOST
    buckets: int = 1

    @property
    def before(self) -> int:
        return self.length - self.gram


class Powers:
    """Powers of the hashes' odd base, their inverses, and a random number for every byte."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, size: int):
        inverse = pow(self.BASE, -1, 1 << 64)
        self.power = self.series(self.BASE, size)
        self.inverse = self.series(inverse, size)
        self.of_byte = np.random.default_rng(20).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @staticmethod
    def series(base: int, size: int) -> np.ndarray:
        found = np.full(size, base, np.uint64)
        found[0] = 1
        return np.cumprod(found, dtype=np.uint64)


_POWERS: list[Powers] = []


def powers() -> Powers:
    if not _POWERS:
        _POWERS.append(Powers(BLOCK + 4096))
    return _POWERS[0]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest (or largest) of every `width` neighbours."""
    size = 1
    while size * 2 <= width:
        values, size = pick(values[:-size], values[size:]), size * 2
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


class Marked(NamedTuple):
    """Anchors of a chunk: text number, place, the gram's hash, the context's hash and borders."""

    text: np.ndarray
    at: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Chunk:
    """The texts of a chunk one after another."""

    def __init__(self, texts, sizes: Repeats):
        parts = [(t or "").encode() for t in texts]
        self.bytes, self.sizes = b"".join(parts), sizes
        lengths = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths

    def text_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")

    def anchors(self) -> Marked:
        """A gram is an anchor if it is the least, or among the least, of some string's. Strings end with their text."""
        p, sizes, whole = powers(), self.sizes, self.bytes
        width = sizes.length - sizes.gram + 1
        places, grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for first in range(0, len(whole) - sizes.length + 1, BLOCK):
            piece = np.frombuffer(whole, np.uint8, min(BLOCK + sizes.length - 1, len(whole) - first), first)
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(p.of_byte[piece] * p.power[: len(piece)], out=sums[1:])
            n = len(piece) - sizes.gram + 1
            hashes = mixed((sums[sizes.gram :] - sums[: -sizes.gram]) * p.inverse[:n])
            least = extreme(hashes, width, np.minimum)
            starts = np.arange(first, first + len(least))
            least[starts + sizes.length > self.ends[self.text_at(starts)]] = 0
            around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
            found = np.flatnonzero((extreme(around, width, np.maximum) == hashes) & (hashes > 0))
            places.append(found + first)
            grams.append(hashes[found])
        at, one = np.unique(np.concatenate(places), return_index=True)
        text = self.text_at(at)
        start = np.maximum(at - sizes.before, self.begins[text])
        end = np.minimum(at + sizes.length, self.ends[text])
        shape = ((at - start) << 20 | (end - at)).astype(np.uint64)
        context = mixed(string_hashes(whole, start, end) + shape)
        return Marked(text, at, np.concatenate(grams)[one], context, start, end)

    def strings(self, m: Marked, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Every string of LENGTH bytes that holds one of the anchors: start, hash, and hash of anchor and place."""
        back = np.arange(self.sizes.before + 1)
        for first in range(0, len(chosen), LISTED):
            few = chosen[first : first + LISTED]
            at, gram, text = m.at[few], m.gram[few], m.text[few]
            start = at[:, None] - back[None, :]
            fits = (start >= self.begins[text][:, None]) & (start + self.sizes.length <= self.ends[text][:, None])
            place = mixed(gram[:, None] + back[None, :].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            start, place = start[fits], place[fits]
            yield start, string_hashes(self.bytes, start, start + self.sizes.length), place


def string_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of parts of a text, in blocks of starts near each other."""
    p, out = powers(), np.empty(len(starts), np.uint64)
    order = np.argsort(starts, kind="stable")
    ordered, at = starts[order], 0
    while at < len(order):
        first = int(ordered[at])
        stop = int(np.searchsorted(ordered, first + BLOCK))
        of = order[at:stop]
        piece = np.frombuffer(text, np.uint8, int(ends[of].max()) - first, first)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(p.of_byte[piece] * p.power[: len(piece)], out=sums[1:])
        out[of] = mixed((sums[ends[of] - first] - sums[starts[of] - first]) * p.inverse[starts[of] - first])
        at = stop
    return out


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[place] == values


def once(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by the columns: their order, where each distinct row begins, how often it is there."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


PAIR = np.dtype([("a", "<u8"), ("b", "<u8"), ("flag", "u1")])


def pairs(a: np.ndarray, b: np.ndarray, flag: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), PAIR)
    out["a"], out["b"], out["flag"] = a, b, flag
    return out


def distinct(rows: np.ndarray) -> np.ndarray:
    """Each pair once, flagged if it was there more than once."""
    order, first, n = once(rows["a"], rows["b"])
    if not len(order):
        return rows
    flag = np.maximum.reduceat(rows["flag"][order], first) | (n > 1)
    return pairs(rows["a"][order[first]], rows["b"][order[first]], flag)


def by_bucket(chunk: int, kind: int, rows: np.ndarray, buckets: int) -> Iterator[tuple]:
    bucket = (rows["a"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    borders = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for n in np.unique(bucket):
        yield int(n), chunk, kind, rows[order[borders[n] : borders[n + 1]]].tobytes()


SENT = "bucket int, chunk int, kind int, data binary"
SENT_COLUMNS = ["bucket", "chunk", "kind", "data"]


def send_hashes(sizes: Repeats):
    """First pass over a chunk: its distinct (anchor, context); CROWDED anchors without contexts."""

    def run(texts: pd.DataFrame) -> pd.DataFrame:
        m = Chunk(texts["text"], sizes).anchors()
        order, first, n = once(m.gram, m.context)
        a, b = m.gram[order[first]], m.context[order[first]]
        flag = (n > 1).astype(np.uint8)
        _, begin, contexts = np.unique(a, return_index=True, return_counts=True)
        crowded = contexts > sizes.crowd
        keep = ~np.repeat(crowded, contexts)
        keep[begin[crowded]] = True
        flag[begin[crowded]], b[begin[crowded]] = CROWDED, 0
        rows = pairs(a[keep], b[keep], flag[keep])
        chunk = int(texts["chunk"].iloc[0])
        return pd.DataFrame(by_bucket(chunk, VERDICT, rows, sizes.buckets), columns=SENT_COLUMNS)

    return run


def answers(chunks: np.ndarray, rows: np.ndarray, kind: int) -> pd.DataFrame:
    order = np.argsort(chunks, kind="stable")
    names, first = np.unique(chunks[order], return_index=True)
    borders = np.append(first, len(order))
    out = [(int(c), kind, rows[order[borders[n] : borders[n + 1]]].tobytes()) for n, c in enumerate(names)]
    return pd.DataFrame(out, columns=["chunk", "kind", "data"])


TOLD = "chunk int, kind int, data binary"


def gathered(sent: pd.DataFrame, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(d, kind) for d in sent["data"]]
    return np.concatenate(parts), np.repeat(sent["chunk"].to_numpy(), [len(p) for p in parts])


def tell_chunks(sizes: Repeats):
    """One bucket's anchors: what is repeated as a whole, whose bytes are needed, what is crowded."""

    def run(sent: pd.DataFrame) -> pd.DataFrame:
        rows, chunk = gathered(sent, PAIR)
        order, first, n = once(rows["a"], rows["b"])
        rows, chunk = rows[order], chunk[order]
        twice = (n > 1) | (np.maximum.reduceat(rows["flag"], first) == 1)
        _, begin, contexts = np.unique(rows["a"][first], return_index=True, return_counts=True)
        crowd = (np.maximum.reduceat(rows["flag"][first], begin) == CROWDED) | (contexts > sizes.most)
        answer = np.zeros(len(rows), np.uint8)
        answer[np.repeat(twice, n)] = RESOLVED
        several = np.repeat(contexts > 1, contexts)
        answer[first[several]] |= SEND
        answer[np.repeat(np.repeat(crowd, contexts), n)] = CROWDED
        told = answer > 0
        return answers(chunk[told], pairs(rows["a"][told], rows["b"][told], answer[told]), VERDICT)

    return run


class Lookup:
    """Rows by their fields a and b. Found by both mixed into one number, then compared whole."""

    def __init__(self, rows: np.ndarray):
        key = rows["a"] ^ mixed(rows["b"].copy())
        order = np.argsort(key, kind="stable")
        self.key, self.rows = key[order], rows[order]

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair is there, and the row that has it."""
        if not len(self.key):
            return np.zeros(len(a), bool), np.empty(0, self.rows.dtype)
        place = np.minimum(np.searchsorted(self.key, a ^ mixed(b)), len(self.key) - 1)
        rows = self.rows[place]
        return (rows["a"] == a) & (rows["b"] == b), rows


def told_rows(told: pd.DataFrame, kind: int, of: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(d, of) for d in told.loc[told["kind"] == kind, "data"]]
    return np.concatenate(parts) if parts else np.empty(0, of)


def verdicts(told: pd.DataFrame) -> tuple[Lookup, np.ndarray]:
    """Flags of (anchor, context), and the crowded anchors."""
    rows = told_rows(told, VERDICT, PAIR)
    crowded = rows["flag"] == CROWDED
    return Lookup(rows[~crowded]), np.unique(rows["a"][crowded])


def send_contexts(sizes: Repeats):
    """Second pass over a chunk: the bytes of contexts asked for, and strings of crowded anchors."""

    def run(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(texts) and len(told):
            number = int(texts["chunk"].iloc[0])
            flags, crowded = verdicts(told)
            chunk = Chunk(texts["text"], sizes)
            m = chunk.anchors()
            known, row = flags.find(m.gram, m.context)
            asked = np.flatnonzero(known & (row["flag"] & SEND > 0)) if known.any() else np.empty(0, np.int64)
            _, one = np.unique(pairs(m.gram[asked], m.context[asked], 0), return_index=True)
            asked = asked[one]
            head = np.empty(len(asked), HEAD)
            if len(asked):
                head["a"], head["b"], head["resolved"] = m.gram[asked], m.context[asked], row["flag"][asked] & RESOLVED
                head["left"], head["size"] = (m.at - m.start)[asked], (m.end - m.start)[asked]
            bucket = (head["a"] % np.uint64(sizes.buckets)).astype(np.int64)
            for b in np.unique(bucket):
                of = np.flatnonzero(bucket == b)
                contexts = b"".join(chunk.bytes[x:y] for x, y in zip(m.start[asked[of]], m.end[asked[of]]))
                out.append((int(b), number, CONTEXTS, np.int64(len(of)).tobytes() + head[of].tobytes() + contexts))
            rows = np.empty(0, PAIR)
            for _, string, place in chunk.strings(m, np.flatnonzero(among(m.gram, crowded))):
                rows = distinct(np.concatenate([rows, pairs(string, place, np.zeros(len(string)))]))
            out += by_bucket(number, STRINGS, rows, sizes.buckets)
        return pd.DataFrame(out, columns=SENT_COLUMNS)

    return run


HEAD = np.dtype([("a", "<u8"), ("b", "<u8"), ("resolved", "u1"), ("left", "<u2"), ("size", "<u2")])


class Occurrences(NamedTuple):
    """Contexts as rows: what follows the anchor, what precedes it (backwards), and how much there is of each."""

    anchor: np.ndarray
    after: np.ndarray
    n_after: np.ndarray
    before: np.ndarray
    n_before: np.ndarray

    @classmethod
    def of(cls, anchor: np.ndarray, left: np.ndarray, contexts: list[bytes], sizes: Repeats) -> Occurrences:
        after = np.zeros((len(contexts), sizes.length), np.uint8)
        before = np.zeros((len(contexts), max(1, sizes.before)), np.uint8)
        for n, whole in enumerate(contexts):
            cut = int(left[n])
            after[n, : len(whole) - cut] = np.frombuffer(whole, np.uint8, offset=cut)
            before[n, :cut] = np.frombuffer(whole, np.uint8, count=cut)[::-1]
        sizes_of = np.array([len(c) for c in contexts], np.int64)
        return cls(anchor, after, sizes_of - left, before, left.astype(np.int64))


def common(rows: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and rows b, pair by pair."""
    differ = rows[a] != rows[b]
    prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(prefix, np.minimum(n[a], n[b]))


def sorted_rows(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The suffix array: rows in byte order, anchor by anchor."""
    key = np.concatenate([anchor.astype(">u8").view(np.uint8).reshape(-1, 8), rows], axis=1)
    return np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")


def intervals(prefixes: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Nodes of the common-prefix interval tree: (length, first, last) in the suffix array, inner ones first.

    prefixes[i] is what entries i and i + 1 share; negative parts groups of different anchors.
    """
    stack: list[tuple[int, int]] = []
    for i, shared in enumerate([*prefixes, -1]):
        first = i
        while stack and stack[-1][0] > shared:
            length, first = stack.pop()
            yield length, first, i
        if shared >= least and (not stack or stack[-1][0] < shared):
            stack.append((shared, first))


def maximal_repeats(found: Occurrences, sizes: Repeats) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of all occurrences of a maximal repeat: bytes from the anchor on, who, and how far back each agrees.

    A node's members are put in the order of what precedes them. Where neighbours
    agree on too little for LENGTH bytes, the left extension differs and the
    group ends.
    """
    array = sorted_rows(found.anchor, found.after)
    same = found.anchor[array[1:]] == found.anchor[array[:-1]]
    prefixes = np.where(same, common(found.after, found.n_after, array[1:], array[:-1]), -1)
    rank = np.empty(len(array), np.int64)
    rank[sorted_rows(found.anchor, found.before)] = np.arange(len(array))
    for right, first, last in intervals(prefixes.tolist(), sizes.gram):
        members = array[first : last + 1]
        members = members[np.argsort(rank[members])]
        agree = common(found.before, found.n_before, members[1:], members[:-1])
        enough = agree + right >= sizes.length
        if not enough.any():
            continue
        borders = np.flatnonzero(np.diff(np.concatenate([[0], enough.view(np.int8), [0]])))
        for begin, end in zip(borders[::2], borders[1::2]):
            shared = agree[begin:end]
            back = np.maximum(np.append(shared, 0), np.append(0, shared))
            yield right, members[begin : end + 1], back


COVER = np.dtype([("a", "<u8"), ("b", "<u8"), ("left", "<u2"), ("right", "<u2")])


def find_repeats(sizes: Repeats):
    """One bucket: the repeats of contexts, or the strings that are there more than once."""

    def of_contexts(sent: pd.DataFrame) -> pd.DataFrame:
        heads, contexts, chunk = [], [], []
        for c, data in zip(sent["chunk"], sent["data"]):
            n = int(np.frombuffer(data, np.int64, 1)[0])
            head = np.frombuffer(data, HEAD, n, 8)
            at = 8 + n * HEAD.itemsize
            for size in head["size"].tolist():
                contexts.append(data[at : at + size])
                at += size
            heads.append(head)
            chunk += [c] * n
        head = np.concatenate(heads)
        found = Occurrences.of(head["a"].copy(), head["left"].astype(np.int64), contexts, sizes)
        left, right = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        for length, members, back in maximal_repeats(found, sizes):
            left[members] = np.maximum(left[members], back)
            right[members] = np.maximum(right[members], length)
        told = (right > 0) & (head["resolved"] == 0)
        out = np.empty(int(told.sum()), COVER)
        out["a"], out["b"], out["left"], out["right"] = head["a"][told], head["b"][told], left[told], right[told]
        return answers(np.array(chunk)[told], out, CONTEXTS)

    def of_strings(sent: pd.DataFrame) -> pd.DataFrame:
        rows, chunk = gathered(sent, PAIR)
        order, first, n = once(rows["a"], rows["b"])
        rows, chunk = rows[order], chunk[order]
        twice = np.repeat((n > 1) | (np.maximum.reduceat(rows["flag"], first) == 1), n)
        return answers(chunk[twice], rows[twice], STRINGS)

    def run(sent: pd.DataFrame) -> pd.DataFrame:
        return of_contexts(sent) if sent["kind"].iloc[0] == CONTEXTS else of_strings(sent)

    return run


def joined_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of one text joined where they overlap or touch."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], ends[last]


def cut(sizes: Repeats, as_text: bool):
    """Third pass over a chunk: what is covered in each text, and what is left of it."""

    def covered(chunk: Chunk, told: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        flags, crowded = verdicts(told)
        m = chunk.anchors()
        known, row = flags.find(m.gram, m.context)
        whole = known & (row["flag"] & RESOLVED > 0) if known.any() else known
        starts, ends = [m.start[whole]], [m.end[whole]]
        found, cover = Lookup(told_rows(told, CONTEXTS, COVER)).find(m.gram, m.context)
        if found.any():
            starts.append(m.at[found] - cover["left"][found])
            ends.append(m.at[found] + cover["right"][found])
        twice = Lookup(told_rows(told, STRINGS, PAIR))
        for start, string, place in chunk.strings(m, np.flatnonzero(among(m.gram, crowded))):
            again, _ = twice.find(string, place)
            starts.append(start[again])
            ends.append(start[again] + sizes.length)
        return np.concatenate(starts), np.concatenate(ends)

    def run(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(texts["text"], sizes)
        starts = ends = np.empty(0, np.int64)
        if len(told):
            starts, ends = covered(chunk, told)
        out = []
        text = chunk.text_at(starts)
        order = np.argsort(text, kind="stable")
        borders = np.searchsorted(text[order], np.arange(len(texts) + 1))
        for n, (doc_id, carried) in enumerate(zip(texts["doc_id"], texts["carried"])):
            first, last = int(chunk.begins[n]), int(chunk.ends[n])
            of = order[borders[n] : borders[n + 1]]
            kept, begin, end = chunk.bytes[first:last], [], []
            if len(of):
                a, b = joined_spans(starts[of], ends[of])
                begin, end = (a - first).tolist(), (b - first).tolist()
                kept = b"".join(kept[x:y] for x, y in zip([0, *end], [*begin, last - first]))
            left = kept.decode("utf-8", "ignore") if as_text else kept
            out.append((doc_id, carried, last - first, begin, end, left))
        return pd.DataFrame(out, columns=["doc_id", "carried", "n_bytes", "starts", "ends", "kept"])

    return run


def of_one(step):
    """A step over a group that gives its memory back."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = step(frame)
        give_back()
        return out

    return run


def of_two(step):
    """A step over a pair of groups that gives its memory back."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = step(left, right)
        give_back()
        return out

    return run


CUT = "doc_id string, carried string, n_bytes long, starts array<long>, ends array<long>, kept"


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, crowd: int = CROWD, most: int = MOST,
    carried: Column | None = None, as_text: bool = False,
) -> DataFrame:
    """(doc_id, carried, n_bytes, starts, ends, kept): the removed spans of every text, and its other bytes.

    `as_text` gives them as a string, without the parts of characters that a cut leaves over.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sizes = Repeats(length, gram, crowd, most, buckets=1 + int((size / BUCKET) ** 0.5))
    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // chunk)).cast("int").alias("chunk")
    rest = F.lit(None).cast("string") if carried is None else carried
    columns = [dealt, F.col("doc_id").cast("string").alias("doc_id"), "text", rest.alias("carried")]
    texts = small_batches(docs).select(*columns).repartition("chunk")
    told = texts.groupBy("chunk").applyInPandas(of_one(send_hashes(sizes)), SENT)
    told = told.groupBy("bucket").applyInPandas(of_one(tell_chunks(sizes)), TOLD)
    sent = texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(of_two(send_contexts(sizes)), SENT)
    found = sent.groupBy("kind", "bucket").applyInPandas(of_one(find_repeats(sizes)), TOLD)
    both = told.unionByName(found)
    done = texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(
        of_two(cut(sizes, as_text)), f"{CUT} {'string' if as_text else 'binary'}"
    )
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def removed(starts: str = "starts", ends: str = "ends") -> Column:
    spans = F.zip_with(starts, ends, lambda a, b: b - a)
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, n: total + n)
