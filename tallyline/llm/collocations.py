"""Collocations of two and three words, by best-first branch and bound over their prefixes.

Per language: a phrase scores 1000000 a a / (l r), where a counts the phrase and l and r
the parts of its worst cut; a phrase goes when a longer one accounts for half of it.

Phrases grow word by word. No phrase occurs more often than a part of it, so only
frequent words grow to pairs, and no continuation of the pair xy scores more than
1000000 f(xy) / f(x); seen from the end, xyz scores at most 1000000 f(yz) / f(z). Pairs
are opened in the order of these bounds, in rounds: a round takes a limit for every
language and counts the triples of all pairs whose bounds reach it, and those that could
put out a pair whose own score reaches it. Then every phrase that scores as much as the
limit is known, and whether it survives. A language is settled when it has `limit`
survivors there, ties included, as all that is still unopened scores less. The limit of
the others is lowered, at last to zero.

Counts are summed in the tasks before they are shuffled. Which words and pairs are open
is told to the tasks by a table of marks, of fixed size at every scale, under the hashes
of the phrases: two phrases of one mark are counted once too often, never too seldom,
and counts stay exact. Texts are read once for words, once for pairs and once a round.

Cases: a null or empty text has no words; a null language is `und`, and so one with the
language of that name; words that are no words of a language (numbers, junk) count like
others; equal rows count each; an empty table gives an empty result. Only lang and text
are read, whatever else the table holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.skew import salted_join
from tallyline.llm.common import Scratch, give_back, small_batches

LEAST = 10
LIMIT = 2000
# A longer phrase with this percentage of a phrase's occurrences puts it out.
COVERED = 50
UNIT = 1_000_000
# Bytes of the table of marks.
SLOTS = 1 << 23
SEED = 42  # of xxhash64() as Spark has it
# Entries that a task keeps before it hands them on.
KEPT = 1 << 18
# Tables of a row per language that are broadcast have so many rows at most.
MOST_LANGS = 100_000
# The first round's limit is the score of so many times LIMIT pairs; how many times more the next take.
FIRST, MORE = 2, 4

# What a mark says of a phrase: it is frequent; it may begin, it may end a triple worth
# counting; triples are to be counted as they may put it out.
FREQUENT, BEGINS, ENDS, WATCHED = 1, 2, 4, 8

# On UTF-8 bytes: A-Z become small, ends of pieces a full stop, blanks and tabs a blank.
STOP = b"."
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else 46 if chr(b) in ".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256)
)


def tokens(text: str) -> list[bytes]:
    """Words in order, with a full stop between pieces."""
    return text.encode().translate(_TABLE).replace(STOP, b" . ").split()


class Marks:
    """Fixed table of flags under the hashes of phrases."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def of(self, lang: bytes, phrases: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        start, mask = lang + b"\n", len(self.table) - 1
        slots = np.fromiter((xxh64_intdigest(start + p, SEED) & mask for p in phrases), np.int64, len(phrases))
        return self.table[slots]


def marked(phrases: DataFrame, slots: int = SLOTS) -> Marks:
    """The marks of (lang, phrase, flags). Eight slots come as one number, so the driver gets slots / 8 rows at most."""
    hashed = F.xxhash64(F.concat("lang", F.lit("\n"), "phrase"))
    rows = phrases.select("flags", F.pmod(hashed, F.lit(slots)).alias("slot")).select(
        F.shiftright("slot", 3).cast("int").alias("lane"),
        F.expr("shiftleft(cast(flags as long), cast(8 * (slot % 8) as int))").alias("bits"),
    )
    found = rows.groupBy("lane").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(slots // 8, np.int64)
    table[found["lane"].to_numpy()] = found["bits"].to_numpy()
    return Marks(table.astype("<i8").view(np.uint8))


class Numbers(dict):
    """Words of a language, numbered as they come; the full stop is 0."""

    def __init__(self):
        super().__init__({STOP: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Tally:
    """Counts of one language's phrases of a size, within one task."""

    def __init__(self, lang: str, size: int, marks: Marks | None):
        self.lang, self.size, self.marks = lang, size, marks
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.names: list[bytes] = []
        self.frequent = np.zeros(0, bool)
        self.words = np.zeros(0, np.int64)
        self.pairs: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.triples: Counter[bytes] = Counter()

    def add(self, texts: list[str]) -> None:
        found = tokens("\n".join(texts))
        ids = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        self.names += list(self.numbers)[len(self.names) :]
        if self.size == 1:
            counts = np.bincount(ids, minlength=len(self.names))
            counts[: len(self.words)] += self.words
            self.words = counts
            return
        new = self.names[len(self.frequent) :]
        flags = self.marks.of(self.lang.encode(), new) & FREQUENT > 0
        if not len(self.frequent):
            flags[0] = False
        self.frequent = np.concatenate([self.frequent, flags])
        open_ = self.frequent[ids]
        first = np.flatnonzero(open_[:-1] & open_[1:])
        codes = ids[first] << 32 | ids[first + 1]
        if self.size == 2:
            self.pairs = summed([self.pairs, (codes, np.ones(len(codes), np.int64))])
        else:
            self.grow(ids, first, codes)

    def grow(self, ids: np.ndarray, first: np.ndarray, codes: np.ndarray) -> None:
        """Count the triples of neighbouring pairs, those starting at `first`, that the marks ask for."""
        distinct, place = np.unique(codes, return_inverse=True)
        flags = self.marks.of(self.lang.encode(), self.phrases(distinct))[place]
        both = np.flatnonzero(first[1:] == first[:-1] + 1)
        a, b = flags[both], flags[both + 1]
        asked = ((a & BEGINS > 0) & (b & ENDS > 0)) | (a & WATCHED > 0) | (b & WATCHED > 0)
        at = first[both[asked & (a & b & FREQUENT > 0)]]
        names = self.names
        rows = zip(ids[at].tolist(), ids[at + 1].tolist(), ids[at + 2].tolist())
        self.triples.update(b"%b %b %b" % (names[x], names[y], names[z]) for x, y, z in rows)

    def phrases(self, codes: np.ndarray) -> list[bytes]:
        names = self.names
        return [names[c >> 32] + b" " + names[c & 0xFFFFFFFF] for c in codes.tolist()]

    def full(self) -> bool:
        return max(len(self.names), len(self.pairs[0]), len(self.triples)) > KEPT

    def rows(self) -> tuple[list[bytes], list[int]]:
        """What was counted; the empty phrase counts all words."""
        if self.size == 1:
            counts = self.words.tolist()
            found = self.names[1:], counts[1:]
            found = [*found[0], b""], [*found[1], sum(counts[1:])]
        elif self.size == 2:
            found = self.phrases(self.pairs[0]), self.pairs[1].tolist()
        else:
            found = list(self.triples), list(self.triples.values())
        self.clear()
        return found


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of equal codes."""
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


def language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def by_language(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Join with a table of one row per language. One language may hold most rows: those don't move."""
    if small.count() <= MOST_LANGS:
        return rows.join(F.broadcast(small), "lang", how)
    return salted_join(rows, small, ["lang"], F.col("phrase"), how)


def counts(docs: DataFrame, size: int, marks: Marks | None = None) -> DataFrame:
    """(lang, phrase, a): counts of the phrases of `size` words that the marks leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}

        def out(tally: Tally) -> pa.RecordBatch:
            phrases, n = tally.rows()
            names = pa.array(phrases, pa.binary()).cast(pa.string())
            langs = pa.DictionaryArray.from_arrays(np.zeros(len(n), np.int32), [tally.lang]).cast(pa.string())
            return pa.RecordBatch.from_arrays([langs, names, pa.array(n, pa.int64())], ["lang", "phrase", "a"])

        for batch in batches:
            of_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of_lang.setdefault(lang, []).append(text)
            for lang, texts in of_lang.items():
                tally = tallies.setdefault(lang, Tally(lang, size, marks))
                tally.add(texts)
                if tally.full():
                    yield out(tally)
            # a column of very many languages
            if sum(len(t.names) for t in tallies.values()) > 4 * KEPT or len(tallies) > KEPT >> 8:
                for tally in tallies.values():
                    yield out(tally)
                tallies.clear()
        for tally in tallies.values():
            yield out(tally)
        tallies.clear()
        give_back()

    rows = small_batches(docs.select(language().alias("lang"), "text").where("text is not null"))
    found = rows.mapInArrow(run, "lang string, phrase string, a long")
    return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exact."""
    return F.expr(
        f"(cast({UNIT} as decimal(7,0)) * (cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)))) "
        f"div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))"
    ).cast("long")


def pairs_of(words: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """Frequent pairs x y with the counts of both words and their score."""
    split = F.split("phrase", " ")
    pairs = found.where(F.col("a") >= least).select("lang", "phrase", "a", split[0].alias("x"), split[1].alias("y"))
    first = words.select("lang", F.col("phrase").alias("x"), F.col("a").alias("l"))
    second = words.select("lang", F.col("phrase").alias("y"), F.col("a").alias("r"))
    return pairs.join(first, ["lang", "x"]).join(second, ["lang", "y"]).withColumn("score", score("a", "l", "r"))


def limits(pairs: DataFrame, wanted: int, langs: DataFrame) -> DataFrame:
    """(lang, least): the score that `wanted` pairs of a language reach, or 0. Scores are a million values at most."""
    of_score = by_language(pairs, langs).groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("lang").orderBy(F.col("score").desc())
    reached = of_score.withColumn("n", F.sum("n").over(above)).where(F.col("n") >= wanted)
    best = reached.groupBy("lang").agg(F.max("score").alias("least"))
    return langs.join(best, "lang", "left").select("lang", F.coalesce("least", F.lit(0)).cast("long").alias("least"))


def opened(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """(lang, phrase, flags) of the pairs in a round with these limits, to be made marks."""
    ahead = F.expr(f"cast({UNIT} as decimal(7,0)) * cast(a as decimal(18,0)) div cast(l as decimal(18,0))")
    behind = F.expr(f"cast({UNIT} as decimal(7,0)) * cast(a as decimal(18,0)) div cast(r as decimal(18,0))")
    bounds = [(ahead, BEGINS), (behind, ENDS), (F.col("score"), WATCHED)]
    flags = sum((F.when(b >= F.col("least"), flag).otherwise(0) for b, flag in bounds), F.lit(FREQUENT))
    return by_language(pairs, least).select("lang", "phrase", flags.alias("flags"))


def triples_of(pairs: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """Frequent triples with their worst cut: l, r, score; and the pairs they hold."""
    split = F.split("phrase", " ")
    names = [F.concat_ws(" ", split[i], split[i + 1]).alias(n) for i, n in enumerate(("head", "tail"))]
    triples = found.where(F.col("a") >= least).select("lang", "phrase", "a", *names)
    head = pairs.select("lang", F.col("phrase").alias("head"), F.col("l").alias("x"), F.col("a").alias("xy"))
    tail = pairs.select("lang", F.col("phrase").alias("tail"), F.col("r").alias("z"), F.col("a").alias("yz"))
    triples = triples.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    cuts = [
        F.struct(score("a", left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
        for k, (left, right) in enumerate((("x", "yz"), ("xy", "z")), 1)
    ]
    return triples.withColumn("cut", F.least(*cuts)).select("lang", "phrase", "a", "head", "tail", "cut.l", "cut.r", "cut.score")


def survivors(pairs: DataFrame, triples: DataFrame, least: DataFrame, covered: int) -> DataFrame:
    """The phrases that reach their language's limit and aren't put out by a longer one."""
    parts = triples.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a")
    longest = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    rows = pairs.join(longest, ["lang", "phrase"], "left")
    rows = rows.where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    rows = rows.select(*columns).unionByName(triples.select(*columns))
    return by_language(rows, least).where(F.col("score") >= F.col("least")).select(*columns)


def collocations(docs: DataFrame, limit: int = LIMIT, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `limit` best surviving phrases of every language."""
    scratch = Scratch(docs.sparkSession, "collocations")
    words = scratch.keep(counts(docs, 1).where((F.col("a") >= least) | (F.col("phrase") == "")), "words")
    totals = words.where("phrase = ''").select("lang", F.col("a").alias("n"))
    words = words.where((F.col("phrase") != "") & (F.col("a") >= least))
    marks = marked(words.withColumn("flags", F.lit(FREQUENT)))
    pairs = scratch.keep(pairs_of(words, counts(docs, 2, marks), least), "pairs")
    wanted = FIRST * limit
    langs = scratch.keep(totals.select("lang"), "langs")
    settled = []
    while True:
        bounds = scratch.keep(limits(pairs, wanted, langs), "limits")
        # pairs of settled languages are not marked, and so not counted again
        marks = marked(words.withColumn("flags", F.lit(FREQUENT)).select("lang", "phrase", "flags").unionByName(opened(pairs, bounds)))
        triples = scratch.keep(triples_of(pairs, counts(docs, 3, marks), least), "triples")
        found = scratch.keep(survivors(pairs, triples, bounds, covered), "survivors")
        sizes = found.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        state = bounds.join(sizes, "lang", "left")
        done = (F.col("least") == 0) | (F.coalesce("found", F.lit(0)) >= limit)
        settled.append(by_language(found, state.where(done).select("lang")))
        langs = scratch.keep(state.where(~done).select("lang"), "langs")
        if langs.isEmpty():
            break
        wanted *= MORE
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    columns = ["lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"]
    return by_language(rows, totals).select(*columns)
