"""Toxicity behind noisy spelling: texts are restored by a noisy channel, then scored.

**Channel.** A written token is a lattice: a letter may be itself, a repeated letter may
be none, a digit or sign may be a letter it looks like (`1` an i or l, `0` an o, ...), a
star any letter, or it may end a word, or nothing, and so may the blanks between single
letters. The Viterbi path under a character model (4-grams within words, counted over
all documents, interpolated) and the costs of the channel is the text as it was meant.

**Scores.** Words of the restored text count with their beginnings of 3 to 6 letters. Over
the labelled rows each of these has a share of toxic documents, of which the lower limit
of the Wilson interval is taken: what is rare proves little. Near copies (equal least hash
of three-word shingles) count as one document. A document is judged by the limits of its
strongest words, their number, and its length, by a logistic regression fitted on limits
that leave the row's own part of the labelled rows out.

Decoding is only needed where a reading could matter: all readings of a token have one
skeleton (look-alikes, repetitions and signs levelled), so tokens that look like plain
words are decoded only if their skeleton begins like that of a word that counts.

The character model reads every document; shares are fitted on at most `FIT_ROWS` labelled
rows, chosen by a hash of their ids, whose crc32(doc_id as text) mod 4 is not 2. Labels,
lang, source and doc_id play no part in a score. Texts don't move.

Cases: a null or empty text has no words and gets the score of a text without any that
count; labels that contradict each other and rows without id aren't fitted on; rows without
id are scored and not held out; without labels of both classes every score is 0; equal
texts get equal scores; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import give_back, least_hashed, small_batches

FIT_ROWS = 20_000
HELD_OUT = 2
THRESHOLD = 0.3
PARTS = 4  # of the labelled rows; each is judged with the shares of the others
# Deviations below an observed share that its lower limit lies.
DEVIATIONS = 2.5
# A word counts from this limit on; so many beginnings and words count at most.
COUNTS_FROM, MOST_COUNTED = 0.2, 50_000
BEGINNINGS = range(3, 7)
LONGEST = max(BEGINNINGS)
REMEMBERED = 200_000

# What digits and signs stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c",
}
ANY = "*"
# Costs of the channel, in natural logarithms.
OF_LEET, OF_ANY, OF_REPEAT, OF_END, OF_NOTHING, OF_BLANK = 1.0, 3.2, 0.7, 4.0, 1.5, 0.2

# Symbols of the character model: the end of a word, 26 letters, any other letter.
SYMBOLS = 28
_SYMBOL = np.zeros(256, np.int8)
for _c in range(26):
    _SYMBOL[97 + _c] = _SYMBOL[65 + _c] = _c + 1
_SYMBOL[128:192] = -1  # the rest of a character that has begun
_SYMBOL[192:] = SYMBOLS - 1
# Shares of the 4-, 3-, 2- and 1-gram estimates in the model.
MIXED = (0.6, 0.25, 0.1, 0.04)


def grams(text: str) -> np.ndarray:
    """Codes of the 4-grams of a text, each a symbol with the three before it in its word."""
    found = _SYMBOL[np.frombuffer(text.encode(), np.uint8)]
    found = np.concatenate([[0, 0, 0], found[found >= 0], [0]]).astype(np.int32)
    a, b, c, d = found[:-3], found[1:-2], found[2:-1], found[3:]
    b = np.where(c == 0, 0, b)
    a = np.where(b == 0, 0, a)
    codes = ((a * SYMBOLS + b) * SYMBOLS + c) * SYMBOLS + d
    return codes[(c > 0) | (d > 0)]


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs (-log) of a symbol after three others, from all texts. Its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            sums += np.bincount(grams("\n".join(batch.column(0).to_pylist())), minlength=SYMBOLS**4)
        codes = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(sums[codes])], ["code", "n"])
        give_back()

    texts = small_batches(docs.select("text").where("text is not null"))
    found = texts.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(SYMBOLS**4)
    sums[found["code"].to_numpy()] = found["n"].to_numpy()
    return costs(sums)


def costs(sums: np.ndarray) -> np.ndarray:
    four = sums.reshape((SYMBOLS,) * 4)
    share = np.full((SYMBOLS,) * 4, (1 - sum(MIXED)) / SYMBOLS)
    for n, weight in zip((4, 3, 2, 1), MIXED):
        counts = four.sum(axis=tuple(range(4 - n)), keepdims=True)
        share = share + weight * counts / np.maximum(counts.sum(axis=3, keepdims=True), 1)
    return -np.log(share).astype(np.float32)


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else SYMBOLS - 1


def edges(c: str, before: str, stars: bool = True) -> list[tuple[str, float]]:
    """What a written character may mean: (letter, blank or nothing; cost). Stars may be letters, if `stars`."""
    if c.isalpha():
        found = [(c, 0.0)]
        return found + [("", OF_REPEAT)] if c == before else found
    if c == " ":
        return [("", OF_BLANK), (" ", OF_END)]
    found = [(letter, OF_LEET) for letter in LEET.get(c, "")]
    if c == ANY:
        found = [(chr(97 + k), OF_ANY) for k in range(26)] if stars else []
    # of a run of signs all but the first are nothing for less
    return [*found, (" ", OF_END), ("", OF_REPEAT if c == before else OF_NOTHING)]


def decoded(written: str, model: np.ndarray) -> str:
    """The Viterbi path of a lattice: words as they were meant, with blanks between them."""
    # state: the three last symbols; for each the cost and the path as linked pairs
    paths: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
    before = ""
    # three stars in a row stand for no letters
    stars = 3 * ANY not in written
    for c in written.lower():
        following: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
        for meant, cost in edges(c, before, stars):
            for state, (total, path) in paths.items():
                if meant == "":
                    new, all_of_it, way = state, total + cost, path
                elif meant == " ":
                    ends = float(model[state][0]) if state != (0, 0, 0) else 0.0
                    new, all_of_it, way = (0, 0, 0), total + cost + ends, (path, meant)
                else:
                    s = symbol(meant)
                    new, all_of_it, way = (state[1], state[2], s), total + cost + float(model[state][s]), (path, meant)
                if new not in following or all_of_it < following[new][0]:
                    following[new] = all_of_it, way
        paths, before = following, c
    ends = [(cost + (float(model[s][0]) if s != (0, 0, 0) else 0.0), n) for n, (s, (cost, _)) in enumerate(paths.items())]
    path = list(paths.values())[min(ends)[1]][1]
    letters = []
    while path:
        path, meant = path
        letters.append(meant)
    return " ".join("".join(reversed(letters)).split())


# What surrounds words in ordinary texts.
AROUND = "\"'`.,;:!?%&#*~^_-–—…«»“”„‘’()[]{}<>/\\=|"
# What goes before and behind a token even where signs may be letters.
BEFORE, BEHIND = "\"'`.,;:?%&#~*^_-«»“„‘{[<", "\"'`.,;:?%&#~*^_-»”’}]>/"
SPACED = re.compile(r"(?<!\S)[^\W_](?:[ \t][^\W_]|[ \t][@$!|+*]){2,}(?!\w)")
_THRICE = re.compile(r"([^\W\d_])\1\1", re.IGNORECASE)
_TWICE = re.compile(r"([^\W\d_])\1")
_SKELETON = str.maketrans({k: v[0] for k, v in LEET.items()} | {"l": "i"})
_LEVELLED = re.compile(r"(.)\1+")


def skeleton(word: str) -> str:
    """The same for all readings of a token (but for stars)."""
    level = word.lower().translate(_SKELETON)
    if not level.isalpha():
        level = "".join(filter(str.isalpha, level))
    return _LEVELLED.sub(r"\1", level)


def noisy(token: str) -> bool:
    """Whether a token isn't written like a word: signs or digits among letters, letters again and again."""
    if not token.isalpha():
        return any(c.isalpha() for c in token)
    return bool(_THRICE.search(token)) or 3 * len(_TWICE.findall(token.lower())) >= len(token) > 3


def parts_of(token: str) -> list[str]:
    """The plain words of a token."""
    return re.findall(r"[^\W\d_]+", token.lower())


def readings(token: str, model: np.ndarray, wanted: frozenset[str] | None = None) -> list[str]:
    """The words that a token stands for, as written and, if it is noisy, as it was meant.

    With `wanted` (beginnings of skeletons) only those readings are sought that can matter.
    """
    inner = token.strip(AROUND)
    # signs at the end may be letters too
    whole = inner if inner == token else token.lstrip(BEFORE).rstrip(BEHIND)
    words = [inner.lower()] if inner.isalpha() else parts_of(inner)
    if not words or not (whole != inner or noisy(inner) or (wanted is not None and _TWICE.search(words[0]))):
        return words
    for written in {inner, whole}:
        if wanted is None or ANY in inner or begins(skeleton(written), wanted):
            words += [w for w in decoded(written, model).split() if w not in words]
    return words


def begins(bare: str, wanted: frozenset[str]) -> bool:
    return any(bare[:k] in wanted for k in range(1, LONGEST + 1))


def restored(text: str | None, model: np.ndarray) -> str:
    """A text with its noisy tokens decoded; the others stay, without the signs around them."""
    text = SPACED.sub(lambda m: decoded(m[0], model), text or "")
    out = []
    for token in text.split():
        inner = token.strip(AROUND)
        out.append(decoded(inner, model) if noisy(inner) else inner)
    return " ".join(x for x in out if x)


def beginnings(word: str) -> list[str]:
    """A word, and its beginnings, which end in a dash."""
    return [word, *[word[:k] + "-" for k in BEGINNINGS if len(word) >= k]]


class Words:
    """For written tokens the words that count and their limits. Remembered, as tokens repeat."""

    def __init__(self, limits: dict[str, float], model: np.ndarray):
        self.limits, self.model = limits, model
        self.shortest = min(BEGINNINGS)
        names = {x.rstrip("-") for x in limits}
        self.starts = frozenset(x[: self.shortest] for x in names)
        self.wanted = frozenset(skeleton(x)[:LONGEST] for x in names) - {""}
        self.harmless: set[str] = set()
        self.known: dict[str, tuple] = {}

    def limit(self, word: str) -> float:
        if word[: self.shortest] not in self.starts:
            return 0.0
        return max(self.limits.get(x, 0.0) for x in beginnings(word))

    def looked_up(self, token: str) -> tuple:
        word = token.strip(".,;:").lower()
        plain = word.isalpha() and not _TWICE.search(word)
        words = (word,) if plain else readings(token, self.model, self.wanted)
        return tuple((w, p) for w in words if w[: self.shortest] in self.starts and (p := self.limit(w)))

    def of_tokens(self, tokens: set[str]) -> dict[str, float]:
        """The words that count among what the tokens stand for."""
        counted: dict[str, float] = {}
        for token in tokens.difference(self.harmless):
            found = self.known.get(token)
            if found is None:
                found = self.looked_up(token)
                if len(token) < 64:
                    if found:
                        self.known[token] = found
                    else:
                        self.harmless.add(token)
            counted.update(found)
        if len(self.harmless) + len(self.known) > REMEMBERED:
            self.harmless.clear()
            self.known.clear()
        return counted

    def of(self, text: str | None) -> list[float]:
        """Numbers about a text: its two strongest words, how many count, its length."""
        tokens = (text or "").split()
        counted = self.of_tokens(set(tokens))
        for span in SPACED.finditer(text or ""):
            counted.update(self.of_tokens(set(decoded(span[0], self.model).split())))
        strongest = sorted(counted.values(), reverse=True)[:2] + [0.0, 0.0]
        odds = [float(np.log(max(p, 0.05) / (1 - min(p, 0.995)))) for p in strongest[:2]]
        return [*odds, float(np.log1p(len(counted))), float(np.log1p(len(tokens)))]


N_NUMBERS = 4


def seen_in(text: str | None, model: np.ndarray) -> set[str]:
    """All words of a text, as written and as restored, with their beginnings."""
    spaced = " ".join(decoded(m[0], model) for m in SPACED.finditer(text or ""))
    tokens = set((text or "").split()) | set(spaced.split())
    return {x for t in tokens for w in readings(t, model) for x in beginnings(w)}


def copy_key(text: str | None) -> int:
    """The least hash of a text's three-word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").lower().split()
    n = min(3, len(words))
    return min((xxh64_intdigest(" ".join(words[i : i + n])) for i in range(len(words) - n + 1)), default=0) >> 1


def is_held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def fitted_on(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, toxic) of the labelled rows to fit on. Their ids, a bounded number, go to the documents."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~is_held_out())
    agreed = usable.groupBy("doc_id").agg(F.min("toxic").alias("least"), F.max("toxic").alias("most"))
    chosen = least_hashed(agreed.where("least = most"), fit_rows, "doc_id")
    ids = chosen.select("doc_id", F.col("least").cast("int").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")


def shares(rows: DataFrame, model: np.ndarray) -> pd.DataFrame:
    """Word or beginning, and in how many clean and toxic documents of each part it is.

    Only those of at least two toxic documents: the others never count.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([copy_key(t.as_py()) for t in batch.column(0)], pa.int64())
            seen = pa.array([sorted(seen_in(t.as_py(), model)) for t in batch.column(0)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([keys, batch.column(1), seen], ["copy", "toxic", "seen"])
        give_back()

    seen = rows.mapInArrow(keyed, "copy long, toxic int, seen array<string>")
    each = seen.select("copy", "toxic", F.explode("seen").alias("word")).groupBy("copy", "toxic", "word").count()
    cells = [F.count_if((F.col("toxic") == t) & (F.pmod("copy", F.lit(PARTS)) == k)).alias(f"n{t}{k}") for t in (0, 1) for k in range(PARTS)]
    found = each.groupBy("word").agg(*cells)
    toxic, all_of = (sum(F.col(f"n{t}{k}") for t in ts for k in range(PARTS)) for ts in ((1,), (0, 1)))
    # what can't reach the limit in any part needn't go to the driver
    limit = lower(toxic, all_of, F.sqrt)
    return found.where((toxic >= 2) & (limit >= COUNTS_FROM / 2)).orderBy(limit.desc(), "word").limit(MOST_COUNTED).toPandas()


def lower(k, n, root=np.sqrt):
    """Lower limit of the Wilson interval of k of n."""
    z = DEVIATIONS
    share = k / n
    return (share + z * z / (2 * n) - z * root(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def limits_of(found: pd.DataFrame, left_out: int | None = None) -> dict[str, float]:
    """Words and beginnings that count, with their limits, without one part of the rows."""
    parts = [k for k in range(PARTS) if k != left_out]
    toxic = sum((found[f"n1{k}"] for k in parts), 0).to_numpy(float)
    clean = sum((found[f"n0{k}"] for k in parts), 0).to_numpy(float)
    limit = lower(toxic, np.maximum(toxic + clean, 1))
    keep = limit >= COUNTS_FROM
    return dict(zip(found["word"][keep], limit[keep].tolist()))


class Model(NamedTuple):
    characters: np.ndarray
    limits: dict[str, float]
    weights: np.ndarray

    def chance(self, numbers: np.ndarray) -> np.ndarray:
        odds = numbers @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(odds, -35, 35)))


def fit_logistic(numbers: np.ndarray, toxic: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Bias and weights by Newton steps."""
    x = np.column_stack([np.ones(len(numbers)), numbers])
    w = np.zeros(x.shape[1])
    keep = np.array([0.0] + [ridge] * numbers.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - toxic) + keep * w
        second = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep + 1e-9)
        step = np.linalg.solve(second, gradient)
        w -= step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
    return w


def trained(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    rows = small_batches(fitted_on(docs, labels, fit_rows))
    characters = character_model(docs)
    found = shares(rows, characters)
    of_part = [limits_of(found, k) for k in range(PARTS)]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Words(limits, characters) for limits in of_part]
        for batch in batches:
            keys = [copy_key(t.as_py()) for t in batch.column(0)]
            numbers = [words[k % PARTS].of(t.as_py()) for k, t in zip(keys, batch.column(0))]
            arrays = [pa.array(keys, pa.int64()), batch.column(1), pa.array(numbers, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["copy", "toxic", "numbers"])
        give_back()

    seen = rows.mapInArrow(judged, "copy long, toxic int, numbers array<double>")
    sample = seen.groupBy("copy", "toxic").agg(F.max("numbers").alias("numbers")).toPandas()
    sample = sample.sort_values(["copy", "toxic"], ignore_index=True)
    if sample["toxic"].nunique() < 2:
        return None
    weights = fit_logistic(np.array(sample["numbers"].tolist()), sample["toxic"].to_numpy() == 1)
    return Model(characters, limits_of(found), weights)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    if model is None:
        score = F.lit(0.0)
    else:

        @F.pandas_udf("double")
        def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words = Words(model.limits, model.characters)
            for texts in batches:
                numbers = np.array([words.of(t) for t in texts]).reshape(-1, N_NUMBERS)
                yield pd.Series(model.chance(numbers))
            give_back()

        score = judge("text")
    rows = small_batches(docs.select("doc_id", "text")).select("doc_id", is_held_out().alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    return scored(docs, trained(docs, labels, **limits))

