"""Quality classifier by co-training: one view of the words, one of the page's data.

Two logistic regressions see different things: the words of a text (hashed words,
endings and shapes), and what is known about it without reading it (source,
language, length, lines, shares of character classes). Both start from the same
labelled rows. In every round each labels the rows of an unlabelled pool it is
surest of, and these go into the other's training set. At the end each view is
calibrated on labelled rows that neither has seen, and their log-odds are added,
less the log-odds of the classes themselves, which both contain.

A document is rejected when the odds are against it. The limit is lowered, if
need be, until at most `MOST_LOST` of the good calibration rows are rejected.

Fitting sees at most `FIT_ROWS` labelled and `POOL_ROWS` unlabelled documents, chosen
by a hash of their ids; every document is scored, whole, where it lies.

Cases: a null or empty text has no words and is judged by the other view and the
class shares; null source, language or n_chars are values of their own; labels
that contradict each other, and rows without id, aren't fitted on; without
labels of both classes nothing is rejected; equal rows are scored alike; an
empty table gives an empty result. Further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from operator import eq
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import Scratch, give_back, least_hashed, small_batches

FIT_ROWS = 2500
POOL_ROWS = 2500
ROUNDS = 5
# Share of the pool that each view labels for the other in a round, and how sure it has to be.
SHARE = 0.06
SURE = 0.95
HELD_OUT = 4  # every fourth labelled row is for calibration
MOST_LOST = 0.002
WORD_BITS = 14
REMEMBERED = 50_000
WORD_SIZE = (1 << WORD_BITS) + 4
# Words, and characters of ordinary classes, that every text is taken to have
# besides its own: so little is concluded from very short texts.
MORE_WORDS = 20
MORE_CHARS = np.array([30, 1, 0.5, 7, 1, 0.5])
BINS = 8
STEPS = 60


class WordFeatures(dict):
    """Three hashed features of a word: itself, its ending, its shape. Remembered, as words repeat."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        mask = (1 << WORD_BITS) - 1
        tail = word.rstrip("0123456789").rstrip()[-3:]
        letters = word.isupper(), word.istitle(), word.isalpha(), word.isdigit()
        last = word[-1] if not word[-1].isalnum() else ""
        shape = f"{letters}{last}{min(len(word), 12) // 4}"
        names = f"w{word.lower()}", f"e{tail}", f"s{shape}"
        found = np.array([crc32(x.encode()) & mask for x in names], np.int32).tobytes()
        if len(word) < 64:
            self[word] = found
        return found


_WORDS = WordFeatures()


def word_features(text: str | None) -> np.ndarray:
    """Features of all words of a text, and of each whether it repeats the one before or is new."""
    words = (text or "").split()
    found = np.frombuffer(b"".join(map(_WORDS.__getitem__, words)), np.int32)
    again = np.fromiter(map(eq, words, words[1:]), np.int32)
    new = len(set(words))
    extra = (1 << WORD_BITS) + np.concatenate([again, np.full(new, 2), np.full(len(words) - new, 3)])
    return np.concatenate([found, extra.astype(np.int32)])


def page_features(text: str | None, source: str | None, lang: str | None, n_chars: float | None) -> list[float]:
    """Numbers about a page, then the hashed source and language."""
    text = text or ""
    lines = text.split("\n")
    raw = text.encode()
    classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6) if raw else np.zeros(6)
    filled = [x for x in lines if x.strip()]
    ended = sum(x.rstrip()[-1] in ".!?:;" for x in filled)
    return [
        float(n_chars) if n_chars is not None and n_chars == n_chars else -1.0,
        len(lines),
        len(text) / len(lines),
        max(map(len, lines)),
        ended / max(1, len(filled)),
        len(set(filled)) / max(1, len(filled)),
        *((classes + MORE_CHARS) / (len(raw) + MORE_CHARS.sum())),
        crc32(f"source {source}".encode()) % 64,
        crc32(f"lang {lang}".encode()) % 16,
    ]


def _classes() -> np.ndarray:
    of = np.full(256, 5, np.int64)  # everything beyond ASCII
    for n in range(128):
        c = chr(n)
        of[n] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4
    return of


_CLASS = _classes()
N_NUMBERS = 12


class Rows(NamedTuple):
    """A sparse matrix: for each entry its row, feature and value."""

    n: int
    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.feature], self.n)

    def back(self, errors: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, self.value * errors[self.row], size)

    def only(self, chosen: np.ndarray) -> Rows:
        place = np.full(self.n, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        keep = place[self.row] >= 0
        return Rows(len(chosen), place[self.row[keep]], self.feature[keep], self.value[keep])


def counted(features: np.ndarray) -> np.ndarray:
    """The distinct features, then how often each is there."""
    ids, counts = np.unique(features, return_counts=True)
    return np.concatenate([ids, counts]).astype(np.int32)


def word_rows(texts: Iterable[np.ndarray]) -> Rows:
    """A row per text (`counted` features): square roots of the features' shares, so that lengths compare."""
    row, feature, value = [], [], []
    n = 0
    for both in texts:
        ids, counts = both[: len(both) // 2], both[len(both) // 2 :]
        row.append(np.full(len(ids), n, np.int32))
        feature.append(ids)
        value.append(np.sqrt(4 * counts / (counts.sum() + 5 * MORE_WORDS)).astype(np.float32))
        n += 1
    kinds = (row, np.int32), (feature, np.int32), (value, np.float32)
    return Rows(n, *[np.concatenate(x).astype(k) if x else np.empty(0, k) for x, k in kinds])


def page_rows(features: np.ndarray, edges: np.ndarray) -> Rows:
    """A row per page: the bin of every number, the source, and the language."""
    n = len(features)
    bins = [(features[:, [k]] >= edges[k][None, :]).sum(axis=1) + k * (BINS + 1) for k in range(N_NUMBERS)]
    first = N_NUMBERS * (BINS + 1)
    columns = np.column_stack([*bins, first + features[:, -2], first + 64 + features[:, -1]]).astype(int)
    return Rows(n, np.repeat(np.arange(n), columns.shape[1]), columns.ravel(), np.full(columns.size, 0.5))


PAGE_SIZE = N_NUMBERS * (BINS + 1) + 64 + 16


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Logistic(NamedTuple):
    weights: np.ndarray
    bias: float

    def odds(self, rows: Rows) -> np.ndarray:
        return rows.times(self.weights) + self.bias


def fit_logistic(rows: Rows, good: np.ndarray, size: int, penalty: float = 1e-3) -> Logistic:
    """Regularised logistic regression, classes weighed alike, by accelerated gradient steps."""
    share = good.mean()
    weigh = np.where(good, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(good)
    weights, bias = np.zeros(size), 0.0
    ahead, ahead_bias, momentum = weights, bias, 1.0
    rate = 4.0 / (1 + max(1e-9, np.bincount(rows.row, rows.value**2, rows.n).max()))
    for _ in range(STEPS):
        error = weigh * (sigmoid(rows.times(ahead) + ahead_bias) - good)
        step = ahead - rate * (rows.back(error, size) + penalty * ahead)
        step_bias = ahead_bias - rate * error.sum()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = step + (momentum - 1) / following * (step - weights)
        ahead_bias = step_bias + (momentum - 1) / following * (step_bias - bias)
        weights, bias, momentum = step, step_bias, following
    return Logistic(weights, bias)


def calibration(odds: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn a view's odds into log-odds of its held-out rows (Newton steps)."""
    # targets a little off 0 and 1, so that separable rows give finite odds
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(40):
        p = sigmoid(slope * odds + shift)
        gradient = np.array([((p - target) * odds).sum() + 1e-3 * (slope - 1), (p - target).sum()])
        w = p * (1 - p) + 1e-6
        second = np.array([[(w * odds * odds).sum() + 1e-3, (w * odds).sum()], [(w * odds).sum(), w.sum()]])
        move = np.linalg.solve(second, gradient)
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
        slope, shift = slope - move[0], shift - move[1]
    return max(float(slope), 0.0), float(shift)


class Model(NamedTuple):
    words: Logistic
    page: Logistic
    edges: np.ndarray
    of_words: tuple[float, float]
    of_page: tuple[float, float]
    prior: float
    limit: float

    def log_odds(self, words: Rows, page: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds of the word view, the page view, and both."""
        a = self.of_words[0] * self.words.odds(words) + self.of_words[1]
        b = self.of_page[0] * self.page.odds(page) + self.of_page[1]
        return a, b, a + b - self.prior


def surest(odds: np.ndarray, free: np.ndarray, share: float, good_share: float) -> tuple[np.ndarray, np.ndarray]:
    """The free rows a view is surest of, as many of each class as its share of them."""
    wanted = max(1, int(share * len(odds)))
    order = np.argsort(-odds, kind="stable")
    order = order[free[order]]
    sure = np.log(SURE / (1 - SURE))
    good = [i for i in order[: max(1, round(wanted * good_share))] if odds[i] > sure]
    bad = [i for i in order[::-1][: max(1, round(wanted * (1 - good_share)))] if odds[i] < -sure]
    chosen = np.array(good + bad, int)
    return chosen, np.arange(len(chosen)) < len(good)


def fit(words: Rows, pages: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> Model | None:
    """Co-training on rows whose label is 1 (good), 0, or -1 (none). None without both classes to fit and calibrate."""
    labelled = np.flatnonzero(label >= 0)
    held = labelled[::HELD_OUT]
    known = np.setdiff1d(labelled, held)
    pool = np.flatnonzero(label < 0)
    if min(len(set(label[known])), len(set(label[held]))) < 2:
        return None
    edges = np.quantile(pages[:, :N_NUMBERS], np.arange(1, BINS + 1) / (BINS + 1), axis=0).T
    page = page_rows(pages, edges)
    good_share = float((label[known] == 1).mean())
    views = [(words, WORD_SIZE), (page, PAGE_SIZE)]
    # each view's own training rows; pseudo-labels come from the other
    rows_of = [known, known]
    labels_of = [label[known] == 1] * 2
    free = [np.ones(len(pool), bool), np.ones(len(pool), bool)]
    models: list[Logistic] = []
    for n in range(rounds + 1):
        models = [fit_logistic(v.only(r), g, size) for (v, size), r, g in zip(views, rows_of, labels_of)]
        if n == rounds or not len(pool):
            break
        for own, other in ((0, 1), (1, 0)):
            odds = models[own].odds(views[own][0].only(pool))
            chosen, good = surest(odds, free[other], SHARE, good_share)
            free[other][chosen] = False
            rows_of[other] = np.append(rows_of[other], pool[chosen])
            labels_of[other] = np.append(labels_of[other], good)
    truth = label[held] == 1
    fits = [calibration(m.odds(v.only(held)), truth) for m, (v, _) in zip(models, views)]
    prior = float(np.log((truth.sum() + 1) / ((~truth).sum() + 1)))
    model = Model(*models, edges, *fits, prior, 0.0)
    both = model.log_odds(words.only(held), page.only(held))[2]
    return model._replace(limit=min(0.0, float(np.quantile(both[truth], MOST_LOST, method="lower"))))


def page_columns() -> list[Column]:
    return [F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars").cast("double").alias("n_chars")]


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int, pool_rows: int) -> pd.DataFrame:
    """Bounded: label, page features and word features (bytes) of the rows to fit on, in order of ids."""
    agreed = labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
    agreed = agreed.agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    of_ids = Scratch(docs.sparkSession, "cotraining").keep(ids.join(agreed, "doc_id", "left"), "ids")
    fitted = least_hashed(of_ids.where("least = most"), fit_rows, "doc_id")
    pool = least_hashed(of_ids.where("least is null"), pool_rows, "doc_id")
    chosen = fitted.select("doc_id", F.col("least").cast("int").alias("label")).unionByName(
        pool.select("doc_id", F.lit(-1).alias("label"))
    )
    found = small_batches(docs).select("doc_id", *page_columns()).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for b in batches:
            pages = [page_features(*x) for x in zip(b["text"], b["source"], b["lang"], b["n_chars"])]
            words = [counted(word_features(t)).tobytes() for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "page": pages, "words": words})
        give_back()

    rows = found.mapInPandas(run, "doc_id long, label int, page array<double>, words binary")
    return rows.dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id", ignore_index=True)


def trained(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS, rounds: int = ROUNDS
) -> Model | None:
    rows = sample(docs, labels, fit_rows, pool_rows)
    if not len(rows):
        return None
    words = word_rows(np.frombuffer(w, np.int32) for w in rows.pop("words"))
    return fit(words, np.array(rows["page"].tolist()), rows["label"].to_numpy(), rounds)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with a struct `quality`: chances of being good by words, by page and by both, and kept.

    A column of that name is replaced.
    """
    kind = "words double, page double, good double, kept boolean"
    if model is None:
        nothing = [F.lit(None).cast("double").alias(n) for n in ("words", "page", "good")]
        return docs.withColumn("quality", F.struct(*nothing, F.lit(True).alias("kept")))

    @F.pandas_udf(kind)
    def judge(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        parts = []
        for at in range(0, len(text), 500):
            few = slice(at, at + 500)
            pages = np.array([page_features(*x) for x in zip(text[few], source[few], lang[few], n_chars[few])])
            words = word_rows(counted(word_features(t)) for t in text[few])
            parts.append(model.log_odds(words, page_rows(pages, model.edges)))
        a, b, both = (np.concatenate(x) for x in zip(*parts)) if parts else [np.empty(0)] * 3
        found = {"words": sigmoid(a), "page": sigmoid(b), "good": sigmoid(both), "kept": both >= model.limit}
        return pd.DataFrame(found)

    return small_batches(docs).withColumn("quality", judge(*page_columns()))


def kept(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject."""
    names = [F.col(f"row.`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    wide = rows.select("row", *[F.col(f"row.{c}").alias(c) for c in ("text", "source", "lang", "n_chars")])
    return scored(wide, trained(docs, labels, **limits)).where("quality.kept").select(*names)
