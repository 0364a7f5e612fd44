"""Quality rules: simple counts, and how far a document is from its language.

Each document has a histogram of character classes and one of the common words
of its language. The reference of a language is the sum of the histograms of all
its documents that pass the simple rules. A document is rejected when the
Jensen-Shannon distance (base 2, so 0 to 1) of either histogram from the
reference is too large; a histogram of too few characters or words is not judged.

Built-in functions only. The texts are read once: the counts, a few dozen
numbers per document, are kept before the references are summed from them.

Cases: a null or empty text has no words and fails the simple rules; a null
language is a language of its own, and one without a word list is judged by its
characters alone; equal rows are judged alike; an empty table gives an empty
result. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import Scratch, words

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_CLASS_CHARS = 200
MIN_LIST_WORDS = 100
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.29

# Characters of each class; what is left are symbols and control characters.
CLASSES = {
    "lower": "a-z",
    "upper": "A-Z",
    "digit": "0-9",
    "space": "\\x09-\\x0D ",
    "punctuation": ".,;:!?'\"()\\-",
    "other": "\\x{80}-\\x{10FFFF}",
}

# The most common function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in is it that was for on are as with by be this from at a",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans a par sur au pas",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}


def outside(text: Column, members: str) -> Column:
    """How many characters of `text` are in the class."""
    return F.length(F.regexp_replace(text, f"[^{members}]+", ""))


def repeated_words(found: Column, windows: Column) -> Column:
    """Words in three-word windows that occur more than once.

    Equal windows are neighbours after sorting; of the windows' positions, each
    adds the words that the one before has not counted.
    """
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def twice(rows: Column) -> Column:
        same = F.filter(
            rows,
            lambda x, i: (F.get(rows, i + 1)["w"] == x["w"]) | (F.get(rows, i - 1)["w"] == x["w"]),
        )
        positions = F.sort_array(F.transform(same, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            positions,
            start,
            lambda acc, p: F.struct(
                (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"),
                p.alias("last"),
            ),
            lambda acc: acc["n"],
        )

    # the sorted rows are bound once: the lambda above refers to them for every element
    counted = F.transform(F.array(placed), twice)[0]
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), counted).otherwise(F.lit(0).cast("long"))


def word_list(lang: Column, lists: dict[str, str]) -> Column:
    none = F.array().cast("array<string>")
    cases = [F.when(lang == k, F.array(*map(F.lit, v.split()))) for k, v in lists.items()]
    return F.coalesce(*cases, none)


def longest(lists: dict[str, str]) -> int:
    """Bytes of the longest listed word; longer ones are not looked up."""
    return max([0, *(len(w.encode()) for v in lists.values() for w in v.split())])


def list_counts(found: Column, listed: Column, most: int) -> Column:
    """Occurrences of each listed word (of `most` bytes at most), in the list's order."""
    short = F.filter(found, lambda w: F.octet_length(w) <= most)
    hits = F.filter(F.transform(short, lambda w: F.array_position(listed, F.lower(w))), lambda p: p > 0)
    marks = F.sequence(F.lit(1).cast("long"), F.size(listed).cast("long") + 1)
    # with every number present once more, counts are distances between first places
    each = F.transform(
        F.array(F.sort_array(F.concat(hits, marks))),
        lambda g: F.transform(
            F.sequence(F.lit(1).cast("long"), F.size(listed).cast("long")),
            lambda k: F.array_position(g, k + 1) - F.array_position(g, k) - 1,
        ),
    )[0]
    return F.when(F.size(listed) > 0, each).otherwise(F.array().cast("array<bigint>"))


def counts(docs: DataFrame, lists: dict[str, str] = COMMON_WORDS) -> DataFrame:
    """doc_id, lang and everything that is counted in a document."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    rows = rows.withColumn("found", words(text)).withColumn("listed", word_list(F.col("lang"), lists))
    found = F.col("found")
    n = F.size(found)
    triples = F.transform(
        F.slice(found, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.concat(w, F.lit(" "), F.get(found, i + 1), F.lit(" "), F.get(found, i + 2)),
    )
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \t-\r]"))
    rows = rows.select("*", triples.alias("triples"), lines.alias("lines"))
    classes = {name: outside(text, members).cast("long") for name, members in CLASSES.items()}
    rows = rows.select(
        "doc_id",
        "lang",
        n.cast("long").alias("n_words"),
        F.length(text).cast("long").alias("n_chars"),
        outside(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(found, F.col("triples")).alias("n_repeat_words"),
        list_counts(found, F.col("listed"), longest(lists)).alias("listed_words"),
        *[c.alias(name) for name, c in classes.items()],
    )
    rest = F.col("n_chars") - reduce(Column.__add__, [F.col(c) for c in CLASSES])
    listed_sum = F.aggregate("listed_words", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "doc_id",
        "lang",
        "n_words",
        (F.col("n_chars") - F.col("space")).alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.array(*CLASSES, rest).alias("classes"),
        F.concat("listed_words", F.array(F.col("n_words") - listed_sum)).alias("word_counts"),
    )


def total(histogram: Column) -> Column:
    return F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x)


def distance(counted: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of the same buckets."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    shares = F.zip_with(
        F.transform(counted, lambda x: x / total(counted)),
        F.transform(reference, lambda x: x / total(reference)),
        lambda a, b: (part(a, b) + part(b, a)) / 2,
    )
    return F.sqrt(F.greatest(F.lit(0.0), total(shares)))


def base_failed() -> Column:
    repeated = F.col("n_repeat_words") * 100 > MAX_REPEATED_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | repeated


def references(counted: DataFrame, n_classes: int, list_sizes: dict[str, int]) -> DataFrame:
    """Per language the summed histograms of documents that pass the simple rules."""
    widest = max([0, *list_sizes.values()]) + 1
    sums = counted.where(~base_failed()).groupBy("lang").agg(
        F.array(*[F.sum(F.col("classes")[i]) for i in range(n_classes)]).alias("class_reference"),
        F.array(*[F.coalesce(F.sum(F.get("word_counts", F.lit(i))), F.lit(0)) for i in range(widest)]).alias("sums"),
    )
    size = F.lit(0)
    for lang, n in list_sizes.items():
        size = F.when(F.col("lang") == lang, n).otherwise(size)
    return sums.select("lang", "class_reference", F.slice("sums", 1, size + 1).alias("word_reference"))


def judged(docs: DataFrame, lists: dict[str, str] = COMMON_WORDS) -> DataFrame:
    """Every document's counts, its two distances (null if not judged), base_failed and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    counted = scratch.keep(counts(docs, lists), "counts")
    known = references(counted, len(CLASSES) + 1, {k: len(v.split()) for k, v in lists.items()})
    rows = counted.join(known, "lang", "left")
    enough_chars = (total(F.col("classes")) >= MIN_CLASS_CHARS) & F.col("class_reference").isNotNull()
    enough_words = (F.col("n_words") >= MIN_LIST_WORDS) & (F.size("word_reference") > 1)
    rows = rows.withColumn("class_distance", F.when(enough_chars, distance(F.col("classes"), F.col("class_reference"))))
    rows = rows.withColumn("word_distance", F.when(enough_words, distance(F.col("word_counts"), F.col("word_reference"))))
    rows = rows.withColumn("base_failed", base_failed())
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (
        F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE
    )
    return rows.withColumn("kept", ~F.col("base_failed") & ~far)
