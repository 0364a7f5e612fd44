"""Files that hold one JSON array each, of any size, read in parallel.

A file is read as pieces that end at a closing brace, by as many tasks as it has byte
ranges (blocks). What a piece means depends on whether it begins inside a string and how
deep it is nested, which depends on all pieces before it. Both are sums: a piece turns
the string state as often as it has quotes, and adds its brackets outside strings to the
depth. So each block is summed up for both states it may begin in, the blocks of a file
are put in order (one row per block), and every piece then learns its own state from its
block's. Pieces are joined to the elements they belong to; most elements are one piece.

An element is parsed by itself. A file with an element that is no JSON, or whose brackets
don't add up, gives no elements: it is rejected as a whole, as it would be if it were
parsed at once. An array without any object in it is one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.functions.materialise import store
from tallyline.functions.skew import salted_join

BLOCK = ["file_path", "block"]
# Files beyond this size that don't begin as an array aren't parsed to word their rejection.
PARSED_WHOLE = 16 << 20
# Tables with a row per file are broadcast up to so many.
MOST_FILES = 100_000
NOT_JSON, NOT_ARRAY = "Input file must be valid JSON", "Input file must be an array"
BLANK = r"[ \t\n\r]*"


def one_slash(uri: Column) -> Column:
    """Spark writes a file's address with one slash or three; here it is one."""
    return F.regexp_replace(uri, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files' text up to each closing brace, with what the piece adds in either state.

    `row` rises with the place in the block. Written once: a second scan might be
    split otherwise.
    """
    text = spark.read.option("lineSep", "}").text(path)
    plain = F.regexp_replace("value", r"\\.", "")  # escapes go, so every quote left opens or closes a string
    strings = r'"[^"]*("|\z)'
    outside = F.regexp_replace(plain, strings, "")
    inside = F.regexp_replace(F.concat(F.lit('"'), plain), strings, "")
    depth = lambda t: (_count(t, "{[") - _count(t, "]")).cast("long")
    return store(
        text.select(
            one_slash(F.col("_metadata.file_path")).alias("file_path"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            "value",
            F.octet_length("value").cast("long").alias("size"),
            _count(plain, '"').cast("long").alias("quotes"),
            depth(outside).alias("deeper_outside"),
            depth(inside).alias("deeper_inside"),
        )
    )


def in_blocks(found: DataFrame) -> DataFrame:
    """Pieces with the sums over the earlier pieces of their block, for both states the block may begin in."""
    before = Window.partitionBy(*BLOCK).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    turned = found.withColumn("turned", so_far("quotes") % 2).withColumn("earlier_bytes", so_far(F.col("size") + 1))

    def step(state: int) -> Column:
        """What the piece and the brace behind it add to the depth, if the block begins in `state` (1: in a string)."""
        own = F.when(F.col("turned") == state, F.col("deeper_outside")).otherwise(F.col("deeper_inside"))
        ends_outside = (F.col("turned") + F.col("quotes") + state) % 2 == 0
        return own - F.when(ends_outside, 1).otherwise(0)

    steps = turned.withColumns({f"step{k}": step(k) for k in (0, 1)})
    return steps.withColumns({f"depth{k}": so_far(f"step{k}") for k in (0, 1)})


def begun(summed: DataFrame) -> DataFrame:
    """The state, depth and offset at which every block begins. A file has a row per block here."""
    blocks = summed.groupBy(*BLOCK).agg(
        (F.sum("quotes") % 2).alias("odd"),
        F.sum("step0").alias("all0"),
        F.sum("step1").alias("all1"),
        F.sum(F.col("size") + 1).alias("bytes"),
    )
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    stated = blocks.withColumn("in_string", so_far("odd") % 2).withColumn("offset", so_far("bytes"))
    own = F.when(F.col("in_string") == 0, F.col("all0")).otherwise(F.col("all1"))
    return stated.withColumn("own", own).withColumn("begin_depth", so_far("own")).select(*BLOCK, "in_string", "offset", "begin_depth")


def placed(summed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pieces with their offset and depth, and whether an element of the array ends with them."""
    rows = summed.join(blocks, BLOCK)
    outside = (F.col("in_string") + F.col("turned") + F.col("quotes")) % 2 == 0
    begins = F.when(F.col("in_string") == 0, F.col("depth0")).otherwise(F.col("depth1")) + F.col("begin_depth")
    step = F.when(F.col("in_string") == 0, F.col("step0")).otherwise(F.col("step1"))
    at = F.col("offset") + F.col("earlier_bytes")
    braced = at + F.col("size") < F.col("file_size")  # the file's last piece may have no brace behind it
    rows = rows.withColumns({"at": at, "braced": braced, "outside": outside, "ends_at": begins + step})
    return rows.withColumn("ends", F.col("braced") & F.col("outside") & (F.col("ends_at") == 1))


def by_file(rows: DataFrame, files: DataFrame, n_files: int, spread_by: str, how: str = "inner") -> DataFrame:
    """Join with a table of one row per file at most; one file may hold most rows."""
    if n_files <= MOST_FILES:
        return rows.join(F.broadcast(files), "file_path", how)
    return salted_join(rows, files, ["file_path"], F.col(spread_by), how)


def elements(spark: SparkSession, path: str, files: DataFrame, n_files: int) -> tuple[DataFrame, DataFrame]:
    """(file_path, place, raw) of the arrays' elements, and (file_path, file_error) of rejected files.

    `files` lists all files, `n_files` is their number. `place` rises with the place in the file.
    """
    found = pieces(spark, path)
    numbers = in_blocks(found.drop("value"))
    sums = begun(numbers)
    last = [F.max_by(c, "at").alias(c) for c in ("ends_at", "outside", "braced")]
    end = F.max(F.when(F.col("ends"), F.col("at") + F.col("size") + 1)).alias("last_end")
    known = store(placed(numbers, sums).groupBy(*BLOCK, "file_size", "in_string", "offset", "begin_depth").agg(end, *last))

    # the step of a last piece without brace has taken one away too many
    balanced = ~F.col("braced") & F.col("outside") & (F.col("ends_at") == -1)
    of_file = known.groupBy("file_path", "file_size").agg(*[F.max_by(c, "block").alias(c) for c in ("ends_at", "outside", "braced")])
    sign = F.substring(F.regexp_replace("value", f"^{BLANK}", ""), 1, 1)
    first = found.where("block = 0").groupBy("file_path").agg(F.min_by(sign, "row").alias("sign"))
    whole = of_file.join(first, "file_path").select("file_path", "file_size", "sign", balanced.alias("balanced"))
    whole = store(files.select("file_path").join(whole, "file_path", "left"))

    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    since = F.coalesce(F.max("last_end").over(earlier), F.lit(0)).alias("open_since")
    blocks = known.select(*BLOCK, "in_string", "offset", "begin_depth", since)
    blocks = blocks.join(whole.where((F.col("sign") == "[") & F.col("balanced")).select("file_path"), "file_path")
    kept = store(parsed(runs(placed(in_blocks(found), blocks))))
    bad = kept.where(F.col("place").isNull()).select("file_path").distinct()
    good = by_file(kept.where(F.col("place").isNotNull()), bad, n_files, "place", "left_anti")
    return good, rejected(found, whole, bad, n_files)


def runs(rows: DataFrame) -> DataFrame:
    """What stands up to the end of each object of an array, and behind the last: pieces put together.

    Most runs are one piece and stay where they are.
    """
    before = Window.partitionBy(*BLOCK).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.when(F.col("ends"), F.col("at") + F.col("size") + 1)).over(before)
    text = F.concat("value", F.when(F.col("braced"), "}").otherwise(""))
    rows = rows.select("file_path", "at", "ends", F.coalesce(ended, "open_since").alias("start"), text.alias("text"))
    alone = F.col("ends") & (F.col("at") == F.col("start"))
    single = rows.where(alone).select("file_path", "start", "text", F.lit(False).alias("is_last"))
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    several = rows.where(~alone).groupBy("file_path", "start").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), (~F.bool_or("ends")).alias("is_last")
    )
    return single.unionByName(several)


def parsed(found: DataFrame) -> DataFrame:
    """(file_path, place, raw) of the elements in runs; place and raw are null for a run that is no JSON."""
    is_first = F.col("start") == 0
    tail = F.when(F.col("is_last"), F.regexp_extract("text", r"\]" + BLANK + r"\z", 0)).otherwise("")
    found = found.withColumns({"head": F.regexp_extract("text", f"^{BLANK}" + r"[\[,]", 0), "tail": tail})
    inner = F.expr("substring(text, length(head) + 1, length(text) - length(head) - length(tail))")
    found = found.withColumn("inner", inner)
    opened = F.when(is_first, F.col("head").endswith("[")).otherwise(F.col("head").endswith(","))
    closed = ~F.col("is_last") | (F.col("tail") != "")
    blank = F.regexp_like("inner", F.lit(f"^{BLANK}\\z"))
    only_end = F.col("is_last") & ~is_first & F.regexp_like("text", F.lit(f"^{BLANK}\\]{BLANK}\\z"))
    listed = F.try_parse_json(F.concat(F.lit("["), "inner", F.lit("]")))
    valid = opened & closed & (~blank | (is_first & F.col("is_last")))
    payload = F.when(only_end, F.parse_json(F.lit("[]"))).when(valid, listed)
    found = found.select("file_path", "start", payload.alias("payload"))
    each = found.sparkSession.tvf.variant_explode(F.col("payload").outer())
    rows = found.where(F.col("payload").isNotNull()).lateralJoin(each)
    rows = rows.select("file_path", (F.col("start") + F.col("pos")).alias("place"), F.to_json("value").alias("raw"))
    nothing = [F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("raw")]
    return rows.unionByName(found.where(F.col("payload").isNull()).select("file_path", *nothing))


def rejected(found: DataFrame, whole: DataFrame, bad: DataFrame, n_files: int) -> DataFrame:
    """Files without an array, and why. Of large ones that begin otherwise it is only said that they are no array."""
    is_array = F.coalesce(F.col("sign") == "[", F.lit(False))
    other = whole.where(~is_array)
    small = by_file(found, other.where(F.col("file_size") <= PARSED_WHOLE).select("file_path"), n_files, "row")
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    small = small.groupBy("file_path", "file_size").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "}").alias("text"))
    # a brace at the very end is not seen in the pieces
    text = F.when(F.octet_length("text") < F.col("file_size"), F.concat("text", F.lit("}"))).otherwise(F.col("text"))
    small = small.select("file_path", F.try_parse_json(text).isNotNull().alias("is_json"))
    is_json = F.coalesce(F.col("is_json"), F.col("file_size") > PARSED_WHOLE, F.lit(False))
    named = other.join(small, "file_path", "left").select("file_path", F.when(is_json, NOT_ARRAY).otherwise(NOT_JSON).alias("file_error"))
    broken = whole.where(is_array & ~F.col("balanced")).select("file_path").unionByName(bad)
    return named.unionByName(broken.select("file_path", F.lit(NOT_JSON).alias("file_error")))
