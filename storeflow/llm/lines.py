"""Fuzzy line dedup by MinHash, in DataFrame functions only.

A line is the set of its character shingles: 12 characters from every character
on, fewer at the end. A band of the signature is made of three minhashes.
Lines that share a band are compared by the Jaccard similarity of their whole
sets, and the links are closed by distributed union-find; the first line of a
component stays. Bands with many different lines are compared in pairs of blocks.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.llm import blocks, work
from storeflow.llm.tables import table

SHINGLE = r"(?s)(?=(.{1,12}))."
WIDTH = 12
STRETCH = 32  # characters; the number of shingles in a row divides it
RUN = 32  # shingles of a line that are one row
BYTES = 4  # of a character in UTF-32
BANDS = 7
ROWS = 3  # a pair of similarity s shares a band with a chance of 1 - (1 - s**3)**7: 0.993 at 0.8, 0.9995 at 0.87
PERCENT = 80
LEAF = 1000  # lines that are compared in one row; larger nodes are dealt to pairs of blocks
DEPTH = 8  # without effect: large nodes do not branch
WORDS = 32  # of 64 bits, in the bitmap of a line's hashes; a power of two. Pairs that it cannot tell apart are compared by sets
FIRST = 4  # words of it that are compared before the rest
SEED = 0x9E3779B97F4A7C15


def shingles(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(SHINGLE), F.lit(1))


def _wide(line: Column) -> Column:
    """The text with as many bytes for every character, so that a shingle is found without counting to it."""
    return F.encode(line, "UTF-32")


def _cut(wide: Column, at: Column, many: int) -> Column:
    """As many shingles of a ``_wide`` text together, from that byte (0, 4, ...) on."""
    return F.substring(wide, at + 1, F.lit(BYTES * (many + WIDTH - 1)))


def _all_hashes(line: Column) -> Column:
    def hashes(wide: Column) -> Column:
        places = F.sequence(F.lit(0), F.octet_length(wide) - BYTES, F.lit(BYTES))
        return F.transform(places, lambda at: F.xxhash64(_cut(wide, at, 1)))

    # One encoding of the line, as the element of an array.
    some = F.element_at(F.transform(F.array(_wide(line)), hashes), 1)
    return F.when(F.length(line) > 0, some).otherwise(F.array().cast("array<bigint>"))


def _hashes(line: Column) -> Column:
    return F.array_distinct(_all_hashes(line))


def _runs(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(key, h0, h1, ...): the hashes of ``RUN`` shingles a row, of lines that are not empty.

    Past the end of a line the row's first hash stands in, which changes no set and no minimum.
    """
    wide = lines.select(key, _wide(F.col(line)).alias("wide"))
    count = (F.octet_length("wide") / BYTES).cast("int")
    places = wide.withColumn("count", count).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("count") - 1, F.lit(RUN))))
    runs = places.select(key, _cut(F.col("wide"), BYTES * F.col("at"), RUN).alias("run"), (F.col("count") - F.col("at")).alias("many"))
    hashed = runs.select(key, "many", *(F.xxhash64(_cut(F.col("run"), F.lit(BYTES * r), 1)).alias(f"h{r}") for r in range(RUN)))
    return hashed.select(key, *(F.when(F.col("many") > r, F.col(f"h{r}")).otherwise(F.col("h0")).alias(f"h{r}") for r in range(RUN)))


def _bitmaps(lines: DataFrame) -> DataFrame:
    """(id, n, w0, w1, ...) of lines (id, text): the size of the set of shingles, and a bitmap with a bit for every hash."""
    h, one = F.col("h"), F.lit(1).cast("long")
    runs = F.collect_list(F.array(*(f"h{r}" for r in range(RUN))))
    sets = _runs(lines, "id", "text").groupBy("id").agg(F.array_distinct(F.flatten(runs)).alias("set"))
    bits = sets.select("id", F.explode("set").alias("h")).select(
        "id", F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int")).alias("bit"),
        F.shiftright(h, 6).bitwiseAND(F.lit(WORDS - 1)).alias("word"),
    )
    some = bits.groupBy("id", "word").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("many"))
    words = (F.coalesce(F.max(F.when(F.col("word") == w, F.col("bits"))), F.lit(0).cast("long")) for w in range(WORDS))
    return some.groupBy("id").agg(F.sum("many").alias("n"), *(word.alias(f"w{w}") for w, word in enumerate(words)))


def _orders() -> list[int]:
    """One number for each minhash; hashes are ordered after an exclusive or with it.

    The numbers are spread evenly over the range of hashes, so that minhashes pick
    different ones.
    """
    many = BANDS * ROWS
    step = (1 << 64) // many
    numbers = [n * step + (SEED * (n + 1)) % (1 << 64) // 64 for n in range(many)]
    return [n - (1 << 64) if n >= 1 << 63 else n for n in numbers]


def _minhashes(lines: DataFrame) -> DataFrame:
    """(line_id, m0, m1, ...): per order the least hash of a line's shingles, one row per different line.

    A few shingles at a time are a row on its way to an aggregate, which keeps a
    line's least hashes and nothing else, so a line of any length takes the same
    memory.
    """
    def least(order: int) -> Column:
        return F.least(*(F.col(f"h{r}").bitwiseXOR(F.lit(order)) for r in range(RUN)))

    return _runs(lines, "line_id", "line").groupBy("line_id").agg(
        *(F.min(least(order)).alias(f"m{n}") for n, order in enumerate(_orders()))
    )


def _orders_of(band: int) -> list[int]:
    """The orders of a band. Neighbouring ones would pick the same hash of a short line, far ones rarely all agree."""
    return [(ROWS * band + 4 * r) % (BANDS * ROWS) for r in range(ROWS)]


def _bands() -> Column:
    """The bands of a line, each made of some of its minhashes."""
    return F.array(*(F.xxhash64(F.lit(b), *(f"m{n}" for n in _orders_of(b))) for b in range(BANDS)))


def _lines(rows: DataFrame) -> DataFrame:
    """(id, text_id, line_no, line, line_id) for every line that is not blank."""
    return (
        rows.select("id", F.xxhash64("text").alias("text_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.trim("line") != "")
        .withColumn("line_id", F.xxhash64("line"))
    )


def _similar(percent: int) -> Callable[[Column, Column, Column, Column], Column]:
    """Whether two lines (n, w0, ...) with their sets are of this similarity; sizes and bitmaps spare most comparisons."""

    def similar(x: Column, y: Column, x_set: Column, y_set: Column) -> Column:
        total = x["n"] + y["n"]
        sized = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
        # Every bit that differs stands for a shingle that only one line has; with
        # more of them than this the threshold is out of reach.
        # A few words rule out most pairs, and those that they leave are compared by all.
        def near(words: int) -> Column:
            apart = reduce(operator.add, (F.bit_count(x[f"w{w}"].bitwiseXOR(y[f"w{w}"])) for w in range(words)))
            return (100 + percent) * apart <= (100 - percent) * total

        common = F.size(F.array_intersect(x_set, y_set))
        return sized & near(FIRST) & near(WORDS) & ((100 + percent) * common >= percent * total)

    return similar


def _forest(lines: Column, similar: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """Links (a, b) that connect the roots of similar lines (root, line): one fewer than roots at most.

    Line by line, each is compared with the earlier ones that are not yet
    connected with it; the parts of those that are similar become one.
    """
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    start = F.struct(F.transform(lines, lambda x: x["root"]).alias("part"), none.alias("links"))

    def add(found: Column, i: Column) -> Column:
        mine, line = F.get(found["part"], i), F.get(lines, i)["line"]

        def meet(met: Column, j: Column) -> Column:
            part, other = F.get(found["part"], j), F.get(lines, j)["line"]
            # A part that the line has met needs no second comparison.
            new = (j < i) & (part != mine) & ~F.array_contains(met, part)
            return F.when(new & similar(other, line, other["set"], line["set"]), F.array_append(met, part)).otherwise(met)

        met = F.aggregate(F.sequence(F.lit(0), i), F.array().cast("array<bigint>"), meet)
        joined = F.transform(met, lambda part: F.struct(part.alias("a"), mine.alias("b")))
        # One evaluation of ``met``, which holds the work, as the element of an array.
        return F.element_at(F.transform(F.array(joined), lambda new: F.when(F.size(new) == 0, found).otherwise(F.struct(
            F.transform(found["part"], lambda p: F.when(F.exists(new, lambda n: n["a"] == p), mine).otherwise(p)).alias("part"),
            F.concat(found["links"], new).alias("links"),
        ))), 1)

    return F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), start, add, lambda found: found["links"])


def _links(spark: SparkSession, rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between line ids that connect all similar pairs found in a shared band."""
    lines = _lines(rows)
    nodes = _minhashes(lines).select(F.col("line_id").alias("id"), _bands().alias("bands"))
    members = work.shared(work.written(nodes, "bands").select(F.explode("bands").alias("node"), "id"))
    needed = members.select(F.col("id").alias("line_id")).distinct()
    full = lines.join(needed, "line_id", "left_semi").select("line_id", "line").dropDuplicates(["line_id"])
    full = full.select(F.col("line_id").alias("id"), F.col("line").alias("text"))
    bits = [f"w{w}" for w in range(WORDS)]
    full = full.join(_bitmaps(full), "id")
    # The text is an eighth of its hashes; they are computed again where lines meet.
    full = work.written(full, "sets")

    similar = _similar(percent)

    def check(pairs: DataFrame) -> DataFrame:
        left = full.select(F.col("id").alias("a"), F.struct("text", "n", *bits).alias("x"))
        right = full.select(F.col("id").alias("b"), F.struct("text", "n", *bits).alias("y"))
        same = similar(F.col("x"), F.col("y"), _all_hashes(F.col("x.text")), _all_hashes(F.col("y.text")))
        return pairs.join(left, "a").join(right, "b").where(same).select("a", "b")

    def compare(nodes: DataFrame) -> DataFrame:
        # About LEAF members at most: one row holds a node.
        # Few bytes, but much to compare: not to be put together in a few tasks.
        dealt = nodes.join(full, "id").repartition(2 * blocks.buckets(spark), "node")
        line = F.struct(_all_hashes(F.col("text")).alias("set"), "n", *bits).alias("line")
        whole = dealt.groupBy("node").agg(F.collect_list(F.struct("root", line)).alias("all"))
        return whole.select(F.explode(_forest(F.col("all"), similar)).alias("link")).select("link.*").distinct()

    return work.connect(members, check, compare, LEAF)


def line_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """``id_col``, text_id, line_no, line_id, class_id, kept for every line that is not blank.

    Lines end at a line feed and are numbered from 0. Equal lines share a line
    id; lines of similarity ``percent`` hundredths or more share a class, and the
    first of a class by id, text and number is kept. Null ids come last.

    Blank lines, null and empty texts give no rows, and blank lines are never
    removed. Rows that repeat id and text are judged as one: their lines are kept
    or removed together. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = blocks.narrow(docs, id_col, text_col)
    places = work.written(_lines(rows).drop("line"), "places")
    roots = work.written(work.components(_links(spark, rows, percent)), "roots")
    classed = places.join(roots.select(F.col("node").alias("line_id"), "root"), "line_id", "left").withColumn(
        "class_id", F.coalesce("root", "line_id")
    )
    place = F.struct(F.col("id").isNull().alias("last"), "id", "text_id", "line_no")
    first = classed.groupBy("class_id").agg(F.min(place).alias("first"))
    return classed.join(first, "class_id").select(
        F.col("id").alias(id_col), "text_id", "line_no", "line_id", "class_id", (place == F.col("first")).alias("kept")
    )


def without_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs``, all columns, without the lines that ``line_classes`` does not keep.

    Every row stays, at worst with an empty text; a text that loses nothing is
    unchanged, nulls included.
    """
    gone = (
        line_classes(docs, id_col, text_col, percent)
        .where("not kept")
        .groupBy(F.col(f"`{id_col}`").alias("id"), "text_id")
        .agg(F.collect_set("line_no").alias("gone"))
    )
    key = F.col(f"`{id_col}`").cast("long")
    text_id = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    # The row in a struct: its columns may have any names.
    packed = docs.select(key.alias("id"), text_id.alias("text_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("text_id").alias("gone_text"), "gone")
    joined = packed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_id") == F.col("gone_text")), "left")
    parts = F.split(F.col("row")[text_col], "\n")
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")))
    rest = F.array_join(F.transform(stay, lambda n: F.get(parts, n)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(rest)
    return joined.select(*((text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
SQL: dict[str, str] = {}
