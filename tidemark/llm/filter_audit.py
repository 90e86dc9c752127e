"""How filters interact: what each removes, in every order of them, of what the others have left.

Five filters look at a whole text: A few words, B few distinct words, C many capitals, D special characters, E the
same text as a document of a smaller id. Each document gets a mask of the filters that it fails; documents are counted
by part, mask and labels, and all orders follow from those counts, which are at most 128 rows a part.

E is by partition refinement. Texts are split by their length in code points; then classes are split by the hash of
the next block of the text, block after block, each sixteen times as long as what was read before, and classes of one
are dropped at every step: only texts that agree so far are read on. At last the full texts of a class are compared
(they are the grouping key), and each row is told the smallest id of its text. Hashes only ever leave too many
together, so no result rests on them.

Every step sends a bitmap of bounded size to the tasks (``keyed.possible``) and writes the rows that pass, so the only
texts that are shuffled are those of the last comparison, and equal ones meet within each task first. Rows of a very
common text find their class by broadcast (``keyed.matched``), not in a shuffle.

Defined results: a null text is empty; null and empty parts are one; a row without id is later than all rows with one,
and fails E if one of those has its text; rows that share the smallest id of a text all pass E; documents without label
are neither good nor toxic, and of several labels of an id one is enough; an empty table gives no rows; other columns
of the input aren't looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.keyed import matched, possible
from tidemark.llm.shared import written

FILTERS = "ABCDE"
#: The filter that looks at other documents has the last bit.
DUPLICATE = 1 << FILTERS.index("E")
#: Code points of the first block, and how many times longer each prefix is than the one before.
FIRST_BLOCK, GROWTH = 64, 16
#: In as many of the 120 orders is one of so many failing filters the first of them.
FIRST_OF = {k: 120 // k for k in range(1, 6)}


def failures(text: Column) -> Column:
    """The bits of filters A to D that a text (not null) fails."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    total, distinct = F.size(words), F.size(F.array_distinct(words))
    failed = (
        total < 100,
        100 * distinct.cast("long") < 80 * total.cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.char_length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    )
    mask = F.lit(0)
    for i, fails in enumerate(failed):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    return mask


def _classes(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The values of ``key`` (long) that two rows or more have, as a written table, and their number."""
    found = written(rows.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").select(key), "classes")
    return found, found.count()


def _block(hashed: Callable[..., Column], start: int, end: int) -> Column:
    """The class of a row after the block from ``start`` to ``end``; a text that ended before has no such block."""
    return F.when(F.col("length") > start, hashed("class", F.substring("text", start + 1, end - start))).otherwise(F.col("class"))


def duplicates(docs: DataFrame, first_block: int = FIRST_BLOCK, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """The rows of ``docs`` (doc_id long, text string, not null, and others) whose text has a smaller doc_id too, with
    ``first_id``: the smallest. ``hashed`` makes a long of columns; it decides only what is compared."""
    sized = docs.withColumn("length", F.char_length("text")).withColumn("class", F.col("length").cast("long"))
    lengths, count = _classes(sized.select("class"), "class")
    names = [*docs.columns, "length", "class"]
    alike = possible(sized, F.col("class"), lengths, count).withColumn("class", _block(hashed, 0, first_block)).select(*names)
    known = first_block
    while True:
        shared, count = _classes(alike.select("class"), "class")
        alike = written(possible(alike, F.col("class"), shared, count), "alike")
        if alike.where(F.col("length") > known).isEmpty():
            break
        alike = alike.withColumn("class", _block(hashed, known, known * GROWTH)).select(*names)
        known *= GROWTH

    texts = alike.groupBy("class", "text").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first_id"))
    texts = written(texts, "texts")
    by_class = texts.groupBy("class").agg(F.count("*").alias("texts"), F.sum("rows").alias("rows"), F.first("first_id").alias("first_id")).where("rows > 1")
    by_class = written(by_class, "equal-texts")
    clean = matched(alike, by_class.where("texts = 1").drop("texts"), "class", "rows")
    # Different texts in one class, which a hash does not often leave, find their own text by its contents.
    mixed = alike.join(by_class.where("texts > 1").select("class"), "class", "left_semi").join(texts.where("rows > 1"), ["class", "text"])
    both = clean.select(*docs.columns, "first_id").unionByName(mixed.select(*docs.columns, "first_id"))
    return both.where((F.col("doc_id") > F.col("first_id")) | F.col("doc_id").isNull() & F.col("first_id").isNotNull())


def _steps(spark) -> DataFrame:
    """(before, own, filter_order, step): the filter ``own`` (its bit) of every order's step, and the bits of those before it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            rows.append((before, 1 << i, "".join(FILTERS[j] for j in order), step))
            before |= 1 << i
    return spark.createDataFrame(rows, "before int, own int, filter_order string, step int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, failed filters and labels. ``docs``: doc_id, part, text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("part", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    cells = ("doc_id", "part", failures(F.col("text")).alias("mask"))
    every = docs.select(*cells, F.lit(1).alias("n"))
    # A duplicate moves from its mask to the one with E.
    later = duplicates(docs).select(*cells)
    moved = later.select("doc_id", "part", F.explode(F.array(F.struct(F.col("mask"), F.lit(-1).alias("n")), F.struct((F.col("mask") + DUPLICATE).alias("mask"), F.lit(1).alias("n")))).alias("x")).select("doc_id", "part", "x.mask", "x.n")
    rows = every.unionByName(moved)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    with_id = rows.where("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    without = rows.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    return with_id.unionByName(without).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and shapley. ``docs``: doc_id, part, text; ``labels``: doc_id, quality, toxic."""
    cells = written(masks(docs, labels), "masks")
    pairs = [(before, 1 << i) for i in range(len(FILTERS)) for before in range(1 << len(FILTERS)) if not before >> i & 1]
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(own).alias("own")) for b, own in pairs)))
    rows = cells.withColumn("x", each).select("part", "mask", "good", "toxic", "n", "x.*")
    mask, before, own = F.col("mask"), F.col("before"), F.col("own")
    reached, fails = mask.bitwiseAND(before) == 0, mask.bitwiseAND(own) != 0
    first_of = F.coalesce(*(F.when(F.bit_count("mask") == k, F.lit(orders)) for k, orders in FIRST_OF.items()), F.lit(0))

    def total(condition: Column, weight: Column = F.lit(1)) -> Column:
        return F.sum(F.when(condition, F.col("n") * weight).otherwise(0)).cast("long")

    counts = rows.groupBy("part", "before", "own").agg(
        total(reached & ~fails).alias("kept"),
        total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"),
        total(mask == own).alias("unique_fails"),
        total(reached & fails, F.col("good")).alias("good_lost"),
        total(reached & fails, F.col("toxic")).alias("toxic_lost"),
        total(fails, first_of).alias("shapley"),
    )
    orders = _steps(docs.sparkSession)  # 600 rows
    return counts.join(F.broadcast(orders), ["before", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
