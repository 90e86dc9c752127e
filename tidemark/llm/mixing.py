"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are laid end to end in a seeded shuffle, once per epoch with another shuffle, and cut into
blocks of ``BLOCK_TOKENS``. The mix is a sequence of slots. Slot i goes to the source in whose share of the unit
interval the i-th point of a golden-ratio sequence falls, shares being in proportion to the sources' targets; such
points fill every share evenly from the start, so any stretch of the mix has the target weights, and a source's
slots number its target over the block size, give or take a few. The j-th slot of a source takes its j-th block; its
last block ends where its target does, slots beyond that stay empty, and what is missing then follows at the end. So
a source's words are its target, whatever the size of blocks.

Points are integers modulo 2**31, and ranks and running sums of documents and slots come from buckets
(``shared.running``), so reruns agree and neither a hot source nor the schedule is ever in one task. Slots meet the
sources' shares by the first bits of their points, an equality join that is even however unequal the shares are. A
document meets the blocks that it lies in: one, and one more for each block's end in it. Only the sources' own rows,
one each and a few for missing blocks, are ranked together: some ten million sources would still fit into a task.

Defined results: a null text has size 0; documents of size 0 are never taken; null is a source of its own, after
all others; rows that share a doc_id, or have none, are taken separately, ``repeated`` included; an empty table gives
an empty mix; extra columns stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import buckets, key_bucket, running, shuffle_key, unused_name, written

BLOCK_TOKENS = 4096
#: 2**31 over the golden ratio, odd; and the cells of the points by which slots meet shares.
POINTS, GOLDEN, CELLS = 1 << 31, 1327217885, 1 << 12
SLOTS_A_BUCKET = 1 << 16


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """``sizes`` (source, source_size; a row per source) with target: all sizes times ``budget``, shared by the
    weights, which repeat over the sources in code point order; a source gets ``cap`` times its size at most, and
    what it can't take is shared among the others by weight.

    With sources in the order of size over weight, the full ones are the first few, so one pass finds how many."""
    by_name, by_need = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_need", F.col("source").asc_nulls_last())
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    rows = sizes.withColumn("_weight", F.get(kinds, (F.row_number().over(by_name) - 1) % len(weights))).withColumn("_need", F.col("source_size") * cap / F.col("_weight"))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.select(
        "*",
        F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0)).alias("_full"),
        F.coalesce(F.sum("_weight").over(before), F.lit(0.0)).alias("_full_weight"),
        F.sum("_weight").over(whole).alias("_all_weight"),
        (F.sum("source_size").over(whole) * budget).alias("_budget"),
    )
    rows = rows.withColumn("_level", (F.col("_budget") - F.col("_full")) / (F.col("_all_weight") - F.col("_full_weight")))
    # The level at which the first source that isn't full stands.
    level = F.min(F.when(F.col("_level") <= F.col("_need"), F.struct("_need", "_level"))).over(whole)["_level"]
    return rows.withColumn("_at", level).select("source", "source_size", F.least(F.col("source_size") * cap, F.coalesce(F.col("_weight") * F.col("_at"), F.col("source_size") * cap)).alias("target"))


def schedule(goals: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, source, block, words): which source's which block each slot of the mix takes, and how many words of it.
    ``goals``: source, target."""
    by_name, whole = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    upto = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(whole)
    ends = goals.where("target > 0").select("source", F.floor(upto * POINTS).cast("long").alias("_end"), F.row_number().over(by_name).alias("_n"), F.count("*").over(whole).alias("_of"))
    ends = ends.withColumn("_end", F.when(F.col("_n") == F.col("_of"), POINTS).otherwise(F.col("_end")))
    shares = ends.withColumn("_begin", F.lag("_end", 1, 0).over(by_name)).where("_begin < _end")
    width = POINTS // CELLS
    cells = shares.select("source", "_begin", "_end", F.explode(F.sequence(F.expr(f"_begin div {width}"), F.expr(f"(_end - 1) div {width}"))).alias("_cell"))
    total = int(goals.agg(F.ceil(F.sum("target") / block)).first()[0] or 0)
    slots = goals.sparkSession.range(total).withColumnRenamed("id", "slot")
    slots = slots.withColumn("_point", F.expr(f"((slot % {POINTS}) * {GOLDEN}) % {POINTS}")).withColumn("_cell", F.expr(f"_point div {width}"))
    taken = slots.join(cells, "_cell").where("_point >= _begin and _point < _end").select("slot", "source")
    taken = taken.withColumn("_bucket", F.expr(f"cast(slot div {SLOTS_A_BUCKET} as int)"))
    taken = running(taken, ["source"], "_bucket", [F.col("slot")], F.lit(1), "block").select("slot", "source", "block")
    wanted = goals.select(F.col("source").alias("_of"), F.floor("target").cast("long").alias("_words"))
    counts = taken.groupBy("source").agg(F.count("*").alias("_slots"))
    missing = wanted.join(counts, F.col("source").eqNullSafe(F.col("_of")), "left").withColumn("_slots", F.coalesce("_slots", F.lit(0)))
    missing = missing.where(F.col("_slots") * block < F.col("_words")).select("_of", "_words", F.explode(F.sequence("_slots", F.expr(f"(_words - 1) div {block}"))).alias("block"))
    missing = missing.select((F.row_number().over(Window.orderBy("block", F.col("_of").asc_nulls_last())) + (total - 1)).cast("long").alias("slot"), F.col("_of").alias("source"), "block", "_words")
    every = taken.join(wanted, F.col("source").eqNullSafe(F.col("_of"))).select("slot", "source", "block", "_words").unionByName(missing)
    return every.where(F.col("block") * block < F.col("_words")).select("slot", "source", "block", F.least(F.lit(block).cast("long"), F.col("_words") - F.col("block") * block).alias("words"))


def laid_out(docs: DataFrame, epochs: int, block: int, seed: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The pieces into which blocks cut the documents of size > 0 (doc_id, source, size, ``keys``): a row for each epoch,
    document and block with the words (first, end) of the document in it. row_at tells rows of a source apart; start is
    the document's place among the source's words."""
    parts = buckets(docs.count())
    rows = docs.where("size > 0")
    at = "_at0"
    for epoch in range(epochs):
        rows = rows.withColumn("_key", shuffle_key(f"{seed}{epoch}", "doc_id")).withColumn("_bucket", key_bucket("_key", parts))
        order = [F.col(c) for c in ("_key", "doc_id", "size", *keys, *([at] if epoch else []))]
        rows = running(rows, ["source"], "_bucket", order, F.col("size"), f"_at{epoch}", f"_all{epoch}").drop("_key", "_bucket")
    starts = F.explode(F.array(*(F.struct(F.lit(e).alias("epoch"), (F.col(f"_at{e}") + e * F.col("_all0")).alias("start")) for e in range(epochs))))
    rows = rows.select("doc_id", "source", "size", *keys, F.col(at).alias("row_at"), starts.alias("_e")).select("doc_id", "source", "size", *keys, "row_at", "_e.epoch", "_e.start")
    rows = rows.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    return rows.select(
        "*",
        F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("first"),
        F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")).alias("end"),
    )


def mix(docs: DataFrame, goals: DataFrame, epochs: int = 2, block: int = BLOCK_TOKENS, seed: str = "mix", keys: tuple[str, ...] = ()) -> DataFrame:
    """The mix: which words (first, end) of which document stand in which slot; pieces in no slot have none and no words."""
    pieces, slots = laid_out(docs, epochs, block, seed, keys), schedule(goals, block)
    slots = slots.select("slot", F.col("source").alias("_source"), F.col("block").alias("_block"), "words")
    found = pieces.join(slots, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    end = F.least("end", F.col("block") * block + F.coalesce("words", F.lit(0)) - F.col("start"))
    return found.withColumn("end", F.greatest("first", F.when(F.col("slot").isNull(), F.col("first")).otherwise(end))).drop("_source", "_block", "words")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, cap: int = 2, block: int = BLOCK_TOKENS, seed: str = "mix", keys: tuple[str, ...] = ()) -> DataFrame:
    """For every row of ``docs`` (doc_id, source, size): doc_id, source, size, source_size, target, taken; taken counts
    the words that the mix takes of it, repeats included. ``keys``: columns that tell rows of equal doc_id and size
    apart; they order them and stay in the result."""
    docs = written(docs.select("doc_id", "source", "size", *keys), "sizes")  # texts are counted once, however often sizes are read
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = written(targets(sizes, weights, budget, cap), "targets")
    rows = ["doc_id", "source", "size", *keys]
    taken = mix(docs, goals, cap, block, seed, keys).groupBy(*rows, "row_at").agg(F.sum(F.col("end") - F.col("first")).alias("taken"))
    whole = taken.select(*rows, "taken").unionByName(docs.where("size = 0").select(*rows, F.lit(0).cast("long").alias("taken")))
    goals = goals.select(F.col("source").alias("_of"), "source_size", "target")
    return whole.join(goals, F.col("source").eqNullSafe(F.col("_of"))).select(*rows, "source_size", "target", "taken")


def repeated(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` (doc_id, source and more) with each document once for every epoch in which the mix takes words of it:
    none to ``cap`` times. A document that a block's end cuts stays whole. Each row has a count of its own, whether its
    doc_id is null, shared or neither: rows are written once with a key, by which their counts find them again."""
    row, times, copy = unused_name(docs, "_row"), unused_name(docs, "_times"), unused_name(docs, "_copy")
    kept = written(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    sized = kept.select("doc_id", "source", word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"), F.col(row).alias("row_key"))
    taken = mix_sources(sized, **how, keys=("text_hash", "row_key")).where("taken > 0")
    taken = taken.select(F.col("row_key").alias(row), F.ceil(F.col("taken") / F.col("size")).cast("int").alias(times))
    rows = kept.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.select(*docs.columns)


def word_count(text: str) -> Column:
    """The words of a text: runs of characters that are neither 0x20 nor 0x09 to 0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
