"""Lines that several documents share: all but the first document's are dropped. DataFrame operations alone.

A line's key is the line without white space at its ends, A-Z in lower case; keys shorter than ``shortest`` code
points never count. Each text is cut into lines once, and the keys' 128-bit digests are written as one array a
document (a third of a text's size at most). Each document's distinct digests are exploded and counted, with a partial
sum in each task, so a line that is in all documents is a few rows a task by the time it is shuffled. Digests with
``least`` documents or more are matched with the lines again: lines that can't match are dropped by a bitmap of
bounded size before the shuffle, and a very common line, which is in a list of bounded size, isn't shuffled. Dropped
positions are gathered by document (an array no longer than the document), and the text is put together from the
positions that are left, in time proportional to its lines.

Defined results: a null or empty text is one empty line; a text's only a document's first if its doc_id is the
smallest, and a null doc_id comes after all others; rows that share a doc_id count as documents each, and keep or
lose a key's lines together; a document that loses all its lines has the empty text; repeated lines inside one
document alone stay; an empty table gives no rows; other columns of the input aren't looked at. Two keys count as one
if half of their SHA-256 agrees, which does not happen.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.keyed import matched, possible
from tidemark.llm.shared import written

#: 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, and no other letter."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _digest(line: Column, shortest: int) -> Column:
    key = lower_ascii(F.btrim(line, F.lit(SPACES)))
    return F.when(F.char_length(key) >= shortest, F.substring(F.sha2(key, 256), 1, 32))


def _number(digest: str) -> Column:
    """64 bits of a digest, for the bitmap."""
    return F.xxhash64(digest)


def shared_keys(keys: DataFrame, least: int) -> DataFrame:
    """(digest, documents, first_id, number) of the digests that ``least`` documents or more have. ``keys``: doc_id and
    an array of digests a row."""
    rows = keys.select("doc_id", F.explode(F.array_distinct("digests")).alias("digest")).where("digest is not null")
    counted = rows.select("doc_id", F.unhex("digest").alias("digest")).groupBy("digest").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"))
    return counted.where(F.col("documents") >= least).withColumn("number", _number("digest"))


def deduplicated(docs: DataFrame, shortest: int = 10, least: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row of ``docs`` (doc_id long, text string): how many lines the text
    has, how many of them are dropped, and the text of the others."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows that share a doc_id are told apart by their texts' numbers; equal ones lose the same positions.
    marked = docs.withColumn("text_number", F.xxhash64("text"))
    keys = marked.select("doc_id", "text_number", F.transform(_lines("text"), lambda x: _digest(x, shortest)).alias("digests"))
    keys = written(keys, "line-keys", compression="zstd")
    shared = written(shared_keys(keys, least), "shared-lines")

    lines = keys.select("doc_id", "text_number", F.posexplode("digests").alias("position", "digest")).where("digest is not null")
    lines = possible(lines.withColumn("digest", F.unhex("digest")), _number("digest"), shared.select("number"), shared.count())
    later = matched(lines, shared.drop("number"), "digest", "documents").where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    dropped = later.groupBy("doc_id", "text_number").agg(F.collect_set("position").alias("dropped"))

    both = [F.col(f"d.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("doc_id", "text_number")]
    rows = marked.alias("d").join(dropped.alias("x"), both, "left").select("d.doc_id", _lines("text").alias("lines"), "dropped")
    rows = rows.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("dropped", F.array().cast("array<int>"))))
    text = F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), text.alias("kept"))
