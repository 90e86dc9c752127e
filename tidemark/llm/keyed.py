"""Matching rows with a table of keys, by DataFrame operations alone: a filter of bounded size that goes to all tasks
before anything is shuffled, and a join in which keys with very many rows never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import unused_name

#: Bits for each key, and at most 64 MB of them; beyond some fifty million keys the filter lets more through.
BITS_A_KEY, MOST_BITS = 16, 1 << 29
#: Bits of a row of the bitmap.
ROW_BITS = 1 << 15
#: A key is hot if it has more than 1 in HOT_SHARE of the rows that match, and HOT_ROWS at least: so there are HOT_SHARE hot keys at most.
HOT_SHARE, HOT_ROWS = 1024, 10_000


def _size(count: int) -> int:
    return min(MOST_BITS, max(ROW_BITS, 1 << (max(1, count * BITS_A_KEY) - 1).bit_length()))


def possible(rows: DataFrame, number: Column, keys: DataFrame, count: int) -> DataFrame:
    """The rows whose ``number`` (long) is among the ``count`` numbers of ``keys`` (one long column), and a few others.

    A bitmap of the numbers is broadcast: 64 MB at most, whatever ``count`` is. Null numbers never match.
    """
    bits = _size(count)
    bucket, row = unused_name(rows, "_bucket"), unused_name(rows, "_bits")
    own = F.pmod(F.col(keys.columns[0]), F.lit(bits)) + 1  # bitmap functions count from 1
    numbered = keys.select(own.alias("_own")).select(F.bitmap_bucket_number("_own").alias(bucket), F.bitmap_bit_position("_own").alias("_at"))
    bitmap = numbered.where(F.col(bucket).isNotNull()).groupBy(bucket).agg(F.bitmap_construct_agg("_at").alias(row))
    place = F.pmod(number, F.lit(bits))
    found = rows.withColumn(bucket, F.floor(place / ROW_BITS) + 1).join(F.broadcast(bitmap), bucket)
    at = F.pmod(place, F.lit(ROW_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(row), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, F.pmod(at, F.lit(8))) == 1).select(*rows.columns)


def matched(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """The rows joined with ``table``, which has one row a ``key`` and in ``count`` how many rows have it; ``how`` is
    inner or left.

    Hot keys are broadcast (``HOT_SHARE`` rows at most), so their rows aren't shuffled at all; the others meet in a
    shuffle of which no key has a large part. Both inputs are read more than once and should be written tables.
    """
    most = max(HOT_ROWS, (table.agg(F.sum(count)).first()[0] or 0) // HOT_SHARE)
    hot, cold = table.where(F.col(count) > most), table.where(F.col(count) <= most)
    warm = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(warm)
