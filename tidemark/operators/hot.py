"""Joins and ranks that no key or group with very many rows can slow down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scans
from tidemark.session import written

#: A key is hot if it has more than 1 in SHARE of all rows, and LEAST at least: there are SHARE hot keys at most.
SHARE, LEAST = 1024, 100_000
#: Ranges that the values of a group are cut into.
RANGES = 64


def _joined(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    more = [F.col(f"r.{c}") for c in table.columns if c not in keys] if how == "inner" else []
    return rows.alias("l").join(table.alias("r"), same, how).select("l.*", *more)


def matched(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: str, least: int = LEAST) -> DataFrame:
    """The rows with the columns of their ``keys`` in ``table``, which has each key once, in ``count`` how many rows have
    it, and in ``total`` how many rows there are. Rows of hot keys find theirs by broadcast; the others meet in a
    shuffle of which no key has a large part. Both are read more than once and should be written tables."""
    most = F.greatest(F.lit(least), F.col(total) / SHARE)
    hot = F.broadcast(table.where(F.col(count) > most))
    cold = _joined(rows, hot, keys, "left_anti")
    return _joined(rows, hot, keys).unionByName(_joined(cold, table.where(F.col(count) <= most), keys))


def placed(rows: DataFrame, groups: list[str], value: str, least: int = LEAST) -> DataFrame:
    """``rows`` (a written table) with below, ties and size: how many rows of the group have a smaller value, the same
    one, and any. Equal values are counted within each task first, the different ones are cut into ranges of about
    equal numbers, and what is below a range is carried to it; so no task holds a group."""
    counts = rows.groupBy(*groups, value).agg(F.count("*").alias("ties"))
    shares = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    cuts = counts.groupBy(*groups).agg(F.percentile_approx(value, shares, F.lit(10_000)).alias("_cuts"), F.sum("ties").alias("size"))
    whole = cuts.withColumn("_all", F.sum("size").over(scans.Window.partitionBy()))  # a row a group
    ranged = _joined(counts, whole, groups).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value))).cast("long")).drop("_cuts")
    found = scans.prefixes(written(ranged, "ranges"), groups, [value], F.col("_range"), {"_upto": ("sum", "ties")})
    found = written(found.withColumn("below", F.col("_upto") - F.col("ties")).select(*groups, value, "below", "ties", "size", "_all"), "places")
    return matched(rows, found, [*groups, value], "ties", "_all", least).drop("_all")


def ranked_in_ranges(rows: DataFrame, groups: list[str], value: Column, ties: list[str], out: str) -> DataFrame:
    """``rows`` (a written table) with their place from 1 within ``groups`` in the order of ``value`` and then ``ties``. A
    group is cut into ranges of the value, ranked each by itself, and what is below a range is carried to it."""
    shares = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    keyed = rows.withColumn("_value", value)
    cuts = keyed.groupBy(*groups).agg(F.percentile_approx("_value", shares, F.lit(10_000)).alias("_cuts"))
    ranged = _joined(keyed, cuts, groups).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_value"))).cast("long")).withColumn("_one", F.lit(1))
    found = scans.prefixes(written(ranged.drop("_cuts"), "ranges"), groups, ["_value", *ties], F.col("_range"), {out: ("sum", "_one")})
    return found.select(*rows.columns, F.col(out).cast("int").alias(out))


def percentile(below: Column, ties: Column, size: Column) -> Column:
    """The mean of the shares below a value and up to it, ties getting one row more, in per cent."""
    return F.lit(50.0) / size * (2 * below + ties + 1)
