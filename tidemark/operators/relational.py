"""Joins and set operations that panels need: as-of joins, calendars, upserts, alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scans
from tidemark.session import written


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str = "dt", period: Column | None = None) -> DataFrame:
    """Each left row with the newest right row of its keys on or before it, nulls without any.

    Both sides are stacked and ordered, so no range join is needed. Without ``period``, a key's rows meet in one sort,
    which spills. With one (a long that ascends with ``on``), rows are dealt by key and period, and the last right row is
    carried over the periods: a hot key, or no key at all (``keys`` empty), is then spread over tasks.
    """
    values = [c for c in right.columns if c not in (*keys, on)]
    own = [c for c in left.columns if c not in (*keys, on)]
    a = left.select(*keys, on, F.lit(1).alias("_side"), F.struct(*map(F.col, own)).alias("_left"), F.lit(None).cast(right.select(F.struct(*values).alias("x")).schema["x"].dataType).alias("_right"))
    b = right.select(*keys, on, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(*map(F.col, values)).alias("_right"))
    if period is None:
        upto = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
        rows = a.unionByName(b).withColumn("_found", F.last("_right", ignorenulls=True).over(upto))
    else:
        rows = scans.prefixes(written(a.unionByName(b), "stacked"), keys, [on, "_side"], period, {"_found": ("last", "_right")})
    return rows.where("_side = 1").select(*keys, on, *(F.col(f"_left.{c}").alias(c) for c in own), *(F.col(f"_found.{c}").alias(c) for c in values))


def next_day_pairs(panel: DataFrame) -> DataFrame:
    """(asset, dt, next_dt, ret): returns from one day of the common calendar to the next, where an asset has both."""
    days = panel.select("dt").distinct()
    calendar = days.withColumn("next_dt", F.lead("dt").over(Window.orderBy("dt")))  # one row per day
    a = panel.select("asset", "dt", "close").join(calendar, "dt")
    b = panel.select("asset", F.col("dt").alias("next_dt"), F.col("close").alias("next_close"))
    return a.join(b, ["asset", "next_dt"]).select("asset", "dt", "next_dt", (F.try_divide("next_close", "close") - 1).alias("ret"))


def outer_mean(frames: list[DataFrame], value: str, on: str = "dt") -> DataFrame:
    """Mean of a value over many frames by key, nulls and absences left out: a union and one aggregation, not outer joins."""
    return reduce(DataFrame.unionByName, frames).groupBy(on).agg(F.avg(value).alias(value))


def zipped_from_end(a: DataFrame, b: DataFrame, order: str = "dt") -> DataFrame:
    """Two series side by side by their places from the end, for as long as the shorter one is.

    A place is a row's place within its month plus the rows of all later months, so that only the months, one row each,
    are ordered together."""

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_month", F.trunc(order, "month"))
        later = Window.orderBy(F.desc("_month")).rowsBetween(Window.unboundedPreceding, -1)
        months = rows.groupBy("_month").agg(F.count("*").alias("_n")).select("_month", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
        inside = F.row_number().over(Window.partitionBy("_month").orderBy(F.desc(order)))
        return rows.withColumn("_inside", inside).join(months, "_month").withColumn("place", (F.col("_inside") + F.col("_later")).cast("int")).drop("_month", "_inside", "_later")

    x, y = placed(a), placed(b)
    return x.select("place", *(F.col(c).alias(f"a_{c}") for c in a.columns)).join(y.select("place", *(F.col(c).alias(f"b_{c}") for c in b.columns)), "place")


def merged_left(base: DataFrame, *others: DataFrame, on: str = "asset") -> DataFrame:
    """``base`` with the columns of all others; where several have a column, the last that isn't null counts."""
    for other in others:
        new = [c for c in other.columns if c != on]
        renamed = other.select(on, *(F.col(c).alias(f"_new_{c}") for c in new))
        rows = base.join(renamed, on, "left")
        kept = [F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in base.columns]
        base = rows.select(*kept, *(F.col(f"_new_{c}").alias(c) for c in new if c not in base.columns))
    return base


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the rows whose keys ``new`` has, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def common_days(panel: DataFrame, assets: list[str]) -> DataFrame:
    """The days on which all of ``assets`` traded."""
    rows = panel.where(F.col("asset").isin(*assets)).groupBy("dt").agg(F.count_distinct("asset").alias("_n"))
    return rows.where(F.col("_n") == len(set(assets))).select("dt")


def last_row(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """One row for each key: the last in ``order``."""
    first = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
