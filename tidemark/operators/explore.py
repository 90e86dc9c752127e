"""Filters, summaries and checks of a universe of assets, and of nested documents about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(term: str, *columns: str) -> Column:
    """Whether one of the columns contains a term as it is, regardless of case; nulls don't."""
    found = [F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def matches(pattern: str, *columns: str) -> Column:
    """Whether one of the columns matches a regular expression, regardless of case."""
    found = [F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False)) for c in columns]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def filter_universe(universe: DataFrame, bands: list[str] | None = None, score: tuple[float, float] | None = None, term: str | None = None, forecast: str | None = None, volatility: tuple[float, float] | None = None, volume: float | None = None, expense: float | None = None) -> DataFrame:
    """The assets that meet all conditions that are given, best score first. ``volume`` is the least mean_volume and
    ``expense`` the most expense; a universe without such a column isn't filtered by it."""
    rows = universe
    if bands:
        rows = rows.where(F.col("band").isin(*bands))
    if score:
        rows = rows.where(F.col("score").between(*score))
    if volatility:
        rows = rows.where(F.col("volatility").between(*volatility))
    if forecast:
        rows = rows.where({"positive": F.col("forecast") > 0, "negative": F.col("forecast") < 0, "strong": F.col("forecast") > 5}[forecast])
    if volume is not None and "mean_volume" in universe.columns:
        rows = rows.where(F.col("mean_volume") >= volume)
    if expense is not None and "expense" in universe.columns:
        rows = rows.where(F.col("expense") <= expense)
    if term:
        rows = rows.where(contains(term, "asset", "name"))
    return rows.orderBy(F.desc("score"), "asset")


def lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The first row with a key, if any."""
    return rows.where(F.col(key) == value).limit(1)


def where_equal(rows: DataFrame, **values: object) -> DataFrame:
    for column, value in values.items():
        rows = rows.where(F.col(column) == value)
    return rows


def without_name(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The rows without a name of their own: none, an empty one, or the key."""
    return rows.where(F.col(name).isNull() | (F.col(name) == "") | (F.col(name) == F.col(key)))


def extremes(rows: DataFrame, value: str, n: int, best: bool = True, key: str = "asset") -> DataFrame:
    """The ``n`` rows with the highest value, or the lowest, with their place. Each task passes on ``n`` rows at most."""
    order = [F.desc(value) if best else F.col(value), F.col(key)]
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # ``n`` rows


def summary(universe: DataFrame) -> DataFrame:
    """Counts, means and extremes by band and, with a null band, of all."""
    return universe.rollup("band").agg(
        F.count("*").alias("assets"), F.avg("score").alias("mean_score"), F.min("score").alias("least"), F.max("score").alias("most"),
        F.count_if(F.col("forecast") > 0).alias("rising"), F.max_by("asset", F.struct("score", "asset")).alias("best"),
    )


def availability(rows: DataFrame) -> DataFrame:
    """Counts by status, by region and by kind, each by itself: grouping sets in one pass."""
    sets = [[F.col("status")], [F.col("region")], [F.col("kind")]]
    return rows.groupingSets(sets, "status", "region", "kind").agg(F.count("*").alias("assets"))


def status(panel: DataFrame, as_of, least: int = 1000, stale: int = 30) -> DataFrame:
    """(asset, status): whether an asset has enough rows and recent ones."""
    found = panel.groupBy("asset").agg(F.count("*").alias("n"), F.datediff(as_of, F.max("dt")).alias("age"))
    return found.select("asset", F.when(F.col("n") < least, "short").when(F.col("age") > stale, "stale").otherwise("ok").alias("status"))


#: The range in which the values of some series must lie.
RANGES = {"vix": (5.0, 100.0), "aud_usd": (0.3, 2.0), "au_10y": (0.0, 20.0), "us_10y": (0.0, 20.0), "gold": (10.0, 500.0)}


def series_quality(series: DataFrame, as_of: Column, least: int = 100, missing: float = 0.05, stale: int = 7) -> DataFrame:
    """(name, points, issues): what is wrong with each series, as a list."""
    ranges = F.create_map(*(x for name, (low, high) in RANGES.items() for x in (F.lit(name), F.array(F.lit(low), F.lit(high)))))
    found = series.groupBy("name").agg(F.count("*").alias("points"), F.avg(F.col("value").isNull().cast("double")).alias("gap"), F.datediff(as_of, F.max("dt")).alias("age"), F.min("value").alias("low"), F.max("value").alias("high"))
    bounds = ranges[F.col("name")]
    issues = F.array(
        F.when(F.col("points") < least, "few points"), F.when(F.col("gap") > missing, "gaps"), F.when(F.col("age") > stale, "stale"), F.when((F.col("low") < bounds[0]) | (F.col("high") > bounds[1]), "out of range")
    )
    return found.select("name", "points", F.filter(issues, lambda x: x.isNotNull()).alias("issues"))


def with_holdings(found: DataFrame, holdings: DataFrame, least: int = 5) -> DataFrame:
    """``status`` rows, where assets that are ok but have fewer than ``least`` holdings (``holdings``: asset, holdings) become
    "few holdings"."""
    few = F.coalesce(F.col("holdings"), F.lit(0)) < least
    return found.join(holdings, "asset", "left").select("asset", F.when((F.col("status") == "ok") & few, "few holdings").otherwise(F.col("status")).alias("status"))


def series_summary(series: DataFrame) -> DataFrame:
    return series.groupBy("name").agg(
        F.count("value").alias("points"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.max_by("value", "dt").alias("latest"), F.min("dt").alias("first"), F.max("dt").alias("last"), F.count_distinct("dt").alias("days"),
    )


def ends(groups: DataFrame, value: str, n: int = 3) -> DataFrame:
    """The ``n`` best and the ``n`` worst rows by a value, with their side and place; a row that is both counts as best."""
    top, bottom = extremes(groups, value, n), extremes(groups, value, n, best=False)
    rows = top.withColumn("side", F.lit("top")).unionByName(bottom.join(top.select("asset"), "asset", "left_anti").withColumn("side", F.lit("bottom")))
    return rows.select("asset", value, "side", "place")


def primary(holdings: DataFrame, key: str, group: str, weight: str) -> DataFrame:
    """The group with the greatest weight for each key, ties by name."""
    sums = holdings.groupBy(key, group).agg(F.sum(weight).alias("weight"))
    return sums.groupBy(key).agg(F.max_by(group, F.struct(F.col("weight"), F.col(group))).alias(group), F.max("weight").alias("weight"))
