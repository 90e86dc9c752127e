"""Ranking of assets: by score as of a date, by percentile within a risk band, and filters on the ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import hot, metrics, relational
from tidemark.session import written


#: Rows of history that an asset needs to be looked at, and to be scored, by the forecast's days; other forecasts need the last.
HISTORY = {20: 50, 40: 100, 60: 150}
LEAST_HISTORY, SCORED_HISTORY = 200, {40: 100}


def _by_window(days: Column, known: dict[int, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in known.items():
        out = F.when(days == k, v).otherwise(out)
    return out


def ranked(rows: DataFrame, groups: list[str], assets: DataFrame, score: str = "score", out: str = "rank") -> DataFrame:
    """``rows`` with their place by falling score within ``groups``, ties in the order of the universe."""
    order = Window.partitionBy(*groups).orderBy(F.desc(score), "ord")
    return rows.join(assets.select("asset", "ord"), "asset").withColumn(out, F.row_number().over(order))


def as_of_rankings(panel: DataFrame, assets: DataFrame, dates: DataFrame, momentum: float = -0.1, least_assets: int = 10, most: int = 50) -> DataFrame:
    """(dt, every, asset, rank, score, seen) for each row of ``dates`` (dt, every: days of the forecast): assets by their
    backtest score as of the day, from their newest bar (of day ``seen``).

    An asset counts as available if it has enough rows by then for the forecast and its last 63 returns sum to more than
    ``momentum``. With fewer than ``least_assets`` of them there is no ranking; of more than ``most``, the first in the
    order of the universe are scored."""
    rows = metrics.behaviour(panel).withColumn("history", F.count("close").over(S.so_far())).withColumn("recent", F.coalesce(F.sum("ret").over(S.last(63)), F.lit(0.0)))
    bars = rows.select("asset", "dt", F.col("dt").alias("seen"), "history", "recent", metrics.backtest_score().alias("score"))
    grid = dates.select("dt", "every").distinct().crossJoin(assets.select("asset", "ord"))
    found = relational.as_of(grid, bars, ["asset"]).where(F.col("history") >= _by_window(F.col("every"), HISTORY, LEAST_HISTORY)).where(F.col("recent") > momentum)
    whole = Window.partitionBy("dt", "every")
    found = found.withColumn("_n", F.count("*").over(whole)).withColumn("_k", F.row_number().over(whole.orderBy("ord"))).where((F.col("_n") >= least_assets) & (F.col("_k") <= most))
    found = found.where(F.col("history") >= _by_window(F.col("every"), SCORED_HISTORY, LEAST_HISTORY))
    return found.select("dt", "every", "asset", F.row_number().over(whole.orderBy(F.desc("score"), "ord")).alias("rank"), "score", "seen")


def top_as_of(panel: DataFrame, assets: DataFrame, as_of, n: int, every: int = 63, momentum: float = -0.1, least_assets: int = 10, most: int = 50) -> DataFrame:
    """(asset, rank, score, seen): the ``n`` best assets as of a day (the last one if None), by the rules of
    ``as_of_rankings``. For one day only each asset's newest rows are needed, and no task ever sorts the universe: the
    first ``most`` of it are taken by each task and then by all."""
    rows = panel if as_of is None else panel.where(F.col("dt") <= F.lit(as_of).cast("date"))
    known = metrics.newest(rows).select("asset", F.col("dt").alias("seen"), "history", "recent", metrics.backtest_score().alias("score"))
    known = known.where((F.col("history") >= HISTORY.get(every, LEAST_HISTORY)) & (F.col("recent") > momentum))
    known = written(known.join(assets.select("asset", "ord"), "asset"), "known")
    enough = known.agg((F.count("*") >= least_assets).alias("_enough"))
    first = known.orderBy("ord").limit(most).where(F.col("history") >= SCORED_HISTORY.get(every, LEAST_HISTORY)).crossJoin(F.broadcast(enough)).where("_enough")  # one row
    order = Window.partitionBy("_enough").orderBy(F.desc("score"), "ord")  # ``most`` rows
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("asset", "rank", "score", "seen")


def percentile_ranking(factors: DataFrame, inverted: tuple[str, ...] = ("cvar",)) -> DataFrame:
    """``factors``: (asset, band, metric, value), nulls left out. For each asset a map of percentiles by metric within its
    band, 100 minus for inverted metrics, their mean, and the rank within the band. Values and means are placed in their
    groups by ranges (``hot.placed``), so a band may hold any part of all assets."""
    rows = hot.placed(written(factors.where("value is not null"), "factors"), ["band", "metric"], "value")
    p = hot.percentile(F.col("below"), F.col("ties"), F.col("size"))
    rows = rows.withColumn("p", F.when(F.col("metric").isin(*inverted), 100 - p).otherwise(p))
    found = rows.groupBy("asset", "band").agg(F.round(F.avg("p"), 9).alias("percentile"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "p")))).alias("by_metric"))
    return hot.ranked_in_ranges(written(found, "percentiles"), ["band"], -F.col("percentile"), ["asset"], "rank")


def weighted_percentile(ranking: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The ranking with a weighted mean of its percentiles; metrics without a weight weigh one."""
    known = F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))))
    weight = lambda e: F.coalesce(known[e["key"]], F.lit(1.0))
    entries = F.map_entries("by_metric")
    zero = F.lit(0.0)
    top = F.aggregate(entries, zero, lambda acc, e: acc + e["value"] * weight(e))
    total = F.aggregate(entries, zero, lambda acc, e: acc + weight(e))
    return ranking.withColumn("weighted", F.try_divide(top, total))


def without_tail(ranking: DataFrame, least: dict[str, float]) -> DataFrame:
    """The ranking without assets whose percentile of a metric is known and below its bound."""
    for metric, bound in least.items():
        ranking = ranking.where(F.coalesce(F.col("by_metric")[metric] >= bound, F.lit(True)))
    return ranking


def strengths(ranking: DataFrame) -> DataFrame:
    """(asset, strengths, concerns, conviction): the three best and two worst metrics, and how many are at 70 or more."""
    entries = F.array_sort(F.transform(F.map_entries("by_metric"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    names = F.transform(entries, lambda e: e["k"])
    good = F.size(F.filter(F.map_values("by_metric"), lambda v: v >= 70))
    conviction = F.when(good >= 3, "HIGH").when(good >= 2, "MEDIUM").otherwise("LOW")
    return ranking.select("asset", "band", F.slice(names, 1, 3).alias("strengths"), F.slice(F.reverse(names), 1, 2).alias("concerns"), conviction.alias("conviction"))
