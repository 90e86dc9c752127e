"""Correlation regimes: rolling correlations of pairs of series, their dispersion, and a class for every fifth day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S

#: The pairs whose correlations tell a regime.
PAIRS = {"gold_equity": ("gold", "equity"), "aud_gold": ("aud_usd", "gold"), "vix_rates": ("vix", "us_10y"), "equity_bonds": ("equity", "us_10y")}


def correlations(series: DataFrame, window: int = 21, least: int = 16) -> DataFrame:
    """(dt, pair, corr): rolling correlations of the pairs' returns from one common day to the next."""
    frames = []
    for pair, (a, b) in PAIRS.items():
        x, y = (series.where((F.col("name") == n) & F.col("value").isNotNull()).select("dt", F.col("value").alias(c)) for n, c in ((a, "x"), (b, "y")))
        frames.append(x.join(y, "dt").withColumn("pair", F.lit(pair)))
    rows = reduce(DataFrame.unionByName, frames).withColumns({c: S.simple_return(c, key="pair") for c in ("x", "y")}).where("x is not null and y is not null")
    found = rows.withColumn("corr", S.rolling(F.corr("x", "y").over(S.last(window, "pair")), "x", window, least, key="pair"))
    return found.where(F.col("corr").isNotNull() & ~F.isnan("corr")).select("dt", "pair", "corr")


def daily(series: DataFrame) -> DataFrame:
    """A row per day with a known correlation: each pair's, how many there are, their dispersion where all are known,
    and the mean of their absolute values. The dispersion counts as one of them."""
    picked = [F.max(F.when(F.col("pair") == p, F.col("corr"))).alias(p) for p in PAIRS]
    rows = correlations(series).groupBy("dt").agg(F.count("*").alias("_pairs"), F.stddev_samp("corr").alias("_sd"), F.sum(F.abs("corr")).alias("_sum"), *picked)
    whole = F.col("_pairs") == len(PAIRS)
    known = F.col("_pairs") + whole.cast("int")
    return rows.select("dt", *PAIRS, F.when(whole, F.col("_sd")).alias("dispersion"), known.alias("known"), ((F.col("_sum") + F.when(whole, F.col("_sd")).otherwise(0.0)) / known).alias("strength"))


def timeline(series: DataFrame, every: int = 5) -> DataFrame:
    """(dt, regime, sub, confidence) for every fifth day with a known correlation; UNKNOWN with fewer than three."""
    rows = daily(series).withColumn("_i", F.row_number().over(Window.orderBy("dt"))).where(F.col("_i") % every == 1)  # a row per day
    gold, rates, bonds = (F.coalesce(F.col(p), F.lit(0.0)) for p in ("gold_equity", "vix_rates", "equity_bonds"))
    spread = F.coalesce(F.col("dispersion"), F.lit(0.5))
    few = F.col("known") < 3
    regime = (
        F.when(few, "UNKNOWN").when((gold < -0.5) & (rates > 0.3), "CRISIS").when((gold > 0.3) & (bonds > 0.5), "RISK_ON").when((gold < -0.3) & (bonds < -0.3), "RISK_OFF")
        .when(rates > 0.5, "STAGFLATION").when((F.abs(gold) < 0.2) & (F.abs(bonds) < 0.2), "NEUTRAL").otherwise("TRANSITIONAL")
    )
    sub = F.when(few, "UNKNOWN").when(spread > 0.3, "HIGH_VOLATILITY").when(spread < 0.05, "STABLE").otherwise("MODERATE")
    base = F.when(spread > 0.3, 0.3).when(spread < 0.05, 0.9).otherwise(0.6)
    confidence = F.when(F.col("strength") > 0.6, F.least(F.lit(0.95), base + 0.2)).when(F.col("strength") < 0.2, F.greatest(F.lit(0.1), base - 0.3)).otherwise(base)
    return rows.select("dt", regime.alias("regime"), sub.alias("sub"), F.when(few, 0.0).otherwise(confidence).alias("confidence"))


def summary(found: DataFrame) -> DataFrame:
    """A row per regime: days, share, mean, least and most confidence, and how often the timeline turned to it; and of the
    whole timeline, how often it turned, per day, and one less that."""
    rows = found.withColumn("_turned", F.col("regime") != F.lag("regime").over(Window.orderBy("dt")))  # a row per fifth day
    whole = Window.partitionBy()
    by = rows.groupBy("regime").agg(
        F.count("*").alias("days"), F.avg("confidence").alias("confidence"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.count_if("_turned").alias("turns")
    )
    rate = F.sum("turns").over(whole) / F.sum("days").over(whole)
    return by.withColumns({"share": F.col("days") / F.sum("days").over(whole), "transition_rate": rate, "stability": 1 - rate})


def features(series: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row of model features as of a day of the timeline (its last one if None): each pair's correlation and their
    dispersion (0 where unknown), the regime's confidence and the timeline's stability."""
    found = timeline(series)
    day = found.agg(F.max("dt").alias("dt")) if as_of is None else found.where(F.col("dt") == F.lit(as_of).cast("date")).select("dt")
    stability = summary(found).agg(F.max("stability").alias("regime_stability"))
    rows = day.join(daily(series), "dt").join(found.select("dt", F.col("confidence").alias("regime_confidence")), "dt").crossJoin(stability)  # one row each
    return rows.select("dt", *(F.coalesce(F.col(p), F.lit(0.0)).alias(f"corr_{p}") for p in (*PAIRS, "dispersion")), "regime_confidence", "regime_stability")
