"""Analysis of single assets: class by volatility, forecast, tail risk, trend, returns and score, without a universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import backtest, risk, scores, signals


def analysis(panel: DataFrame, least: int = 30, validated: int = 312) -> DataFrame:
    """A row per asset of ``panel`` that has ``least`` rows. The forecast's sign is turned; hits count only with
    ``validated`` rows; the trend is 1 for a strength above one half, 0 otherwise; returns are in per cent up to the
    panel's last day, 0 with a single row in their span."""
    rows = panel.withColumn("ret", S.simple_return()).withColumn("_k", S.from_end())
    today = panel.agg(F.max("dt").alias("_today"))  # one row
    year, twelve = F.col("dt") >= F.trunc("_today", "year"), F.col("dt") >= F.date_sub("_today", 365)

    def change(span: Column) -> Column:
        first, last = F.min_by(F.when(span, F.col("close")), F.when(span, F.col("dt"))), F.max_by(F.when(span, F.col("close")), F.when(span, F.col("dt")))
        return F.when(F.count_if(span) > 1, (F.try_divide(last, first) - 1) * 100).otherwise(0.0)

    own = rows.crossJoin(today).groupBy("asset").agg(
        F.count("*").alias("rows"), (F.stddev_samp("ret") * F.sqrt(F.lit(S.TRADING_DAYS))).alias("volatility"), F.max_by("close", "dt").alias("latest"),
        change(year).alias("ytd_return"), change(twelve).alias("one_year_return"),
    )
    own = own.where(F.col("rows") >= least).withColumn("band", risk.volatility_class(F.col("volatility")))
    trend = signals.kalman_hull(panel.join(own.select("asset", "band"), "asset")).select("asset", F.col("signal_strength").alias("signal"), F.col("efficiency_ratio").alias("efficiency"))
    hits = backtest.walk_forward_hits(panel).select("asset", F.col("hit_rate").alias("_hits"))
    found = own.join(backtest.forecasts(panel), "asset").join(hits, "asset", "left").join(risk.cvar(panel), "asset", "left").join(trend, "asset")
    c = F.col
    found = found.withColumns({"forecast": -c("forecast"), "hit_rate": F.when(c("rows") >= validated, F.coalesce("_hits", F.lit(0.0))).otherwise(0.0), "trend": (c("signal") > 0.5).cast("int")})
    score = scores.single(c("forecast"), c("hit_rate"), c("signal"), c("cvar"))
    return found.select("asset", "rows", "latest", "volatility", "band", "forecast", "confidence", "hit_rate", "cvar", "trend", "signal", "efficiency", "ytd_return", "one_year_return", score.alias("score"))
