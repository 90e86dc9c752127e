"""The ten features of a forecast model: one row per asset, from its own last rows and from external series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import signals

#: The features in the order in which they are taken, and the bounds of each place's scale. The scale of a
#: place is that of the label at the same place of the model's own list, which names them in another order.
ORDER = ("volatility", "momentum", "volatility_level", "signal_quality", "macd_histogram", "macd_signal", "gold_equity_corr", "vix_rates_corr", "cross_asset_dispersion", "equity_bonds_corr")
LABELS = ("volatility", "gold_equity_corr", "volatility_level", "signal_quality", "vix_rates_corr", "cross_asset_dispersion", "macd_histogram", "macd_signal", "momentum", "equity_bonds_corr")
BOUNDS = {
    "volatility": (0.0, 1.0), "momentum": (-0.5, 0.5), "volatility_level": (0.5, 2.0), "signal_quality": (0.0, 1.0), "macd_histogram": (-0.1, 0.1), "macd_signal": (-0.05, 0.05),
    "gold_equity_corr": (-1.0, 1.0), "vix_rates_corr": (-1.0, 1.0), "cross_asset_dispersion": (0.0, 0.1), "equity_bonds_corr": (-1.0, 1.0),
}


def clipped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def _returns(frame: DataFrame, value: str, key: str) -> DataFrame:
    return frame.withColumn("ret", S.simple_return(value, key=key)).where("ret is not null").select(key, "dt", "ret")


def _last_corr(pairs: DataFrame, key: str, days: int = 60, least: int = 30) -> DataFrame:
    """(key, corr): correlation of x and y over the last ``days`` common days; 0 with fewer than ``least`` of them."""
    rows = pairs.withColumn("_k", S.from_end(key))
    found = rows.groupBy(key).agg(F.count("*").alias("_n"), F.corr(F.when(F.col("_k") <= days, F.col("x")), F.col("y")).alias("_c"))
    return found.select(key, F.when(F.col("_n") >= least, F.coalesce(F.nanvl("_c", F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("corr"))


def _pair_corr(rets: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of two external series."""
    x, y = (rets.where(F.col("name") == n).select("dt", F.col("ret").alias(c)) for n, c in ((a, "x"), (b, "y")))
    whole = _last_corr(x.join(y, "dt").withColumn("pair", F.lit(0)), "pair")
    return whole.agg(F.coalesce(F.max("corr"), F.lit(0.0)).alias("corr"))


def model_features(panel: DataFrame, series: DataFrame, roles: dict[str, str], spread: tuple[str, ...]) -> DataFrame:
    """(asset and ``ORDER``) at each series' end; all zero with fewer than 60 rows. ``roles``: which external series are
    gold, vix, rates, equity and bonds; ``spread``: those whose 60-day deviations are compared (two at least)."""
    rows = panel.withColumn("ret", S.simple_return()).withColumn("_k", S.from_end())
    own = rows.groupBy("asset").agg(
        F.count("*").alias("_n"), F.stddev_samp(F.when(F.col("_k") <= 30, F.col("ret"))).alias("_sd"), F.count("ret").alias("_rets"),
        F.max(F.when(F.col("_k") == 1, F.col("close"))).alias("_close"), F.max(F.when(F.col("_k") == 21, F.col("close"))).alias("_before"),
    )
    own = own.join(signals.macd(panel), "asset")
    external = _returns(series, "value", "name")
    gold = external.where(F.col("name") == roles["gold"]).select("dt", F.col("ret").alias("y"))
    with_gold = _last_corr(_returns(panel, "close", "asset").select("asset", "dt", F.col("ret").alias("x")).join(gold, "dt"), "asset").withColumnRenamed("corr", "_gold")
    recent = external.where(F.col("name").isin(*spread)).withColumn("_k", S.from_end("name")).where("_k <= 60").groupBy("name").agg(F.stddev_samp("ret").alias("sd"))
    dispersion = recent.agg(F.when(F.count("sd") >= 2, F.stddev_pop("sd")).otherwise(0.05).alias("_spread"))
    market = dispersion.crossJoin(_pair_corr(external, roles["vix"], roles["rates"]).withColumnRenamed("corr", "_vix")).crossJoin(_pair_corr(external, roles["equity"], roles["bonds"]).withColumnRenamed("corr", "_bonds"))
    c = F.col
    found = own.join(with_gold, "asset", "left").crossJoin(market)  # one row
    values = {
        "volatility": F.when(c("_rets") > 30, F.least(F.lit(1.0), c("_sd") * F.sqrt(F.lit(S.TRADING_DAYS)))).otherwise(0.15),
        "momentum": F.coalesce(clipped(F.try_divide("_close", "_before") - 1, -0.5, 0.5), F.lit(0.0)),
        "volatility_level": clipped(c("line") / F.greatest("_sd", F.lit(0.01)), 0.5, 2.0),
        "signal_quality": clipped(F.abs("signal") * 20, 0.0, 1.0),
        "macd_histogram": clipped(c("histogram") / c("_close"), -0.1, 0.1),
        "macd_signal": clipped(c("line") / c("_close"), -0.05, 0.05),
        "gold_equity_corr": F.coalesce(c("_gold"), F.lit(0.0)),
        "vix_rates_corr": c("_vix"),
        "cross_asset_dispersion": clipped(c("_spread"), 0.0, 0.1),
        "equity_bonds_corr": c("_bonds"),
    }
    return found.select("asset", *(F.when(c("_n") >= 60, values[n]).otherwise(0.0).alias(n) for n in ORDER))


def scaled(features: DataFrame) -> DataFrame:
    """The features scaled to 0 to 1, each by the bounds that go with its place."""
    out = []
    for name, label in zip(ORDER, LABELS, strict=True):
        low, high = BOUNDS[label]
        out.append(clipped((F.col(name) - low) / (high - low), 0.0, 1.0).alias(name))
    return features.select("asset", *out)
