"""Technical signals of each series: averages, ranges, trends, and recursive filters.

Window signals are built-in expressions over one sort per asset. Exponential averages and filtered levels are affine
recursions, which are dealt by asset and period (``scans``). The trailing bands, whose parameters come from a series'
end, are a fold over one asset's rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scans
from tidemark.functions import series as S
from tidemark.session import written


def returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("ret", S.simple_return())


def crossings(panel: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """The panel with two moving averages, whether the fast one is above, and how often that has changed so far."""
    rows = panel.withColumn("fast", S.sma("close", fast)).withColumn("slow", S.sma("close", slow))
    rows = rows.withColumn("above", (F.col("fast") > F.col("slow")).cast("int"))
    changed = F.coalesce(F.abs(F.col("above") - S.ago("above", 1)), F.lit(0))
    return rows.withColumn("changed", changed).withColumn("changes", F.sum("changed").over(S.so_far()))


def atr(panel: DataFrame, n: int = 14, least: int | None = None) -> DataFrame:
    """The panel with true range and its rolling mean; ``least`` rows are enough for a mean (all ``n`` by default)."""
    rows = panel.withColumn("tr", S.true_range())
    return rows.withColumn("atr", S.rolling(F.avg("tr").over(S.last(n)), "tr", n, least))


def efficiency(panel: DataFrame, n: int = 10) -> DataFrame:
    """Net move over the path travelled in ``n`` steps, 0 to 1; one half while unknown or without any move."""
    rows = panel.withColumn("_step", F.abs(F.col("close") - S.ago("close", 1)))
    path = S.rolling(F.sum("_step").over(S.last(n)), "_step", n)
    ratio = F.try_divide(F.abs(F.col("close") - S.ago("close", n)), path)
    return rows.withColumn("efficiency", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(ratio, F.lit(0.5))))).drop("_step")


def hull(panel: DataFrame, n: int = 9) -> DataFrame:
    """Hull moving average: a short weighted mean of twice the half-length mean less the full-length one."""
    rows = panel.withColumn("_raw", 2 * S.wma("close", max(2, n // 2)) - S.wma("close", n))
    return rows.withColumn("hull", S.wma("_raw", max(2, round(n**0.5)))).drop("_raw")


def divergence(panel: DataFrame, indicator: str, n: int = 20) -> DataFrame:
    """bullish where the price is below its lowest of the ``n`` rows before but the indicator is not; bearish the other way round."""
    before = S.by_asset().rowsBetween(-n, -1)
    low, high = (F.col("close") < F.min("close").over(before)), (F.col("close") > F.max("close").over(before))
    own_low, own_high = (F.col(indicator) < F.min(indicator).over(before)), (F.col(indicator) > F.max(indicator).over(before))
    kind = F.when(F.count("close").over(before) < n, "none").when(low & ~own_low, "bullish").when(high & ~own_high, "bearish").otherwise("none")
    return panel.withColumn("divergence", kind)


def trend_consistency(panel: DataFrame, trend: str, n: int = 20, most: int = 4) -> DataFrame:
    """Whether a trend flag has changed less than ``most`` times in the last ``n`` rows; the first row counts as a change."""
    changed = F.when(S.ago(trend, 1).isNull() | (F.col(trend) != S.ago(trend, 1)), 1).otherwise(0)
    rows = panel.withColumn("_changed", changed)
    return rows.withColumn("consistent", F.sum("_changed").over(S.last(n)) < most).drop("_changed")


def exponential(panel: DataFrame, span: int = 20) -> DataFrame:
    """(asset, ema): the exponential mean of each series at its end, started at its first value."""
    a = 2 / (span + 1)
    found = scans.affine(panel.select("asset", "dt", "close"), ["asset"], ["dt"], scans.period_of(), {"ema": (F.lit(1 - a), F.col("close") * a, F.col("close"))})
    return found.groupBy("asset").agg(F.max_by("ema", "dt").alias("ema"))


def _weighted_means(rows: DataFrame, c: str, spans: dict[str, int]) -> DataFrame:
    """``rows`` with exponential means of ``c`` weighted by the values seen so far: a numerator and a denominator run
    along, so the first values are not overrated."""
    zero = F.lit(0.0)
    values = {f"_{x}_{out}": (F.lit(1 - 2 / (n + 1)), F.col(c) if x == "n" else F.when(F.col(c).isNotNull(), 1.0), zero) for out, n in spans.items() for x in "nd"}
    found = scans.affine(rows, ["asset"], ["dt"], scans.period_of(), values)
    return found.withColumns({out: F.try_divide(f"_n_{out}", f"_d_{out}") for out in spans}).drop(*values)


def macd(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(asset, line, signal, histogram) at each series' end: a fast mean over a slow one, and the mean of that."""
    means = _weighted_means(panel.select("asset", "dt", "close"), "close", {"fast": fast, "slow": slow})
    rows = _weighted_means(means.select("asset", "dt", (F.col("fast") - F.col("slow")).alias("line")), "line", {"signal": signal})
    end = rows.groupBy("asset").agg(F.max_by(F.struct("line", "signal"), "dt").alias("e")).select("asset", "e.*")
    return end.withColumn("histogram", F.col("line") - F.col("signal"))


def _gain(n: Column, measurement: Column, process: Column, variance: float = 100.0) -> Column:
    """The gain of a Kalman filter's ``n``-th step, which depends on no value: the prior variance goes to its fixed point by
    a constant factor in the cross ratio of its two fixed points."""
    root = F.sqrt(process * process + 4 * process * measurement)
    high, low, first = (process + root) / 2, (process - root) / 2, variance + process
    ratio = F.pow((low + measurement) / (high + measurement), n - 1) * (first - high) / (first - low)
    prior = F.when(process == 0, 1 / (1 / first + (n - 1) / measurement)).otherwise((high - ratio * low) / (1 - ratio))
    return prior / (prior + measurement)


def kalman_levels(panel: DataFrame, parameters: DataFrame) -> DataFrame:
    """(asset, dt, n, level): the filtered level of every close, by ``parameters`` (asset, measurement, process). As gains
    don't depend on prices, a level is an affine function of the one before, and long series are dealt by period."""
    rows = written(panel.where("close is not null").join(parameters.select("asset", "measurement", "process"), "asset").select("asset", "dt", "close", "measurement", "process"), "levels")
    rows = scans.prefixes(rows, ["asset"], ["dt"], scans.period_of(), {"n": ("count", "close")})
    gain = _gain(F.col("n"), F.col("measurement"), F.col("process"))
    return scans.affine(rows, ["asset"], ["dt"], scans.period_of(), {"level": (1 - gain, gain * F.col("close"), F.col("close"))}).select("asset", "dt", "n", "level")


#: Fixed values by risk band: base noise of measurement and process, the bands' factor, and the days of the true range's mean.
KALMAN = {"LOW": (4.0, 0.005, 1.5, 14), "MEDIUM": (3.0, 0.01, 1.7, 12), "HIGH": (2.0, 0.02, 2.0, 10)}


def kalman(prices: np.ndarray, measurement: float, process: float) -> np.ndarray:
    """A scalar Kalman filter of a level; the first price is the first state, with variance 100. Gains don't depend on
    the prices."""
    out = np.empty(len(prices))
    state, variance = prices[0], 100.0
    for i, price in enumerate(prices):
        variance += process
        gain = variance / (variance + measurement)
        state += gain * (price - state)
        variance *= 1 - gain
        out[i] = state
    return out


def weighted_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the last ``n`` values with weights from 1 to ``n``; NaN until there are as many."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n) @ np.arange(1, n + 1) / (n * (n + 1) / 2)
    return out


def hull_mean(x: np.ndarray, n: int) -> np.ndarray:
    return weighted_mean(2 * weighted_mean(x, max(2, n // 2)) - weighted_mean(x, n), max(2, round(n**0.5)))


def trailing_bands(prices: np.ndarray, centre: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper and lower band and trend (1, -1, or 0 before the first crossing). After a price beyond a band, that band only
    moves towards the price; the trend is that of the last price beyond a band."""
    upper, lower = centre + width, centre - width
    trend = np.zeros(len(prices), int)
    for i in range(len(prices)):
        if i and prices[i - 1] < lower[i - 1]:
            lower[i] = max(lower[i], lower[i - 1])
        if i and prices[i - 1] > upper[i - 1]:
            upper[i] = min(upper[i], upper[i - 1])
        trend[i] = 1 if prices[i] > upper[i] else -1 if prices[i] < lower[i] else trend[i - 1] if i else 0
    return upper, lower, trend


def _divergence_at_end(prices: np.ndarray, indicator: np.ndarray, n: int = 20) -> str:
    """bullish where the last price is below the ``n`` before it but the indicator isn't below all of its own, and bearish
    the other way round."""
    if len(prices) < n + 1:
        return "none"
    before, own = prices[-n - 1 : -1], indicator[-n - 1 : -1]
    if prices[-1] < before.min() and indicator[-1] > np.nanmin(own):
        return "bullish"
    return "bearish" if prices[-1] > before.max() and indicator[-1] < np.nanmax(own) else "none"


def _strength(price: float, upper: float, lower: float, ratio: float, trend: int) -> float:
    """Nearness to the band that the trend heads for, and the efficiency of the way there."""
    if upper == lower:
        return 0.5
    gap = {1: upper - price, -1: price - lower}.get(trend, min(abs(price - upper), abs(price - lower)))
    place = 1 - gap / (upper - lower) if upper > lower else 0.5
    return float(np.clip(0.6 * np.clip(place, 0, 1) + 0.4 * ratio, 0, 1))


def band_parameters(panel: DataFrame, band: str = "MEDIUM", least: int = 30) -> DataFrame:
    """(asset, measurement, process, length, factor, days): what ``kalman_hull`` takes for each series from its end, for
    series of ``least`` closes or more: the two noises, the length of the Hull mean, the bands' factor, and the days of
    the true range's mean."""
    noise, process, factor, days = KALMAN.get(band, KALMAN["MEDIUM"])
    rows = panel.where("close is not null").withColumn("tr", S.true_range()).withColumn("_step", F.abs(F.col("close") - S.ago("close", 1)))
    rows = rows.withColumns({"width": F.avg("tr").over(S.last(days)), "path": F.sum("_step").over(S.last(10)), "move": F.abs(F.col("close") - S.ago("close", 10)), "n": F.count("close").over(S.so_far())})
    end = rows.withColumn("_k", S.from_end()).where(f"_k = 1 and n >= {least}")
    ratio = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide("move", "path"))), F.lit(0.5))
    end = end.withColumn("unrest", F.when(F.col("close") != 0, F.col("width") / F.col("close")).otherwise(0.1)).withColumn("measurement", noise * (1 - ratio) * (1 + F.col("unrest")))
    length = F.greatest(F.lit(3), F.least(F.bround("measurement").cast("long"), F.expr("n div 2")))
    return end.select("asset", "measurement", (process * (1 + F.col("unrest"))).alias("process"), length.alias("length"), F.lit(factor).alias("factor"), F.lit(days).alias("days"))


KALMAN_SCHEMA = "asset string, trend int, kalman_price double, upper_band double, lower_band double, efficiency_ratio double, divergence string, trend_consistency boolean, signal_strength double"


def kalman_hull(panel: DataFrame, band: str = "MEDIUM", least: int = 30) -> DataFrame:
    """The trend of each series at its end, by ``KALMAN_SCHEMA``: prices are filtered, with more noise the less efficient
    and the more volatile they are, smoothed by a Hull mean whose length is that noise, and banded by the true range.
    A series of fewer than ``least`` closes has a strength of 0 and no more.

    ``band`` is the risk band of all assets; a column of that name in the panel tells each asset's own (one without
    parameters counts as MEDIUM). A series is one asset's daily rows, so a group is bounded by the length of a history."""

    def of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["close"].notna()].sort_values("dt")
        row: dict = {"trend": None, "kalman_price": None, "upper_band": None, "lower_band": None, "efficiency_ratio": None, "divergence": "none", "trend_consistency": False, "signal_strength": 0.0}
        close = frame["close"].to_numpy(float)
        if len(close) >= least:
            noise, process, factor, days = KALMAN.get(str(frame["band"].iloc[0]).upper(), KALMAN["MEDIUM"])
            path = np.abs(np.diff(close[-11:])).sum()
            ratio = float(np.clip(abs(close[-1] - close[-11]) / path, 0, 1)) if path > 0 else 0.5
            previous = np.append(np.nan, close[:-1])
            spread = np.fmax(frame["high"] - frame["low"], np.fmax(np.abs(frame["high"] - previous), np.abs(frame["low"] - previous)))
            width = pd.Series(spread.to_numpy()).rolling(days, min_periods=1).mean().to_numpy()
            unrest = width[-1] / close[-1] if close[-1] else 0.1
            measurement = noise * (1 - ratio) * (1 + unrest)
            smooth = hull_mean(kalman(close, measurement, process * (1 + unrest)), max(3, min(round(measurement), len(close) // 2)))
            upper, lower, trend = trailing_bands(close, smooth, factor * width)
            turns = 1 + int((np.diff(trend[-20:]) != 0).sum())  # the first of the last twenty counts as one
            row = {
                "trend": trend[-1], "kalman_price": smooth[-1], "upper_band": upper[-1], "lower_band": lower[-1], "efficiency_ratio": ratio, "divergence": _divergence_at_end(close, smooth),
                "trend_consistency": turns < 4, "signal_strength": _strength(close[-1], upper[-1], lower[-1], ratio, int(trend[-1])),
            }
        return pd.DataFrame([{"asset": key[0], **row}])

    own = F.col("band") if "band" in panel.columns else F.lit(band)
    return panel.select("asset", "dt", "high", "low", "close", own.alias("band")).groupBy("asset").applyInPandas(of, KALMAN_SCHEMA)
