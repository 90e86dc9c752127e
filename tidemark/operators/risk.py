"""Risk: volatility, beta against the best benchmark, tail risk, classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.session import written
from tidemark.sources import stored


def volatility(panel: DataFrame, year: int = S.TRADING_DAYS, least: int = 90) -> DataFrame:
    """Annualised deviation of the last year's returns, of all if there are at least ``least``, else null."""
    rows = panel.withColumn("ret", S.simple_return()).where("ret is not null").withColumn("_k", S.from_end())
    sd = F.stddev_samp(F.when(F.col("_k") <= year, F.col("ret"))) * F.sqrt(F.lit(S.TRADING_DAYS))
    return rows.groupBy("asset").agg(F.when(F.count("*") >= least, sd).alias("volatility"))


def enhanced_volatility(panel: DataFrame) -> DataFrame:
    """(asset, volatility): ``volatility`` widened by the fat tails of each asset's Student-t law, where that has a variance."""
    law = fitted_laws(panel).select("asset", "degrees")
    wide = F.when(F.col("degrees") > 2.1, F.sqrt(F.col("degrees") / (F.col("degrees") - 2))).otherwise(1.0)
    return volatility(panel).join(law, "asset", "left").select("asset", (F.col("volatility") * F.coalesce(wide, F.lit(1.0))).alias("volatility"))


def aligned(panel: DataFrame, benchmarks: DataFrame, days: int | None = None) -> DataFrame:
    """(asset, benchmark, dt, ret, bret): returns of both on common days; of the last ``days`` rows of each side, if given."""
    own = panel.withColumn("ret", S.simple_return()).where("ret is not null").select("asset", "dt", "ret")
    other = benchmarks.withColumn("bret", S.simple_return("level", key="benchmark")).where("bret is not null").select("benchmark", "dt", "bret")
    if days:
        own = own.withColumn("_k", S.from_end()).where(F.col("_k") <= days).drop("_k")
        other = other.withColumn("_k", S.from_end("benchmark")).where(F.col("_k") <= days).drop("_k")
    return own.join(other, "dt")


def best_benchmark(panel: DataFrame, benchmarks: DataFrame, days: int = S.TRADING_DAYS, least: int = 30) -> DataFrame:
    """(asset, benchmark, corr, beta): the benchmark that an asset follows most closely, and its beta; null beyond 10."""
    pairs = aligned(panel, benchmarks, days).groupBy("asset", "benchmark").agg(
        F.count("*").alias("n"), F.corr("ret", "bret").alias("corr"), F.covar_samp("ret", "bret").alias("cov"), F.var_samp("bret").alias("var")
    )
    pairs = pairs.where((F.col("n") >= least) & F.col("corr").isNotNull())
    first = Window.partitionBy("asset").orderBy(F.desc("corr"), "benchmark")
    beta = F.try_divide("cov", "var")
    rows = pairs.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return rows.select("asset", "benchmark", "corr", F.when(F.abs(beta) <= 10, beta).alias("beta"))


def risk_class(vol: Column, beta: Column, low: float = 0.12, high: float = 0.22) -> Column:
    """LOW, MEDIUM or HIGH by a matrix of volatility and beta, UNKNOWN without either: calm assets are LOW unless beta is
    above 1.2, usual ones MEDIUM unless it is, and wild ones HIGH unless it is below 0.8."""
    steep = beta > 1.2
    calm = F.when(steep, "MEDIUM").otherwise("LOW")
    usual = F.when(steep, "HIGH").otherwise("MEDIUM")
    wild = F.when(beta < 0.8, "MEDIUM").otherwise("HIGH")
    return F.when(vol.isNull() | beta.isNull(), "UNKNOWN").when(vol < low, calm).when(vol <= high, usual).otherwise(wild)


def volatility_class(vol: Column, low: float = 0.15, high: float = 0.30) -> Column:
    """LOW, MEDIUM or HIGH by volatility alone, for assets without a benchmark."""
    return F.when(vol.isNull(), "UNKNOWN").when(vol < low, "LOW").when(vol < high, "MEDIUM").otherwise("HIGH")


def tail_scale(cvar: Column) -> Column:
    """Tail risk from -30 per cent to none as 0 to 1; unknown risk is one half."""
    known = cvar.isNotNull() & ~F.isnan(cvar)
    return F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cvar + 0.30) / 0.30))).otherwise(0.5)


def risk_score(vol: Column, beta: Column) -> Column:
    return 0.7 * vol + 0.3 * F.abs(beta - 1)


RISK_FREE = 0.0435


def conditional_sharpe(panel: DataFrame, fear: DataFrame, law: DataFrame | None = None, quantile: float = 0.85, least: int = 20, free: float = RISK_FREE) -> DataFrame:
    """(asset, days, sharpe): excess return of the days on which a fear index (dt, value) stood above its quantile of the
    asset's own days, over the volatility of a Student-t law, within -3 and 3.

    ``law``: (asset, degrees, scale), as ``fitted_laws`` gives it; without one, or where it is too wide or too narrow to
    have a variance, 5 degrees and a scale of 0.02. Null with fewer than 252 values on either side, 100 common ones or
    ``least`` days of stress."""
    rows = panel.withColumn("ret", S.simple_return()).where("ret is not null").select("asset", "dt", "ret")
    long_enough = rows.groupBy("asset").agg(F.count("*").alias("_rows"))
    fears = fear.where("value is not null").select("dt", "value")
    both = rows.join(fears, "dt")
    bars = both.groupBy("asset").agg(F.percentile("value", quantile).alias("_bar"), F.count("*").alias("_common"))
    stress = F.col("value") > F.col("_bar")
    found = both.join(bars, "asset").groupBy("asset").agg(F.count_if(stress).alias("days"), F.avg(F.when(stress, F.col("ret"))).alias("_mean"), F.first("_common").alias("_common"))
    found = found.join(long_enough, "asset").crossJoin(fears.agg(F.count("*").alias("_fears")))  # one row
    found = found.join(law, "asset", "left") if law is not None else found.withColumns({"degrees": F.lit(5.0), "scale": F.lit(0.02)})
    degrees = F.when(F.coalesce(F.col("degrees"), F.lit(0.0)) <= 2.1, 5.0).otherwise(F.col("degrees"))
    scale = F.when(F.coalesce(F.col("scale"), F.lit(0.0)) <= 0.001, 0.02).otherwise(F.col("scale"))
    spread = scale * F.sqrt(degrees / (degrees - 2)) * F.sqrt(F.lit(S.TRADING_DAYS))
    ratio = (F.col("_mean") * S.TRADING_DAYS - free) / spread
    known = (F.col("_rows") >= 252) & (F.col("_fears") >= 252) & (F.col("_common") >= 100) & (F.col("days") >= least)
    return found.select("asset", "days", F.when(known, F.greatest(F.lit(-3.0), F.least(F.lit(3.0), ratio))).alias("sharpe"))


# Student-t fit and tail risk. A group is one asset's returns.


def _log_gamma(x: float) -> float:
    from math import lgamma

    return lgamma(x)


def fit_t(x: np.ndarray) -> tuple[float, float, float]:
    """Degrees of freedom, centre and scale of a Student-t law, by expectation and maximisation for centre and scale and a
    golden-section search for the degrees; few values get wide tails."""
    n = len(x)
    if n < 30:
        return 2.1, 0.0, 0.02

    def at(nu: float) -> tuple[float, float, float]:
        mu, s2 = float(np.median(x)), float(np.var(x)) or 1e-12
        for _ in range(60):
            w = (nu + 1) / (nu + (x - mu) ** 2 / s2)
            mu, before = float((w * x).sum() / w.sum()), s2
            s2 = float((w * (x - mu) ** 2).mean()) or 1e-12
            if abs(s2 - before) < 1e-12 * before:
                break
        z = (x - mu) ** 2 / s2
        ll = n * (_log_gamma((nu + 1) / 2) - _log_gamma(nu / 2) - 0.5 * np.log(nu * np.pi * s2)) - (nu + 1) / 2 * np.log1p(z / nu).sum()
        return -float(ll), mu, s2

    a, b, ratio = np.log(1.0), np.log(200.0), (5**0.5 - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = at(np.exp(c))[0], at(np.exp(d))[0]
    for _ in range(40):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = at(np.exp(c))[0]
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = at(np.exp(d))[0]
    nu = float(np.exp((a + b) / 2))
    _, mu, s2 = at(nu)
    nu = max(nu, 2.1)
    if n < 100:
        nu = nu * (n - 1) / max(n - 3, 1)
    return nu, mu, s2**0.5


def _digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of the logarithm of the gamma function, by its recurrence up to 8 and its series from there."""
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out = out - np.where(low, 1 / x, 0.0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def _climbed(f: pd.DataFrame, low: float = 1.0, high: float = 200.0) -> tuple[np.ndarray, np.ndarray]:
    """Degrees and scale after a joint Newton step up the likelihood of each asset's law, by the means of its weights and
    distances; where that is no way up, after a step in each by itself. Neither more than doubles or halves."""
    nu, scale = f["degrees"].to_numpy(float), f["scale"].to_numpy(float)

    def law(x: np.ndarray) -> np.ndarray:
        return np.log(x / 2) - _digamma(x / 2) + _digamma((x + 1) / 2) - np.log((x + 1) / 2)

    step = 1e-4 * nu
    up_nu = (law(nu) + 1 + f["mean"].to_numpy(float)) / 2
    up_scale = f["wz"].to_numpy(float) - 1
    nu_nu = ((law(nu + step) - law(nu - step)) / (2 * step) + f["slope"].to_numpy(float)) / 2
    scale_scale = -2 * nu * (nu + 1) * f["z1"].to_numpy(float)
    both = f["z2"].to_numpy(float) - f["z1"].to_numpy(float)
    det = nu_nu * scale_scale - both**2
    joint = (nu_nu < 0) & (det > 0)
    safe = np.where(joint, det, 1.0)
    move_nu = np.where(joint, (both * up_scale - scale_scale * up_nu) / safe, np.where(nu_nu < 0, -up_nu / np.minimum(nu_nu, -1e-12), np.sign(up_nu) * nu))
    move_scale = np.where(joint, (both * up_nu - nu_nu * up_scale) / safe, -up_scale / np.minimum(scale_scale, -1e-12))
    return np.clip(np.clip(nu + move_nu, nu / 2, 2 * nu), low, high), scale * np.exp(np.clip(move_scale, -np.log(2), np.log(2)))


def first_laws(returns: DataFrame, degrees: float = 5.0) -> DataFrame:
    """(asset, n, degrees, centre, scale): where the steps begin: mean and deviation of each asset's returns."""
    found = returns.groupBy("asset").agg(F.count("ret").alias("n"), F.avg("ret").alias("centre"), F.stddev_pop("ret").alias("scale"))
    return found.select("asset", "n", F.lit(float(degrees)).alias("degrees"), "centre", F.greatest("scale", F.lit(1e-12)).alias("scale"))


def next_laws(returns: DataFrame, laws: DataFrame, free: bool = True) -> DataFrame:
    """One step for the Student-t laws of all assets at once: one pass over the returns, which leaves a few sums an asset,
    added up in each task first. The centre is the weighted mean. Without ``free`` degrees, so is the scale of the
    weighted squares; else degrees and scale climb together (``_climbed``)."""
    rows = returns.where("ret is not null").join(laws, "asset")
    rows = rows.withColumn("_x", F.col("ret") - F.col("centre")).withColumn("_z", F.col("_x") * F.col("_x") / (F.col("scale") * F.col("scale")))
    rows = rows.withColumn("_w", (F.col("degrees") + 1) / (F.col("degrees") + F.col("_z")))
    x, z, w, nu = map(F.col, ("_x", "_z", "_w", "degrees"))
    square = (nu + z) * (nu + z)
    sums = rows.groupBy("asset", "degrees", "centre", "scale").agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.avg(F.log(w) - w).alias("mean"), F.avg((1 / w - 1) * (z - 1) / square).alias("slope"),
        F.avg(w * z).alias("wz"), F.avg(z / square).alias("z1"), F.avg(z * z / square).alias("z2"),
    )
    move = F.col("wx") / F.col("w")
    centre = (F.col("centre") + move).alias("centre")
    if not free:
        # Divided by the weights' sum, not their number: the same fixed point, reached sooner.
        variance = F.greatest((F.col("wxx") - move * F.col("wx")) / F.col("w"), F.lit(1e-24))
        return sums.select("asset", "n", "degrees", centre, F.sqrt(variance).alias("scale"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            degrees, scale = _climbed(frame)
            yield frame[["asset", "n"]].assign(degrees=degrees, centre=frame["centre"], scale=np.maximum(scale, 1e-12))

    found = sums.select("asset", "n", "degrees", centre, "scale", "mean", "slope", "wz", "z1", "z2")
    return found.mapInPandas(run, "asset string, n long, degrees double, centre double, scale double")


def laws_by_sums(returns: DataFrame, steps: int = 15, degrees: float | None = None, table: str | None = None) -> DataFrame:
    """(asset, n, degrees, centre, scale): the Student-t law of each asset's returns (asset, ret) after ``steps`` steps; with
    ``degrees``, those are given. The returns are stored by buckets of assets, so a step reads them without an exchange,
    and no asset's returns are ever one task's alone before they are added up."""
    spark = returns.sparkSession
    table = table or stored.store(returns.where("ret is not null").select("asset", "ret"), "returns", day=None)
    rows = spark.table(table)
    laws = first_laws(rows, degrees or 5.0)
    for _ in range(steps):
        laws = written(next_laws(rows, written(laws, "laws"), degrees is None), "laws")
    return laws


def t_density(x: float, nu: float) -> float:
    return float(np.exp(_log_gamma((nu + 1) / 2) - _log_gamma(nu / 2)) / np.sqrt(nu * np.pi) * (1 + x * x / nu) ** (-(nu + 1) / 2))


def t_quantile(p: float, nu: float) -> float:
    """By the trapezoid rule on the density's lower half, p below one half."""
    grid = np.tan(np.linspace(-np.pi / 2 + 1e-9, 0, 20001))
    dens = np.array((1 + grid**2 / nu) ** (-(nu + 1) / 2)) * t_density(0.0, nu)
    mass = np.concatenate(([0], np.cumsum((dens[1:] + dens[:-1]) / 2 * np.diff(grid))))
    return float(np.interp(p, mass * (0.5 / mass[-1]), grid))


def tail_loss(x: np.ndarray, share: float = 0.05) -> float:
    """Annualised mean of the worst ``share`` of a fitted Student-t law; NaN with fewer than 30 values."""
    if len(x) < 30:
        return float("nan")
    nu, mu, scale = fit_t(x)
    q = t_quantile(share, nu)
    mean = -t_density(q, nu) * (nu + q * q) / ((nu - 1) * share)
    return float((mean * scale + mu) * S.TRADING_DAYS**0.5)


def per_asset(rows: DataFrame, of: Callable[[np.ndarray], float], out: str) -> DataFrame:
    """(asset, out): a number from each asset's returns in order; null for NaN."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        value = of(frame.sort_values("dt")["ret"].to_numpy(float))
        return pd.DataFrame({"asset": frame["asset"].iloc[:1], out: [None if value != value else value]})

    return rows.select("asset", "dt", "ret").groupBy("asset").applyInPandas(run, f"asset string, {out} double")


def cvar(panel: DataFrame) -> DataFrame:
    return per_asset(panel.withColumn("ret", S.simple_return()).where("ret is not null"), tail_loss, "cvar")


def fitted_laws(panel: DataFrame) -> DataFrame:
    """(asset, degrees, centre, scale): the Student-t law of each asset's returns."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        law = fit_t(frame.sort_values("dt")["ret"].to_numpy(float))
        return pd.DataFrame({"asset": frame["asset"].iloc[:1], "degrees": law[0], "centre": law[1], "scale": law[2]})

    rows = panel.withColumn("ret", S.simple_return()).where("ret is not null").select("asset", "dt", "ret")
    return rows.groupBy("asset").applyInPandas(run, "asset string, degrees double, centre double, scale double")
