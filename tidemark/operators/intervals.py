"""Percentile intervals that tell a change from noise, and the decisions that follow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import rules
from tidemark.functions import series as S
from tidemark.functions.ordered import OrderedWindow
from tidemark.operators import relational

METRICS = ("hit_rate", "conviction", "stability")


def history(rows: DataFrame, names: tuple[str, ...] = METRICS, days: int = 100) -> DataFrame:
    """(asset, dt, metric, value) of the last ``days`` rows of each asset."""
    recent = rows.withColumn("_k", S.from_end()).where(F.col("_k") <= days)
    return recent.unpivot(["asset", "dt"], list(names), "metric", "value")


def intervals(long: DataFrame, winsorised: tuple[str, ...] = ("conviction",)) -> DataFrame:
    """(asset, metric, lower, upper, mean, std, median): 2.5 and 97.5 percentiles; the named metrics are first drawn in
    to their 1 and 99 percentiles; the deviation is the population's."""
    bounds = long.groupBy("asset", "metric").agg(F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("b"))
    rows = long.join(bounds, ["asset", "metric"])
    drawn = F.when(F.col("metric").isin(*winsorised), F.greatest(F.col("b")[0], F.least(F.col("b")[1], F.col("value")))).otherwise(F.col("value"))
    found = rows.withColumn("v", drawn).groupBy("asset", "metric").agg(
        F.percentile("v", F.array(F.lit(0.025), F.lit(0.975), F.lit(0.5))).alias("p"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )
    return found.select("asset", "metric", F.col("p")[0].alias("lower"), F.col("p")[1].alias("upper"), "mean", "std", F.col("p")[2].alias("median"))


def as_of_each(rows: DataFrame, also: tuple[str, ...] = (), names: tuple[str, ...] = METRICS, days: int = 100, winsorised: tuple[str, ...] = ("conviction",), wanted: Column | None = None) -> DataFrame:
    """(asset, metric, dt, ``also``, lower, upper, mean): the interval as it stands on each day of ``rows`` (where
    ``wanted``, if given), from the ``days`` rows up to it.

    Rows pass in the order of asset and day, and each metric's window is kept in order of size as values come and go, so
    nothing is sorted again and a task holds ``days`` values of a metric, whatever the history's length."""
    wide = rows.select("asset", "dt", *also, (F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))).alias("_wanted"), *(F.col(n).cast("double").alias(n) for n in names))
    kinds = {f.name: f for f in wide.schema.fields}
    out = T.StructType([kinds["asset"], T.StructField("metric", T.StringType()), kinds["dt"], *(kinds[c] for c in also), *(T.StructField(c, T.DoubleType()) for c in ("lower", "upper", "mean"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asset, windows = None, None
        for batch in batches:
            at, found = [], []
            assets, flags = batch.column(0).to_pylist(), batch.column(2 + len(also)).to_pylist()
            values = [batch.column(3 + len(also) + k).to_pylist() for k in range(len(names))]
            for i, own in enumerate(assets):
                if windows is None or own != asset:
                    asset, windows = own, [OrderedWindow(days) for _ in names]
                for k, window in enumerate(windows):
                    window.push(values[k][i])
                    if flags[i]:
                        at.append((i, names[k]))
                        found.append(window.interval(names[k] in winsorised))
            place = pa.array([i for i, _ in at], pa.int64())
            kept = [batch.column(c).take(place) for c in (0, *range(1, 2 + len(also)))]
            bounds = [pa.array([x[k] for x in found], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([kept[0], pa.array([m for _, m in at], pa.string()), *kept[1:], *bounds], names=out.names)

    return wide.repartition("asset").sortWithinPartitions("asset", "dt").mapInArrow(run, out)


def decision_counts(found: DataFrame) -> DataFrame:
    """One row: decisions by ``rotation_rule``, those that rotate, and outside of stress those held back as noise and those
    that wait for more."""
    calm = found.crossJoin(market_stress(found).select("stressed")).withColumn("calm", ~F.col("stressed"))  # one row
    return calm.agg(
        F.count("*").alias("decisions"), F.count_if(F.col("calm") & F.col("signal").isin("ROTATE", "NO_CI")).alias("rotations"),
        F.count_if(F.col("calm") & (F.col("signal") == "HOLD")).alias("noise_prevented"), F.count_if(F.col("calm") & (F.col("signal") == "WAIT")).alias("waiting"),
    )


def signals(current: DataFrame, bounds: DataFrame, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """(``keys``, weight, signal): the weights of the three metrics outside their intervals, summed; NO_CI without any."""
    long = current.unpivot(list(keys), list(METRICS), "metric", "value")
    rows = long.join(bounds.select(*keys, "metric", "lower", "upper"), [*keys, "metric"], "left")
    weight = F.sum(rules.distance_weight(F.col("value"), F.col("lower"), F.col("upper")))
    found = rows.groupBy(*keys).agg(F.count("lower").alias("_n"), weight.alias("weight"))
    return found.select(*keys, "weight", F.when(F.col("_n") == 0, "NO_CI").otherwise(rules.rotation_decision(F.col("weight"))).alias("signal"))


def signals_as_of(rows: DataFrame, checks: DataFrame, least: int = 100) -> DataFrame:
    """(asset, dt, signal) for each day of ``checks`` (dt): each asset's newest metrics by then against its intervals as
    they stood with them. ``rows``: asset, dt and the metrics, a written table; an asset counts from its ``least``-th row."""
    known = rows.withColumn("_rn", F.row_number().over(S.by_asset())).withColumn("_next", F.lead("dt").over(S.by_asset())).where(F.col("_rn") >= least)
    grid = known.select("asset").distinct().crossJoin(checks.select("dt").distinct()).withColumn("_day", F.lit(1))
    seen = relational.as_of(grid, known.select("asset", "dt", F.col("dt").alias("seen"), *METRICS), ["asset"]).where("seen is not null")
    days = F.broadcast(checks.agg(F.collect_set("dt").alias("_days")))  # one row; check dates are some hundreds at most
    wanted = F.exists("_days", lambda d: (d >= F.col("dt")) & (F.col("_next").isNull() | (d < F.col("_next"))))
    bounds = as_of_each(known.crossJoin(days).withColumn("_used", wanted), wanted=F.col("_used")).withColumnRenamed("dt", "seen")
    days_of = seen.select("asset", "dt", "seen").join(bounds.select("asset", "seen", "metric", "lower", "upper"), ["asset", "seen"])
    return signals(seen.select("asset", "dt", *METRICS), days_of, ("asset", "dt"))


def market_stress(found: DataFrame, share: float = 0.30) -> DataFrame:
    """One row: the share of assets that signal ROTATE, and whether it is market-wide."""
    rotating = F.avg((F.col("signal") == "ROTATE").cast("double"))
    return found.agg(F.count("*").alias("assets"), rotating.alias("rotating"), (rotating > share).alias("stressed"))


def annual(deviation: Column) -> Column:
    return deviation * F.sqrt(F.lit(S.TRADING_DAYS))


def volatility_interval(panel: DataFrame, window: int = 100, least: int = 50) -> DataFrame:
    """Each asset's annual volatility over its last 20, 50 and 100 returns against the history of its ``window``-return
    volatilities: 5th, 50th and 95th percentile, or 0.8, 1 and 1.2 times the current one while there is no history.
    Assets with fewer than ``least`` returns are left out."""
    rows = panel.withColumn("ret", S.simple_return()).where("ret is not null").withColumn("_k", S.from_end())
    rows = rows.withColumn("_i", F.row_number().over(S.by_asset()))
    before = S.by_asset().rowsBetween(-window, -1)
    rows = rows.withColumn("_vol", F.when(F.col("_i") > window, annual(F.stddev_samp("ret").over(before))))
    now = [F.when(F.count("*") >= n, annual(F.stddev_samp(F.when(F.col("_k") <= n, F.col("ret"))))).alias(f"vol_{n}") for n in (20, 50, 100)]
    bands = F.percentile("_vol", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("p")
    found = rows.groupBy("asset").agg(F.count("*").alias("n"), *now, bands).where(F.col("n") >= least)
    wide = F.col("n") > window
    return found.select(
        "asset", "vol_20", "vol_50", "vol_100",
        F.when(wide, F.col("p")[0]).otherwise(F.col("vol_20") * 0.8).alias("p5"),
        F.when(wide, F.col("p")[1]).otherwise(F.col("vol_20")).alias("median"),
        F.when(wide, F.col("p")[2]).otherwise(F.col("vol_20") * 1.2).alias("p95"),
        (wide & (F.col("vol_20") > F.col("p")[2])).alias("elevated"),
    )


def market_volatility(panel: DataFrame, days: int = 20) -> DataFrame:
    """One row: mean, median and upper percentiles of the annual volatilities of all assets that have ``days`` returns."""
    rows = panel.withColumn("ret", S.simple_return()).where("ret is not null").withColumn("_k", S.from_end()).where(F.col("_k") <= days)
    each = rows.groupBy("asset").agg(F.when(F.count("*") >= days, annual(F.stddev_samp("ret"))).alias("vol"))
    p = F.percentile("vol", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    found = each.agg(F.avg("vol").alias("mean"), p.alias("p"), F.count("vol").alias("assets"))
    return found.select("mean", F.col("p")[0].alias("median"), F.col("p")[1].alias("p75"), F.col("p")[2].alias("p90"), "assets")


def stressed(mean: Column, median: Column, high: float = 0.30, spread: float = 1.5) -> Column:
    """Whether the market is in stress: volatile on average, or much more so than its median asset."""
    return (mean > high) | (mean > spread * median)


def _percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def volatility_decision(own: DataFrame, market: DataFrame, high: float = 0.30) -> DataFrame:
    """(asset, decision, reason): HOLD while the market is in stress, else ROTATE, with what is so of the asset, of the
    market, and why."""
    rows = own.crossJoin(market.select(F.col("mean").alias("_m"), F.col("median").alias("_md")))  # one row
    stress = stressed(F.col("_m"), F.col("_md"), high)
    asset = F.when(F.col("elevated"), F.concat("asset", F.lit(" volatility "), _percent(F.col("vol_20")), F.lit(" above its range to "), _percent(F.col("p95"))))
    asset = asset.otherwise(F.concat("asset", F.lit(" volatility "), _percent(F.col("vol_20")), F.lit(" in its range")))
    mean = F.concat(F.lit("mean volatility "), _percent(F.col("_m")))
    whole = F.when(F.col("_m") > high, F.concat(F.lit("market in stress: "), mean)).when(stress, F.concat(F.lit("market in stress: "), mean, F.lit(" far above the median "), _percent(F.col("_md"))))
    whole = whole.otherwise(F.concat(F.lit("market normal: "), mean))
    why = F.when(stress, "HOLD: the market is in stress").when(F.col("elevated"), "ROTATE: the asset alone is volatile").otherwise("ROTATE: a lower rank in a normal market is real")
    return rows.select("asset", F.when(stress, "HOLD").otherwise("ROTATE").alias("decision"), F.concat_ws(" | ", asset, whole, why).alias("reason"))
