"""Queries on intervals, decisions, joins, sets and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules, scans
from tidemark.functions import series as S
from tidemark.operators import correlations, intervals, metrics, ranking, relational, signals
from tidemark.plans.metrics import METRICS
from tidemark.plans.rolling import registry, rounded
from tidemark.plans.sql import ASSETS, BARS, RETS, TYPES
from tidemark.session import written
from tidemark.sources import panels

QUERIES, ORACLES, query = registry()

_CI = f"""{METRICS}, h AS (UNPIVOT (SELECT asset, dt, hit_rate, conviction, stability FROM m WHERE n - rn < 100) ON hit_rate, conviction,
    stability INTO NAME metric VALUE value),
  w AS (SELECT asset, metric, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM h GROUP BY ALL),
  v AS (SELECT asset, metric, CASE WHEN metric = 'conviction' THEN greatest(lo, least(hi, value)) ELSE value END AS x FROM h JOIN w USING (asset, metric)),
  ci AS (SELECT asset, metric, quantile_cont(x, 0.025) AS lower, quantile_cont(x, 0.975) AS upper, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.5) AS median
      FROM v GROUP BY ALL)"""
_CURRENT = """cur AS (UNPIVOT (SELECT asset, hit_rate, conviction, stability FROM m WHERE rn = n) ON hit_rate, conviction, stability INTO NAME metric VALUE value),
  g AS (SELECT asset, value, lower, upper, CASE WHEN value < lower THEN lower - value WHEN value > upper THEN value - upper ELSE 0 END AS gap,
    abs(CASE WHEN value < lower THEN lower ELSE upper END) AS bound FROM cur LEFT JOIN ci USING (asset, metric)),
  sig AS (SELECT asset, sum(CASE WHEN gap = 0 THEN 0.0 WHEN CASE WHEN bound = 0 THEN gap ELSE gap / bound END <= 0.10 THEN 0.3 WHEN CASE WHEN bound = 0 THEN gap
      ELSE gap / bound END <= 0.20 THEN 0.7 ELSE 1.0 END)::DOUBLE AS weight FROM g GROUP BY asset),
  decided AS (SELECT asset, weight, CASE WHEN weight < 0.5 THEN 'HOLD' WHEN weight <= 1.5 THEN 'WAIT' ELSE 'ROTATE' END AS signal FROM sig)"""


def _behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.behaviour(panels.bars(spark, sf_dir))


def _newest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_k", S.from_end()).where("_k = 1").drop("_k")


@query(f"""WITH {RETS}, {_CI} SELECT asset, metric, round(lower, 4) AS lower, round(upper, 4) AS upper, round(mean, 4) AS mean, round(std, 4) AS std, round(median,
    4) AS median FROM ci""")
def metric_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intervals.intervals(intervals.history(_behaviour(spark, sf_dir))), "lower", "upper", "mean", "std", "median", digits=4)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _behaviour(spark, sf_dir)
    return intervals.signals(_newest(rows).select("asset", *intervals.METRICS), intervals.intervals(intervals.history(rows)))


@query(f"WITH {RETS}, {_CI}, {_CURRENT} SELECT asset, round(weight, 6) AS weight, signal FROM decided")
def rotation_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_signals(spark, sf_dir), "weight")


@query(f"""WITH {RETS}, {_CI}, {_CURRENT} SELECT count(*) AS assets, round(avg(CAST(signal = 'ROTATE' AS DOUBLE)), 6) AS rotating,
    avg(CAST(signal = 'ROTATE' AS DOUBLE)) > 0.3 AS stressed FROM decided""")
def market_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intervals.market_stress(_signals(spark, sf_dir)), "rotating")


@query(f"""WITH {RETS}, {_CI}, {_CURRENT}, s AS (SELECT avg(CAST(signal = 'ROTATE' AS DOUBLE)) > 0.3 AS stressed FROM decided)
  SELECT asset, signal, CASE WHEN stressed THEN 'HOLD' WHEN signal IN ('ROTATE', 'NO_CI') THEN 'ROTATE' ELSE 'HOLD' END AS decision FROM decided, s""")
def rotation_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _signals(spark, sf_dir)
    rows = found.crossJoin(F.broadcast(intervals.market_stress(found).select("stressed")))  # one row
    return rows.select("asset", "signal", rules.rotation_rule(F.col("signal"), F.col("stressed")).alias("decision"))


_VOLCI = """r AS (SELECT asset, dt, ret, n - rn + 1 AS k, row_number() OVER (PARTITION BY asset ORDER BY dt) AS i FROM rets WHERE ret IS NOT NULL),
  hv AS (
    SELECT *, CASE WHEN i > 100 THEN sqrt(252) * stddev_samp(ret) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) END AS vol FROM r),
  vc AS (
    SELECT asset, count(*) AS n,
      CASE WHEN count(*) >= 20 THEN sqrt(252) * stddev_samp(ret) FILTER (k <= 20) END AS vol_20,
      CASE WHEN count(*) >= 50 THEN sqrt(252) * stddev_samp(ret) FILTER (k <= 50) END AS vol_50,
      CASE WHEN count(*) >= 100 THEN sqrt(252) * stddev_samp(ret) FILTER (k <= 100) END AS vol_100,
      quantile_cont(vol, 0.05) AS q5, quantile_cont(vol, 0.5) AS q50, quantile_cont(vol, 0.95) AS q95
    FROM hv GROUP BY asset),
  own AS (
    SELECT asset, vol_20, vol_50, vol_100, CASE WHEN n > 100 THEN q5 ELSE vol_20 * 0.8 END AS p5, CASE WHEN n > 100 THEN q50 ELSE vol_20 END AS median,
      CASE WHEN n > 100 THEN q95 ELSE vol_20 * 1.2 END AS p95, n > 100 AND vol_20 > q95 AS elevated
    FROM vc WHERE n >= 50)"""
_MARKET = """mk AS (
  SELECT avg(vol_20) AS mean, quantile_cont(vol_20, 0.5) AS median, quantile_cont(vol_20, 0.75) AS p75, quantile_cont(vol_20, 0.9) AS p90, count(vol_20) AS assets
  FROM vc)"""


@query(f"""WITH {RETS}, {_VOLCI}
  SELECT asset, round(vol_20, 6) AS vol_20, round(vol_50, 6) AS vol_50, round(vol_100, 6) AS vol_100, round(p5, 6) AS p5, round(median, 6) AS median,
    round(p95, 6) AS p95, elevated FROM own""")
def vol_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intervals.volatility_interval(panels.bars(spark, sf_dir)), "vol_20", "vol_50", "vol_100", "p5", "median", "p95")


@query(f"WITH {RETS}, {_VOLCI}, {_MARKET} SELECT round(mean, 6) AS mean, round(median, 6) AS median, round(p75, 6) AS p75, round(p90, 6) AS p90, assets FROM mk")
def market_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intervals.market_volatility(panels.bars(spark, sf_dir)), "mean", "median", "p75", "p90")


@query(f"""WITH {RETS}, {_VOLCI}, {_MARKET},
  x AS (SELECT own.*, mk.mean, mk.median AS md, mk.mean > 0.30 OR mk.mean > 1.5 * mk.median AS stress FROM own, mk)
  SELECT asset, CASE WHEN stress THEN 'HOLD' ELSE 'ROTATE' END AS decision,
    asset || ' volatility ' || printf('%.1f%%', vol_20 * 100) || CASE WHEN elevated THEN ' above its range to ' || printf('%.1f%%', p95 * 100) ELSE ' in its range' END
    || ' | ' || CASE WHEN stress THEN 'market in stress: ' ELSE 'market normal: ' END || 'mean volatility ' || printf('%.1f%%', mean * 100)
    || CASE WHEN stress AND mean <= 0.30 THEN ' far above the median ' || printf('%.1f%%', md * 100) ELSE '' END
    || ' | ' || CASE WHEN stress THEN 'HOLD: the market is in stress' WHEN elevated THEN 'ROTATE: the asset alone is volatile'
        ELSE 'ROTATE: a lower rank in a normal market is real' END AS reason
  FROM x""")
def vol_regime_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = written(panels.bars(spark, sf_dir), "bars")
    return intervals.volatility_decision(intervals.volatility_interval(bars), intervals.market_volatility(bars))


# Joins and sets.


@query(f"""WITH {BARS}, {TYPES}, t AS (SELECT dt, close AS level FROM types WHERE asset = 'PROMO' AND day(dt) <= 5)
  SELECT asset, b.dt, round(level, 8) AS level FROM bars b ASOF LEFT JOIN t ON b.dt >= t.dt""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar with the newest of a series that is published on a few days a month."""
    bars = panels.bars(spark, sf_dir).select("asset", "dt")
    monthly = panels.type_bars(spark, sf_dir).where((F.col("asset") == "PROMO") & (F.dayofmonth("dt") <= 5)).select("dt", F.col("close").alias("level"))
    return rounded(relational.as_of(bars, monthly, [], period=scans.period_of()), "level", digits=8)  # all assets look at one series: there is no key


@query(f"""WITH {BARS}, c AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS next_dt FROM (SELECT DISTINCT dt FROM bars))
  SELECT a.asset, a.dt, c.next_dt, round(b.close / a.close - 1, 6) AS ret FROM bars a JOIN c ON a.dt = c.dt JOIN bars b ON b.asset = a.asset AND b.dt = c.next_dt""")
def next_day_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.next_day_pairs(panels.bars(spark, sf_dir)), "ret")


@query(f"""WITH {RETS} SELECT dt, round(avg(ret), 6) AS ret FROM rets WHERE ret IS NOT NULL AND asset IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY dt""")
def outer_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.returns(panels.bars(spark, sf_dir)).where("ret is not null")
    frames = [rows.where(F.col("asset") == f"Brand#{i}").select("dt", "ret") for i in (1, 2, 3)]
    return rounded(relational.outer_mean(frames, "ret"), "ret")


@query(f"""WITH {BARS}, a AS (SELECT close, row_number() OVER (ORDER BY dt DESC) AS place FROM bars WHERE asset = 'Brand#1'), b AS (SELECT close,
    row_number() OVER (ORDER BY dt DESC) AS place FROM bars WHERE asset = 'Brand#2')
  SELECT CAST(place AS INTEGER) AS place, round(a.close, 8) AS a_close, round(b.close, 8) AS b_close FROM a JOIN b USING (place)""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panels.bars(spark, sf_dir)
    a, b = (bars.where(F.col("asset") == x).select("dt", "close") for x in ("Brand#1", "Brand#2"))
    return rounded(relational.zipped_from_end(a, b).select("place", "a_close", "b_close"), "a_close", "b_close", digits=8)


@query(f"""WITH {RETS}, {ASSETS}, x AS (SELECT asset, count(*) AS n, CASE WHEN count(*) > 1530 THEN 'long' END AS name FROM bars GROUP BY asset)
  SELECT a.asset, region, kind, coalesce(x.name, a.name) AS name, n FROM assets a LEFT JOIN x USING (asset)""")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with later sources winning where they have a value."""
    base = panels.assets(spark, sf_dir).select("asset", "region", "kind", "name")
    counts = panels.bars(spark, sf_dir).groupBy("asset").agg(F.count("*").alias("n"), F.when(F.count("*") > 1530, "long").alias("name"))
    return relational.merged_left(base, counts)


@query(f"WITH {BARS} SELECT DISTINCT dt FROM bars")
def calendar_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.bars(spark, sf_dir).select("dt").distinct()


@query(f"WITH {BARS} SELECT dt FROM bars WHERE asset IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY dt HAVING count(DISTINCT asset) = 3")
def calendar_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.common_days(panels.bars(spark, sf_dir), ["Brand#1", "Brand#2", "Brand#3"])


@query(f"WITH {BARS}, {ASSETS}, l AS (SELECT max(dt) AS d FROM bars) SELECT asset FROM assets WHERE asset NOT IN (SELECT asset FROM bars, l WHERE dt >= d - 1)")
def missing_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets without a bar on the panel's last two days."""
    bars = panels.bars(spark, sf_dir)
    recent = bars.join(F.broadcast(bars.agg(F.date_sub(F.max("dt"), 1).alias("d"))), F.col("dt") >= F.col("d"))  # one row
    return panels.assets(spark, sf_dir).select("asset").join(recent.select("asset"), "asset", "left_anti")


@query(f"""WITH {BARS}, new AS (SELECT asset, dt, close * 2 AS close FROM bars WHERE dt >= DATE '2001-06-01')
  SELECT asset, dt, round(close, 8) AS close FROM bars WHERE (asset, dt) NOT IN (SELECT asset, dt FROM new) UNION ALL SELECT asset, dt, round(close, 8) FROM new""")
def factor_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = panels.bars(spark, sf_dir).select("asset", "dt", "close")
    new = old.where("dt >= date '2001-06-01'").withColumn("close", F.col("close") * 2)
    return rounded(relational.upsert(old, new, ["asset", "dt"]), "close", digits=8)


@query(f"""WITH {BARS}, f AS (SELECT asset, min(dt) AS first FROM bars GROUP BY asset), d AS (SELECT DISTINCT first AS dt FROM f) SELECT dt, count(*) AS available FROM d
    JOIN f ON first <= dt GROUP BY dt""")
def availability_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many assets have begun by each day on which one does, as a running sum."""
    from pyspark.sql import Window

    first = panels.bars(spark, sf_dir).groupBy("asset").agg(F.min("dt").alias("dt")).groupBy("dt").agg(F.count("*").alias("n"))
    return first.select("dt", F.sum("n").over(Window.orderBy("dt")).alias("available"))  # a row per day at most


@query(f"""WITH {RETS}, k AS (SELECT asset, dt, ret FROM rets WHERE asset IN ('Brand#1', 'Brand#2', 'Brand#3') AND ret IS NOT NULL), c AS (SELECT r.asset,
    k.asset AS held, corr(r.ret, k.ret) AS c FROM rets r JOIN k ON r.dt = k.dt WHERE r.ret IS NOT NULL AND r.asset NOT IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY ALL)
  SELECT asset, round(max(c), 6) AS highest, round(avg(c), 6) AS mean FROM c GROUP BY asset""")
def portfolio_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How closely each asset follows the ones that are held."""
    rows = written(signals.returns(panels.bars(spark, sf_dir)).where("ret is not null").select("asset", "dt", "ret"), "returns")
    held = F.col("asset").isin("Brand#1", "Brand#2", "Brand#3")
    c = correlations.common_correlations(rows.where(~held), rows.where(held))
    return rounded(c.groupBy("asset").agg(F.max("corr").alias("highest"), F.avg("corr").alias("mean")), "highest", "mean")


# Ranking.

_RANK = f"""{METRICS}, {ASSETS}, f AS (UNPIVOT (SELECT asset, kind AS band, hit_rate, conviction, stability, volume FROM m JOIN assets USING (asset)
    WHERE rn = n) ON hit_rate, conviction, stability, volume INTO NAME metric VALUE value),
  p AS (SELECT *, rank() OVER (PARTITION BY band, metric ORDER BY value) - 1 AS below, count(*) OVER (PARTITION BY band, metric, value) AS ties,
      count(*) OVER (PARTITION BY band, metric) AS k FROM f),
  pc AS (SELECT asset, band, metric, CASE WHEN metric = 'volume' THEN 100 - 50.0::DOUBLE / k * (2 * below + ties + 1)
      ELSE 50.0::DOUBLE / k * (2 * below + ties + 1) END AS p FROM p),
  t AS (SELECT asset, band, avg(p) AS percentile, max(p) FILTER (metric = 'stability') AS stability FROM pc GROUP BY ALL)"""


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = metrics.newest(panels.bars(spark, sf_dir)).join(panels.assets(spark, sf_dir).select("asset", F.col("kind").alias("band")), "asset")
    factors = newest.unpivot(["asset", "band"], ["hit_rate", "conviction", "stability", "volume"], "metric", "value")
    return ranking.percentile_ranking(factors, inverted=("volume",))


@query(f"""WITH {RETS}, {_RANK} SELECT asset, band, round(percentile, 6) AS percentile, CAST(row_number() OVER (PARTITION BY band ORDER BY round(percentile, 9) DESC,
    asset) AS INTEGER) AS rank FROM t""")
def percentile_rank_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ranking(spark, sf_dir).select("asset", "band", "percentile", "rank"), "percentile")


@query(f"WITH {RETS}, {_RANK} SELECT asset, band, round(percentile, 6) AS percentile FROM t WHERE stability >= 30")
def risk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.without_tail(_ranking(spark, sf_dir), {"stability": 30}).select("asset", "band", "percentile"), "percentile")


@query(f"""WITH {RETS}, {_RANK} SELECT asset, round(sum(p * CASE metric WHEN 'hit_rate' THEN 2.0 WHEN 'conviction' THEN 0.5 ELSE 1 END) / sum(CASE metric
    WHEN 'hit_rate' THEN 2.0 WHEN 'conviction' THEN 0.5 ELSE 1 END), 6) AS weighted FROM pc GROUP BY asset""")
def weighted_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.weighted_percentile(_ranking(spark, sf_dir), {"hit_rate": 2.0, "conviction": 0.5}).select("asset", "weighted"), "weighted")


@query(f"""WITH {RETS}, {_RANK} SELECT asset, array_to_string(list_slice(list(metric ORDER BY p DESC, metric), 1, 3), ',') AS strengths,
    array_to_string(list_slice(list(metric ORDER BY p, metric DESC), 1, 2), ',') AS concerns,
  CASE WHEN count(*) FILTER (p >= 70) >= 3 THEN 'HIGH' WHEN count(*) FILTER (p >= 70) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS conviction FROM pc GROUP BY asset""")
def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.strengths(_ranking(spark, sf_dir))
    return rows.select("asset", F.array_join("strengths", ",").alias("strengths"), F.array_join("concerns", ",").alias("concerns"), "conviction")
