"""Queries on metrics, performance and risk of assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import metrics, risk, signals
from tidemark.plans.rolling import registry, rounded
from tidemark.plans.sql import ASSETS, BARS, RETS, TYPE_RETS, last
from tidemark.session import written
from tidemark.sources import panels

QUERIES, ORACLES, query = registry()

METRICS = f"""m AS (
    SELECT *, CASE WHEN rn > 100 THEN avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER {last(100)} ELSE 0 END AS hit_rate,
      CASE WHEN rn > 40 THEN coalesce(avg(ret) OVER {last(10)} / nullif(abs(avg(ret) OVER {last(40)}), 0), 0) ELSE 0 END AS conviction,
      CASE WHEN rn > 30 THEN 1 / (1 + 10 * stddev_samp(ret) OVER {last(30)}) ELSE 0 END AS stability FROM rets)"""


@query(f"""WITH {RETS}, {METRICS} SELECT asset, dt, round(hit_rate, 6) AS hit_rate, round(conviction, 4) AS conviction, round(stability, 6) AS stability FROM m
    WHERE rn = n""")
def metrics_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.newest(panels.bars(spark, sf_dir))
    return rounded(rounded(rows.select("asset", "dt", "hit_rate", "conviction", "stability"), "hit_rate", "stability"), "conviction", digits=4)


_PERF = f"""WITH {RETS}, g AS (SELECT *, product(1 + coalesce(ret, 0)) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS growth FROM rets),
  d AS (SELECT *, growth / max(growth) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS down FROM g),
  p AS (SELECT asset, arg_max(growth, dt) - 1 AS total, pow(1 + avg(ret), 252) - 1 AS annual, stddev_samp(ret) * sqrt(252) AS volatility, min(down) AS max_drawdown,
    avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE WHEN ret IS NOT NULL THEN 0 END) AS hit_rate FROM d GROUP BY asset)"""


@query(f"""{_PERF} SELECT asset, round(total, 6) AS total, round(ln(1 + annual), 6) AS log_annual, round(volatility, 6) AS volatility, round(max_drawdown,
    6) AS max_drawdown, round(hit_rate, 6) AS hit_rate,
  round(ln(1 + CASE WHEN volatility > 0 THEN annual / volatility ELSE 0 END), 6) AS log_sharpe FROM p""")
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance of each asset; annual return and Sharpe ratio as logarithms, as unit prices jump wildly from day to day."""
    p = metrics.performance(signals.returns(panels.bars(spark, sf_dir)))
    rows = p.select("asset", "total", F.log(1 + F.col("annual")).alias("log_annual"), "volatility", "max_drawdown", "hit_rate", F.log(1 + F.col("sharpe")).alias("log_sharpe"))
    return rounded(rows, "total", "log_annual", "volatility", "max_drawdown", "hit_rate", "log_sharpe")


@query(f"{_PERF} SELECT asset, round(max_drawdown, 6) AS max_drawdown FROM p")
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.equity(written(panels.bars(spark, sf_dir).select("asset", "dt", "close"), "bars"))
    return rounded(rows.groupBy("asset").agg(F.min("drawdown").alias("max_drawdown")), "max_drawdown")


@query(f"""WITH {RETS} SELECT asset, round(avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)), 6) AS annualised, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS daily,
  round((avg(ret) * 252 - 0.0435) / (stddev_samp(ret) * sqrt(252)), 6) AS above_risk_free FROM rets GROUP BY asset""")
def sharpe_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.sharpe_variants(signals.returns(panels.bars(spark, sf_dir))), "annualised", "daily", "above_risk_free")


@query(f"""WITH {RETS}, v AS (SELECT *, n - rn + 1 AS k, volume > 0 AND close > 0 AND ret IS NOT NULL AS valid FROM rets),
  w AS (SELECT *, CASE WHEN valid THEN row_number() OVER (PARTITION BY asset, valid ORDER BY dt DESC) END AS vk FROM v)
  SELECT asset, round(avg(volume) FILTER (k <= 60), 6) AS mean_volume, count(*) FILTER (k <= 60 AND volume = 0) AS zero_days,
    round(CASE WHEN count(*) FILTER (vk <= 60) > 30 THEN avg(abs(ret) / (close * volume)) FILTER (vk <= 60) * 1000000 END, 6) AS impact FROM w GROUP BY asset""")
def liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.liquidity(panels.bars(spark, sf_dir)), "mean_volume", "impact")


@query(f"""WITH {BARS},
  q AS (SELECT asset, count(*) AS rows, count(*) / 252.0::DOUBLE AS years, count(close) / count(*) AS completeness FROM bars
      WHERE dt >= DATE '1999-01-01' OR asset > 'Brand#2' GROUP BY asset)
  SELECT asset, rows, round(years, 6) AS years, round(completeness, 6) AS completeness,
    CASE WHEN years >= 3 THEN 'tier_1' WHEN years >= 2 THEN 'tier_2' WHEN years >= 1 THEN 'tier_3' ELSE 'tier_4' END AS tier,
    CASE WHEN years >= 3 THEN 0.0::DOUBLE WHEN years >= 2 THEN -2.0 WHEN years >= 1 THEN -5.0 ELSE -10.0 END AS penalty,
    round(least(1.0, years / 5 * completeness), 6) AS score FROM q""")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each asset's data; some of them are looked at since 1999 only, so that tiers differ."""
    bars = panels.bars(spark, sf_dir).where("dt >= date '1999-01-01' or asset > 'Brand#2'")
    return rounded(metrics.data_quality(bars), "years", "completeness", "score")


QUARTERS = """ends AS (SELECT asset, CAST(date_trunc('quarter', dt) AS DATE) AS quarter, arg_max(close, dt) AS close FROM bars GROUP BY ALL),
  span AS (SELECT asset, CAST(unnest(generate_series(CAST(min(quarter) AS TIMESTAMP), CAST(max(quarter) AS TIMESTAMP), INTERVAL 3 MONTH)) AS DATE) AS quarter FROM ends
      GROUP BY asset),
  q AS (SELECT s.asset, s.quarter, close, (close / lag(close) OVER (PARTITION BY s.asset ORDER BY s.quarter) - 1) * 100 AS change,
    row_number() OVER (PARTITION BY s.asset ORDER BY s.quarter) AS k FROM span s LEFT JOIN ends e ON e.asset = s.asset AND e.quarter = s.quarter)"""


@query(f"WITH {BARS}, {QUARTERS} SELECT asset, quarter, round(change, 6) AS change FROM q")
def quarter_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.quarters(panels.bars(spark, sf_dir)).select("asset", "quarter", "change"), "change")


@query(f"""WITH {BARS}, {ASSETS}, {QUARTERS}, s AS (SELECT q.*, kind AS sector FROM q JOIN assets USING (asset)),
  md AS (SELECT sector, quarter, median(change) AS med FROM s WHERE change IS NOT NULL GROUP BY ALL)
  SELECT asset, round(avg(CASE WHEN change > med THEN 1.0::DOUBLE ELSE 0 END), 6) AS wins, count(*) AS quarters FROM s JOIN md USING (sector, quarter) WHERE k > 1
      AND asset IN (SELECT asset FROM bars GROUP BY asset HAVING count(*) >= 500) GROUP BY asset""")
def sector_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = panels.assets(spark, sf_dir).select("asset", F.col("kind").alias("sector"))
    bars = written(panels.bars(spark, sf_dir), "bars")
    return rounded(metrics.sector_wins(metrics.quarters(bars), sectors, bars.groupBy("asset").agg(F.count("*").alias("rows"))), "wins")


@query(f"""WITH {RETS}, r AS (SELECT asset, dt, close, row_number() OVER w AS i, close / lag(close) OVER w - 1 AS ret, abs(close - lag(close) OVER w) AS move FROM rets
    WHERE rn > n - 60 WINDOW w AS (PARTITION BY asset ORDER BY dt)),
  u AS (SELECT *, coalesce(CASE WHEN i >= 20 THEN CAST(avg(close) OVER {last(5)} > avg(close) OVER {last(20)} AS INTEGER) END, 0) AS up FROM r),
  t AS (SELECT *, abs(up - lag(up) OVER (PARTITION BY asset ORDER BY dt)) AS turn FROM u)
  SELECT asset, round(CASE WHEN count(*) < 20 THEN 0 ELSE 0.4 * greatest(0, 1 - stddev_samp(ret) * sqrt(252) / 0.5) + 0.4 * greatest(0,
      1 - sum(turn) / count(*)) + 0.2 * greatest(0, 1 - avg(move) / arg_min(close, dt) * 0.05) END, 6) AS stability FROM t GROUP BY asset""")
def short_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.short_stability(panels.bars(spark, sf_dir)), "stability")


@query(f"WITH {BARS} SELECT asset, CAST(year(dt) AS INTEGER) AS year, round(arg_max(close, dt) / arg_min(close, dt) - 1, 6) AS change FROM bars GROUP BY ALL")
def yearly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.yearly(panels.bars(spark, sf_dir)), "change")


_VOL = """v AS (SELECT asset, CASE WHEN count(ret) >= 90 THEN stddev_samp(ret) FILTER (n - rn < 252) * sqrt(252) END AS volatility FROM rets WHERE ret IS NOT NULL
    GROUP BY asset)"""
_BETA = """br AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY dt DESC) AS bk FROM trets WHERE bret IS NOT NULL),
  pairs AS (SELECT r.asset, b.benchmark, count(*) AS k, corr(ret, bret) AS c, covar_samp(ret, bret) AS cov, var_samp(bret) AS var
    FROM rets r JOIN br b ON r.dt = b.dt AND bk <= 252 WHERE ret IS NOT NULL AND n - rn < 252 GROUP BY ALL),
  best AS (SELECT asset, benchmark, c, CASE WHEN abs(cov / nullif(var, 0)) <= 10 THEN cov / nullif(var, 0) END AS beta FROM pairs WHERE k >= 30 AND c IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY asset ORDER BY c DESC, benchmark) = 1)"""


@query(f"WITH {RETS}, {_VOL} SELECT asset, round(volatility, 6) AS volatility FROM v")
def annual_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.volatility(panels.bars(spark, sf_dir)), "volatility")


@query(f"WITH {RETS}, {TYPE_RETS}, {_BETA} SELECT asset, benchmark, round(c, 6) AS corr, round(beta, 6) AS beta FROM best")
def beta_best_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.best_benchmark(panels.bars(spark, sf_dir), panels.benchmarks(spark, sf_dir)), "corr", "beta")


@query(f"""WITH {RETS}, {TYPE_RETS}, {_BETA}, {_VOL}, j AS (SELECT v.asset, volatility, coalesce(beta, CASE WHEN volatility IS NOT NULL THEN 1.0 END) AS beta FROM v LEFT
    JOIN best USING (asset))
  SELECT asset, CASE WHEN volatility IS NULL OR beta IS NULL THEN 'UNKNOWN'
      WHEN volatility < 0.12 THEN CASE WHEN beta > 1.2 THEN 'MEDIUM' ELSE 'LOW' END
      WHEN volatility <= 0.22 THEN CASE WHEN beta > 1.2 THEN 'HIGH' ELSE 'MEDIUM' END
      ELSE CASE WHEN beta < 0.8 THEN 'MEDIUM' ELSE 'HIGH' END END AS risk_class,
    round(0.7 * volatility + 0.3 * abs(beta - 1), 6) AS risk_score FROM j""")
def risk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk class of each asset by volatility and beta; a missing beta counts as one."""
    bars = panels.bars(spark, sf_dir)
    rows = risk.volatility(bars).join(risk.best_benchmark(bars, panels.benchmarks(spark, sf_dir)), "asset", "left")
    rows = rows.withColumn("beta", F.coalesce("beta", F.when(F.col("volatility").isNotNull(), 1.0)))
    vol, beta = F.col("volatility"), F.col("beta")
    return rounded(rows.select("asset", risk.risk_class(vol, beta).alias("risk_class"), risk.risk_score(vol, beta).alias("risk_score")), "risk_score")


_STRESS = """f AS (SELECT dt, level FROM trets WHERE benchmark = 'SMALL' AND level IS NOT NULL),
  j AS (SELECT asset, ret, level, quantile_cont(level, 0.85) OVER (PARTITION BY asset) AS bar, count(*) OVER (PARTITION BY asset) AS common
    FROM rets JOIN f USING (dt) WHERE ret IS NOT NULL),
  st AS (SELECT asset, any_value(common) AS common, count(*) FILTER (level > bar) AS days, avg(ret) FILTER (level > bar) AS mean FROM j GROUP BY asset),
  long AS (SELECT asset, count(ret) AS rows FROM rets GROUP BY asset)"""


@query(f"""WITH {RETS}, {TYPE_RETS}, {_STRESS}
  SELECT asset, days, round(CASE WHEN rows >= 252 AND (SELECT count(*) FROM f) >= 252 AND common >= 100 AND days >= 20
    THEN greatest(-3.0::DOUBLE, least(3.0::DOUBLE, (mean * 252 - 0.0435) / (0.02 * sqrt(5.0 / 3.0) * sqrt(252)))) END, 6) AS sharpe
  FROM st JOIN long USING (asset)""")
def stress_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratios of the days of fear, by the law that stands in where none is fitted."""
    fear = panels.series(spark, sf_dir).where("name = 'vix'").select("dt", "value")
    return rounded(risk.conditional_sharpe(panels.bars(spark, sf_dir), fear), "sharpe")


@query()
def stress_sharpe_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by each asset's own fitted law."""
    bars = written(panels.bars(spark, sf_dir), "bars")
    fear = panels.series(spark, sf_dir).where("name = 'vix'").select("dt", "value")
    return rounded(risk.conditional_sharpe(bars, fear, risk.fitted_laws(bars)), "sharpe", digits=4)


@query()
def enhanced_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.enhanced_volatility(written(panels.bars(spark, sf_dir), "bars")), "volatility", digits=4)


_T_STEP = """s{n} AS (
    SELECT asset, c + sum(w * (ret - c)) / sum(w) AS c, sqrt((sum(w * (ret - c) * (ret - c)) - pow(sum(w * (ret - c)), 2) / sum(w)) / sum(w)) AS s
    FROM (SELECT r.asset, ret, c, 5.0::DOUBLE / (4 + pow((ret - c) / s, 2)) AS w FROM r JOIN s{m} USING (asset)) GROUP BY asset, c)"""


@query(f"""WITH {RETS}, r AS (SELECT asset, ret FROM rets WHERE ret IS NOT NULL), s0 AS (SELECT asset, avg(ret) AS c, stddev_pop(ret) AS s FROM r GROUP BY asset),
  {", ".join(_T_STEP.format(n=i, m=i - 1) for i in (1, 2, 3, 4))}
  SELECT asset, round(c, 6) AS centre, round(s, 6) AS scale FROM s4""")
def t_laws_of_four_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and scale of each asset's returns by a Student-t law of four degrees, after four steps."""
    found = risk.laws_by_sums(signals.returns(panels.bars(spark, sf_dir)), steps=4, degrees=4.0)
    return rounded(found.select("asset", "centre", "scale"), "centre", "scale")


@query()
def cvar_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.cvar(panels.bars(spark, sf_dir)), "cvar", digits=4)


