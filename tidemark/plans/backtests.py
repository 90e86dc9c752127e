"""Queries on portfolio simulations and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import backtest, intervals, metrics, ranking, relational
from tidemark.plans.metrics import METRICS
from tidemark.plans.rolling import registry, rounded
from tidemark.plans.sql import ASSETS, BARS, RETS, last
from tidemark.session import written
from tidemark.sources import panels

QUERIES, ORACLES, query = registry()

START, END = "1996-01-02", "2000-12-31"

# The momentum window has to see all rows, also those before the hundredth.
_SCORES = f"""{METRICS}, {ASSETS},
  mm AS (SELECT *, coalesce(sum(ret) OVER {last(63)}, 0) AS recent FROM m),
  sc AS (
    SELECT mm.asset, dt, rn AS history, recent, (0.35 * hit_rate + 0.40 * (1 / (1 + exp(-conviction))) + 0.25 * stability) * 10 AS score
    FROM mm)"""


def _ranks_sql(dates: str) -> str:
    """Rankings as of the days of ``dates`` (a query with columns d and every, the forecast's days)."""
    return f"""dates AS ({dates}),
  grid AS (SELECT asset, ord, d, every FROM assets, (SELECT DISTINCT d, every FROM dates)),
  newest AS (SELECT g.*, sc.dt AS seen, history, recent, score FROM grid g ASOF JOIN sc ON sc.asset = g.asset AND g.d >= sc.dt),
  open AS (
    SELECT *, count(*) OVER (PARTITION BY d, every) AS available, row_number() OVER (PARTITION BY d, every ORDER BY ord) AS k
    FROM newest
    WHERE recent > -0.1 AND history >= CASE every WHEN 20 THEN 50 WHEN 40 THEN 100 WHEN 60 THEN 150 ELSE 200 END),
  ranks AS (
    SELECT asset, d, every, seen, score, row_number() OVER (PARTITION BY d, every ORDER BY score DESC, ord) AS rank
    FROM open WHERE available >= 10 AND k <= 50 AND history >= CASE every WHEN 40 THEN 100 ELSE 200 END)"""


_PAIRS = """cal AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS next_dt FROM (SELECT DISTINCT dt FROM bars)),
  pairs AS (SELECT a.asset, a.dt, b.close / a.close - 1 AS ret FROM bars a JOIN cal ON a.dt = cal.dt JOIN bars b ON b.asset = a.asset AND b.dt = cal.next_dt)"""


#: Daily returns and growth of the holdings of held (scenario, d, state).
_EQUITY = f"""{_PAIRS},
  days AS (SELECT DISTINCT dt, scenario FROM pairs, scen WHERE dt BETWEEN DATE '{START}' AND DATE '{END}'),
  inforce AS (SELECT days.scenario, dt, state FROM days ASOF JOIN held ON held.scenario = days.scenario AND days.dt >= held.d),
  each AS (SELECT scenario, dt, unnest(state) AS asset FROM inforce),
  daily AS (SELECT scenario, e.dt, coalesce(avg(ret), 0) AS ret FROM each e LEFT JOIN pairs p ON p.asset = e.asset AND p.dt = e.dt GROUP BY ALL),
  eq AS (SELECT *, product(1 + ret) OVER (PARTITION BY scenario ORDER BY dt ROWS UNBOUNDED PRECEDING) AS growth FROM daily)"""


def _conditional_sql(scenarios: str) -> str:
    """Daily returns of the conditional rebalancing of ``scenarios`` (a query with scenario, every, buffer)."""
    return f"""WITH RECURSIVE {RETS}, {_SCORES}, scen AS ({scenarios}),
  steps AS (SELECT scenario, every, buffer, d, row_number() OVER (PARTITION BY scenario ORDER BY d) AS i
    FROM (SELECT scenario, every, buffer, CAST(unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL 1 DAY,
        to_days(CAST(every AS INTEGER)))) AS DATE) AS d FROM scen)),
  {_ranks_sql("SELECT d, every FROM steps")},
  tops AS (SELECT scenario, i, steps.d, coalesce(list(asset ORDER BY rank) FILTER (rank <= buffer), []) AS top FROM steps LEFT JOIN ranks ON ranks.d = steps.d
      AND ranks.every = steps.every GROUP BY ALL),
  held(scenario, i, d, state) AS (
    SELECT scenario, i, d, list_slice(top, 1, 3) FROM tops WHERE i = 1 UNION ALL
    SELECT t.scenario, t.i, t.d, CASE WHEN len(top) = 0 THEN state ELSE list_slice(list_concat(list_filter(state, lambda x: list_contains(top, x)), list_filter(top,
        lambda x: NOT list_contains(state, x))), 1, 3) END
    FROM held h JOIN tops t ON t.scenario = h.scenario AND t.i = h.i + 1),
  {_EQUITY}"""


def _grid(spark: SparkSession, every: tuple[int, ...], buffers: tuple[int, ...]) -> DataFrame:
    """Every pair of check interval and buffer, from two short lists."""
    one = spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, every))).alias("every"))
    return one.withColumn("buffer", F.explode(F.array(*map(F.lit, buffers)))).withColumn("scenario", F.format_string("%d/%d", "every", "buffer"))


def _conditional(spark: SparkSession, sf_dir: str, every: tuple[int, ...], buffers: tuple[int, ...]) -> DataFrame:
    bars, assets = written(panels.bars(spark, sf_dir), "bars"), panels.assets(spark, sf_dir)
    checks = backtest.check_dates(_grid(spark, every, buffers), START, END)
    holdings = backtest.conditional_holdings(checks, backtest.rankings(bars, assets, checks))
    return backtest.equity(backtest.daily_returns(holdings, bars, START, END))


@query(f"""{_conditional_sql('SELECT 1 AS k, 40 AS every, 10 AS buffer, chr(52) AS scenario')} SELECT dt, round(ret, 6) AS ret, round(ln(growth * 100000), 6) AS log_value
    FROM eq""")
def conditional_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equity of three holdings, checked every 40 days and replaced once they leave the best ten; as a logarithm."""
    rows = _conditional(spark, sf_dir, (40,), (10,))
    return rounded(rows.select("dt", "ret", F.log("value").alias("log_value")), "ret", "log_value")


_SWEEP = "SELECT e.every, b.buffer, printf('%d/%d', e.every, b.buffer) AS scenario FROM (VALUES (20), (40), (60), (120)) e(every), (VALUES (5), (10), (15)) b(buffer)"
_SWEEP_DOWN = "sw AS (SELECT scenario, dt, ret, growth, growth / max(growth) OVER (PARTITION BY scenario ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS down FROM eq)"


@query(f"""{_conditional_sql(_SWEEP)}, {_SWEEP_DOWN} SELECT scenario, round(ln(arg_max(growth, dt)), 6) AS log_total, round(min(down), 6) AS max_drawdown, round(avg(CASE
    WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate FROM sw GROUP BY scenario""")
def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve scenarios in one plan."""
    rows = _conditional(spark, sf_dir, (20, 40, 60, 120), (5, 10, 15))
    found = metrics.performance(rows.select("scenario", "dt", "ret"), "scenario")
    return rounded(found.select("scenario", F.log(1 + F.col("total")).alias("log_total"), "max_drawdown", "hit_rate"), "log_total", "max_drawdown", "hit_rate")


@query(f"""{_conditional_sql(_SWEEP)}, t AS (SELECT split_part(scenario, '/', 1) AS every, split_part(scenario, '/', 2) AS buffer, ln(arg_max(growth, dt)) AS lt FROM eq
    GROUP BY scenario) SELECT every, buffer, round(avg(lt), 6) AS mean_log_total, count(*) AS cells FROM t GROUP BY CUBE (every, buffer)""")
def grid_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean result by check interval, by buffer, by both and overall."""
    rows = _conditional(spark, sf_dir, (20, 40, 60, 120), (5, 10, 15)).groupBy("scenario").agg(F.log(F.max_by("value", "dt") / backtest.CAPITAL).alias("lt"))
    parts = F.split("scenario", "/")
    found = rows.select(parts[0].alias("every"), parts[1].alias("buffer"), "lt").cube("every", "buffer").agg(F.avg("lt").alias("mean_log_total"), F.count("*").alias("cells"))
    return rounded(found, "mean_log_total")


@query(f"""WITH {RETS}, {_SCORES}, {_ranks_sql(f"SELECT DATE '{START}' AS d, 63 AS every")},
  best AS (SELECT asset FROM ranks WHERE rank <= 3),
  daily AS (SELECT dt, avg(ret) AS ret FROM rets WHERE ret IS NOT NULL AND dt BETWEEN DATE '{START}' AND DATE '{END}' AND asset IN (SELECT asset FROM best) GROUP BY dt)
  SELECT dt, round(ret, 6) AS ret, round(ln(product(1 + ret) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) * 100000), 6) AS log_value FROM daily""")
def buy_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backtest.buy_and_hold(written(panels.bars(spark, sf_dir), "bars"), panels.assets(spark, sf_dir), START, END)
    return rounded(rows.select("dt", "ret", F.log("value").alias("log_value")), "ret", "log_value")


@query(f"""WITH {BARS}, c AS (SELECT dt FROM bars WHERE asset IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY dt HAVING count(DISTINCT asset) = 3),
  r AS (SELECT dt, close / lag(close) OVER (PARTITION BY asset ORDER BY dt) - 1 AS ret FROM bars WHERE asset IN ('Brand#1', 'Brand#2', 'Brand#3') AND dt IN (SELECT dt
      FROM c)),
  daily AS (SELECT dt, avg(ret) AS ret FROM r WHERE ret IS NOT NULL GROUP BY dt)
  SELECT dt, round(ln(product(1 + ret) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) * 100000), 6) AS log_value FROM daily""")
def equal_weight_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backtest.equal_weight_common(panels.bars(spark, sf_dir), ["Brand#1", "Brand#2", "Brand#3"])
    return rounded(rows.select("dt", F.log("value").alias("log_value")), "log_value")


@query(f"""WITH {RETS}, {_SCORES},
    {_ranks_sql(f"SELECT CAST(last_day(CAST(unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 MONTH)) AS DATE)) AS DATE) AS d, 63 AS every")},
  picks AS (SELECT d, list(asset) AS held FROM ranks WHERE rank <= 3 GROUP BY d),
  days AS (SELECT DISTINCT dt FROM rets WHERE ret IS NOT NULL AND dt BETWEEN DATE '{START}' AND DATE '{END}'),
  inforce AS (SELECT dt, unnest(held) AS asset FROM days ASOF JOIN picks ON days.dt >= picks.d),
  daily AS (SELECT r.dt, avg(ret) AS ret FROM rets r JOIN inforce i ON i.asset = r.asset AND i.dt = r.dt WHERE ret IS NOT NULL GROUP BY r.dt)
  SELECT dt, round(ln(product(1 + ret) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) * 100000), 6) AS log_value FROM daily""")
def scheduled_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backtest.scheduled(written(panels.bars(spark, sf_dir), "bars"), panels.assets(spark, sf_dir), START, END)
    return rounded(rows.select("dt", F.log("value").alias("log_value")), "log_value")


@query(f"""WITH {RETS}, s AS (SELECT *, sum(ret) OVER {last(20)} AS s20 FROM rets)
  SELECT asset, round(CASE WHEN n >= 100 THEN greatest(-0.1, least(0.1, s20)) * 100 ELSE 0 END, 6) AS forecast, CASE WHEN n >= 100 THEN 0.9::DOUBLE
      ELSE 0.5 END AS confidence FROM s WHERE rn = n""")
def forecast_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.forecasts(panels.bars(spark, sf_dir)), "forecast")


@query(f"""WITH {RETS}, s AS (SELECT *, sum(ret) OVER {last(20)} AS s20, sum(ret) OVER {last(19)} AS s19 FROM rets), h AS (SELECT *, lag(s20, 20) OVER (PARTITION BY asset
    ORDER BY dt) AS p FROM s)
  SELECT asset, count(*) AS windows, round(CASE WHEN count(*) >= 3 THEN avg(CAST(sign(p) = sign(s19) AS DOUBLE)) END, 6) AS hit_rate FROM h WHERE rn >= 120
      AND (rn - 120) % 15 = 0 AND rn < n - 20 GROUP BY asset""")
def walk_forward_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.walk_forward_hits(panels.bars(spark, sf_dir)), "hit_rate")


def _checks(spark: SparkSession) -> DataFrame:
    return backtest.check_dates(_grid(spark, (40,), (20,)), START, END)


def ci_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings by interval signals, which compare each check date's metrics with the intervals as they stood."""
    bars, assets, checks = written(panels.bars(spark, sf_dir), "bars"), panels.assets(spark, sf_dir), _checks(spark)
    rows = written(metrics.behaviour(bars).select("asset", "dt", *intervals.METRICS), "behaviour")
    signals = written(intervals.signals_as_of(rows, checks).select("asset", "dt", "signal"), "signals")
    ranks = written(backtest.rankings(bars, assets, checks), "ranks")
    best = signals.join(ranks.where("rank <= 20").select("asset", "dt"), ["asset", "dt"], "left_semi")
    stressed = best.groupBy("dt").agg((F.avg((F.col("signal") == "ROTATE").cast("double")) > 0.3).alias("stressed"))
    return backtest.signal_holdings(ranks, signals, stressed)


_CHECKS = f"""steps AS (SELECT d, 40 AS every FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL 1 DAY, INTERVAL 40 DAY)) AS DATE) AS d))"""


def _point(p: float) -> str:
    """A quantile of list s, between its values as if they stood at even distances."""
    at = f"({p}::DOUBLE * (len(s) - 1))"
    low, high = (f"list_sort(s)[CAST({f}({at}) AS BIGINT) + 1]" for f in ("floor", "ceil"))
    return f"{low} + ({at} - floor({at})) * ({high} - {low})"


def _machine(pick: str, guard: str) -> str:
    """The holdings of held by day: each outside the best three gives way to what ``pick`` offers, unless ``guard`` keeps it."""

    def choice(i: int, chosen: list[str]) -> str:
        free = f"list_filter({pick}, lambda x: NOT list_contains(state, x)" + "".join(f" AND x IS DISTINCT FROM {c}" for c in chosen) + ")[1]"
        return f"CASE WHEN state[{i}] IS NULL OR list_contains(top[1:3], state[{i}]) OR {guard.format(own=f'state[{i}]')} THEN state[{i}] ELSE coalesce({free}, state[{i}]) END"

    return f"""held0(i, d, state) AS (
    SELECT i, d, top[1:3] FROM tops WHERE i = 1
    UNION ALL
    SELECT i, d, CASE WHEN len(state) = 0 THEN top[1:3] WHEN frozen THEN state
      ELSE list_slice(list_concat(list_filter([c1, c2, c3], lambda x: x IS NOT NULL), list_filter(top, lambda x: NOT list_contains([c1, c2, c3], x))), 1, 3) END
    FROM (SELECT *, {choice(3, ["c1", "c2"])} AS c3 FROM (SELECT *, {choice(2, ["c1"])} AS c2 FROM (SELECT *, {choice(1, [])} AS c1
      FROM (SELECT t.*, h.state FROM held0 h JOIN tops t ON t.i = h.i + 1)))))"""


#: A decision of each asset on each check date, by the intervals of its last hundred days with enough history.
_SIGNALS_AS_OF = f"""known AS (SELECT * FROM m WHERE rn >= 100),
  newest_at AS (SELECT a.asset, dates.d, k.dt AS seen FROM (SELECT DISTINCT asset FROM known) a CROSS JOIN (SELECT DISTINCT d FROM steps) dates ASOF JOIN known k ON k.asset = a.asset AND dates.d >= k.dt),
  hist AS (UNPIVOT (SELECT asset, dt, hit_rate, conviction, stability FROM known) ON hit_rate, conviction, stability INTO NAME metric VALUE value),
  framed AS (SELECT *, list(value) OVER (PARTITION BY asset, metric ORDER BY dt ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS s FROM hist),
  ends AS (SELECT f.asset, f.dt, metric, value, s, {_point(0.01)} AS lo, {_point(0.99)} AS hi FROM framed f WHERE (f.asset, f.dt) IN (SELECT (asset, seen) FROM newest_at)),
  drawn AS (SELECT asset, dt, value, CASE WHEN metric = 'conviction' THEN list_transform(s, lambda y: greatest(lo, least(hi, y))) ELSE s END AS s FROM ends),
  bounded AS (SELECT asset, dt, value, {_point(0.025)} AS lower, {_point(0.975)} AS upper FROM drawn),
  gaps AS (SELECT asset, dt, CASE WHEN value < lower THEN lower - value WHEN value > upper THEN value - upper ELSE 0 END AS gap, abs(CASE WHEN value < lower THEN lower ELSE upper END) AS bound FROM bounded),
  weights AS (SELECT asset, dt, sum(CASE WHEN gap = 0 THEN 0.0 WHEN CASE WHEN bound = 0 THEN gap ELSE gap / bound END <= 0.10 THEN 0.3
      WHEN CASE WHEN bound = 0 THEN gap ELSE gap / bound END <= 0.20 THEN 0.7 ELSE 1.0 END)::DOUBLE AS weight FROM gaps GROUP BY ALL),
  signals AS (SELECT n.asset, n.d, CASE WHEN weight < 0.5 THEN 'HOLD' WHEN weight <= 1.5 THEN 'WAIT' ELSE 'ROTATE' END AS signal FROM newest_at n JOIN weights w ON w.asset = n.asset AND w.dt = n.seen)"""


@query(f"""WITH RECURSIVE {RETS}, {_SCORES}, {_CHECKS}, {_ranks_sql("SELECT d, every FROM steps")}, {_SIGNALS_AS_OF},
  days AS (SELECT r.d, r.asset, r.rank, s.signal FROM ranks r LEFT JOIN signals s ON s.asset = r.asset AND s.d = r.d WHERE r.rank <= 20),
  tops AS (
    SELECT d, row_number() OVER (ORDER BY d) AS i, list(asset ORDER BY rank) AS top, list(asset ORDER BY rank) FILTER (rank <= 3 AND signal = 'ROTATE') AS rotating,
      list({{'asset': asset, 'signal': coalesce(signal, 'NONE')}}) AS sigs, coalesce(avg(CAST(signal = 'ROTATE' AS DOUBLE)) FILTER (signal IS NOT NULL) > 0.3, FALSE) AS frozen
    FROM days GROUP BY d),
  {_machine("coalesce(rotating, [])", "coalesce(list_filter(sigs, lambda x: x.asset = {own})[1].signal, 'WAIT') NOT IN ('HOLD', 'WAIT')")}
  SELECT d AS dt, array_to_string(state, ',') AS holdings FROM held0""")
def ci_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is held from each check date on by interval signals."""
    return ci_holdings(spark, sf_dir).select("dt", F.array_join("holdings", ",").alias("holdings"))


def volatility_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings that rotate while the market is calm."""
    bars, assets, checks = written(panels.bars(spark, sf_dir), "bars"), panels.assets(spark, sf_dir), _checks(spark)
    vols = bars.withColumn("ret", S.simple_return()).withColumn("vol", intervals.annual(S.rolling_std("ret", 20))).where("vol is not null").select("asset", "dt", "vol")
    grid = checks.select("dt").distinct().crossJoin(assets.select("asset")).withColumn("wanted", F.lit(1))
    at = relational.as_of(grid.select("asset", "dt", "wanted"), vols, ["asset"])
    calm = at.groupBy("dt").agg((~intervals.stressed(F.avg("vol"), F.median("vol"))).alias("calm"))
    return backtest.volatility_holdings(backtest.rankings(bars, assets, checks), calm)


@query(f"""WITH RECURSIVE {RETS}, {_SCORES}, {_CHECKS}, {_ranks_sql("SELECT d, every FROM steps")},
  vols AS (SELECT * FROM (SELECT asset, dt, CASE WHEN count(ret) OVER {last(20)} >= 20 THEN sqrt(252) * stddev_samp(ret) OVER {last(20)} END AS vol FROM rets) WHERE vol IS NOT NULL),
  newest_at AS (SELECT a.asset, steps.d, v.vol FROM assets a CROSS JOIN steps ASOF JOIN vols v ON v.asset = a.asset AND steps.d >= v.dt),
  calm AS (SELECT d, NOT (avg(vol) > 0.30 OR avg(vol) > 1.5 * median(vol)) AS calm FROM newest_at GROUP BY d),
  tops AS (SELECT r.d, row_number() OVER (ORDER BY r.d) AS i, list(asset ORDER BY rank) AS top, NOT coalesce(any_value(calm), FALSE) AS frozen
    FROM ranks r LEFT JOIN calm ON calm.d = r.d WHERE rank <= 20 GROUP BY r.d),
  {_machine("top[1:5]", "FALSE")},
  scen AS (SELECT 'volatility' AS scenario), held AS (SELECT 'volatility' AS scenario, i, d, state FROM held0), {_EQUITY}
  SELECT dt, round(ln(growth * 100000), 6) AS log_value FROM eq""")
def vol_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity of holdings that rotate while the market is calm."""
    bars = panels.bars(spark, sf_dir)
    rows = backtest.equity(backtest.daily_returns(volatility_holdings(spark, sf_dir), bars, START, END))
    return rounded(rows.select("dt", F.log("value").alias("log_value")), "log_value")


@query(f"""WITH {RETS}, {_SCORES}, {_ranks_sql("SELECT max(dt) AS d, 63 AS every FROM bars")}
  SELECT asset, seen AS dt, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranks WHERE rank <= 20""")
def quality_rank_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the twenty best assets by score as of the panel's last day."""
    found = ranking.top_as_of(panels.bars(spark, sf_dir), panels.assets(spark, sf_dir), None, 20)
    return rounded(found.select("asset", F.col("seen").alias("dt"), "score", "rank"), "score")
