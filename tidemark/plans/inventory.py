"""Queries on look-ups, report lists, model features, strategies compared, and single assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions import series as S
from tidemark.operators import backtest, compare, explore, features, intervals, metrics, relational, scores, single
from tidemark.plans import backtests as B
from tidemark.plans.decisions import _CI, _CURRENT, _signals
from tidemark.plans.market import _UNIVERSE, universe
from tidemark.plans.metrics import METRICS
from tidemark.plans.rolling import _ewm_sql, registry, rounded
from tidemark.plans.sql import ASSETS, BARS, RETS, SERIES, TYPES
from tidemark.session import new_folder, written
from tidemark.sources import panels, sinks

QUERIES, ORACLES, query = registry()

# Look-ups and lists.


@query(f"WITH {ASSETS} SELECT asset, name, region, kind FROM assets WHERE asset = 'Brand#13'")
def asset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first asset with a key."""
    return explore.lookup(panels.assets(spark, sf_dir), "asset", "Brand#13").select("asset", "name", "region", "kind")


@query(f"WITH {ASSETS} SELECT asset, region, kind FROM assets WHERE region = 'AU' AND kind = 'Equity'")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of a region and a type."""
    return explore.where_equal(panels.assets(spark, sf_dir), region="AU", kind="Equity").select("asset", "region", "kind")


_NAMED = f"""{ASSETS}, nm AS (SELECT asset, CASE WHEN ord % 5 = 0 THEN asset WHEN ord % 7 = 0 THEN '' WHEN ord % 11 = 0 THEN NULL ELSE name END AS name FROM assets)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets some of whose names are missing in one way or another."""
    o = F.col("ord")
    name = F.when(o % 5 == 0, F.col("asset")).when(o % 7 == 0, "").when(o % 11 == 0, F.lit(None)).otherwise(F.col("name"))
    return panels.assets(spark, sf_dir).select("asset", name.alias("name"))


@query(f"WITH {_NAMED} SELECT asset FROM nm WHERE name IS NULL OR name = '' OR name = asset")
def missing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.without_name(_named(spark, sf_dir), "asset", "name").select("asset")


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')', '\\([^)]*\\)', '', 'g'), '[^A-Za-z ]+', ' ', 'g')) AS name FROM part")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without what stands in brackets and without anything but letters and spaces."""
    text = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return panels.table(spark, sf_dir, "part").select("p_partkey", rules.clean_name(text).alias("name"))


@query(f"""WITH {RETS}, {_UNIVERSE},
  o AS (SELECT asset, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, asset) AS up, row_number() OVER (ORDER BY round(score, 6),
      asset) AS down FROM u)
  SELECT 'top 15' AS list, CAST(up AS INTEGER) AS place, asset, score FROM o WHERE up <= 15 UNION ALL SELECT 'top 10', up, asset, score FROM o WHERE up <= 10
  UNION ALL SELECT 'top 5', up, asset, score FROM o WHERE up <= 5 UNION ALL SELECT 'top 1', up, asset, score FROM o WHERE up <= 1 UNION ALL SELECT 'bottom 5', down,
      asset, score FROM o WHERE down <= 5""")
def report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of a report: the best 1, 5, 10 and 15 assets and the worst 5."""
    rows = written(rounded(universe(spark, sf_dir).select("asset", "score"), "score"), "universe")
    out = None
    for name, n, best in (("top 15", 15, True), ("top 10", 10, True), ("top 5", 5, True), ("top 1", 1, True), ("bottom 5", 5, False)):
        part = explore.extremes(rows, "score", n, best).select(F.lit(name).alias("list"), "place", "asset", "score")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {RETS}, {_UNIVERSE}, v AS (SELECT asset, avg(volume) AS mean_volume FROM rets WHERE n - rn < 60 GROUP BY asset)
  SELECT asset, round(score, 6) AS score, round(mean_volume, 6) AS mean_volume, expense FROM (SELECT u.*, mean_volume, length(name) / 100.0::DOUBLE AS expense FROM u
      JOIN v USING (asset))
  WHERE band IN ('Equity', 'Bond') AND score >= 2 AND mean_volume >= 60 AND expense <= 0.1""")
def universe_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets by band and score, with a least volume and a most expense."""
    bars = panels.bars(spark, sf_dir)
    volume = metrics.liquidity(bars).select("asset", "mean_volume")
    rows = universe(spark, sf_dir).join(volume, "asset").withColumn("expense", F.length("name") / 100)
    found = explore.filter_universe(rows, ["Equity", "Bond"], (2, float("inf")), volume=60, expense=0.1)
    return rounded(found.select("asset", "score", "mean_volume", "expense"), "score", "mean_volume")


@query(f"""WITH {ASSETS}, t AS (SELECT asset, kind, region, CASE kind WHEN 'Bond' THEN 'bond' WHEN 'Commodity' THEN 'commodity' ELSE CASE WHEN ord % 2 = 0 THEN 'growth'
    ELSE 'thematic' END END AS type,
    CASE region WHEN 'AU' THEN 'AUSTRALIA' ELSE region END AS place FROM assets)
  SELECT asset, CASE WHEN type = 'bond' THEN 'Bonds' WHEN type = 'commodity' THEN 'Commodities' WHEN place = 'AUSTRALIA' AND type IN ('broad_market',
      'growth') THEN 'Australian_Equity' ELSE 'International_Equity' END AS class FROM t""")
def asset_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.assets(spark, sf_dir)
    kind = F.when(F.col("kind") == "Bond", "bond").when(F.col("kind") == "Commodity", "commodity").when(F.col("ord") % 2 == 0, "growth").otherwise("thematic")
    place = F.when(F.col("region") == "AU", "AUSTRALIA").otherwise(F.col("region"))
    return rows.select("asset", rules.asset_group(kind, place).alias("class"))


@query(f"WITH {RETS}, {_UNIVERSE} SELECT asset, band, round(score, 6) AS score FROM u")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe as CSV with a map spread over columns, and read back."""
    path = new_folder(spark, "csv")
    rows = rounded(universe(spark, sf_dir).select("asset", "band", "score"), "score")
    sinks.csv(sinks.spread(rows.select("asset", F.create_map(F.lit("band"), F.col("band"), F.lit("score"), F.col("score").cast("string")).alias("m")), "m", ["band", "score"], "m_"), path)
    found = spark.read.option("header", True).schema("asset string, m_band string, m_score double").csv(path)
    return found.select("asset", F.col("m_band").alias("band"), F.col("m_score").alias("score"))


@query(f"WITH {RETS}, {_UNIVERSE} SELECT asset, band, round(score, 6) AS score FROM u WHERE forecast > 0")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe as JSON documents with nested fields, read back by their schema."""
    path = new_folder(spark, "json")
    rows = rounded(universe(spark, sf_dir), "score").select("asset", F.struct("band", "forecast").alias("about"), "score")
    sinks.json(rows, path)
    found = panels.json_documents(spark, path, "asset string, about struct<band: string, forecast: double>, score double")
    return found.where("about.forecast > 0").select("asset", "about.band", "score")


@query(f"""WITH {BARS}, o AS (SELECT asset, dt, close FROM bars WHERE asset < 'Brand#3'), new AS (SELECT asset, dt, close * 2 AS close FROM o
    WHERE dt >= DATE '2001-06-01')
  SELECT asset, dt, round(close, 8) AS close FROM o WHERE (asset, dt) NOT IN (SELECT asset, dt FROM new) UNION ALL SELECT asset, dt, round(close, 8) FROM new""")
def upserted_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by asset with newer rows put in place of their keys, as a new table."""
    a, b = new_folder(spark, "factors"), new_folder(spark, "factors-new")
    old = panels.bars(spark, sf_dir).where("asset < 'Brand#3'").select("asset", "dt", "close")
    sinks.partitioned(old, a, "asset")
    sinks.upserted(a, old.where("dt >= date '2001-06-01'").withColumn("close", F.col("close") * 2), ["asset", "dt"], "asset", b)
    return rounded(spark.read.parquet(b).select("asset", "dt", "close"), "close", digits=8)


@query(f"""WITH {BARS}
  SELECT asset, dt, round(CASE WHEN asset < 'Brand#3' AND day(dt) % 2 = 0 THEN close / 2 ELSE close END, 8) AS price FROM bars""")
def adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted closes where there are any: for some assets on every other day, and for the others there is no such column."""
    bars = panels.bars(spark, sf_dir).select("asset", "dt", "close")
    own = bars.where("asset < 'Brand#3'").withColumn("adj_close", F.when(F.dayofmonth("dt") % 2 == 0, F.col("close") / 2))
    rows = panels.adjusted(own).unionByName(panels.adjusted(bars.where("asset >= 'Brand#3'")))
    return rounded(rows.select("asset", "dt", "price"), "price", digits=8)


# Model features.

_ROLES = {"gold": "gold", "vix": "vix", "rates": "us_10y", "equity": "equity", "bonds": "bonds"}
_SPREAD = ("equity", "gold", "bonds")


def _external_corr(a: str, b: str) -> str:
    return f"""(SELECT CASE WHEN count(*) >= 30 THEN coalesce(corr(x, y) FILTER (k <= 60), 0) ELSE 0 END FROM (
      SELECT a.r AS x, b.r AS y, row_number() OVER (ORDER BY a.dt DESC) AS k FROM er a JOIN er b ON a.dt = b.dt WHERE a.name = '{a}' AND b.name = '{b}'))"""


_FEATURES = f"""{SERIES}, er AS (SELECT name, dt, value / lag(value) OVER (PARTITION BY name ORDER BY dt) - 1 AS r FROM series QUALIFY r IS NOT NULL),
  ml AS (SELECT *, {_ewm_sql("close", 12)} - {_ewm_sql("close", 26)} AS line FROM rets WINDOW w AS (PARTITION BY asset ORDER BY dt)),
  ms AS (SELECT *, {_ewm_sql("line", 9)} AS mean FROM ml WINDOW w AS (PARTITION BY asset ORDER BY dt)),
  own AS (
    SELECT asset, any_value(n) AS n, count(ret) AS rets, stddev_samp(ret) FILTER (rn > n - 30) AS sd, max(close) FILTER (rn = n) AS close,
        max(close) FILTER (rn = n - 20) AS before,
      max(line) FILTER (rn = n) AS line, max(mean) FILTER (rn = n) AS mean FROM ms GROUP BY asset),
  gp AS (SELECT r.asset, r.ret AS x, er.r AS y, row_number() OVER (PARTITION BY r.asset ORDER BY r.dt DESC) AS k FROM rets r JOIN er ON er.dt = r.dt AND er.name = 'gold'
      WHERE r.ret IS NOT NULL),
  gc AS (SELECT asset, CASE WHEN count(*) >= 30 THEN coalesce(corr(x, y) FILTER (k <= 60), 0) ELSE 0 END AS gold FROM gp GROUP BY asset),
  sp AS (SELECT name, stddev_samp(r) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dt DESC) AS k FROM er) WHERE k <= 60 AND name IN ('equity',
      'gold', 'bonds') GROUP BY name),
  mf AS (
    SELECT asset, CASE WHEN rets > 30 THEN least(1, sd * sqrt(252)) ELSE 0.15 END AS volatility, greatest(-0.5, least(0.5, close / before - 1)) AS momentum,
      greatest(0.5, least(2.0, line / greatest(sd, 0.01))) AS volatility_level, greatest(0, least(1, abs(mean) * 20)) AS signal_quality, greatest(-0.1, least(0.1,
          (line - mean) / close)) AS macd_histogram,
      greatest(-0.05, least(0.05, line / close)) AS macd_signal, gold AS gold_equity_corr, {_external_corr("vix", "us_10y")} AS vix_rates_corr,
      greatest(0, least(0.1, (SELECT CASE WHEN count(*) >= 2 THEN stddev_pop(sd) ELSE 0.05 END FROM sp))) AS cross_asset_dispersion,
          {_external_corr("equity", "bonds")} AS equity_bonds_corr
    FROM own JOIN gc USING (asset) WHERE n >= 60)"""


def _model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.model_features(written(panels.bars(spark, sf_dir), "bars"), written(panels.series(spark, sf_dir), "series"), _ROLES, _SPREAD)


@query(f"WITH {RETS}, {_FEATURES} SELECT asset, {', '.join(f'round({n}, 5) AS {n}' for n in features.ORDER)} FROM mf")
def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_model_features(spark, sf_dir), *features.ORDER, digits=5)


_SCALED = ", ".join(
    f"round(greatest(0, least(1, ({n} - ({features.BOUNDS[label][0]})) / ({features.BOUNDS[label][1] - features.BOUNDS[label][0]}::DOUBLE))), 5) AS {n}" for n, label in zip(features.ORDER, features.LABELS, strict=True)
)


@query(f"WITH {RETS}, {_FEATURES} SELECT asset, {_SCALED} FROM mf")
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.scaled(_model_features(spark, sf_dir)), *features.ORDER, digits=5)


# Intervals as of each day.

_POINT = "x[CAST(floor({p} * (len(x) - 1)) AS BIGINT) + 1] + ({p} * (len(x) - 1) - floor({p} * (len(x) - 1))) * (x[CAST(ceil({p} * (len(x) - 1)) AS BIGINT) + 1] - x[CAST(floor({p} * (len(x) - 1)) AS BIGINT) + 1])"


def _point(p: float, x: str = "x") -> str:
    return "(" + _POINT.format(p=f"{p}::DOUBLE").replace("x[", f"{x}[").replace("len(x)", f"len({x})") + ")"


INTERVAL_HISTORY = f"""WITH {RETS}, {METRICS}, h AS (UNPIVOT (SELECT asset, dt, rn, n, hit_rate, conviction, stability FROM m WHERE rn >= 100) ON hit_rate, conviction,
    stability INTO NAME metric VALUE value),
  l AS (SELECT asset, metric, dt, rn, list_sort(list(value) OVER (PARTITION BY asset, metric ORDER BY dt ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) AS s FROM h),
  w AS (SELECT *, {_point(0.01, "s")} AS lo, {_point(0.99, "s")} AS hi FROM l WHERE rn % 200 = 0),
  v AS (SELECT asset, metric, dt, CASE WHEN metric = 'conviction' THEN list_transform(s, lambda y: greatest(lo, least(hi, y))) ELSE s END AS x FROM w)
  SELECT asset, metric, dt, round({_point(0.025)}, 4) AS lower, round({_point(0.975)}, 4) AS upper, round(list_avg(x), 4) AS mean FROM v"""


@query(INTERVAL_HISTORY)
def interval_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals as they stood on every two hundredth day of each asset, from the hundred days up to it."""
    rows = metrics.behaviour(panels.bars(spark, sf_dir)).withColumn("rn", F.row_number().over(S.by_asset())).where("rn >= 100")
    found = intervals.as_of_each(rows, wanted=F.col("rn") % 200 == 0)
    return rounded(found.select("asset", "metric", "dt", "lower", "upper", "mean"), "lower", "upper", "mean", digits=4)


@query(f"""WITH {RETS}, {_CI}, {_CURRENT}, s AS (SELECT avg(CAST(signal = 'ROTATE' AS DOUBLE)) > 0.3 AS stressed FROM decided)
  SELECT count(*) AS decisions, count(*) FILTER (NOT stressed AND signal IN ('ROTATE', 'NO_CI')) AS rotations, count(*) FILTER (NOT stressed
      AND signal = 'HOLD') AS noise_prevented, count(*) FILTER (NOT stressed AND signal = 'WAIT') AS waiting
  FROM decided, s""")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many decisions there are, how many rotate, and how many changes were held back as noise."""
    return intervals.decision_counts(_signals(spark, sf_dir))


# Strategies compared.

_FIRST, _LAST = "1996-01-01", "2000-12-31"


@query(f"""WITH {TYPES}, cal AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS next_dt FROM (SELECT DISTINCT dt FROM types)),
  pr AS (SELECT a.asset, cal.next_dt AS dt, b.close / a.close - 1 AS ret FROM types a JOIN cal ON cal.dt = a.dt JOIN types b ON b.asset = a.asset AND b.dt = cal.next_dt),
  cr AS (SELECT * FROM pr WHERE dt IN (SELECT dt FROM pr GROUP BY dt HAVING count(*) = (SELECT count(DISTINCT asset) FROM types)) AND dt BETWEEN DATE '{_FIRST}'
      AND DATE '{_LAST}'),
  qe AS (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM (SELECT CAST(last_day(CAST(unnest(generate_series(TIMESTAMP '1996-03-01', TIMESTAMP '2000-12-01',
      INTERVAL 3 MONTH)) AS DATE)) AS DATE) AS a)),
  sp AS (SELECT * FROM qe WHERE a IN (SELECT dt FROM cr) AND b IN (SELECT dt FROM cr)),
  mn AS (SELECT a, b, asset, avg(ret) AS mean FROM cr JOIN sp ON dt BETWEEN a - 90 AND a GROUP BY ALL),
  ld AS (SELECT a, b, asset FROM mn QUALIFY row_number() OVER (PARTITION BY a ORDER BY mean DESC, asset) <= 3),
  st AS (
    SELECT 'hold_first' AS strategy, dt, avg(ret) AS ret FROM cr WHERE asset IN (SELECT DISTINCT asset FROM types ORDER BY asset LIMIT 3) GROUP BY dt
    UNION ALL SELECT 'quarterly_leaders', dt, ret FROM (SELECT a, dt, avg(ret) AS ret FROM cr JOIN ld USING (asset) WHERE dt BETWEEN a AND b GROUP BY a, dt)
    UNION ALL SELECT 'equal_weight', dt, avg(ret) FROM cr GROUP BY dt UNION ALL SELECT 'benchmark', dt, ret FROM cr WHERE asset = 'STANDARD')
  SELECT strategy, count(*) AS days, round(sum(ln(1 + ret)), 6) AS log_total FROM st GROUP BY strategy""")
def strategy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holding the first three, following each quarter's leaders, and holding all alike, beside a benchmark."""
    panel = written(panels.type_bars(spark, sf_dir).select("asset", "dt", "close"), "types")
    return rounded(compare.totals(compare.strategies(panel, "STANDARD", _FIRST, _LAST)), "log_total")


_THREE = "SELECT e.every, b.buffer, printf('%d/%d', e.every, b.buffer) AS scenario FROM (VALUES (20), (40)) e(every), (VALUES (5), (15)) b(buffer)"
_PERIODS = (("calm", "1996-01-02", "1997-06-30"), ("stress", "1997-07-01", "1998-12-31"), ("recovery", "1999-01-01", "2000-12-31"))
_EDGES = f"""{B._conditional_sql(_THREE)}, bench AS (SELECT dt, avg(ret) AS b FROM pairs WHERE dt BETWEEN DATE '{B.START}' AND DATE '{B.END}' GROUP BY dt),
  pd(period, a, b) AS (VALUES {", ".join(f"('{p}', DATE '{a}', DATE '{b}')" for p, a, b in _PERIODS)}),
  g AS (SELECT scenario, period, eq.dt, ret, bench.b AS bench, exp(sum(ln(1 + ret)) OVER w) AS growth FROM eq JOIN bench USING (dt) JOIN pd ON eq.dt BETWEEN pd.a AND pd.b
      WINDOW w AS (PARTITION BY scenario, period ORDER BY eq.dt ROWS UNBOUNDED PRECEDING)),
  dd AS (SELECT *, growth / max(growth) OVER (PARTITION BY scenario, period ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS down FROM g),
  ed AS (SELECT scenario, period, sum(ln(1 + ret)) - sum(ln(1 + bench)) AS edge, min(down) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate
      FROM dd GROUP BY ALL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B._conditional(spark, sf_dir, (20, 40), (5, 15)).select("scenario", "dt", "ret")
    pairs = relational.next_day_pairs(panels.bars(spark, sf_dir)).where(F.col("dt").between(F.lit(B.START).cast("date"), F.lit(B.END).cast("date")))
    periods = spark.createDataFrame(_PERIODS, "period string, a string, b string").select("period", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    return compare.edges(rows, pairs.groupBy("dt").agg(F.avg("ret").alias("ret")), periods)


@query(f"{_EDGES} SELECT scenario, period, round(edge, 6) AS edge, round(max_drawdown, 6) AS max_drawdown, round(hit_rate, 6) AS hit_rate FROM ed")
def strategy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth over the mean of all assets, by scenario and period, the benchmark as a baseline."""
    return rounded(_edges(spark, sf_dir), "edge", "max_drawdown", "hit_rate")


@query(f"""{_EDGES} SELECT scenario, count(*) AS periods, round(avg(CASE WHEN edge > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive, bool_and(edge > 0) AS always,
    round(avg(edge), 6) AS mean_edge,
  round(avg(edge) / nullif(abs(min(max_drawdown)), 0), 6) AS edge_over_drawdown FROM ed GROUP BY scenario""")
def strategy_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.consistency(_edges(spark, sf_dir)), "positive", "mean_edge", "edge_over_drawdown")


@query(f"""{_EDGES} SELECT count(*) FILTER (edge > 0) AS winners, count(*) AS total, round(avg(edge), 6) AS mean_excess, round(avg(max_drawdown), 6) AS mean_drawdown,
    round(avg(hit_rate), 6) AS mean_hit_rate,
  round(count(*) FILTER (edge > 0) / count(*), 6) AS positive_folds FROM ed""")
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all scenarios and periods: how many win, and the means."""
    won = F.col("edge") > 0
    found = _edges(spark, sf_dir).agg(F.count_if(won).alias("winners"), F.count("*").alias("total"), F.avg("edge").alias("mean_excess"), F.avg("max_drawdown").alias("mean_drawdown"), F.avg("hit_rate").alias("mean_hit_rate"), F.avg(won.cast("double")).alias("positive_folds"))
    return rounded(found, "mean_excess", "mean_drawdown", "mean_hit_rate", "positive_folds")


@query()
def full_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebalancing by ranks, by interval signals and by volatility, and holding the first choice, over the same days."""
    bars, assets = written(panels.bars(spark, sf_dir), "bars"), panels.assets(spark, sf_dir)
    checks = backtest.check_dates(B._grid(spark, (40,), (20,)), B.START, B.END)
    standard = backtest.conditional_holdings(checks, backtest.rankings(bars, assets, checks)).withColumn("scenario", F.lit("standard"))
    held = written(standard.unionByName(B.ci_holdings(spark, sf_dir)).unionByName(B.volatility_holdings(spark, sf_dir)), "held")
    returns = backtest.daily_returns(held, bars, B.START, B.END)
    hold = backtest.buy_and_hold(bars, assets, B.START, B.END).select("scenario", "dt", "ret")
    found = compare.performance(returns.unionByName(hold)).join(compare.trades(held), "scenario", "left")
    return rounded(found.withColumn("trades", F.coalesce("trades", F.lit(0))), "log_total", "volatility", "sharpe", "max_drawdown", digits=4)


@query(f"""WITH {BARS}, {ASSETS},
  l AS (SELECT asset, max(dt) AS last FROM bars JOIN assets USING (asset) WHERE dt <= DATE '1999-06-06' - CAST(ord % 4 AS INTEGER) GROUP BY asset),
  b AS (SELECT asset, epoch(TIMESTAMP '1999-06-07 09:00:00' - CAST(last AS TIMESTAMP)) / 3600 AS hours, CASE isodow(last) WHEN 6 THEN 76 WHEN 5 THEN 100 ELSE 72 END AS bound FROM l),
  s AS (SELECT asset, CASE WHEN hours <= bound THEN 'active' ELSE 'inactive: ' || CAST(hours AS BIGINT) || ' h since its last bar, ' || bound || ' allowed' END AS status FROM b)
  SELECT status, count(*) AS assets, string_agg(asset, ',' ORDER BY asset) AS names FROM s GROUP BY status""")
def activity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe as of a Monday morning by the hours since each asset's last bar, with the reason."""
    now = F.lit("1999-06-07 09:00:00").cast("timestamp_ntz")
    bars = panels.bars(spark, sf_dir).join(panels.assets(spark, sf_dir).select("asset", "ord"), "asset")
    seen = bars.where("dt <= date_sub(date '1999-06-06', cast(ord % 4 as int))").groupBy("asset").agg(F.max("dt").cast("timestamp_ntz").alias("last"))
    return scores.split_by_reason(seen.select("asset", rules.activity_reason(F.col("last"), now).alias("status")))


# Quality over the whole universe, and single assets.


@query(f"""WITH {RETS}, {METRICS}, {ASSETS},
  q AS (SELECT m.asset, a.kind AS sector, ord, round(0.40 * conviction + 0.35 * hit_rate + 0.15 * stability, 6) AS quality FROM m JOIN assets a USING (asset)
      WHERE rn = n)
  SELECT asset, sector, quality, CAST(row_number() OVER (ORDER BY quality DESC, ord) AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY sector
      ORDER BY quality DESC, ord) AS INTEGER) AS sector_rank FROM q""")
def quality_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assets by quality, over the universe and within their sectors."""
    rows = metrics.behaviour(panels.bars(spark, sf_dir)).withColumn("_k", S.from_end()).where("_k = 1")
    assets = panels.assets(spark, sf_dir).select("asset", "ord", F.col("kind").alias("sector"))
    found = rows.select("asset", F.round(metrics.quality_score(), 6).alias("quality")).join(assets, "asset")
    whole, own = Window.orderBy(F.desc("quality"), "ord"), Window.partitionBy("sector").orderBy(F.desc("quality"), "ord")
    return found.select("asset", "sector", "quality", F.row_number().over(whole).alias("rank"), F.row_number().over(own).alias("sector_rank"))  # a row per asset


@query(f"""WITH {RETS}, {_UNIVERSE}, c AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY round(score, 9) DESC, asset) AS place FROM u)
  SELECT band, CAST(place AS INTEGER) AS place, asset, round(score, 6) AS score FROM c WHERE place <= 3""")
def best_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best assets of each band."""
    order = Window.partitionBy("band").orderBy(F.round("score", 9).desc(), "asset")
    rows = universe(spark, sf_dir).withColumn("place", F.row_number().over(order)).where("place <= 3")
    return rounded(rows.select("band", "place", "asset", "score"), "score")


@query()
def single_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of one asset."""
    bars = written(panels.bars(spark, sf_dir).where("asset = 'Brand#13'"), "bars")
    numbers = ("latest", "volatility", "forecast", "hit_rate", "cvar", "signal", "efficiency", "ytd_return", "one_year_return", "score")
    return rounded(single.analysis(bars), *numbers, digits=4)
