"""Queries on composite scores, portfolios over periods, and documents on holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions import series as S
from tidemark.operators import backtest, explore, metrics, ranking, risk, scores, signals
from tidemark.plans import backtests as B
from tidemark.plans.metrics import METRICS
from tidemark.plans.rolling import registry, rounded
from tidemark.plans.sql import ASSETS, BARS, RETS, last
from tidemark.session import written
from tidemark.sources import panels

QUERIES, ORACLES, query = registry()

_NOW = "WHERE rn = n"


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.behaviour(panels.bars(spark, sf_dir)).withColumn("_k", S.from_end()).where("_k = 1")


@query(f"""WITH {RETS}, {METRICS} SELECT count(*) FILTER (hit_rate >= 0.65) AS strong, count(*) FILTER (hit_rate >= 0.55) AS good,
    count(*) FILTER (hit_rate >= 0.50) AS fair, round(avg(hit_rate), 6) AS mean, round(median(hit_rate), 6) AS median FROM m {_NOW}""")
def hit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("hit_rate")
    found = _now(spark, sf_dir).agg(F.count_if(h >= 0.65).alias("strong"), F.count_if(h >= 0.55).alias("good"), F.count_if(h >= 0.50).alias("fair"), F.avg(h).alias("mean"), F.median(h).alias("median"))
    return rounded(found, "mean", "median")


@query(f"""WITH {RETS}, {METRICS}, {ASSETS}, q AS (SELECT m.asset, ord, round(0.40 * conviction + 0.35 * hit_rate + 0.15 * stability, 6) AS quality FROM m
    JOIN assets USING (asset) WHERE rn = n AND hit_rate >= 0.50)
  SELECT asset, quality, CAST(row_number() OVER (ORDER BY quality DESC, ord) AS INTEGER) AS rank FROM q QUALIFY rank <= 10""")
def quality_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best assets by quality among those that rise often enough."""
    rows = _now(spark, sf_dir).where("hit_rate >= 0.50").select("asset", F.round(metrics.quality_score(), 6).alias("quality"))
    return ranking.ranked(rows, [], panels.assets(spark, sf_dir), "quality").where(F.col("rank") <= 10).select("asset", "quality", "rank")


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset with its class, forecast, hits, tail risk and trend, and the two scores of them."""
    bars = written(panels.bars(spark, sf_dir), "bars")
    vol = risk.volatility(bars)
    band = vol.select("asset", "volatility", risk.volatility_class(F.col("volatility")).alias("band"))
    trend = signals.kalman_hull(bars.join(band.select("asset", "band"), "asset")).select("asset", F.col("signal_strength").alias("signal"), F.col("efficiency_ratio").alias("efficiency"))
    hits = backtest.walk_forward_hits(bars).select("asset", "hit_rate")
    rows = band.join(backtest.forecasts(bars), "asset").join(hits, "asset", "left").join(risk.cvar(bars), "asset", "left").join(trend, "asset", "left")
    rows = rows.withColumn("hit_rate", F.coalesce("hit_rate", F.lit(0.0)))  # also of assets too short for any window
    c = F.col
    return rows.withColumns({"composite": scores.composite(c("cvar"), c("forecast"), c("confidence"), c("signal")), "single": scores.single(c("forecast"), c("hit_rate"), c("signal"), c("cvar"))})


@query()
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analysed(spark, sf_dir).withColumn("words", scores.interpretation(F.col("single")))
    return rounded(rows.select("asset", "composite", "single", "words"), "composite", "single", digits=4)


@query()
def growth_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best assets of a medium or high risk with a score above 35, with how far the forecast can be trusted and a
    score of their momentum."""
    return rounded(scores.growth(analysed(spark, sf_dir)), "single", "momentum", digits=4)


#: Inputs of the scores from every twentieth day of each asset: its return as the forecast in per cent and as tail risk, and
#: numbers of its volume and history that walk through all ladders.
_INPUTS = """g AS (SELECT asset, dt, 100 * ret AS forecast, (CAST(volume AS BIGINT) % 101) / 100.0::DOUBLE AS hit_rate, (CAST(volume AS BIGINT) % 23) / 12.0::DOUBLE - 0.5 AS signal,
    CASE WHEN rn % 3 = 0 THEN NULL ELSE least(0, ret) END AS cvar, (rn % 17) / 16.0::DOUBLE AS confidence FROM rets WHERE rn % 20 = 5)"""


@query(f"""WITH {RETS}, {_INPUTS},
  c AS (
    SELECT *, greatest(0, least(1, 0.4 * CASE WHEN cvar IS NULL THEN 0.5 ELSE greatest(0, least(1, (cvar + 0.1) / 0.1)) END + 0.3 * greatest(0, least(1,
        (forecast + 15) / 30)) * confidence
        + 0.3 * greatest(0, least(1, (signal + 1) / 2)))) AS composite,
      round(greatest(0, least(100, greatest(-40, least(40, forecast / 10 * 40)) + hit_rate * 20 + greatest(0, least(20, signal * 20))
        + CASE WHEN cvar < 0 THEN least(20, -greatest(cvar, -0.5) * 200) ELSE 0 END)), 6) AS single,
      CASE WHEN hit_rate > 0.65 AND confidence > 0.7 THEN 'EXCELLENT' WHEN hit_rate > 0.55 AND confidence > 0.5 THEN 'FAIR'
          WHEN hit_rate < 0.45 OR confidence < 0.15 THEN 'POOR' ELSE 'WARNING' END AS flag,
      CASE WHEN cvar IS NULL THEN 0.5 ELSE greatest(0, least(1, (cvar + 0.30) / 0.30)) END AS tail FROM g)
  SELECT asset, dt, round(composite, 6) AS composite, single, flag, round(tail, 6) AS tail,
    CASE WHEN single >= 80 THEN 'very strong' WHEN single >= 60 THEN 'strong' WHEN single >= 40 THEN 'neutral' WHEN single >= 20 THEN 'weak' ELSE 'very weak' END AS words
        FROM c""")
def score_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores, ladders and flags of inputs that the panel gives."""
    c = F.col
    rows = signals.returns(panels.bars(spark, sf_dir)).withColumn("rn", F.row_number().over(S.by_asset())).where("rn % 20 = 5")
    volume = c("volume").cast("long")
    rows = rows.select(
        "asset", "dt", (100 * c("ret")).alias("forecast"), (volume % 101 / 100).alias("hit_rate"), (volume % 23 / 12 - 0.5).alias("signal"),
        F.when(c("rn") % 3 != 0, F.least(F.lit(0.0), c("ret"))).alias("cvar"), (c("rn") % 17 / 16).alias("confidence"),
    )
    rows = rows.withColumns({
        "composite": scores.composite(c("cvar"), c("forecast"), c("confidence"), c("signal")), "single": F.round(scores.single(c("forecast"), c("hit_rate"), c("signal"), c("cvar")), 6),
        "flag": rules.quality_flag(c("hit_rate"), c("confidence")), "tail": risk.tail_scale(c("cvar")),
    })
    return rounded(rows.select("asset", "dt", "composite", "single", "flag", "tail", scores.interpretation(c("single")).alias("words")), "composite", "tail")


@query(f"""WITH {RETS}, g AS (SELECT asset, dt, CASE WHEN rn % 9 > 0 THEN round(least(abs(ret), 0.4), 6) END AS volatility, CASE WHEN rn % 7 > 0 THEN (CAST(volume AS BIGINT) % 17) / 10.0::DOUBLE END AS beta
    FROM rets WHERE rn % 20 = 5)
  SELECT *, CASE WHEN volatility IS NULL OR beta IS NULL THEN 'UNKNOWN' WHEN volatility < 0.12 AND beta <= 1.2 THEN 'LOW' WHEN volatility < 0.12 THEN 'MEDIUM'
      WHEN volatility <= 0.22 AND beta <= 1.2 THEN 'MEDIUM' WHEN volatility <= 0.22 THEN 'HIGH' WHEN beta < 0.8 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_class,
    CASE WHEN volatility IS NULL THEN 'UNKNOWN' WHEN volatility < 0.15 THEN 'LOW' WHEN volatility < 0.30 THEN 'MEDIUM' ELSE 'HIGH' END AS alone FROM g""")
def risk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of risk classes, and the class by volatility alone, of days' moves and volumes."""
    c = F.col
    rows = signals.returns(panels.bars(spark, sf_dir)).withColumn("rn", F.row_number().over(S.by_asset())).where("rn % 20 = 5")
    vol = F.when(c("rn") % 9 > 0, F.round(F.least(F.abs("ret"), F.lit(0.4)), 6))
    rows = rows.select("asset", "dt", vol.alias("volatility"), F.when(c("rn") % 7 > 0, c("volume").cast("long") % 17 / 10).alias("beta"))
    return rows.select("*", risk.risk_class(c("volatility"), c("beta")).alias("risk_class"), risk.volatility_class(c("volatility")).alias("alone"))


@query(f"""WITH {RETS}, {METRICS}, {ASSETS}, now AS (SELECT m.*, kind FROM m JOIN assets USING (asset) {_NOW})
  SELECT 'hit_rate' AS rule, count(*) FILTER (NOT hit_rate BETWEEN 0.45 AND 1) AS broken, count(hit_rate) AS known FROM now
  UNION ALL SELECT 'stability', count(*) FILTER (NOT (stability > 0 AND stability <= 1)), count(stability) FROM now
  UNION ALL SELECT 'price', count(*) FILTER (NOT close > 0), count(close) FROM now
  UNION ALL SELECT 'kind', count(*) FILTER (kind NOT IN ('Equity', 'Bond')), count(kind) FROM now""")
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many assets break a rule on a range or a list of values."""
    c = F.col
    rows = _now(spark, sf_dir).join(panels.assets(spark, sf_dir).select("asset", "kind"), "asset")
    ranges = {"hit_rate": c("hit_rate").between(0.45, 1), "stability": (c("stability") > 0) & (c("stability") <= 1), "price": c("close") > 0}
    return scores.violations(rows, ranges | {"kind": c("kind").isin("Equity", "Bond")})


@query(f"""WITH {BARS}, st AS (SELECT asset, CASE WHEN count(*) < 1600 THEN 'short' WHEN DATE '2001-11-01' - max(dt) > 0 THEN 'stale' ELSE 'ok' END AS status FROM bars
    GROUP BY asset)
  SELECT status, count(*) AS assets, string_agg(asset, ',' ORDER BY asset) AS names FROM st GROUP BY status""")
def universe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.split_by_reason(explore.status(panels.bars(spark, sf_dir), F.lit("2001-11-01").cast("date"), 1600, 0))


@query(f"""WITH {RETS}, l AS (SELECT max(dt) AS d FROM rets), g AS (SELECT asset, avg(ret) AS mean FROM rets, l WHERE ret IS NOT NULL AND dt > d - 90 GROUP BY asset)
  SELECT asset, round(mean, 6) AS mean, CAST(row_number() OVER (ORDER BY mean DESC, asset) AS INTEGER) AS rank FROM g QUALIFY rank <= 3""")
def top_performers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best mean returns over the panel's last ninety days."""
    rows = signals.returns(panels.bars(spark, sf_dir))
    recent = rows.join(F.broadcast(rows.agg(F.date_sub(F.max("dt"), 90).alias("d"))), F.col("dt") > F.col("d"))  # one row
    means = recent.where("ret is not null").groupBy("asset").agg(F.avg("ret").alias("mean"))
    return rounded(means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "asset"))).where(F.col("rank") <= 3), "mean")  # a row per asset


@query(f"""WITH {BARS}, e AS (SELECT asset, min(dt) AS a, max(dt) AS b FROM bars GROUP BY asset)
  SELECT asset, 'month' AS kind, CAST(last_day(CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)) AS DATE) AS dt FROM e
  UNION ALL SELECT asset, 'check', CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 40 DAY)) AS DATE) FROM e""")
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month ends, and check dates every forty calendar days, over each asset's life."""
    ends = panels.bars(spark, sf_dir).groupBy("asset").agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    a, b = F.col("a"), F.col("b")
    kinds = F.array(F.struct(F.lit("month").alias("kind"), backtest.months_between(a, b).alias("days")), F.struct(F.lit("check").alias("kind"), backtest.days_between(a, b, F.lit(40)).alias("days")))
    return ends.select("asset", F.inline(kinds)).select("asset", "kind", F.explode("days").alias("dt"))


_COND = B._conditional_sql("SELECT '40/10' AS scenario, 40 AS every, 10 AS buffer")


@query(f"{_COND} SELECT CAST(year(dt) AS INTEGER) AS year, round(ln(arg_max(growth, dt) / arg_min(growth, dt)), 6) AS log_change FROM eq GROUP BY year(dt)")
def equity_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B._conditional(spark, sf_dir, (40,), (10,))
    return rounded(metrics.yearly(rows, "scenario", "value").select("year", F.log(1 + F.col("change")).alias("log_change")), "log_change")


@query(f"""{_COND}, ch AS (SELECT d, state, lag(state) OVER (ORDER BY i) AS before FROM held), t AS (SELECT d, lag(d) OVER (ORDER BY d) AS previous FROM ch
    WHERE before IS NULL OR list_sort(state) <> list_sort(before))
  SELECT count(*) AS trades, round(avg(d - previous), 6) AS mean_gap FROM t""")
def trade_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the holdings change as a set, and the mean number of days between changes."""
    checks = backtest.check_dates(B._grid(spark, (40,), (10,)), B.START, B.END)
    held = backtest.conditional_holdings(checks, backtest.rankings(panels.bars(spark, sf_dir), panels.assets(spark, sf_dir), checks))
    order = Window.partitionBy("scenario").orderBy("dt")
    now, before = F.array_sort("holdings"), F.array_sort(F.lag("holdings").over(order))
    trades = held.withColumn("_b", before).where(F.col("_b").isNull() | (now != F.col("_b"))).withColumn("gap", F.datediff("dt", F.lag("dt").over(order)))
    return rounded(trades.agg(F.count("*").alias("trades"), F.avg("gap").alias("mean_gap")), "mean_gap")


_PERIODS = (("calm", "1996-01-02", "1997-06-30"), ("stress", "1997-07-01", "1998-12-31"), ("recovery", "1999-01-01", "2000-12-31"))


@query(f"""{_COND}, pd(period, a, b) AS (VALUES {", ".join(f"('{p}', DATE '{a}', DATE '{b}')" for p, a, b in _PERIODS)}),
  g AS (SELECT period, dt, ret, product(1 + ret) OVER w AS growth FROM eq JOIN pd ON dt BETWEEN a AND b WINDOW w AS (PARTITION BY period
      ORDER BY dt ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT *, growth / max(growth) OVER (PARTITION BY period ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS down FROM g)
  SELECT period, round(ln(arg_max(growth, dt)), 6) AS log_total, round(min(down), 6) AS max_drawdown, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END),
      6) AS hit_rate FROM d GROUP BY period""")
def period_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy over separate periods, out of sample and under stress."""
    rows = B._conditional(spark, sf_dir, (40,), (10,))
    periods = F.array(*(F.struct(F.lit(p).alias("period"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for p, a, b in _PERIODS))
    inside = rows.withColumn("p", F.explode(periods)).where("dt between p.a and p.b").select("p.period", "dt", "ret")
    found = metrics.performance(inside, "period")
    return rounded(found.select("period", F.log(1 + F.col("total")).alias("log_total"), "max_drawdown", "hit_rate"), "log_total", "max_drawdown", "hit_rate")


FUNDS = """fl AS (
    SELECT l_suppkey, l_partkey, p_type, CAST(l_shipdate AS DATE) AS dt, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
      CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 ELSE 5 END AS k,
      'P' || l_partkey || ['.AX', '-US', '.L', '-JKT', '', '.DE'][l_partkey % 6 + 1] AS symbol
    FROM lineitem JOIN part ON l_partkey = p_partkey),
  fh AS (
    SELECT l_suppkey AS fund, symbol, p_type AS sector, l_partkey, CASE WHEN l_suppkey % 4 = 3 THEN k // 2 WHEN k < 4 THEN l_suppkey % 4
        WHEN k = 4 THEN (l_suppkey + 1) % 3 ELSE (l_suppkey + 2) % 3 END AS position,
      cents FROM fl),
  fd AS (
    SELECT s_suppkey AS fund, s_name || [' Gold Trust', ' Bitcoin Fund', ' Income', ' Oil and Metal'][CAST(s_suppkey // 4 % 4 AS INTEGER) + 1] AS name, ['LOW', 'MEDIUM',
        'HIGH'][s_suppkey % 3 + 1] AS risk
    FROM supplier),
  ft AS (
    SELECT fund, sum(cents) AS cents, sum(cents) FILTER (position = 0) / sum(cents) AS stock, sum(cents) FILTER (position = 1) / sum(cents) AS bond,
        sum(cents) FILTER (position = 2) / sum(cents) AS other,
      count(DISTINCT l_partkey) AS holdings FROM fh GROUP BY fund),
  fc AS (
    SELECT *, CASE WHEN stock > 0.5 THEN 'Equity' WHEN bond > 0.5 THEN 'Bond'
      WHEN other > 0.5 THEN CASE WHEN contains(lower(name), 'bitcoin') THEN 'Crypto' WHEN contains(lower(name), 'gold') OR contains(lower(name),
          'oil') OR contains(lower(name), 'metal') THEN 'Commodity' ELSE 'Other' END
      ELSE 'Mixed' END AS class FROM ft JOIN fd USING (fund)),
  fr AS (
    SELECT fund, CASE WHEN contains(symbol, '-JKT') THEN 'Indonesia' WHEN contains(symbol, '.AX') THEN 'Australia' WHEN contains(symbol, '.L') THEN 'United Kingdom'
        WHEN contains(symbol, '.DE') THEN 'Germany'
      ELSE 'United States' END AS region, sum(cents) AS weight FROM fh GROUP BY ALL),
  fs AS (SELECT fund, sector, sum(cents) AS weight FROM fh GROUP BY ALL),
  br AS (SELECT fund, region, weight FROM fr QUALIFY row_number() OVER (PARTITION BY fund ORDER BY weight DESC, region DESC) = 1),
  bs AS (SELECT fund, sector, weight FROM fs QUALIFY row_number() OVER (PARTITION BY fund ORDER BY weight DESC, sector DESC) = 1)"""


def _holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What funds (the suppliers) hold, a row per line: fund, symbol, sector, position (0 stock, 1 bond, 2 other), cents."""
    lines = panels.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_shipdate").cast("date").alias("dt"))
    parts = panels.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = lines.join(parts, "l_partkey").withColumn("k", F.array_position(F.array(*map(F.lit, ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))), F.col("p_type")) - 1)
    suffix = F.element_at(F.array(*map(F.lit, (".AX", "-US", ".L", "-JKT", "", ".DE"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    fund = F.col("l_suppkey")
    position = F.when(fund % 4 == 3, F.floor(F.col("k") / 2)).when(F.col("k") < 4, fund % 4).when(F.col("k") == 4, (fund + 1) % 3).otherwise((fund + 2) % 3)
    return rows.select(fund.alias("fund"), F.concat(F.lit("P"), F.col("l_partkey").cast("string"), suffix).alias("symbol"), F.col("p_type").alias("sector"), "l_partkey", "dt", position.cast("int").alias("position"), "cents")


def _funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fund, name, risk) of each fund."""
    key = F.col("s_suppkey")
    words = F.element_at(F.array(*map(F.lit, (" Gold Trust", " Bitcoin Fund", " Income", " Oil and Metal"))), (F.floor(key / 4) % 4 + 1).cast("int"))
    return panels.table(spark, sf_dir, "supplier").select(key.alias("fund"), F.concat("s_name", words).alias("name"), F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH"))), (key % 3 + 1).cast("int")).alias("risk"))


def _classes(spark: SparkSession, sf_dir: str, holdings: DataFrame) -> DataFrame:
    share = lambda p: F.sum(F.when(F.col("position") == p, F.col("cents"))) / F.sum("cents")
    found = holdings.groupBy("fund").agg(F.sum("cents").alias("cents"), share(0).alias("stock"), share(1).alias("bond"), share(2).alias("other"), F.count_distinct("l_partkey").alias("holdings"), F.count_distinct("dt").alias("days"))
    return found.join(_funds(spark, sf_dir), "fund").withColumn("class", scores.asset_class(F.col("stock"), F.col("bond"), F.col("other"), F.col("name")))


@query(f"WITH {FUNDS} SELECT fund, region, round(br.weight / cents, 6) AS weight FROM br JOIN ft USING (fund)")
def holdings_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region where most of each fund's holdings are listed, and its share."""
    rows = _holdings(spark, sf_dir)
    return rounded(scores.shares(scores.primary(rows, "fund", rules.region_of(F.col("symbol")), "cents", "region"), rows, "fund", "cents"), "weight")


@query(f"WITH {FUNDS} SELECT fund, sector, round(bs.weight / cents, 6) AS weight FROM bs JOIN ft USING (fund)")
def holdings_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sector of most of each fund's holdings, and its share."""
    rows = _holdings(spark, sf_dir)
    return rounded(scores.shares(scores.primary(rows, "fund", F.col("sector"), "cents", "sector"), rows, "fund", "cents"), "weight")


@query(f"WITH {FUNDS} SELECT fund, class FROM fc")
def holdings_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fund mostly is, by its positions and its name."""
    return _classes(spark, sf_dir, _holdings(spark, sf_dir)).select("fund", "class")


@query(f"""WITH {FUNDS}, days AS (SELECT l_suppkey AS fund, count(DISTINCT dt) AS days FROM fl GROUP BY l_suppkey)
  SELECT fund, name, risk, class, sector, round(bs.weight / cents, 6) AS sector_weight, region, round(br.weight / cents, 6) AS region_weight, holdings, CASE
      WHEN holdings > 20 THEN 'RICH' ELSE 'BASIC' END AS quality
  FROM fc JOIN days USING (fund) JOIN bs USING (fund) JOIN br USING (fund) WHERE risk <> 'LOW' AND days >= 30""")
def holdings_filtration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funds with enough prices and a risk above LOW, by what they hold."""
    rows = written(_holdings(spark, sf_dir), "holdings")
    found = _classes(spark, sf_dir, rows).where("risk <> 'LOW' and days >= 30")
    for group, out in ((F.col("sector"), "sector"), (rules.region_of(F.col("symbol")), "region")):
        best = scores.shares(scores.primary(rows, "fund", group, "cents", out), rows, "fund", "cents")
        found = found.join(best.withColumnRenamed("weight", f"{out}_weight"), "fund")
    quality = F.when(F.col("holdings") > 20, "RICH").otherwise("BASIC")
    return rounded(found.select("fund", "name", "risk", "class", "sector", "sector_weight", "region", "region_weight", "holdings", quality.alias("quality")), "sector_weight", "region_weight")


@query(f"""WITH {FUNDS}, days AS (SELECT l_suppkey AS fund, count(DISTINCT dt) AS days FROM fl GROUP BY l_suppkey)
  SELECT count(*) AS funds, count(*) FILTER (days >= 30 AND risk <> 'LOW') AS kept, count(*) FILTER (coalesce(days, 0) < 30) AS without_data, count(*) FILTER (days >= 30
      AND risk = 'LOW') AS excluded,
    round(count(*) FILTER (days >= 30 AND risk <> 'LOW') / count(*) * 100, 6) AS rate FROM fd LEFT JOIN days USING (fund)""")
def filtration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many funds the filtration keeps and why others go."""
    days = _holdings(spark, sf_dir).groupBy("fund").agg(F.count_distinct("dt").alias("days"))
    rows = _funds(spark, sf_dir).join(days, "fund", "left")
    enough, low = F.coalesce(F.col("days") >= 30, F.lit(False)), F.col("risk") == "LOW"
    found = rows.agg(F.count("*").alias("funds"), F.count_if(enough & ~low).alias("kept"), F.count_if(~enough).alias("without_data"), F.count_if(enough & low).alias("excluded"))
    return rounded(found.withColumn("rate", F.col("kept") / F.col("funds") * 100), "rate")


@query(f"""WITH {RETS}, {METRICS}, {ASSETS}, at AS (SELECT m.asset, ord, rn, n, (0.35 * hit_rate + 0.40 * (1 / (1 + exp(-conviction))) + 0.25 * stability) * 10 AS score
    FROM m JOIN assets USING (asset)),
  a AS (SELECT asset, score, row_number() OVER (ORDER BY score DESC, ord) AS r FROM at WHERE rn = n), b AS (SELECT asset, score, row_number() OVER (ORDER BY score DESC,
      ord) AS r FROM at WHERE rn = n - 40)
  SELECT count(*) FILTER (a.r > 3) AS fallen, round((SELECT avg(score) FROM a WHERE r <= 3) / (SELECT avg(score) FROM b WHERE r <= 3) - 1, 6) AS gain,
    count(*) FILTER (a.r > 3) > 0 OR (SELECT avg(score) FROM a WHERE r <= 3) / (SELECT avg(score) FROM b WHERE r <= 3) - 1 > 0.03 AS rebalance FROM b JOIN a USING (asset)
        WHERE b.r <= 3""".replace("at AS (", "sc AS (").replace("FROM at ", "FROM sc "))
def rebalance_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the three best of forty rows ago have fallen behind, or today's are better by more than three per cent."""
    rows = metrics.behaviour(panels.bars(spark, sf_dir)).withColumn("_k", S.from_end()).where("_k in (1, 41)").withColumn("score", metrics.backtest_score())
    placed = ranking.ranked(rows.select("asset", "_k", "score"), ["_k"], panels.assets(spark, sf_dir))
    now, then = (placed.where(F.col("_k") == k).select("asset", F.col("score").alias(s), F.col("rank").alias(r)) for k, s, r in ((1, "s1", "r1"), (41, "s2", "r2")))
    both = now.join(then, "asset", "full")
    gain = F.avg(F.when(F.col("r1") <= 3, F.col("s1"))) / F.avg(F.when(F.col("r2") <= 3, F.col("s2"))) - 1
    found = both.agg(F.count_if((F.col("r2") <= 3) & (F.col("r1") > 3)).alias("fallen"), gain.alias("gain"))
    return rounded(found.withColumn("rebalance", (F.col("fallen") > 0) | (F.col("gain") > 0.03)), "gain")
