"""Queries on overlays, regimes, the universe, nested fields and scalar rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions import series as S
from tidemark.operators import backtest, explore, metrics, overlays, ranking, regimes, risk, signals
from tidemark.plans.metrics import METRICS
from tidemark.plans.rolling import registry, rounded
from tidemark.plans.sql import ASSETS, BARS, RETS, SERIES, last
from tidemark.session import written
from tidemark.sources import panels

QUERIES, ORACLES, query = registry()

#: Which of the six series that the tables can play stands for which role.
ROLES = {
    "high_yield": "equity", "long_bonds": "bonds", "dollar": "aud_usd", "ten_year": "us_10y", "two_year": "bonds", "market": "equity", "prices": "gold", "policy_rate": "us_10y",
    "financials": "vix", "industrials": "gold", "consumer": "aud_usd", "energy": "us_10y", "technology": "equity", "health": "bonds", "utilities": "us_10y", "staples": "gold",
    "chip_maker": "gold", "chip_rival": "vix", "chip_rival_2": "bonds", "island": "aud_usd", "peer": "gold", "peer_2": "bonds", "defence": "us_10y", "defence_2": "gold", "defence_3": "vix",
    "fear": "vix", "gold": "gold", "oil": "us_10y", "sea_oil": "bonds", "gas": "vix", "retail": "bonds", "rival_market": "aud_usd", "currency": "aud_usd", "continent": "bonds",
}


def _features_sql() -> str:
    columns = []
    for n in sorted(set(ROLES.values())):
        at = lambda p, n=n: f"max(value) FILTER (name = '{n}' AND k = {p})"
        own = lambda w, n=n: f"FILTER (name = '{n}' AND k <= {w})"
        columns += [f"{at(p)} AS {n}_at{p}" for p in overlays.PLACES]
        columns += [f"coalesce(({at(1)} / {at(c + 1)} - 1) * 100, 0) AS {n}_pc{c}" for c in overlays.CHANGES]
        columns += [f"CASE WHEN count(value) {own(w)} = {w} THEN avg(value) {own(w)} END AS {n}_ma{w}" for w in overlays.MEANS]
        columns += [f"CASE WHEN count(r) {own(w)} = {w} THEN stddev_samp(r) {own(w)} END * sqrt(252) * 100 AS {n}_vol{w}" for w in overlays.WINDOWS]
        columns += [f"CASE WHEN count(value) {own(252)} = 252 THEN max(value) {own(252)} END AS {n}_top", f"count(*) FILTER (name = '{n}') AS {n}_n"]
    return f"""{SERIES}, ks AS (SELECT *, value / lag(value) OVER (PARTITION BY name ORDER BY dt) - 1 AS r, row_number() OVER (PARTITION BY name ORDER BY dt DESC) AS k
        FROM series),
      f AS (SELECT {", ".join(columns)} FROM ks)"""


def _n(x: str, c: float, s: float) -> str:
    return f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {c} + ({x}) / {s}::DOUBLE * 50))"


class _Named(dict):
    """Replaces role.feature in a formula by its column."""

    def fill(self, text: str) -> str:
        return re.sub(r"\b([a-z_0-9]+)\.(at\d+|pc\d+|ma\d+|vol\d+|top|n)\b", lambda m: f"{ROLES[m[1]]}_{m[2]}", text)


_fill = _Named().fill
_excess = lambda r: f"coalesce(({r}.vol30 / CASE WHEN {r}.vol252 > 0 THEN {r}.vol252 END - 1) * 100, 0)"
_SECTOR_LIST = ", ".join(f"{{'v': -{s}.pc20, 'i': {i}, 's': '{s}'}}" for i, s in enumerate(overlays.SECTORS))
_MACRO = _fill(f"""
  so AS (SELECT *, list_sort([{_SECTOR_LIST}]) AS o, (ten_year.at1 - two_year.at1) * 100 AS points, ten_year.at1 - (prices.at1 / prices.at12 - 1) * 100 AS rate,
      (prices.at1 / prices.at12 - 1) * 100 AS infl,
    ten_year.at60 - (prices.at60 / prices.at72 - 1) * 100 AS rate_before, long_bonds.pc30 - high_yield.pc30 AS gap, long_bonds.pc60 - high_yield.pc60 AS gap_before,
        policy_rate.at1 - policy_rate.at3 AS ps, policy_rate.at1 - policy_rate.at6 AS pl FROM f),
  sl AS (SELECT *, [o[1].s, o[2].s, o[3].s] AS lead, -(o[1].v + o[2].v + o[3].v) / 3 + (o[6].v + o[7].v + o[8].v) / 3 AS breadth FROM so),
  b AS (SELECT 0.40 * (0.70 * {_n("gap", 50, 5)} + 0.30 * {_n("coalesce((gap / nullif(gap_before, 0) - 1) * 100, 0)", 50, 50)}) + 0.35 * (0.75 * {_n("0.60 * dollar.pc20 + 0.40 * dollar.pc60", 50, 3)} + 12.5)
      + 0.25 * CASE WHEN ten_year.n < 30 OR two_year.n < 30 THEN 50 ELSE 0.70 * CASE WHEN points > 100 THEN 25 + least(75, (points - 100) / 2)
          WHEN points > 0 THEN 25 + points / 100 * 25 ELSE greatest(0, 25 + points / 2) END
        + 0.30 * {_n("points - (ten_year.at30 - two_year.at30) * 100", 50, 25)} END AS systematic,
    0.45 * {_n("industrials.pc60 - market.pc60", 50, 5)} + 0.35 * {_n("(industrials.pc60 + consumer.pc60 + financials.pc60) / 3 - (utilities.pc60 + health.pc60 + staples.pc60) / 3", 50, 5)}
      + 0.20 * (0.75 * CASE WHEN list_has_any(lead, ['financials', 'industrials']) THEN 75 WHEN list_has_any(lead, ['technology', 'consumer']) THEN 60
          WHEN list_has_any(lead, ['energy']) THEN 50 ELSE 25 END + 0.25 * {_n("breadth", 0, 10)}) AS growth,
    0.45 * CASE WHEN prices.n < 12 THEN 50 ELSE 0.70 * CASE WHEN rate < -1 THEN greatest(0, 50 - (rate + 1) / 2 * 50) WHEN rate < 2 THEN 50 - rate / 2 * 25
        ELSE greatest(0, 25 - (rate - 2) / 3 * 25) END
        + 0.30 * {_n("-CASE WHEN prices.n > 72 THEN rate - rate_before ELSE 0 END", 50, 0.5)} END
      + 0.30 * CASE WHEN prices.n < 12 THEN 50 ELSE 0.70 * CASE WHEN infl < 0 THEN 85 WHEN infl < 2 THEN 75 WHEN infl < 4 THEN 50 WHEN infl < 6 THEN 30 ELSE 15 END
        + 0.30 * {_n("-((prices.at1 / prices.at3 - 1) * 400 - (prices.at3 / prices.at6 - 1) * 400)", 50, 2)} END
      + 0.25 * CASE WHEN policy_rate.n < 6 THEN 50 ELSE greatest(0, least(100, CASE WHEN ps < -0.25 THEN 75 WHEN ps > 0.25 THEN 25 WHEN policy_rate.at1 < 2 THEN 65
          WHEN policy_rate.at1 > 4 THEN 35 ELSE 50 END
        - (CASE WHEN policy_rate.n > 6 THEN pl ELSE 0 END - CASE WHEN policy_rate.n > 3 THEN ps ELSE 0 END) * 10)) END AS policy FROM sl),
  r AS (SELECT *, CASE WHEN systematic > 60 OR growth < 30 OR (systematic > 50 AND growth < 40) THEN 'CRISIS' WHEN systematic < 40 AND growth > 60
      AND policy > 55 THEN 'GOLDILOCKS' ELSE 'TRANSITIONAL' END AS regime FROM b),
  rs AS (SELECT *, CASE regime WHEN 'CRISIS' THEN greatest(0, 30 - growth / 3) WHEN 'GOLDILOCKS' THEN least(100, 70 + (growth - 60) / 2) ELSE 50 END AS regime_score
      FROM r),
  mac AS (SELECT *, CASE regime WHEN 'CRISIS' THEN 0.45 * systematic + 0.25 * growth + 0.20 * policy + 0.10 * regime_score
      WHEN 'GOLDILOCKS' THEN 0.20 * systematic + 0.40 * growth + 0.25 * policy + 0.15 * regime_score
    ELSE 0.35 * systematic + 0.30 * growth + 0.25 * policy + 0.10 * regime_score END AS composite FROM rs)""")
_GEO = _fill(f"""
  p AS (SELECT 0.40 * {_n("(chip_rival.pc30 + chip_rival_2.pc30) / 2 - chip_maker.pc30", 50, 8)} + 0.30 * (0.60 * {_n("(peer.pc30 + peer_2.pc30) / 2 - island.pc30", 0, 5)} + 0.40 * {_n(_excess("island"), 0, 50)})
      + 0.30 * {_n("(defence.pc30 + defence_2.pc30 + defence_3.pc30) / 3 - market.pc30", 50, 5)} AS tension,
    0.30 * (0.60 * CASE WHEN fear.at1 < 16 THEN fear.at1 / 16 * 30 WHEN fear.at1 < 20 THEN 30 + (fear.at1 - 16) / 4 * 20
        WHEN fear.at1 < 30 THEN 50 + (fear.at1 - 20) / 10 * 30 ELSE least(100, 80 + (fear.at1 - 30) / 10 * 20) END
        + 0.40 * least(100, greatest(0, coalesce((fear.at1 / CASE WHEN fear.ma20 > 0 THEN fear.ma20 END - 1) * 100, 0) * 2)))
      + 0.40 * (0.60 * {_n("gold.pc30 - market.pc30", 50, 5)} + 0.40 * {_n("long_bonds.pc30", 50, 3)})
      + 0.30 * (0.40 * {_n("coalesce((oil.at1 / CASE WHEN oil.ma50 > 0 THEN oil.ma50 END - 1) * 100, 0)", 50, 15)} + 0.30 * {_n("abs(sea_oil.at1 - oil.at1 - 5)", 0, 10)} + 0.30 * {_n(_excess("gas"), 0, 50)}) AS conflict,
    0.35 * {_n("0.60 * (market.pc30 - (industrials.pc30 + consumer.pc30 + retail.pc30) / 3) + 0.40 * ((health.pc30 + utilities.pc30) / 2 - market.pc30)", 50, 5)} + 0.35 * {_n("market.pc60 - rival_market.pc60", 50, 10)}
      + 0.30 * (0.70 * {_n("(currency.at1 - 7) / 7 * 100", 50, 5)} + 0.30 * {_n("greatest(0, coalesce(currency.vol252 - currency.vol30, 0))", 0, 2)}) AS trade,
    0.40 * CASE WHEN ten_year.at1 - two_year.at1 < 0 THEN least(100, abs(ten_year.at1 - two_year.at1) * 100) ELSE 0 END + 0.35 * least(100,
        coalesce(abs((market.at1 / market.top - 1) * 100 / 20) * 100, 100))
      + 0.25 * {_n("market.pc60 - industrials.pc60", 50, 10)} AS stress,
    0.40 * {_n("market.pc30 - continent.pc30", 50, 5)} + 0.35 * least(100, abs(sea_oil.at1 - oil.at1 - 4) / 8 * 100) + 0.25 * {_n(_excess("energy"), 0, 50)} AS security
        FROM f),
  geo AS (SELECT *, 0.30 * tension + 0.25 * conflict + 0.20 * trade + 0.15 * stress + 0.10 * security AS composite FROM p),
  gl AS (SELECT *, CASE WHEN composite < 20 THEN 'LOW' WHEN composite < 35 THEN 'MODERATE' WHEN composite < 50 THEN 'HIGH' WHEN composite < 65 THEN 'SEVERE'
      ELSE 'EXTREME' END AS level FROM geo)""")


@query(f"""WITH {_features_sql()}, {_MACRO} SELECT round(systematic, 6) AS systematic, round(growth, 6) AS growth, round(policy, 6) AS policy, regime, round(regime_score,
    6) AS regime_score, round(composite, 6) AS composite, round(0.75 + composite / 100 * 0.5, 6) AS multiplier FROM mac""")
def macro_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overlays.macro(panels.series(spark, sf_dir), ROLES), "systematic", "growth", "policy", "regime_score", "composite", "multiplier")


@query(f"""WITH {_features_sql()}, {_GEO} SELECT round(tension, 6) AS tension, round(conflict, 6) AS conflict, round(trade, 6) AS trade, round(stress, 6) AS stress,
    round(security, 6) AS security, round(composite, 6) AS composite, level FROM gl""")
def geo_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overlays.geopolitical(panels.series(spark, sf_dir), ROLES), "tension", "conflict", "trade", "stress", "security", "composite")


@query(f"""WITH {_features_sql()}, {_MACRO}, {_GEO} SELECT round(mac.composite, 6) AS macro, regime, round(gl.composite, 6) AS geo, level,
  CASE WHEN regime = 'CRISIS' AND level IN ('SEVERE', 'EXTREME') THEN 'MAXIMUM DEFENSE' WHEN regime = 'CRISIS' OR level IN ('HIGH', 'SEVERE', 'EXTREME') THEN 'DEFENSIVE'
    WHEN regime = 'GOLDILOCKS' AND level = 'LOW' THEN 'AGGRESSIVE' ELSE 'BALANCED' END AS advice FROM mac, gl""")
def combined_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overlays.combined(panels.series(spark, sf_dir), ROLES), "macro", "geo")


def _regime_sql() -> str:
    pairs = " UNION ALL ".join(
        f"SELECT '{p}' AS pair, x.dt, x.value AS x, y.value AS y FROM series x JOIN series y ON x.dt = y.dt WHERE x.name = '{a}' AND y.name = '{b}'"
        for p, (a, b) in regimes.PAIRS.items()
    )
    picks = ", ".join(f"max(c) FILTER (pair = '{p}') AS {p}" for p in regimes.PAIRS)
    return f"""{SERIES}, pv AS ({pairs}),
      pr AS (
        SELECT pair, dt, x / lag(x) OVER w - 1 AS x, y / lag(y) OVER w - 1 AS y FROM pv WINDOW w AS (PARTITION BY pair ORDER BY dt)
        QUALIFY lag(x) OVER w IS NOT NULL),
      co AS (SELECT dt, pair, CASE WHEN count(*) OVER w >= 16 THEN corr(x, y) OVER w END AS c FROM pr WINDOW w AS {last(21, "pair")}),
      dc AS (
        SELECT dt, count(*) AS pairs, CASE WHEN count(*) = 4 THEN stddev_samp(c) END AS dispersion, sum(abs(c)) AS total, {picks}
        FROM co WHERE c IS NOT NULL GROUP BY dt),
      da AS (
        SELECT *, pairs + CASE WHEN pairs = 4 THEN 1 ELSE 0 END AS known, (total + coalesce(dispersion, 0)) / (pairs + CASE WHEN pairs = 4 THEN 1 ELSE 0 END) AS strength,
          coalesce(dispersion, 0.5) AS spread FROM dc),
      fi AS (SELECT *, row_number() OVER (ORDER BY dt) AS i FROM da QUALIFY i % 5 = 1),
      tl AS (
        SELECT dt, known, strength,
          CASE WHEN known < 3 THEN 'UNKNOWN' WHEN gold_equity < -0.5 AND vix_rates > 0.3 THEN 'CRISIS' WHEN gold_equity > 0.3 AND equity_bonds > 0.5 THEN 'RISK_ON'
            WHEN gold_equity < -0.3 AND equity_bonds < -0.3 THEN 'RISK_OFF' WHEN vix_rates > 0.5 THEN 'STAGFLATION'
            WHEN abs(coalesce(gold_equity, 0)) < 0.2 AND abs(coalesce(equity_bonds, 0)) < 0.2 THEN 'NEUTRAL' ELSE 'TRANSITIONAL' END AS regime,
          CASE WHEN known < 3 THEN 'UNKNOWN' WHEN spread > 0.3 THEN 'HIGH_VOLATILITY' WHEN spread < 0.05 THEN 'STABLE' ELSE 'MODERATE' END AS sub,
          CASE WHEN spread > 0.3 THEN 0.3::DOUBLE WHEN spread < 0.05 THEN 0.9 ELSE 0.6 END AS base
        FROM fi),
      rt AS (
        SELECT dt, regime, sub, CASE WHEN known < 3 THEN 0.0::DOUBLE WHEN strength > 0.6 THEN least(0.95::DOUBLE, base + 0.2)
            WHEN strength < 0.2 THEN greatest(0.1::DOUBLE, base - 0.3)
          ELSE base END AS confidence FROM tl),
      turns AS (SELECT *, coalesce(regime <> lag(regime) OVER (ORDER BY dt), false) AS turned FROM rt),
      stable AS (SELECT count(*) FILTER (turned) / count(*) AS rate FROM turns)"""


@query(f"WITH {_regime_sql()} SELECT dt, regime, sub, round(confidence, 6) AS confidence FROM rt")
def regime_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regimes.timeline(panels.series(spark, sf_dir)), "confidence")


@query(f"""WITH {_regime_sql()}
  SELECT regime, count(*) AS days, round(avg(confidence), 6) AS confidence, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most,
    count(*) FILTER (turned) AS turns, round(count(*) / sum(count(*)) OVER (), 6) AS share, round((SELECT rate FROM stable), 6) AS transition_rate,
    round(1 - (SELECT rate FROM stable), 6) AS stability FROM turns GROUP BY regime""")
def regime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regimes.summary(regimes.timeline(written(panels.series(spark, sf_dir), "series")))
    return rounded(found, "confidence", "least", "most", "share", "transition_rate", "stability")


@query(f"""WITH {_regime_sql()}
  SELECT dt, {", ".join(f"round(coalesce({p}, 0), 6) AS corr_{p}" for p in (*regimes.PAIRS, "dispersion"))}, round(confidence, 6) AS regime_confidence,
    round(1 - (SELECT rate FROM stable), 6) AS regime_stability FROM da JOIN rt USING (dt) WHERE dt = (SELECT max(dt) FROM rt)""")
def regime_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model may know of the regime on the timeline's last day."""
    found = regimes.features(written(panels.series(spark, sf_dir), "series"))
    return rounded(found, *(f"corr_{p}" for p in (*regimes.PAIRS, "dispersion")), "regime_confidence", "regime_stability")


# The universe: a row per asset.

_UNIVERSE = f"""{METRICS}, {ASSETS}, vv AS (SELECT asset, stddev_samp(ret) * sqrt(252) AS volatility FROM rets WHERE n - rn < 252 GROUP BY asset),
  s20 AS (SELECT *, sum(ret) OVER {last(20)} AS s FROM rets),
  u AS (SELECT m.asset, name, a.kind AS band, region, (0.35 * hit_rate + 0.40 * (1 / (1 + exp(-conviction))) + 0.25 * stability) * 10 AS score, volatility, greatest(-0.1,
      least(0.1, s)) * 100 AS forecast, m.close
    FROM m JOIN assets a USING (asset) JOIN vv USING (asset) JOIN s20 ON s20.asset = m.asset AND s20.rn = s20.n WHERE m.rn = m.n)"""


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panels.bars(spark, sf_dir)
    rows = metrics.behaviour(bars).withColumn("k", S.from_end())
    newest = rows.where("k = 1").select("asset", metrics.backtest_score().alias("score"), "close")
    vol = rows.where("k <= 252").groupBy("asset").agg((F.stddev_samp("ret") * F.sqrt(F.lit(S.TRADING_DAYS))).alias("volatility"))
    forecast = backtest.forecasts(bars, least=1).select("asset", "forecast")
    names = panels.assets(spark, sf_dir).select("asset", "name", F.col("kind").alias("band"), "region")
    return newest.join(names, "asset").join(vol, "asset").join(forecast, "asset")


@query(f"""WITH {RETS}, {_UNIVERSE} SELECT asset, name, band, round(score, 6) AS score, round(volatility, 6) AS volatility, round(forecast, 6) AS forecast FROM u
    WHERE band IN ('Equity', 'Bond') AND score BETWEEN 3 AND 9 AND forecast > 5 AND (contains(lower(asset), '1') OR contains(lower(name), '1'))""")
def universe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explore.filter_universe(universe(spark, sf_dir), ["Equity", "Bond"], (3, 9), "1", "strong")
    return rounded(rows.select("asset", "name", "band", "score", "volatility", "forecast"), "score", "volatility", "forecast")


@query(f"WITH {ASSETS} SELECT asset, name FROM assets WHERE regexp_matches(name, '^(red|big|b.ue)', 'i') OR regexp_matches(asset, '^(red|big|b.ue)', 'i')")
def universe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.assets(spark, sf_dir).where(explore.matches("^(red|big|b.ue)", "asset", "name")).select("asset", "name")


@query(f"""WITH {RETS}, {_UNIVERSE} SELECT band, count(*) AS assets, round(avg(score), 6) AS mean_score, round(min(score), 6) AS least, round(max(score), 6) AS most,
    count(*) FILTER (forecast > 0) AS rising, arg_max(asset, score) AS best FROM u GROUP BY ROLLUP (band)""")
def summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.summary(universe(spark, sf_dir)), "mean_score", "least", "most")


@query(f"""WITH {BARS}, {ASSETS}, st AS (SELECT asset, CASE WHEN count(*) < 1600 THEN 'short' WHEN DATE '2001-11-01' - max(dt) > 0 THEN 'stale' ELSE 'ok' END AS status
    FROM bars GROUP BY asset),
  sh AS (SELECT asset, CASE WHEN status = 'ok' AND n_parts % 10 < 5 THEN 'few holdings' ELSE status END AS status FROM st JOIN assets USING (asset))
  SELECT status, region, kind, count(*) AS assets FROM sh JOIN assets USING (asset) GROUP BY GROUPING SETS ((status), (region), (kind))""")
def availability_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explore.status(panels.bars(spark, sf_dir), F.lit("2001-11-01").cast("date"), 1600, 0)
    found = explore.with_holdings(found, panels.assets(spark, sf_dir).select("asset", (F.col("n_parts") % 10).alias("holdings")))
    return explore.availability(found.join(panels.assets(spark, sf_dir).select("asset", "region", "kind"), "asset"))


@query(f"""WITH {SERIES} SELECT name, count(*) AS points, array_to_string(list_filter([CASE WHEN count(*) < 100 THEN 'few points' END, CASE
    WHEN avg(CAST(value IS NULL AS DOUBLE)) > 0.05 THEN 'gaps' END,
  CASE WHEN DATE '2001-11-12' - max(dt) > 7 THEN 'stale' END, CASE WHEN CASE name WHEN 'vix' THEN min(value) < 5 OR max(value) > 100
      WHEN 'aud_usd' THEN min(value) < 0.3 OR max(value) > 2 WHEN 'us_10y' THEN min(value) < 0 OR max(value) > 20
    WHEN 'gold' THEN min(value) < 10 OR max(value) > 500 ELSE false END THEN 'out of range' END], lambda x: x IS NOT NULL), ',') AS issues FROM series GROUP BY name""")
def series_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explore.series_quality(panels.series(spark, sf_dir), F.lit("2001-11-12").cast("date"))
    return found.select("name", "points", F.array_join("issues", ",").alias("issues"))


@query(f"""WITH {SERIES} SELECT name, count(value) AS points, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean,
    round(stddev_samp(value), 6) AS std, round(arg_max(value, dt), 6) AS latest, min(dt) AS first, max(dt) AS last, count(DISTINCT dt) AS days FROM series
    GROUP BY name""")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.series_summary(panels.external_series(spark, sf_dir)), "low", "high", "mean", "std", "latest")


@query(f"""WITH {RETS}, g AS (SELECT asset, sum(ret) AS total FROM rets WHERE n - rn < 60 GROUP BY asset), o AS (SELECT *, row_number() OVER (ORDER BY total DESC,
    asset) AS up, row_number() OVER (ORDER BY total, asset) AS down FROM g)
  SELECT asset, round(total, 6) AS total, CASE WHEN up <= 3 THEN 'top' ELSE 'bottom' END AS side, CAST(CASE WHEN up <= 3 THEN up ELSE down END AS INTEGER) AS place FROM o
      WHERE up <= 3 OR down <= 3""")
def top_bottom_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.returns(panels.bars(spark, sf_dir)).withColumn("k", S.from_end()).where("k <= 60")
    return rounded(explore.ends(rows.groupBy("asset").agg(F.sum("ret").alias("total")), "total"), "total")


@query("""WITH e AS (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), s AS (SELECT user_id, event_type, sum(k) AS weight FROM e
    GROUP BY ALL)
  SELECT user_id, arg_max(event_type, weight * 1000000 + ascii(event_type)) AS event_type, CAST(max(weight) AS BIGINT) AS weight FROM s
      GROUP BY user_id HAVING count(*) FILTER (weight IS NOT NULL) > 0""")
def primary_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's heaviest kind of event, weights from a nested field."""
    rows = panels.table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return explore.primary(rows, "user_id", "event_type", "k")


@query("""SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, CAST(max(CAST(json_extract(props,
    '$.k') AS BIGINT)) AS BIGINT) AS most FROM events GROUP BY event_type""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k long")["k"]
    return panels.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(props).alias("total"), F.max(props).alias("most"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'JEWELLERY' WHEN contains(lower(p_name), 'bolt') OR contains(lower(p_name),
    'gear') THEN 'HARDWARE' ELSE 'OTHER' END AS sector,
  CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 5) || '...' ELSE p_name END AS short, replace(p_brand, '#', '_') AS code FROM part""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = panels.table(spark, sf_dir, "part")
    sector = rules.sector_of(F.col("p_name"), (("ring", "JEWELLERY"), ("bolt", "HARDWARE"), ("gear", "HARDWARE")))
    return parts.select("p_partkey", sector.alias("sector"), rules.shortened(F.col("p_name"), 8).alias("short"), F.replace("p_brand", F.lit("#"), F.lit("_")).alias("code"))


@query('''WITH l AS (SELECT event_type, user_id, max(ts) AS ts FROM events GROUP BY ALL),
    nows AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-29 12:00:00', TIMESTAMP '2024-02-04 12:00:00', INTERVAL 1 DAY)) AS TIMESTAMP) AS now),
    x AS (SELECT event_type, user_id, now, ts, epoch(now - ts) / 3600 AS hours, isodow(now) - 1 AS day, isodow(ts) - 1 AS wd, CAST(now AS DATE) - CAST(ts AS DATE) >= 1 AS earlier FROM l, nows WHERE ts <= now),
    b AS (SELECT *, CASE day WHEN 0 THEN CASE wd WHEN 5 THEN 76 WHEN 4 THEN 100 ELSE 72 END WHEN 6 THEN CASE wd WHEN 5 THEN 76 ELSE 48 END WHEN 5 THEN CASE wd WHEN 4 THEN 72 ELSE 36 END
      WHEN 4 THEN CASE WHEN earlier THEN 52 ELSE 32 END WHEN 3 THEN CASE WHEN earlier THEN 40 ELSE 28 END ELSE CASE WHEN earlier THEN 36 ELSE 24 END END AS bound FROM x)
  SELECT event_type, now, count(*) FILTER (hours <= bound) AS active, count(*) FILTER (hours > bound) AS stale, CAST(max(bound) AS INTEGER) AS bound FROM b GROUP BY event_type, now''')
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users of each kind of event have been seen lately, as of each day of a week."""
    rows = panels.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max("ts").alias("ts"))
    days = F.expr("sequence(timestamp_ntz '2024-01-29 12:00:00', timestamp_ntz '2024-02-04 12:00:00', interval 1 day)")
    rows = rows.withColumn("now", F.explode(days)).where("ts <= now")
    state, bound = rules.activity(F.col("ts"), F.col("now")), rules.activity_bound(F.col("ts"), F.col("now"))
    return rows.groupBy("event_type", "now").agg(F.count_if(state == "active").alias("active"), F.count_if(state == "stale").alias("stale"), F.max(bound).alias("bound"))


@query()
def full_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline: volatility and beta, risk class, forecast, tail risk, trend, and the rank within the class."""
    bars = written(panels.bars(spark, sf_dir), "bars")
    base = risk.volatility(bars).join(risk.best_benchmark(bars, panels.benchmarks(spark, sf_dir)), "asset", "left")
    base = base.withColumn("band", risk.risk_class(F.col("volatility"), F.coalesce("beta", F.lit(1.0))))
    trend = signals.kalman_hull(bars.join(base.select("asset", "band"), "asset")).select("asset", F.col("signal_strength").alias("signal"))
    rows = base.join(risk.cvar(bars), "asset").join(backtest.forecasts(bars), "asset").join(trend, "asset").join(backtest.walk_forward_hits(bars).select("asset", "hit_rate"), "asset")
    rows = written(rows, "analysis")
    factors = rows.unpivot(["asset", "band"], ["cvar", "forecast", "signal", "hit_rate"], "metric", "value")
    ranked = ranking.percentile_ranking(factors)
    found = rows.join(ranked.select("asset", "percentile", "rank"), "asset").select("asset", "band", "volatility", "beta", "cvar", "forecast", "signal", "hit_rate", "percentile", "rank")
    return rounded(found, "volatility", "beta", "cvar", "signal", "percentile", digits=4)
