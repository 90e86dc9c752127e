"""Operators on small panels, against values worked out by hand or by pandas."""

import datetime
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import rules
from tidemark.functions import series as S
from tidemark.operators import backtest, compare, correlations, hot, intervals, metrics, ranking, regimes, relational, risk, signals, single
from tidemark.session import written
from tidemark.sources import panels, sinks


def panel(spark, closes, asset="A", start="2021-01-01"):
    days = pd.date_range(start, periods=len(closes)).date
    rows = [(asset, d, c, c * 1.01, c * 0.99, c, 10.0) for d, c in zip(days, map(float, closes), strict=True)]
    return spark.createDataFrame(rows, "asset string, dt date, open double, high double, low double, close double, volume double")


def last(df):
    return df.orderBy(F.desc("dt")).first()


@pytest.mark.parametrize(("n", "expected"), [(100, 0.0), (101, 1.0)])
def test_hit_rate_needs_a_hundred_returns(spark, n, expected):
    assert last(metrics.behaviour(panel(spark, [100.0 + i for i in range(n)]))).hit_rate == expected


def test_hit_rate_counts_rises(spark):
    closes, price = [100.0], 100.0
    for i in range(100):
        price += 1 if i < 54 else -0.5
        closes.append(price)
    assert last(metrics.behaviour(panel(spark, closes))).hit_rate == pytest.approx(0.54)


def test_constant_prices(spark):
    row = last(metrics.behaviour(panel(spark, [5.0] * 150)))
    assert (row.hit_rate, row.conviction, row.stability) == (0.0, 0.0, 1.0)
    assert last(panel(spark, [5.0] * 30).withColumn("z", S.zscore("close", 20))).z == 0.0


def test_windows_equal_pandas(spark):
    rng = np.random.default_rng(1)
    closes = list(100 + rng.normal(0, 1, 80).cumsum())
    frame = signals.hull(signals.atr(panel(spark, closes).withColumn("sma", S.sma("close", 10)).withColumn("ret", S.simple_return()))).orderBy("dt").toPandas()
    s = pd.Series(closes)
    assert np.allclose(frame["sma"].fillna(-1).astype(float), s.rolling(10).mean().fillna(-1))
    assert np.allclose(frame["ret"].astype(float)[1:], s.pct_change()[1:])

    def wma(x, n):
        w = np.arange(1, n + 1)
        return x.rolling(n).apply(lambda v: (v * w).sum() / w.sum(), raw=True)

    assert np.allclose(frame["hull"].astype(float).fillna(-1), wma(2 * wma(s, 4) - wma(s, 9), 3).fillna(-1))


def test_exponential_means_equal_pandas(spark):
    rng = np.random.default_rng(2)
    s = pd.Series(100 + rng.normal(0, 1, 60).cumsum())
    p = panel(spark, list(s))
    assert signals.exponential(p, 20).first().ema == pytest.approx(s.ewm(span=20, adjust=False).mean().iloc[-1])
    line = s.ewm(span=12).mean() - s.ewm(span=26).mean()
    row = signals.macd(p).first()
    assert (row.line, row.signal) == pytest.approx((line.iloc[-1], line.ewm(span=9).mean().iloc[-1]))


@pytest.mark.parametrize(("value", "lower", "upper", "weight"), [(0.3, 0.4, 0.6, 1.0), (0.8, 0.4, 0.6, 1.0), (0.5, 0.4, 0.6, 0.0), (0.38, 0.4, 0.6, 0.3), (0.33, 0.4, 0.6, 0.7), (0.05, 0.0, 0.0, 0.3)])
def test_distance_weight(spark, value, lower, upper, weight):
    assert spark.range(1).select(rules.distance_weight(F.lit(value), F.lit(lower), F.lit(upper)).alias("w")).first().w == weight


@pytest.mark.parametrize(("weight", "decision"), [(0.3, "HOLD"), (1.0, "WAIT"), (2.0, "ROTATE")])
def test_rotation_decision(spark, weight, decision):
    assert spark.range(1).select(rules.rotation_decision(F.lit(weight)).alias("d")).first().d == decision


def test_as_of_takes_the_newest_on_or_before(spark):
    d = datetime.date
    left = spark.createDataFrame([("a", d(2020, 1, 1), 1), ("a", d(2020, 1, 5), 2), ("b", d(2020, 1, 5), 3)], "asset string, dt date, x int")
    right = spark.createDataFrame([("a", d(2020, 1, 2), "p"), ("a", d(2020, 1, 5), "q")], "asset string, dt date, y string")
    found = {(r.asset, r.x): r.y for r in relational.as_of(left, right, ["asset"]).collect()}
    assert found == {("a", 1): None, ("a", 2): "q", ("b", 3): None}


def test_upsert_replaces_by_key(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_percentiles_with_ties_and_a_single_asset(spark):
    rows = spark.createDataFrame([("a", "X", "m", 1.0), ("b", "X", "m", 1.0), ("c", "X", "m", 3.0), ("d", "Y", "m", 9.0)], "asset string, band string, metric string, value double")
    found = {r.asset: (round(r.percentile, 4), r["rank"]) for r in ranking.percentile_ranking(rows, ()).collect()}
    assert found == {"a": (50.0, 2), "b": (50.0, 3), "c": (100.0, 1), "d": (100.0, 1)}


def test_holdings_keep_survivors_and_fill(spark):
    d = datetime.date
    ranks = spark.createDataFrame([(d(2020, 1, day), 40, a, i + 1, 0.0) for day, order in ((1, "abcde"), (2, "badce"), (3, "edcba")) for i, a in enumerate(order)], "dt date, every int, asset string, rank int, score double")
    scen = spark.createDataFrame([("s", 40, 3, d(2020, 1, day)) for day in (1, 2, 3, 4)], "scenario string, every int, buffer int, dt date")
    found = {r.dt.day: r.holdings for r in backtest.conditional_holdings(scen, ranks).collect()}
    assert found == {1: ["a", "b", "c"], 2: ["a", "b", "d"], 3: ["d", "e", "c"], 4: ["d", "e", "c"]}


def many(spark, lengths, start="2021-01-01", drop=()):
    """A panel of assets a00, a01, ... with histories of some lengths that end on the same day; ``drop`` fall at the end."""
    rng, rows = np.random.default_rng(5), []
    end = pd.Timestamp(start) + pd.Timedelta(days=400)
    for i, n in enumerate(lengths):
        closes = 100 * np.exp(rng.normal(0.001, 0.01, n).cumsum())
        if i in drop:
            closes[-20:] *= np.linspace(0.9, 0.5, 20)
        rows += [(f"a{i:02}", (end - pd.Timedelta(days=n - 1 - k)).date(), float(c), float(c), float(c), float(c), 1.0) for k, c in enumerate(closes)]
    assets = spark.createDataFrame([(f"a{i:02}", i + 1) for i in range(len(lengths))], "asset string, ord int")
    return spark.createDataFrame(rows, "asset string, dt date, open double, high double, low double, close double, volume double"), assets, end.date()


@pytest.mark.parametrize(("every", "ranked"), [(20, 10), (40, 12), (60, 10), (63, 10)])
def test_rankings_need_history_and_momentum(spark, every, ranked):
    """Fourteen assets, two of them fallen; two have 120 rows and the others 260."""
    bars, assets, day = many(spark, [260] * 12 + [120] * 2, drop=(0, 1))
    dates = spark.createDataFrame([(day, every)], "dt date, every int")
    found = ranking.as_of_rankings(bars, assets, dates).orderBy("rank").collect()
    assert len(found) == ranked and not {"a00", "a01"} & {r.asset for r in found} and [r["rank"] for r in found] == list(range(1, ranked + 1))
    assert all(x.score >= y.score for x, y in zip(found, found[1:], strict=False)) and all(r.seen == day for r in found)


def test_no_ranking_of_few_assets_and_fifty_at_most(spark):
    bars, assets, day = many(spark, [220] * 9)
    dates = spark.createDataFrame([(day, 63)], "dt date, every int")
    assert ranking.as_of_rankings(bars, assets, dates).count() == 0
    bars, assets, day = many(spark, [220] * 54)
    found = {r.asset for r in ranking.as_of_rankings(bars, assets, spark.createDataFrame([(day, 63)], "dt date, every int")).collect()}
    fallen = bars.withColumn("r", S.simple_return()).withColumn("k", S.from_end()).where("k <= 63").groupBy("asset").agg(F.sum("r").alias("s")).where("s <= -0.1").count()
    assert fallen or found == {f"a{i:02}" for i in range(50)}


def test_signal_holdings(spark):
    """A holding that left the best three goes only for a candidate that rotates, and only if it doesn't itself."""
    d = datetime.date
    orders = {1: "abcde", 2: "dabce", 3: "dabce", 4: "edabc", 5: "edcba"}
    ranks = spark.createDataFrame([(d(2020, 1, day), a, i + 1) for day, order in orders.items() for i, a in enumerate(order)], "dt date, asset string, rank int")
    rotating = {2: "d", 3: "d", 4: "ec", 5: "e"}
    signals_ = spark.createDataFrame([(d(2020, 1, day), a, "ROTATE" if a in rotating.get(day, "") else "WAIT") for day in orders for a in "abcde"], "dt date, asset string, signal string")
    stressed = spark.createDataFrame([(d(2020, 1, day), day == 2) for day in orders], "dt date, stressed boolean")
    found = {r.dt.day: r.holdings for r in backtest.signal_holdings(ranks, signals_, stressed).collect()}
    assert found == {1: ["a", "b", "c"], 2: ["a", "b", "c"], 3: ["a", "b", "d"], 4: ["a", "e", "d"], 5: ["a", "e", "d"]}


def test_volatility_holdings(spark):
    d = datetime.date
    orders = {1: "abcde", 2: "dabce", 3: "dabce", 4: "edcba"}
    ranks = spark.createDataFrame([(d(2020, 1, day), a, i + 1) for day, order in orders.items() for i, a in enumerate(order)], "dt date, asset string, rank int")
    calm = spark.createDataFrame([(d(2020, 1, day), day != 2) for day in orders], "dt date, calm boolean")
    found = {r.dt.day: r.holdings for r in backtest.volatility_holdings(ranks, calm).collect()}
    assert found == {1: ["a", "b", "c"], 2: ["a", "b", "c"], 3: ["a", "b", "d"], 4: ["e", "c", "d"]}


def test_growth_of_equity_is_the_product(spark):
    rets = spark.createDataFrame([("s", datetime.date(2020, 1, i + 1), r) for i, r in enumerate([0.1, -0.5, 0.2])], "scenario string, dt date, ret double")
    assert last(backtest.equity(rets)).value == pytest.approx(100_000 * 1.1 * 0.5 * 1.2)
    assert metrics.performance(rets, "scenario").first().max_drawdown == pytest.approx(-0.5)


def test_student_t_fit_and_tail():
    rng = np.random.default_rng(3)
    x = rng.standard_t(5, 4000) * 0.01 + 0.001
    nu, mu, scale = risk.fit_t(x)
    assert 4 < nu < 6.5 and abs(mu - 0.001) < 0.001 and abs(scale - 0.01) < 0.001
    assert risk.t_quantile(0.05, 5.0) == pytest.approx(-2.015, abs=2e-3)
    assert risk.tail_loss(x) < 0 and np.isnan(risk.tail_loss(x[:29]))
    assert risk.fit_t(x[:10]) == (2.1, 0.0, 0.02)


def plain_trend(frame, noise, process, factor, days):
    """The trend in plain pandas, a row at a time."""
    close, high, low = frame["close"], frame["high"], frame["low"]
    path = close.diff().abs().iloc[-10:].sum()
    er = min(1.0, abs(close.iloc[-1] - close.iloc[-11]) / path) if path else 0.5
    tr = pd.concat([high - low, (high - close.shift()).abs(), (low - close.shift()).abs()], axis=1).max(axis=1)
    atr = tr.rolling(days, min_periods=1).mean()
    unrest = atr.iloc[-1] / close.iloc[-1]
    r, q = noise * (1 - er) * (1 + unrest), process * (1 + unrest)
    state, p, smooth = close.iloc[0], 100.0, []
    for price in close:
        gain = (p + q) / (p + q + r)
        state, p = state + gain * (price - state), (1 - gain) * (p + q)
        smooth.append(state)

    def wma(x, n):
        w = np.arange(1, n + 1)
        return x.rolling(n).apply(lambda v: (v * w).sum() / w.sum(), raw=True)

    n = max(3, min(round(r), len(close) // 2))
    hull = wma(2 * wma(pd.Series(smooth), max(2, n // 2)) - wma(pd.Series(smooth), n), max(2, round(n**0.5)))
    up, lo, trends = (hull + factor * atr.to_numpy()).tolist(), (hull - factor * atr.to_numpy()).tolist(), []
    prices = close.tolist()
    for i in range(1, len(prices)):
        if prices[i - 1] < lo[i - 1]:
            lo[i] = max(lo[i], lo[i - 1])
        if prices[i - 1] > up[i - 1]:
            up[i] = min(up[i], up[i - 1])
    for i, price in enumerate(prices):
        trends.append(1 if price > up[i] else -1 if price < lo[i] else trends[-1] if trends else 0)
    gap = {1: up[-1] - prices[-1], -1: prices[-1] - lo[-1], 0: min(abs(prices[-1] - up[-1]), abs(prices[-1] - lo[-1]))}[trends[-1]]
    place = 1 - gap / (up[-1] - lo[-1]) if up[-1] > lo[-1] else 0.5
    strength = 0.6 * min(1, max(0, place)) + 0.4 * er
    return trends[-1], hull.iloc[-1], up[-1], lo[-1], er, 1 + sum(x != y for x, y in zip(trends[-20:], trends[-19:], strict=False)) < 4, strength


@pytest.mark.parametrize("band", ["LOW", "MEDIUM", "HIGH"])
def test_kalman_hull_equals_a_plain_version(spark, band):
    rng = np.random.default_rng(4)
    series = {"UP": 50 + np.arange(252) * 0.5 + rng.normal(0, 0.1, 252), "WALK": 50 + rng.normal(0, 0.5, 252).cumsum(), "DOWN": 90 - np.arange(60) + rng.normal(0, 2, 60), "SHORT": np.ones(29), "FLAT": np.full(40, 7.0)}
    rows = None
    for name, closes in series.items():
        rows = panel(spark, list(closes), name) if rows is None else rows.unionByName(panel(spark, list(closes), name))
    found = {r.asset: r for r in signals.kalman_hull(rows, band).collect()}
    assert found["SHORT"].signal_strength == 0.0 and found["SHORT"].trend is None
    for name in ("UP", "WALK", "DOWN"):
        frame = rows.where(F.col("asset") == name).orderBy("dt").toPandas()
        r = found[name]
        assert (r.trend, r.kalman_price, r.upper_band, r.lower_band, r.efficiency_ratio, r.trend_consistency, r.signal_strength) == pytest.approx(plain_trend(frame, *signals.KALMAN[band]))
    assert found["FLAT"].efficiency_ratio == 0.5
    own = rows.withColumn("band", F.lit(band.lower()))
    assert sorted(map(str, signals.kalman_hull(own, "other").collect())) == sorted(map(str, found.values()))


def test_divergence_at_the_end():
    flat = np.concatenate((np.full(20, 10.0), [9.0]))
    rising = np.linspace(1, 2, 21)
    assert signals._divergence_at_end(flat, rising) == "bullish" and signals._divergence_at_end(-flat, -rising) == "bearish"
    assert signals._divergence_at_end(flat[1:], rising[1:]) == "none" and signals._divergence_at_end(flat, flat) == "none"


@pytest.mark.parametrize(("vol", "beta", "band"), [
    (0.1, 0.5, "LOW"), (0.1, 1.2, "LOW"), (0.1, 1.3, "MEDIUM"), (0.12, 0.5, "MEDIUM"), (0.22, 1.2, "MEDIUM"), (0.22, 1.3, "HIGH"), (0.3, 0.79, "MEDIUM"), (0.3, 0.8, "HIGH"), (0.3, 2.0, "HIGH"), (None, 1.0, "UNKNOWN"), (0.2, None, "UNKNOWN"),
])
def test_risk_matrix(spark, vol, beta, band):
    row = spark.createDataFrame([(vol, beta)], "v double, b double").select(risk.risk_class(F.col("v"), F.col("b")).alias("c")).first()
    assert row.c == band


def regime_series(spark, pairs, n=40):
    """Series whose returns have a given sign towards those of equity, gold or rates; shaped by a shared noise."""
    rng = np.random.default_rng(6)
    days = pd.date_range("2021-01-01", periods=n).date
    base = rng.normal(0, 0.01, n)
    rows = []
    for name, share in pairs.items():
        rets = share * base + (1 - abs(share)) * rng.normal(0, 0.01, n)
        rows += [(name, d, float(v)) for d, v in zip(days, 100 * np.cumprod(1 + rets), strict=True)]
    return spark.createDataFrame(rows, "name string, dt date, value double")


@pytest.mark.parametrize(("shares", "regime"), [
    ({"gold": -1.0, "equity": 1.0, "vix": 1.0, "us_10y": 1.0, "aud_usd": 0.1}, "CRISIS"), ({"gold": 1.0, "equity": 1.0, "vix": -1.0, "us_10y": 1.0, "aud_usd": 0.1}, "RISK_ON"),
    ({"gold": -1.0, "equity": 1.0, "vix": 1.0, "us_10y": -1.0, "aud_usd": 0.1}, "RISK_OFF"),
])
def test_regimes(spark, shares, regime):
    found = regimes.timeline(regime_series(spark, shares)).orderBy("dt").collect()
    assert found and {r.regime for r in found} == {regime}
    few = regimes.timeline(regime_series(spark, {k: v for k, v in shares.items() if k in ("gold", "equity", "aud_usd")})).collect()
    assert {(r.regime, r.sub, r.confidence) for r in few} == {("UNKNOWN", "UNKNOWN", 0.0)}


@pytest.mark.parametrize(("code", "region"), [("BHP.AX", "Australia"), ("X-JKT", "Indonesia"), ("SAP.DE", "Germany"), ("MC.PA", "France"), ("AAPL", "United States"), ("A.B-HK", "Hong Kong"), ("Z.QQ", "United States"), (None, "United States")])
def test_regions(spark, code, region):
    assert spark.createDataFrame([(code,)], "c string").select(rules.region_of(F.col("c")).alias("r")).first().r == region


def test_single_analysis(spark):
    rng = np.random.default_rng(7)
    closes = list(100 * np.exp(rng.normal(0, 0.013, 330).cumsum()))
    row = single.analysis(panel(spark, closes).unionByName(panel(spark, [1.0] * 20, "SHORT"))).collect()
    assert len(row) == 1
    r, s = row[0], pd.Series(closes, pd.date_range("2021-01-01", periods=330))
    ret = s.pct_change().dropna()
    assert r.volatility == pytest.approx(ret.std() * 252**0.5) and r.band == "MEDIUM" and r.latest == pytest.approx(closes[-1])
    assert r.forecast == pytest.approx(-100 * np.clip(ret.tail(20).sum(), -0.1, 0.1)) and r.cvar == pytest.approx(risk.tail_loss(ret.to_numpy()))
    assert r.ytd_return == pytest.approx((s.iloc[-1] / s.iloc[0] - 1) * 100) and r.one_year_return == pytest.approx((s.iloc[-1] / s.iloc[0] - 1) * 100)
    tail = min(20, -max(r.cvar, -0.5) * 200) if r.cvar < 0 else 0
    assert r.score == pytest.approx(max(0, min(100, np.clip(r.forecast * 4, -40, 40) + r.hit_rate * 20 + min(20, r.signal * 20) + tail)), abs=1e-6)


def test_conditional_sharpe_by_a_fitted_law(spark):
    rng = np.random.default_rng(8)
    bars = panel(spark, list(100 * np.exp((rng.standard_t(5, 400) * 0.01).cumsum())))
    days = [r.dt for r in bars.select("dt").orderBy("dt").collect()]
    fear = dict(zip(days, rng.gamma(2, 8, 400).tolist(), strict=True))
    law = risk.fitted_laws(bars).first()
    found = risk.conditional_sharpe(bars, spark.createDataFrame(list(fear.items()), "dt date, value double"), risk.fitted_laws(bars)).first()
    s = pd.Series([r.close for r in bars.orderBy("dt").collect()], days).pct_change().dropna()
    f = pd.Series(fear)[s.index]
    stress = s[f > np.percentile(f, 85)]
    want = (stress.mean() * 252 - 0.0435) / (law.scale * (law.degrees / (law.degrees - 2)) ** 0.5 * 252**0.5)
    assert found.days == len(stress) and found.sharpe == pytest.approx(max(-3, min(3, want)))
    short = risk.conditional_sharpe(bars.where("dt < date '2021-06-01'"), spark.createDataFrame(list(fear.items()), "dt date, value double")).first()
    assert short.sharpe is None
    wide = risk.enhanced_volatility(bars).first().volatility
    assert wide == pytest.approx(s.tail(252).std() * 252**0.5 * (law.degrees / (law.degrees - 2)) ** 0.5)


def test_volatility_decision(spark):
    own = spark.createDataFrame([("a", 0.5, 0.4, True), ("b", 0.1, 0.4, False)], "asset string, vol_20 double, p95 double, elevated boolean")
    calm, wild = (spark.createDataFrame([(m, md)], "mean double, median double") for m, md in ((0.2, 0.18), (0.2, 0.1)))
    found = {r.asset: (r.decision, r.reason) for r in intervals.volatility_decision(own, calm).collect()}
    assert found["a"] == ("ROTATE", "a volatility 50.0% above its range to 40.0% | market normal: mean volatility 20.0% | ROTATE: the asset alone is volatile") and found["b"][0] == "ROTATE"
    assert {r.decision for r in intervals.volatility_decision(own, wild).collect()} == {"HOLD"}


def test_unknown_partition_is_refused(spark, tmp_path):
    sinks.partitioned(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), str(tmp_path / "t"), "k")
    assert [r.v for r in sinks.partition(spark, str(tmp_path / "t"), "k", "a", ("a", "b")).collect()] == [1]
    with pytest.raises(ValueError, match="must be one of"):
        sinks.partition(spark, str(tmp_path / "t"), "k", "c", ("a", "b"))


def test_interval_without_history_is_no_ci(spark):
    current = spark.createDataFrame([("a", 0.5, 1.0, 0.9)], "asset string, hit_rate double, conviction double, stability double")
    bounds = spark.createDataFrame([], "asset string, metric string, lower double, upper double")
    assert intervals.signals(current, bounds).first().signal == "NO_CI"


def test_metrics_take_one_shuffle(spark):
    plan = metrics.behaviour(panel(spark, [1.0, 2.0]).repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_comparison_of_holdings(spark):
    d = datetime.date
    held = spark.createDataFrame([("s", d(2020, 1, 1), ["a", "b"]), ("s", d(2020, 1, 2), ["b", "a"]), ("s", d(2020, 1, 3), ["a", "c"]), ("t", d(2020, 1, 1), ["a"])], "scenario string, dt date, holdings array<string>")
    assert {r.scenario: r.trades for r in compare.trades(held).collect()} == {"s": 1, "t": 0}
    rets = spark.createDataFrame([("s", d(2020, 1, i + 1), r) for i, r in enumerate([0.1, -0.5, 0.2])], "scenario string, dt date, ret double")
    r = compare.performance(rets).first()
    assert r.log_total == pytest.approx(np.log(1.1 * 0.5 * 1.2)) and r.max_drawdown == pytest.approx(-0.5)
    s = pd.Series([0.1, -0.5, 0.2])
    assert r.sharpe == pytest.approx(s.mean() * 252 / (s.std() * 252**0.5)) and r.volatility == pytest.approx(s.std() * 252**0.5)
    periods = spark.createDataFrame([("all", d(2020, 1, 1), d(2020, 1, 3)), ("end", d(2020, 1, 3), d(2020, 1, 9))], "period string, a date, b date")
    found = {e.period: e for e in compare.edges(rets, rets.select("dt", (F.col("ret") / 2).alias("ret")), periods).collect()}
    assert found["end"].edge == pytest.approx(np.log(1.2 / 1.1)) and found["all"].edge == pytest.approx(np.log(1.1 * 0.5 * 1.2) - np.log(1.05 * 0.75 * 1.1))
    whole = compare.consistency(compare.edges(rets, rets.select("dt", (F.col("ret") / 2).alias("ret")), periods)).first()
    assert whole.periods == 2 and whole.positive == 0.5 and not whole.always


def test_missing_columns_are_null(spark):
    df = spark.createDataFrame([("a", 1.0)], "asset string, close double")
    assert panels.adjusted(df).first().asDict() == {"asset": "a", "close": 1.0, "adj_close": None, "price": 1.0}
    assert panels.projected(df, {"close": "string", "volume": "double"}).schema.simpleString() == "struct<asset:string,close:double,volume:double>"


@pytest.mark.parametrize("least", [3, 1000])
def test_places_in_a_group_equal_a_count(spark, least):
    """With ties in a third of all rows, which are hot for the lower bound, and groups of very different sizes."""
    rng = random.Random(least)
    rows = [(rng.choice("aaab"), rng.choice([0.0, round(rng.gauss(0, 1), 1), rng.gauss(0, 1)]), i) for i in range(400)] + [(None, 1.0, -1), (None, 2.0, -2)]
    data = written(spark.createDataFrame(rows, "g string, v double, i long"), "rows")
    got = {r.i: (r.below, r.ties, r.size) for r in hot.placed(data, ["g"], "v", least).collect()}
    ranks = {r.i: r.place for r in hot.ranked_in_ranges(data, ["g"], -F.col("v"), ["i"], "place").collect()}
    for g, v, i in rows:
        mine = [x for x in rows if x[0] == g]
        assert got[i] == (sum(x[1] < v for x in mine), sum(x[1] == v for x in mine), len(mine))
        assert ranks[i] == sorted(mine, key=lambda x: (-x[1], x[2])).index((g, v, i)) + 1


def test_newest_equals_the_last_row_of_behaviour(spark):
    bars, _, _ = many(spark, [300, 130, 101, 100, 64, 41, 40, 31, 30, 2, 1])
    last = {r.asset: r for r in metrics.behaviour(bars).withColumn("_k", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("dt")))).where("_k = 1").collect()}
    got = metrics.newest(bars).collect()
    assert len(got) == len(last)
    for r in got:
        w = last[r.asset]
        assert (r.dt, r.close) == (w.dt, w.close) and (r.hit_rate, r.conviction, r.stability) == pytest.approx((w.hit_rate, w.conviction, w.stability))


@pytest.mark.parametrize("every", [20, 40, 60, 63])
def test_the_best_of_one_day_equal_the_rankings(spark, every):
    bars, assets, day = many(spark, [260] * 12 + [120] * 2 + [51] * 3, drop=(0, 1))
    for when in (None, day - datetime.timedelta(days=15)):
        want = ranking.as_of_rankings(bars, assets, spark.createDataFrame([(when or day, every)], "dt date, every int")).where("rank <= 8")
        got = ranking.top_as_of(bars, assets, when, 8, every)
        assert sorted((r["rank"], r.asset, round(r.score, 9), r.seen) for r in got.collect()) == sorted((r["rank"], r.asset, round(r.score, 9), r.seen) for r in want.collect())


@pytest.mark.parametrize(("series", "days"), [(64, 256), (2, 7)])
def test_correlations_by_blocks_equal_pairwise_ones(spark, series, days):
    """Series with days of their own, one that doesn't move, one without common days, and missing values."""
    rng, start = random.Random(days), datetime.date(2019, 12, 20)
    rows = [(f"s{k}", start + datetime.timedelta(days=i), 0.5 if k == 3 else rng.gauss(5, 1)) for k in range(7) for i in range(60) if rng.random() < 0.8]
    rows += [("late", start + datetime.timedelta(days=500 + i), 1.0 * i) for i in range(5)] + [("s1", start + datetime.timedelta(days=99), None), ("one", start + datetime.timedelta(days=3), 2.0)]
    data = written(spark.createDataFrame(rows, "asset string, dt date, ret double"), "returns")
    held = F.col("asset").isin("s0", "s1", "s3")
    got = {(r.asset, r.other): (r.n, r["corr"]) for r in correlations.common_correlations(data.where(~held), data.where(held), series, days).collect()}
    wide = pd.DataFrame(rows, columns=["a", "dt", "r"]).pivot(index="dt", columns="a", values="r")
    for a in ("s2", "s4", "s5", "s6", "one", "late"):
        for b in ("s0", "s1", "s3"):
            both = wide[[a, b]].dropna()
            if len(both) == 0:
                assert (a, b) not in got
            else:
                n, c = got[a, b]
                assert n == len(both) and (c is None if len(both) == 1 or b == "s3" else c == pytest.approx(both[a].corr(both[b])))


@pytest.mark.parametrize(("micros", "state"), [(-1, "active"), (0, "active"), (1, "stale"), (999_999, "stale"), (1_000_000, "stale")])
def test_activity_ends_at_its_bound_to_the_microsecond(spark, micros, state):
    now = datetime.datetime(2024, 2, 4, 12)  # a Sunday: 48 hours since a Friday
    last = now - datetime.timedelta(hours=48, microseconds=micros)
    row = spark.createDataFrame([(last, now)], "last timestamp_ntz, now timestamp_ntz")
    assert row.select(rules.activity(F.col("last"), F.col("now")).alias("state")).first().state == state


def test_activity_equals_its_sql_beside_the_bound(spark, tmp_path):
    now = datetime.datetime(2024, 1, 30, 12)  # a Tuesday: 36 hours since the day before
    rows = [(user, "view", now - datetime.timedelta(hours=36, microseconds=micros)) for user, micros in enumerate([-300_000, 0, 1, 700_000, 1_200_000])]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    columns = ["event_type", "now", "active", "stale", "bound"]
    got = registry.queries()["activity"](spark, str(tmp_path)).select(*columns).collect()
    want = con.sql(registry.oracle_sql()["activity"]).select(*columns).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert ("view", now, 2, 3, 36) in want
