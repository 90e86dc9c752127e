"""Running values dealt by period, held against plain Python, with one key that has nearly all rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scans
from tidemark.operators import metrics, relational, signals
from tidemark.session import written

FIRST = datetime.date(2001, 1, 1)


def series(seed, sizes):
    rng, rows = random.Random(seed), []
    for key, n in sizes.items():
        day = FIRST
        for _ in range(n):
            day += datetime.timedelta(days=90 if rng.random() < 0.01 else rng.choice([1, 1, 2]))
            rows.append((key, day, rng.gauss(0, 1), rng.choice([None, rng.random()])))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = series(3, {"hot": 900, "y": 5, None: 70})
    return rows, written(spark.createDataFrame(rows, "k string, dt date, v double, w double").repartition(5), "series")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["dt"]):
        out.setdefault(r["k"], []).append(r)
    return out


def test_prefixes_equal_loops(data):
    rows, df = data
    kinds = {"total": ("sum", "w"), "top": ("max", "w"), "filled": ("last", "w"), "known": ("count", "w"), "earlier": ("previous", "w"), "grown": ("product", "w")}
    got = by_key(scans.prefixes(df, ["k"], ["dt"], scans.period_of(), kinds).collect())
    assert sum(map(len, got.values())) == len(rows)
    for found in got.values():
        total = top = filled = grown = before = None
        known = 0
        for r in found:
            w = r["w"]
            assert r["earlier"] == before
            before = w
            if w is not None:
                total, top, grown, filled, known = (total or 0) + w, w if top is None else max(top, w), w if grown is None else grown * w, w, known + 1
            assert (r["top"], r["filled"], r["known"]) == (top, filled, known)
            assert (r["total"], r["grown"]) == pytest.approx((total, grown)) if total is not None else r["total"] is r["grown"] is None


def test_an_unknown_kind_is_refused(data):
    with pytest.raises(ValueError, match="median"):
        scans.prefixes(data[1], ["k"], ["dt"], scans.period_of(), {"x": ("median", "w")})


def test_affine_recursions_equal_loops(data):
    """Slow and steep decays, resets, and rows that are unknown, all in one scan."""
    _, df = data
    values = {
        "slow": (F.lit(0.999), F.col("v"), F.lit(5.0)),
        "steep": (F.lit(0.001), F.col("v"), F.lit(0.0)),
        "reset": (F.when(F.col("w") < 0.1, 0.0).otherwise(0.95), F.col("w"), F.col("v")),
    }
    for found in by_key(scans.affine(df, ["k"], ["dt"], scans.period_of(), values).collect()).values():
        slow, steep, reset = 5.0, 0.0, found[0]["v"]
        for r in found:
            slow, steep = 0.999 * slow + r["v"], 0.001 * steep + r["v"]
            reset = reset if r["w"] is None else (0.0 if r["w"] < 0.1 else 0.95) * reset + r["w"]
            assert (r["slow"], r["steep"], r["reset"]) == pytest.approx((slow, steep, reset), rel=1e-9, abs=1e-9)


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, dt date, v double")
    assert scans.affine(none, ["k"], ["dt"], scans.period_of(), {"e": (F.lit(0.5), F.col("v"), F.lit(0.0))}).collect() == []
    assert scans.prefixes(none, ["k"], ["dt"], scans.period_of(), {"s": ("sum", "v")}).collect() == []


def test_one_key_is_spread_over_tasks(spark, data):
    _, df = data
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = scans.prefixes(df.where("k = 'hot'"), ["k"], ["dt"], scans.period_of(), {"s": ("sum", "v")})
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 900 and max(sizes) < 600


def panel(spark, rows):
    return written(spark.createDataFrame([(k or "z", d, 50 + v, 51 + v, 49 + v) for k, d, v, _ in rows], "asset string, dt date, close double, high double, low double"), "panel")


def test_exponential_means_equal_folds(spark, data):
    rows = data[0]
    got = {r.asset: r.ema for r in signals.exponential(panel(spark, rows), 20).collect()}
    lines = {r.asset: tuple(r)[1:] for r in signals.macd(panel(spark, rows)).collect()}
    for key in ("hot", "y", None):
        close = [50 + v for k, _, v, _ in rows if k == key]
        ema = close[0]
        for x in close[1:]:
            ema += (x - ema) * 2 / 21
        weigh = lambda xs, n: sum(x * (1 - 2 / (n + 1)) ** i for i, x in enumerate(reversed(xs))) / sum((1 - 2 / (n + 1)) ** i for i in range(len(xs)))
        line = [weigh(close[: i + 1], 12) - weigh(close[: i + 1], 26) for i in range(len(close))]
        assert got[key or "z"] == pytest.approx(ema)
        assert lines[key or "z"] == pytest.approx((line[-1], weigh(line, 9), line[-1] - weigh(line, 9)))


@pytest.mark.parametrize("process", [0.0, 0.01, 5.0])
def test_kalman_levels_equal_the_filter(spark, data, process):
    rows = data[0]
    parameters = spark.createDataFrame([(a, 2.0, process) for a in ("hot", "y", "z")], "asset string, measurement double, process double")
    found = {}
    for r in signals.kalman_levels(panel(spark, rows), parameters).orderBy("dt").collect():
        found.setdefault(r.asset, []).append(r.level)
    for key in ("hot", "y", None):
        assert found[key or "z"] == pytest.approx(signals.kalman(signals.np.array([50 + v for k, _, v, _ in rows if k == key]), 2.0, process).tolist())


def test_equity_and_drawdown_equal_a_loop(spark, data):
    rows = data[0]
    for key, found in by_key([{"k": r.asset, **r.asDict()} for r in metrics.equity(panel(spark, rows)).collect()]).items():
        growth, top, before = 1.0, 0.0, None
        for r in found:
            growth *= r["close"] / before if before else 1.0
            top, before = max(top, growth), r["close"]
            assert (r["growth"], r["drawdown"]) == pytest.approx((growth, growth / top - 1)), key


def test_as_of_without_a_key_equals_a_search(spark, data):
    rows = data[0]
    left = spark.createDataFrame([(d, i) for i, (_, d, _, _) in enumerate(rows)], "dt date, i long")
    right = [(d + datetime.timedelta(days=1), v) for _, d, v, w in rows[::40] if w is not None]
    right = list({d: (d, v) for d, v in right}.values())
    got = {r.i: r.v for r in relational.as_of(left, spark.createDataFrame(right, "dt date, v double"), [], period=scans.period_of()).collect()}
    keyed = {r.i: r.v for r in relational.as_of(left.withColumn("a", F.lit(1)), spark.createDataFrame(right, "dt date, v double").withColumn("a", F.lit(1)), ["a"]).collect()}
    for i, (_, d, _, _) in enumerate(rows):
        before = [x for x in right if x[0] <= d]
        assert got[i] == keyed[i] == (max(before)[1] if before else None)
