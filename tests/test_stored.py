"""Stored panels, and Student-t laws by sums over them."""

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import risk
from tidemark.sources import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"a{i % 9}", datetime.date(2018 + i % 5, 1 + i % 12, 1 + i % 28), float(i)) for i in range(900)]
    panel = spark.createDataFrame(rows, "asset string, dt date, close double").dropDuplicates(["asset", "dt"])
    return panel, stored.store(panel, buckets=8)


def test_windows_by_asset_need_no_exchange(spark, table):
    panel, name = table
    rows = stored.stored(spark, name).withColumn("total", F.sum("close").over(S.so_far()))
    assert "Exchange" not in plan(rows) and "Window" in plan(rows)
    want = panel.withColumn("total", F.sum("close").over(S.so_far()))
    assert sorted(map(tuple, rows.select("asset", "dt", "total").collect())) == sorted(map(tuple, want.select("asset", "dt", "total").collect()))


def test_only_buckets_and_years_that_are_asked_for_are_read(spark, table):
    panel, name = table
    rows = stored.stored(spark, name, ["a3"], "2019-06-01", datetime.date(2020, 2, 28))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        said = plan(rows.withColumn("total", F.sum("close").over(S.so_far())))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "SelectedBucketsCount: 1 out of 8" in said and re.search(r"PartitionFilters: \[.*year.*>= 2019.*year.*<= 2020", said)
    years = {re.search("year=(\\d+)", r.name)[1] for r in rows.select(F.input_file_name().alias("name")).distinct().collect()}
    assert years <= {"2019", "2020"}
    want = panel.where("asset = 'a3' and dt between date '2019-06-01' and date '2020-02-28'")
    assert sorted(map(tuple, rows.select("asset", "dt", "close").collect())) == sorted(map(tuple, want.collect()))
    assert stored.stored(spark, name, []).count() == 0


def test_joins_of_stored_tables_need_no_exchange(spark, table):
    panel, name = table
    other = stored.store(panel.groupBy("asset").agg(F.avg("close").alias("mean")), buckets=8, day=None)
    joined = stored.stored(spark, name).hint("merge").join(spark.table(other), "asset")
    assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined) and joined.count() == panel.count()


def test_laws_by_sums_of_given_degrees_equal_the_same_steps(spark):
    rng = np.random.default_rng(3)
    data = {"a": 0.01 + 0.02 * rng.standard_t(4, 800), "b": rng.standard_t(3, 500), "c": 5 + 0.1 * rng.standard_t(8, 900)}
    returns = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs] + [("a", None)], "asset string, ret double")
    for r in risk.laws_by_sums(returns, 6, 4.0).collect():
        x, mu, s = data[r.asset], data[r.asset].mean(), data[r.asset].std()
        for _ in range(6):
            w = 5 / (4 + ((x - mu) / s) ** 2)
            mu = (w * x).sum() / w.sum()
            s = np.sqrt((w * (x - mu) ** 2).sum() / w.sum())
        assert (r.n, r.centre, r.scale, r.degrees) == pytest.approx((len(x), mu, s, 4.0))


def test_free_degrees_reach_the_most_likely_law(spark):
    rng = np.random.default_rng(5)
    data = {"a": 0.3 + 2 * rng.standard_t(3, 400), "b": rng.standard_t(6, 700)}
    returns = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x], "asset string, ret double")
    for r in risk.laws_by_sums(returns).collect():
        assert (r.degrees, r.centre, r.scale) == pytest.approx(risk.fit_t(data[r.asset]), rel=2e-5), r.asset


def test_digamma():
    assert risk._digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.2517525890667211])
