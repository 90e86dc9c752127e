"""Streams of several batches: days split over them, batches that come again, late and disordered rows."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordered import OrderedWindow
from tidemark.operators import intervals, signals
from tidemark.plans import streams
from tidemark.session import new_folder
from tidemark.streaming import events
from tidemark.streaming.replay import BandFold, IntervalFold, LevelFold, replayed
from tidemark.streaming.upserts import DayTable, added

DAY = datetime.datetime(2024, 3, 1)


def batches(spark, parts, schema, name="in"):
    """The rows of each part as the files of one batch."""
    folder = new_folder(spark, name)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={i}")
    return events.file_stream(spark, folder)


EVENT = "event_id long, event_type string, value double, ts timestamp"


def event(i, kind="a", value=1.0, hours=0.0):
    return i, kind, value, DAY + datetime.timedelta(hours=hours)


def table(df):
    return sorted((r.event_type, str(r.day), r.events, r.total) for r in df.collect())


@pytest.mark.parametrize("compact_every", [0, 1, 2])
def test_a_day_split_over_batches_is_whole(spark, compact_every):
    parts = [[event(1, value=10.0), event(2, "b")], [event(3, value=20.0, hours=5)], [event(4, hours=30), event(5, "b", 2.0, 23)], [event(6, value=0.5, hours=1)]]
    got = events.appended(batches(spark, parts, EVENT), compact_every)
    assert table(got) == [("a", "2024-03-01", 3, 30.5), ("a", "2024-03-02", 1, 1.0), ("b", "2024-03-01", 2, 3.0)]


def test_a_batch_that_comes_again_changes_nothing_and_writes_its_own_partitions_alone(spark):
    days = DayTable(spark, ["event_type"], {"events": "sum", "total": "sum"}, "event_type string, day date, events long, total double")
    assert days.read().collect() == []
    first, second = (spark.createDataFrame(x, EVENT) for x in ([event(1, value=10.0)], [event(2, value=20.0, hours=2), event(3, hours=50)]))
    days.put(events.daily_partials(first), 0)
    days.put(events.daily_partials(second), 1)
    want = [("a", "2024-03-01", 2, 30.0), ("a", "2024-03-03", 1, 1.0)]
    assert table(days.read()) == want
    before = {r.name: r.at for r in spark.read.parquet(f"{days.folder}/partials").select(F.input_file_name().alias("name"), F.col("_metadata.file_modification_time").alias("at")).collect()}
    days.put(events.daily_partials(second), 1)
    assert table(days.read()) == want
    after = {r.name: r.at for r in spark.read.parquet(f"{days.folder}/partials").select(F.input_file_name().alias("name"), F.col("_metadata.file_modification_time").alias("at")).collect()}
    assert {n: t for n, t in after.items() if "batch=0" in n} == {n: t for n, t in before.items() if "batch=0" in n}
    days.compacted()
    days.put(events.daily_partials(second), 1)  # a batch that runs again after its merge
    assert table(days.read()) == want
    days.compacted()
    days.put(events.daily_partials(first), 2)
    assert table(days.read()) == [("a", "2024-03-01", 3, 40.0), ("a", "2024-03-03", 1, 1.0)]


def test_other_ways_to_merge(spark):
    days = DayTable(spark, ["k"], {"low": "min", "high": "max", "last": "newest"}, "k string, day date, low double, high double, last string")
    day = DAY.date()
    for i, row in enumerate([("x", day, 3.0, 3.0, "one"), ("x", day, 1.0, 1.0, "two"), ("x", day, 2.0, 5.0, None)]):
        days.put(spark.createDataFrame([row], "k string, day date, low double, high double, last string"), i)
    assert [tuple(r) for r in days.read().select("low", "high", "last").collect()] == [(1.0, 5.0, None)]


def test_what_a_batch_writes_goes_by_the_batch(spark):
    """Ten times the table, the same batch: the same bytes."""
    sizes = []
    for old in (20, 200):
        days = DayTable(spark, ["event_type"], {"events": "sum", "total": "sum"}, "event_type string, day date, events long, total double")
        days.put(events.daily_partials(spark.createDataFrame([event(i, hours=24 * i) for i in range(old)], EVENT)), 0)
        days.put(events.daily_partials(spark.createDataFrame([event(1, hours=24), event(2, hours=48)], EVENT)), 1)
        files = spark.read.parquet(f"{days.folder}/partials").where("batch = 1").select("_metadata.file_path", "_metadata.file_size").distinct()
        sizes.append(files.agg(F.count("*"), F.sum("file_size")).first()[:])
    assert sizes[0] == sizes[1]


def shuffled_parts(rows, parts, late, at, rng):
    """Rows in parts of ascending time, out of order by up to ``late``."""
    order = sorted(rows, key=lambda r: r[at] + datetime.timedelta(days=rng.uniform(0, late)))
    size = -(-len(order) // parts)
    found = [order[i * size : (i + 1) * size] for i in range(parts)]
    for part in found:
        rng.shuffle(part)
    return found


def test_levels_in_any_order_of_files(spark):
    rng = random.Random(4)
    rows = [event(i, rng.choice("ab"), rng.gauss(0, 1), rng.uniform(0, 300)) for i in range(400)]
    found = events.newest(events.run_to_end(events.filtered(batches(spark, shuffled_parts(rows, 4, 2, 3, rng), EVENT)), "update"), ["event_type"])
    fold = LevelFold()
    for r in found.collect():
        state = fold.start()
        for _, _, value, _ in sorted((x for x in rows if x[1] == r.event_type), key=lambda x: (x[3], x[0])):
            state = fold.fold(state, (value,))
        assert (r.events, r.state, r.variance) == pytest.approx(state)


def bars(rng, asset, days):
    price, out = 50.0, []
    for i in range(days):
        price *= 1 + rng.gauss(0, 0.02)
        out.append((asset, DAY + datetime.timedelta(days=i), price * 1.01, price * 0.99, price))
    return out


def test_bands_equal_the_batch_whatever_the_order_and_repeats(spark):
    rng = random.Random(8)
    rows = [r for asset, n in (("x", 150), ("y", 90), ("z", 31)) for r in bars(rng, asset, n)]
    schema = "asset string, ts timestamp, high double, low double, close double"
    panel = spark.createDataFrame(rows, schema).withColumn("dt", F.to_date("ts"))
    parts = shuffled_parts(rows, 3, 8, 1, rng)
    parts[1] += parts[0][-5:]  # bars that come again
    stream = batches(spark, parts, schema).join(signals.band_parameters(panel), "asset")
    got = events.newest(events.run_to_end(replayed(stream, BandFold(), ["asset"], "20 days", 7 * 86_400), "update"), ["asset"])
    want = {r.asset: r for r in signals.kalman_hull(panel).collect()}
    for r in got.collect():
        w = want.pop(r.asset)
        assert (r.trend, r.kalman_price, r.upper_band, r.lower_band) == pytest.approx((w.trend, w.kalman_price, w.upper_band, w.lower_band))
    assert not want


def test_a_part_of_many_files_is_one_batch_and_none_of_it_is_late(spark):
    rng = random.Random(18)
    schema = "asset string, ts timestamp, high double, low double, close double"
    panel = spark.createDataFrame([r for asset in "abcdefgh" for r in bars(rng, asset, 400)], schema).withColumn("dt", F.to_date("ts"))
    rows = panel.join(signals.band_parameters(panel), "asset").repartition(8, "asset")
    found = events.run_to_end(replayed(streams._bar_stream(rows), BandFold(), ["asset"], "40 days", 30 * 86_400), "update")
    assert {r.batch for r in found.select("batch").distinct().collect()} <= {0, 1, 2, 3}  # three parts, and one without rows at the end
    got = {r.asset: (r.trend, r.kalman_price, r.upper_band, r.lower_band) for r in events.newest(found, ["asset"]).collect()}
    for w in signals.kalman_hull(panel).collect():
        assert got.pop(w.asset) == pytest.approx((w.trend, w.kalman_price, w.upper_band, w.lower_band))
    assert not got


def test_parts_have_as_many_files_as_a_batch_takes_however_few_their_rows(spark):
    rows = spark.range(1000, numPartitions=7).withColumn("part", F.when(F.col("id") < 2, 1).when(F.col("id") < 5, 2).otherwise(0))
    folder = events.files_in_turn(rows, F.col("part"), 4, "few", 3)
    assert [len(spark.read.schema(rows.schema).parquet(f"{folder}/part={i}").inputFiles()) for i in range(4)] == [3] * 4
    found = events.run_to_end(events.file_stream(spark, folder, 3), "append")
    assert sorted(tuple(r) for r in found.groupBy("batch").agg(F.count("*"), F.min("part"), F.max("part")).collect()) == [(0, 995, 0, 0), (1, 2, 1, 1), (2, 3, 2, 2)]


def test_streams_have_no_more_stores_than_cores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for number, most in (("200", max(events.LEAST_STORES, spark.sparkContext.defaultParallelism)), ("2", 2)):
            spark.conf.set("spark.sql.shuffle.partitions", number)
            with events.state_stores(spark):
                assert spark.conf.get("spark.sql.shuffle.partitions") == str(most)
            assert spark.conf.get("spark.sql.shuffle.partitions") == number
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_band_parameters_leave_short_series_out(spark):
    panel = spark.createDataFrame(bars(random.Random(1), "x", 29), "asset string, ts timestamp, high double, low double, close double").withColumn("dt", F.to_date("ts"))
    assert signals.band_parameters(panel).collect() == []


def test_intervals_of_every_day_equal_the_batch(spark):
    rng = random.Random(9)
    rows = [(a, m, DAY + datetime.timedelta(days=i), rng.choice([0.0, rng.gauss(0, 1)])) for a in "xy" for m in ("hit_rate", "conviction") for i in range(130)]
    schema = "asset string, metric string, ts timestamp, value double"
    stream = batches(spark, shuffled_parts(rows, 3, 6, 2, rng), schema)
    found = events.run_to_end(replayed(stream, IntervalFold(), ["asset", "metric"], "20 days", 10 * 86_400), "update")
    last = found.groupBy("asset", "metric", "ts").agg(F.max_by(F.struct("lower", "upper", "mean"), F.struct("batch", "settled")).alias("x"))
    got = {(r.asset, r.metric, r.ts): (r.lower, r.upper, r.mean) for r in last.select("asset", "metric", "ts", "x.*").collect()}
    wide = spark.createDataFrame(rows, schema).groupBy("asset", F.to_date("ts").alias("dt")).pivot("metric", ["hit_rate", "conviction"]).agg(F.first("value"))
    want = intervals.as_of_each(wide, names=("hit_rate", "conviction")).collect()
    assert len(want) == len(got) == len(rows)
    for r in want:
        assert got[r.asset, r.metric, datetime.datetime.combine(r.dt, datetime.time())] == pytest.approx((r.lower, r.upper, r.mean))


def test_an_ordered_window_equals_sorting():
    rng = random.Random(2)
    values = [rng.choice([1.0, 2.0, None, rng.random()]) for _ in range(300)]
    window = OrderedWindow(25)
    for i, v in enumerate(values):
        window.push(v)
        known = pd.Series([x for x in values[max(0, i - 24) : i + 1] if x is not None], dtype=float)
        assert window.ordered == sorted(known)
        if len(known):
            low, high, mean = window.interval(True)
            drawn = known.clip(known.quantile(0.01), known.quantile(0.99))
            assert (low, high, mean) == pytest.approx((drawn.quantile(0.025), drawn.quantile(0.975), drawn.mean()))
