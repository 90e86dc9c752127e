"""Correlations of every series of one set with every one of another, over their common days, by products of blocks.

Series are dealt into blocks of about ``SERIES``, days into periods of ``DAYS``. Blocks of one period meet, and a product
of two matrices and of their masks gives each pair's sums over the days that both have. So what is shuffled grows with
series times blocks, and what comes of a meeting with pairs and periods, not with pairs and days.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scans

SERIES, DAYS = 64, 256


def _blocks(rows: DataFrame, side: str, series: int, days: int) -> DataFrame:
    """(day_block, block, and arrays of keys, days and values) of a side: at most about ``series`` times ``days`` values a row."""
    count = rows.select("asset").distinct().agg(F.ceil(F.count("*") / series).alias("_blocks"))
    dealt = rows.where(F.col("ret").isNotNull() & ~F.isnan("ret")).crossJoin(F.broadcast(count))  # one row
    dealt = dealt.select("asset", "dt", "ret", F.pmod(F.xxhash64("asset"), F.greatest("_blocks", F.lit(1))).alias("block"), scans.period_of("dt", days).alias("day_block"))
    each = F.collect_list(F.struct("asset", F.unix_date("dt").alias("day"), "ret")).alias(side)
    return dealt.groupBy("block", "day_block").agg(each).select("day_block", F.col("block").alias(f"{side}_block"), *(F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in ("asset", "day", "ret")))


def _dense(keys: pa.Array, days: pa.Array, values: pa.Array, axis: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A matrix of series by days of ``axis`` with zeros where there is no value, and its mask."""
    names, which = np.unique(keys.to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    day, value = days.to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False)
    at = np.searchsorted(axis, day)
    known = (at < len(axis)) & (axis[np.minimum(at, len(axis) - 1)] == day) if len(axis) else np.zeros(len(day), bool)
    matrix, mask = np.zeros((len(names), len(axis))), np.zeros((len(names), len(axis)))
    matrix[which[known], at[known]], mask[which[known], at[known]] = value[known], 1.0
    return names.tolist(), matrix, mask


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [[batch.column(f"{side}_{c}") for c in ("asset", "day", "ret")] for side in ("a", "b")]
        for i in range(batch.num_rows):
            (ka, da, va), (kb, db, vb) = ([c[i].values for c in side] for side in sides)
            axis = np.intersect1d(da.to_numpy(zero_copy_only=False), db.to_numpy(zero_copy_only=False))
            names_a, x, mx = _dense(ka, da, va, axis)
            names_b, y, my = _dense(kb, db, vb, axis)
            n = mx @ my.T
            sums = [n, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T]
            p, q = np.nonzero(n)
            columns = [pa.array([names_a[k] for k in p], pa.string()), pa.array([names_b[k] for k in q], pa.string()), *(pa.array(s[p, q]) for s in sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["asset", "other", "n", "x", "y", "xx", "yy", "xy"])


def common_correlations(left: DataFrame, right: DataFrame, series: int = SERIES, days: int = DAYS) -> DataFrame:
    """(asset, other, n, corr) of each pair of a series of ``left`` and one of ``right`` (asset, dt, ret) with common days:
    how many, and the correlation over them; null where one of them doesn't move or there's a single day."""
    pairs = _blocks(left, "a", series, days).join(_blocks(right, "b", series, days), "day_block")
    sums = pairs.mapInArrow(_products, "asset string, other string, n double, x double, y double, xx double, yy double, xy double")
    total = sums.groupBy("asset", "other").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    spread = (F.col("xx") - x * x / n) * (F.col("yy") - y * y / n)
    flat = (F.col("xx") - x * x / n <= 1e-14 * F.col("xx")) | (F.col("yy") - y * y / n <= 1e-14 * F.col("yy"))
    return total.select("asset", "other", n.cast("long").alias("n"), F.when(~flat, (F.col("xy") - x * y / n) / F.sqrt(spread)).alias("corr"))
