"""Windows over the series of a panel, as columns. A panel has columns asset and dt, one row a day.

``last(n)`` frames take the rows that exist, as a tail does; ``rolling`` values are null until the frame is full.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS = 252


def by_asset(key: str = "asset") -> WindowSpec:
    return Window.partitionBy(key).orderBy("dt")


def last(n: int, key: str = "asset") -> WindowSpec:
    return by_asset(key).rowsBetween(1 - n, 0)


def so_far(key: str = "asset") -> WindowSpec:
    return by_asset(key).rowsBetween(Window.unboundedPreceding, 0)


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ago(c: Column | str, n: int, key: str = "asset") -> Column:
    return F.lag(column(c), n).over(by_asset(key))


def simple_return(price: str = "close", n: int = 1, key: str = "asset") -> Column:
    """Change over ``n`` rows; null for the first ``n`` and after a price of zero."""
    return F.try_divide(F.col(price), ago(price, n, key)) - 1


def rolling(value: Column, c: Column | str, n: int, least: int | None = None, key: str = "asset") -> Column:
    """``value`` (over ``last(n)``) where the frame has at least ``least`` (all ``n`` by default) values of ``c``."""
    return F.when(F.count(column(c)).over(last(n, key)) >= (least or n), value)


def sma(c: Column | str, n: int, key: str = "asset") -> Column:
    return rolling(F.avg(column(c)).over(last(n, key)), c, n, key=key)


def rolling_std(c: Column | str, n: int, key: str = "asset") -> Column:
    return rolling(F.stddev_samp(column(c)).over(last(n, key)), c, n, key=key)


def zscore(c: Column | str, n: int) -> Column:
    """Distance from the rolling mean in rolling deviations; a deviation of zero counts as one."""
    spread = F.coalesce(F.nullif(rolling_std(c, n), F.lit(0.0)), F.when(F.count(column(c)).over(last(n)) >= n, F.lit(1.0)))
    return (column(c) - sma(c, n)) / spread


def wma(c: str, n: int) -> Column:
    """Linearly weighted mean, the newest value weighing most; null until there are ``n`` values."""
    terms = [F.coalesce(ago(c, n - i), F.lit(None).cast("double")) * i if i < n else F.col(c) * n for i in range(1, n + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / (n * (n + 1) / 2)


def true_range() -> Column:
    """The widest of today's range and its distances from yesterday's close; today's range on the first day."""
    before = ago("close", 1)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def growth(ret: Column | str, key: str = "asset") -> Column:
    """Product of one plus the returns so far; nulls count as no change."""
    return F.product(1 + F.coalesce(column(ret), F.lit(0.0))).over(so_far(key))


def drawdown(level: Column | str, key: str = "asset") -> Column:
    """Fall from the highest level so far, zero or less."""
    return column(level) / F.max(column(level)).over(so_far(key)) - 1


def filled(c: str, key: str = "asset") -> Column:
    """The last value that is not null."""
    return F.last(c, ignorenulls=True).over(so_far(key))


def from_end(key: str = "asset") -> Column:
    """1 for the newest row of a series, 2 for the one before."""
    return F.row_number().over(Window.partitionBy(key).orderBy(F.desc("dt")))
