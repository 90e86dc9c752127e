"""Comparisons of strategies: against each other, against a benchmark, over periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import relational


def common_returns(panel: DataFrame) -> DataFrame:
    """(asset, dt, ret) from one day of the common calendar to the next, on the days on which all assets have one."""
    rows = relational.next_day_pairs(panel).select("asset", F.col("next_dt").alias("dt"), "ret")
    whole = panel.agg(F.count_distinct("asset").alias("_all"))
    days = rows.groupBy("dt").agg(F.count("*").alias("_n")).crossJoin(whole).where("_n = _all").select("dt")  # one row
    return rows.join(days, "dt", "left_semi")


def quarter_ends(start: str, end: str) -> str:
    return f"transform(sequence(trunc(date '{start}', 'quarter'), date '{end}', interval 3 months), q -> last_day(add_months(q, 2)))"


def quarterly_leaders(rets: DataFrame, start: str, end: str, held: int = 3, days: int = 90) -> DataFrame:
    """(dt, ret): from each quarter's end to the next, both days included, the mean return of the assets with the best mean
    return over the ``days`` days up to its start. Quarters whose ends aren't trading days are left out."""
    ends = rets.sparkSession.range(1).select(F.posexplode(F.expr(quarter_ends(start, end))).alias("i", "a")).where(F.col("a") <= F.lit(end).cast("date"))
    trading = rets.select(F.col("dt").alias("a")).distinct()
    spans = ends.join(ends.select((F.col("i") - 1).alias("i"), F.col("a").alias("b")), "i").join(trading, "a").join(trading.withColumnRenamed("a", "b"), "b")
    recent = rets.join(spans, (F.col("dt") <= F.col("a")) & (F.col("dt") >= F.date_sub("a", days)))
    means = recent.groupBy("i", "a", "b", "asset").agg(F.avg("ret").alias("mean"))
    best = means.withColumn("_r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("mean"), "asset"))).where(F.col("_r") <= held)
    during = best.select("i", "a", "b", "asset").join(rets, "asset").where((F.col("dt") >= F.col("a")) & (F.col("dt") <= F.col("b")))
    return during.groupBy("i", "dt").agg(F.avg("ret").alias("ret")).select("dt", "ret")


def totals(returns: DataFrame, key: str = "strategy") -> DataFrame:
    """(key, days, log_total): the whole growth of each key's returns as a logarithm."""
    return returns.groupBy(key).agg(F.count("*").alias("days"), F.sum(F.log1p("ret")).alias("log_total"))


def strategies(panel: DataFrame, benchmark: str, start: str, end: str, held: int = 3) -> DataFrame:
    """Returns by strategy and day: the first ``held`` assets by name held on, each quarter's leaders, all assets alike,
    and one asset as the benchmark."""
    rets = common_returns(panel).where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    first = panel.select("asset").distinct().orderBy("asset").limit(held)
    parts = {
        "hold_first": rets.join(first, "asset", "left_semi").groupBy("dt").agg(F.avg("ret").alias("ret")),
        "quarterly_leaders": quarterly_leaders(rets, start, end, held),
        "equal_weight": rets.groupBy("dt").agg(F.avg("ret").alias("ret")),
        "benchmark": rets.where(F.col("asset") == benchmark).select("dt", "ret"),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("strategy"), "dt", "ret")
        out = rows if out is None else out.unionByName(rows)
    return out


def trades(holdings: DataFrame) -> DataFrame:
    """(scenario, trades): how often each scenario's holdings (scenario, dt, holdings) change as a set, the first buy left out."""
    order = Window.partitionBy("scenario").orderBy("dt")
    rows = holdings.withColumn("_before", F.array_sort(F.lag("holdings").over(order)))
    return rows.groupBy("scenario").agg(F.count_if(F.col("_before").isNotNull() & (F.array_sort("holdings") != F.col("_before"))).alias("trades"))


def performance(returns: DataFrame) -> DataFrame:
    """(scenario, log_total, volatility, sharpe, max_drawdown) of daily returns (scenario, dt, ret)."""
    order = Window.partitionBy("scenario").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("_g", F.exp(F.sum(F.log1p("ret")).over(order))).withColumn("_d", F.col("_g") / F.max("_g").over(order) - 1)
    year = F.sqrt(F.lit(252))
    return rows.groupBy("scenario").agg(
        F.sum(F.log1p("ret")).alias("log_total"), (F.stddev_samp("ret") * year).alias("volatility"), F.try_divide(F.avg("ret") * 252, F.stddev_samp("ret") * year).alias("sharpe"), F.min("_d").alias("max_drawdown")
    )


def edges(returns: DataFrame, benchmark: DataFrame, periods: DataFrame) -> DataFrame:
    """(scenario, period, edge, max_drawdown, hit_rate) over each period: growth over the benchmark's, both as logarithms.
    ``returns``: scenario, dt, ret; ``benchmark``: dt, ret; ``periods``: period, a, b, a few rows."""
    both = returns.join(benchmark.select("dt", F.col("ret").alias("_b")), "dt").crossJoin(periods).where("dt between a and b")
    order = Window.partitionBy("scenario", "period").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_g", F.exp(F.sum(F.log1p("ret")).over(order))).withColumn("_d", F.col("_g") / F.max("_g").over(order) - 1)
    edge = F.sum(F.log1p("ret")) - F.sum(F.log1p("_b"))
    return rows.groupBy("scenario", "period").agg(edge.alias("edge"), F.min("_d").alias("max_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"))


def consistency(found: DataFrame) -> DataFrame:
    """A row per scenario: periods, share of positive edges, whether all are, mean edge, and edge over the worst drawdown."""
    rows = found.groupBy("scenario").agg(
        F.count("*").alias("periods"), F.avg((F.col("edge") > 0).cast("double")).alias("positive"), F.bool_and(F.col("edge") > 0).alias("always"),
        F.avg("edge").alias("mean_edge"), F.min("max_drawdown").alias("worst"),
    )
    return rows.select("scenario", "periods", "positive", "always", "mean_edge", F.try_divide("mean_edge", F.abs("worst")).alias("edge_over_drawdown"))
