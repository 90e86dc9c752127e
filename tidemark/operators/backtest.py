"""Walk-forward portfolio simulations as single plans.

Rankings as of all check dates come from one pass over the panel and an as-of join; a scenario's holdings come
from a fold over its few check dates; daily returns come from one join with the calendar. Parameters are columns, so
a grid of scenarios is one plan and not a loop.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import ranking, relational

CAPITAL = 100_000.0
HELD = 3


def days_between(first: Column, last: Column, every: Column) -> Column:
    """An array of ``first`` and each ``every`` days after it, before ``last``; none if there's no day between."""
    return F.when(first < last, F.sequence(first, F.date_sub(last, 1), F.make_interval(days=every))).otherwise(F.array().cast("array<date>"))


def check_dates(scenarios: DataFrame, start: str, end: str) -> DataFrame:
    """``scenarios`` (scenario, every and more) with dt: ``start``, and each ``every`` days after it before ``end``."""
    return scenarios.withColumn("dt", F.explode(days_between(F.lit(start).cast("date"), F.lit(end).cast("date"), F.col("every").cast("int"))))


def months_between(first: Column, last: Column) -> Column:
    """An array of the ends of months from that of ``first`` on, as far as whole months from ``first`` reach up to ``last``."""
    return F.transform(F.sequence(first, last, F.expr("interval 1 month")), lambda d: F.last_day(d))


def month_ends(start: str, end: str) -> Column:
    return F.explode(months_between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def rankings(panel: DataFrame, assets: DataFrame, dates: DataFrame) -> DataFrame:
    """(dt, every, asset, rank, score) for each check date and forecast window of ``dates``."""
    return ranking.as_of_rankings(panel, assets, dates)


def _tops(scenarios: DataFrame, ranks: DataFrame) -> DataFrame:
    """(scenario, dt, top): on each check date the best ``buffer`` assets in order."""
    rows = scenarios.join(ranks, ["dt", "every"]).where(F.col("rank") <= F.col("buffer"))
    tops = rows.groupBy("scenario", "dt").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "asset"))), lambda x: x["asset"]).alias("top"))
    return scenarios.select("scenario", "dt").join(tops, ["scenario", "dt"], "left").select("scenario", "dt", F.coalesce("top", F.array().cast("array<string>")).alias("top"))


def conditional_holdings(scenarios: DataFrame, ranks: DataFrame, held: int = HELD) -> DataFrame:
    """(scenario, dt, holdings) from each check date on: holdings that left the best ``buffer`` are replaced in the order
    of the ranking, survivors keep their places; nothing changes on a date without a ranking."""
    ordered = _tops(scenarios, ranks).groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct("dt", "top"))).alias("steps"))

    def step(acc: Column, x: Column) -> Column:
        state, top = acc["state"], x["top"]
        new = F.when(F.size(top) == 0, state).otherwise(F.slice(F.concat(F.array_intersect(state, top), F.array_except(top, state)), 1, held))
        return F.struct(new.alias("state"), F.concat(acc["log"], F.array(F.struct(x["dt"].alias("dt"), new.alias("holdings")))).alias("log"))

    zero = F.struct(F.array().cast("array<string>").alias("state"), F.array().cast("array<struct<dt: date, holdings: array<string>>>").alias("log"))
    log = F.aggregate("steps", zero, step)["log"]
    return ordered.select("scenario", F.explode(log).alias("x")).select("scenario", "x.dt", "x.holdings")


def daily_returns(holdings: DataFrame, panel: DataFrame, start: str, end: str) -> DataFrame:
    """(scenario, dt, ret): mean return from each day to the next of the holdings in force, over those with both days; 0 without any."""
    pairs = relational.next_day_pairs(panel).where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    days = pairs.select("dt").distinct().crossJoin(holdings.select("scenario").distinct())
    inforce = relational.as_of(days.select("scenario", "dt", F.lit(1).alias("day")), holdings, ["scenario"]).where("holdings is not null")
    rows = inforce.select("scenario", "dt", F.explode("holdings").alias("asset")).join(pairs.select("asset", "dt", "ret"), ["asset", "dt"], "left")
    return rows.groupBy("scenario", "dt").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("ret"))


def equity(returns: DataFrame, key: str = "scenario") -> DataFrame:
    """(scenario, dt, ret, value): the capital carried on by each day's return."""
    return returns.withColumn("value", S.growth("ret", key) * CAPITAL)


def buy_and_hold(panel: DataFrame, assets: DataFrame, start: str, end: str, held: int = HELD) -> DataFrame:
    """The best assets as of ``start``, held to ``end``: the mean of their own rows' returns on each day."""
    best = ranking.top_as_of(panel, assets, start, held).select("asset")
    rows = panel.withColumn("ret", S.simple_return()).where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("ret").isNotNull())
    daily = rows.join(best, "asset", "left_semi").groupBy("dt").agg(F.avg("ret").alias("ret"))
    return equity(daily.withColumn("scenario", F.lit("hold")))


def equal_weight_common(panel: DataFrame, names: list[str]) -> DataFrame:
    """Equal weights over the days on which all of ``names`` traded, from one common day to the next."""
    rows = panel.where(F.col("asset").isin(*names)).join(relational.common_days(panel, names), "dt", "left_semi")
    daily = rows.withColumn("ret", S.simple_return()).where("ret is not null").groupBy("dt").agg(F.avg("ret").alias("ret"))
    return equity(daily.withColumn("scenario", F.lit("equal")))


def scheduled(panel: DataFrame, assets: DataFrame, start: str, end: str, held: int = HELD) -> DataFrame:
    """At each month's end the best assets are held until the next one; own rows' returns."""
    dates = panel.sparkSession.range(1).select(month_ends(start, end).alias("dt"), F.lit(63).alias("every"))
    picks = rankings(panel, assets, dates).where(F.col("rank") <= held).groupBy("dt").agg(F.collect_list("asset").alias("holdings")).withColumn("scenario", F.lit("scheduled"))
    rows = panel.withColumn("ret", S.simple_return()).where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("ret").isNotNull())
    days = rows.select("dt").distinct().withColumn("scenario", F.lit("scheduled")).withColumn("day", F.lit(1))
    inforce = relational.as_of(days, picks, ["scenario"]).where("holdings is not null").select("dt", F.explode("holdings").alias("asset"))
    daily = rows.join(inforce, ["asset", "dt"]).groupBy("dt").agg(F.avg("ret").alias("ret"))
    return equity(daily.withColumn("scenario", F.lit("scheduled")))


def _choices(top: list[str], state: list[str], replace: Callable[[str, list[str]], str | None], held: int) -> list[str]:
    chosen: list[str] = []
    for own in state:
        new = None if own in top[:held] else replace(own, chosen)
        chosen.append(new or own)
    chosen = list(dict.fromkeys(chosen))
    return (chosen + [a for a in top if a not in chosen])[:held]


def signal_holdings(ranks: DataFrame, signals: DataFrame, stressed: DataFrame, buffer: int = 20, held: int = HELD) -> DataFrame:
    """(scenario, dt, holdings) by interval signals: in a stressed market nothing changes; a holding outside the best
    ``held`` whose own signal isn't ROTATE gives way to the first of those that rotates and isn't chosen yet.

    ``ranks``: dt, asset, rank; ``signals``: dt, asset, signal; ``stressed``: dt, stressed. A scenario has a row per
    check date and ranked asset, which one group holds."""
    rows = ranks.where(F.col("rank") <= buffer).join(signals, ["dt", "asset"], "left").join(stressed, "dt", "left").withColumn("scenario", F.lit("signals"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        state, log = [], []
        for dt, day in frame.sort_values(["dt", "rank"]).groupby("dt"):
            top, signal = day["asset"].tolist(), dict(zip(day["asset"], day["signal"], strict=True))
            if not state:
                state = top[:held]
            elif not bool(day["stressed"].iloc[0]):
                rotating = [a for a in top[:held] if signal.get(a) == "ROTATE"]

                def replace(own: str, chosen: list[str], rotating=rotating, signal=signal, state=state) -> str | None:
                    if signal.get(own, "WAIT") not in ("HOLD", "WAIT"):
                        return None
                    return next((a for a in rotating if a not in chosen and a not in state), None)

                state = _choices(top, state, replace, held)
            log.append({"scenario": "signals", "dt": dt, "holdings": list(state)})
        return pd.DataFrame(log, columns=["scenario", "dt", "holdings"])

    return rows.select("scenario", "dt", "asset", "rank", "signal", "stressed").groupBy("scenario").applyInPandas(run, "scenario string, dt date, holdings array<string>")


def volatility_holdings(ranks: DataFrame, calm: DataFrame, held: int = HELD, candidates: int = 5) -> DataFrame:
    """(scenario, dt, holdings) by market volatility: on days that aren't ``calm`` (dt, calm) all holdings outside the best
    ``held`` give way to the first of the best ``candidates`` that isn't chosen yet."""
    rows = ranks.where(F.col("rank") <= 20).join(calm, "dt", "left").withColumn("scenario", F.lit("volatility"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        state, log = [], []
        for dt, day in frame.sort_values(["dt", "rank"]).groupby("dt"):
            top = day["asset"].tolist()
            if not state:
                state = top[:held]
            elif bool(day["calm"].iloc[0]):
                state = _choices(top, state, lambda own, chosen, top=top, state=state: next((a for a in top[:candidates] if a not in chosen and a not in state), None), held)
            log.append({"scenario": "volatility", "dt": dt, "holdings": list(state)})
        return pd.DataFrame(log, columns=["scenario", "dt", "holdings"])

    return rows.select("scenario", "dt", "asset", "rank", "calm").groupBy("scenario").applyInPandas(run, "scenario string, dt date, holdings array<string>")


def forecasts(panel: DataFrame, least: int = 100) -> DataFrame:
    """(asset, forecast, confidence): the closed form of a model fitted on its own last row: the sum of the last 20 returns
    in per cent, within ten, with confidence 0.9; 0 and 0.5 with fewer than ``least`` rows."""
    rows = panel.withColumn("ret", S.simple_return()).withColumn("s", F.sum("ret").over(S.last(20)))
    found = rows.groupBy("asset").agg(F.count("*").alias("n"), F.max_by("s", "dt").alias("s"))
    enough = F.col("n") >= least
    value = F.greatest(F.lit(-0.1), F.least(F.lit(0.1), F.col("s"))) * 100
    return found.select("asset", F.when(enough, value).otherwise(0.0).alias("forecast"), F.when(enough, 0.9).otherwise(0.5).alias("confidence"))


def walk_forward_hits(panel: DataFrame, train: int = 120, test: int = 20, every: int = 15, least: int = 3) -> DataFrame:
    """(asset, windows, hit_rate): how often the sum of the last 20 learning returns has the sign of the test's; null with
    fewer than ``least`` windows."""
    rows = panel.withColumn("ret", S.simple_return()).withColumn("rn", F.row_number().over(S.by_asset())).withColumn("n", F.count("*").over(Window.partitionBy("asset")))
    rows = rows.withColumn("_s", F.sum("ret").over(S.last(20))).withColumn("_a", F.sum("ret").over(S.last(test - 1)))
    rows = rows.withColumn("hit", (F.signum(S.ago("_s", test)) == F.signum("_a")).cast("double"))
    ends = rows.where((F.col("rn") >= train) & ((F.col("rn") - train) % every == 0) & (F.col("rn") < F.col("n") - test))
    return ends.groupBy("asset").agg(F.count("*").alias("windows"), F.when(F.count("*") >= least, F.avg("hit")).alias("hit_rate"))
