"""Overlay scores of the market's state from external series: macro, geopolitical, and both.

``series`` has name, dt, value. ``features`` brings what the scores need of each series (last values, changes, means,
volatilities) into one row by one aggregation; every score is arithmetic on that row. Scores speak of roles (the market,
high yield, oil); which series plays which role is a parameter, so any set of series will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S

CHANGES, PLACES, MEANS, WINDOWS = (20, 30, 60), (1, 3, 6, 12, 30, 60, 72), (20, 50), (30, 252)

Role = Callable[[str, str], Column]


def features(series: DataFrame, names: list[str]) -> DataFrame:
    """One row with, for each name: its value at places from the end, changes in per cent (0 if it is too short), means and
    yearly volatilities of full windows, the year's high, and its length."""
    rows = series.where(F.col("name").isin(*names)).withColumn("_ret", S.simple_return("value", key="name"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("dt"))))
    value, k = F.col("value"), F.col("_k")
    columns = []
    for n in names:
        own = F.col("name") == n

        def at(place: int, own: Column = own) -> Column:
            return F.max(F.when(own & (k == place), value))

        def full(f: Callable[[Column], Column], x: str, w: int, own: Column = own) -> Column:
            inside = F.when(own & (k <= w), F.col(x))
            return F.when(F.count(inside) == w, f(inside))

        columns += [at(p).alias(f"{n}_at{p}") for p in PLACES]
        columns += [F.coalesce((F.try_divide(at(1), at(c + 1)) - 1) * 100, F.lit(0.0)).alias(f"{n}_pc{c}") for c in CHANGES]
        columns += [full(F.avg, "value", w).alias(f"{n}_ma{w}") for w in MEANS]
        columns += [(full(F.stddev_samp, "_ret", w) * F.sqrt(F.lit(S.TRADING_DAYS)) * 100).alias(f"{n}_vol{w}") for w in WINDOWS]
        columns += [full(F.max, "value", 252).alias(f"{n}_top"), F.count_if(own).alias(f"{n}_n")]
    return rows.agg(*columns)


def normal(value: Column, centre: float, scale: float) -> Column:
    """A value as a score of 0 to 100 round a centre."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), centre + value / scale * 50))


def _mean(*values: Column) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total / len(values)


def _excess(x: Role, role: str) -> Column:
    """How far the short volatility stands above the long one, in per cent; 0 without a long one."""
    return F.coalesce((F.try_divide(x(role, "vol30"), F.when(x(role, "vol252") > 0, x(role, "vol252"))) - 1) * 100, F.lit(0.0))


# Macro.


def credit_spreads(x: Role) -> Column:
    now, before = x("long_bonds", "pc30") - x("high_yield", "pc30"), x("long_bonds", "pc60") - x("high_yield", "pc60")
    widening = F.coalesce((F.try_divide(now, before) - 1) * 100, F.lit(0.0))
    return 0.70 * normal(now, 50, 5) + 0.30 * normal(widening, 50, 50)


def dollar_strength(x: Role) -> Column:
    """Momentum; the acceleration part looks back over too few rows to be anything but neutral."""
    return 0.75 * normal(0.60 * x("dollar", "pc20") + 0.40 * x("dollar", "pc60"), 50, 3) + 0.25 * F.lit(50.0)


def yield_curve(x: Role) -> Column:
    points = (x("ten_year", "at1") - x("two_year", "at1")) * 100
    turn = points - (x("ten_year", "at30") - x("two_year", "at30")) * 100
    steep = F.when(points > 100, 25 + F.least(F.lit(75.0), (points - 100) / 2)).when(points > 0, 25 + points / 100 * 25).otherwise(F.greatest(F.lit(0.0), 25 + points / 2))
    return F.when((x("ten_year", "n") < 30) | (x("two_year", "n") < 30), 50.0).otherwise(0.70 * steep + 0.30 * normal(turn, 50, 25))


def systematic_risk(x: Role) -> Column:
    return 0.40 * credit_spreads(x) + 0.35 * dollar_strength(x) + 0.25 * yield_curve(x)


SECTORS = ("financials", "industrials", "consumer", "energy", "technology", "health", "utilities", "staples")


def sector_rotation(x: Role) -> Column:
    """Which part of the cycle leads, and how far leaders and laggards are apart; ties in the order of SECTORS."""
    order = F.array_sort(F.array(*(F.struct((-x(s, "pc20")).alias("v"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SECTORS))))
    leaders = F.transform(F.slice(order, 1, 3), lambda e: e["s"])

    def leads(*names: str) -> Column:
        return F.arrays_overlap(leaders, F.array(*map(F.lit, names)))

    phase = F.when(leads("financials", "industrials"), 75.0).when(leads("technology", "consumer"), 60.0).when(leads("energy"), 50.0).otherwise(25.0)
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, e: a - e["v"]) / 3
    return 0.75 * phase + 0.25 * normal(total(F.slice(order, 1, 3)) - total(F.slice(order, -3, 3)), 0, 10)


def growth_momentum(x: Role) -> Column:
    activity = normal(x("industrials", "pc60") - x("market", "pc60"), 50, 5)
    cyclical, defensive = (_mean(*(x(s, "pc60") for s in names)) for names in (("industrials", "consumer", "financials"), ("utilities", "health", "staples")))
    return 0.45 * activity + 0.35 * normal(cyclical - defensive, 50, 5) + 0.20 * sector_rotation(x)


def real_rates(x: Role) -> Column:
    rate = x("ten_year", "at1") - (x("prices", "at1") / x("prices", "at12") - 1) * 100
    before = x("ten_year", "at60") - (x("prices", "at60") / x("prices", "at72") - 1) * 100
    change = F.when(x("prices", "n") > 72, rate - before).otherwise(0.0)
    level = F.when(rate < -1, F.greatest(F.lit(0.0), 50 - (rate + 1) / 2 * 50)).when(rate < 2, 50 - rate / 2 * 25).otherwise(F.greatest(F.lit(0.0), 25 - (rate - 2) / 3 * 25))
    return F.when(x("prices", "n") < 12, 50.0).otherwise(0.70 * level + 0.30 * normal(-change, 50, 0.5))


def inflation_path(x: Role) -> Column:
    year = (x("prices", "at1") / x("prices", "at12") - 1) * 100
    level = F.when(year < 0, 85.0).when(year < 2, 75.0).when(year < 4, 50.0).when(year < 6, 30.0).otherwise(15.0)
    turn = (x("prices", "at1") / x("prices", "at3") - 1) * 400 - (x("prices", "at3") / x("prices", "at6") - 1) * 400
    return F.when(x("prices", "n") < 12, 50.0).otherwise(0.70 * level + 0.30 * normal(-turn, 50, 2))


def policy_stance(x: Role) -> Column:
    now = x("policy_rate", "at1")
    short, long = (F.when(x("policy_rate", "n") > n, now - x("policy_rate", f"at{n}")).otherwise(0.0) for n in (3, 6))
    base = F.when(short < -0.25, 75.0).when(short > 0.25, 25.0).when(now < 2, 65.0).when(now > 4, 35.0).otherwise(50.0)
    return F.when(x("policy_rate", "n") < 6, 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - (long - short) * 10)))


def monetary_policy(x: Role) -> Column:
    return 0.45 * real_rates(x) + 0.30 * inflation_path(x) + 0.25 * policy_stance(x)


#: Weights of systematic risk, growth, policy and the regime itself.
REGIMES = {"CRISIS": (0.45, 0.25, 0.20, 0.10), "GOLDILOCKS": (0.20, 0.40, 0.25, 0.15), "TRANSITIONAL": (0.35, 0.30, 0.25, 0.10)}


def macro(series: DataFrame, roles: dict[str, str]) -> DataFrame:
    """One row: the three factors, the regime and its score, the composite by the regime's weights, and a multiplier."""
    x = lambda role, what: F.col(f"{roles[role]}_{what}")
    rows = features(series, sorted(set(roles.values()))).select(systematic_risk(x).alias("systematic"), growth_momentum(x).alias("growth"), monetary_policy(x).alias("policy"))
    risk, growth, policy = map(F.col, ("systematic", "growth", "policy"))
    crisis = (risk > 60) | (growth < 30) | (risk > 50) & (growth < 40)
    golden = (risk < 40) & (growth > 60) & (policy > 55)
    rows = rows.withColumn("regime", F.when(crisis, "CRISIS").when(golden, "GOLDILOCKS").otherwise("TRANSITIONAL"))
    regime = F.col("regime")
    rows = rows.withColumn("regime_score", F.when(regime == "CRISIS", F.greatest(F.lit(0.0), 30 - growth / 3)).when(regime == "GOLDILOCKS", F.least(F.lit(100.0), 70 + (growth - 60) / 2)).otherwise(50.0))

    def weight(i: int) -> Column:
        return F.when(regime == "CRISIS", REGIMES["CRISIS"][i]).when(regime == "GOLDILOCKS", REGIMES["GOLDILOCKS"][i]).otherwise(REGIMES["TRANSITIONAL"][i])

    rows = rows.withColumn("composite", weight(0) * risk + weight(1) * growth + weight(2) * policy + weight(3) * F.col("regime_score"))
    return rows.withColumn("multiplier", 0.75 + F.col("composite") / 100 * 0.5)


# Geopolitical.


def tension(x: Role) -> Column:
    chips = normal(_mean(x("chip_rival", "pc30"), x("chip_rival_2", "pc30")) - x("chip_maker", "pc30"), 50, 8)
    discount = normal(_mean(x("peer", "pc30"), x("peer_2", "pc30")) - x("island", "pc30"), 0, 5)
    defence = normal(_mean(x("defence", "pc30"), x("defence_2", "pc30"), x("defence_3", "pc30")) - x("market", "pc30"), 50, 5)
    return 0.40 * chips + 0.30 * (0.60 * discount + 0.40 * normal(_excess(x, "island"), 0, 50)) + 0.30 * defence


def fear(x: Role) -> Column:
    v = x("fear", "at1")
    level = F.when(v < 16, v / 16 * 30).when(v < 20, 30 + (v - 16) / 4 * 20).when(v < 30, 50 + (v - 20) / 10 * 30).otherwise(F.least(F.lit(100.0), 80 + (v - 30) / 10 * 20))
    spike = F.coalesce((F.try_divide(v, F.when(x("fear", "ma20") > 0, x("fear", "ma20"))) - 1) * 100, F.lit(0.0))
    return 0.60 * level + 0.40 * F.least(F.lit(100.0), F.greatest(F.lit(0.0), spike * 2))


def safe_havens(x: Role) -> Column:
    return 0.60 * normal(x("gold", "pc30") - x("market", "pc30"), 50, 5) + 0.40 * normal(x("long_bonds", "pc30"), 50, 3)


def energy_shocks(x: Role) -> Column:
    spike = F.coalesce((F.try_divide(x("oil", "at1"), F.when(x("oil", "ma50") > 0, x("oil", "ma50"))) - 1) * 100, F.lit(0.0))
    odd = F.abs(x("sea_oil", "at1") - x("oil", "at1") - 5.0)
    return 0.40 * normal(spike, 50, 15) + 0.30 * normal(odd, 0, 10) + 0.30 * normal(_excess(x, "gas"), 0, 50)


def conflict(x: Role) -> Column:
    return 0.30 * fear(x) + 0.40 * safe_havens(x) + 0.30 * energy_shocks(x)


def trade(x: Role) -> Column:
    exposed = x("market", "pc30") - _mean(x("industrials", "pc30"), x("consumer", "pc30"), x("retail", "pc30"))
    sheltered = _mean(x("health", "pc30"), x("utilities", "pc30")) - x("market", "pc30")
    apart = normal(x("market", "pc60") - x("rival_market", "pc60"), 50, 10)
    held_down = F.greatest(F.lit(0.0), F.coalesce(x("currency", "vol252") - x("currency", "vol30"), F.lit(0.0)))
    money = 0.70 * normal((x("currency", "at1") - 7.0) / 7.0 * 100, 50, 5) + 0.30 * normal(held_down, 0, 2)
    return 0.35 * normal(0.60 * exposed + 0.40 * sheltered, 50, 5) + 0.35 * apart + 0.30 * money


def financial_stress(x: Role) -> Column:
    slope = x("ten_year", "at1") - x("two_year", "at1")
    inverted = F.when(slope < 0, F.least(F.lit(100.0), F.abs(slope) * 100)).otherwise(0.0)
    fall = F.least(F.lit(100.0), F.coalesce(F.abs((x("market", "at1") / x("market", "top") - 1) * 100 / 20) * 100, F.lit(100.0)))
    return 0.40 * inverted + 0.35 * fall + 0.25 * normal(x("market", "pc60") - x("industrials", "pc60"), 50, 10)


def energy_security(x: Role) -> Column:
    strait = F.least(F.lit(100.0), F.abs(x("sea_oil", "at1") - x("oil", "at1") - 4.0) / 8.0 * 100)
    return 0.40 * normal(x("market", "pc30") - x("continent", "pc30"), 50, 5) + 0.35 * strait + 0.25 * normal(_excess(x, "energy"), 0, 50)


PILLARS = {"tension": (0.30, tension), "conflict": (0.25, conflict), "trade": (0.20, trade), "stress": (0.15, financial_stress), "security": (0.10, energy_security)}


def geopolitical(series: DataFrame, roles: dict[str, str]) -> DataFrame:
    """One row: five pillars, their composite and its level."""
    x = lambda role, what: F.col(f"{roles[role]}_{what}")
    rows = features(series, sorted(set(roles.values()))).select(*(f(x).alias(n) for n, (_, f) in PILLARS.items()))
    total = F.lit(0.0)
    for n, (w, _) in PILLARS.items():
        total = total + w * F.col(n)
    rows = rows.withColumn("composite", total)
    c = F.col("composite")
    return rows.withColumn("level", F.when(c < 20, "LOW").when(c < 35, "MODERATE").when(c < 50, "HIGH").when(c < 65, "SEVERE").otherwise("EXTREME"))


def combined(series: DataFrame, roles: dict[str, str]) -> DataFrame:
    """One row: both composites and what to do: the most cautious where the economy is in crisis and the world severe,
    cautious where either is so or the world is at high risk, bold where all is well, balanced otherwise."""
    a = macro(series, roles).select(F.col("composite").alias("macro"), "regime")
    b = geopolitical(series, roles).select(F.col("composite").alias("geo"), "level")
    crisis, level = F.col("regime") == "CRISIS", F.col("level")
    advice = F.when(crisis & level.isin("SEVERE", "EXTREME"), "MAXIMUM DEFENSE").when(crisis | level.isin("HIGH", "SEVERE", "EXTREME"), "DEFENSIVE")
    advice = advice.when((F.col("regime") == "GOLDILOCKS") & (level == "LOW"), "AGGRESSIVE").otherwise("BALANCED")
    return a.crossJoin(b).withColumn("advice", advice)  # one row each
