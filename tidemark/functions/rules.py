"""Scalar rules as columns: decisions, ladders and text classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_weight(value: Column, lower: Column, upper: Column) -> Column:
    """How far a value lies outside an interval, as a weight: 0 inside, then 0.3, 0.7 and 1 by relative distance."""
    gap = F.when(value < lower, lower - value).when(value > upper, value - upper).otherwise(0.0)
    bound = F.abs(F.when(value < lower, lower).otherwise(upper))
    relative = F.when(bound == 0, gap).otherwise(F.try_divide(gap, bound))
    return F.when(gap == 0, 0.0).when(relative <= 0.10, 0.3).when(relative <= 0.20, 0.7).otherwise(1.0)


def rotation_decision(weight: Column) -> Column:
    return F.when(weight < 0.5, "HOLD").when(weight <= 1.5, "WAIT").otherwise("ROTATE")


def rotation_rule(signal: Column, stressed: Column) -> Column:
    """HOLD in a stressed market; else rotate on ROTATE or without an interval."""
    return F.when(stressed, "HOLD").when(F.coalesce(signal, F.lit("NO_CI")).isin("ROTATE", "NO_CI"), "ROTATE").otherwise("HOLD")


#: Hours after its last bar in which a series counts as alive, and what is added for a weekend and for holidays.
MOST_HOURS, WEEKEND_HOURS, HOLIDAY_HOURS = 24, 48, 4


def activity_bound(last: Column, now: Column) -> Column:
    """The hours that may have passed since a series' last bar, by the weekdays of now and of then (0 is Monday)."""
    day, then = F.weekday(now), F.weekday(last)
    earlier = F.datediff(now, last) >= 1
    weekend = MOST_HOURS + WEEKEND_HOURS + HOLIDAY_HOURS
    monday = F.when(then == 5, weekend).when(then == 4, weekend + 24).otherwise(MOST_HOURS + 48)
    sunday = F.when(then == 5, weekend).otherwise(MOST_HOURS + 24)
    saturday = F.when(then == 4, 72).otherwise(MOST_HOURS + 12)
    friday = F.when(earlier, MOST_HOURS + 24 + HOLIDAY_HOURS).otherwise(MOST_HOURS + 8)
    thursday = F.when(earlier, MOST_HOURS + 16).otherwise(MOST_HOURS + 4)
    other = F.when(earlier, MOST_HOURS + 12).otherwise(MOST_HOURS)
    return F.when(day == 0, monday).when(day == 6, sunday).when(day == 5, saturday).when(day == 4, friday).when(day == 3, thursday).otherwise(other)


def activity(last: Column, now: Column) -> Column:
    """Whether a series is alive: the time since its last bar, to the microsecond, against ``activity_bound``."""
    allowed = activity_bound(last, now) * F.lit(3_600_000_000)
    return F.when(last.isNull(), "missing").when(F.timestamp_diff("MICROSECOND", last, now) <= allowed, "active").otherwise("stale")


def activity_reason(last: Column, now: Column) -> Column:
    """"active", or why a series isn't."""
    hours = F.floor(F.timestamp_diff("SECOND", last, now) / 3600).cast("string")
    late = F.concat(F.lit("inactive: "), hours, F.lit(" h since its last bar, "), activity_bound(last, now).cast("string"), F.lit(" allowed"))
    return F.when(last.isNull(), "inactive: no price data").when(activity(last, now) == "active", "active").otherwise(late)


#: The region of a listing by its suffix; none is the United States.
REGIONS = {
    "-HK": "Hong Kong", "-US": "United States", "-CA": "Canada", "-GB": "United Kingdom", "-IN": "India", "-JP": "Japan", "-JKT": "Indonesia", "-PH": "Philippines", "-AU": "Australia",
    "-TH": "Thailand", "-NZ": "New Zealand", "-ZA": "South Africa", "-SG": "Singapore", "-SE": "Sweden", "-CN": "China", "-BM": "Bermuda", "-NE": "Canada", "-BR": "Brazil", "-DE": "Germany",
    "-FR": "France", ".AX": "Australia", ".L": "United Kingdom", ".TO": "Canada", ".HK": "Hong Kong", ".T": "Japan", ".DE": "Germany", ".PA": "France", ".SI": "Singapore", ".NZ": "New Zealand",
}


def region_of(code: Column, default: str = "United States") -> Column:
    """The region of a listing by what follows its last dash, or its last dot if it has no dash."""
    known = F.create_map(*(F.lit(x) for pair in REGIONS.items() for x in pair))
    dash, dot = (F.concat(F.lit(c), F.substring_index(code, c, -1)) for c in "-.")
    return F.coalesce(known[F.when(F.contains(code, F.lit("-")), dash).when(F.contains(code, F.lit(".")), dot)], F.lit(default))


def sector_of(name: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The sector of the first keyword that a name contains, regardless of case; OTHER without any."""
    low = F.lower(name)
    return F.coalesce(*(F.when(low.contains(word), sector) for word, sector in rules), F.lit("OTHER"))


def quality_flag(hit_rate: Column, confidence: Column) -> Column:
    """How far a forecast can be trusted."""
    good, fair = (hit_rate > 0.65) & (confidence > 0.7), (hit_rate > 0.55) & (confidence > 0.5)
    return F.when(good, "EXCELLENT").when(fair, "FAIR").when((hit_rate < 0.45) | (confidence < 0.15), "POOR").otherwise("WARNING")


def asset_group(kind: Column, region: Column) -> Column:
    """The group of an asset by its type and region."""
    home = (region == "AUSTRALIA") & kind.isin("broad_market", "growth")
    return F.when(kind == "bond", "Bonds").when(kind == "commodity", "Commodities").when(home, "Australian_Equity").otherwise("International_Equity")


def clean_name(text: Column) -> Column:
    """A name without what stands in brackets and without anything but letters and spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", ""), "[^A-Za-z ]+", " "))


def shortened(text: Column, most: int = 50) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
