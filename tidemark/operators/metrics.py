"""Metrics of each asset: behaviour of recent returns, performance of a return series, liquidity, data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scans
from tidemark.functions import series as S
from tidemark.session import written


def behaviour(panel: DataFrame) -> DataFrame:
    """The panel with ret, hit_rate, conviction and stability as of each day, in one sort per asset.

    hit_rate: share of the last 100 returns above zero; 0 with fewer. conviction: mean of the last 10 over the size of
    the mean of the last 40; 0 with fewer than 40 or a mean of zero. stability: 1 / (1 + 10 deviations of the last
    30); 0 with fewer.
    """
    rows = panel.withColumn("ret", S.simple_return())

    def enough(n: int, value: Column) -> Column:
        return F.coalesce(F.when(F.count("ret").over(S.so_far()) >= n, value), F.lit(0.0))

    up = F.when(F.col("ret") > 0, 1.0).when(F.col("ret").isNotNull(), 0.0)
    return rows.withColumns({
        "hit_rate": enough(100, F.avg(up).over(S.last(100))),
        "conviction": enough(40, F.try_divide(F.avg("ret").over(S.last(10)), F.abs(F.avg("ret").over(S.last(40))))),
        "stability": enough(30, 1 / (1 + 10 * F.stddev_samp("ret").over(S.last(30)))),
    })


def newest(panel: DataFrame) -> DataFrame:
    """Each asset's newest row of ``panel`` with what ``behaviour`` says of it, and history (closes so far) and recent (sum
    of the last 63 returns, 0 without any): what is looked at is each asset's last hundred rows, in one sort."""
    back = Window.partitionBy("asset").orderBy(F.desc("dt"))
    rows = panel.withColumns({"ret": F.try_divide(F.col("close"), F.lead("close").over(back)) - 1, "_k": F.row_number().over(back)})
    whole = Window.partitionBy("asset")
    rows = rows.withColumns({"_n": F.count("ret").over(whole), "history": F.count("close").over(whole)}).where("_k <= 100")

    def last(n: int, value: Column) -> Column:
        return F.when(F.col("_k") <= n, value)

    def enough(n: int, value: Column) -> Column:
        return F.coalesce(F.when(F.max("_n") >= n, value), F.lit(0.0))

    ret = F.col("ret")
    up = F.when(ret > 0, 1.0).when(ret.isNotNull(), 0.0)
    own = [c for c in panel.columns if c != "asset"]
    found = rows.groupBy("asset").agg(
        F.min_by(F.struct(*own, "ret"), "_k").alias("_row"),
        F.max("history").alias("history"),
        F.coalesce(F.sum(last(63, ret)), F.lit(0.0)).alias("recent"),
        enough(100, F.avg(up)).alias("hit_rate"),
        enough(40, F.try_divide(F.avg(last(10, ret)), F.abs(F.avg(last(40, ret))))).alias("conviction"),
        enough(30, 1 / (1 + 10 * F.stddev_samp(last(30, ret)))).alias("stability"),
    )
    return found.select("asset", "_row.*", "hit_rate", "conviction", "stability", "history", "recent")


def equity(panel: DataFrame) -> DataFrame:
    """``panel`` (asset, dt, close; a written table) with ret, growth and drawdown of each day since the series' first.
    Products and maxima are carried from period to period, so a long series is dealt over tasks."""
    period = scans.period_of()
    rows = scans.prefixes(panel, ["asset"], ["dt"], period, {"_before": ("previous", "close")}).withColumn("ret", F.try_divide("close", "_before") - 1)
    rows = written(rows.drop("_before").withColumn("_change", 1 + F.coalesce("ret", F.lit(0.0))), "returns")
    rows = written(scans.prefixes(rows, ["asset"], ["dt"], period, {"growth": ("product", "_change")}).drop("_change"), "growth")
    rows = scans.prefixes(rows, ["asset"], ["dt"], period, {"_top": ("max", "growth")})
    return rows.withColumn("drawdown", F.col("growth") / F.col("_top") - 1).drop("_top")


def backtest_score() -> Column:
    """Score of a candidate: hit rate, a squashed conviction and stability, times ten."""
    squashed = 1 / (1 + F.exp(-F.col("conviction")))
    return (0.35 * F.col("hit_rate") + 0.40 * squashed + 0.25 * F.col("stability")) * 10


def quality_score() -> Column:
    return 0.40 * F.col("conviction") + 0.35 * F.col("hit_rate") + 0.15 * F.col("stability")


def performance(returns: DataFrame, key: str = "asset") -> DataFrame:
    """Total and annual return, volatility, Sharpe ratio, greatest drawdown and hit rate of each series of (key, dt, ret)."""
    rows = returns.withColumn("_growth", S.growth("ret", key)).withColumn("_down", S.drawdown("_growth", key))
    found = rows.groupBy(key).agg(
        (F.max_by("_growth", "dt") - 1).alias("total"), (F.pow(1 + F.avg("ret"), S.TRADING_DAYS) - 1).alias("annual"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(S.TRADING_DAYS))).alias("volatility"), F.min("_down").alias("max_drawdown"),
        F.avg(F.when(F.col("ret") > 0, 1.0).when(F.col("ret").isNotNull(), 0.0)).alias("hit_rate"),
    )
    sharpe = F.when(F.col("volatility") > 0, F.col("annual") / F.col("volatility")).otherwise(0.0)
    return found.withColumn("sharpe", sharpe)


def sharpe_variants(returns: DataFrame, risk_free: float = 0.0435, key: str = "asset") -> DataFrame:
    """Three usual Sharpe ratios: of annualised means, of daily ones, and above a risk-free rate."""
    mean, sd = F.avg("ret"), F.stddev_samp("ret")
    year, root = F.lit(S.TRADING_DAYS), F.sqrt(F.lit(S.TRADING_DAYS))
    return returns.groupBy(key).agg(
        F.try_divide(mean * year, sd * root).alias("annualised"), (F.try_divide(mean, sd) * root).alias("daily"),
        F.try_divide(mean * year - risk_free, sd * root).alias("above_risk_free"),
    )


def liquidity(panel: DataFrame, days: int = 60, least: int = 30) -> DataFrame:
    """Mean volume and days without any of the last ``days``, and price impact per volume of the last ``days`` valid rows."""
    rows = panel.withColumn("ret", S.simple_return()).withColumn("_k", S.from_end())
    valid = (F.col("volume") > 0) & (F.col("close") > 0) & F.col("ret").isNotNull()
    rows = rows.withColumn("_valid", valid)
    rows = rows.withColumn("_v", F.when(F.col("_valid"), F.row_number().over(Window.partitionBy("asset", "_valid").orderBy(F.desc("dt")))))
    recent, use = F.col("_k") <= days, F.col("_v") <= days
    impact = F.avg(F.when(use, F.try_divide(F.abs("ret"), F.col("close") * F.col("volume")))) * 1e6
    found = rows.groupBy("asset").agg(
        F.avg(F.when(recent, F.col("volume"))).alias("mean_volume"), F.count_if(recent & (F.col("volume") == 0)).alias("zero_days"),
        F.count_if(use).alias("_n"), impact.alias("impact"),
    )
    return found.withColumn("impact", F.when(F.col("_n") > least, F.col("impact"))).drop("_n")


#: Years of rows that a tier needs, and what forecasts on it are cut by.
TIERS = ((3, "tier_1", 0.0), (2, "tier_2", -2.0), (1, "tier_3", -5.0), (0, "tier_4", -10.0))


def quality_tier(years: Column) -> tuple[Column, Column]:
    """The tier of a history of so many years, and its penalty."""
    tier = penalty = None
    for least, name, cut in TIERS:
        tier = F.when(years >= least, name) if tier is None else tier.when(years >= least, name)
        penalty = F.when(years >= least, cut) if penalty is None else penalty.when(years >= least, cut)
    return tier, penalty


def data_quality(panel: DataFrame) -> DataFrame:
    """Rows, years, share of rows with a close, tier by years and its penalty, and a score of both, full at five years."""
    years = F.col("rows") / S.TRADING_DAYS
    found = panel.groupBy("asset").agg(F.count("*").alias("rows"), F.count("close").alias("closes"))
    tier, penalty = quality_tier(years)
    complete = F.col("closes") / F.col("rows")
    score = F.least(F.lit(1.0), years / 5 * complete)
    return found.select("asset", "rows", years.alias("years"), complete.alias("completeness"), tier.alias("tier"), penalty.alias("penalty"), score.alias("score"))


def quarters(panel: DataFrame) -> DataFrame:
    """The last close of each quarter from an asset's first to its last, empty ones with null, and the change in per cent."""
    ends = panel.groupBy("asset", F.trunc("dt", "quarter").alias("quarter")).agg(F.max_by("close", "dt").alias("close"))
    span = ends.groupBy("asset").agg(F.sequence(F.min("quarter"), F.max("quarter"), F.expr("interval 3 months")).alias("q"))
    every = span.select("asset", F.explode("q").alias("quarter"))
    order = Window.partitionBy("asset").orderBy("quarter")
    rows = every.join(ends, ["asset", "quarter"], "left")
    change = (F.try_divide(F.col("close"), F.lag("close").over(order)) - 1) * 100
    return rows.select("asset", "quarter", "close", change.alias("change"))


def sector_wins(changes: DataFrame, sectors: DataFrame, history: DataFrame, least: int = 500) -> DataFrame:
    """Share of quarters in which an asset beat its sector's median; a quarter without a change of its own is lost. Assets
    with fewer than ``least`` rows (``history``: asset, rows) have none, but count in their sector's median."""
    long = history.where(F.col("rows") >= least).select("asset")
    rows = changes.join(sectors.select("asset", "sector"), "asset")
    medians = rows.where("change is not null").groupBy("sector", "quarter").agg(F.median("change").alias("median"))
    first = Window.partitionBy("asset").orderBy("quarter")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n > 1").join(medians, ["sector", "quarter"]).join(long, "asset", "left_semi")
    return rows.groupBy("asset").agg(F.avg(F.coalesce((F.col("change") > F.col("median")).cast("double"), F.lit(0.0))).alias("wins"), F.count("*").alias("quarters"))


def short_stability(panel: DataFrame, days: int = 60, least: int = 20) -> DataFrame:
    """Calm of the last ``days`` rows: low volatility, few changes of trend, small moves; 0 with fewer than ``least``."""
    recent = panel.withColumn("_k", S.from_end()).where(F.col("_k") <= days)
    rows = recent.withColumn("ret", S.simple_return()).withColumn("_move", F.abs(F.col("close") - S.ago("close", 1)))
    rows = rows.withColumn("_up", F.coalesce((S.sma("close", 5) > S.sma("close", 20)).cast("int"), F.lit(0)))
    rows = rows.withColumn("_turn", F.abs(F.col("_up") - S.ago("_up", 1)))
    found = rows.groupBy("asset").agg(
        F.count("*").alias("n"), (F.stddev_samp("ret") * F.sqrt(F.lit(S.TRADING_DAYS))).alias("vol"), F.coalesce(F.sum("_turn"), F.lit(0)).alias("turns"),
        F.avg("_move").alias("move"), F.min_by("close", "dt").alias("first"),
    )

    def share(x: Column) -> Column:
        return F.greatest(F.lit(0.0), 1 - x)

    calm = 0.4 * share(F.col("vol") / 0.5) + 0.4 * share(F.col("turns") / F.col("n")) + 0.2 * share(F.try_divide("move", "first") * 0.05)
    return found.select("asset", F.when(F.col("n") < least, 0.0).otherwise(calm).alias("stability"))


def yearly(levels: DataFrame, key: str = "asset", value: str = "close") -> DataFrame:
    """Last over first level of each calendar year, less one."""
    return levels.groupBy(key, F.year("dt").alias("year")).agg((F.try_divide(F.max_by(value, "dt"), F.min_by(value, "dt")) - 1).alias("change"))
