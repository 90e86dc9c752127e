"""Queries on windows over a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scans
from tidemark.functions import series as S
from tidemark.operators import metrics, signals
from tidemark.plans.sql import BARS, RETS, SERIES, TYPES, last
from tidemark.session import written
from tidemark.sources import panels, stored


def registry():
    """A dict of queries, one of their DuckDB equivalents, and the decorator that fills them."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


QUERIES, ORACLES, query = registry()


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """``df`` with the named columns rounded, as engines add up doubles in different orders."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


@query(f"WITH {RETS} SELECT asset, dt, round(ret, 6) AS ret FROM rets WHERE ret IS NOT NULL")
def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.returns(panels.bars(spark, sf_dir)).where("ret is not null").select("asset", "dt", "ret"), "ret")


@query(f"""WITH {RETS},
  p AS (SELECT asset, rn, n, close / lag(close, 20) OVER w - 1 AS c20, close / lag(close, 60) OVER w - 1 AS c60 FROM rets WINDOW w AS (PARTITION BY asset ORDER BY dt))
  SELECT asset, round(coalesce(c20, 0) * 100, 6) AS change_20, round(coalesce(c60, 0) * 100, 6) AS change_60 FROM p WHERE rn = n""")
def period_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change in per cent over 20 and 60 rows at each series' end; 0 where the series is shorter."""
    rows = panels.bars(spark, sf_dir).withColumns({f"change_{n}": F.coalesce(S.simple_return(n=n), F.lit(0.0)) * 100 for n in (20, 60)})
    rows = rows.withColumn("_end", S.from_end()).where("_end = 1")
    return rounded(rows.select("asset", "change_20", "change_60"), "change_20", "change_60")


@query(f"""WITH {RETS},
  m AS (SELECT *, CASE WHEN rn >= 5 THEN avg(close) OVER {last(5)} END AS fast, CASE WHEN rn >= 20 THEN avg(close) OVER {last(20)} END AS slow FROM rets),
  a AS (SELECT *, CAST(fast > slow AS INTEGER) AS above FROM m),
  c AS (SELECT *, coalesce(abs(above - lag(above) OVER (PARTITION BY asset ORDER BY dt)), 0) AS changed FROM a)
  SELECT asset, dt, round(fast, 6) AS fast, round(slow, 6) AS slow, above, CAST(sum(changed) OVER (PARTITION BY asset ORDER BY dt) AS BIGINT) AS changes FROM c""")
def sma_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.crossings(panels.bars(spark, sf_dir)).select("asset", "dt", "fast", "slow", "above", "changes")
    return rounded(rows, "fast", "slow")


@query(f"""WITH {RETS}, k AS (SELECT *, 1 - 2.0::DOUBLE / 21 AS k FROM rets)
  SELECT asset, round(sum(close * CASE WHEN rn = 1 THEN pow(k, n - 1) ELSE (1 - k) * pow(k, n - rn) END), 6) AS ema FROM k GROUP BY asset""")
def ema20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.exponential(panels.bars(spark, sf_dir), 20), "ema")


def _ewm_sql(x: str, span: int) -> str:
    """Exponential mean weighted by the values so far, as sums of values blown up by their age."""
    k = f"(1 - 2.0::DOUBLE / {span + 1})"
    return f"(pow({k}, rn) * sum({x} * pow({k}, -rn)) OVER w / ((1 - pow({k}, rn)) / (1 - {k})))"


@query(f"""WITH {RETS}, l AS (SELECT *, {_ewm_sql("close", 12)} - {_ewm_sql("close", 26)} AS line FROM rets WINDOW w AS (PARTITION BY asset ORDER BY dt)),
  s AS (SELECT *, {_ewm_sql("line", 9)} AS mean FROM l WINDOW w AS (PARTITION BY asset ORDER BY dt))
  SELECT asset, round(line, 6) AS line, round(mean, 6) AS signal, round(line - mean, 6) AS histogram FROM s WHERE rn = n""")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.macd(panels.bars(spark, sf_dir)), "line", "signal", "histogram")


@query(f"""WITH {RETS},
  t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM rets WINDOW w AS (PARTITION BY asset ORDER BY dt))
  SELECT asset, dt, round(tr, 8) AS tr, round(CASE WHEN rn >= 14 THEN avg(tr) OVER {last(14)} END, 5) AS atr FROM t""")
def atr14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(signals.atr(panels.bars(spark, sf_dir)).select("asset", "dt", "tr", "atr"), "tr", digits=8), "atr", digits=5)


@query(f"""WITH {TYPES}, r AS (SELECT asset, dt, close / lag(close) OVER (PARTITION BY asset ORDER BY dt) - 1 AS ret FROM types),
  j AS (SELECT a.dt, a.ret AS x, b.ret AS y FROM r a JOIN r b ON a.dt = b.dt WHERE a.asset = 'ECONOMY' AND b.asset = 'STANDARD' AND a.ret IS NOT NULL
      AND b.ret IS NOT NULL)
  SELECT dt, round(CASE WHEN count(*) OVER w >= 16 THEN corr(x, y) OVER w END, 6) AS corr FROM j WINDOW w AS (ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def rolling_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of two groups' returns over the last 21 common days, 16 at least."""
    rows = signals.returns(panels.type_bars(spark, sf_dir)).where("ret is not null")
    sides = [rows.where(F.col("asset") == a).select("dt", F.col("ret").alias(c)) for a, c in (("ECONOMY", "x"), ("STANDARD", "y"))]
    pair = sides[0].join(sides[1], "dt").withColumn("asset", F.lit("pair"))
    found = pair.withColumn("corr", S.rolling(F.corr("x", "y").over(S.last(21)), "x", 21, 16))
    return rounded(found.select("dt", "corr"), "corr")


@query(f"""WITH {RETS}, m AS (SELECT *, avg(close) OVER w AS mean, stddev_samp(close) OVER w AS sd FROM rets WINDOW w AS {last(20)})
  SELECT asset, dt, round(CASE WHEN rn >= 20 THEN (close - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END END, 5) AS z FROM m""")
def zscore20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panels.bars(spark, sf_dir).select("asset", "dt", S.zscore("close", 20).alias("z")), "z", digits=5)


@query(f"""WITH {RETS} SELECT asset, dt, round(CASE WHEN rn >= 20 THEN volume / nullif(avg(volume) OVER {last(20)}, 0) END, 6) AS ratio FROM rets""")
def rel_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.try_divide(F.col("volume"), S.sma("volume", 20))
    return rounded(panels.bars(spark, sf_dir).select("asset", "dt", ratio.alias("ratio")), "ratio")


@query(f"""WITH {RETS}, e AS (SELECT asset, dt, product(1 + coalesce(ret, 0)) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS growth FROM rets)
  SELECT asset, dt, round(growth, 6) AS growth, round(growth / max(growth) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM e""")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.equity(written(panels.bars(spark, sf_dir).select("asset", "dt", "close"), "bars"))
    return rounded(rows.select("asset", "dt", "growth", "drawdown"), "growth", "drawdown")


@query(f"""WITH {BARS}, days AS (SELECT DISTINCT dt FROM bars), a AS (SELECT asset, min(dt) AS first FROM bars GROUP BY asset),
  g AS (SELECT a.asset, d.dt, b.close FROM a JOIN days d ON d.dt >= a.first LEFT JOIN bars b ON b.asset = a.asset AND b.dt = d.dt)
  SELECT asset, dt, round(last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING), 8) AS close, close IS NULL AS carried FROM g""")
def filled_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asset on every trading day since its first, prices carried forward."""
    bars = written(panels.bars(spark, sf_dir).select("asset", "dt", "close"), "bars")
    last = bars.agg(F.max("dt").alias("_last"))
    every = bars.groupBy("asset").agg(F.min("dt").alias("_first")).crossJoin(last)  # one row
    grid = every.select("asset", F.explode(F.sequence("_first", "_last")).alias("dt")).join(bars.select("dt").distinct(), "dt", "left_semi")
    rows = written(grid.join(bars, ["asset", "dt"], "left").withColumn("carried", F.col("close").isNull()), "calendar")
    rows = scans.prefixes(rows, ["asset"], ["dt"], scans.period_of(), {"filled": ("last", "close")})
    return rounded(rows.select("asset", "dt", F.col("filled").alias("close"), "carried"), "close", digits=8)


def _wma_sql(c: str, n: int) -> str:
    return "(" + " + ".join(f"lag({c}, {n - i}) OVER w * {i}" if i < n else f"{c} * {n}" for i in range(1, n + 1)) + f") / {n * (n + 1) / 2}::DOUBLE"


@query(f"""WITH {BARS}, r AS (SELECT *, 2 * ({_wma_sql("close", 4)}) - ({_wma_sql("close", 9)}) AS raw FROM bars WINDOW w AS (PARTITION BY asset ORDER BY dt))
  SELECT asset, dt, round({_wma_sql("raw", 3)}, 6) AS hull FROM r WINDOW w AS (PARTITION BY asset ORDER BY dt)""")
def hull_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.hull(panels.bars(spark, sf_dir), 9).select("asset", "dt", "hull"), "hull")


_EFFICIENCY = f"""s AS (SELECT *, abs(close - lag(close) OVER w) AS step, abs(close - lag(close, 10) OVER w) AS net FROM rets WINDOW w AS (PARTITION BY asset
    ORDER BY dt)),
  er AS (SELECT *, least(1, greatest(0, coalesce(net / nullif(CASE WHEN rn > 10 THEN sum(step) OVER {last(10)} END, 0), 0.5))) AS efficiency FROM s)"""


@query(f"WITH {RETS}, {_EFFICIENCY} SELECT asset, dt, round(efficiency, 6) AS efficiency FROM er")
def efficiency_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.efficiency(panels.bars(spark, sf_dir)).select("asset", "dt", "efficiency"), "efficiency")


@query(f"""WITH {RETS}, {_EFFICIENCY},
  f AS (SELECT *, count(*) OVER b AS k, close < min(close) OVER b AS plow, close > max(close) OVER b AS phigh, efficiency < min(efficiency) OVER b AS elow,
      efficiency > max(efficiency) OVER b AS ehigh
    FROM er WINDOW b AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
  SELECT asset, dt, CASE WHEN k < 20 THEN 'none' WHEN plow AND NOT elow THEN 'bullish' WHEN phigh AND NOT ehigh THEN 'bearish' ELSE 'none' END AS divergence FROM f""")
def price_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.divergence(signals.efficiency(panels.bars(spark, sf_dir)), "efficiency").select("asset", "dt", "divergence")


@query(f"""WITH {RETS}, m AS (SELECT *, close > avg(close) OVER {last(20)} AS up FROM rets),
  c AS (SELECT *, CASE WHEN lag(up) OVER w IS NULL OR up <> lag(up) OVER w THEN 1 ELSE 0 END AS changed FROM m WINDOW w AS (PARTITION BY asset ORDER BY dt))
  SELECT asset, dt, sum(changed) OVER {last(20)} < 4 AS consistent FROM c""")
def trend_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.bars(spark, sf_dir).withColumn("up", F.col("close") > F.avg("close").over(S.last(20)))
    return signals.trend_consistency(rows, "up").select("asset", "dt", "consistent")


@query(f"""WITH {RETS}, {_EFFICIENCY}, m AS (SELECT *, avg(ret) OVER {last(5)} AS a, avg(efficiency - 0.5) OVER {last(5)} AS b FROM er)
  SELECT asset, dt, CASE WHEN a > 0 AND b < 0 THEN 'fading' WHEN a < 0 AND b > 0 THEN 'building' ELSE 'aligned' END AS state FROM m WHERE rn > 11""")
def trend_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the five-day means of returns and of path efficiency point apart."""
    rows = signals.efficiency(signals.returns(panels.bars(spark, sf_dir))).withColumn("rn", F.row_number().over(S.by_asset()))
    a, b = F.avg("ret").over(S.last(5)), F.avg(F.col("efficiency") - 0.5).over(S.last(5))
    rows = rows.withColumn("state", F.when((a > 0) & (b < 0), "fading").when((a < 0) & (b > 0), "building").otherwise("aligned"))
    return rows.where("rn > 11").select("asset", "dt", "state")


@query(f"""WITH {RETS} SELECT asset, dt, round(CASE WHEN rn > 30 THEN stddev_samp(ret) OVER {last(30)} END * sqrt(252) * 100, 6) AS vol_30,
  round(CASE WHEN rn > 252 THEN stddev_samp(ret) OVER {last(252)} END * sqrt(252) * 100, 6) AS vol_252 FROM rets""")
def rolling_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.returns(panels.bars(spark, sf_dir)).withColumns({f"vol_{n}": S.rolling_std("ret", n) * F.sqrt(F.lit(252)) * 100 for n in (30, 252)})
    return rounded(rows.select("asset", "dt", "vol_30", "vol_252"), "vol_30", "vol_252")


@query(f"""WITH {RETS} SELECT asset, round(max(close) FILTER (rn = n), 6) AS newest, round(max(close) FILTER (rn = n - 20), 6) AS ago_20,
    round(max(close) FILTER (rn = n - 251), 6) AS ago_251 FROM rets GROUP BY asset""")
def from_the_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes by their place from the end of each series."""
    rows = panels.bars(spark, sf_dir).withColumn("k", S.from_end())
    picked = [F.max(F.when(F.col("k") == k + 1, F.col("close"))).alias(n) for k, n in ((0, "newest"), (20, "ago_20"), (251, "ago_251"))]
    return rounded(rows.groupBy("asset").agg(*picked), "newest", "ago_20", "ago_251")


@query(f"WITH {RETS} SELECT asset, dt, round(close, 8) AS close FROM rets WHERE rn % 5 = 1")
def every_fifth_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.bars(spark, sf_dir).withColumn("rn", F.row_number().over(S.by_asset())).where("rn % 5 = 1")
    return rounded(rows.select("asset", "dt", "close"), "close", digits=8)


@query(f"""WITH {TYPES}, r AS (SELECT asset, dt, close / lag(close) OVER (PARTITION BY asset ORDER BY dt) - 1 AS ret FROM types)
  SELECT dt, round(stddev_samp(ret), 6) AS dispersion FROM r WHERE ret IS NOT NULL GROUP BY dt HAVING count(*) = 6""")
def cross_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of all groups' returns on the days on which all have one."""
    rows = signals.returns(panels.type_bars(spark, sf_dir)).where("ret is not null")
    return rounded(rows.groupBy("dt").agg(F.stddev_samp("ret").alias("dispersion"), F.count("*").alias("k")).where("k = 6").drop("k"), "dispersion")


@query(f"""WITH {BARS}, l AS (SELECT max(dt) AS d FROM bars)
  SELECT asset, round(arg_max(close, dt) FILTER (dt >= date_trunc('year', d)) / arg_min(close, dt) FILTER (dt >= date_trunc('year', d)) - 1, 6) AS ytd,
    round(arg_max(close, dt) FILTER (dt >= d - 365) / arg_min(close, dt) FILTER (dt >= d - 365) - 1, 6) AS year FROM bars, l GROUP BY asset""")
def calendar_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns since the year's start and over 365 days, as of the panel's last day."""
    bars = panels.bars(spark, sf_dir)
    rows = bars.crossJoin(F.broadcast(bars.agg(F.max("dt").alias("d"))))  # one row

    def over(since):
        inside = F.when(F.col("dt") >= since, F.col("dt"))
        return F.max_by("close", inside) / F.min_by("close", inside) - 1

    return rounded(rows.groupBy("asset").agg(over(F.trunc("d", "year")).alias("ytd"), over(F.date_sub("d", 365)).alias("year")), "ytd", "year")


@query(f"""WITH {RETS}, g AS (SELECT asset, any_value(n) AS n, bool_or(ret > 3 OR ret < -0.5) AS jump, max(close) FILTER (rn = n) AS a,
    max(close) FILTER (rn = n - 251) AS b FROM rets GROUP BY asset)
  SELECT asset, round(CASE WHEN n < 252 THEN 0.0 WHEN jump THEN NULL ELSE a / b - 1 END, 6) AS year_return FROM g""")
def guarded_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-year return; null after a daily move that can't be real, 0 with less than a year of rows."""
    rows = signals.returns(panels.bars(spark, sf_dir)).withColumn("k", S.from_end())
    found = rows.groupBy("asset").agg(
        F.count("*").alias("n"), F.bool_or((F.col("ret") > 3) | (F.col("ret") < -0.5)).alias("jump"),
        F.max(F.when(F.col("k") == 1, F.col("close"))).alias("a"), F.max(F.when(F.col("k") == 252, F.col("close"))).alias("b"),
    )
    value = F.when(F.col("n") < 252, 0.0).when(F.col("jump"), None).otherwise(F.try_divide("a", "b") - 1)
    return rounded(found.select("asset", value.alias("year_return")), "year_return")


@query(f"""WITH {SERIES}, m AS (SELECT name, dt, value, max(value) OVER w AS top, count(*) OVER w AS k FROM series WINDOW w AS (PARTITION BY name
    ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
  SELECT name, dt, round(least(100, (top - value) / top * 500), 6) AS stress FROM m WHERE k = 252""")
def drawdown_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fall from the year's high as a stress of 0 to 100, once a year of rows is there."""
    rows = panels.series(spark, sf_dir)
    top = S.rolling(F.max("value").over(S.last(252, "name")), "value", 252, key="name")
    rows = rows.withColumn("top", top).where("top is not null")
    return rounded(rows.select("name", "dt", F.least(F.lit(100.0), (F.col("top") - F.col("value")) / F.col("top") * 500).alias("stress")), "stress")


@query(f"""WITH {RETS}, newest AS (SELECT asset, close AS v FROM rets WHERE rn = n),
  h AS (SELECT r.asset, count(*) AS k, count(*) FILTER (r.close < v) AS below, count(*) FILTER (r.close <= v) AS upto FROM rets r JOIN newest USING (asset)
      WHERE r.rn > r.n - 252 GROUP BY r.asset)
  SELECT asset, round(CASE WHEN k >= 60 THEN 50.0::DOUBLE / k * (below + upto + CASE WHEN upto > below THEN 1 ELSE 0 END) END, 6) AS percentile FROM h""")
def own_history_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest close's percentile among the last 252, 60 at least; ties count half and one more."""
    rows = panels.bars(spark, sf_dir).withColumn("k", S.from_end()).where("k <= 252")
    rows = rows.withColumn("v", F.max_by("close", "dt").over(Window.partitionBy("asset")))
    found = rows.groupBy("asset").agg(F.count("*").alias("k"), F.count_if(F.col("close") < F.col("v")).alias("below"), F.count_if(F.col("close") <= F.col("v")).alias("upto"))
    value = F.when(F.col("k") >= 60, F.lit(50.0) / F.col("k") * (F.col("below") + F.col("upto") + (F.col("upto") > F.col("below")).cast("int")))
    return rounded(found.select("asset", value.alias("percentile")), "percentile")


#: The trend of each series by the MEDIUM band, written as recursions: the filter's state and variance, then the bands.
KALMAN = f"""tr AS (
    SELECT asset, dt, rn, n, close, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, abs(close - lag(close) OVER w) AS move
    FROM rets WINDOW w AS (PARTITION BY asset ORDER BY dt)),
  ta AS (SELECT *, avg(tr) OVER {last(12)} AS atr FROM tr WHERE n >= 30),
  pe AS (
    SELECT asset, any_value(n) AS n, max(atr) FILTER (rn = n) / max(close) FILTER (rn = n) AS unrest,
      coalesce(greatest(0, least(1, abs(max(close) FILTER (rn = n) - max(close) FILTER (rn = n - 10)) / nullif(sum(move) FILTER (rn > n - 10), 0))), 0.5) AS er
    FROM ta GROUP BY asset),
  pa AS (SELECT *, 3.0::DOUBLE * (1 - er) * (1 + unrest) AS r, 0.01::DOUBLE * (1 + unrest) AS q FROM pe),
  pp AS (SELECT *, CAST(greatest(3, least(round_even(r, 0), n // 2)) AS BIGINT) AS h FROM pa),
  kal(asset, rn, state, p) AS (
    SELECT ta.asset, rn, close, (1 - (100 + q) / (100 + q + r)) * (100 + q) FROM ta JOIN pp USING (asset) WHERE rn = 1
    UNION ALL
    SELECT k.asset, ta.rn, state + (k.p + q) / (k.p + q + r) * (close - state), (1 - (k.p + q) / (k.p + q + r)) * (k.p + q)
    FROM kal k JOIN ta ON ta.asset = k.asset AND ta.rn = k.rn + 1 JOIN pp ON pp.asset = k.asset),
  wm AS (
    SELECT a.asset, a.rn, any_value(h) AS h, any_value(s) AS s,
      sum(b.state * (half - (a.rn - b.rn))) FILTER (a.rn - b.rn < half) / (any_value(half) * (any_value(half) + 1) / 2) AS short,
      sum(b.state * (h - (a.rn - b.rn))) / (any_value(h) * (any_value(h) + 1) / 2) AS long
    FROM (SELECT kal.*, h, greatest(2, h // 2) AS half, CAST(greatest(2, round_even(sqrt(h), 0)) AS BIGINT) AS s FROM kal JOIN pp USING (asset)) a
    JOIN kal b ON b.asset = a.asset AND b.rn BETWEEN a.rn - h + 1 AND a.rn
    WHERE a.rn >= h GROUP BY a.asset, a.rn),
  hm AS (
    SELECT a.asset, a.rn, sum((2 * b.short - b.long) * (a.s - (a.rn - b.rn))) / (any_value(a.s) * (any_value(a.s) + 1) / 2) AS hull
    FROM wm a JOIN wm b ON b.asset = a.asset AND b.rn BETWEEN a.rn - a.s + 1 AND a.rn
    WHERE a.rn >= a.h + a.s - 1 GROUP BY a.asset, a.rn),
  b0 AS (SELECT ta.asset, ta.rn, ta.n, close, hull, hull + 1.7 * atr AS up, hull - 1.7 * atr AS lo FROM ta LEFT JOIN hm ON hm.asset = ta.asset AND hm.rn = ta.rn),
  band(asset, rn, n, close, hull, up, lo, trend) AS (
    SELECT asset, rn, n, close, hull, up, lo, CASE WHEN close > up THEN 1 WHEN close < lo THEN -1 ELSE 0 END FROM b0 WHERE rn = 1
    UNION ALL
    SELECT asset, rn, n, close, hull, up, lo, CASE WHEN close > up THEN 1 WHEN close < lo THEN -1 ELSE trend END
    FROM (
      SELECT b0.asset, b0.rn, b0.n, b0.close, b0.hull, d.trend, CASE WHEN d.close > d.up THEN least(b0.up, d.up) ELSE b0.up END AS up,
        CASE WHEN d.close < d.lo THEN greatest(b0.lo, d.lo) ELSE b0.lo END AS lo
      FROM band d JOIN b0 ON b0.asset = d.asset AND b0.rn = d.rn + 1)),
  ends AS (
    SELECT asset, max(CASE WHEN rn = n THEN close END) AS close, max(CASE WHEN rn = n THEN hull END) AS hull, max(CASE WHEN rn = n THEN up END) AS up,
      max(CASE WHEN rn = n THEN lo END) AS lo, max(CASE WHEN rn = n THEN trend END) AS trend,
      min(close) FILTER (rn < n AND rn >= n - 20) AS low, max(close) FILTER (rn < n AND rn >= n - 20) AS high,
      min(hull) FILTER (rn < n AND rn >= n - 20) AS own_low, max(hull) FILTER (rn < n AND rn >= n - 20) AS own_high,
      1 + count(*) FILTER (rn > n - 19 AND trend <> before) AS turns
    FROM (SELECT *, lag(trend) OVER (PARTITION BY asset ORDER BY rn) AS before FROM band) GROUP BY asset),
  kh AS (
    SELECT asset, trend, hull, up, lo, er, turns < 4 AS consistent,
      CASE WHEN close < low AND hull > own_low THEN 'bullish' WHEN close > high AND hull < own_high THEN 'bearish' ELSE 'none' END AS divergence,
      CASE WHEN up = lo THEN 0.5 ELSE greatest(0, least(1, 0.4 * er + 0.6 * CASE WHEN up < lo THEN 0.5 ELSE greatest(0, least(1, 1 - CASE trend WHEN 1 THEN up - close
          WHEN -1 THEN close - lo
        ELSE least(abs(close - up), abs(close - lo)) END / (up - lo))) END)) END AS strength
    FROM ends JOIN pp USING (asset))"""


@query(f"""WITH RECURSIVE {RETS}, {KALMAN}
  SELECT asset, CAST(trend AS INTEGER) AS trend, round(hull, 4) AS kalman_price, round(up, 4) AS upper_band, round(lo, 4) AS lower_band, round(er, 6) AS efficiency_ratio,
    divergence, consistent AS trend_consistency, round(strength, 6) AS signal_strength FROM kh""")
def kalman_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend of each series at its end, its bands and strength."""
    rows = rounded(signals.kalman_hull(panels.bars(spark, sf_dir)), "kalman_price", "upper_band", "lower_band", digits=4)
    return rounded(rows, "efficiency_ratio", "signal_strength")


@query(f"""WITH RECURSIVE {RETS}, {KALMAN}
  SELECT asset, dt, rn AS n, round(state, 6) AS level FROM kal JOIN rets USING (asset, rn) WHERE rn % 50 = 0""")
def kalman_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered level of every fiftieth close, with the noises that each series' end tells."""
    bars = written(panels.bars(spark, sf_dir), "bars")
    found = signals.kalman_levels(bars, signals.band_parameters(bars))
    return rounded(found.where("n % 50 = 0"), "level")


@query(f"""WITH {BARS}, b AS (SELECT * FROM bars WHERE asset IN ('Brand#11', 'Brand#2', 'Brand#23', 'Brand#5') AND dt BETWEEN DATE '1996-03-01' AND DATE '1998-06-30')
  SELECT asset, dt, round(close / lag(close) OVER w - 1, 6) AS ret, round(max(high) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS top
  FROM b WINDOW w AS (PARTITION BY asset ORDER BY dt)""")
def stored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns and twenty-day highs of four assets over some years, from a stored panel of which only their part is read."""
    table = stored.store(panels.bars(spark, sf_dir))
    rows = stored.stored(spark, table, ["Brand#11", "Brand#2", "Brand#23", "Brand#5"], "1996-03-01", "1998-06-30")
    rows = signals.returns(rows).withColumn("top", F.max("high").over(S.last(20)))
    return rounded(rows.select("asset", "dt", "ret", "top"), "ret", "top")
