"""Composite scores, classes and checks of assets, and of documents on what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import quality_flag


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def composite(cvar: Column, forecast: Column, confidence: Column, signal: Column) -> Column:
    """0 to 1 from tail risk, forecast by its confidence, and signal; unknown tail risk counts as middling."""
    return clipped(0.4 * F.when(cvar.isNull(), 0.5).otherwise(clipped((cvar + 0.1) / 0.1)) + 0.3 * clipped((forecast + 15) / 30) * confidence + 0.3 * clipped((signal + 1) / 2))


def single(forecast: Column, hit_rate: Column, signal: Column, cvar: Column) -> Column:
    """0 to 100 for one asset on its own: forecast in per cent (ten are worth 40), hits, signal, and the size of its tail."""
    tail = F.when(cvar < 0, clipped(-F.greatest(cvar, F.lit(-0.5)) * 200, 0, 20)).otherwise(0.0)
    return clipped(clipped(forecast / 10 * 40, -40, 40) + hit_rate * 20 + clipped(signal * 20, 0, 20) + F.coalesce(tail, F.lit(0.0)), 0, 100)


def interpretation(score: Column) -> Column:
    return F.when(score >= 80, "very strong").when(score >= 60, "strong").when(score >= 40, "neutral").when(score >= 20, "weak").otherwise("very weak")


#: Words in the names of funds that hold mostly other things.
CRYPTO, COMMODITY = ("bitcoin", "ethereum", "crypto", "blockchain"), ("gold", "silver", "oil", "commodity", "metal")


def _names_any(name: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(F.lower(name), F.lit(word))
    return F.coalesce(found, F.lit(False))


def asset_class(stock: Column, bond: Column, other: Column, name: Column) -> Column:
    """What more than half of the holdings are, other things by the fund's name; Mixed without any such share."""
    kind = F.when(_names_any(name, CRYPTO), "Crypto").when(_names_any(name, COMMODITY), "Commodity").otherwise("Other")
    return F.when(stock > 0.5, "Equity").when(bond > 0.5, "Bond").when(other > 0.5, kind).otherwise("Mixed")


def growth(rows: DataFrame, least: float = 35, n: int = 10) -> DataFrame:
    """(asset, band, single, flag, momentum) of the ``n`` best assets of a medium or high risk whose score is above ``least``."""
    found = rows.where(F.col("band").isin("MEDIUM", "HIGH") & (F.col("single") > least))
    momentum = (0.6 * F.col("signal") + 0.4 * F.col("efficiency")) * 100
    flag = quality_flag(F.col("hit_rate"), F.col("confidence"))
    return found.select("asset", "band", "single", flag.alias("flag"), momentum.alias("momentum")).orderBy(F.desc("single"), "asset").limit(n)


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, broken, known): how many rows break each rule, and on how many it can be told."""
    counts = [F.struct(F.lit(k).alias("rule"), F.count_if(~r).alias("broken"), F.count(r).alias("known")) for k, r in rules.items()]
    return rows.agg(F.array(*counts).alias("x")).select(F.inline("x"))


def split_by_reason(found: DataFrame) -> DataFrame:
    """(status, assets, names): the universe by status, names in order."""
    return found.groupBy("status").agg(F.count("*").alias("assets"), F.array_join(F.array_sort(F.collect_list("asset")), ",").alias("names"))


def primary(holdings: DataFrame, key: str, group: Column, weight: str, out: str) -> DataFrame:
    """For each document, whose holdings are rows with a weight, the group that weighs most and its weight; ties by name."""
    sums = holdings.groupBy(key, group.alias(out)).agg(F.sum(weight).alias("weight"))
    best = F.max_by(F.struct(out, "weight"), F.struct(F.round("weight", 9), F.col(out)))
    return sums.groupBy(key).agg(best.alias("_b")).select(key, F.col(f"_b.{out}").alias(out), F.col("_b.weight").alias("weight"))


def shares(best: DataFrame, holdings: DataFrame, key: str, weight: str) -> DataFrame:
    """``best`` with its weight as a share of each document's whole."""
    whole = holdings.groupBy(key).agg(F.sum(weight).alias("_whole"))
    return best.join(whole, key).withColumn("weight", F.col("weight") / F.col("_whole")).drop("_whole")
