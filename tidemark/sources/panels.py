"""Price panels from trade tables.

A panel has a row for each asset and day on which it traded: asset, dt, open, high, low, close, volume. Prices are
unit prices of order lines; the close is the day's volume-weighted price, from sums of whole cents, so it does not
depend on the order of the lines. Days without trades have no row, as with real listings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that stand for external series, and the product types whose closes play them.
SERIES = {"gold": "ECONOMY", "equity": "STANDARD", "vix": "SMALL", "us_10y": "MEDIUM", "aud_usd": "LARGE", "bonds": "PROMO"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projected(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with its columns and those of ``columns`` (name to type) that it lacks, which are null."""
    return df.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in columns.items() if name not in df.columns))


def adjusted(df: DataFrame) -> DataFrame:
    """``df`` with price: the adjusted close where the table has one, else the close."""
    return projected(df, {"adj_close": "double"}).withColumn("price", F.coalesce("adj_close", "close"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a line, by their schema: fields that a document lacks are null, others aren't read."""
    return spark.read.schema(schema).json(path)


def _panel(spark: SparkSession, sf_dir: str, asset: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", F.col("l_shipdate").cast("date").alias("dt"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(asset).alias("asset"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("asset", "dt").agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        (cents / F.lit(100.0) / F.sum("l_quantity")).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of 25 assets: the brands."""
    return _panel(spark, sf_dir, "p_brand")


def type_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of 6 broad groups: the product types. They serve as benchmarks and external series."""
    return _panel(spark, sf_dir, "p_type")


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_bars(spark, sf_dir).select(F.col("asset").alias("benchmark"), "dt", F.col("close").alias("level"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, dt, value): external series."""
    names = F.create_map(*(F.lit(x) for name, kind in SERIES.items() for x in (kind, name)))
    return type_bars(spark, sf_dir).select(F.coalesce(names[F.col("asset")], F.lower("asset")).alias("name"), "dt", F.col("close").alias("value"))


def external_series(spark: SparkSession, sf_dir: str, least: int = 100) -> DataFrame:
    """The values of those series that have at least ``least`` points."""
    rows = series(spark, sf_dir).where("value is not null")
    known = rows.groupBy("name").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("name")
    return rows.join(known, "name", "left_semi")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension of assets: ordinal, region, type and name, derived from each brand's parts."""
    parts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_name").alias("name"), F.min("p_type").alias("type"), F.count("*").alias("n_parts"))
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    regions = F.array(*map(F.lit, ("AU", "US", "EU", "ASIA")))
    return parts.select(
        F.col("p_brand").alias("asset"),
        F.row_number().over(_by_brand()).alias("ord"),
        F.element_at(regions, number % 4 + 1).alias("region"),
        F.when(number % 5 == 0, "Bond").when(number % 5 == 1, "Commodity").otherwise("Equity").alias("kind"),
        "type",
        "name",
        "n_parts",
    )


def _by_brand():
    from pyspark.sql import Window

    return Window.orderBy("p_brand")
