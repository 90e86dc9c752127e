"""Sinks: partitioned Parquet, CSV with maps spread out, JSON, and keyed upserts of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.relational import upsert


def partitioned(df: DataFrame, path: str, by: str) -> None:
    """Parquet with a folder for each value of ``by``, rows clustered by it, so each folder gets few files."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).option("compression", "snappy").parquet(path)


def partition(spark: SparkSession, path: str, by: str, value: str, allowed: tuple[str, ...]) -> DataFrame:
    """The rows of one folder of a partitioned table; ``value`` must be one of ``allowed``."""
    if value not in allowed:
        raise ValueError(f"{by} must be one of {', '.join(allowed)}, not {value!r}")
    return spark.read.parquet(path).where(F.col(by) == value)


def spread(df: DataFrame, column: str, keys: list[str], prefix: str) -> DataFrame:
    """``df`` with a column for each of ``keys`` in place of a map."""
    return df.select(*(c for c in df.columns if c != column), *(F.col(column)[k].alias(f"{prefix}{k}") for k in keys))


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upserted(path: str, new: DataFrame, keys: list[str], by: str, out: str) -> None:
    """The table at ``path`` with the rows of ``new`` in place of those with their keys, written to ``out``."""
    old = new.sparkSession.read.parquet(path)
    partitioned(upsert(old.select(new.columns), new, keys), out, by)
