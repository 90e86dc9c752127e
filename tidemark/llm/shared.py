"""What the operators share: tables written to the cluster's shared folder, and global ranks and running sums.

Ranks and running sums never sort all rows in one task: rows are dealt into buckets of an order, each bucket is
ranked by itself, and the totals of the buckets before it are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import bounded_batches, new_folder

#: Rows that a bucket of a global order holds on average, until there are MOST_BUCKETS.
BUCKET_ROWS, MOST_BUCKETS = 1024, 1 << 16


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of the columns of ``df``, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_key(seed: str, *columns: str) -> Column:
    """A text that orders rows in a seeded shuffle: the MD5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns)))


def buckets(rows: int) -> int:
    """How many buckets to deal so many rows into; ranks and sums don't depend on it."""
    return min(MOST_BUCKETS, max(1, -(-rows // BUCKET_ROWS)))


def key_bucket(key: str, count: int) -> Column:
    """The bucket of a ``shuffle_key``, ascending with it."""
    return F.floor(F.conv(F.substring(key, 1, 7), 16, 10).cast("long") * count / (1 << 28)).cast("int")


def running(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: Column, out: str, total: str | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before each row, within ``groups``, in the order
    of (``bucket``, ``order``), and with ``total``: the sum over the whole group. ``bucket`` must ascend with the
    order. One task holds a bucket of a group at most; the offsets come from one row per group and bucket.
    """
    one, offset, before = (unused_name(df, n) for n in ("_sum", "_offset", "_before"))
    of = {c: unused_name(df, f"_of_{c}") for c in (*groups, bucket)}
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias(one))
    earlier = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *(F.col(c).alias(name) for c, name in of.items()),
        F.coalesce(F.sum(one).over(earlier), F.lit(0)).alias(offset),
        *([F.sum(one).over(Window.partitionBy(*groups)).alias(total)] if total else []),
    )
    within = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn(before, F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = local.join(offsets, [F.col(c).eqNullSafe(F.col(name)) for c, name in of.items()], "left")
    place = (F.col(before) + F.col(offset)).cast("long").alias(out)
    return joined.select(*df.columns, place, *([F.col(total).cast("long").alias(total)] if total else []))
