"""Panels kept as tables that are bucketed by asset and partitioned by year.

A window or an aggregate by asset, or a join with another table of the same buckets, reads such a table without an
exchange; a choice of assets opens their buckets alone, and a range of days its years alone.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_folder

BUCKETS = 16


def store(panel: DataFrame, name: str = "panel", buckets: int = BUCKETS, key: str = "asset", day: str | None = "dt") -> str:
    """Writes ``panel`` as a table and gives its name. Its files are in the folder that all machines share; each bucket of
    a year is one file, sorted by asset and day. Without ``day`` there are no years."""
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    order = [key, *([day] if day else [])]
    rows = panel.withColumn("year", F.year(day)) if day else panel
    writer = rows.repartition(buckets, key).sortWithinPartitions(*(["year"] if day else []), *order).write.bucketBy(buckets, key).sortBy(*order)
    writer = writer.partitionBy("year") if day else writer
    writer.option("path", new_folder(panel.sparkSession, table)).saveAsTable(table)
    return table


Day = datetime.date | str


def stored(spark: SparkSession, table: str, assets: Sequence[str] | None = None, start: Day | None = None, end: Day | None = None, key: str = "asset", day: str = "dt") -> DataFrame:
    """The table's rows of some assets and from ``start`` to ``end``, both inclusive; all if not given."""
    rows = spark.table(table)
    if assets is not None:
        rows = rows.where(F.col(key).isin(*assets))
    for bound, keep in ((start, lambda c, x: c >= x), (end, lambda c, x: c <= x)):
        if bound is not None:
            rows = rows.where(keep(F.col(day), F.lit(str(bound)).cast("date")) & keep(F.col("year"), F.lit(int(str(bound)[:4]))))
    return rows.drop("year")
