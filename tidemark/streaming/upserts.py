"""A table by key and day that a stream adds to, batch by batch.

Each batch adds up its own rows by key and day, and writes these partial sums into the partitions of (day, batch). Only
partitions that the batch names are replaced, so it writes as much as it has days and keys, however large the table
is, and a batch that runs again replaces what it wrote before. Readers merge the partial sums of a day. A day may so
come in any number of batches, and late rows find their day.

Partials of many batches are folded into one from time to time (``compacted``): the merged table is written first, and
one row that names it and the last batch in it second, so readers see either the one or the other whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_folder

#: How partial values of a column are merged: all of them are associative, and ``newest`` takes that of the last batch, null or not.
MERGES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "newest": lambda c: F.max_by(c, "batch")}


class DayTable:
    """Rows by ``keys`` and ``day``, in which ``merges`` says how each other column's partial values become one."""

    def __init__(self, spark: SparkSession, keys: list[str], merges: dict[str, str], schema: str, day: str = "day", folder: str | None = None) -> None:
        self.spark, self.keys, self.merges, self.day = spark, keys, merges, day
        self.schema = f"{schema}, batch long"
        self.folder = folder or new_folder(spark, "days")

    def put(self, partial: DataFrame, number: int) -> None:
        """Writes the partial rows (keys, day, columns) of batch ``number``. A batch's rows are dealt by their days; one
        day with very many is split over tasks by adaptive execution."""
        rows = partial.withColumn("batch", F.lit(number).cast("long")).hint("rebalance", self.day)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.day, "batch").parquet(f"{self.folder}/partials")

    def _stored(self, path: str) -> DataFrame:
        """The table's columns in a folder; none, if nothing has been written there yet."""
        try:
            return self.spark.read.schema(self.schema).parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def _base(self) -> tuple[DataFrame | None, int]:
        """The merged table and the last batch in it."""
        named = self.spark.read.schema("upto long, path string")
        try:
            last = named.parquet(f"{self.folder}/merged").orderBy(F.desc("upto")).first()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        return (self._stored(last["path"]), last["upto"]) if last else (None, -1)

    def partials(self) -> DataFrame:
        base, upto = self._base()
        rows = self._stored(f"{self.folder}/partials").where(F.col("batch") > upto)
        return rows if base is None else rows.unionByName(base)

    def _merged(self, rows: DataFrame, *more: Column) -> DataFrame:
        return rows.groupBy(*self.keys, self.day).agg(*(MERGES[how](c).alias(c) for c, how in self.merges.items()), *more)

    def read(self) -> DataFrame:
        """Each key and day once, with its merged columns."""
        return self._merged(self.partials())

    def compacted(self) -> None:
        """Merges all partials that are there. Not to run while a batch is being put."""
        rows = self.partials()
        upto = rows.agg(F.max("batch")).first()[0]
        if upto is not None:
            path = f"{self.folder}/base-{upto}"
            self._merged(rows, F.max("batch").alias("batch")).write.mode("overwrite").partitionBy(self.day).parquet(path)
            self.spark.createDataFrame([(upto, path)], "upto long, path string").coalesce(1).write.mode("append").parquet(f"{self.folder}/merged")


def added(stream: DataFrame, table: DayTable, partial: Callable[[DataFrame], DataFrame], compact_every: int = 0) -> DayTable:
    """Runs ``stream`` to the end of what is there into ``table``; ``partial`` makes a batch's rows those of the table.
    After every ``compact_every`` batches, their partials are merged."""

    def put(batch: DataFrame, number: int) -> None:
        table.put(partial(batch), number)
        if compact_every and number % compact_every == compact_every - 1:
            table.compacted()

    stream.writeStream.foreachBatch(put).option("checkpointLocation", new_folder(table.spark, "days-state")).trigger(availableNow=True).start().awaitTermination()
    return table
