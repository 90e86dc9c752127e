"""Sharding by proportional stratified interleaving.

Within each source, rows are ranked in a seeded shuffle, and a row's fractional rank is (rank + 1/2) over the
source's rows. In the order of fractional ranks every stretch holds each source in its share of all rows, so
cutting that order into pieces of equal length gives shards that all match the mixture: of any source, a shard has
its exact share to within a row, and its share of as many rows as there are sources, and the shards' counts differ by one at most (the law "rows").

Ranks come from buckets of the shuffle and from even stretches of the whole order (``shared.running``), so neither a
hot source, nor very many sources of a few rows, nor the whole order is ever in one task, and they don't depend on how the input is partitioned.

Defined results: null sources are a source of their own; a null text has no bytes and the checksum of the empty
text; rows that agree in everything are told apart by nothing and take their places in an arbitrary order among
themselves; with fewer rows than shards, some shards are empty; equal texts are not kept together, as the law
and the mixture decide every cut; extra columns pass through, but for ones named shard or slot, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import buckets, key_bucket, running, shuffle_key, unused_name, written


def interleaved_shards(rows: DataFrame, shards: int, source: str = "source", identity: tuple[str, ...] = ("doc_id",), seed: str = "shards") -> DataFrame:
    """``rows`` with shard (0 to ``shards`` - 1) and slot (the place in the shard, gapless from 0)."""
    rows = rows.drop("shard", "slot")
    count = rows.count()
    parts = buckets(count)
    key, bucket, rank, all_rows, share, place = (unused_name(rows, n) for n in ("_key", "_bucket", "_rank", "_rows", "_share", "_place"))
    keyed = rows.withColumn(key, shuffle_key(seed, *identity)).withColumn(bucket, key_bucket(key, parts))
    ties = [F.col(key), *map(F.col, identity)]
    ranked = running(keyed, [source], bucket, ties, F.lit(1), rank, all_rows)
    # The fraction (2 rank + 1) / (2 rows), exact enough as a double for ties to be the same everywhere.
    placed = ranked.withColumn(share, (2 * F.col(rank) + 1) / (2 * F.col(all_rows)))
    order = [F.col(share), F.col(source).asc_nulls_last(), *ties]
    # Millions of sources of one row all have the fraction 1/2: stretches of the whole order, sources included, are even.
    placed = written(placed.repartitionByRange(*order).withColumn(bucket, F.spark_partition_id()), "placed")
    ordered = running(placed, [], bucket, order, F.lit(1), place)
    shard = F.expr(f"cast((`{place}` * {shards}) div {max(count, 1)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {count} + {shards - 1}) div {shards}")
    return ordered.withColumn("shard", shard).withColumn("slot", F.col(place) - first).select(*rows.columns, "shard", "slot")
