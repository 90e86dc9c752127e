"""Connected components by alternating large-star and small-star steps, each a written table.

Before the first step and after each, every task links the nodes of its own edges with the least of those that they
connect. Steps end when that has left nothing but stars, which a table that fits into a task is at once: a step has a
dozen shuffles, each of which costs the driver a thread and its memory, however little it moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import returning_memory
from tidemark.llm.shared import written

#: Edges that a task holds at once, some 100 bytes each.
PIECE = 1 << 19

#: Parts over which a node's neighbours are dealt.
SALTS = 64


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step. ``edges``: (a, b) with a > b. Each node's neighbours (the smaller ones, or the larger ones) are
    linked with its least neighbour or itself. The least is found over parts of the neighbours and then over the parts,
    and goes back the same way, so a node with very many neighbours is no single task's."""
    if small:
        around = edges
    else:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = around.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = around.groupBy("a", "part").agg(F.min("b").alias("_least"))
    least = parts.groupBy("a").agg(F.min("_least").alias("_least")).select("a", F.least("a", "_least").alias("least"))
    linked = around.join(parts.select("a", "part").join(least, "a"), ["a", "part"])
    if small:
        new = linked.select("b", "least").unionByName(least.select(F.col("a").alias("b"), "least"))
    else:
        new = linked.where("b > a").select("b", "least")
    return new.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges, but the least of each component, and that least one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        least, most = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        np.minimum.at(root, most, least)
        while (root[root] != root).any():
            root = root[root]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def contracted(edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """Edges (a, b) with a > b that connect what ``edges`` do: those of each task, ``piece`` at a time, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for start in range(0, batch.num_rows, piece):
                part = batch.slice(start, piece)
                kept.append((part.column("a").to_numpy(), part.column("b").to_numpy()))
                if sum(len(a) for a, _ in kept) >= piece:
                    kept = [_forest(*map(np.concatenate, zip(*kept, strict=True)))]
                    if 2 * len(kept[0][0]) > piece:  # it stays more than half full: a new one begins
                        yield pa.RecordBatch.from_arrays([*map(pa.array, kept[0])], names=["a", "b"])
                        kept = []
        if kept:
            yield pa.RecordBatch.from_arrays([*map(pa.array, _forest(*map(np.concatenate, zip(*kept, strict=True))))], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(returning_memory(run), "a long, b long")


def _settled(edges: DataFrame) -> bool:
    """Whether every node but the roots has one edge, and a root has none of its own."""
    nodes = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("own")), F.struct(F.col("b").alias("node"), F.lit(None).cast("int").alias("own")))))
    counts = nodes.groupBy("node").agg(F.count("own").alias("own"), F.count("*").alias("all"))
    return not counts.where("own > 1 or own = 1 and all > 1").head(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, long) but the roots; a root is the least node of its component."""
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = written(contracted(ordered), "edges")
    while not _settled(stars):
        stars = written(contracted(_star(_star(stars, small=False), small=True)), "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
