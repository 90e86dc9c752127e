"""Exact top-k search by integer inner product, by MaxScore over shards.

A term is a dimension with a sign; a vector stands in the postings of a term if its component there has that sign.
A query's terms are its dimensions with its own signs, so that only vectors in a term's postings gain by it, by the
term's bound at most: the query's weight times the greatest component in the postings. Terms are ordered by bound.
The first few, whose bounds together don't exceed the k-th best score so far, are non-essential: a vector in none
of the others' postings can't get among the best. So the essential postings are traversed, and the vectors found
there are completed by the non-essential terms, the strongest first, as long as they stay competitive. Vectors are
taken in blocks by ascending id, so a vector that only ties with the k-th best never displaces it.

Candidates are dealt by hash into shards that take ``SHARD_BYTES`` of memory (fewer rows only where there would be
fewer shards than cores), each of which gets all queries and answers with its own k best; these are merged by query.
Queries are a stated set against all rows: their number times that of the shards is what is shuffled, so shards are
as large as a task can hold. A task holds one shard and one block of queries at a time. As vectors are dense, the
postings of a term are a boolean row over the shard's vectors.

Scores are computed in doubles where their bounds stay below 2**53, so they are exact; a query whose bounds don't is
compared with all vectors of the shard in Python's integers.

Defined results: components beyond 64 bits are the nearest integers of 64 bits, and so are scores; vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
without id; rows that share an id count once, with the largest vector; vectors of different lengths are never
compared; a query without candidates gets no row; extra columns stay out; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

#: Bytes of a shard's components and postings, and the fewest rows for which a shard is worth a task.
SHARD_BYTES, LEAST_ROWS = 128 << 20, 4096
QUERY_ROWS = 256
BLOCK_ROWS = 2048
#: Non-essential terms that are probed before competitive vectors are picked again.
PROBES = 4


def integer_vectors(df: DataFrame, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector): floor(scale * x) for each component x, of the vectors that take part."""
    values = F.col(embedding).cast("array<double>")
    sound = F.size(values).cast("int") > 0
    sound &= ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(values, lambda x: F.floor(x * scale).cast("long"))
    rows = df.where(F.col(vec_id).isNotNull() & values.isNotNull()).where(sound)
    return rows.groupBy(F.col(vec_id).alias("vec_id")).agg(F.max(whole).alias("vector"))


class Shard:
    """The vectors of a shard by ascending id, their postings and the greatest component of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids)
        self.ids, columns = ids[order], np.ascontiguousarray(vectors[order].T)
        self.columns = columns.astype(np.float64)
        self.most = np.abs(self.columns).max(axis=1)
        self.whole = columns if self.most.max() >= 2.0**53 else self.columns  # the components as they are
        self.postings = {1: self.columns > 0, -1: self.columns < 0}
        self.greatest = {1: np.maximum(self.columns.max(axis=1), 0), -1: np.maximum(-self.columns.min(axis=1), 0)}

    def best(self, query: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best candidates, ties by smaller id; the query's own row is none."""
        if not float(np.abs(weights.astype(np.float64)) @ self.most) < 2.0**53:
            return self._beyond_doubles(query, weights, k)
        weights = weights.astype(np.float64)
        signs = np.where(weights < 0, -1, 1)
        bounds = np.abs(weights) * np.where(signs > 0, self.greatest[1], self.greatest[-1])
        order = np.argsort(bounds, kind="stable")
        upto = np.cumsum(bounds[order])
        ids, scores, least = np.zeros(0, np.int64), np.zeros(0), -np.inf
        for start in range(0, len(self.ids), BLOCK_ROWS):
            rows = slice(start, start + BLOCK_ROWS)
            split = int(np.searchsorted(upto, least, side="right"))  # terms before it are non-essential
            essential = order[split:]
            block = self.columns[:, rows]
            if split:
                found = np.zeros(block.shape[1], bool)
                for sign in (1, -1):
                    terms = essential[signs[essential] == sign]
                    if len(terms):
                        found |= self.postings[sign][terms, rows].any(axis=0)
                at = np.flatnonzero(found)
            else:  # every term counts still, and so does every vector
                at = np.arange(block.shape[1])
            total = (weights[essential] @ block[essential])[at] if len(essential) else np.zeros(len(at))
            at, total = self._competitive(at, total, float(upto[split - 1]) if split else 0.0, least)
            left = split
            while left and len(at):
                terms = order[max(0, left - PROBES) : left]
                total = total + weights[terms] @ block[np.ix_(terms, at)]
                left = max(0, left - PROBES)
                at, total = self._competitive(at, total, float(upto[left - 1]) if left else 0.0, least)
            own = self.ids[start + at] != query
            ids, scores = np.concatenate((ids, self.ids[start + at[own]])), np.concatenate((scores, total[own]))
            if len(ids) > k:
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
            if len(ids) == k:
                least = float(scores.min())
        top = np.lexsort((ids, -scores))
        return ids[top], scores[top]

    def _beyond_doubles(self, query: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        found: list[tuple[int, int]] = []
        w = np.array(weights.tolist(), object)
        for start in range(0, len(self.ids), BLOCK_ROWS):
            scores = w @ self.whole[:, start : start + BLOCK_ROWS].astype(np.int64).astype(object)
            found += [(-s, i) for s, i in zip(scores.tolist(), self.ids[start : start + BLOCK_ROWS].tolist(), strict=True) if i != query]
            found = sorted(found)[:k]
        return np.array([i for _, i in found], np.int64), np.array([max(-(1 << 63), min((1 << 63) - 1, -s)) for s, _ in found], np.int64)

    @staticmethod
    def _competitive(at: np.ndarray, total: np.ndarray, more: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        keep = total + more > least
        return at[keep], total[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (vec_id, vector): for each row with ``is_query``, the ``k``
    other rows of the same length with the highest inner product, ties by smaller vec_id, ranks from 1."""
    vectors = written(vectors.withColumn("_length", F.size("vector")), "vectors")
    size = vectors.agg(F.count("*").alias("rows"), F.sum("_length").alias("components")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    # Ten bytes a component: a double and two postings.
    shards = max(1, -(-10 * (size.components or 0) // SHARD_BYTES), min(cores, size.rows // LEAST_ROWS))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    candidates = vectors.select("_length", own.alias("_shard"), F.lit(0).alias("_part"), "vec_id", "vector")
    queries = vectors.where(is_query).select("_length", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"), F.lit(1).alias("_part"), "vec_id", "vector")
    dealt = candidates.unionByName(queries).repartition("_length", "_shard").sortWithinPartitions("_length", "_shard", "_part")

    def answers(shard: Shard | None, ids: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        if shard is None:
            return
        for query, w in zip(ids.tolist(), weights, strict=True):
            found, scores = shard.best(query, w, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), query)), pa.array(found), pa.array(scores.astype(np.int64))], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            parts = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            ids, flat = batch.column(3).to_numpy(), batch.column(4)
            cuts = np.flatnonzero((parts[1:] != parts[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                length, number, part = parts[start].tolist()
                matrix = flat.slice(start, end - start).flatten().to_numpy().reshape(-1, length)
                if (length, number) != key:
                    key, held, shard = (length, number), [], None
                if part == 0:
                    held.append((ids[start:end], matrix))
                    continue
                if held:
                    shard, held = Shard(np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])), []
                found = [b for at in range(0, end - start, QUERY_ROWS) for b in answers(shard, ids[start + at : min(end, start + at + QUERY_ROWS)], matrix[at : at + QUERY_ROWS])]
                if found:
                    yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
