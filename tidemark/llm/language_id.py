"""Language identification by rank-order profiles.

A profile is the most frequent n-grams of one to three letters, by rank. A document's profile is compared with each
language's by out-of-place distance: each of its n-grams adds how far its rank is from its rank in the language's
profile, or the greatest distance if that has none; the language with the least distance is predicted.

Letters are code points in lower case, of any script, and all between words is one boundary, which n-grams may begin
or end with. An n-gram is the number that its code points make, 21 bits each, so different ones never count as one,
and counts are exact, over whole texts and all learning documents.

Defined results: texts that are null or have no letter are ``und`` with score 0; ties go to the language that is
first by code point; with no language learned all is ``und``; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import returning_memory, text_slices, with_columns, with_fields

#: N-grams in a profile.
PROFILE = 300
#: The boundary between words, and the bits of a code point.
BOUNDARY, POINT_BITS = 32, 21
#: Distinct n-grams of which a task sums counts before it passes them on.
HELD_CODES = 200_000
CHUNK_BYTES = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """The letter in lower case that each code point is; the boundary for all but letters."""
    table = np.full(0x110000, BOUNDARY, np.uint32)
    letters = np.array([p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and chr(p).isalpha()])
    table[letters] = [ord(chr(p).lower()[0]) for p in letters.tolist()]
    return table


def ngrams(texts: pa.Array) -> Iterator[np.ndarray]:
    """The n-grams of each text, as numbers, as often as they occur."""
    texts = ["" if t is None else t for t in texts.to_pylist()]
    points = np.frombuffer(" ".join(texts).encode("utf-32-le", "replace"), np.uint32)
    symbols = np.concatenate(([np.uint32(BOUNDARY)], _symbols()[points], [np.uint32(BOUNDARY)]))
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != BOUNDARY) | (symbols[:-1] != BOUNDARY)
    ends = np.cumsum([len(t) + 1 for t in texts])  # of each text's last boundary among all symbols
    places = np.concatenate(([0], np.cumsum(keep)[ends] - 1))
    s = symbols[keep].astype(np.int64)
    two = s[:-1] << POINT_BITS | s[1:]
    three = two[:-1] << POINT_BITS | s[2:]
    for start, end in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        one = s[start : end + 1]
        pairs, triples = two[start:end], three[start : max(start, end - 1)]
        yield np.concatenate((one[one != BOUNDARY], pairs, triples[one[1:-1] != BOUNDARY]))


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def profile(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, the most frequent first, ties by code."""
    distinct, counts = _counted(codes)
    if len(counts) > size:  # those that can be among the first: ties with the last one are all kept
        keep = counts >= np.partition(counts, len(counts) - size)[len(counts) - size]
        distinct, counts = distinct[keep], counts[keep]
    return distinct[np.argsort(-counts, kind="stable")][:size]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their counts over some codes with counts."""
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's profile, from all rows of ``docs`` with a language; ``size`` numbers a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def passed_on(name: str) -> Iterator[pa.RecordBatch]:
            codes, counts = _summed(held.pop(name))
            for at in range(0, len(codes), 100_000):
                part = codes[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(counts[at : at + 100_000])], names=["lang", "code", "n"])

        for batch in text_slices(batches, text, CHUNK_BYTES):
            langs = batch.column(lang)
            for name in pc.unique(langs).to_pylist():
                codes = np.concatenate([*ngrams(batch.column(text).filter(pc.equal(langs, name))), np.zeros(0, np.int64)])
                held.setdefault(name, []).append(_counted(codes))
                if sum(len(c) for c, _ in held[name]) > HELD_CODES:
                    held[name] = [_summed(held[name])]
                    if len(held[name][0][0]) > HELD_CODES // 2:
                        yield from passed_on(name)
        for name in list(held):
            yield from passed_on(name)

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias(text), F.col(lang).alias(lang))
    counts = rows.mapInArrow(returning_memory(run), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    found: dict[str, list[int]] = {}
    for row in sorted(best.collect(), key=lambda r: (r.lang, r.rank)):  # size rows a language
        found.setdefault(row.lang, []).append(row.code)
    return found


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two columns, which replace columns of the same names: the language, and its score, which is one
    minus the distance over the greatest possible."""
    names = sorted(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unique(np.array([c for name in names for c in profiles[name]], np.int64))
        ranks = np.full((len(names), len(known) + 1), -1, np.int32)  # the last column is that of n-grams in no profile
        for row, name in zip(ranks, names, strict=True):
            row[np.searchsorted(known, profiles[name])] = np.arange(len(profiles[name]))
        places = np.arange(size, dtype=np.int32)
        for batch in text_slices(batches, text, CHUNK_BYTES):
            langs, scores = [], []
            for codes in ngrams(batch.column(text)):
                own = profile(codes, size)
                if not len(own) or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at = np.searchsorted(known, own)
                there = ranks[:, np.where(known[np.minimum(at, len(known) - 1)] == own, at, len(known))]
                distances = np.where(there < 0, size, np.abs(there - places[: len(own)])).sum(axis=1)
                best = int(distances.argmin())
                langs.append(names[best])
                scores.append(1 - float(distances[best]) / (size * len(own)))
            yield with_columns(batch, {out[0]: pa.array(langs, pa.string()), out[1]: pa.array(scores, pa.float64())})

    return docs.mapInArrow(returning_memory(run), with_fields(docs, {out[0]: "string", out[1]: "double"}))


def fold(doc_id: str, parts: int) -> Column:
    """The part that a document falls into: the CRC-32 of its id as text, modulo ``parts``; null counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts
