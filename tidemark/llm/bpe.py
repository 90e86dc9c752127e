"""Byte-level BPE encoding and decoding through a pair occurrence index.

``encode`` works on the distinct pre-tokens of a batch of rows. Every adjacent pair of symbols that the
vocabulary can merge is kept in an index from its rank to all positions where it occurs. Ranks are taken in
ascending order from a heap; all occurrences of a pair are merged at once, and the lists of the pairs that the
merge created next to them are extended. Positions whose symbols have changed meanwhile are dropped when their
pair comes up. Words do not influence each other, so this gives each word the merges that it would get alone.

The vocabulary is a file of the ``tokenizers`` library; its path is a parameter, and each executor reads it.
A task holds one Arrow batch, of which ``CHUNK_BYTES`` are worked on at a time, and a word table of bounded size,
so memory does not grow with the input, and a lost task is simply run again.

Defined results: a null or empty text has no ids and decodes to the empty string; null ids decode to the empty
string; whole texts are encoded, however long; other columns pass through unchanged, and a column that clashes
with an output column is replaced.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrow import returning_memory, text_slices, with_columns, with_fields
from tidemark.llm.byte_words import TableEncoder, gather

#: Bytes of text that are encoded at a time.
CHUNK_BYTES = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte: printable Latin-1 stands for itself, the rest follow from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merges and bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.byte_sizes = np.array(list(map(len, self.token_bytes)), np.int64)
        self.byte_at = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.symbol = np.full(256, -1, np.int64)
        for c, b in alphabet.items():
            self.symbol[b] = ids[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = self.left * self.size + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the vocabulary has no merge for it."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _by_rank(positions: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(ranks, kind="stable")
    positions, ranks = positions[order], ranks[order]
    cut = np.flatnonzero(np.diff(ranks)) + 1
    for start, end in zip([0, *cut.tolist()], [*cut.tolist(), len(ranks)], strict=True):
        yield int(ranks[start]), positions[start:end]


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and where each word's ids begin (one more entry than words)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lengths.sum())
    ends = np.cumsum(lengths)
    # One cell more than symbols: cell n stands for "no neighbour" and never matches.
    symbols = np.append(v.symbol[np.frombuffer(b"".join(words), np.uint8)], -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends[lengths > 0] - 1] = n
    before[(ends - lengths)[lengths > 0]] = n
    after[n] = before[n] = n

    index: dict[int, list[np.ndarray]] = {}
    at = np.flatnonzero(after[:n] < n)
    ranks = v.ranks(symbols[at], symbols[after[at]])
    known = ranks >= 0
    if known.any():
        for rank, positions in _by_rank(at[known], ranks[known]):
            index[rank] = [positions]
    active = sorted(index)
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        p = lists[0] if len(lists) == 1 else np.concatenate(lists)
        left, right = int(v.left[rank]), int(v.right[rank])
        p = p[(symbols[p] == left) & (symbols[after[p]] == right)]
        if not len(p):
            continue
        if left == right:  # in a run of equal symbols every other occurrence merges, from the left
            p = np.sort(p)
            starts = np.ones(len(p), bool)
            starts[1:] = after[p[:-1]] != p[1:]
            place = np.arange(len(p))
            p = p[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
        q = after[p]
        beyond = after[q]
        symbols[p] = v.made[rank]
        symbols[q] = -1
        after[p] = beyond
        before[beyond] = p
        before[n] = n
        touched = np.sort(np.concatenate((before[p], p)))
        touched = touched[(touched < n) & np.append(True, touched[1:] != touched[:-1])]
        touched = touched[after[touched] < n]
        if not len(touched):
            continue
        ranks = v.ranks(symbols[touched], symbols[after[touched]])
        known = ranks >= 0
        if known.any():
            for new, positions in _by_rank(touched[known], ranks[known]):
                if new in index:
                    index[new].append(positions)
                else:
                    index[new] = [positions]
                    heapq.heappush(active, new)
    alive = symbols[:n] >= 0
    counts = np.concatenate(([0], np.cumsum(alive)))
    return symbols[:n][alive], counts[np.concatenate(([0], ends))]


class Encoder(TableEncoder):
    """BPE of distinct words by the pair occurrence index."""

    def __init__(self, path: str) -> None:
        self.v = vocabulary(path)
        super().__init__(list(self.v.special))

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [b"" if w in self.v.special else w.encode() for w in words]
        ids, at = merge_words(plain, self.v)
        if b"" in plain:
            rows = [[self.v.special[w]] if w in self.v.special else ids[a:b] for w, a, b in zip(words, at[:-1], at[1:], strict=True)]
            return np.concatenate(rows).astype(np.int32), np.array(list(map(len, rows)), np.int32)
        return ids.astype(np.int32), np.diff(at).astype(np.int32)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def decode(ids: np.ndarray, bounds: np.ndarray, v: Vocabulary) -> pa.Array:
    """The texts of some ids one after another; bytes that are no UTF-8 become replacement characters."""
    raw, sizes = gather(v.bytes, v.byte_at[ids], v.byte_sizes[ids])
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[bounds]
    data = raw.tobytes()
    inner = ends[ends < len(data)]
    try:
        data.decode()
        split = (raw[inner] & 0xC0 == 0x80).any()
    except UnicodeDecodeError:
        split = True
    if split:
        return pa.array([data[a:b].decode(errors="replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the token ids of column ``text`` as an array of int in column ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text, CHUNK_BYTES):
            yield with_columns(batch, {out: _lists(*encoder(path).encode(batch.column(text).to_pylist()))})

    return df.mapInArrow(returning_memory(run), with_fields(df, {out: "array<int>"}))


def decode_column(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in column ``ids`` as a string in column ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            column = batch.column(ids)
            lengths = column.value_lengths().fill_null(0).to_numpy()
            texts = decode(column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lengths]), v)
            yield with_columns(batch, {out: texts})

    return df.mapInArrow(returning_memory(run), with_fields(df, {out: "string"}))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode_column`` of what it gave, in one pass over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in text_slices(batches, text, CHUNK_BYTES):
            found, bounds = encoder(path).encode(batch.column(text).to_pylist())
            yield with_columns(batch, {ids: _lists(found, bounds), decoded: decode(found, bounds, v)})

    return df.mapInArrow(returning_memory(run), with_fields(df, {ids: "array<int>", decoded: "string"}))
