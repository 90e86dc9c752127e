"""Token-id files: concatenated ids in blocks, with Elias-Fano coded document boundaries.

``write`` deals documents into ranges of ascending ids, encodes each range's texts with the tokenizers library,
and writes blocks as rows of Parquet in a shared folder, through Spark's writer and its commit protocol, so a lost
executor costs a task and no file is half there. A block holds the ids of some documents one after another (two
bytes an id where the vocabulary allows, else four), the documents' own ids, and the boundaries: n + 1 offsets
into the block as an Elias-Fano sequence. Offsets are local to a block, so no table of 64-bit offsets exists; a
document's place in the whole corpus is its local offset plus the ids of all blocks before, a sum over one row
per block. ``read`` takes the blocks back to documents, ``read_document`` finds single ones; both get their offsets by
the sequence's select.

Defined results: a null or empty text is the end id alone; null document ids come first; rows with equal document
ids stay separate, in an arbitrary order among them; a document longer than a block gets a block of its own; an
empty table gives no blocks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import text_slices
from tidemark.llm.bpe import CHUNK_BYTES
from tidemark.llm.byte_words import TableEncoder
from tidemark.llm.elias_fano import EliasFano
from tidemark.llm.shared import unused_name

#: A block is closed at so many ids or documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 8192

BLOCK_SCHEMA = "shard int, block int, n_docs int, n_ids long, id_bytes int, first_doc long, last_doc long, doc_ids binary, no_doc_id binary, ids binary, bound_bits int, bound_low binary, bound_high binary, bound_samples binary"


class LibraryEncoder(TableEncoder):
    """The tokenizers library on each distinct word once; on whole texts if its words aren't the byte-level ones."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        before = str(self.library.pre_tokenizer)
        self.by_word = self.library.normalizer is None and before.startswith("ByteLevel") and "add_prefix_space=False" in before and "use_regex=True" in before
        small = self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16
        super().__init__([t.content for t in self.library.get_added_tokens_decoder().values()], np.uint16 if small else np.uint32)

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, rows), np.int32, len(rows))
        return np.fromiter(chain.from_iterable(rows), self.kind, int(sizes.sum())), sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.by_word:
            return super().encode(texts)
        ids, sizes = self.word_ids([text or "" for text in texts])
        return ids, np.cumsum([0, *sizes])


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _block(shard: int, block: int, docs: list[int | None], rows: list[bytes], width: int) -> dict:
    ends = np.cumsum([0, *map(len, rows)]) // width
    bounds = EliasFano.of(ends)
    return {
        "shard": shard, "block": block, "n_docs": len(docs), "n_ids": int(ends[-1]), "id_bytes": width,
        "first_doc": min((d for d in docs if d is not None), default=None), "last_doc": max((d for d in docs if d is not None), default=None),
        "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "no_doc_id": np.packbits([d is None for d in docs]).tobytes(), "ids": b"".join(rows),
        "bound_bits": bounds.low_bits, "bound_low": bounds.low, "bound_high": bounds.high, "bound_samples": bounds.samples,
    }


def write(df: DataFrame, tokenizer: str, folder: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all texts of ``df``, each with ``end_id`` after it, in ascending ``doc_id`` order."""
    schema = df.sparkSession.createDataFrame([], BLOCK_SCHEMA).schema
    arrow = pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        width = np.dtype(encoder.kind).itemsize
        end = np.array([end_id], encoder.kind).tobytes()
        shard, block = TaskContext.get().partitionId(), 0
        docs, rows, size = [], [], 0
        for batch in text_slices(batches, text, CHUNK_BYTES):
            found, bounds = encoder.encode(batch.column(text).to_pylist())
            raw, cuts = found.tobytes(), (bounds * width).tolist()
            for doc, a, b in zip(batch.column(doc_id).to_pylist(), cuts[:-1], cuts[1:], strict=True):
                docs.append(doc)
                rows.append(raw[a:b] + end)
                size += len(rows[-1])
                if size >= BLOCK_IDS * width or len(docs) == BLOCK_DOCS:
                    yield pa.RecordBatch.from_pylist([_block(shard, block, docs, rows, width)], arrow)
                    docs, rows, size, block = [], [], 0, block + 1
        if docs:
            yield pa.RecordBatch.from_pylist([_block(shard, block, docs, rows, width)], arrow)

    slim = df.select(F.col(doc_id).alias(doc_id), F.col(text).alias(text))
    # Rows of one id, or of none, may be many: they are dealt over tasks by their contents' hash.
    tie = unused_name(slim, "_tie")
    ordered = slim.withColumn(tie, F.xxhash64(text)).repartitionByRange(doc_id, tie).sortWithinPartitions(doc_id, tie).drop(tie)
    ordered.mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids (array of int)."""
    return _documents(spark, folder, "ids array<int>", _as_lists)


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """As ``read``, with ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers) for the ids."""
    return _documents(spark, folder, "ids_crc32 long", _as_checksums)


_BOUNDS = ("bound_bits", "bound_low", "bound_high", "bound_samples")


def _slice(block: Row, place: int) -> np.ndarray:
    """The ids of the document at ``place`` in a block: its two offsets come by select, nothing else is decoded."""
    bounds = EliasFano(block.n_docs + 1, block.bound_bits, *(bytes(block[c]) for c in _BOUNDS[1:]))
    start, end = bounds.select(place), bounds.select(place + 1)
    return np.frombuffer(bytes(block.ids), f"<u{block.id_bytes}", end - start, start * block.id_bytes)


def read_one(spark: SparkSession, folder: str, shard: int, block: int, place: int) -> np.ndarray:
    """The ids of one document: that at ``place`` in its block."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder).where((F.col("shard") == shard) & (F.col("block") == block))
    found = blocks.select("n_docs", "id_bytes", "ids", *_BOUNDS).first()
    if found is None or not 0 <= place < found.n_docs:
        raise IndexError(f"no document {place} in block {block} of shard {shard}")
    return _slice(found, place)


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of each document with this id. Blocks tell their first and last id, so Parquet reads those that can have it."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    found = []
    for block in blocks.select("n_docs", "id_bytes", "ids", "doc_ids", "no_doc_id", *_BOUNDS).toLocalIterator():
        missing = np.unpackbits(np.frombuffer(block.no_doc_id, np.uint8))[: block.n_docs]
        found += [_slice(block, place) for place in np.flatnonzero((np.frombuffer(block.doc_ids, "<i8") == doc_id) & (missing == 0)).tolist()]
    return found


def _as_lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))


def _as_checksums(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    from zlib import crc32

    raw = memoryview(ids.astype("<u4").tobytes())
    return pa.array([crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.int64())


def _documents(spark: SparkSession, folder: str, column: str, form) -> DataFrame:
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("_all"))
    # One row per shard, that is per task of the writing stage.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_shards_before"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_blocks_before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    offsets = sizes.join(shards, "shard").select("shard", "block", (F.col("_blocks_before") + F.col("_shards_before")).alias("_base"))
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                bounds = EliasFano(b["n_docs"] + 1, b["bound_bits"], b["bound_low"], b["bound_high"], b["bound_samples"]).select(np.arange(b["n_docs"] + 1))
                ids = np.frombuffer(b["ids"], f"<u{b['id_bytes']}")
                missing = np.unpackbits(np.frombuffer(b["no_doc_id"], np.uint8))[: b["n_docs"]].astype(bool)
                docs = pa.array(np.frombuffer(b["doc_ids"], "<i8"), pa.int64(), mask=missing)
                n = b["n_docs"]
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(np.full(n, b["shard"], np.int32)), pa.array(np.full(n, b["block"], np.int32)), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), form(ids, bounds)],
                    names=["doc_id", "shard", "block", "_at", "n_tokens", name],
                )

    rows = blocks.mapInArrow(run, f"doc_id long, shard int, block int, _at long, n_tokens long, {column}")
    return rows.join(offsets, ["shard", "block"]).select("doc_id", (F.col("_at") + F.col("_base")).alias("start"), "n_tokens", name)
