"""Exact deduplication by a Grace hash: complete contents are compared, in buckets that fit into memory.

Each input partition is deduplicated first, so that a group of copies, however large, enters the shuffle with one
row per partition. The rows that are left are dealt by hash. A task builds an open-addressing table of distinct
contents; once these exceed a budget, records with further contents are partitioned to spill files by bits of the hash,
and each file is gone through in turn in the same way, again and again if need be. Records of a content that is in the
table are passed on at once and never kept, so memory holds distinct contents alone, however many copies there are.
Where all records of a content are needed together (a row for each partition that has it), they count into the budget
and are spilled with it. Spill files are scratch of one task in a folder of its own, gone when it ends; nothing else
reads them. What the first stage found is a written table in the shared folder, so both later reads see the same rows
even if executors are lost.

Defined results: null counts as the empty text; among equal texts the row with the largest doc_id stays (rows
without doc_id come last; of rows with equal doc_id, one stays); whole texts are compared; extra columns stay
out of the result; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import text_slices
from tidemark.llm.shared import unused_name, written

#: Bytes of distinct contents that a task keeps in memory before it spills.
BUDGET_BYTES = 32 << 20
#: Files that a bucket is spilled to; hash bits that choose among them.
FANOUT_BITS = 4
OUT_ROWS, OUT_BYTES = 2000, 4 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class ContentTable:
    """Open addressing with linear probing: hash and complete content decide, and each distinct content is kept once.
    Contents are compared in the form that ``normal`` gives them."""

    def __init__(self, normal: Callable[[bytes], bytes]) -> None:
        self.normal = normal
        self.contents: list[bytes] = []
        self.hashes: list[int] = []
        self.bytes = 0
        self.slots = np.full(1024, -1, np.int64)

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        for entry, h in enumerate(self.hashes):
            at = h & len(self.slots) - 1
            while self.slots[at] >= 0:
                at = at + 1 & len(self.slots) - 1
            self.slots[at] = entry

    def _place(self, h: int, content: bytes) -> int:
        """The slot that holds this content's entry, or the free one where it belongs."""
        at = h & len(self.slots) - 1
        while (entry := int(self.slots[at])) >= 0:
            if self.hashes[entry] == h and (self.contents[entry] == content or self.normal(self.contents[entry]) == self.normal(content)):
                break
            at = at + 1 & len(self.slots) - 1
        return at

    def find(self, h: int, content: bytes) -> int:
        """The number of this content's entry, -1 if it isn't there."""
        return int(self.slots[self._place(h, content)])

    def entry(self, h: int, content: bytes) -> int:
        """The number of this content's entry; a new one if it isn't there yet."""
        at = self._place(h, content)
        if (entry := int(self.slots[at])) >= 0:
            return entry
        self.slots[at] = entry = len(self.contents)
        self.contents.append(content)
        self.hashes.append(h)
        self.bytes += len(content) + 100
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry


#: A record: hash of the content, content, and whatever goes with it.
Record = tuple[int, bytes, Any]


def as_it_is(content: bytes) -> bytes:
    return content


def lower(content: bytes) -> bytes:
    return content.translate(_LOWER)


class _Spill:
    """The files that a bucket's records are partitioned to, by hash bits of its level."""

    def __init__(self, folder: Path, level: int) -> None:
        folder.mkdir()
        self.folder, self.shift = folder, 60 - level * FANOUT_BITS
        self.paths = [folder / str(i) for i in range(1 << FANOUT_BITS)]
        self.files = [p.open("wb") for p in self.paths]

    def add(self, record: Record) -> None:
        pickle.dump(record, self.files[record[0] >> self.shift & (1 << FANOUT_BITS) - 1], protocol=5)

    def buckets(self) -> Iterator[tuple[Iterator[Record], Path]]:
        """Each file's records, and a folder for what they may be spilled to."""
        for f in self.files:
            f.close()
        for i, path in enumerate(self.paths):
            yield _spilled(path), self.folder / f"below{i}"
            path.unlink()


def grace(records: Iterator[Record], budget: int, folder: Path, normal: Callable[[bytes], bytes] = as_it_is, level: int = 0) -> Iterator[tuple[int, bytes, Any] | None]:
    """The number of its content, the content and what goes with it for each record, as soon as that is known, and None
    at the end of a bucket, after which numbers begin again. Records in other spellings of a content keep their own."""
    table, spill = ContentTable(normal), None
    for record in records:
        h, content, more = record
        if spill is None and table.bytes > budget and (level + 1) * FANOUT_BITS <= 60:
            spill = _Spill(folder, level)
        entry = table.find(h, content) if spill else table.entry(h, content)
        if entry < 0:
            spill.add(record)
        else:
            own = table.contents[entry]
            yield entry, own if own == content else content, more
    if table.contents:
        yield None
    del table
    if spill:
        for below, place in spill.buckets():
            yield from grace(below, budget, place, normal, level + 1)


def grace_groups(records: Iterator[Record], budget: int, folder: Path, level: int = 0) -> Iterator[list[Any]]:
    """What goes with the records of each distinct content. All of a group is in memory at once; groups that don't fit
    together are spilled and taken one after another."""
    table, groups, size = ContentTable(as_it_is), [], 0
    for h, content, more in records:
        entry = table.entry(h, content)
        if entry == len(groups):
            groups.append([])
        groups[entry].append(more)
        size += 150
        if table.bytes + size > budget and len(groups) > 1 and (level + 1) * FANOUT_BITS <= 60:
            break
    else:
        yield from groups
        return
    spill = _Spill(folder, level)
    for h, content, group in zip(table.hashes, table.contents, groups, strict=True):
        for more in group:
            spill.add((h, content, more))
    del table, groups
    for record in records:
        spill.add(record)
    for below, place in spill.buckets():
        yield from grace_groups(below, budget, place, level + 1)


def _spilled(path: Path) -> Iterator[Record]:
    with path.open("rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``rows`` as Arrow batches of bounded size; a row's last value is its content or None."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if len(held) >= OUT_ROWS or size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _larger(a: int | None, b: int | None) -> bool:
    """Whether id ``a`` is larger than ``b``; nulls come last."""
    return a is not None and (b is None or a > b)


def _best(ids: list[int | None]) -> int:
    """The place of the largest id, the first of equal ones; nulls come last."""
    return max(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))


def _local(docs: DataFrame, budget: int) -> DataFrame:
    """A row per document with the number of its group within the partition (nth: its place in it), and a row per group
    with its size, content and largest doc_id, and the place of that (best)."""
    fields = [("doc_id", pa.int64()), ("text_sha256", pa.string()), ("task", pa.int64()), ("local", pa.int64()), ("nth", pa.int64()), ("best", pa.int64()), ("hash", pa.int64()), ("size", pa.int64()), ("content", pa.binary())]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        for batch in text_slices(batches, "text", OUT_BYTES):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                content = lower(text or b"")
                digest = sha256(content)
                yield int.from_bytes(digest.digest()[:8], "little"), content, (doc, digest.hexdigest())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        task, base = TaskContext.get().partitionId(), 0
        groups: list[list] = []  # of each content of the bucket: content, hash, rows, largest doc_id, its place
        with tempfile.TemporaryDirectory() as scratch:
            for found in grace(records(batches), budget, Path(scratch, "spill")):
                if found is None:
                    for local, (content, h, size, doc, best) in enumerate(groups, base):
                        yield doc, None, task, local, None, best, h, size, content
                    base += len(groups)
                    groups = []
                    continue
                number, content, (doc, digest) = found
                if number == len(groups):
                    groups.append([content, int.from_bytes(bytes.fromhex(digest[:16]), "little", signed=True), 0, doc, 0])
                group = groups[number]
                if _larger(doc, group[3]):
                    group[3:] = doc, group[2]
                yield doc, digest, task, base + number, group[2], None, None, None, None
                group[2] += 1

    schema = "doc_id long, text_sha256 string, task long, local long, nth long, best long, hash long, size long, content binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _in_batches(rows(batches), pa.schema(fields)), schema)


def _merged(local: DataFrame, budget: int) -> DataFrame:
    """For each partition's group (task, local): the whole group's keep_id and group_size, and the place in this
    partition's group of the row that stays, null if that is in another partition."""
    fields = [("task", pa.int64()), ("local", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("kept", pa.int64()), ("nothing", pa.binary())]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        for batch in text_slices(batches, "content", OUT_BYTES):
            columns = [batch.column(c).to_pylist() for c in ("hash", "content", "doc_id", "task", "local", "size", "best")]
            for h, content, *more in zip(*columns, strict=True):
                yield h % (1 << 64), content, tuple(more)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        with tempfile.TemporaryDirectory() as scratch:
            for members in grace_groups(records(batches), budget, Path(scratch, "spill")):
                members.sort(key=lambda m: m[1:3])
                best, size = _best([m[0] for m in members]), sum(m[3] for m in members)
                for i, (_, task, local, _, place) in enumerate(members):
                    yield task, local, members[best][0], size, place if i == best else None, None

    dealt = local.where("content is not null").select("hash", "content", "doc_id", "task", "local", "size", "best").repartition("hash")
    schema = "task long, local long, keep_id long, group_size long, kept long, nothing binary"
    return dealt.mapInArrow(lambda batches: _in_batches(rows(batches), pa.schema(fields)), schema).drop("nothing")


def exact_groups(docs: DataFrame, budget: int = BUDGET_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id long, text string); texts are
    equal when identical after lower-casing A-Z."""
    local = written(_local(docs, budget), "local-groups")
    found = local.where("content is null").select("doc_id", "text_sha256", "task", "local", "nth").join(_merged(local, budget), ["task", "local"])
    return found.select("doc_id", "keep_id", "group_size", F.col("kept").eqNullSafe(F.col("nth")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, budget: int = BUDGET_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, whole: one of each group of equal texts, as ``exact_groups`` keeps it. Rows that
    are no partition's best never leave it, so a row is shuffled once at most."""
    names, schema = docs.columns, docs.schema
    others, hashed = [n for n in names if n != "text"], unused_name(docs, "_hash")
    doc = others.index("doc_id")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        for batch in text_slices(batches, "text", OUT_BYTES):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, *row in zip(texts, *(batch.column(n).to_pylist() for n in others), strict=True):
                yield int.from_bytes(sha256(lower(text or b"")).digest()[:8], "little"), text or b"", (text is None, row)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = pa.schema([*(first.schema.field(n) for n in others), pa.field("text", pa.binary()), pa.field(hashed, pa.int64())])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
            return pa.RecordBatch.from_arrays([made.column(n).cast(pa.string()) if n == "text" else made.column(n) for n in (*names, hashed)], names=[*names, hashed])

        held, size = [], 0
        groups: list[tuple[bytes, bool, list]] = []  # the best row of each content of the bucket
        with tempfile.TemporaryDirectory() as scratch:
            for found in grace(records(chain([first], batches)), budget, Path(scratch, "spill"), lower):
                if found is not None:
                    number, content, (missing, row) = found
                    if number == len(groups):
                        groups.append((content, missing, row))
                    elif _larger(row[doc], groups[number][2][doc]):
                        groups[number] = content, missing, row
                    continue
                for content, missing, row in groups:
                    held.append((*row, None if missing else content, int.from_bytes(sha256(lower(content)).digest()[:8], "little", signed=True)))
                    size += len(content)
                    if size >= OUT_BYTES or len(held) >= OUT_ROWS:
                        yield table(held)
                        held, size = [], 0
                groups = []
        if held:
            yield table(held)

    wider = T.StructType([*schema.fields, T.StructField(hashed, T.LongType())])
    return docs.mapInArrow(best, wider).repartition(hashed).drop(hashed).mapInArrow(lambda batches: (b.select(names) for b in best(batches)), schema)
