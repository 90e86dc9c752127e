"""Similarity join of texts on word shingles: all pairs whose Jaccard similarity reaches a threshold, as components.

Multiple-global-order filtering. Under any one order of all shingles, two sets that are similar enough share a
shingle among the first few of each (the prefix). The join finds pairs that share prefix shingles under a first
order, keeps those that also do under each further order, and verifies what is left on the whole texts. All orders
put rare shingles first; they differ in how shingles of about the same frequency follow each other. How rare a
shingle is comes from a table of ``SLOTS`` counts over all documents (a fixed 16 MB, whatever the input; colliding
shingles share a count, and a count tells by how far it is above the usual one, in deviations, so that frequent shingles
stand out however full the slots are). It decides the order alone, so it can make the join slower, never wrong.

Before that, documents are contracted. Those with the same words in the same order count as one: the first of each
task stands for its copies there, so a group of copies enters a shuffle with a row per task. Those that agree in a
band of least hashes, or in all of their set, are compared with the band's leader. A band's documents are dealt over
``SALTS`` parts, in which it is found and where they meet it. So a group of thousands of near copies costs a comparison
or a few each, not all pairs, and no band is one task's. Links found so are true links, and pairs within a component needn't be looked for any more. Pairs that a shingle brings together are
dropped on the spot if their sizes, the places of the shingle or the parities of their sets show that they can't be
linked. Candidates for a shingle that very many sets have in their prefixes are split over a grid of tasks.

Shingles are 64-bit numbers until pairs are verified; there the words themselves are compared, so no link is owed to
numbers that agree by chance. (A link could be missed only if two different shingles of one text had one number.)
Texts are read again where they are needed. Before that, documents that aren't wanted are dropped by a bitmap that
is sized by the number of those that are, up to ``MOST_BITS`` (it may let some through, which the join drops).

Defined results: null texts and texts without words have an empty set, are linked with nothing and are their own
component; a row without doc_id has no component (null) and links nothing; rows that share a doc_id are one node;
texts are taken whole; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import returning_memory, text_slices
from tidemark.llm.components import components
from tidemark.llm.shared import written
from tidemark.llm.shingles import exact_sets, mix, sets_of, shingle_sets, split

#: Counts of shingles by hash: their number, how many go into one row, and parts in which a row's counts first meet.
SLOTS, SLOTS_A_ROW, ROW_PARTS = 1 << 24, 1 << 18, 16
#: A task counts in two bytes a slot (32 MB), and hands its counts on before one overflows.
MOST_COUNT = (1 << 16) - 1
#: Orders of the shingles, by the seed that breaks ties of frequency.
ORDERS = (101, 102, 103)
#: Bands of least hashes, two seeds each; one more band stands for the whole set.
BANDS = ((11, 12), (13, 14), (15, 16))
ALL_BANDS = tuple(f"band{i}" for i in range(len(BANDS) + 1))
#: Parts over which the documents of a band are dealt.
SALTS = 64
#: Contents of which a task remembers the first document, about 100 bytes each.
REMEMBERED = 200_000
#: A prefix shingle that so many more sets may have than the usual slot is split over a grid of tasks.
GRID_SETS = 4096
#: The class of the usual count, and how many classes further on the distance from it has doubled.
USUAL_CLASS, CLASSES_A_DOUBLING = 64, 7
CHUNK_BYTES = 1 << 19
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29


@dataclass(frozen=True)
class Join:
    """Shingles of ``width`` words; a link where 100 * intersection >= ``percent`` * union."""

    width: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        """Least number of first shingles of a set of ``n`` of which a similar set must share one."""
        return n - -(-n * self.percent // 100) + 1 if n else 0

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Of two sets of ``exact_sets``."""
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both) > 0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _summaries(docs: DataFrame, join: Join) -> DataFrame:
    """For each document its set's size, 128 bits of the SHA-256 of its words, the first document of this task with the
    same words, and its bands; and each task's slot counts."""

    names = ["doc_id", "n", "key1", "key2", "same_as", *ALL_BANDS, "slot_row", "counts"]

    def counted(table: np.ndarray) -> pa.RecordBatch:
        rows = []
        for i in range(SLOTS // SLOTS_A_ROW):
            part = table[i * SLOTS_A_ROW :][:SLOTS_A_ROW]
            slots = np.flatnonzero(part)
            if len(slots):
                rows.append((i, _packed(slots, part[slots])))
        empty = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([*[empty] * (len(names) - 2), pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, np.uint16)
        firsts: dict[bytes, int] = {}
        for batch in text_slices(batches, "text", CHUNK_BYTES):
            rows, seen, keys, same_as = [], [], [], []
            contents, bounds = split(batch.column("text"))
            lane_bounds = np.append(contents.first, len(contents.lanes))[bounds].tolist()
            for s in sets_of(contents.numbers(), bounds, join.width):
                seen.append(s)
                with np.errstate(over="ignore"):
                    bands = [mix(mix(s, a).min() * np.uint64(3) + mix(s, b).min(), a) if len(s) else np.uint64(0) for a, b in BANDS]
                    rows.append([*bands, mix(mix(s, 1).sum(dtype=np.uint64), 2)])
            for doc, a, b, c, d in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), lane_bounds[:-1], lane_bounds[1:], strict=True):
                key = sha256(contents.lanes[c:d].tobytes() + contents.sizes[a:b].tobytes()).digest()[:16]
                keys.append(key)
                if doc is not None and key not in firsts and len(firsts) >= REMEMBERED:
                    firsts.clear()
                same_as.append(None if doc is None else firsts.setdefault(key, doc))
            slots, counts = np.unique(_slot(np.concatenate(seen)), return_counts=True)
            if len(slots) and int((table[slots] + counts).max()) > MOST_COUNT:
                yield counted(table)
                table[:] = 0
            while len(counts) and counts.max() > MOST_COUNT:  # of one slice alone
                table[slots] = np.minimum(counts, MOST_COUNT)
                counts = counts - table[slots]
                yield counted(table)
                table[:] = 0
            table[slots] += counts.astype(np.uint16)
            columns = np.array(rows, np.uint64).T.copy().view(np.int64)
            key1, key2 = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2).T.copy()
            n = len(rows)
            sizes = pa.array(list(map(len, seen)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(key1), pa.array(key2), pa.array(same_as, pa.int64()), *map(pa.array, columns), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        yield counted(table)

    bands = "".join(f", {band} long" for band in ALL_BANDS)
    return docs.mapInArrow(returning_memory(run), f"doc_id long, n long, key1 long, key2 long, same_as long{bands}, slot_row int, counts binary")


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.uint32)


def _packed(slots: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending slots and their counts in few bytes."""
    width = "8" if len(counts) and int(counts.max()) >> 32 else "4"
    return zlib.compress(np.concatenate((np.diff(slots, prepend=0), counts)).astype(f"<u{width}").tobytes(), 1) + width.encode()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw[:-1]), f"<u{raw[-1:].decode()}").astype(np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def _class(counts: np.ndarray, usual: float) -> np.ndarray:
    """The class of frequency of slots with such counts, by how far they are from the usual one, in its own deviations. So
    shingles that are frequent stand out even when all slots hold millions of rare ones."""
    z = (counts - usual) / np.sqrt(usual + 1)
    return np.clip(np.round(USUAL_CLASS + np.sign(z) * CLASSES_A_DOUBLING * np.log2(1 + np.abs(z))), 0, 255).astype(np.uint8)


def _beyond(classes: np.ndarray, usual: float) -> np.ndarray:
    """About how many more documents than usual a slot of some class counts, which are those of a frequent shingle."""
    return np.sqrt(usual + 1) * (2 ** (np.maximum(classes.astype(float) - USUAL_CLASS, 0) / CLASSES_A_DOUBLING) - 1)


def _rarity(summaries: DataFrame) -> tuple[np.ndarray, float]:
    """Each slot's class of frequency, and the usual count: the median."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                slots, counts = _unpacked(raw.as_py())
                sums.setdefault(row, np.zeros(SLOTS_A_ROW, np.int64))[slots] += counts
        for row, x in sums.items():
            slots = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([float(np.median(x))]), pa.array([_packed(slots, x[slots])], pa.binary())], names=["slot_row", "median", "counts"])

    # A row's counts meet in some parts first, so no task gets those of all others.
    parts = summaries.where("slot_row is not null").select("slot_row", "counts", F.pmod(F.crc32("counts"), F.lit(ROW_PARTS)).alias("part"))
    schema = "slot_row int, median double, counts binary"
    parts = parts.repartition("slot_row", "part").select("slot_row", "counts").mapInArrow(add, schema).select("slot_row", "counts")
    sums = written(parts.repartition("slot_row").mapInArrow(add, schema), "slots")
    medians = [r["median"] for r in sums.select("median").collect()]  # SLOTS / SLOTS_A_ROW of them
    usual = float(np.median(medians + [0.0] * (SLOTS // SLOTS_A_ROW - len(medians))))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column("counts"):
                slots, counts = _unpacked(x.as_py())
                table = np.zeros(SLOTS_A_ROW, np.int64)
                table[slots] = counts
                found.append(_class(table, usual).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("slot_row"), pa.array(found, pa.binary())], names=["slot_row", "classes"])

    classes = np.full(SLOTS, _class(np.zeros(1), usual)[0], np.uint8)
    for row in sums.mapInArrow(classed, "slot_row int, classes binary").collect():  # SLOTS bytes, whatever the input
        classes[row.slot_row * SLOTS_A_ROW :][:SLOTS_A_ROW] = np.frombuffer(row.classes, np.uint8)
    return classes, usual


def _sides(classes: np.ndarray, usual: float) -> np.ndarray:
    """The side of the grid over which shingles of some classes are split: 1 for all but hot ones."""
    return np.maximum(1, np.ceil(_beyond(classes, usual) / GRID_SETS)).astype(np.int32)


def _ordered(s: np.ndarray, seed: int, classes: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` shingles of a set: rare ones first, then by a hash of their own for each seed."""
    key = (classes[_slot(s)].astype(np.uint64) << np.uint64(56)) | (mix(s, seed) >> np.uint64(8))
    if most < len(s):
        part = np.argpartition(key, most - 1)[:most]
        s, key = s[part], key[part]
    return s[np.argsort(key)]


def _prefixes(docs: DataFrame, join: Join, seeds: tuple[int, ...], rarity: tuple[np.ndarray, float], keep: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n, common, parity0, parity1, p0, p1, ...): each document's prefix under each order; ``sides``: the grid's
    side for the shingles of p0, null if all are 1; ``common``: how frequent its shingles are on average. The parities say of 128 classes of shingles whether the set has an odd
    number of each: two sets differ by at least as many shingles as their parities by bits."""
    shared = docs.sparkSession.sparkContext.broadcast((*rarity, keep))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, usual, bits = shared.value
        for batch in text_slices(_kept(batches, bits), "text", CHUNK_BYTES):
            sizes, grid, parities, common, prefixes = [], [], [], [], [[] for _ in seeds]
            for s in shingle_sets(batch.column("text"), join.width):
                sizes.append(len(s))
                common.append(float(classes[_slot(s)].mean()) if len(s) else 0.0)
                parities.append(np.packbits(np.bincount((mix(s, 31) & np.uint64(127)).astype(np.int64), minlength=128) & 1))
                for seed, out in zip(seeds, prefixes, strict=True):
                    out.append(_ordered(s, seed, classes, join.prefix(len(s))))
                side = _sides(classes[_slot(prefixes[0][-1])], usual)
                grid.append(side.tolist() if (side > 1).any() else None)
            arrays = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(_signed(np.concatenate(out)))) for out in prefixes]
            names = ["doc_id", "n", "common", "parity0", "parity1", "sides", *(f"p{i}" for i in range(len(seeds)))]
            parity = np.concatenate(parities).view(np.int64).reshape(-1, 2).T.copy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(common), *map(pa.array, parity), pa.array(grid, pa.list_(pa.int32())), *arrays], names=names)

    fields = "".join(f", p{i} array<long>" for i in range(len(seeds)))
    return docs.mapInArrow(returning_memory(run), f"doc_id long, n int, common double, parity0 long, parity1 long, sides array<int>{fields}")


def _bit(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64), 7) % np.uint64(size)).astype(np.int64)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap in which every document of ``ids`` (columns of doc_ids) has its bit set: eight to sixteen bits a row of
    ``ids``, ``MOST_BITS`` at most. Each task's part of it is a row only for the stretches it uses."""
    size = 1 << max(LEAST_BITS.bit_length() - 1, min(MOST_BITS.bit_length() - 1, (8 * len(ids.columns) * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(size // 8, np.uint8)
        for batch in batches:
            bit = _bit(np.concatenate([c.to_numpy() for c in batch.columns]), size)
            np.bitwise_or.at(packed, bit >> 3, (128 >> (bit & 7)).astype(np.uint8))
        packed = packed.reshape(-1, 4096)
        used = np.flatnonzero(packed.any(axis=1))
        for start in range(0, len(used), 256):
            some = used[start : start + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[i].tobytes() for i in some], pa.binary())], names=["part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts[part] = parts.get(part, np.uint8(0)) | np.frombuffer(raw.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])

    schema = "part int, bits binary"
    packed = np.zeros((size // 8 // 4096, 4096), np.uint8)
    for row in ids.mapInArrow(run, schema).repartition("part").mapInArrow(merge, schema).collect():  # MOST_BITS at most
        packed[row.part] = np.frombuffer(row.bits, np.uint8)
    return packed.ravel()


def _kept(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The rows whose doc_id has its bit set; all if there is no bitmap; never rows without doc_id."""
    for batch in batches:
        ids = batch.column("doc_id")
        keep = np.asarray(ids.is_valid())
        if bits is not None:
            bit = _bit(ids.fill_null(0).to_numpy(), 8 * len(bits))
            keep &= (bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
        if keep.any():
            yield batch.filter(pa.array(keep))


def _verified(pairs: DataFrame, docs: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose texts are linked."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(pairs.select("a", "b")))  # of bounded size
    wanted = docs.mapInArrow(lambda batches: _kept(batches, bits.value), docs.schema)
    # A leader is in very many pairs: its text meets them in SALTS parts.
    salted = pairs.select("a", "b", _salt("a").alias("salt"))
    left = salted.join(wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    right = salted.select("b", "salt").distinct().join(wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(text_slices(batches, "text_a", CHUNK_BYTES), "text_b", CHUNK_BYTES):
            sets = list(exact_sets(pa.concat_arrays([batch.column("text_a"), batch.column("text_b")]), join.width))
            n = batch.num_rows
            yield batch.select(["a", "b"]).filter(pa.array([join.linked(x, y) for x, y in zip(sets[:n], sets[n:], strict=True)], pa.bool_()))

    return left.join(right, ["b", "salt"]).select("a", "b", "text_a", "text_b").mapInArrow(returning_memory(run), "a long, b long")


def _salt(doc: str) -> Column:
    return F.pmod(F.xxhash64(doc, F.lit(9)), F.lit(SALTS)).cast("int")


def _leader_pairs(sets: DataFrame) -> DataFrame:
    """Each set paired with the leader of each of its bands: the one with the most common shingles, as the text that others
    were made from has few of its own and is like most of them. A band's documents are dealt over parts; its leader is
    that of the parts' leaders, and goes back to the parts first and from there to their documents."""
    bands = F.array(*(F.struct(F.lit(i).alias("i"), F.col(band).alias("band")) for i, band in enumerate(ALL_BANDS)))
    rows = sets.select("doc_id", "common", F.inline(bands)).withColumn("salt", _salt("doc_id"))
    rank = F.struct("common", F.xxhash64("doc_id", "i").alias("tie"), F.col("doc_id").alias("lead"))
    parts = rows.groupBy("i", "band", "salt").agg(F.max(rank).alias("first"), F.count("*").alias("rows"))
    tops = parts.groupBy("i", "band").agg(F.max("first")["lead"].alias("b"), F.sum("rows").alias("all")).where("all > 1")
    led = parts.select("i", "band", "salt").join(tops, ["i", "band"]).select("i", "band", "salt", "b")
    return rows.join(led, ["i", "band", "salt"]).select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()


def _candidates(postings: DataFrame, join: Join) -> DataFrame:
    """Pairs of sets in different components that share a shingle of the first order's prefixes, where sizes, places and parities allow a link."""

    def pairs(token: np.ndarray, cell: np.ndarray, part: np.ndarray, doc: np.ndarray, n: np.ndarray, pos: np.ndarray, parity0: np.ndarray, parity1: np.ndarray) -> Iterator[np.ndarray]:
        rest = n - pos
        # Rows of a shingle are in the order of components, and each meets those after its own component's.
        new = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])
        begins = np.append(0, np.flatnonzero(new) + 1)[: len(token)]
        at = np.arange(len(token))
        to = np.repeat(np.append(begins[1:], len(token)), np.diff(np.append(begins, len(token))))
        while len(at):
            inside = to < len(token)
            at, to = at[inside], to[inside]
            same = (token[at] == token[to]) & (cell[at] == cell[to])
            at, to = at[same], to[same]
            both = n[at] + n[to]
            least = -(-join.percent * both // (100 + join.percent))  # shingles that must be common
            # At the first shingle that two sets share, no more than the rest of either can be common.
            fits = np.minimum(rest[at], rest[to]) >= least
            fits &= np.bitwise_count(parity0[at] ^ parity0[to]).astype(np.int64) + np.bitwise_count(parity1[at] ^ parity1[to]) <= both - 2 * least
            if fits.any():
                a, b = doc[at[fits]], doc[to[fits]]
                yield np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            to = to + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None  # the last shingle's rows, as it may go on in the next batch
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            sizes = batch.column(4).to_numpy()
            columns += [sizes >> 32, sizes & 0xFFFFFFFF, *(batch.column(i).to_numpy().view(np.uint64) for i in (5, 6))]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            new = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))
            last = int(new[-1]) + 1 if len(new) else 0
            kept = [c[last:] for c in columns]
            yield from out(pairs(*(c[:last] for c in columns)))
        if kept is not None:
            yield from out(pairs(*kept))

    def out(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x in found:
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    ordered = postings.repartition("token", "cell").sortWithinPartitions("token", "cell", "part")
    return ordered.mapInArrow(returning_memory(run), "a long, b long").distinct()


def _postings(prefixes: DataFrame, parts: DataFrame) -> DataFrame:
    """A row for each shingle of each distinct set's prefix; those of a hot shingle go to all cells of a row and a column of its grid."""
    rows = prefixes.join(parts, "doc_id").select("doc_id", "part", "n", "parity0", "parity1", "sides", F.posexplode("p0").alias("pos", "token"))
    side = F.coalesce(F.get("sides", F.col("pos")), F.lit(1))
    own = F.pmod(F.xxhash64("doc_id"), side).cast("int")
    cells = F.transform(F.sequence(F.lit(0), side - 1), lambda j: F.least(own, j) * side + F.greatest(own, j))
    rows = rows.withColumn("cell", F.explode(F.when(side == 1, F.array(F.lit(0))).otherwise(cells)))
    return rows.select("token", "cell", "part", "doc_id", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("n_pos"), "parity0", "parity1")


def similar_components(docs: DataFrame, join: Join = Join(), bands: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id long, text string): the size of its set,
    and the smallest doc_id that can be reached from it over links. Without ``bands`` every link but those of equal texts
    is found by the orders alone, with the same result; with them, groups of many near copies cost less."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    summaries = written(_summaries(docs, join), "summaries")
    rarity = _rarity(summaries)
    rows = summaries.where("slot_row is null")
    real = rows.where("n > 0 and doc_id is not null")
    firsts = real.where("same_as = doc_id")
    sets = written(firsts.groupBy("key1", "key2").agg(F.min("doc_id").alias("doc_id"), *(F.first(band).alias(band) for band in ALL_BANDS)), "sets")
    copies = firsts.select("key1", "key2", F.col("doc_id").alias("a")).join(sets.select("key1", "key2", F.col("doc_id").alias("b")), ["key1", "key2"]).select("a", "b")
    same = real.select(F.col("doc_id").alias("a"), F.col("same_as").alias("b")).unionByName(copies).where("a <> b")

    first = written(_prefixes(docs, join, ORDERS[:1], rarity, _bitmap(sets.select("doc_id"))), "prefixes")
    near = docs.sparkSession.createDataFrame([], "a long, b long")
    if bands:
        near = written(_verified(written(_leader_pairs(sets.join(first.select("doc_id", "common"), "doc_id")), "leaders"), docs, join), "near")
    roots = components(near)
    parts = sets.select("doc_id").distinct().join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("part"))

    found = written(_candidates(_postings(first, parts), join), "candidates")
    others = _prefixes(docs, join, ORDERS[1:], rarity, _bitmap(found.select("a", "b")))
    sides = [others.select(F.col("doc_id").alias(c), *(F.col(f"p{i}").alias(f"{c}{i}") for i in range(len(ORDERS) - 1))) for c in ("a", "b")]
    shared = found.join(sides[0], "a").join(sides[1], "b")
    for i in range(len(ORDERS) - 1):
        shared = shared.where(F.arrays_overlap(f"a{i}", f"b{i}"))
    links = _verified(written(shared.select("a", "b").distinct(), "shared"), docs, join)

    roots = components(links.unionByName(near).unionByName(same))
    return rows.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
