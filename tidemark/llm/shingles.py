"""Word shingles of texts as 64-bit numbers, in numpy over a slice of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: The bytes of a lane that are a word's own, by how many there are.
_OWN = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them; another one for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Lanes:
    """The contents of some words, each as a row of 64-bit lanes, one word after another. A word has one lane at least."""

    def __init__(self, lanes: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> None:
        self.lanes, self.counts, self.sizes = lanes, counts, sizes
        self.first = np.cumsum(counts) - counts

    def numbers(self) -> np.ndarray:
        """A number for each word. Every lane is scattered by itself, with its place, before lanes are added, so sums
        of words that hold the same lanes elsewhere, or lanes that differ by a pattern, have nothing in common."""
        if not len(self.counts):
            return np.zeros(0, np.uint64)
        places = mix(np.arange(int(self.counts.max()), dtype=np.uint64), 3)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(self.lanes ^ places[np.arange(len(self.lanes)) - np.repeat(self.first, self.counts)]), self.first)
            return mix(sums + self.sizes.astype(np.uint64) * _STEP)

    def take(self, which: np.ndarray) -> Lanes:
        counts = self.counts[which]
        ends = np.cumsum(counts)
        at = np.repeat(self.first[which] - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        return Lanes(self.lanes[at], counts, self.sizes[which])

    def equal(self, other: Lanes, which: np.ndarray) -> np.ndarray:
        """Whether each word is the one at its place of ``which`` in ``other``: their contents are compared."""
        if not len(which):
            return np.zeros(0, bool)
        at = np.repeat(other.first[which] - self.first, self.counts) + np.arange(len(self.lanes))
        same = self.lanes == other.lanes[np.minimum(at, len(other.lanes) - 1)]
        return np.logical_and.reduceat(same, self.first) & (self.sizes == other.sizes[which])


def split(texts: pa.Array) -> tuple[Lanes, np.ndarray]:
    """The words of all texts, A-Z in lower case, and where each text's words begin (one entry more).
    Words are runs of bytes that are neither 0x20 nor 0x09 to 0x0D."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    none = np.zeros(0, np.int64)
    if not len(texts):
        return Lanes(none.view(np.uint64), none, none), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = bounds[:-1][bounds[:-1] < len(data)]  # a text's first byte begins a word even if the text before has no space at its end
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    sizes = np.flatnonzero(last) + 1 - starts
    counts = (sizes + 7) // 8
    lane = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    padded = np.concatenate((_LOWER[data], np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    lanes = eight[np.repeat(starts, counts) + 8 * lane] & _OWN[np.minimum(np.repeat(sizes, counts) - 8 * lane, 8)]
    return Lanes(lanes, counts, sizes), np.searchsorted(starts, bounds)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of all texts, A-Z in lower case, and where each text's words begin (one entry more)."""
    found, bounds = split(texts)
    return found.numbers(), bounds


def word_classes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``words``, but a word's number is the same as another's if and only if their contents are, which are compared."""
    found, bounds = split(texts)
    distinct, first, which = np.unique(found.numbers(), return_index=True, return_inverse=True)
    odd = np.flatnonzero(~found.equal(found, first[which]))
    more: dict[bytes, int] = {}
    for i in odd.tolist():  # words whose number is another word's: next to never
        content = found.lanes[found.first[i] : found.first[i] + found.counts[i]].tobytes() + int(found.sizes[i]).to_bytes(8, "little")
        which[i] = more.setdefault(content, len(distinct) + len(more))
    return which.astype(np.int64), bounds


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct ``width``-word shingles of each text; with fewer words, the sequence as one; without any, none."""
    return sets_of(*words(texts), width)


def sets_of(numbers: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """As ``shingle_sets``, from what ``words`` gave."""
    with np.errstate(over="ignore"):
        joined = numbers[: max(0, len(numbers) - width + 1)]
        for i in range(1, width):
            joined = mix(joined * _STEP + numbers[i : len(joined) + i])
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if end - start >= width:
                yield np.unique(joined[start : end - width + 1])
            elif end > start:
                short = numbers[start : start + 1]
                for i in range(start + 1, end):
                    short = mix(short * _STEP + numbers[i : i + 1])
                yield mix(short, 1 + end - start)  # never the number of a longer sequence but by chance
            else:
                yield np.zeros(0, np.uint64)


def exact_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """As ``shingle_sets``, with numbers that hold among these texts alone and are equal if and only if the shingles'
    words are."""
    classes, bounds = word_classes(texts)
    base = int(classes.max(initial=0)) + 1
    joined = classes[: max(0, len(classes) - width + 1)]
    for i in range(1, width):
        joined = np.unique(joined * base + classes[i : len(joined) + i], return_inverse=True)[1]
    short: dict[bytes, int] = {}
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - start >= width:
            yield np.unique(joined[start : end - width + 1])
        elif end > start:
            content = classes[start:end].tobytes()
            yield np.array([short.setdefault(content, -1 - len(short))])
        else:
            yield np.zeros(0, np.int64)
