"""The words of the byte-level pre-tokenizer in numpy, and encoders that look distinct words up in a table.

Its pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. So a word begins

- where the class of characters (letter, number, white space, other) changes, but one space right before a run of
  another class belongs to that run;
- at the last white space before something else;
- after a contraction that begins a run of other characters by itself.

Words are looked up by a 64-bit number in sorted arrays. Their contents are kept there too and compared on every hit,
so a word never gets another's ids.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from tidemark.llm.shingles import Lanes

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a Python worker keeps, about 60 bytes each, and the lanes of their contents, of three characters.
CACHE_WORDS, CACHE_LANES = 300_000, 1_500_000
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    kinds = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            kinds[ord(found[0][0]) : ord(found[0][-1]) + 1] = kind
    return kinds


def word_lanes(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Lanes:
    """The contents of the words that begin at ``starts``, three code points of 21 bits to a lane."""
    counts = (sizes + 2) // 3
    lane = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at, left = np.repeat(starts, counts) + 3 * lane, np.repeat(sizes, counts) - 3 * lane
    padded = np.concatenate((points, np.zeros(2, points.dtype)))
    lanes = padded[at].astype(np.uint64)
    for i in (1, 2):
        lanes |= np.where(left > i, padded[at + i], 0).astype(np.uint64) << np.uint64(21 * i)
    return Lanes(lanes, counts, sizes)


def word_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a word begins at each code point of some texts one after another; text i begins at ``bounds[i]``."""
    kinds = _classes()[points]
    n = len(points)
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins = np.ones(n, bool)
    begins[1:] = kinds[1:] != kinds[:-1]
    begins[heads] = True
    spaced = np.zeros(n, bool)
    spaced[1:] = points[:-1] == 32
    spaced[heads] = False
    white = kinds == _SPACE
    starts = begins & (white | ~spaced)
    follows = np.zeros(n + 1, bool)  # something else follows in the same text
    follows[:n] = begins
    follows[heads] = False
    starts |= white & follows[1:]
    quotes = np.flatnonzero((points == 39) & starts)
    quotes = quotes[~spaced[quotes]]
    if len(quotes):
        ends = bounds[np.searchsorted(bounds, quotes, side="right")]
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        a, b = padded[quotes + 1], padded[quotes + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & (quotes + 1 < ends)
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (quotes + 2 < ends)
        for found, size in ((quotes[one], 2), (quotes[two & ~one], 3)):
            starts[found + 1] = False
            after = found + size
            after = after[after < bounds[np.searchsorted(bounds, found, side="right")]]
            inside = kinds[after] == _LETTER
            starts[after[inside]] = True
    return starts


class TableEncoder:
    """Ids of texts from those of their distinct words, which a subclass finds."""

    def __init__(self, special: list[str], kind: type = np.int32) -> None:
        self.special = special
        self.kind = kind
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.at, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.kind)
        self.contents = Lanes(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and the number of each word's ids. Special tokens are words of their own."""
        raise NotImplementedError

    def _learn(self, hashes: np.ndarray, contents: Lanes, words: list[str]) -> None:
        ids, sizes = self.word_ids(words)
        at = np.concatenate((self.at, len(self.flat) + np.cumsum(sizes) - sizes))
        hashes, sizes = np.concatenate((self.hashes, hashes)), np.concatenate((self.sizes, sizes))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.sizes, self.flat = hashes[order], at[order], sizes[order], np.concatenate((self.flat, ids))
        both = [np.concatenate(x) for x in zip((self.contents.lanes, self.contents.counts, self.contents.sizes), (contents.lanes, contents.counts, contents.sizes), strict=True)]
        self.contents = Lanes(*both).take(order)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def _slow(self, text: str) -> np.ndarray:
        """The ids of a text in which special tokens occur."""
        parts = self.cut.split(text)
        words = [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.pattern.findall(part))]
        return self.word_ids(words)[0]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids begin (one more entry); null counts as empty."""
        texts = [text or "" for text in texts]
        slow = {i: self._slow(text) for i, text in enumerate(texts) if any(s in text for s in self.special)}
        plain = ["" if i in slow else text for i, text in enumerate(texts)]
        whole = "".join(plain)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *map(len, plain)])
        if len(points):
            begins = word_starts(points, bounds)
            starts = np.flatnonzero(begins)
            ends = np.append(starts[1:], len(points))
            lengths = ends - starts
            contents = word_lanes(points, starts, lengths)
            hashes = contents.numbers()
            distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            own = contents.take(first)
            if len(self.hashes) + len(distinct) > CACHE_WORDS or len(self.contents.lanes) + len(own.lanes) > CACHE_LANES:
                self._forget()
            new = first[~self._places(distinct)[1]]
            if len(new):
                self._learn(hashes[new], contents.take(new), [whole[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = self._places(distinct)[0]
            known = contents.equal(own, which) & own.equal(self.contents, at)[which]
            flat, places, sizes = self.flat, self.at[at][which], self.sizes[at][which]
            odd = np.flatnonzero(~known)
            if len(odd):  # words whose number is another word's: next to never
                more, counts = self.word_ids([whole[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)])
                places[odd], sizes[odd] = len(flat) + np.cumsum(counts) - counts, counts
                flat = np.concatenate((flat, more))
            ids, sizes = gather(flat, places, sizes)
            upto = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(starts, bounds)]
        else:
            ids, upto = np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64)
        if slow:
            rows = [slow[i] if i in slow else ids[upto[i] : upto[i + 1]] for i in range(len(texts))]
            ids, upto = np.concatenate(rows).astype(self.kind), np.cumsum([0, *map(len, rows)])
        return ids, upto


def gather(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``flat[at : at + size]`` one after another, and the sizes."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(at - ends + sizes, sizes) + np.arange(total)], sizes
