"""Personal data by a semi-Markov conditional random field over whole spans.

Base spans come from fixed patterns and always stay. The field scores every way to split a text's tokens into
segments: an entity of a kind and at most ``MOST_TOKENS`` tokens, or a single token that is none. A segment's score
comes from features of the whole span (its digits, separators, check sum, shape, neighbours), and dynamic programming
over the bounded lengths finds the best split, so boundaries and kinds are chosen jointly. Entities of that split
that touch no base span and whose own score beats leaving their tokens outside by ``MARGIN`` are added: addresses
spelt with "[at]", phone numbers without country sign, numbers that a base match lost among others, keys and passwords
(kind ``secret``, which has no base spans). A number of a card's length with a wrong check sum is none.

Tokens, candidate segments and their features are made in numpy, for all texts of a slice of a batch at once, a
stretch of ``STRETCH`` tokens at a time. A segment that gains nothing over leaving its tokens outside is in no best
split, so only the others go into the dynamic programme; between them the best split is that of the single tokens.
So the time is linear in the text and memory that of a stretch, whatever the text holds.

The field is trained here, by gradient steps on the conditional likelihood of at most ``LEARN_WINDOWS`` windows of
the corpus (those first by a hash), of ``LEARN_TOKENS`` tokens at most: the tokens round a trigger (digits, "@", a
spelt "at", a word such as "password"). Base spans and values after such a word are the truth in them, and some are
rewritten in other spellings of the same data, so that the span features, not the pattern, carry the weight; besides
them stand ``MADE_SECRETS`` made-up secrets of all lengths from 16 to 128 and of letters, digits or both.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no spans; whole texts are
searched; without any window to learn from, base spans alone are found; extra columns pass through, but for one
named like the output, which is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import text_slices, with_columns, with_fields

#: Kinds with base patterns, and all kinds that the field knows.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
LEARN_WINDOWS, LEARN_TOKENS, LEARN_CHARS, EPOCHS, RATE, RIDGE = 320, 60, 600, 40, 1.0, 0.001
MOST_TOKENS, MARGIN = 24, 1.5
STRETCH = 4096
CHUNK_BYTES = 1 << 20

#: The contract's patterns. Where a match can only begin at a run's first character, a look-behind says so, to keep the search linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words that a secret follows, in lower case, and the secrets that windows are learned from.
SECRET_WORDS = ("token", "password", "passwd", "secret", "apikey", "key")
LEAST_SECRET = 16
_SECRET = re.compile(r"(?i:\b(?:token|password|passwd|secret|api[_-]?key|key))[ ]?[=:][ ]?[\"']?([A-Za-z0-9]{16,128})(?![A-Za-z0-9])")
#: Numbers that are nobody's data, which are learned as such whatever the corpus holds.
PLAIN = (
    "version 3 of 2024-01-01, page 12, order 12345678", "on 31.12.2023 at 12:30 or 2024-05-17T08:15:00", "release 1.2.3 and 10.0.1, build 20240517", "isbn 978-3-16-148410-0", "a sum of 1,234,567.89 in 1999-2004",
    "no. 20953013749 of 47853805923911", "meet [at] noon (at) 5 pm", "lines 100 - 250 (2 of 7)", "section 4.2.1.3 and 4.2.10", "commit deadbeef12345678 in file2345", "500 + 1200 = 1700", "key = 5 and token: none",
)
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and then start."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and what can stand between them
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


_LETTERS, _DIGITS, _SPACE_TOKEN, _MARK, _BREAK = range(5)
_MARKS = ".@+-()_%[]"


@lru_cache(maxsize=1)
def _char_kinds() -> np.ndarray:
    """What a code point below 256 is: a letter, a digit, a space, a mark that an entity may hold, or neither."""
    kinds = np.full(256, _BREAK, np.uint8)
    kinds[[*range(65, 91), *range(97, 123)]] = _LETTERS
    kinds[48:58] = _DIGITS
    kinds[32] = _SPACE_TOKEN
    kinds[[ord(c) for c in _MARKS]] = _MARK
    return kinds


FEATURES = (
    "one_at", "spelt_at", "domain", "letters", "spaces", "four_parts", "dotted", "luhn", "d_few", "d_phone", "d_long", "d_card", "d_more", "country",
    "plus", "area", "groups_phone", "groups_card", "open_pair", "odd_ends", "mixed_run", "after_word", "one_run", "long_run", "left_open", "right_open", "always",
)
OUTSIDE = ("digits", "some_digits", "many_digits", "sign", "long_mixed", "always")


class Lattice:
    """Some text's tokens, its candidate segments and their features.

    Letters, digits: a run of them is a token, and any other character is one by itself. A run of 16 or more letters
    and digits is one token if both occur in it. No segment crosses a character that entities can't hold."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.where(points < 256, _char_kinds()[np.minimum(points, 255)], _BREAK)
        n = len(points)
        begins = np.ones(n, bool)
        begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] > _DIGITS)
        word = kinds <= _DIGITS
        runs = np.flatnonzero(word & np.append(True, ~word[:-1])[:n])
        run_ends = np.flatnonzero(word & np.append(~word[1:], True)[:n]) + 1
        upto = np.append(0, np.cumsum(begins))
        mixed = (run_ends - runs >= 16) & (upto[run_ends] - upto[runs] > 1)
        marks = np.zeros(n + 1, np.int8)
        marks[runs[mixed]], marks[run_ends[mixed]] = 1, marks[run_ends[mixed]] - 1
        whole = np.cumsum(marks)[:n] > 0  # a run that is one token
        begins &= ~whole
        begins[runs[mixed]] = True
        self.starts = np.append(np.flatnonzero(begins), n)
        starts = self.starts[:-1]
        self.points = points
        self.count = len(starts)
        self.kinds = kinds[starts]
        self.mixed = whole[starts]
        self.sizes = np.diff(self.starts).astype(np.int32)
        self.first = points[starts]
        digit = kinds == _DIGITS
        self.char_digits = np.append(np.int32(0), np.cumsum(digit, dtype=np.int32))
        values = (points[digit] - 48).astype(np.int64)
        double = 2 * values - 9 * (values > 4)
        even = np.arange(len(values)) % 2 == 0
        self.sums = [np.append(0, np.cumsum(np.where(even == side, double, values))) for side in (True, False)]
        self._places()

    def _is(self, char: str) -> np.ndarray:
        return (self.first == ord(char)) & ~self.mixed

    def _spelt(self, word: str) -> np.ndarray:
        """Tokens that are ``word``, in any case of letters."""
        found = (self.sizes == len(word)) & (self.kinds == _LETTERS) & ~self.mixed
        at = self.starts[:-1][found]
        same = np.ones(len(at), bool)
        for i, c in enumerate(word):
            same &= (self.points[at + i] | 32) == ord(c)
        found[found] = same
        return found

    def _places(self) -> None:
        """What is said of single tokens, with room behind and before for their neighbours."""
        n = self.count
        pad = MOST_TOKENS + 2

        def padded(x: np.ndarray, fill: object = 0) -> np.ndarray:
            return np.concatenate((np.full(pad, fill, x.dtype), x, np.full(pad, fill, x.dtype)))

        self.pad = pad
        digits, letters = (self.kinds == _DIGITS) & ~self.mixed, (self.kinds == _LETTERS) & ~self.mixed
        alnum = digits | letters | self.mixed
        ends = self.char_digits[self.starts]
        self.digit_at = np.concatenate((np.zeros(pad, ends.dtype), ends, np.full(pad, ends[-1])))
        opened, closed = self._is("(") | self._is("["), self._is(")") | self._is("]")
        at_word = padded(self._spelt("at"))
        self.p = {
            "digits": padded(digits), "letters": padded(letters), "alnum": padded(alnum), "mixed": padded(self.mixed), "size": padded(self.sizes),
            "space": padded(self._is(" ")), "dot": padded(self._is(".")), "sign": padded(self._is("@")), "plus": padded(self._is("+")), "open": padded(opened), "close": padded(closed),
            "round": padded(self._is("(").astype(np.int8) - self._is(")")), "square": padded(self._is("[").astype(np.int8) - self._is("]")),
            "dash": padded(self._is("-")), "near_left": padded(alnum | np.isin(self.first, [ord(c) for c in "@.+-_%"])), "near_right": padded(alnum | np.isin(self.first, [ord(c) for c in "@-_%"])),
            "inside": padded(alnum | (self.kinds == _MARK) | self._is(" ")),
        }
        p = self.p
        p["spelt"] = np.zeros(n + 2 * pad, bool)
        p["spelt"][1:-1] = at_word[1:-1] & p["open"][:-2] & p["close"][2:]
        p["may_at"] = np.zeros(n + 2 * pad, bool)
        p["may_at"][1:] = at_word[1:] & p["open"][:-1]
        p["dot_word"] = padded(self._spelt("dot"))
        word = np.zeros(n, bool)
        for w in SECRET_WORDS:
            word |= self._spelt(w)
        # What stands between such a word and its value: spaces, "=", ":" and quotes, four of them at most.
        between = np.isin(self.first, [ord(c) for c in " =:\"'"]) & ~self.mixed
        after, reach = np.zeros(n, bool), word
        for _ in range(4):
            reach = np.append(False, reach[:-1])[:n] & between
            after[1:] |= reach[:-1]
        p["after_word"] = padded(after & ~between)
        # A long run after such a word may be its value, whatever it holds.
        p["value"] = padded(after & ~between & (self.kinds <= _DIGITS) & (self.sizes >= LEAST_SECRET))
        # 255 at most, and the value of a token of digits with up to three of them.
        at = self.starts[:-1]
        value = np.full(n, 999)
        small = digits & (self.sizes <= 3)
        v = np.zeros(int(small.sum()), np.int64)
        for i in range(3):
            more = self.sizes[small] > i
            v = np.where(more, v * 10 + self.points[np.minimum(at[small] + i, len(self.points) - 1)].astype(np.int64) - 48, v)
        value[small] = v
        p["octet"] = padded(value <= 255)
        zeros = digits & (self.sizes >= 3) & (self.first == 48)
        zeros[zeros] = self.points[at[zeros] + 1] == 48
        p["zeros"] = padded(zeros)
        double = digits & (self.sizes == 2) & (self.first == 48)
        double[double] = self.points[at[double] + 1] == 48
        p["double_zero"] = padded(double)
        p["code"] = padded(digits & (self.sizes <= 3))
        p["fours"] = padded(digits & (self.sizes % 4 == 0))
        p["gap"] = padded(self._is(" ") | self._is("-"))
        p["end_gap"] = p["gap"] | p["dot"] | p["open"] & (p["round"] > 0)
        area = padded(digits & (self.sizes >= 2) & (self.sizes <= 4))
        p["area"] = np.zeros(n + 2 * pad, bool)
        p["area"][1:-1] = area[1:-1] & (p["round"][:-2] > 0) & (p["round"][2:] < 0)
        self.totals = {k: np.append(np.int32(0), np.cumsum(p[k], dtype=np.int32)) for k in ("letters", "space", "dot", "sign", "round", "square", "area", "spelt", "fours", "gap", "digits", "mixed", "may_at")}
        self.alone = np.stack([digits, digits & (self.sizes >= 3), digits & (self.sizes >= 8), self._is("@") | self._is("+"), self.mixed, np.ones(n, bool)], axis=1).astype(np.float32)
        # The token up to which a segment that begins here may reach: no further than a character that entities can't hold, or two spaces.
        stop = ~p["inside"]
        stop[1:] |= p["space"][1:] & p["space"][:-1]
        places = np.arange(n + 2 * pad)
        self.reach = np.minimum.accumulate(np.where(stop, places, n + 2 * pad)[::-1])[::-1]

    def stretches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The candidate segments and their features, ``STRETCH`` first tokens at a time: first token, end, features."""
        p, t, pad = self.p, self.totals, self.pad
        begins = p["alnum"] | p["plus"] | p["open"] & (p["round"] > 0)
        # A segment holds digits, an "@" or a spelt "at", or is a mixed run or a value; there's one of these soon after where it begins.
        hot = np.append(0, np.cumsum(p["digits"] | p["sign"] | p["may_at"] | p["mixed"] | p["value"], dtype=np.int64))
        first = np.flatnonzero(begins)
        first = first[hot[np.minimum(first + MOST_TOKENS, len(hot) - 1)] > hot[first]]
        lengths = np.arange(1, MOST_TOKENS + 1)
        for at in range(0, len(first), STRETCH):
            i = np.repeat(first[at : at + STRETCH], MOST_TOKENS)
            j = i + np.tile(lengths, len(i) // MOST_TOKENS)
            fits = (j <= self.reach[i]) & p["alnum"][j - 1]
            i, j = i[fits], j[fits]

            def many(name: str, i: np.ndarray = i, j: np.ndarray = j) -> np.ndarray:
                return t[name][j] - t[name][i]

            letters, spelt = many("letters") > 0, (many("sign") > 0) | (many("may_at") > 0)
            digits = many("digits") > 0
            mixed = many("mixed") > 0
            keep = np.where(mixed, j - i == 1, np.where(letters, spelt, digits))
            # A spelt address has spaces only round its "at".
            keep &= ~letters | (many("space") <= 2)
            keep |= p["value"][i] & (j - i == 1)
            i, j = i[keep], j[keep]
            if len(i):
                yield i - pad, j - pad, self._features(i, j)

    def _features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        p, t = self.p, self.totals
        n = j - i

        def many(name: str) -> np.ndarray:
            return t[name][j] - t[name][i]

        def between(name: str) -> np.ndarray:
            """Whether there's such a token with its neighbours in the segment."""
            return (n >= 3) & (t[name][j - 1] > t[name][i + 1])

        a, b = self.digit_at[i], self.digit_at[j]
        d = b - a
        even = (b - 1) % 2 == 0  # of the last digit, which stands for itself
        luhn_sum = np.where(even, self.sums[1][b] - self.sums[1][a], self.sums[0][b] - self.sums[0][a])
        signs = many("sign")
        four = n == 7
        for k in range(7):
            four &= p["octet" if k % 2 == 0 else "dot"][np.minimum(i + k, len(p["dot"]) - 1)]
        last, before = j - 1, j - 2
        domain = p["letters"][last] & (p["size"][last] >= 2) & (p["dot"][before] & p["alnum"][j - 3] & (n >= 3) | p["close"][before] & p["dot_word"][j - 3] & p["open"][j - 4] & p["alnum"][j - 5] & (n >= 5))
        country = p["plus"][i] & p["code"][i + 1] & p["end_gap"][i + 2] & (n >= 3) | p["zeros"][i] | p["double_zero"][i] & p["gap"][i + 1] & p["code"][i + 2] & (n >= 5)
        phone = p["digits"][last] & (p["size"][last] == 4) & (p["gap"][before] | p["dot"][before]) & p["digits"][j - 3] & (p["size"][j - 3] >= 3) & (n >= 3)
        fours = many("fours")
        card = (d == 16) & (fours == many("digits")) & (fours + many("gap") == n) & (many("gap") == fours - 1)
        left, right = p["near_left"][i - 1], p["near_right"][j] | p["dot"][j] & p["alnum"][j + 1]
        columns = (
            (signs == 1) & ~p["sign"][i], between("spelt"), domain, many("letters") + many("mixed") > 0, many("space") > 0, four, many("dot") > 0, (d >= 12) & (luhn_sum % 10 == 0), (d > 0) & (d < 7), (d >= 8) & (d <= 12),
            (d >= 13) & (d <= 15), (d >= 16) & (d <= 19), d > 19, country, p["plus"][i], between("area"), phone, card, (many("round") != 0) | (many("square") != 0),
            ~(p["alnum"][i] | p["plus"][i] | (p["round"][i] > 0)), p["mixed"][i] & (n == 1), p["after_word"][i], (n == 1) & p["alnum"][i], (n == 1) & (p["size"][i] >= 24), left, right, np.ones(len(i), bool),
        )
        return np.stack(columns, axis=1).astype(np.float32)

    def gains(self, inside: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First token, end, kind and gain over leaving its tokens outside of each segment that has a gain."""
        upto = np.append(0, np.cumsum(np.einsum("ij,j->i", self.alone, outside.astype(np.float32)), dtype=np.float64))
        found: list[tuple[np.ndarray, ...]] = []
        for i, j, features in self.stretches():
            score = np.einsum("ij,kj->ik", features, inside.astype(np.float32))  # in this thread, as Spark's tasks share the cores
            kind = score.argmax(axis=1)
            gain = score[np.arange(len(i)), kind] - (upto[j] - upto[i])
            good = gain > 0
            found.append((i[good], j[good], kind[good], gain[good]))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        i, j, kind, gain = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((i, j))
        return i[order], j[order], kind[order], gain[order]

    def best(self, inside: np.ndarray, outside: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(first token, end, kind, gain) of the entities of the best split."""
        i, j, kind, gain = self.gains(inside, outside)
        ends = np.append(0, np.unique(j))  # where the best value can change
        before = (np.searchsorted(ends, i, side="right") - 1).tolist()
        at = np.searchsorted(ends, j).tolist()
        value, back = [0.0] * len(ends), [-1] * len(ends)
        last = 0
        for k, (b, e, g) in enumerate(zip(before, at, gain.tolist(), strict=True)):
            if e != last:
                value[e] = value[e - 1]
                last = e
            if value[b] + g > value[e]:
                value[e], back[e] = value[b] + g, k
        chosen, e = [], len(ends) - 1
        while e > 0:
            k = back[e]
            if k < 0:
                e -= 1
                continue
            chosen.append((int(i[k]), int(j[k]), int(kind[k]), float(gain[k])))
            e = before[k]
        return chosen[::-1]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All candidate segments with their features; for texts of a few tokens."""
        parts = list(self.stretches())
        if not parts:
            return np.zeros(0, int), np.zeros(0, int), np.zeros((0, len(FEATURES)), np.float32)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Cases:
    """Some windows that are learned from, their segments side by side, ordered by where they end."""

    def __init__(self, cases: list[tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, dict[tuple[int, int], int]]]) -> None:
        self.sizes = np.array([len(alone) for _, alone, _ in cases])
        self.longest = int(self.sizes.max(initial=0))
        self.alone = np.zeros((len(cases), self.longest, len(OUTSIDE)))
        own, first, end, features, gold, self.covered = [], [], [], [], [], np.zeros((len(cases), self.longest), bool)
        for c, ((i, j, f), alone, truth) in enumerate(cases):
            self.alone[c, : len(alone)] = alone
            own.append(np.full(len(i), c))
            first.append(i)
            end.append(j)
            features.append(f)
            kinds = [truth.get(span, -1) for span in zip(i.tolist(), j.tolist(), strict=True)]
            gold.append(np.array(kinds, int))
            for (x, y), kind in zip(zip(i.tolist(), j.tolist(), strict=True), kinds, strict=True):
                if kind >= 0:
                    self.covered[c, x:y] = True
        end_of = np.concatenate(end).astype(int)
        order = np.argsort(end_of, kind="stable")
        self.own, self.first, self.end, self.gold = (np.concatenate(x).astype(int)[order] for x in (own, first, end, gold))
        self.features = np.concatenate(features)[order]
        self.bounds = np.searchsorted(self.end, np.arange(self.longest + 2))

    def gradient(self, inside: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the sum of the log-likelihoods of the true splits: all windows go ahead and back together, token by token."""
        count, n = len(self.sizes), self.longest
        score, single = self.features @ inside.T, self.alone @ outside
        total = np.logaddexp.reduce(score, axis=1) if len(score) else np.zeros(0)
        ahead, behind = np.full((count, n + 1), -np.inf), np.full((count, n + 1), -np.inf)
        ahead[:, 0] = 0
        behind[np.arange(count), self.sizes] = 0
        for j in range(1, n + 1):
            ahead[:, j] = ahead[:, j - 1] + single[:, j - 1]
            some = slice(self.bounds[j], self.bounds[j + 1])
            np.logaddexp.at(ahead[:, j], self.own[some], ahead[self.own[some], self.first[some]] + total[some])
        for j in range(n, 0, -1):
            behind[:, j - 1] = np.logaddexp(behind[:, j - 1], behind[:, j] + single[:, j - 1])
            some = slice(self.bounds[j], self.bounds[j + 1])
            np.logaddexp.at(behind, (self.own[some], self.first[some]), behind[self.own[some], j] + total[some])
        whole = ahead[np.arange(count), self.sizes]
        real = np.arange(n) < self.sizes[:, None]
        out = -np.exp(np.minimum(0, np.where(real, ahead[:, :-1] + single + behind[:, 1:] - whole[:, None], -np.inf)))
        share = -np.exp(np.minimum(0, (ahead[self.own, self.first] + behind[self.own, self.end] - whole[self.own])[:, None] + score))
        known = np.flatnonzero(self.gold >= 0)
        share[known, self.gold[known]] += 1
        out[real & ~self.covered] += 1
        return share.T @ self.features, np.einsum("ct,ctf->f", out, self.alone)


def gradient(segments: tuple[np.ndarray, np.ndarray, np.ndarray], alone: np.ndarray, gold: dict[tuple[int, int], int], inside: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of the split whose entities are ``gold``: (first token, end) to kind."""
    return Cases([(segments, alone, gold)]).gradient(inside, outside)


def truth(window: str) -> list[tuple[str, int, int]]:
    """The spans that a window is learned with."""
    return base_spans(window) + [("secret", *m.span(1)) for m in _SECRET.finditer(window)]


_SECRET_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789")


def _other_secret(seed: int) -> str:
    """A made-up secret of 16 to 128 letters, digits or both, by a number."""
    state, out = seed, []
    alphabet = _SECRET_ALPHABETS[seed % len(_SECRET_ALPHABETS)]
    for _ in range(LEAST_SECRET + (seed >> 8) % (24 if seed % 3 else 113)):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(alphabet[(state >> 33) % len(alphabet)])
    return "".join(out)


def rewritten(window: str, spans: list[tuple[str, int, int]], pick: int) -> tuple[str, list[tuple[str, int, int]]]:
    """The window with its first fitting span in another spelling, and the spans then: an "@" spelt out, a phone number
    with "00", without country sign or in other groups, another secret."""
    for at, (kind, a, b) in enumerate(spans):
        s = window[a:b]
        if kind == "email":
            new = s.replace("@", ("[at]", " [at] ", "(at)", " (at) ")[pick % 4])
        elif kind == "phone" and re.match(r"\+[0-9]{1,3}[ (]", s):
            code, rest = re.match(r"\+([0-9]{1,3}) ?(.*)", s).groups()
            groups = re.findall("[0-9]+", rest)
            pairs = re.findall("[0-9]{1,2}", "".join(groups))
            new = (
                f"00{code} {rest}", rest, f"00 {code} {rest}", " ".join(["00", code, *groups]), "-".join(["00" + code, *groups]), "-".join(["00" + code, *pairs]), " ".join(["00" + code, *pairs]),
            )[pick % 7]
        elif kind == "secret":
            new = _other_secret(zlib.crc32(f"{pick}:{s}".encode()))
        else:
            continue
        shift = len(new) - len(s)
        moved = [(k, x + shift * (x > a), y + shift * (y > a)) for k, x, y in spans]
        moved[at] = (kind, a, a + len(new))
        return window[:a] + new + window[b:], moved
    return window, spans


#: Ways in which a secret follows its word, which are learned with made-up secrets, as the corpus holds but a few of them.
_SECRET_PHRASES = ("token={}", "password: {}", "the passwd = {} was set", "secret: {}, to be kept", "api_key={}", "api-key = '{}'", 'key: "{}" here', "apikey={};", "Password = {}", "SECRET={}", "my token: {} and no other", "key={}")
#: As many of them, each with another secret.
MADE_SECRETS = 48


def made_examples() -> list[str]:
    return [_SECRET_PHRASES[i % len(_SECRET_PHRASES)].format(_other_secret(zlib.crc32(f"made:{i}".encode()))) for i in range(MADE_SECRETS)]


def _gold(lattice: Lattice, spans: list[tuple[str, int, int]], candidates: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """The candidate segments that are spans, by kind; of spans that overlap, the first kind's."""
    token = {s: i for i, s in enumerate(lattice.starts.tolist())}
    gold, used = {}, np.zeros(lattice.count + 1, bool)
    for kind, a, b in spans:
        if a in token and b in token and not used[token[a] : token[b]].any():
            gold[token[a], token[b]] = ALL_KINDS.index(kind)
            used[token[a] : token[b]] = True
    return {span: kind for span, kind in gold.items() if span in candidates}


#: Between the texts of a slice: no entity can hold it.
_BETWEEN = "\n\n"


class Field:
    """The weights: a row of ``FEATURES`` for each kind, and those of tokens outside."""

    def __init__(self, inside: np.ndarray, outside: np.ndarray) -> None:
        self.inside, self.outside = inside, outside

    def entities(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Of each text, the entities of the best split that beat the margin."""
        lattice = Lattice(_BETWEEN.join(texts))
        begins = np.cumsum([0, *(len(t) + len(_BETWEEN) for t in texts)])
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for i, j, kind, gain in lattice.best(self.inside, self.outside):
            if gain >= MARGIN:
                a, b = int(lattice.starts[i]), int(lattice.starts[j])
                k = int(np.searchsorted(begins, a, side="right")) - 1
                found[k].append((ALL_KINDS[kind], a - int(begins[k]), b - int(begins[k])))
        return found

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
        """Of each text, all spans by kind and then start, each with whether it is a base span."""
        out = []
        for text, entities in zip(texts, self.entities(texts), strict=True):
            base = base_spans(text)
            taken = sorted((a, b) for _, a, b in base)
            found = [(*s, True) for s in base]
            at, reach = 0, -1  # base spans are passed in order, as entities are
            for kind, a, b in entities:
                while at < len(taken) and taken[at][0] < b:
                    reach = max(reach, taken[at][1])
                    at += 1
                if reach <= a:
                    found.append((kind, a, b, False))
            out.append(sorted(found, key=lambda s: (ALL_KINDS.index(s[0]), s[1], s[2])))
        return out


def train(examples: list[str]) -> Field | None:
    """The field of some windows; None if there are none."""
    cases = []
    for window in [*examples, *((*PLAIN, *made_examples()) if examples else ())]:
        spans = truth(window)
        pick = zlib.crc32(window.encode("utf-8", "surrogatepass"))
        new, moved = rewritten(window, spans, pick)
        for w, s in {(window, tuple(spans)), (new, tuple(moved))}:
            lattice = Lattice(w)
            segments = lattice.segments()
            cases.append((w, segments, lattice.alone, _gold(lattice, list(s), set(zip(segments[0].tolist(), segments[1].tolist(), strict=True)))))
    if not cases:
        return None
    cases.sort(key=lambda c: (zlib.crc32(c[0].encode("utf-8", "surrogatepass")), c[0]))
    inside, outside = np.zeros((len(ALL_KINDS), len(FEATURES))), np.zeros(len(OUTSIDE))
    seen_in, seen_out = np.full_like(inside, 1e-6), np.full_like(outside, 1e-6)
    parts = [Cases([c[1:] for c in cases[start : start + 16]]) for start in range(0, len(cases), 16)]
    for _ in range(EPOCHS):
        for part in parts:
            a, b = part.gradient(inside, outside)
            g_in, g_out = a / len(part.sizes) - RIDGE * inside, b / len(part.sizes) - RIDGE * outside
            seen_in += g_in**2
            seen_out += g_out**2
            inside += RATE * g_in / np.sqrt(seen_in)
            outside += RATE * g_out / np.sqrt(seen_out)
    return Field(inside, outside)


#: Bytes without which a text has no span but a secret: digits, "@", and brackets before a spelt "at".
@lru_cache(maxsize=1)
def _triggers() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(48, 58), *map(ord, "@[(")]] = True
    return table


def _candidates(texts: pa.Array) -> np.ndarray:
    """Whether each text has a character without which there is no span, or a word that a secret may follow."""
    word = "|".join(SECRET_WORDS)
    out = np.array(pc.fill_null(pc.match_substring_regex(texts, rf"(?i)(?:{word})[\"']? ?[=:]"), False).to_numpy(zero_copy_only=False), bool)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2]:
        places = np.flatnonzero(_triggers()[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]) + bounds[0]
        out[np.searchsorted(bounds, places, side="right") - 1] = True
    return out


def windows(text: str) -> Iterator[str]:
    """The stretches that are learned from: the tokens round each trigger, cut to ``LEARN_TOKENS`` and ``LEARN_CHARS``
    at a token's end. Triggers that a stretch has taken in get none of their own."""
    lattice = Lattice(text)
    p, pad = lattice.p, lattice.pad
    hot = np.flatnonzero((p["digits"] | p["sign"] | p["may_at"] | p["mixed"] | p["value"])[pad : pad + lattice.count])
    done = 0
    for t in hot.tolist():
        if t < done:
            continue
        a = max(done, t - LEARN_TOKENS // 3)
        b = min(lattice.count, a + LEARN_TOKENS)
        while b > t and lattice.starts[b] - lattice.starts[a] > LEARN_CHARS:
            a, b = (a + 1, b) if a < t else (a, b - 1)
        if b > t:
            yield text[lattice.starts[a] : lattice.starts[b]]
        done = max(b, t + 1)


def learn(docs: DataFrame, text: str = "text", most: int = LEARN_WINDOWS) -> Field | None:
    """The field of at most ``most`` windows of ``docs``: distinct ones, first by a hash, a share of them for each kind
    of span that is in them and one for windows without."""
    shares = (*ALL_KINDS, "none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {kind: {} for kind in shares}
        for batch in text_slices(batches, text, CHUNK_BYTES):
            column = batch.column(text)
            for x in column.filter(pa.array(_candidates(column))).to_pylist():
                for window in windows(x):
                    found = {kind for kind, _, _ in truth(window)}
                    held[min(found, key=ALL_KINDS.index) if found else "none"][window] = zlib.crc32(window.encode("utf-8", "surrogatepass"))
                for kind, some in held.items():
                    if len(some) > 4 * most:
                        held[kind] = dict(sorted(some.items(), key=lambda y: (y[1], y[0]))[:most])
        rows = [(kind, w, h) for kind, some in held.items() for w, h in sorted(some.items(), key=lambda y: (y[1], y[0]))[:most]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["has", "window", "h"])

    found = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "has string, window string, h long").distinct()
    place = F.row_number().over(Window.partitionBy("has").orderBy("h", "window"))
    rows = found.withColumn("place", place).where(F.col("place") <= most // len(shares)).collect()
    examples = [r["window"] for r in sorted(rows, key=lambda r: (shares.index(r.has), r.place))]
    return train(examples)


def find(docs: DataFrame, field: Field | None, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end, base) in column ``out``, by kind and then start."""
    weights = (field.inside, field.outside) if field else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*weights) if weights else None
        for batch in text_slices(batches, text, CHUNK_BYTES):
            column = batch.column(text)
            spans: list[list] = [[]] * len(column)
            places = np.flatnonzero(_candidates(column)).tolist()
            texts = [column[i].as_py() for i in places]
            found = own.spans(texts) if own else [[(*s, True) for s in base_spans(x)] for x in texts]
            for i, some in zip(places, found, strict=True):
                spans[i] = [dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in some]
            yield with_columns(batch, {out: pa.array(spans, _SPAN_TYPE)})

    return docs.mapInArrow(run, with_fields(docs, {out: "array<struct<kind: string, start: int, end: int, base: boolean>>"}))
