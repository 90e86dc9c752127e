"""Quality classifier: a generalised additive model with pairwise interactions, by cyclic boosting of shallow trees.

Each feature of a text is binned by quantiles of the learning rows. In every round the model goes through all
features in turn and adds to each feature's table a small tree of at most ``LEAVES`` leaves, grown on gradients
summed by bin; going in turn with small steps keeps correlated features from taking each other's credit. Then the
pairs of features with the greatest remaining gain get tables of two dimensions, boosted in the same way by trees
of one split on each side. What is left is a table a feature and a table a pair: a score is the sigmoid of as many
look-ups as there are tables, done for all texts of a batch at once.

The model learns from at most ``LEARN_ROWS`` labelled rows, those that come first by a hash of their id; all rows
with fewer. Its tables have a fixed size.

Defined results: a null text is scored as the empty one, which has a score as any other; without labels, or with
one label alone, all scores are that label's share (one half without any); extra columns pass through, but for one named
like the output, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import text_slices, with_columns, with_fields
from tidemark.llm.shingles import words

LEARN_ROWS = 20_000
BINS, LEAVES = 32, 4
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 120, 40, 8, 0.12
#: Least sum of second derivatives in a leaf, and the pull of its value towards zero.
LEAST, RIDGE = 3.0, 1.0
CHUNK_BYTES = 1 << 20

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "high", "line", "sentence_end", "symbol_kinds",
    "lone_symbols", "symbol_ends", "distinct_words", "top_word", "repeats", "distinct_pairs",
)

_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _SYMBOL, _HIGH = range(8)
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[[33, 44, 46, 63]] = _SPACE, _LINE, _STOP


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text; shares are of the text's bytes or words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    n, sizes = len(texts), np.diff(bounds)
    kinds = _KIND[data]
    owner = np.repeat(np.arange(n), sizes)
    count = np.bincount(owner * 8 + kinds, minlength=8 * n).reshape(n, 8).astype(float)
    mark = (kinds == _SYMBOL) | (kinds == _STOP)
    white = (kinds == _SPACE) | (kinds == _LINE)
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    before[bounds[:-1][sizes > 0]] = True
    after[bounds[1:][sizes > 0] - 1] = True
    lone = np.bincount(owner[mark & before & after], minlength=n)
    ends = np.bincount(owner[mark & after & ~before & (data != 46) & (data != 44)], minlength=n)
    stops = np.bincount(owner[(data == 46) & after], minlength=n)
    numbers, at = words(texts)
    rows = np.zeros((n, len(FEATURES)))
    for i in range(n):
        own = numbers[at[i] : at[i + 1]]
        k = len(own)
        if k:
            counts = np.unique(own, return_counts=True)[1]
            pairs = np.unique(own[:-1] * np.uint64(3) + own[1:])
            rows[i, 12:] = len(counts) / k, counts.max() / k, (own[1:] == own[:-1]).mean() if k > 1 else 0, len(pairs) / max(k - 1, 1)
            used = data[bounds[i] : bounds[i + 1]][mark[bounds[i] : bounds[i + 1]]]
            rows[i, 9] = np.count_nonzero(np.bincount(used, minlength=1))
    size, total = np.maximum(sizes, 1), np.maximum(np.diff(at), 1)
    letters = np.maximum(count[:, _UPPER] + count[:, _LOWER] + count[:, _HIGH], 1)
    rows[:, :9] = np.stack([
        np.log1p(sizes), np.log1p(np.diff(at)), sizes / total, count[:, _UPPER] / letters, count[:, _DIGIT] / size,
        count[:, _SYMBOL] / size, count[:, _HIGH] / size, count[:, _LINE] / total, stops / total,
    ], axis=1)
    rows[:, 10], rows[:, 11] = lone / total, ends / total
    return rows


@dataclass
class Model:
    """Bin edges, a table for each feature and for each pair of features, and the score of all zeros."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray = field(default_factory=lambda: np.zeros((len(FEATURES), BINS)))
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for i, table in enumerate(self.tables):
            total += table[bins[:, i]]
        for (a, b), table in self.pairs.items():
            total += table[bins[:, a], bins[:, b]]
        return total

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.logits(self.bins(rows)) if self.edges else np.full(len(rows), self.base))))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h < LEAST, -np.inf, g * g / (h + RIDGE))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step of each bin by a tree of at most LEAVES leaves on sums of first and second derivatives by bin."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, -1, -1)
        for k, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            gains = _gain(gl, hl) + _gain(g[a:b].sum() - gl, h[a:b].sum() - hl) - g[a:b].sum() ** 2 / (h[a:b].sum() + RIDGE)
            at = int(np.argmax(gains))
            best = max(best, (float(gains[at]), k, a + at + 1))
        if best[1] < 0:
            break
        a, b = leaves[best[1]]
        leaves[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    step = np.zeros(len(g))
    for a, b in leaves:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return step


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best split on each side of a pair's table into four leaves: its gain and the steps."""
    G, H = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    quarters = []
    for S in (G, H):
        a = S[:-1, :-1]
        quarters.append((a, S[:-1, -1:] - a, S[-1:, :-1] - a, S[-1, -1] - S[:-1, -1:] - S[-1:, :-1] + a))
    gains = sum(np.where(qh > 0, qg * qg / (qh + RIDGE), 0) for qg, qh in zip(*quarters, strict=True))
    gains = np.where(np.minimum.reduce([q for q in quarters[1]]) < LEAST, -np.inf, gains)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    step = np.zeros_like(g)
    if np.isfinite(gains[i, j]):
        values = [qg[i, j] / (qh[i, j] + RIDGE) for qg, qh in zip(*quarters, strict=True)]
        step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values
    return float(gains[i, j]), step


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """The model of some rows of features and their labels, 0 or 1."""
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    share = labels.mean()
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model = Model(float(np.log(share / (1 - share))), [np.unique(np.quantile(c, quantiles)) for c in rows.T])
    bins = model.bins(rows)
    total = model.logits(bins)

    def derivatives() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i in range(len(FEATURES)):
            g, h = (np.bincount(bins[:, i], x, BINS) for x in derivatives())
            step = RATE * _tree(g, h)
            model.tables[i] += step
            total += step[bins[:, i]]
    cells = {(a, b): bins[:, a] * BINS + bins[:, b] for a, b in combinations(range(len(FEATURES)), 2)}
    g, h = derivatives()
    sums = {p: [np.bincount(c, x, BINS * BINS).reshape(BINS, BINS) for x in (g, h)] for p, c in cells.items()}
    chosen = sorted(cells, key=lambda p: -_cross(*sums[p])[0])[:PAIRS]
    model.pairs = {p: np.zeros((BINS, BINS)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for p in chosen:
            g, h = (np.bincount(cells[p], x, BINS * BINS).reshape(BINS, BINS) for x in derivatives())
            step = RATE * _cross(g, h)[1]
            model.pairs[p] += step
            total += step.ravel()[cells[p]]
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = LEARN_ROWS) -> Model:
    """The model of ``labels`` (doc_id and ``label``, 0 or 1) on the texts of ``docs``; at most ``rows`` of them."""
    some = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(rows)
    learning = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # of at most ``rows`` short rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", CHUNK_BYTES):
            found = features(batch.column("text"))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), lists], names=["doc_id", "label", "row"])

    found = learning.mapInArrow(run, "doc_id long, label int, row array<double>").orderBy("doc_id", "label", "row").limit(rows).toArrow()
    matrix = np.array(found.column("row").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(matrix, found.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text, CHUNK_BYTES):
            yield with_columns(batch, {out: pa.array(model.scores(features(batch.column(text))))})

    return docs.mapInArrow(run, with_fields(docs, {out: "double"}))
