"""Quality rules: document statistics, fixed rules and gradient-boosted trees over them.

The trees are fitted on a bounded labelled sample on the driver: logistic loss,
histograms of BINS quantile bins, depth DEPTH. On the features of MONOTONE the
score may only fall: a split keeps the order of its sides' values, and bounds
handed down to the children keep it below. The fitted trees are flattened into
arrays of nodes, in which leaves lead to themselves, so that all texts take a
step down a tree at once. Statistics come from the bytes of the texts, a slice
at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._labels import labelled
from ._session import ship

#: The bound of the labelled sample.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.2
RIDGE, LEAST_WEIGHT = 1.0, 2.0
#: Probabilities of label 1 from here on are kept.
ACCEPT = 0.3

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "adjacent_share", "distinct_share",
    "capital_share", "digit_share", "mark_share", "shout_share", "bar_share", "words_a_line", "high_share",
)
MONOTONE = ("symbol_share", "dup_line_share", "repeat_share", "adjacent_share", "shout_share", "bar_share")

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_RANGE = {
    "capital": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "mark": np.isin(np.arange(256), np.frombuffer(b".,;:!?'\"()-", np.uint8)),
    "shout": np.arange(256) == ord("!"),
    "bar": np.arange(256) == ord("|"),
    "high": np.arange(256) >= 0xC0,
}


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(BASE counts, FEATURES), a column a text."""
    n = len(offsets) - 1

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(sums[offsets])

    starts, ends, first = t.word_bounds(data, offsets)
    words = np.diff(first)
    of = np.repeat(np.arange(n), words)
    lead = (data & 0xC0) != 0x80
    chars = total(lead & ~t._WS[data])
    symbols = total(_SYMBOL[data])

    # Lines with a word, and those equal to an earlier one of the text.
    newline = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    cuts = cuts[cuts < len(data)]
    line = np.unique(np.searchsorted(cuts, starts, "right") - 1)
    begin = cuts[line]
    nxt = np.append(cuts, len(data))[line + 1]
    stop = nxt - ((data[nxt - 1] == 10) if len(nxt) else 0)
    owner = np.searchsorted(offsets, begin, "right") - 1
    key = t.mix(t.span_hashes(data, begin, stop, fold=False) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lines = np.bincount(owner, minlength=n)
    _, at = np.unique(key, return_index=True)
    dup = lines - np.bincount(owner[at], minlength=n)

    h = t.span_hashes(data, starts, ends, fold=False)
    base = t.mix(of.astype(np.uint64) + np.uint64(1))
    repeat = np.zeros(n, np.int64)
    adjacent = np.zeros(n, np.int64)
    if len(h) > 2:
        inside = np.flatnonzero(of[2:] == of[:-2])
        tri = t.mix(h[:-2] + t.mix(h[1:-1] * np.uint64(3) + t.mix(h[2:] * np.uint64(5))) + base[:-2])[inside]
        s = np.sort(tri)
        often = np.unique(s[1:][s[1:] == s[:-1]])
        if len(often):
            place = np.minimum(np.searchsorted(often, tri), len(often) - 1)
            hit = inside[often[place] == tri]
            covered = np.zeros(len(h), bool)
            for k in range(3):
                covered[hit + k] = True
            repeat = np.bincount(of[covered], minlength=n)
    if len(h) > 1:
        adjacent = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=n)
    s = t.mix(h + base)
    _, at = np.unique(s, return_index=True)
    distinct = np.bincount(of[at], minlength=n)

    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    share = {k: total(flags[data]) / c for k, flags in _RANGE.items()}
    features = [
        np.log1p(words), chars / w, symbols / c, dup / np.maximum(lines, 1), repeat / w, adjacent / w, distinct / w,
        share["capital"], share["digit"], share["mark"], share["shout"], share["bar"], words / np.maximum(lines, 1), share["high"],
    ]
    return np.stack([words, chars, symbols, dup, repeat]), np.stack(features).astype(np.float64)


class Trees:
    """Boosted trees as node arrays: a node's feature, threshold, children (left: at most the threshold) and value."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        """x: a row a text; y: 0 or 1."""
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = [], [], [], [], [], []
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1 - 1e-3
        self.start = float(np.log(p / (1 - p)))
        if len(np.unique(y)) == 2:
            self._fit(x, y.astype(float))
        self.feature, self.left, self.right = (np.array(v, np.int64) for v in (self.feature, self.left, self.right))
        self.threshold, self.value = np.array(self.threshold), np.array(self.value)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        sign = [-1 if f in MONOTONE else 0 for f in FEATURES]
        margin = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = p - y, p * (1 - p)
            self.roots.append(len(self.feature))
            self._grow(np.arange(len(y)), bins, edges, gradient, weight, sign, margin, DEPTH, -np.inf, np.inf)

    def _node(self, feature: int, threshold: float, value: float) -> int:
        k = len(self.feature)
        for v, new in zip((self.feature, self.threshold, self.left, self.right, self.value), (feature, threshold, k, k, value)):
            v.append(new)
        return k

    def _grow(self, rows, bins, edges, gradient, weight, sign, margin, depth, low, high) -> int:
        g, h = gradient[rows], weight[rows]
        best = (1e-6, -1, 0, 0.0, 0.0)
        if depth:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                gs = np.cumsum(np.bincount(bins[rows, f], g, len(e) + 1))
                hs = np.cumsum(np.bincount(bins[rows, f], h, len(e) + 1))
                gl, hl = gs[:-1], hs[:-1]
                gr, hr = gs[-1] - gl, hs[-1] - hl
                left, right = (np.clip(-a / (b + RIDGE), low, high) for a, b in ((gl, hl), (gr, hr)))
                own = np.clip(-gs[-1] / (hs[-1] + RIDGE), low, high)
                worth = lambda v, a, b: -(a * v + 0.5 * (b + RIDGE) * v * v)
                gain = worth(left, gl, hl) + worth(right, gr, hr) - worth(own, gs[-1], hs[-1])
                ok = (hl >= LEAST_WEIGHT) & (hr >= LEAST_WEIGHT) & (sign[f] * (right - left) >= 0)
                gain = np.where(ok, gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(left[k]), float(right[k]))
        _, f, k, left, right = best
        if f < 0:
            value = RATE * float(np.clip(-g.sum() / (h.sum() + RIDGE), low, high))
            margin[rows] += value
            return self._node(0, 0.0, value)
        node = self._node(f, float(edges[f][k]), 0.0)
        under = bins[rows, f] <= k
        middle = (left + right) / 2
        bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[sign[f]]
        self.left[node] = self._grow(rows[under], bins, edges, gradient, weight, sign, margin, depth - 1, *bounds[0])
        self.right[node] = self._grow(rows[~under], bins, edges, gradient, weight, sign, margin, depth - 1, *bounds[1])
        return node

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of label 1, for each row of x."""
        margin = np.full(len(x), self.start)
        flat, row = x.reshape(-1), np.arange(len(x)) * x.shape[1]
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                go = flat[row + self.feature[node]] <= self.threshold[node]
                node = np.where(go, self.left[node], self.right[node])
            margin += self.value[node]
        return 1 / (1 + np.exp(-margin))


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees of a bounded labelled sample; see labelled()."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in t.slices(batch.column(2)):
                _, features = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), t.list_array(features.T, len(FEATURES), pa.float64())], ["doc_id", "quality", "x"])

    rows = labelled(docs, labels, SAMPLE_ROWS).mapInArrow(run, "doc_id long, quality int, x array<double>").toArrow().sort_by("doc_id")
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES)) if len(rows) else np.zeros((0, len(FEATURES)))
    return Trees(x, np.asarray(rows.column("quality")))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for every row of docs(doc_id, text).

    base_failed: under 50 words, or over half of them in repeated three-word
    windows. kept: not base_failed, and the trees' probability of quality
    label 1, score, is ACCEPT at least. Without labelled rows the trees keep
    all. A null or empty text has zeros and fails. Labels of ids with
    crc32(doc_id as text) mod 5 of 0 are not learned from.
    """
    trees = fit(docs, labels)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in t.slices(batch.column(1)):
                counts, features = statistics(data, offsets)
                failed = (counts[0] < 50) | (100 * counts[4] > 50 * counts[0])
                score = shared.value.probability(np.ascontiguousarray(features.T))
                columns = [*(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(~failed & (score >= ACCEPT)), pa.array(score)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], ["doc_id", *BASE, "base_failed", "kept", "score"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean, score double")
