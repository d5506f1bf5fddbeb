"""Quality scores from a generalised additive model with pairwise interactions.

Spark computes the features of every whole text.  The model is fitted on a bounded sample of labelled rows: shallow
trees are boosted in cycles, one feature after the other, and each feature's trees add up to a table over its bins;
the strongest pairs of features, by the gain of one cut in each, get tables too.  A score adds the tables' entries.
"""

from __future__ import annotations

import itertools
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import fresh, quoted, text_groups

#: Labelled rows the fit reads, about (a uniform sample by hash), whatever the input's size.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS = 64, 12
CYCLES, PAIR_CYCLES, PAIRS = 150, 60, 6
RATE, RIDGE = 0.1, 1.0
THRESHOLD = 0.7

FEATURES = ["log_bytes", "log_words", "word_bytes", "upper", "digit", "mark", "mark_kinds", "beyond_ascii", "space", "stops", "bars",
            "distinct_words", "top_word", "same_as_last", "ends_in_mark", "log_lines", "distinct_lines", "line_words", "pair_distinct"]

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 digit, 3 mark, 4 beyond ASCII, 5 space
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 4
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_END_MARKS = tuple("!#$%&*|+=<>^~@/\\")


def features(text: str) -> list[float]:
    """The numbers a text is judged by; all 0 for an empty one."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(FEATURES)
    per_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    _, upper, digit, mark, beyond, space = np.bincount(_CLASS, weights=per_byte, minlength=6) / n
    words = text.split()
    w = len(words)
    lines = [x for x in text.split("\n") if x]
    counts = Counter(words)
    marks = (per_byte[_CLASS == 3] > 0).sum()
    if not w:
        return [np.log1p(n), 0, 0, upper, digit, mark, marks, beyond, space] + [0.0] * (len(FEATURES) - 9)
    return [np.log1p(n), np.log1p(w), (n - space * n) / w, upper, digit, mark, marks, beyond, space,
            (per_byte[46] + per_byte[44]) / w, per_byte[124] / w,
            len(counts) / w, max(counts.values()) / w, sum(map(operator.eq, words, itertools.islice(words, 1, None))) / w,
            sum(x.endswith(_END_MARKS) for x in words) / w,
            np.log1p(len(lines)), len(set(lines)) / len(lines), w / len(lines),
            len(set(zip(words, itertools.islice(words, 1, None), strict=False))) / w]


def with_features(docs: DataFrame, text: str, out: str) -> DataFrame:
    @F.arrow_udf("array<double>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([features(t) for group in text_groups(column) for t in group], pa.list_(pa.float64()))

    return docs.withColumn(out, compute(quoted(text)))


@dataclass
class Model:
    """Bin edges and a table for each feature, tables for pairs, and the constant."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    constant: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, f], "right")]
        for a, b, edges_a, edges_b, values in self.pairs:
            total += values[np.searchsorted(edges_a, x[:, a], "right"), np.searchsorted(edges_b, x[:, b], "right")]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -500, 500)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cut points with about equally many rows between them; none where a feature has one value."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(values) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree of that depth over consecutive bins: each bin's step."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        cut = int(gains.argmax()) + 1
        if gains[cut - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + RIDGE))


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both axes at once: gain over no cut, and each cell's step."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)

    def parts(c):
        ll, lu, ul = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return ll, lu - ll, ul - ll, c[-1, -1] - lu - ul + ll

    total = sum(_gain(a, b) for a, b in zip(parts(cg), parts(ch), strict=True))
    i, j = np.unravel_index(total.argmax(), total.shape)
    step = np.zeros_like(g)
    for rows in (slice(None, i + 1), slice(i + 1, None)):
        for cols in (slice(None, j + 1), slice(j + 1, None)):
            step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return float(total[i, j] - _gain(g.sum(), h.sum())), step


def fit_tables(x: np.ndarray, y: np.ndarray, cycles: int = CYCLES, pair_cycles: int = PAIR_CYCLES, pairs: int = PAIRS) -> Model:
    """Boost the tables on a sample; no rows give score 0.5, rows of one label a constant."""
    if not len(y):
        return Model()
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(constant=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    count = x.shape[1]
    model.edges = [_edges(x[:, f], BINS) for f in range(count)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    logit = np.full(len(y), model.constant)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(cycles):
        for f in range(count):
            g, h = slopes()
            size = len(model.tables[f])
            step = RATE * _tree(np.bincount(binned[f], g, size), np.bincount(binned[f], h, size))
            model.tables[f] += step
            logit += step[binned[f]]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(count)]
    low = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def grid(a, b, values):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(low[a] * shape[1] + low[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(((_quarters(grid(a, b, g), grid(a, b, h))[0], a, b) for a, b in itertools.combinations(range(count), 2)), reverse=True)
    chosen = [(a, b) for gain, a, b in gains[:pairs] if gain > 0]
    steps = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(pair_cycles):
        for a, b in chosen:
            g, h = slopes()
            step = RATE * _quarters(grid(a, b, g), grid(a, b, h))[1]
            steps[a, b] += step
            logit += step[low[a], low[b]]
    model.pairs = [(a, b, coarse[a], coarse[b], steps[a, b]) for a, b in chosen]
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``train_rows`` of the rows of ``labels`` that have an id and a label; ids without a document drop out."""
    rows = labels.select(quoted(doc_id).alias("k"), quoted(label).cast("double").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
    n = rows.count()
    unit = F.shiftrightunsigned(F.xxhash64("k", F.lit(7)), 11) / float(1 << 53)
    chosen = settle(rows.where(unit < min(1.0, train_rows / max(n, 1))))  # about train_rows rows of 16 bytes
    texts = docs.select(quoted(doc_id).alias("k"), quoted(text).alias("t")).join(F.broadcast(chosen), "k")
    sample = with_features(texts, "t", "x").select("x", "y").toPandas()
    if not len(sample):
        return Model()
    x, y = np.array(sample["x"].tolist()), sample["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # tasks end in any order
    return fit_tables(x[order], y[order])


def with_quality(docs: DataFrame, model: Model, text: str = "text", out: str = "quality") -> DataFrame:
    """Add the score, 0 to 1, of every text (null: empty), under a free name if ``out`` is taken.

    Equal texts have equal scores; repeated rows and other columns pass through; an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = np.array([features(t) for group in text_groups(column) for t in group]).reshape(-1, len(FEATURES))
            yield pa.array(sent.value.scores(x))

    return docs.withColumn(fresh(docs, out), score(quoted(text)))


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")
