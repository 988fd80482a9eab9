"""A quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level from per-bin sums of gradients, all nodes of a
level at once, and kept as flat arrays in heap order (the children of node i
are 2i + 1 and 2i + 2); scoring walks all rows through all trees together.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import doc_crc, map_arrow, tune, with_cleared

#: Labelled rows that a model is fitted on at most, taken in the order of a hash of the id.
MAX_ROWS = 20_000
FEATURES = (
    "words", "chars_per_word", "distinct_words", "distinct_pairs", "distinct_fives", "top_word",
    "symbols", "bars", "exclamations", "digits", "upper", "stops", "commas", "other_marks", "beyond_ascii",
    "lines", "distinct_lines", "words_per_line", "short_words", "long_words",
)
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&<>@^~=+_\\{}[]"
_HIGH = bytes(range(128, 256))
_MARKS = b";:'\"()?/-"


def features(text: str | None) -> list[float]:
    """Statistics of one text, finite for any; shares are of words or of bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(len(data), 1)
    if not n:
        return [0.0] * len(FEATURES)
    count = lambda chars: size - len(data.translate(None, chars))
    distinct = set(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    top = max(Counter(words).values())
    fives = len(set(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))) / (n - 4) if n > 4 else 1.0
    pairs = len(set(zip(words, words[1:], strict=False))) / (n - 1) if n > 1 else 1.0
    sizes = list(map(len, words))
    return [
        float(np.log1p(n)), sum(sizes) / n, len(distinct) / n, pairs, fives, top / n,
        count(_SYMBOLS) / n, data.count(b"|") / n, data.count(b"!") / n, count(_DIGITS) / size, count(_UPPER) / size,
        data.count(b".") / n, data.count(b",") / n, count(_MARKS) / n, count(_HIGH) / size,
        len(lines) / n, len(set(lines)) / len(lines), n / len(lines), sum(s < 4 for s in sizes) / n, sum(s > 12 for s in sizes) / n,
    ]


@dataclass
class Trees:
    """Flat arrays of all trees: feature (-1: a leaf was reached above) and threshold of inner nodes, values of the last level."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.feature):
            return out
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), dtype=np.int32)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return out + self.value[trees, at - (2**self.depth - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 2.0, least: float = 5.0) -> Trees:
    """Boosted trees for the log-odds of y = 1; a constant where there is no row or one class.

    The constant is that of one more document of either class, so that scores
    lie strictly between 0 and 1.
    """
    n = len(y)
    p = (y.sum() + 1) / (n + 2)
    base, inner, leaves = float(np.log(p / (1 - p))), 2**depth - 1, 2**depth
    out = Trees(base, np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)), depth)
    if n == 0 or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # x <= edge b: bin <= b
    width, d = bins + 1, x.shape[1]
    margin = np.full(n, base)
    feature, threshold, value = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        f, t = np.zeros(inner, np.int32), np.full(inner, np.inf)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            place = ((at - first)[:, None] * d + np.arange(d)) * width + binned
            shape = (nodes, d, width)
            gs = np.bincount(place.ravel(), np.repeat(g, d), minlength=nodes * d * width).reshape(shape).cumsum(axis=2)
            hs = np.bincount(place.ravel(), np.repeat(h, d), minlength=nodes * d * width).reshape(shape).cumsum(axis=2)
            ns = np.bincount(place.ravel(), minlength=nodes * d * width).reshape(shape).cumsum(axis=2)
            gain = gs**2 / (hs + smooth) + (gs[..., -1:] - gs) ** 2 / (hs[..., -1:] - hs + smooth) - gs[..., -1:] ** 2 / (hs[..., -1:] + smooth)
            gain[(ns < least) | (ns[..., -1:] - ns < least)] = 0
            flat = gain.reshape(nodes, -1)
            best = flat.argmax(axis=1)
            for i in np.flatnonzero(flat.max(axis=1) > 1e-9):
                j, b = divmod(int(best[i]), width)
                f[first + i], t[first + i] = j, edges[j][b]
            right = x[np.arange(n), f[at]] > t[at]
            at = 2 * at + 1 + right
        leaf = at - inner
        v = rate * np.bincount(leaf, g, minlength=leaves) / (np.bincount(leaf, h, minlength=leaves) + smooth)
        margin += v[leaf]
        feature.append(f)
        threshold.append(t)
        value.append(v)
    return Trees(base, np.array(feature), np.array(threshold), np.array(value), depth)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Fits on the labelled rows outside the held-out quarter, at most ``max_rows``; only their statistics reach the driver."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").where(doc_crc() % 4 != 2).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).distinct()
    marks = marks.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)
    # at most max_rows rows of 12 bytes: safe to broadcast whatever the tables' size
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).select(F.col("text"), F.col("_y"), F.col("doc_id"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array([features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = map_arrow(rows, "doc_id long, y int, x array<double>", run)
    # an id that repeats in docs could exceed the bound: as many of its rows are left out
    got = sorted((r.doc_id, r.y, r.x) for r in got.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(2 * max_rows).collect())
    x = np.array([r[2] for r in got], dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in got], dtype=np.float64))


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``.

    ``held_out``: crc32 of the id as text leaves 2 when divided by 4; no label
    of such a row is learned. ``score``: probability of label 1, from the text
    alone. A null text counts as empty, a null id as crc32 0. With no label, or
    labels of one class only, all scores are one constant. Labels other than 0
    and 1 don't count; repeated rows score alike.
    """
    tune(docs.sparkSession)
    own = with_cleared(docs, "held_out", "score", "predicted")
    model = train(own, labels, max_rows)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(np.array([features(t) for t in b.column(1).to_pylist()]))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= cutoff).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = own.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (doc_crc() % 4 == 2).alias("held_out"))
    return map_arrow(rows, "doc_id long, held_out boolean, score double, predicted int", run)
