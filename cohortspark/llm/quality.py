"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics are computed in tasks; the trees are fitted on the driver from a bounded sample of statistics (numbers only)
and flattened into arrays, which numpy walks for all trees and rows at once.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._arrow import map_batches
from cohortspark.llm._sample import labelled, remainder
from cohortspark.llm._words import slices

STATS = (
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "space", "high", "hash_marks", "pipe", "exclaim",
    "question", "stops", "quotes", "other_marks", "distinct_words", "top_word", "same_as_before", "line_words", "distinct_lines",
    "longest_word", "marks_per_word",
)
#: At most about so many labelled rows are fitted.
TRAIN_ROWS = 20_000
#: score from which a document counts as good.
CUT = 0.3
MODULUS, HELD = 5, 0


def stats_of(text: str | None) -> list[float]:
    """The statistics of a whole text; zeros for null or empty text."""
    if not text:
        return [0.0] * len(STATS)
    data = text.encode()
    h = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n = len(data)
    words = data.split()
    k = len(words) or 1
    lines = data.split(b"\n")
    count = Counter(words)
    upper, digit = h[65:91].sum(), h[48:58].sum()
    marks = h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()
    symbols, stops, quotes = h[[35, 36, 37, 38, 42]].sum(), h[[44, 46, 58, 59]].sum(), h[[34, 39, 96]].sum()
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / k, upper / n, h[97:123].sum() / n, digit / n, h[32] / n,
        h[128:].sum() / n, symbols / n, h[124] / n, h[33] / n, h[63] / n, stops / n, quotes / n,
        (marks - symbols - stops - quotes - h[124] - h[33] - h[63]) / n, len(count) / k, max(count.values(), default=0) / k,
        sum(map(bytes.__eq__, words[1:], words)) / k, k / len(lines), len(set(lines)) / len(lines),
        max(map(len, words), default=0), marks / k,
    ]


class Trees(NamedTuple):
    """Complete trees side by side: [tree, node]; children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        trees, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        rows, which = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), dtype=np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[which, node]] > self.threshold[which, node])
        return 1 / (1 + np.exp(-(self.bias + self.leaf[which, node - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12, ridge: float = 1.0, least: float = 4.0) -> Trees:
    """Boosted trees for the logistic loss; cuts come from quantile bins, gains from gradient and curvature sums.

    One class only (or no rows) gives a constant model.
    """
    n, f = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
    out = Trees(np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), float(np.log(mean / (1 - mean))))
    if n == 0 or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(f) * bins
    raw = np.full(n, out.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (f * bins) + flat).ravel()
            size = width * f * bins
            sg, sh = (np.bincount(key, weights=np.repeat(v, f), minlength=size).reshape(width, f, bins).cumsum(axis=2) for v in (g, h))
            tg, th = sg[:, :1, -1:], sh[:, :1, -1:]
            gain = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
            gain[(sh < least) | (th - sh < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, b in enumerate(best):
                j, at = divmod(int(b), bins)
                if gain[k, j, at] > 1e-6 and at < len(edges[j]):
                    out.feature[t, first + k], out.threshold[t, first + k] = j, edges[j][at]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.threshold[t, node])
        leaf = node - inner
        out.leaf[t] = rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + ridge)
        raw += out.leaf[t, leaf]
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from the statistics of a bounded sample of labelled rows outside the held-out ones."""
    sample = labelled(docs, labels, "quality", rows, MODULUS, HELD)

    def make():
        return lambda cols: {"doc_id": cols["doc_id"], "label": cols["label"], "stats": [stats_of(t) for t in cols["text"]]}

    got = map_batches(sample, make, "doc_id long, label int, stats array<double>").toPandas().sort_values("doc_id")
    x = np.array(got["stats"].tolist(), dtype=float).reshape(-1, len(STATS))
    return fit(x, got["label"].to_numpy(dtype=float))


def _judge(model: Trees, texts: list[str | None]) -> np.ndarray:
    return model.predict(np.array([stats_of(t) for t in texts], dtype=float).reshape(-1, len(STATS)))


def score(docs: DataFrame, model: Trees, cut: float = CUT) -> DataFrame:
    """Score of every document's whole text: doc_id, held_out, score, predicted.

    Null text scores like empty text; a null id is not held out; repeated rows stay; other columns are ignored; an empty
    table gives an empty result. Row-local, no shuffle.
    """

    def make():
        def work(cols):
            p = _judge(model, cols["text"])
            return {"doc_id": cols["doc_id"], "score": p.tolist(), "predicted": (p >= cut).astype(int).tolist()}

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double, predicted int").withColumn("held_out", F.coalesce(remainder("doc_id", MODULUS) == HELD, F.lit(False)))


def accepted(docs: DataFrame, model: Trees, cut: float = CUT) -> DataFrame:
    """The documents whose text scores at least ``cut``: all their columns as they are, whatever these are called."""

    def run(batches):
        for b in batches:
            for part in slices(b.column("text")):
                piece = b.slice(part.start, part.stop - part.start)
                yield piece.filter(pa.array(_judge(model, piece.column("text").to_pylist()) >= cut))

    return docs.mapInArrow(run, docs.schema)
