"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in a cycle and adds a shallow tree of one feature at a time to that feature's lookup
table over its bins; afterwards the same is done for the pairs of features that explain most of what is left, with a cut
on each of the two axes. A score is the logistic function of an intercept plus one table entry per feature and per pair:
bins are found once, and everything else is array additions.

Features come from the text alone (never from labels, language, source or id). The model is fitted on a bounded sample of
labelled rows, ``max_rows`` at most, drawn by a hash of the id. Scoring covers every row and shuffles nothing.

Defined results: a null text is scored as the empty text, equal texts get equal scores; of documents that
share a labelled id, that with the smallest features teaches; rows without a label, or with a null label or id, teach
nothing; with no labelled rows of both kinds, every score is the share of label 1 among those seen, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, encoded, frugal, hash_fraction, slices_by_bytes

FEATURES = (
    "log_words",
    "log_bytes",
    "mean_word_bytes",
    "symbol_share",
    "upper_share",
    "digit_share",
    "punctuation_share",
    "space_share",
    "byte_entropy",
    "distinct_word_share",
    "top_word_share",
    "same_next_share",
    "distinct_pair_share",
    "repeat_line_share",
    "log_line_bytes",
    "symbol_word_share",
    "log_zstd_ratio",
)
_CLASSES = np.zeros((256, 5), np.int64)
for _k, _bytes in enumerate((b"#*$%&|<>~^_=+@\\{}[]", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-/", b" \t\n\r\x0b\x0c")):
    _CLASSES[list(_bytes), _k] = 1
_SYMBOL_END = b"#*$%&|<>~^_=+@!"


def features(text: str | None, packer: zstandard.ZstdCompressor) -> list[float]:
    raw = encoded(text)
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0, float(np.log1p(size))] + [0.0] * (len(FEATURES) - 2)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbol, upper, digit, punctuation, space = (histogram @ _CLASSES).tolist()
    share = histogram[histogram > 0] / size
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    body = max(1, size - space)
    pairs = max(1, n - 1)
    marked = sum(1 for w in words if w[-1] in _SYMBOL_END)
    return [
        float(np.log1p(n)),
        float(np.log1p(size)),
        body / n,
        symbol / body,
        upper / body,
        digit / body,
        punctuation / body,
        space / size,
        float(-(share * np.log2(share)).sum()),
        len(index) / n,
        float(np.bincount(ids).max()) / n,
        float((ids[1:] == ids[:-1]).sum()) / pairs,
        len(np.unique(ids[1:] * n + ids[:-1])) / pairs,
        1.0 - len(set(lines)) / len(lines),
        float(np.log1p(size / len(lines))),
        marked / n,
        float(np.log(size / len(packer.compress(raw)))),
    ]


@dataclass
class AdditiveModel:
    """``edges``: upper bin limits per feature; ``tables``: a score per bin; ``pairs``: (feature, feature, scores by the
    coarse bins of both)."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if not self.edges:
            return total
        bins = [np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)]
        for b, table in zip(bins, self.tables, strict=True):
            total += table[b]
        for f, g, table in self.pairs:
            total += table[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Leaf values by bin of a tree on one ordered feature, from sums of gradients and Hessians by bin."""
    total_g, total_h = g.sum(), h.sum()
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(left_g, left_h, ridge) + _gain(total_g - left_g, total_h - left_h, ridge)
        gains[(left_h < least) | (total_h - left_h < least)] = -1.0
        cut = int(gains.argmax())
        if gains[cut] > _gain(total_g, total_h, ridge) + 1e-12:
            return np.concatenate([_tree(g[: cut + 1], h[: cut + 1], depth - 1, ridge, least), _tree(g[cut + 1 :], h[cut + 1 :], depth - 1, ridge, least)])
    return np.full(len(g), total_g / (total_h + ridge))


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best cut on both axes of a grid of sums: leaf values by cell, and its gain."""
    best, values = -1.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    rows, cols = g.shape
    for i in range(rows - 1):
        for j in range(cols - 1):
            parts = []
            for c in (cg, ch):
                a, b, d = c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j]
                parts.append(np.array([a, b, d, c[-1, -1] - a - b - d]))
            gain = float(_gain(parts[0], parts[1], ridge).sum())
            if gain > best:
                leaf = parts[0] / (parts[1] + ridge)
                best = gain
                values = np.empty_like(g)
                values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = leaf
    return values, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 30, n_pairs: int = 6, bins: int = 48, coarse_bins: int = 8, rate: float = 0.08, depth: int = 2, ridge: float = 2.0, least: float = 1.0) -> AdditiveModel:
    """Cyclic boosting for the logistic loss with Newton leaf values."""
    mean = float(y.mean()) if len(y) else 0.5
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    model = AdditiveModel(float(np.log(mean / (1 - mean))))
    if not len(y) or y.min() == y.max():
        return model
    for f in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        model.edges.append(edges)
        model.tables.append(np.zeros(len(edges) + 1))
        model.coarse.append(np.arange(len(edges) + 1) * coarse_bins // (len(edges) + 1))
    at = [np.searchsorted(e, x[:, f]) for f, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(at[f], y - p, len(table))
            h = np.bincount(at[f], p * (1 - p), len(table))
            step = rate * _tree(g, h, depth, ridge, least)
            table += step
            total += step[at[f]]
    wide = [c[b] for c, b in zip(model.coarse, at, strict=True)]

    def grid(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        cell = wide[f] * coarse_bins + wide[g]
        n = coarse_bins * coarse_bins
        return np.bincount(cell, y - p, n).reshape(-1, coarse_bins), np.bincount(cell, p * (1 - p), n).reshape(-1, coarse_bins)

    ranked = sorted(((_quadrants(*grid(f, g), ridge)[1], f, g) for f in range(x.shape[1]) for g in range(f)), reverse=True)
    model.pairs = [(f, g, np.zeros((coarse_bins, coarse_bins))) for _, f, g in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for f, g, table in model.pairs:
            step = rate * _quadrants(*grid(f, g), ridge)[0]
            table += step
            total += step[wide[f], wide[g]]
    return model


def feature_udf():
    """A column function: text -> array of ``FEATURES``."""

    @F.pandas_udf("array<double>")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packer = zstandard.ZstdCompressor(level=1)
        for texts in batches:
            yield pd.Series([features(t, packer) for t in texts])

    return run


def learn_quality(docs: DataFrame, labels: DataFrame, trains: Column, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AdditiveModel:
    """Fit on labelled rows for which ``trains`` (an expression over ``labels``) holds."""
    usable = labels.where(trains & col(labels, label_col).isNotNull() & col(labels, id_col).isNotNull())
    usable = usable.select(col(labels, id_col).alias("id"), col(labels, label_col).cast("int").alias("y"))
    n = usable.count()
    few = usable.withColumn("draw", hash_fraction(F.col("id"))).where(F.col("draw") < min(1.0, 1.2 * max_rows / max(1, n)))
    chosen = few.orderBy("draw", "id", "y").limit(max_rows).select("id", "y")
    texts = docs.select(col(docs, id_col).alias("id"), col(docs, text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), "id").select("id", "y", feature_udf()("text").alias("x"))  # max_rows ids of 8 bytes
    found = joined.groupBy("id", "y").agg(F.min("x").alias("x")).toPandas()  # one text per labelled id, however often it occurs
    found = found.assign(key=[tuple(r) for r in found["x"]]).sort_values(["key", "y"])  # the same model in whatever order rows come
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, found["y"].to_numpy(np.float64))


def quality_udf(docs: DataFrame, model: AdditiveModel):
    """A column function: text -> score in [0, 1]."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some tables of a few dozen numbers

    @F.pandas_udf("double")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packer = zstandard.ZstdCompressor(level=1)
        for texts in batches:
            parts = [np.array([features(t, packer) for t in part]) for part in slices_by_bytes(texts)]
            yield pd.Series(shared.value.score(np.concatenate(parts)) if parts else np.empty(0))

    return run


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted."""
    scored = docs.select(col(docs, id_col).alias("doc_id"), quality_udf(docs, model)(col(docs, text_col)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
