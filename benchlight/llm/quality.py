"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once, in the map tasks, and written. A
sample of labelled rows, bounded by ``SAMPLE_ROWS``, comes to the driver and is binned;
each tree is grown level by level from histograms of gradients. Every tree is complete
to its depth, so that the model is three arrays and a batch of rows walks a tree with
one comparison per level.

Only statistics of the text are inputs. NULL counts as the empty text, which has a
score like any other, a very long one is measured whole. Other columns are not read. Of several labels of one id the least counts. Without labelled
rows of both classes every score is the share of the label there is, or 0.5. Rows that
repeat score alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlight.session import settle

SAMPLE_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
PENALTY = 1.0
FOLDS = 3
HELD_OUT_FOLD = 1

STATISTICS = (
    "log_chars",
    "log_words",
    "chars_per_word",
    "longest_word",
    "upper_share",
    "digit_share",
    "symbol_share",
    "stop_share",
    "comma_share",
    "shout_share",
    "other_mark_share",
    "high_byte_share",
    "blank_share",
    "byte_entropy",
    "distinct_words",
    "distinct_pairs",
    "repeated_next",
    "upper_words",
    "alphabetic_words",
    "top_word_share",
    "words_per_line",
    "distinct_lines",
    "ended_lines",
    "short_lines",
)

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "stop": b".",
    "comma": b",",
    "shout": b"!?",
    "other": b"\"'()+-/:;=@[\\]^_`{}~",
    "blank": b" \t\n\x0b\x0c\r",
}


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, n_words, n_lines = max(len(raw), 1), max(len(words), 1), max(len(lines), 1)
    share = {k: counts[list(v)].sum() / n for k, v in _CLASSES.items()}
    p = counts[counts > 0] / n
    times: dict[str, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        sum(map(len, words)) / n_words,
        max(map(len, words), default=0),
        share["upper"],
        share["digit"],
        share["symbol"],
        share["stop"],
        share["comma"],
        share["shout"],
        share["other"],
        counts[128:].sum() / n,
        share["blank"],
        float(-(p * np.log2(p)).sum()),
        len(times) / n_words,
        len(set(zip(words, words[1:], strict=False))) / n_words,
        sum(map(eq, words, words[1:])) / n_words,
        sum(map(str.isupper, words)) / n_words,
        sum(map(str.isalpha, words)) / n_words,
        max(times.values(), default=0) / n_words,
        len(words) / n_lines,
        len(set(lines)) / n_lines,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / n_lines,
        sum(len(x) < 30 for x in lines) / n_lines,
    ]


def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([np.array(statistics(t or ""), np.float32) for t in texts])


def described(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``features`` of every document."""
    udf = F.pandas_udf(_statistics, "array<float>")
    return docs.select(
        F.col(key).alias("doc_id"), udf(F.col(text).cast("string")).alias("features")
    )


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string")) % FOLDS


def sample(features: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``rows`` labelled documents outside the held-out
    fold, those of the least hashes."""
    usable = (
        labels.filter(F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT_FOLD))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    total = usable.count()
    limit = F.lit(2**63 - 1) if total <= rows else F.lit(int(2**64 * (rows / total)) - 2**63)
    drawn = usable.filter(F.xxhash64("doc_id") <= limit)
    found = (
        features.join(drawn, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select("features", "label")
        .toPandas()
    )
    if not len(found):
        return np.zeros((0, len(STATISTICS)), np.float32), np.zeros(0)
    return np.stack(found["features"].to_list()).astype(np.float32), found["label"].to_numpy(float)


@dataclass
class Trees:
    """Complete trees: feature and threshold of each inner node in heap order, leaf values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            margin += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosts logistic loss over binned statistics."""
    inner, n_features = 2**DEPTH - 1, len(STATISTICS)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Trees(
        float(np.log(mean / (1 - mean))),
        np.zeros((trees, inner), np.int64),
        np.full((trees, inner), np.inf, np.float32),
        np.zeros((trees, inner + 1)),
    )
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1], method="lower")) for j in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    slots = binned + np.arange(n_features) * BINS
    margin, rows = np.full(len(y), model.base), np.arange(len(y))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            place = ((at - first)[:, None] * (n_features * BINS) + slots).ravel()
            size = n * n_features * BINS
            g = np.bincount(place, np.repeat(slope, n_features), size).reshape(n, n_features, BINS).cumsum(axis=2)
            h = np.bincount(place, np.repeat(bend, n_features), size).reshape(n, n_features, BINS).cumsum(axis=2)
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + PENALTY) + (all_g - g) ** 2 / (all_h - h + PENALTY) - all_g**2 / (all_h + PENALTY)
            gain[(h < 1) | (all_h - h < 1)] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            feature, cut = best // BINS, best % BINS
            for i in range(n):
                if gain[i, feature[i], cut[i]] > 1e-9 and cut[i] < len(edges[feature[i]]):
                    model.feature[t, first + i] = feature[i]
                    model.threshold[t, first + i] = edges[feature[i]][cut[i]]
            at = 2 * at + 1 + (x[rows, model.feature[t, at]] > model.threshold[t, at])
        place = at - inner
        g = np.bincount(place, slope, inner + 1)
        h = np.bincount(place, bend, inner + 1)
        model.leaf[t] = RATE * g / (h + PENALTY)
        margin += model.leaf[t, place]
    return model


def _scored(model: Trees):
    @F.pandas_udf("double")
    def run(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.stack(features.to_list()).astype(np.float32)))

    return run


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document.

    ``labels`` has ``doc_id`` and ``label``; rows of the held-out fold are never learnt.
    """
    features = settle(described(docs, text, key))
    model = fit(*sample(features, labels))
    # Ids stay on Spark's side, where they keep their type and value beside NULL.
    scored = features.select("doc_id", _scored(model)("features").alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
