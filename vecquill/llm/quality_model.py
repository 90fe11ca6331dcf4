"""Quality by histogram gradient-boosted trees over document statistics, flattened into arrays.

Training reads ``per_class`` labelled rows of each class at most (a documented bound), bins every statistic at the
sample's quantiles and grows trees of fixed depth on the binned columns from gradient histograms. The trees lie in
three arrays (statistic, bin, leaf value), which numpy walks for many documents at once. Every row is scored on the
statistics of its whole text.

Defined results: a null or empty text has statistics of 0 and is scored by them; a null id is not held out; with no
labelled rows every score is 0.0, with one class only that class's value; of rows that repeat an id, training takes the least text, and
all are scored; of repeated labels the greater one holds; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquill.llm.quality_rules import statistics
from vecquill.llm.samples import fold, labelled_sample
from vecquill.llm.shared import batches_of, bounded_batches
from vecquill.llm.textbytes import slices, text_buffer

DEPTH, TREES, BINS, RATE, RIDGE = 4, 80, 64, 0.15, 2.0


def columns(s: dict[str, np.ndarray]) -> np.ndarray:
    """Features of each document from its statistics."""
    w, c, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / w, s["n_symbols"] / w, s["n_symbols"] / c, s["n_dup_lines"] / lines, s["n_repeat_words"] / w,
        s["n_upper"] / np.maximum(s["n_alpha"], 1), s["n_alpha"] / c, s["n_digits"] / c, s["n_bangs"] / w, s["n_lines"] / w, s["n_distinct_words"] / w,
        s["n_distinct_words"] / np.sqrt(w), s["n_stops"] / w, s["n_words"] / c,
    ], axis=1).astype(np.float32)


class Trees:
    """Boosted trees of one depth in arrays: node i's children are 2i + 1 and 2i + 2."""

    def __init__(self) -> None:
        self.cuts: list[np.ndarray] = []
        self.base, self.constant = 0.0, None
        self.feature = np.zeros((0, 2**DEPTH - 1), np.int16)
        self.bin = np.zeros((0, 2**DEPTH - 1), np.int16)
        self.leaf = np.zeros((0, 2**DEPTH))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    def leaves(self, b: np.ndarray, t: int) -> np.ndarray:
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[rows, self.feature[t, node]] > self.bin[t, node])
        return node - (2**DEPTH - 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        b, z = self.binned(x), np.full(len(x), self.base)
        for t in range(len(self.leaf)):
            z += self.leaf[t, self.leaves(b, t)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        """One tree more. b: binned columns; g, h: first and second derivatives of the loss."""
        n, k = b.shape
        feature, cut = np.zeros(2**DEPTH - 1, np.int16), np.full(2**DEPTH - 1, BINS, np.int16)
        node = np.zeros(n, np.int64)
        for d in range(DEPTH):
            base, wide = 2**d - 1, 2**d
            at = (node - base)[:, None] * (k * BINS) + np.arange(k) * BINS + b
            size = wide * k * BINS
            sg = np.bincount(at.ravel(), np.repeat(g, k), size).reshape(wide, k, BINS).cumsum(2)
            sh = np.bincount(at.ravel(), np.repeat(h, k), size).reshape(wide, k, BINS).cumsum(2)
            tg, th = sg[:, :, -1:], sh[:, :, -1:]
            gain = sg**2 / (sh + RIDGE) + (tg - sg) ** 2 / (th - sh + RIDGE) - tg**2 / (th + RIDGE)
            gain[(sh < 1) | (th - sh < 1)] = 0
            best = gain.reshape(wide, -1).argmax(1)
            worth = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-3
            feature[base : base + wide] = np.where(worth, best // BINS, 0)
            cut[base : base + wide] = np.where(worth, best % BINS, BINS)
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + RIDGE)
        self.feature, self.bin, self.leaf = np.vstack([self.feature, feature]), np.vstack([self.bin, cut]), np.vstack([self.leaf, value])


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Fit with classes of equal weight where both have rows; the score of 0.7 then asks for clear evidence."""
    m = Trees()
    if len(np.unique(y)) < 2:
        m.constant = float(y[0]) if len(y) else 0.0
        return m
    m.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1], method="lower")) for k in range(x.shape[1])]
    b, share = m.binned(x), y.mean()
    m.base = float(np.log(share / (1 - share)))
    z = np.full(len(y), m.base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-z))
        m.grow(b, p - y, p * (1 - p))
        z += m.leaf[t, m.leaves(b, t)]
    return m


def score_with_trees(docs: DataFrame, labels: DataFrame, per_class: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    bounded_batches(docs.sparkSession)
    texts, y = labelled_sample(docs, labels, "quality", fold(id_col, 4) != 2, per_class, id_col, text_col)
    data, offs = text_buffer(texts)
    x = np.concatenate([columns(statistics(d, o)) for _, _, d, o in slices(data, offs)]) if len(y) else np.zeros((0, 15), np.float32)
    model = train(x, y)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            data, offs = text_buffer(b.column(2))
            s = np.concatenate([model.scores(columns(statistics(d, o))) for _, _, d, o in slices(data, offs)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=[id_col, "held_out", "score"])

    scored = docs.select(F.col(f"`{id_col}`"), (fold(id_col, 4) == 2).alias("held_out"), F.col(f"`{text_col}`").cast("string")).mapInArrow(score, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
