"""Text to vectors over a model behind an interface: tokens, overlapping windows, pooling, normalised vectors, their mean.

A provider stands for the model. It travels to the tasks, so it must pickle; it may load its weights on first use there.
Each task takes Arrow batches of texts; windows of several texts go to the provider together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POOLINGS = ("none", "mean", "cls", "last", "rank")


class EmbeddingProvider(Protocol):
    """What a model offers."""

    def tokenize(self, text: str) -> list[int]:
        """Ids of a text, with the special ones that the model adds."""

    def encode(self, windows: list[list[int]]) -> list[np.ndarray]:
        """Of each window, a vector for each token (tokens x dimensions)."""

    def rank(self, window: list[int]) -> np.ndarray:
        """The classifier's output for a window; asked for with pooling ``rank`` only."""


@dataclass(frozen=True)
class EmbedOptions:
    """n_ctx and n_ubatch bound a window; threads are the executor's and accepted for callers that set them."""

    n_ctx: int = 512
    n_ubatch: int = 512
    pooling: str = "mean"
    n_threads: int | None = None
    n_threads_batch: int | None = None
    embeddings: bool = True

    def __post_init__(self):
        if self.pooling not in POOLINGS:
            raise ValueError(f"unknown pooling {self.pooling!r}")
        if self.window < 1:
            raise ValueError("a window holds a token at least")
        if not self.embeddings:
            raise ValueError("embeddings are off")

    @property
    def window(self) -> int:
        return min(self.n_ctx, self.n_ubatch)

    @property
    def stride(self) -> int:
        return self.window - self.window // 8


def windows(n: int, options: EmbedOptions) -> list[tuple[int, int]]:
    """(start, end) of the windows of n tokens: one begins at every stride below n, also if the one before reaches the end."""
    return [(s, min(s + options.window, n)) for s in range(0, n, options.stride)]


def pool(tokens: np.ndarray, pooling: str) -> np.ndarray:
    """The vector of a window from its tokens' vectors."""
    if pooling == "mean":
        return tokens.mean(axis=0)
    return tokens[0] if pooling == "cls" else tokens[-1]  # "none" gives the last token's


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v.astype(float) ** 2).sum())
    return v / n if n > 0 else v


def text_vectors(provider: EmbeddingProvider, text: str | None, options: EmbedOptions) -> tuple[list[np.ndarray], np.ndarray | None]:
    """The normalised vectors of a text's windows, and their normalised mean: for one window its vector, for no text none."""
    ids = provider.tokenize(text) if text else []
    cut = [ids[a:b] for a, b in windows(len(ids), options)]
    if not cut:
        return [], None
    if options.pooling == "rank":
        vecs = [unit(np.asarray(provider.rank(w), float)) for w in cut]
    else:
        vecs = [unit(pool(np.asarray(t, float), options.pooling)) for t in provider.encode(cut)]
    return vecs, vecs[0] if len(vecs) == 1 else unit(np.mean(vecs, axis=0))


def embed(docs: DataFrame, provider: EmbeddingProvider, options: EmbedOptions = EmbedOptions(), id_col: str = "doc_id", text_col: str = "text", half: bool = False) -> DataFrame:
    """(id, vecs, avg_vec) of each text, components as 32-bit floats, or rounded to 16 bits for ``half``.

    A null or empty text, or one without tokens, has no vectors and a null mean.
    """
    kind = np.float16 if half else np.float32

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            vecs, mean = [], []
            for t in b.column(1).to_pylist():
                own, avg = text_vectors(provider, t, options)
                vecs.append([v.astype(kind).astype(np.float32) for v in own])
                mean.append(None if avg is None else avg.astype(kind).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vecs, pa.list_(pa.list_(pa.float32()))), pa.array(mean, pa.list_(pa.float32()))], names=[id_col, "vecs", "avg_vec"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, vecs array<array<float>>, avg_vec array<float>")


class WordProvider:
    """A small model without weights, for tests and dry runs: a token is a word between spaces, its vector a function of
    the word's length and first character."""

    def __init__(self, dimensions: int = 4):
        self.dimensions = dimensions

    def tokenize(self, text: str) -> list[int]:
        return [len(w) * 0x110000 + ord(w[0]) for w in text.split(" ") if w]

    def encode(self, windows: list[list[int]]) -> list[np.ndarray]:
        j = np.arange(self.dimensions)
        out = []
        for w in windows:
            n, c = np.divmod(np.array(w, np.int64), 0x110000)
            out.append(((n[:, None] * (j + 3) + c[:, None]) % 17 - 8).astype(float))
        return out

    def rank(self, window: list[int]) -> np.ndarray:
        return np.array([float(len(window))])


def retrieve(docs: DataFrame, queries: DataFrame, provider: EmbeddingProvider, k: int = 3, options: EmbedOptions = EmbedOptions(), separator: str = "\n", size: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, id, chunk, text, distance): the k chunks of the documents nearest to each query (id, text) by cosine.

    Documents are cut behind the separator into chunks of more than ``size`` characters; each is embedded by the mean of
    its windows. ids of chunks are their document's id times 2**20 plus their number; a document has fewer chunks than that.
    """
    from vecquill.operators import pieces, search

    cut = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.posexplode(pieces.over_batches(pieces.chunks(separator, size))(F.col(f"`{text_col}`"))).alias("chunk", "text"))
    chunks = cut.select((F.col("doc") * (1 << 20) + F.col("chunk")).alias("id"), "chunk", "text")
    vectors = lambda rows: embed(rows, provider, options, "id", "text").where("avg_vec is not null").select("id", F.col("avg_vec").cast("array<double>").alias("v"))
    found = search.knn(vectors(queries.select(F.col("id").cast("long").alias("id"), "text")), vectors(chunks), k, "cosine")
    return found.join(chunks, "id").select("query_id", "rank", (F.col("id") / (1 << 20)).cast("long").alias("id"), "chunk", "text", "distance")
