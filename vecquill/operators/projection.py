"""Linear maps of vectors: principal components, random rotations, centering; applied in numpy, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Rows that are mapped at once.
ROWS_AT_ONCE = 2_048


@dataclass
class LinearMap:
    """x -> matrix @ x + bias. The size is that of the dimensions and does not grow with the rows."""

    matrix: np.ndarray
    bias: np.ndarray

    def over(self, x: np.ndarray) -> np.ndarray:
        """The mapped rows of x; sums run component by component, so that equal rows stay equal."""
        out, t = np.zeros((len(x), len(self.matrix))), np.empty((len(x), len(self.matrix)))
        with np.errstate(all="ignore"):
            for c, m in zip(x.T, self.matrix.T):
                out += np.multiply(c[:, None], m[None, :], out=t)
            return np.add(out, self.bias, out=out)

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows with v mapped; a null vector stays null, and one of another length or with a null in it is mapped to nulls."""
        size, d = self.matrix.shape
        names = rows.columns
        at = names.index("v")
        schema = StructType([StructField("v", ArrayType(DoubleType())) if f.name == "v" else f for f in rows.schema])

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in it:
                for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                    b = whole.slice(lo, ROWS_AT_ONCE)
                    v = b.column(at)
                    right = v.value_lengths().to_pandas().to_numpy(float) == d
                    flat = v.filter(pa.array(right)).flatten()
                    out = np.full((len(v), size), np.nan)
                    out[right] = self.over(np.asarray(flat, float).reshape(-1, d))
                    nulls = ~right
                    if flat.null_count:
                        nulls[right] = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(1)
                    there = v.is_valid().to_numpy(zero_copy_only=False)
                    values = pa.array(out[there].ravel(), mask=np.repeat(nulls[there], size))
                    ends = np.concatenate([[0], np.cumsum(there * size)]).astype(np.int32)
                    mapped = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(~there))
                    yield pa.RecordBatch.from_arrays([mapped if i == at else b.column(i) for i in range(b.num_columns)], names=names)

        return rows.mapInArrow(run, schema)

    def then(self, after: "LinearMap") -> "LinearMap":
        return LinearMap(after.matrix @ self.matrix, after.matrix @ self.bias + after.bias)

    def reverse(self) -> "LinearMap":
        """The way back by the transpose; exact for rotations."""
        return LinearMap(self.matrix.T, -self.matrix.T @ self.bias)


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of vectors, their sum and the sum of their outer products, from all rows; each task sends one table."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in it:
            x = b.column(0).drop_null()
            if not len(x):
                continue
            m = np.asarray(x.flatten(), np.float64).reshape(len(x), -1)
            m = np.concatenate([np.ones((len(m), 1)), m], axis=1)
            total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "line"])

    parts = rows.select("v").mapInArrow(partial, "i int, line array<double>").select("i", F.posexplode("line").alias("j", "x"))
    cells = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()  # (dimensions + 1) squared rows
    if not len(cells):
        raise ValueError("no vectors to train on")
    table = np.zeros((cells.i.max() + 1, cells.j.max() + 1))
    table[cells.i, cells.j] = cells.x
    return int(round(table[0, 0])), table[0, 1:], table[1:, 1:]


def centering(rows: DataFrame) -> LinearMap:
    n, s, _ = moments(rows)
    return LinearMap(np.eye(len(s)), -s / n)


def pca(rows: DataFrame, size: int, whiten: float = 0.0) -> LinearMap:
    """The ``size`` directions of most variance around the mean, each scaled by variance ** whiten (-0.5 whitens)."""
    n, s, gram = moments(rows)
    mean = s / n
    values, directions = np.linalg.eigh(gram / n - np.outer(mean, mean))
    order = np.argsort(-values, kind="stable")[:size]
    m = directions[:, order].T
    m *= np.where(m[np.arange(len(m)), np.abs(m).argmax(1)] < 0, -1.0, 1.0)[:, None]  # the greatest component is positive
    if whiten:
        m = m * np.maximum(values[order], 1e-12)[:, None] ** whiten
    return LinearMap(m, -m @ mean)


def random_rotation(dimensions: int, size: int, seed: int = 12345) -> LinearMap:
    """A seeded map with orthonormal rows, or orthonormal columns where size is greater."""
    wide = max(dimensions, size)
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(wide, wide)))
    return LinearMap((q * np.sign(np.diag(r)))[:size, :dimensions], np.zeros(size))
