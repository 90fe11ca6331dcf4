"""Scans of coded vectors in numpy: every task keeps the k nearest of its rows for each query, and these meet in one ranking.

The queries of a search are a stated set. They are read in blocks of ``QUERY_BLOCK``, which travel with the tasks; the
rows are scanned once for each block and never paired with the queries in Spark, so a search shuffles k rows a query and
task whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecquill.operators import exact

#: Queries that travel with a task.
QUERY_BLOCK = 4096
#: Rows of a batch that are compared at once, so that rows times queries stay bounded.
ROWS_AT_ONCE = 2048
NUMBERS_AT_ONCE = 1 << 20
PAIRS = "query_id long, id long, distance double"

#: Of a batch: distances, a row for each of its rows and a column for each query; NaN where a query does not ask for a row.
Distances = Callable[[pa.RecordBatch], np.ndarray]


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries (id, v) in blocks; null vectors are left out."""
    q = queries.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    for i in range(blocks):
        own = q if blocks == 1 else q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        rows = sorted(own.collect(), key=lambda r: r.id)
        if rows:
            yield np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows], float)


def vectors_of(column) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def codes_of(column) -> np.ndarray:
    """A column of codes of equal length as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.uint8)


def squared_l2(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ q.T + (q * q).sum(1)[None, :], 0)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return x @ q.T


def hamming(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of matrices of bits."""
    return x.sum(1)[:, None] + q.sum(1)[None, :] - 2.0 * x.astype(float) @ q.astype(float).T


def least(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each column of s the k least values and their ids (two tables of k rows), by value, then id; missing ones are infinite."""
    if len(s) > k:
        edge = np.partition(s, k - 1, axis=0)[k - 1]
        some = (s <= edge).any(axis=1)
        s, ids = s[some], ids[some]
    order = np.lexsort((ids, s), axis=0)[:k]
    s, ids = np.take_along_axis(s, order, 0), np.take_along_axis(ids, order, 0)
    short = k - len(s)
    return (np.pad(s, ((0, short), (0, 0)), constant_values=np.inf), np.pad(ids, ((0, short), (0, 0)))) if short > 0 else (s, ids)


def _parts(it: Iterator[pa.RecordBatch], queries: int) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that rows times queries stay within a bound."""
    for whole in it:
        size = max(16, min(ROWS_AT_ONCE, NUMBERS_AT_ONCE // max(1, queries)))
        for at in range(0, whole.num_rows, size):
            yield whole.slice(at, size)


def nearest(rows: DataFrame, distances: Distances, query_ids: np.ndarray, k: int, larger: bool, pairs: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray] | None = None, scale: float = 0.0) -> DataFrame:
    """(query_id, id, distance): for each task the k nearest of its rows to each query. rows have a column id.

    ``pairs``: of a batch, places of queries and places of rows, the exact distances, where those of ``distances`` are off by
    rounding; ``scale`` is the greatest squared length of a query.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = exact.Nearest(len(query_ids), k)
        for b in _parts(it, len(query_ids)):
            d = distances(b).T
            out = np.isnan(d)
            off = np.full(len(d), 0.0 if pairs is None else 1e-12 * (scale + np.abs(d, where=~out, out=np.zeros(d.shape)).max(initial=0)))
            s = np.where(out, np.inf, -d if larger else d)
            value = None if pairs is None else lambda qi, ri, b=b: (-1 if larger else 1) * pairs(b, qi, ri)
            best.add(b.column("id").to_numpy(zero_copy_only=False).astype(np.int64), iter([(slice(0, len(d)), s, off, value)]), lambda own, out=out: out)
        query, ids, found = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[query]), pa.array(ids), pa.array(-found if larger else found)], names=["query_id", "id", "distance"])

    return rows.mapInArrow(run, PAIRS)


def within(rows: DataFrame, distances: Distances, query_ids: np.ndarray, radius: float, larger: bool) -> DataFrame:
    """(query_id, id, distance) of all pairs strictly within the radius, or beyond it for similarities."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(it, len(query_ids)):
            d = distances(b)
            row, query = np.nonzero((d > radius) if larger else (d < radius))
            ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[query]), pa.array(ids[row]), pa.array(d[row, query])], names=["query_id", "id", "distance"])

    return rows.mapInArrow(run, PAIRS)


def ranked(pairs: DataFrame, k: int, larger: bool) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of the pairs by distance, then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("distance") if larger else F.asc("distance"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def all_blocks(rows: DataFrame, queries: DataFrame, of_block: Callable[[np.ndarray, np.ndarray], DataFrame]) -> DataFrame:
    """The union of what is found for each block of queries; nothing for no queries."""
    found = [of_block(ids, q) for ids, q in query_blocks(queries)]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], PAIRS)
