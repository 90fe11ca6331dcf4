"""Statistics of all vectors of a table, component by component: bounds, means and exact medians; tables of one size pass the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquill.operators import exact

#: Bits of a value that one pass of the medians settles.
DIGIT = 11

Mapped = Callable[[np.ndarray], np.ndarray]


def _tables(rows: DataFrame, of: Mapped, partial: Callable[[Iterator[np.ndarray]], np.ndarray | None]) -> Iterator[np.ndarray]:
    """What ``partial`` makes of the mapped vectors of each task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (of(exact.matrix_of(b.column("v").slice(at, exact.TILE_ROWS))) for b in it for at in range(0, b.num_rows, exact.TILE_ROWS))
        out = partial(parts)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([str(out.dtype)]), pa.array([len(out)], pa.int32())], names=["x", "kind", "n"])

    base = rows.where("v is not null").select(F.col("v").cast("array<double>").alias("v"))
    for r in base.mapInArrow(run, "x binary, kind string, n int").toLocalIterator():
        yield np.frombuffer(r.x, r.kind).reshape(r.n, -1)


def moments(rows: DataFrame, of: Mapped) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(number, least, greatest, sum) of the mapped vectors."""

    def partial(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        out = None
        for x in parts:
            own = np.stack([np.full(x.shape[1], float(len(x))), x.min(0), x.max(0), x.sum(0)])
            out = own if out is None else np.stack([out[0] + own[0], np.minimum(out[1], own[1]), np.maximum(out[2], own[2]), out[3] + own[3]])
        return out

    found = list(_tables(rows, of, partial))  # four rows a task
    if not found:
        raise ValueError("no vectors to train on")
    t = np.stack(found)
    return int(t[:, 0, 0].sum()), t[:, 1].min(0), t[:, 2].max(0), t[:, 3].sum(0)


def _keys(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the values."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def medians(rows: DataFrame, of: Mapped, n: int, d: int) -> np.ndarray:
    """The medians of the d components of n mapped vectors: the two middle values are found digit by digit, a pass each."""
    rank = np.stack([np.full(d, (n - 1) // 2), np.full(d, n // 2)]).astype(np.int64)
    known, left = np.zeros((2, d), np.uint64), 64
    while left:
        digit = min(DIGIT, left)
        shift, size = np.uint64(left - digit), 1 << digit

        def partial(parts: Iterator[np.ndarray], known=known, left=left, shift=shift, size=size) -> np.ndarray | None:
            out = np.zeros((2, d * size), np.int64)
            for x in parts:
                keys = _keys(np.ascontiguousarray(x))
                for side in range(2):
                    place = ((keys >> shift) & np.uint64(size - 1)).astype(np.int64) + np.arange(d) * size
                    same = np.ones(keys.shape, bool) if left == 64 else keys >> np.uint64(left) == known[side] >> np.uint64(left)
                    out[side] += np.bincount(place[same], minlength=d * size)
            return out

        counts = sum(_tables(rows, of, partial)).reshape(2, d, size)
        ends = counts.cumsum(2)
        own = (ends <= rank[:, :, None]).sum(2)
        rank = rank - np.where(own > 0, np.take_along_axis(ends, np.maximum(own - 1, 0)[:, :, None], 2)[:, :, 0], 0)
        known, left = known | (own.astype(np.uint64) << shift), left - digit
    bits = np.where(known >> np.uint64(63) == 1, known & np.uint64((1 << 63) - 1), ~known)
    low, high = bits.view(float)
    return low + 0.5 * (high - low)
