"""What the operators of this subpackage share: durable tables, batch limits, packed exchanges and small statistics."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch, so that a Python worker holds a bounded piece of long texts at a time.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches. Plans read this when they run, so it stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; one of our own in a local session that names none (tests)."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if not set_:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="vecquill-")
        atexit.register(shutil.rmtree, folder, True)
        set_ = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", set_)
    return set_


#: The folders that durable() has written and release() has not deleted yet.
_written: list[str] = []


def durable(df: DataFrame, partition_by: Iterable[str] = ()) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no recomputation.

    The table lives until release() or until the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vecquill-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete_all, spark)
    _written.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """The number of tables so far, for release()."""
    return len(_written)


def release(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Delete the tables of durable() from one mark to another; nothing that is still to run may read them."""
    for i in range(since, len(_written) if until is None else until):
        if _written[i]:
            place = spark._jvm.org.apache.hadoop.fs.Path(_written[i])
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            _written[i] = ""


def _delete_all(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        release(spark, 0)


def width(df: DataFrame) -> int:
    """Partitions for an exchange that holds about as much as ``df``: grows with the input and follows the session."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def pack(bucket: np.ndarray, *columns: np.ndarray, kind: int = 0) -> pa.RecordBatch | None:
    """One row for each bucket, with the values of its entries as packed bytes: (bucket, kind, c0, c1, ...)."""
    if len(bucket) == 0:
        return None
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    bounds = np.concatenate([[0], cuts, [len(sorted_)]])
    arrays = [pa.array(sorted_[bounds[:-1]].astype(np.int32)), pa.array(np.full(len(bounds) - 1, kind, np.int32))]
    for c in columns:
        c = np.ascontiguousarray(c[order])
        size = c.dtype.itemsize * (int(np.prod(c.shape[1:])) if c.ndim > 1 else 1)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(c)]))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "kind", *(f"c{i}" for i in range(len(columns)))])


def packed_schema(n: int) -> str:
    return ", ".join(["bucket int", "kind int", *(f"c{i} binary" for i in range(n))])


def unpack(column, dtype) -> np.ndarray:
    """All values of a packed column, one row after the other."""
    parts = [np.frombuffer(b, dtype) for b in column.to_pylist() if b]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def first_of_groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    if len(sorted_keys) == 0:
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all ranges, one range after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def batches_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in it if b.num_rows)
