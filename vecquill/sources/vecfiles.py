"""Vector files of fixed records: a little-endian 32-bit dimension, then so many components.

``fvecs`` holds 32-bit floats, ``ivecs`` 32-bit integers, ``bvecs`` bytes. Records are of equal length, so large files
are split between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a partition that comes to the driver, and bytes that it writes at once.
PARTITION_ROWS, BUFFER = 50_000, 4 << 20
_FORMS = {"fvecs": ("<f4", "array<float>"), "ivecs": ("<i4", "array<int>"), "bvecs": ("u1", "array<int>")}


def read_vectors(spark: SparkSession, path: str, dimensions: int, form: str = "fvecs") -> DataFrame:
    """(id, v): ids number the records from 0 in the order of the file. A record of another dimension is an error."""
    if form not in _FORMS:
        raise ValueError(f"unknown form {form!r}")
    dtype, type_ = _FORMS[form]
    # there is no DataFrame source for fixed binary records that splits a file
    records = spark.sparkContext.binaryRecords(path, 4 + dimensions * np.dtype(dtype).itemsize)

    def rows(it: Iterator[tuple[bytes, int]]) -> Iterator[tuple[int, list]]:
        for raw, i in it:
            if int.from_bytes(raw[:4], "little") != dimensions:
                raise ValueError(f"record {i} is not of {dimensions} dimensions")
            yield i, np.frombuffer(raw, dtype, offset=4).tolist()

    return spark.createDataFrame(records.zipWithIndex().mapPartitions(rows), f"id long, v {type_}")


def vector_records(rows: DataFrame, form: str = "fvecs") -> DataFrame:
    """(id, record): the bytes of each (id, v); a null vector has none. Joined in the order of ids they are a vector file."""
    if form not in _FORMS:
        raise ValueError(f"unknown form {form!r}")
    dtype = _FORMS[form][0]

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield vectors.map(lambda v: None if v is None else np.int32(len(v)).tobytes() + np.asarray(v).astype(dtype).tobytes())

    return rows.select("id", run("v").alias("record")).where("record is not null")


def write_vectors(rows: DataFrame, path: str, form: str = "fvecs", records: int = 1_000_000) -> None:
    """Vector files of ``records`` rows at most under ``path``, in the order of ids, so that their names keep the order.

    The path may lie in any store that Spark reaches: the records come to the driver partition by partition and it writes
    them through Spark's file systems, so this is for files that other programs want; tables of their own go to Parquet.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(place):
        raise FileExistsError(path)
    files.mkdirs(place)
    parts = max(1, -(-rows.count() // PARTITION_ROWS))
    ordered = vector_records(rows, form).repartitionByRange(parts, "id").sortWithinPartitions("id").select("record")
    out, held, size, n = None, [], 0, 0
    for r in ordered.toLocalIterator():
        if n % records == 0:
            if out is not None:
                out.write(bytearray(b"".join(held)))
                out.close()
            out, held, size = files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-{n // records:06d}.{form}")), [], 0
        held.append(bytes(r.record))
        size += len(held[-1])
        n += 1
        if size >= BUFFER:
            out.write(bytearray(b"".join(held)))
            held, size = [], 0
    if out is not None:
        out.write(bytearray(b"".join(held)))
        out.close()
