"""A bounded sample of labelled texts for training, never holding a row of the held-out fold. It does not depend on the order of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[pa.Array, np.ndarray]:
    """Whole texts and labels of ``per_class`` rows of each class at most, by the order of a hash of the id. allowed: a condition on the labels' ids; other rows' labels are never read."""
    own = labels.where(allowed & F.col(f"`{id_col}`").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(F.max(label).alias("y"))
    chosen = None
    for y in (0, 1):  # 2 * per_class ids at most are sent to every task
        part = own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas(), "id long, y int") if chosen is not None else chosen
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    table = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toArrow().sort_by("id")  # of a repeated id, the least text
    return table["text"].combine_chunks() if len(table) else pa.array([], pa.string()), table["y"].to_numpy().astype(np.int64) if len(table) else np.zeros(0, np.int64)
