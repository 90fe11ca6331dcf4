"""Jump consistent hashing of stable keys to shards, without a ring table.

Law ``key``: the key and the number of shards alone decide a row's shard, and one more shard takes rows only into
itself. Within a shard the rows get gapless slots from 0: rows are dealt to a fixed number of salts by their key, the
counts of (shard, salt) - a bounded table - give each salt its first slot, and a window ranks the rows of one salt.
So no task holds a whole shard, and a key or text that a third of all rows share does no harm, as keys differ.

Defined results: a null key counts as a key of its own (all such rows share a shard); a null text has no bytes and
CRC-32 0; rows with equal keys share a shard and get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecquill.llm.shared import batches_of, bounded_batches

# Fixed value: the multiplier of the 64-bit linear congruential generator of the published algorithm.
_LCG = np.uint64(2862933555777941757)
#: Parts of each shard that are ranked apart.
SALTS = 256


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    key, b, j = keys.astype(np.uint64).copy(), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        b[live] = j[live]
        key[live] = key[live] * _LCG + np.uint64(1)
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[j[live] < shards]
    return b


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit("").cast("binary"))
    # the text's size and checksum are taken in the JVM, so that texts are never shuffled nor sent to Python
    light = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("key"))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            key = b.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            salt = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("size"), b.column("crc"), pa.array(jump_hash(key, shards).astype(np.int32)), pa.array(jump_hash(key, shards + 1).astype(np.int32)), pa.array((salt % SALTS).astype(np.int32))], names=["id", "size", "crc", "shard", "grown", "salt"])

    placed = light.mapInArrow(place, "id long, size long, crc long, shard int, grown int, salt int")
    counts = placed.groupBy("shard", "salt").count()  # shards x SALTS rows at most
    first = counts.select("shard", "salt", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "salt").orderBy("id", "crc", "size")) - 1)
    return ranked.join(F.broadcast(first), ["shard", "salt"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"), F.col("grown").alias("grown_shard")
    )
