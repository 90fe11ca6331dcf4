"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A document is its token ids and an end id. Longer ones are cut into pieces of the full length, the first of which may
be shorter. Packing is planned on the histogram of piece lengths, which has ``capacity`` rows at most, so the plan
does not grow with the input: a bin is filled greedily, longest first; then its smallest piece gives way to two
unpacked pieces that fit the expanded gap more tightly; and the bin's pattern is repeated while its lengths last.
A piece of the full length fills a sequence alone and needs no rank. Each other piece finds its place by its rank among
the pieces of its length, which is taken within salts; a length has a salt for every ``RANKED`` of its pieces, so no task
ranks more than about that many, however common a length is.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed one by one; a null
id is packed as any other; which of two pieces of equal length goes to which place is arbitrary, as the contract leaves
it; an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecquill.llm import bytebpe
from vecquill.llm.shared import batches_of, bounded_batches, durable
from vecquill.llm.textbytes import slices, text_buffer

#: Pieces of one length that are ranked together, on average; lengths of fewer pieces have up to LEAST_SALTS salts of FEW.
RANKED, FEW, LEAST_SALTS = 100_000, 200, 16


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def best_pair(present: np.ndarray, room: int) -> tuple[int, int]:
    """Of the lengths present (sorted, each more than once or apart), two that fill most of the room; (0, 0) if none."""
    best, pair = 0, (0, 0)
    i, j = 0, len(present) - 1
    while i <= j and best < room:
        s = int(present[i] + present[j])
        if s > room:
            j -= 1
        else:
            if s > best:
                best, pair = s, (int(present[i]), int(present[j]))
            i += 1
    return pair


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a bin, in order) and how often each is used. counts[length] is used up."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    if left[capacity]:
        out.append(([capacity], int(left[capacity])))
        left[capacity] = 0
    while left.any():
        used = np.zeros(capacity + 1, np.int64)
        bin_, gap = [], capacity
        while gap:
            fits = np.flatnonzero(left[: gap + 1] > used[: gap + 1])
            if not len(fits):
                break
            take = int(fits[-1])
            bin_.append(take)
            used[take] += 1
            gap -= take
        # the smallest piece gives way to two others, if these leave less of the gap
        while gap and len(bin_) > 1:
            small = bin_[-1]
            used[small] -= 1
            free = left - used
            room = gap + small
            lengths = np.flatnonzero(free[: room + 1] > 0)
            a, b = best_pair(lengths, room)
            if a == b and a and free[a] < 2:
                lengths_once = lengths[lengths != a]
                c, d = best_pair(lengths_once, room)
                e = lengths_once[np.searchsorted(lengths_once, room - a, side="right") - 1] if len(lengths_once) and lengths_once[0] <= room - a else 0
                a, b = (c, d) if c + d >= a + e and not (c == d and free[c] < 2) else (a, int(e)) if e else (0, 0)
            if a + b > small:
                bin_ = [*bin_[:-1], *sorted((a, b), reverse=True)]
                used[a] += 1
                used[b] += 1
                gap = room - a - b
                bin_.sort(reverse=True)
            else:
                used[small] += 1
                break
        kinds = np.flatnonzero(used)
        times = int((left[kinds] // used[kinds]).min())
        left -= used * times
        out.append((bin_, times))
    return out


def piece_table(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """id, piece, start, length, ids_crc32 and spread (a hash for salts) of every piece."""
    id_type = dict(docs.dtypes)[id_col]

    def cut_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bytebpe.table(vocabulary)
        end = np.array([end_id], "<u4")
        for b in batches_of(it):
            data, offs = text_buffer(b.column(1))
            for lo, hi, d, o in slices(data, offs):
                counts, ids = table.tokenize(d, o, True)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                row, piece, start, length, crc = [], [], [], [], []
                for i in range(hi - lo):
                    own = np.concatenate([ids[bounds[i] : bounds[i + 1]].astype("<u4"), end])
                    for k, (s, n) in enumerate(cut(len(own), capacity)):
                        row.append(lo + i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(own[s : s + n].tobytes()))
                crcs = np.array(crc, np.int64)
                spread = (crcs ^ (np.array(row, np.int64) * 40503) ^ np.array(piece, np.int64)) & 0x7FFFFFFF
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs), pa.array(spread.astype(np.int32))], names=["id", "piece", "start", "length", "ids_crc32", "spread"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(cut_up, f"id {id_type}, piece int, start long, length long, ids_crc32 long, spread int")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = durable(piece_table(docs, vocabulary, end_id, capacity, id_col, text_col))
    by_length = pieces.groupBy("length").count().toPandas()  # capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    counts[by_length["length"].to_numpy(np.int64)] = by_length["count"].to_numpy(np.int64)
    patterns = plan(counts, capacity)
    n_salts = np.maximum(np.maximum(-(-counts // RANKED), np.minimum(counts // FEW, LEAST_SALTS)), 1)
    salts_of = F.array(*(F.lit(int(n)) for n in n_salts))
    salted = pieces.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("id", "piece", "spread"), F.get(salts_of, F.col("length").cast("int"))).cast("int"))
    sizes = salted.groupBy("length", "salt").count().toPandas()  # LEAST_SALTS for each length at most, and one for each RANKED pieces
    # of each length: the first rank of each salt (salts of one length after the other), and the runs of ranks that a pattern takes
    base_of = np.cumsum(n_salts) - n_salts
    first = np.zeros(int(n_salts.sum()), np.int64)
    at_ = base_of[sizes["length"].to_numpy(np.int64)] + sizes["salt"].to_numpy(np.int64)
    first[at_] = sizes["count"].to_numpy(np.int64)
    before = np.cumsum(first) - first
    first = before - np.repeat(before[base_of], n_salts)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks, base = np.zeros(capacity + 1, np.int64), 0
    for bin_, times in patterns:
        at = 0
        for length in dict.fromkeys(bin_):
            each = bin_.count(length)
            runs.setdefault(length, []).append((int(ranks[length]), base, each, at))
            ranks[length] += each * times
            at += each * length
        base += times
    tables = {k: np.array(v, np.int64).T for k, v in runs.items()}

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            length, salt, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "rank"))
            rank = rank + first[base_of[length] + salt]
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                begin, base_, each, at = tables[int(n)]
                j = np.searchsorted(begin, rank[own], side="right") - 1
                inner = rank[own] - begin[j]
                sequence[own] = base_[j] + inner // each[j]
                offset[own] = at[j] + inner % each[j] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    id_type = dict(docs.dtypes)[id_col]
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1)
    placed = ranked.mapInArrow(place, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    alone = pieces.where(F.col("length") == capacity).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)
