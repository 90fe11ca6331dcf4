"""Indexes of binary vectors under the Hamming distance. Codes are bytes, the low bit first.

BFlat scans all codes; BIVF n scans the lists nearest to a query, whose centres are majorities of bits; BHNSW m walks a
graph by shard; BHash b keeps the codes by their first b bits and reads those within ``flips`` bits of the query's;
BHash n x b keeps them by n groups of b bits. Scans compare bits by matrix products (``scan``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecquill.operators import codecs, scan
from vecquill.operators.graph import Graph

_KIND = re.compile(r"B(Flat|IVF(\d+)|HNSW(\d*)|Hash(?:(\d+)x)?(\d+))")
SHARD_ROWS = 50_000


def bits_of(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(codes, axis=1, bitorder="little")


def real_to_binary(v: Column) -> Column:
    """Bytes of the signs of an array of numbers: a bit is set for a component of zero or more."""
    pack = lambda rows: [r.tobytes() for r in np.packbits(np.array(rows, float) >= 0, axis=1, bitorder="little")]
    return codecs._mapped(pack, "binary")(v)


def binary_to_real(codes: np.ndarray) -> np.ndarray:
    """-1 and 1 for the bits 0 and 1."""
    return bits_of(codes) * 2.0 - 1.0


@dataclass(frozen=True)
class BinaryIndex:
    kind: str
    n_bits: int
    size: int = 0  # lists, links or bits of a hash
    maps: int = 1
    centres: np.ndarray | None = None  # bits of the lists' centres
    rows: DataFrame | None = None  # id, code

    @classmethod
    def open(cls, description: str, n_bits: int) -> "BinaryIndex":
        m = _KIND.fullmatch(description)
        if not m or n_bits % 8:
            raise ValueError(f"unknown binary index {description!r} of {n_bits} bits")
        if m[2]:
            return cls("ivf", n_bits, int(m[2]))
        if m[5]:
            maps, b = int(m[4] or 1), int(m[5])
            if not b or not maps or maps * b > n_bits or b > 62:
                raise ValueError(f"{description}: {n_bits} bits do not hold the hashes")
            return cls("hash", n_bits, b, maps)
        return cls("graph", n_bits, int(m[3] or 32)) if m[1].startswith("HNSW") else cls("flat", n_bits)

    def train(self, rows: DataFrame, sample: int = 50_000) -> "BinaryIndex":
        """Centres from the rows (id, code) of least hash."""
        picked = rows.orderBy(F.xxhash64("id", F.lit(1234)), "id").select("code").limit(sample).collect()
        x = bits_of(np.frombuffer(b"".join(r.code for r in picked), np.uint8).reshape(len(picked), -1)).astype(float)
        return replace(self, centres=(codecs.kmeans(x, self.size, 10) >= 0.5).astype(np.uint8))

    def add(self, rows: DataFrame) -> "BinaryIndex":
        if self.kind == "ivf" and self.centres is None:
            raise ValueError("the index is not trained")
        wrong = F.raise_error(F.concat(F.lit(f"a code of another size than {self.n_bits} bits: id "), F.col("id").cast("string")))
        new = rows.where("code is not null").select(F.col("id").cast("long").alias("id"), F.when(F.octet_length("code") * 8 == self.n_bits, F.col("code")).otherwise(wrong).alias("code"))
        return replace(self, rows=new if self.rows is None else self.rows.unionByName(new))

    def _asked(self, q: np.ndarray, nprobe: int, flips: int):
        """A function from the bits of rows to (rows, queries): which rows a query reads. None for all."""
        if self.kind == "ivf":
            centres = self.centres
            near = np.argsort(scan.hamming(centres, q), axis=0, kind="stable")[:nprobe]

            def lists(bits: np.ndarray) -> np.ndarray:
                own = scan.hamming(bits, centres).argmin(1)
                wanted = np.zeros((len(centres), len(q)), bool)
                wanted[near, np.arange(len(q))] = True
                return wanted[own]

            return lists
        if self.kind == "hash":
            size, n_maps = self.size, self.maps
            masks = np.array([sum(1 << b for b in c) for r in range(flips + 1) for c in combinations(range(size), r)], np.int64)

            def hashed(x: np.ndarray, m: int) -> np.ndarray:
                return x[:, m * size : (m + 1) * size].astype(np.int64) @ (1 << np.arange(size, dtype=np.int64))

            def maps(bits: np.ndarray) -> np.ndarray:
                out = np.zeros((len(bits), len(q)), bool)
                for m in range(n_maps):
                    near = np.isin(hashed(bits, m)[:, None] ^ hashed(q, m)[None, :], masks)
                    out |= near
                return out

            return maps
        return None

    def _pairs(self, queries: DataFrame, nprobe: int, flips: int, of_block) -> DataFrame:
        if self.rows is None:
            raise ValueError("the index is empty")
        asked = queries.select(F.col("id").cast("long").alias("id"), "code").where("code is not null").orderBy("id").collect()  # a stated set
        out = None
        for lo in range(0, len(asked), scan.QUERY_BLOCK):
            part = asked[lo : lo + scan.QUERY_BLOCK]
            ids, q = np.array([r.id for r in part], np.int64), bits_of(np.frombuffer(b"".join(r.code for r in part), np.uint8).reshape(len(part), -1))
            reads = self._asked(q, nprobe, flips)

            def distances(b: pa.RecordBatch, q=q, reads=reads) -> np.ndarray:
                if not b.num_rows:
                    return np.zeros((0, len(q)))
                bits = bits_of(scan.codes_of(b.column("code")))
                found = scan.hamming(bits, q)
                return found if reads is None else np.where(reads(bits), found, np.nan)

            found = of_block(ids, q, distances)
            out = found if out is None else out.unionByName(found)
        return out if out is not None else self.rows.sparkSession.createDataFrame([], scan.PAIRS)

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 1, flips: int = 0, width: int = 64) -> DataFrame:
        """(query_id, rank, id, distance) for queries (id, code)."""
        if self.kind == "graph":
            return scan.ranked(self._pairs(queries, nprobe, flips, lambda ids, q, _: self._walked(ids, q, k, width)), k, False)
        return scan.ranked(self._pairs(queries, nprobe, flips, lambda ids, q, d: scan.nearest(self.rows, d, ids, k, False)), k, False)

    def range_search(self, queries: DataFrame, radius: float, nprobe: int = 1, flips: int = 0) -> DataFrame:
        """(query_id, id, distance) strictly within the radius."""
        return self._pairs(queries, nprobe, flips, lambda ids, q, d: scan.within(self.rows, d, ids, radius, False))

    def _walked(self, query_ids: np.ndarray, q: np.ndarray, k: int, width: int) -> DataFrame:
        links = self.size
        shards = max(1, -(-self.rows.count() // SHARD_ROWS))

        def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, int, bytes]] = []

            def found() -> pa.RecordBatch:
                own = sorted(held, key=lambda r: r[1])
                x = bits_of(np.frombuffer(b"".join(r[2] for r in own), np.uint8).reshape(len(own), -1)).astype(float)
                graph = Graph.build(np.array([r[1] for r in own], np.int64), x, links)
                got = [graph.search(v.astype(float), k, width) for v in q]
                return pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, [len(d) for d, _ in got])), pa.array(np.concatenate([i for _, i in got])), pa.array(np.round(np.concatenate([d for d, _ in got])) + 0.0)], names=["query_id", "id", "distance"])

            for b in it:
                for row in zip(*(b.column(c).to_pylist() for c in ("shard", "id", "code"))):
                    if held and held[0][0] != row[0]:
                        yield found()
                        held = []
                    held.append(row)
            if held:
                yield found()

        rows = self.rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        return rows.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(walk, scan.PAIRS)
