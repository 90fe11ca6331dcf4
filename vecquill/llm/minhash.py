"""Near-duplicate groups by MinHash: banding, signature verification, confirmation on full shingle sets, components.

1. Texts are lower-cased (A to Z), cut into words and shingles; texts with equal word sequences form a class, whose
   least id stands for it, so copies are never paired with each other.
2. Of each class the minima of ``BANDS * ROWS`` universal hash functions are taken and banded. Classes that share no
   bucket with another class are done.
3. First links: each class is paired with the least class of its buckets and of a salted part of them, at most two
   pairs a class, those that agree in most bands; pairs whose signatures agree are confirmed on full sets. The links
   give first components, which take in nearly all of even the largest groups.
4. All the rest, exactly: in a bucket with several components, the members outside of the bucket's largest one are
   queries against the bucket's members of other components. They meet in blocks of ``BLOCK`` queries and members, first
   by their signatures alone: a pair counts in the first band that it shares and only if its signatures agree. Queries
   and members without such a pair are done; the sets of the others meet in the same blocks and are compared by an
   inverted index of the queries' shingles; one link for each query and component is enough. So every pair that shares a
   bucket is either confirmed, refuted or already connected, without any bucket's pairs being listed.
5. Components of all links by large-star and small-star.

A pair of Jaccard similarity s shares a bucket with probability 1 - (1 - s**ROWS)**BANDS: at 0.8, all but 7 in a million.

Defined results: null or empty texts, or texts without words, have an empty set, are linked with nothing and are kept;
rows that share an id count as one document; a null id sorts after all others, its row belongs to its class's group and
is kept only if the group has no id at all; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquill.llm.components import connected_components
from vecquill.llm.shared import batches_of, bounded_batches, durable, expand, width
from vecquill.llm.textbytes import lowered, mix, slices, span_hashes, text_buffer, window_hashes, word_spans

BANDS, ROWS = 30, 5
_SEEDS = np.random.default_rng(90210)
_FACTOR = _SEEDS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_OFFSET = _SEEDS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
#: Queries, and members, of a block of step 4.
BLOCK = 300
#: How far below the threshold the signatures of a pair may agree: five standard deviations of 150 minima at 0.8.
SLACK = 0.2
#: Parts of a bucket that have a least class of their own in step 3.
PARTS = 16


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of all hash functions over a set of 64-bit shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        np.minimum(out, (x[lo : lo + 2048, None] * _FACTOR + _OFFSET).min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of signatures."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.zeros(parts.shape[:2], np.uint64)
    for j in range(ROWS):
        h = mix(h * np.uint64(6364136223846793005) + parts[:, :, j] + np.uint64(1))
    return h ^ (np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """For each text of a slice: a digest of its word sequence and its sorted set of shingle hashes."""
    d = lowered(data)
    starts, ends, first = word_spans(d, offs)
    h = span_hashes(d, starts, ends)
    w = window_hashes(h, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        own = h[a:b]
        shingles = np.unique(w[a : b - k + 1]) if b - a >= k else window_hashes(own, b - a) if b > a else own
        yield hashlib.blake2b(own.tobytes(), digest_size=16).digest(), shingles


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact comparison of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _block_links(queries: list[tuple[int, int, np.ndarray]], percent: int):
    """A function from a member (node, component, set) to the queries that it links with."""
    nodes = np.array([q[0] for q in queries], np.int64)
    comps = np.array([q[1] for q in queries], np.int64)
    sizes = np.array([len(q[2]) for q in queries], np.int64)
    flat = np.concatenate([q[2] for q in queries])
    owner = np.repeat(np.arange(len(queries)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    told: set[tuple[int, int]] = set()

    def links(node: int, comp: int, own: np.ndarray) -> list[tuple[int, int]]:
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        both = np.bincount(owner[expand(lo, hi - lo)], minlength=len(nodes))
        hit = (100 * both >= percent * (sizes + len(own) - both)) & (comps != comp) & (nodes != node)
        found = [(int(nodes[i]), node) for i in np.flatnonzero(hit) if (int(nodes[i]), comp) not in told]
        told.update((q, comp) for q, _ in found)
        return found

    return links


def agreeing(signatures: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """For each pair of rows of two tables of signatures: do as many minima agree as the threshold, less the slack, asks?"""
    return (signatures == others).mean(axis=-1) >= percent / 100 - SLACK


def signature_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else column), np.uint32).reshape(-1, BANDS * ROWS)


def met_first(queries: np.ndarray, q_comp: np.ndarray, members: np.ndarray, m_comp: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which queries and which members of a bucket of a band have a pair of unlike components that agrees and shares no earlier band."""
    q_on, m_on = np.zeros(len(queries), bool), np.zeros(len(members), bool)
    q_keys, m_keys = band_keys(queries)[:, :band], band_keys(members)[:, :band]
    for i in range(len(queries)):
        at = np.flatnonzero(m_comp != q_comp[i])
        at = at[~(m_keys[at] == q_keys[i]).any(axis=1)]
        at = at[agreeing(members[at], queries[i], percent)]
        q_on[i] = len(at) > 0
        m_on[at] = True
    return q_on, m_on


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept of each row. Links: Jaccard similarity of the sets of k-word shingles of percent / 100 or more."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            data, offs = text_buffer(b.column(1))
            keys, sizes, signs = [], [], []
            for _, _, d, o in slices(data, offs):
                for key, s in shingle_sets(d, o, k):
                    keys.append(key)
                    sizes.append(len(s))
                    signs.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())], names=["id", "key", "n", "signature"])

    signed = durable(base.mapInArrow(sign, "id long, key binary, n long, signature binary"))
    classes = durable(signed.groupBy("key").agg(F.min("id").alias("node"), F.min("n").alias("n"), F.min("signature").alias("signature")))

    # step 2: buckets of two classes or more
    def bands(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
            keys = band_keys(sig)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), BANDS)), pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys)))], names=["node", "bucket", "band"])

    banded = classes.where("n > 0 and node is not null").select("node", "signature").mapInArrow(bands, "node long, bucket long, band int")
    # tables of their own, so that AQE can split the rows of a bucket that very many classes share
    heads = durable(banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("head")).where("size > 1").select("bucket", "head"))
    members = durable(banded.join(heads, "bucket"))

    # full sets of the classes that share a bucket
    wanted = durable(members.select("node").distinct())

    def take_sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            data, offs = text_buffer(b.column(1))
            blobs = [s.tobytes() for _, _, d, o in slices(data, offs) for _, s in shingle_sets(d, o, k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    sets = durable(base.join(wanted, base["id"] == wanted["node"], "left_semi").mapInArrow(take_sets, "node long, shingles binary"))
    signatures = durable(classes.select("node", "signature").join(wanted, "node", "left_semi"))

    # step 3: two pairs a class at most
    def best(pairs: DataFrame) -> DataFrame:
        agreeing = pairs.where("node > other").groupBy("node", "other").agg(F.count("*").alias("bands"))
        return agreeing.groupBy("node").agg(F.max_by("other", F.struct("bands", -F.col("other"))).alias("other"))

    part = F.pmod(F.xxhash64("node"), F.lit(PARTS))
    split = members.withColumn("part", part)
    part_heads = split.groupBy("bucket", "part").agg(F.min("node").alias("other"))
    pairs = best(members.select("node", F.col("head").alias("other"))).unionByName(best(split.join(part_heads, ["bucket", "part"]).select("node", "other"))).distinct()

    def agree(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            yield b.select(["node", "other"]).filter(pa.array(agreeing(signature_rows(b.column("gx")), signature_rows(b.column("gy")), percent)))

    def confirm(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            sets_of = zip(b.column("sx").to_pylist(), b.column("sy").to_pylist())
            linked = [jaccard_at_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sets_of]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("other")], names=["u", "v"]).filter(pa.array(linked, pa.bool_()))

    signed_pairs = pairs.join(signatures.withColumnRenamed("signature", "gx"), "node").join(signatures.select(F.col("node").alias("other"), F.col("signature").alias("gy")), "other")
    near = signed_pairs.mapInArrow(agree, "node long, other long")
    both = near.join(sets.withColumnRenamed("shingles", "sx"), "node").join(sets.select(F.col("node").alias("other"), F.col("shingles").alias("sy")), "other")
    first_links = durable(both.mapInArrow(confirm, "u long, v long"))
    first = connected_components(first_links)

    # step 4: what other components a bucket holds, against its largest one
    placed = durable(members.join(first, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("component")))
    held = placed.groupBy("bucket", "component").agg(F.count("*").alias("mass"))
    shape = (
        held.groupBy("bucket")
        .agg(F.count("*").alias("kinds"), F.sum("mass").alias("all"), F.max(F.struct("mass", "component")).alias("host"))
        .where("kinds > 1")
        .select("bucket", F.col("host.component").alias("host"), F.ceil((F.col("all") - F.col("host.mass")) / BLOCK).cast("int").alias("query_blocks"), F.ceil(F.col("all") / BLOCK).cast("int").alias("member_blocks"))
    )
    mixed = placed.join(durable(shape), "bucket")  # a table of its own as above
    spot, every = F.xxhash64("node"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(spot, F.col(n)).cast("int")
    q = mixed.where("component <> host").select("bucket", "band", "node", "component", one("query_blocks").alias("qb"), every("member_blocks").alias("mb"), F.lit(0).alias("kind"))
    m = mixed.select("bucket", "band", "node", "component", every("query_blocks").alias("qb"), one("member_blocks").alias("mb"), F.lit(1).alias("kind"))
    places = q.unionByName(m)
    parts = width(docs)
    block = ["bucket", "qb", "mb"]

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "qb", "mb", "band", "kind", "node", "component"]
        rows: list[tuple] = []

        def kept(rows: list[tuple]) -> list[tuple]:
            sides = [[r for r in rows if r[4] == kind] for kind in (0, 1)]
            if not all(sides):
                return []
            table = [signature_rows([r[7] for r in side]) for side in sides]
            comp = [np.array([r[6] for r in side], np.int64) for side in sides]
            on = met_first(table[0], comp[0], table[1], comp[1], rows[0][3], percent)
            return [r[:7] for side, yes in zip(sides, on) for r, y in zip(side, yes.tolist()) if y]

        def told(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

        for b in it:
            out: list[tuple] = []
            for row in zip(*(b.column(c).to_pylist() for c in (*names, "signature"))):
                if rows and rows[0][:3] != row[:3]:
                    out += kept(rows)
                    rows = []
                rows.append(row)
            if out:
                yield told(out)
        if rows and (out := kept(rows)):
            yield told(out)

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, links = None, [], None
        for b in it:
            out = []
            for bucket, qb, mb, kind, node, comp, blob in zip(*(b.column(c).to_pylist() for c in (*block, "kind", "node", "component", "shingles"))):
                if (bucket, qb, mb) != at:
                    at, waiting, links = (bucket, qb, mb), [], None
                own = np.frombuffer(blob, np.uint64)
                if kind == 0:
                    waiting.append((node, comp, own))
                elif waiting or links:
                    if links is None:
                        links, waiting = _block_links(waiting, percent), []
                    out += links(node, comp, own)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])

    meeting = (
        places.join(signatures, "node")
        .repartition(parts, *block)
        .sortWithinPartitions(*block, "kind")
        .mapInArrow(meet, "bucket long, qb int, mb int, band int, kind int, node long, component long")
    )
    more_links = (
        durable(meeting)
        .join(sets, "node")
        .repartition(parts, *block)
        .sortWithinPartitions(*block, "kind")
        .mapInArrow(compare, "u long, v long")
    )
    final = connected_components(first_links.unionByName(durable(more_links)))
    named = classes.select("key", F.col("node")).join(final, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    rows = signed.select("id", "key", "n").join(named, "key")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
