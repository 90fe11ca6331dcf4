"""Removal of passages that recur across documents, by repeated-phrase automata.

A word goes if a window of ``window`` consecutive words around it also starts in a document with a smaller id.

1. Anchors. Of every window, the least hash of its ``ANCHOR`` -word runs is its anchor, so equal windows have equal
   anchors and a document has about one anchor in five words. Anchors are counted by hash buckets, aggregated within
   each task first; an anchor of one document only rules its windows out. The few anchors of a bucket that hold an
   eighth of its occurrences or more - stock phrases, eight a bucket at most - are told to all tasks, the others are
   looked up in their bucket.
2. Segments. Runs of windows with recurring anchors are cut out of the documents as word hashes and sent to the shard
   of the first document that has the anchor, so all occurrences of a window meet in one shard. A window whose anchor
   is a stock phrase goes to a shard by the least hash of its ``LONGER`` -word runs instead, so that a phrase's many unlike
   surroundings are spread, while neighbours in a popular passage mostly stay together.
3. Phrases. Each task reduces its segments to one copy of each window, with its least document and whether there are
   others; where a shard's copies meet, the windows of one document only are dropped. What is left is confirmed. The
   copies of a shard of more than ``WHOLE_SALTS`` salts meet in parts, by the same longer runs of the windows.
4. Automata. Large shards are split by document; each part gets the shard's confirmed phrases and no others, and holds
   ``COPIED`` times their words or more. It compiles an
   Aho-Corasick automaton (one symbol a word) over runs of ``SEED`` words of them, so placed that every confirmed window
   holds one, and streams its segments through it. The windows around a hit are compared, by 64-bit hash, with the
   confirmed ones and count if a window's least document is smaller than the segment's.
5. The covered words go back to their documents.

Defined results: a null or empty text has no words and stays as it is; a null id sorts after all others, so that it
removes nothing from other rows; rows that share an id remove nothing from each other; texts shorter than a window are
left alone; an empty table gives an empty result; all other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquill.llm.shared import batches_of, bounded_batches, durable, expand, first_of_groups, mark, pack, packed_schema, release, unpack, width
from vecquill.llm.textbytes import inner_windows, mix, slices, span_hashes, text_buffer, window_hashes, word_spans

ANCHOR, LONGER, SEED, HELD, HOT_LEAST, SHARDS_PER_PART, SALT_WORDS = 5, 9, 6, 1 << 21, 20_000, 32, 1 << 15
#: Salts of a shard whose phrases still meet in one task.
WHOLE_SALTS = 3
#: Words of a part for each word of the phrases that it gets.
COPIED = 4
#: Shards with parts are told to all tasks up to so many; beyond, they are joined.
BROADCAST_ROWS = 1_000_000
NO_ID = (1 << 63) - 1


def _symbols(words: np.ndarray) -> np.ndarray:
    """A code point for each word, from its hash: the planes above the surrogates, about a million symbols."""
    return ((words >> np.uint64(44)).astype(np.uint32) % np.uint32(0x100000) + np.uint32(0xE000)).astype("<u4")


def window_anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within a document, the position of each one's anchor, and the hashes of all anchor runs."""
    a = window_hashes(h, ANCHOR)
    starts = np.flatnonzero(inner_windows(first, window, len(h)))
    n = len(h) - window + 1
    if n <= 0 or not len(starts):
        return starts, starts, a
    best, at = a[:n].copy(), np.arange(n)
    for j in range(1, window - ANCHOR + 1):
        less = a[j : j + n] < best
        best[less] = a[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    return starts, at[starts], a


def _bounds(hashes: np.ndarray, ids_lo: np.ndarray, ids_hi: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct hash with its least and greatest id and its count."""
    order = np.argsort(hashes, kind="stable")
    s = first_of_groups(hashes[order])
    if not len(s):
        return hashes, ids_lo, ids_hi, counts
    return hashes[order][s], np.minimum.reduceat(ids_lo[order], s), np.maximum.reduceat(ids_hi[order], s), np.add.reduceat(counts[order], s)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in a sorted table, -1 where there is none."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[i] == keys, i, -1)


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Columns __row (a struct of all columns but the text), __text (with_text: what is kept), n_words, n_removed, kept_sha256."""
    spark = docs.sparkSession
    bounded_batches(spark)
    nb = width(docs)
    shards = nb * SHARDS_PER_PART
    others = [c for c in docs.columns if c != text_col]
    id_ = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(id_.alias("id"), F.xxhash64(id_, text).alias("k"), text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("__row"))
    words_of = keyed.select("id", "k", F.coalesce("text", F.lit("")).alias("text"))

    def sliced(it: Iterator[pa.RecordBatch]):
        for b in batches_of(it):
            data, offs = text_buffer(b.column("text"))
            ids, ks = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "k"))
            for lo, hi, d, o in slices(data, offs):
                starts, ends, first = word_spans(d, o)
                yield ids[lo:hi], ks[lo:hi], span_hashes(d, starts, ends), first

    # 1: anchors of more than one document
    def count_anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_d, size = [], [], 0

        def told() -> Iterator[pa.RecordBatch]:
            h, d = np.concatenate(held_h), np.concatenate(held_d)
            h, lo, hi, n = _bounds(h, d, d, np.ones(len(h), np.int64))
            one = lo == hi
            bucket = (h % np.uint64(nb)).astype(np.int64)
            a = _packed(bucket[one], h[one], lo[one], None, None, 0)
            c = _packed(bucket[~one], h[~one], lo[~one], hi[~one], n[~one], 1)
            yield from (x for x in (a, c) if x is not None)

        for ids, _, h, first in sliced(it):
            _, at, a = window_anchors(h, first, window)
            at = np.unique(at)
            held_h.append(a[at])
            held_d.append(ids[np.searchsorted(first, at, side="right") - 1])
            size += len(at)
            if size >= HELD:
                yield from told()
                held_h, held_d, size = [], [], 0
        if size:
            yield from told()

    def recurring(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, lo, hi, n = [], [], [], []
        for b in it:
            for kind, c0, c1, c2, c3 in zip(*(b.column(c).to_pylist() for c in ("kind", "c0", "c1", "c2", "c3"))):
                h.append(np.frombuffer(c0, np.uint64))
                lo.append(np.frombuffer(c1, np.int64))
                hi.append(np.frombuffer(c2, np.int64) if kind else lo[-1])
                n.append(np.frombuffer(c3, np.int64) if kind else np.ones(len(lo[-1]), np.int64))
        if not h:
            return
        h, lo, hi, n = _bounds(*(np.concatenate(x) for x in (h, lo, hi, n)))
        many = lo < hi
        bucket = (h % np.uint64(nb)).astype(np.int64)
        most = max(HOT_LEAST, int(n.sum()) // 8)
        for kind, own in ((0, many & (n < most)), (1, many & (n >= most))):
            part = pack(bucket[own], h[own], lo[own], kind=kind)
            if part is not None:
                yield part

    since = mark()
    anchors = durable(words_of.mapInArrow(count_anchors, packed_schema(4)).repartition(nb, "bucket").mapInArrow(recurring, packed_schema(2)))
    hot = np.sort(unpack(anchors.where("kind = 1").select("c0").toArrow()["c0"], np.uint64))  # 8 a partition at most

    # 2: which anchors of each document recur, and where first
    def look_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ks, h, first in sliced(it):
            _, at, a = window_anchors(h, first, window)
            at = np.unique(at)
            own, k = a[at], ks[np.searchsorted(first, at, side="right") - 1]
            cold = _find(hot, own) < 0
            part = pack((own[cold] % np.uint64(nb)).astype(np.int64), own[cold], k[cold], kind=1)
            if part is not None:
                yield part

    def flag(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_h, known_d, table = [], [], None
        for b in it:
            out_k, out_h, out_d = [], [], []
            for kind, c0, c1 in zip(*(b.column(c).to_pylist() for c in ("kind", "c0", "c1"))):
                if kind == 0:
                    known_h.append(np.frombuffer(c0, np.uint64))
                    known_d.append(np.frombuffer(c1, np.int64))
                    continue
                if table is None:
                    hs, ds = (np.concatenate(known_h), np.concatenate(known_d)) if known_h else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    order = np.argsort(hs)
                    table, first_doc = hs[order], ds[order]
                h, k = np.frombuffer(c0, np.uint64), np.frombuffer(c1, np.int64)
                j = _find(table, h)
                out_k.append(k[j >= 0])
                out_h.append(h[j >= 0])
                out_d.append(first_doc[j[j >= 0]])
            if out_k:
                k, h, d = np.concatenate(out_k), np.concatenate(out_h), np.concatenate(out_d)
                part = pack((k.view(np.uint64) % np.uint64(nb)).astype(np.int64), k, h, d, kind=0)
                if part is not None:
                    yield part

    flags = words_of.mapInArrow(look_up, packed_schema(2)).unionByName(anchors.where("kind = 0")).repartition(nb, "bucket").sortWithinPartitions("kind").mapInArrow(flag, packed_schema(3))

    # the remainder of k as an unsigned number, as Python takes it
    bucket_of_k = F.expr(f"cast((pmod(shiftrightunsigned(k, 1), {nb}) * 2 + (k & 1)) % {nb} as int)")
    no = lambda c, t: F.lit(None).cast(t).alias(c)

    def with_docs(packed: DataFrame, n: int, rows: DataFrame, extra: list[tuple[str, T.DataType]]) -> DataFrame:
        cols = [f"c{i}" for i in range(n)]
        a = packed.select("bucket", "kind", *cols, no("k", "long"), no("id", "long"), no("text", "string"), *(no(c, t) for c, t in extra))
        b = rows.select(bucket_of_k.alias("bucket"), F.lit(1).alias("kind"), *(no(c, "binary") for c in cols), "k", "id", "text", *(c for c, _ in extra))
        return a.unionByName(b).repartition(nb, "bucket").sortWithinPartitions("kind")

    def cut_segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], []]
        table = None
        for b in batches_of(it):
            kinds = b.column("kind").to_numpy()
            facts = int(np.searchsorted(kinds, 1))
            if facts:
                for i, t in enumerate((np.int64, np.uint64, np.int64)):
                    got[i].append(unpack(b.column(f"c{i}").slice(0, facts), t))
            if facts == len(kinds):
                continue
            if table is None:
                k, h, d = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(got, (np.int64, np.uint64, np.int64)))
                key = mix(k.view(np.uint64) ^ mix(h))
                order = np.argsort(key)
                table, first_doc = key[order], d[order]
            rest = b.slice(facts)
            shard_, id_, k_, start_, words_ = [], [], [], [], []
            for ids, ks, h, first in sliced([rest]):
                starts, at, a = window_anchors(h, first, window)
                if not len(starts):
                    continue
                spots, which = np.unique(at, return_inverse=True)
                doc = np.searchsorted(first, spots, side="right") - 1
                j = _find(table, mix(ks[doc].view(np.uint64) ^ mix(a[spots])))
                shard = np.where(j >= 0, (mix(first_doc[j].view(np.uint64)) % np.uint64(shards)).astype(np.int64) if len(first_doc) else -1, -1)[which]
                doc = doc[which]
                stock = np.flatnonzero((_find(hot, a[spots]) >= 0)[which])
                if len(stock):
                    shard[stock] = (mix(longer_anchors(h, starts[stock], window)) % np.uint64(shards)).astype(np.int64)
                new = np.ones(len(starts), bool)
                new[1:] = (shard[1:] != shard[:-1]) | (doc[1:] != doc[:-1]) | (starts[1:] != starts[:-1] + 1)
                begin = np.flatnonzero(new)
                end = np.concatenate([begin[1:], [len(starts)]])
                live = shard[begin] >= 0
                begin, end = begin[live], end[live]
                shard_ += shard[begin].tolist()
                id_ += ids[doc[begin]].tolist()
                k_ += ks[doc[begin]].tolist()
                start_ += (starts[begin] - first[doc[begin]]).tolist()
                words_ += [h[x : y + window].tobytes() for x, y in zip(starts[begin].tolist(), starts[end - 1].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard_, pa.int32()), pa.array(id_, pa.int64()), pa.array(k_, pa.int64()), pa.array(start_, pa.int32()), pa.array([len(x) // 8 for x in words_], pa.int32()), pa.array(words_, pa.binary())], names=["shard", "id", "k", "start", "n", "words"])

    segments = durable(with_docs(flags, 3, words_of, []).mapInArrow(cut_segments, "shard int, id long, k long, start int, n int, words binary"))
    release(spark, since, since + 1)  # the anchors

    def parted(of: DataFrame) -> DataFrame:
        """(shard, salts) of the shards with several salts, broadcast if they are few."""
        several = of.where("salts > 1").select("shard", "salts")
        return F.broadcast(several) if several.count() <= BROADCAST_ROWS else several

    sizes = segments.groupBy("shard").agg(F.sum("n").alias("words"))
    salts = parted(sizes.withColumn("salts", F.ceil(F.col("words") / SALT_WORDS).cast("int")))
    n_salts = F.coalesce("salts", F.lit(1))

    # 3: one copy of each window of a task, then of a shard
    def distinct_windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows held are reduced in place; what does not shrink to half is passed on, so that memory stays bounded."""
        held, size, parts_of = [], 0, {}

        def told() -> pa.RecordBatch:
            return phrase_batch([p for r in held for p in parted_row(r, parts_of.get(r[0], 1), window)])

        for b in it:
            for *row, salts_ in zip(*(b.column(c).to_pylist() for c in ("shard", "id", "several", "words", "salts"))):
                if salts_ > WHOLE_SALTS:
                    parts_of[row[0]] = salts_ * LONGER
                held.append(tuple(row))
                size += len(row[3]) // 8
            if size >= HELD // 2:
                held = one_of_each(held, window)
                size = sum(len(r[3]) // 8 for r in held)
                if size >= HELD // 4:
                    yield told()
                    held, size = [], 0
        if held:
            held = one_of_each(held, window)
            yield told()

    def confirmed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of each shard's part that have several documents; rows come sorted by shard and part."""
        held, at, done, size, most = [], None, [], 0, HELD // 2
        for b in it:
            for shard, part, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "part", "id", "several", "words"))):
                if (shard, part) != at:
                    done += [(r[0], 0, *r[1:]) for r in one_of_each(held, window) if r[2]]
                    held, at, size, most = [], (shard, part), 0, HELD // 2
                held.append((shard, *row))
                size += len(row[2]) // 8
                if size >= most:
                    held = one_of_each(held, window)
                    size = sum(len(r[3]) // 8 for r in held)
                    most = max(HELD // 2, 2 * size)
            if len(done) >= 512:
                yield phrase_batch(done)
                done = []
        done += [(r[0], 0, *r[1:]) for r in one_of_each(held, window) if r[2]]
        if done:
            yield phrase_batch(done)

    phrase_type = "shard int, part int, id long, several int, n int, words binary"
    of_tasks = segments.join(salts, "shard", "left").select("shard", "id", F.lit(0).alias("several"), "words", n_salts.alias("salts")).mapInArrow(distinct_windows, phrase_type)
    phrases = durable(of_tasks.repartition(nb, "shard", "part").sortWithinPartitions("shard", "part").mapInArrow(confirmed, phrase_type))

    # 4: compile and stream; the segments of a shard's part that a batch holds go through the automaton together
    def locate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, auto = None, [], None
        for b in it:
            out: list[tuple[np.ndarray, ...]] = []
            waiting: list[tuple[int, int, int, bytes]] = []

            def stream() -> None:
                ids, ks, starts = (np.array([r[c] for r in waiting], np.int64) for c in range(3))
                seg, s, n = auto.covered(ids, [r[3] for r in waiting])
                out.append((ks[seg], ids[seg], starts[seg] + s, n))
                waiting.clear()

            for shard, salt, kind, id_, k, start, words in zip(*(b.column(c).to_pylist() for c in ("shard", "salt", "kind", "id", "k", "start", "words"))):
                if (shard, salt) != group:
                    if waiting:
                        stream()
                    group, rows, auto = (shard, salt), [], None
                if kind == 0:
                    rows.append((id_, words))
                    continue
                if auto is None:
                    auto, rows = Automaton(rows, window), []
                waiting.append((id_, k, start, words))
            if waiting:
                stream()
            if out:
                k, i, s, n = (np.concatenate(x) for x in zip(*out))
                part = pack((k.view(np.uint64) % np.uint64(nb)).astype(np.int64), k, i, s.astype(np.int32), n.astype(np.int32))
                if part is not None:
                    yield part

    # a part holds COPIED words for each word of the phrases that it gets, so these copies stay a small share of all
    copied = phrases.groupBy("shard").agg(F.sum("n").alias("own"))
    salts = parted(sizes.join(copied, "shard", "left").withColumn("salts", F.ceil(F.col("words") / F.greatest(F.lit(SALT_WORDS), F.coalesce("own", F.lit(0)) * COPIED)).cast("int")))
    to_compile = phrases.join(salts, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), n_salts - 1)).alias("salt"), F.lit(0).alias("kind"), "id", no("k", "long"), no("start", "int"), "words")
    to_stream = segments.join(salts, "shard", "left").select("shard", F.pmod(F.xxhash64("k"), n_salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "k", "start", "words")
    found = to_compile.unionByName(to_stream).repartition(nb, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(locate, packed_schema(4))

    # 5: back to the documents
    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], [], []]
        types = (np.int64, np.int64, np.int32, np.int32)
        table = None
        for b in batches_of(it):
            facts = int(np.searchsorted(b.column("kind").to_numpy(), 1))
            if facts:
                for i, t in enumerate(types):
                    got[i].append(unpack(b.column(f"c{i}").slice(0, facts), t))
            if facts == b.num_rows:
                continue
            if table is None:
                k, i_, s_, n_ = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(got, types))
                order = np.argsort(k, kind="stable")
                table, i_, s_, n_ = k[order], i_[order], s_[order], n_[order]
            rest = b.slice(facts)
            words_n, removed_n, digests, texts = [], [], [], []
            for id_, k, t in zip(*(rest.column(c).to_pylist() for c in ("id", "k", "text"))):
                raw = (t or "").encode()
                a, z = np.searchsorted(table, k, "left"), np.searchsorted(table, k, "right")
                words = raw.split()
                n = len(words)
                if z > a:
                    own = np.flatnonzero(i_[a:z] == id_) + a
                    gone = np.zeros(n + 1, np.int64)
                    np.add.at(gone, s_[own], 1)
                    np.add.at(gone, np.minimum(s_[own] + n_[own] + window - 1, n), -1)
                    gone = np.cumsum(gone[:n]) > 0
                else:
                    gone = None
                if gone is not None and gone.any():
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                    removed_n.append(n - len(kept))
                    texts.append(_without(raw, gone) if with_text else None)
                else:
                    kept = words
                    removed_n.append(0)
                    texts.append(t if with_text else None)
                words_n.append(n)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            arrays = [rest.column("__row"), *([pa.array(texts, pa.string())] if with_text else []), pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(arrays, names=["__row", *(["__text"] if with_text else []), "n_words", "n_removed", "kept_sha256"])

    row_type = keyed.schema["__row"].dataType
    out = T.StructType([T.StructField("__row", row_type), *([T.StructField("__text", T.StringType())] if with_text else []), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return with_docs(found, 4, keyed, [("__row", row_type)]).mapInArrow(finish, out)


def _packed(bucket: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray | None, d: np.ndarray | None, kind: int) -> pa.RecordBatch | None:
    """Four packed columns, the last two null where they are not given."""
    given = [x for x in (a, b, c, d) if x is not None]
    part = pack(bucket, *given, kind=kind)
    if part is None:
        return None
    missing = [pa.nulls(part.num_rows, pa.binary())] * (4 - len(given))
    return pa.RecordBatch.from_arrays([*part.columns, *missing], names=["bucket", "kind", "c0", "c1", "c2", "c3"])


def _without(raw: bytes, gone: np.ndarray) -> str:
    """The text without the words flagged and the white space behind each; other white space stays."""
    data = np.frombuffer(raw, np.uint8)
    starts, _, _ = word_spans(data, np.array([0, len(data)]))
    edge = np.zeros(len(data) + 1, np.int64)
    ends = np.concatenate([starts[1:], [len(data)]])
    np.add.at(edge, starts[gone], 1)
    np.add.at(edge, ends[gone], -1)
    return data[np.cumsum(edge[:-1]) == 0].tobytes().decode()


def longer_anchors(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """For the windows at some places, the least hash of their runs of ``LONGER`` words."""
    k = min(LONGER, window)
    return window_hashes(h, k)[at[:, None] + np.arange(window - k + 1)].min(axis=1)


def parted_row(row: tuple[int, int, int, bytes], parts: int, window: int) -> list[tuple[int, int, int, int, bytes]]:
    """(shard, part, id, several, words): the row as it is, or, if its shard has several parts, cut where its windows' parts change."""
    shard, id_, several, words = row
    if parts == 1:
        return [(shard, 0, id_, several, words)]
    h = np.frombuffer(words, np.uint64)
    n = len(h) - window + 1
    part = (mix(mix(longer_anchors(h, np.arange(n), window))) % np.uint64(parts)).astype(np.int64)  # not the hash that dealt the shards
    s = first_of_groups(part)
    return [(shard, p, id_, several, words[8 * a : 8 * (z - 1 + window)]) for p, a, z in zip(part[s].tolist(), s.tolist(), [*s[1:].tolist(), n])]


def one_of_each(rows: list[tuple[int, int, int, bytes]], window: int) -> list[tuple[int, int, int, bytes]]:
    """One copy of each window of (shard, id, several, words), with its least id and whether another id has it too."""
    if not rows:
        return []
    flat = np.frombuffer(b"".join(r[3] for r in rows), np.uint64)
    offs = np.concatenate([[0], np.cumsum([len(r[3]) // 8 for r in rows])]).astype(np.int64)
    ids, more = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    w = window_hashes(flat, window)
    at = np.flatnonzero(inner_windows(offs, window, len(flat)))
    if not len(at):
        return []
    row = np.searchsorted(offs, at, side="right") - 1
    order = np.lexsort((at, ids[row], w[at]))
    s = first_of_groups(w[at][order])
    last = np.concatenate([s[1:], [len(order)]]) - 1
    several = (ids[row[order[last]]] != ids[row[order[s]]]) | (np.maximum.reduceat(more[row[order]], s) > 0)
    keep = at[order[s]]  # the window's place in its least document
    by_place = np.argsort(keep)
    keep, several = keep[by_place], several[by_place]
    row = np.searchsorted(offs, keep, side="right") - 1
    new = np.ones(len(keep), bool)
    new[1:] = (keep[1:] != keep[:-1] + 1) | (row[1:] != row[:-1]) | (several[1:] != several[:-1])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(keep)]]) - 1
    runs = zip(keep[begin].tolist(), keep[end].tolist(), row[begin].tolist(), several[begin].tolist())
    return [(rows[r][0], rows[r][1], int(m), flat[x : y + window].tobytes()) for x, y, r, m in runs]


def phrase_batch(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    shard, part, ids, several, words = zip(*rows) if rows else ((), (), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(part, pa.int32()), pa.array(ids, pa.int64()), pa.array(several, pa.int32()), pa.array([len(x) // 8 for x in words], pa.int32()), pa.array(words, pa.binary())], names=["shard", "part", "id", "several", "n", "words"])


class Automaton:
    """An Aho-Corasick automaton over the confirmed phrases (least id, words) of a shard's part."""

    def __init__(self, rows: list[tuple[int, bytes]], window: int):
        self.window, self.seed = window, min(SEED, window)
        self.step = window - self.seed + 1  # every window holds a run of ``seed`` words that starts at its last place modulo this
        flat = np.frombuffer(b"".join(w for _, w in rows), np.uint64)
        sizes = np.array([len(w) // 8 for _, w in rows], np.int64)
        offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        at = np.flatnonzero(inner_windows(offs, window, len(flat)))
        hashes = window_hashes(flat, window)[at]
        order = np.argsort(hashes, kind="stable")
        self.hash, self.least = hashes[order], np.array([i for i, _ in rows], np.int64)[np.searchsorted(offs, at[order], side="right") - 1]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        text = _symbols(flat).tobytes().decode("utf-32-le")
        # a run of windows has a seed in every ``step`` words; a window alone has its seed of least hash, which its neighbours often share
        alone, run = offs[:-1][sizes == window], sizes > window
        n = -(-(sizes[run] - window + 1) // self.step)
        at = expand(np.zeros(len(n), np.int64), n) * self.step + np.repeat(offs[:-1][run], n) + self.step - 1
        if len(alone):
            seeds = window_hashes(flat, self.seed)
            at = np.concatenate([at, alone + np.argmin(seeds[alone[:, None] + np.arange(self.step)], axis=1)])
        for a in at.tolist():
            self.machine.add_word(text[a : a + self.seed], 1)
        self.empty = not len(self.hash)
        if not self.empty:
            self.machine.make_automaton()

    def covered(self, ids: np.ndarray, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs (segment, start, number) of the windows that also start in a document with a smaller id than the segment's."""
        none = np.zeros(0, np.int64)
        if self.empty:
            return none, none, none
        flat = np.frombuffer(b"".join(segments), np.uint64)
        sizes = np.array([len(x) // 8 for x in segments], np.int64)
        first = np.cumsum(sizes) - sizes
        codes = np.full(len(flat) + len(segments), 1, "<u4")  # a code that no word has ends each segment
        codes[np.arange(len(flat)) + np.repeat(np.arange(len(segments)), sizes)] = _symbols(flat)
        hits = np.fromiter(chain.from_iterable(self.machine.iter(codes.tobytes().decode("utf-32-le"))), np.int64)[::2] - (self.seed - 1)
        if not len(hits):
            return none, none, none
        seg = np.searchsorted(first + np.arange(len(segments)), hits, side="right") - 1
        at = hits - seg
        # the windows that hold a hit
        lo, hi = np.maximum(at - self.step + 1, first[seg]), np.minimum(at, first[seg] + sizes[seg] - self.window)
        whole = lo <= hi
        around = np.bincount(lo[whole], minlength=len(flat) + 1) - np.bincount(hi[whole] + 1, minlength=len(flat) + 1)
        at = np.flatnonzero(np.cumsum(around) > 0)
        seg = np.searchsorted(first, at, side="right") - 1
        j = _find(self.hash, window_hashes(flat, self.window)[at])
        live = (j >= 0) & (self.least[j] < ids[seg])
        seg, at = seg[live], at[live]
        if not len(seg):
            return none, none, none
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1)
        s = np.flatnonzero(new)
        return seg[s], at[s] - first[seg[s]], np.diff(np.concatenate([s, [len(seg)]]))
