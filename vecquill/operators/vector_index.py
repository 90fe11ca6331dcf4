"""An index as a value: a specification, its trained model and a DataFrame of codes.

``open_factory("IVF64,PQ8,RFlat", 64).train(rows).add(rows).search(queries, 10, nprobe=8)``. Every call returns a new index
or a DataFrame. Training reads a bounded sample, a search reads its queries, ids that are given out are counted; all else
runs when the result is asked for. Save an index that is searched often, so that its rows are not encoded anew.

A search scans the codes of the lists that it probes, in numpy, task by task (``scan``). Product codes are compared by
tables of their entries' distances, others are decoded batch by batch. Graphs are built and walked shard by shard.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecquill.functions.vectors import normalized, padded, unpacker
from vecquill.operators import codecs, exact, scan, search, statistics
from vecquill.operators.graph import Graph
from vecquill.operators.projection import LinearMap, random_rotation
from vecquill.plans.spec import IndexSpec, parse

#: Rows of the sample that a model is trained on: this many for each centre of its largest book, within the two bounds.
PER_CENTRE, LEAST_SAMPLE, MOST_SAMPLE = 256, 2_000, 131_072
#: Rows of a shard that holds a graph of its own.
SHARD_ROWS = 50_000
#: Nodes that a walk through a graph keeps, at least.
WIDTH = 64


def _sample(rows: DataFrame, size: int) -> np.ndarray:
    """The rows of least hash: a bounded, repeatable sample that does not depend on the partitioning."""
    picked = rows.where("v is not null").orderBy(F.xxhash64("id", F.lit(1234)), "id").select("v").limit(size).collect()
    if not picked:
        raise ValueError("no vectors to train on")
    x = np.array([r.v for r in picked], float)
    if not np.isfinite(x).all():
        raise ValueError("vectors to train on hold NaN or infinity")
    return x


def _principal(x: np.ndarray, n: int, power: float) -> LinearMap:
    mean = x.mean(0)
    values, directions = np.linalg.eigh(np.cov((x - mean).T, bias=True).reshape(x.shape[1], -1))
    order = np.argsort(-values, kind="stable")[:n]
    m = directions[:, order].T * np.maximum(values[order], 1e-12)[:, None] ** power
    return LinearMap(m, -m @ mean)


def _sign_rotation(x: np.ndarray, n: int, steps: int = 50) -> LinearMap:
    """Principal directions, turned so that the signs lie near the values."""
    first = _principal(x, n, 0.0)
    y = x @ first.matrix.T + first.bias
    turn = random_rotation(n, n).matrix
    for _ in range(steps):
        u, _, v = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
        turn = (u @ v).T
    return first.then(LinearMap(turn.T, np.zeros(n)))


def _product_rotation(x: np.ndarray, n: int, parts: int, steps: int = 20) -> LinearMap:
    """Orthonormal rows that lower the error of a product code of ``parts`` parts with 8 bits, by turns."""
    m, w = random_rotation(x.shape[1], n).matrix, n // parts
    for _ in range(steps):
        y = x @ m.T
        books = [codecs.kmeans(y[:, i * w : (i + 1) * w], min(256, max(1, len(x) // 4)), 4) for i in range(parts)]
        near = np.concatenate([b[codecs.nearest(y[:, i * w : (i + 1) * w], b)] for i, b in enumerate(books)], axis=1)
        u, _, v = np.linalg.svd(near.T @ x, full_matrices=False)
        m = u @ v
    return LinearMap(m, np.zeros(n))


@dataclass(frozen=True)
class Coarse:
    """The centroids of the lists: books of one part, or of the two halves, whose pairs (i, j) are list i * size + j."""

    books: tuple[np.ndarray, ...]
    graph: str = ""
    links: int = 32

    def number(self, x: np.ndarray) -> np.ndarray:
        """The list of each row."""
        near = [codecs.nearest(part, book) for part, book in zip(np.split(x, len(self.books), axis=1), self.books)]
        return near[0] if len(near) == 1 else near[0] * len(self.books[1]) + near[1]

    def vector(self, lists: np.ndarray) -> np.ndarray:
        if len(self.books) == 1:
            return self.books[0][lists]
        size = len(self.books[1])
        return np.concatenate([self.books[0][lists // size], self.books[1][lists % size]], axis=1)

    def probed(self, q: np.ndarray, n: int, inner: bool) -> np.ndarray:
        """The n nearest lists of each query, a row each; ties go to the smaller list."""
        if len(self.books) == 1 and self.graph:
            walk = Graph.build(np.arange(len(self.books[0])), self.books[0], self.links, self.graph == "HNSW", inner)
            found = [walk.search(v, n, max(WIDTH, 2 * n))[1] for v in q]
            return np.array([np.resize(f, n) for f in found])
        tables = [-scan.inner(part, book) if inner else scan.squared_l2(part, book) for part, book in zip(np.split(q, len(self.books), axis=1), self.books)]
        if len(tables) == 1:
            return np.argsort(tables[0], axis=1, kind="stable")[:, :n]
        # the n least sums pair entries among the n least of each half
        order = [np.argsort(t, axis=1, kind="stable")[:, :n] for t in tables]
        least = [np.take_along_axis(t, o, 1) for t, o in zip(tables, order)]
        sums = (least[0][:, :, None] + least[1][:, None, :]).reshape(len(q), -1)
        lists = (order[0][:, :, None] * len(self.books[1]) + order[1][:, None, :]).reshape(len(q), -1)
        best = np.lexsort((lists, sums), axis=1)[:, :n]
        return np.take_along_axis(lists, best, 1)


@dataclass(frozen=True)
class VectorIndex:
    spec: IndexSpec
    chain: tuple[LinearMap | None, ...] = ()  # None stands for a transform without a matrix
    coarse: Coarse | None = None
    model: codecs.Model | None = None
    refine_model: codecs.Model | None = None
    rows: DataFrame | None = None  # id, list_no, code, fine
    graphs: DataFrame | None = None  # list_no, graph: of a saved graph index
    readonly: bool = False

    # ---- training
    @property
    def is_trained(self) -> bool:
        return self.model is not None

    def train(self, rows: DataFrame) -> "VectorIndex":
        """Fits the transforms, the lists and the books of codes in turn to a bounded sample of rows (id, v); bounds of scalar
        codes, thresholds of sign codes and the centre of RaBitQ are those of all rows."""
        if self.is_trained and self.spec.needs_training:
            raise ValueError("the index is trained")
        code = self.spec.code
        books = max((1 << b for b in code.sizes), default=1) if code.kind in ("pq", "pqr", "rq", "lsq") else 1
        lists = round(self.spec.lists**0.5) if self.spec.multi else self.spec.lists
        return self._fit(_sample(rows, min(MOST_SAMPLE, max(LEAST_SAMPLE, PER_CENTRE * max(books, lists)))), rows)

    def _fit(self, x: np.ndarray, rows: DataFrame) -> "VectorIndex":
        original, code = x, self.spec.code
        if x.shape[1] != self.spec.dimensions:
            raise ValueError(f"vectors of {x.shape[1]} dimensions for an index of {self.spec.dimensions}")
        chain: list[LinearMap | None] = []
        for name, args in self.spec.transforms:
            step = None
            if name == "pca":
                step = _principal(x, args[0], -0.5 if args[1] else 0.0)
                step = step.then(random_rotation(args[0], args[0])) if args[2] else step
            elif name == "rr":
                step = random_rotation(x.shape[1], args[0])
            elif name == "itq":
                step = _sign_rotation(x, args[0])
            elif name == "opq":
                step = _product_rotation(x, *args)
            chain.append(step)
            if step is not None:
                x = x @ step.matrix.T + step.bias
            elif name == "pad":
                x = np.pad(x, ((0, 0), (0, args[0] - x.shape[1])))
            else:
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(n > 0, n, 1)
        ready, coarse, lists = replace(self, chain=tuple(chain)), None, self.spec.lists
        if self.spec.multi:
            coarse = Coarse(tuple(codecs.kmeans(half, round(lists**0.5), 10) for half in np.split(x, 2, axis=1)))
        elif lists * PER_CENTRE <= MOST_SAMPLE and lists:
            coarse = Coarse((codecs.kmeans(x, lists, 10, spherical=self.spec.metric == "ip"),), self.spec.coarse_graph, self.spec.links)
        elif lists:  # too many lists for the sample: steps over all rows
            found = search.kmeans(ready._moved(rows), lists, 10).orderBy("list_no").collect()
            coarse = Coarse((np.array([r.v for r in found]),), self.spec.coarse_graph, self.spec.links)
        if coarse is not None and self._residual:
            x = x - coarse.vector(coarse.number(x))
        fine = self.spec.refine and ready._whole(self.spec.refine.code, codecs.train(self.spec.refine.code, original), rows, lambda v: v)
        ready = replace(ready, coarse=coarse)
        left = (lambda v: v - coarse.vector(coarse.number(v))) if coarse is not None and self._residual else (lambda v: v)
        return replace(ready, model=self._whole(code, codecs.train(code, x), ready._moved(rows.select(F.col("v").cast("array<double>").alias("v"))), left), refine_model=fine)

    @staticmethod
    def _whole(code: codecs.Code, model: codecs.Model, rows: DataFrame, of: statistics.Mapped) -> codecs.Model:
        """The model with its bounds, thresholds or centre from all rows; what else it holds is the sample's."""
        if code.kind == "sq" and "low" in model:
            _, low, high, _ = statistics.moments(rows, of)
            return model | {"low": low, "width": high - low}
        if code.kind == "rabitq":
            n, _, _, total = statistics.moments(rows, of)
            return model | {"centre": total / n}
        if code.kind == "lsh" and "cut" in model:
            turned = lambda v: codecs._turned(of(v), model, len(code.sizes))
            return model | {"cut": statistics.medians(rows, turned, statistics.moments(rows, turned)[0], len(model["cut"]))}
        return model

    @property
    def _residual(self) -> bool:
        return bool(self.spec.lists) and self.spec.code.kind in ("sq", "pq", "pqr", "rq", "lsq", "rabitq", "lattice") and self.spec.metric in ("l2", "ip")

    def _moved(self, rows: DataFrame) -> DataFrame:
        for (name, args), step in zip(self.spec.transforms, self.chain):
            if step is not None:
                rows = step.apply(rows)
            else:
                rows = rows.withColumn("v", normalized(F.col("v")) if name == "l2norm" else padded(F.col("v"), args[0]))
        return rows

    def _moved_queries(self, q: np.ndarray) -> np.ndarray:
        """The transforms, in numpy."""
        if q.shape[1] != self.spec.dimensions:
            raise ValueError(f"queries of {q.shape[1]} dimensions for an index of {self.spec.dimensions}")
        for (name, args), step in zip(self.spec.transforms, self.chain):
            if step is not None:
                q = q @ step.matrix.T + step.bias
            elif name == "l2norm":
                n = np.linalg.norm(q, axis=1, keepdims=True)
                q = q / np.where(n > 0, n, 1)
            else:
                q = np.pad(q, ((0, 0), (0, args[0] - q.shape[1])))
        return q

    # ---- content
    def add(self, rows: DataFrame) -> "VectorIndex":
        """Adds (id, v), or (v) with ids that follow the greatest so far; v is an array of numbers or the bytes of 32-bit
        floats. Null vectors are left out."""
        self._writable()
        if self.spec.code.kind == "minmax":
            raise ValueError("a row-wise code stands alone: use encode and decode")
        if not self.is_trained:
            if self.spec.needs_training:
                raise ValueError("the index is not trained")
            return self._fit(np.zeros((1, self.spec.dimensions)), rows).add(rows)
        rows = rows.withColumn("v", unpacker()("v")) if dict(rows.dtypes)["v"] == "binary" else rows
        if "id" not in rows.columns:
            rows = _numbered(rows.select("v"), self.next_id())
        rows = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v is not null")
        wrong = F.raise_error(F.concat(F.lit(f"a vector of another size than {self.spec.dimensions}: id "), F.col("id").cast("string")))
        rows = rows.withColumn("v", F.when(F.size("v") == self.spec.dimensions, F.col("v")).otherwise(wrong))
        if self.spec.graph:
            first = 0 if self.rows is None else self.rows.agg(F.max("list_no")).first()[0] + 1
            shards = max(1, -(-rows.count() // SHARD_ROWS))
            numbered = rows.withColumn("list_no", (F.pmod(F.xxhash64("id"), F.lit(shards)) + first).cast("int"))
        else:
            numbered = rows.withColumn("list_no", F.lit(0))
        refine = self.spec.refine
        fine = codecs.encoder(refine.code, self.refine_model)("v") if refine else F.lit(None).cast("binary")
        maps = all(step is not None or name == "pad" for (name, _), step in zip(self.spec.transforms, self.chain))
        ready = numbered.withColumn("fine", fine)
        new = (ready if maps else self._moved(ready)).mapInArrow(self._coder(maps), "id long, list_no int, code binary, fine binary")
        return replace(self, rows=new if self.rows is None else self.rows.unionByName(new))

    def _coder(self, maps: bool = False):
        """Batches of (id, v, list_no, fine) behind the transforms to batches of (id, list_no, code, fine). maps: the transforms
        are linear maps and paddings, and are made here, so that they need no workers of their own."""
        code, model, coarse, residual = self.spec.code, self.model, self.coarse, self._residual
        steps = [(args, step) for (_, args), step in zip(self.spec.transforms, self.chain)] if maps else []

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if not b.num_rows:
                    continue
                x, lists = scan.vectors_of(b.column("v")), b.column("list_no").to_numpy(zero_copy_only=False).astype(np.int32)
                for args, step in steps:
                    x = step.over(x) if step is not None else np.pad(x, ((0, 0), (0, args[0] - x.shape[1])))
                if coarse is not None:
                    lists = coarse.number(x).astype(np.int32)
                    x = x - coarse.vector(lists) if residual else x
                if code.kind == "sh" and code.name[-1] == "c":
                    x = x - coarse.vector(lists)
                raw = codecs.encode(code, model, x)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lists), pa.array([r.tobytes() for r in raw], pa.binary()), b.column("fine")], names=["id", "list_no", "code", "fine"])

        return run

    def encode(self, rows: DataFrame) -> DataFrame:
        """(id, code) of rows (id, v): the stand-alone code, without lists."""
        if not self.is_trained:
            raise ValueError("the index is not trained")
        return self._moved(rows.select("id", F.col("v").cast("array<double>").alias("v"))).select("id", codecs.encoder(self.spec.code, self.model)("v").alias("code"))

    def decode(self, codes: DataFrame) -> DataFrame:
        """(id, v) of (id, code), through the transforms' transposes."""
        return self._back(codes.select("id", codecs.decoder(self.spec.code, self.model, self.spec.inner_dimensions)("code").alias("v")))

    def add_codes(self, rows: DataFrame) -> "VectorIndex":
        """Adds rows (id, list_no, code) that were coded before, by an index of the same training."""
        self._writable()
        new = rows.select(F.col("id").cast("long").alias("id"), F.col("list_no").cast("int").alias("list_no"), "code", F.lit(None).cast("binary").alias("fine"))
        return replace(self, rows=new if self.rows is None else self.rows.unionByName(new), graphs=None)

    def _writable(self) -> None:
        if self.readonly:
            raise ValueError("the index was opened to be read")

    def next_id(self) -> int:
        greatest = None if self.rows is None else self.rows.agg(F.max("id")).first()[0]
        return 0 if greatest is None else greatest + 1

    def count(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    def remove(self, where: Column) -> "VectorIndex":
        """Without the ids for which the condition holds."""
        self._writable()
        return replace(self, rows=self.rows.where(~F.coalesce(where, F.lit(False))), graphs=None)

    def update(self, rows: DataFrame) -> "VectorIndex":
        """The rows (id, v) take the place of those of the same ids."""
        return replace(self, rows=self.rows.join(rows.select("id"), "id", "left_anti").select(*self.rows.columns), graphs=None).add(rows)

    def merge(self, other: "VectorIndex", shift: int = 0) -> "VectorIndex":
        """With the rows of an index of the same training, their ids shifted."""
        if self.spec != other.spec:
            raise ValueError("the indexes differ")
        self._writable()
        if self.spec.graph:  # shards of the two stay apart
            other_rows = other.rows.withColumn("list_no", F.col("list_no") + F.lit(self.rows.agg(F.max("list_no")).first()[0] + 1))
        else:
            other_rows = other.rows
        return replace(self, rows=self.rows.unionByName(other_rows.withColumn("id", F.col("id") + shift)), graphs=None)

    def reset(self) -> "VectorIndex":
        self._writable()
        return replace(self, rows=None, graphs=None)

    def copy_subset(self, modulus: int, remainder: int) -> "VectorIndex":
        """The rows whose id leaves the remainder; with every remainder once, the shards of the index by id."""
        return replace(self, rows=self.rows.where(F.pmod("id", F.lit(modulus)) == remainder), graphs=None)

    def copy_range(self, first: int, end: int) -> "VectorIndex":
        """The rows with first <= id < end."""
        return replace(self, rows=self.rows.where((F.col("id") >= first) & (F.col("id") < end)), graphs=None)

    def shard_by_id(self, shards: int) -> list["VectorIndex"]:
        return [self.copy_subset(shards, i) for i in range(shards)]

    def shard_by_list(self, shards: int) -> list["VectorIndex"]:
        """Parts that hold whole lists; a query's lists are read in the parts that hold them."""
        return [replace(self, rows=self.rows.where(F.pmod("list_no", F.lit(shards)) == i), graphs=None) for i in range(shards)]

    def clone(self) -> "VectorIndex":
        return replace(self)

    def permute(self, new_ids: DataFrame) -> "VectorIndex":
        """Rows under other ids: new_ids (id, new_id) names each id once."""
        return replace(self, rows=self.rows.join(new_ids, "id").select(F.col("new_id").cast("long").alias("id"), "list_no", "code", "fine"), graphs=None)

    def direct_map(self) -> DataFrame:
        """(id, list_no): in which list each id lies."""
        return self.rows.select("id", "list_no")

    def _opened(self):
        """A function from a batch of (list_no, code) to its vectors in the transformed space."""
        code, model, coarse, residual, d = self.spec.code, self.model, self.coarse, self._residual, self.spec.inner_dimensions

        def vectors(lists: np.ndarray, raw: np.ndarray) -> np.ndarray:
            x = codecs.decode(code, model, raw, d)
            return x + coarse.vector(lists) if residual else x

        return vectors

    def _decoded(self, rows: DataFrame) -> DataFrame:
        """(id, list_no, v) in the transformed space."""
        vectors = self._opened()

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if b.num_rows:
                    x = vectors(b.column("list_no").to_numpy(), scan.codes_of(b.column("code")))
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("list_no"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "list_no", "v"])

        return rows.select("id", "list_no", "code").mapInArrow(run, "id long, list_no int, v array<double>")

    def reconstruct(self, where: Column | None = None) -> DataFrame:
        """(id, v) from the codes, through the transforms' transposes; a scaling by length is not undone."""
        return self._back(self._decoded(self.rows if where is None else self.rows.where(where)).select("id", "v"))

    def _back(self, out: DataFrame) -> DataFrame:
        for (name, _), step, size in reversed(list(zip(self.spec.transforms, self.chain, self._sizes()))):
            if step is not None:
                out = step.reverse().apply(out)
            elif name == "pad":
                out = out.withColumn("v", F.slice("v", 1, size))
        return out

    def _sizes(self) -> list[int]:
        """The dimensions before each transform."""
        out, d = [], self.spec.dimensions
        for name, args in self.spec.transforms:
            out.append(d)
            d = d if name == "l2norm" else args[0]
        return out

    # ---- search
    def _probes(self, nprobe: int) -> int:
        return self.spec.lists if self.spec.whole else max(1, min(nprobe, self.spec.lists))

    def _asked_rows(self, where: Column | None) -> DataFrame:
        if self.rows is None:
            raise ValueError("the index is empty")
        return self.rows if where is None else self.rows.where(where)

    def _scanned(self, q: np.ndarray, nprobe: int):
        """For a block of queries: the distances of a batch, the lists to read (None: all), and a function from lists to (rows,
        queries): which rows a query asks for (None: all)."""
        spec, code, model, coarse, metric = self.spec, self.spec.code, self.model, self.coarse, self.spec.metric
        q, inner, vectors, d = self._moved_queries(q), metric == "ip", self._opened(), self.spec.inner_dimensions
        asked = lists_of = None
        if coarse is not None:
            lists_of = coarse.probed(q, self._probes(nprobe), inner)
            asked = np.unique(lists_of)

        def in_list(batch_lists: np.ndarray) -> np.ndarray:
            """(rows, queries): does the query ask for the row's list?"""
            place = np.searchsorted(asked, batch_lists)
            wanted = np.zeros((len(asked), len(q)), bool)
            wanted[np.searchsorted(asked, lists_of), np.arange(len(q))[:, None]] = True
            known = (place < len(asked)) & (asked[np.minimum(place, len(asked) - 1)] == batch_lists)
            return wanted[np.minimum(place, len(asked) - 1)] & known[:, None]

        tables = codecs.split_tables(q, model, code, inner or self._residual) if code.kind == "pq" and metric in ("l2", "ip") else None

        def by_tables(raw: np.ndarray, lists: np.ndarray) -> np.ndarray:
            numbers = codecs.numbers_of(raw, code)
            found = codecs.looked_up(tables, numbers)
            if not self_residual:
                return found
            own, at = np.unique(lists, return_inverse=True)
            centre = coarse.vector(own)
            if inner:
                return found + scan.inner(centre, q)[at]
            # |q - c - y|^2 = |q - c|^2 + |y|^2 + 2 c y - 2 q y; all but the last need no query and list together
            w = d // len(code.sizes)
            own_term = np.zeros(len(raw))
            for m in range(len(code.sizes)):
                book = model[f"book{m}"]
                own_term += ((book * book).sum(1)[None, :] + 2 * centre[:, m * w : (m + 1) * w] @ book.T)[at, numbers[:, m]]
            return np.maximum(scan.squared_l2(centre, q)[at] + own_term[:, None] - 2 * found, 0)

        self_residual = self._residual

        def distances(b: pa.RecordBatch) -> np.ndarray:
            lists, raw = b.column("list_no").to_numpy(), scan.codes_of(b.column("code"))
            if not len(raw):
                return np.zeros((0, len(q)))
            if tables is not None:
                found = by_tables(raw, lists)
            elif code.kind in ("lsh", "sh"):
                bits = codecs.decode(code, model, raw, d)
                own = q
                if code.kind == "sh" and code.name[-1] == "c":
                    found = np.zeros((len(raw), len(q)))
                    for one in np.unique(lists):
                        here = lists == one
                        found[here] = scan.hamming(bits[here], codecs.decode(code, model, codecs.encode(code, model, q - coarse.vector(np.array([one]))), d))
                else:
                    found = scan.hamming(bits, codecs.decode(code, model, codecs.encode(code, model, own), d))
            else:
                x = vectors(lists, raw)
                found = scan.inner(x, q) if inner else scan.squared_l2(x, q) if metric == "l2" else _other_metric(metric, x, q)
            return found if asked is None else np.where(in_list(lists), found, np.nan)

        return distances, asked, None if asked is None else in_list

    def _nearest(self, rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, nprobe: int, larger: bool) -> DataFrame:
        """The k nearest rows of each task to a block of queries; equal codes of a list tie exactly, wherever they lie."""
        distances, lists, in_list = self._scanned(q, nprobe)
        code, model, coarse, metric, vectors = self.spec.code, self.model, self.coarse, self.spec.metric, self._opened()
        q, read = self._moved_queries(q), self._read(rows, lists)
        if code.kind == "pq" and metric in ("l2", "ip"):
            w = self.spec.inner_dimensions // len(code.sizes)

            def in_parts(b: pa.RecordBatch, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
                """Of what the centres leave of the queries, the sums of the parts' distances in order."""
                numbers = codecs.numbers_of(scan.codes_of(b.column("code")), code)[ri]
                rest = (q[qi] - coarse.vector(b.column("list_no").to_numpy()[ri])).T
                return sum(exact.in_order("l2", rest[m * w : (m + 1) * w], model[f"book{m}"][numbers[:, m]].T) for m in range(len(code.sizes)))

            return scan.nearest(read, distances, ids, k, larger, in_parts if self._residual and metric == "l2" else None, float((q * q).sum(1).max()))
        if code.kind in ("lsh", "sh"):
            return scan.nearest(read, distances, ids, k, larger)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near, best = exact.Distances(metric, q), exact.Nearest(len(q), k)
            for whole in it:
                for at in range(0, whole.num_rows, exact.TILE_ROWS):
                    b = whole.slice(at, exact.TILE_ROWS)
                    own = b.column("list_no").to_numpy()
                    wanted = None if in_list is None else in_list(own)
                    best.add(b.column("id").to_numpy().astype(np.int64), near.tiles(vectors(own, scan.codes_of(b.column("code")))), None if wanted is None else lambda part, wanted=wanted: ~wanted[:, part].T)
            place, found, s = best.found()
            yield pa.RecordBatch.from_arrays([pa.array(ids[place]), pa.array(found), pa.array(near.distance(s))], names=["query_id", "id", "distance"])

        return read.mapInArrow(run, scan.PAIRS)

    def _read(self, rows: DataFrame, lists: np.ndarray | None) -> DataFrame:
        """The rows of the lists; saved rows lie by list, so others are not read."""
        rows = rows.select("id", "list_no", "code")
        if lists is None or len(lists) == self.spec.lists:
            return rows
        if len(lists) <= 1000:
            return rows.where(F.col("list_no").isin(lists.tolist()))
        wanted = rows.sparkSession.createDataFrame([(int(i),) for i in lists], "list_no int")
        return rows.join(F.broadcast(wanted), "list_no", "left_semi").select("id", "list_no", "code")  # lists of one block of queries

    def _found(self, queries: DataFrame, k: int, nprobe: int, where: Column | None, width: int) -> tuple[DataFrame, bool]:
        rows, larger = self._asked_rows(where), search.metric(self.spec.metric)[1] if self.spec.code.kind not in ("lsh", "sh") else False
        if self.spec.graph and where is None and self.spec.metric in ("l2", "ip"):
            pairs = scan.all_blocks(rows, queries, lambda ids, q: self._walked(ids, self._moved_queries(q), k, width))
        elif self.spec.code.kind == "dedup":
            once = rows.groupBy("list_no", "code").agg(F.min("id").alias("id"), F.collect_set("id").alias("ids"))

            def of_block(ids: np.ndarray, q: np.ndarray) -> DataFrame:
                near = self._nearest(once, ids, q, k, nprobe, larger)
                return near.join(once.select("id", F.explode("ids").alias("one")), "id").select("query_id", F.col("one").alias("id"), "distance")

            pairs = scan.all_blocks(rows, queries, of_block)
        else:
            pairs = scan.all_blocks(rows, queries, lambda ids, q: self._nearest(rows, ids, q, k, nprobe, larger))
        return scan.ranked(pairs, k, larger), larger

    def built_graphs(self) -> DataFrame:
        """(list_no, graph): the graph of each shard, over its decoded vectors."""
        if self.graphs is not None:
            return self.graphs
        vectors, links, layered, inner = self._opened(), self.spec.links, self.spec.graph == "HNSW", self.spec.metric == "ip"

        def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, int, bytes]] = []

            def built() -> pa.RecordBatch:
                ids, raw = np.array([r[1] for r in held], np.int64), np.frombuffer(b"".join(r[2] for r in held), np.uint8).reshape(len(held), -1)
                order = np.argsort(ids, kind="stable")  # not the order in which rows came
                graph = Graph.build(ids[order], vectors(np.zeros(len(held), int), raw[order]), links, layered, inner)
                return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), pa.array([graph.to_bytes()], pa.binary())], names=["list_no", "graph"])

            for b in it:
                for row in zip(*(b.column(c).to_pylist() for c in ("list_no", "id", "code"))):
                    if held and held[0][0] != row[0]:
                        yield built()
                        held = []
                    held.append(row)
            if held:
                yield built()

        parts = max(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        return self.rows.select("list_no", "id", "code").repartition(parts, "list_no").sortWithinPartitions("list_no").mapInArrow(build, "list_no int, graph binary")

    def _walked(self, query_ids: np.ndarray, q: np.ndarray, k: int, width: int) -> DataFrame:
        inner = self.spec.metric == "ip"

        def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for raw in b.column("graph").to_pylist():
                    graph = Graph.from_bytes(raw)
                    found = [graph.search(v, k, width) for v in q]
                    ids = np.repeat(query_ids, [len(d) for d, _ in found])
                    d = np.concatenate([d for d, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([i for _, i in found])), pa.array(-d if inner else np.maximum(d + 0.0, 0))], names=["query_id", "id", "distance"])

        full = self.built_graphs()
        # distances of a walk lack nothing: squared lengths of both sides are in them
        return full.select("graph").mapInArrow(walk, scan.PAIRS)

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 1, where: Column | None = None, k_factor: int = 4, width: int = WIDTH) -> DataFrame:
        """(query_id, rank, id, distance) for queries (id, v); ``where`` selects ids before ranking, and then a graph's rows
        are scanned. With refinement k * k_factor candidates are ranked by their refined codes. ``width``: nodes that a walk keeps.
        """
        refine = self.spec.refine
        if refine is None:
            return self._found(queries, k, nprobe, where, width)[0]
        found, _ = self._found(queries, k * k_factor, nprobe, where, max(width, k * k_factor))
        return search.refine(found, queries, self._fine(), k, self.spec.metric)

    def _fine(self) -> DataFrame:
        refine = self.spec.refine
        return self.rows.select("id", codecs.decoder(refine.code, self.refine_model, self.spec.dimensions)("fine").alias("v"))

    def search_and_codes(self, queries: DataFrame, k: int = 10, nprobe: int = 1) -> DataFrame:
        """(query_id, rank, id, distance, list_no, code)."""
        return self.search(queries, k, nprobe).join(self.rows.select("id", "list_no", "code"), "id").select("query_id", "rank", "id", "distance", "list_no", "code")

    def search_and_reconstruct(self, queries: DataFrame, k: int = 10, nprobe: int = 1) -> DataFrame:
        """(query_id, rank, id, distance, v)."""
        return self.search(queries, k, nprobe).join(self.reconstruct(), "id").select("query_id", "rank", "id", "distance", "v")

    def assign(self, queries: DataFrame, nprobe: int = 1) -> DataFrame:
        """(query_id, probe, list_no): the lists that each query would probe, in order."""
        if self.coarse is None:
            raise ValueError("the index has no lists")
        out = []
        for ids, q in scan.query_blocks(queries):
            found = self.coarse.probed(self._moved_queries(q), self._probes(nprobe), self.spec.metric == "ip")
            out += [(int(i), p, int(c)) for i, row in zip(ids, found) for p, c in enumerate(row, 1)]
        return queries.sparkSession.createDataFrame(out, "query_id long, probe int, list_no int")

    def search_centroids(self, queries: DataFrame, k: int = 10, nprobe: int = 1) -> DataFrame:
        """(query_id, rank, id, distance, list_no, query_list): the list of each result and the nearest list of its query."""
        first = self.assign(queries, 1).select("query_id", F.col("list_no").alias("query_list"))
        found = self.search(queries, k, nprobe).join(self.direct_map(), "id").join(F.broadcast(first), "query_id")  # a row a query
        return found.select("query_id", "rank", "id", "distance", "list_no", "query_list")

    def range_search(self, queries: DataFrame, radius: float, nprobe: int = 1, where: Column | None = None) -> DataFrame:
        """(query_id, id, distance) strictly within the radius (beyond it for similarities), by the codes, or by the
        refined codes if there are some. Graphs are scanned."""
        rows, larger = self._asked_rows(where), search.metric(self.spec.metric)[1] if self.spec.code.kind not in ("lsh", "sh") else False

        def of_block(ids: np.ndarray, q: np.ndarray) -> DataFrame:
            distances, lists, _ = self._scanned(q, nprobe)
            return scan.within(self._read(rows, lists), distances, ids, radius, larger)

        pairs = scan.all_blocks(rows, queries, of_block)
        if self.spec.refine is None:
            return pairs
        fine = search.distances_of(pairs, queries, self._fine(), self.spec.metric)
        return fine.where(F.col("distance") > radius if larger else F.col("distance") < radius)

    # ---- files
    def save(self, path: str) -> None:
        """Rows by list under ``path``/rows and the model in one row under ``path``/model."""
        if self.rows is None or not self.is_trained:
            raise ValueError("the index is empty")
        arrays = {f"m_{k}": v for k, v in self.model.items()} | {f"f_{k}": v for k, v in (self.refine_model or {}).items()}
        arrays |= {} if self.coarse is None else {f"lists{i}": b for i, b in enumerate(self.coarse.books)}
        for i, step in enumerate(self.chain):
            arrays |= {} if step is None else {f"a{i}": step.matrix, f"b{i}": step.bias}
        kept = io.BytesIO()
        np.savez(kept, **arrays)
        self.rows.write.mode("errorifexists").partitionBy("list_no").parquet(f"{path}/rows")
        if self.spec.graph:
            self.built_graphs().write.mode("errorifexists").parquet(f"{path}/graphs")
        one = (self.spec.description, self.spec.dimensions, self.spec.metric, kept.getvalue())
        self.rows.sparkSession.createDataFrame([one], "description string, dimensions int, metric string, arrays binary").coalesce(1).write.parquet(f"{path}/model")


def _other_metric(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The further metrics, a query at a time."""
    out = np.empty((len(x), len(q)))
    for i, v in enumerate(q):
        off = np.abs(x - v)
        with np.errstate(divide="ignore", invalid="ignore"):
            if metric == "l1":
                out[:, i] = off.sum(1)
            elif metric == "linf":
                out[:, i] = off.max(1)
            elif metric == "canberra":
                out[:, i] = (off / (np.abs(x) + np.abs(v))).sum(1)
            elif metric == "braycurtis":
                out[:, i] = off.sum(1) / np.abs(x + v).sum(1)
            elif metric == "cosine":
                n = np.linalg.norm(x, axis=1) * np.linalg.norm(v)
                both = ~x.any(1) & ~v.any()
                out[:, i] = np.where(n > 0, x @ v / n, both.astype(float))
            elif metric == "jaccard":
                out[:, i] = np.minimum(x, v).sum(1) / np.maximum(x, v).sum(1)
            elif metric == "jensenshannon":
                mean = (x + v) / 2
                out[:, i] = 0.5 * (-x * np.log(mean / x) - v * np.log(mean / v)).sum(1)
            elif metric == "nan_euclidean":
                both = ~(np.isnan(x) | np.isnan(v))
                out[:, i] = x.shape[1] / both.sum(1) * np.where(both, off * off, 0).sum(1)
            elif metric == "gower":
                bad = (x > 1) | (v > 1) | ((x < 0) != (v < 0))
                out[:, i] = np.where(bad, np.nan, np.where(x < 0, x != v, off)).sum(1) / x.shape[1]
            else:
                raise ValueError(f"metric {metric!r} has no scan")
    return out


def _numbered(rows: DataFrame, first: int) -> DataFrame:
    """rows with ids from ``first``, in the order of a hash of the vectors and the vectors themselves.

    The order is the content's own, so it does not change when a task runs again. A sort by range deals the rows; one
    count for each range passes the driver.
    """
    marked = rows.withColumn("__h", F.xxhash64("v"))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    part = F.floor(F.shiftrightunsigned("__h", 1) / F.lit(float(1 << 63)) * n).cast("int")
    marked = marked.withColumn("__part", F.least(part, F.lit(n - 1)))
    at, starts = first, []
    for r in marked.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():
        starts.append((r["__part"], at))
        at += r["n"]
    table = rows.sparkSession.createDataFrame(starts, "__part int, __start long")
    ranked = marked.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy("__h", "v")) - 1)
    return ranked.join(F.broadcast(table), "__part").select((F.col("__start") + F.col("__row")).alias("id"), "v")  # a row for each part


def open_factory(description: str, dimensions: int, metric: str = "l2") -> VectorIndex:
    """An empty index."""
    return VectorIndex(parse(description, dimensions, metric))


def open_index(spark: SparkSession, path: str, readonly: bool = False) -> VectorIndex:
    """A saved index; its rows are read when asked for, and only the lists that are searched. A read-only one refuses changes."""
    one = spark.read.parquet(f"{path}/model").first()
    spec, kept = parse(one.description, one.dimensions, one.metric), np.load(io.BytesIO(one.arrays))
    chain = tuple(LinearMap(kept[f"a{i}"], kept[f"b{i}"]) if f"a{i}" in kept else None for i in range(len(spec.transforms)))
    pick = lambda p: {k[2:]: kept[k] for k in kept if k.startswith(p)}
    fine = pick("f_") if spec.refine else None
    rows = spark.read.schema("id long, code binary, fine binary, list_no int").parquet(f"{path}/rows")
    books = tuple(kept[f"lists{i}"] for i in range(2) if f"lists{i}" in kept)
    coarse = Coarse(books, spec.coarse_graph, spec.links) if books else None
    graphs = spark.read.schema("list_no int, graph binary").parquet(f"{path}/graphs") if spec.graph else None
    return VectorIndex(spec, chain, coarse, pick("m_"), fine, rows.select("id", "list_no", "code", "fine"), graphs, readonly)


def merge_saved(spark: SparkSession, paths: list[str], out: str, shift: bool = False) -> VectorIndex:
    """Saved indexes of the same training joined on disk; with ``shift`` each one's ids follow the greatest before."""
    index = open_index(spark, paths[0])
    for path in paths[1:]:
        index = index.merge(open_index(spark, path), index.next_id() if shift else 0)
    index.save(out)
    return open_index(spark, out)


class Trainer:
    """Training vectors gathered in a folder, batch by batch, until an index is trained on them."""

    def __init__(self, spark: SparkSession, path: str, index: VectorIndex):
        if index.is_trained:
            raise ValueError("the index is trained")
        self.spark, self.path, self.index = spark, path, index

    def add(self, rows: DataFrame) -> None:
        """Appends (v): arrays of numbers, or bytes of 32-bit floats."""
        v = unpacker()("v") if dict(rows.dtypes)["v"] == "binary" else F.col("v").cast("array<float>")
        rows.select(v.alias("v")).where("v is not null").write.mode("append").parquet(self.path)

    def add_half(self, rows: DataFrame) -> None:
        """Appends (v), bytes of 16-bit floats."""
        self.add(rows.select(unpacker(half=True)("v").alias("v")))

    def train(self) -> VectorIndex:
        try:
            kept = self.spark.read.parquet(self.path)
        except Exception as e:
            raise ValueError(f"no training vectors in {self.path}") from e
        d = self.index.spec.dimensions
        if kept.where(F.size("v") != d).limit(1).count():
            raise ValueError(f"training vectors of another size than {d}")
        return self.index.train(kept.select(F.xxhash64("v").alias("id"), F.col("v").cast("array<double>").alias("v")))
