"""Exact search plans: k nearest neighbours, radius, selectors, refinement, probes. Rows are (id, vector)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecquill.functions.vectors import ALIASES, doubles, metric, normalized
from vecquill.operators import exact, scan

def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return df.select(F.col(id_col).alias("id"), doubles(vector_col).alias("v"))


def distances(queries: DataFrame, base: DataFrame, name: str = "ip", p: float | None = None, where: Column | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, id, distance) of a stated query set against all base rows; ``where`` selects base ids before ranking.
    A null vector's distances are null. ``digits``: distances are rounded.

    The queries come to the driver in blocks when the plan is made; the pairs are made tile by tile.
    """
    rows = base if where is None else base.where(where)
    found = exact.every_pair(queries, rows, name, p, digits)
    null = F.lit(None).cast("double").alias("distance")
    q, r = queries.select(F.col("id").cast("long").alias("query_id"), F.col("v").isNull().alias("__q")), rows.select(F.col("id").cast("long").alias("id"), F.col("v").isNull().alias("__r"))
    of_rows = r.where("__r").crossJoin(F.broadcast(q.select("query_id")))  # a stated set
    of_queries = r.where("not __r").crossJoin(F.broadcast(q.where("__q").select("query_id")))
    return found.unionByName(of_rows.select("query_id", "id", null)).unionByName(of_queries.select("query_id", "id", null))


def top_k(pairs: DataFrame, k: int, larger: bool) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest by distance, then id; partial top-k before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("distance") if larger else F.asc("distance"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def knn(queries: DataFrame, base: DataFrame, k: int = 10, name: str = "ip", p: float | None = None, where: Column | None = None, apart: bool = False) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest base rows of each query, by distance, then id; null vectors are left
    out. apart: a query's own id is none of its neighbours. Each task ranks its rows; k rows a query and task are shuffled."""
    return top_k(exact.nearest(queries, base if where is None else base.where(where), k, name, p, apart), k, metric(name, p)[1])


def within(queries: DataFrame, base: DataFrame, radius: float, name: str = "l2") -> DataFrame:
    """All pairs strictly within the radius (beyond it for similarities)."""
    return exact.within(queries, base, radius, name)


def distances_of(pairs: DataFrame, queries: DataFrame, base: DataFrame, name: str) -> DataFrame:
    """(query_id, id, distance) of the stated pairs (query_id, id)."""
    q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    return pairs.select("query_id", "id").join(q, "query_id").join(base, "id").select("query_id", "id", metric(name)[0](F.col("qv"), F.col("v")).alias("distance"))


def refine(candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, name: str) -> DataFrame:
    """Re-rank candidates (query_id, id) by exact distances."""
    return top_k(distances_of(candidates, queries, base, name), k, metric(name)[1])


def _sums(rows: DataFrame, centres: np.ndarray, spherical: bool) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the rows of each list; one table a task comes to the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centres)), np.zeros_like(centres)
        for b in it:
            if b.num_rows:
                x = scan.vectors_of(b.column("v"))
                own = nearest_list(x, centres, spherical)
                n += np.bincount(own, minlength=len(centres))
                np.add.at(total, own, x)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])

    n, total = np.zeros(len(centres)), np.zeros_like(centres)
    for r in rows.where("v is not null").select(F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "n binary, total binary").toLocalIterator():
        n += np.frombuffer(r.n)
        total += np.frombuffer(r.total).reshape(centres.shape)
    return n, total


def nearest_list(x: np.ndarray, centres: np.ndarray, inner: bool = False) -> np.ndarray:
    """The nearest centre of each row, the first of equals."""
    d = -scan.inner(x, centres) if inner else scan.squared_l2(x, centres)
    return d.argmin(1)


def kmeans(rows: DataFrame, k: int, steps: int = 25, spherical: bool = False) -> DataFrame:
    """(list_no, v): Lloyd's steps from the k rows of least id; ties go to the smaller list, an empty list takes half of the
    largest. spherical: nearest by inner product, centres of length 1.

    The k centroids pass through the driver after each step, so the plan does not grow; each step is one pass over the
    rows, without a shuffle.
    """
    spark = rows.sparkSession
    centres = np.round(np.array([r.v for r in rows.where("v is not null").orderBy("id").limit(k).collect()], float), 9)
    for _ in range(steps if len(centres) else 0):
        n, total = _sums(rows, centres, spherical)
        now = centres.copy()
        now[n > 0] = np.round(total[n > 0] / n[n > 0, None], 9)
        for empty in np.flatnonzero(n == 0):
            big = int(n.argmax())
            now[empty], now[big] = now[big] * (1 + 1 / 1024), now[big] * (1 - 1 / 1024)
            n[empty] = n[big] = n[big] / 2
        if spherical:
            now = np.round(now / np.maximum(np.linalg.norm(now, axis=1, keepdims=True), 1e-12), 9)
        if (now == centres).all():
            break
        centres = now
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list_no int, v array<double>")


def centroids_of(rows: DataFrame, key: str, digits: int | None = 9) -> DataFrame:
    """(list_no, v): the mean vector of each group, rounded so that the order of summation does not show."""
    parts = rows.select(key, F.posexplode("v").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"] if digits is None else F.round(s["x"], digits)).alias("v")).withColumnRenamed(key, "list_no")


#: Numbers of the centroids that travel with a task; more are taken in blocks.
CENTROID_NUMBERS = 4_000_000


def assign(rows: DataFrame, centroids: DataFrame, name: str = "l2", k: int = 1) -> DataFrame:
    """(id, list_no, probe): the k nearest centroids (list_no, v) of each row, by distance, then list. The rows are not
    shuffled; centroids travel with the tasks, in blocks if there are very many."""
    table = sorted((r.list_no, r.v) for r in centroids.select("list_no", F.col("v").cast("array<double>").alias("v")).collect())
    numbers, book = np.array([c for c, _ in table], np.int64), np.array([v for _, v in table], float)
    larger = metric(name)[1]
    per = max(1, CENTROID_NUMBERS // max(1, book.shape[1] if len(book) else 1))

    def of_block(part: np.ndarray, x_numbers: np.ndarray):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in it:
                for at in range(0, whole.num_rows, scan.ROWS_AT_ONCE):
                    b = whole.slice(at, scan.ROWS_AT_ONCE)
                    x = scan.vectors_of(b.column("v"))
                    d = (-scan.inner(x, part) if larger else scan.squared_l2(x, part)).T
                    s, c = scan.least(d, np.broadcast_to(x_numbers[:, None], d.shape), min(k, len(part)))
                    ids = np.broadcast_to(b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)[None, :], s.shape)
                    rank = np.broadcast_to(np.arange(1, len(s) + 1, dtype=np.int32)[:, None], s.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(ids.T.ravel()), pa.array(c.T.ravel()), pa.array(rank.T.ravel()), pa.array((-s if larger else s).T.ravel())], names=["id", "list_no", "probe", "distance"])

        return run

    base = rows.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    found = [base.mapInArrow(of_block(book[i : i + per], numbers[i : i + per]), "id long, list_no long, probe int, distance double") for i in range(0, len(book), per)]
    list_type = dict(centroids.dtypes)["list_no"]
    if len(found) == 1:
        return found[0].select("id", F.col("list_no").cast(list_type).alias("list_no"), "probe")
    pairs = reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], "id long, list_no long, probe int, distance double")
    return top_k(pairs.select(F.col("id").alias("query_id"), F.col("list_no").alias("id"), "distance"), k, larger).select(F.col("query_id").alias("id"), F.col("id").cast(list_type).alias("list_no"), F.col("rank").alias("probe"))


def probe(queries: DataFrame, lists: DataFrame, centroids: DataFrame, nprobe: int, name: str = "l2") -> DataFrame:
    """(query_id, list_no, probe, id, distance) within the nprobe nearest lists of each query. lists: (list_no, id, v).

    The lists that the queries ask for, nprobe rows a query, come to the driver; list rows are dealt over all cores, and
    their distances are computed list by list, in tiles.
    """
    name = ALIASES.get(name.lower(), name.lower())
    chosen = assign(queries, centroids, name, nprobe).select("id", F.col("list_no").cast("long").alias("list_no"), "probe").toArrow()
    asked, numbers, places = (chosen.column(c).to_numpy() for c in ("id", "list_no", "probe"))
    rows = lists.select(F.col("list_no").cast("long").alias("list_no"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    dealt = rows.where("v is not null and list_no is not null").repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)

    def run_of(ids: np.ndarray, q: np.ndarray):
        own = np.flatnonzero(np.isin(asked, ids))
        own = own[np.argsort(numbers[own], kind="stable")]
        heads, starts = np.unique(numbers[own], return_index=True)
        wanted = {int(c): (np.searchsorted(ids, asked[part]), places[part]) for c, part in zip(heads, np.split(own, starts[1:]))}

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in it:
                for at in range(0, whole.num_rows, exact.TILE_ROWS):
                    b = whole.slice(at, exact.TILE_ROWS)
                    found, row_ids, x = b.column("list_no").to_numpy(), b.column("id").to_numpy(), exact.matrix_of(b.column("v"))
                    for c in np.unique(found).tolist():
                        here = np.flatnonzero(found == c)
                        asking, rank = wanted.get(c, (np.zeros(0, int), np.zeros(0, np.int32)))
                        for lo in range(0, len(asking), exact.TILE_QUERIES):
                            some = asking[lo : lo + exact.TILE_QUERIES]
                            d = exact.in_order(name, q[some].T[:, :, None], x[here].T[:, None, :])
                            each = lambda v: pa.array(np.repeat(v, len(here)))
                            yield pa.RecordBatch.from_arrays([each(ids[some]), each(np.full(len(some), c)), each(rank[lo : lo + exact.TILE_QUERIES]), pa.array(np.tile(row_ids[here], len(some))), pa.array(d.ravel())], names=["query_id", "list_no", "probe", "id", "distance"])

        return run

    schema = "query_id long, list_no long, probe int, id long, distance double"
    parts = [dealt.mapInArrow(run_of(ids, q), schema) for ids, q in exact.query_blocks(queries)]
    pairs = reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], schema)
    return pairs.withColumn("list_no", F.col("list_no").cast(dict(lists.dtypes)["list_no"]))


def capped_range(pairs: DataFrame, most: int, larger: bool) -> DataFrame:
    """The pairs strictly nearer than the pair in place ``most`` + 1, so ``most`` or fewer; all if there are no more.

    Only ``most`` + 1 distances are ranked, in each task and then once.
    """
    order = F.desc("distance") if larger else F.asc("distance")
    nearest = pairs.select("distance").orderBy(order).limit(most + 1)
    edge = nearest.agg((F.min if larger else F.max)("distance").alias("edge"), F.count("*").alias("n"))
    inside = (F.col("distance") > F.col("edge")) if larger else (F.col("distance") < F.col("edge"))
    return pairs.crossJoin(F.broadcast(edge)).where((F.col("n") <= most) | inside).select(*pairs.columns)  # edge is one row


def capped_within(queries: DataFrame, base: DataFrame, most: int, name: str = "l2") -> DataFrame:
    """``capped_range`` of all pairs of the queries and the base rows, without making them.

    ``most`` + 1 distances a task pass the driver when the plan is made; pairs are not shuffled.
    """
    nearest = exact.least(queries, base, most + 1, name)
    return distances(queries, base, name) if len(nearest) <= most else within(queries, base, nearest[most], name)


def range_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(precision, recall) over all (query_id, id): with nothing found precision is 1, with nothing to find recall is 1 or 0."""
    t = truth.select("query_id", "id").distinct().withColumn("t", F.lit(1))
    f = found.select("query_id", "id").distinct().withColumn("f", F.lit(1))
    n = t.join(f, ["query_id", "id"], "full").agg(F.count("t").alias("nt"), F.count("f").alias("nf"), F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("both"))
    none = F.when(F.col("nf") == 0, 1.0).otherwise(0.0)
    return n.select(F.coalesce(F.col("both") / F.nullif("nf", F.lit(0)), F.lit(1.0)).alias("precision"), F.coalesce(F.col("both") / F.nullif("nt", F.lit(0)), none).alias("recall"))


def pooled(rows: DataFrame, mode: str) -> DataFrame:
    """(doc_id, v) of token vectors (doc_id, pos, v): mean, cls (least position) or last (greatest)."""
    if mode in ("cls", "last"):
        return rows.groupBy("doc_id").agg((F.min_by if mode == "cls" else F.max_by)("v", "pos").alias("v"))
    if mode != "mean":
        raise ValueError(f"unknown pooling {mode!r}")
    return centroids_of(rows, "doc_id", None).withColumnRenamed("list_no", "doc_id")


def window_average(windows: DataFrame) -> DataFrame:
    """(doc_id, v): the mean of the normalised window vectors, normalised; a single window's vector is itself."""
    unit = windows.select("doc_id", normalized(F.col("v")).alias("v"))
    return pooled(unit.withColumn("pos", F.lit(0)), "mean").select("doc_id", normalized(F.col("v")).alias("v"))


def in_bitmap(id_: Column, bitmap: bytes) -> Column:
    """Is the id's bit set? Bits beyond the map are not. The map is a literal of the plan: for maps of a few megabytes."""
    code = F.lit(bytearray(bitmap))
    byte = F.conv(F.hex(F.substring(code, (id_ / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    inside = (id_ >= 0) & (id_ < len(bitmap) * 8)
    return F.coalesce(inside & (F.call_function("shiftright", byte, (id_ % 8).cast("int")).bitwiseAND(F.lit(1)) == 1), F.lit(False))


def translated(rows: DataFrame, ids: DataFrame, where: Column) -> DataFrame:
    """rows whose outer id the condition holds for; ids: (id, outer) of each row."""
    return rows.join(ids.where(where).select("id"), "id", "left_semi")


def scores_at(truth: DataFrame, found: DataFrame, radii: list[float]) -> DataFrame:
    """(radius, hits, precision, recall) of the pairs (query_id, id, distance) within each radius against the true pairs."""
    marked = found.join(truth.select("query_id", "id", F.lit(1).alias("t")), ["query_id", "id"], "left")
    inside = [F.col("distance") < F.lit(r) for r in radii]
    counts = [F.struct(F.lit(r).alias("radius"), F.count_if(i).alias("found"), F.count_if(i & F.col("t").isNotNull()).alias("hits")) for r, i in zip(radii, inside)]
    n = marked.agg(F.array(*counts).alias("n")).select(F.inline("n")).where("found > 0")
    all_ = truth.agg(F.count("*").alias("all"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(1.0))
    return n.crossJoin(F.broadcast(all_)).select("radius", "hits", share("hits", "found").alias("precision"), share("hits", "all").alias("recall"))  # all_ is one row


def pareto(points: DataFrame, cost: str, gain: str) -> DataFrame:
    """(cost, gain): the points with more gain than every cheaper one, the best of each cost."""
    best = points.groupBy(cost).agg(F.max(gain).alias(gain))  # one row for each distinct cost
    before = F.max(gain).over(Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(gain) > F.col("__before"))).drop("__before")


def same_but_for_ties(one: DataFrame, other: DataFrame) -> DataFrame:
    """(query_id, same): do two results have equal distances at every rank, and equal ids but among those of the greatest distance?"""
    a, b = one.select("query_id", "rank", "id", "distance"), other.select("query_id", "rank", F.col("id").alias("id2"), F.col("distance").alias("distance2"))
    ranks = a.join(b, ["query_id", "rank"], "full").groupBy("query_id").agg(F.bool_and(F.coalesce(F.col("distance") == F.col("distance2"), F.lit(False))).alias("levels"))
    last = Window.partitionBy("query_id")
    inner = lambda df, v: df.withColumn("__most", F.max(v).over(last)).where(F.col(v) < F.col("__most"))
    ia, ib = inner(a, "distance").select("query_id", "id", F.lit(1).alias("x")), inner(b, "distance2").select("query_id", F.col("id2").alias("id"), F.lit(1).alias("y"))
    ids = ia.join(ib, ["query_id", "id"], "full").groupBy("query_id").agg(F.bool_and(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("ids"))
    return ranks.join(ids, "query_id", "left").select("query_id", (F.col("levels") & F.coalesce("ids", F.lit(True))).alias("same"))


def split_rows(rows: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """rows whose vectors are the parts (first, length) behind one another: a sum over components is then the sum of the
    distances of the parts, as if each part had an index of its own."""
    return rows.withColumn("v", F.concat(*(F.slice("v", first + 1, n) for first, n in parts)))


def split_knn(queries: DataFrame, base: DataFrame, parts: list[tuple[int, int]], k: int = 10, name: str = "l2") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest by the sum of the distances of the parts, for metrics that are sums."""
    if ALIASES.get(name.lower(), name.lower()) not in ("ip", "l2", "l1", "canberra"):
        raise ValueError(f"metric {name!r} is no sum over components")
    return knn(split_rows(queries, parts), split_rows(base, parts), k, name)


# ---- further clusterings
def kmeans_1d(values: DataFrame, k: int, most: int = 20_000) -> DataFrame:
    """(list_no, centre, n): the exact clusters of (x), by dynamic programming over the distinct values in order.

    Values are counted first; their distinct ones, ``most`` at most, come to the driver (ValueError beyond).
    """
    rows = values.where("x is not null").groupBy(F.col("x").cast("double").alias("x")).agg(F.count("*").alias("n")).orderBy("x").limit(most + 1).collect()
    if not rows or len(rows) > most:
        raise ValueError(f"{len(rows)} distinct values")
    x, n = np.array([r.x for r in rows]), np.array([r.n for r in rows], float)
    sums = [np.concatenate([[0], np.cumsum(n * x**p)]) for p in range(3)]

    def cost(a: np.ndarray, b: int) -> np.ndarray:
        """The squared errors of the values a to b - 1 around their mean."""
        w, s1, s2 = (s[b] - s[a] for s in sums)
        return np.maximum(s2 - s1 * s1 / np.maximum(w, 1e-300), 0)

    k = min(k, len(x))
    best, cuts = np.array([np.inf if b == 0 else cost(np.array([0]), b)[0] for b in range(len(x) + 1)]), []
    best[0] = 0
    for _ in range(1, k):
        now, cut = np.full(len(x) + 1, np.inf), np.zeros(len(x) + 1, int)
        for b in range(1, len(x) + 1):
            total = best[:b] + cost(np.arange(b), b)
            cut[b] = int(total.argmin())
            now[b] = total[cut[b]]
        best = now
        cuts.append(cut)
    ends = [len(x)]
    for cut in reversed(cuts):
        ends.append(int(cut[ends[-1]]))
    edges = sorted({0, *ends})
    out = [(i, float((n[a:b] * x[a:b]).sum() / n[a:b].sum()), int(n[a:b].sum())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return values.sparkSession.createDataFrame(out, "list_no int, centre double, n long")


def kmeans_two_level(rows: DataFrame, k1: int, k2: int, steps: int = 25, sample: int = 50_000) -> DataFrame:
    """(list_no, v): k1 coarse clusters of all rows, each split into k2 by the rows of it that have the least hash, ``sample``
    at most in a task; list_no counts through."""
    from vecquill.operators import codecs

    coarse = kmeans(rows, k1, steps)
    own = rows.join(assign(rows, coarse).select("id", "list_no"), "id").select("id", "list_no", "v")
    first = Window.partitionBy("list_no").orderBy(F.xxhash64("id"), "id")
    picked = own.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= sample).select("list_no", "v")

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in it:
            if b.num_rows:
                lists, x = b.column("list_no").to_numpy(), scan.vectors_of(b.column("v"))
                for c in np.unique(lists):
                    held.setdefault(int(c), []).append(x[lists == c])
        for c, parts in held.items():
            x = np.concatenate(parts)
            centres = codecs.kmeans(x[np.lexsort(x.T[::-1])], k2, steps)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(c * k2, (c + 1) * k2, dtype=np.int32)), pa.array(list(centres), pa.list_(pa.float64()))], names=["list_no", "v"])

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return picked.repartition(parts, "list_no").mapInArrow(split, "list_no int, v array<double>")


def kmeans_progressive(rows: DataFrame, k: int, stages: int = 3, steps: int = 10) -> DataFrame:
    """(list_no, v): k-means along growing numbers of principal directions, each stage from the centres of the one before."""
    from vecquill.operators import projection

    first = rows.where("v is not null").select(F.size("v").alias("d")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "list_no int, v array<double>")
    turn = projection.pca(rows, first.d)
    turned = turn.apply(rows)
    centres: np.ndarray | None = None
    for stage in range(stages):
        d = max(1, round(first.d ** ((stage + 1) / stages)))
        part = turned.withColumn("v", F.slice("v", 1, d))
        if centres is None:
            centres = np.array([r.v for r in part.orderBy("id").limit(k).collect()], float)
        else:
            centres = np.pad(centres, ((0, 0), (0, d - centres.shape[1])))
        for _ in range(steps):
            n, total = _sums(part, centres, False)
            centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    table = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list_no int, v array<double>")
    return turn.reverse().apply(table)


# ---- parameters and long searches
def explore(index, queries: DataFrame, truth: DataFrame, probes: list[int], k: int = 10) -> DataFrame:
    """(nprobe, seconds, recall, best): recall at k and time of a search for each number of probes; best marks the front.
    truth: (query_id, id) of the k true neighbours."""
    import time

    wanted = truth.select("query_id", "id").distinct()
    total = wanted.count()
    rows = []
    for n in probes:
        began = time.perf_counter()
        found = index.search(queries, k, nprobe=n).select("query_id", "id").collect()  # k for each query of a stated set
        seconds = time.perf_counter() - began
        hit = wanted.join(F.broadcast(wanted.sparkSession.createDataFrame(found, "query_id long, id long")), ["query_id", "id"], "left_semi").count()
        rows.append((n, seconds, hit / total if total else 1.0))
    best, top = set(), -1.0
    for n, _, recall in sorted(rows, key=lambda r: (r[1], -r[2])):
        if recall > top:
            best.add(n)
            top = recall
    return queries.sparkSession.createDataFrame([(*r, r[0] in best) for r in rows], "nprobe int, seconds double, recall double, best boolean")


def search_in_blocks(index, queries: DataFrame, out: str, blocks: int, k: int = 10, **options) -> DataFrame:
    """A long search that can go on after a stop: each block of queries writes its results to ``out``; blocks that are there
    are not searched again. Blocks are by a hash of the query's id, so they are the same each time."""
    spark = queries.sparkSession
    for i in range(blocks):
        path = f"{out}/block={i}"
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
            index.search(own, k, **options).write.mode("overwrite").parquet(path)
    return spark.read.schema("query_id long, rank int, id long, distance double").parquet(*(f"{out}/block={i}" for i in range(blocks)))
