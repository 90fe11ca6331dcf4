"""The queries for the reference's operators and their SQL oracles. A search asks with every row whose id is divisible by 20."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecquill.functions import vectors as V
from vecquill.operators import chat, codecs, pieces, projection, sampling, scan, search, text, vector_index
from vecquill.plans.spec import parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def base(spark: SparkSession, d: str) -> DataFrame:
    return search.vectors(table(spark, d, "embeddings"))


def asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % 20 == 0)


# ---- metrics and k nearest neighbours
E_ = "e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
ALL = "range(1, len(a) + 1)"


def each(expr: str) -> str:
    """DuckDB: the list of expr over i, with a[i] and b[i]."""
    return f"list_transform({ALL}, lambda i: {expr})"


def total(expr: str) -> str:
    return f"list_sum({each(expr)})"


DUCK = {
    "ip": (total("a[i]*b[i]"), True), "l2": (total("(a[i]-b[i])*(a[i]-b[i])"), False), "l1": (total("abs(a[i]-b[i])"), False), "linf": (f"list_max({each('abs(a[i]-b[i])')})", False),
    "canberra": (total("abs(a[i]-b[i])/(abs(a[i])+abs(b[i]))"), False), "braycurtis": (f"{total('abs(a[i]-b[i])')}/{total('abs(a[i]+b[i])')}", False), "lp3": (total("abs(a[i]-b[i])*abs(a[i]-b[i])*abs(a[i]-b[i])"), False),
    "cosine": (f"{total('a[i]*b[i]')}/(sqrt({total('a[i]*a[i]')})*sqrt({total('b[i]*b[i]')}))", True),
    "js_abs": (f"0.5*{total('-a[i]*ln((a[i]+b[i])/2/a[i])-b[i]*ln((a[i]+b[i])/2/b[i])')}", False), "jaccard_abs": (f"{total('least(a[i],b[i])')}/{total('greatest(a[i],b[i])')}", True),
    "naneuclid": (f"len(a)/{total('CASE WHEN isnan(a[i]) OR isnan(b[i]) THEN 0.0 ELSE 1.0 END')}*{total('CASE WHEN isnan(a[i]) OR isnan(b[i]) THEN 0.0 ELSE (a[i]-b[i])*(a[i]-b[i]) END')}", False),
    "gower": (f"{total('abs(a[i]-b[i])')}/len(a)", False),
}
#: What a metric's input is made of: Spark and DuckDB forms of a component x.
SHAPES = {"js_abs": (F.abs, "abs(x)"), "jaccard_abs": (F.abs, "abs(x)"), "naneuclid": (lambda x: F.when(F.abs(x) < 0.02, F.lit(float("nan"))).otherwise(x), "CASE WHEN abs(x) < 0.02 THEN CAST('nan' AS DOUBLE) ELSE x END"), "gower": (lambda x: (x + 1) / 2, "(x + 1) / 2")}
NAMES = {"lp3": "lp", "js_abs": "jensenshannon", "jaccard_abs": "jaccard", "naneuclid": "nan_euclidean"}


def pairs_sql(name: str, shape: str = "x", where: str = "true") -> str:
    return f"WITH {E_}, s AS (SELECT id, list_transform(v, lambda x: {shape}) AS v FROM e), p AS (SELECT q.id AS query_id, s.id AS id, q.v AS a, s.v AS b FROM s, s q WHERE q.id % 20 = 0 AND {where}), d AS (SELECT query_id, id, {DUCK[name][0]} AS distance FROM p)"


def ranked_sql(larger: bool, k: int, source: str = "d", partition: str = "query_id") -> str:
    return f"SELECT query_id, rank, id, round(distance, 6) AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {partition} ORDER BY distance {'DESC' if larger else 'ASC'}, id) AS INTEGER) AS rank FROM {source}) WHERE rank <= {k}"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


for _name in DUCK:
    _f, _sql = SHAPES.get(_name, (None, "x"))

    @register(f"knn_{_name}", f"{pairs_sql(_name, _sql)} {ranked_sql(DUCK[_name][1], 10)}")
    def _(spark, d, name=_name, f=_f):
        rows = base(spark, d)
        rows = rows if f is None else rows.withColumn("v", F.transform("v", f))
        return rounded(search.knn(asked(rows), rows, 10, NAMES.get(name, name), p=3 if name == "lp3" else None))


@register("range_l2", f"{pairs_sql('l2')} SELECT query_id, id, round(distance, 6) AS distance FROM d WHERE distance < 1.2")
def _(spark, d):
    return rounded(search.within(asked(base(spark, d)), base(spark, d), 1.2, "l2"))


@register("range_ip", f"{pairs_sql('ip')} SELECT query_id, id, round(distance, 6) AS distance FROM d WHERE distance > 0.4")
def _(spark, d):
    return rounded(search.within(asked(base(spark, d)), base(spark, d), 0.4, "ip"))


@register("pairwise_l2", f"{pairs_sql('l2')} SELECT query_id, id, round(distance, 6) AS distance FROM d")
def _(spark, d):
    return search.distances(asked(base(spark, d)), base(spark, d), "l2", digits=6)


# ---- selectors: restrict ids before ranking
SELECTORS = {"sel_range": ("id >= 100 AND id < 300", "s.id >= 100 AND s.id < 300"), "sel_batch": ("id IN (1, 7, 20, 55, 140, 222, 333)", "s.id IN (1, 7, 20, 55, 140, 222, 333)"), "sel_not": ("NOT (id < 250)", "NOT (s.id < 250)"), "sel_and_or_xor": ("((id % 3 = 0) OR (id % 5 = 0)) AND ((id < 400) <> (id % 2 = 0))", "((s.id % 3 = 0) OR (s.id % 5 = 0)) AND ((s.id < 400) <> (s.id % 2 = 0))")}
for _name, (_spark, _sql) in SELECTORS.items():

    @register(_name, f"{pairs_sql('ip', where=_sql)} {ranked_sql(True, 5)}")
    def _(spark, d, cond=_spark):
        return rounded(search.knn(asked(base(spark, d)), base(spark, d), 5, "ip", where=F.expr(cond)))


@register("knn_graph_self", f"{pairs_sql('l2', where='q.id <> s.id')} {ranked_sql(False, 5)}")
def _(spark, d):
    return rounded(search.knn(asked(base(spark, d)), base(spark, d), 5, "l2", apart=True))


@register("shard_merge_topk", f"{pairs_sql('ip')}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id % 4 ORDER BY distance DESC, id) AS r FROM d) WHERE r <= 10) {ranked_sql(True, 10, 't')}")
def _(spark, d):
    shards = [search.knn(asked(base(spark, d)), base(spark, d), 10, "ip", where=F.col("id") % 4 == i).drop("rank") for i in range(4)]
    return rounded(search.top_k(reduce(DataFrame.unionByName, shards), 10, True))


@register("refine_two_stage", f"{pairs_sql('l1')}, c AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM d) WHERE r <= 40), d2 AS (SELECT c.query_id, c.id, (SELECT {total('(a[i]-b[i])*(a[i]-b[i])')} FROM (SELECT q.v AS a, x.v AS b)) AS distance FROM c JOIN e q ON q.id = c.query_id JOIN e x ON x.id = c.id) {ranked_sql(False, 10, 'd2')}")
def _(spark, d):
    rows = base(spark, d)
    return rounded(search.refine(search.knn(asked(rows), rows, 40, "l1"), asked(rows), rows, 10, "l2"))


@register("recall_at_1", f"{pairs_sql('ip')}, g AS (SELECT query_id, arg_max(id, (distance, -id)) AS best FROM d GROUP BY 1), r AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance DESC, id) AS k FROM d WHERE id % 2 = 0) WHERE k <= 10) SELECT round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM r WHERE r.query_id = g.query_id AND r.id = g.best)) / count(*), 6) AS recall FROM g")
def _(spark, d):
    rows = base(spark, d)
    truth = search.knn(asked(rows), rows, 1, "ip").select("query_id", "id")
    got = search.knn(asked(rows), rows, 10, "ip", where=F.expr("id % 2 = 0")).select("query_id", "id", F.lit(1).alias("hit"))
    return truth.join(got, ["query_id", "id"], "left").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("recall"))


@register("intersection_at_10", f"{pairs_sql('ip')}, t AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance DESC, id) AS k FROM d) WHERE k <= 10), r AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance DESC, id) AS k FROM d WHERE id % 2 = 0) WHERE k <= 10) SELECT round(count(*) / (SELECT count(*) FROM t), 6) AS share FROM t JOIN r USING (query_id, id)")
def _(spark, d):
    rows = base(spark, d)
    truth, got = search.knn(asked(rows), rows, 10, "ip"), search.knn(asked(rows), rows, 10, "ip", where=F.expr("id % 2 = 0"))
    hit = truth.select("query_id", "id").join(got.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("share"))


@register("distance_subset", f"WITH {E_}, p AS (SELECT q.id AS query_id, e.id, q.v AS a, e.v AS b FROM e JOIN e q ON e.id % 50 = q.id % 50 AND q.id % 20 = 0) SELECT query_id, id, round({total('(a[i]-b[i])*(a[i]-b[i])')}, 6) AS distance FROM p")
def _(spark, d):
    rows = base(spark, d)
    wanted = asked(rows).select(F.col("id").alias("query_id"), (F.col("id") % 50).alias("r")).join(rows.select("id", (F.col("id") % 50).alias("r")), "r").select("query_id", "id")
    return rounded(search.distances_of(wanted, asked(rows), rows, "l2"))


@register("search_and_reconstruct", f"{pairs_sql('ip')}, t AS ({ranked_sql(True, 3)}) SELECT query_id, rank, t.id, pos - 1 AS pos, round(e.v[pos], 6) AS x FROM t JOIN e USING (id), range(1, 65) r(pos)")
def _(spark, d):
    rows = base(spark, d)
    found = search.knn(asked(rows), rows, 3, "ip").join(rows, "id").select("query_id", "rank", "id", F.posexplode("v").alias("pos", "x"))
    return found.select("query_id", "rank", "id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def lloyd_sql(steps: int, k: int) -> str:
    """Steps of k-means from the vectors of the k least ids, one after the other."""
    out = [f"WITH {E_}, k0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS list_no, list_transform(v, lambda x: round(x, 9)) AS v FROM e ORDER BY id LIMIT {k})"]
    for i in range(steps):
        out.append(f"a{i} AS MATERIALIZED (SELECT id, arg_min(list_no, (d, list_no)) AS list_no FROM (SELECT id, list_no, {total('(a[i]-b[i])*(a[i]-b[i])')} AS d FROM (SELECT e.id, k.list_no, e.v AS a, k.v AS b FROM e, k{i} k)) GROUP BY id)")
        out.append(f"k{i + 1} AS MATERIALIZED (SELECT list_no, list(x ORDER BY pos) AS v FROM (SELECT list_no, pos, round(avg(v[pos]), 9) AS x FROM e JOIN a{i} USING (id), range(1, 65) t(pos) GROUP BY 1, 2) GROUP BY 1)")
    return ", ".join(out) + f" SELECT list_no, CAST(pos - 1 AS BIGINT) AS pos, round(v[pos], 6) AS x FROM k{steps}, range(1, 65) t(pos)"


@register("kmeans_full", lloyd_sql(10, 16))
def _(spark, d):
    found = search.kmeans(base(spark, d), 16, 10).select("list_no", F.posexplode("v").alias("pos", "x"))
    return found.select("list_no", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register("pad", f"WITH {E_} SELECT id, pos - 1 AS pos, CASE WHEN pos <= 64 THEN round(v[pos], 6) ELSE 0.0 END AS x FROM e, range(1, 81) t(pos)")
def _(spark, d):
    return base(spark, d).select("id", F.posexplode(V.padded(F.col("v"), 80)).alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


# ---- mutation and reconstruction
@register("reconstruct_ids", f"WITH {E_} SELECT id, pos - 1 AS pos, round(v[pos], 6) AS x FROM e, range(1, 65) t(pos) WHERE id IN (3, 14, 159)")
def _(spark, d):
    return base(spark, d).where("id IN (3, 14, 159)").select("id", F.posexplode("v").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register("remove_ids", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 7 <> 0")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return rows.join(rows.where("id % 7 = 0").select("id"), "id", "left_anti")


@register("merge_shift_ids", "SELECT vec_id AS id, label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return rows.unionAll(rows.withColumn("id", F.col("id") + 1000000))


@register("copy_subset_mod", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 4 = 1")
def _(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 4 = 1").select(F.col("vec_id").alias("id"), "label")


@register("dedup_vectors", "SELECT min(vec_id) AS id, count(*) AS n FROM embeddings GROUP BY embedding")
def _(spark, d):
    return table(spark, d, "embeddings").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).select("id", "n")


@register("sliding_window_slices", "SELECT vec_id AS id, vec_id // 50 AS slice FROM embeddings WHERE vec_id // 50 > (SELECT max(vec_id // 50) FROM embeddings) - 3")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.expr("vec_id div 50").alias("slice"))
    return rows.crossJoin(F.broadcast(rows.agg(F.max("slice").alias("last")))).where("slice > last - 3").select("id", "slice")


# ---- vector functions
NORM = f"sqrt({total('a[i]*a[i]')})"


@register("norm_l2", f"WITH {E_} SELECT id, round({NORM}, 6) AS norm FROM (SELECT id, v AS a FROM e)")
def _(spark, d):
    return base(spark, d).select("id", F.round(V.norm(F.col("v")), 6).alias("norm"))


@register("normalize_l2", f"WITH {E_}, n AS (SELECT id, a, {NORM} AS n FROM (SELECT id, list_transform(v, lambda x: x * 3) AS a FROM e)) SELECT id, CAST(pos - 1 AS BIGINT) AS pos, round(a[pos] / n, 6) AS x FROM n, range(1, 65) t(pos)")
def _(spark, d):
    rows = base(spark, d).withColumn("v", F.transform("v", lambda x: x * 3))
    return rows.select("id", F.posexplode(V.normalized(F.col("v"))).alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


U_ = "u AS (SELECT id, label, CAST(pos - 1 AS BIGINT) AS pos, v[pos] AS x FROM e, range(1, 65) t(pos))"


def unpacked(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.posexplode(V.doubles("embedding")).alias("pos", "x"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@register("center", f"WITH {E_}, {U_} SELECT id, pos, round(x - avg(x) OVER (PARTITION BY pos), 6) + 0.0 AS x FROM u")
def _(spark, d):
    u = unpacked(spark, d)
    means = u.groupBy("pos").agg(F.avg("x").alias("m"))
    return u.join(F.broadcast(means), "pos").select("id", "pos", (F.round(F.col("x") - F.col("m"), 6) + 0.0).alias("x"))


@register("avg_vec_by_label", f"WITH {E_}, {U_}, m AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY 1, 2) SELECT label, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m")
def _(spark, d):
    m = unpacked(spark, d).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return m.withColumn("x", F.round(F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("label"))), 6))


@register("matrix_stats", f"WITH {E_}, {U_} SELECT pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS lo, round(max(x), 6) AS hi, count(*) FILTER (WHERE isnan(x)) AS nans FROM u GROUP BY pos")
def _(spark, d):
    r = lambda c: F.round(c, 6)
    return unpacked(spark, d).groupBy("pos").agg(r(F.avg("x")).alias("mean"), r(F.stddev_pop("x")).alias("std"), r(F.min("x")).alias("lo"), r(F.max("x")).alias("hi"), F.count_if(F.isnan("x")).alias("nans"))


@register("imbalance_factor", "SELECT round(sum(h * h) * count(*) / (sum(h) * sum(h)), 6) AS imbalance FROM (SELECT CAST(count(*) AS DOUBLE) AS h FROM embeddings GROUP BY label)")
def _(spark, d):
    h = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").cast("double").alias("h"))
    return h.agg(F.round(F.sum(F.col("h") * F.col("h")) * F.count("*") / (F.sum("h") * F.sum("h")), 6).alias("imbalance"))


@register("minmax_rowwise", f"WITH {E_} SELECT id, CAST(pos - 1 AS BIGINT) AS pos, CAST(floor((v[pos] - list_min(v)) / (list_max(v) - list_min(v)) * 255) AS INTEGER) AS code FROM e, range(1, 65) t(pos)")
def _(spark, d):
    rows = base(spark, d).select("id", "v", F.array_min("v").alias("lo"), F.array_max("v").alias("hi"))
    return rows.select("id", F.posexplode(F.transform("v", lambda x: F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).cast("int"))).alias("pos", "code")).withColumn("pos", F.col("pos").cast("long"))


@register("linear_apply", f"WITH {E_} SELECT id, CAST(r AS BIGINT) AS pos, round(list_sum(list_transform(range(0, 64), lambda c: v[c + 1] * ((r * 7 + c * 3) % 11 - 5) / 10.0)) + r, 6) AS x FROM e, range(0, 4) t(r)")
def _(spark, d):
    r, c = np.indices((4, 64))
    out = projection.LinearMap(((r * 7 + c * 3) % 11 - 5) / 10.0, np.arange(4.0)).apply(base(spark, d))
    return out.select("id", F.posexplode("v").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register("pca_total_variance", f"WITH {E_}, {U_} SELECT round(sum(s), 6) AS total FROM (SELECT var_pop(x) AS s FROM u GROUP BY pos)")
def _(spark, d):
    rows = base(spark, d)
    x = projection.pca(rows, 64).apply(rows).select(F.posexplode("v").alias("pos", "x"))
    return x.groupBy("pos").agg(F.var_pop("x").alias("s")).agg(F.round(F.sum("s"), 6).alias("total"))


@register("pca_apply", f"WITH {E_}, {U_}, m AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM u GROUP BY pos)), z AS (SELECT id, list_transform(range(1, 65), lambda i: v[i] - m[i]) AS v FROM e, m), p AS (SELECT q.id AS query_id, z.id, q.v AS a, z.v AS b FROM z, z q WHERE q.id % 20 = 0) SELECT query_id, id, round({total('a[i]*b[i]')}, 6) + 0.0 AS distance FROM p")
def _(spark, d):
    rows = base(spark, d)  # all directions: inner products are those of the centred vectors, whatever the directions' signs
    out = projection.pca(rows, 64).apply(rows)
    return search.distances(asked(out), out, "ip", digits=6)


# ---- inverted lists: the centroids are the means of the labels
CENTROIDS = f"{E_}, {U_}, c AS (SELECT label AS list_no, list(round(x, 9) ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM u GROUP BY 1, 2) GROUP BY 1)"
L2E = total("(a[i]-b[i])*(a[i]-b[i])")
PROBES = f"{CENTROIDS}, pr AS (SELECT query_id, list_no, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, list_no) AS INTEGER) AS probe FROM (SELECT query_id, list_no, {L2E} AS distance FROM (SELECT q.id AS query_id, c.list_no, q.v AS a, c.v AS b FROM e q, c WHERE q.id % 20 = 0)) QUALIFY probe <= 3), d AS (SELECT query_id, list_no, probe, id, {L2E} AS distance FROM (SELECT pr.query_id, pr.list_no, pr.probe, e.id, q.v AS a, e.v AS b FROM pr JOIN e q ON q.id = pr.query_id JOIN e ON e.label = pr.list_no))"


def ivf(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", V.doubles("embedding").alias("v"))
    lists = rows.withColumnRenamed("label", "list_no")
    return search.probe(asked(rows), lists, search.centroids_of(rows, "label"), 3)


@register("ivf_probe_given_centroids", f"WITH {PROBES} {ranked_sql(False, 10)}")
def _(spark, d):
    return rounded(search.top_k(ivf(spark, d), 10, False))


@register("ivf_range", f"WITH {PROBES} SELECT query_id, id, round(distance, 6) AS distance FROM d WHERE distance < 1.4")
def _(spark, d):
    return rounded(ivf(spark, d).where("distance < 1.4").select("query_id", "id", "distance"))


@register("ivf_max_codes", f"WITH {PROBES}, n AS (SELECT query_id, list_no, probe, count(*) AS n FROM d GROUP BY ALL), v AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM n) SELECT query_id, list_no, probe, n FROM v WHERE seen < 80")
def _(spark, d):
    n = ivf(spark, d).groupBy("query_id", "list_no", "probe").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy("probe").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("seen", F.coalesce(F.sum("n").over(w), F.lit(0))).where("seen < 80").drop("seen")


@register("assign_label_centroid", f"WITH {CENTROIDS} SELECT id, arg_min(list_no, (distance, list_no)) AS list_no FROM (SELECT id, list_no, {L2E} AS distance FROM (SELECT e.id, c.list_no, e.v AS a, c.v AS b FROM e, c)) GROUP BY id")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", V.doubles("embedding").alias("v"))
    return search.assign(rows, search.centroids_of(rows, "label")).select("id", "list_no")


@register("residual_to_centroid", f"WITH {CENTROIDS} SELECT id, CAST(pos - 1 AS BIGINT) AS pos, round(e.v[pos] - c.v[pos], 6) + 0.0 AS x FROM e JOIN c ON c.list_no = e.label, range(1, 65) t(pos)")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", V.doubles("embedding").alias("v"))
    c = search.centroids_of(rows, "label").select(F.col("list_no").alias("label"), F.col("v").alias("c"))
    return rows.join(F.broadcast(c), "label").select("id", F.posexplode(F.zip_with("v", "c", lambda x, y: F.round(x - y, 6) + 0.0)).alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))


# ---- scalar, sign and product codes
RANGES = "r AS (SELECT pos, min(x) AS lo, max(x) - min(x) AS width FROM u GROUP BY pos)"


@register("sq8_train", f"WITH {E_}, {U_}, {RANGES} SELECT pos, round(lo, 9) AS lo, round(width, 9) AS width FROM r")
def _(spark, d):
    return unpacked(spark, d).groupBy("pos").agg(F.round(F.min("x"), 9).alias("lo"), F.round(F.max("x") - F.min("x"), 9).alias("width"))


def bounds(rows: DataFrame) -> DataFrame:
    """(low, width): one row of arrays, from one row a position."""
    one = rows.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("lo"), (F.max("x") - F.min("x")).alias("width"))
    ordered = one.agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "width"))).alias("b"))  # a row for each dimension
    return ordered.select(F.transform("b", lambda x: x["lo"]).alias("low"), F.transform("b", lambda x: x["width"]).alias("width"))


def scalar_codes(rows: DataFrame, levels: int) -> DataFrame:
    """(id, codes, low, width); the bounds are one row, sent to all tasks."""
    code = F.transform("v", lambda x, i: V.scalar_code(x, F.get("low", i), F.get("width", i), levels))
    return rows.crossJoin(F.broadcast(bounds(rows))).select("id", code.alias("codes"), "low", "width")


for _bits in (4, 6, 8):

    @register(f"sq{_bits}_encode", f"WITH {E_}, {U_}, {RANGES} SELECT id, pos, CAST(floor(greatest(0.0, least(1.0, (x - lo) / width)) * {2**_bits - 1}) AS INTEGER) AS code FROM u JOIN r USING (pos)")
    def _(spark, d, levels=2**_bits - 1):
        return scalar_codes(base(spark, d), levels).select("id", F.posexplode("codes").alias("pos", "code")).withColumn("pos", F.col("pos").cast("long"))


SQ_KNN = {b: f"WITH {E_}, {U_}, {RANGES}, k AS (SELECT id, list((floor(greatest(0.0, least(1.0, (x - lo) / width)) * {2**b - 1}) + 0.5) / {2**b - 1} * width + lo ORDER BY pos) AS v FROM u JOIN r USING (pos) GROUP BY id), d AS (SELECT query_id, id, {L2E} AS distance FROM (SELECT q.id AS query_id, k.id, q.v AS a, k.v AS b FROM e q, k WHERE q.id % 20 = 0)) {ranked_sql(False, 10)}" for b in (4, 6, 8)}


@register("sq8_decode_knn", SQ_KNN[8])
def _(spark, d):
    rows = base(spark, d)
    decoded = F.transform("codes", lambda c, i: (c + 0.5) / 255 * F.get("width", i) + F.get("low", i))
    return rounded(search.knn(asked(rows), scalar_codes(rows, 255).select("id", decoded.alias("v")), 10, "l2"))


def bits_sql(lo: int) -> str:
    return f"CAST(list_sum(list_transform(range({lo}, {lo + 32}), lambda i: CASE WHEN v[i + 1] >= 0 THEN CAST(1 AS BIGINT) << (i - {lo}) ELSE 0 END)) AS BIGINT)"


@register("lsh_code", f"WITH {E_} SELECT id, {bits_sql(0)} AS low, {bits_sql(32)} AS high FROM e")
def _(spark, d):
    return base(spark, d).select("id", V.sign_bits(F.col("v"), 0, 32).alias("low"), V.sign_bits(F.col("v"), 32, 64).alias("high"))


LSH_KNN = f"WITH {E_}, c AS (SELECT id, {bits_sql(0)} AS low, {bits_sql(32)} AS high FROM e), d AS (SELECT q.id AS query_id, c.id, CAST(bit_count(xor(q.low, c.low)) + bit_count(xor(q.high, c.high)) AS DOUBLE) AS distance FROM c q, c WHERE q.id % 20 = 0) {ranked_sql(False, 10)}"


@register("lsh_knn", LSH_KNN)
def _(spark, d):
    rows = base(spark, d)
    found = scan.all_blocks(rows, asked(rows), lambda ids, q: scan.nearest(rows, lambda b: scan.hamming(scan.vectors_of(b.column("v")) >= 0, q >= 0), ids, 10, False))
    return scan.ranked(found, 10, False)


@register("lsh_median_thresholds", f"WITH {E_}, {U_} SELECT pos, round(median(x), 9) AS threshold FROM u GROUP BY pos")
def _(spark, d):
    return unpacked(spark, d).groupBy("pos").agg(F.round(F.percentile("x", F.lit(0.5)), 9).alias("threshold"))


# product codes of 8 parts of 8 dimensions; the code book is the parts of the 16 vectors of least id
BOOK = "b AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS code, v FROM e ORDER BY id LIMIT 16)"
PART_L2 = "list_sum(list_transform(range(m * 8 + 1, m * 8 + 9), lambda i: (a[i]-b[i])*(a[i]-b[i])))"
CODES = f"{E_}, {BOOK}, k AS (SELECT id, m, arg_min(code, (distance, code)) AS code FROM (SELECT id, m, code, {PART_L2} AS distance FROM (SELECT e.id, m, b.code, e.v AS a, b.v AS b FROM e, b, range(0, 8) t(m))) GROUP BY 1, 2)"


def product_book(rows: DataFrame) -> codecs.Model:
    """The parts of the 16 vectors of least id."""
    first = np.array([r.v for r in rows.orderBy("id").limit(16).collect()], float)
    return {f"book{m}": first[:, 8 * m : 8 * m + 8] for m in range(8)}


@register("pq_encode_given_codebook", f"WITH {CODES} SELECT id, CAST(m AS BIGINT) AS m, code FROM k")
def _(spark, d):
    rows = base(spark, d)
    numbers = codecs.numbered(parse("PQ8x4", 64).code, product_book(rows))("v")
    return rows.select("id", F.posexplode(numbers).alias("m", "code")).withColumn("m", F.col("m").cast("long"))


PQ_KNN = f"WITH {CODES}, lut AS (SELECT query_id, m, code, {PART_L2} AS part FROM (SELECT q.id AS query_id, m, b.code, q.v AS a, b.v AS b FROM e q, b, range(0, 8) t(m) WHERE q.id % 20 = 0)), d AS (SELECT query_id, id, round(sum(part), 9) AS distance FROM lut JOIN k USING (m, code) GROUP BY 1, 2) {ranked_sql(False, 10)}"


@register("pq_adc_knn", PQ_KNN)
def _(spark, d):
    rows, code = base(spark, d), parse("PQ8x4", 64).code
    book = product_book(rows)
    coded = rows.select("id", codecs.encoder(code, book)("v").alias("code"))

    def of_block(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        tables = codecs.split_tables(q, book, code, False)
        return scan.nearest(coded, lambda b: codecs.looked_up(tables, codecs.numbers_of(scan.codes_of(b.column("code")), code)).round(9), ids, 10, False)

    return rounded(scan.ranked(scan.all_blocks(coded, asked(rows), of_block), 10, False))


@register("kmeans_one_step", f"WITH {E_}, {BOOK}, s AS (SELECT id, arg_min(code, (distance, code)) AS cluster FROM (SELECT id, code, {L2E} AS distance FROM (SELECT e.id, b.code, e.v AS a, b.v AS b FROM e, b)) GROUP BY id), {U_} SELECT cluster, pos, round(avg(x), 6) AS x FROM u JOIN s USING (id) GROUP BY 1, 2")
def _(spark, d):
    rows = base(spark, d)
    seeds = rows.orderBy("id").limit(16).withColumn("list_no", F.row_number().over(Window.orderBy("id")) - 1)
    own = search.assign(rows, seeds).select("id", F.col("list_no").alias("cluster"))
    return unpacked(spark, d).join(own, "id").groupBy("cluster", "pos").agg(F.round(F.avg("x"), 6).alias("x"))


@register("rabitq_encode", f"WITH {E_}, {U_}, m AS (SELECT pos, round(avg(x), 9) AS c FROM u GROUP BY pos) SELECT id, CAST(count(*) FILTER (WHERE x - c > 0) AS BIGINT) AS ones, round(sum((x - c) * (x - c)), 6) AS norm2, round(sum((x - c) * (x - c)) / nullif(sum(abs(x - c)), 0), 6) AS factor FROM u JOIN m USING (pos) GROUP BY id")
def _(spark, d):
    u = unpacked(spark, d)
    m = u.groupBy("pos").agg(F.round(F.avg("x"), 9).alias("c"))
    z = u.join(F.broadcast(m), "pos").withColumn("z", F.col("x") - F.col("c"))
    return z.groupBy("id").agg(F.count_if(F.col("z") > 0).alias("ones"), F.round(F.sum(F.col("z") * F.col("z")), 6).alias("norm2"), F.round(F.sum(F.col("z") * F.col("z")) / F.nullif(F.sum(F.abs("z")), F.lit(0.0)), 6).alias("factor"))


# ---- texts
DOCS = "(SELECT doc_id, text FROM documents)"
MARK = text.MARK


@register("normalize_spaces", f"SELECT doc_id, md5(CASE WHEN trim(text, ' ') = '' THEN '' ELSE '{MARK}' || regexp_replace(trim(text, ' '), ' +', '{MARK}', 'g') END) AS digest FROM {DOCS}")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_spaces(F.col("text")).cast("binary")).alias("digest"))


@register("piece_encode_word", f"SELECT doc_id, CAST(len(p) AS INTEGER) AS n, md5(array_to_string(p, ' ')) AS digest FROM (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(trim(text, ' '), ' +'), lambda w: w <> ''), lambda w: '{MARK}' || w) AS p FROM {DOCS})")
def _(spark, d):
    p = table(spark, d, "documents").select("doc_id", text.word_pieces(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", " ").cast("binary")).alias("digest"))


@register("piece_decode", f"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(trim(text, ' '), ' +'), lambda w: w <> ''), ' ')) AS digest FROM {DOCS}")
def _(spark, d):
    p = table(spark, d, "documents").select("doc_id", text.word_pieces(F.col("text")).alias("p"))
    return p.select("doc_id", F.md5(text.decode_pieces(F.col("p")).cast("binary")).alias("digest"))


@register("train_word_vocab", f"WITH w AS (SELECT unnest(string_split(text, ' ')) AS piece FROM {DOCS}), c AS (SELECT piece, count(*) AS freq FROM w WHERE piece <> '' GROUP BY 1) SELECT piece, freq, round(ln(freq) - ln((SELECT sum(freq) FROM c)), 6) AS score FROM c ORDER BY freq DESC, piece LIMIT 500")
def _(spark, d):
    return text.word_vocabulary(table(spark, d, "documents"), 500)


CHARS = f"c AS (SELECT c, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM {DOCS}) GROUP BY 1)"


@register("train_char_vocab", f"WITH {CHARS} SELECT c, freq FROM c")
def _(spark, d):
    return text.char_counts(table(spark, d, "documents"))


@register("char_coverage", f"WITH {CHARS}, g AS (SELECT freq, count(*) AS k FROM c GROUP BY 1), b AS (SELECT freq, coalesce(sum(freq * k) OVER (ORDER BY freq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT c, freq FROM c JOIN b USING (freq) WHERE before < (SELECT sum(freq) FROM c) * 0.995")
def _(spark, d):
    return text.char_coverage(text.char_counts(table(spark, d, "documents")), 0.995)


@register("bpe_pair_counts", f"WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM {DOCS}) WHERE length(w) > 1 GROUP BY 1) SELECT substr(w, i, 1) AS a, substr(w, i + 1, 1) AS b, CAST(sum(n) AS BIGINT) AS freq FROM (SELECT w, n, unnest(range(1, length(w))) AS i FROM w) GROUP BY 1, 2")
def _(spark, d):
    return text.pair_counts(table(spark, d, "documents"))


@register("ngram_next_token", f"WITH w AS (SELECT string_split(text, ' ') AS w FROM {DOCS}) SELECT w[i + 1] || ' ' || w[i + 2] AS gram, w[i + 3] AS next, count(*) AS freq FROM (SELECT w, unnest(range(0, len(w) - 2)) AS i FROM w WHERE len(w) > 2) GROUP BY 1, 2")
def _(spark, d):
    return text.next_words(table(spark, d, "documents"), 2)


@register("token_windows", f'WITH n AS (SELECT doc_id, len(string_split(text, \' \')) AS n FROM {DOCS}) SELECT doc_id, CAST(s // 56 AS INTEGER) AS "window", CAST(s AS INTEGER) AS start, CAST(least(64, n - s) AS INTEGER) AS n FROM (SELECT doc_id, n, unnest(range(0, n, 56)) AS s FROM n)')
def _(spark, d):
    return text.token_windows(table(spark, d, "documents").select("doc_id", F.size(F.split("text", " ")).alias("n_tokens")), 64)


def filled_sql(form: str) -> str:
    return "'" + form.replace("'", "''").replace("{role}", "' || role || '").replace("{Role}", "' || upper(substr(role, 1, 1)) || substr(role, 2) || '").replace("{ROLE}", "' || upper(role) || '").replace("{text}", "' || text || '").replace("{trim}", f"' || trim(text, '{chat.BLANKS}') || '").replace("{open}", "' || opens || '").replace("{pending}", "' || pending || '") + "'"


def chat_sql(message: str, opening: str, start: str = "") -> str:
    return f"SELECT conv_id, '{start}' || string_agg(m, '' ORDER BY turn) || '{opening}' AS prompt FROM (SELECT conv_id, turn, {message} AS m FROM conversations) GROUP BY conv_id"


for _name, (_form, _opening) in chat.TEMPLATES.items():

    @register(f"chat_{_name}", chat_sql(filled_sql(_form), _opening))
    def _(spark, d, name=_name):
        return chat.prompts(table(spark, d, "conversations"), name)


for _name, (_start, _forms, _opening) in chat.BY_ROLE.items():
    _case = "CASE WHEN false THEN '' " + " ".join(f"WHEN role = '{r}' THEN {filled_sql(x)}" for r, x in _forms.items() if r != "*") + f" ELSE {filled_sql(_forms.get('*', ''))} END"

    @register(f"chat_{_name}", chat_sql(_case, _opening, _start))
    def _(spark, d, name=_name):
        return chat.prompts(table(spark, d, "conversations"), name)


#: Formats whose prompts themselves hold the marks of their templates.
MARKED = ["chatml", "phi4", "gemma", "openchat", "command_r", "llama3", "minicpm", "granite", "megrez", "llama4", "kimi_k2", "seed_oss"]


@register("chat_detect", " UNION ALL ".join(f"SELECT '{n}' AS format, '{n}' AS detected, count(DISTINCT conv_id) AS n FROM conversations" for n in MARKED))
def _(spark, d):
    made = [chat.prompts(table(spark, d, "conversations"), n).select(F.lit(n).alias("format"), chat.detected(F.col("prompt")).alias("detected")) for n in MARKED]
    rows = made[0]
    for m in made[1:]:
        rows = rows.unionByName(m)
    return rows.groupBy("format", "detected").agg(F.count("*").alias("n"))


def placed_sql(start: str, turns: tuple[str, str], forms: dict[str, str], opening: str) -> str:
    """The prompts of a format whose messages depend on their place; the roles of the table are user, system, assistant."""
    whole = sorted({r.partition("@")[0] for r in forms} - {"*"})
    rest = "role NOT IN (" + ", ".join(f"'{r}'" for r in whole) + ")" if whole else "true"
    at = {"": "", "first": " AND place = 1", "last": " AND after IS NULL"}
    named = {k: (rest if k.partition("@")[0] == "*" else f"role = '{k.partition('@')[0]}'") for k in forms}
    takes = " OR ".join(named[k] for k, f in forms.items() if "{pending}" in f) or "false"
    case = "CASE " + " ".join(f"WHEN {named[k]}{at[k.partition('@')[2]]} THEN {filled_sql(f)}" for k, f in forms.items()) + " ELSE '' END"
    own = f"trim(text, '{chat.BLANKS}')" if "{trim}" in "".join(forms.values()) else "text"
    w = "OVER (PARTITION BY conv_id ORDER BY turn"
    return f"""WITH a AS (SELECT *, row_number() {w}) AS place, lag(role) {w}) AS before, lead(turn) {w}) AS after, coalesce(sum(CASE WHEN {takes} THEN 1 ELSE 0 END) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM conversations),
    b AS (SELECT *, coalesce(string_agg(CASE WHEN role = 'system' THEN {own} END, '') OVER (PARTITION BY conv_id, taken ORDER BY turn ROWS UNBOUNDED PRECEDING), '') AS sys FROM a),
    c AS (SELECT *, CASE WHEN sys <> '' THEN sys || '\n\n' ELSE '' END AS pending, CASE WHEN place = 1 THEN '{turns[0]}' WHEN before IN ('user', 'system') THEN '' ELSE '{turns[1]}' END AS opens FROM b)
    SELECT conv_id, '{start}' || string_agg({case}, '' ORDER BY turn) || '{opening}' AS prompt FROM c GROUP BY conv_id"""


for _name, _rules in chat.BY_PLACE.items():

    @register(f"chat_{_name}", placed_sql(*_rules))
    def _(spark, d, name=_name):
        return chat.prompts(table(spark, d, "conversations"), name)


# ---- samplers: a step is a vector, a token a component, its logit ten times the component
LOGITS = "l AS (SELECT vec_id AS step, CAST(pos - 1 AS BIGINT) AS token, CAST(embedding[pos] AS DOUBLE) * 10 AS logit FROM embeddings, range(1, 65) t(pos))"
SOFT = "s AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY step)) / sum(exp(logit - m)) OVER (PARTITION BY step) AS p FROM (SELECT *, max(logit) OVER (PARTITION BY step) AS m FROM l))"


def logits(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("step"), F.posexplode(V.doubles("embedding")).alias("token", "x")).select("step", F.col("token").cast("long").alias("token"), (F.col("x") * 10).alias("logit"))


def sampler(name: str, oracle: str):
    def keep(f):
        @register(name, oracle)
        def _(spark, d):
            out = f(logits(spark, d))
            return out.select("step", "token", F.round("logit", 6).alias("logit"), *([F.round("p", 6).alias("p")] if "p" in out.columns else []))

    return keep


OUT = "step, token, round(logit, 6) AS logit"
sampler("softmax", f"WITH {LOGITS}, {SOFT} SELECT {OUT}, round(p, 6) AS p FROM s")(sampling.softmax)
sampler("temperature", f"WITH {LOGITS} SELECT step, token, round(logit / 0.7, 6) AS logit FROM l")(lambda x: sampling.temperature(x, 0.7))
sampler("top_k", f"WITH {LOGITS} SELECT {OUT} FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY logit DESC, token) AS r FROM l) WHERE r <= 8")(lambda x: sampling.top_k(x, 8))
sampler("top_p", f"WITH {LOGITS}, {SOFT} SELECT {OUT} FROM (SELECT *, round(sum(p) OVER (PARTITION BY step ORDER BY logit DESC, token ROWS UNBOUNDED PRECEDING) - p, 12) AS b FROM s) WHERE b < 0.8")(lambda x: sampling.top_p(x, 0.8))
sampler("min_p", f"WITH {LOGITS} SELECT {OUT} FROM (SELECT *, max(logit) OVER (PARTITION BY step) AS m FROM l) WHERE logit >= m + ln(0.2)")(lambda x: sampling.min_p(x, 0.2))
sampler("typical", f"WITH {LOGITS}, {SOFT}, h AS (SELECT *, sum(-p * ln(p)) OVER (PARTITION BY step) AS h FROM s), o AS (SELECT *, round(abs(-ln(p) - h), 9) AS off FROM h) SELECT {OUT} FROM (SELECT *, round(sum(p) OVER (PARTITION BY step ORDER BY off, token ROWS UNBOUNDED PRECEDING) - p, 9) AS b FROM o) WHERE b <= 0.5")(lambda x: sampling.typical(x, 0.5))
sampler("top_n_sigma", f"WITH {LOGITS} SELECT {OUT} FROM (SELECT *, max(logit) OVER (PARTITION BY step) - 1.0 * stddev_pop(logit) OVER (PARTITION BY step) AS cut FROM l) WHERE round(logit, 9) >= round(cut, 9)")(lambda x: sampling.top_n_sigma(x, 1.0))
sampler("xtc", f"WITH {LOGITS}, {SOFT} SELECT {OUT} FROM (SELECT *, count(*) FILTER (WHERE p >= 0.05) OVER (PARTITION BY step) AS n, row_number() OVER (PARTITION BY step ORDER BY logit DESC, token) AS r FROM s) WHERE n < 2 OR r >= n")(lambda x: sampling.xtc(x, 0.05))


@register("penalties", f"WITH {LOGITS} SELECT step, token, round(CASE WHEN token % 5 = 0 THEN (CASE WHEN logit > 0 THEN logit / 1.1 ELSE logit * 1.1 END) - (token % 3 + 1) * 0.2 - 0.1 ELSE logit END, 6) AS logit FROM l")
def _(spark, d):
    x = logits(spark, d)
    counts = x.where("token % 5 = 0").select("step", "token", (F.col("token") % 3 + 1).alias("n"))
    return sampling.penalties(x, counts, 1.1, 0.2, 0.1).select("step", "token", F.round("logit", 6).alias("logit"))


@register("greedy", f"WITH {LOGITS} SELECT step, arg_max(token, (logit, -token)) AS token FROM l GROUP BY step")
def _(spark, d):
    return sampling.temperature(logits(spark, d), 0).select("step", "token")


@register("dist_draw", f"WITH {LOGITS}, {SOFT}, c AS (SELECT step, token, sum(p) OVER (PARTITION BY step ORDER BY logit DESC, token ROWS UNBOUNDED PRECEDING) AS c FROM s) SELECT step, arg_min(token, (c, token)) AS token FROM c WHERE c >= 0.5 GROUP BY step")
def _(spark, d):
    return sampling.draw(logits(spark, d), 0.5)


@register("logit_bias", f"WITH {LOGITS} SELECT step, token, round(logit + CASE token WHEN 3 THEN 1.5 WHEN 7 THEN -2.0 ELSE 0.0 END, 6) AS logit FROM l")
def _(spark, d):
    return sampling.logit_bias(logits(spark, d), {3: 1.5, 7: -2.0}).select("step", "token", F.round("logit", 6).alias("logit"))


sampler("dynamic_temperature", f"WITH {LOGITS}, {SOFT}, h AS (SELECT *, sum(-p * ln(p)) OVER (PARTITION BY step) / ln(64) AS h FROM s) SELECT step, token, round(logit / (0.3 + 1.0 * pow(h, 1.5)), 6) AS logit FROM h")(lambda x: sampling.dynamic_temperature(x, 0.8, 0.5, 1.5))
sampler("mirostat_v2", f"WITH {LOGITS}, {SOFT} SELECT {OUT} FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY logit DESC, token) AS r FROM s) WHERE round(-log2(p), 9) <= 5.0 OR r = 1")(lambda x: sampling.mirostat_v2(x, 5.0))
sampler("mirostat", f"WITH {LOGITS}, {SOFT}, r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY logit DESC, token) AS r, lead(p) OVER (PARTITION BY step ORDER BY logit DESC, token) AS n FROM s), k AS (SELECT step, sum(ln((r + 1.0) / r) * ln(p / n)) / sum(ln((r + 1.0) / r) * ln((r + 1.0) / r)) AS s FROM r WHERE r < 20 AND n IS NOT NULL GROUP BY step) SELECT {OUT} FROM r JOIN k USING (step) WHERE r <= greatest(1, coalesce(floor(pow((s - 1) * pow(2, 4.0) / nullif(1 - pow(64, 1 - s), 0), 1 / s)), 1))")(lambda x: sampling.mirostat(x, 4.0, 64, 20))


@register("dry_penalty", f"WITH {LOGITS} SELECT step, token, round(logit - CASE WHEN token = 2 THEN 0.8 * pow(1.75, 3 - 2) WHEN token = 5 THEN 0.8 * pow(1.75, 2 - 2) ELSE 0 END, 6) AS logit FROM l")
def _(spark, d):
    x = logits(spark, d)  # every step follows 7 0 1 2 9 0 1 5 7 0 1: 7 0 1 came before 2, 0 1 before 5
    histories = x.select("step").distinct().withColumn("history", F.array(*(F.lit(t) for t in (7, 0, 1, 2, 9, 0, 1, 5, 7, 0, 1))))
    return sampling.dry(x, histories, 0.8, 1.75, 2).select("step", "token", F.round("logit", 6).alias("logit"))


@register("n_ctx_autosize", "SELECT p_partkey, CAST(least(floor(p_retailprice * 1000000 / floor(32 * (8 * 128 * (1.125 + 2.0)))), 4294967295) AS BIGINT) AS n_ctx FROM part")
def _(spark, d):
    size = sampling.context_size(F.col("p_retailprice") * 1000000, F.lit(32), F.lit(4096), F.lit(32), F.lit(8), "q8_0", "f16")
    return table(spark, d, "part").select("p_partkey", size.alias("n_ctx"))


@register("context_shift", "SELECT event_id, CASE WHEN event_id % 600 + 1 >= 512 AND event_id % 600 > 64 THEN (event_id % 600 - 64) // 2 ELSE 0 END AS gone FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", sampling.context_shift(F.col("event_id") % 600, F.lit(64), F.lit(512)).alias("gone"))


# ---- ranges, pooling, packing of vectors
@register("range_topn_cap", f"{pairs_sql('l2')} SELECT query_id, id, round(distance, 6) AS distance FROM d WHERE distance < (SELECT max(distance) FROM (SELECT distance FROM d ORDER BY distance LIMIT 201))")
def _(spark, d):
    return rounded(search.capped_within(asked(base(spark, d)), base(spark, d), 200, "l2"))


@register("threshold_radius", f"{pairs_sql('l2')}, t AS ({ranked_sql(False, 10)}) SELECT * FROM t WHERE distance < 1.5")
def _(spark, d):
    return rounded(search.knn(asked(base(spark, d)), base(spark, d), 10, "l2")).where("distance < 1.5")


@register("range_pr", f"{pairs_sql('l2')} SELECT count(*) FILTER (WHERE distance < 1.2 AND id % 3 <> 0) / count(*) FILTER (WHERE distance < 1.4 AND id % 3 <> 0) AS precision, count(*) FILTER (WHERE distance < 1.2 AND id % 3 <> 0) / count(*) FILTER (WHERE distance < 1.2) AS recall FROM d")
def _(spark, d):
    q, rows = asked(base(spark, d)), base(spark, d)
    return search.range_scores(search.within(q, rows, 1.2), search.within(q, rows.where("id % 3 <> 0"), 1.4))


for _mode, _size in {"none": "1.0", "maxabs": "list_max(list_transform(a, lambda x: abs(x))) / 32760.0", "l2": NORM, "p3": f"pow({total('pow(abs(a[i]), 3)')}, 1.0 / 3)"}.items():

    @register(f"embd_normalize_{_mode}", f"WITH {E_}, n AS (SELECT id, a, {_size} AS s FROM (SELECT id, v AS a FROM e)) SELECT id, CAST(pos - 1 AS BIGINT) AS pos, round(a[pos] / s, 4) AS x FROM n, range(1, 65) t(pos)")
    def _(spark, d, mode={"none": -1, "maxabs": 0, "l2": 2, "p3": 3}[_mode]):
        out = base(spark, d).select("id", F.posexplode(V.scaled(F.col("v"), mode)).alias("pos", "x"))
        return out.select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 4).alias("x"))


for _mode, _sql in {"mean": "avg(x)", "cls": "arg_min(x, id)", "last": "arg_max(x, id)"}.items():

    @register(f"pool_{_mode}", f"WITH {E_}, {U_} SELECT label AS doc_id, pos, round({_sql}, 6) AS x FROM u GROUP BY 1, 2")
    def _(spark, d, mode=_mode):
        rows = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), V.doubles("embedding").alias("v"))
        return search.pooled(rows, mode).select("doc_id", F.posexplode("v").alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register("window_avg_vec", f"WITH {E_}, {U_}, n AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS y FROM u), m AS (SELECT id // 7 AS doc_id, pos, avg(y) AS x FROM n GROUP BY 1, 2) SELECT doc_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM m")
def _(spark, d):
    rows = base(spark, d).select(F.expr("id div 7").alias("doc_id"), "v")
    return search.window_average(rows).select("doc_id", F.posexplode("v").alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


HALF = "CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END"  # of a 16-bit float; x is finite and not large


@register("fp16_roundtrip", f"WITH {E_} SELECT id, CAST(pos - 1 AS BIGINT) AS pos, CAST(128 AS INTEGER) AS n_bytes, round({HALF}, 9) AS x FROM (SELECT id, pos, v[pos] AS x FROM e, range(1, 65) t(pos))")
def _(spark, d):
    packed = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.packer(half=True)("embedding").alias("code"))
    out = packed.select("id", F.length("code").alias("n_bytes"), F.posexplode(V.unpacker(half=True)("code")).alias("pos", "x"))
    return out.select("id", F.col("pos").cast("long").alias("pos"), "n_bytes", F.round(F.col("x").cast("double"), 9).alias("x"))


@register("fp32_roundtrip", f"WITH {E_} SELECT id, CAST(pos - 1 AS BIGINT) AS pos, round(v[pos], 9) AS x FROM e, range(1, 65) t(pos)")
def _(spark, d):
    packed = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.packer()("embedding").alias("code"))
    out = packed.select("id", F.posexplode(V.unpacker()("code")).alias("pos", "x"))
    return out.select("id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 9).alias("x"))


# ---- pieces of a vocabulary
def encoded(spark, d, encode) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", pieces.over_batches(encode)(text.normalize_spaces(F.col("text"))).alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", " ").cast("binary")).alias("digest"))


def word_scores(spark, d) -> dict[str, float]:
    """The 500 most frequent words, marked, as a vocabulary."""
    return {text.MARK + r.piece: r.score for r in text.word_vocabulary(table(spark, d, "documents"), 500).collect()}


@register("piece_encode_char", f"SELECT doc_id, CAST(length(t) AS INTEGER) AS n, md5(array_to_string(string_split(t, ''), ' ')) AS digest FROM (SELECT doc_id, CASE WHEN trim(text, ' ') = '' THEN '' ELSE '{MARK}' || regexp_replace(trim(text, ' '), ' +', '{MARK}', 'g') END AS t FROM {DOCS})")
def _(spark, d):
    return encoded(spark, d, list)


MERGES = 12


def merges_sql() -> str:
    """The merges in turn; a word is a text of its symbols, each between blanks."""
    out = ["w0 AS MATERIALIZED (SELECT ' ' || array_to_string(string_split(w, ''), '  ') || ' ' AS s, n FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE length(w) > 1 GROUP BY w))"]
    for i in range(MERGES):
        out.append(f"p{i} AS (SELECT l[k] AS a, l[k + 1] AS b, sum(n) AS n FROM (SELECT l, n, unnest(range(1, len(l))) AS k FROM (SELECT string_split(trim(s, ' '), '  ') AS l, n FROM w{i})) GROUP BY 1, 2)")
        out.append(f"b{i} AS MATERIALIZED (SELECT a, b FROM p{i} ORDER BY n DESC, length(a || b), a || b, a LIMIT 1)")
        out.append(f"w{i + 1} AS MATERIALIZED (SELECT replace(s, ' ' || a || '  ' || b || ' ', ' ' || a || b || ' ') AS s, n FROM w{i}, b{i})")
    return ", ".join(out) + ", m AS (" + " UNION ALL ".join(f"SELECT a || b AS piece, {-float(i)} AS score FROM b{i}" for i in range(MERGES)) + ")"


def merged_sql() -> str:
    """Texts of symbols, joined piece by piece in the order of their scores, however a piece is split."""
    steps = []
    for i in range(MERGES):
        steps.append(f"t{i + 1} AS MATERIALIZED (SELECT doc_id, list_reduce(list_prepend(s, list_transform(range(1, length(p)), lambda k: ' ' || substr(p, 1, k) || '  ' || substr(p, k + 1) || ' ')), lambda x, y: replace(x, y, ' ' || p || ' ')) AS s FROM t{i}, (SELECT a || b AS p FROM b{i}))")
    return ", ".join(steps)


NORMAL = f"SELECT doc_id, CASE WHEN trim(text, ' ') = '' THEN '' ELSE '{MARK}' || regexp_replace(trim(text, ' '), ' +', '{MARK}', 'g') END AS t FROM {DOCS}"


@register("bpe_train", f"WITH {merges_sql()} SELECT piece, score FROM m")
def _(spark, d):
    return spark.createDataFrame(list(pieces.train_merges(table(spark, d, "documents"), MERGES).items()), "piece string, score double")


@register("bpe_encode", f"WITH {merges_sql()}, t0 AS MATERIALIZED (SELECT doc_id, ' ' || array_to_string(string_split(t, ''), '  ') || ' ' AS s FROM ({NORMAL}) WHERE t <> ''), {merged_sql()} SELECT doc_id, CAST(len(string_split(trim(s, ' '), '  ')) AS INTEGER) AS n, md5(replace(trim(s, ' '), '  ', ' ')) AS digest FROM t{MERGES}")
def _(spark, d):
    return encoded(spark, d, pieces.pair_merger(pieces.train_merges(table(spark, d, "documents"), MERGES))).where("n > 0")


VOCABULARY = "v AS MATERIALIZED (SELECT piece FROM (SELECT unnest(string_split(text, ' ')) AS piece, count(*) AS n FROM documents GROUP BY 1) WHERE piece <> '' ORDER BY n DESC, piece LIMIT 500)"


# a word's longest beginning in the vocabulary is a piece; what follows up to the next such beginning is one unknown piece
@register("unigram_encode", f"WITH {VOCABULARY}, w AS (SELECT doc_id, w[i] AS w, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents))), b AS MATERIALIZED (SELECT w, coalesce(max_by(piece, length(piece)), '') AS p FROM (SELECT DISTINCT w FROM w) LEFT JOIN v ON starts_with(w, piece) GROUP BY w), s AS (SELECT doc_id, i, CASE WHEN p = '' THEN NULL ELSE '{MARK}' || p END AS known, CASE WHEN p = '' THEN '{MARK}' || w ELSE substr(w, length(p) + 1) END AS rest FROM w JOIN b USING (w)), r AS (SELECT *, sum(CASE WHEN known IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM s), g AS (SELECT doc_id, run, max(known) AS known, string_agg(rest, '' ORDER BY i) AS rest FROM r GROUP BY doc_id, run) SELECT doc_id, CAST(sum((known IS NOT NULL)::INT + (rest <> '')::INT) AS INTEGER) AS n, md5(string_agg(concat_ws(' ', known, nullif(rest, '')), ' ' ORDER BY run)) AS digest FROM g GROUP BY doc_id")
def _(spark, d):
    return encoded(spark, d, pieces.best_path(word_scores(spark, d))).where("n > 0")


_APART = r"\p{P}$+<=>^`|~"


@register("wpm_encode", f"WITH {VOCABULARY}, t AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[{_APART}]|[^\\s{_APART}]+') AS t FROM {DOCS}), x AS (SELECT doc_id, list_transform(t, lambda x: CASE WHEN list_contains(known, x) THEN '{MARK}' || x ELSE '[UNK]' END) AS p FROM t, (SELECT list(piece) AS known FROM v)) SELECT doc_id, CAST(len(p) AS INTEGER) AS n, md5(array_to_string(p, ' ')) AS digest FROM x WHERE len(p) > 0")
def _(spark, d):
    p = table(spark, d, "documents").select("doc_id", pieces.over_batches(pieces.word_parts(set(word_scores(spark, d))))("text").alias("p"))
    return p.where("size(p) > 0").select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", " ").cast("binary")).alias("digest"))


CHUNKS = """WITH p AS (SELECT doc_id, text, string_split(text, '. ') AS p FROM documents), r AS (SELECT doc_id, list_reduce(list_prepend('', list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i < len(p) THEN '. ' || chr(2) ELSE '' END)),
  lambda acc, x: acc || replace(x, chr(2), '') || CASE WHEN contains(x, chr(2)) AND length(string_split(acc, chr(1))[-1]) + length(x) - 1 > 200 THEN chr(1) ELSE '' END) AS t FROM p WHERE text <> ''),
q AS (SELECT doc_id, string_split(t, chr(1)) AS q FROM r), c AS (SELECT doc_id, CASE WHEN len(q) = 1 THEN q ELSE list_append(q[1 : len(q) - 2], q[len(q) - 1] || q[len(q)]) END AS c FROM q)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk, CAST(length(c[i]) AS INTEGER) AS n_chars, md5(c[i]) AS digest FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)"""


@register("chunk_by_separator", CHUNKS)
def _(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(pieces.over_batches(pieces.chunks(". ", 200))("text")).alias("chunk", "t"))
    return c.select("doc_id", "chunk", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


# ---- the index as a whole: kinds that lose nothing equal exact search, the others are tested for recall
EXACT_KINDS = {"index_flat": "Flat", "index_ivf_all_lists": "IVF8,Flat", "index_hnsw": "IDMap,HNSW32,Flat", "index_nsg": "NSG32", "index_rotated": "Pad80,RR80,Flat", "index_dedup": "IVF4,FlatDedup", "index_imi": "IMI2x2,Flat", "index_coarse_graph": "IVF8_HNSW16,Flat", "index_opq": "OPQ16,Flat,RFlat", "index_itq": "ITQ,Flat,RFlat", "index_pca": "PCAR64,Flat,RFlat"}
#: Kinds that lose something, with what SQL makes of the same training.
CODED_KINDS = {
    "index_sq8": ("SQ8", SQ_KNN[8]), "index_sq6": ("SQ6", SQ_KNN[6]), "index_sq4": ("SQ4", SQ_KNN[4]), "index_lsh": ("LSH", LSH_KNN),
    "index_lsh_thresholds": ("LSH64t", LSH_KNN.replace("FROM e)", "FROM (SELECT id, list_transform(range(1, 65), lambda i: v[i] - t[i]) AS v FROM e, (SELECT list(m ORDER BY pos) AS t FROM (SELECT pos, median(v[pos]) AS m FROM e, range(1, 65) t(pos) GROUP BY pos))))")),
    "index_sqfp16": ("SQfp16", f"WITH {E_}, h AS (SELECT id, list({HALF} ORDER BY pos) AS v FROM (SELECT id, pos, v[pos] AS x FROM e, range(1, 65) t(pos)) GROUP BY id), d AS (SELECT query_id, id, {L2E} AS distance FROM (SELECT q.id AS query_id, h.id, q.v AS a, h.v AS b FROM e q, h WHERE q.id % 20 = 0)) {ranked_sql(False, 10)}"),
    "index_rabitq": ("RaBitQ", f"WITH {E_}, {U_}, m AS (SELECT pos, avg(x) AS c FROM u GROUP BY pos), z AS (SELECT id, pos, c, x - c AS z FROM u JOIN m USING (pos)), f AS (SELECT id, sum(z * z) / sum(abs(z)) AS f FROM z GROUP BY id), k AS (SELECT id, list(c + CASE WHEN z > 0 THEN f ELSE -f END ORDER BY pos) AS v FROM z JOIN f USING (id) GROUP BY id), d AS (SELECT query_id, id, {L2E} AS distance FROM (SELECT q.id AS query_id, k.id, q.v AS a, k.v AS b FROM e q, k WHERE q.id % 20 = 0)) {ranked_sql(False, 10)}"),
}


def index_of(spark, d, description: str):
    rows, index = base(spark, d), vector_index.open_factory(description, 64)
    return (index.train(rows) if index.spec.needs_training else index).add(rows)


for _name, _text in EXACT_KINDS.items():

    @register(_name, f"{pairs_sql('l2')} {ranked_sql(False, 10)}")
    def _(spark, d, description=_text):
        return rounded(index_of(spark, d, description).search(asked(base(spark, d)), 10, nprobe=16, width=256))


for _name, (_text, _sql) in CODED_KINDS.items():

    @register(_name, _sql)
    def _(spark, d, description=_text):
        return rounded(index_of(spark, d, description).search(asked(base(spark, d)), 10))


@register("index_pq", PQ_KNN)
def _(spark, d):
    index = replace(vector_index.open_factory("PQ8x4", 64), model=product_book(base(spark, d)))
    return rounded(index.add(base(spark, d)).search(asked(base(spark, d)), 10))


# lists of the nearest label means; product codes of what the centroids leave, the book from the 16 vectors of least id
IVFPQ = f"""{CENTROIDS}, own AS (SELECT id, arg_min(list_no, (d, list_no)) AS list_no FROM (SELECT id, list_no, {L2E} AS d FROM (SELECT e.id, c.list_no, e.v AS a, c.v AS b FROM e, c)) GROUP BY id),
r AS MATERIALIZED (SELECT e.id, own.list_no, list_transform(range(1, 65), lambda i: e.v[i] - c.v[i]) AS v FROM e JOIN own USING (id) JOIN c ON c.list_no = own.list_no),
b AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS code, v FROM r ORDER BY id LIMIT 16),
k AS MATERIALIZED (SELECT id, any_value(list_no) AS list_no, m, arg_min(code, (distance, code)) AS code FROM (SELECT id, list_no, m, code, {PART_L2} AS distance FROM (SELECT r.id, r.list_no, m, b.code, r.v AS a, b.v AS b FROM r, b, range(0, 8) t(m))) GROUP BY id, m),
pr AS (SELECT query_id, list_no, v FROM (SELECT query_id, list_no, v, row_number() OVER (PARTITION BY query_id ORDER BY d, list_no) AS p FROM (SELECT q.id AS query_id, c.list_no, list_transform(range(1, 65), lambda i: q.v[i] - c.v[i]) AS v, list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))) AS d FROM e q, c WHERE q.id % 20 = 0)) WHERE p <= 3),
d AS (SELECT query_id, id, sum(part) AS distance FROM (SELECT query_id, id, m, {PART_L2} AS part FROM (SELECT pr.query_id, k.id, k.m, pr.v AS a, b.v AS b FROM pr JOIN k USING (list_no) JOIN b USING (code))) GROUP BY 1, 2)"""


@register("index_ivfpq", f"WITH {IVFPQ} {ranked_sql(False, 10)}")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", V.doubles("embedding").alias("v"))
    centres = np.array([r.v for r in search.centroids_of(rows, "label").orderBy("list_no").collect()], float)
    index = vector_index.open_factory(f"IVF{len(centres)},PQ8x4", 64)
    first = np.array([r.v for r in rows.orderBy("id").limit(16).collect()], float)
    coarse = vector_index.Coarse((centres,))
    rest = first - coarse.vector(coarse.number(first))
    index = replace(index, coarse=coarse, model={f"book{m}": rest[:, 8 * m : 8 * m + 8] for m in range(8)})
    return rounded(index.add(rows.select("id", "v")).search(asked(rows), 10, nprobe=3))


# two books of given vectors; the five best sums are kept after the first
RQ = f"""{E_}, b AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS n, v FROM e ORDER BY id LIMIT 32), b1 AS (SELECT n AS i, v FROM b WHERE n < 16), b2 AS (SELECT n - 16 AS j, list_transform(v, lambda x: x / 2) AS v FROM b WHERE n >= 16),
s AS MATERIALIZED (SELECT id, i, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, i) AS place FROM (SELECT e.id, b1.i, list_transform(range(1, 65), lambda x: e.v[x] - b1.v[x]) AS v, list_sum(list_transform(range(1, 65), lambda x: (e.v[x] - b1.v[x]) * (e.v[x] - b1.v[x]))) AS d FROM e, b1)) WHERE place <= 5),
k AS (SELECT id, arg_min(i, (d, i, j)) AS i, arg_min(j, (d, i, j)) AS j FROM (SELECT s.id, s.i, b2.j, list_sum(list_transform(range(1, 65), lambda x: (s.v[x] - b2.v[x]) * (s.v[x] - b2.v[x]))) AS d FROM s, b2) GROUP BY id),
y AS (SELECT k.id, list_transform(range(1, 65), lambda x: b1.v[x] + b2.v[x]) AS v FROM k JOIN b1 USING (i) JOIN b2 USING (j)),
d AS (SELECT query_id, id, {L2E} AS distance FROM (SELECT q.id AS query_id, y.id, q.v AS a, y.v AS b FROM e q, y WHERE q.id % 20 = 0))"""


@register("index_rq", f"WITH {RQ} {ranked_sql(False, 10)}")
def _(spark, d):
    rows = base(spark, d)
    first = np.array([r.v for r in rows.orderBy("id").limit(32).collect()], float)
    index = replace(vector_index.open_factory("RQ2x4", 64), model={"book0": first[:16], "book1": first[16:] / 2})
    return rounded(index.add(rows).search(asked(rows), 10))


@register("index_pq_rflat", PQ_KNN.replace(ranked_sql(False, 10), f", c AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM d) WHERE r <= 40), d2 AS (SELECT query_id, id, {L2E} AS distance FROM (SELECT c.query_id, c.id, q.v AS a, x.v AS b FROM c JOIN e q ON q.id = c.query_id JOIN e x ON x.id = c.id)) {ranked_sql(False, 10, 'd2')}"))
def _(spark, d):
    index = replace(vector_index.open_factory("PQ8x4,RFlat", 64), model=product_book(base(spark, d)), refine_model={})
    return rounded(index.add(base(spark, d)).search(asked(base(spark, d)), 10, k_factor=4))
