"""Further registered queries: binary indexes, text to vectors, generation, index services, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecquill.catalogue import CENTROIDS, DUCK, E_, HALF, L2E, LOGITS, MARK, NORMAL, OUT, PROBES, asked, base, bits_sql, logits, pairs_sql, ranked_sql, register, rounded, table, total
from vecquill.functions import vectors as V
from vecquill.operators import binary, embedding, generation, search, vector_index

# ---- binary vectors: the signs of the components
BITS = f"c AS (SELECT id, {bits_sql(0)} AS low, {bits_sql(32)} AS high FROM e), d AS (SELECT q.id AS query_id, c.id, CAST(bit_count(xor(q.low, c.low)) + bit_count(xor(q.high, c.high)) AS DOUBLE) AS distance, bit_count(xor(q.low, c.low) & 65535) AS off0, bit_count((xor(q.low, c.low) >> 16) & 65535) AS off1 FROM c q, c WHERE q.id % 20 = 0)"


def signs(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), binary.real_to_binary(F.col("embedding")).alias("code"))


def binary_index(spark, d, description: str) -> binary.BinaryIndex:
    index = binary.BinaryIndex.open(description, 64)
    return (index.train(signs(spark, d)) if index.kind == "ivf" else index).add(signs(spark, d))


for _name, _text, _sql in (("binary_flat", "BFlat", "true"), ("binary_ivf_all_lists", "BIVF4", "true"), ("binary_hash", "BHash16", "off0 <= 2"), ("binary_multi_hash", "BHash2x16", "(off0 <= 1 OR off1 <= 1)")):

    @register(_name, f"WITH {E_}, {BITS}, x AS (SELECT * FROM d WHERE {_sql}) {ranked_sql(False, 10, 'x')}")
    def _(spark, d, text=_text):
        return binary_index(spark, d, text).search(asked(signs(spark, d)), 10, nprobe=4, flips=2 if text == "BHash16" else 1)


@register("binary_range", f"WITH {E_}, {BITS} SELECT query_id, id, distance FROM d WHERE distance < 24")
def _(spark, d):
    return binary_index(spark, d, "BFlat").range_search(asked(signs(spark, d)), 24)


@register("binary_graph", f"WITH {E_}, {BITS} SELECT query_id, id, distance FROM d WHERE distance = 0")
def _(spark, d):  # every vector finds itself, and what equals it
    return binary_index(spark, d, "BHNSW16").search(asked(signs(spark, d)), 10, width=200).where("distance = 0").select("query_id", "id", "distance")


@register("binary_to_real", f"WITH {E_} SELECT id, CAST(pos - 1 AS BIGINT) AS pos, CASE WHEN v[pos] >= 0 THEN 1.0 ELSE -1.0 END AS x FROM e, range(1, 65) t(pos)")
def _(spark, d):
    real = F.pandas_udf(lambda s: s.map(lambda b: binary.binary_to_real(__import__("numpy").frombuffer(b, "uint8")[None, :])[0]), "array<double>")
    return signs(spark, d).select("id", F.posexplode(real("code")).alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))


# ---- text to vectors
EMBEDDED = """w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, s // 56 AS "window", w[s + 1 : s + 64] AS w FROM (SELECT doc_id, w, unnest(range(0, len(w), 56)) AS s FROM w)),
{pool},
n AS (SELECT doc_id, "window", v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM m),
u AS (SELECT doc_id, "window", CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS v FROM n)"""
TOKEN = "CAST((length({w}) * (j + 3) + unicode({w})) % 17 - 8 AS DOUBLE)"
POOL = {
    "mean": f"""m AS (SELECT doc_id, "window", list_transform(range(0, 4), lambda j: list_avg(list_transform(w, lambda x: {TOKEN.format(w='x')}))) AS v FROM p)""",
    "cls": f"""m AS (SELECT doc_id, "window", list_transform(range(0, 4), lambda j: {TOKEN.format(w='w[1]')}) AS v FROM p)""",
    "last": f"""m AS (SELECT doc_id, "window", list_transform(range(0, 4), lambda j: {TOKEN.format(w='w[len(w)]')}) AS v FROM p)""",
    "rank": """m AS (SELECT doc_id, "window", [CAST(len(w) AS DOUBLE)] AS v FROM p)""",
}
POOL["none"] = POOL["last"]


def embedded(spark, d, pooling: str) -> DataFrame:
    return embedding.embed(table(spark, d, "documents"), embedding.WordProvider(4), embedding.EmbedOptions(n_ctx=64, pooling=pooling))


for _mode, _pool in POOL.items():

    @register(f"embed_windows_{_mode}", f'WITH {EMBEDDED.format(pool=_pool)} SELECT doc_id, "window", CAST(pos - 1 AS BIGINT) AS pos, round(CAST(CAST(v[pos] AS FLOAT) AS DOUBLE), 5) + 0.0 AS x FROM u, range(1, 5) t(pos) WHERE pos <= len(v)')
    def _(spark, d, mode=_mode):
        rows = embedded(spark, d, mode).select("doc_id", F.posexplode("vecs").alias("window", "v")).select("doc_id", "window", F.posexplode("v").alias("pos", "x"))
        return rows.select("doc_id", F.col("window").cast("long").alias("window"), F.col("pos").cast("long").alias("pos"), (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x"))


@register("embed_average", f'WITH {EMBEDDED.format(pool=POOL["mean"])}, a AS (SELECT doc_id, pos, avg(v[pos]) AS x FROM u, range(1, 5) t(pos) GROUP BY 1, 2), b AS (SELECT doc_id, pos, x, sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS n FROM a) SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, round(CAST(CAST(CASE WHEN n > 0 THEN x / n ELSE x END AS FLOAT) AS DOUBLE), 4) + 0.0 AS x FROM b')
def _(spark, d):
    rows = embedded(spark, d, "mean").select("doc_id", F.posexplode("avg_vec").alias("pos", "x"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))


# ---- generation
CHAIN = f"""WITH {LOGITS}, a AS (SELECT step, token, CASE WHEN token % 5 = 0 THEN CASE WHEN logit > 0 THEN logit / 1.1 ELSE logit * 1.1 END ELSE logit END AS logit FROM l),
b AS (SELECT step, token, logit FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY logit DESC, token) AS r FROM a) WHERE r <= 40),
c AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY step)) AS e FROM b), p AS (SELECT *, e / sum(e) OVER (PARTITION BY step) AS p FROM c),
k AS (SELECT step, token, logit FROM (SELECT *, round(sum(p) OVER (PARTITION BY step ORDER BY logit DESC, token ROWS UNBOUNDED PRECEDING) - p, 12) AS before FROM p) WHERE before < 0.95),
m AS (SELECT step, token, logit / 0.8 AS logit FROM (SELECT *, max(logit) OVER (PARTITION BY step) AS top FROM k) WHERE logit >= top + ln(0.01)),
e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY step)) AS e FROM m)
SELECT step, token, round(logit, 6) AS logit, round(e / sum(e) OVER (PARTITION BY step), 6) AS p FROM e"""


@register("sampler_chain", CHAIN)
def _(spark, d):
    x = logits(spark, d)
    counts = x.where("token % 5 = 0").select("step", "token", F.lit(1).alias("n"))
    return generation.chain(x, counts).select("step", "token", F.round("logit", 6).alias("logit"), F.round("p", 6).alias("p"))


WORDS = "w AS (SELECT conv_id * 100 + turn AS step, string_split(text, ' ') AS w FROM conversations), t AS (SELECT step, i AS pos, w[i + 1] AS piece, length(w[i + 1]) AS token FROM (SELECT step, w, unnest(range(0, len(w))) AS i FROM w))"


@register("stop_rule", f"WITH {WORDS}, s AS (SELECT *, token = 11 OR row_number() OVER o >= 40 OR (token IN (3, 8) AND (contains(piece, 'end') OR contains(piece, 'assistant'))) AS stop FROM t WINDOW o AS (PARTITION BY step ORDER BY pos)), c AS (SELECT *, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY step ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM s) SELECT step, pos, CAST(token AS INTEGER) AS token, piece FROM c WHERE n = 0 AND token NOT IN (3, 8)")
def _(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("step"), F.posexplode(F.split("text", " ")).alias("pos", "piece"))
    rows = rows.select("step", F.col("pos").cast("long").alias("pos"), F.length("piece").alias("token"), "piece")
    return generation.stopped(rows, [11], [3, 8], 40)


@register("prompt_messages", "SELECT doc_id AS conv_id, '<|im_start|>system\nYou are a helpful AI assistant<|im_end|>\n<|im_start|>user\n' || text || '<|im_end|>\n<|im_start|>assistant\n' AS prompt FROM documents")
def _(spark, d):
    from vecquill.operators import chat

    return chat.prompts(generation.messages_of(table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("prompt"))), "chatml")


@register("penalty_window", f"WITH {WORDS} SELECT step, pos, CAST(token AS INTEGER) AS token, (SELECT count(*) FROM t b WHERE b.step = a.step AND b.pos < a.pos AND b.pos >= a.pos - 8 AND b.token = a.token) AS recent FROM t a")
def _(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("step"), F.posexplode(F.transform(F.split("text", " "), F.length)).alias("pos", "token"))
    last = F.collect_list("token").over(Window.partitionBy("step").orderBy("pos").rowsBetween(-8, -1))
    return rows.withColumn("last", last).select("step", F.col("pos").cast("long").alias("pos"), "token", F.size(F.filter("last", lambda x: x == F.col("token"))).cast("long").alias("recent"))


# ---- services of an index
def ivf_index(spark, d) -> tuple[vector_index.VectorIndex, DataFrame]:
    """Lists of the nearest label means, raw vectors."""
    import numpy as np
    from dataclasses import replace

    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", V.doubles("embedding").alias("v"))
    centres = np.array([r.v for r in search.centroids_of(rows, "label").orderBy("list_no").collect()], float)
    index = replace(vector_index.open_factory(f"IVF{len(centres)},Flat", 64), coarse=vector_index.Coarse((centres,)), model={})
    return index.add(rows.select("id", "v")), rows


OWN = f"{CENTROIDS}, own AS (SELECT id, arg_min(list_no, (d, list_no)) AS list_no FROM (SELECT id, list_no, {L2E} AS d FROM (SELECT e.id, c.list_no, e.v AS a, c.v AS b FROM e, c)) GROUP BY id), pr AS (SELECT query_id, list_no, CAST(p AS INTEGER) AS probe FROM (SELECT query_id, list_no, row_number() OVER (PARTITION BY query_id ORDER BY d, list_no) AS p FROM (SELECT q.id AS query_id, c.list_no, {L2E.replace('a[i]', 'q.v[i]').replace('b[i]', 'c.v[i]').replace('len(a)', 'len(q.v)')} AS d FROM e q, c WHERE q.id % 20 = 0)) WHERE p <= 3), d AS (SELECT query_id, id, {L2E} AS distance FROM (SELECT pr.query_id, e.id, q.v AS a, e.v AS b FROM pr JOIN own USING (list_no) JOIN e ON e.id = own.id JOIN e q ON q.id = pr.query_id))"


@register("direct_map", f"WITH {OWN} SELECT id, CAST(list_no AS INTEGER) AS list_no FROM own")
def _(spark, d):
    return ivf_index(spark, d)[0].direct_map()


@register("assign_probes", f"WITH {OWN} SELECT query_id, probe, CAST(list_no AS INTEGER) AS list_no FROM pr")
def _(spark, d):
    index, rows = ivf_index(spark, d)
    return index.assign(asked(rows.select("id", "v")), 3)


@register("search_and_codes", f"WITH {OWN}, t AS ({ranked_sql(False, 5)}) SELECT query_id, rank, t.id, distance, CAST(list_no AS INTEGER) AS list_no, CAST(256 AS INTEGER) AS n_bytes FROM t JOIN own USING (id)")
def _(spark, d):
    index, rows = ivf_index(spark, d)
    return rounded(index.search_and_codes(asked(rows.select("id", "v")), 5, 3).withColumn("n_bytes", F.octet_length("code")).drop("code"))


@register("search_centroids", f"WITH {OWN}, t AS ({ranked_sql(False, 5)}) SELECT t.query_id, rank, t.id, distance, CAST(own.list_no AS INTEGER) AS list_no, CAST(pr.list_no AS INTEGER) AS query_list FROM t JOIN own USING (id) JOIN pr ON pr.query_id = t.query_id AND pr.probe = 1")
def _(spark, d):
    index, rows = ivf_index(spark, d)
    return rounded(index.search_centroids(asked(rows.select("id", "v")), 5, 3))


@register("index_ivf_range", f"WITH {OWN} SELECT query_id, id, round(distance, 6) AS distance FROM d WHERE distance < 1.4")
def _(spark, d):
    index, rows = ivf_index(spark, d)
    return rounded(index.range_search(asked(rows.select("id", "v")), 1.4, 3))


@register("sharded_by_id", f"{pairs_sql('l2')} {ranked_sql(False, 10)}")
def _(spark, d):
    from vecquill.operators import scan

    index = vector_index.open_factory("Flat", 64).add(base(spark, d))
    parts = [shard.search(asked(base(spark, d)), 10).drop("rank") for shard in index.shard_by_id(3)]
    return rounded(scan.ranked(parts[0].unionByName(parts[1]).unionByName(parts[2]), 10, False))


@register("copy_range", f"WITH {E_}, p AS (SELECT q.id AS query_id, e.id, q.v AS a, e.v AS b FROM e, e q WHERE q.id % 20 = 0 AND e.id >= 50 AND e.id < 150), d AS (SELECT query_id, id, {DUCK['ip'][0]} AS distance FROM p) {ranked_sql(True, 3)}")
def _(spark, d):
    index = vector_index.open_factory("Flat", 64, "ip").add(base(spark, d))
    return rounded(index.copy_range(50, 150).search(asked(base(spark, d)), 3))


@register("add_packed_bytes", f"{pairs_sql('l2')} {ranked_sql(False, 3)}")
def _(spark, d):
    packed = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), V.packer()("embedding").alias("v"))  # ids as text
    return rounded(vector_index.open_factory("Flat", 64).add(packed).search(asked(base(spark, d)), 3))


@register("add_coded", f"{pairs_sql('l2')} {ranked_sql(False, 3)}")
def _(spark, d):
    index = vector_index.open_factory("Flat", 64).add(base(spark, d))
    return rounded(index.reset().add_codes(index.rows).search(asked(base(spark, d)), 3))


@register("update_vectors", f"WITH {E_}, e2 AS (SELECT id, CASE WHEN id % 10 = 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM e), d AS (SELECT query_id, id, {L2E} AS distance FROM (SELECT q.id AS query_id, e2.id, q.v AS a, e2.v AS b FROM e q, e2 WHERE q.id % 20 = 0)) {ranked_sql(False, 5)}")
def _(spark, d):
    index = vector_index.open_factory("Flat", 64).add(base(spark, d))
    turned = base(spark, d).where("id % 10 = 0").withColumn("v", F.transform("v", lambda x: -x))
    return rounded(index.update(turned).search(asked(base(spark, d)), 5))


@register("permuted_ids", f"{pairs_sql('l2')}, x AS (SELECT query_id, 100000 - id AS id, distance FROM d) {ranked_sql(False, 5, 'x')}")
def _(spark, d):
    index = vector_index.open_factory("Flat", 64).add(base(spark, d))
    return rounded(index.permute(base(spark, d).select("id", (100000 - F.col("id")).alias("new_id"))).search(asked(base(spark, d)), 5))


@register("refine_range", f"{pairs_sql('l2')} SELECT query_id, id, round(distance, 6) AS distance FROM d WHERE distance < 1.2")
def _(spark, d):
    index = vector_index.open_factory("Flat,RFlat", 64).add(base(spark, d))
    return rounded(index.range_search(asked(base(spark, d)), 1.2))


# ---- selectors by bits, thresholds, fronts
@register("sel_bitmap", f"{pairs_sql('ip', where='(s.id % 8) IN (0, 3, 6)')} {ranked_sql(True, 5)}")
def _(spark, d):
    bitmap = bytes([0b01001001]) * (1 << 16)
    kept = search.in_bitmap(F.col("id"), bitmap)
    return rounded(search.knn(asked(base(spark, d)), base(spark, d), 5, "ip", where=kept))


@register("sel_translated", f"{pairs_sql('ip', where='(s.id * 3 + 1) IN (1, 31, 61, 301, 601)')} {ranked_sql(True, 3)}")
def _(spark, d):
    ids = base(spark, d).select("id", (F.col("id") * 3 + 1).alias("outer"))
    rows = search.translated(base(spark, d), ids, F.col("outer").isin(1, 31, 61, 301, 601))
    return rounded(search.knn(asked(base(spark, d)), rows, 3, "ip"))


@register("range_pr_thresholds", f"{pairs_sql('l2')}, g AS (SELECT t / 10.0 AS radius FROM range(10, 17) r(t)) SELECT radius, count(*) FILTER (WHERE distance < radius AND distance < 1.2) AS hits, round(CASE WHEN count(*) FILTER (WHERE distance < radius) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE distance < radius AND distance < 1.2) / count(*) FILTER (WHERE distance < radius) END, 6) AS precision, round(count(*) FILTER (WHERE distance < radius AND distance < 1.2) / count(*) FILTER (WHERE distance < 1.2), 6) AS recall FROM d, g GROUP BY radius")
def _(spark, d):
    found = search.within(asked(base(spark, d)), base(spark, d), 1.6)
    truth = found.where("distance < 1.2").select("query_id", "id")
    out = search.scores_at(truth, found, [t / 10.0 for t in range(10, 17)])
    return out.select("radius", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("operating_points", "SELECT l_quantity AS cost, l_extendedprice AS gain FROM (SELECT l_quantity, l_extendedprice, max(l_extendedprice) OVER (ORDER BY l_quantity RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(l_extendedprice) OVER (PARTITION BY l_quantity) AS own FROM lineitem) WHERE l_extendedprice = own AND (before IS NULL OR own > before) GROUP BY 1, 2")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("cost"), F.col("l_extendedprice").alias("gain"))
    return search.pareto(rows, "cost", "gain")


@register("tie_tolerant", f"{pairs_sql('l1')}, a AS (SELECT query_id, id, round(distance, 0) AS level FROM d), t AS (SELECT query_id, level, id, row_number() OVER (PARTITION BY query_id ORDER BY level, id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY level, id DESC) AS r2 FROM a) SELECT query_id, true AS same FROM t GROUP BY query_id")
def _(spark, d):
    pairs = search.distances(asked(base(spark, d)), base(spark, d), "l1").withColumn("distance", F.round("distance", 0))
    one = search.top_k(pairs, 20, False)
    other = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", F.desc("id")))).where("rank <= 20")
    return search.same_but_for_ties(one, other)


@register("spherical_kmeans_step", f"WITH {E_}, b AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS list_no, list_transform(v, lambda x: round(x, 9)) AS v FROM e ORDER BY id LIMIT 8), s AS (SELECT id, arg_max(list_no, (d, -list_no)) AS list_no FROM (SELECT id, list_no, {total('a[i]*b[i]')} AS d FROM (SELECT e.id, b.list_no, e.v AS a, b.v AS b FROM e, b)) GROUP BY id), m AS (SELECT list_no, pos, round(avg(v[pos]), 9) AS x FROM e JOIN s USING (id), range(1, 65) t(pos) GROUP BY 1, 2), n AS (SELECT list_no, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT list_no, CAST(pos - 1 AS BIGINT) AS pos, round(x / n, 6) AS x FROM m JOIN n USING (list_no)")
def _(spark, d):
    found = search.kmeans(base(spark, d), 8, 1, spherical=True).select("list_no", F.posexplode("v").alias("pos", "x"))
    return found.select("list_no", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register("spectral_bits", f"WITH {E_} SELECT id, CAST(sum(CAST(floor(v[pos] * 2 / 0.3) AS BIGINT) & 1) AS BIGINT) AS ones FROM e, range(1, 65) t(pos) GROUP BY id")
def _(spark, d):
    bits = F.transform("v", lambda x: F.floor(x * 2 / 0.3).bitwiseAND(F.lit(1).cast("bigint")))
    return base(spark, d).select("id", F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ones"))


@register("kmeans_1d", "WITH g AS (SELECT p_size AS x, count(*) AS n FROM part GROUP BY 1), c AS (SELECT a.x AS lo, b.x AS hi FROM g a, g b WHERE a.x < b.x), t AS (SELECT lo, hi, (x >= lo)::INT + (x >= hi)::INT AS part, sum(n) AS n, sum(n * x) / sum(n) AS m, sum(n * x * x) - sum(n * x) * sum(n * x) / sum(n) AS cost FROM c, g GROUP BY 1, 2, 3), s AS (SELECT lo, hi FROM t GROUP BY lo, hi HAVING count(*) = 3 ORDER BY sum(cost), lo, hi LIMIT 1) SELECT CAST(part AS INTEGER) AS list_no, round(m, 6) AS centre, CAST(n AS BIGINT) AS n FROM t JOIN s USING (lo, hi)")
def _(spark, d):
    return search.kmeans_1d(table(spark, d, "part").select(F.col("p_size").alias("x")), 3).withColumn("centre", F.round("centre", 6))


@register("grammar_match", r"SELECT w, n, regexp_full_match(w, '[A-ZÀ-Ü][a-zß-ÿ]*[.,]?') AS fits FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations) GROUP BY w)")
def _(spark, d):
    from vecquill.operators import grammar

    rules = grammar.Grammar('root ::= [A-ZÀ-Ü] [a-zß-ÿ]* [.,]?')
    words = table(spark, d, "conversations").select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.select("w", "n", grammar.accepted(rules)("w").alias("fits"))


@register("schema_match", "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT' AS fits FROM orders")
def _(spark, d):
    from vecquill.operators import grammar

    schema = {"type": "object", "properties": {"key": {"type": "integer"}, "status": {"enum": ["F", "O"]}, "priority": {"const": "1-URGENT"}, "total": {"type": "number"}, "clerk": {"type": "string"}}, "required": ["key", "status", "priority"]}
    one = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("decimal(18,2)").alias("total")))
    return table(spark, d, "orders").select("o_orderkey", grammar.accepted(grammar.Grammar(grammar.schema_grammar(schema)))(one).alias("fits"))


# ---- pieces of a model: the 300 most frequent words
VOCAB = "v AS (SELECT piece, freq, CAST(row_number() OVER (ORDER BY freq DESC, piece) + 2 AS INTEGER) AS id FROM (SELECT piece, freq FROM (SELECT unnest(string_split(text, ' ')) AS piece, count(*) AS freq FROM documents GROUP BY 1) WHERE piece <> '' ORDER BY freq DESC, piece LIMIT 300)), w AS (SELECT doc_id, w[i] AS piece, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents))), j AS (SELECT doc_id, i, coalesce(id, 0) AS id, coalesce(freq, 0) AS freq, w.piece FROM w LEFT JOIN v USING (piece)), s AS (SELECT *, CASE WHEN id = 0 AND lag(id) OVER (PARTITION BY doc_id ORDER BY i) = 0 THEN 0 ELSE 1 END AS new FROM j)"


def word_model(spark, d):
    from vecquill.operators import piecemodel, text

    found = text.word_vocabulary(table(spark, d, "documents"), 300).orderBy(F.desc("freq"), "piece").collect()
    special = (("<unk>", 0.0, piecemodel.UNKNOWN), ("<s>", 0.0, piecemodel.CONTROL), ("</s>", 0.0, piecemodel.CONTROL))
    return piecemodel.PieceModel((*special, *((text.MARK + r.piece, r.score, piecemodel.NORMAL) for r in found)), piecemodel.WORD), {text.MARK + r.piece: r.freq for r in found}


def over_texts(spark, d, f, type_: str) -> DataFrame:
    import pyarrow as pa

    from vecquill.operators import pieces

    arrow = {"array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "string": pa.string()}[type_]
    return table(spark, d, "documents").select("doc_id", pieces.mapped(f, type_, arrow)("text").alias("x"))


@register("piece_ids", f"WITH {VOCAB} SELECT doc_id, CAST(count(*) + 2 AS INTEGER) AS n, md5('2 ' || string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i DESC) || ' 1') AS digest FROM s WHERE new = 1 GROUP BY doc_id")
def _(spark, d):
    model, _ = word_model(spark, d)
    ids = over_texts(spark, d, lambda t: model.encode_ids(t, "bos:eos:reverse"), "array<int>")
    return ids.where("size(x) > 2").select("doc_id", F.size("x").alias("n"), F.md5(F.array_join(F.transform("x", lambda i: i.cast("string")), " ").cast("binary")).alias("digest"))


@register("piece_decode_full", f"WITH {VOCAB} SELECT doc_id, md5(string_agg(CASE WHEN id = 0 THEN ' ⁇ ' WHEN i = 1 THEN piece ELSE ' ' || piece END, '' ORDER BY i)) AS digest FROM s WHERE new = 1 GROUP BY doc_id")
def _(spark, d):
    model, _ = word_model(spark, d)
    out = over_texts(spark, d, lambda t: model.decode_ids(model.encode_ids(t)), "string")
    return out.where("x <> ''").select("doc_id", F.md5(F.col("x").cast("binary")).alias("digest"))


@register("vocabulary_counts", "SELECT text, count(*) AS n FROM documents WHERE text <> '' GROUP BY text")
def _(spark, d):
    from vecquill.operators import piecetrain

    return piecetrain.sentences(table(spark, d, "documents"))


@register("split_vectors", f"{pairs_sql('l2')} {ranked_sql(False, 10)}")
def _(spark, d):
    return rounded(search.split_knn(asked(base(spark, d)), base(spark, d), [(0, 16), (16, 32), (48, 16)], 10))


@register("sharded_by_list", f"WITH {OWN} {ranked_sql(False, 10)}")
def _(spark, d):
    from vecquill.operators import scan

    index, rows = ivf_index(spark, d)
    parts = [part.search(asked(rows.select("id", "v")), 10, 3).drop("rank") for part in index.shard_by_list(2)]
    return rounded(scan.ranked(parts[0].unionByName(parts[1]), 10, False))


@register("fp32_to_fp16", f"WITH {E_}, h AS (SELECT id, pos, v[pos] AS x FROM e, range(1, 65) t(pos)) SELECT id, CAST(pos - 1 AS BIGINT) AS pos, round({HALF}, 9) AS x FROM h")
def _(spark, d):
    packed = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.packer()("embedding").alias("code"))
    back = packed.select("id", V.unpacker()(V.reformatter(False)(V.reformatter(True)("code"))).alias("v"))
    return back.select("id", F.posexplode("v").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 9).alias("x"))


@register("byte_pieces", f"SELECT doc_id, CAST(strlen(t) AS INTEGER) AS n, md5(t) AS digest FROM ({NORMAL}) WHERE t <> ''")
def _(spark, d):
    from vecquill.operators import piecemodel

    model = piecemodel.PieceModel((("<unk>", 0.0, piecemodel.UNKNOWN), *((f"<0x{b:02X}>", 0.0, piecemodel.BYTE) for b in range(256))), piecemodel.CHAR, byte_fallback=True)
    out = over_texts(spark, d, lambda t: (lambda p: [str(len(p)), model.decode(p)])(model.encode(t)), "array<string>").where("x[0] <> '0'")
    return out.select("doc_id", F.col("x")[0].cast("int").alias("n"), F.md5(F.col("x")[1].cast("binary")).alias("digest"))


CUT = r"\p{N}{1,3}|\p{L}+|[^\s\p{L}\p{N}]+|[ \n\t\r]+"


@register("pre_tokens", f"SELECT doc_id, CAST(len(p) AS INTEGER) AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '{CUT}') AS p FROM documents) WHERE len(p) > 0")
def _(spark, d):
    from vecquill.operators import piecemodel

    out = over_texts(spark, d, lambda t: piecemodel.pre_tokens(t, CUT), "array<string>")
    return out.where("size(x) > 0").select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", "|").cast("binary")).alias("digest"))


# the small model says the letters in order, up to j or eleven of them
LETTERS = "l AS (SELECT doc_id AS conv_id, doc_id % 26 AS c FROM documents), a AS (SELECT conv_id, c, CAST(least(11, (9 - c + 26) % 26) AS INTEGER) AS n FROM l)"


@register("predict_greedy", f"WITH {LETTERS} SELECT conv_id, substr('abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz', c + 2, n) AS answer, n AS n_pieces FROM a")
def _(spark, d):
    return generation.predict(letters(spark, d), generation.LetterProvider(), GREEDY)


@register("predict_pieces", f"WITH {LETTERS} SELECT conv_id, CAST(k AS INTEGER) AS n, chr(CAST(97 + (c + 1 + k) % 26 AS INTEGER)) AS piece FROM a, range(0, 11) r(k) WHERE k < a.n")
def _(spark, d):
    return generation.predict(letters(spark, d), generation.LetterProvider(), GREEDY, pieces=True)


GREEDY = generation.PredictOptions(temp=0, repeat_penalty=1.0, dry_multiplier=0.0, max_tokens=12)


def letters(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.char(F.col("doc_id") % 26 + 97).alias("prompt"))
