"""Queries against their SQL oracles on the smallest tables, and literal facts of the operators."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from vecquill import catalogue, catalogue_more  # noqa: F401
from vecquill.functions import vectors as V
from vecquill.operators import chat, sampling, search, text
from vecquill.streaming import index

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["knn_ip", "knn_jaccard_abs", "sel_and_or_xor", "ivf_max_codes", "sq8_encode", "pq_adc_knn", "lsh_knn", "top_p", "typical", "chat_chatml", "chat_vicuna", "chat_deepseek3", "chat_yandex", "chat_granite", "distance_subset", "search_and_reconstruct", "pad", "linear_apply", "pca_total_variance", "dist_draw", "logit_bias", "refine_two_stage", "token_windows", "char_coverage", "kmeans_full", "index_ivfpq", "index_rq", "binary_multi_hash", "embed_windows_mean", "embed_average", "sampler_chain", "stop_rule", "chunk_by_separator", "search_centroids", "operating_points", "range_pr_thresholds", "piece_ids", "grammar_match", "chat_detect", "chat_bailing"])
def test_query_matches_its_oracle(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "conversations", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, TABLES).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted(map(tuple, x[columns].astype(object).values.tolist()), key=str)
    assert rows(got) == rows(want) and len(got)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def array(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def test_metric_facts(spark):
    nan = math.nan
    assert one(spark, V.nan_euclidean(array(2, nan, 4, nan, 7), array(5, 1, 8, nan, nan))) == 5 / 2 * (9 + 16)
    assert math.isnan(one(spark, V.nan_euclidean(array(nan, 1), array(1, nan))))
    assert one(spark, V.l2(array(1, 2), array(4, 6))) == 25
    assert one(spark, V.cosine(array(0, 0), array(0, 0))) == 1.0
    assert one(spark, V.cosine(array(0, 0), array(1, 0))) == 0.0
    with pytest.raises(ValueError):
        V.metric("lp")


def probabilities(spark, p, f):
    d = spark.createDataFrame([(0, i, math.log(x)) for i, x in enumerate(p)], "step long, token long, logit double")
    return [round(r.p, 5) for r in sampling.softmax(f(d)).orderBy(F.desc("p"), "token").collect()]


def shares(*p):
    return [round(x / sum(p), 5) for x in p]


def test_sampler_facts(spark):
    p = [0.05, 0.5, 0.12, 0.33]
    assert probabilities(spark, p, lambda d: sampling.top_k(d, 2)) == shares(0.5, 0.33)
    assert probabilities(spark, p, lambda d: sampling.top_k(d, 0)) == shares(0.5, 0.33, 0.12, 0.05)
    assert probabilities(spark, p, lambda d: sampling.top_p(d, 0.6)) == shares(0.5, 0.33)
    assert probabilities(spark, p, lambda d: sampling.top_p(d, 0.9)) == shares(0.5, 0.33, 0.12)
    assert probabilities(spark, p, lambda d: sampling.top_p(d, 0)) == [1.0]
    assert probabilities(spark, p, lambda d: sampling.min_p(d, 0.2)) == shares(0.5, 0.33, 0.12)
    assert probabilities(spark, p, lambda d: sampling.temperature(d, 0)) == [1.0]
    logs = [math.log(x) for x in p]
    mean = sum(logs) / 4
    spread = math.sqrt(sum((x - mean) ** 2 for x in logs) / 4)
    assert probabilities(spark, p, lambda d: sampling.top_n_sigma(d, 1)) == shares(*(x for x in sorted(p, reverse=True) if math.log(x) >= max(logs) - spread))
    h = -sum(x * math.log(x) for x in p)
    first = min(p, key=lambda x: abs(-math.log(x) - h))
    assert probabilities(spark, p, lambda d: sampling.typical(d, first - 0.01)) == [1.0]


def test_text_facts(spark):
    for given, want in (("", ""), ("   ", ""), (" A  B  C ", "▁A▁B▁C")):
        assert one(spark, text.normalize_spaces(F.lit(given))) == want
    assert one(spark, text.decode_pieces(F.array(F.lit("▁a"), F.lit("b"), F.lit("▁c▁d")))) == "ab c▁d"
    with pytest.raises(ValueError):
        chat.prompts(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string"), "none")


def test_kmeans_is_lloyd(spark):
    import numpy as np

    rows = catalogue.base(spark, TABLES)
    x = np.array([r.v for r in rows.orderBy("id").collect()])
    c = x[:4].copy()
    for _ in range(5):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(4)])
    got = np.array([r.v for r in search.kmeans(rows, 4, 5).orderBy("list_no").collect()])
    assert np.allclose(got, c, atol=1e-6)
    assert search.kmeans(rows.where("false"), 4, 5).count() == 0
    assert len(search.kmeans(rows.limit(3), 5, 4).collect()) == 3
    two = search.kmeans_two_level(rows, 3, 4, 5)
    assert sorted(r.list_no for r in two.collect()) == list(range(12))
    best = lambda c: ((x[:, None] - np.array([r.v for r in c.collect()])[None]) ** 2).sum(2).min(1).mean()
    assert best(two) < best(search.kmeans(rows, 3, 5)) and best(search.kmeans_progressive(rows, 8, 3, 5)) < best(search.kmeans(rows, 1, 1))


def test_stream_adds_and_answers(spark, tmp_path):
    rows = catalogue.base(spark, TABLES)
    rows.where("id < 100").repartition(2).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    index.add_stream(stream(), f"{tmp_path}/base", f"{tmp_path}/c1").awaitTermination()
    rows.where("id >= 100").write.mode("append").parquet(f"{tmp_path}/in")
    index.add_stream(stream(), f"{tmp_path}/base", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/base").count() == rows.count()
    rows.where("id % 20 = 0").write.parquet(f"{tmp_path}/asked")
    asked = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/asked")
    index.search_stream(asked, f"{tmp_path}/base", f"{tmp_path}/out", f"{tmp_path}/c2", 5).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("query_id", "rank", "id")
    want = search.knn(rows.where("id % 20 = 0"), rows, 5).select("query_id", "rank", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_chat_formats_that_depend_on_place(spark):
    turns = ["system", "user", "assistant", "user"]
    talk = spark.createDataFrame([(1, i, r, f" {r[0]}{i}") for i, r in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = lambda name, rows=talk: chat.prompts(rows, name).first().prompt
    assert got("mistral_v1") == " [INST]  s0\n\n u1 [/INST]  a2</s> [INST]  u3 [/INST]"
    assert got("llama2_sys_bos") == "[INST] <<SYS>>\n s0\n<</SYS>>\n\n u1 [/INST] a2</s><s>[INST]  u3 [/INST]"
    assert got("gemma") == "<start_of_turn>user\ns0\n\nu1<end_of_turn>\n<start_of_turn>model\na2<end_of_turn>\n<start_of_turn>user\nu3<end_of_turn>\n<start_of_turn>model\n"
    assert got("rwkv_world") == "System: s0\n\nUser: u1\n\nAssistant: a2\n\nUser: u3\n\nAssistant:"
    assert got("gigachat") == "<s> s0<|message_sep|>user<|role_sep|> u1<|message_sep|>available functions<|role_sep|>[]<|message_sep|>assistant<|role_sep|> a2<|message_sep|>user<|role_sep|> u3<|message_sep|>available functions<|role_sep|>[]<|message_sep|>assistant<|role_sep|>"
    odd = spark.createDataFrame([(1, 0, None, None), (1, 1, "user", None)], talk.schema)
    assert got("monarch", odd) == "\n</s>\n<s>user\n</s>\n<s>assistant\n"


def test_sliding_index(spark, tmp_path):
    rows = catalogue.base(spark, TABLES)
    window = index.SlidingIndex(spark, f"{tmp_path}/w", 2)
    assert window.rows().count() == 0
    for i in range(4):
        window.step(rows.where(F.col("id") % 4 == i))
    assert window.numbers() == [2, 3]
    got = window.search(rows.where("id % 20 = 2"), 3).collect()
    want = search.knn(rows.where("id % 20 = 2"), rows.where("id % 4 >= 2"), 3, "l2").collect()
    assert sorted((r.query_id, r.id) for r in got) == sorted((r.query_id, r.id) for r in want)
    with pytest.raises(ValueError):
        index.SlidingIndex(spark, "x", 0)


def test_log():
    from vecquill import log

    log.reset_log()
    log.logger.warning("one")
    assert log.get_log() == "WARNING one"
    log.reset_log()
    assert log.get_log() == ""
