"""Exact search by tiles: ties, odd values, the queries of all rows, and plans that never pair rows in the JVM."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecquill.functions import vectors as V
from vecquill.operators import exact, search

NAMES = ["ip", "l2", "l1", "linf", "canberra", "braycurtis", "jensenshannon", "jaccard", "nan_euclidean", "gower", "cosine", "lp"]


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v) for i, v in enumerate(x)], "id long, v array<double>")


def sample(name, n=230):
    x = np.random.default_rng(4).normal(size=(n, 7))
    x[n // 2 :] = x[: n - n // 2]  # copies tie exactly, wherever their tiles begin
    x = np.abs(x) if name in ("jensenshannon", "jaccard") else x
    return np.clip(np.abs(x) / 4, 0, 1) if name == "gower" else np.where(np.abs(x) < 0.1, np.nan, x) if name == "nan_euclidean" else x


@pytest.mark.parametrize("name", NAMES)
def test_search_equals_the_expressions(spark, name):
    p = 3 if name == "lp" else None
    rows = table(spark, sample(name).tolist())
    asked = rows.where("id % 20 = 0")
    f, larger = V.metric(name, p)
    pairs = asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")).crossJoin(rows).select("query_id", "id", f(F.col("q"), F.col("v")).alias("distance"))
    key = lambda df: [(r.query_id, r.rank, r.id, round(r.distance, 9)) for r in df.orderBy("query_id", "rank").collect()]
    assert key(search.knn(asked, rows, 6, name, p)) == key(search.top_k(pairs, 6, larger))
    every = lambda df: sorted((r.query_id, r.id, round(r.distance, 9)) for r in df.collect())
    assert every(search.distances(asked, rows, name, p)) == every(pairs)


def test_search_never_pairs_rows_in_the_jvm(spark):
    rows = table(spark, sample("l2").tolist())
    plan = search.knn(rows.where("id % 20 = 0"), rows, 5, "l2")._jdf.queryExecution().toString()
    assert "Join" not in plan and "zip_with" not in plan


def test_odd_vectors(spark):
    rows = table(spark, [[0.0, 0.0], [1.0, 0.0], None, [0.0, 0.0], [3.0, 4.0]])
    got = search.knn(rows.where("id in (0, 2)"), rows, 9, "cosine").orderBy("rank").collect()
    assert [(r.query_id, r.id, r.distance) for r in got] == [(0, 0, 1.0), (0, 3, 1.0), (0, 1, 0.0), (0, 4, 0.0)]
    assert [r.id for r in search.knn(rows.where("id = 0"), rows, 9, "canberra").orderBy("rank").collect()] == [4, 0, 1, 3]  # NaN comes last
    assert search.distances(rows.where("id < 3"), rows, "l2").where("distance is null").count() == 7
    with pytest.raises(Exception, match="different lengths"):
        search.knn(table(spark, [[1.0]]), table(spark, [[1.0], [1.0, 2.0, 3.0]]), 1, "l2").collect()


def test_least_and_capped(spark):
    rows = table(spark, sample("l2").tolist())
    asked = rows.where("id % 20 = 0")
    d = sorted(r.distance for r in search.distances(asked, rows, "l2").collect())
    assert exact.least(asked, rows, 40, "l2") == d[:40]
    assert search.capped_within(asked, rows, 40, "l2").count() == sum(x < d[40] for x in d)
    assert search.capped_within(asked, rows, 10_000_000, "l2").count() == len(d)
    assert search.knn(asked, rows, 3, "l2", apart=True).where("query_id = id").count() == 0


def test_zero_vectors_hide_no_neighbour(spark):
    x = np.random.default_rng(8).normal(size=(60, 5))
    x[20:50] = 0  # more zero vectors in a tile than neighbours are asked for: cosine 0, which the others exceed
    rows = table(spark, x.tolist()).coalesce(1)
    got = search.knn(rows.where("id = 3"), rows, 4, "cosine").orderBy("rank").collect()
    cosines = x[:20] @ x[3], x[50:] @ x[3]
    best = np.sort(np.concatenate(cosines) / np.linalg.norm(np.concatenate([x[:20], x[50:]]), axis=1) / np.linalg.norm(x[3]))[::-1][:4]
    assert got[0].id == 3 and np.allclose([r.distance for r in got], best, rtol=0, atol=1e-12)
    assert np.allclose(exact.least(rows.where("id = 3"), rows, 4, "cosine"), best, rtol=0, atol=1e-12)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("kind", ["plain", "copies", "scaled"])
def test_few_pairs_are_summed_in_order(monkeypatch, name, kind):
    x, p = np.random.default_rng(9).normal(size=(1600, 12)), 3 if name == "lp" else None
    x = np.abs(x) if name in ("jensenshannon", "jaccard") else np.clip(np.abs(x) / 4, 0, 1) if name == "gower" else np.where(np.abs(x) < 0.1, np.nan, x) if name == "nan_euclidean" else x
    x = np.where(np.arange(len(x))[:, None] % 3 == 0, x[0], x) if kind == "copies" else x * 1000 if kind == "scaled" and name != "gower" else x
    q, ids, summed, in_order = x[::20], np.random.default_rng(10).permutation(len(x)), [], exact.in_order

    def counted(name, a, b, p=None):
        summed.append(np.prod(np.broadcast_shapes(a.shape[1:], b.shape[1:])))
        return in_order(name, a, b, p)

    monkeypatch.setattr(exact, "in_order", counted)
    one, other, distances = exact.Nearest(len(q), 5), exact.Nearest(len(q), 5), exact.Distances(name, q, p)
    one.add(ids, distances.tiles(x))
    few = sum(summed)
    other.add(ids, distances.tiles(x, exact=True))
    assert (one.ids == other.ids).all() and (one.s == other.s).all()
    assert kind == "copies" or few < len(q) * len(x) / 4
    across = np.ascontiguousarray(x.T)
    for own, s, off, values in distances.tiles(x):
        true = distances._nearness(in_order(distances.name, q[own].T[:, :, None], across[:, None, :], p))
        assert ((s == true) | (s == -np.inf) | (np.abs(s - true) <= np.reshape(off, (-1, 1)))).all()
        qi, ri = np.nonzero(s > -np.inf)
        assert (values(qi + own.start, ri) == true[qi, ri]).all()


def test_linf_is_estimated_in_whole_steps():
    x = np.random.default_rng(11).normal(size=(900, 6))
    for odd in (x, np.zeros((900, 6)), np.where(np.arange(900)[:, None] == 7, 1e7, x), x * 1e-20):
        distances, ids = exact.Distances("linf", odd[::9]), np.arange(900)
        one, other = exact.Nearest(100, 4), exact.Nearest(100, 4)
        one.add(ids, distances.tiles(odd))
        other.add(ids, distances.tiles(odd, exact=True))
        assert (one.ids == other.ids).all() and (one.s == other.s).all()
    assert {s.dtype for _, s, _, _ in exact.Distances("linf", x[::9]).tiles(x)} == {np.dtype(float)}
    own, s, off, _ = next(exact.Distances("linf", x[:20]).tiles(x))
    steps = s / (np.abs(x).max() / 16_000)
    assert np.allclose(steps, np.rint(steps), rtol=0, atol=1e-6)


def test_codes_are_trained_on_all_rows(spark, monkeypatch):
    from vecquill.operators import vector_index

    monkeypatch.setattr(vector_index, "LEAST_SAMPLE", 50)
    monkeypatch.setattr(vector_index, "PER_CENTRE", 1)
    x = np.random.default_rng(6).normal(size=(1001, 8))
    for rows in (x, x[:1000]):
        model = lambda text: vector_index.open_factory(text, 8).train(table(spark, rows.tolist())).model
        sq = model("SQ8")
        assert (sq["low"] == rows.min(0)).all() and (sq["width"] == np.ptp(rows, axis=0)).all()
        assert np.allclose(model("LSH8t")["cut"], np.median(rows, axis=0), rtol=0, atol=1e-15)
        assert np.allclose(model("RaBitQ")["centre"], rows.mean(0), rtol=0, atol=1e-12)


@pytest.mark.parametrize("text", ["Flat", "SQ4", "RaBitQ", "IVF3,PQ4x4"])
def test_equal_codes_tie_by_id(spark, text):
    from vecquill.operators import vector_index

    x = np.random.default_rng(7).normal(size=(40, 8))
    rows = table(spark, np.concatenate([x] * 9).tolist()).repartition(7)
    index = vector_index.open_factory(text, 8).train(rows) if text != "Flat" else vector_index.open_factory(text, 8)
    got = index.add(rows).search(rows.where("id < 40"), 9, nprobe=3).collect()
    for q in range(40):
        own = sorted((r.distance, r.rank, r.id) for r in got if r.query_id == q)
        assert [r for _, r, _ in own] == list(range(1, 10)) and all(a[2] < b[2] for a, b in zip(own, own[1:]) if a[0] == b[0])
        assert text == "IVF3,PQ4x4" or len({d for d, _, _ in own}) == 1


def test_texts_are_encoded_in_slices(spark):
    import pyarrow as pa

    from vecquill.operators import pieces

    texts = pa.array(["abc", None, "x" * 50, "", "de", "fgh"])
    parts = list(pieces.in_slices(texts, 6))
    assert pa.concat_arrays(parts).to_pylist() == texts.to_pylist() and len(parts) == 3
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "a▁" * (i % 50) * 400) for i in range(300)], "id long, t string").coalesce(1)
    got = rows.select("id", F.size(pieces.over_batches(list)("t")).alias("n"), "t").collect()
    assert len(got) == 300 and all((r.n in (-1, None)) if r.t is None else r.n == len(r.t) for r in got)


def test_pieces_word_by_word_are_those_of_whole_texts(monkeypatch):
    from vecquill.operators import pieces

    text = "▁the▁then▁xx▁ythe▁▁the▁in▁" * 3 + "tail"
    scores = {"▁the": -1.0, "▁the" + "n": -2.0, "▁in": -1.5}
    merges = {"th": 0.0, "the": -1.0, "in": -2.0}
    fast = pieces.best_path(scores)(text), pieces.pair_merger(merges)(text)
    monkeypatch.setattr(pieces, "by_word", lambda encode, _: encode)
    assert fast == (pieces.best_path(scores)(text), pieces.pair_merger(merges)(text))


def test_all_pairs_are_rounded_before_the_jvm(spark):
    d = np.array([0.5, 1.5, -0.5, -2.5, 1234567.5, 0.4999999, -0.2, np.nan, np.inf, -np.inf, 1e300])
    assert str(exact.rounded(d, 0).tolist()) == "[1.0, 2.0, -1.0, -3.0, 1234568.0, 0.0, 0.0, nan, inf, -inf, 1e+300]"
    rows = table(spark, [[0.1, 0.2], [3.0, 4.00000051], None])
    got = search.distances(rows, rows, "l2", digits=6)
    assert "round(" not in got._jdf.queryExecution().toString().lower()
    assert sorted((r.query_id, r.id, r.distance) for r in got.where("distance is not null").collect()) == [(0, 0, 0.0), (0, 1, 22.850004), (1, 0, 22.850004), (1, 1, 0.0)]
    assert got.count() == 9


def test_scans_hold_a_bounded_tile(spark):
    from vecquill.operators import scan

    n = 3_000

    def distances(b):
        if b.num_rows * n > scan.NUMBERS_AT_ONCE:
            raise ValueError(f"a tile of {b.num_rows} by {n}")
        return np.abs(b.column("id").to_numpy()[:, None] - np.arange(n)[None, :]).astype(float)

    rows = spark.range(2_500).coalesce(1)
    got = scan.nearest(rows, distances, np.arange(n), 1, False).where("query_id < 2500").select("query_id", "id", "distance").collect()
    assert len(got) == 2_500 and all(r.id == r.query_id and r.distance == 0 for r in got)


def test_products_are_estimated_in_single_precision():
    x = np.random.default_rng(12).normal(size=(700, 9))
    x[600:] = x[:100]
    for name in ("ip", "l2", "cosine"):
        assert {s.dtype for _, s, _, _ in exact.Distances(name, x[:90]).tiles(x)} == {np.dtype(np.float32)}
        for odd in (x, x * 1e12, x * 1e20, x * 1e-25, np.where(np.arange(700)[:, None] % 9 == 4, x * 1e-19, x), np.where(np.arange(700)[:, None] == 7, 1e13, x)):
            distances, ids = exact.Distances(name, odd[::3]), np.random.default_rng(13).permutation(700)
            one, other = exact.Nearest(len(odd[::3]), 4), exact.Nearest(len(odd[::3]), 4)
            for at in range(0, 700, 250):
                one.add(ids[at : at + 250], distances.tiles(odd[at : at + 250]))
                other.add(ids[at : at + 250], distances.tiles(odd[at : at + 250], exact=True))
            assert (one.ids == other.ids).all() and (one.s == other.s).all()


def test_of_copies_the_least_ids_are_searched(spark):
    x = np.random.default_rng(14).normal(size=(30, 6))
    x[3] = np.float32(x[3])  # packed by four bytes, others by eight
    of = np.random.default_rng(15).choice(30, 3000, p=np.r_[0.7, np.full(29, 0.3 / 29)])
    rows = table(spark, x[of].tolist()).repartition(5)
    dealt = exact._by_content(rows, 4).toArrow().to_batches()
    searched = list(exact._first_copies(iter(dealt), 4, 64))
    ids, v = np.concatenate([i for i, _ in searched]), np.concatenate([y for _, y in searched])
    assert sorted(ids) == sorted(i for c in range(30) for i in np.flatnonzero(of == c)[:4]) and (v == x[of[ids]]).all()
    asked = rows.where("id % 20 = 0")
    for apart in (False, True):
        got = {(r.query_id, r.rank): (r.id, r.distance) for r in search.knn(asked, rows, 4, "ip", apart=apart).collect()}
        d = np.zeros((150, 3000))
        for j in range(6):
            d += x[of[::20], j, None] * x[of, j]
        for n, q in enumerate(range(0, 3000, 20)):
            s = np.where((np.arange(3000) == q) & apart, -np.inf, d[n])
            want = np.lexsort((np.arange(3000), -s))[:4]
            assert [got[q, r + 1] for r in range(4)] == [(i, d[n, i]) for i in want.tolist()]


def test_queries_are_sent_in_blocks_and_rows_are_dealt_once(spark, monkeypatch):
    x = np.random.default_rng(16).normal(size=(900, 6))
    x[800:] = x[:100]
    rows = table(spark, x.tolist())
    asked = rows.where("id % 3 = 0")
    key = lambda df: sorted((r.query_id, r.rank, r.id, r.distance) for r in df.collect())
    whole = key(search.knn(asked, rows, 3, "l2"))
    monkeypatch.setattr(exact, "QUERY_NUMBERS", 6 * 70)
    monkeypatch.setattr(exact, "QUERY_BLOCK", 100)  # three parts
    sizes = [len(ids) for ids, _ in exact._blocks_by_content(asked, 1000)]
    assert sizes == [70, 70, 70, 70, 20]
    found = search.knn(asked, rows, 3, "l2")
    assert key(found) == whole and len(whole) == 900
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan  # the rows are packed and dealt once for all blocks
    assert [(ids == np.sort(ids)).all() for ids, _ in exact.query_blocks(asked)] == [True] * 5
