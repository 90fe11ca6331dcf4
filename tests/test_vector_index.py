"""Index descriptions, codes and the index as a whole against exact search and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecquill import catalogue
from vecquill.operators import codecs, search, vector_index
from vecquill.plans.spec import parse

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return catalogue.base(spark, TABLES)


@pytest.fixture(scope="module")
def asked(rows):
    return catalogue.asked(rows)


def pairs(df):
    return {(r.query_id, r.id) for r in df.collect()}


def test_descriptions():
    s = parse("IDMap2,OPQ8_32,IVF4k_HNSW32,PQ8x4fs,Refine(SQ8)", 64, "InnerProduct")
    assert (s.metric, s.lists, s.code.kind, s.code.sizes, s.refine.code.name, s.inner_dimensions) == ("ip", 4096, "pq", (4,) * 8, "SQ8", 32)
    assert parse("PCAWR16,L2norm,HNSW32,SQ4", 64).type_name() == "HNSWScalarQuantizer" and parse("Flat", 3).code_size() == 12
    assert parse("RQ2x8_1x4", 8).code.sizes == (8, 8, 4) and parse("LSH100rt", 64).code.thresholds and not parse("Flat", 8).needs_training
    for bad in ("", "Nope", "PQ7", "IVF16", "IVF0,Flat", "Flat,Flat", "PCA99,Flat", "FlatDedup", "OPQ5,PQ8"):
        with pytest.raises(ValueError):
            parse(bad, 64)
    with pytest.raises(ValueError):
        parse("LSH", 64, "ip")


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("text", ["Flat", "IVF8,Flat", "HNSW16", "IDMap,Pad80,RR80,Flat"])
def test_exact_kinds_equal_exact_search(rows, asked, text, metric):
    index = vector_index.open_factory(text, 64, metric)
    index = (index.train(rows) if index.spec.needs_training else index).add(rows)
    assert pairs(index.search(asked, 5, nprobe=8)) == pairs(search.knn(asked, rows, 5, metric))


@pytest.mark.parametrize("text, least", [("SQ8", 0.95), ("SQ6", 0.8), ("SQ4", 0.5), ("SQfp16", 0.98), ("SQbf16", 0.9), ("PQ16", 0.5), ("RQ6x6", 0.2), ("RaBitQ", 0.3), ("LSH256r", 0.3), ("PCA32,SQ8", 0.4), ("IVF8,SQ8", 0.95), ("IVF8,PQ16,RFlat", 0.9), ("OPQ16,PQ16", 0.5), ("ITQ,LSH", 0.15), ("IVF4,RaBitQ,Refine(SQfp16)", 0.7)])
def test_codes_find_the_near(rows, asked, text, least):
    index = vector_index.open_factory(text, 64)
    index = (index.train(rows) if index.spec.needs_training else index).add(rows)
    want = pairs(search.knn(asked, rows, 5, "l2"))
    assert len(pairs(index.search(asked, 5, nprobe=8)) & want) / len(want) >= least


def test_codes_lose_little():
    x = np.random.default_rng(3).normal(size=(400, 16))
    for text, most in (("SQ8", 0.001), ("SQ4", 0.05), ("SQfp16", 1e-6), ("SQbf16", 1e-4), ("PQ8", 0.2), ("RQ4x6", 0.6), ("RaBitQ", 0.6)):
        code = parse(text, 16).code
        model = codecs.train(code, x)
        raw = codecs.encode(code, model, x)
        assert ((codecs.decode(code, model, raw, 16) - x) ** 2).mean() / x.var() < most
        assert text == "RaBitQ" or raw.shape[1] == parse(text, 16).code_size()


def test_content_and_files(spark, rows, asked, tmp_path):
    index = vector_index.open_factory("PCA48,IVF4,SQ8,RFlat", 64).train(rows).add(rows.where("id < 300"))
    index = index.add(rows.where("id >= 300 and id < 320").select("v"))
    assert index.count() == 320 and index.next_id() == 320
    index = index.remove(F.col("id") % 2 == 1).update(rows.where("id = 20"))
    assert index.count() == 160
    index.save(f"{tmp_path}/x")
    again = vector_index.open_index(spark, f"{tmp_path}/x")
    assert sorted(map(tuple, again.search(asked, 3, 4).collect())) == sorted(map(tuple, index.search(asked, 3, 4).collect()))
    assert again.merge(index, 1000).count() == 320 and again.reset().next_id() == 0
    near = {r.id: r.v for r in again.reconstruct(F.col("id") < 20).collect()}
    x = {r.id: r.v for r in rows.where("id < 20").collect()}
    assert sorted(near) == list(range(0, 20, 2)) and all(np.linalg.norm(np.subtract(near[i], x[i])) < 0.9 for i in near)
    assert pairs(again.search(asked, 3, 4, where=F.col("id") < 100)) and all(i < 100 for _, i in pairs(again.search(asked, 3, 4, where=F.col("id") < 100)))
    got = index.range_search(asked, 1.0, 4)
    assert got.where("distance >= 1.0").count() == 0


def test_errors(spark, rows):
    index = vector_index.open_factory("IVF4,Flat", 64)
    with pytest.raises(ValueError):
        index.add(rows)
    with pytest.raises(ValueError):
        index.train(rows.where("false"))
    with pytest.raises(ValueError):
        vector_index.open_factory("IVF4,Flat", 32).train(rows)
    flat = vector_index.open_factory("Flat", 64)
    with pytest.raises(ValueError):
        flat.search(rows)
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 64)], "id long, v array<double>")
    assert flat.add(odd).count() == 1 and flat.add(odd.where("false")).count() == 0
    one = flat.add(spark.createDataFrame([(0, [1.0] * 64)], "id long, v array<double>"))
    assert one.next_id() == 1
    with pytest.raises(Exception, match="another size"):
        flat.add(spark.createDataFrame([(1, [1.0])], "id long, v array<double>")).rows.collect()


@pytest.mark.parametrize("text, least", [("LSQ6x5", 0.25), ("PRQ4x2x5", 0.3), ("PLSQ4x2x5", 0.3), ("ZnLattice8x24_6", 0.4), ("IVF8,ITQ32,SH1.5", 0.1), ("IVF8,PCAR32,SH0.6m", 0.05), ("IVF8,PCAR32,SH0.6c", 0.05), ("IMI2x3,PQ16", 0.4), ("Residual8,PQ16x6", 0.4), ("Residual2x2,PQ16x6", 0.4), ("IVF8_HNSW16,SQ8", 0.95), ("IVF8(NSG16),Flat", 0.99), ("HNSW16,SQ8", 0.9), ("NSG16,PQ32", 0.5), ("IVF8,FlatDedup", 0.999), ("PQ16x4fs", 0.3), ("IVF8,PQ8+16", 0.5), ("IVF8,RQ6x5", 0.25)])
def test_further_kinds_find_the_near(rows, asked, text, least):
    index = vector_index.open_factory(text, 64)
    index = (index.train(rows) if index.spec.needs_training else index).add(rows)
    want = pairs(search.knn(asked, rows, 5, "l2"))
    share = len(pairs(index.search(asked, 5, nprobe=8 if "IMI" not in text else 64)) & want) / len(want)
    assert share >= least, share


def test_better_sums_of_entries():
    x = np.random.default_rng(8).normal(size=(600, 12))
    code = parse("RQ4x4", 12).code
    model = codecs.train(code, x)
    books = [model[f"book{m}"] for m in range(4)]
    off = lambda codes, b: ((sum(k[codes[:, m]] for m, k in enumerate(b)) - x) ** 2).sum()
    assert off(codecs.beam_codes(x, books, 8), books) <= off(codecs.beam_codes(x, books, 1), books)
    assert off(codecs.searched_codes(x, books), books) <= off(codecs.beam_codes(x, books, 1), books)
    fitted = codecs.train(parse("LSQ4x4", 12).code, x)
    assert off(codecs.searched_codes(x, [fitted[f"book{m}"] for m in range(4)]), [fitted[f"book{m}"] for m in range(4)]) < off(codecs.beam_codes(x, books, 1), books)


def test_lattice_points_are_the_nearest():
    import itertools

    x = np.random.default_rng(9).normal(size=(40, 3))
    every = np.array([p for p in itertools.product(range(-3, 4), repeat=3) if sum(v * v for v in p) == 9])
    got = codecs.lattice_points(x, 9)
    assert (np.abs(got) ** 2).sum(1).tolist() == [9] * 40 and np.allclose((got * x).sum(1), (x @ every.T).max(1))
    with pytest.raises(ValueError):
        codecs.lattice_points(np.ones((1, 1)), 3)


def test_row_wise_codes(rows):
    for text in ("MinMax,SQ8", "MinMaxFP16,SQ4"):
        index = vector_index.open_factory(text, 64).train(rows)
        coded = index.encode(rows)
        assert len(coded.first().code) == index.spec.code_size()
        near, x = {r.id: r.v for r in index.decode(coded).collect()}, {r.id: r.v for r in rows.collect()}
        assert max(np.abs(np.subtract(near[i], x[i])).max() for i in x) < (0.01 if "SQ8" in text else 0.1)
        with pytest.raises(ValueError):
            index.add(rows)


def test_refused_descriptions():
    for bad in ("IVF8(PQ4),Flat", "Residual3x4,PQ8", "IMI2x20,Flat", "IMI2x4", "RCQ2x8", "SH1.5", "PRQ3x2x8", "BFlat", "HNSW16,FlatDedup", "MinMax,MinMax,SQ8"):
        with pytest.raises(ValueError):
            parse(bad, 64)
    with pytest.raises(ValueError):
        parse("IMI2x4,Flat", 64, "ip")


def test_saved_graphs_and_read_only(spark, rows, asked, tmp_path):
    index = vector_index.open_factory("HNSW16", 64).add(rows)
    index.save(f"{tmp_path}/g")
    again = vector_index.open_index(spark, f"{tmp_path}/g", readonly=True)
    assert pairs(again.search(asked, 5)) == pairs(index.search(asked, 5))
    for change in (lambda: again.add(rows), lambda: again.remove(F.col("id") > 1), lambda: again.reset(), lambda: again.update(rows), lambda: again.merge(again)):
        with pytest.raises(ValueError):
            change()
    two = vector_index.open_factory("HNSW16", 64).add(rows.where("id < 90")).add(rows.where("id >= 90"))
    assert two.built_graphs().count() == 2 and len(pairs(two.search(asked, 5)) & pairs(index.search(asked, 5))) > 0.9 * len(pairs(index.search(asked, 5)))
    merged = vector_index.merge_saved(spark, [f"{tmp_path}/g", f"{tmp_path}/g"], f"{tmp_path}/m", shift=True)
    assert merged.count() == 2 * rows.count() and merged.next_id() == 2 * index.next_id()
    assert pairs(again.search(asked, 3, where=F.col("id") % 2 == 0)) == pairs(search.knn(asked, rows.where("id % 2 = 0"), 3, "l2"))


def test_trainer_and_packed_vectors(spark, rows, asked, tmp_path):
    from vecquill.functions.vectors import packer

    trainer = vector_index.Trainer(spark, f"{tmp_path}/t", vector_index.open_factory("IVF4,SQ8", 64))
    with pytest.raises(ValueError):
        trainer.train()
    trainer.add(rows.where("id % 2 = 0").select("v"))
    trainer.add_half(rows.where("id % 2 = 1").select(packer(half=True)("v").alias("v")))
    index = trainer.train()
    packed = rows.select(F.col("id").cast("string").alias("id"), packer()("v").alias("v"))
    assert index.add(packed).count() == rows.count()
    with pytest.raises(ValueError):
        vector_index.Trainer(spark, "x", index)
    short = vector_index.Trainer(spark, f"{tmp_path}/s", vector_index.open_factory("IVF4,SQ8", 32))
    short.add(rows.select("v"))
    with pytest.raises(ValueError):
        short.train()


def test_ids_that_are_given_out_do_not_depend_on_the_order(rows):
    flat = vector_index.open_factory("Flat", 64)
    one = {(r.id, tuple(r.v)) for r in flat.add(rows.select("v")).reconstruct().collect()}
    other = {(r.id, tuple(r.v)) for r in flat.add(rows.repartition(7).orderBy(F.rand()).select("v")).reconstruct().collect()}
    assert one == other and sorted(i for i, _ in one) == list(range(rows.count()))


def test_explored_parameters_and_long_searches(spark, rows, asked, tmp_path):
    index = vector_index.open_factory("IVF8,Flat", 64).train(rows).add(rows)
    truth = search.knn(asked, rows, 5, "l2")
    found = {r.nprobe: r for r in search.explore(index, asked, truth, [1, 4, 8], 5).collect()}
    assert found[8].recall == 1.0 and found[1].recall <= found[4].recall and any(r.best for r in found.values())
    got = search.search_in_blocks(index, asked, f"{tmp_path}/b", 3, 5, nprobe=8)
    assert pairs(got) == pairs(truth)
    (tmp_path / "b" / "block=1" / "_SUCCESS").unlink()
    again = search.search_in_blocks(index.remove(F.col("id") >= 0).add(rows), asked, f"{tmp_path}/b", 3, 5, nprobe=8)
    assert pairs(again) == pairs(truth)


def test_binary_indexes(spark, rows):
    from vecquill.operators.binary import BinaryIndex, real_to_binary

    codes = rows.select("id", real_to_binary(F.col("v")).alias("code"))
    some = codes.where("id % 20 = 0")
    flat = pairs(BinaryIndex.open("BFlat", 64).add(codes).search(some, 5))
    near = BinaryIndex.open("BIVF4", 64).train(codes).add(codes).search(some, 5, nprobe=2)
    walked = BinaryIndex.open("BHNSW16", 64).add(codes).search(some, 5, width=100)
    assert len(pairs(near) & flat) / len(flat) > 0.4 and len(pairs(walked) & flat) / len(flat) > 0.7
    for bad in ("B", "BHash", "BHash9x8", "BHash2x40", "BFlat8"):
        with pytest.raises(ValueError):
            BinaryIndex.open(bad, 64)
    with pytest.raises(ValueError):
        BinaryIndex.open("BIVF4", 64).add(codes)
    with pytest.raises(Exception, match="another size"):
        BinaryIndex.open("BFlat", 32).add(codes).rows.collect()


def test_linear_maps_are_made_by_the_coder(rows):
    index = vector_index.open_factory("Pad80,RR80,Flat", 64)
    index = index.train(rows).add(rows) if index.spec.needs_training else index.add(rows)
    plan = index.rows._jdf.queryExecution()
    assert "zip_with" not in plan.toString() and plan.executedPlan().toString().count("MapInArrow") == 1
    moved = {r.id: np.array(r.v, np.float32).tobytes() for r in index._moved(rows).collect()}
    assert {r.id: bytes(r.code) for r in index.rows.collect()} == moved
