"""Linear maps against numpy; vector files against their bytes."""

from functools import reduce

import numpy as np
import pytest

from vecquill import catalogue
from vecquill.operators import projection
from vecquill.sources.vecfiles import read_vectors, write_vectors

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return catalogue.base(spark, TABLES)


def array(df):
    return np.array([r.v for r in df.orderBy("id").collect()])


def test_pca(rows):
    x = array(rows)
    for whiten in (0.0, -0.5):
        got = array(projection.pca(rows, 8, whiten).apply(rows))
        values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:8]
        want = np.ones(8) if whiten else values
        assert np.allclose(got.mean(0), 0, atol=1e-9) and np.allclose(np.cov(got.T, bias=True), np.diag(want), atol=1e-8)


def test_centering_rotation_and_chain(rows):
    x = array(rows)
    turn = projection.random_rotation(64, 64)
    chain = projection.centering(rows).then(turn)
    assert np.allclose(array(chain.apply(rows)), (x - x.mean(0)) @ turn.matrix.T, atol=1e-9)
    assert np.allclose(array(chain.reverse().apply(chain.apply(rows))), x, atol=1e-9)


def test_odd_inputs(spark, rows):
    odd = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, None, None)], "id long, v array<double>, `__m x` string")
    got = {r.id: r.v for r in projection.random_rotation(2, 2).apply(odd).collect()}
    assert got[2] is None and np.isclose(np.linalg.norm(got[1]), 5**0.5)
    with pytest.raises(ValueError):
        projection.pca(rows.where("false"), 2)


@pytest.mark.parametrize("form, dtype", [("fvecs", "<f4"), ("ivecs", "<i4"), ("bvecs", "u1")])
def test_vector_files(spark, tmp_path, form, dtype):
    x = np.random.default_rng(1).integers(0, 200, (50, 12)).astype(dtype)
    (tmp_path / "x").write_bytes(b"".join(np.int32(12).tobytes() + r.tobytes() for r in x))
    got = read_vectors(spark, str(tmp_path / "x"), 12, form).orderBy("id").collect()
    assert [r.id for r in got] == list(range(50)) and np.array_equal(np.array([r.v for r in got]), x)
    with pytest.raises(ValueError):
        read_vectors(spark, str(tmp_path / "x"), 12, "other")


def test_written_vectors_read_back(spark, rows, tmp_path):
    write_vectors(rows, f"{tmp_path}/out", records=200)
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc"))
    assert len(names) > 1 and all(n.endswith(".fvecs") for n in names)
    (tmp_path / "one").write_bytes(b"".join((tmp_path / "out" / n).read_bytes() for n in names))
    got = read_vectors(spark, str(tmp_path / "one"), 64).orderBy("id").collect()
    assert np.allclose(np.array([r.v for r in got]), array(rows))


def test_maps_sum_in_order_and_keep_what_is_odd(spark):
    x = np.random.default_rng(3).normal(size=(300, 6))
    x[150:] = x[:150]
    turn = projection.LinearMap(np.random.default_rng(4).normal(size=(4, 6)), np.arange(4.0))
    rows = spark.createDataFrame([(i, f"t{i}", v) for i, v in enumerate(x.tolist())] + [(300, None, None), (301, "a", [1.0]), (302, "b", [None] + [1.0] * 5)], "id long, t string, v array<double>")
    plan = turn.apply(rows)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan and "CartesianProduct" not in plan
    got = {r.id: (r.t, r.v) for r in turn.apply(rows.repartition(5)).collect()}
    for i in range(300):
        want = [reduce(lambda s, ab: s + ab[0] * ab[1], zip(x[i].tolist(), m), 0.0) + c for m, c in zip(turn.matrix.tolist(), turn.bias.tolist())]
        assert got[i] == (f"t{i}", want)
    assert got[300] == (None, None) and got[301] == ("a", [None] * 4) and got[302] == ("b", [None] * 4)
