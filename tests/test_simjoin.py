"""The similarity join against all pairs."""

import numpy as np
import pytest

from tests.test_operators import frame
from timbrel.operators import simjoin, similarity


def exact(x, least):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = u @ u.T
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if c[i, j] >= least and x[i].any() and x[j].any()}


def clustered(n, dims, k, spread, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(k, dims))[rng.integers(0, k, n)] + spread * rng.normal(size=(n, dims))


def found(df):
    rows = df.collect()
    got = {(r["i"], r["j"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("least", [0.2, 0.9, 1.0])
@pytest.mark.parametrize("options", [{"block": 16}, {"block": 7, "pivots": 3}, {"sample": 2}])
def test_join_is_exact(spark, least, options):
    x = np.concatenate([clustered(150, 6, 5, 0.3), np.random.default_rng(2).normal(size=(60, 6)), np.zeros((2, 6)), -np.eye(6)])
    x[10], x[11] = x[12] * 3, x[12]
    least = least if least < 1 else 1 - 1e-12
    assert found(simjoin.similar_pairs(frame(spark, x), least, **options)) == exact(x, least)


def test_same_rows_as_all_pairs(spark):
    df = frame(spark, clustered(300, 12, 9, 0.2))
    want = {(r["i"], r["j"]): r["c"] for r in similarity.cosine_pairs(df, least=0.9).collect()}
    got = {(r["i"], r["j"]): r["c"] for r in simjoin.similar_pairs(df, 0.9, block=32).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and want


def test_cells_are_skipped(spark):
    df = frame(spark, clustered(3000, 16, 40, 0.1))
    join = simjoin.Join(df, 0.9, block=64)
    assert join.skipped() > 0.9
    assert found(join.pairs()) == found(similarity.cosine_pairs(df, least=0.9))
    plan = join.distinct_pairs()._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_copies_are_compared_once(spark):
    x = np.concatenate([np.tile(clustered(1, 5, 1, 0.1), (400, 1)), clustered(40, 5, 4, 0.1, 7)])
    join = simjoin.Join(frame(spark, x), 0.9)
    assert join.sent.where("not visitor").count() == 41
    assert found(join.pairs()) == exact(x, 0.9)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert simjoin.similar_pairs(none, 0.5).count() == 0
    odd = spark.createDataFrame([(1, None), (None, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, -0.0])], "id long, v array<double>")
    assert found(simjoin.similar_pairs(odd, 0.5)) == {(3, 4)}
    with pytest.raises(ValueError):
        simjoin.similar_pairs(odd, 0.0)


def test_vectors_are_sent_once(spark):
    """However many cells a vector visits, pairs leave the tasks that read the blocks; nothing is exchanged."""
    x = np.random.default_rng(9).normal(size=(400, 8))
    join = simjoin.Join(frame(spark, x), 0.5, block=24)
    pairs = join.distinct_pairs()
    assert found(pairs) == exact(x, 0.5) and join.skipped() < 0.5
    assert "Exchange" not in pairs._jdf.queryExecution().toString()
