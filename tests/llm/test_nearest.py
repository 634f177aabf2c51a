"""Nearest neighbours against all pairs in double precision."""

import functools
import math
import operator

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import rows_of
from timbrel.llm import entry, neighbours

SCHEMA = "vec_id long, embedding array<double>"


def cosine(a, b):
    dot = lambda x, y: functools.reduce(operator.add, (u * v for u, v in zip(x, y, strict=True)))  # noqa: E731  (sum() would compensate)
    scale = lambda x: [math.ldexp(u, -math.frexp(max(map(abs, x)))[1]) for u in x]
    a, b = scale(a), scale(b)
    return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))


def brute(rows, queries, k):
    def usable(some):
        return {(i, tuple(x + 0.0 for x in v)) for i, v in some if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}

    out = []
    for i, v in usable(queries):
        found = sorted((-cosine(v, w), j) for j, w in usable(rows) if j != i and len(v) == len(w))
        out += [(i, r, j, -minus) for r, (minus, j) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


ODD = [(None, [1.0, 2.0]), (100, None), (150, []), (200, [0.0, 0.0, 0.0]), (250, [1.0, None, 2.0]), (300, [float("nan"), 1.0, 1.0]), (350, [float("inf"), 1.0, 1.0]), (400, [1.0, 1.0]), (450, [1.0]), (451, [-3.0]), (500, [1e300, 1e300, -1e299]), (501, [1e-300, 1e-300, 0.0]), (550, [-0.0, 1.0, 0.0]), (551, [0.0, 1.0, 0.0])]


def rows(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    out = [(int(i), rng.normal(size=dim).round(3).tolist()) for i in rng.permutation(n)]
    hot = rng.normal(size=dim).tolist()
    return out + [(1000 + i, hot) for i in range(copies)]


@pytest.mark.parametrize("n,dim,copies,options", [(300, 3, 0, {}), (300, 8, 150, {"least": 16}), (120, 1500, 0, {"least": 50}), (60, 2, 40, {"block_bytes": 64}), (4, 5, 0, {}), (2000, 16, 700, {"least": 500})])
def test_nearest(spark, n, dim, copies, options):
    some = rows(n, dim, dim, copies) + (ODD if dim == 3 else [])
    # repeated rows, and one id with two vectors
    some += some[:7] + [(0, [1.0] * dim), (3, [2.0] * dim)]
    df = spark.createDataFrame(some, SCHEMA).withColumns({c: F.lit("own") for c in ("id", "v", "dim", "block", "query", "own", "score", "of", "n", "blocks")})
    asked = [r for r in some if r[0] is not None and (r[0] % 50 == 0 or 1000 <= r[0] < 1010)]
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0 or vec_id between 1000 and 1009"), **options)
    assert rows_of(got) == brute(some, asked, neighbours.K)


def test_small_tiles(spark, monkeypatch):
    for name, value in (("TILE_QUERIES", 7), ("TILE_ROWS", 9), ("PAIRS", 5), ("EXACT", 3)):
        monkeypatch.setattr(neighbours, name, value)
    some = rows(200, 6, 9, 30)
    ids, vectors = (np.array([r[0] for r in some]), [r[1] for r in some])
    import pyarrow as pa

    block = neighbours.Block(ids, pa.array(vectors), 5)
    got = {int(ids[t]): sorted(heap, reverse=True) for t, heap in block.nearest(ids, pa.array(vectors))}
    want = brute(some, some, 5)
    assert sorted(((q, r, -minus, score) for q, heap in got.items() for r, (score, minus) in enumerate(heap, 1)), key=str) == want


def test_bounds_hold_and_prune():
    m = np.random.default_rng(2).normal(size=(400, 96))
    m[0] = 0
    m[0, 5] = 1e-9
    norm = np.linalg.norm(m, axis=1)
    coded = neighbours.Coded(m, norm)
    assert coded.codes.dtype == np.int8
    estimate, off = neighbours.tile(coded, slice(0, 400), coded, slice(0, 400))
    exact = (m / norm[:, None]) @ (m / norm[:, None]).T
    assert (np.abs(estimate - exact) <= off).all() and off.max() < 0.05


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(50, [1.0, 2.0])], SCHEMA)
    for a, b in ((none, none), (one, none), (none, one), (one, one)):
        assert neighbours.nearest(a, b).count() == 0


def test_recall_of_the_query_is_one(spark):
    got = entry.QUERIES["op11_nearest_neighbours"](spark, "/root/testdata/sf0.1").toPandas()
    m = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(m["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = m["vec_id"].to_numpy()
    for q, own in got.groupby("query_id"):
        c = x @ x[np.searchsorted(ids, q)]
        c[ids == q] = -9
        best = np.lexsort((ids, -c.round(13)))[:5]
        assert own.sort_values("rank")["vec_id"].tolist() == ids[best].tolist()
    assert len(got) == 5 * (ids % 50 == 0).sum()
