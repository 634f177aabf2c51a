"""The condensed tree by contraction against the published algorithm on all edges in one place."""

import numpy as np
import pytest

from tests.test_operators import same_partition
from timbrel.operators import density, hierarchy


def spanning(n, kind, seed):
    """Edges (w, lo, hi) of a random spanning tree."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(1, n):
        j = {"path": i - 1, "star": 0, "random": int(rng.integers(0, i)), "blobs": int(rng.integers(i // 12 * 12, i)) if i % 12 else int(rng.integers(0, i))}[kind]
        w = {"path": float(i), "star": float(rng.integers(1, 9))}.get(kind) or (float(rng.integers(1, 5)) if kind == "random" else float(rng.random() + (8 if i % 12 == 0 else 0)))
        out.append((w, j, i))
    names = rng.permutation(n)
    return [(w, int(min(names[a], names[b])), int(max(names[a], names[b]))) for w, a, b in out]


@pytest.mark.parametrize("n,kind,least", [(60, "random", 3), (40, "path", 4), (120, "blobs", 5), (5, "random", 9), (1, "random", 2)])
def test_cut(spark, n, kind, least):
    edges = spanning(n, kind, n + least)
    want = density.condensed(n, edges, least) if n > 1 else np.array([-1])
    df = spark.createDataFrame(edges, "w double, lo long, hi long")
    got = {r["id"]: r["clust"] for r in hierarchy.cut(df, spark.range(n), least).collect()}
    assert sorted(got) == list(range(n))
    mine = [got[i] for i in range(n)]
    assert [c == -1 for c in mine] == [c == -1 for c in want] and same_partition(mine, list(want))


@pytest.mark.parametrize("seed", range(20))
def test_nodes_of_the_tree(seed):
    """Jumps up the tree end at the highest node whose own edge is less than the one asked for."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 300))
    records = np.array(spanning(n, ["random", "path", "blobs", "star"][seed % 4], seed), [("w", float), ("lo", np.int64), ("hi", np.int64)])
    tree = hierarchy.Tree(np.arange(n), records, records["lo"], records["hi"])
    leaf = rng.integers(0, n, 200)
    edge = records[rng.integers(0, n - 1, 200)]
    for k, start, rank in zip(tree.cluster(leaf, edge), leaf, np.searchsorted(tree.edges, edge), strict=True):
        while tree.parent[start] >= 0 and tree.parent[start] - n < rank:
            start = tree.parent[start]
        assert k == start


def test_too_many_clusters(spark):
    edges = spanning(60, "random", 3)
    with pytest.raises(ValueError, match="min_cluster_size"):
        hierarchy.cut(spark.createDataFrame(edges, "w double, lo long, hi long"), spark.range(60), 2, limit=2)
    with pytest.raises(ValueError, match="at least 2"):
        hierarchy.cut(spark.createDataFrame(edges, "w double, lo long, hi long"), spark.range(60), 1)
