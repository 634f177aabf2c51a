"""Connected components against a plain union-find, by one chunk of edges and by many."""

import numpy as np
import pytest

from timbrel.operators.components import components


def plain(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def graph():
    rng = np.random.default_rng(5)
    path = rng.permutation(200).tolist()
    star = [(300, 301 + int(k)) for k in rng.permutation(150)] + [(299, 460), (460, 450)]
    loose = [(int(x), int(y)) for x, y in rng.integers(500, 900, (260, 2)) if x != y]
    edges = [*zip(path, path[1:], strict=False), *star, *loose]
    return edges + [(b, a) for a, b in edges[:40]]


@pytest.mark.parametrize("chunk", [1 << 19, 64])
def test_chunks_of_any_size_give_the_smallest_node(spark, chunk):
    edges = graph()
    df = spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long").repartition(5)
    got = [(r["node"], r["root"]) for r in components(df, chunk=chunk).collect()]
    assert len(got) == len(dict(got)) and dict(got) == plain(edges)


def test_nodes_of_bytes_go_by_their_bytes(spark):
    name = lambda k: bytes([k % 7 * 40, k // 7, 255])
    edges = [(name(a % 200), name(b % 200)) for a, b in graph() if name(a % 200) != name(b % 200)]
    df = spark.createDataFrame(edges, "a binary, b binary")
    assert {bytes(r["node"]): bytes(r["root"]) for r in components(df).collect()} == plain(edges)


def test_few_edges_are_linked_in_few_jobs(spark):
    edges = spark.createDataFrame(graph(), "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("few", "few")
    try:
        components(edges).collect()
        jobs = len(sc.statusTracker().getJobIdsForGroup("few"))
    finally:
        sc._jsc.clearJobGroup()
    assert jobs <= 8  # over 30 by the star steps
