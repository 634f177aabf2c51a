"""Density clusters of any number of points: the condensed tree by contraction, not point by point in one place.

The spanning tree of mutual reachability grows by rounds of nearest components, whose members are a
table.  Then components of fewer points than a cluster are contracted.  The next edge to join a
component is its least one; so of small components that point to one another along these edges, those
that end at a large component fall from it, each at its own edge's level, however long the way; and a pair
that points at each other is joined.  A round makes the least of the small components larger, so there
are about as many rounds as a cluster has points.  What is left is the tree of the smallest clusters
alone, the condensed tree itself, which is cut in one place; all points then find their cluster in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.operators.components import components
from timbrel.sources.tables import forget, settle

#: Smallest clusters whose tree is cut in one place, at most: some 60 bytes each.
TREE_LIMIT = 4_000_000
#: Steps up the tree that one jump saves, by level.
JUMP = 16
EDGE = ("w", "lo", "hi")


def joined(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, part) after the edges (lo, hi) have joined the parts of their ends; parts take the smallest name."""
    at = lambda end: parts.select(F.col("id").alias(end), F.col("part").alias(f"part_{end}"))
    links = edges.select("lo", "hi").join(at("lo"), "lo").join(at("hi"), "hi").select(F.col("part_lo").alias("a"), F.col("part_hi").alias("b"))
    roots = components(links).select(F.col("node").alias("part"), "root")
    return settle(parts.join(roots, "part", "left").select("id", F.coalesce("root", "part").alias("part")))


def contracted(edges: DataFrame, points: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Of a spanning tree (w, lo, hi) over ``points`` (id): the edges between components of ``least`` points or more,
    (w, lo, hi, a, b), and (id, part, w, lo, hi): each point's component and the edge it falls from it at.

    Where all points together are fewer, the points have no edge.
    """
    falls = ("fall_w", "fall_lo", "fall_hi")
    kinds = dict(edges.dtypes)
    none = [F.lit(None).cast(kinds[c]).alias(f) for c, f in zip(EDGE, falls, strict=True)]
    held = settle(points.select("id", F.col("id").alias("part"), *none))
    left = settle(edges.select(*EDGE, F.col("lo").alias("a"), F.col("hi").alias("b")))
    while True:
        sizes = settle(held.groupBy("part").agg(F.count("*").alias("size")))
        small = sizes.where(F.col("size") < least).select("part", "size")
        either = left.select(F.col("a").alias("part"), F.col("b").alias("other"), *EDGE).unionByName(left.select(F.col("b").alias("part"), F.col("a").alias("other"), *EDGE))
        first = settle(either.join(small, "part").groupBy("part", "size").agg(F.min(F.struct(*EDGE, "other")).alias("e")).select("part", "size", "e.*"))
        if not first.limit(1).count():
            break
        # small components by the way they point; each group ends at one large component or at one pair
        there = first.select(F.col("part").alias("other"), F.col("size").alias("other_size"), *[F.col(c).alias(f"other_{c}") for c in EDGE])
        pointed = settle(first.join(there, "other", "left"))
        inner = pointed.where("other_size is not null").select(F.col("part").alias("a"), F.col("other").alias("b"))
        groups = components(inner) if inner.limit(1).count() else inner.select(F.col("a").alias("node"), F.col("b").alias("root"))
        grouped = settle(pointed.join(groups.withColumnRenamed("node", "part"), "part", "left").withColumn("root", F.coalesce("root", "part")))
        exits = grouped.where("other_size is null").select("root", F.col("other").alias("to"))
        raked = grouped.join(exits, "root").select("part", "to", *[F.col(c).alias(f"new_{c}") for c in EDGE])
        mutual = F.lit(True)
        for c in EDGE:
            mutual = mutual & (F.col(c) == F.col(f"other_{c}"))
        large = (F.col("size") + F.col("other_size")) >= least
        paired = grouped.where(mutual).select("part", F.least("part", "other").alias("to"), *[F.when(large, F.col(c)).alias(f"new_{c}") for c in EDGE])
        moves = settle(raked.unionByName(paired))
        again = held.join(moves, "part", "left").select("id", F.coalesce("to", "part").alias("part"), *[F.coalesce(f"new_{c}", f).alias(f) for c, f in zip(EDGE, falls, strict=True)])
        to = moves.select("part", "to")
        ends = left
        for end in ("a", "b"):
            ends = ends.join(to.select(F.col("part").alias(end), F.col("to").alias(f"to_{end}")), end, "left").withColumn(end, F.coalesce(f"to_{end}", end)).drop(f"to_{end}")
        old = (held, left, sizes, first, pointed, grouped, moves)
        held, left = settle(again), settle(ends.where("a <> b").select(*EDGE, "a", "b"))
        for table in old:
            forget(table)
    return left, held.select("id", "part", *[F.col(f).alias(c) for c, f in zip(EDGE, falls, strict=True)])


class Tree:
    """The condensed tree: node k below the number of leaves is a smallest cluster, node leaves + k is what the k-th edge splits."""

    def __init__(self, leaves: np.ndarray, edges: np.ndarray, a: np.ndarray, b: np.ndarray):
        order = np.argsort(edges, order=EDGE)
        self.names, self.edges = np.sort(leaves), edges[order]
        n = len(leaves)
        self.n, self.parent = n, np.full(2 * n - 1, -1)
        self.children = np.zeros((max(0, n - 1), 2), np.int64)
        above, node = list(range(n)), list(range(n))

        def root(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        ends = zip(np.searchsorted(self.names, a[order]).tolist(), np.searchsorted(self.names, b[order]).tolist(), strict=True)
        for k, (x, y) in enumerate(ends):
            x, y = root(x), root(y)
            self.children[k] = node[x], node[y]
            self.parent[[node[x], node[y]]] = n + k
            above[y] = x
            node[x] = n + k
        self.jumps = [self.parent]
        while JUMP ** len(self.jumps) < 2 * n - 1:
            up = self.jumps[-1]
            for _ in range(JUMP - 1):
                up = np.where(up >= 0, self.jumps[-1][up], -1)
            self.jumps.append(up)

    def cluster(self, part: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The node that a point of each leaf ``part`` falls from at its edge: the highest whose own edge is a lesser one."""
        at = np.searchsorted(self.names, part)
        rank = np.searchsorted(self.edges, edges) if len(self.edges) else np.zeros(len(at), np.int64)
        for up in reversed(self.jumps):
            while True:
                to = up[at]
                go = (to >= 0) & (to - self.n < rank)
                if not go.any():
                    break
                at = np.where(go, to, at)
        return at

    def labels(self, count: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The label of each node's points, -1 for noise, from the points that fall from each node and the sum of their levels."""
        n = self.n
        split = 1 / np.maximum(self.edges["w"], 1e-12)
        birth = np.where(self.parent >= 0, split[np.maximum(self.parent - n, 0)] if n > 1 else 0.0, 0.0)
        size, stability = count.astype(float), level - birth * count
        best, chosen = np.zeros(2 * n - 1), np.zeros(2 * n - 1, bool)
        for c in range(2 * n - 2):  # all but the root, children first
            if c >= n:
                below = size[self.children[c - n]].sum()
                size[c] += below
                stability[c] += below * (split[c - n] - birth[c])
            under = best[self.children[c - n]].sum() if c >= n else -np.inf
            chosen[c] = stability[c] >= under
            best[c] = stability[c] if chosen[c] else under
        label, number = np.full(2 * n - 1, -1), 0
        for c in range(2 * n - 3, -1, -1):
            up = label[self.parent[c]]
            if up >= 0:
                label[c] = up
            elif chosen[c]:
                label[c], number = number, number + 1
        return label


def _edges(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    out = np.zeros(table.num_rows, [("w", float), ("lo", np.int64), ("hi", np.int64)])
    for c in EDGE:
        out[c] = table.column(c).to_numpy()
    return out


def cut(edges: DataFrame, points: DataFrame, min_cluster_size: int, limit: int = TREE_LIMIT) -> DataFrame:
    """(id, clust): labels from 0 of the points (id) of a spanning tree (w, lo, hi), -1 for noise; lo and hi are ids."""
    if min_cluster_size < 2:
        raise ValueError("a cluster has at least 2 points")
    spark = edges.sparkSession
    big, falls = contracted(edges, points, min_cluster_size)
    falls = falls.where("w is not null")
    every = points.select("id")
    leaves = falls.select("part").distinct()
    n = leaves.count()
    if n < 2:  # one cluster or none is no split of all points
        return every.select("id", F.lit(-1).alias("clust"))
    if n > limit:
        raise ValueError(f"{n} smallest clusters; the tree of {limit} at most is cut: raise min_cluster_size")
    table = big.toArrow()
    tree = Tree(leaves.toArrow().column("part").to_numpy(), _edges(table), table.column("a").to_numpy(), table.column("b").to_numpy())
    sent = spark.sparkContext.broadcast(tree)  # ``limit`` leaves at most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = _edges(batch)
            node = sent.value.cluster(batch.column("part").to_numpy(), edges)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(node), pa.array(1 / np.maximum(edges["w"], 1e-12))], names=["id", "node", "level"])

    found = settle(falls.mapInArrow(find, "id long, node long, level double"))
    count, level = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1)
    for r in found.groupBy("node").agg(F.count("*").alias("n"), F.sum("level").alias("level")).toLocalIterator():  # one row a node
        count[r["node"]], level[r["node"]] = r["n"], r["level"]
    labels = spark.sparkContext.broadcast(tree.labels(count, level).astype(np.int32))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(labels.value[batch.column("node").to_numpy()])], names=["id", "clust"])

    return found.select("id", "node").mapInArrow(name, "id long, clust int")
