"""Connected components of an edge table: stars within chunks of edges, then alternating large-star and small-star steps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.sources.tables import forget, settle

#: Edges that a task links at a time.
CHUNK = 1 << 19


def _stars(lo: pa.ChunkedArray, hi: pa.ChunkedArray) -> pa.RecordBatch:
    """(lo, hi): every node of the edges but the smallest of its component, with that one."""
    codes = pa.chunked_array([*lo.chunks, *hi.chunks]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(codes.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    x, y = np.split(rank[codes.indices.to_numpy()], 2)
    root = np.arange(len(order))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        # a root goes to the smallest one that an edge ties it to, if that is smaller
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    names = codes.dictionary.take(order)
    node = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(root[node])), names.take(pa.array(node))], names=["lo", "hi"])


def _linked(edges: DataFrame, chunk: int) -> tuple[DataFrame, bool]:
    """The settled edges with those of each chunk replaced by stars, and whether one chunk had all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if n and n + batch.num_rows > chunk:
                table, held, n = pa.Table.from_batches(held), [], 0
                yield _stars(table["lo"], table["hi"])
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if n:
            table = pa.Table.from_batches(held)
            yield _stars(table["lo"], table["hi"])

    tasks = math.ceil(edges.count() / chunk)
    out = settle(edges.coalesce(max(1, tasks)).mapInArrow(run, edges.schema))
    forget(edges)
    return out, tasks <= 1


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """(node, root): the smallest node of each component, for every node that has an edge.

    Each round first links the edges of each chunk among themselves, in parallel; if they were one chunk, that is all.
    Else it links every node's neighbours to its smallest one and writes the edges down, so
    lineage stays short; the number of rounds grows with the logarithm of a component's size.
    Edges of one node are pre-aggregated to its minimum, and no neighbour list is ever gathered.
    The minima are written before they are joined, so a hub's edges are a skewed join between two
    exchanges, which Spark splits.
    """
    now = settle(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi"))
    for _ in range(rounds):
        now, whole = _linked(now, chunk)
        if whole:
            break
        # large star: neighbours above a node go to its smallest neighbour; a node that is smaller than all its neighbours keeps its edges
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"))
        moved = now.withColumnRenamed("lo", "u").join(least.hint("merge"), "u", "left")
        large = settle(moved.select(F.coalesce("m", "u").alias("lo"), "hi").distinct())
        # small star: of a node with several neighbours below, these go to the smallest
        down = settle(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")).where("n > 1").drop("n"))
        loose = bool(down.limit(1).count())
        after = large
        if loose:
            small = large.join(down.hint("merge"), "hi", "left")
            small = small.select(F.coalesce("m", "lo").alias("lo"), F.when(F.col("lo") == F.col("m"), F.col("hi")).when(F.col("m").isNull(), F.col("hi")).otherwise(F.col("lo")).alias("hi"))
            after = settle(small.where("lo <> hi").distinct())
            forget(large)
        # done when every node has one root and no root has one
        loose = loose or bool(after.select("hi").join(after.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").limit(1).count())
        for old in (now, least, down):
            forget(old)
        now = after
        if not loose:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return roots.unionByName(now.select(F.col("hi").alias("node"), F.col("lo").alias("root")))
