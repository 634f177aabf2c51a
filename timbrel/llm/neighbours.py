"""Exact nearest neighbours of a set of queries among all vectors, by block matrix products of int8 codes.

Each vector, scaled to length 1, is rounded to int8 codes; the length of what rounding lost is kept.  A
tile is the product of the codes of some queries and some candidates (whole numbers, exact in
floating point), which gives every cosine to within a known bound.  The k-th largest lower bound of a
query tells which pairs may still be among its k nearest; only these are computed again from the
original vectors, in double precision, and go into the query's heap.  Candidates lie in blocks, each in
one task; the queries stream past every block, and the blocks' short lists are merged by heaps.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm.rows import give_back, quoted
from timbrel.sources.tables import settle

K = 5
#: Candidates of a block: at least (a smaller table is one block), and bytes of their doubles at most; blocks that are made, rather than larger ones, until that bound.
LEAST, BLOCK_BYTES, BLOCKS = 1024, 64 << 20, 64
#: Queries and candidates of a tile, pairs that are computed again at a time, and dimensions whose product of codes is exact in 32 bits.
TILE_QUERIES, TILE_ROWS, PAIRS, EXACT = 256, 4096, 1 << 16, 1024
#: What floating point may add to a bound.
SLACK = 1e-9
EVERY = 50


def _matrix(vectors: pa.Array) -> np.ndarray:
    m = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)
    # a power of two changes no digit and keeps squares in range
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added dimension by dimension."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Coded:
    """int8 codes of unit vectors: ``codes * scale`` is off by a vector of length ``lost``, and ``length`` long."""

    def __init__(self, m: np.ndarray, norm: np.ndarray):
        unit = m / norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.lost = np.linalg.norm(unit - near, axis=1)
        self.length = np.linalg.norm(near, axis=1)


def tile(a: Coded, i: slice, b: Coded, j: slice) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of some rows of each, and how far off each may be."""
    total = 0.0
    for d in range(0, a.codes.shape[1], EXACT):
        total = total + a.codes[i, d : d + EXACT].astype(np.float32) @ b.codes[j, d : d + EXACT].astype(np.float32).T
    estimate = total * a.scale[i, None] * b.scale[None, j]
    # x.y - x'.y' = x.(y - y') + (x - x').y', and x has length 1
    return estimate, b.lost[None, j] + a.lost[i, None] * b.length[None, j] + SLACK


class Block:
    """Candidates of one block: equal vectors are one, with the ids that can matter: the k + 1 smallest."""

    def __init__(self, ids: np.ndarray, vectors: pa.Array, k: int):
        m = _matrix(vectors)
        order = np.lexsort(np.vstack([ids[None], m.T[::-1]])) if len(ids) else np.zeros(0, np.int64)
        m, ids = m[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (m[1:] != m[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.m, self.k = m[first], k
        self.ids = [ids[a:b][: k + 1] for a, b in zip(first, [*first[1:], len(ids)], strict=True)]
        self.most = max(map(len, self.ids), default=0)
        self.norm = np.sqrt(summed(self.m, self.m))
        self.coded = Coded(self.m, self.norm)

    def nearest(self, ids: np.ndarray, vectors: pa.Array) -> Iterator[tuple[int, list[tuple[float, int]]]]:
        """(row, heap) of each query: its k nearest of this block as (cosine, -id), the least on top."""
        m = _matrix(vectors)
        norm = np.sqrt(summed(m, m))
        coded = Coded(m, norm)
        for begin in range(0, len(m), TILE_QUERIES):
            rows = slice(begin, min(begin + TILE_QUERIES, len(m)))
            heaps: list[list[tuple[float, int]]] = [[] for _ in range(rows.stop - begin)]
            # the least cosine that can still enter; a vector's own ids do not count, so one more stands below each
            floor = np.full(len(heaps), -np.inf)
            for c in range(0, len(self.m), TILE_ROWS):
                columns = slice(c, min(c + TILE_ROWS, len(self.m)))
                estimate, off = tile(coded, rows, self.coded, columns)
                low, wide = estimate - off, columns.stop - c
                if wide > self.k:  # the query itself may be one of them
                    floor = np.maximum(floor, np.partition(low, wide - self.k - 1, axis=1)[:, wide - self.k - 1])
                alive = estimate + off >= floor[:, None]
                q, j = np.nonzero(alive)
                for part in range(0, len(q), PAIRS):
                    x, y = q[part : part + PAIRS], j[part : part + PAIRS] + c
                    score = summed(m[x + begin], self.m[y]) / (norm[x + begin] * self.norm[y])
                    self._enter(heaps, ids, begin, x, y, score)
                    full = [t for t in np.unique(x) if len(heaps[t]) == self.k]
                    floor[full] = np.maximum(floor[full], [heaps[t][0][0] for t in full])
            for t, heap in enumerate(heaps):
                if heap:
                    yield begin + t, heap

    def _enter(self, heaps: list, ids: np.ndarray, begin: int, x: np.ndarray, y: np.ndarray, score: np.ndarray) -> None:
        # the best first, so that most of the others do not enter
        for t in np.lexsort((-score, x)):
            heap, own = heaps[x[t]], ids[begin + x[t]]
            if len(heap) == self.k and score[t] < heap[0][0]:
                continue
            for candidate in self.ids[y[t]]:
                if candidate != own:
                    push(heap, (float(score[t]), -int(candidate)), self.k)


def push(heap: list, item: tuple[float, int], k: int) -> None:
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def _runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of equal key columns."""
    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    for a, b in zip(first, [*first[1:], batch.num_rows], strict=True):
        yield tuple(c[a] for c in columns), batch.slice(a, b - a)


def _searched(k: int):
    """Kernel over rows (dim, block, query, own, id, v), sorted so that a block's candidates come before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            for key, rows in _runs(batch, 3):
                if key[:2] != now:
                    now, held, block = key[:2], [], None
                if not key[2]:
                    held.append(rows)
                    continue
                if not held and block is None:
                    continue  # nothing in this block
                if block is None:
                    candidates = pa.Table.from_batches(held)
                    block, held = Block(candidates["id"].to_numpy(), candidates["v"].combine_chunks(), k), []
                own = rows.column("own").to_numpy()
                ids = rows.column("id").to_numpy()
                out = [(int(own[t]), int(ids[t]), score, -minus) for t, heap in block.nearest(ids, rows.column("v")) for score, minus in heap]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["own", "query_id", "score", "vec_id"])
        give_back()

    return run


def _merged(k: int):
    """Kernel over rows (own, query_id, score, vec_id), a query's rows side by side: its k best, the best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []

        def told() -> pa.RecordBatch:
            best = sorted(heap, reverse=True)
            return pa.RecordBatch.from_arrays([pa.array([now[1]] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([-minus for _, minus in best], pa.int64()), pa.array([score for score, _ in best], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for key, rows in _runs(batch, 2):
                if key != now:
                    if heap:
                        yield told()
                    now, heap = (int(key[0]), int(key[1])), []
                for score, candidate in zip(rows.column("score").to_pylist(), rows.column("vec_id").to_pylist(), strict=True):
                    push(heap, (score, -candidate), k)
        if heap:
            yield told()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding", least: int = LEAST, block_bytes: int = BLOCK_BYTES, blocks: int = BLOCKS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``queries`` the k rows of ``vectors`` of the largest cosine.

    Ties go to the smaller id; a query's own id is no candidate; fewer rows than k are all found.  The score is the
    cosine in double precision, products added in order of dimension.  Rows of a null id, and vectors that are null,
    empty, zero or hold null or non-finite components, take no part; vectors of different length are not compared.
    Rows equal in id and vector count once; of one id's different vectors each is a candidate, and as queries
    each has ranks of its own.  Extra columns are ignored whatever their names; an empty table gives an empty one.

    Blocks are as few as their bytes allow, but ``blocks`` of at least ``least`` candidates where there are that many, so
    the queries are sent once a block: rows in all are candidates + queries * blocks.
    """
    spark = vectors.sparkSession
    n_partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def usable(rows: DataFrame) -> DataFrame:
        plain = rows.select(quoted(id_col).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v"))
        sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
        # zeros have one sign, so that equal vectors are equal rows
        return plain.where(F.col("id").isNotNull() & sound).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).dropDuplicates(["id", "v"]).withColumn("dim", F.size("v"))

    candidates, asked = settle(usable(vectors)), settle(usable(queries))
    sizes = settle(candidates.groupBy("dim").agg(F.count("*").alias("n")))
    few = F.ceil(F.col("n") * F.col("dim") * 8 / block_bytes)
    sizes = sizes.select(F.col("dim").alias("of"), F.greatest(few, F.least(F.ceil(F.col("n") / least), F.lit(blocks))).cast("int").alias("blocks"))
    dealt = candidates.join(sizes, F.col("dim") == F.col("of")).select("dim", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("query"), F.lit(0).cast("long").alias("own"), "id", "v")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    sent = asked.join(sizes, F.col("dim") == F.col("of")).select("dim", every, F.lit(True).alias("query"), F.xxhash64("v").alias("own"), "id", "v")
    tiles = dealt.unionByName(sent).repartition(n_partitions, "dim", "block").sortWithinPartitions("dim", "block", "query")
    lists = tiles.mapInArrow(_searched(k), "own long, query_id long, score double, vec_id long")
    return lists.repartition(n_partitions, "own", "query_id").sortWithinPartitions("own", "query_id").mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS norm FROM e),
p AS (SELECT q.vec_id AS query_id, q.v AS own, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) / (q.norm * c.norm) AS score
      FROM n q JOIN n c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= {K}
"""
