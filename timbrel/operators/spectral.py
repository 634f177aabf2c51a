"""Spectral clustering on the affinity graph: spectrum, eigengap, k-means."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timbrel.operators import similarity
from timbrel.sources.tables import forget, settle

MIN_SPEAKERS, MAX_SPEAKERS = 1, 14
#: Points up to which the Laplacian is solved densely in one task (N * N doubles); block Davidson beyond.
DENSE_LIMIT = 5000

TILE = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("i", pa.binary()), ("j", pa.binary()), ("w", pa.binary())])
#: A block of nodes with its vectors that join the basis next, their inner products, those with the basis, and squared residuals.
FRESH = pa.schema([("p", pa.int64()), ("x", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("r", pa.binary())])
#: A block of nodes with its rows of the basis v and of L times it, their inner products v'v and v'lv, and the largest degree.
BASIS = pa.schema([("p", pa.int64()), ("ids", pa.binary()), ("d", pa.binary()), ("v", pa.binary()), ("lv", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("top", pa.float64())])
FRESH_COLUMNS, BASIS_COLUMNS = "p long, x binary, a binary, b binary, r binary", "p long, ids binary, d binary, v binary, lv binary, a binary, b binary, top double"
#: Residuals beyond those asked for that join in a round, and residuals are divided by degrees less the value, no nearer to 0 than this share of the largest degree.
GUARD, NEAREST = 10, 0.005
#: Cells for each edge of a tile from which it is multiplied edge by edge.
SPARSE = 250


def dense_spectrum(edges: DataFrame, ids: DataFrame, vectors: int) -> DataFrame:
    """(id, values, u): all nodes' rows of the first ``vectors`` eigenvectors; values are the eigenvalues."""
    tagged = edges.select("i", "j", "w").unionByName(ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("w"))).withColumn("one", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(pdf["i"].to_numpy())
        a, b = np.searchsorted(nodes, pdf["i"].to_numpy()), np.searchsorted(nodes, pdf["j"].to_numpy())
        lap = np.zeros((len(nodes), len(nodes)))
        np.add.at(lap, (a, b), -pdf["w"].to_numpy())
        np.fill_diagonal(lap, 0.0)
        np.fill_diagonal(lap, np.abs(lap).sum(axis=1))
        values, rows = np.linalg.eigh(lap)
        k = min(vectors, len(nodes))
        rows = _signed(rows[:, :k])
        return pd.DataFrame({"id": nodes, "values": [values[:k].tolist()] * len(nodes), "u": rows.tolist()})

    return tagged.groupBy("one").applyInPandas(run, "id long, values array<double>, u array<double>")


def _signed(u: np.ndarray) -> np.ndarray:
    """Signs fixed: the entry of largest magnitude of each vector is positive."""
    top = np.abs(u).argmax(axis=0)
    return u * np.where(u[top, np.arange(u.shape[1])] < 0, -1.0, 1.0)


def _cells(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(n, -1)


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    return pa.table({"p": [key[0].as_py()], "q": [key[1].as_py()], **{c: [rows.column(c).to_numpy().tobytes()] for c in "ijw"}}, TILE)


def _placed(batches):
    """Tiles of ids as tiles of places in their blocks, in order of row."""
    for batch in batches:
        for r in batch.to_pylist():
            i, j = (np.searchsorted(np.frombuffer(r[own], np.int64), np.frombuffer(r[c], np.int64)) for c, own in (("i", "pids"), ("j", "qids")))
            order = np.argsort(i, kind="stable")
            cells = {"i": i[order].astype(np.int32), "j": j[order].astype(np.int32), "w": np.frombuffer(r["w"], np.float64)[order]}
            yield pa.RecordBatch.from_pylist([{"p": r["p"], "q": r["q"], **{c: x.tobytes() for c, x in cells.items()}}], TILE)


def _gathered(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("id")
    return pa.table({"p": [key[0].as_py()], "ids": [rows.column("id").to_numpy().tobytes()], "d": [rows.column("d").to_numpy().tobytes()]}, pa.schema([("p", pa.int64()), ("ids", pa.binary()), ("d", pa.binary())]))


def _random(seed: int, p: int, n: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, p % (1 << 63)]).normal(size=(n, width))


def _fresh(p: int, x: np.ndarray, v: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"p": p, "x": x.tobytes(), "a": (x.T @ x).tobytes(), "b": (v.T @ x).tobytes(), "r": (r * r).sum(axis=0).tobytes()}], FRESH)


def _first(seed: int, width: int):
    """Random vectors of a graph that is given by its edges."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = _random(seed, r["p"], len(r["ids"]) // 8, width)
                yield _fresh(r["p"], x, x[:, :0], x[:, :0])

    return run


class _Coordinates:
    """Unit vectors' coordinates, of which the first eigenvectors of their graph are nearly made, a constant and random vectors, for what is not."""

    def __init__(self, own, seed: int, width: int):
        self.own, self.seed, self.width = own, seed, width

    def end(self, others):
        m = np.nan_to_num(self.own.m, nan=0.0, posinf=0.0, neginf=0.0)
        p = int(self.own.ids[0])
        x = np.hstack([np.ones((len(m), 1)), m, _random(self.seed, p, len(m), self.width)])
        yield _fresh(p, x, x[:, :0], x[:, :0])

    def wants(self, file: str) -> bool:
        return False

    def see(self, other) -> None:
        pass

    def told(self):
        yield from ()


def _by_task(files: list[str]) -> dict[int, str]:
    """Files of a settled table by the number of the task that wrote them; one that had no rows has none."""
    return {int(re.search(r"part-(\d+)", f.rsplit("/", 1)[-1])[1]): f for f in files}


def _joined(tiles: list[str], tasks: int, fresh: list[str], basis: dict[int, str], chosen: np.ndarray, kept: np.ndarray, along: np.ndarray, mix: np.ndarray):
    """Each task's blocks: the new vectors less their part in the basis, times ``mix``, and their products with L, join the basis turned by ``kept``.

    A task reads the new vectors of all blocks, and the tiles of its own one by one.
    """

    def run(batches):
        x: dict[int, np.ndarray] = {}
        place = np.zeros(0)
        mine = [task for batch in batches for task in batch.column(0).to_pylist()]
        old = {r["p"]: r for task in mine if task in basis for r in similarity.rows(basis[task], ["p", "v", "lv"])}
        for name in fresh:
            for r in similarity.rows(name, ["p", "x"]):
                x[r["p"]] = np.ascontiguousarray(np.frombuffer(r["x"]).reshape(-1, len(chosen))[:, chosen])
        for name in (name for task in mine for name in tiles[task::tasks]):
            sums, own = {}, {}
            for r in similarity.rows(name, ["p", "q", "i", "j", "w", "ids"]):
                if r["q"] is None:
                    own[r["p"]] = r
                    continue
                row, at, w = np.frombuffer(r["i"], np.int32), np.frombuffer(r["j"], np.int32), np.frombuffer(r["w"], np.float64)
                y, other = sums.setdefault(r["p"], np.zeros_like(x[r["p"]])), x[r["q"]]
                if SPARSE * len(w) > len(y) * len(other):
                    if len(place) < len(y) * len(other):
                        place = np.zeros(len(y) * len(other))
                    cells = row.astype(np.int64) * len(other) + at
                    np.add.at(place, cells, w)
                    y += place[: len(y) * len(other)].reshape(len(y), -1) @ other
                    place[cells] = 0
                else:
                    cut = np.flatnonzero(np.diff(row, prepend=-1))
                    y[row[cut]] += np.add.reduceat(np.take(other, at, axis=0) * w[:, None], cut, axis=0)
            for p, r in own.items():
                d = np.frombuffer(r["w"])
                n = len(d)
                y = d[:, None] * x[p] - sums.get(p, 0.0)
                v, lv = (_cells(old[p][c], n) @ kept if p in old else np.zeros((n, 0)) for c in ("v", "lv"))
                v, lv = np.hstack([v, (x[p] - v @ along) @ mix]), np.hstack([lv, (y - lv @ along) @ mix])
                yield pa.RecordBatch.from_pylist([{"p": p, "ids": r["ids"], "d": r["w"], "v": v.tobytes(), "lv": lv.tobytes(), "a": (v.T @ v).tobytes(), "b": (v.T @ lv).tobytes(), "top": float(d.max(initial=0.0))}], BASIS)

    return run


def _residuals(turn: np.ndarray, values: np.ndarray, nearest: float):
    """Residuals of the vectors v turn, and these divided by what the degrees are beyond the values."""

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                d = np.frombuffer(b["d"])
                v, lv = _cells(b["v"], len(d)), _cells(b["lv"], len(d))
                r = lv @ turn - (v @ turn) * values
                beyond = d[:, None] - values
                yield _fresh(b["p"], r / np.where(np.abs(beyond) < nearest, np.where(beyond < 0, -nearest, nearest), beyond), v, r)

    return run


def _summed(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Sums over the blocks of small matrices, by tasks first."""

    def run(batches):
        sums = None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                now = [np.frombuffer(x) for x in r]
                sums = now if sums is None else [a + b for a, b in zip(sums, now, strict=True)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in sums], names=list(columns))

    found = df.select(*columns).mapInArrow(run, ", ".join(f"{c} binary" for c in columns)).collect()
    return [sum(np.frombuffer(r[c]) for r in found) for c in columns]


def _spelled(values: list[float], mix: np.ndarray):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                u = _cells(r["v"], len(ids)) @ mix
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([values] * len(ids), pa.list_(pa.float64())), pa.array(u.tolist(), pa.list_(pa.float64()))], names=["id", "values", "u"])

    return run


def lanczos_spectrum(edges: DataFrame, ids: DataFrame, vectors: int, steps: int = 60, seed: int = 7, tolerance: float = 1e-7, rounds: int = 1000) -> DataFrame:
    """As ``dense_spectrum`` for large graphs, by block Davidson with thick restarts.

    A block has more vectors than are asked for, so an eigenvalue repeated that often is found that
    often: the zeros of a graph of several components are all there.  In each round the residuals join the space,
    each node's divided by its degree less the value (Davidson), for many of the first vectors lie on nodes
    of low degree.  Rounds go on until each residual is at most ``tolerance`` times the bound 2 * max degree of the
    spectrum; RuntimeError after ``rounds``.  A basis of over ``steps`` vectors (eight blocks at least) is
    restarted from its best three blocks.  Each round is one distributed product of edge tiles with the block's vectors;
    only small matrices come to the driver.  Of the bases only the last is kept.
    """
    n = ids.count()
    blocks = max(1, -(-n // similarity.BLOCK))
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    degrees = ids.join(similarity.degree(edges).withColumnRenamed("i", "id"), "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"))
    own = settle(degrees.withColumn("p", block_of("id")).groupBy("p").applyInArrow(_gathered, "p long, ids binary, d binary"))
    start = own.mapInArrow(_first(seed, min(n, vectors + GUARD)), FRESH_COLUMNS)
    return _eigenvectors(edge_tiles(edges, own, blocks), settle(start), n, vectors, steps, tolerance, rounds)


def edge_tiles(edges: DataFrame, own: DataFrame, blocks: int) -> DataFrame:
    """Settled tiles, as of ``similarity.tiles``, of edges (i, j, w) between blocks of ids by hash; ``own`` is settled and has (p, ids, d) of these."""
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    raw = edges.select(block_of("i").alias("p"), block_of("j").alias("q"), "i", "j", F.col("w").cast("double").alias("w")).groupBy("p", "q").applyInArrow(_tile, "p long, q long, i binary, j binary, w binary")
    both = raw.join(own.select("p", F.col("ids").alias("pids")), "p").join(own.select(F.col("p").alias("q"), F.col("ids").alias("qids")), "q")
    none = F.lit(None).cast("binary")
    tiles = both.mapInArrow(_placed, "p long, q long, i binary, j binary, w binary").withColumn("ids", none)
    tiles = tiles.unionByName(own.select("p", F.lit(None).cast("long").alias("q"), none.alias("i"), none.alias("j"), F.col("d").alias("w"), "ids"))
    return settle(tiles.repartition(blocks, "p"))


def normalised_spectrum(edges: DataFrame, ids: DataFrame, vectors: int, blocks: int, seed: int = 7, tolerance: float = 0.05, rounds: int = 1000) -> DataFrame:
    """(id, values, u): the first eigenvectors of 1 - D^-1/2 W D^-1/2 of symmetric edges, to residuals of ``tolerance`` times 2; every id has an edge."""
    n = ids.count()
    degrees = settle(degree_roots(edges))
    scaled = edges.join(degrees, "i").join(degrees.select(F.col("i").alias("j"), F.col("root").alias("root_j")), "j").select("i", "j", (F.col("w") / (F.col("root") * F.col("root_j"))).alias("w"))
    block_of = F.pmod(F.xxhash64("id"), F.lit(blocks))
    own = settle(ids.select("id", F.lit(1.0).alias("d")).withColumn("p", block_of).groupBy("p").applyInArrow(_gathered, "p long, ids binary, d binary"))
    start = own.mapInArrow(_first(seed, min(n, vectors + GUARD)), FRESH_COLUMNS)
    return _eigenvectors(edge_tiles(scaled, own, blocks), settle(start), n, vectors, 0, tolerance, rounds)


def degree_roots(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.sqrt(F.sum("w")).alias("root"))


def graph_spectrum(graph: DataFrame, vectors: int, steps: int = 60, seed: int = 7, tolerance: float = 1e-7, rounds: int = 1000) -> DataFrame:
    """As ``lanczos_spectrum`` of the affinity of a ``similarity.graph``, whose tiles come straight from its blocks; it starts from the points' coordinates."""
    n = graph.count()
    start = similarity.met(graph, lambda own: _Coordinates(own, seed, min(n, vectors + GUARD)), FRESH_COLUMNS)
    return _eigenvectors(settle(similarity.tiles(graph)), settle(start), n, vectors, steps, tolerance, rounds)


def _eigenvectors(tiles: DataFrame, start: DataFrame, n: int, vectors: int, steps: int, tolerance: float, rounds: int) -> DataFrame:
    """The rounds: ``tiles`` are as of ``similarity.tiles``, all of a block in one file, ``start`` the first vectors."""
    spark = tiles.sparkSession
    files = sorted(tiles.inputFiles())
    block, vectors = min(n, vectors + GUARD), min(vectors, n)
    tasks = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    fresh, basis, turn, bound = start, None, np.zeros((0, 0)), None
    inner, shadow = _summed(fresh, "a")[0], np.zeros(0)
    chosen = np.ones(round(len(inner) ** 0.5), bool)
    for _ in range(rounds):
        inner, shadow = inner.reshape(len(chosen), -1)[np.ix_(chosen, chosen)], shadow.reshape(-1, len(chosen))[:, chosen]
        along = turn.T @ shadow
        root, way = np.linalg.eigh(inner - along.T @ along)
        real = np.flatnonzero(root > 1e-12 * root[-1])[-(n - turn.shape[1]) :]
        old = [fresh] if basis is None else [fresh, basis]
        basis = settle(spark.range(0, tasks, 1, tasks).mapInArrow(_joined(files, tasks, sorted(fresh.inputFiles()), {} if basis is None else _by_task(basis.inputFiles()), chosen, turn, along, way[:, real] / np.sqrt(root[real])), BASIS_COLUMNS))
        for table in old:
            forget(table)
        bound = bound or 2.0 * basis.agg(F.max("top")).first()[0] or 1.0
        gram, product = _summed(basis, "a", "b")
        size = round(len(gram) ** 0.5)
        gram, product = gram.reshape(size, size), product.reshape(size, size)
        half = np.linalg.inv(np.linalg.cholesky(gram))
        product = half @ (product + product.T) @ half.T / 2
        values, turn = np.linalg.eigh(product)
        turn = half.T @ turn
        fresh = settle(basis.select("p", "d", "v", "lv").mapInArrow(_residuals(turn[:, :block], values[:block], NEAREST * bound), FRESH_COLUMNS))
        inner, shadow, square = _summed(fresh, "a", "b", "r")
        length = np.sqrt(square)
        chosen = length > tolerance * bound
        if not chosen[:vectors].any() or size >= n:
            break
        turn = turn[:, : 3 * block] if size + block > max(steps, 8 * block) else turn
    else:
        raise RuntimeError(f"the spectrum did not converge: residuals {length[:vectors][chosen[:vectors]].tolist()} of a bound of {bound}")
    return basis.select("ids", "v").mapInArrow(_spelled(values[:vectors].tolist(), turn[:, :vectors]), "id long, values array<double>, u array<double>")


def spectrum(edges: DataFrame, ids: DataFrame, vectors: int = MAX_SPEAKERS + 1) -> DataFrame:
    """(id, values, u), dense up to DENSE_LIMIT nodes (the count is checked), block Davidson beyond."""
    return dense_spectrum(edges, ids, vectors) if ids.count() <= DENSE_LIMIT else lanczos_spectrum(edges, ids, vectors)


def affinity_spectrum(df: DataFrame, id_col: str = "id", vector: str = "v", pval: float = 0.02, min_pnum: int = 6, vectors: int = MAX_SPEAKERS + 1) -> DataFrame:
    """(id, values, u) of the affinity graph of vectors; beyond DENSE_LIMIT no edge is shuffled."""
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    if ids.count() <= DENSE_LIMIT:
        return dense_spectrum(similarity.affinity(df, id_col, vector, pval, min_pnum), ids, vectors)
    return graph_spectrum(similarity.graph(df, id_col, vector, pval, min_pnum), vectors)


def eigenvalues(solved: DataFrame) -> DataFrame:
    """(ord, lambda) from a solved spectrum."""
    return solved.limit(1).select(F.posexplode("values").alias("ord", "lambda"))


def eigen_gaps(values: DataFrame, order: str = "ord", value: str = "lambda") -> DataFrame:
    """(ord, gap): difference to the next value.  The series is a spectrum: a few rows, one task."""
    return values.select(F.col(order).alias("ord"), (F.lead(value).over(W.orderBy(order)) - F.col(value)).alias("gap")).where("gap is not null")


def choose_k(values: list[float], nmin: int = MIN_SPEAKERS, nmax: int = MAX_SPEAKERS, k: int | None = None) -> int:
    """Number of clusters: place of the largest gap among values nmin-1 to nmax, first on ties; ``k`` overrides."""
    if k is not None:
        return k
    if not 1 <= nmin <= min(nmax, len(values) - 1):
        raise ValueError(f"nmin must lie in 1..{min(nmax, len(values) - 1)}")
    part = values[nmin - 1 : nmax + 1]
    gaps = [b - a for a, b in zip(part, part[1:], strict=False)]
    return gaps.index(max(gaps)) + nmin


def nmin_sweep(solved: DataFrame, nmax: int = MAX_SPEAKERS) -> DataFrame:
    """(nmin, k) for every admissible nmin over one spectrum: the interactive loop as a table."""
    return sweep(eigenvalues(solved), "ord", "lambda", nmax)


def sweep(values: DataFrame, order: str = "ord", value: str = "lambda", nmax: int = MAX_SPEAKERS) -> DataFrame:
    """(nmin, k) as ``choose_k`` gives it for every admissible nmin, of a spectrum given as rows in order from 0."""
    gaps = eigen_gaps(values, order, value).where(F.col("ord") < nmax)
    starts = gaps.select((F.col("ord") + 1).cast("int").alias("nmin"))
    best = F.min_by("ord", F.struct(-F.col("gap"), "ord"))
    return starts.join(gaps, F.col("ord") >= F.col("nmin") - 1).groupBy("nmin").agg((best + 1).cast("int").alias("k"))


def embedded_kmeans(solved: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(id, clust) by k-means on the first k eigenvector entries; k = 1 is label 0."""
    if k == 1:
        return solved.select("id", F.lit(0).alias("clust"))
    points = settle(solved.select("id", array_to_vector(F.slice("u", 1, k)).alias("features")))
    model = KMeans(k=k, seed=seed, initMode="k-means||", initSteps=5, maxIter=100, tol=1e-8).fit(points)
    return model.transform(points).select("id", F.col("prediction").cast("int").alias("clust"))


def canonical(labels: DataFrame) -> DataFrame:
    """Labels renumbered from 0 by smallest member id; a label table is a few rows."""
    firsts = labels.groupBy("clust").agg(F.min("id").alias("first"))
    ranked = firsts.withColumn("rank", (F.row_number().over(W.orderBy("first")) - 1).cast("int"))
    return labels.join(ranked, "clust").select("id", F.col("rank").alias("clust"))


def spectral_cluster(df: DataFrame, id_col: str = "id", vector: str = "v", nmin: int = MIN_SPEAKERS, nmax: int = MAX_SPEAKERS, pval: float = 0.02, min_pnum: int = 6, k: int | None = None, seed: int = 7) -> DataFrame:
    """(id, clust): similarity, pruning, Laplacian, eigengap, k-means."""
    solved = settle(affinity_spectrum(df, id_col, vector, pval, min_pnum, nmax + 1 if k is None else max(k, 2)))
    chosen = choose_k(solved.first()["values"], nmin, nmax, k)
    return canonical(embedded_kmeans(solved, chosen, seed))
