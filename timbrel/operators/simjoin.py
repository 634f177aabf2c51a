"""Exact similarity join: all pairs of a least cosine, without looking at all pairs.

Angles obey the triangle inequality.  Each vector lies in the cell of its nearest pivot; a cell knows the
least and largest angle of its vectors to the pivot.  A pair within angle t of each other, one of them
in cell B, differ by at most t in their angles to B's pivot: so a vector visits B only if its angle to
that pivot lies within t of the cell's range, and within a cell a visitor meets only the vectors
whose angle lies within t of its own.  Whole pairs of cells are thus never compared.  Blocks are ranges
of cells and angles in a settled table; a task reads the blocks that its own may have partners in, so no
vector is sent more than once.  Equal vectors are one throughout and their pairs are listed at the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.functions import vectors as V
from timbrel.operators import similarity
from timbrel.sources.tables import settle

#: Pivots at most, rows they are chosen from, vectors of a block of a cell, cosines a task holds at a time.
PIVOTS, SAMPLE, BLOCK, CELLS = 512, 8192, 2048, 1 << 20
#: What rounding may add to an angle: cosines near 1 are some 1e-16 off, their angles some 1e-8.
SLACK = 1e-6


def _unit(vectors: pa.Array) -> np.ndarray:
    m = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors spread over a sample: each the one farthest from those before it."""
    far = np.full(len(sample), np.inf)
    chosen = [0]
    for _ in range(min(n, len(sample)) - 1):
        far = np.minimum(far, angles(sample, sample[chosen[-1:]])[:, 0])
        if far.max() <= SLACK:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def _homes(pivots: np.ndarray):
    """Kernel over (id, v): the cell of each vector and its angle to the cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a = angles(_unit(batch.column(1)), pivots)
            cell = a.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(a[np.arange(len(a)), cell])], names=["id", "v", "cell", "angle"])

    return run


def _visits(pivots: np.ndarray, low: np.ndarray, high: np.ndarray, most: float):
    """Kernel over (id, v, cell): the cells whose vectors each is compared with, its own first.

    Of a pair in two cells the one of the smaller cell number visits the other's cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                a, home = angles(_unit(part.column("v")), pivots), part.column("cell").to_numpy()
                row, cell = np.nonzero((a <= high + most + SLACK) & (a >= low - most - SLACK) & (np.arange(len(pivots)) > home[:, None]))
                visitor = np.arange(len(home) + len(row)) >= len(home)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([home, cell]), pa.int32()), pa.array(visitor)], names=["cell", "visitor"])

    return run


class _Cell:
    """A block: vectors of one cell within a range of angles to its pivot, in order of these."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows["angle"].to_numpy(), kind="stable")
        self.angle, self.ids, self.cell = rows["angle"].to_numpy()[order], rows["id"].to_numpy()[order], rows["cell"].to_numpy()[order]
        self.m = _unit(rows["v"].combine_chunks())[order]


class _Meeting:
    """The pairs of a block's vectors with those of other blocks; each two blocks meet once."""

    def __init__(self, own: _Cell, least: float, pivots: np.ndarray, spans: dict[str, list[tuple]]):
        self.own, self.least, self.pivots, self.spans = own, least, pivots, spans
        self.width = math.acos(max(-1.0, min(1.0, least))) + SLACK
        self.angles = np.sort(angles(own.m, pivots), axis=0)
        self.now: list = []

    def wants(self, path: str) -> bool:
        """Whether any vector's angle to a pivot of the other block lies near enough to those of its cell there."""
        for cell, low, high in self.spans[path.rsplit("/", 1)[-1]]:
            first, end = np.searchsorted(self.angles[:, cell], [low - self.width, high + self.width])
            if first < end:
                return True
        return False

    def see(self, other: _Cell) -> None:
        own, same = self.own, other is self.own
        for cell in np.unique(other.cell):
            # only those of a like angle to the other's pivot, of a block in order of these
            there = np.flatnonzero(other.cell == cell)
            angle = angles(own.m, self.pivots[cell : cell + 1])[:, 0]
            order = np.argsort(angle, kind="stable")
            order = order[slice(*np.searchsorted(angle[order], [other.angle[there[0]] - self.width, other.angle[there[-1]] + self.width]))]
            step = max(1, CELLS // len(there))
            for begin in range(0, len(order), step):
                some = order[begin : begin + step]
                lo, hi = np.searchsorted(other.angle[there], [angle[some[0]] - self.width, angle[some[-1]] + self.width])
                c = own.m[some] @ other.m[there[lo:hi]].T
                x, y = np.divmod(np.flatnonzero(c >= self.least), max(1, hi - lo))
                a, b, c = own.ids[some][x], other.ids[there[lo:hi]][y], c[x, y]
                if same:
                    a, b, c = a[a < b], b[a < b], c[a < b]
                if len(a):
                    self.now.append(pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c)], names=["i", "j", "c"]))

    def told(self) -> Iterator[pa.RecordBatch]:
        out, self.now = self.now, []
        yield from out

    def end(self, others: Callable) -> Iterator[pa.RecordBatch]:
        yield from ()


class Join:
    """The plan of a similarity join: ``pairs`` are its rows, ``cells`` and ``skipped`` say what is not compared."""

    def __init__(self, df: DataFrame, least: float, id_col: str = "id", vector: str = "v", pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK):
        if not 0 < least <= 1:
            raise ValueError("the least cosine must lie in (0, 1]")
        self.spark, self.least, self.angle = df.sparkSession, least, math.acos(least)
        # zeros have one sign, so that equal vectors are equal rows; zero vectors have cosine 0 with all
        sound = df.select(F.col(id_col).cast("long").alias("id"), F.transform(V.doubles(vector), lambda x: x + F.lit(0.0)).alias("v")).where("id is not null and v is not null").where(F.exists("v", lambda x: x != 0))
        of = F.xxhash64("v")
        points = settle(sound.withColumn("h", of))
        least_id = points.groupBy("h", "v").agg(F.min("id").alias("least"), F.count("*").alias("n"))
        one = settle(least_id)
        self.copies = settle(points.join(one.where("n > 1"), ["h", "v"]).select("id", "least"))
        distinct = one.select(F.col("least").alias("id"), "v")
        n = one.count()
        chosen = distinct.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
        self.pivots = choose_pivots(_unit(chosen), min(pivots, max(1, 8 * math.ceil(n / block)) + 8)) if n else np.zeros((0, 0))
        if not n:
            self.homes = self.cells = None
            return
        homes = settle(distinct.mapInArrow(_homes(self.pivots), "id long, v array<double>, cell int, angle double"))
        self.cells = settle(homes.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")))
        known = {r["cell"]: r for r in self.cells.collect()}  # one row a pivot
        low, high = (np.array([known[k][name] if k in known else other for k in range(len(self.pivots))]) for name, other in (("low", np.inf), ("high", -np.inf)))
        self.sent = homes.mapInArrow(_visits(self.pivots, low, high, self.angle), "cell int, visitor boolean")
        self.n, self.homes, self.block = n, homes, block

    def skipped(self) -> float:
        """The share of all pairs of different vectors that lie in cells that never meet."""
        met = self.sent.groupBy("cell").agg(F.sum((~F.col("visitor")).cast("long")).alias("own"), F.sum(F.col("visitor").cast("long")).alias("guests"))
        compared = met.agg(F.sum(F.col("own") * (F.col("own") - 1) / 2 + F.col("own") * F.col("guests"))).first()[0] or 0.0
        return 1 - compared / max(1.0, self.n * (self.n - 1) / 2)

    def distinct_pairs(self) -> DataFrame:
        """(i, j, c) of different vectors, each named by its smallest id."""
        if self.cells is None:
            return self.spark.createDataFrame([], "i long, j long, c double")
        # small tables have blocks enough for the cluster; half the others fall to each block
        width = max(1, min(self.block, max(256, math.ceil(self.n / (4 * self.spark.sparkContext.defaultParallelism)))))
        table = settle(self.homes.repartitionByRange(max(1, math.ceil(self.n / width)), "cell", "angle", "id"))
        spans: dict[str, list[tuple]] = {}
        for r in table.groupBy(F.input_file_name().alias("file"), "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).toLocalIterator():  # one row a block, and one more a cell
            spans.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["cell"], r["low"], r["high"]))
        least, pivots = self.least, self.pivots
        return similarity.met(table, lambda own: _Meeting(own, least, pivots, spans), "i long, j long, c double", half=True, kind=_Cell)

    def pairs(self) -> DataFrame:
        """(i, j, c) of all rows, i < j: those of different vectors for each of their copies, and copies among one another."""
        found = self.distinct_pairs()
        if not self.copies.limit(1).count():
            return found
        a, b = (self.copies.select(F.col("least").alias(f"{side}_least"), F.col("id").alias(side)) for side in ("a", "b"))
        spread = found.join(a, F.col("i") == F.col("a_least"), "left").join(b, F.col("j") == F.col("b_least"), "left").select(F.coalesce("a", "i").alias("x"), F.coalesce("b", "j").alias("y"), "c")
        among = a.join(b, F.col("a_least") == F.col("b_least")).where("a < b").select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1.0).alias("c"))
        return spread.unionByName(among).select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "c")


def similar_pairs(df: DataFrame, least: float, id_col: str = "id", vector: str = "v", **options) -> DataFrame:
    """(i, j, c) for i < j with a cosine of at least ``least``, which is over 0: the rows of ``cosine_pairs`` from there up.

    Rows without an id or vector and zero vectors have no pairs; ids are unique.  Vectors have one length.
    """
    return Join(df, least, id_col, vector, **options).pairs()
