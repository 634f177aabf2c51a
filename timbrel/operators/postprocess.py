"""What follows clustering: small inputs, minor clusters, merging by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from timbrel.functions import vectors as V
from timbrel.operators import similarity
from timbrel.operators.components import components
from timbrel.sources.tables import settle

CLUSTER_LINE = 10
MIN_CLUSTER = 4
#: Labels up to which a centroid table may be broadcast or held by the driver.
MAX_LABELS = 10_000


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("clust").agg(F.count("*").alias("n"))


def minor_major(labels: DataFrame, least: int = MIN_CLUSTER) -> DataFrame:
    return cluster_sizes(labels).withColumn("is_minor", F.col("n") < least)


def centroids(df: DataFrame, label: str = "clust", vector: str = "v") -> DataFrame:
    """(clust, cv, n): mean of the raw vectors, partially aggregated by place before the shuffle."""
    flat = df.select(F.col(label).alias("clust"), F.posexplode(V.doubles(vector)).alias("pos", "x"))
    means = flat.groupBy("clust", "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return means.groupBy("clust").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("cv"), F.max("n").alias("n"))


def mean_vectors(df: DataFrame, by: str, vector: str = "v") -> DataFrame:
    """(by, v): mean vector of each group, L2-normalised; the speaker embedding of a group's utterances."""
    return centroids(df, by, vector).select(F.col("clust").alias(by), V.normalize(F.col("cv")).alias("v"))


def small_n_fallback(df: DataFrame, line: int = CLUSTER_LINE, id_col: str = "id") -> DataFrame | None:
    """All label 1 where there are fewer than ``line`` points, else None: nothing to fall back from."""
    if df.limit(line).count() >= line:
        return None
    return df.select(F.col(id_col).alias("id"), F.lit(1).alias("clust"))


def absorb_minor(df: DataFrame, least: int = MIN_CLUSTER) -> DataFrame:
    """(id, clust) of (id, clust, v): points of clusters under ``least`` go to the major cluster of the nearest centroid.

    One pass with centroids frozen; ties go to the smaller label; labels are not renumbered; where
    all clusters are minor, labels stay.  Noise (-1) is a label like others.
    """
    sizes = minor_major(df, least)
    majors = centroids(df).join(sizes.where("not is_minor").select("clust"), "clust").select(F.col("clust").alias("major"), "cv")
    minor = df.join(sizes.where("is_minor").select("clust"), "clust").select("id", "v")
    scored = scored_against(minor, majors)
    nearest = scored.groupBy("id").agg(F.max_by("major", F.struct("c", (-F.col("major")).alias("low"))).alias("to"))
    return df.join(nearest, "id", "left").select("id", F.coalesce("to", "clust").alias("clust"))


def scored_against(points: DataFrame, centres: DataFrame, blocks: int = 64) -> DataFrame:
    """(id, major, c): cosine of each point (id, v) and centre (major, cv).

    Centres are broadcast where their count is MAX_LABELS at most; more are dealt into blocks that
    each point visits, one shuffle, no broadcast.
    """
    if centres.count() <= MAX_LABELS:
        return points.crossJoin(F.broadcast(centres)).select("id", "major", V.cosine(V.doubles("v"), F.col("cv")).alias("c"))
    a = points.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = centres.withColumn("b", F.pmod(F.xxhash64("major"), F.lit(blocks)).cast("int"))
    return a.join(b, "b").select("id", "major", V.cosine(V.doubles("v"), F.col("cv")).alias("c"))


def centroid_affinity(df: DataFrame, label: str = "clust", vector: str = "v") -> DataFrame:
    """(c1, c2, aff) for c1 < c2.  One row per label goes in; over MAX_LABELS of them (counted first) are multiplied block by block."""
    c = settle(centroids(df, label, vector))
    if c.count() > MAX_LABELS:
        return similarity.cosine_pairs(c, "clust", "cv").select(*[F.col(x).cast(c.schema["clust"].dataType).alias(y) for x, y in (("i", "c1"), ("j", "c2"))], F.col("c").alias("aff"))
    a, b = c.select(F.col("clust").alias("c1"), F.col("cv").alias("v1")), c.select(F.col("clust").alias("c2"), F.col("cv").alias("v2"))
    return a.join(b, F.col("c1") < F.col("c2")).select("c1", "c2", V.cosine(F.col("v1"), F.col("v2")).alias("aff"))


def best_merge_pair(df: DataFrame, label: str = "clust", vector: str = "v") -> DataFrame:
    """The most similar pair of clusters, lexicographically first on ties."""
    return centroid_affinity(df, label, vector).orderBy(F.col("aff").desc(), "c1", "c2").limit(1)


def merge_loop(names: np.ndarray, sums: np.ndarray, counts: np.ndarray, threshold: float) -> dict[int, int]:
    """The label each label ends in, merging the most similar pair (first in order on ties) into its smaller label again and again.

    ``names`` ascend.  Each row knows its best partner among later rows; a merge looks at one row of
    cosines, and again at those rows whose partner went.
    """
    n = len(names)
    sums, counts, alive = sums.astype(float), counts.astype(float), np.ones(n, bool)

    def units(rows: np.ndarray) -> np.ndarray:
        m = sums[rows] / counts[rows, None]
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    unit = units(np.arange(n))
    best, partner, to = np.full(n, -np.inf), np.zeros(n, int), np.arange(n)

    def look(rows: np.ndarray) -> None:
        for some in np.array_split(rows, max(1, len(rows) * n >> 22)):
            c = unit[some] @ unit.T
            c[:, ~alive] = -np.inf
            c[np.arange(n)[None] <= some[:, None]] = -np.inf
            partner[some] = c.argmax(axis=1)
            best[some] = c[np.arange(len(some)), partner[some]]

    if n:
        look(np.arange(n))
    while n > 1:
        i = int(best.argmax())
        if not best[i] >= threshold:
            break
        j = int(partner[i])
        sums[i] += sums[j]
        counts[i] += counts[j]
        alive[j], best[j] = False, -np.inf
        to[to == j] = i
        unit[i] = units(np.array([i]))[0]
        lost = alive & ((partner == i) | (partner == j)) & (best > -np.inf)
        lost[i] = True
        c = unit[:i] @ unit[i]
        closer = alive[:i] & ~lost[:i] & ((c > best[:i]) | ((c == best[:i]) & (i < partner[:i])))
        best[:i][closer], partner[:i][closer] = c[closer], i
        look(np.flatnonzero(lost))
    return {int(a): int(names[b]) for a, b in zip(names, to, strict=True)}


class _Caps:
    """For each cap (id, v, radius) of a block the smallest other cap that lies within the angle of it."""

    def __init__(self, rows: pa.Table, angle: float):
        self.ids, self.m, self.radius, self.angle = *self.read(rows), angle
        self.least = np.full(len(self.ids), np.iinfo(np.int64).max)

    @staticmethod
    def read(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return rows["id"].to_numpy(), np.asarray(rows["v"].combine_chunks().flatten()).reshape(rows.num_rows, -1), rows["radius"].to_numpy()

    def see(self, columns: pa.Table) -> None:
        ids, m, radius = self.read(columns)
        near = np.arccos(np.clip(self.m @ m.T, -1, 1)) <= self.angle + self.radius[:, None] + radius[None] + 1e-6
        near &= self.ids[:, None] != ids[None]
        self.least = np.minimum(self.least, np.where(near, ids[None], np.iinfo(np.int64).max).min(axis=1))

    def told(self) -> Iterator[pa.RecordBatch]:
        some = self.least < np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[some]), pa.array(self.least[some])], names=["a", "b"])


def merge_groups(table: DataFrame, threshold: float, block: int = similarity.BLOCK) -> DataFrame:
    """(clust, root): labels in groups none of which can ever merge with a label of another.

    All centroids that merging makes of a group lie within the cone of its own, so within a cap around their
    mean direction (a cap under a right angle is convex).  Groups whose caps come within the threshold's
    angle of each other are joined until none do; a cap of a right angle or more holds all directions.
    """
    angle = float(np.arccos(threshold))
    unit = settle(table.select("clust", V.normalize(F.col("cv")).alias("v")).withColumn("root", F.col("clust").cast("long")))
    while True:
        flat = unit.select("root", "clust", F.posexplode("v").alias("pos", "x"))
        sums = flat.groupBy("root", "pos").agg(F.sum("x").alias("x")).groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre"))
        centre = settle(sums.select("root", V.normalize(F.col("centre")).alias("centre")))
        turned = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(F.col("v"), F.col("centre")))))
        radius = unit.join(centre, "root").groupBy("root").agg(F.max(turned).alias("radius"), F.count("*").alias("n"))
        wide = F.when(F.col("n") == 1, 0.0).when(F.col("radius") >= np.pi / 2 - 1e-6, np.pi).otherwise(F.col("radius"))
        caps = settle(centre.join(radius, "root").select(F.col("root").alias("id"), F.col("centre").alias("v"), wide.alias("radius")))
        n = caps.count()
        links = settle(similarity.streamed(caps, n, lambda rows: _Caps(rows, angle), "a long, b long", block, block))
        if not links.limit(1).count():
            return unit.select("clust", "root")
        roots = components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
        unit = settle(unit.join(roots, "root", "left").select("clust", "v", F.coalesce("to", "root").alias("root")))


def merged_labels(table: DataFrame, threshold: float, limit: int = MAX_LABELS, block: int = similarity.BLOCK) -> DataFrame:
    """(clust, merged) of labels (clust, cv, n): up to ``limit`` labels in one place, more group by group with the same result.

    A group that cannot be told apart is one task: one row a label and, at a time, a few rows of cosines.
    """
    spark, kind = table.sparkSession, table.schema["clust"].dataType
    table = settle(table)
    schema = T.StructType([T.StructField("clust", kind), T.StructField("merged", kind)])

    def merged(names: np.ndarray, vectors: np.ndarray, counts: np.ndarray) -> dict[int, int]:
        order = np.argsort(names)
        return merge_loop(names[order], vectors[order] * counts[order, None], counts[order], threshold)

    if table.count() <= limit:
        rows = table.collect()
        to = merged(np.array([r["clust"] for r in rows]), np.array([r["cv"] for r in rows]), np.array([r["n"] for r in rows])) if rows else {}
        return spark.createDataFrame(list(to.items()), schema)

    def run(rows: pa.Table) -> pa.Table:
        vectors = np.asarray(rows["cv"].combine_chunks().flatten()).reshape(rows.num_rows, -1)
        to = merged(rows["clust"].to_numpy(), vectors, rows["n"].to_numpy())
        return pa.table({"clust": list(to), "merged": list(to.values())}).cast(to_arrow_schema(schema))

    grouped = settle(merge_groups(table, threshold, block))
    several = grouped.groupBy("root").agg(F.count("*").alias("labels")).where("labels > 1")
    some = table.join(grouped.join(several, "root").select("clust", "root"), "clust")
    return some.groupBy("root").applyInArrow(run, schema)


def merge_by_cosine(df: DataFrame, threshold: float, limit: int = MAX_LABELS) -> DataFrame:
    """(id, clust): the most similar pair merges into its smaller label while its cosine reaches ``threshold``.

    Centroids are sums and counts, so merging needs no further pass over the points, and the label
    map returns as one join.  Over ``limit`` labels (counted first) it is made group by group, as
    ``merged_labels`` says.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    mapping = settle(merged_labels(centroids(df), threshold, limit))
    return df.join(mapping, "clust", "left").select("id", F.coalesce("merged", "clust").alias("clust"))


def ranked_labels(labels: DataFrame) -> DataFrame:
    """Distinct labels in order with their rank, for palettes and legends."""
    distinct = labels.select("clust").distinct()
    return distinct.withColumn("rank", F.row_number().over(W.orderBy("clust")) - 1)
