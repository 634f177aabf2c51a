"""The whole flow as plans: embed, cluster, project, assign, route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.operators import density, postprocess, project, series, slices, spectral
from timbrel.sources.tables import settle
from timbrel.sources import readers, writers
from timbrel.sources.cache import KEYS, FeatureCache

METHODS = ("spectral", "umap_hdbscan")


def cluster(df: DataFrame, method: str = "spectral", cluster_line: int = postprocess.CLUSTER_LINE, min_cluster_size: int = postprocess.MIN_CLUSTER, merge_cosine: float | None = None, id_col: str = "id", vector: str = "v", seed: int = 7, **options) -> DataFrame:
    """(id, clust): fewer than ``cluster_line`` points are one cluster 1; else cluster, absorb minor clusters, maybe merge.

    All vectors must have one length; null vectors are refused.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if merge_cosine is not None and not 0 < merge_cosine <= 1:
        raise ValueError("merge_cosine must lie in (0, 1]")
    points = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    shape = points.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.sum(F.col("v").isNull().cast("int")).alias("nulls")).first()
    if shape["nulls"] or shape["low"] != shape["high"]:
        raise ValueError("vectors must all be present and of one length")
    few = postprocess.small_n_fallback(points, cluster_line)
    if few is not None:
        return few
    if method == "spectral":
        labels = spectral.spectral_cluster(points, seed=seed, **options)
    else:
        labels = density.umap_hdbscan(points, seed=seed, min_cluster_size=min_cluster_size, **options)
    labels = postprocess.absorb_minor(points.join(labels, "id"), min_cluster_size)
    if merge_cosine is not None:
        labels = postprocess.merge_by_cosine(points.join(labels, "id"), merge_cosine)
    return labels


def assign(points: DataFrame, labels: DataFrame, xy: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(filename, clust, x, y): labels, places and names meet on id."""
    names = points.select("id", "filename") if names is None else names
    return names.join(labels, "id").join(xy, "id").select("filename", "clust", "x", "y")


def cache_misses(keyed: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the cache does not know."""
    return keyed.join(known, keys, "left_anti")


def embed_folder(spark: SparkSession, folder: str, encoder: str = "timbre", speaker: str = "", cache: str | None = None) -> DataFrame:
    """(id, filename, v) of a folder's recordings; vectors cached for unchanged files are read, the others computed and cached."""
    if encoder not in slices.ENCODERS:
        raise ValueError(f"encoder must be one of {slices.ENCODERS}")
    files = readers.utterances(spark, folder)
    if cache is None:
        return slices.embed(readers.waveforms(files, trim=encoder != "emotion"), encoder)
    marks = readers.listing(spark, folder).withColumnRenamed("path", "filename")
    keyed = files.select("id", "filename").join(marks, "filename")
    store = FeatureCache(spark, cache)
    missing = files.join(store.misses(keyed, speaker, encoder).select("id"), "id", "left_semi")
    if missing.limit(1).count():
        fresh = slices.embed(readers.waveforms(missing, trim=encoder != "emotion"), encoder).join(keyed, ["id", "filename"])
        store.write(fresh, speaker, encoder)
    return keyed.join(store.read(speaker, encoder), list(KEYS)).select("id", "filename", "v")


def split(spark: SparkSession, folder: str, out: str | None = None, encoder: str = "timbre", method: str = "spectral", reducer: str = "tsne", speaker: str = "", cache: str | None = None, plot: str | None = None, **options) -> DataFrame:
    """The assignment table of a folder of recordings; written as CSV where ``out`` is given, drawn as PNG where ``plot`` is."""
    points = settle(embed_folder(spark, folder, encoder, speaker, cache))
    labels = cluster(points, method, **options)
    assigned = assign(points, labels, project.project(points, reducer))
    if out:
        writers.assignment_csv(assigned, out)
    if plot:
        writers.scatter_png(project.scatter_grid(assigned), plot, series.PALETTE)
    return assigned


def sweep(spark: SparkSession, folder: str, encoder: str = "timbre", speaker: str = "", cache: str | None = None) -> DataFrame:
    """(nmin, k): the number of clusters that each nmin gives a folder's recordings, from one spectrum."""
    points = settle(embed_folder(spark, folder, encoder, speaker, cache))
    return spectral.nmin_sweep(spectral.affinity_spectrum(points))


def load_matrix(spark: SparkSession, path: str, vocabulary: str | None = None, reducer: str = "tsne", out: str | None = None) -> DataFrame:
    """(token, clust, x, y) of a .npy matrix, tokens named by a vocabulary where given; the token CSV is written first."""
    matrix = readers.npy_matrix(spark, path)
    names = None if vocabulary is None else series.invert_vocabulary(readers.vocabulary(spark, vocabulary))
    named = series.tokens(matrix, names)
    if out:
        writers.token_csv(named, out)
    xy = project.project(matrix, reducer)
    by_id = matrix.select("id", F.col("id").cast("string").alias("token")) if names is None else matrix.join(names, F.col("id") == F.col("pos")).select("id", F.col("keys").alias("token"))
    return by_id.join(xy, "id").select("token", F.lit(1).alias("clust"), "x", "y")


def clean_transcripts(transcripts: DataFrame, files: DataFrame) -> DataFrame:
    """Transcript rows whose first column names a file that exists; duplicates stay."""
    stems = files.select(readers.stem(readers.basename("path")).alias("stem")).where("stem is not null").distinct()
    first = transcripts.columns[0]
    return transcripts.join(stems, transcripts[first] == stems["stem"], "left_semi")


def clean_csv(spark: SparkSession, path: str, wavs: str) -> DataFrame:
    """Rewrite a transcript CSV without rows whose recording is gone."""
    kept = clean_transcripts(readers.table_csv(spark, path), readers.listing(spark, wavs))
    writers.rewrite_csv(kept, path)
    return readers.table_csv(spark, path)
