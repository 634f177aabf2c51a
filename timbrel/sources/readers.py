"""Sources: recordings, matrices, vocabularies, assignments, transcripts.

All read through Spark, so any store that Spark reaches will do; schemas are declared, never inferred.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.sources import arrays, sound
from timbrel.sources.tables import settle

#: The public result of clustering.
ASSIGNMENT = T.StructType([T.StructField("filename", T.StringType()), T.StructField("clust", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RATE = 16_000


def basename(path):
    """Last part of a path with either separator."""
    path = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(path, r"[/\\]"), -1)


def stem(name, suffix: str = ".wav"):
    """Name without the suffix, null where it has another (case counts)."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.endswith(suffix), name.substr(F.lit(1), F.length(name) - len(suffix)))


def listing(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(path, length, modified): files of a folder, contents not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def utterances(spark: SparkSession, folder: str) -> DataFrame:
    """(id, filename, content): the .wav files of a folder, not of folders in it; id by path order.

    Ids number a listing of names; contents are joined to it by path.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    return files.join(numbered(files.select("path"), "path"), "path").select("id", F.col("path").alias("filename"), "content")


def numbered(names: DataFrame, name: str) -> DataFrame:
    """(name, id): places from 0 in order of distinct names.  Ranges of names are numbered apart; only their sizes meet in one task."""
    ranged = settle(names.select(name).repartitionByRange(name).withColumn("range", F.spark_partition_id()))
    within = ranged.withColumn("place", F.row_number().over(W.partitionBy("range").orderBy(name)) - 1)
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return within.join(sizes.select("range", before.alias("before")), "range").select(name, (F.col("before") + F.col("place")).cast("long").alias("id"))


def decode(content: bytes, rate: int = RATE) -> np.ndarray:
    """Mono float32 samples in [-1, 1] at ``rate`` from PCM wave bytes of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as f:
        x = sound.pcm(f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels())
        return sound.resample(x, f.getframerate(), rate)


def preprocess(x: np.ndarray, target_dbfs: float = -30.0, rate: int = RATE) -> np.ndarray:
    """Volume raised to the target level, windows without speech cut out; a recording shorter than a window stays."""
    if not len(x):
        return x
    power = float(np.sqrt((x**2).mean()))
    if power > 0:
        gain = 10 ** (target_dbfs / 20) / power
        x = x * gain if gain > 1 else x
    size = int(rate * sound.WINDOW)
    frames = x[: len(x) // size * size].reshape(-1, size)
    if not len(frames):
        return x.astype(np.float32)
    return frames[sound.voiced(sound.levels(x, rate))].ravel().astype(np.float32)


def waveforms(files: DataFrame, rate: int = RATE, trim: bool = False) -> DataFrame:
    """(id, filename, n_samples, samples) decoded in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            waves = [decode(c, rate) for c in pdf["content"]]
            waves = [preprocess(w) for w in waves] if trim else waves
            yield pd.DataFrame({"id": pdf["id"], "filename": pdf["filename"], "n_samples": [len(w) for w in waves], "samples": [w.tolist() for w in waves]})

    return files.select("id", "filename", "content").mapInPandas(run, "id long, filename string, n_samples long, samples array<float>")


def npy_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) rows of a rank-2 .npy matrix, or of a folder of matrices one after the other; pickled contents are refused."""
    rows, heads = arrays.matrices(spark, path), settle(arrays.headers(spark, path))
    shape = heads.agg(F.count("*").alias("files"), F.min("columns").alias("low"), F.max("columns").alias("high")).first()
    if shape["low"] != shape["high"]:
        raise ValueError("matrices of one folder have one width")
    if shape["files"] < 2:
        return rows.select("id", "v")
    # one row a file meets in one task
    before = F.coalesce(F.sum("rows").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    starts = settle(heads.select("path", before.alias("before")))
    return rows.join(starts, "path").select((F.col("before") + F.col("id")).alias("id"), "v")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(pos, key, value) of a JSON object in file order; a repeated key keeps its last value."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", "map<string,string>").alias("m"))
    return parsed.select(F.posexplode(F.map_entries("m")).alias("pos", "e")).select("pos", "e.key", "e.value")


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """Assignment CSV with header; doubled quotes, blank lines dropped."""
    return spark.read.csv(path, header=True, schema=ASSIGNMENT, quote='"', escape='"')


def table_csv(spark: SparkSession, path: str) -> DataFrame:
    """Transcript CSV: header, all columns strings, quoted line breaks allowed."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
