"""Sinks: assignment and token CSV, transcripts, plots, recordings, file routing."""

from __future__ import annotations

import io
import struct
import uuid
import wave
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.sources.readers import basename
from timbrel.sources.stores import reached


def assignment_csv(df: DataFrame, path: str) -> None:
    """One CSV with header, no index; replaces what is there.  The table has one short row a file."""
    df.select("filename", "clust", "x", "y").coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def token_csv(df: DataFrame, path: str) -> None:
    df.select("token", "clust").coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def rewrite_csv(df: DataFrame, path: str) -> None:
    """Replace a CSV folder that ``df`` itself may read: written beside it, then swapped by two renames."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".new", ".old"))
    store = target.getFileSystem(conf)
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path + ".new")
    store.delete(old, True)
    if store.exists(target) and not store.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not store.rename(fresh, target):
        store.rename(old, target)
        raise OSError(f"cannot put the new {path} in place")
    store.delete(old, True)


def png(image: np.ndarray) -> bytes:
    """A (height, width, 3) array of bytes as a PNG file."""
    height, width = image.shape[:2]
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def scatter_png(grid: DataFrame, path: str, colors: Sequence[tuple[int, int, int]], width: int = 1200, height: int = 900, mark: int = 2) -> None:
    """Write a scatter plot of (px, py, clust) as a PNG: squares of ``mark`` pixels to each side, labels coloured in turn; one row a pixel comes to the driver."""
    image = np.full((height, width, 3), 255, np.uint8)
    for r in sorted(grid.collect(), key=lambda r: (r["clust"], r["py"], r["px"])):
        image[max(0, r["py"] - mark) : r["py"] + mark + 1, max(0, r["px"] - mark) : r["px"] + mark + 1] = colors[r["clust"] % len(colors)]
    store, at = reached(path)
    store.create_dir(at.rpartition("/")[0] or ".", recursive=True)
    with store.open_output_stream(at) as out:
        out.write(png(image))


def wav_files(waves: DataFrame, rate: int = 16_000, pad: float = 0.5) -> DataFrame:
    """(filename, content): recordings as 16-bit wave files, with ``pad`` seconds of silence after them for players that stop early."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for samples in pdf["samples"]:
                x = np.concatenate([np.asarray(samples, np.float64), np.zeros(int(pad * rate))])
                raw = io.BytesIO()
                with wave.open(raw, "wb") as f:
                    f.setnchannels(1)
                    f.setsampwidth(2)
                    f.setframerate(rate)
                    f.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
                out.append(raw.getvalue())
            yield pd.DataFrame({"filename": pdf["filename"], "content": out})

    return waves.select("filename", "samples").mapInPandas(run, "filename string, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(path): write each (filename, content) into ``folder``, under its name's last part; beside its place first, then renamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = reached(folder)
        store.create_dir(at, recursive=True)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, content in zip(names, batch.column(1), strict=True):
                part = f"{at}/.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}" for name in names], pa.string())], names=["path"])

    return files.select(basename("filename").alias("filename"), "content").mapInArrow(run, "path string")


def route_plan(assigned: DataFrame, out: str) -> DataFrame:
    """(src, dst, collides) to copy every file to ``out``/<clust>/; collides where two have one destination."""
    plan = assigned.select(F.col("filename").alias("src"), F.concat_ws("/", F.lit(out.rstrip("/")), F.col("clust").cast("string"), basename("filename")).alias("dst"))
    many = plan.groupBy("dst").agg((F.count("*") > 1).alias("collides"))
    return plan.join(many, "dst").select("src", "dst", "collides")


def kick_plan(assigned: DataFrame, clust: int, folder: str) -> DataFrame:
    """(src, dst, collides) to move one cluster's files to ``folder``_<clust>/."""
    own = assigned.where(F.col("clust") == clust)
    plan = own.select(F.col("filename").alias("src"), F.concat(F.lit(f"{folder.rstrip('/')}_{clust}/"), basename("filename")).alias("dst"))
    many = plan.groupBy("dst").agg((F.count("*") > 1).alias("collides"))
    return plan.join(many, "dst").select("src", "dst", "collides")


def _carry(src: str, dst: str, move: bool) -> None:
    """Copied beside its place and then renamed, so a task that is lost leaves no half file; a file already moved is done."""
    (source, a), (target, b) = reached(src), reached(dst)
    there = source.get_file_info(a).type != fs.FileType.NotFound
    if move and not there and target.get_file_info(b).type != fs.FileType.NotFound:
        return
    if not there:
        raise FileNotFoundError(src)
    target.create_dir(b.rpartition("/")[0], recursive=True)
    part = f"{b}.{uuid.uuid4().hex}.part"
    fs.copy_files(a, part, source_filesystem=source, destination_filesystem=target, use_threads=False)
    target.move(part, b)
    if move:
        source.delete_file(a)


def execute(plan: DataFrame, move: bool = False, dry_run: bool = True) -> DataFrame:
    """(src, dst, done): carry the plan out on local folders that machines share, or stores named by an address; a dry run does nothing.

    A file already moved counts as done, so a task that is run again does no harm.
    """
    if dry_run:
        return plan.select("src", "dst", F.lit(False).alias("done"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, dst in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _carry(src, dst, move)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([True] * batch.num_rows)], names=["src", "dst", "done"])

    return plan.select("src", "dst").mapInArrow(run, "src string, dst string, done boolean")
