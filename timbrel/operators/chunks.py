"""Recordings longer than a row: frames, slices and pooled vectors from chunks with a halo.

Chunks are rows (path, chunk, start, lead, n, n_samples, rate, samples) as ``sources.arrays.wave_chunks``
gives them.  A frame belongs to the chunk its centre lies in, a slice to the chunk it starts in; the
halo holds the rest of it, so no samples are shuffled, and a recording is as many tasks as it has
chunks.  What is pooled over a recording is summed chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.functions import vectors as V
from timbrel.operators.slices import BANDS, FRAME, RATE, WIDTH, mel_windows, partial_encoder, slice_starts

#: Samples to either side of a frame's centre; the halo that frames, and slices, need.
HALF = 200
FRAME_HALO, SLICE_HALO = HALF, WIDTH * FRAME + HALF


def frames_of(samples: np.ndarray, base: int, total: int, first: int, last: int) -> np.ndarray:
    """(frames, bands): frames ``first`` to ``last`` of a recording of ``total`` samples, from those of its samples that start at ``base``."""
    a, b = first * FRAME - HALF, (last - 1) * FRAME + HALF
    if max(a, 0) < base or min(b, total) > base + len(samples):
        raise ValueError("the chunk's halo is too short")
    held = samples[max(0, a - base) : max(0, b - base)]
    # before and after the recording is silence
    before = max(0, min(base - a, b - a))
    return mel_windows(np.concatenate([np.zeros(before, np.float32), held, np.zeros(b - a - before - len(held), np.float32)]))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, int, np.ndarray]]:
    """(path, start, n, base, total, samples) of each chunk; those at another rate are refused."""
    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            path, start, lead, n, total, rate = (column[k][i].as_py() for k in ("path", "start", "lead", "n", "n_samples", "rate"))
            if rate != RATE:
                raise ValueError(f"chunks are at {RATE} samples a second here, not {rate}")
            yield path, start, n, start - lead, total, np.asarray(column["samples"][i].values, np.float32)


COLUMNS = ("path", "start", "lead", "n", "n_samples", "rate", "samples")


def mel_frames(chunks: DataFrame) -> DataFrame:
    """(path, frame, mel): the spectrogram of each recording, one row a frame, as of the whole recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, n, base, total, x in _each(batches):
            last = total // FRAME + 1 if start + n >= total else -(-(start + n) // FRAME)
            first = -(-start // FRAME)
            for a in range(first, last, 4096):
                mel = frames_of(x, base, total, a, min(a + 4096, last))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, mel.size + 1, BANDS, dtype=np.int32)), pa.array(mel.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(mel)), pa.array(np.arange(a, a + len(mel))), lists], names=["path", "frame", "mel"])

    return chunks.select(*COLUMNS).mapInArrow(run, "path string, frame long, mel array<float>")


def loudness(chunks: DataFrame) -> DataFrame:
    """(path, n_samples, power): mean square of each recording, from sums of its chunks without their halo; null where it has no samples."""
    own = F.slice("samples", F.col("lead").cast("int") + 1, F.col("n").cast("int"))
    squares = F.aggregate(own, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sums = chunks.select("path", "n", squares.alias("squares")).groupBy("path").agg(F.sum("n").alias("n_samples"), F.sum("squares").alias("squares"))
    return sums.select("path", "n_samples", F.try_divide("squares", "n_samples").alias("power"))


def at_volume(chunks: DataFrame, target_dbfs: float = -30.0) -> DataFrame:
    """Chunks of recordings under the target level raised to it; only one number a recording meets the chunks."""
    level = F.lit(10 ** (target_dbfs / 20))
    gain = loudness(chunks).select("path", F.when(F.col("power") > 0, F.greatest(F.lit(1.0), level / F.sqrt("power"))).otherwise(1.0).alias("gain"))
    raised = F.transform("samples", lambda x: (x * F.col("gain")).cast("float"))
    return chunks.join(gain, "path").withColumn("samples", raised).select(*chunks.columns)


def embed_partials(chunks: DataFrame, encoder: str = "timbre", rate: float = 1.3, min_coverage: float = 0.75) -> DataFrame:
    """(path, part, v): one vector for each slice of each recording; the chunks' halo is at least ``SLICE_HALO``."""
    make = partial_encoder(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for path, start, n, base, total, x in _each(batches):
            starts = slice_starts(total, rate, min_coverage)
            at = starts * FRAME
            own = np.flatnonzero((at >= start) & ((at < start + n) | (start + n >= total)))
            for some in np.array_split(own, max(1, len(own) // 64)):
                if not len(some):
                    continue
                first = starts[some[0]]
                mel = frames_of(x, base, total, first, starts[some[-1]] + WIDTH)
                vectors = np.asarray(encode(np.stack([mel[a : a + WIDTH] for a in starts[some] - first])), float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32)), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(some, pa.int32()), lists], names=["path", "part", "v"])

    return chunks.select(*COLUMNS).mapInArrow(run, "path string, part int, v array<double>")


def pooled(partials: DataFrame, normalize: bool) -> DataFrame:
    """(path, v): mean of each recording's partial vectors, summed place by place where the partials are."""
    flat = partials.select("path", F.posexplode("v").alias("pos", "x"))
    mean = flat.groupBy("path", "pos").agg(F.avg("x").alias("m")).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    return mean.withColumn("v", V.normalize(F.col("v"))) if normalize else mean


def embed(chunks: DataFrame, encoder: str = "timbre") -> DataFrame:
    """(path, v): as ``slices.embed`` of whole recordings (not trimmed), for an encoder of slices."""
    return pooled(embed_partials(chunks, encoder), encoder != "emotion")
