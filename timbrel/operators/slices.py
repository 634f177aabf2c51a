"""Partial utterances, spectral features and pluggable encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.functions import vectors as V

#: Fixed values of the published encoder: samples a second, samples a frame, frames a slice, mel bands.
RATE, FRAME, WIDTH, BANDS = 16_000, 160, 160, 40


def frame_step(rate: float) -> int:
    """Frames from slice to slice, rounded half to even."""
    step = int(np.round(RATE / rate / FRAME))
    if not 0 < step <= WIDTH:
        raise ValueError(f"rate {rate} gives slices {step} frames apart; 1 to {WIDTH} are possible, so rate must be over {RATE / (FRAME * WIDTH)}")
    return step


def partial_slices(df: DataFrame, n_samples: Column | str, id_col: str = "id", rate: float = 1.3, min_coverage: float = 0.75) -> DataFrame:
    """(id, part, mel_start, mel_stop, wav_start, wav_stop): overlapping slices of each recording.

    The last slice goes where it covers less than ``min_coverage`` and is not the only one.
    """
    if not 0 < min_coverage <= 1:
        raise ValueError("min_coverage must lie in (0, 1]")
    step = frame_step(rate)
    n = (F.col(n_samples) if isinstance(n_samples, str) else n_samples).cast("long")
    frames = F.ceil((n + 1) / FRAME)
    steps = F.greatest(F.lit(1), frames - WIDTH + step + 1)
    base = df.select(F.col(id_col).alias("id"), n.alias("n"), steps.alias("steps"))
    parts = base.select("id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("steps") - 1, F.lit(step).cast("long"))).alias("part", "mel_start"), F.floor((F.col("steps") - 1) / step).alias("last"))
    start = F.col("mel_start") * FRAME
    coverage = (F.col("n") - start) / F.lit(float(WIDTH * FRAME))
    kept = parts.where(~((F.col("part") == F.col("last")) & (F.col("last") > 0) & (coverage < min_coverage)))
    return kept.select("id", "part", "mel_start", (F.col("mel_start") + WIDTH).alias("mel_stop"), start.alias("wav_start"), (start + WIDTH * FRAME).alias("wav_stop"))


def slice_starts(n_samples: int, rate: float = 1.3, min_coverage: float = 0.75) -> np.ndarray:
    """First frames of one recording's slices, as ``partial_slices`` has them."""
    step = frame_step(rate)
    starts = np.arange(0, max(1, -(-(n_samples + 1) // FRAME) - WIDTH + step + 1), step)
    if len(starts) > 1 and (n_samples - starts[-1] * FRAME) / (WIDTH * FRAME) < min_coverage:
        return starts[:-1]
    return starts


#: Fixed values of the auditory scale that the published encoder's front end uses: linear to 1000 Hz, logarithmic above.
MEL_HZ, MEL_TURN, MEL_STEP = 200 / 3, 1000.0, np.log(6.4) / 27


def mel_filters(bands: int = BANDS, size: int = 400, rate: int = RATE) -> np.ndarray:
    """Triangular filters of equal area, evenly spaced on the mel scale."""
    turn = MEL_TURN / MEL_HZ
    top = turn + np.log(rate / 2 / MEL_TURN) / MEL_STEP
    mels = np.linspace(0, top, bands + 2)
    edges = np.where(mels < turn, MEL_HZ * mels, MEL_TURN * np.exp(MEL_STEP * (mels - turn)))
    freq = np.fft.rfftfreq(size, 1 / rate)
    rise = (freq[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - freq[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_spectrogram(x: np.ndarray, bands: int = BANDS, size: int = 400, hop: int = FRAME) -> np.ndarray:
    """(frames, bands) powers of 25 ms windows every 10 ms, centred."""
    return mel_windows(np.pad(np.asarray(x, np.float32), (size // 2, size // 2)), bands, size, hop)


def mel_windows(padded: np.ndarray, bands: int = BANDS, size: int = 400, hop: int = FRAME) -> np.ndarray:
    """(frames, bands) powers of the windows that start every ``hop`` samples and lie wholly within ``padded``."""
    frames = 1 + max(0, len(padded) - size) // hop
    at = np.arange(size)[None] + hop * np.arange(frames)[:, None]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return (np.abs(np.fft.rfft(padded[at] * window, axis=1)) ** 2 @ mel_filters(bands, size).T).astype(np.float32)


#: An encoder takes (slices, frames, bands) and gives (slices, dimensions).
Encoder = Callable[[np.ndarray], np.ndarray]
_encoders: dict[str, Callable[[], Encoder]] = {}


def partial_encoder(name: str) -> Callable[[], Encoder]:
    """What makes the encoder of slices registered by that name."""
    if name not in _encoders:
        raise ValueError(f"unknown encoder {name!r}")
    return _encoders[name]


def register_encoder(name: str, make: Callable[[], Encoder]) -> None:
    """``make`` runs once a worker, when first needed: load weights there."""
    _encoders[name] = make
    _whole.pop(name, None)


#: Encoders of whole recordings: samples to one vector.
_whole: dict[str, Callable] = {}


def register_whole_encoder(name: str, make: Callable) -> None:
    """As ``register_encoder``, for an encoder that takes a recording's samples and gives one vector."""
    _whole[name] = make


def whole_encoder(name: str) -> Callable:
    if name not in _whole:
        raise ValueError(f"no encoder of whole recordings is registered as {name!r}")
    return _whole[name]


def embed_whole(waves: DataFrame, encoder: str) -> DataFrame:
    """(id, filename, v): one vector for each recording by an encoder of whole recordings."""
    make = whole_encoder(encoder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "filename": pdf["filename"], "v": [encode(np.asarray(x, np.float32)).astype(float).tolist() for x in pdf["samples"]]})

    return waves.select("id", "filename", "samples").mapInPandas(run, "id long, filename string, v array<double>")


def _timbre() -> Encoder:
    """Deterministic stand-in for trained weights: rectified projection of mean and spread of log powers."""
    w = np.random.default_rng(11).normal(size=(2 * BANDS, 256)) / np.sqrt(2 * BANDS)

    def encode(mels: np.ndarray) -> np.ndarray:
        log = np.log(mels + 1e-6)
        y = np.maximum(np.concatenate([log.mean(axis=1), log.std(axis=1)], axis=1) @ w, 0)
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    return encode


def _emotion() -> Encoder:
    """Deterministic stand-in: mean-pooled tanh features of zero-mean, unit-variance input."""
    w = np.random.default_rng(13).normal(size=(BANDS, 1024)) / np.sqrt(BANDS)

    def encode(mels: np.ndarray) -> np.ndarray:
        log = np.log(mels + 1e-6)
        log = (log - log.mean(axis=(1, 2), keepdims=True)) / (log.std(axis=(1, 2), keepdims=True) + 1e-7)
        return np.tanh(log @ w).mean(axis=1)

    return encode


register_encoder("timbre", _timbre)
register_encoder("emotion", _emotion)
ENCODERS = ("timbre", "emotion", "mix")


def embed_partials(waves: DataFrame, encoder: str = "timbre", rate: float = 1.3, min_coverage: float = 0.75) -> DataFrame:
    """(id, filename, part, v): one vector for each slice of each recording, batches of all slices of some recordings."""
    make = partial_encoder(encoder)
    cut = partial_slices(waves, "n_samples", "id", rate, min_coverage)
    plan = cut.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "mel_start", "mel_stop", "wav_stop"))).alias("slices"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = np.asarray(row.samples, np.float32)
                x = np.pad(x, (0, max(0, int(row.slices[-1]["wav_stop"]) - len(x))))
                mel = mel_spectrogram(x)
                vectors = encode(np.stack([mel[s["mel_start"] : s["mel_stop"]] for s in row.slices]))
                yield pd.DataFrame({"id": row.id, "filename": row.filename, "part": [s["part"] for s in row.slices], "v": [v.astype(float).tolist() for v in vectors]})

    return waves.join(plan, "id").select("id", "filename", "samples", "slices").mapInPandas(run, "id long, filename string, part int, v array<double>")


def embed(waves: DataFrame, encoder: str = "timbre", normalize_parts: bool = False) -> DataFrame:
    """(id, filename, v): mean of a recording's partial vectors; timbre is L2-normalised, mix is timbre then emotion."""
    if encoder not in ENCODERS and encoder not in _encoders and encoder not in _whole:
        raise ValueError(f"encoder must be one of {sorted({*ENCODERS, *_encoders, *_whole})}")
    if encoder in _whole:
        return embed_whole(waves, encoder)
    if encoder == "mix":
        a, b = embed(waves, "timbre"), embed(waves, "emotion")
        second = V.normalize(F.col("v2")) if normalize_parts else F.col("v2")
        return a.join(b.select("id", F.col("v").alias("v2")), "id").select("id", "filename", V.concatenated(F.col("v"), second).alias("v"))
    flat = embed_partials(waves, encoder).select("id", "filename", F.posexplode("v").alias("pos", "x"))
    mean = flat.groupBy("id", "filename", "pos").agg(F.avg("x").alias("m")).groupBy("id", "filename").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    return mean if encoder == "emotion" else mean.withColumn("v", V.normalize(F.col("v")))
