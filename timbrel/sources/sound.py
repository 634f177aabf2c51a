"""Sound in numpy: PCM samples, band-limited resampling, voice activity."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

RATE = 16_000
#: Zero crossings of the filter to either side, share of the band that passes, and the window's parameter (stop band over 80 dB down).
ZEROS, ROLLOFF, BETA = 48, 0.93, 8.6

#: Voice activity: window in seconds; decibels over the noise at which speech starts and ends, and below the
#: loudest window within which all is speech; decibels a second that the noise estimate may rise, in pauses and in speech; windows that stay on.
WINDOW, ON, OFF, PEAK, RISE, CREEP, HANG = 0.03, 9.0, 5.0, 20.0, 3.0, 0.5, 8


def pcm(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Mono float32 samples in [-1, 1] of little-endian PCM bytes of 8, 16, 24 or 32 bits."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    if channels > 1:
        x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
    return x


def steps(own: int, rate: int) -> tuple[int, int]:
    """(up, down) in lowest terms: ``up`` samples out for ``down`` samples in."""
    shared = math.gcd(own, rate)
    return rate // shared, own // shared


@lru_cache(maxsize=16)
def _filter(up: int, down: int) -> tuple[int, np.ndarray]:
    """Half length in samples, and the taps of each of the ``up`` phases."""
    cutoff = min(1.0, up / down) * ROLLOFF
    half = math.ceil(ZEROS * max(1.0, down / up)) + 1
    t = np.arange(-half + 1, half + 1)[None] - np.arange(up)[:, None] / up
    window = np.i0(BETA * np.sqrt(np.maximum(0, 1 - (t / half) ** 2))) / np.i0(BETA)
    taps = cutoff * np.sinc(cutoff * t) * window
    return half, taps / taps.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, own: int, rate: int = RATE) -> np.ndarray:
    """Samples at ``rate``: a windowed sinc below the lower of both limits, one phase of output samples at a time.

    Output sample i stands at input time i * own / rate; beyond the ends the first and the last
    sample go on.  Of n samples ceil(n * rate / own) come out.
    """
    up, down = steps(own, rate)
    if up == down or not len(x):
        return np.asarray(x, np.float32)
    half, taps = _filter(up, down)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.full(half - 1, x[0]), x, np.full(half + down + 1, x[-1])])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)
    out = np.empty(n)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase and lie ``down`` apart
        at, phase = divmod(first * down, up)
        count = -(-(n - first) // up)
        out[first::up] = windows[at :: down][:count] @ taps[phase]
    return out.astype(np.float32)


def resampled_size(n: int, own: int, rate: int) -> int:
    up, down = steps(own, rate)
    return -(-n * up // down)


def inputs(a: int, b: int, n: int, own: int, rate: int) -> tuple[int, int, int]:
    """(first, last, skip): of ``n`` samples those that samples ``a`` to ``b`` at ``rate`` need, and how many of what ``resample`` makes of them come before ``a``."""
    up, down = steps(own, rate)
    if up == down:
        return a, b, 0
    half = math.ceil(ZEROS * max(1.0, down / up)) + 1
    first = max(0, (a * down // up - half) // down * down)
    return first, min(n, -(-b * down // up) + half + 1), a - first // down * up


def levels(x: np.ndarray, rate: int = RATE, window: float = WINDOW) -> np.ndarray:
    """Decibels of each whole window, at least -120."""
    size = int(rate * window)
    frames = np.asarray(x, np.float64)[: len(x) // size * size].reshape(-1, size)
    return 10 * np.log10(np.maximum((frames**2).mean(axis=1), 1e-12))


def voiced(level: np.ndarray, window: float = WINDOW) -> np.ndarray:
    """Which windows are speech, by energy over a noise estimate, with hysteresis and hang-over.

    The noise follows the level down at once and up by ``RISE`` decibels a second (``CREEP`` in speech).  Speech starts ``ON``
    decibels over it and goes on while the level is ``OFF`` over it; after that it hangs over
    for ``HANG`` windows.  What is within ``PEAK`` decibels of the loudest window is speech however loud the noise,
    so a recording without pauses is all speech; digital silence never is.
    """
    out = np.zeros(len(level), bool)
    if not len(level):
        return out
    sure = level.max() - PEAK
    noise, speaking, hang = float(np.percentile(level, 10)), False, 0
    for i, now in enumerate(level):
        noise = min(now, noise + (CREEP if speaking else RISE) * window)
        bar = min(noise + (OFF if speaking else ON), sure)
        speaking = now > bar and now > -100
        hang = HANG if speaking else hang - 1
        out[i] = speaking or hang >= 0
    return out
