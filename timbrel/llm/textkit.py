"""Vectorised byte, word and n-gram hashing over Arrow string columns.

Texts are handled as one byte buffer with row offsets, in chunks of whole rows, so memory
depends on the chunk size and the longest single text, not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        factors = np.full(size, base & _MASK, np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if size <= 2 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def string_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole rows of about ``limit`` bytes."""
    raw, at = string_parts(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums S with S[j] - S[i] = sum of values[t] * B**t over t in [i, j)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "up", len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span; equal spans hash alike wherever they lie."""
    return mix((prefix[end] - prefix[start]) * _power(_INVERSE, "down", len(prefix))[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, 64-bit word hashes and the row of each word.

    ``table`` maps a byte to what counts in the hash, 0 where the byte separates words.
    """
    folded = table[data]
    inside = folded != 0
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    if len(before):
        before[0] = False
    before[cut] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(after):
        after[-1] = False
    cut = offsets[1:][(offsets[1:] > 0)] - 1
    after[cut] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    hashes = span_hash(prefix_hash(folded), start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, hashes, row


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words, rows not regarded."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= np.uint64(0x100000001B3)
        out += hashes[j : n + j]
    return mix(out)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    if width <= 1 or not len(values):
        return values
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """Byte map for ``words``: 0 for separators, A-Z folded to a-z where ``lower``."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


#: ASCII white space, as in the class [\x20\x09-\x0D].  Byte 0 keeps a value of its own, for it is not a separator.
SPACE_TABLE = byte_table(b" \t\n\v\f\r", lower=False).astype(np.uint16)
SPACE_TABLE[0] = 256
#: Words are runs of ASCII letters, digits and all non-ASCII characters; A-Z folded.
ALNUM_TABLE = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of a string's UTF-8 bytes, four bits at a time."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    # of each byte the low four bits come first
    bits = f"list_transform(range(strlen({text}) * 2), lambda i: instr('0123456789ABCDEF', substr(hex({text}), CAST(xor(i, 1) AS BIGINT) + 1, 1)) - 1)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(c >> 4, ({table})[CAST(xor(c & 15, b) AS BIGINT) + 1])), 4294967295::BIGINT)"
