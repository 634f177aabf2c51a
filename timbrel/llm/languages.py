"""Language identification with error-correcting output codes.

Each language gets a codeword; one binary classifier over hashed byte n-grams predicts each bit.
Loss-weighted decoding picks the codeword with the least sum of logistic losses, each bit weighted
by how well its classifier separates the training texts; a small lead over the second best flags
ambiguity.  Classifiers are fitted on a bounded sample (``per_language`` documents and
``max_bytes`` of text of each language, drawn by a hash of id and text).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.llm import textkit as tk
from timbrel.llm.rows import append
from timbrel.llm.sampling import MAX_BYTES, draw_labelled

#: Training documents of each language, at most.
PER_LANGUAGE = 400
DIMENSIONS = 1 << 12
UNKNOWN = "und"
#: Least lead of the best codeword's probability over the second's.
LEAD = 0.2
ROWS = 256
#: Pairs of codewords looked at in all tries for a code.
TRIES = 100_000_000
#: Slots of the table of 3-grams met in fitting.
KNOWN = 1 << 20

#: Letters fold to lower case, all else that is ASCII to a space.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of +1 and -1: all splits in two up to 6 languages, above that random balanced columns, all rows apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] << 1 >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    bits = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(seed)
    best, best_gap = np.ones((n, bits)), -1.0
    for _ in range(max(1, min(50, TRIES // (n * n)))):
        half = np.where(np.arange(n) < n // 2, 1.0, -1.0)
        code = np.stack([rng.permutation(half) for _ in range(bits)], axis=1)
        gap = least_distance(code)
        if gap > best_gap:
            best, best_gap = code, gap
    return best


def least_distance(code: np.ndarray) -> float:
    """Bits in which the two nearest codewords differ."""
    sent, gap = code.astype(np.float32), np.inf
    for a in range(0, len(code), 1024):
        like = sent[a : a + 1024] @ sent.T
        like[np.arange(len(like)), a + np.arange(len(like))] = -np.inf
        gap = min(gap, (code.shape[1] - like.max()) / 2)
    return float(gap)


def vectors(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of hashed 1- to 3-gram counts of whole texts, rows of length one; n-grams of spaces only are left out."""
    n = len(at) - 1
    x = _FOLD[data]
    row = np.repeat(np.arange(n), np.diff(at))
    out = np.zeros(n * DIMENSIONS, np.float32)
    value = np.zeros(len(x), np.uint32)
    for size in (1, 2, 3):
        m = len(x) - size + 1
        if m <= 0:
            break
        value = value[:m] * np.uint32(0x01000193) + x[size - 1 :]
        slot = ((value * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
        letters = x[:m] != 32
        for j in range(1, size):
            letters |= x[j : m + j] != 32
        keep = letters & (row[:m] == row[size - 1 :])
        out += np.bincount(row[:m][keep] * DIMENSIONS + slot[keep], minlength=n * DIMENSIONS)
    out = np.sqrt(out.reshape(n, DIMENSIONS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of every byte 3-gram of the texts, a space put before and after each; those with no letter are left out."""
    x = np.insert(_FOLD[data], np.repeat(at, 2)[1:-1], 32)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at) + 2)
    value = (x[:-2] * np.uint32(0x01000193) + x[1:-1]) * np.uint32(0x01000193) + x[2:]
    keep = (row[:-2] == row[2:]) & ((x[:-2] != 32) | (x[1:-1] != 32) | (x[2:] != 32))
    return ((value[keep] * np.uint32(0x9E3779B1)) >> np.uint32(12)).astype(np.int64), row[:-2][keep]


def known_share(known: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of each text's 3-grams that ``known`` has; 1 for a text with none."""
    slot, row = trigrams(data, at)
    n = len(at) - 1
    total = np.bincount(row, minlength=n)
    return np.where(total > 0, np.bincount(row, weights=known[slot], minlength=n) / np.maximum(total, 1), 1.0)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    #: 3-grams met in fitting, and for each language the share of them under which a text is foreign.
    known: np.ndarray | None = None
    floor: np.ndarray | None = None

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability and its lead over the second."""
        margin = x @ self.weights + self.bias
        # of each bit the loss where the codeword has +1 and where it has -1: their mean, and half their difference by its sign
        yes, no = np.logaddexp(0, -margin), np.logaddexp(0, margin)
        loss = 0.5 * ((yes + no) @ self.trust)[:, None] + 0.5 * ((yes - no) * self.trust) @ self.code.T
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(p, axis=1)
        lead = order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)
        return p.argmax(axis=1), p.max(axis=1), lead


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 80, rate: float = 20.0, ridge: float = 1e-5) -> Model:
    """One logistic classifier a bit, languages weighted alike, by gradient steps with momentum."""
    code = codewords(len(languages))
    target = code[y]
    weight = (1 / np.bincount(y, minlength=len(languages)))[y]
    weight = (weight / weight.sum())[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        slope = -target * weight / (1 + np.exp(np.clip((x @ w + b) * target, -30, 30)))
        vw = 0.9 * vw - (rate * (x.T @ slope + ridge * w)).astype(np.float32)
        vb = 0.9 * vb - (0.05 * rate * slope.sum(axis=0)).astype(np.float32)
        w, b = w + vw, b + vb
    right = (((x @ w + b) * target > 0) * weight).sum(axis=0)
    trust = np.maximum(2 * right - 1, 1e-3)
    return Model(languages, code, w, b, trust * len(trust) / trust.sum() / max(1, len(trust) / 3))


def _folds(id_column: str, parts: int):
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(parts))


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, parts: int = 5, held_out: int = 0, max_bytes: int = MAX_BYTES) -> Model | None:
    """A model from text and lang of the documents outside the held-out fold; None if no language is known.

    At most ``per_language`` documents and ``max_bytes`` of text of each language are collected, and 12,000
    documents and 64 MB in all: of many languages each has an even part.
    """
    known = docs.where(F.col("lang").isNotNull() & (_folds("doc_id", parts) != held_out))
    rows = draw_labelled(known.select(F.col("lang").alias("label"), "doc_id", "text"), per_language, max_bytes)
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    rows.sort(key=lambda r: r[0])
    texts = pa.array([t for _, t in rows], pa.large_string())
    x = np.concatenate([vectors(data[: at[-1]], at) for _, _, data, at in row_chunks(texts)])
    number = {lang: k for k, lang in enumerate(languages)}
    y = np.array([number[lang] for lang, _ in rows])
    model = fit(x, y, languages)
    model.known, model.floor = _familiar(texts, y, len(languages))
    return model


def _familiar(texts: pa.Array, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The 3-grams of all texts, and each language's floor: half the share that 99 % of its texts reach
    when only every other text is known; 0 for a language of one text, which tells nothing."""
    half = np.zeros((2, KNOWN), bool)
    for begin, end, data, at in row_chunks(texts):
        slot, row = trigrams(data[: at[-1]], at)
        half[(row + begin) % 2, slot] = True
    share = np.zeros(len(y))
    for begin, end, data, at in row_chunks(texts):
        both = np.stack([known_share(h, data[: at[-1]], at) for h in half])
        share[begin:end] = both[1 - np.arange(begin, end) % 2, np.arange(end - begin)]
    floor = [0.5 * np.quantile(share[y == k], 0.01) if (y == k).sum() > 1 else 0.0 for k in range(n)]
    return half[0] | half[1], np.array(floor)


def row_chunks(texts, limit: int = ROWS):
    """Chunks of at most ``limit`` rows, for kernels with a wide row."""
    for begin, _, data, at in tk.chunks(texts):
        for i in range(0, len(at) - 1, limit):
            j = min(i + limit, len(at) - 1)
            yield begin + i, begin + j, data[at[i] : at[j]], at[i : j + 1] - at[i]


def _kernel(model: Model | None, lead: float):
    def run(texts) -> list:
        names, scores, unsure = [], [], []
        spelled = texts.to_pylist()
        for begin, end, data, at in row_chunks(texts):
            lettered = [any(map(str.isalpha, t)) if t else False for t in spelled[begin:end]]
            if model is None:
                best, score, gap = np.zeros(end - begin, int), np.zeros(end - begin), np.zeros(end - begin)
            else:
                best, score, gap = model.decode(vectors(data, at))
            for i, ok in enumerate(lettered):
                ok = ok and model is not None
                names.append(model.languages[best[i]] if ok else UNKNOWN)
                scores.append(float(score[i]) if ok else 0.0)
                unsure.append(bool(gap[i] < lead) if ok else True)
        return [names, scores, unsure]

    return run


def identify(docs: DataFrame, model: Model | None, text: str = "text", lead: float = LEAD, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous.

    ``und`` with score 0, flagged ambiguous, for null, empty and letterless texts and where no
    language could be learned.  Whole texts, a row at a time: repeated rows get the same answer,
    an empty table stays empty, input columns named like a result are replaced.  No shuffle; the
    model sent to each task has a fixed number of weights for each bit.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return append(docs, lambda: _kernel(sent.value, lead), FIELDS, (text,), keep)


def foreign(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``identify`` with a column foreign: und, or fewer known 3-grams than the floor of the language predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        judge = _kernel(sent.value, LEAD)

        def run(texts) -> list:
            names, scores, unsure = judge(texts)
            share = np.concatenate([np.zeros(0), *(known_share(sent.value.known, data, at) for _, _, data, at in row_chunks(texts))])
            floor = dict(zip(sent.value.languages, sent.value.floor, strict=True))
            return [names, scores, unsure, [bool(s < floor.get(name, 2.0)) for s, name in zip(share, names, strict=True)]]

        return run

    return append(docs, make, T.StructType([*FIELDS, T.StructField("foreign", T.BooleanType())]), (text,))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit_languages(docs), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(_folds("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
