"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over the words and word prefixes of a text is trained from confirmed toxic documents and
unlabelled text only.  Its risk is  prior * E_pos[loss(+f)] + max(0, E_unl[loss(-f)] - prior *
E_pos[loss(-f)]);  where the bracket turns negative the step ascends it, so the classifier cannot
win by memorising the positives.  Both are bounded samples of labelled rows (``max_positive`` and
``max_unlabelled`` documents, ``max_bytes`` of text), drawn by hash.
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
from timbrel.llm.sampling import draw_labelled

MAX_POSITIVE = 2000
MAX_UNLABELLED = 6000
MAX_BYTES = 24 << 20
#: Positives that hold a feature, at least; its least contrast in standard errors; features at most.
MIN_DOCS = 3
CONTRAST = 5.0
MAX_FEATURES = 4000
#: Lengths in bytes of the word prefixes that are features beside whole words.
PREFIXES = range(4, 11)
LEVELS = 3
#: Share of toxic documents where the labels do not tell.
PRIOR = 0.1
THRESHOLD = 0.3

FIELDS = T.StructType([T.StructField("score", T.DoubleType())])


@dataclass
class Model:
    """Sorted hashes of words and prefixes, the weight for 1, 2 and more distinct words that have it, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def _features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct word of a text and, for each such word, of its proper prefixes of PREFIXES bytes."""
    start, end, whole, row = tk.words(data, at, tk.ALNUM_TABLE)
    order = np.lexsort((whole, row))
    first = np.ones(len(row), bool)
    first[1:] = (row[order][1:] != row[order][:-1]) | (whole[order][1:] != whole[order][:-1])
    order = order[first]
    start, end, whole, row = start[order], end[order], whole[order], row[order]
    prefix = tk.prefix_hash(tk.ALNUM_TABLE[data])
    rows, found = [row], [whole]
    for size in PREFIXES:
        longer = np.flatnonzero(end - start > size)
        rows.append(row[longer])
        found.append(~tk.span_hash(prefix, start[longer], start[longer] + size))
    return np.concatenate(rows), np.concatenate(found)


def _counted(texts, among: np.ndarray | None = None):
    """Chunk by chunk: rows, feature hashes and the number of distinct words behind each; only features in the sorted ``among``, if given."""
    for begin, _, data, at in tk.chunks(texts, 1 << 19):
        row, hashes = _features(data, at)
        if among is not None:
            known = _known(hashes, among)
            row, hashes = row[known], hashes[known]
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        at_first = np.flatnonzero(first)
        yield begin + row[at_first], hashes[at_first], np.diff(np.append(at_first, len(row)))


def _known(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _frequent(texts) -> np.ndarray:
    """Features that MIN_DOCS of the texts have, sorted."""
    word = np.concatenate([np.zeros(0, np.uint64), *(h for _, h, _ in _counted(texts))])
    word.sort()
    far = word[MIN_DOCS - 1 :] == word[: len(word) - MIN_DOCS + 1]
    return np.unique(word[: len(far)][far])


def _levels(texts, table: np.ndarray):
    """Chunk by chunk: rows and numbers (place in the table * LEVELS + level) of the features present."""
    for row, hashes, times in _counted(texts, table):
        place = np.searchsorted(table, hashes)
        for k in range(LEVELS):
            yield row[times > k], place[times > k] * LEVELS + k


def fit(texts, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4, contrast: float = CONTRAST, most: int = MAX_FEATURES) -> Model:
    """``positive`` marks the confirmed toxic among ``texts``; all others are unlabelled.

    A feature is a word or prefix that 1, 2 or 3 (LEVELS) distinct words of the text have, at
    least.  Those are used whose share among the positives stands ``contrast`` standard errors
    above that among the unlabelled, the ``most`` telling ones at most.  Features are counted and
    then gathered in two passes, so only those used are ever held for all texts.
    """
    n, p = len(positive), positive.astype(bool)
    # no feature passes that few positives have, so only theirs are counted among the unlabelled
    vocabulary = _frequent(texts.filter(pa.array(p)))
    n_pos, n_unl = max(1, int(p.sum())), max(1, int((~p).sum()))
    size = len(vocabulary) * LEVELS
    in_pos, in_unl = np.zeros(size), np.zeros(size)
    for row, at in _levels(texts, vocabulary):
        in_pos += np.bincount(at[p[row]], minlength=size)
        in_unl += np.bincount(at[~p[row]], minlength=size)
    pooled = (in_pos + in_unl + 1) / (n + 2)
    z = (in_pos / n_pos - in_unl / n_unl) / np.sqrt(pooled * (1 - pooled) * (1 / n_pos + 1 / n_unl))
    z[in_pos < MIN_DOCS] = 0
    chosen = np.zeros(size, bool)
    best = np.argsort(-z, kind="stable")[:most]
    chosen[best[z[best] >= contrast]] = True
    number = np.cumsum(chosen) - 1
    n_features = int(chosen.sum())
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    held += [(row[chosen[at]], number[at[chosen[at]]]) for row, at in _levels(texts, vocabulary)]
    row, at = (np.concatenate(x) for x in zip(*held, strict=True))
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, var = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        f = np.clip(np.bincount(row, weights=w[at], minlength=n) + w[-1], -40, 40)
        s = 1 / (1 + np.exp(-f))
        rest = s[~p].sum() / n_unl - prior * s[p].sum() / n_pos
        bend = s * (1 - s)
        slope = np.where(p, -prior * bend / n_pos, bend / n_unl)
        # the positives' own risk counts too, unless the bracket is negative: then that alone is ascended
        slope = -slope if rest < 0 else slope - np.where(p, prior * bend / n_pos, 0)
        g = np.append(np.bincount(at, weights=slope[row], minlength=n_features), slope.sum())
        g[:-1] += ridge * w[:-1]
        mean = 0.9 * mean + 0.1 * g
        var = 0.999 * var + 0.001 * g**2
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-6)
    weights = np.zeros(size)
    weights[chosen] = w[:-1]
    weights = weights.reshape(-1, LEVELS)
    used = weights.any(axis=1)
    return Model(vocabulary[used], np.cumsum(weights[used], axis=1), float(w[-1]))


def _folds(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def fit_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_bytes: int = MAX_BYTES) -> Model:
    """A model from labels outside the held-out fold; without any toxic label, or any other, it scores every text with PRIOR.

    Positives are documents labelled toxic.  The unlabelled text is that of documents with any
    label, the label itself not looked at: so its share of toxic documents is that of the labels,
    which is the prior.  Labels of one document that differ count as toxic.  At most
    ``max_positive`` and ``max_unlabelled`` documents and ``max_bytes`` of text of each are collected.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (_folds(parts) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = usable.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("toxic")).first()
    n, n_toxic = total["n"], total["toxic"] or 0
    # labels that confirm toxic documents alone say nothing of the rest, nor of its share
    told = 0 < n_toxic < n
    prior = min(0.5, max(0.005, n_toxic / n)) if told else PRIOR
    bias = float(np.log(prior / (1 - prior)))
    none = Model(np.zeros(0, np.uint64), np.zeros((0, LEVELS)), bias)
    if not told:
        return none
    draw = F.xxhash64(F.col("doc_id").cast("string"))
    pick = lambda rows, most: [r["doc_id"] for r in rows.orderBy(draw, "doc_id").limit(most).select("doc_id").collect()]
    kind = T.StructType([T.StructField("label", T.StringType()), T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    positive = pick(usable.where("toxic = 1"), max_positive)
    rest = pick(usable, max_unlabelled)
    wanted = docs.sparkSession.createDataFrame([("positive", i) for i in positive] + [("unlabelled", i) for i in rest], kind)
    rows = docs.join(F.broadcast(wanted), "doc_id").select("label", "doc_id", "text")
    drawn = draw_labelled(rows, max(max_positive, max_unlabelled), max_bytes)
    texts = {k: [t for label, t in drawn if label == k][:most] for k, most in (("positive", max_positive), ("unlabelled", max_unlabelled))}
    if not texts["positive"]:
        return none
    marks = np.array([k == "positive" for k in texts for _ in texts[k]])
    return fit(pa.array(texts["positive"] + texts["unlabelled"], pa.large_string()), marks, prior)


def _kernel(model: Model):
    table, weights = model.words, model.weights

    def run(texts) -> list:
        f = np.full(len(texts), model.bias)
        if len(table):
            for begin, end, data, at in tk.chunks(texts):
                row, hashes = _features(data, at)
                place = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                known = table[place] == hashes
                pair, times = np.unique(row[known] * len(table) + place[known], return_counts=True)
                f[begin:end] += np.bincount(pair // len(table), weights=weights[pair % len(table), np.minimum(times, LEVELS) - 1], minlength=end - begin)
        return [1 / (1 + np.exp(-np.clip(f, -40, 40)))]

    return run


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score, 0 to 1.

    Null, empty and wordless texts get the bias alone.  Repeated rows score alike, an empty table
    stays empty, a column named score is replaced.  No shuffle; the model's size is bounded by the
    samples it was fitted on.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return append(docs, lambda: _kernel(sent.value), FIELDS, (text,), keep)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(_folds(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
