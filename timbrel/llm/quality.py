"""Quality rules with a line-level conditional random field.

Counting rules are exact.  On top of them a linear-chain CRF labels each line content or
boilerplate; Viterbi decoding gives the best label sequence of a text, and the share of words in
content lines decides retention.  The CRF is fitted on a bounded sample of labelled documents
(``max_docs`` and ``max_bytes`` of text for each quality label, drawn by hash): lines of poor documents and
repeated lines count as boilerplate.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.llm import textkit as tk
from timbrel.llm.rows import append
from timbrel.llm.sampling import MAX_BYTES, draw_labelled

#: Documents of each quality label that the field is fitted on, at most.
MAX_DOCS = 1000
#: Least share of a text's words in content lines.
MIN_CONTENT = 0.5

FEATURES = ("bias", "repeated line", "few words", "symbols", "capitals", "digits", "exclamations", "repeats of the word before", "sentence end", "long words")
SYMBOLS = b"#*$%&|<>"


@dataclass
class Field:
    """Weights of a two-label chain: ``emit`` scores content against boilerplate, ``move[a, b]`` label b after a."""

    emit: np.ndarray
    move: np.ndarray


#: For use without labelled documents, in the order of FEATURES.
DEFAULT = Field(np.array([2.0, -2.0, -0.5, -5.0, -5.0, -2.0, -4.0, -6.0, 0.5, -0.5]), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[np.frombuffer(chars, np.uint8)] = 1
    return out


_LETTERS = bytes(range(65, 91))
_CLASS = {"symbol": _table(SYMBOLS), "capital": _table(_LETTERS), "digit": _table(b"0123456789"), "shout": _table(b"!"), "space": _table(b" \t\n\v\f\r")}
_HEADS = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int32)


@dataclass
class Lines:
    """Lines with a word of a run of texts, and what the counting rules need."""

    row: np.ndarray
    words: np.ndarray
    features: np.ndarray
    rows: dict[str, np.ndarray]


def measure(data: np.ndarray, at: np.ndarray) -> Lines:
    n = len(at) - 1
    start, end, hashes, row = tk.words(data, at, tk.SPACE_TABLE)
    sums = {k: np.concatenate([[0], np.cumsum(t[data])]) for k, t in _CLASS.items()}
    heads = np.concatenate([[0], np.cumsum(_HEADS[data])])
    chars, spaces = heads[at[1:]] - heads[at[:-1]], sums["space"][at[1:]] - sums["space"][at[:-1]]

    # words in three-word windows found twice or more in their text
    gram = tk.grams(hashes, 3)
    whole = row[: len(gram)] == row[2:] if len(gram) else np.zeros(0, bool)
    key = gram + tk.mix(row[: len(gram)].astype(np.uint64) + np.uint64(1))
    key = key[whole]
    where = np.flatnonzero(whole)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[where[again] + j] = True

    # lines
    feed = np.flatnonzero(data == 10)
    feed_row = np.searchsorted(at, feed, "right") - 1
    first = np.concatenate([at[:-1], feed + 1])
    owner = np.concatenate([np.arange(n), feed_row])
    order = np.lexsort((first, owner))
    first, owner = first[order], owner[order]
    last = np.empty_like(first)
    last[:-1] = np.where(owner[1:] == owner[:-1], first[1:] - 1, 0)
    final = np.ones(len(first), bool)
    final[:-1] = owner[1:] != owner[:-1]
    last[final] = at[owner[final] + 1]
    # word -> line: the last line of the word's row that starts at or before it
    line_key = owner * (len(data) + 2) + first
    of = np.searchsorted(line_key, row * (len(data) + 2) + start, "right") - 1
    count = np.bincount(of, minlength=len(first))
    line_hash = tk.span_hash(tk.prefix_hash(data), first, last)
    full = count > 0
    index = np.flatnonzero(full)
    pair = line_hash[index] + tk.mix(owner[index].astype(np.uint64) + np.uint64(1))
    order = np.argsort(pair, kind="stable")
    seen = np.zeros(len(index), bool)
    seen[order[1:][pair[order][1:] == pair[order][:-1]]] = True

    echo = np.zeros(len(hashes))
    if len(hashes) > 1:
        echo[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    a, b, words = first[index], last[index], count[index]
    size = np.maximum(heads[b] - heads[a], 1)
    letters = np.maximum(size - (sums["space"][b] - sums["space"][a]), 1)
    share = {k: (s[b] - s[a]) / letters for k, s in sums.items()}
    tail = end[np.searchsorted(of, index, "right") - 1] - 1 if len(index) else np.zeros(0, np.int64)
    features = np.stack(
        [np.ones(len(index)), seen, words < 3, np.minimum(1, 12 * share["symbol"]), share["capital"], np.minimum(1, 5 * share["digit"]), np.minimum(1, 8 * share["shout"]), np.bincount(of, weights=echo, minlength=len(first))[index] / np.maximum(words, 1), np.isin(data[tail], np.frombuffer(b".!?:;", np.uint8)), letters / np.maximum(words, 1) > 15],
        axis=1,
    ).astype(np.float64)
    rows = {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": chars - spaces,
        "n_symbols": sums["symbol"][at[1:]] - sums["symbol"][at[:-1]],
        "n_dup_lines": np.bincount(owner[index][seen], minlength=n),
        "n_repeat_words": np.bincount(row[covered], minlength=n),
    }
    return Lines(owner[index], words, features, rows)


def _chains(row: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First line and length of each chain, longest first; chains over ``longest`` lines are cut."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], row[1:] != row[:-1]])
    if longest:
        begin = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
        new |= (np.arange(len(row)) - begin) % longest == 0
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(row)))
    order = np.argsort(-length, kind="stable")
    return first[order], length[order]


def viterbi(features: np.ndarray, row: np.ndarray, field: Field) -> np.ndarray:
    """Best label (1: content) of each line, all chains in step; ties go to boilerplate."""
    first, length = _chains(row)
    score = np.stack([np.zeros(len(row)), features @ field.emit], axis=1)
    label = np.zeros(len(row), np.int8)
    if not len(first):
        return label
    back = np.zeros((len(row), 2), np.int8)
    best = score[first].copy()
    active = np.searchsorted(-length, -np.arange(int(length[0]) + 1), "left")  # chains of more than t lines
    for t in range(1, int(length[0])):
        k = active[t]
        via = best[:k, :, None] + field.move
        back[first[:k] + t] = via[:, 1] > via[:, 0]
        best[:k] = via.max(axis=1) + score[first[:k] + t]
    end = (best[:, 1] > best[:, 0]).astype(np.int8)
    now = end.copy()
    for t in range(int(length[0]) - 1, -1, -1):
        k = active[t]
        label[first[:k] + t] = now[:k]
        now[:k] = back[first[:k] + t, now[:k]] if t else now[:k]
    return label


def fit(features: np.ndarray, row: np.ndarray, label: np.ndarray, steps: int = 200, rate: float = 0.2, ridge: float = 1e-3, ridge_move: float = 3e-2) -> Field:
    """Maximum conditional likelihood by forward-backward and Adam; long chains are cut at 64 lines.

    Moves are shrunk more than emissions: most texts are of one label throughout, and unchecked
    moves would let one repeated line take a short text along.
    """
    first, length = _chains(row, 64)
    active = np.searchsorted(-length, -np.arange(int(length[0]) + 1), "left")
    longest = int(length[0])
    theta = np.zeros(features.shape[1] + 4)
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    moved, shrink = np.zeros((2, 2)), np.append(np.full(features.shape[1], ridge), np.full(4, ridge_move))
    for t in range(1, longest):
        k = active[t]
        np.add.at(moved, (label[first[:k] + t - 1], label[first[:k] + t]), 1)
    wanted = np.concatenate([features[label == 1].sum(axis=0), moved.ravel()])
    n = len(row)
    for step in range(1, steps + 1):
        emit, move = theta[:-4], theta[-4:].reshape(2, 2)
        score = np.stack([np.zeros(n), features @ emit], axis=1)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[first] = score[first]
        for t in range(1, longest):
            at = first[: active[t]] + t
            via = ahead[at - 1][:, :, None] + move
            ahead[at] = np.logaddexp(via[:, 0], via[:, 1]) + score[at]
        total = np.logaddexp(ahead[first + length - 1, 0], ahead[first + length - 1, 1])
        expected = np.zeros((2, 2))
        for t in range(longest - 1, 0, -1):
            k = active[t]
            at = first[:k] + t
            out = (score[at] + behind[at])[:, None, :] + move
            expected += np.exp(ahead[at - 1][:, :, None] + out - total[:k, None, None]).sum(axis=0)
            behind[at - 1] = np.logaddexp(out[:, :, 0], out[:, :, 1])
        whole = np.empty(n)
        for t in range(longest):
            k = active[t]
            whole[first[:k] + t] = total[:k]
        content = np.exp(ahead[:, 1] + behind[:, 1] - whole)
        slope = (wanted - np.concatenate([features.T @ content, expected.ravel()])) / n - shrink * theta
        mean = 0.9 * mean + 0.1 * slope
        var = 0.99 * var + 0.01 * slope**2
        theta += rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def _unfitted(why: str) -> Field:
    warnings.warn(f"quality rules are not fitted: {why}", stacklevel=3)
    return DEFAULT


def fit_field(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Field:
    """The field for these documents: a bounded sample, the same for any order of rows; DEFAULT without both labels.

    At most ``max_docs`` documents and ``max_bytes`` of text of each quality label are collected, drawn among
    labels that have a document.  Labels of one document that differ count as the lowest.  Where there is nothing to fit,
    a warning says so and DEFAULT is used.
    """
    rated = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    # ids alone meet before the draw
    rated = rated.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = [tuple(r) for q in (0, 1) for r in rated.where(F.col("label") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()]
    if len({q for _, q in ids}) < 2:
        return _unfitted("no document has a label of each quality")
    chosen = docs.sparkSession.createDataFrame(ids, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("label", T.IntegerType())]))
    found = draw_labelled(docs.join(F.broadcast(chosen), "doc_id").select("label", "doc_id", "text"), max_docs, max_bytes)
    texts = [t for _, t in found]
    if len({q for q, _ in found}) < 2:
        return _unfitted(f"no text of one quality is within {max_bytes} bytes")
    import pyarrow as pa

    parts, base = [], 0
    good = np.array([q == 1 for q, _ in found])
    for begin, end, data, at in tk.chunks(pa.array(texts, pa.large_string())):
        lines = measure(data, at)
        parts.append((lines.features, lines.row + base, good[begin:end][lines.row] & (lines.features[:, 1] == 0)))
        base += end - begin
    features, row, label = (np.concatenate(x) for x in zip(*parts, strict=True))
    return fit(features, row, label.astype(np.int8)) if len(row) else _unfitted("no labelled text has a line with a word")


FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("content_share", T.DoubleType()), T.StructField("line_labels", T.StringType())])


def _kernel(field: Field, spell: bool):
    def run(texts) -> list:
        out: list[list] = [[] for _ in FIELDS]
        for _, _, data, at in tk.chunks(texts):
            n = len(at) - 1
            lines = measure(data, at)
            label = viterbi(lines.features, lines.row, field)
            kept = np.bincount(lines.row, weights=lines.words * label, minlength=n)
            total = lines.rows["n_words"]
            made = [*lines.rows.values(), np.where(total > 0, kept / np.maximum(total, 1), 0.0)]
            for column, values in zip(out, made, strict=False):
                column.append(values)
            cut = np.searchsorted(lines.row, np.arange(n + 1))
            marks = np.where(label == 1, ord("c"), ord("b")).astype(np.uint8).tobytes().decode()
            out[-1] += [marks[cut[i] : cut[i + 1]] for i in range(n)] if spell else [None] * n
        return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out[:-1]] + [out[-1]]

    return run


def rate_quality(docs: DataFrame, field: Field, text: str = "text", min_content: float = MIN_CONTENT, line_labels: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the counts, content_share, line_labels (c or b for each line with a word), base_failed and kept.

    Null and empty texts have no words and fail.  Repeated rows are rated alike; an empty table
    stays empty; input columns named like a result are replaced.  Memory: one text at a time at
    worst.  No shuffle.
    """
    share = T.StructType([f for f in FIELDS if line_labels or f.name != "line_labels"])

    def make():
        run = _kernel(field, line_labels)
        return run if line_labels else lambda texts: run(texts)[:-1]

    out = append(docs.drop("base_failed", "kept") if keep is None else docs, make, share, (text,), keep)
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= F.lit(min_content)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = rate_quality(docs, field, line_labels=False, keep=["doc_id"])
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


__all__ = ["DEFAULT", "Field", "fit", "fit_field", "measure", "query", "rate_quality", "viterbi"]
