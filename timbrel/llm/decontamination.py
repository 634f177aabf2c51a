"""Benchmark decontamination by winnowing.

Of every ``span`` consecutive words, training and test side keep the minimum hash of the word
k-grams inside (leftmost on ties), so two texts that share ``span`` words keep a common
fingerprint.  Training fingerprints are joined to those of the benchmark; each hit is extended
to all windows of ``span`` words around it, which are compared word by word.

The benchmark's size is measured.  Up to ``block_bytes`` of text its index is broadcast, and the
join is a look-up where the documents lie.  A larger one is joined by shuffles: fingerprints to
fingerprints, then the windows around the hits to the benchmark's windows, with the same results.
A benchmark of any size costs the same passes over the documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.llm import textkit as tk
from timbrel.llm.rows import FILTER_BITS, append, filter_bits, may_be, quoted
from timbrel.sources.tables import forget, settle

SPAN = 13
GRAM = 5
#: Bytes of a benchmark's text that one index in memory takes, at most.
BLOCK_BYTES = 16 << 20

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


def fingerprints(hashes: np.ndarray, row: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints of word hashes: values and word positions."""
    k = tk.grams(hashes, gram)
    low = np.uint64((1 << max(1, len(k).bit_length())) - 1)
    least = tk.window_min((k & ~low) | np.arange(len(k), dtype=np.uint64), span - gram + 1)
    whole = row[: len(least)] == row[span - 1 : span - 1 + len(least)]
    at = np.unique((least[whole] & low).astype(np.int64))
    return k[at], at


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


@dataclass
class Index:
    """Fingerprints and windows of a block of benchmark items, as flat arrays: some 50 bytes a word."""

    span: int
    gram: int
    items: list[str]
    prints: np.ndarray
    #: all items' folded words, one space between, and where each word starts and ends in it
    spelled: bytes
    start: np.ndarray
    end: np.ndarray
    #: window length in words -> (sorted window hashes, bounds into owners, owners, first word of one occurrence of each)
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def build(items: list[tuple[str, str]], span: int, gram: int) -> Index:
        prints, words, hashes, rows = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, _, data, at in tk.chunks(pa.array([t for _, t in items], pa.large_string())):
            start, end, h, row = tk.words(data, at, tk.ALNUM_TABLE)
            folded = tk.ALNUM_TABLE[data].tobytes()
            words += [folded[a:b] for a, b in zip(start, end, strict=True)]
            prints.append(fingerprints(h, row, span, gram)[0])
            hashes.append(h)
            rows.append(row + first)
        h, row = np.concatenate(hashes), np.concatenate(rows)
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size + 1) - 1
        out = Index(span, gram, [i for i, _ in items], np.unique(np.concatenate(prints)), b" ".join(words), end - size, end)
        fits = np.minimum(np.bincount(row, minlength=len(items)), span)
        for length in sorted({int(n) for n in fits if n}):
            value = tk.grams(h, length)
            place = np.flatnonzero((row[: len(value)] == row[length - 1 :]) & (fits[row[: len(value)]] == length))
            value, owner = value[place], row[place]
            order = np.lexsort((place, owner, value))
            value, owner, place = value[order], owner[order], place[order]
            fresh = np.concatenate([[True], value[1:] != value[:-1]])
            once = fresh | np.concatenate([[True], owner[1:] != owner[:-1]])
            table = value[fresh]
            bounds = np.append(np.flatnonzero(fresh[once]), int(once.sum()))
            out.windows[length] = (table, bounds, owner[once].astype(np.int32), place[fresh])
        return out

    def window(self, length: int, which: int) -> bytes:
        first = int(self.windows[length][3][which])
        return self.spelled[self.start[first] : self.end[first + length - 1]]

    def matches(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, length, window number) of each occurrence of a window in the words given."""
        out = []
        folded = b""
        for length, (table, _, _, _) in self.windows.items():
            if len(hashes) < length:
                continue
            if length == self.span:
                values, at = fingerprints(hashes, row, self.span, self.gram)
                at = at[_member(values, self.prints) >= 0]
                if not len(at):
                    continue
                # a hit is extended to each window that holds its k-gram
                begin = np.unique((at[:, None] - np.arange(self.span - self.gram + 1)).ravel())
                begin = begin[(begin >= 0) & (begin + length <= len(hashes))]
                value = hashes[begin].copy()
                for j in range(1, length):
                    value *= np.uint64(0x100000001B3)
                    value += hashes[begin + j]
                value = tk.mix(value)
            else:
                begin, value = np.arange(len(hashes) - length + 1), tk.grams(hashes, length)
            which = _member(value, table)
            ok = np.flatnonzero((which >= 0) & (row[begin] == row[begin + length - 1]))
            if len(ok):
                folded = folded or tk.ALNUM_TABLE[data].tobytes()
            for i in ok:
                s = begin[i]
                if b" ".join(folded[a:b] for a, b in zip(start[s : s + length], end[s : s + length], strict=True)) == self.window(length, int(which[i])):
                    out.append((int(s), length, int(which[i])))
        return out


def _told(n_words: np.ndarray, hits: dict[int, list[tuple[int, int]]], items: dict[int, set[str]]) -> list:
    """Result columns of rows, from the (first word, length) of the windows in each and their items."""
    n = len(n_words)
    n_hit, spans = np.zeros(n, np.int64), [[]] * n
    for r, found in hits.items():
        cover = np.zeros(int(n_words[r]) + 1, np.int32)
        begin, length = np.array(found).T
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + length, -1)
        inside = np.cumsum(cover[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
        spans[r] = [{"start": x, "end": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        n_hit[r] = int(inside.sum())
    return [n_words, n_hit, pa.array(spans, FIELDS_ARROW[2]), pa.array([sorted(items.get(r, ())) for r in range(n)], FIELDS_ARROW[3])]


def _kernel(index: Index):
    """Whole results, by an index of the whole benchmark."""

    def run(texts) -> list:
        n_words = np.zeros(len(texts), np.int64)
        hits: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for first, last, data, at in tk.chunks(texts):
            start, end, hashes, row = tk.words(data, at, tk.ALNUM_TABLE)
            n_words[first:last] = np.bincount(row, minlength=last - first)
            base = np.searchsorted(row, np.arange(last - first + 1))
            for s, length, which in index.matches(data, start, end, hashes, row):
                r = first + int(row[s])
                _, bounds, own, _ = index.windows[length]
                hits.setdefault(r, []).append((s - int(base[r - first]), length))
                items.setdefault(r, set()).update(index.items[o] for o in own[bounds[which] : bounds[which + 1]].tolist())
        return _told(n_words, hits, items)

    return run


def _print_kernel(span: int, gram: int, lengths: list[int], slots: np.ndarray | None):
    """Distinct fingerprints of each text: winnowed ones of ``span`` words, and all grams of the shorter ``lengths``; with ``slots`` only those the filter lets pass."""

    def run(texts) -> list:
        n_words, out = [], []
        for first, last, data, at in tk.chunks(texts):
            _, _, hashes, row = tk.words(data, at, tk.ALNUM_TABLE)
            n_words.append(np.bincount(row, minlength=last - first))
            values, place = fingerprints(hashes, row, span, gram)
            rows, prints = [row[place]], [values]
            for n in lengths:
                value = tk.grams(hashes, n)
                ok = row[: len(value)] == row[n - 1 :]
                rows.append(row[: len(value)][ok])
                prints.append(tk.mix(value[ok] + np.uint64(n)))
            rows, prints = np.concatenate(rows), np.concatenate(prints)
            if slots is not None:
                slot = prints >> np.uint64(64 - FILTER_BITS)
                passed = (slots[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                rows, prints = rows[passed], prints[passed]
            order = np.lexsort((prints, rows))
            rows, prints = rows[order], prints[order]
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows[1:] != rows[:-1]) | (prints[1:] != prints[:-1])
            cut = np.searchsorted(rows[fresh], np.arange(last - first + 1))
            out += [prints[fresh][a:b].view(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return [np.concatenate(n_words) if n_words else np.zeros(0, np.int64), pa.array(out, pa.list_(pa.int64()))]

    return run


def _window_kernel(span: int, gram: int, lengths: list[int] | None):
    """Windows of each text (begin, folded words): around the fingerprints given, or of an item whole (``lengths`` None)."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("length", pa.int64()), ("window", pa.string())]))

    def run(texts, prints=None) -> list:
        out: list[list[dict]] = []
        wanted = None if prints is None else prints.to_pylist()
        for first, last, data, at in tk.chunks(texts):
            start, end, hashes, row = tk.words(data, at, tk.ALNUM_TABLE)
            folded = tk.ALNUM_TABLE[data].tobytes()
            cut = np.searchsorted(row, np.arange(last - first + 1))
            for r in range(last - first):
                a, b = int(cut[r]), int(cut[r + 1])
                own, none = hashes[a:b], np.zeros(b - a, np.int64)
                found: list[tuple[int, int]] = []
                if lengths is None:
                    n = min(span, b - a)
                    found = [(i, n) for i in range(b - a - n + 1)] if n else []
                elif wanted[first + r]:
                    known = np.array(wanted[first + r], np.int64).view(np.uint64)
                    values, place = fingerprints(own, none, span, gram)
                    near = (place[np.isin(values, known)][:, None] - np.arange(span - gram + 1)).ravel()
                    found = [(int(i), span) for i in np.unique(near) if 0 <= i <= b - a - span]
                    for n in lengths:
                        found += [(int(i), n) for i in np.flatnonzero(np.isin(tk.mix(tk.grams(own, n) + np.uint64(n)), known))]
                spell = lambda i, n, a=a: b" ".join(folded[x:y] for x, y in zip(start[a + i : a + i + n], end[a + i : a + i + n], strict=True)).decode()
                out.append([{"begin": i, "length": n, "window": spell(i, n)} for i, n in found])
        return [pa.array(out, kind)]

    return run


def owners(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (i, length, window): each window with the set of its items, (length, window, set), and the sets, (set, items).

    Windows of the same items share a set, so a passage of many items is one row wherever it occurs.
    """
    grouped = settle(windows.groupBy("length", "window").agg(F.array_sort(F.collect_set("i")).alias("items")).withColumn("set", F.md5(F.to_json("items"))))
    return grouped.select("length", "window", "set"), settle(grouped.select("set", "items").dropDuplicates(["set"]))


def _by_shuffle(docs: DataFrame, items: DataFrame, text: str, span: int, gram: int, carried: list[str]) -> DataFrame:
    """Results for a benchmark too large to broadcast.  Texts are known by their digest; equal ones are looked up once.

    Fingerprints and windows cross the network, and the texts of rows that may have hits; all others stay where they are.
    """
    spark = docs.sparkSession
    sized = append(items, lambda: _print_kernel(span, gram, [], None), T.StructType([T.StructField("n", T.LongType()), T.StructField("prints", T.ArrayType(T.LongType()))]), ("t",))
    lengths = sorted(r["n"] for r in sized.where(F.col("n").between(1, span - 1)).select("n").distinct().collect())  # 12 numbers at most
    listed = settle(append(items, lambda: _window_kernel(span, gram, None), T.StructType([T.StructField("windows", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("length", T.LongType()), T.StructField("window", T.StringType())])))]), ("t",), ["i"]))
    windows, sets = owners(listed.select("i", F.explode("windows").alias("w")).select("i", "w.length", "w.window"))
    forget(listed)
    short = windows.where(F.col("length") < span).select("length", "window").distinct()
    own = append(short, lambda: _whole_kernel(), T.StructType([T.StructField("print", T.LongType())]), ("window",), [])
    prints = settle(sized.select(F.explode("prints").alias("print")).unionByName(own).distinct())
    slots = spark.sparkContext.broadcast(filter_bits(prints))

    digest = F.unhex(F.md5(F.coalesce(quoted(text), F.lit("")))).alias("__digest")
    source = docs.select(digest, F.coalesce(quoted(text), F.lit("")).alias("t"))
    told = append(source, lambda: _print_kernel(span, gram, lengths, slots.value), T.StructType([T.StructField("n", T.LongType()), T.StructField("prints", T.ArrayType(T.LongType()))]), ("t",), ["__digest"])
    marked = settle(told.where(F.size("prints") > 0).select(F.col("__digest").alias("digest"), "prints").dropDuplicates(["digest"]).select("digest", F.explode("prints").alias("print")))
    # a passage of many texts is a skewed join between two exchanges, which Spark splits
    hits = settle(marked.join(prints.hint("merge"), "print").groupBy("digest").agg(F.collect_list("print").alias("prints")))
    # copies are one text before they meet, task by task, so they never lie in one
    texts = may_be(source, "__digest", hits, "digest").where("__maybe").dropDuplicates(["__digest"]).join(hits.hint("merge"), F.col("__digest") == F.col("digest")).select("digest", "t", "prints")
    kind = T.StructType([T.StructField("windows", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("length", T.LongType()), T.StructField("window", T.StringType())])))])
    around = settle(append(texts, lambda: _window_kernel(span, gram, lengths), kind, ("t", "prints"), ["digest"]).select("digest", F.explode("windows").alias("w")).select("digest", "w.*"))
    met = settle(around.join(windows.hint("merge"), ["length", "window"]).select("digest", "begin", "length", "set").distinct())
    of_sets = met.select("digest", "set").distinct().join(sets.hint("merge"), "set").groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("owners"))
    found = settle(met.groupBy("digest").agg(F.collect_set(F.struct("begin", "length")).alias("found")).join(of_sets, "digest"))
    rows = may_be(docs.select(*[quoted(c) for c in carried], quoted(text).alias("__text"), digest), "__digest", found, "digest")
    names = [*carried, "__text", "found", "owners"]
    joined = rows.where("__maybe").join(found.hint("merge"), F.col("__digest") == F.col("digest"), "left").select(*map(quoted, names))
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("found", "owners")]
    joined = joined.unionByName(rows.where("not __maybe").select(*map(quoted, names[:-2]), *none))

    def make():
        def run(texts, found, owners) -> list:
            n_words = np.zeros(len(texts), np.int64)
            for first, last, data, at in tk.chunks(texts):
                n_words[first:last] = np.bincount(tk.words(data, at, tk.ALNUM_TABLE)[3], minlength=last - first)
            hits = {r: [(x["begin"], x["length"]) for x in f] for r, f in enumerate(found.to_pylist()) if f}
            return _told(n_words, hits, {r: set(o) for r, o in enumerate(owners.to_pylist()) if o})

        return run

    return append(joined, make, FIELDS, ("__text", "found", "owners"), carried)


def _whole_kernel():
    """The fingerprint of a window of fewer than ``span`` words: all its words."""

    def run(texts) -> list:
        out = [np.zeros(0, np.int64)]
        for first, last, data, at in tk.chunks(texts):
            _, _, hashes, row = tk.words(data, at, tk.ALNUM_TABLE)
            cut = np.searchsorted(row, np.arange(last - first + 1))
            out.append(np.array([tk.mix(tk.grams(hashes[a:b], b - a) + np.uint64(b - a))[0] for a, b in zip(cut[:-1], cut[1:], strict=True)], np.uint64).view(np.int64))
        return [np.concatenate(out)]

    return run


FIELDS_ARROW = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (in words, end exclusive) and item_ids (sorted as strings).

    A window is ``span`` consecutive words of an item, or all words of an item that has fewer.
    Words inside any occurrence of a window are hit.  Null texts have no words; items with a null
    id or without words are left out; repeated items count once; an empty benchmark hits nothing;
    input columns named like a result are replaced.  Rows stay where they are: no shuffle, unless
    the benchmark has over ``block_bytes`` of text; then those that may have hits meet theirs.
    """
    items = benchmark.where(quoted(item_id).isNotNull()).select(quoted(item_id).cast("string").alias("i"), F.coalesce(quoted(item_text), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 64).alias("n")).first()["n"] or 0
    carried = [c for c in (docs.columns if keep is None else keep) if c not in FIELDS.names]
    if size > block_bytes:
        return _by_shuffle(docs, items, text, span, gram, carried)
    index = docs.sparkSession.sparkContext.broadcast(Index.build(sorted({(r["i"], r["t"]) for r in items.collect()}), span, gram))
    return append(docs, lambda: _kernel(index.value), FIELDS, (text,), carried)


def is_contaminated():
    """The contract's rule: some word is hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


SQL = r"""
WITH bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bwin AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
dwin AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM bwin) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dwin JOIN bwin USING (n, win)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
