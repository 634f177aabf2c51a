"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Each distinct text gets one label of ``DEPTH`` MinHash values for each of ``TREES`` tries; in the
order of labels, the texts under one node of a trie, those that share a prefix, lie together.  Every
text starts with its whole labels and shortens them step by step, in the trie where a step adds the
most recall for the fewest further texts, until a pair at the threshold is missed with a chance of
at most ``1 - recall``.  So prefixes that many unlike texts share stay long.  A text meets all texts under
the nodes it has stopped at; of nodes within one another the widest is looked at.  Texts under one node
are compared by their signatures, and what may be similar is tied together.  Within each tied set
the shingle sets themselves (sets of 64-bit hashes of the shingles) are compared, all pairs of a set,
in tiles.

Nodes of many texts are dealt into tiles of about ``run`` texts.  In a tile of such a node a text that is nearly a copy of an earlier one (a leader) is compared with
no further texts.  The looser thresholds for ties that go with this keep every pair at the
threshold tied, by the triangle inequality of Jaccard distance.  Exact copies are one text
throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.llm import textkit as tk
from timbrel.operators.components import components
from timbrel.llm.rows import append, give_back, quoted
from timbrel.sources.tables import forget, settle

THRESHOLD = 0.8
SHINGLE = 5
TREES = 24
DEPTH = 8
RECALL = 0.9999
#: Bits of a value of a label after its shortest prefix.
TAIL_BITS = 21
#: Texts under a node that one task compares, and texts and shingles of a tile for exact comparison, about.
RUN = 2048
TILE_TEXTS = 512
TILE_SHINGLES = 1 << 20


def prefix_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest depth at which a pair at the threshold meets in some trie with the target recall: none is shortened further."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word shingle, rows ascending; a text of fewer words is one shingle, one without words none."""
    _, _, hashes, row = tk.words(data, at, tk.SPACE_TABLE)
    each = np.bincount(row, minlength=len(at) - 1)
    gram = tk.grams(hashes, size)
    whole = row[: len(gram)] == row[size - 1 :] if len(gram) else np.zeros(0, bool)
    rows, found = [row[: len(gram)][whole]], [gram[whole]]
    for short in range(1, size):
        first = np.flatnonzero(each[row] == short)[::short]
        if len(first):
            rows.append(row[first])
            found.append(tk.grams(hashes, short)[first])
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(rows, kind="stable")
    return rows[order], found[order]


_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def signatures(row: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """(n, TREES * DEPTH) MinHash values; rows without shingles are all ones."""
    out = np.full((n, TREES * DEPTH), np.iinfo(np.uint64).max, np.uint64)
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for k in range(TREES * DEPTH):
            out[row[first], k] = np.minimum.reduceat(shingle * _MULTIPLY[k] + _ADD[k], first)
    return out


def _sign(depth: int, size: int):
    """Kernel: shingles, the label's shortest prefix and its rest for each trie, and the signature.

    The rest has TAIL_BITS bits a value, first value first: its order is that of labels, and
    shifting it shortens them.
    """

    def run(texts) -> list:
        counts, keys, tails, short = [], [], [], []
        for begin, end, data, at in tk.chunks(texts, 1 << 19):
            n = end - begin
            row, shingle = shingles(data, at, size)
            signature = signatures(row, shingle, n)
            labels = signature.reshape(n, TREES, DEPTH)
            key = np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((n, 1), np.uint64)
            for d in range(depth):
                key = tk.mix(key * np.uint64(0x100000001B3) + labels[:, :, d])
            tail = np.zeros((n, TREES), np.uint64)
            for d in range(depth, min(DEPTH, depth + 3)):
                tail = (tail << np.uint64(TAIL_BITS)) | (tk.mix(labels[:, :, d]) >> np.uint64(64 - TAIL_BITS))
            counts.append(np.bincount(row, minlength=n))
            keys.append(key.view(np.int64))
            tails.append(tail.view(np.int64))
            low = tk.mix(signature).astype(np.uint8)
            short += [r.tobytes() for r in low]
        lists = []
        for values in (keys, tails):
            flat = np.concatenate(values).ravel() if values else np.zeros(0, np.int64)
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TREES, dtype=np.int32)), pa.array(flat)))
        return [np.concatenate(counts) if counts else np.zeros(0, np.int64), *lists, pa.array(short, pa.binary())]

    return run


SIGNED = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("tails", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())])
EDGES = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("key", T.LongType()), T.StructField("tile", T.LongType()), T.StructField("signature", T.BinaryType())])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple[tuple, pa.Table]]]:
    """The parts of each run of equal key columns as they come: (key, rows), a run's parts one after the other."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(n, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        yield [(tuple(c[a] for c in columns), batch.slice(a, b - a)) for a, b in zip(first, [*first[1:], n], strict=True)]


def _same_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each of a to each of b, from one byte a value."""
    out = np.empty((len(a), len(b)))
    for i in range(len(a)):
        out[i] = (b == a[i]).mean(axis=1)
    return np.maximum(0, (out - 1 / 256) / (1 - 1 / 256))


class _Ties:
    """Union-find over the texts of a run."""

    def __init__(self):
        self.above: list[int] = []

    def add(self, n: int) -> None:
        self.above += range(len(self.above), len(self.above) + n)

    def root(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = self.above[i]
        return i

    def tie(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.above[max(i, j)] = min(i, j)


def _compare(tie_at: float, retire_at: float | None, keep_leaders: bool):
    """Kernel over rows (key, tile, digest, signature, hot) sorted by key and tile: ties, and leaders where ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: dict = {}

        def close() -> list[tuple]:
            if not state:
                return []
            names, ties = state["names"], state["ties"]
            out = [(names[ties.root(i)], name, None, None, None) for i, name in enumerate(names) if ties.root(i) != i]
            if keep_leaders and state["hot"]:
                out += [(names[i], None, int(now[0]), int(now[1]), s.tobytes()) for i, s in zip(state["leaders"], state["signs"], strict=True)]
            return out

        def grow(rows: pa.RecordBatch) -> None:
            base = len(state["names"])
            names = rows.column(2).to_pylist()
            signs = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8).reshape(len(names), -1)
            state["names"] += names
            state["ties"].add(len(names))
            for start in range(0, len(names), 256):
                fresh = signs[start : start + 256]
                open_ = np.ones(len(fresh), bool)
                if state["leaders"]:
                    old = np.stack(state["signs"])
                    share = _same_share(fresh, old)
                    for i, j in zip(*np.nonzero(share >= tie_at), strict=True):
                        state["ties"].tie(state["leaders"][j], base + start + int(i))
                    if retire_at is not None:
                        open_ &= share.max(axis=1) < retire_at
                for i in range(len(fresh)):
                    if not open_[i]:
                        continue
                    later = np.flatnonzero(np.arange(len(fresh)) != i)
                    share = _same_share(fresh[i : i + 1], fresh[later])[0]
                    for j in later[share >= tie_at]:
                        state["ties"].tie(base + start + i, base + start + int(j))
                    if retire_at is not None:
                        gone = later[share >= retire_at]
                        open_[gone[gone > i]] = False
                    state["leaders"].append(base + start + i)
                    state["signs"].append(fresh[i])

        for parts in _runs(batches, 2):
            made: list[tuple] = []
            for key, rows in parts:
                if key != now:
                    made += close()
                    now = key
                    state = {"names": [], "ties": _Ties(), "leaders": [], "signs": [], "hot": bool(rows.column(4)[0].as_py())}
                grow(rows)
            if made:
                yield _edges(made)
        if made := close():
            yield _edges(made)
        state.clear()
        give_back()

    return run


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=EDGES.names)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted hash sets: common elements as a matrix product, rare ones by pairs."""
    m = len(sets)
    out = np.zeros((m, m))
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    times = np.diff(np.append(first, len(values)))
    for f in np.unique(times[(times > 1) & (times <= max(2, m // 16))]):
        groups = owner[first[times == f][:, None] + np.arange(f)]
        for part in np.array_split(groups, max(1, len(groups) * f * f // 2_000_000)):
            code = part[:, :, None] * m + part[:, None, :]
            out += np.bincount(code.ravel(), minlength=m * m).reshape(m, m)
    common = np.flatnonzero(times > max(2, m // 16))
    for begin in range(0, len(common), 4096):
        some = common[begin : begin + 4096]
        dense = np.zeros((m, len(some)), np.float32)
        place = np.repeat(np.arange(len(some)), times[some])
        dense[owner[np.concatenate([np.arange(first[c], first[c] + times[c]) for c in some])], place] = 1
        out += dense @ dense.T
    return out


def _verify(threshold: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        names, tile = rows.column("digest").to_pylist(), rows.column("own").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets], float)
        both = intersections(sets)
        union = size[:, None] + size[None, :] - both
        link = both >= threshold * union - 1e-9
        np.fill_diagonal(link, False)
        lo, hi = key[1].as_py(), key[2].as_py()
        if lo != hi:
            link &= tile[:, None] != tile[None, :]
        root = np.arange(len(sets))
        while True:
            least = np.minimum(root, np.where(link, root[None, :], len(sets)).min(axis=1))
            least = least[least]
            if (least == root).all():
                break
            root = least
        out = pa.table({"digest": pa.array(names, pa.binary()), "links": pa.array(link.sum(axis=1), pa.int64()), "root": pa.array([names[r] for r in root], pa.binary())})
        if len(sets) > 256:
            give_back()
        return out

    return run


def _shingle_sets(size: int):
    def run(texts) -> list:
        out = []
        for begin, end, data, at in tk.chunks(texts):
            row, shingle = shingles(data, at, size)
            cut = np.searchsorted(row, np.arange(end - begin + 1))
            out += [np.unique(shingle[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return [pa.array(out, pa.binary())]

    return run


def digest_of(text: str = "text"):
    return F.unhex(F.md5(F.coalesce(quoted(text), F.lit(""))))


def stops(sizes: np.ndarray, there: np.ndarray, depth: int, threshold: float, recall: float) -> np.ndarray:
    """Values beyond the first ``depth`` that each text keeps in each trie: (texts, tries).

    ``sizes`` (texts, tries, levels) has the texts under the node of each length, shortest first; in tries where a
    text is not ``there`` it is alone however short its label, and the label is shortest.
    """
    levels = sizes.shape[2] - 1
    miss = np.log1p(-(threshold ** np.arange(depth, depth + levels + 1, dtype=float)))
    gain = np.append(0.0, np.diff(miss))  # of a step down from each length
    keep = np.where(there, levels, 0)
    total = miss[keep].sum(axis=1)
    at = np.arange(len(keep))
    while True:
        open_ = at[total > math.log(1 - recall)]
        open_ = open_[keep[open_].any(axis=1)]
        if not len(open_):
            return keep
        now = keep[open_]
        more = np.take_along_axis(sizes[open_], np.maximum(now - 1, 0)[:, :, None], 2) - np.take_along_axis(sizes[open_], now[:, :, None], 2)
        worth = np.where(now > 0, gain[now] / (more[:, :, 0] + 0.5), -1.0)
        trie = worth.argmax(axis=1)
        total[open_] -= gain[now[np.arange(len(now)), trie]]
        keep[open_, trie] -= 1


STOPPED = T.StructType([T.StructField("key", T.LongType()), T.StructField("tail", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("stop", T.IntegerType())])


def _stopped(depth: int, levels: int, threshold: float, recall: float):
    """Kernel over (digest, tries: list of (key, tail, n0, n1, ...)): a row for each trie, with the values beyond ``depth`` that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            count = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            flat = lists.flatten()
            sizes, there = np.zeros((len(count), TREES, levels + 1)), np.zeros((len(count), TREES), bool)
            there[row, place] = True
            for j in range(levels + 1):
                sizes[row, place, j] = flat.field(2 + j).to_numpy()
            keep = stops(sizes, there, depth, threshold, recall)[row, place]
            yield pa.RecordBatch.from_arrays([flat.field(0), flat.field(1), batch.column(0).take(pa.array(row)), pa.array(keep, pa.int32())], names=STOPPED.names)

    return run


def stopped(labels: DataFrame, depth: int, threshold: float, recall: float) -> DataFrame:
    """(key, tail, digest, stop), settled: how many values beyond ``depth`` each text keeps in each trie where it is not alone under its shortest prefix, from rows (key, tail, digest) of distinct texts."""
    levels = min(DEPTH, depth + 3) - depth
    prefix = lambda j: F.shiftrightunsigned("tail", TAIL_BITS * (levels - j))
    # counts are written down before they meet the labels, so that a crowded node is a skewed join between two exchanges, which Spark splits
    counted = settle(labels.groupBy("key").agg(F.count("*").alias("n0")).where("n0 > 1"))
    members = settle(labels.join(counted.hint("merge"), "key"))
    leaves = members.groupBy("key", "tail").agg(F.first("n0").alias("n0"), F.count("*").alias("texts"))
    for j in range(1, levels + 1):
        node = leaves.groupBy("key", prefix(j).alias("prefix")).agg(F.sum("texts").alias(f"n{j}"))
        leaves = leaves.withColumn("prefix", prefix(j)).join(node, ["key", "prefix"]).drop("prefix")
    leaves = settle(leaves.drop("texts"))
    sizes = [f"n{j}" for j in range(levels + 1)]
    each = members.select("key", "tail", "digest").join(leaves.hint("merge"), ["key", "tail"]).groupBy("digest").agg(F.collect_list(F.struct("key", "tail", *sizes)).alias("tries"))
    out = settle(each.mapInArrow(_stopped(depth, levels, threshold, recall), STOPPED))
    for table in (counted, members, leaves):
        forget(table)
    return out


def forest(labels: DataFrame, run: int, depth: int, threshold: float, recall: float) -> DataFrame:
    """Nodes and the texts to compare under them: (node, tile, digest, tiles), from rows (key, tail, digest) of distinct texts.

    tiles is over 1 for nodes that hold more than ``run`` texts.
    """
    levels = min(DEPTH, depth + 3) - depth
    prefix = lambda j: F.shiftrightunsigned("tail", TAIL_BITS * (levels - j))
    told = stopped(labels, depth, threshold, recall)
    # a leaf lies under the widest node that any text under that node has stopped at
    leaves = told.groupBy("key", "tail").agg(F.min("stop").alias("least"))
    widest = F.lit(levels)
    for j in range(levels):
        node = leaves.groupBy("key", prefix(j).alias("prefix")).agg((F.min("least") <= j).alias(f"at{j}"))
        leaves = leaves.withColumn("prefix", prefix(j)).join(node, ["key", "prefix"]).drop("prefix")
    for j in range(levels - 1, -1, -1):
        widest = F.when(F.col(f"at{j}"), j).otherwise(widest)
    cut = F.element_at(F.array(*[prefix(j) for j in range(levels + 1)]), widest + 1)
    leaves = settle(leaves.select("key", "tail", F.xxhash64("key", widest, cut).alias("node")))
    placed = settle(told.select("key", "tail", "digest").join(leaves.hint("merge"), ["key", "tail"]).select("node", "digest"))
    counted = settle(placed.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.ceil(F.col("n") / run).cast("long").alias("tiles")))
    out = settle(placed.join(counted.hint("merge"), "node").select("node", F.pmod(F.xxhash64("digest"), F.col("tiles")).alias("tile"), "digest", "tiles"))
    for table in (told, leaves, placed, counted):
        forget(table)
    return out


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, run: int = RUN, tile_texts: int = TILE_TEXTS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, digest, leads for each row of ``docs``.

    Texts are linked if their sets of ``shingle`` consecutive words (split at ASCII white space)
    have a Jaccard similarity of ``threshold`` or more; a class is what links and copies connect,
    named by its smallest doc_id.  n_links counts the other texts linked to a row's text, n_copies
    the rows of the same text.  leads tells the rows whose text and doc_id a class keeps if it keeps
    one: the smallest doc_id, of its texts that of the smallest digest; null ids come after all
    others.  Texts of fewer words are one shingle.  Null, empty and blank texts
    are linked to nothing, each row a class of its own.  Repeated rows are copies; extra columns
    are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    source = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    depth = prefix_depth(threshold, recall)
    signed = settle(append(source.withColumn("digest", digest_of()), lambda: _sign(depth, shingle), SIGNED, ("text",), ["doc_id", "digest"]))
    worded = signed.where("n_shingles > 0")

    # texts under one node of a trie
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = settle(worded.select("digest", "keys", "tails", "signature").dropDuplicates(["digest"]))
    labels = distinct.select("digest", F.explode(F.arrays_zip("keys", "tails")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.tails").alias("tail"), "digest")
    met = forest(labels, run, depth, threshold, recall)
    dealt = met.join(distinct.select("digest", "signature"), "digest").select("node", "tile", "digest", "signature", (F.col("tiles") > 1).alias("hot"))
    tied = settle(dealt.repartition(partitions, "node", "tile").sortWithinPartitions("node", "tile").mapInArrow(_compare(threshold - 0.3, 1 - (1 - threshold) * 0.4, True), EDGES))
    edges = tied.where("b is not null").select("a", "b")
    leaders = tied.where("b is null").select("key", "tile", F.col("a").alias("digest"), "signature")
    if leaders.limit(1).count():  # nodes of several tiles: each two tiles' leaders meet
        n_tiles = met.where("tiles > 1").select(F.col("node").alias("key"), "tiles").distinct()
        pairs = leaders.join(n_tiles, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        pairs = pairs.withColumn("pair", F.least("tile", "other") * F.lit(1 << 31) + F.greatest("tile", "other")).select("key", F.col("pair").alias("tile"), "digest", "signature", F.lit(False).alias("hot"))
        cross = pairs.repartition(partitions, "key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_compare(max(0.1, threshold - 0.46), None, False), EDGES)
        edges = edges.unionByName(cross.select("a", "b"))
    sets = components(edges)
    for table in (met, distinct, tied):
        forget(table)

    # exact comparison within each tied set, by tiles
    counted = settle(worded.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")))
    ones = counted.join(sets.select(F.col("node").alias("digest"), "root"), "digest").select(F.col("digest").alias("own"), "root", F.col("least").alias("one"))
    texts = source.withColumn("digest", digest_of()).join(ones, (F.col("digest") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("one"))).select("digest", "root", "text")
    spelled = append(texts, lambda: _shingle_sets(shingle), T.StructType([T.StructField("shingles", T.BinaryType())]), ("text",), ["digest", "root"]).dropDuplicates(["digest"])
    spelled = settle(spelled)
    volume = settle(spelled.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / tile_texts), F.ceil(F.sum(F.octet_length("shingles")) / (8 * tile_shingles))).cast("int").alias("tiles")))
    tiles = spelled.join(volume.hint("merge"), "root").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = tiles.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "digest", "shingles")
    # dealt by tile: what lies with its set already would be compared in one task, set by set
    tiles = tiles.repartition(partitions, "root", "lo", "hi")
    found = settle(tiles.groupBy("root", "lo", "hi").applyInArrow(_verify(threshold), "digest binary, links long, root binary"))
    forget(spelled)
    links = found.groupBy("digest").agg(F.sum("links").alias("n_links"))
    classes = components(found.where("digest <> root").select(F.col("root").alias("a"), F.col("digest").alias("b")))

    # copies are counted by text, then texts by class
    by_text = settle(counted.join(classes.withColumnRenamed("node", "digest"), "digest", "left").join(links, "digest", "left").withColumn("root", F.coalesce("root", "digest")))
    named = settle(by_text.groupBy("root").agg(F.min("least").alias("class_id"), F.min(F.struct(F.col("least").isNull().alias("none"), "least", "digest"))["digest"].alias("leader")))
    # counts are written down before they are joined, so that many texts of one class, or copies of one text, are skewed joins between two exchanges, which Spark splits
    of_text = settle(by_text.join(named.hint("merge"), "root").select("digest", "class_id", (F.col("digest") == F.col("leader")).alias("leader"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"))
    leads = (F.col("leader") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("leads")
    rows = worded.select("doc_id", "digest").join(of_text.hint("merge"), "digest").select("doc_id", "class_id", "n_links", "n_copies", "digest", leads)
    blank = signed.where("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), "digest", F.lit(True).alias("leads"))
    return rows.unionByName(blank)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("digest", "leads")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT text, min(doc_id) AS rep, count(*) AS n_copies, any_value(w) AS w FROM d WHERE len(w) > 0 GROUP BY text),
s AS (SELECT DISTINCT rep, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT rep, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i FROM t)),
z AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z za ON za.rep = a JOIN z zb ON zb.rep = b WHERE 5 * k >= 4 * (za.n + zb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS x, rep AS y FROM t UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x AS rep, min(y) AS class_id FROM r GROUP BY x),
n AS (SELECT a AS rep, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(n.n_links, 0) AS n_links, coalesce(t.n_copies, 1) AS n_copies
FROM d LEFT JOIN t ON t.text = d.text LEFT JOIN c ON c.rep = t.rep LEFT JOIN n ON n.rep = t.rep
"""
