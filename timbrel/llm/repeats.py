"""Removal of long repeated byte strings with a run-length index.

Which places can repeat each other is found by sampling: of every ``length`` bytes the minimum
hash of the ``anchor``-grams inside (leftmost on ties) is their anchor, so two occurrences of a
string of ``length`` bytes have their anchor at the same place.  An anchor's context is the strings
of ``length`` bytes that it is the anchor of, and each such string is in one context.  Contexts
that occur twice are repeats as they are.  Different contexts of one anchor go together, some groups at a time, into an index: suffix
order, run-compressed Burrows-Wheeler transform, and match lengths sampled at the ends of its
runs, from which the match lengths at all other places follow by counting down (a place inside a
run matches one less than the place before).  Places that match ``length`` bytes elsewhere start a
repeated string.  Groups over ``group`` contexts are dealt into several indexes; what an index
leaves open is settled by hashes of the single strings, so every group has an exact answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.llm import textkit as tk
from timbrel.llm.rows import append, give_back, quoted
from timbrel.sources.tables import forget, settle

LENGTH = 400
ANCHOR = 128
#: Contexts of one anchor that go into one index; bytes of contexts and anchors in one index, about.
GROUP = 4096
BLOCK_BYTES = 1 << 20
BLOCK_GROUPS = 1000
#: Strings left open are first matched by the bytes that this many neighbouring ones share.
CELL = 34


def anchors(data: np.ndarray, at: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Row, anchor hash, context hash, the anchor's place in its context, context start and end (in the row) of each anchor."""
    n = len(data) - anchor + 1
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty, empty
    prefix = tk.prefix_hash(data)
    place = np.arange(n)
    gram = tk.span_hash(prefix, place, place + anchor)
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    least = tk.window_min((gram & ~low) | place.astype(np.uint64), length - anchor + 1)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    begin = np.flatnonzero(np.arange(len(least)) + length <= at[row + 1])
    if not len(begin):
        return empty, empty, empty, empty, empty, empty
    mark = (least[begin] & low).astype(np.int64)
    new = np.ones(len(begin), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (row[begin][1:] != row[begin][:-1])
    first = np.flatnonzero(new)
    p, lo, hi = mark[first], begin[first], begin[np.append(first[1:], len(begin)) - 1] + length
    r = row[lo]
    return r, gram[p].view(np.int64), tk.span_hash(prefix, lo, hi).view(np.int64), p - lo, lo - at[r], hi - at[r]


def suffix_order(text: np.ndarray, group: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes, each up to its own ``end``, by group and then by content, ties by position.

    Prefix doubling that sorts again only what is still tied.
    """
    n = len(text)
    place = np.arange(n)
    key = group.astype(np.int64)
    for j in range(6):
        ahead = np.minimum(place + j, n - 1)
        key = key * 512 + np.where(place + j < end, text[ahead].astype(np.int64) + 1, 0)
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    done, longest = 6, int((end - place).max()) if n else 0
    while done < longest:
        tail = np.ones(n, bool)
        tail[:-1] = head[1:]
        tied = np.flatnonzero(~(head & tail))
        if not len(tied):
            break
        suffix = order[tied]
        ahead = suffix + done
        second = np.where(ahead < end[suffix], rank[np.minimum(ahead, n - 1)] + 1, 0)
        code = rank[suffix] * (n + 1) + second
        by = np.argsort(code, kind="stable")
        order[tied] = suffix = suffix[by]
        code = code[by]
        head[tied[1:]] |= code[1:] != code[:-1]
        rank[suffix] = np.maximum.accumulate(np.where(head, place, 0))[tied]
        done *= 2
    return order


class RunLengthIndex:
    """Run-compressed transform of grouped texts, with places and match lengths sampled at the ends of its runs.

    What is kept grows with the number of runs, not with the texts: for each run its start, its
    character (0 before a text's first), and two samples.
    """

    def __init__(self, texts: list[bytes], group: np.ndarray, least: int):
        lengths = np.array([len(t) for t in texts])
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)])
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        owner = np.repeat(np.arange(len(texts)), lengths + 1)
        end = self.first[:-1][owner] + lengths[owner]
        self.n = n = len(raw)
        order = suffix_order(raw, group[owner], end)
        before = np.where(order > self.first[:-1][owner[order]], raw[order - 1].astype(np.int16) + 1, 0)
        split = np.ones(n, bool)  # a run ends where the character before changes; text starts are runs of their own
        split[1:] = (before[1:] != before[:-1]) | (before[1:] == 0) | (group[owner[order]][1:] != group[owner[order]][:-1])
        self.run_start = np.flatnonzero(split)
        self.run_char = before[self.run_start]
        # samples: at a run's first suffix the match with the suffix above, at its last that with the one below
        heads, tails = order[self.run_start], order[np.append(self.run_start[1:], n) - 1]
        upper, lower = tails[:-1], heads[1:]
        both = group[owner[upper]] == group[owner[lower]]
        size = np.zeros(len(upper), np.int64)
        size[both] = self._match(raw, end, upper[both], lower[both], least)
        self.above = self._by_place(heads, np.concatenate([[0], size]))
        self.below = self._by_place(tails, np.concatenate([size, [0]]))

    @staticmethod
    def _by_place(place: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(place, kind="stable")
        return place[order], match[order]

    def transform(self) -> np.ndarray:
        """The whole transform, spelled out from its runs."""
        return np.repeat(self.run_char, np.diff(np.append(self.run_start, self.n)))

    @staticmethod
    def _match(raw: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
        """Common prefix lengths, 0 where under ``least``."""
        out = np.zeros(len(a), np.int64)
        most = np.minimum(end[a] - a, end[b] - b)
        where = np.flatnonzero(most >= least)
        # the last bytes of the least length differ first in most pairs
        for t in (least - 1, least // 2, 0, least // 4, 3 * least // 4):
            where = where[raw[a[where] + t] == raw[b[where] + t]]
        for part in np.array_split(where, max(1, len(where) * int(most.max(initial=1)) // 4_000_000)):
            if len(part):
                reach = np.arange(int(most[part].max()))
                differ = raw[np.minimum(a[part][:, None] + reach, len(raw) - 1)] != raw[np.minimum(b[part][:, None] + reach, len(raw) - 1)]
                differ |= reach >= most[part][:, None]
                found = np.where(differ.any(axis=1), differ.argmax(axis=1), most[part])
                out[part] = np.where(found >= least, found, 0)
        return out

    def matching_statistics(self, begin: int, end: int) -> np.ndarray:
        """Longest match of each place from begin to end elsewhere in its group (at least where it reaches the least length), streamed from the samples."""
        place = np.arange(begin, end)
        out = np.zeros(end - begin, np.int64)
        for at, match in (self.above, self.below):
            # a place inside a run matches one less than the place before it; the first place of a text is a sample
            last = np.searchsorted(at, place, "right") - 1
            out = np.maximum(out, match[last] - (place - at[last]))
        return out


def repeated_starts(texts: list[bytes], group: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, whether the ``length`` bytes from each place occur elsewhere in its group."""
    index = RunLengthIndex(texts, group, length)
    return [index.matching_statistics(a, a + max(0, len(t) - length + 1)) >= length for a, t in zip(index.first, texts, strict=False)]


ANCHORS = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("h", "c", "p", "lo", "hi")])


def _anchor_kernel(length: int, anchor: int):
    def run(texts) -> list:
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        counts = []
        for begin, end, data, at in tk.chunks(texts, 1 << 19):
            row, *columns = anchors(data, at, length, anchor)
            counts.append(np.bincount(row, minlength=end - begin))
            for part, column in zip(parts, columns, strict=True):
                part.append(column)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32) if counts else np.zeros(1, np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), pa.int64())) for p in parts]

    return run


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, x, text, wanted) to (h, tile, open, doc_id, x, p, lo, context)."""
    for batch in batches:
        rows, h, tile, open_, p, lo, context = [], [], [], [], [], [], []
        size = 0
        for i, (text, wanted) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            raw = text.as_py().encode()
            for w in wanted.as_py():
                rows.append(i)
                h.append(w["h"])
                tile.append(w["tile"])
                open_.append(w["open"])
                p.append(w["p"])
                lo.append(w["lo"])
                context.append(raw[w["lo"] : w["hi"]])
                size += len(context[-1])
            if size > 1 << 23 or (rows and i == batch.num_rows - 1):
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(tile, pa.int64()), pa.array(open_, pa.bool_()), batch.column(0).take(at), batch.column(1).take(at), pa.array(p, pa.int64()), pa.array(lo, pa.int64()), pa.array(context, pa.binary())], names=["h", "tile", "open", "doc_id", "x", "p", "lo", "context"])
                rows, h, tile, open_, p, lo, context = [], [], [], [], [], [], []
                size = 0


def _index_kernel(length: int, anchor: int, cell: int):
    """Rows (h, tile, open, doc_id, x, p, lo, context) sorted by h and tile: repeated stretches, and strings left open."""
    names = ["doc_id", "x", "start", "end", "core", "strings"]

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        h, tile = table.column("h").to_numpy(), table.column("tile").to_numpy()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (tile[1:] != tile[:-1])
        group = np.cumsum(new) - 1
        texts = table.column("context").to_pylist()
        lo, place, open_ = table.column("lo").to_numpy(), table.column("p").to_numpy(), table.column("open").to_numpy(zero_copy_only=False)
        rows, start, end, core, strings = [], [], [], [], []
        told: dict[int, set[int]] = {}
        for i, repeated in enumerate(repeated_starts(texts, group, length)):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                rows.append(i)
                start.append(int(lo[i] + a))
                end.append(int(lo[i] + b - 1 + length))
                core.append(None)
                strings.append(None)
            if open_[i]:
                data = np.frombuffer(texts[i], np.uint8)
                prefix = tk.prefix_hash(data)
                value = tk.span_hash(prefix, np.arange(len(repeated)), np.arange(len(repeated)) + length).view(np.int64)
                # strings found here may be the match of strings left open elsewhere: one place of each goes along
                known = told.setdefault(int(group[i]), set())
                fresh = np.array([bool(r) and int(v) not in known for r, v in zip(repeated, value, strict=True)])
                known.update(value[fresh].tolist())
                left = np.flatnonzero(~repeated | fresh)
                origin = int(place[i]) - (length - anchor)
                for c in np.unique((left - origin) // cell).tolist():
                    some = left[(left - origin) // cell == c]
                    # all strings that start in a cell, counted from the anchor, share these bytes
                    head = origin + c * cell
                    shared = tk.span_hash(prefix, np.array([head + cell - 1]), np.array([head + length]))
                    rows.append(i)
                    start.append(int(lo[i]))
                    end.append(None)
                    core.append(int(tk.mix(shared ^ tk.mix(np.array([h[i]]).view(np.uint64) + np.uint64(c))).view(np.int64)[0]))
                    strings.append([{"at": int(lo[i] + s), "hash": int(v)} for s, v in zip(some, value[some], strict=True)])
        if rows:
            at = pa.array(rows, pa.int64())
            kinds = pa.list_(pa.struct([("at", pa.int64()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(at), table.column("x").combine_chunks().take(at), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(core, pa.int64()), pa.array(strings, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = groups = 0
        last: tuple | None = None
        for batch in batches:
            h, tile = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(h):
                continue
            weight = np.diff(batch.column(7).buffers()[1] and np.frombuffer(batch.column(7).buffers()[1], np.int32)[batch.column(7).offset : batch.column(7).offset + len(h) + 1])
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (tile[1:] != tile[:-1])
            new[0] = (int(h[0]), int(tile[0])) != last
            begin = 0
            for i in np.flatnonzero(new):
                added = int(weight[begin:i].sum())
                size += added
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                    begin = int(i)
                if held and (size >= BLOCK_BYTES or groups >= BLOCK_GROUPS):
                    yield from solve(held)
                    held, size, groups = [], 0, 0
                groups += 1
            held.append(batch.slice(begin))
            size += int(weight[begin:].sum())
            last = (int(h[-1]), int(tile[-1]))
        if held:
            yield from solve(held)
        held = []
        give_back()

    return run


REMOVED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])


def _remove_kernel(give_kept: bool):
    def run(texts, spans) -> list:
        out: list[list] = [[], [], [], [], []]
        for text, found in zip(texts, spans, strict=True):
            raw = (text.as_py() or "").encode()
            runs: list[list[int]] = []
            for a, b in sorted((s["start"], s["end"]) for s in found.as_py() or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            edges = [0, *(x for r in runs for x in r), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            for column, value in zip(out, (len(raw), len(raw) - len(kept), len(runs), kept if give_kept else None, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
        return out

    return run


def different_rows(rows: DataFrame) -> DataFrame:
    """One row of each (doc_id, x): repeated rows would be cut once each, and meet in one index.

    Keys are counted first; where none recurs the rows stay where they are.
    """
    if not rows.groupBy("doc_id", "x").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return rows
    return rows.dropDuplicates(["doc_id", "x"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, cell: int = CELL, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) for each row.

    Each byte goes that lies in a string of ``length`` UTF-8 bytes which also starts elsewhere, in
    any row or the same one.  Null texts are empty; texts under ``length`` stay whole; repeated
    rows and other copies of ``length`` bytes or more go whole, for all their contexts recur; extra
    columns are ignored; an empty table gives an empty one.  Texts cross the network twice by id, never by content, so
    copies do not meet in one task.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text")).withColumn("x", F.xxhash64("text"))
    long_ones = source.where(F.octet_length("text") >= length)

    listed = append(long_ones, lambda: _anchor_kernel(length, anchor), ANCHORS, ("text",), ["doc_id", "x"])
    found = settle(listed.select("doc_id", "x", F.explode(F.arrays_zip("h", "c", "p", "lo", "hi")).alias("a")).select("doc_id", "x", "a.*"))
    every = settle(found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "x", "p", "lo", "hi")).alias("first")))
    # written down, so that a common anchor's contexts are a skewed join between two exchanges, which Spark splits
    anchor_size = settle(every.groupBy("h").agg(F.count("*").alias("n_contexts"), F.sum("n").alias("n_all")).where("n_all > 1").drop("n_all"))
    context = settle(every.join(anchor_size.hint("merge"), "h").select("h", "c", "n", "first", "n_contexts"))
    forget(every)
    again = context.where(F.col("n") > 1).select("h", "c")
    whole = settle(found.join(again, ["h", "c"]).select("doc_id", "x", F.col("lo").alias("start"), F.col("hi").alias("end")))
    forget(found)

    # different contexts of one anchor are indexed together
    mixed = context.where(F.col("n_contexts") > 1)
    tiles = F.ceil(F.col("n_contexts") / group)
    wanted = mixed.select("first.*", "h", F.pmod(F.xxhash64("c"), tiles).cast("long").alias("tile"), (tiles > 1).alias("open"))
    wanted = wanted.groupBy("doc_id", "x").agg(F.collect_list(F.struct("h", "tile", "open", "p", "lo", "hi")).alias("wanted"))
    kind = source.schema["doc_id"].dataType
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["x"] == b["x"])
    different = different_rows(long_ones)
    once = different.join(wanted, same(different, wanted)).select(different["doc_id"], different["x"], "text", "wanted")
    contexts = once.mapInArrow(_extract, T.StructType([T.StructField("h", T.LongType()), T.StructField("tile", T.LongType()), T.StructField("open", T.BooleanType()), T.StructField("doc_id", kind), T.StructField("x", T.LongType()), T.StructField("p", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("context", T.BinaryType())]))
    solved_schema = T.StructType([T.StructField("doc_id", kind), T.StructField("x", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("core", T.LongType()), T.StructField("strings", T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("hash", T.LongType())])))])
    solved = settle(contexts.repartition(partitions, "h", "tile").sortWithinPartitions("h", "tile").mapInArrow(_index_kernel(length, anchor, cell), solved_schema))
    spans = solved.where("end is not null").select("doc_id", "x", "start", "end").unionByName(whole)
    open_ = solved.where("core is not null").select("doc_id", "x", "core", "strings")
    if open_.limit(1).count():  # anchors of several indexes: single strings decide, where what they share recurs
        cores = open_.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
        strings = open_.join(cores, "core").select("doc_id", "x", "core", F.explode("strings").alias("s")).select("doc_id", "x", "core", "s.*")
        twice = strings.groupBy("core", "hash").agg(F.min(F.struct("doc_id", "x", "at")).alias("a"), F.max(F.struct("doc_id", "x", "at")).alias("b")).where("a <> b").select("core", "hash")
        spans = spans.unionByName(strings.join(twice, ["core", "hash"]).select("doc_id", "x", F.col("at").alias("start"), (F.col("at") + length).alias("end")))

    by_row = spans.groupBy("doc_id", "x").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = source.join(by_row, same(source, by_row), "left").select(source["doc_id"], "text", "spans")
    out = append(joined, lambda: _remove_kernel(keep_bytes), REMOVED, ("text", "spans"), ["doc_id"])
    return out if keep_bytes else out.drop("kept")


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
