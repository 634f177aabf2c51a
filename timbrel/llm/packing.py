"""Best-two-fit packing of tokenised documents into fixed-size sequences.

Each bin is filled greedily with the largest unpacked piece that fits; then its smallest piece is
replaced by the two unpacked pieces that fill the gap it leaves most tightly, if any two fill it
better than it does.  Pieces are dealt by hash into groups of bounded size that are packed apart;
a group wastes at most its last few bins.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.llm.rows import quoted
from timbrel.sources.tables import settle

CAPACITY = 2048
END_ID = 0
#: Pieces packed together, about.
GROUP = 60_000
#: Distinct text fragments whose ids a task keeps.
CACHE = 400_000

#: Fixed values of the public vocabulary: its only special token, and the last byte that starts a
#: two-byte character below U+0700, up to which both tokenizer libraries class characters alike.
SPECIAL = "<|endoftext|>"
PLAIN_LEAD = 0xDB


class _Irregular(Exception):
    pass


class Encoder:
    """Ids of whole texts as little-endian bytes, equal to those of the vocabulary's ``tokenizers`` file.

    In this vocabulary's splitting rule a space before a non-space always starts a new token, so
    the ids of a text are those of its space-led fragments in a row; these recur and are kept.
    Texts with runs of white space go through the fast encoder whole, and those with the special
    token's string or characters from U+0700 on through the ``tokenizers`` file itself.
    """

    def __init__(self, path: str | None = None):
        import base64
        import os

        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path or public_tokenizers.path("byte_bpe_50k.json")
        ranks_path = self.path.removesuffix(".json") + ".tiktoken"
        self.exact = None
        self.fast = None
        if os.path.exists(ranks_path):
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = self.fast.encode_ordinary if self.fast else None

        class Cache(dict):
            def __missing__(self, part: str) -> bytes:
                if not part or part[0].isspace():
                    raise _Irregular
                if len(self) >= CACHE:
                    self.clear()
                ids = np.array(encode(" " + part), "<u4").tobytes()
                self[part] = ids
                return ids

        self.cache = Cache()

    def _by_file(self, text: str) -> bytes:
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.fast is None or SPECIAL in text:
            return self._by_file(text)
        if not text.isascii() and np.frombuffer(text.encode(), np.uint8).max() > PLAIN_LEAD:
            return self._by_file(text)
        head, *parts = text.split(" ")
        try:
            rest = b"".join(map(self.cache.__getitem__, parts))
        except _Irregular:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        if not head:
            return rest
        return np.array(self.fast.encode_ordinary(head), "<u4").tobytes() + rest


_encoders: dict[str | None, Encoder] = {}


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for each piece of each document row.

    A document is its text's ids and END_ID; null is the empty text.  Only those over ``capacity``
    are cut, into full pieces after a first one that holds what is over.  ``tokenizer`` is the
    path of the vocabulary file on every machine (default: the installed public one).
    """
    kind = docs.schema[doc_id].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encode = _encoders[tokenizer]
        for batch in batches:
            of, number, start, length, check, ids = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                raw = encode(value.as_py() or "") + end
                total = len(raw) // 4
                first = total % capacity or min(total, capacity)
                cuts = [0, *range(first, total + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    of.append(row)
                    number.append(i)
                    start.append(a)
                    length.append(b - a)
                    check.append(zlib.crc32(raw[4 * a : 4 * b]))
                    if with_ids:
                        ids.append(np.frombuffer(raw, "<i4")[a:b])
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(quoted(doc_id), quoted(text)).mapInArrow(run, T.StructType(fields))


class _Pool:
    """Unpacked pieces by length, with the lengths present as bits of one number, forward and reversed."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity = capacity
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.have = self.back = 0
        for i, n in enumerate(lengths.tolist()):
            self.put(i, n)

    def put(self, i: int, n: int) -> None:
        if not self.stacks[n]:
            self.have |= 1 << n
            self.back |= 1 << (self.capacity - n)
        self.stacks[n].append(i)

    def take(self, n: int) -> int:
        i = self.stacks[n].pop()
        if not self.stacks[n]:
            self.have &= ~(1 << n)
            self.back &= ~(1 << (self.capacity - n))
        return i

    def largest(self, most: int) -> int:
        """Length of the largest piece of at most ``most``, 0 if none."""
        return max(0, (self.have & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths that sum to ``total`` exactly."""
        both = self.have & (self.back >> (self.capacity - total))
        while both:
            a = both.bit_length() - 1
            if 2 * a != total or len(self.stacks[a]) > 1:
                return a, total - a
            both &= ~(1 << a)
        return None


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece."""
    pool = _Pool(lengths, capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while pool.have:
        content: list[tuple[int, int]] = []
        gap = capacity
        while gap and (n := pool.largest(gap)):
            content.append((n, pool.take(n)))
            gap -= n
        if gap and len(content) > 1 and pool.have:
            smallest, i = content[-1]
            for total in range(gap + smallest, smallest, -1):
                if found := pool.pair(total):
                    content[-1:] = [(n, pool.take(n)) for n in found]
                    pool.put(i, smallest)
                    break
        at = 0
        for n, i in content:
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(table: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``table`` (doc_id, piece, length and more, e.g. from ``pieces``) with sequence_id and offset.

    Rows are packed as they are: a repeated row is packed as often as it occurs, extra columns are
    carried, an empty table gives an empty one.  A piece is 1 to ``capacity`` long.  The table is
    written once, for its size sets the number of groups; a group holds about ``group`` rows
    whatever the input, so no task grows with it.
    """
    table = settle(table.drop("sequence_id", "offset"))
    groups = max(1, math.ceil(table.count() / group))
    # the row's place in the written table parts rows that are equal; it is the same when a lost task is run again
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "piece", "start", "length", F.monotonically_increasing_id()), F.lit(groups))
    schema = T.StructType([*table.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["group"])
        bins, offsets = best_two_fit(rows.column("length").to_numpy(), capacity)
        rows = rows.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32)))
        return rows.append_column("offset", pa.array(offsets))

    return table.withColumn("group", spread).groupBy("group").applyInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
