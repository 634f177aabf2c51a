"""Language-model scores by stupid backoff over n-gram counts of the whole corpus but the scored text.

Texts are read once into blocks of bounded size: a block is one row that holds its documents' ids
and their words, coded by a local vocabulary of 64-bit word hashes.  Round n explodes each block's
n-grams, adds them up in the block, and sends them to count tables partitioned by n-gram hash,
which add up all blocks and join the totals back to each block's n-grams.  An n-gram that holds a
shorter one of total 1 occurs once itself, so it is neither sent nor answered.  With the totals at
hand each block takes every text's own n-grams off them and sums the scores of its documents: what only
the text itself has was not seen, and backs off.  What crosses the network is packed: sorted hashes
and counts of one block and partition to a row.  n-grams are told apart by their 64-bit hash alone.
The rows of a round grow with the square of the input; where they would hold next to nothing, the
same counts come from plain joins of exploded n-grams to their count tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.llm import textkit as tk
from timbrel.llm.rows import give_back, quoted
from timbrel.sources.tables import settle

ORDER = 3
MIN_COUNT = 1
ALPHA = 0.4
#: Text bytes of a block, n-grams of a table partition, about.
BLOCK_BYTES = 12 << 20
BYTES_OF_WORD = 6
TABLE_GRAMS = 2 << 20
#: Packed rows of a round, blocks times partitions, at most: with more, each would hold next to nothing.
MAX_MESSAGES = 1 << 32

SENT = "block long, n int, part long, hashes binary, counts binary"
ANSWERED = "block long, n int, part long, totals binary"


def _pack(values: np.ndarray) -> bytes:
    """Compressed integers; sorted hashes as differences, byte by byte."""
    wide = values.astype(np.uint64)
    planes = np.diff(wide, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T if len(wide) else np.zeros((8, 0), np.uint8)
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack_small(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_small(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def _coded(texts) -> tuple[np.ndarray, bytes, bytes]:
    """Words of each text, the distinct word hashes from the commonest on, and the words as places among these, packed."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for begin, _, data, at in tk.chunks(texts):
        _, _, h, row = tk.words(data, at, tk.SPACE_TABLE)
        hashes.append(h)
        rows.append(row + begin)
    words, row = np.concatenate(hashes), np.concatenate(rows)
    distinct, which, count = np.unique(words, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    planes = np.ascontiguousarray(place[which].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return np.bincount(row, minlength=len(texts)), distinct[order].astype("<u8").tobytes(), zstandard.compress(planes, 1)


def _blocks(block_bytes: int):
    """Kernel: rows (doc_id, text) to one row for about ``block_bytes`` of text, numbered by partition and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = made = 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            sizes, vocabulary, codes = _coded(table.column(1))
            ids = table.column(0).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(sizes, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), *lists, pa.array([vocabulary], pa.binary()), pa.array([codes], pa.binary())], names=["block", "doc_ids", "sizes", "vocabulary", "codes"])

        for batch in batches:
            at = tk.string_parts(batch.column(1))[1]
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(at, at[begin] + block_bytes - size, "right")) - 1)
                held.append(batch.slice(begin, end - begin))
                size += int(at[end] - at[begin])
                begin = end
                if size >= block_bytes or begin < batch.num_rows:
                    yield close()
                    held, size, made = [], 0, made + 1
        if held:
            yield close()
        held = []
        give_back()

    return run


class Block:
    """The n-grams of a block's texts by order, with the totals known so far."""

    def __init__(self, sizes, vocabulary: bytes, codes: bytes, parts: int, least: int):
        self.parts, self.least = parts, least
        planes = np.frombuffer(zstandard.decompress(codes), np.uint8).reshape(4, -1)
        place = np.ascontiguousarray(planes.T).view("<u4").ravel()
        self.words = np.frombuffer(vocabulary, "<u8")[place].astype(np.uint64)
        self.n_rows = len(sizes)
        self.row = np.repeat(np.arange(self.n_rows), sizes)
        #: by order: for each word, the total of the n-gram that ends there, 0 where it is under the least count or leaves its text
        self.total: dict[int, np.ndarray] = {}

    def _candidates(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Last words of the n-grams that may occur again, or reach the least count, and their hashes."""
        if n == 1:
            return np.arange(len(self.words)), self.words
        last = np.arange(n - 1, len(self.words))
        shorter, often = self.total[n - 1], max(2, self.least)
        ok = self._inside(n) & (shorter[last] >= often) & (shorter[last - 1] >= often)
        return last[ok], tk.grams(self.words, n)[ok]

    def _inside(self, n: int) -> np.ndarray:
        """Whether the n-gram that ends at each word from the n-th on lies in one text."""
        return self.row[: max(0, len(self.row) - n + 1)] == self.row[n - 1 :]

    def send(self, n: int):
        """(part, sorted distinct hashes, counts) of the order's n-grams."""
        _, gram = self._candidates(n)
        distinct, counts = np.unique(gram, return_counts=True)
        cut = np.searchsorted(distinct, self._bounds())
        for part, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                yield part, distinct[a:b], counts[a:b]

    def _bounds(self) -> list:
        step = (1 << 64) // self.parts
        return [np.uint64(i * step) for i in range(self.parts)] + [np.uint64((1 << 64) - 1)]

    def receive(self, n: int, answers: dict[int, np.ndarray]) -> None:
        """``answers``: totals by part, in the order sent."""
        last, gram = self._candidates(n)
        order = np.argsort(gram)
        gram = gram[order]
        head = np.ones(len(gram), bool)
        head[1:] = gram[1:] != gram[:-1]
        distinct = gram[head]
        totals = np.zeros(len(distinct), np.int64)
        cut = np.searchsorted(distinct, self._bounds())
        for part, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                if part not in answers or len(answers[part]) != b - a:
                    raise ValueError("totals do not belong to this block's texts")
                totals[a:b] = answers[part]
        self.total[n] = np.zeros(len(self.words), np.int64)
        if n > 1 and self.least <= 1:
            self.total[n][n - 1 :] = self._inside(n)  # what was not sent occurs once
        self.total[n][last[order]] = totals[np.cumsum(head) - 1]

    def others(self, n: int) -> np.ndarray:
        """For each word, how often other texts have the n-gram that ends there."""
        last = np.arange(n - 1, len(self.words))
        some = self.total[n][last] > 1  # an n-gram of total 1 is the text's own
        last = last[some]
        gram = (self.words if n == 1 else tk.grams(self.words, n))[some]
        own = tk.mix(gram + self.row[last].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, which, times = np.unique(own, return_inverse=True, return_counts=True)
        out = np.zeros(len(self.words), np.int64)
        out[last] = self.total[n][last] - times[which]
        return np.maximum(out, 0)  # totals under the least count are not known

    def scores(self, order: int, alpha: float) -> tuple[np.ndarray, ...]:
        """For each text the sum of log10 scores, with those of words alone not yet divided by the number of others' words, how many these are,
        how many words end an n-gram of the highest order that other texts have, and how many back off."""
        size, least = len(self.words), max(1, self.least)
        before = self.others(1)
        value = np.log10(np.maximum(before, 1)) + np.where(before > 0, 0.0, math.log10(alpha))
        alone, backs = np.ones(size, bool), before == 0
        seen = np.zeros(size, bool)
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], self.row[1:] != self.row[:-1]]), np.arange(size), 0)) if size else np.zeros(0, np.int64)
        depth = np.arange(size) - begin
        for n in range(2, order + 1):
            reach = depth >= n - 1
            now = self.others(n)
            found = reach & (now >= least)
            context = np.zeros(size, np.int64)
            context[1:] = before[:-1]
            better = np.log10(np.where(found, now, 1) / np.maximum(context, 1))
            value = np.where(found, better, np.where(reach, value + math.log10(alpha), value))
            alone &= ~found
            seen, backs, before = found, np.where(reach, ~found, backs), now
        if order == 1:
            seen = before >= least
        return tuple(np.bincount(self.row, weights=x, minlength=self.n_rows) if x is value else np.bincount(self.row[x], minlength=self.n_rows) for x in (value, alone, seen, backs))


def _load(rows: pa.Table, answers: pa.Table | None, parts: int, least: int, below: int) -> Block:
    row = rows.slice(0, 1).to_pylist()[0]
    block = Block(row["sizes"], row["vocabulary"], row["codes"], parts, least)
    found: dict[int, dict[int, np.ndarray]] = {n: {} for n in range(1, below)}
    if answers is not None:
        for n, part, raw in zip(answers.column("n").to_pylist(), answers.column("part").to_pylist(), answers.column("totals").to_pylist(), strict=True):
            found[n][part] = _unpack_small(raw)
    for n in range(1, below):
        block.receive(n, found[n])
    return block


def _sent(block: Block, key: int, n: int) -> pa.Table:
    rows = [(key, n, part, _pack(h), _pack_small(c)) for part, h, c in block.send(n)]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "n", "part", "hashes", "counts"])


def _add_up(least: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        hashes = [_unpack(x) for x in rows.column("hashes").to_pylist()]
        counts = [_unpack_small(x) for x in rows.column("counts").to_pylist()]
        every, by = np.concatenate(hashes), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        every, by = every[order], by[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        table, total = every[first], np.add.reduceat(by, first)
        if key[0].as_py() > 1:
            total = np.where(total >= least, total, 0)
        totals = [_pack_small(total[np.searchsorted(table, h)]) for h in hashes]
        return pa.Table.from_arrays([rows.column("block"), rows.column("n"), rows.column("part"), pa.array(totals, pa.binary())], names=["block", "n", "part", "totals"])

    return run


def _first_round(parts: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                yield from _sent(_load(row, None, parts, least, 1), row.column("block")[0].as_py(), 1).to_batches()
        give_back()

    return run


def _later_round(parts: int, least: int, n: int):
    def run(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        out = _sent(_load(rows, known, parts, least, n), key[0].as_py(), n)
        give_back()
        return out

    return run


def _word_lists(kind: T.DataType):
    """Kernel and schema: rows (doc_id, text) to (key, doc_id, words), a key for each row and the hashes of its words."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", kind), T.StructField("words", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin, end, data, at in tk.chunks(batch.column(1)):
                _, _, hashes, row = tk.words(data, at, tk.SPACE_TABLE)
                cut = pa.array(np.searchsorted(row, np.arange(end - begin + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(cut, pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + end - begin)), batch.column(0).slice(begin, end - begin), lists], names=schema.names)
                key += end - begin
        give_back()

    return run, schema


def score_relational(source: DataFrame, order: int, min_count: int, alpha: float) -> DataFrame:
    """As ``score_documents``, of (doc_id, text), by joins of exploded n-grams to their count tables: a row for each word, linear at any size."""
    kernel, schema = _word_lists(source.schema["doc_id"].dataType)
    listed = settle(source.mapInArrow(kernel, schema))
    i = F.col("i")
    gram = lambda last, n: F.when(last >= n, F.slice("words", F.greatest(last - n + 1, F.lit(1)), F.lit(n)))
    each = listed.where(F.size("words") > 0).select("key", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("i"))
    # an n-gram, and for each longer than a word what stands before its last word
    grams = [gram(i, n).alias(f"g{n}") for n in range(1, order + 1)] + [F.when(i >= n, gram(i - 1, n - 1)).alias(f"d{n}") for n in range(2, order + 1)]
    each = settle(each.select("key", "i", *grams))
    n_corpus = each.count() or 1
    tables = {n: settle(each.where(F.col(f"g{n}").isNotNull()).groupBy(F.col(f"g{n}").alias("gram")).agg(F.count("*").alias("n"))) for n in range(1, order + 1)}
    counted = each
    for name, n in [(f"g{n}", n) for n in range(1, order + 1)] + [(f"d{n}", n - 1) for n in range(2, order + 1)]:
        # counts are written first, so a common n-gram is a skewed join between two exchanges, which Spark splits
        table = tables[n].select(F.col("gram").alias("known"), F.col("n").alias(f"n_{name}"))
        counted = counted.join(table.hint("merge"), F.col(name) == F.col("known"), "left").drop("known")
    # what the text itself has is taken off
    for name, gram_of in [(f"g{n}", f"g{n}") for n in range(1, order + 1)] + [(f"d{n}", f"g{n - 1}") for n in range(2, order + 1)]:
        own = each.where(F.col(gram_of).isNotNull()).groupBy(F.col("key").alias("own_key"), F.col(gram_of).alias("own")).agg(F.count("*").alias("own_n"))
        counted = counted.join(own, (F.col("key") == F.col("own_key")) & (F.col(name) == F.col("own")), "left")
        counted = counted.withColumn(f"n_{name}", F.col(f"n_{name}") - F.coalesce("own_n", F.lit(0))).drop("own_key", "own", "own_n", name)
    counted = counted.join(listed.select(F.col("key").alias("of"), F.size("words").alias("size")), F.col("key") == F.col("of"))
    least = max(1, min_count)
    none = F.col("n_g1") <= 0
    value = F.log10(F.greatest(F.col("n_g1"), F.lit(1)) / F.greatest(F.lit(n_corpus) - F.col("size"), F.lit(1))) + F.when(none, math.log10(alpha)).otherwise(0.0)
    seen, backs = (F.col("n_g1") >= least if order == 1 else F.lit(False)), none
    for n in range(2, order + 1):
        reach = i >= n
        found = reach & (F.col(f"n_g{n}") >= least)
        value = F.when(found, F.log10(F.col(f"n_g{n}") / F.col(f"n_d{n}"))).when(reach, value + math.log10(alpha)).otherwise(value)
        seen, backs = found, F.when(reach, ~found).otherwise(backs)
    summed = counted.groupBy("key").agg(F.sum(value).alias("log10_score"), *[F.sum(F.coalesce(x, F.lit(False)).cast("long")).alias(name) for name, x in (("n_seen", seen), ("n_backed", backs))])
    scored = listed.select("key", "doc_id", F.size("words").cast("long").alias("n_words")).join(summed, "key", "left")
    return scored.select("doc_id", "n_words", F.coalesce("log10_score", F.lit(0.0)).alias("log10_score"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_seen", "n_backed")])


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES, table_grams: int = TABLE_GRAMS, most_messages: int = MAX_MESSAGES) -> DataFrame:
    """doc_id, n_words, log10_score (summed over the words), n_seen (words that end an n-gram of the highest order that others have ``min_count`` times), n_backed (words scored by less than their longest n-gram) and seen_share (n_seen of the words that end one) for each row.

    A word scores count(n-gram) / count(n-gram without it) for its longest n-gram that occurs
    ``min_count`` times, times ``alpha`` for each order it backs off; a word alone scores its share
    of all words, and one that occurs nowhere that of a word seen once, times ``alpha`` again.  Words are split
    at ASCII white space; n-grams stay within a text.  Counts are of all other rows: a row's own n-grams are taken off,
    those of its repeated rows and other copies are not.  Null, empty and blank texts score 0 with no words; extra
    columns are ignored; an empty table gives an empty one.  Where blocks and partitions would
    exchange more than ``most_messages`` rows a round, n-grams are joined one row each instead.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    source = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    packed = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("vocabulary", T.BinaryType()), T.StructField("codes", T.BinaryType())])
    n_bytes = source.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(n_bytes / BYTES_OF_WORD / table_grams))
    with_share = lambda df: df.withColumn("seen_share", F.col("n_seen") / F.greatest(F.col("n_words") - (order - 1), F.lit(1)))
    if parts * math.ceil(n_bytes / block_bytes) > most_messages:
        return with_share(score_relational(source, order, min_count, alpha))
    # blocks and answers are dealt once each, and all rounds read these exchanges; a lost one is dealt again alike
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = source.mapInArrow(_blocks(block_bytes), packed).repartition(partitions, "block")
    answers: DataFrame | None = None
    for n in range(1, order + 1):
        if answers is None:
            sent = blocks.mapInArrow(_first_round(parts, min_count), SENT)
        else:
            sent = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_later_round(parts, min_count, n), SENT)
        answer = sent.groupBy("n", "part").applyInArrow(_add_up(min_count), ANSWERED).repartition(partitions, "block")
        answers = answer if answers is None else answers.unionByName(answer)
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("part_score", T.DoubleType()), T.StructField("n_alone", T.LongType()), T.StructField("n_seen", T.LongType()), T.StructField("n_backed", T.LongType())])

    def last(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        block = _load(rows, known, parts, min_count, order + 1)
        size = np.bincount(block.row, minlength=block.n_rows)
        ids = rows.column("doc_ids").combine_chunks().flatten()
        score, *counts = block.scores(order, alpha)
        out = pa.Table.from_arrays([ids, pa.array(size, pa.int64()), pa.array(score, pa.float64()), *[pa.array(x, pa.int64()) for x in counts]], names=schema.names)
        give_back()
        return out

    scored = settle(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(last, schema))
    # words scored alone are counted against all words of others, whose number is known only now
    n_corpus = scored.agg(F.sum("n_words").alias("n")).first()["n"] or 1
    total = F.col("part_score") - F.col("n_alone") * F.log10(F.greatest(F.lit(n_corpus) - F.col("n_words"), F.lit(1)))
    return with_share(scored.select("doc_id", "n_words", total.alias("log10_score"), "n_seen", "n_backed"))


def query(spark, sf_dir: str) -> DataFrame:
    scored = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"), "n_seen", "n_backed", F.round("seen_share", 4).alias("seen_share"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT r, len(w) AS size, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS bc, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS abc,
         CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS ab
  FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0)),
-- of each n-gram: the rows' own counts, and what others have of it
o AS (SELECT r, g, count(*) AS own FROM (SELECT r, c AS g FROM p UNION ALL SELECT r, bc FROM p UNION ALL SELECT r, abc FROM p) WHERE g IS NOT NULL GROUP BY ALL),
n AS (SELECT r, g, sum(own) OVER (PARTITION BY g) - own AS n FROM o),
s AS (
  SELECT p.r, p.i, p.size, n1.n AS n1, n2.n AS n2, n3.n AS n3, h1.n AS h1, h2.n AS h2
  FROM p JOIN n n1 ON n1.r = p.r AND n1.g = p.c LEFT JOIN n n2 ON n2.r = p.r AND n2.g = p.bc LEFT JOIN n n3 ON n3.r = p.r AND n3.g = p.abc
         LEFT JOIN n h1 ON h1.r = p.r AND h1.g = p.b LEFT JOIN n h2 ON h2.r = p.r AND h2.g = p.ab),
v AS (
  SELECT r, coalesce(n3 > 0, false) AS seen, CASE WHEN i > 2 THEN n3 = 0 WHEN i = 2 THEN n2 = 0 ELSE n1 = 0 END AS backed,
    CASE WHEN n3 > 0 THEN log10(n3::DOUBLE / h2) WHEN n2 > 0 THEN log10(n2::DOUBLE / h1) + CASE WHEN i > 2 THEN log10(0.4::DOUBLE) ELSE 0 END
         ELSE log10(greatest(n1, 1)::DOUBLE / greatest((SELECT count(*) FROM p) - size, 1)) + log10(0.4::DOUBLE) * (least(i - 1, 2) + CASE WHEN n1 = 0 THEN 1 ELSE 0 END) END AS v
  FROM s)
SELECT any_value(d.doc_id) AS doc_id, CAST(any_value(len(d.w)) AS BIGINT) AS n_words, round(coalesce(sum(v.v), 0), 4) + 0.0 AS log10_score, CAST(count(*) FILTER (WHERE v.seen) AS BIGINT) AS n_seen,
       CAST(count(*) FILTER (WHERE v.backed) AS BIGINT) AS n_backed, round(count(*) FILTER (WHERE v.seen) / greatest(any_value(len(d.w)) - 2, 1), 4) AS seen_share
FROM d LEFT JOIN v USING (r) GROUP BY r
"""
