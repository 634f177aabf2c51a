"""Target-distribution importance resampling: documents drawn by how much likelier their words are in a target corpus.

Features are word n-grams hashed into a fixed number of buckets.  Both corpora are counted bucket by
bucket; the gains of all buckets are one array of fixed size, which every task indexes to score whole
documents.  A document's score is the floored mean gain of its features plus Gumbel noise that its
id decides, an integer, so the largest scores are a draw without replacement.  Scores have a
bounded range, so an exact histogram is small at any size: suffix sums over it tell how many
documents lie above each score, and where the draw ends.  Ranks are these offsets plus a row number
within each score that survives; nothing is sorted as a whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.llm import textkit as tk
from timbrel.llm.rows import append, give_back, quoted
from timbrel.sources.tables import settle

BUCKETS = 10_000
#: Words of a feature, least words of a document that may be drawn, share drawn in hundredths, and the seed of the noise.
WORDS, MIN_WORDS, PERCENT, SEED = 1, 20, 10, 2024
#: Longer words are summed one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC_TABLE = _crc_table()


def span_crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each byte span, a byte position of all spans at a time."""
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    size = end - start
    order = np.argsort(-size, kind="stable")
    sizes = -size[order]  # ascending: the spans with a byte at j are a prefix
    for j in range(min(LONG, int(-sizes[0])) if len(sizes) else 0):
        some = order[: np.searchsorted(sizes, -j, "left")]
        out[some] = CRC_TABLE[(out[some] ^ data[start[some] + j]) & 0xFF] ^ out[some] >> np.uint32(8)
    out = ~out
    for i in order[: np.searchsorted(sizes, -LONG, "left")]:
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def buckets(data: np.ndarray, at: np.ndarray, size: int = WORDS, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, and row and bucket of each run of ``size`` of its words, joined by one space (A-Z lowered)."""
    start, end, _, row = tk.words(data, at, tk.ALNUM_TABLE)
    n_words = np.bincount(row, minlength=len(at) - 1)
    upper = (data >= 65) & (data <= 90)
    folded = data + upper.astype(np.uint8) * np.uint8(32)
    if size == 1:
        return n_words, row, span_crc32(folded, start, end) % n
    # words side by side, one space after each: a run of them is one span
    length = end - start + 1
    place = np.concatenate([[0], np.cumsum(length)])
    joined = np.full(int(place[-1]), 32, np.uint8)
    if len(start):
        offset = np.arange(len(joined)) - np.repeat(place[:-1], length)
        inside = offset < np.repeat(length - 1, length)
        joined[inside] = folded[(np.repeat(start, length) + offset)[inside]]
    m = max(0, len(start) - size + 1)
    whole = np.flatnonzero(row[:m] == row[size - 1 : size - 1 + m]) if m else np.zeros(0, np.int64)
    return n_words, row[whole], span_crc32(joined, place[whole], place[whole + size] - 1) % n


def _counted(size: int, n: int):
    def run(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            for _, _, data, at in tk.chunks(batch.column(0)):
                total += np.bincount(buckets(data, at, size, n)[2], minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])
        give_back()

    return run


def bucket_counts(docs: DataFrame, text: str = "text", size: int = WORDS, n: int = BUCKETS) -> DataFrame:
    """(bucket, n) features of all texts, buckets without any left out; a task sends one row a bucket."""
    return docs.select(quoted(text)).mapInArrow(_counted(size, n), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, size: int = WORDS, n: int = BUCKETS) -> np.ndarray:
    """Each bucket's floored 1000-fold log ratio of smoothed shares, target over docs: ``n`` integers, whatever the size of the corpora."""
    counts = []
    for corpus in (docs, target):
        count = np.zeros(n, np.int64)
        for r in bucket_counts(corpus, size=size, n=n).collect():  # n rows at most
            count[r["bucket"]] = r["n"]
        counts.append(count)
    s, t = (c.astype(np.float64) for c in counts)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _scored(gain: np.ndarray, size: int):
    def run(texts) -> list:
        words, features, weights = [], [], []
        for _, _, data, at in tk.chunks(texts):
            n_words, row, bucket = buckets(data, at, size, len(gain))
            each = np.bincount(row, minlength=len(at) - 1)
            total = np.zeros(len(at) - 1, np.int64)
            np.add.at(total, row, gain[bucket])
            words.append(n_words)
            features.append(each)
            weights.append(np.where(each > 0, total // np.maximum(each, 1), 0))
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, features, weights)]

    return run


SCORED = T.StructType([T.StructField(name, T.LongType()) for name in ("n_words", "n_features", "weight")])


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of the seed and the id (null: empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """``scored`` (a settled table with doc_id, n_features, weight, score) with rank: 1, 2, 3 ... by score, the largest first.

    Of the N ``eligible`` rows floor(percent * N / 100) are drawn; ties go to the smaller doc_id (null last), then to
    more features and the larger weight; other rows have no rank.  The histogram has one row a score, and scores lie
    within some 100,000 integers, whatever the number of rows.
    """
    counts = settle(scored.where(eligible).groupBy("score").agg(F.count("*").alias("size")))
    wanted = (counts.agg(F.sum("size")).first()[0] or 0) * percent // 100
    above = F.coalesce(F.sum("size").over(W.orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    surviving = settle(counts.select(F.col("score").alias("survivor"), above.alias("above")).where(F.col("above") < wanted))
    cutoff = surviving.agg(F.min("survivor")).first()[0]
    # scores survive from the cutoff up, so other rows need no look-up
    stays = F.coalesce(eligible, F.lit(False)) & (F.col("score") >= cutoff) if cutoff is not None else F.lit(False)
    order = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), F.col("n_features").desc(), F.col("weight").desc())
    rank = F.col("above") + F.row_number().over(order)
    met = scored.where(stays).join(surviving, F.col("score") == F.col("survivor"))
    ranked = met.withColumn("rank", F.when(rank <= wanted, rank)).select(*[quoted(c) for c in scored.columns], "rank")
    return ranked.unionByName(scored.where(~stays).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, size: int = WORDS, n: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) for each row of ``docs``, resampled towards ``target``.

    Words are runs of ASCII letters, digits and other than ASCII characters, A-Z lowered.  Null, empty and blank
    texts have no features and weight 0; texts are scored whole; documents of under ``min_words`` words are never
    drawn.  Repeated rows are drawn side by side; a null id is hashed as an empty one and comes last among ties.
    Extra columns are ignored; an empty target or table gives gains and draws all the same.
    """
    gain = gains(docs, target, size, n)
    plain = docs.select(quoted("doc_id").alias("doc_id"), quoted("text").alias("text"))
    scored = append(plain, lambda: _scored(gain, size), SCORED, ("text",), ["doc_id"]).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw(settle(scored), F.col("n_words") >= min_words, percent).drop("n_words")


def query(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _words(table: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({table}.text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("documents")} AS w FROM documents),
x AS (SELECT r, unnest(w) AS word FROM d), y AS (SELECT unnest({_words("benchmark")}) AS word FROM benchmark),
v AS (SELECT word, {tk.crc32_sql("word")} % {BUCKETS} AS bucket FROM (SELECT word FROM x UNION SELECT word FROM y)),
s AS (SELECT bucket, count(*) AS n FROM x JOIN v USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM y JOIN v USING (word) GROUP BY bucket),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + {BUCKETS})::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM x JOIN v USING (word) JOIN g USING (bucket) GROUP BY r),
z AS (SELECT d.r, doc_id, coalesce(m.n, 0) AS n_features, coalesce(m.weight, 0) AS weight,
        coalesce(m.weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features DESC, weight DESC) AS rank FROM z WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM o) * {PERCENT} // 100 THEN rank END AS rank FROM z LEFT JOIN o USING (r)
"""
