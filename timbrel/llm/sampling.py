"""Bounded samples of labelled rows for fitting: rows and bytes are bounded before a text is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.sources.tables import forget, settle

#: Text bytes of a label's sample, at most; rows and bytes of all labels together, at most.
MAX_BYTES = 8 << 20
MAX_ROWS, TOTAL_BYTES = 12_000, 64 << 20


def draw_labelled(rows: DataFrame, per_label: int, max_bytes: int = MAX_BYTES, max_rows: int = MAX_ROWS, total_bytes: int = TOTAL_BYTES) -> list[tuple]:
    """(label, text) of at most ``per_label`` different rows (doc_id, text) of each label, in a fixed order.

    ``rows`` has the columns label, doc_id and text; null texts and labels are left out, repeated
    rows count once.  The draw goes by a hash of id and text, so rows of one id are drawn apart.
    Texts are taken whole, in draw order, as long as their sum stays within ``max_bytes`` a label;
    one that would pass it is passed over.  Where labels are many, each has an even part of
    ``max_rows`` and ``total_bytes``; of more labels than ``max_rows`` the most frequent are drawn from.  Only row keys are listed over all data.
    """
    spark = rows.sparkSession
    rows = rows.where("label is not null and text is not null").select("label", "doc_id", "text", F.xxhash64("text").alias("digest"))
    keys = settle(rows.select("label", "doc_id", "digest", F.octet_length("text").alias("size")).distinct())
    counts = settle(keys.groupBy("label").agg(F.count("*").alias("n")))
    n_labels = counts.count()
    if n_labels > max_rows:
        counts = settle(counts.orderBy(F.col("n").desc(), "label").limit(max_rows))
        n_labels = max_rows
    if not n_labels:
        return []
    per_label = max(1, min(per_label, max_rows // n_labels))
    max_bytes = min(max_bytes, total_bytes // n_labels)
    # four times the rows wanted pass on average, so fewer than wanted do with no chance worth naming
    share = F.least(F.lit(1.0), (4 * per_label + 50) / F.col("n")) * (1 << 30)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "digest"), F.lit(1 << 30))
    some = keys.join(counts, "label").withColumn("draw", draw).where(F.col("draw") < share).select("label", "doc_id", "digest", "size", "draw")
    listed = some.toArrow().to_pylist()  # some 4 * max_rows + 50 a label of them, without a text
    forget(keys)
    chosen, used = [], {}
    for r in sorted(listed, key=lambda r: (r["draw"], r["digest"], str(r["doc_id"]))):
        n, size = used.get(r["label"], (0, 0))
        if n < per_label and size + r["size"] <= max_bytes:
            used[r["label"]] = (n + 1, size + r["size"])
            chosen.append((r["label"], r["doc_id"], r["digest"]))
    kinds = T.StructType([T.StructField(n, rows.schema[n].dataType) for n in ("label", "doc_id", "digest")])
    wanted = spark.createDataFrame(chosen, kinds)
    match = rows["label"].eqNullSafe(wanted["label"]) & rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["digest"] == wanted["digest"])
    found = rows.join(F.broadcast(wanted), match, "left_semi").dropDuplicates(["label", "doc_id", "digest"]).collect()
    text = {(r["label"], r["doc_id"], r["digest"]): r["text"] for r in found}
    return [(k[0], text[k]) for k in chosen]
