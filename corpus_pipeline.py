"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives what it kept with the columns of ``documents``;
the last gives packed pieces.  ``run`` writes each stage's rows to the shared folder and reads
them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.llm import decontamination, jaccard, languages, packing, secrets
from timbrel.llm.rows import may_be, quoted
from timbrel.sources.tables import forget, settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those in no known language (foreign by their 3-grams); where no language is known, only the former can be told."""
    model = languages.fit_languages(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = {c: f"__own_{c}" for c in docs.columns if c in ("lang_pred", "score", "ambiguous", "foreign")}
    found = languages.foreign(docs.withColumnsRenamed(own), model).where((F.col("lang_pred") != languages.UNKNOWN) & ~F.col("foreign"))
    return found.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each class, by id and text, null ids last.

    Of rows equal in id and text the one that comes first with all its columns spelled out stays.  Only rows that a
    filter of one size cannot rule out meet the list of rows to drop; all others stay where they are.
    """
    classes = settle(jaccard.jaccard_classes(docs))
    others = settle(classes.where(~F.col("leads")).select(F.col("doc_id").alias("other"), F.col("digest").alias("other_text")).distinct())
    twice = settle(classes.where("leads and n_copies > 1").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("own"), F.col("digest").alias("own_text")))
    marked = may_be(docs.withColumn("__digest", jaccard.digest_of()), "__digest", others, "other_text")
    # one plan at every size: the list of rows to drop grows with the corpus, so it is never broadcast
    left = marked.where("__maybe").join(others.hint("merge"), (F.col("__digest") == F.col("other_text")) & F.col("doc_id").eqNullSafe(F.col("other")), "left_anti")
    kept = left.unionByName(marked.where("not __maybe")).drop("__maybe")
    if twice.limit(1).count():
        marked = may_be(kept, "__digest", twice, "own_text")
        same = (F.col("__digest") == F.col("own_text")) & F.col("doc_id").eqNullSafe(F.col("own"))
        some = marked.where("__maybe").join(twice.hint("merge"), same, "left").withColumn("__twice", F.col("own_text").isNotNull()).drop("own", "own_text")
        whole = F.struct(*[quoted(c) for c in docs.columns])
        one = some.where("__twice").groupBy("doc_id", "__digest").agg(F.min_by(whole, F.to_json(whole, {"ignoreNullFields": "false"})).alias("row")).select("row.*")
        kept = marked.where("not __maybe").select(*[quoted(c) for c in docs.columns]).unionByName(some.where("not __twice").select(*[quoted(c) for c in docs.columns])).unionByName(one)
    return kept.select(*[quoted(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated with passages of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_contamination(docs, benchmark)
    return found.where(~decontamination.is_contaminated()).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with a mark in place of each secret."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in full sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Trained classifiers, hashing and tokenisation are beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        forget(before)  # only tables that a stage wrote
    return STAGES[-1][1](spark, docs, sf_dir)
