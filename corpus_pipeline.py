"""Corpus pipeline: quality, near-duplicates, personal data, mixing, encoding.

Every stage is a function (spark, docs, sf_dir) -> DataFrame on all that its
predecessor kept. All but the last return the columns of ``documents``; each
result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm import bpe, gam, minhash, mixing, pii
from linkwright.llm.common import prepare, split_pattern, staged, table, take_columns, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below the threshold."""
    model = gam.fit(docs, table(spark, sf_dir, "labels"))
    return gam.score(take_columns(docs, COLUMNS), model, "__score").where(
        F.col("__score") >= gam.THRESHOLD).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, as one row per text.

    Of rows with equal doc_id and text the one with the smallest other columns stays.
    A row without doc_id is a document of its own, numbered after all ids in the
    order of text hashes, so it stays only if no document with an id is like it.
    Rows whose text has no words are never duplicates.
    """
    docs = take_columns(docs, COLUMNS)
    words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    keyed = docs.withColumn("_h", F.when(words, F.sha2("text", 256)))
    many = staged(keyed.where("_h is not null").groupBy("doc_id", "_h").count().where("count > 1").select(
        F.col("doc_id").alias("_d"), F.col("_h").alias("_t")), "dedup-repeats")
    loose = staged(keyed.where("doc_id is null and _h is not null").select("_h").distinct().orderBy("_h").select(
        F.col("_h").alias("_t"), F.monotonically_increasing_id().alias("_n")), "dedup-loose")
    one, any_loose = keyed, not loose.isEmpty()
    if not many.isEmpty():
        same = keyed["doc_id"].eqNullSafe(many["_d"]) & (keyed["_h"] == many["_t"])
        rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
        repeated = keyed.join(many, same, "left_semi").groupBy("doc_id", "_h").agg(
            F.min(F.struct(*rest)).alias("_r"), F.first("text").alias("text"))
        one = keyed.join(many, same, "left_anti").unionByName(
            repeated.select("doc_id", "text", "_h", *[F.col("_r")[c].alias(c) for c in rest]))
    one = one.withColumn("_id", F.col("doc_id").cast("long"))
    if any_loose:
        top = docs.agg(F.max(F.col("doc_id").cast("long")).alias("m")).first()["m"]
        bare = F.col("doc_id").isNull() & F.col("_h").isNotNull()
        numbered = one.where(bare).join(loose, F.col("_h") == F.col("_t")).withColumn(
            "_id", F.col("_n") + F.lit(max(-1 if top is None else top, -1) + 1))
        one = one.where(~bare).unionByName(numbered.select(*one.columns))
    if any_loose or not many.isEmpty():
        one = staged(one, "dedup-rows")
    gone = minhash.near_duplicates(one.select(F.col("_id").alias("doc_id"), "text")).where("not kept").select(
        F.col("doc_id").alias("_id"))
    return one.join(gone, "_id", "left_anti").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the new text."""
    return pii.pseudonymize(take_columns(docs, COLUMNS), pii.session_key(spark)).withColumn(
        "n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix does: not at all, once or twice."""
    docs = take_columns(docs, COLUMNS)
    return mixing.mixed_documents(docs, mixing.mix(docs)).select(*COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids, decoded again; digests per document."""
    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern()
    return bpe.round_trip(docs, path, pattern, keep=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", dedup_stage),
    ("personal data", pii_stage),
    ("source mixing", mixing_stage),
    ("byte-level encoding", encode_stage),
]

#: trained models, sketches and keyed surrogates have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
