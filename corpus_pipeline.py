"""The corpus pipeline: five stages over documents, each calling one operator of `weft.llm`.

Quality, near-duplicates, repeated passages, personal data, packing. Every stage but the last returns
the columns of `documents`; where a stage changes texts, `n_chars` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import _common, packing, pii, quality, queries, simhash, suffix_dedup


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of op9 doesn't reject."""
    model = quality.learn(docs, _common.table(spark, sf_dir, "labels"), ~queries.held_out())
    return quality.score(docs, model, name="__score").where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of 5-word shingles of 0.8 or more): the one with the smallest id.

    Rows without an id are kept; repeated rows of a kept id are one document and stay as they are.
    """
    found = simhash.similar(docs, words_each=5, similarity=0.8).where("component <> row_id").select(F.col("row_id").alias("__gone")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__gone"), "left_anti")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages cut out of the texts."""
    done = suffix_dedup.cut(docs)
    return _with_lengths(done.drop("spans"), F.size("spans") > 0, done)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by surrogates."""
    done = pii.replace(docs, queries.PII_KEY)
    return _with_lengths(done.drop("n_entities"), F.col("n_entities") > 0, done)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 ids."""
    packed = packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"), end_id=0)
    return packed.select(F.col("row_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _with_lengths(out: DataFrame, changed: F.Column, done: DataFrame) -> DataFrame:
    """`done` in the columns of `out`, with n_chars of the changed texts."""
    if "n_chars" not in out.columns:
        return out
    n = F.when(changed, F.length("text").cast(out.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n).select(*out.columns)


STAGES = [("quality classifier", keep_good), ("SimHash near-dedup", keep_one), ("suffix-array dedup", cut_passages), ("PII", replace_private), ("best-fit packing", pack)]

#: No SQL expresses the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are a table that the next one reads."""
    docs = _common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _common.stash(docs, "stage")
    return docs
