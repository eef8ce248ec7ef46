"""The queries of this subpackage's operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import ann, binary, bpe, embedding_dedup, packing, pii, quality, simhash, suffix_dedup, url_filters
from weft.llm._common import table

#: Rules of op8: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The key of op3's surrogates; a secret where it matters.
PII_KEY = "surrogates of the public corpus"
#: The end id of op5's documents.
END_ID = 2


def vocabulary(name: str) -> str:
    """The contents of a public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=0)
    return packed.select(F.col("row_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("row_id").alias("doc_id"), simhash.hexed().alias("fingerprint"), F.col("component").alias("component_id"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_entities")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.cut(docs).select("doc_id", "text", F.size("spans").alias("n_spans"), F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_cut"))


def op5_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = binary.write_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), END_ID)
    return binary.read_documents(shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("row_id") % 20 == 0, k=20)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return found.select(F.col("row_id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("row_id").eqNullSafe(F.col("component")).alias("kept"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filters.RULE_SCHEMA)
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), rules, "allow", keep=["page_id"])


def held_out(doc_id: str = "row_id") -> F.Column:
    """Rows that never teach op9 and the pipeline's classifier."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model | quality.Constant:
    return quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality_model(spark, sf_dir))
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True).withColumnRenamed("row_id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_simhash": op2_simhash,
        "op3_pii": op3_pii,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_binary": op5_binary,
        "op6_ann": op6_ann,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_url_filters": op8_url_filters,
        "op9_quality": op9_quality,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return {
        "op8_url_filters": rf"""
with parts as (
  select page_id, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end, '') as rest from pages),
cut as (
  select page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
rules(rule_host, rule_path, verdict) as (values {rules}),
hits as (
  select c.page_id, r.rule_host || r.rule_path as rule, r.verdict,
         row_number() over (partition by c.page_id order by length(r.rule_host || r.rule_path) desc, r.rule_host || r.rule_path) as k
  from cut c join rules r on (c.host = r.rule_host or ends_with(c.host, '.' || r.rule_host)) and starts_with(c.path, r.rule_path))
select c.page_id, c.host, c.path, h.rule, coalesce(h.verdict, 'allow') as verdict
from cut c left join (select * from hits where k = 1) h on c.page_id = h.page_id""",
    }
