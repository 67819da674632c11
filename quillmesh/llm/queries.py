"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_bpe, license_templates, line_templates, merkle, mixing, packing, prefix_trie, quality_rules, sharding, simhash, spotsigs, substring_dedup, token_counts
from .common import documents

SHARDS = 8
TOKEN_LIMIT, SEQUENCE_TOKENS, END_ID = 512, 4096, 1
MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED = (1, 2, 3), 3, "mix"


def tokenizer_path(name: str) -> str:
    import public_tokenizers  # vocabulary files, on every machine

    return public_tokenizers.path(name)


def op1_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).drop("spans")


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(documents(spark, sf_dir))


def op3_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_edits(documents(spark, sf_dir))


def op4_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), SEQUENCE_TOKENS, END_ID)


def op6_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link_documents(documents(spark, sf_dir))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_report(documents(spark, sf_dir))


def document_paths(docs: DataFrame) -> DataFrame:
    """(path, doc_id, text). A document that closes with a licence notice stands for a licence file: in English of its
    source's folder, else of its language's; the others lie in their source's folder for their language."""
    closing = F.lower(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), -1)).rlike(license_templates.LICENSE_WORDS)
    home = F.concat_ws("/", "source", "lang")
    name = F.concat(F.lit("LICENSE-"), "doc_id")
    path = F.when(closing & (F.col("lang") == "en"), F.concat_ws("/", "source", name)).when(closing, F.concat_ws("/", home, name))
    return docs.select(path.otherwise(F.concat_ws("/", home, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))).alias("path"), "doc_id", "text")


def op8_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.scan_licenses(document_paths(documents(spark, sf_dir)), ["doc_id"])


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), SHARDS)


def op10_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(documents(spark, sf_dir), MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED)
    rows = plan.withColumn("_each", F.explode(F.array_repeat(F.lit(1), F.col("n_rows").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_merkle_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(documents(spark, sf_dir))


def op13_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_block_anchors, op2_repetition_coverage, op3_spot_signatures, op4_two_tier_token_counts, op5_best_two_fit, op6_deletion_variants, op7_line_templates, op8_license_templates, op9_jump_sharding, op10_water_filling, op11_prefix_trie, op12_merkle_exchange, op13_chunk_bpe)}
