"""Registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.llm import (
    arc_warc,
    bpe_stream,
    chat_windows,
    conversation_repair,
    divergence_rules,
    importance,
    interleave_shards,
    line_dedup,
    minhash_tensor,
    oracles,
    pfair_mix,
    quotient_dedup,
    suffix_dedup,
    token_alignment,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CONTROL_TEXT = "\\### Assistant: </turn> ok"
SHARDS = 40
MIX_POWER = 0.5

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = dict(oracles.ORACLES)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many documents as labels say are good, drawn by importance towards the good ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    targets = labels.where("quality = 1 AND toxic = 0").select("doc_id")
    good = labels.agg(F.avg("quality")).first()[0] or 0.0
    return importance.resample(docs, targets, round(docs.count() * good))


@query
def op2_quotient_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


@query
def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    turns = table(spark, sf_dir, "conversations").select(control.columns).unionByName(control)
    return chat_windows.conversation_digests(chat_windows.format_windows(turns))


@query
def op4_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe_stream.decode(bpe_stream.encode(docs, TOKENIZER).drop("text"), TOKENIZER)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = minhash_tensor.NearRule(words=3, percent=85)
    return minhash_tensor.near_duplicates(table(spark, sf_dir, "documents"), rule)


@query
def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


@query
def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    weights = pfair_mix.tempered_weights(docs, MIX_POWER)
    return pfair_mix.schedule(docs, weights).select(
        "doc_id", "_mix.source", "_mix.source_rank", "_mix.block", "_mix.release", "_mix.deadline", "_mix.slot", "_mix.position"
    )


@query
def op9_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave_shards.assign_shards(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op11_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query
def op12_ida_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))
    return repaired.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)
