"""Training-data pipeline: ``documents`` through five stages, each written as Parquet and read again.

Stages keep the columns of ``documents``; the mix adds ``mix_position``, the place of a row in the mixed
order, and the last adds token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.llm import bpe_stream, divergence_rules, minhash_tensor, pfair_mix, quotient_dedup
from deskspark.sources.scratch import freeze

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# Target weights are row counts to this power: small sources count more than their share.
MIX_POWER = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return divergence_rules.passing(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quotient_dedup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_tensor.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pfair_mix.mix(docs, pfair_mix.tempered_weights(docs, MIX_POWER), position_col="mix_position")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe_stream.encode(docs, TOKENIZER)
    decoded = bpe_stream.decode(encoded, TOKENIZER)
    return decoded.withColumns(
        {
            "n_tokens": (F.octet_length("ids") / 4).cast("bigint"),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    ).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", encode_tokens),
]

# MinHash links, Pfair slots and merges are not expressible in SQL; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = freeze(stage(spark, docs, sf_dir))
    return docs
