"""Scans and sinks."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from deskspark.functions.text import as_id
from deskspark.operators.grouped import dedupe

MESSAGE_COLUMNS = ["tweet_id", "author_id", "created_at", "text", "in_response_to_tweet_id"]

# Names under which producers ship the same golden field, preferred first.
GOLDEN_ALIASES = {
    "text": ["customer_msg", "text"],
    "true_intent": ["true_intent", "primary_intent", "intent"],
    "true_action": ["true_escalate", "ideal_action"],
}
GOLDEN_DEFAULTS = {"text": "", "true_intent": "order_status_delivery", "true_action": "auto_handle"}


def read_messages(spark: SparkSession, path: str | Sequence[str], multiline: bool = True) -> DataFrame:
    """Message log CSV as (tweet_id, author_id, created_at, text, in_response_to_tweet_id).

    Quoted texts may hold line breaks. A multi-line file cannot be split, so
    parallelism comes from the number of files; pass ``multiline=False`` for
    logs without line breaks to let Spark split each file. Columns are matched
    by the header, other columns are ignored, unparseable ids become NULL. The
    reply pointer stays as written: a bad one is no reply, but not a first
    contact either.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
    )
    paths = [path] if isinstance(path, str) else list(path)
    header = reader.csv(paths).columns
    missing = set(MESSAGE_COLUMNS) - set(header)
    if missing:
        raise ValueError(f"message log lacks columns: {sorted(missing)}")
    schema = StructType([StructField(name, StringType()) for name in header])
    raw = reader.schema(schema).csv(paths)
    return raw.select(
        as_id(F.col("tweet_id")).alias("tweet_id"),
        "author_id",
        "created_at",
        "text",
        "in_response_to_tweet_id",
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of ``<name>.parquet`` tables."""
    return read_table(spark, os.path.join(folder, f"{name}.parquet"))


def write_tables(threads: DataFrame, messages: DataFrame, folder: str) -> tuple[str, str]:
    """Write the two derived tables; mentions are joined with commas only here."""
    threads_path, messages_path = f"{folder}/threads.parquet", f"{folder}/customer_messages.parquet"
    if dict(threads.dtypes).get("removed_mentions", "").startswith("array"):
        threads = threads.withColumn("removed_mentions", F.array_join("removed_mentions", ","))
    threads.write.mode("overwrite").parquet(threads_path)
    messages.write.mode("overwrite").parquet(messages_path)
    return threads_path, messages_path


def resolve(df: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    """First non-null of the columns that exist; the default stands in only when none of them does, so that
    an empty cell stays NULL instead of becoming a label."""
    found: list[Column] = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(default).cast("string")


def golden_columns(df: DataFrame) -> DataFrame:
    """Add text, true_intent, true_action and thread_length whatever the producer called them."""
    named = {
        name: resolve(df, aliases, GOLDEN_DEFAULTS[name]) for name, aliases in GOLDEN_ALIASES.items()
    }
    named["thread_length"] = (
        F.coalesce(F.col("thread_length").try_cast("int"), F.lit(1))
        if "thread_length" in df.columns
        else F.lit(1)
    )
    return df.withColumns(named)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden CSV with producer-dependent column names."""
    raw = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    )
    return golden_columns(raw)


def write_golden(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric and agreement rows as one JSON file; these tables hold one row per system or dimension."""
    df.coalesce(1).write.mode("overwrite").json(path)


def materialize_embeddings(
    df: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], key: str
) -> DataFrame:
    """Embedding table keyed by id: rows already stored are reused, new ids are encoded once and appended.

    Of rows that share an id, the same one is encoded whatever their order. Any failure to read the table but its
    absence is an error.
    """
    spark = df.sparkSession
    missing = dedupe(df, key, [F.xxhash64(*df.columns)])
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        missing = missing.join(stored.select(key), key, "left_anti")
    encode(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path)
