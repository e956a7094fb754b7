"""Shards that all match the mixture, by proportional stratified interleaving.

Rows are shuffled by seed within each source and ranked; sorting by fractional
rank ((rank + 1/2) / rows of the source) interleaves the sources in proportion,
so that any contiguous cut holds every source at its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm.spread import before_each, shuffled, slice_of

SLICES = 4096
# What a row weighs beside its text.
ROW_BYTES = 16


def assign_shards(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, text_crc32, source_rank, position, shard, slot`` per row.

    Law: row counts of shards differ by at most one. A null text counts as
    empty, a null source is a source of its own, repeated rows each get a slot,
    an empty table gives an empty result and other columns are not looked at.
    Both rankings cut a source or the table into 4,096 slices, so a source with
    a third of all rows is spread like any other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shuffled(F.col(id_col), seed).alias("_order"),
    )
    tie = [F.col("_order"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = before_each(
        rows, ["source"], slice_of(F.col("_order")), tie, {"source_rank": F.lit(1)}, {"source_rank": "_rows"}
    )
    part = (2 * F.col("source_rank") + 1) / (2 * F.col("_rows"))
    mixed = before_each(
        ranked.withColumn("_part", part),
        [],
        F.floor(F.col("_part") * SLICES).cast("int"),
        [F.col("_part"), F.col("source"), *tie],
        {"position": F.lit(1)},
        {"position": "_all"},
    )
    shard = F.expr(f"(position * {shards}) div _all")
    return mixed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        "source_rank",
        "position",
        "shard",
        F.expr(f"position - (shard * _all + {shards - 1}) div {shards}").alias("slot"),
    )
