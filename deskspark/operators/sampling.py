"""Reproducible samples. The order is a hash of (seed, key), so a sample does not
depend on partitioning, file order or the engine."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskspark.operators.grouped import top_n_per_group, with_position
from deskspark.sources.scratch import freeze

# Hex digits of the hash that one pass of a cut resolves: at most 4,096 counts leave a task.
CUT_DIGITS = 3


def hash_order(seed: int, key: str | Column) -> Column:
    col = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")))


def _cut(hashes: DataFrame, n: int) -> tuple[str, int, int] | None:
    """(hash, rows below it, rows holding it) of the n-th row in hash order; None when there are fewer rows.

    Counts per prefix find the slice that holds the row, and the next pass counts inside that slice
    alone, until it holds one hash. Each pass returns one row.
    """
    prefix, below = "", 0
    while True:
        bins = (
            hashes.where(F.col("_hash").startswith(prefix))
            .groupBy(F.substring("_hash", 1, len(prefix) + CUT_DIGITS).alias("_prefix"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_hash").alias("_low"), F.max("_hash").alias("_high"))
        )
        # At most 16 ** CUT_DIGITS rows, whatever the size of the table.
        upto = F.sum("_n").over(Window.orderBy("_prefix")) + F.lit(below)
        found = bins.withColumn("_upto", upto).where(F.col("_upto") >= n).orderBy("_prefix").first()
        if found is None:
            return None
        prefix, below = found["_prefix"], found["_upto"] - found["_n"]
        if found["_low"] == found["_high"]:
            return found["_low"], below, found["_n"]


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows, uniformly chosen by seed; the whole table when it has no more than n.

    The hash of the n-th row is found from counts (see :func:`_cut`), so the draw itself is a filter:
    nothing is sorted or shuffled whatever n is. NULL keys come first. Rows that share the last key are
    cut by their content; equal rows are interchangeable.
    """
    if n <= 0:
        return df.limit(0)
    order = F.coalesce(hash_order(seed, key), F.lit(""))
    cut = _cut(df.select(order.alias("_hash")), n)
    if cut is None:
        return df
    last, below, holding = cut
    if below + holding == n:
        return df.where(order <= last)
    placed = with_position(df.where(order == last), [F.xxhash64(*df.columns), F.rand(seed)], "_pos")
    return df.where(order < last).unionByName(placed.where(F.col("_pos") < n - below).drop("_pos"))


def limit_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(order).limit(n)


def systematic_sample(df: DataFrame, m: int, order: str, position: str = "position") -> DataFrame:
    """m evenly spaced rows of the ordered table, first and last included.

    Positions are floor(i * (n - 1) / (m - 1)); a table of at most m rows comes
    back whole.
    """
    placed = with_position(df, [order], position)
    last = placed.agg(F.max(position)).scalar()
    i = F.col("id")
    spot = F.floor(i * last / F.lit(max(m - 1, 1))).cast("bigint")
    spots = df.sparkSession.range(m).select(
        F.when(last < m, i).otherwise(spot).alias(position)
    )
    return placed.join(spots, position, "left_semi")


def relabel_sample(df: DataFrame, frac: float, seed: int, key: str) -> DataFrame:
    """ceil(frac * rows) rows in shuffled order, for blind relabelling."""
    n = math.ceil(round(df.count() * frac, 9))
    return sample_n(df, n, seed, key)


def centroid_distance(df: DataFrame, stratum: str, vector: str) -> DataFrame:
    """Squared distance of each row to its stratum's mean vector, as ``distance``.

    Means are combined before the shuffle; one vector per stratum is joined back.
    """
    means = (
        df.groupBy(stratum)
        .agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("_mean"))
        .select(F.col(stratum).alias("_stratum"), vector_to_array("_mean").alias("_mean"))
    )
    gap = F.zip_with(F.col(vector), "_mean", lambda x, m: (x - m) * (x - m))
    return (
        df.join(means, F.col(stratum).eqNullSafe(F.col("_stratum")))
        .withColumn("distance", F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x))
        .drop("_stratum", "_mean")
    )


def stratified_backfill(
    df: DataFrame,
    stratum: str,
    quota: int,
    total: int,
    seed: int,
    key: str,
    by: str = "random",
    vector: str | None = None,
) -> DataFrame:
    """Up to ``quota`` rows per stratum, then random rows of the rest up to ``total``.

    Quotas go first: where they add up to more than ``total``, all of them are
    drawn and there is no backfill. Rows with a NULL stratum only enter through the backfill. ``by='centroid'``
    draws the rows nearest to the mean vector of their stratum. ``origin`` tells
    the two draws apart; no row appears twice.
    """
    # The draw works on narrow rows, computed once; only drawn ids meet the wide table.
    narrow = freeze(df.select(key, stratum, *([vector] if by == "centroid" else [])))
    candidates = narrow.where(F.col(stratum).isNotNull())
    if by == "centroid":
        candidates = centroid_distance(candidates, stratum, vector)
        nearness = [F.round("distance", 9), F.col(key)]
    else:
        nearness = [hash_order(seed, key), F.col(key)]
    quota_rows = freeze(
        top_n_per_group(candidates, [stratum], nearness, quota, "_rank").select(key, F.lit("quota").alias("origin"))
    )
    rest = narrow.select(key).join(quota_rows, key, "left_anti")
    left = max(total - quota_rows.count(), 0)
    backfill = sample_n(rest, left, seed, key).select(key, F.lit("backfill").alias("origin"))
    return df.join(quota_rows.unionByName(backfill), key).select(*df.columns, "origin")
