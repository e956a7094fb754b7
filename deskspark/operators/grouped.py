"""Ordering and per-group helpers that stay distributed on skewed data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskspark.sources.scratch import freeze

# Up to this many rows per group Spark prunes each partition before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold); beyond it groups are salted.
GROUP_LIMIT_THRESHOLD = 1000
SALTS = 64
# A key is hot when it holds more than 1/HOT_SHARE of the weighed rows, so fewer than
# HOT_SHARE keys are hot whatever the size of the table.
HOT_SHARE = 1000


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order (order must be unique within a key).

    A combinable aggregate, so a hot key is reduced before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*_columns(order))).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, "_first.*").select(*df.columns)


def dedupe(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """One row per id, the earliest in the given order."""
    return first_per_key(df, key, order)


def top_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first n rows of each group with their 1-based rank.

    For small n Spark's group limit drops surplus rows before the shuffle. For
    large n a first pass within salted sub-groups does the same, so no task
    receives a whole hot group.
    """
    if n > GROUP_LIMIT_THRESHOLD:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        part = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn(rank, F.row_number().over(part))
            .where(F.col(rank) <= n)
            .drop("_salt", rank)
        )
    whole = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)


def _placed(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-sorted and frozen, with the slice (sorted partition) and the offset inside it."""
    placed = freeze(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumns(
        {
            "_slice": F.shiftright("_at", 33),
            "_offset": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    ).drop("_at")


def _before(slices: DataFrame, value: str) -> DataFrame:
    """Sum over all earlier slices; one row per sorted partition, so the window stays tiny."""
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.select("_slice", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("_before"))


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Exact 0-based position in a total order, without a single-task window.

    Rows are range-sorted once; a row's position is the size of the earlier
    sorted partitions plus its offset in its own. The broadcast table has one
    row per partition.
    """
    placed = _placed(df, order)
    before = _before(placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")), "_n")
    return (
        placed.join(F.broadcast(before), "_slice")
        .withColumn(name, F.col("_before") + F.col("_offset"))
        .select(*df.columns, name)
    )


def running_total(
    df: DataFrame, order: Sequence[str | Column], value: str, name: str = "running"
) -> DataFrame:
    """Exact cumulative sum (current row included) over a total order, distributed."""
    placed = _placed(df, order)
    before = _before(placed.groupBy("_slice").agg(F.sum(value).alias("_n")), "_n")
    inside = Window.partitionBy("_slice").orderBy("_offset").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_inside", F.sum(value).over(inside))
        .join(F.broadcast(before), "_slice")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .select(*df.columns, name)
    )


def running_count(
    df: DataFrame,
    key: Sequence[str],
    ts: str,
    order: Sequence[str],
    name: str,
    slice_width: str = "hour",
) -> DataFrame:
    """Running row count per key in time order.

    Each key is cut into time slices: counts per (key, slice) are combined
    before the shuffle, their running sum gives the count before each slice,
    and only rows of one slice are ordered together. A hot key is spread over
    as many tasks as it has slices.
    """
    sliced = df.withColumn("_slice", F.date_trunc(slice_width, F.col(ts).cast("timestamp")))
    counts = sliced.groupBy(*key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = counts.select(*key, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*key, "_slice").orderBy(*order)
    ranked = sliced.withColumn("_inside", F.row_number().over(inside))
    same = [ranked[k].eqNullSafe(before[k]) for k in [*key, "_slice"]]
    joined = ranked.join(before, same)
    return joined.select(
        *[ranked[c] for c in df.columns],
        (before["_before"] + ranked["_inside"]).cast("bigint").alias(name),
    )


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, how: str = "left") -> DataFrame:
    """Join one row per key to ``rows``, however many rows share a key.

    ``groups`` is a stored table, unique by ``key``, whose ``size`` counts the rows of its key. Keys with
    more than 1/HOT_SHARE of all counted rows are fewer than HOT_SHARE, which bounds the
    broadcast; their rows are dealt over SALTS by ``spread``, which differs between rows of one key.
    ``groups`` is never broadcast, however small its compressed files are.
    """
    hot = F.col(size) * HOT_SHARE > groups.agg(F.sum(size)).scalar()
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = groups.withColumn("_salt", F.explode(salts))
    left = rows.join(F.broadcast(groups.where(hot).select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return left.withColumn("_salt", salt).drop("_hot").join(right.hint("merge"), [key, "_salt"], how).drop("_salt")
