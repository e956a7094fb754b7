"""Ranks, joins and prefilters that stay spread when one key holds much of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of the weighed rows, so fewer
# than HOT_SHARE keys are hot whatever the size of the table.
HOT_SHARE = 1000
SALTS = 64
# A bitmap row of Spark covers 32,768 bits, so the prefilter has 2**26 / 32768 = 2,048
# rows of 4 KB, 8 MB in all, for any number of keys.
FILTER_BITS = 26
BITMAP = 32768


def shuffled(key: Column, seed: int) -> Column:
    """Seeded order of a key, the same in any engine: the md5 of ``seed:key``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def slice_of(order: Column) -> Column:
    """The first of 4,096 slices of a :func:`shuffled` order, by its leading digits."""
    return F.conv(F.substring(order, 1, 3), 16, 10).cast("int")


def before_each(
    df: DataFrame,
    group: list[str],
    bucket: Column,
    order: list[Column],
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Exclusive running sums within each group, for groups of any size.

    ``bucket`` is an order-preserving integer that cuts a group into pieces:
    values are summed per (group, bucket) before the shuffle, a running sum over
    the buckets gives what lies before each, and only the rows of one bucket are
    ordered together. ``sums`` maps new names to the values summed, a constant 1
    for ranks; ``totals`` names columns for the whole sum of some of them. With
    ``group=[]`` the whole table is one group. Null group keys are a group.
    """
    totals = totals or {}
    names = list(sums)
    cut = df.withColumns({"_bucket": bucket, **{f"_v{i}": sums[n] for i, n in enumerate(names)}})
    counts = cut.groupBy(*group, "_bucket").agg(
        *[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(names))]
    )
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_bucket").alias("_at"),
        *[F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(names))],
        *[F.sum(f"_s{names.index(n)}").over(whole).alias(f"_t{k}") for k, n in enumerate(totals)],
    )
    rows = (
        Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = cut.withColumns(
        {f"_i{i}": F.coalesce(F.sum(f"_v{i}").over(rows), F.lit(0)) for i in range(len(names))}
    )
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    return inside.join(before, [*same, F.col("_bucket") == F.col("_at")]).select(
        *df.columns,
        *[(F.col(f"_b{i}") + F.col(f"_i{i}")).cast("bigint").alias(n) for i, n in enumerate(names)],
        *[F.col(f"_t{k}").cast("bigint").alias(name) for k, name in enumerate(totals.values())],
    )


def merged(table: DataFrame) -> DataFrame:
    """``table``, never broadcast where it is joined: for tables that grow with the input.

    Spark broadcasts what seems small by the bytes of its files. Compressed ids take a few bytes a row there, but
    about 100 as a hash table, which the driver builds and holds.
    """
    return table.hint("merge")


def attach(
    rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str, how: str = "left", merge: bool = False
) -> DataFrame:
    """Join one row per key to ``rows``, however many rows share a key.

    ``groups`` is a stored table, unique by ``key``, whose ``size`` counts the
    rows of its key. The keys with more than 1/HOT_SHARE of all counted rows are
    fewer than HOT_SHARE, which bounds the broadcast; their rows are dealt over
    SALTS by ``spread``, a column that differs between rows of one key. With ``merge`` no other key is broadcast.
    """
    total = groups.agg(F.sum(size)).scalar()
    hot = F.col(size) * HOT_SHARE > total
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = groups.withColumn("_salt", F.explode(salts))
    marked = groups.where(hot).select(F.col(key).alias("_hot"))
    left = rows.join(F.broadcast(marked), F.col(key) == F.col("_hot"), "left")
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(
        F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS)).cast("int")
    )
    right = merged(right) if merge else right
    return left.withColumn("_salt", salt).drop("_hot").join(right, [key, "_salt"], how).drop("_salt")


def maybe_among(rows: DataFrame, column: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key may be in ``keys`` (one bigint column), none missed.

    A bitmap of 2**bits bits, 2**bits / 8 bytes whatever the number of keys, is
    broadcast. It only saves later shuffles: when it fills up, more rows pass
    and the result stays the same.
    """

    def bit(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(1 << bits))

    word = "i -> cast(conv(hex(substring(_bits, 8 * i + 1, 8)), 16, -10) as bigint)"
    bitmaps = (
        keys.select(bit(keys[keys.columns[0]]).alias("_bit"))
        .groupBy(F.expr(f"_bit div {BITMAP}").alias("_map"))
        .agg(F.bitmap_construct_agg(F.col("_bit") % BITMAP).alias("_bits"))
        # As numbers of 64 bits, which a probe reads in place.
        .select("_map", F.expr(f"transform(sequence(0, {BITMAP // 64 - 1}), {word})").alias("_words"))
    )
    own = rows.withColumn("_bit", bit(F.col(column))).withColumn("_map", F.expr(f"_bit div {BITMAP}"))
    # The first byte of a number holds its first eight bits, each byte's lowest bit first.
    shift = "8 * (7 - (_bit % 64) div 8) + _bit % 8"
    is_set = F.expr(f"shiftright(get(_words, cast((_bit % {BITMAP}) div 64 as int)), cast({shift} as int)) & 1") == 1
    return own.join(F.broadcast(bitmaps), "_map").where(is_set).select(*rows.columns)
