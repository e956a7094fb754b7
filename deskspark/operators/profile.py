"""Corpus profiles: lengths, bigrams, class shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.functions.text import ascii_words, word_count
from deskspark.lexicon import BIGRAM_STOP_WORDS


# Items a bigram sketch keeps, first try and second. Its map has 4/3 as many places, a power of two.
SKETCH_ITEMS = (12_288, 196_608)
SKETCH_GROUPS = 64


def _bigrams(df: DataFrame, text: str, stop_words: Sequence[str]) -> DataFrame:
    stops = list(stop_words)
    words = df.select(F.filter(ascii_words(F.col(text)), lambda w: ~w.isin(stops)).alias("w"))
    # A shifted zip keeps pair building in generated code; no filter on the word list, which would tokenise twice.
    room = F.greatest(F.size("w") - 1, F.lit(0))
    neighbours = F.arrays_zip(F.slice("w", 1, room).alias("a"), F.slice("w", 2, room).alias("b"))
    pairs = words.select(F.inline(neighbours).alias("a", "b"))
    return pairs.select(F.concat_ws(" ", "a", "b").alias("bigram"))


def _counted(pairs: DataFrame, n: int | None) -> DataFrame:
    counts = pairs.groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))
    return counts if n is None else counts.orderBy(F.desc("n"), "bigram").limit(n)


def top_bigrams(
    df: DataFrame, text: str = "text", n: int | None = 20, stop_words: Sequence[str] = BIGRAM_STOP_WORDS
) -> DataFrame:
    """Most frequent adjacent word pairs after stop-word removal; ties by bigram.

    Pairs are counted before the shuffle, and the top n is a distributed
    take-ordered; ``n=None`` returns every bigram.
    """
    return _counted(_bigrams(df, text, stop_words), n)


def _candidates(pairs: DataFrame, n: int, items: int) -> list[str] | None:
    """Bigrams that may be among the n most frequent, none missing; None when the sketch cannot tell.

    A kept item's estimate is its count or up to ``error`` more; an item that is not kept has at most
    ``error`` rows. So n bigrams have at least (n-th estimate - error) rows: where that is more than
    ``error``, only kept items at or above it can be among the first n.
    """
    parts = pairs.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("_group")).agg(
        F.expr(f"approx_top_k_accumulate(bigram, {items})").alias("_sketch"), F.count(F.lit(1)).alias("_rows")
    )
    # Grouped by a constant, since sketches of no rows do not combine.
    whole = parts.groupBy(F.lit(0).alias("_all")).agg(
        F.expr(f"approx_top_k_combine(_sketch, {items})").alias("_sketch"), F.sum("_rows").alias("_rows")
    )
    # Nothing is lost while all rows fit.
    error = F.when(F.col("_rows") <= items, 0.0).otherwise(F.lit(3.5 * 3 / 4 / items) * F.col("_rows"))
    told = whole.select(F.expr(f"approx_top_k_estimate(_sketch, {items})").alias("_kept"), error.alias("_error"))
    least = F.coalesce(F.get("_kept", F.lit(n - 1))["count"] - F.col("_error"), F.lit(0.0))
    found = told.select(
        "_error", least.alias("_least"), F.filter("_kept", lambda x: x["count"] >= least)["item"].alias("_items")
    ).first()
    if found is None:
        return []
    return found["_items"] if found["_error"] == 0 or found["_least"] > found["_error"] else None


def frequent_bigrams(
    df: DataFrame,
    text: str = "text",
    n: int = 20,
    stop_words: Sequence[str] = BIGRAM_STOP_WORDS,
    sketches: Sequence[int] = SKETCH_ITEMS,
) -> DataFrame:
    """The rows of :func:`top_bigrams` without shuffling every distinct bigram.

    Each task keeps a frequent-items sketch; merged, in groups first, they name the bigrams that can
    be among the first n, and a second scan counts those exactly. Where counts are too flat for a
    sketch, a larger one is tried, and at last all bigrams are counted.
    """
    if n <= 0:
        return top_bigrams(df, text, 0, stop_words)
    pairs = _bigrams(df, text, stop_words)
    for items in sketches:
        found = _candidates(pairs, n, items) if items >= 2 * n else None
        if found is not None:
            chosen = df.sparkSession.createDataFrame([(b,) for b in found], "bigram string")
            # At most ``items`` rows.
            return _counted(pairs.join(F.broadcast(chosen), "bigram", "left_semi"), n)
    return _counted(pairs, n)


def length_profile(df: DataFrame, text: str = "text", by: Sequence[str] = (), ts: str | None = None) -> DataFrame:
    """Words per text: total, min, quartiles (linear), mean, max; optional time range.

    Texts are reduced to a histogram of word counts first, so the percentiles
    are exact and each group ends as a few distinct lengths.
    """
    extra = [F.min(ts).alias("first_at"), F.max(ts).alias("last_at")] if ts else []
    histogram = (
        df.select(*by, word_count(F.col(text)).alias("words"), *([ts] if ts else []))
        .groupBy(*by, "words")
        .agg(F.count(F.lit(1)).alias("n"), *extra)
    )
    times = [F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")] if ts else []
    quartiles = F.percentile("words", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    return (
        histogram.groupBy(*by)
        .agg(
            F.sum("n").alias("total"),
            F.min("words").alias("min_words"),
            quartiles.alias("_q"),
            (F.sum(F.col("words") * F.col("n")) / F.sum("n")).alias("mean_words"),
            F.max("words").alias("max_words"),
            *times,
        )
        .withColumns(
            {
                "p25_words": F.get("_q", F.lit(0)),
                "median_words": F.get("_q", F.lit(1)),
                "p75_words": F.get("_q", F.lit(2)),
            }
        )
        .drop("_q")
    )


def class_distribution(df: DataFrame, col: str) -> DataFrame:
    """Count and share per class; the total is a scalar subquery over the counts."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def compare_distributions(sample: DataFrame, population: DataFrame, col: str) -> DataFrame:
    """Share of each class in a sample next to its natural share."""
    drawn = class_distribution(sample, col).select(
        col, F.col("n").alias("sample_n"), F.col("share").alias("sample_share")
    )
    natural = class_distribution(population, col).select(
        col, F.col("n").alias("natural_n"), F.col("share").alias("natural_share")
    )
    return natural.join(drawn, col, "full_outer").na.fill(0)


def majority_class(df: DataFrame, col: str) -> DataFrame:
    """The most frequent class, ties to the alphabetically first: one row (class, n)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), col).limit(1)


def fold_rare(df: DataFrame, col: str, min_share: float = 0.03, other: str | Column = "other") -> DataFrame:
    """Replace classes below a share of the rows by ``other``.

    The rare classes are joined back; the optimiser broadcasts them when small
    and the join is on class otherwise, with no row leaving its class's count.
    """
    shares = class_distribution(df, col)
    rare = shares.where(F.col("share") < min_share).select(F.col(col).alias("_rare"))
    target = other if isinstance(other, Column) else F.lit(other)
    joined = df.join(rare, F.col(col) == F.col("_rare"), "left")
    return joined.withColumn(col, F.when(F.col("_rare").isNotNull(), target).otherwise(F.col(col))).drop("_rare")
