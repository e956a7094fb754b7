"""Agreement between two raters, from one joint histogram of their ratings."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from deskspark.operators.grouped import running_total


def pair_ratings(
    a: DataFrame, b: DataFrame, key: str, dims: Sequence[str], impute: bool = False
) -> DataFrame:
    """Rater A's rows with rater B's ratings as ``b_<dim>``.

    Missing B ratings stay NULL (and drop out of agreement); with ``impute`` they
    copy A's rating and ``imputed`` marks the row.
    """
    right = b.select(key, *[F.col(d).alias(f"b_{d}") for d in dims])
    paired = a.join(right, key, "left")
    missing = F.lit(False)
    for d in dims:
        missing = missing | F.col(f"b_{d}").isNull()
    paired = paired.withColumn("imputed", missing if impute else F.lit(False))
    fill = {f"b_{d}": F.coalesce(f"b_{d}", d) for d in dims} if impute else {}
    return paired.withColumns(fill) if fill else paired


def unpivot_pairs(pairs: DataFrame, dims: Sequence[str], prefix: str = "b_") -> DataFrame:
    """(dimension, a, b) rows where both raters gave a value."""
    rows = [
        F.struct(
            F.lit(d).alias("dimension"),
            F.col(d).cast("double").alias("a"),
            F.col(f"{prefix}{d}").cast("double").alias("b"),
        )
        for d in dims
    ]
    long = pairs.select(F.inline(F.array(*rows)))
    return long.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def _cells(long: DataFrame) -> DataFrame:
    return long.groupBy("dimension", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def agreement(pairs: DataFrame, dims: Sequence[str], tol: float = 1.0) -> DataFrame:
    """Exact and within-tolerance rates and both raters' means, per dimension."""
    gap = F.abs(F.col("a") - F.col("b"))
    return (
        unpivot_pairs(pairs, dims)
        .groupBy("dimension")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((gap == 0).cast("double")).alias("exact_agreement"),
            F.avg((gap <= tol).cast("double")).alias("within_tolerance"),
            F.avg("a").alias("a_mean"),
            F.avg("b").alias("b_mean"),
        )
    )


def _average_ranks(cells: DataFrame, value: str, few_values: bool) -> DataFrame:
    """Average rank of each distinct value: rows before it plus half of its own."""
    marginal = cells.groupBy("dimension", value).agg(F.sum("n").alias("_n"))
    if few_values:
        upto = Window.partitionBy("dimension").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        counted = marginal.withColumn("_upto", F.sum("_n").over(upto))
    else:
        total = running_total(marginal, ["dimension", value], "_n", "_global")
        # Rows of earlier dimensions are counted in; subtract them per dimension.
        start = total.groupBy("dimension").agg(F.min(F.col("_global") - F.col("_n")).alias("_start"))
        counted = total.join(F.broadcast(start), "dimension").withColumn(
            "_upto", F.col("_global") - F.col("_start")
        )
    rank = F.col("_upto") - (F.col("_n") - 1) / 2
    return counted.select("dimension", value, rank.alias(f"rank_{value}"))


def spearman(long: DataFrame, few_values: bool = False) -> DataFrame:
    """Spearman's rho per dimension of (dimension, a, b) rows, average ranks for ties.

    NULL when either side is constant. Ranks come from value histograms:
    ``few_values`` states that each dimension has few distinct values (a rating
    scale); otherwise the cumulative counts are computed on range-sorted slices,
    so no task sees all distinct values.
    """
    cells = _cells(long)
    ranked = cells.join(_average_ranks(cells, "a", few_values), ["dimension", "a"]).join(
        _average_ranks(cells, "b", few_values), ["dimension", "b"]
    )
    # The mean of average ranks is known, so they are centred before they are multiplied.
    middles = cells.groupBy("dimension").agg(((F.sum("n") + 1) / 2).alias("_middle"))
    n, rank_a, rank_b = F.col("n"), F.col("rank_a") - F.col("_middle"), F.col("rank_b") - F.col("_middle")
    flat = (F.min("rank_a") == F.max("rank_a")) | (F.min("rank_b") == F.max("rank_b"))
    sums = ranked.join(middles, "dimension").groupBy("dimension").agg(
        F.sum("n").alias("n"),
        flat.alias("_flat"),
        F.sum(n * rank_a * rank_a).alias("_aa"),
        F.sum(n * rank_b * rank_b).alias("_bb"),
        F.sum(n * rank_a * rank_b).alias("_ab"),
    )
    rho = F.when(~F.col("_flat"), F.try_divide("_ab", F.sqrt("_aa") * F.sqrt("_bb")))
    return sums.select("dimension", "n", rho.alias("rho"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 300):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def t_two_sided(rho: float, n: int) -> float | None:
    """Two-sided p-value of a correlation by the t distribution with n - 2 degrees of freedom."""
    if rho is None or math.isnan(rho) or n < 3:
        return None
    if abs(rho) >= 1.0:
        return 0.0
    dof = n - 2
    x = 1.0 - rho * rho  # dof / (dof + t^2)
    a, b = dof / 2.0, 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x)
    ) if x < 1.0 else 0.0
    if x >= 1.0:
        return 1.0
    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return min(1.0, 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b)


@F.pandas_udf(DoubleType())
def _p_values(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(None if pd.isna(r) else float(r), int(k)) for r, k in zip(rho, n)], dtype="float64")


def with_p_value(correlations: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """Add the two-sided p-value; runs on one row per dimension."""
    return correlations.withColumn("p_value", _p_values(F.col(rho), F.col(n)))


def cohens_kappa(pairs: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Raw agreement and Cohen's kappa; NULL when chance agreement is total."""
    cells = pairs.groupBy(*by, first, second).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    same = F.when(F.col(first).eqNullSafe(F.col(second)), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col(first).cast("string").alias("class"), F.col("n").alias("f"), zero.alias("s"), same.alias("both")),
        F.struct(F.col(second).cast("string").alias("class"), zero.alias("f"), F.col("n").alias("s"), zero.alias("both")),
    )
    classes = (
        cells.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(F.sum("f").alias("f"), F.sum("s").alias("s"), F.sum("both").alias("both"))
    )
    total = F.col("n").cast("double")
    f, s = F.col("f").cast("double"), F.col("s").cast("double")
    summed = classes.groupBy(*by).agg(
        F.sum("f").alias("n"), F.sum("both").alias("_both"), F.sum(f * s).alias("_chance")
    )
    observed = F.col("_both") / total
    chance = F.col("_chance") / (total * total)
    return summed.select(
        *by,
        "n",
        observed.alias("agreement"),
        F.when(chance < 1.0, (observed - chance) / (F.lit(1.0) - chance)).alias("kappa"),
    )
