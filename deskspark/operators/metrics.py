"""Scoring predictions against truth. Everything starts from one count per (truth, prediction) cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskspark.lexicon import ESCALATE, INTENTS


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 when the bottom is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def pair_labels(predictions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Predictions next to their truth, matched by id."""
    return predictions.join(gold, key)


def stack_predictions(systems: Mapping[str, DataFrame]) -> DataFrame:
    """Predictions of several systems in one table with a ``model`` column."""
    stacked = None
    for name, frame in systems.items():
        named = frame.withColumn("model", F.lit(name))
        stacked = named if stacked is None else stacked.unionByName(named)
    return stacked


def stack_columns(df: DataFrame, systems: Mapping[str, Mapping[str, Column]], keep: Sequence[str]) -> DataFrame:
    """As stack_predictions, for systems that are columns of one table: one scan for all of them."""
    rows = [
        F.struct(F.lit(name).alias("model"), *[c.alias(n) for n, c in fields.items()])
        for name, fields in systems.items()
    ]
    return df.select(*keep, F.inline(F.array(*rows)))


def accuracy(pairs: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    hit = F.col(truth).eqNullSafe(F.col(pred))
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("accuracy")
    )


def confusion(pairs: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Long confusion matrix: one row per cell that occurs."""
    return pairs.groupBy(*by, truth, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(
    pairs: DataFrame, truth: str, pred: str, classes: Sequence[str] = INTENTS, by: Sequence[str] = ()
) -> DataFrame:
    """One row per true class, one column per predicted class, 0 where empty."""
    return pairs.groupBy(*by, truth).pivot(pred, list(classes)).agg(F.count(F.lit(1))).na.fill(0, list(classes))


def class_scores(cells: DataFrame, truth: str, pred: str, by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """Precision, recall and F1 per class over the union of true and predicted classes."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col(truth).eqNullSafe(F.col(pred)), F.col(n)).otherwise(zero)
    sides = F.array(
        F.struct(F.col(truth).alias("class"), hit.alias("tp"), F.col(n).alias("support"), zero.alias("predicted")),
        F.struct(F.col(pred).alias("class"), zero.alias("tp"), zero.alias("support"), F.col(n).alias("predicted")),
    )
    counts = (
        cells.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(
            F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
        )
    )
    return counts.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("predicted")),
            "recall": ratio(F.col("tp"), F.col("support")),
            "f1": ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")),
        }
    )


def macro_prf(pairs: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted class means of precision, recall and F1."""
    scores = class_scores(confusion(pairs, truth, pred, by), truth, pred, by)
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("classes"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def _binary(t: Column, p: Column, n: Column) -> dict[str, Column]:
    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("bigint")

    return {"tp": total(t & p), "fp": total(~t & p), "fn": total(t & ~p), "tn": total(~t & ~p)}


def _binary_scores() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
    }


def binary_prf(
    pairs: DataFrame, truth: str, pred: str, positive: str | int = ESCALATE, by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1, accuracy and the four counts for one positive label."""
    t = F.coalesce(F.col(truth) == F.lit(positive), F.lit(False))
    p = F.coalesce(F.col(pred) == F.lit(positive), F.lit(False))
    counts = _binary(t, p, F.lit(1))
    return pairs.groupBy(*by).agg(*[c.alias(n) for n, c in counts.items()]).withColumns(_binary_scores())


def binary_rollup(
    pairs: DataFrame, truth: str, pred: str, levels: Sequence[str], positive: str | int = ESCALATE
) -> DataFrame:
    """:func:`binary_prf` for every prefix of ``levels`` down to the total, in one pass.

    ``level`` tells the rows apart: 0 for all levels, then 1, 3, 7 as the last, the last two, ... are summed
    over (a NULL there stands for all). Rows are counted once per cell of all levels; the subtotals are sums of those.
    """
    t = F.coalesce(F.col(truth) == F.lit(positive), F.lit(False))
    p = F.coalesce(F.col(pred) == F.lit(positive), F.lit(False))
    cells = pairs.groupBy(*levels).agg(*[c.alias(n) for n, c in _binary(t, p, F.lit(1)).items()])
    sums = [F.sum(n).cast("bigint").alias(n) for n in ("tp", "fp", "fn", "tn")]
    return cells.rollup(*levels).agg(F.grouping_id().alias("level"), *sums).withColumns(_binary_scores())


def rating_means(df: DataFrame, dims: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean rating per dimension and the mean of those means."""
    means = df.groupBy(*by).agg(*[F.avg(d).alias(f"{d}_mean") for d in dims])
    overall = sum((F.col(f"{d}_mean") for d in dims[1:]), F.col(f"{dims[0]}_mean")) / len(dims)
    return means.withColumn("overall_mean", overall)


def compare(
    pairs: DataFrame,
    base: str,
    truth_intent: str = "true_intent",
    pred_intent: str = "intent",
    truth_action: str = "true_action",
    pred_action: str = "decision",
) -> DataFrame:
    """One metrics row per system, with deltas against a base system.

    The rows are counted once, per (model, intents, actions) cell; every metric
    is a sum over those few cells.
    """
    cells = pairs.groupBy("model", truth_intent, pred_intent, truth_action, pred_action).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col(truth_intent).eqNullSafe(F.col(pred_intent)), F.col("n")).otherwise(0)
    t = F.coalesce(F.col(truth_action) == ESCALATE, F.lit(False))
    p = F.coalesce(F.col(pred_action) == ESCALATE, F.lit(False))
    actions = (
        cells.groupBy("model")
        .agg(
            F.sum("n").alias("n"),
            F.sum(hit).alias("_hits"),
            *[c.alias(k) for k, c in _binary(t, p, F.col("n")).items()],
        )
        .withColumns(_binary_scores())
    )
    macro = (
        class_scores(cells, truth_intent, pred_intent, ["model"]).groupBy("model").agg(F.avg("f1").alias("_macro"))
    )
    rows = actions.join(macro, "model").select(
        "model",
        "n",
        ratio(F.col("_hits"), F.col("n")).alias("intent_accuracy"),
        F.col("_macro").alias("intent_macro_f1"),
        F.col("precision").alias("escalate_precision"),
        F.col("recall").alias("escalate_recall"),
        F.col("f1").alias("escalate_f1"),
        F.col("accuracy").alias("escalation_accuracy"),
        F.col("fn").alias("false_negative_count"),
        F.col("fp").alias("false_positive_count"),
    )
    return with_deltas(rows, base)


def with_deltas(metrics: DataFrame, base: str) -> DataFrame:
    """Add accuracy and F1 gains and the false-negative reduction (percent) over the base system."""
    # One row per system, so this single window holds a handful of rows.
    every = Window.partitionBy(F.lit(1))

    def of_base(name: str) -> Column:
        return F.max(F.when(F.col("model") == base, F.col(name))).over(every)

    fewer = of_base("false_negative_count") - F.col("false_negative_count")
    return metrics.withColumns(
        {
            "intent_accuracy_delta": F.col("intent_accuracy") - of_base("intent_accuracy"),
            "escalate_f1_delta": F.col("escalate_f1") - of_base("escalate_f1"),
            "fn_reduction_pct": F.try_divide(fewer * 100.0, of_base("false_negative_count")),
        }
    )


def failure_cases(
    pairs: DataFrame,
    n: int = 5,
    key: str = "ticket_id",
    truth_intent: str = "true_intent",
    pred_intent: str = "intent",
    truth_action: str = "true_action",
    pred_action: str = "decision",
) -> DataFrame:
    """The first n wrong rows in id order, each with the kind of failure."""
    wanted, given = F.col(truth_action) == ESCALATE, F.col(pred_action) == ESCALATE
    kind = (
        F.when(wanted & ~given, "false_negative_escalation")
        .when(~wanted & given, "false_positive_escalation")
        .when(F.col(truth_intent) != F.col(pred_intent), "intent_error")
    )
    return pairs.withColumn("failure", kind).where(F.col("failure").isNotNull()).orderBy(key).limit(n)
