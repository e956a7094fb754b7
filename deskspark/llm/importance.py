"""Importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

A generative model of hashed words and word pairs is fitted to target text and
one to the raw corpus. A document's log importance weight is the sum of log
ratios over its n-grams; adding Gumbel noise and taking the k largest keys
samples k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm import ngrams
from deskspark.llm.spread import before_each, shuffled
from deskspark.sources.scratch import freeze


@dataclass(frozen=True)
class ImportanceModel:
    """``buckets`` of the hashed n-grams, pseudo-count of a bucket, and at most how many labelled target
    documents the target model is fitted on (drawn by seed)."""

    buckets: int = 1 << 14
    smoothing: float = 1.0
    target_rows: int = 20_000
    seed: int = 5


def _buckets(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and of every pair of neighbouring words, and the text that each is from."""
    h, counts = ngrams.word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    pairs = ngrams.mixed(h[:-1] * ngrams.M1 + h[1:]) if len(h) else h
    inside = owner[:-1] == owner[1:] if len(h) else np.empty(0, bool)
    every = np.concatenate([h, pairs[inside]])
    owners = np.concatenate([owner, owner[:-1][inside]]) if len(h) else owner
    return (every % np.uint64(buckets)).astype(np.int64), owners


def _counts(buckets: int):
    """Task code: texts in, one row per bucket that occurs in the task out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in ngrams.chunks(batch.column(0)):
                total += np.bincount(_buckets(texts, buckets)[0], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["bucket", "n"]
        )

    return run


def _scores(log_ratio: np.ndarray):
    """Task code: (doc_id, text) in, (doc_id, log_weight, n_grams) out."""
    buckets = len(log_ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, sizes = [], []
            for _, texts in ngrams.chunks(batch.column(1)):
                found, owners = _buckets(texts, buckets)
                weights.append(np.bincount(owners, log_ratio[found], len(texts)))
                sizes.append(np.bincount(owners, minlength=len(texts)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.concatenate(weights) if weights else [], pa.float64()),
                    pa.array(np.concatenate(sizes) if sizes else [], pa.int64()),
                ],
                ["doc_id", "log_weight", "n_grams"],
            )

    return run


def bucket_counts(docs: DataFrame, model: ImportanceModel, text_col: str = "text") -> np.ndarray:
    """Counts of all n-grams of all texts; the driver gets one number per bucket."""
    rows = (
        docs.select(text_col)
        .mapInArrow(_counts(model.buckets), "bucket bigint, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = np.zeros(model.buckets, np.float64)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return counts


def log_ratios(target: np.ndarray, raw: np.ndarray, model: ImportanceModel) -> np.ndarray:
    """log p_target - log p_raw per bucket, both with a pseudo-count."""

    def logs(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + model.smoothing) / (counts.sum() + model.smoothing * model.buckets))

    return logs(target) - logs(raw)


def fit(
    docs: DataFrame, targets: DataFrame, model: ImportanceModel, id_col: str = "doc_id", text_col: str = "text"
) -> np.ndarray:
    """Log ratios from the target documents (one column of ids) and all documents."""
    chosen = (
        targets.select(F.col(targets.columns[0]).alias("_target"))
        .distinct()
        .orderBy(shuffled(F.col("_target"), model.seed), "_target")
        .limit(model.target_rows)
    )
    # At most target_rows ids, so the broadcast is bounded.
    target = docs.join(F.broadcast(chosen), docs[id_col] == chosen["_target"], "left_semi")
    return log_ratios(bucket_counts(target, model, text_col), bucket_counts(docs, model, text_col), model)


def _uniform(seed: int):
    """A number in (0, 1) that depends on the doc_id alone."""
    digits = F.conv(F.substring(shuffled(F.col("doc_id"), seed), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / float(1 << 52)


def resample(
    docs: DataFrame,
    targets: DataFrame,
    k: int,
    model: ImportanceModel = ImportanceModel(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, log_weight, n_grams, key, rank, kept``.

    ``kept`` marks the k largest keys (log weight plus Gumbel noise seeded by
    doc_id), all when there are no more; ties go to the smaller doc_id. A null
    or empty text has log weight 0. Repeated rows have equal keys and are
    ranked one by one. Without targets the models are equal up to smoothing. An
    empty table gives an empty result; other columns are not looked at.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ratios = fit(base, targets, model)
    gumbel = -F.log(-F.log(_uniform(model.seed)))
    scored = freeze(
        base.mapInArrow(_scores(ratios), "doc_id bigint, log_weight double, n_grams bigint").withColumn(
            "key", F.col("log_weight") + gumbel
        )
    )
    # Ranks over all rows: cut the keys into slices of about equal size, each ordered on its own.
    cuts = scored.approxQuantile("key", [i / 256 for i in range(1, 256)], 0.001) if k > 0 else []
    slices = F.lit(0)
    if cuts:
        bounds = ", ".join(f"{c!r}D" for c in sorted(set(cuts)))
        slices = F.expr(f"size(filter(array({bounds}), c -> c >= key))")
    ranked = before_each(scored, [], slices, [F.col("key").desc(), F.col("doc_id")], {"rank": F.lit(1)})
    return ranked.withColumn("kept", F.col("rank") < k)


def sample(docs: DataFrame, targets: DataFrame, k: int, model: ImportanceModel = ImportanceModel()) -> DataFrame:
    """The sampled documents with all their columns."""
    chosen = resample(docs, targets, k, model).where("kept").select(F.col("doc_id").alias("_sampled"))
    return docs.join(chosen, docs["doc_id"] == chosen["_sampled"], "left_semi")
