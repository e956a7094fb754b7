"""Text features: TF-IDF terms and vectors, message embeddings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    StopWordsRemover,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

MAX_TERMS = 2500
EMBEDDING_DIMS = 256
ENCODE_BATCH = 64


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def term_column(col: Column, stop_words: Sequence[str] = (), ngrams: int = 2) -> Column:
    """Words of two or more word characters, stop words removed, then 1..n-grams."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    if ngrams == 1:
        return words
    if ngrams != 2:
        raise ValueError("ngrams must be 1 or 2")
    room = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, room), F.slice(words, 2, room), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def tfidf_terms(
    df: DataFrame, key: str, text: str = "text", max_terms: int = MAX_TERMS,
    stop_words: Sequence[str] = (), ngrams: int = 2,
) -> DataFrame:
    """(key, term, tf, weight) over the ``max_terms`` most frequent terms, rows L2-normalised.

    idf = ln((1 + rows) / (1 + rows with the term)) + 1. Term counts are combined
    per row before the shuffle; the vocabulary has at most ``max_terms`` rows.
    """
    counts = (
        df.select(key, F.explode(term_column(F.col(text), stop_words, ngrams)).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    vocabulary = (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("_total"), F.count(F.lit(1)).alias("_df"))
        .orderBy(F.desc("_total"), "term")
        .limit(max_terms)
    )
    rows = df.agg(F.count(F.lit(1))).scalar()
    raw = F.col("tf") * (F.log((1 + rows) / (1 + F.col("_df"))) + 1)
    weighted = counts.join(vocabulary, "term").select(key, "term", "tf", raw.alias("_raw"))
    # At most max_terms rows per key.
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", "tf", (F.col("_raw") / norm).alias("weight"))


def _vocabulary(terms: DataFrame, weight: Column, max_terms: int) -> dict[str, int]:
    """The most frequent terms with the number of rows holding each, from one combinable count.

    Every occurrence adds to a term's total, its first one per row to the row count.
    """
    seen = F.concat(
        F.transform("_terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("uses"), F.lit(0).alias("rows"))),
        F.transform(
            F.array_distinct("_terms"),
            lambda t: F.struct(t.alias("term"), F.lit(0).alias("uses"), F.lit(1).alias("rows")),
        ),
    )
    top = (
        terms.select(weight.alias("_w"), F.inline(seen))
        .groupBy("term")
        .agg(F.sum(F.col("uses") * F.col("_w")).alias("total"), F.sum(F.col("rows") * F.col("_w")).alias("rows"))
        .orderBy(F.desc("total"), "term")
        .limit(max_terms)
        .collect()
    )
    return {row["term"]: row["rows"] for row in top}


def fit_tfidf(
    df: DataFrame, text: str = "text", max_terms: int = MAX_TERMS, hashed: int | None = None,
    stop_words: Sequence[str] | None = None, output: str = "features", weight: str | None = None,
) -> Callable[[DataFrame], DataFrame]:
    """Fit TF-IDF vectors; the returned function adds ``output`` (unit length) to a DataFrame.

    The vocabulary (at most ``max_terms`` terms) is what reaches the driver;
    ``weight`` counts a row as that many copies. ``hashed`` replaces terms by
    that many hash buckets, so that no term is out of vocabulary.
    """
    stops = english_stop_words() if stop_words is None else list(stop_words)

    def with_terms(frame: DataFrame) -> DataFrame:
        terms = term_column(F.col(text), stops)
        if hashed:
            terms = F.transform(terms, lambda t: F.pmod(F.hash(t), F.lit(hashed)).cast("string"))
        return frame.withColumn("_terms", terms)

    copies = F.col(weight) if weight else F.lit(1)
    rows = df.agg(F.sum(copies)).first()[0] or 0
    counted = with_terms(df.select(text, copies.cast("bigint").alias("_copies")))
    holding = _vocabulary(counted, F.col("_copies"), hashed or max_terms)
    vocabulary = [str(bucket) for bucket in range(hashed)] if hashed else list(holding)
    counter = CountVectorizerModel.from_vocabulary(vocabulary or [""], inputCol="_terms", outputCol="_tf")
    idf = [math.log((1.0 + rows) / (1.0 + holding.get(term, 0))) + 1.0 for term in vocabulary or [""]]
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_scaled")
    stages = PipelineModel([counter, scale, Normalizer(inputCol="_scaled", outputCol=output)])

    def transform(frame: DataFrame) -> DataFrame:
        return stages.transform(with_terms(frame)).drop("_terms", "_tf", "_scaled")

    return transform


Encoder = Callable[[list[str]], np.ndarray]


def embed(
    df: DataFrame,
    text: str = "text",
    encoder: Encoder | None = None,
    fitted: Callable[[DataFrame], DataFrame] | None = None,
    output: str = "embedding",
    batch: int = ENCODE_BATCH,
) -> DataFrame:
    """Add a unit vector per row; NULL text counts as empty.

    ``encoder`` maps a list of texts to a matrix and runs inside tasks in
    batches; without it the hashed TF-IDF transform ``fitted`` is used, fitted
    on this table when not given.
    """
    if encoder is None:
        fitted = fitted or fit_tfidf(df, text, hashed=EMBEDDING_DIMS, output="_features")
        vectors = fitted(df)
        return vectors.withColumn(output, vector_to_array("_features", "float32")).drop("_features")

    schema = StructType([*df.schema.fields, StructField(output, ArrayType(FloatType()))])

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            parts = [
                np.asarray(encoder(texts[i : i + batch]), dtype=np.float64) for i in range(0, len(texts), batch)
            ]
            if parts:
                matrix = np.vstack(parts)
                length = np.linalg.norm(matrix, axis=1, keepdims=True)
                matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
                frame = frame.assign(**{output: list(matrix.astype(np.float32))})
            else:
                frame = frame.assign(**{output: pd.Series([], dtype=object)})
            yield frame

    return df.mapInPandas(encode, schema)
