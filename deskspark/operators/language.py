"""Language of unlabelled text: rank profiles of character n-grams, out-of-place distance.

Texts are lower-cased and reduced to words of letters; n-grams of one to three characters are taken
inside a word with a blank at each end. A profile lists the most frequent n-grams of a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.operators.grouped import top_n_per_group
from deskspark.operators.rules import route_language
from deskspark.sources.scratch import freeze

PROFILE_SIZE = 300
MARGIN_PERCENT = 3
# Profiles reach every task: at most this many languages of PROFILE_SIZE n-grams.
MAX_LANGUAGES = 1_000
BLANK = 32
BITS = 21
# Characters of a text that are counted at a time.
PIECE = 1 << 20


def plain_words(text: Column) -> Column:
    """Words of letters, lower-cased, each with a blank before and after; '' without letters."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(codes, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def _grams(plain: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of a text; a code holds the code points, longer n-grams have larger codes."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for start in range(0, len(plain), PIECE):
        c = np.frombuffer(plain[start : start + PIECE + 2].encode("utf-32-le"), "<u4").astype(np.int64)
        two = c[:-1] << BITS | c[1:]
        three = (two[:-1] << BITS | c[2:])[:PIECE]
        ones = c[:PIECE]
        codes = np.concatenate([ones[ones != BLANK], two[:PIECE], three[c[1:-1][:PIECE] != BLANK]])
        found.append(np.unique(codes, return_counts=True))
    if len(found) == 2:
        return found[1]
    return _summed(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))


def _top(plain: str, size: int) -> np.ndarray:
    codes, counts = _grams(plain)
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """Profiles (lang, gram, rank) from all rows with a language: counts leave a task summed per batch.

    ``gram`` is the code of the n-gram; ties in frequency go to the shorter, then the smaller one.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, texts in batch.groupby("lang")["plain"]:
                parts = [_grams(t) for t in texts]
                codes, counts = _summed(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
                yield pd.DataFrame({"lang": name, "gram": codes, "n": counts})

    rows = df.select(F.col(lang).alias("lang"), plain_words(F.col(text)).alias("plain"))
    counts = (
        rows.where("lang IS NOT NULL AND plain <> ''")
        .mapInPandas(count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    return top_n_per_group(counts, ["lang"], [F.desc("n"), F.col("gram")], size).select("lang", "gram", "rank")


def detect_language(
    df: DataFrame,
    profiles: DataFrame,
    text: str = "text",
    margin: int = MARGIN_PERCENT,
    size: int = PROFILE_SIZE,
    lang: str = "lang_guess",
) -> DataFrame:
    """Add the nearest profile's language, its distance and the runner-up's.

    The distance sums, over the ``size`` most frequent n-grams of the text, how far each stands from its
    place in the profile, or ``size`` where the profile lacks it. A text is ambiguous, its language NULL,
    when the runner-up is less than ``margin`` percent farther. Texts without letters have NULLs, and no
    row is dropped. Ties go to the alphabetically first language. Columns of these names are replaced.
    """
    profiles = freeze(profiles)  # learned once, read twice
    names = [r["lang"] for r in profiles.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: fold the rare ones first")
    rows = profiles.where(F.col("rank") <= size).toPandas()
    grams = np.unique(rows["gram"].to_numpy(np.int64))
    places = np.zeros((len(names), len(grams) + 1), np.int64)  # 0: not in the profile
    spots = np.searchsorted(grams, rows["gram"].to_numpy(np.int64))
    places[np.searchsorted(np.array(names, dtype=object), rows["lang"].to_numpy(object)), spots] = rows["rank"]
    shared = df.sparkSession.sparkContext.broadcast((names, grams, places))

    def nearest(plain: str) -> tuple:
        names, grams, places = shared.value
        top = _top(plain, size) if plain and names else ()
        if not len(top):
            return None, None, None
        at = np.searchsorted(grams, top)
        known = grams[np.minimum(at, len(grams) - 1)] == top
        placed = places[:, np.where(known, at, len(grams))]
        gaps = np.where(placed > 0, np.abs(placed - np.arange(1, len(top) + 1)), size).sum(axis=1)
        order = np.argsort(gaps, kind="stable")
        return names[order[0]], int(gaps[order[0]]), int(gaps[order[1]]) if len(order) > 1 else None

    @F.pandas_udf("lang string, distance bigint, runner_up bigint")
    def judge(plain: pd.Series) -> pd.DataFrame:
        judged = pd.DataFrame([nearest(t) for t in plain], columns=["lang", "distance", "runner_up"])
        return judged.astype({"distance": "Int64", "runner_up": "Int64"})

    told = f"{lang}_distance", f"{lang}_runner_up"
    judged = df.withColumn("_judged", judge(plain_words(F.col(text))))
    gap = F.col("_judged.runner_up") - F.col("_judged.distance")
    clear = F.coalesce(gap * 100 >= F.col("_judged.runner_up") * margin, F.lit(True))
    return judged.withColumns(
        {
            lang: F.when(clear, F.col("_judged.lang")),
            told[0]: F.col("_judged.distance"),
            told[1]: F.col("_judged.runner_up"),
        }
    ).drop("_judged")


def route_unlabelled(
    df: DataFrame,
    profiles: DataFrame,
    supported: list[str],
    text: str = "text",
    intent: str = "intent",
) -> DataFrame:
    """Rows in an unsupported language, or in none that is clear, get the catch-all intent; no row is dropped."""
    guessed = detect_language(df, profiles, text)
    return route_language(guessed, supported, "lang_guess", intent)
