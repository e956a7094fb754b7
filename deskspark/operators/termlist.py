"""Rule tables of any size: all terms are found in one scan of each text.

A table of a few dozen rules is best written as one expression (``rules.classify_rules``). Beyond some
hundreds of terms that expression leaves generated code and scans every text once per term; here an
automaton of all terms, built once per task, scans each text once. Only the text goes to Python, no row is
shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark import lexicon as lx
from deskspark.sources.scratch import freeze

# Bytes of the terms of one automaton (some tens of bytes of memory for each of them).
BLOCK_BYTES = 2 << 20
WORD_KINDS = ("Mn", "Mc", "Me", "Nd", "Nl", "Pc")


@lru_cache(maxsize=65_536)
def _in_word(char: str) -> bool:
    return char.isalpha() or unicodedata.category(char) in WORD_KINDS


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends before character ``at``."""
    before = at > 0 and _in_word(text[at - 1])
    after = at < len(text) and _in_word(text[at])
    return before != after


def _automaton(terms: list[tuple[str, list[int]]]) -> ahocorasick.Automaton | None:
    if not terms:
        return None
    built = ahocorasick.Automaton()
    for term, positions in terms:
        built.add_word(term, (len(term), tuple(positions)))
    built.make_automaton()
    return built


def _positions(automaton: ahocorasick.Automaton | None, text: str, whole: bool) -> list[int]:
    hits: set[int] = set()
    for last, (length, positions) in automaton.iter(text) if automaton else ():
        if not whole or (_edge(text, last + 1 - length) and _edge(text, last + 1)):
            hits.update(positions)
    return sorted(hits)


def _scan(df: DataFrame, terms: list[tuple[str, list[int]]], text: str, found: str, whole: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(terms)

    @F.pandas_udf("array<bigint>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(shared.value)
        for texts in batches:
            yield pd.Series([_positions(automaton, t, whole) for t in texts], dtype=object)

    return df.withColumn(found, F.array_union(found, scan(F.lower(F.coalesce(F.col(text), F.lit(""))))))


def find_terms(
    df: DataFrame,
    rules: DataFrame,
    text: str = "text",
    found: str = "found",
    mode: str = "word",
    term: str = "term",
    position: str = "position",
) -> DataFrame:
    """Add ``found``: the positions of all rules with a term in the text, ascending; a column of that name is replaced.

    ``rules`` holds a row per term; terms may share a position, and a term may stand at several. Terms and
    texts are lower-cased. ``mode`` finds terms as whole words ("word") or anywhere ("substring"). NULL texts
    hold nothing; NULL and empty terms are found nowhere. A table above BLOCK_BYTES is dealt into blocks by
    term, each scanned after the other with the result stored in between, so that neither the driver nor a
    task holds more than about a block.
    """
    table = (
        rules.select(F.lower(term).alias("_term"), F.col(position).cast("bigint").alias("_position"))
        .where("_term <> '' AND _position IS NOT NULL")
        .groupBy("_term")
        .agg(F.sort_array(F.collect_set("_position")).alias("_positions"))
    )
    size = table.agg(F.coalesce(F.sum(F.octet_length("_term") + 8 * F.size("_positions")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    if blocks > 1:
        table = freeze(table.withColumn("_block", F.pmod(F.xxhash64("_term"), F.lit(blocks))))
    out = df.withColumn(found, F.array().cast("array<bigint>"))
    for block in range(max(blocks, 1)):
        part = table.where(F.col("_block") == block) if blocks > 1 else table
        terms = [(r["_term"], r["_positions"]) for r in part.select("_term", "_positions").toLocalIterator()]
        out = _scan(out, terms, text, found, mode == "word")
        if block + 1 < blocks:
            out = freeze(out)
    return out.withColumn(found, F.sort_array(found)) if blocks > 1 else out


def classify_terms(
    df: DataFrame,
    rules: DataFrame,
    text: str = "text",
    mode: str = "word",
    default: str = lx.OTHER,
    intent: str = "intent",
    label: str = "intent",
    term: str = "term",
    position: str = "position",
) -> DataFrame:
    """The first rule (lowest position) with a term in the text names the intent; ``default`` where none is found.

    As ``rules.classify_rules`` for a table of rules (term, position, label). Rules that share a position
    share their label; if they don't, the smallest counts. Adds ``first_rule`` and the intent.
    """
    first = find_terms(df, rules, text, "_found", mode, term, position).withColumn("first_rule", F.get("_found", F.lit(0)))
    labels = rules.groupBy(F.col(position).cast("bigint").alias("first_rule")).agg(F.min(label).alias("_label"))
    kept = [c for c in df.columns if c not in (intent, "first_rule")]
    # Spark broadcasts the labels while they are small, and splits a rule that most texts match otherwise.
    return first.join(labels, "first_rule", "left").select(
        *kept, "first_rule", F.coalesce("_label", F.lit(default)).alias(intent)
    )
