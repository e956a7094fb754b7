"""Text cleaning and entity extraction as native Columns.

Regular expressions carry ``(?U)`` so word characters, digits and white space
are the Unicode ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskspark.lexicon import (
    MONEY_PATTERN,
    ORDER_ID_PATTERN,
    SIGNOFFS,
    TRACKING_ID_PATTERN,
)

HANDLE = "@([A-Za-z0-9_]+)"
URL = r"(?U)https?://\S+|www\.\S+"
SPACES = r"(?U)[\s\x1c-\x1f]+"


def strip_space(col: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(col, rf"^{SPACES}|{SPACES}$", "")


def _without(col: Column, hints: Sequence[str], pattern: str) -> Column:
    """Delete matches; texts that hold none of the literal hints skip the regular expression."""
    possible = reduce(lambda a, b: a | b, [col.contains(h) for h in hints])
    return F.when(possible, F.regexp_replace(col, pattern, "")).otherwise(col)


def clean_text(col: Column) -> Column:
    """Drop handles and URLs, collapse white space; NULL becomes ''."""
    text = _without(F.coalesce(col, F.lit("")), ["@"], HANDLE)
    text = _without(text, ["http", "www."], URL)
    return F.trim(F.regexp_replace(text, SPACES, " "))


def clean_or_raw(col: Column) -> Column:
    """Cleaned text, or the trimmed raw text when cleaning leaves nothing."""
    raw = strip_space(F.coalesce(col, F.lit("")))
    return F.coalesce(F.nullif(clean_text(col), F.lit("")), raw)


def mentions(col: Column) -> Column:
    """Handles in order of appearance, duplicates kept."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(HANDLE), F.lit(1))


def as_id(col: Column) -> Column:
    """Tolerant numeric id: '12', '12.0' and 12.0 give 12, anything else NULL."""
    text = F.trim(col.cast("string"))
    whole = text.try_cast("bigint")
    return F.coalesce(whole, text.try_cast("double").try_cast("bigint"))


def money(col: Column) -> Column:
    """Dollar amounts in order of appearance."""
    return F.regexp_extract_all(col, F.lit("(?U)" + MONEY_PATTERN), F.lit(0))


def order_ids(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit("(?U)" + ORDER_ID_PATTERN), F.lit(0))


def tracking_ids(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit("(?U)" + TRACKING_ID_PATTERN), F.lit(0))


def word_count(col: Column) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def ascii_words(col: Column) -> Column:
    """Lower-case words of two or more ASCII letters, whole words only."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(col, F.lit(""))), F.lit(r"(?U)\b[a-z]{2,}\b"), F.lit(0)
    )


def normalize_reply(col: Column, signoffs: Sequence[str] = SIGNOFFS, default: str | None = None) -> Column:
    """Remove one pair of outer quotes; add a sign-off unless there is one already."""
    default = default or signoffs[0]
    text = strip_space(F.coalesce(col, F.lit("")))
    quoted = text.startswith('"') & text.endswith('"')
    bare = F.when(quoted, strip_space(F.regexp_replace(text, r'(?s)^"(.*?)"?$', "$1"))).otherwise(text)
    signed = F.lit(False)
    for signoff in signoffs:
        signed = signed | bare.endswith(signoff)
    return F.when(signed, bare).otherwise(F.concat(bare, F.lit(f" {default}")))
