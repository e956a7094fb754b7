"""Reply guard: identifiers in a reply that neither the message nor its context holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.functions.text import money, order_ids, tracking_ids
from deskspark.lexicon import GUARD_FLAGS, GUARD_REPLACEMENTS

EXTRACTORS = {"order": order_ids, "tracking": tracking_ids, "money": money}

# What may not follow an identifier for it to be a whole token: '$5' is not part of '$50' or '$5.25'.
TOKEN_END = {"order": r"(?!\d)", "tracking": r"(?!\d)", "money": r"(?!\d|\.\d{2})"}


def fabricated(kind: str, reply: Column, known: Column) -> Column:
    """Sorted distinct identifiers of one kind that only the reply holds.

    The longer known text is searched only for replies that hold any.
    """
    extract = EXTRACTORS[kind]
    held = extract(reply)
    return F.when(F.size(held) > 0, F.array_sort(F.array_except(held, extract(known)))).otherwise(
        F.array().cast("array<string>")
    )


def _mask(text: Column, found: Column, kind: str) -> Column:
    """Replace each listed identifier, whole tokens only, in one pass over the text."""
    quoted = F.transform(found, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E")))
    pattern = F.concat(F.lit("(?:"), F.array_join(quoted, "|"), F.lit(")"), F.lit(TOKEN_END[kind]))
    return F.when(
        F.size(found) > 0, F.regexp_replace(text, pattern, F.lit(GUARD_REPLACEMENTS[kind]))
    ).otherwise(text)


def guard_reply(
    df: DataFrame, reply: str = "reply", message: str = "text", context: str = "context"
) -> DataFrame:
    """Add hallucination_detected, hallucination_flags and sanitized_reply."""
    blank = F.lit("")
    df = df.withColumns(
        {
            "_reply": F.coalesce(F.col(reply), blank),
            "_known": F.concat_ws(" ", F.coalesce(F.col(message), blank), F.coalesce(F.col(context), blank)),
        }
    )
    df = df.withColumns({f"_{k}": fabricated(k, F.col("_reply"), F.col("_known")) for k in EXTRACTORS})
    flags = [
        F.when(F.size(f"_{k}") > 0, F.format_string(GUARD_FLAGS[k], F.array_join(f"_{k}", ", ")))
        for k in EXTRACTORS
    ]
    found = F.array_except(F.array(*flags), F.expr("array(cast(null as string))"))
    clean = F.col("_reply")
    for kind in EXTRACTORS:
        clean = _mask(clean, F.col(f"_{kind}"), kind)
    return (
        df.withColumn("hallucination_flags", found)
        .withColumns({"hallucination_detected": F.size("hallucination_flags") > 0, "sanitized_reply": clean})
        .drop("_reply", "_known", *[f"_{k}" for k in EXTRACTORS])
    )
