"""Prompts out, raw model answers in: rendering, parsing and normalising as Columns."""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.functions.text import strip_space
from deskspark.lexicon import DEFAULT_CONFIDENCE, DEFAULT_RATINGS, INTENTS, OTHER


def render_prompts(
    df: DataFrame, template: str, values: Mapping[str, Column | str] | None = None, prompt: str = "prompt"
) -> DataFrame:
    """Fill ``{name}`` fields from columns of that name, or from ``values`` (columns or fixed text)."""
    values = values or {}
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            given = values.get(field, F.col(field))
            given = F.lit(given) if isinstance(given, str) else given
            parts.append(F.coalesce(given.cast("string"), F.lit("")))
    return df.withColumn(prompt, F.concat(*parts))


def strip_thinking(col: Column) -> Column:
    """Drop <think> blocks, unless nothing else is left."""
    raw = F.coalesce(col, F.lit(""))
    return F.coalesce(F.nullif(strip_space(F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")), F.lit("")), raw)


def _parsed(text: Column, fields: Sequence[str]) -> Column:
    """Struct of string fields, NULL unless the text is a JSON object."""
    ddl = ", ".join(f"{f} string" for f in fields) + ", _corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}
    parsed = F.from_json(text, ddl, options)
    return F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$") & parsed["_corrupt"].isNull(), parsed)


def parse_responses(df: DataFrame, raw: str, fields: Sequence[str]) -> DataFrame:
    """Add the fields as strings, and ``error`` when no JSON object can be found.

    Tried in order: the whole text, a fenced block, the widest pair of braces.
    """
    df = df.withColumn("_text", strip_thinking(F.col(raw)))
    fenced = F.regexp_extract("_text", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract("_text", r"(?s)(\{.*\})", 1)
    df = df.withColumn(
        "_parsed",
        F.coalesce(_parsed(F.col("_text"), fields), _parsed(fenced, fields), _parsed(braces, fields)),
    )
    return df.select(
        *[c for c in df.columns if c not in ("_text", "_parsed", *fields)],
        *[F.col("_parsed")[f].alias(f) for f in fields],
        F.when(F.col("_parsed").isNull(), "json_parse_failed").alias("error"),
    )


def _answer(raw: Column) -> Column:
    """The JSON object of an answer as a variant, NULL without one; tried in the order of :func:`parse_responses`."""
    text = strip_thinking(raw)
    tried = [
        text,
        F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1),
        F.regexp_extract(text, r"(?s)(\{.*\})", 1),
    ]
    return F.coalesce(*[F.when(t.rlike(r"(?s)^\s*\{.*\}\s*$"), F.try_parse_json(t)) for t in tried])


def parse_typed(df: DataFrame, raw: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add typed, possibly nested fields, given as name -> (path, SQL type), such as ("$.ratings.tone", "int").

    A value that does not convert to its type is NULL and its name is listed in ``mistyped``; names without a
    value, or with a JSON null, are listed in ``missing``. ``error`` is set, the lists are empty and the fields
    NULL when no JSON object can be found. Columns of these names are replaced.
    """
    df = df.withColumn("_answer", _answer(F.col(raw)))
    got = {f: F.try_variant_get("_answer", path, kind) for f, (path, kind) in fields.items()}
    given = {f: F.try_variant_get("_answer", path, "variant") for f, (path, _) in fields.items()}
    absent = {f: v.isNull() | F.is_variant_null(v) for f, v in given.items()}

    def listed(tests: Mapping[str, Column]) -> Column:
        names = F.array(*[F.when(test, F.lit(f)) for f, test in tests.items()])
        return F.when(F.col("_answer").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(names))

    added = {
        **got,
        "missing": listed(absent),
        "mistyped": listed({f: ~absent[f] & got[f].isNull() for f in fields}),
        "error": F.when(F.col("_answer").isNull(), "json_parse_failed"),
    }
    return df.select(*[c for c in df.columns if c not in ("_answer", *added)], *[v.alias(f) for f, v in added.items()])


def answer_drift(df: DataFrame, raw: str, paths: Mapping[str, str]) -> DataFrame:
    """What answers hold: rows (field, kind, n) for fields given as name -> path.

    Kinds are number, string, boolean, array, object, null, missing and, for answers without a JSON
    object, unreadable. One pass; a few counts per task are shuffled.
    """
    answers = df.select(_answer(F.col(raw)).alias("_answer"))
    shape = {f: F.schema_of_variant(F.try_variant_get("_answer", path, "variant")) for f, path in paths.items()}
    kinds = [
        F.struct(
            F.lit(f).alias("field"),
            F.when(F.col("_answer").isNull(), "unreadable")
            .when(s.isNull(), "missing")
            .when(s == "VOID", "null")
            .when(s.isin("STRING", "BOOLEAN"), F.lower(s))
            .when(s.startswith("OBJECT") | s.startswith("ARRAY"), F.lower(F.regexp_extract(s, "^[A-Z]+", 0)))
            .otherwise("number")
            .alias("kind"),
        )
        for f, s in shape.items()
    ]
    return answers.select(F.inline(F.array(*kinds))).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))


def answer_schema(df: DataFrame, raw: str) -> DataFrame:
    """One row: the schema that holds all answers, and how many there are with and without a JSON object."""
    return df.select(_answer(F.col(raw)).alias("_answer")).agg(
        F.schema_of_variant_agg("_answer").alias("schema"),
        F.count("_answer").alias("answers"),
        F.count_if(F.col("_answer").isNull()).alias("unreadable"),
    )


def normalize_label(col: Column, labels: Sequence[str] = INTENTS, other: str = OTHER) -> Column:
    """Exact name, else the first name that contains or is contained in the text, else ``other``.

    Empty text is ``other``.
    """
    text = strip_space(F.lower(F.coalesce(col, F.lit(""))))
    result = F.when(text.isin(list(labels)), text).when(text == "", other)
    for label in labels:
        result = result.when(text.contains(label) | F.contains(F.lit(label), text), label)
    return result.otherwise(other)


def clamp_confidence(col: Column, default: float = DEFAULT_CONFIDENCE) -> Column:
    """Missing or unreadable becomes the default; the rest is clamped to [0, 1]."""
    value = F.coalesce(col.try_cast("double"), F.lit(default))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def normalize_ratings(df: DataFrame, defaults: Mapping[str, int] = DEFAULT_RATINGS) -> DataFrame:
    """Whole ratings in 1..5 with defaults for missing ones, and their mean to 2 places."""
    dims = {
        d: F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(F.col(d).try_cast("double").try_cast("int"), F.lit(v))))
        for d, v in defaults.items()
    }
    df = df.withColumns(dims)
    mean = sum((F.col(d) for d in list(defaults)[1:]), F.col(next(iter(defaults)))) / len(defaults)
    return df.withColumn("overall_mean", F.round(mean, 2))
