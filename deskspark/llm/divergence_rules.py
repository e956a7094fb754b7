"""Quality rules by distribution divergence.

A document's histograms of character classes and of its language's common words
are compared with references, the histograms of all documents of that language,
by Jensen-Shannon distance (base 2, from 0 to 1). Basic counts and repetition
rules come first. Everything is a SQL expression over the row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.functions.sql import literal, literals
from deskspark.operators.rules import settle
from deskspark.sources.scratch import freeze

# Common words of each language, most common first.
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "this"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "dans", "au", "par"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "una"),
}
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
# Character classes in the order in which they are taken out of the text; what is left is the last
# class. The first is later split into letters and white space.
CLASSES = (
    ("plain", r"[a-z\x20\x09-\x0D]+"),
    ("upper", "[A-Z]+"),
    ("letter", r"\p{L}+"),
    ("digit", "[0-9]+"),
    ("point", r"[.,;:!?'\"()-]+"),
)
N_CLASSES = len(CLASSES) + 2
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class DivergenceRules:
    """Parameters. Distances are tested only from the minimum lengths on, since short histograms are noise;
    a limit is its first number plus its second over the root of the word count, as noise shrinks."""

    common_words: Mapping[str, Sequence[str]] = field(default_factory=lambda: COMMON_WORDS)
    min_words: int = 50
    max_repeat_percent: int = 50
    min_class_chars: int = 200
    min_common_words: int = 50
    class_limit: tuple[float, float] = (0.12, 0.9)
    common_limit: tuple[float, float] = (0.15, 1.2)


def _let(expression: str, variable: str, body: str) -> str:
    """SQL: body with the variable bound to a value that is computed once."""
    return f"element_at(transform(array({expression}), {variable} -> {body}), 1)"


def _repeated_words() -> str:
    """SQL over ``_words`` and ``_hashes`` (of 3-word windows): words in windows found twice or more.

    Windows with distinct hashes are distinct; only those that share a hash are compared as text.
    """
    ordered = "sort_array(transform(_hashes, (x, i) -> struct(x AS h, i AS i)))"
    shared = "(get(s, k).h <=> get(s, k - 1).h OR get(s, k).h <=> get(s, k + 1).h)"
    window = "concat_ws(' ', get(_words, i), get(_words, i + 1), get(_words, i + 2))"
    texts = (
        f"sort_array(transform(transform(filter(sequence(0, size(s) - 1), k -> {shared}), k -> get(s, k).i), "
        f"i -> struct({window} AS w, i AS i)))"
    )
    same = "(get(v, k).w <=> get(v, k - 1).w OR get(v, k).w <=> get(v, k + 1).w)"
    starts = f"sort_array(transform(filter(sequence(0, size(v) - 1), k -> {same}), k -> get(v, k).i))"
    covered = (
        "CASE WHEN size(t) = 0 THEN 0 ELSE "
        "aggregate(sequence(1, size(t)), 0, (a, j) -> a + least(3, coalesce(get(t, j) - get(t, j - 1), 3))) END"
    )
    return (
        "CASE WHEN size(_words) < 4 OR size(array_distinct(_hashes)) = size(_hashes) THEN 0 "
        f"ELSE {_let(ordered, 's', _let(texts, 'v', _let(starts, 't', covered)))} END"
    )


def _common_counts(words: Sequence[str]) -> str:
    """SQL over ``_common``, common words between double blanks: how often each occurs."""
    found = [
        f"(octet_length(_common) - octet_length(replace(_common, {literal(f' {w} ')}, ''))) div {len(w.encode()) + 2}"
        for w in words
    ]
    return f"array({', '.join(found)})"


def text_features(
    docs: DataFrame, rules: DivergenceRules, id_col: str, text_col: str, lang_col: str, counts: bool = True
) -> DataFrame:
    """Per row: ``row`` (all its columns), ``n_words``, the two histograms and, with ``counts``, the basic counts.

    ``common`` is NULL for a language without a word list.
    """
    lists = rules.common_words.values()
    listed = sorted({form for words in lists for w in words for form in (w, w.capitalize(), w.upper())})
    blank = literal(SPACES)
    df = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    trimmed = f"btrim(_text, {blank})"
    words = f"split({trimmed}, {literal(SPACE_CLASS)})"
    df = settle(
        df,
        {
            "_words": f"CASE WHEN {trimmed} = '' THEN cast(array() AS array<string>) ELSE {words} END",
            "_no_plain": f"regexp_replace(_text, {literal(CLASSES[0][1])}, '')",
        },
    )
    for (before, _), (name, pattern) in zip(CLASSES[:-1], CLASSES[1:]):
        df = df.withColumn(f"_no_{name}", F.expr(f"regexp_replace(_no_{before}, {literal(pattern)}, '')"))
    df = df.withColumn("_ink", F.expr("length(array_join(_words, ''))"))
    names = ["text", *(f"no_{name}" for name, _ in CLASSES)]
    taken = [f"length(_{x}) - length(_{y})" for x, y in zip(names[:-1], names[1:])]
    spaces = "(length(_text) - _ink)"
    classes = ", ".join([spaces, f"{taken[0]} - {spaces}", *taken[1:], f"length(_{names[-1]})"])
    by_lang = " ".join(
        f"WHEN {literal(lang)} THEN {_common_counts(words)}" for lang, words in rules.common_words.items()
    )
    known = f"lang IN ({literals(rules.common_words)})"
    df = df.withColumn(
        "_common",
        F.expr(
            f"CASE WHEN {known} THEN "
            f"lower(concat(' ', array_join(filter(_words, w -> w IN ({literals(listed)})), '  '), ' ')) END"
        ),
    )
    features = {
        "n_words": "cast(size(_words) AS bigint)",
        "classes": f"transform(array({classes}), c -> cast(c AS bigint))",
        "common": f"CASE lang {by_lang} END",
    }
    if counts:
        df = df.withColumn(
            "_hashes",
            F.expr("transform(_words, (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2)))"),
        ).withColumn("_lines", F.expr(f"filter(split(_text, '\\n', -1), l -> btrim(l, {blank}) <> '')"))
        features |= {
            "word_chars": "cast(_ink AS bigint)",
            "n_symbols": f"cast(length(_no_plain) - length(translate(_no_plain, '{SYMBOLS}', '')) AS bigint)",
            "n_dup_lines": "cast(size(_lines) - size(array_distinct(_lines)) AS bigint)",
            "n_repeat_words": f"cast({_repeated_words()} AS bigint)",
        }
    return settle(df, features).select("row", "doc_id", "lang", *features)


def fit_references(features: DataFrame, rules: DivergenceRules) -> dict[str, tuple[list[int], list[int], int]]:
    """Per language with a word list: class counts, common-word counts and words of all its documents.

    The driver gets one row per listed language.
    """
    most = max(len(w) for w in rules.common_words.values())
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(most)]
    rows = (
        features.where(F.col("common").isNotNull())
        .groupBy("lang")
        .agg(*sums, F.sum("n_words").alias("n"))
        .collect()
    )
    return {
        r["lang"]: (
            [r[f"c{i}"] for i in range(N_CLASSES)],
            [r[f"w{i}"] for i in range(len(rules.common_words[r["lang"]]))],
            r["n"],
        )
        for r in rows
    }


def _distance(counts: str, total: str, reference: Sequence[float]) -> str:
    """SQL: Jensen-Shannon distance of counts / total to a constant distribution."""
    q = "array(" + ", ".join(f"{x!r}D" for x in reference) + ")"
    half = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((p + q) / 2)) ELSE 0D END"
    terms = f"zip_with(transform({counts}, c -> c / {total}), {q}, (p, q) -> ({half.format('p')} + {half.format('q')}) / 2)"
    return f"sqrt(greatest(0D, aggregate({terms}, 0D, (a, x) -> a + x)))"


def judge(features: DataFrame, references: Mapping[str, tuple], rules: DivergenceRules) -> DataFrame:
    """Adds ``class_distance, common_distance`` (NULL below the minimum lengths or without a reference),
    ``base_failed`` and ``kept``."""
    by_class, by_common = [], []
    for lang, (classes, common, n) in references.items():
        if sum(classes) and n:
            by_class.append((lang, _distance("classes", "_chars", [x / sum(classes) for x in classes])))
            rest = [x / n for x in common]
            counts = "concat(common, array(n_words - aggregate(common, 0L, (a, x) -> a + x)))"
            by_common.append((lang, _distance(counts, "n_words", [*rest, (n - sum(common)) / n])))

    def pick(cases: list[tuple[str, str]], guard: str) -> str:
        whens = " ".join(f"WHEN lang = {literal(k)} THEN {sql}" for k, sql in cases)
        return f"CASE WHEN NOT ({guard}) THEN cast(NULL AS double) {whens} ELSE cast(NULL AS double) END"

    measured = features.withColumn("_chars", F.expr("aggregate(classes, 0L, (a, x) -> a + x)")).withColumns(
        {
            "class_distance": F.expr(pick(by_class, f"_chars >= {rules.min_class_chars}")),
            "common_distance": F.expr(pick(by_common, f"n_words >= {rules.min_common_words}")),
            "base_failed": F.expr(
                f"n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words"
            ),
        }
    )

    def within(distance: str, limit: tuple[float, float]) -> str:
        return f"coalesce({distance} <= {limit[0]}D + {limit[1]}D / sqrt(n_words), true)"

    alike = f"{within('class_distance', rules.class_limit)} AND {within('common_distance', rules.common_limit)}"
    return measured.withColumn("kept", ~F.col("base_failed") & F.expr(alike)).drop("_chars")


def assess(
    docs: DataFrame,
    rules: DivergenceRules = DivergenceRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per document: counts, histograms, distances and verdict.

    A null or empty text has no words and fails the base rules. A null or
    unlisted language has no reference and is judged by the base rules alone.
    Repeated rows count as often as they occur; an empty table gives an empty
    result; names of other columns do not matter.
    """
    features = freeze(text_features(docs, rules, id_col, text_col, lang_col).drop("row"))
    return judge(features, fit_references(features, rules), rules)


def passing(
    docs: DataFrame,
    rules: DivergenceRules = DivergenceRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The documents that pass, with all their columns; the texts are not shuffled."""
    columns = (id_col, text_col, lang_col)
    references = fit_references(text_features(docs, rules, *columns, counts=False), rules)
    return judge(text_features(docs, rules, *columns), references, rules).where("kept").select("row.*")
