"""Rule operators: escalation policy, intent cascades, baselines, canned replies."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark import lexicon as lx
from deskspark.functions.sql import literal, literals, lookup, name
from deskspark.functions.text import MONEY_PATTERN

NO_STRINGS = "array(cast(null as string))"


def _lowered(text: str) -> str:
    return f"lower(coalesce({name(text)}, ''))"


def contains_any(lowered: str, terms: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {literal(t)})" for t in terms) + ")"


def has_word(lowered: str, terms: Sequence[str]) -> str:
    """Any of the terms as whole words; the plain search spares most texts the regular expression."""
    pattern = r"(?U)\b(?:" + "|".join(re.escape(t) for t in terms) + r")\b"
    return f"({contains_any(lowered, terms)} AND rlike({lowered}, {literal(pattern)}))"


def matched_terms(lowered: str, terms: Sequence[str]) -> str:
    """Word-bounded terms found in the text, in list order, joined by commas; '' when none."""
    found = ", ".join(f"CASE WHEN {has_word(lowered, [t])} THEN {literal(t)} END" for t in terms)
    return f"concat_ws(', ', {found})"


def settle(df: DataFrame, computed: Mapping[str, str]) -> DataFrame:
    """Add columns (SQL text) that later filters read instead of recomputing.

    The optimiser copies a column's expression into every filter on it. For
    dozens of text searches that costs more than the filter saves, so the
    columns come from a one-row inline, which filters do not cross.
    """
    row = ", ".join(f"{sql} AS {name(column)}" for column, sql in computed.items())
    kept = [name(c) for c in df.columns if c not in computed]
    return df.selectExpr(*kept, f"inline(array(struct({row})))")


def escalate(
    df: DataFrame,
    policy: lx.EscalationPolicy = lx.EscalationPolicy(),
    text: str = "text",
    intent: str = "intent",
    confidence: str = "confidence",
    thread_length: str = "thread_length",
) -> DataFrame:
    """Add decision, reason, fired_signals and signal_count from eight ordered signals."""
    repeat = "|".join(p.replace("{brand}", re.escape(policy.brand.lower())) for p in policy.repeat_patterns)
    amounts = f"regexp_extract_all(coalesce({name(text)}, ''), {literal('(?U)' + MONEY_PATTERN)}, 0)"
    scanned = settle(
        df.withColumn("_low", F.expr(_lowered(text))),
        {
            "_legal": matched_terms("_low", policy.legal_terms),
            "_safety": matched_terms("_low", policy.safety_terms),
            "_frustration": matched_terms("_low", policy.frustration_terms),
            "_money": f"CASE WHEN contains({name(text)}, '$') THEN array_join({amounts}, ', ') ELSE '' END",
            "_repeat": f"rlike(_low, {literal('(?U)' + repeat)})",
        },
    )
    fmt = {kind: literal(text) for kind, text in lx.SIGNAL_FORMATS.items()}
    least = float(policy.min_confidence)

    def listed(kind: str) -> str:
        return f"CASE WHEN _{kind} <> '' THEN format_string({fmt[kind]}, _{kind}) END"

    signals = [
        f"CASE WHEN {name(intent)} IN ({literals(policy.risky_intents)}) THEN format_string({fmt['intent']}, {name(intent)}) END",
        listed("legal"),
        listed("money"),
        listed("safety"),
        f"CASE WHEN {name(thread_length)} > 1 THEN format_string({fmt['thread']}, bigint({name(thread_length)})) END",
        f"CASE WHEN _repeat THEN {fmt['repeat']} END",
        listed("frustration"),
        f"CASE WHEN {name(confidence)} < {least}D THEN "
        f"format_string({fmt['confidence']}, double({name(confidence)}), {least}D) END",
    ]
    kept = [name(c) for c in df.columns if c not in ("fired_signals", "decision", "reason", "signal_count")]
    # array_except drops the NULLs of silent signals and, unlike a lambda filter, stays in generated code.
    return scanned.selectExpr(*kept, f"array_except(array({', '.join(signals)}), {NO_STRINGS}) AS fired_signals").selectExpr(
        *kept,
        "fired_signals",
        f"CASE WHEN size(fired_signals) > 0 THEN {literal(lx.ESCALATE)} ELSE {literal(lx.AUTO)} END AS decision",
        f"CASE WHEN size(fired_signals) > 0 THEN concat({literal(lx.REASON_PREFIX)}, array_join(fired_signals, '; ')) "
        f"ELSE {literal(lx.REASON_NONE)} END AS reason",
        "size(fired_signals) AS signal_count",
    )


def signal_rates(df: DataFrame) -> DataFrame:
    """How often each signal fires and co-fires: one row per (signal, with_signal).

    ``signal = with_signal`` is the plain firing count; share is over all rows.
    One pass with one counter per pair of signals, so a single row per partition
    is shuffled.
    """
    heads = {kind: "\n" + fmt.split("(")[0] for kind, fmt in lx.SIGNAL_FORMATS.items()}
    fired = df.selectExpr("concat('\\n', array_join(fired_signals, '\\n')) AS fired").selectExpr(
        *[f"contains(fired, {literal(head)}) AS {kind}" for kind, head in heads.items()]
    )
    kinds = list(heads)
    pairs = [(a, b) for i, a in enumerate(kinds) for b in kinds[i:]]
    counts = fired.selectExpr("count(1) AS total", *[f"count_if({a} AND {b}) AS {a}_{b}" for a, b in pairs])
    rows = ", ".join(
        f"struct('{x}' AS signal, '{y}' AS with_signal, {a}_{b} AS n)"
        for a, b in pairs
        for x, y in sorted({(a, b), (b, a)})
    )
    return (
        counts.selectExpr("total", f"inline(array({rows}))")
        .where("n > 0")
        .selectExpr("signal", "with_signal", "n", "n / total AS share")
    )


def _matches(lowered: str, pattern: str | Sequence[str], mode: str) -> str:
    if mode == "regex":
        return f"rlike({lowered}, {literal('(?U)' + pattern)})"
    return has_word(lowered, pattern) if mode == "word" else contains_any(lowered, pattern)


def classify_rules(
    df: DataFrame,
    rules: Sequence[tuple],
    mode: str,
    text: str = "text",
    default: str = lx.OTHER,
    default_decision: str | None = None,
    confidence: float | None = None,
    intent: str = "intent",
) -> DataFrame:
    """First matching rule names the intent (and the decision, for three-part rules).

    Rules are (pattern, intent) or (pattern, intent, decision). ``mode`` reads the
    pattern as whole words ("word"), substrings ("substring") or one regular
    expression on lower-cased text ("regex").
    """
    cases = " ".join(f"WHEN {_matches('_low', rule[0], mode)} THEN {i}" for i, rule in enumerate(rules))
    numbered = settle(df.withColumn("_low", F.expr(_lowered(text))), {"_rule": f"CASE {cases} END"})

    def pick(part: int, otherwise: str) -> str:
        return f"coalesce(get(array({literals(rule[part] for rule in rules)}), _rule), {literal(otherwise)})"

    added = {intent: pick(1, default)}
    if confidence is not None:
        added["confidence"] = f"{float(confidence)}D"
    if default_decision is not None:
        added["decision"] = pick(2, default_decision)
    kept = [name(c) for c in df.columns if c not in added]
    return numbered.selectExpr(*kept, *[f"{sql} AS {name(column)}" for column, sql in added.items()])


def rules_regex(df: DataFrame, text: str = "text", intent: str = "intent") -> DataFrame:
    return classify_rules(df, lx.WORD_RULES, "word", text, intent=intent)


def rules_substring(df: DataFrame, text: str = "text", intent: str = "intent") -> DataFrame:
    return classify_rules(
        df, lx.SUBSTRING_RULES, "substring", text, confidence=lx.SUBSTRING_CONFIDENCE, intent=intent
    )


def rules_decision(df: DataFrame, text: str = "text", intent: str = "intent") -> DataFrame:
    default_intent, default_decision = lx.DECISION_RULES_DEFAULT
    return classify_rules(
        df, lx.DECISION_RULES, "substring", text, default_intent, default_decision, intent=intent
    )


def multi_intent(
    df: DataFrame,
    rules: Sequence[tuple] = lx.SUBSTRING_RULES,
    priority: Sequence[str] = lx.INTENT_PRIORITY,
    text: str = "text",
    mode: str = "substring",
) -> DataFrame:
    """Primary and secondary intent by priority among all intents that match."""
    ordered = sorted(rules, key=lambda rule: list(priority).index(rule[1]))
    hits = ", ".join(f"CASE WHEN {_matches('_low', rule[0], mode)} THEN {literal(rule[1])} END" for rule in ordered)
    found = settle(
        df.withColumn("_low", F.expr(_lowered(text))), {"_hits": f"array_except(array({hits}), {NO_STRINGS})"}
    )
    return found.selectExpr(
        *[name(c) for c in df.columns],
        f"coalesce(get(_hits, 0), {literal(lx.OTHER)}) AS primary_intent",
        "get(_hits, 1) AS secondary_intent",
    )


def escalate_simple(
    df: DataFrame,
    terms: Sequence[str] = lx.SIMPLE_ESCALATION_TERMS,
    text: str = "text",
    thread_length: str = "thread_length",
) -> DataFrame:
    """Escalate multi-turn threads, else any row with one of the substrings."""
    said = {kind: literal(reason) for kind, reason in lx.SIMPLE_REASONS.items()}
    kept = [name(c) for c in df.columns if c not in ("reason", "decision")]
    reasoned = settle(
        df.withColumn("_low", F.expr(_lowered(text))),
        {
            "reason": f"CASE WHEN {name(thread_length)} > 1 THEN {said['thread']} "
            f"WHEN {contains_any('_low', terms)} THEN {said['term']} ELSE {said['none']} END"
        },
    )
    return reasoned.selectExpr(
        *kept,
        "reason",
        f"CASE WHEN reason = {said['none']} THEN {literal(lx.AUTO)} ELSE {literal(lx.ESCALATE)} END AS decision",
    )


def constant_baseline(df: DataFrame, intent: str | Column = lx.INTENTS[0]) -> DataFrame:
    """One intent for every row, always escalated."""
    return df.withColumns(
        {
            "intent": F.lit(intent) if isinstance(intent, str) else intent,
            "confidence": F.lit(1.0),
            "decision": F.lit(lx.ESCALATE),
            "reason": F.lit(lx.CONSTANT_REASON),
        }
    )


def canned_reply(
    df: DataFrame,
    templates: Mapping[str, str] = lx.REPLY_TEMPLATES,
    default: str = lx.DEFAULT_REPLY,
    intent: str = "intent",
    reply: str = "reply",
) -> DataFrame:
    """Reply text by intent; the template map is a literal, so there is no join."""
    found = lookup(dict(templates), name(intent))
    return df.withColumn(reply, F.expr(f"coalesce({found}, {literal(default)})"))


def label_actions(df: DataFrame, policy: lx.EscalationPolicy = lx.EscalationPolicy()) -> DataFrame:
    """Golden action from the policy itself, marked as such.

    Scores of the same policy against these labels are circular; ``label_source``
    lets an evaluation leave them out.
    """
    kept = df.columns
    labelled = escalate(
        df.withColumn("_confidence", F.lit(lx.DEFAULT_CONFIDENCE)),
        policy, intent="true_intent", confidence="_confidence",
    )
    return labelled.select(
        *kept, F.col("decision").alias("true_escalate"), F.lit("policy").alias("label_source")
    )


def route_language(df: DataFrame, supported: Sequence[str], lang: str = "lang", intent: str = "intent") -> DataFrame:
    """Rows in an unsupported or unknown language get the catch-all intent; no row is dropped."""
    known = F.coalesce(F.col(lang).isin(list(supported)), F.lit(False))
    kept = F.col(intent) if intent in df.columns else F.lit(None).cast("string")
    return df.withColumn(intent, F.when(known, kept).otherwise(lx.OTHER))
