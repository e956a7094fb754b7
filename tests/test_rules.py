import pytest
from pyspark.sql import functions as F

from deskspark import lexicon as lx
from deskspark.operators import guard, rules
from deskspark.workload.views import PHRASES

# (event type, variant) -> regex intent, substring intent, text and intent signals
EXPECTED = {
    ("error", 0): ("app_website_bug", "other_unclear", ""),
    ("error", 1): ("app_website_bug", "app_website_bug", ""),
    ("error", 2): ("app_website_bug", "other_unclear", "frustration"),
    ("error", 3): ("other_unclear", "app_website_bug", ""),
    ("purchase", 0): ("billing_dispute", "billing_dispute", "intent money"),
    ("purchase", 1): ("billing_dispute", "billing_dispute", "intent legal money"),
    ("purchase", 2): ("billing_dispute", "billing_dispute", "intent legal money"),
    ("purchase", 3): ("other_unclear", "billing_dispute", "intent money repeat"),
    ("view", 0): ("order_status_delivery", "order_status_delivery", ""),
    ("view", 1): ("order_status_delivery", "order_status_delivery", "repeat"),
    ("view", 2): ("order_status_delivery", "order_status_delivery", "safety"),
    ("view", 3): ("order_status_delivery", "order_status_delivery", ""),
    ("click", 0): ("refund_return", "refund_return", ""),
    ("click", 1): ("refund_return", "billing_dispute", "intent money"),
    ("click", 2): ("cancellation", "cancellation", ""),
    ("click", 3): ("product_issue", "product_issue", "frustration"),
    ("signup", 0): ("account_access", "account_access", "intent"),
    ("signup", 1): ("account_access", "account_access", "intent"),
    ("signup", 2): ("general_complaint_vent", "general_complaint_vent", ""),
    ("signup", 3): ("other_unclear", "other_unclear", ""),
}


def kinds(signals):
    heads = {kind: fmt.split("(")[0] for kind, fmt in lx.SIGNAL_FORMATS.items()}
    return " ".join(next(k for k, h in heads.items() if s.startswith(h)) for s in signals)


def test_fixture_labels(spark):
    rows = [
        (kind, i, text.replace("{v}", "$12.50"), 1) for kind, texts in PHRASES.items() for i, text in enumerate(texts)
    ]
    df = spark.createDataFrame(rows, "kind string, variant int, text string, thread_length int")
    both = rules.rules_substring(rules.rules_regex(df, intent="by_regex"))
    got = {
        (r["kind"], r["variant"]): (r["by_regex"], r["intent"], kinds(r["fired_signals"]))
        for r in rules.escalate(both).collect()
    }
    assert got == EXPECTED


# (text, intent, confidence, thread length), decision, signals.
CASES = [
    (
        ("I will sue, my LAWYER and the BBB know. $5 or $7.25!", "billing_dispute", 0.59, 3),
        "escalate",
        [
            "High-risk intent category ('billing_dispute')",
            "Legal/Regulatory escalation keyword detected (lawyer, bbb, sue)",
            "Monetary value involved ($5, $7.25)",
            "Multi-turn repeat interaction (thread_length=3)",
            "Low intent classification confidence (0.59 < 0.60)",
        ],
    ),
    (("an issue with the suede coat", "product_issue", 0.60, 1), "auto_handle", []),
    (
        ("contacted support 3 times, promised a call two days ago", "other_unclear", 0.9, 1),
        "escalate",
        ["Customer indicates prior unresolved contact attempts"],
    ),
    (
        ("broken glass, leaked, empty box; worst customer service", "product_issue", 0.5, 2),
        "escalate",
        [
            "Safety/Severe incident keyword detected (broken glass, leaked, empty box)",
            "Multi-turn repeat interaction (thread_length=2)",
            "High-frustration / supervisor demand detected (worst customer service)",
            "Low intent classification confidence (0.50 < 0.60)",
        ],
    ),
    (
        ("it's the manager's fault. It is unacceptable", "account_access", 0.61, 1),
        "escalate",
        [
            "High-risk intent category ('account_access')",
            "High-frustration / supervisor demand detected (manager, unacceptable)",
        ],
    ),
    (
        ("third time this happened multiple times", "cancellation", 0.1, 1),
        "escalate",
        [
            "Customer indicates prior unresolved contact attempts",
            "Low intent classification confidence (0.10 < 0.60)",
        ],
    ),
    (("", "other_unclear", 0.85, 1), "auto_handle", []),
    (
        ("é lawyeré lawyer’s", "other_unclear", 0.85, 1),
        "escalate",
        ["Legal/Regulatory escalation keyword detected (lawyer)"],
    ),
]


def test_policy_cases(spark):
    df = spark.createDataFrame(
        [(i, *c) for i, (c, _, _) in enumerate(CASES)],
        "i int, text string, intent string, confidence double, thread_length int",
    )
    for row, (_, decision, signals) in zip(rules.escalate(df).orderBy("i").collect(), CASES):
        reason = lx.REASON_PREFIX + "; ".join(signals) if signals else lx.REASON_NONE
        assert (row["decision"], row["reason"], row["fired_signals"]) == (decision, reason, signals)
        assert row["signal_count"] == len(signals)


def test_dollar_needs_word_characters_around(spark):
    df = spark.createDataFrame([("double $5",), ("a$b",)], "text string")
    assert [r["intent"] for r in rules.rules_regex(df).collect()] == ["other_unclear", "billing_dispute"]


def test_substring_rules_fire_inside_words(spark):
    df = spark.createDataFrame([("see you later",), ("discard it",)], "text string")
    assert [r["intent"] for r in rules.rules_substring(df).collect()] == ["order_status_delivery", "billing_dispute"]


def test_regex_mode_takes_patterns(spark):
    df = spark.createDataFrame([("Ab12",), ("x",)], "text string")
    got = rules.classify_rules(df, [(r"b\d+", "hit")], "regex", default="miss").collect()
    assert [r["intent"] for r in got] == ["hit", "miss"]


def test_filters_stop_above_the_searches(spark):
    df = spark.createDataFrame([("hello",)], "text string")
    plan = rules.rules_regex(df).where("intent = 'cancellation'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == len(lx.WORD_RULES)


def test_multi_intent_priority(spark):
    df = spark.createDataFrame([("my card was charged, I forgot my password and want a refund",), ("hm",)], "text string")
    got = [(r["primary_intent"], r["secondary_intent"]) for r in rules.multi_intent(df).collect()]
    assert got == [("billing_dispute", "account_access"), ("other_unclear", None)]


def test_simple_escalation_reads_sue_in_issue(spark):
    df = spark.createDataFrame([("an issue", 1), ("fine", 2), ("fine", 1)], "text string, thread_length int")
    got = [(r["decision"], r["reason"]) for r in rules.escalate_simple(df).collect()]
    assert [d for d, _ in got] == ["escalate", "escalate", "auto_handle"]
    assert [r for _, r in got] == [lx.SIMPLE_REASONS[k] for k in ("term", "thread", "none")]


def test_route_language_drops_nothing(spark):
    df = spark.createDataFrame([("en", "a"), ("xx", "b"), (None, "c")], "lang string, intent string")
    assert [r["intent"] for r in rules.route_language(df, ["en"]).collect()] == ["a", "other_unclear", "other_unclear"]


def test_signal_rates(spark):
    df = spark.createDataFrame([c for c, _, _ in CASES], "text string, intent string, confidence double, thread_length int")
    got = {(r["signal"], r["with_signal"]): r["n"] for r in rules.signal_rates(rules.escalate(df)).collect()}
    want = {}
    for _, _, signals in CASES:
        fired = kinds(signals).split()
        for a in fired:
            for b in fired:
                want[a, b] = want.get((a, b), 0) + 1
    assert got == want


@pytest.mark.parametrize(
    "reply, message, context, flags, clean",
    [
        ("pay $5 and $50", "$50", "", ["Fabricated dollar amount(s): $5"], "pay the disputed amount and $50"),
        ("$5.25 or $5", "$5.25", "", ["Fabricated dollar amount(s): $5"], "$5.25 or the disputed amount"),
        ("order 111-2223334-5556667", "", "about 111-2223334-5556667", [], "order 111-2223334-5556667"),
        (
            "TBA123456789 for 111-2223334-5556667, $3",
            "hi",
            None,
            [
                "Fabricated order ID(s): 111-2223334-5556667",
                "Fabricated tracking ID(s): TBA123456789",
                "Fabricated dollar amount(s): $3",
            ],
            "your tracking number for your order details, the disputed amount",
        ),
        (None, "x", "y", [], ""),
    ],
)
def test_guard(spark, reply, message, context, flags, clean):
    df = spark.createDataFrame([(reply, message, context)], "reply string, text string, context string")
    row = guard.guard_reply(df).first()
    assert (row["hallucination_flags"], row["sanitized_reply"]) == (flags, clean)
    assert row["hallucination_detected"] == bool(flags)
    again = guard.guard_reply(spark.createDataFrame([(clean, message, context)], df.schema)).first()
    assert not again["hallucination_detected"]


def test_permuted_partitions_agree(spark):
    df = spark.createDataFrame([(i, *CASES[i % len(CASES)][0]) for i in range(200)], "i int, text string, intent string, confidence double, thread_length int")
    one = {r["i"]: r["reason"] for r in rules.escalate(df.coalesce(1)).collect()}
    many = {r["i"]: r["reason"] for r in rules.escalate(df.repartition(7, F.rand(1))).collect()}
    assert one == many
