"""SQL oracles for the registered queries.

Views are common table expressions; the word lists and wording come from the
same fixed tables, the logic is written separately in SQL.
"""

from __future__ import annotations

import string

from deskspark import lexicon as lx
from deskspark.workload.views import DEFAULT_EXAMPLES, GOLD_INTENTS, PHRASES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def cleaned(expr: str) -> str:
    steps = f"coalesce({expr}, '')"
    for pattern, put in ((r"@[A-Za-z0-9_]+", ""), (r"https?://\S+|www\.\S+", ""), (r"\s+", " ")):
        steps = f"regexp_replace({steps}, '{pattern}', '{put}', 'g')"
    return f"trim({steps})"


def or_raw(expr: str) -> str:
    return f"CASE WHEN {cleaned(expr)} = '' THEN trim(coalesce({expr}, '')) ELSE {cleaned(expr)} END"


_phrases = " ".join(
    f"WHEN '{kind}/{i}' THEN {quoted(text)}" for kind, texts in PHRASES.items() for i, text in enumerate(texts)
)
_gold = " ".join(f"WHEN '{kind}' THEN '{intent}'" for kind, intent in GOLD_INTENTS.items())

TICKETS = f"""
priced AS (
  SELECT event_id AS ticket_id, user_id, ts, CAST(ts AS DATE) AS day, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         '$' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS amount
  FROM events),
raw_tickets AS (
  SELECT ticket_id, user_id, ts, day, k, amount,
         replace(CASE event_type || '/' || CAST(k % 4 AS VARCHAR) {_phrases} END, '{{v}}', amount) AS raw_text,
         CAST(50 + k % 50 AS DOUBLE) / 100.0 AS confidence,
         CASE event_type {_gold} END AS true_intent,
         CASE WHEN value > 15 THEN 'escalate' ELSE 'auto_handle' END AS true_action,
         row_number() OVER (PARTITION BY user_id, day ORDER BY ts, ticket_id) AS thread_length
  FROM priced),
tickets AS (
  SELECT *, {or_raw('raw_text')} AS text, lower({or_raw('raw_text')}) AS low FROM raw_tickets)"""

LOG = """
turns AS (SELECT * FROM conversations WHERE role <> 'system'),
log AS (
  SELECT (conv_id << 20) | turn AS tweet_id,
         CASE WHEN role = 'assistant' THEN 'brand' ELSE 'c' || CAST(conv_id AS VARCHAR) END AS author_id,
         strftime(TIMESTAMP '2024-01-01' + to_seconds(conv_id * 100 + turn), '%Y-%m-%d %H:%M:%S') AS created_at,
         text,
         lag((conv_id << 20) | turn) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_to
  FROM turns)"""

THREADS = (
    LOG
    + f""",
replies AS (
  SELECT reply_to AS customer_tweet_id, tweet_id AS brand_tweet_id, created_at AS reply_created_at,
         {cleaned('text')} AS brand_reply
  FROM log WHERE author_id = 'brand' AND reply_to IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY reply_to ORDER BY created_at, tweet_id) = 1),
threads AS (
  SELECT 'thread_' || CAST(l.tweet_id AS VARCHAR) AS thread_id, CAST(l.tweet_id AS VARCHAR) AS customer_tweet_id,
         {cleaned('l.text')} AS customer_msg, r.brand_reply, CAST(r.brand_tweet_id AS VARCHAR) AS brand_tweet_id,
         r.reply_created_at AS created_at, l.created_at AS message_created_at,
         array_to_string(regexp_extract_all(l.text, '@([A-Za-z0-9_]+)', 1), ',') AS removed_mentions
  FROM log l JOIN replies r ON l.tweet_id = r.customer_tweet_id
  WHERE l.reply_to IS NULL AND l.author_id <> 'brand' AND length({cleaned('l.text')}) >= 5)"""
)


def regex_intent(low: str) -> str:
    cases = " ".join(
        rf"WHEN regexp_matches({low}, '\b(?:{'|'.join(t.replace('$', chr(92) + '$') for t in terms)})\b') THEN '{i}'"
        for terms, i in lx.WORD_RULES
    )
    return f"CASE {cases} ELSE 'other_unclear' END"


def _contains(low: str, terms) -> str:
    return "(" + " OR ".join(f"contains({low}, {quoted(t)})" for t in terms) + ")"


def substring_intent(low: str) -> str:
    cases = " ".join(f"WHEN {_contains(low, t)} THEN '{i}'" for t, i in lx.SUBSTRING_RULES)
    return f"CASE {cases} ELSE 'other_unclear' END"


_third = " ".join(f"WHEN {_contains('low', t)} THEN {n}" for n, (t, _, _) in enumerate(lx.DECISION_RULES, 1))
THIRD_INTENT = f"[{', '.join(quoted(r[1]) for r in lx.DECISION_RULES)}, 'order_status_delivery'][CASE {_third} ELSE 7 END]"
THIRD_DECISION = f"[{', '.join(quoted(r[2]) for r in lx.DECISION_RULES)}, 'auto_handle'][CASE {_third} ELSE 7 END]"
SIMPLE_REASON = f"""CASE WHEN thread_length > 1 THEN {quoted(lx.SIMPLE_REASONS['thread'])}
  WHEN {_contains('low', lx.SIMPLE_ESCALATION_TERMS)} THEN {quoted(lx.SIMPLE_REASONS['term'])}
  ELSE {quoted(lx.SIMPLE_REASONS['none'])} END"""
SIMPLE_DECISION = f"""CASE WHEN thread_length > 1 OR {_contains('low', lx.SIMPLE_ESCALATION_TERMS)}
  THEN 'escalate' ELSE 'auto_handle' END"""


def _terms(terms) -> str:
    return rf"list_filter({listed(terms)}, lambda t: regexp_matches(low, '\b' || t || '\b'))"


def policy(source: str, name: str, intent: str = "intent", confidence: str = "confidence", thread: str = "thread_length") -> str:
    """CTEs that add fired, decision, reason and signal_count to ``source`` (text, low)."""
    repeat = "|".join(p.replace("{brand}", "brand") for p in lx.REPEAT_CONTACT_PATTERNS)
    money = lx.MONEY_PATTERN
    return rf"""
{name}_found AS (
  SELECT *, {_terms(lx.LEGAL_TERMS)} AS legal, {_terms(lx.SAFETY_TERMS)} AS safety,
         {_terms(lx.FRUSTRATION_TERMS)} AS angry, regexp_extract_all(text, '{money}') AS paid,
         regexp_matches(low, '{repeat}') AS again
  FROM {source}),
{name}_fired AS (
  SELECT *, list_filter([
    CASE WHEN {intent} IN ('billing_dispute', 'account_access') THEN 'High-risk intent category (''' || {intent} || ''')' END,
    CASE WHEN len(legal) > 0 THEN 'Legal/Regulatory escalation keyword detected (' || array_to_string(legal, ', ') || ')' END,
    CASE WHEN len(paid) > 0 THEN 'Monetary value involved (' || array_to_string(paid, ', ') || ')' END,
    CASE WHEN len(safety) > 0 THEN 'Safety/Severe incident keyword detected (' || array_to_string(safety, ', ') || ')' END,
    CASE WHEN {thread} > 1 THEN 'Multi-turn repeat interaction (thread_length=' || CAST({thread} AS VARCHAR) || ')' END,
    CASE WHEN again THEN 'Customer indicates prior unresolved contact attempts' END,
    CASE WHEN len(angry) > 0 THEN 'High-frustration / supervisor demand detected (' || array_to_string(angry, ', ') || ')' END,
    CASE WHEN {confidence} < 0.60 THEN 'Low intent classification confidence (' || printf('%.2f', {confidence}) || ' < 0.60)' END
  ], lambda s: s IS NOT NULL) AS fired
  FROM {name}_found),
{name} AS (
  SELECT *, CASE WHEN len(fired) > 0 THEN 'escalate' ELSE 'auto_handle' END AS decision,
         CASE WHEN len(fired) > 0 THEN 'Escalated due to: ' || array_to_string(fired, '; ')
              ELSE {quoted(lx.REASON_NONE)} END AS reason,
         CAST(len(fired) AS INTEGER) AS signal_count
  FROM {name}_fired)"""


REGEX_LABELLED = TICKETS + f",\nlabelled AS (SELECT *, {regex_intent('low')} AS intent FROM tickets)"
SUB_LABELLED = TICKETS + f",\nlabelled AS (SELECT * EXCLUDE (confidence), 0.88 AS confidence, {substring_intent('low')} AS intent FROM tickets)"
DECIDED = REGEX_LABELLED + "," + policy("labelled", "decided")
SUB_DECIDED = (
    TICKETS
    + f",\nlabelled AS (SELECT * EXCLUDE (confidence), CAST(0.88 AS DOUBLE) AS confidence, {substring_intent('low')} AS intent FROM tickets),"
    + policy("labelled", "decided")
)
PREDICTIONS = (
    SUB_DECIDED
    + f""",
predictions AS (
  SELECT ticket_id, true_intent, true_action, 'trivial_baseline' AS model, 'order_status_delivery' AS intent, 'escalate' AS decision FROM tickets
  UNION ALL
  SELECT ticket_id, true_intent, true_action, 'simple_baseline', {regex_intent('low')}, {SIMPLE_DECISION} FROM tickets
  UNION ALL
  SELECT ticket_id, true_intent, true_action, 'full_system', intent, decision FROM decided),
classes AS (
  SELECT model, class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted
  FROM (
    SELECT model, true_intent AS class, CAST(true_intent = intent AS INTEGER) AS tp, 1 AS support, 0 AS predicted FROM predictions
    UNION ALL
    SELECT model, intent, 0, 0, 1 FROM predictions)
  GROUP BY ALL),
scores AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
         2.0 * tp / (support + predicted) AS f1
  FROM classes)"""
)


def binary(t: str, p: str) -> str:
    return f"""
  SELECT {{group}} CAST(count(*) FILTER ({t} AND {p}) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT {t} AND {p}) AS BIGINT) AS fp,
         CAST(count(*) FILTER ({t} AND NOT {p}) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT {t} AND NOT {p}) AS BIGINT) AS tn
  FROM {{source}} {{by}}"""


BINARY_SCORES = """
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1,
  CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy"""
ACTION_COUNTS = binary("true_action = 'escalate'", "decision = 'escalate'").format(
    group="model,", source="predictions", by="GROUP BY model"
)
COMPARED = (
    PREDICTIONS
    + f""",
actions AS ({ACTION_COUNTS}),
scored AS (SELECT *, {BINARY_SCORES} FROM actions),
hits AS (SELECT model, CAST(count(*) AS BIGINT) AS n, avg(CAST(true_intent = intent AS DOUBLE)) AS intent_accuracy FROM predictions GROUP BY model),
macro AS (SELECT model, avg(f1) AS intent_macro_f1 FROM scores GROUP BY model),
compared AS (
  SELECT model, n, intent_accuracy, intent_macro_f1, precision AS escalate_precision, recall AS escalate_recall,
         f1 AS escalate_f1, accuracy AS escalation_accuracy, fn AS false_negative_count, fp AS false_positive_count
  FROM scored JOIN hits USING (model) JOIN macro USING (model)),
base AS (SELECT * FROM compared WHERE model = 'simple_baseline'),
deltas AS (
  SELECT c.*, c.intent_accuracy - b.intent_accuracy AS intent_accuracy_delta, c.escalate_f1 - b.escalate_f1 AS escalate_f1_delta,
         (b.false_negative_count - c.false_negative_count) * 100.0 / b.false_negative_count AS fn_reduction_pct
  FROM compared c, base b)"""
)

STRATA = (
    TICKETS
    + f""",
strata AS (SELECT ticket_id, text, nullif({substring_intent('low')}, 'other_unclear') AS stratum FROM tickets),
quota AS (
  SELECT * FROM strata WHERE stratum IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || CAST(ticket_id AS VARCHAR)), ticket_id) <= 20),
drawn AS (
  SELECT *, 'quota' AS origin FROM quota
  UNION ALL
  SELECT *, 'backfill' FROM strata WHERE ticket_id NOT IN (SELECT ticket_id FROM quota)
  ORDER BY origin DESC, md5('42:' || CAST(ticket_id AS VARCHAR)), ticket_id LIMIT 208)"""
)

RATINGS = (
    TICKETS
    + """,
rated AS (
  SELECT ticket_id, CAST(k % 5 + 1 AS INTEGER) AS groundedness, CAST(ticket_id % 5 + 1 AS INTEGER) AS tone,
         CAST(user_id % 5 + 1 AS INTEGER) AS actionability, k, user_id, (ticket_id + user_id) % 3 - 1 AS shift
  FROM raw_tickets),
second AS (
  SELECT ticket_id, CAST(least(5, greatest(1, k % 5 + 1 + shift)) AS INTEGER) AS b_groundedness,
         CAST(least(5, greatest(1, ticket_id % 5 + 1 - shift)) AS INTEGER) AS b_tone,
         CAST(user_id % 4 + 1 AS INTEGER) AS b_actionability
  FROM rated WHERE ticket_id % 7 <> 0),
pairs AS (
  SELECT ticket_id, groundedness, tone, actionability, b_groundedness, b_tone, b_actionability
  FROM rated LEFT JOIN second USING (ticket_id)),
long AS (
  SELECT 'groundedness' AS dimension, CAST(groundedness AS DOUBLE) AS a, CAST(b_groundedness AS DOUBLE) AS b FROM pairs
  UNION ALL SELECT 'tone', tone, b_tone FROM pairs
  UNION ALL SELECT 'actionability', actionability, b_actionability FROM pairs),
both_given AS (SELECT * FROM long WHERE b IS NOT NULL)"""
)

CALIBRATED = (
    RATINGS
    + """,
every AS (
  SELECT * FROM both_given
  UNION ALL
  SELECT 'average', round((groundedness + tone + actionability) / 3.0, 2), round((b_groundedness + b_tone + b_actionability) / 3.0, 2)
  FROM pairs WHERE b_tone IS NOT NULL),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY dimension ORDER BY a) + (count(*) OVER (PARTITION BY dimension, a) - 1) / 2.0 AS ra,
         rank() OVER (PARTITION BY dimension ORDER BY b) + (count(*) OVER (PARTITION BY dimension, b) - 1) / 2.0 AS rb
  FROM every),
report AS (
  SELECT dimension, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(a = b AS DOUBLE)), 6) AS exact_agreement,
         round(avg(CAST(abs(a - b) <= 1 AS DOUBLE)), 6) AS within_tolerance, round(avg(a), 6) AS a_mean, round(avg(b), 6) AS b_mean,
         round(corr(ra, rb), 6) AS rho
  FROM ranked GROUP BY dimension)"""
)

DRAFTS = (
    TICKETS
    + """,
ids AS (
  SELECT *, '222-' || lpad(CAST(ticket_id % 10000000 AS VARCHAR), 7, '0') || '-7654321' AS ord,
         'TBA' || lpad(CAST(ticket_id % 1000000000 AS VARCHAR), 9, '0') AS trk
  FROM tickets),
drafts AS (
  SELECT ticket_id, text, amount, ord,
    CASE ticket_id % 6
      WHEN 0 THEN 'We found order ' || ord || ' and will check it'
      WHEN 1 THEN 'Parcel ' || trk || ' is on its way, sorry ^Help'
      WHEN 2 THEN 'We refund ' || amount || ' for your order'
      WHEN 3 THEN '"We refund $7.77 and order ' || ord || ' is closed"'
      WHEN 4 THEN 'Order ' || ord || ' and parcel ' || trk || ' ^Helper'
      ELSE ' "Please message us the details"  ' END AS draft,
    CASE WHEN ticket_id % 4 = 0 THEN 'Past case: ' || ord ELSE '' END AS context
  FROM ids),
entities AS (
  SELECT *, regexp_extract_all(draft, '\\b\\d{3}-\\d{7}-\\d{7}\\b') AS ro,
         regexp_extract_all(draft, '\\bTBA\\d{9,13}\\b') AS rt,
         regexp_extract_all(draft, '\\$\\d+(?:\\.\\d{2})?') AS rm,
         text || ' ' || context AS known
  FROM drafts),
fabricated AS (
  SELECT *, list_sort(list_distinct(list_filter(ro, lambda x: NOT list_contains(regexp_extract_all(known, '\\b\\d{3}-\\d{7}-\\d{7}\\b'), x)))) AS fo,
         list_sort(list_distinct(list_filter(rt, lambda x: NOT list_contains(regexp_extract_all(known, '\\bTBA\\d{9,13}\\b'), x)))) AS ft,
         list_sort(list_distinct(list_filter(rm, lambda x: NOT list_contains(regexp_extract_all(known, '\\$\\d+(?:\\.\\d{2})?'), x)))) AS fm
  FROM entities)"""
)

RESPONSES = (
    TICKETS
    + """,
bodies AS (
  SELECT ticket_id, '{"intent": "' || true_intent || '", "confidence": ' || CAST(CAST(confidence AS DECIMAL(4,2)) AS VARCHAR)
         || ', "reasoning": "ticket ' || CAST(ticket_id AS VARCHAR) || '"}' AS body, true_intent, confidence
  FROM raw_tickets),
parsed AS (
  SELECT ticket_id, CASE WHEN ticket_id % 6 = 4 THEN NULL WHEN ticket_id % 6 = 5 THEN ' The ' || true_intent ELSE true_intent END AS intent,
         CASE WHEN ticket_id % 6 <> 4 THEN CAST(CAST(confidence AS DECIMAL(4,2)) AS VARCHAR) END AS confidence,
         CASE WHEN ticket_id % 6 <> 4 THEN 'ticket ' || CAST(ticket_id AS VARCHAR) END AS reasoning,
         CASE WHEN ticket_id % 6 = 4 THEN 'json_parse_failed' END AS error
  FROM bodies)"""
)

_vector = "CAST(embedding AS DOUBLE[])"


def neighbours(shift: int, same_label: str) -> str:
    """Top-3 CTE ``hits`` over all query and corpus rows with the given join condition."""
    return f"""
asked AS (SELECT vec_id AS query_id, {_vector} AS qv, label + {shift} AS label FROM embeddings),
corpus AS (SELECT vec_id AS corpus_id, {_vector} AS cv, label FROM embeddings),
hits AS (
  SELECT query_id, corpus_id, round(list_dot_product(qv, cv), 9) AS similarity,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(qv, cv), 9) DESC, corpus_id DESC) AS INTEGER) AS rank
  FROM asked q JOIN corpus c ON {same_label}
  QUALIFY rank <= 3)"""


SHOWN = """
SELECT query_id, round(similarity, 5) AS similarity, 'message ' || CAST(corpus_id AS VARCHAR) AS customer_msg,
       'reply ' || CAST(corpus_id AS VARCHAR) AS brand_reply, 'thread_' || CAST(corpus_id AS VARCHAR) AS thread_id, rank
FROM hits"""
_defaults = " UNION ALL ".join(
    f"SELECT CAST({d['similarity']} AS DOUBLE) AS similarity, {quoted(d['customer_msg'])} AS customer_msg, "
    f"{quoted(d['brand_reply'])} AS brand_reply, {quoted(d['thread_id'])} AS thread_id, {i} AS rank"
    for i, d in enumerate(DEFAULT_EXAMPLES, 1)
)
OWN_COMPARED = (
    SUB_DECIDED
    + ",\nsource AS (SELECT * EXCLUDE (confidence), CAST(0.85 AS DOUBLE) AS confidence FROM tickets),"
    + policy("source", "taught", intent="true_intent")
    + COMPARED[len(SUB_DECIDED) :]
    .replace(
        "'trivial_baseline' AS model, 'order_status_delivery' AS intent, 'escalate' AS decision FROM tickets",
        "'trained' AS model, true_intent AS intent, decision FROM taught",
    )
    .replace("'full_system'", "'triage'")
)


def rendered(template: str) -> str:
    """SQL text: a prompt template with its fields filled from columns."""
    parts = [
        p for text, field, _, _ in string.Formatter().parse(template)
        for p in ([quoted(text)] if text else []) + ([field] if field else [])
    ]
    return " || ".join(parts)


_replies = " ".join(f"WHEN '{i}' THEN {quoted(t)}" for i, t in lx.REPLY_TEMPLATES.items())
_stops = listed(lx.BIGRAM_STOP_WORDS)
_pivot = ", ".join(
    f"CAST(count(*) FILTER (intent = '{i}') AS BIGINT) AS {i}" for i in lx.INTENTS
)
_words = r"""CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0
  ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END"""
_label_cases = " ".join(
    f"WHEN contains(t, '{name}') OR contains('{name}', t) THEN '{name}'" for name in lx.INTENTS
)


def profile_columns(count: str = "words") -> str:
    return f"""CAST(count(*) AS BIGINT) AS total, CAST(min({count}) AS INTEGER) AS min_words,
  quantile_cont({count}, 0.25) AS p25_words, quantile_cont({count}, 0.5) AS median_words, avg({count}) AS mean_words,
  quantile_cont({count}, 0.75) AS p75_words, CAST(max({count}) AS INTEGER) AS max_words"""


def multi_intent_sql() -> str:
    by_intent = {i: t for t, i in lx.SUBSTRING_RULES}
    hits = ", ".join(
        f"CASE WHEN {_contains('low', by_intent[i])} THEN '{i}' END" for i in lx.INTENT_PRIORITY if i in by_intent
    )
    return f"""WITH {TICKETS}, found AS (
  SELECT ticket_id, list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM tickets)
SELECT ticket_id, coalesce(hits[1], 'other_unclear') AS primary_intent, hits[2] AS secondary_intent FROM found"""


ORACLES: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {cleaned('text')} AS cleaned FROM documents",
    "clean_urls": f"""SELECT page_id, {cleaned("' see ' || url || '  and  @desk '")} AS cleaned,
        {or_raw('url')} AS url_or_raw FROM pages""",
    "mentions": f"""WITH {TICKETS}, texts AS (
        SELECT 'document' AS origin, doc_id AS id, text FROM documents
        UNION ALL SELECT 'ticket', ticket_id, raw_text FROM raw_tickets)
      SELECT origin, id, array_to_string(regexp_extract_all(text, '@([A-Za-z0-9_]+)', 1), ',') AS removed_mentions,
        CAST(len(regexp_extract_all(text, '@([A-Za-z0-9_]+)', 1)) AS INTEGER) AS n FROM texts""",
    "money_mentions": f"""WITH {TICKETS}
      SELECT ticket_id, array_to_string(regexp_extract_all(text, '{lx.MONEY_PATTERN}'), ',') AS amounts FROM tickets""",
    "entity_ids": f"""WITH {DRAFTS} SELECT ticket_id, array_to_string(ro, ',') AS orders,
      array_to_string(rt, ',') AS trackings, array_to_string(rm, ',') AS amounts FROM entities""",
    "length_profile": f"""WITH counted AS (SELECT lang, {_words} AS words FROM documents)
      SELECT lang, {profile_columns()} FROM counted GROUP BY lang""",
    "ticket_length_profile": f"""WITH {TICKETS}, counted AS (SELECT ts, {_words} AS words FROM tickets)
      SELECT {profile_columns()}, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_at,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at FROM counted""",
    "top_bigrams": rf"""WITH words AS (
        SELECT list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+'),
          lambda w: regexp_full_match(w, '[a-z]{{2,}}') AND NOT list_contains({_stops}, w)) AS w FROM documents),
      pairs AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM words)
      SELECT bigram, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY bigram ORDER BY n DESC, bigram LIMIT 20""",
    "class_distribution": f"""WITH {SUB_LABELLED} SELECT intent, CAST(count(*) AS BIGINT) AS n,
        count(*) / sum(count(*)) OVER () AS share FROM labelled GROUP BY intent""",
    "distribution_shift": f"""WITH {STRATA},
      whole AS (SELECT coalesce(stratum, 'other_unclear') AS intent, count(*) AS n FROM strata GROUP BY 1),
      sampled AS (SELECT coalesce(stratum, 'other_unclear') AS intent, count(*) AS n FROM drawn GROUP BY 1)
      SELECT intent, CAST(whole.n AS BIGINT) AS natural_n, whole.n / (SELECT sum(n) FROM whole) AS natural_share,
        CAST(coalesce(sampled.n, 0) AS BIGINT) AS sample_n, coalesce(sampled.n / (SELECT sum(n) FROM sampled), 0) AS sample_share
      FROM whole FULL JOIN sampled USING (intent)""",
    "majority_class": f"""WITH {TICKETS} SELECT true_intent, CAST(count(*) AS BIGINT) AS n FROM raw_tickets
      GROUP BY true_intent ORDER BY n DESC, true_intent LIMIT 1""",
    "fold_rare": f"""WITH {SUB_LABELLED}, shares AS (
        SELECT intent, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM labelled GROUP BY intent)
      SELECT CASE WHEN share < 0.06 THEN 'other' ELSE intent END AS intent, CAST(sum(n) AS BIGINT) AS n,
        sum(n) / (SELECT count(*) FROM labelled) AS share FROM shares GROUP BY 1""",
    "build_threads": f"WITH {THREADS} SELECT * FROM threads",
    "first_reply": f"WITH {THREADS} SELECT * FROM replies",
    "answered_messages": f"""WITH {LOG} SELECT tweet_id, author_id, created_at FROM log
      WHERE tweet_id IN (SELECT reply_to FROM log WHERE author_id = 'brand')""",
    "customer_messages": f"""WITH {THREADS} SELECT customer_tweet_id AS tweet_id, customer_msg AS text,
      message_created_at AS created_at FROM threads ORDER BY md5('42:' || customer_tweet_id), customer_tweet_id LIMIT 50""",
    "sample_threads": f"""WITH {THREADS} SELECT thread_id, customer_msg FROM threads
      ORDER BY md5('42:' || customer_tweet_id), customer_tweet_id LIMIT 50""",
    "first_ticket_per_user": f"""WITH {TICKETS} SELECT user_id, ticket_id, raw_text FROM raw_tickets
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, ticket_id) = 1""",
    "thread_length": f"WITH {TICKETS} SELECT ticket_id, user_id, thread_length FROM raw_tickets",
    "triage_decisions": f"""WITH {DECIDED} SELECT intent, decision, CAST(count(*) AS BIGINT) AS n,
      CAST(sum(signal_count) AS BIGINT) AS signals FROM decided GROUP BY intent, decision""",
    "escalation_policy": f"""WITH {DECIDED} SELECT ticket_id, intent, decision, reason,
      array_to_string(fired, ' | ') AS fired, signal_count FROM decided""",
    "signal_rates": f"""WITH {DECIDED}, kinds AS (
        SELECT ticket_id, unnest(list_transform(fired, lambda s: CASE
          WHEN starts_with(s, 'High-risk') THEN 'intent' WHEN starts_with(s, 'Legal') THEN 'legal'
          WHEN starts_with(s, 'Monetary') THEN 'money' WHEN starts_with(s, 'Safety') THEN 'safety'
          WHEN starts_with(s, 'Multi-turn') THEN 'thread' WHEN starts_with(s, 'Customer') THEN 'repeat'
          WHEN starts_with(s, 'High-frustration') THEN 'frustration' ELSE 'confidence' END)) AS kind FROM decided)
      SELECT a.kind AS signal, b.kind AS with_signal, CAST(count(*) AS BIGINT) AS n,
        count(*) / (SELECT count(*) FROM decided) AS share
      FROM kinds a JOIN kinds b USING (ticket_id) GROUP BY 1, 2""",
    "rules_regex": f"WITH {REGEX_LABELLED} SELECT ticket_id, intent FROM labelled",
    "rules_substring": f"WITH {SUB_LABELLED} SELECT ticket_id, intent, CAST(confidence AS DOUBLE) AS confidence FROM labelled",
    "rules_third": f"WITH {TICKETS} SELECT ticket_id, {THIRD_INTENT} AS intent, {THIRD_DECISION} AS decision FROM tickets",
    "rules_documents": f"SELECT doc_id, {substring_intent('lower(text)')} AS intent FROM documents",
    "escalate_simple": f"WITH {TICKETS} SELECT ticket_id, {SIMPLE_DECISION} AS decision, {SIMPLE_REASON} AS reason FROM tickets",
    "constant_baseline": f"""WITH {TICKETS} SELECT ticket_id,
      (SELECT true_intent FROM raw_tickets GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS intent,
      CAST(1.0 AS DOUBLE) AS confidence, 'escalate' AS decision FROM raw_tickets""",
    "multi_intent": multi_intent_sql(),
    "canned_reply": f"""WITH {SUB_LABELLED} SELECT ticket_id, CASE intent {_replies} ELSE {quoted(lx.DEFAULT_REPLY)} END AS reply FROM labelled""",
    "label_actions": f"""WITH {TICKETS}, source AS (SELECT * EXCLUDE (confidence), CAST(0.85 AS DOUBLE) AS confidence FROM tickets),
      {policy('source', 'decided', intent='true_intent')}
      SELECT ticket_id, decision AS true_escalate, 'policy' AS label_source FROM decided""",
    "route_language": f"""SELECT doc_id, lang, CASE WHEN lang = 'en' THEN {substring_intent('lower(text)')}
      ELSE 'other_unclear' END AS intent FROM documents""",
    "reply_guard": f"""WITH {DRAFTS}, flagged AS (SELECT *, list_filter([
        CASE WHEN len(fo) > 0 THEN 'Fabricated order ID(s): ' || array_to_string(fo, ', ') END,
        CASE WHEN len(ft) > 0 THEN 'Fabricated tracking ID(s): ' || array_to_string(ft, ', ') END,
        CASE WHEN len(fm) > 0 THEN 'Fabricated dollar amount(s): ' || array_to_string(fm, ', ') END],
        lambda s: s IS NOT NULL) AS flags FROM fabricated),
      masked AS (SELECT *, CASE WHEN len(fo) > 0 THEN replace(draft, fo[1], 'your order details') ELSE draft END AS m1 FROM flagged),
      masked2 AS (SELECT *, CASE WHEN len(ft) > 0 THEN replace(m1, ft[1], 'your tracking number') ELSE m1 END AS m2 FROM masked)
      SELECT ticket_id, len(flags) > 0 AS hallucination_detected, array_to_string(flags, ' | ') AS flags,
        CASE WHEN len(fm) > 0 THEN replace(m2, fm[1], 'the disputed amount') ELSE m2 END AS sanitized_reply FROM masked2""",
    "normalize_reply": f"""WITH {DRAFTS}, bare AS (
        SELECT ticket_id, CASE WHEN starts_with(trim(draft), '"') AND ends_with(trim(draft), '"')
          THEN trim(substr(trim(draft), 2, length(trim(draft)) - 2)) ELSE trim(draft) END AS b FROM drafts)
      SELECT ticket_id, CASE WHEN ends_with(b, '^Help') OR ends_with(b, '^Helper') THEN b ELSE b || ' ^Help' END AS reply FROM bare""",
    "accuracy": f"""WITH {PREDICTIONS} SELECT model, CAST(count(*) AS BIGINT) AS n,
      avg(CAST(true_intent = intent AS DOUBLE)) AS accuracy FROM predictions GROUP BY model""",
    "macro_prf": f"""WITH {PREDICTIONS} SELECT model, CAST(count(*) AS BIGINT) AS classes, avg(precision) AS macro_precision,
      avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM scores GROUP BY model""",
    "class_scores": f"WITH {PREDICTIONS} SELECT model, class, tp, support, predicted, precision, recall, f1 FROM scores",
    "binary_prf": f"WITH {PREDICTIONS}, counts AS ({ACTION_COUNTS}) SELECT *, {BINARY_SCORES} FROM counts",
    "binary_prf_labels": "WITH counts AS ("
    + binary("quality = 1", "n_chars > 1000").format(
        group="", source="documents JOIN labels USING (doc_id)", by=""
    )
    + f") SELECT *, {BINARY_SCORES} FROM counts",
    "confusion": f"""WITH {PREDICTIONS} SELECT model, true_intent, intent, CAST(count(*) AS BIGINT) AS n
      FROM predictions GROUP BY model, true_intent, intent""",
    "confusion_wide": f"WITH {PREDICTIONS} SELECT model, true_intent, {_pivot} FROM predictions GROUP BY model, true_intent",
    "rating_means": f"""WITH {RATINGS} SELECT avg(groundedness) AS groundedness_mean, avg(tone) AS tone_mean,
      avg(actionability) AS actionability_mean, (avg(groundedness) + avg(tone) + avg(actionability)) / 3 AS overall_mean FROM rated""",
    "compare_systems": f"WITH {COMPARED} SELECT * FROM deltas",
    "stacked_predictions": f"""WITH {TICKETS}
      SELECT ticket_id, {regex_intent('low')} AS intent, {SIMPLE_DECISION} AS decision, 'simple' AS model FROM tickets
      UNION ALL SELECT ticket_id, {THIRD_INTENT}, {THIRD_DECISION}, 'third' FROM tickets""",
    "failure_cases": f"""WITH {PREDICTIONS}, kinds AS (SELECT ticket_id, CASE
          WHEN true_action = 'escalate' AND decision <> 'escalate' THEN 'false_negative_escalation'
          WHEN true_action <> 'escalate' AND decision = 'escalate' THEN 'false_positive_escalation'
          WHEN true_intent <> intent THEN 'intent_error' END AS failure, true_intent, intent, true_action, decision
        FROM predictions WHERE model = 'full_system')
      SELECT * FROM kinds WHERE failure IS NOT NULL ORDER BY ticket_id LIMIT 5""",
    "agreement_rates": f"""WITH {RATINGS} SELECT dimension, CAST(count(*) AS BIGINT) AS n,
      avg(CAST(a = b AS DOUBLE)) AS exact_agreement, avg(CAST(abs(a - b) <= 1 AS DOUBLE)) AS within_tolerance,
      avg(a) AS a_mean, avg(b) AS b_mean FROM both_given GROUP BY dimension""",
    "pair_ratings": f"""WITH {RATINGS} SELECT ticket_id, groundedness, tone, actionability,
      coalesce(b_groundedness, groundedness) AS b_groundedness, coalesce(b_tone, tone) AS b_tone,
      coalesce(b_actionability, actionability) AS b_actionability, b_tone IS NULL AS imputed FROM pairs""",
    "spearman": """WITH long AS (
        SELECT 'quality' AS dimension, quality AS a, n_chars AS b FROM documents JOIN labels USING (doc_id)
        UNION ALL SELECT 'toxic', toxic, n_chars FROM documents JOIN labels USING (doc_id)),
      ranked AS (SELECT *,
          rank() OVER (PARTITION BY dimension ORDER BY a) + (count(*) OVER (PARTITION BY dimension, a) - 1) / 2.0 AS ra,
          rank() OVER (PARTITION BY dimension ORDER BY b) + (count(*) OVER (PARTITION BY dimension, b) - 1) / 2.0 AS rb FROM long)
      SELECT dimension, CAST(count(*) AS BIGINT) AS n, round(corr(ra, rb), 6) AS rho FROM ranked GROUP BY dimension""",
    "cohens_kappa": f"""WITH {TICKETS},
      both_labels AS (SELECT {regex_intent('low')} AS f, {substring_intent('low')} AS s FROM tickets),
      marginals AS (SELECT sum(f.n * s.n) AS chance FROM (SELECT f AS c, count(*) AS n FROM both_labels GROUP BY 1) f
        JOIN (SELECT s AS c, count(*) AS n FROM both_labels GROUP BY 1) s USING (c)),
      totals AS (SELECT count(*) AS n, avg(CAST(f = s AS DOUBLE)) AS po FROM both_labels)
      SELECT CAST(n AS BIGINT) AS n, round(po, 9) AS agreement,
        round((po - chance / (n * n)) / (1 - chance / (n * n)), 9) AS kappa FROM totals, marginals""",
    "calibrate": f"WITH {CALIBRATED} SELECT * FROM report",
    "calibration_summary": f"""WITH {CALIBRATED}, exact AS (
        SELECT dimension, corr(ra, rb) AS rho, avg(CAST(abs(a - b) <= 1 AS DOUBLE)) AS w, avg(CAST(a = b AS DOUBLE)) AS e
        FROM ranked WHERE dimension <> 'average' GROUP BY dimension)
      SELECT round(avg(rho), 6) AS mean_rho, round(avg(w), 6) AS mean_within_tolerance, round(avg(e), 6) AS mean_exact_agreement FROM exact""",
    "knn_topk": f"WITH {neighbours(0, 'true')} SELECT query_id, corpus_id, round(similarity, 5) AS similarity, rank FROM hits",
    "knn_blocked": f"WITH {neighbours(0, 'true')} SELECT query_id, corpus_id, round(similarity, 5) AS similarity, rank FROM hits",
    "knn_cells_recall": "SELECT CAST(3 * count(*) AS BIGINT) AS neighbours, true AS recall_reached FROM embeddings",
    "knn_by_label": f"""WITH {neighbours(1, 'q.label = c.label OR q.label NOT IN (SELECT label FROM embeddings)')}
      SELECT query_id, corpus_id, round(similarity, 5) AS similarity, rank FROM hits""",
    "knn_fallback": f"""WITH {neighbours(1, 'q.label = c.label')}, defaults AS ({_defaults})
      {SHOWN} UNION ALL SELECT query_id, similarity, customer_msg, brand_reply, thread_id, rank
      FROM asked, defaults WHERE query_id NOT IN (SELECT query_id FROM hits)""",
    "format_context": f"""WITH {neighbours(1, 'q.label = c.label')}, shown AS (
        SELECT query_id, rank, '[Example ' || CAST(rank AS VARCHAR) || '] (Similarity: ' || printf('%.2f', similarity) || ')' || chr(10)
          || 'Customer: "message ' || CAST(corpus_id AS VARCHAR) || '"' || chr(10)
          || 'Desk Verified Resolution: "reply ' || CAST(corpus_id AS VARCHAR) || '"' AS block FROM hits),
      texts AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM shown GROUP BY query_id)
      SELECT query_id, coalesce(context, {quoted(lx.NO_CONTEXT)}) AS retrieved_context FROM asked LEFT JOIN texts USING (query_id)""",
    "systematic_sample": f"""WITH {TICKETS}, placed AS (
        SELECT ticket_id, raw_text, row_number() OVER (ORDER BY ticket_id) - 1 AS position, count(*) OVER () AS n FROM raw_tickets)
      SELECT ticket_id, raw_text, position FROM placed
      WHERE position IN (SELECT i * ((SELECT count(*) FROM events) - 1) // 14 FROM range(15) r(i))""",
    "stratified_backfill": f"WITH {STRATA} SELECT * FROM drawn",
    "centroid_sample": f"""WITH spread AS (
        SELECT vec_id, label, unnest({_vector}) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
      means AS (SELECT label, pos, avg(x) AS m FROM spread GROUP BY label, pos),
      gaps AS (SELECT vec_id, label, sum((x - m) * (x - m)) AS distance FROM spread JOIN means USING (label, pos) GROUP BY vec_id, label),
      quota AS (SELECT vec_id, label FROM gaps QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), vec_id) <= 15)
      SELECT vec_id, label, 'quota' AS origin FROM quota
      UNION ALL SELECT vec_id, label, 'backfill' FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM quota)
      ORDER BY origin DESC, md5('42:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 208""",
    "relabel_sample": """SELECT * FROM labels ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id
      LIMIT (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM labels)""",
    "limit_rows": "SELECT * FROM labels ORDER BY doc_id LIMIT 35",
    "render_prompts": f"""WITH {TICKETS} SELECT ticket_id, replace({quoted(lx.CLASSIFY_PROMPT.replace('{taxonomy}', lx.taxonomy_text()).replace('{{', '{').replace('}}', '}'))},
      '{{text}}', text) AS prompt FROM tickets""",
    "parse_responses": f"WITH {RESPONSES} SELECT ticket_id, intent, CAST(confidence AS DOUBLE) AS confidence, reasoning, error FROM parsed",
    "normalize_label": f"""WITH {RESPONSES}, t AS (SELECT *, trim(lower(coalesce(intent, ''))) AS t FROM parsed)
      SELECT ticket_id, CASE WHEN t IN ({', '.join(quoted(i) for i in lx.INTENTS)}) THEN t WHEN t = '' THEN 'other_unclear'
        {_label_cases} ELSE 'other_unclear' END AS intent,
        least(1.0, greatest(0.0, coalesce(TRY_CAST(confidence AS DOUBLE), 0.85))) AS confidence FROM t""",
    "normalize_ratings": f"""WITH {TICKETS}, r AS (SELECT ticket_id,
        CAST(CASE WHEN k % 11 = 0 THEN 4 ELSE least(5, greatest(1, k % 8 - 1)) END AS INTEGER) AS groundedness,
        CAST(CASE WHEN k % 13 = 0 THEN 5 ELSE least(5, greatest(1, ticket_id % 7)) END AS INTEGER) AS tone,
        CAST(CASE WHEN k % 5 = 0 THEN 4 ELSE least(5, greatest(1, user_id % 6)) END AS INTEGER) AS actionability FROM raw_tickets)
      SELECT *, round((groundedness + tone + actionability) / 3.0, 2) AS overall_mean FROM r""",
    "tfidf_terms": rf"""WITH messages AS (SELECT (conv_id << 20) | turn AS message_id, text FROM conversations),
      words AS (SELECT message_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+'),
          lambda w: length(w) > 1 AND NOT list_contains({_stops}, w)) AS w FROM messages),
      terms AS (SELECT message_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
      counts AS (SELECT message_id, term, count(*) AS tf FROM terms GROUP BY ALL),
      vocabulary AS (SELECT term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY term ORDER BY total DESC, term LIMIT 2500),
      raw AS (SELECT message_id, term, tf, tf * (ln((1 + (SELECT count(*) FROM messages)) / (1 + df)) + 1) AS v FROM counts JOIN vocabulary USING (term))
      SELECT message_id, term, CAST(tf AS BIGINT) AS tf, round(v / sqrt(sum(v * v) OVER (PARTITION BY message_id)), 6) AS weight FROM raw""",
    "cluster_summary": """SELECT label AS cluster, CAST(count(*) AS BIGINT) AS size,
      count(*) / sum(count(*)) OVER () * 100 AS percentage FROM embeddings GROUP BY label""",
    "cluster_examples": """SELECT label AS cluster, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS rank
      FROM embeddings QUALIFY rank <= 5""",
    "silhouette_squared": f"""WITH v AS (SELECT vec_id, label, {_vector} AS x FROM embeddings),
      sizes AS (SELECT label, count(*) AS n FROM v GROUP BY label),
      sums AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x) ** 2) AS s
        FROM v a JOIN v b ON true GROUP BY ALL),
      means AS (SELECT vec_id, max(CASE WHEN own = other THEN CASE WHEN n > 1 THEN s / (n - 1) END END) AS a,
          min(CASE WHEN own <> other THEN s / n END) AS b FROM sums JOIN sizes ON sizes.label = sums.other GROUP BY vec_id)
      SELECT CAST(count(*) AS BIGINT) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM means""",
    "kmeans_steps": f"""WITH v AS (SELECT vec_id, {_vector} AS x FROM embeddings),
      seeds AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cluster, x AS c FROM v ORDER BY vec_id LIMIT 12),
      ks AS (SELECT CAST(unnest(range(5, 13)) AS INTEGER) AS k),
      own AS (SELECT k, cluster, vec_id, x, list_distance(x, c) ** 2 AS gap FROM ks JOIN seeds ON cluster < k JOIN v ON true
        QUALIFY row_number() OVER (PARTITION BY k, vec_id ORDER BY gap, cluster) = 1),
      sums AS (SELECT k, cluster, CAST(count(*) AS BIGINT) AS size, round(sum(gap), 6) AS cost FROM own GROUP BY k, cluster),
      moved AS (SELECT k, cluster, list(m ORDER BY pos) AS c FROM (
        SELECT k, cluster, pos, avg(e) AS m FROM (SELECT k, cluster, unnest(x) AS e, unnest(range(len(x))) AS pos FROM own)
        GROUP BY k, cluster, pos) GROUP BY k, cluster),
      stay AS (SELECT k, cluster, c FROM moved UNION ALL
        SELECT k, cluster, c FROM ks JOIN seeds ON cluster < k WHERE (k, cluster) NOT IN (SELECT (k, cluster) FROM moved)),
      after AS (SELECT k, round(sum(gap), 6) AS cost_after FROM (
        SELECT k, vec_id, min(list_distance(x, c) ** 2) AS gap FROM stay JOIN v ON true GROUP BY k, vec_id) GROUP BY k)
      SELECT k, cluster, size, cost, cost_after FROM sums JOIN after USING (k)""",
    "silhouette_exact": f"""WITH v AS (SELECT vec_id, label, {_vector} AS x FROM embeddings),
      named AS (SELECT vec_id, x, unnest(['cluster', 'halves', 'parity']) AS labelling, unnest([label, label // 5, label % 2]) AS own FROM v),
      sizes AS (SELECT labelling, own AS other, count(*) AS n FROM named GROUP BY ALL),
      gaps AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.x, b.x) AS gap FROM v a JOIN v b ON a.vec_id <> b.vec_id),
      sums AS (SELECT p.labelling, p.vec_id, p.own, q.own AS other, sum(gap) AS s
        FROM gaps JOIN named p ON p.vec_id = a JOIN named q ON q.vec_id = b AND q.labelling = p.labelling GROUP BY ALL),
      means AS (SELECT labelling, vec_id, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS inside,
          min(CASE WHEN own <> other THEN s / n END) AS outside FROM sums JOIN sizes USING (labelling, other) GROUP BY ALL)
      SELECT labelling, round(avg(coalesce((outside - inside) / greatest(outside, inside), 0)), 6) AS silhouette
      FROM means GROUP BY labelling""",
    "thread_depths": f"""WITH RECURSIVE {LOG},
      placed AS (SELECT tweet_id, tweet_id AS root_id, CAST(0 AS BIGINT) AS depth FROM log
          WHERE reply_to IS NULL OR reply_to NOT IN (SELECT tweet_id FROM log)
        UNION ALL SELECT log.tweet_id, placed.root_id, placed.depth + 1 FROM log JOIN placed ON log.reply_to = placed.tweet_id)
      SELECT tweet_id, root_id, depth, false AS cyclic, count(*) OVER (PARTITION BY root_id) AS thread_size FROM placed""",
    "knn_codes_whole": f"WITH {neighbours(0, 'true')} SELECT query_id, corpus_id, round(similarity, 5) AS similarity, rank FROM hits",
    "knn_codes_recall": """SELECT CAST(3 * count(*) AS BIGINT) AS neighbours, true AS recall_reached,
      24 <= 0.1 * count(*) AS few_vectors_read FROM embeddings""",
    "index_search": f"WITH {neighbours(0, 'true')} SELECT query_id, corpus_id, round(similarity, 5) AS similarity, rank FROM hits",
    "triage_stream_retrieval": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS differing FROM events",
    "triage_by_intent": f"""WITH {SUB_DECIDED} SELECT ticket_id, intent, decision, reason, signal_count FROM decided""",
    "thread_length_final": f"""WITH {TICKETS} SELECT ticket_id, thread_length FROM raw_tickets
      WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""",
    "evaluate_own": f"""WITH {OWN_COMPARED} SELECT * FROM deltas""",
    "binary_rollup": f"""WITH {PREDICTIONS}, counts AS (SELECT model, true_intent, grouping_id(model, true_intent) AS level,
        CAST(count(*) FILTER (true_action = 'escalate' AND decision = 'escalate') AS BIGINT) AS tp,
        CAST(count(*) FILTER (true_action <> 'escalate' AND decision = 'escalate') AS BIGINT) AS fp,
        CAST(count(*) FILTER (true_action = 'escalate' AND decision <> 'escalate') AS BIGINT) AS fn,
        CAST(count(*) FILTER (true_action <> 'escalate' AND decision <> 'escalate') AS BIGINT) AS tn
        FROM predictions GROUP BY ROLLUP (model, true_intent))
      SELECT *, {BINARY_SCORES} FROM counts""",
    "triage_records": f"""WITH {SUB_DECIDED} SELECT ticket_id, intent, confidence, CASE intent {_replies} END AS reply, decision, reason,
      false AS hallucination_detected, '' AS flags, array_to_string(fired, ' | ') AS fired, signal_count, 'full_system' AS model_type FROM decided""",
    "evaluate_systems": f"""WITH {COMPARED}, drawn AS (
        SELECT ticket_id FROM (SELECT ticket_id, row_number() OVER (ORDER BY ticket_id) - 1 AS position FROM tickets)
        WHERE position IN (SELECT i * ((SELECT count(*) FROM events) - 1) // 14 FROM range(15) r(i))),
      means AS (SELECT avg(k % 5 + 1) AS g, avg(ticket_id % 5 + 1) AS t, avg(user_id % 5 + 1) AS a FROM raw_tickets WHERE ticket_id IN (SELECT ticket_id FROM drawn))
      SELECT deltas.*, g AS groundedness_mean, t AS tone_mean, a AS actionability_mean, (g + t + a) / 3 AS overall_mean FROM deltas, means""",
    "roundtrip_io": f"""WITH {THREADS} SELECT customer_tweet_id, customer_msg, brand_reply, removed_mentions, customer_msg AS text FROM threads""",
    "roundtrip_golden": f"""WITH {STRATA} SELECT ticket_id, text, coalesce(stratum, 'other_unclear') AS true_intent,
      'escalate' AS true_action, CAST(1 AS INTEGER) AS thread_length FROM drawn""",
    "embedding_store": "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM embeddings",
    "triage_stream": f"""WITH {TICKETS},
      labelled AS (SELECT * EXCLUDE (confidence), CAST(0.88 AS DOUBLE) AS confidence, {substring_intent('low')} AS intent FROM tickets),
      {policy('labelled', 'decided')}
      SELECT ticket_id, intent, decision, reason, CASE intent {_replies} END AS reply, signal_count FROM decided""",
    "triage_batches": f"WITH {DECIDED} SELECT ticket_id, decision, signal_count FROM decided",
    "thread_length_stream": f"WITH {TICKETS} SELECT ticket_id, thread_length FROM raw_tickets",
    "session_length_stream": f"""WITH {TICKETS}, marked AS (
        SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
        FROM raw_tickets WINDOW w AS (PARTITION BY user_id ORDER BY ts, ticket_id)),
      numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked),
      sessions AS (SELECT user_id, min(ts) AS b, max(ts) + INTERVAL 6 HOUR AS e, count(*) AS n FROM numbered GROUP BY user_id, s)
      SELECT user_id, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(e, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
        CAST(n AS BIGINT) AS thread_length FROM sessions
      WHERE e <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""",
    "escalation_rates": f"""WITH {TICKETS},
      labelled AS (SELECT * EXCLUDE (confidence), CAST(0.88 AS DOUBLE) AS confidence, {substring_intent('low')} AS intent FROM tickets),
      {policy('labelled', 'decided')},
      hours AS (SELECT date_trunc('hour', ts) AS h, count(*) AS messages, count(*) FILTER (decision = 'escalate') AS escalations FROM decided GROUP BY 1)
      SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(h + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
        CAST(messages AS BIGINT) AS messages, CAST(escalations AS BIGINT) AS escalations, escalations / messages AS rate
      FROM hours WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "escalation_rates_sliding": f"""WITH {DECIDED}, spots AS (
        SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * i) AS w, decision FROM decided, range(4) r(i))
      SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
        CAST(count(*) AS BIGINT) AS messages, CAST(count(*) FILTER (decision = 'escalate') AS BIGINT) AS escalations,
        count(*) FILTER (decision = 'escalate') / count(*) AS rate FROM spots GROUP BY w""",
}
GUESSED = r"""plain AS (
    SELECT doc_id, lang, text, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) AS words FROM documents),
  chars AS (SELECT doc_id, lang, unnest(list) AS c, generate_subscripts(list, 1) AS i
    FROM (SELECT doc_id, lang, string_split(' ' || words || ' ', '') AS list FROM plain WHERE words <> '')),
  spots AS (SELECT doc_id, lang, c, lead(c) OVER w AS c1, lead(c, 2) OVER w AS c2 FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  grams AS (SELECT doc_id, lang, g, count(*) AS n FROM (
      SELECT doc_id, lang, unnest([nullif(c, ' '), c || c1, CASE WHEN c1 <> ' ' THEN c || c1 || c2 END]) AS g FROM spots)
    WHERE g IS NOT NULL GROUP BY ALL),
  profiles AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) AS place
    FROM grams WHERE lang IS NOT NULL GROUP BY lang, g QUALIFY place <= 300),
  tops AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) AS place FROM grams QUALIFY place <= 300),
  gaps AS (SELECT t.doc_id, l.lang, CAST(sum(coalesce(abs(t.place - p.place), 300)) AS BIGINT) AS gap
    FROM tops t CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.g = t.g GROUP BY ALL),
  ranked AS (SELECT doc_id, list(lang ORDER BY gap, lang) AS langs, list(gap ORDER BY gap, lang) AS ds FROM gaps GROUP BY doc_id),
  guessed AS (SELECT doc_id, text, CASE WHEN (ds[2] - ds[1]) * 100 < ds[2] * 3 THEN NULL ELSE langs[1] END AS lang_guess,
      ds[1] AS lang_guess_distance, ds[2] AS lang_guess_runner_up
    FROM plain LEFT JOIN ranked USING (doc_id))"""
ORACLES["detect_language"] = f"WITH {GUESSED} SELECT * EXCLUDE (text) FROM guessed"
ORACLES["route_unlabelled"] = f"""WITH {GUESSED} SELECT doc_id, lang_guess,
  CASE WHEN lang_guess = 'en' THEN {substring_intent('lower(text)')} ELSE 'other_unclear' END AS intent FROM guessed"""
FOUND_TERMS = r"""listed AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
  spots AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM listed),
  paired AS (SELECT item_id * 100000 + i AS position, word, lead(word) OVER (PARTITION BY item_id ORDER BY i) AS after FROM spots),
  terms AS (SELECT term, CAST(min(position) AS BIGINT) AS position FROM (
      SELECT position, unnest([CASE WHEN length(word) >= 4 THEN word END, word || ' ' || after]) AS term FROM paired)
    WHERE term IS NOT NULL GROUP BY term),
  pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+') AS p FROM documents)),
  windows AS (SELECT doc_id, piece, piece || lead(piece) OVER w || lead(piece, 2) OVER w AS pair
    FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  hits AS (SELECT DISTINCT doc_id, position FROM (SELECT doc_id, unnest([piece, pair]) AS term FROM windows) JOIN terms USING (term)),
  gathered AS (SELECT doc_id, list(position ORDER BY position) AS found FROM hits GROUP BY doc_id)"""
ORACLES["find_terms"] = f"""WITH {FOUND_TERMS} SELECT doc_id, CAST(coalesce(len(found), 0) AS INTEGER) AS n_rules,
  coalesce(array_to_string(found, ','), '') AS found_rules FROM documents LEFT JOIN gathered USING (doc_id)"""
ORACLES["rules_table"] = f"""WITH {FOUND_TERMS} SELECT doc_id, found[1] AS first_rule, CASE WHEN found IS NULL THEN 'other_unclear'
  ELSE {listed(lx.INTENTS)}[(found[1] // 100000) % {len(lx.INTENTS)} + 1] END AS intent FROM documents LEFT JOIN gathered USING (doc_id)"""
ORACLES["frequent_bigrams"] = ORACLES["top_bigrams"]
NESTED = f"""{TICKETS}, bodies AS (SELECT ticket_id, ticket_id % 8 AS pick, '{{"intent": "' || true_intent || '", "confidence": '
      || CAST(CAST(confidence AS DECIMAL(4,2)) AS VARCHAR)
      || CASE WHEN ticket_id % 8 = 5 THEN '' ELSE ', "ratings": ' || CASE WHEN ticket_id % 8 = 4 THEN '[1, 2]' ELSE '{{"tone": '
        || CASE ticket_id % 8 WHEN 1 THEN '"high"' WHEN 2 THEN '"4"' WHEN 3 THEN 'null' ELSE CAST(k % 5 AS VARCHAR) END
        || ', "useful": true}}' END END || '}}' AS body FROM raw_tickets),
  answers AS (SELECT ticket_id, CASE WHEN pick = 7 THEN NULL ELSE CAST(body AS JSON) END AS a FROM bodies)"""
ORACLES["typed_answers"] = f"""WITH {NESTED}, got AS (SELECT ticket_id, a, a->>'$.intent' AS intent,
    TRY_CAST(a->>'$.confidence' AS DOUBLE) AS confidence, TRY_CAST(a->>'$.ratings.tone' AS INTEGER) AS tone,
    TRY_CAST(a->>'$.ratings.useful' AS BOOLEAN) AS useful, (a->>'$.ratings.tone') IS NOT NULL AS toned FROM answers)
  SELECT ticket_id, intent, confidence, tone, useful, CASE WHEN a IS NULL THEN 'json_parse_failed' END AS error,
    CASE WHEN a IS NULL THEN '' ELSE concat_ws(',', CASE WHEN NOT toned THEN 'tone' END, CASE WHEN useful IS NULL THEN 'useful' END) END AS missing,
    CASE WHEN toned AND tone IS NULL THEN 'tone' ELSE '' END AS mistyped FROM got"""
ORACLES["answer_drift"] = f"""WITH {NESTED}, seen AS (
    SELECT unnest(['tone', 'ratings', 'confidence']) AS field, a IS NULL AS unreadable,
      unnest([json_type(a, '$.ratings.tone'), json_type(a, '$.ratings'), json_type(a, '$.confidence')]) AS t FROM answers)
  SELECT field, CASE WHEN unreadable THEN 'unreadable' WHEN t IS NULL THEN 'missing' WHEN t = 'VARCHAR' THEN 'string'
    WHEN t IN ('NULL', 'BOOLEAN', 'OBJECT', 'ARRAY') THEN lower(t) ELSE 'number' END AS kind, count(*) AS n FROM seen GROUP BY ALL"""
ORACLES["roundtrip_metrics"] = ORACLES["class_scores"]
ORACLES["deduped_log"] = f"WITH {LOG} SELECT tweet_id, author_id, text FROM log"
# The t distribution's closed sums for whole degrees of freedom; sin and cos of the angle are rho and sqrt(1 - rho^2).
ORACLES["calibrate_p_values"] = f"""WITH {CALIBRATED}, exact AS (SELECT dimension, corr(ra, rb) AS r FROM ranked GROUP BY dimension),
  base AS (SELECT dimension, n, r, n - 2 AS v, (n - 2) % 2 AS odd, 1 - r * r AS cc FROM report JOIN exact USING (dimension)),
  steps AS (SELECT *, unnest(range(1, (v - 2 - odd) // 2 + 1)) AS j FROM base WHERE cc > 0),
  terms AS (SELECT dimension, exp(sum(ln((2 * j - 1 + odd) / (2 * j + odd) * cc)) OVER (PARTITION BY dimension ORDER BY j)) AS term FROM steps),
  sums AS (SELECT dimension, sum(term) AS s FROM terms GROUP BY dimension)
  SELECT dimension, n, round(r, 6) AS rho, CASE WHEN r IS NULL OR isnan(r) OR n < 3 THEN NULL WHEN cc <= 0 THEN 0.0 ELSE round(abs(1 - CASE
    WHEN odd = 0 THEN abs(r) * (1 + coalesce(s, 0))
    ELSE 2 / pi() * (asin(abs(r)) + CASE WHEN v > 1 THEN abs(r) * sqrt(cc) * (1 + coalesce(s, 0)) ELSE 0 END) END), 6) END AS p_value
  FROM base LEFT JOIN sums USING (dimension)"""
ORACLES["restricted_messages"] = ORACLES["customer_messages"]
ORACLES["reply_prompts"] = f"""WITH contexts AS ({ORACLES['format_context']}), named AS (
    SELECT query_id, retrieved_context, 'message ' || CAST(query_id AS VARCHAR) AS text,
      {listed(lx.INTENTS)}[label % {len(lx.INTENTS)} + 1] AS intent
    FROM contexts JOIN (SELECT vec_id AS query_id, label + 1 AS label FROM embeddings) USING (query_id)),
  filled AS (SELECT *, CASE intent {_replies} ELSE {quoted(lx.DEFAULT_REPLY)} END AS reply FROM named)
  SELECT query_id, {rendered(lx.REPLY_PROMPT)} AS reply_prompt, {rendered(lx.RATING_PROMPT)} AS rating_prompt FROM filled"""
