"""Views that shape the driver tables into messages, threads and ratings.

Each view is lazy and reads whole tables; ``oracle.py`` holds the same views as
SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.functions.sql import literal, literals, lookup
from deskspark.functions.text import clean_or_raw
from deskspark.operators.threads import thread_length
from deskspark.sources.tables import load

BRAND = "brand"

# Ticket wording by (event_type, k % 4); {v} is the row's amount.
PHRASES = {
    "error": [
        "The app shows a glitch at checkout, please look into it",
        "Your website lost my cart again and again @desk",
        "Error 500 on every page, this is unacceptable",
        "Page not loading since morning https://t.example/x1",
    ],
    "purchase": [
        "My card was charged {v} twice for one purchase",
        "I was billed {v} by mistake, my lawyer will hear of this",
        "Unknown payment of {v} on my bank statement, looks like fraud",
        "Why did I pay {v}, I already called about it",
    ],
    "view": [
        "Where is my parcel, tracking shows nothing new",
        "The delivery is late for the third time",
        "My package was stolen from the porch",
        "Is my shipment delayed @desk @ops",
    ],
    "click": [
        "How do I return this jacket",
        "Still no refund of {v} after two weeks",
        "I want to cancel order 111-2223334-5556667",
        "The mug came broken, I ask for a supervisor",
    ],
    "signup": [
        "I am locked and the password reset fails",
        "Login code never comes, otp is useless",
        "This is the worst desk ever",
        "hello there",
    ],
}

GOLD_INTENTS = {
    "error": "app_website_bug",
    "purchase": "billing_dispute",
    "view": "order_status_delivery",
    "click": "refund_return",
    "signup": "account_access",
}


def _phrase() -> str:
    """SQL text: the wording for the row's event type and k, with the amount filled in."""
    texts = ", ".join(f"{literal(kind)}, array({literals(texts)})" for kind, texts in PHRASES.items())
    return f"replace(get(try_element_at(map({texts}), event_type), pmod(k, 4)), '{{v}}', amount)"


def tickets_of(events: DataFrame, sequenced: bool = False) -> DataFrame:
    """One support message per event; ``sequenced`` adds the running thread length."""
    named = events.selectExpr(
        "event_id AS ticket_id",
        "user_id",
        "timestamp(ts) AS ts",
        "date(ts) AS day",
        "event_type",
        "value",
        "try_cast(get_json_object(props, '$.k') AS int) AS k",
    )
    if sequenced:
        named = thread_length(named, ["user_id", "day"], "ts", ["ts", "ticket_id"])
    priced = named.withColumn("amount", F.expr("concat('$', string(cast(value AS decimal(18,2))))"))
    return priced.selectExpr(
        "ticket_id",
        "user_id",
        "ts",
        "day",
        "k",
        "amount",
        f"{_phrase()} AS raw_text",
        "double(pmod(k, 50) + 50) / 100D AS confidence",
        f"{lookup(GOLD_INTENTS, 'event_type')} AS true_intent",
        "CASE WHEN value > 15 THEN 'escalate' ELSE 'auto_handle' END AS true_action",
        *(["thread_length"] if sequenced else []),
    )


def raw_tickets(spark: SparkSession, sf: str, sequenced: bool = True) -> DataFrame:
    return tickets_of(load(spark, sf, "events"), sequenced)


def tickets(spark: SparkSession, sf: str, sequenced: bool = True) -> DataFrame:
    """Tickets with cleaned text."""
    return raw_tickets(spark, sf, sequenced).withColumn("text", clean_or_raw(F.col("raw_text")))


def message_id() -> Column:
    """Unique for conversations of up to 2**20 turns."""
    return F.shiftleft("conv_id", 20).bitwiseOR(F.col("turn"))


def message_log(spark: SparkSession, sf: str) -> DataFrame:
    """Flat reply-pointer log over conversations, system turns dropped.

    Turn numbers within a conversation are dense, so a row points at the
    previous turn's id; the first user turn points nowhere.
    """
    turns = load(spark, sf, "conversations").where(F.col("role") != "system")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    tweet_id = message_id()
    spoken = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 100 + F.col("turn"))
    return turns.join(first, "conv_id").select(
        tweet_id.alias("tweet_id"),
        F.when(F.col("role") == "assistant", BRAND)
        .otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
        .alias("author_id"),
        F.date_format(spoken, "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "text",
        F.when(F.col("turn") > F.col("first_turn"), (tweet_id - 1).cast("string")).alias(
            "in_response_to_tweet_id"
        ),
    )


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    """A drafted reply and its context per ticket; some drafts hold identifiers found nowhere else."""
    pad = F.lpad((F.col("ticket_id") % 10000000).cast("string"), 7, "0")
    order = F.concat(F.lit("222-"), pad, F.lit("-7654321"))
    track = F.concat(F.lit("TBA"), F.lpad((F.col("ticket_id") % 1000000000).cast("string"), 9, "0"))
    variant = F.pmod("ticket_id", F.lit(6))
    reply = (
        F.when(variant == 0, F.concat(F.lit("We found order "), order, F.lit(" and will check it")))
        .when(variant == 1, F.concat(F.lit("Parcel "), track, F.lit(" is on its way, sorry ^Help")))
        .when(variant == 2, F.concat(F.lit("We refund "), F.col("amount"), F.lit(" for your order")))
        .when(variant == 3, F.concat(F.lit('"We refund $7.77 and order '), order, F.lit(' is closed"')))
        .when(variant == 4, F.concat(F.lit("Order "), order, F.lit(" and parcel "), track, F.lit(" ^Helper")))
        .otherwise(F.lit(' "Please message us the details"  '))
    )
    context = F.when(F.pmod("ticket_id", F.lit(4)) == 0, F.concat(F.lit("Past case: "), order)).otherwise("")
    return tickets(spark, sf, sequenced=False).select(
        "ticket_id", "text", "amount", reply.alias("draft"), context.alias("context")
    )


def ratings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two raters' 1..5 scores per ticket, derived from events; rater B skipped some tickets."""
    base = raw_tickets(spark, sf, sequenced=False)
    a = base.select(
        "ticket_id",
        (F.pmod("k", F.lit(5)) + 1).cast("int").alias("groundedness"),
        (F.pmod("ticket_id", F.lit(5)) + 1).cast("int").alias("tone"),
        (F.pmod("user_id", F.lit(5)) + 1).cast("int").alias("actionability"),
    )
    shift = F.pmod(F.col("ticket_id") + F.col("user_id"), F.lit(3)) - 1
    b = base.where(F.pmod("ticket_id", F.lit(7)) != 0).select(
        "ticket_id",
        F.least(F.lit(5), F.greatest(F.lit(1), F.pmod("k", F.lit(5)) + 1 + shift)).cast("int").alias("groundedness"),
        F.least(F.lit(5), F.greatest(F.lit(1), F.pmod("ticket_id", F.lit(5)) + 1 - shift)).cast("int").alias("tone"),
        (F.pmod("user_id", F.lit(4)) + 1).cast("int").alias("actionability"),
    )
    return a, b


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Raw answers of a labelling service, well formed or not, one per ticket."""
    body = F.concat(
        F.lit('{"intent": "'), F.col("true_intent"), F.lit('", "confidence": '),
        F.col("confidence").cast("decimal(4,2)").cast("string"), F.lit(', "reasoning": "ticket '),
        F.col("ticket_id").cast("string"), F.lit('"}'),
    )
    variant = F.pmod("ticket_id", F.lit(6))
    raw = (
        F.when(variant == 0, body)
        .when(variant == 1, F.concat(F.lit("<think>maybe\nbilling</think>\n"), body))
        .when(variant == 2, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone")))
        .when(variant == 3, F.concat(F.lit("I think "), body, F.lit(" fits")))
        .when(variant == 4, F.lit("cannot tell"))
        .otherwise(F.replace(body, F.lit('"intent": "'), F.lit('"intent": " The ')))
    )
    return raw_tickets(spark, sf, sequenced=False).select("ticket_id", raw.alias("raw"))


def nested_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Raw answers with nested fields whose types drift, one per ticket."""
    pick = F.pmod("ticket_id", F.lit(8))
    tone = F.when(pick == 1, '"high"').when(pick == 2, '"4"').when(pick == 3, "null").otherwise(F.pmod("k", F.lit(5)).cast("string"))
    ratings = F.when(pick == 4, "[1, 2]").otherwise(F.concat(F.lit('{"tone": '), tone, F.lit(', "useful": true}')))
    body = F.concat(
        F.lit('{"intent": "'), F.col("true_intent"), F.lit('", "confidence": '),
        F.col("confidence").cast("decimal(4,2)").cast("string"),
        F.when(pick == 5, "").otherwise(F.concat(F.lit(', "ratings": '), ratings)), F.lit("}"),
    )
    raw = (
        F.when(pick == 6, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```")))
        .when(pick == 7, F.substring(body, 1, 20))
        .otherwise(body)
    )
    return raw_tickets(spark, sf, sequenced=False).select("ticket_id", raw.alias("raw"))


# Shown to a query without similar messages: invented exchanges, least certain last.
DEFAULT_EXAMPLES = [
    {"similarity": 0.40, "customer_msg": "the lamp I bought flickers", "brand_reply": "Try another bulb first. ^Help",
     "thread_id": "default-a"},
    {"similarity": 0.30, "customer_msg": "can I change my seat", "brand_reply": "Yes, under your booking. ^Help",
     "thread_id": "default-b"},
    {"similarity": 0.20, "customer_msg": "the page will not print", "brand_reply": "Which browser is it? ^Help",
     "thread_id": "default-c"},
]
