"""Thread reconstruction from a flat message log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.functions.text import as_id, clean_text, mentions
from deskspark.operators.grouped import first_per_key, running_count
from deskspark.sources.scratch import freeze

MIN_LENGTH = 5


def brand_replies(messages: DataFrame, brand: str) -> DataFrame:
    """Messages by the brand that point at another message; bad pointers are skipped."""
    pointer = as_id(F.col("in_response_to_tweet_id"))
    return messages.where((F.col("author_id") == brand) & pointer.isNotNull()).withColumn(
        "in_response_to_tweet_id", pointer
    )


def first_reply(messages: DataFrame, brand: str) -> DataFrame:
    """The earliest brand reply per answered message, by (created_at, tweet_id)."""
    replies = brand_replies(messages, brand).select(
        F.col("in_response_to_tweet_id").alias("customer_tweet_id"),
        as_id(F.col("tweet_id")).alias("brand_tweet_id"),
        F.col("created_at").alias("reply_created_at"),
        F.col("text").alias("brand_reply"),
    )
    return first_per_key(
        replies, "customer_tweet_id", ["reply_created_at", "brand_tweet_id"]
    ).withColumn("brand_reply", clean_text(F.col("brand_reply")))


def first_contacts(messages: DataFrame, brand: str, keep_brand_posts: bool = False) -> DataFrame:
    """Customer messages that answer nothing, as (customer_tweet_id, text, message_created_at)."""
    pointer = F.col("in_response_to_tweet_id")
    opening = pointer.isNull() | (F.trim(pointer.cast("string")) == "")
    if not keep_brand_posts:
        opening = opening & ~F.col("author_id").eqNullSafe(brand)
    return messages.where(opening).select(
        as_id(F.col("tweet_id")).alias("customer_tweet_id"),
        F.col("text"),
        F.col("created_at").alias("message_created_at"),
    )


def build_threads(
    messages: DataFrame, brand: str, min_length: int = MIN_LENGTH, keep_brand_posts: bool = False
) -> DataFrame:
    """Customer first contact joined to the first brand reply that points at it.

    Replies are unique per answered message before the join, so a hot message
    meets one row; the log is read once per side, and only answered messages
    are cleaned. First contact, join and first row share one partitioning.
    """
    answered = first_contacts(messages, brand, keep_brand_posts).join(
        first_reply(messages, brand), "customer_tweet_id"
    )
    threads = first_per_key(answered, "customer_tweet_id", ["message_created_at", "text"]).withColumn(
        "customer_msg", clean_text(F.col("text"))
    )
    return threads.where(F.length("customer_msg") >= min_length).select(
        F.concat(F.lit("thread_"), F.col("customer_tweet_id").cast("string")).alias("thread_id"),
        F.col("customer_tweet_id").cast("string").alias("customer_tweet_id"),
        "customer_msg",
        "brand_reply",
        F.col("brand_tweet_id").cast("string").alias("brand_tweet_id"),
        F.col("reply_created_at").alias("created_at"),
        "message_created_at",
        mentions(F.col("text")).alias("removed_mentions"),
    )


def answered_messages(messages: DataFrame, brand: str) -> DataFrame:
    """Every message the brand replied to."""
    targets = brand_replies(messages, brand).select(F.col("in_response_to_tweet_id").alias("tweet_id"))
    return messages.join(targets, "tweet_id", "left_semi")


def customer_messages(threads: DataFrame) -> DataFrame:
    """(tweet_id, text, created_at) of the customer side, with the customer's own time."""
    return threads.select(
        F.col("customer_tweet_id").alias("tweet_id"),
        F.col("customer_msg").alias("text"),
        F.col("message_created_at").alias("created_at"),
    )


def restrict_to(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Messages whose id opens one of the given threads."""
    ids = threads.select(F.col("customer_tweet_id").alias("tweet_id"))
    return messages.join(ids, "tweet_id", "left_semi")


def thread_length(
    df: DataFrame,
    thread: Sequence[str],
    ts: str = "ts",
    order: Sequence[str] = ("ts",),
    name: str = "thread_length",
    slice_width: str = "hour",
) -> DataFrame:
    """Turn count of the thread up to and including each row."""
    return running_count(df, list(thread), ts, list(order), name, slice_width)


def reply_depth(messages: DataFrame, key: str = "tweet_id", reply_to: str = "in_response_to_tweet_id") -> DataFrame:
    """``key, root_id, depth, cyclic, thread_size`` of every message along its reply pointers.

    Pointers are doubled: each round a message looks up the state of the ancestor it has reached, so a chain of
    n replies takes about log2(n) joins. A message without a pointer, or whose parent is not in
    the table, is a root of depth 0. Messages on a cycle of pointers, or below one, have no root: a round in
    which no message finds one leaves only those. ``thread_size`` counts the messages of a root. Ids are
    expected to be unique; a bad pointer counts as a lost parent. A popular ancestor is a hot key of
    the join's larger side only, which Spark splits (adaptive skew join).
    """
    rows = messages.select(as_id(F.col(key)).alias("id"), as_id(F.col(reply_to).cast("string")).alias("parent"))
    known = rows.select(F.col("id").alias("_known"))
    placed = rows.join(known, F.col("parent") == F.col("_known"), "left")
    found = F.col("_known").isNotNull()
    state = freeze(
        placed.select(
            "id",
            F.when(found, F.col("parent")).alias("reached"),
            found.cast("bigint").alias("depth"),
            (~found).alias("done"),
        )
    )
    parts, left = [state.where("done").select("id", F.col("id").alias("root_id"), "depth")], state.where("NOT done")
    waiting = left.count()
    settled = state
    while waiting:
        seen = settled.select(
            F.col("id").alias("_id"), F.col("reached").alias("_reached"), F.col("depth").alias("_depth"), F.col("done").alias("_done")
        )
        settled = freeze(
            left.join(seen, F.col("reached") == F.col("_id")).select(
                "id",
                F.when(F.col("_done"), F.coalesce("_reached", F.col("_id"))).otherwise(F.col("_reached")).alias("reached"),
                (F.col("depth") + F.col("_depth")).alias("depth"),
                F.col("_done").alias("done"),
            )
        )
        parts.append(settled.where("done").select("id", F.col("reached").alias("root_id"), "depth"))
        left = settled.where("NOT done")
        now = left.count()
        if now == waiting:
            break
        waiting = now
        # Ancestors that are done already are looked up as well; their state does not change any more.
        settled = freeze(_states(parts).unionByName(left))
    rooted = parts[0]
    for part in parts[1:]:
        rooted = rooted.unionByName(part)
    placed = rooted.withColumn("cyclic", F.lit(False))
    if waiting:
        lost = left.select("id", F.lit(None).cast("bigint").alias("root_id"), F.lit(None).cast("bigint").alias("depth"))
        placed = placed.unionByName(lost.withColumn("cyclic", F.lit(True)))
    sizes = rooted.groupBy("root_id").agg(F.count(F.lit(1)).alias("thread_size"))
    return placed.join(sizes, "root_id", "left").select(
        F.col("id").alias(key), "root_id", "depth", "cyclic", "thread_size"
    )


def _states(parts: list[DataFrame]) -> DataFrame:
    whole = None
    for part in parts:
        rows = part.select("id", F.col("root_id").alias("reached"), "depth", F.lit(True).alias("done"))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole
