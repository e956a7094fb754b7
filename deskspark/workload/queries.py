"""Registered queries: every operator over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark import lexicon as lx
from deskspark.functions import responses as rs
from deskspark.functions import text as tx
from deskspark.operators import (
    agreement,
    classify,
    cluster,
    features,
    grouped,
    guard,
    language,
    metrics,
    profile,
    retrieve,
    rules,
    sampling,
    termlist,
    threads,
)
from deskspark.plans import jobs
from deskspark.sources import tables
from deskspark.sources.index import SearchIndex
from deskspark.sources.scratch import freeze, new_path, rocksdb_state
from deskspark.streaming import triage as streams
from deskspark.workload import views
from deskspark.workload.views import BRAND

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SEED = 42
QUOTA = 20
GOLDEN_ROWS = 208
CELLS, PROBES = 16, 8


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


# --- Text and profile ---------------------------------------------------------


@query
def clean_text(spark, sf):
    docs = tables.load(spark, sf, "documents")
    return docs.select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query
def clean_urls(spark, sf):
    pages = tables.load(spark, sf, "pages")
    said = F.concat(F.lit(" see "), F.col("url"), F.lit("  and  @desk "))
    return pages.select(
        "page_id", tx.clean_text(said).alias("cleaned"), tx.clean_or_raw(F.col("url")).alias("url_or_raw")
    )


@query
def mentions(spark, sf):
    docs = tables.load(spark, sf, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text")
    said = views.raw_tickets(spark, sf, False).select(
        F.lit("ticket").alias("origin"), F.col("ticket_id").alias("id"), F.col("raw_text").alias("text")
    )
    found = tx.mentions(F.col("text"))
    return docs.unionByName(said).select(
        "origin", "id", F.array_join(found, ",").alias("removed_mentions"), F.size(found).alias("n")
    )


@query
def money_mentions(spark, sf):
    amounts = tx.money(F.col("text"))
    return views.tickets(spark, sf, False).select("ticket_id", F.array_join(amounts, ",").alias("amounts"))


@query
def entity_ids(spark, sf):
    return views.drafts(spark, sf).select(
        "ticket_id",
        F.array_join(tx.order_ids(F.col("draft")), ",").alias("orders"),
        F.array_join(tx.tracking_ids(F.col("draft")), ",").alias("trackings"),
        F.array_join(tx.money(F.col("draft")), ",").alias("amounts"),
    )


@query
def length_profile(spark, sf):
    return profile.length_profile(tables.load(spark, sf, "documents"), "text", ["lang"])


@query
def ticket_length_profile(spark, sf):
    found = profile.length_profile(views.tickets(spark, sf, False), "text", ts="ts")
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first_at", "last_at")}
    return found.withColumns(shown)


@query
def top_bigrams(spark, sf):
    return profile.top_bigrams(tables.load(spark, sf, "documents"))


@query
def frequent_bigrams(spark, sf):
    return profile.frequent_bigrams(tables.load(spark, sf, "documents"))


@query
def class_distribution(spark, sf):
    labelled = rules.rules_substring(views.tickets(spark, sf, False).drop("confidence"))
    return profile.class_distribution(labelled, "intent")


@query
def distribution_shift(spark, sf):
    labelled = _strata(spark, sf).withColumn("intent", F.coalesce("stratum", F.lit(lx.OTHER)))
    sample = sampling.stratified_backfill(labelled, "stratum", QUOTA, GOLDEN_ROWS, SEED, "ticket_id")
    return profile.compare_distributions(sample, labelled, "intent")


@query
def majority_class(spark, sf):
    return profile.majority_class(views.raw_tickets(spark, sf, False), "true_intent")


@query
def fold_rare(spark, sf):
    labelled = rules.rules_substring(views.tickets(spark, sf, False).drop("confidence"))
    folded = profile.fold_rare(labelled, "intent", 0.06)
    return profile.class_distribution(folded, "intent")


# --- Threads ------------------------------------------------------------------


@query
def build_threads(spark, sf):
    found = threads.build_threads(views.message_log(spark, sf), BRAND)
    return found.withColumn("removed_mentions", F.array_join("removed_mentions", ","))


@query
def first_reply(spark, sf):
    return threads.first_reply(views.message_log(spark, sf), BRAND)


@query
def answered_messages(spark, sf):
    return threads.answered_messages(views.message_log(spark, sf), BRAND).select("tweet_id", "author_id", "created_at")


@query
def customer_messages(spark, sf):
    sample, messages = jobs.prepare(views.message_log(spark, sf), BRAND, 50, SEED)
    return messages


@query
def restricted_messages(spark, sf):
    """All customer messages, restricted to sampled threads."""
    found = threads.build_threads(views.message_log(spark, sf), BRAND)
    sample = sampling.sample_n(found, 50, SEED, "customer_tweet_id")
    return threads.restrict_to(threads.customer_messages(found), sample)


@query
def sample_threads(spark, sf):
    found = threads.build_threads(views.message_log(spark, sf), BRAND)
    return sampling.sample_n(found, 50, SEED, "customer_tweet_id").select("thread_id", "customer_msg")


@query
def first_ticket_per_user(spark, sf):
    base = views.raw_tickets(spark, sf, False).select("user_id", "ts", "ticket_id", "raw_text")
    return threads.first_per_key(base, "user_id", ["ts", "ticket_id"]).select("user_id", "ticket_id", "raw_text")


@query
def thread_length(spark, sf):
    return views.raw_tickets(spark, sf).select("ticket_id", "user_id", "thread_length")


@query
def thread_depths(spark, sf):
    """Root, depth and size of the thread of every message, along reply pointers."""
    return threads.reply_depth(views.message_log(spark, sf))


# --- Rules --------------------------------------------------------------------


def _decided(spark, sf):
    return rules.escalate(rules.rules_regex(views.tickets(spark, sf)))


@query
def triage_decisions(spark, sf):
    return (
        _decided(spark, sf)
        .groupBy("intent", "decision")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("signal_count").alias("signals"))
    )


@query
def escalation_policy(spark, sf):
    return _decided(spark, sf).select(
        "ticket_id", "intent", "decision", "reason", F.array_join("fired_signals", " | ").alias("fired"), "signal_count"
    )


@query
def signal_rates(spark, sf):
    return rules.signal_rates(_decided(spark, sf))


@query
def rules_regex(spark, sf):
    return rules.rules_regex(views.tickets(spark, sf, False)).select("ticket_id", "intent")


@query
def rules_substring(spark, sf):
    base = views.tickets(spark, sf, False).drop("confidence")
    return rules.rules_substring(base).select("ticket_id", "intent", "confidence")


@query
def rules_third(spark, sf):
    return rules.rules_decision(views.tickets(spark, sf, False)).select("ticket_id", "intent", "decision")


@query
def rules_documents(spark, sf):
    """The substring cascade over whole documents."""
    docs = tables.load(spark, sf, "documents").select("doc_id", "text")
    return rules.rules_substring(docs).select("doc_id", "intent")


@query
def escalate_simple(spark, sf):
    return rules.escalate_simple(views.tickets(spark, sf)).select("ticket_id", "decision", "reason")


@query
def constant_baseline(spark, sf):
    base = views.raw_tickets(spark, sf, False).select("ticket_id", "true_intent")
    most = profile.majority_class(base, "true_intent").select("true_intent").scalar()
    return rules.constant_baseline(base.select("ticket_id"), most).select(
        "ticket_id", "intent", "confidence", "decision"
    )


@query
def multi_intent(spark, sf):
    return rules.multi_intent(views.tickets(spark, sf, False)).select("ticket_id", "primary_intent", "secondary_intent")


@query
def canned_reply(spark, sf):
    base = views.tickets(spark, sf, False).drop("confidence")
    return rules.canned_reply(rules.rules_substring(base)).select("ticket_id", "reply")


@query
def label_actions(spark, sf):
    base = views.tickets(spark, sf).select("ticket_id", "text", "true_intent", "thread_length")
    return rules.label_actions(base).select("ticket_id", "true_escalate", "label_source")


@query
def route_language(spark, sf):
    docs = tables.load(spark, sf, "documents").select("doc_id", "lang", "text")
    routed = rules.route_language(rules.rules_substring(docs), ["en"])
    return routed.select("doc_id", "lang", "intent")


@query
def detect_language(spark, sf):
    docs = tables.load(spark, sf, "documents").select("doc_id", "lang", "text")
    found = language.detect_language(docs.drop("lang"), language.learn_profiles(docs))
    return found.select("doc_id", "lang_guess", "lang_guess_distance", "lang_guess_runner_up")


@query
def route_unlabelled(spark, sf):
    docs = tables.load(spark, sf, "documents").select("doc_id", "lang", "text")
    labelled = rules.rules_substring(docs.drop("lang"))
    routed = language.route_unlabelled(labelled, language.learn_profiles(docs), ["en"])
    return routed.select("doc_id", "lang_guess", "intent")


def _watch_rules(spark, sf):
    """A rule per word of ``benchmark``: the word (four letters or more) and the pair it begins."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    spots = tables.load(spark, sf, "benchmark").select("item_id", words.alias("w")).select("item_id", "w", F.posexplode("w").alias("i", "word"))
    pair = F.concat("word", F.lit(" "), F.get("w", F.col("i") + 1))
    return (
        spots.select(
            (F.col("item_id") * 100_000 + F.col("i")).alias("position"),
            F.explode(F.array(F.when(F.length("word") >= 4, F.col("word")), pair)).alias("term"),
        )
        .where("term IS NOT NULL")
        .groupBy("term")
        .agg(F.min("position").alias("position"))
        .withColumn("intent", F.get(F.lit(list(lx.INTENTS)), F.expr(f"int((position div 100000) % {len(lx.INTENTS)})")))
    )


@query
def find_terms(spark, sf):
    docs = tables.load(spark, sf, "documents").select("doc_id", "text")
    found = termlist.find_terms(docs, _watch_rules(spark, sf))
    return found.select("doc_id", F.size("found").alias("n_rules"), F.array_join("found", ",").alias("found_rules"))


@query
def rules_table(spark, sf):
    docs = tables.load(spark, sf, "documents").select("doc_id", "text")
    return termlist.classify_terms(docs, _watch_rules(spark, sf)).select("doc_id", "first_rule", "intent")


# --- Guard --------------------------------------------------------------------


@query
def reply_guard(spark, sf):
    guarded = guard.guard_reply(views.drafts(spark, sf), "draft")
    return guarded.select(
        "ticket_id",
        "hallucination_detected",
        F.array_join("hallucination_flags", " | ").alias("flags"),
        "sanitized_reply",
    )


@query
def normalize_reply(spark, sf):
    return views.drafts(spark, sf).select("ticket_id", tx.normalize_reply(F.col("draft")).alias("reply"))


# --- Metrics ------------------------------------------------------------------


def _predictions(spark, sf):
    return jobs.predictions(views.tickets(spark, sf), "ticket_id")


@query
def accuracy(spark, sf):
    return metrics.accuracy(_predictions(spark, sf), "true_intent", "intent", ["model"])


@query
def macro_prf(spark, sf):
    return metrics.macro_prf(_predictions(spark, sf), "true_intent", "intent", ["model"])


@query
def class_scores(spark, sf):
    cells = metrics.confusion(_predictions(spark, sf), "true_intent", "intent", ["model"])
    return metrics.class_scores(cells, "true_intent", "intent", ["model"])


@query
def binary_prf(spark, sf):
    return metrics.binary_prf(_predictions(spark, sf), "true_action", "decision", by=["model"])


@query
def binary_rollup(spark, sf):
    return metrics.binary_rollup(_predictions(spark, sf), "true_action", "decision", ["model", "true_intent"])


@query
def binary_prf_labels(spark, sf):
    """Long documents as a guess for quality = 1."""
    guess = tables.load(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("guess"))
    pairs = metrics.pair_labels(guess, tables.load(spark, sf, "labels"), "doc_id")
    return metrics.binary_prf(pairs, "quality", "guess", positive=1)


@query
def confusion(spark, sf):
    return metrics.confusion(_predictions(spark, sf), "true_intent", "intent", ["model"])


@query
def confusion_wide(spark, sf):
    return metrics.confusion_wide(_predictions(spark, sf), "true_intent", "intent", by=["model"])


@query
def rating_means(spark, sf):
    a, _ = views.ratings(spark, sf)
    return metrics.rating_means(a, lx.RATING_DIMENSIONS)


@query
def compare_systems(spark, sf):
    return metrics.compare(_predictions(spark, sf), "simple_baseline")


@query
def stacked_predictions(spark, sf):
    base = views.tickets(spark, sf)
    named = ["ticket_id", "intent", "decision"]
    return metrics.stack_predictions(
        {
            "simple": rules.escalate_simple(rules.rules_regex(base)).select(*named),
            "third": rules.rules_decision(base).select(*named),
        }
    )


@query
def failure_cases(spark, sf):
    full = _predictions(spark, sf).where(F.col("model") == "full_system")
    return metrics.failure_cases(full).select("ticket_id", "failure", "true_intent", "intent", "true_action", "decision")


# --- Agreement ----------------------------------------------------------------


@query
def agreement_rates(spark, sf):
    a, b = views.ratings(spark, sf)
    pairs = agreement.pair_ratings(a, b, "ticket_id", lx.RATING_DIMENSIONS)
    return agreement.agreement(pairs, lx.RATING_DIMENSIONS)


@query
def pair_ratings(spark, sf):
    a, b = views.ratings(spark, sf)
    return agreement.pair_ratings(a, b, "ticket_id", lx.RATING_DIMENSIONS, impute=True)


@query
def spearman(spark, sf):
    """Document length against both labels, ranks over all distinct lengths."""
    pairs = metrics.pair_labels(
        tables.load(spark, sf, "documents").select("doc_id", "n_chars"), tables.load(spark, sf, "labels"), "doc_id"
    ).select("quality", "toxic", F.col("n_chars").alias("b_quality"), F.col("n_chars").alias("b_toxic"))
    found = agreement.spearman(agreement.unpivot_pairs(pairs, ["quality", "toxic"]))
    return found.withColumn("rho", F.round("rho", 6))


@query
def cohens_kappa(spark, sf):
    first = rules.rules_regex(views.tickets(spark, sf, False), intent="first_label")
    both = rules.rules_substring(first.drop("confidence"), intent="second_label")
    return agreement.cohens_kappa(both, "first_label", "second_label").select(
        "n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa")
    )


def _calibration(spark, sf):
    a, b = views.ratings(spark, sf)
    return jobs.calibrate(agreement.pair_ratings(a, b, "ticket_id", lx.RATING_DIMENSIONS))


@query
def calibrate(spark, sf):
    rounded = {c: F.round(c, 6) for c in ("exact_agreement", "within_tolerance", "a_mean", "b_mean", "rho")}
    return _calibration(spark, sf).withColumns(rounded).drop("p_value")


@query
def calibrate_p_values(spark, sf):
    return _calibration(spark, sf).select("dimension", "n", *[F.round(c, 6).alias(c) for c in ("rho", "p_value")])


@query
def calibration_summary(spark, sf):
    found = jobs.calibration_summary(_calibration(spark, sf))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


# --- Retrieval ----------------------------------------------------------------


def _vectors(spark, sf, shift: int = 0):
    base = tables.load(spark, sf, "embeddings")
    asked = base.select(F.col("vec_id").alias("query_id"), "embedding", (F.col("label") + shift).alias("label"))
    return asked, base.select(F.col("vec_id").alias("corpus_id"), "embedding", "label")


def _rounded(hits):
    return hits.withColumn("similarity", F.round("similarity", 5))


@query
def knn_topk(spark, sf):
    return _rounded(retrieve.knn(*_vectors(spark, sf), k=3))


@query
def knn_blocked(spark, sf):
    """The same search in small blocks."""
    return _rounded(retrieve.knn(*_vectors(spark, sf), k=3, block_rows=64))


@query
def knn_cells_recall(spark, sf):
    """Share of the exact neighbours that 8 of 16 cells find, and whether it reaches 0.9."""
    asked, corpus = _vectors(spark, sf)
    pair = ["query_id", "corpus_id"]
    exact = retrieve.knn(asked, corpus, k=3).select(*pair)
    found = retrieve.knn_cells(asked, corpus, CELLS, PROBES, k=3).select(*pair, F.lit(1).alias("found"))
    return exact.join(found, pair, "left").agg(
        F.count(F.lit(1)).alias("neighbours"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_reached")
    )


@query
def knn_codes_whole(spark, sf):
    """Product-quantised search whose short lists hold everything: exact."""
    asked, corpus = _vectors(spark, sf)
    rows = corpus.count()
    return _rounded(retrieve.knn_codes(asked, corpus, CELLS, CELLS, rows, k=3))


SHORT_LIST = 24


def _code_figures(spark, sf):
    """(neighbours, found among them, share of the corpus whose vectors a query reads)."""
    asked, corpus = _vectors(spark, sf)
    pair = ["query_id", "corpus_id"]
    exact = retrieve.knn(asked, corpus, k=3).select(*pair)
    found = retrieve.knn_codes(asked, corpus, CELLS, CELLS, SHORT_LIST, k=3).select(*pair, F.lit(1).alias("found"))
    counts = exact.join(found, pair, "left").agg(F.count(F.lit(1)).alias("neighbours"), F.count("found").alias("found"))
    return counts.withColumn("read_share", F.lit(float(SHORT_LIST)) / corpus.count())


@query
def knn_codes_recall(spark, sf):
    """Whether a short list of 24 by 20-byte codes finds 0.9 of the neighbours, reading a tenth of the vectors at most."""
    return _code_figures(spark, sf).select(
        "neighbours",
        (F.col("found") >= 0.9 * F.col("neighbours")).alias("recall_reached"),
        (F.col("read_share") <= 0.1).alias("few_vectors_read"),
    )


@query
def knn_codes_figures(spark, sf):
    """The measured recall and share of vectors read of the same search."""
    return _code_figures(spark, sf).select(
        "neighbours", (F.col("found") / F.col("neighbours")).alias("recall"), "read_share"
    )


@query
def index_search(spark, sf):
    """A stored index, grown by two appends and compacted, searched in all its cells."""
    asked, corpus = _vectors(spark, sf)
    path = new_path(spark, "index")
    third = F.pmod("corpus_id", F.lit(3))
    index = SearchIndex.create(corpus.where(third == 0), path, CELLS, "corpus_id", seed=SEED)
    index.append(corpus.where(third == 1), "second")
    index.compact("both")
    index.append(corpus.where(third == 2), "third")
    index.append(corpus.where(third == 2), "third")
    return _rounded(SearchIndex.open(spark, path).search(asked, k=3))


@query
def knn_by_label(spark, sf):
    """Queries carry the next label, so those of the last one fall back to the whole corpus."""
    return _rounded(retrieve.knn_by_label(*_vectors(spark, sf, 1), "label", k=3))


def _examples(spark, sf):
    asked, corpus = _vectors(spark, sf, 1)
    hits = retrieve.knn(asked, corpus, k=3, partition="label")
    shown = hits.select(
        "query_id",
        "similarity",
        F.concat(F.lit("message "), F.col("corpus_id")).alias("customer_msg"),
        F.concat(F.lit("reply "), F.col("corpus_id")).alias("brand_reply"),
        F.concat(F.lit("thread_"), F.col("corpus_id")).alias("thread_id"),
        "rank",
    )
    return shown, asked


@query
def knn_fallback(spark, sf):
    shown, asked = _examples(spark, sf)
    return _rounded(retrieve.with_fallback(shown, asked, views.DEFAULT_EXAMPLES))


@query
def format_context(spark, sf):
    shown, asked = _examples(spark, sf)
    return retrieve.format_context(shown, "Desk", queries=asked)


@query
def reply_prompts(spark, sf):
    """Reply and rating prompts over retrieved examples."""
    shown, asked = _examples(spark, sf)
    contexts = retrieve.format_context(shown, "Desk", queries=asked)
    named = contexts.join(asked.select("query_id", "label"), "query_id").select(
        "query_id",
        "retrieved_context",
        F.concat(F.lit("message "), F.col("query_id")).alias("text"),
        F.get(F.array(*map(F.lit, lx.INTENTS)), (F.col("label") % len(lx.INTENTS)).cast("int")).alias("intent"),
    )
    filled = rs.render_prompts(rules.canned_reply(named), lx.REPLY_PROMPT, prompt="reply_prompt")
    rated = rs.render_prompts(filled, lx.RATING_PROMPT, prompt="rating_prompt")
    return rated.select("query_id", "reply_prompt", "rating_prompt")


# --- Sampling -----------------------------------------------------------------


@query
def systematic_sample(spark, sf):
    base = views.raw_tickets(spark, sf, False).select("ticket_id", "raw_text")
    return sampling.systematic_sample(base, 15, "ticket_id")


def _strata(spark, sf):
    labelled = rules.rules_substring(views.tickets(spark, sf, False).drop("confidence"))
    return labelled.select(
        "ticket_id", "text", F.nullif(F.col("intent"), F.lit(lx.OTHER)).alias("stratum")
    )


@query
def stratified_backfill(spark, sf):
    return sampling.stratified_backfill(_strata(spark, sf), "stratum", QUOTA, GOLDEN_ROWS, SEED, "ticket_id")


@query
def centroid_sample(spark, sf):
    base = tables.load(spark, sf, "embeddings")
    drawn = sampling.stratified_backfill(
        base, "label", QUOTA - 5, GOLDEN_ROWS, SEED, "vec_id", by="centroid", vector="embedding"
    )
    return drawn.select("vec_id", "label", "origin")


@query
def relabel_sample(spark, sf):
    return sampling.relabel_sample(tables.load(spark, sf, "labels"), 0.1, SEED, "doc_id")


@query
def limit_rows(spark, sf):
    return sampling.limit_rows(tables.load(spark, sf, "labels"), 35, "doc_id")


# --- Responses ----------------------------------------------------------------


@query
def render_prompts(spark, sf):
    base = views.tickets(spark, sf, False)
    filled = rs.render_prompts(base, lx.CLASSIFY_PROMPT, {"taxonomy": lx.taxonomy_text()})
    return filled.select("ticket_id", "prompt")


FIELDS = ["intent", "confidence", "reasoning"]


@query
def parse_responses(spark, sf):
    parsed = rs.parse_responses(views.responses(spark, sf), "raw", FIELDS)
    return parsed.select("ticket_id", "intent", F.col("confidence").try_cast("double"), "reasoning", "error")


NESTED = {
    "intent": ("$.intent", "string"),
    "confidence": ("$.confidence", "double"),
    "tone": ("$.ratings.tone", "int"),
    "useful": ("$.ratings.useful", "boolean"),
}


@query
def typed_answers(spark, sf):
    parsed = rs.parse_typed(views.nested_responses(spark, sf), "raw", NESTED)
    lists = {c: F.array_join(c, ",") for c in ("missing", "mistyped")}
    return parsed.withColumns(lists).drop("raw")


@query
def answer_drift(spark, sf):
    paths = {"tone": "$.ratings.tone", "ratings": "$.ratings", "confidence": "$.confidence"}
    return rs.answer_drift(views.nested_responses(spark, sf), "raw", paths)


@query
def normalize_label(spark, sf):
    parsed = rs.parse_responses(views.responses(spark, sf), "raw", FIELDS)
    return parsed.select(
        "ticket_id",
        rs.normalize_label(F.col("intent")).alias("intent"),
        rs.clamp_confidence(F.col("confidence")).alias("confidence"),
    )


@query
def normalize_ratings(spark, sf):
    base = views.raw_tickets(spark, sf, False)
    raw = base.select(
        "ticket_id",
        F.when(F.pmod("k", F.lit(11)) != 0, (F.pmod("k", F.lit(8)) - 1).cast("string")).alias("groundedness"),
        F.when(F.pmod("k", F.lit(13)) != 0, F.concat(F.pmod("ticket_id", F.lit(7)).cast("string"), F.lit(".0"))).alias("tone"),
        F.when(F.pmod("k", F.lit(5)) == 0, "n/a").otherwise(F.pmod("user_id", F.lit(6)).cast("string")).alias("actionability"),
    )
    return rs.normalize_ratings(raw)


# --- Features, models, clusters -----------------------------------------------


@query
def tfidf_terms(spark, sf):
    base = tables.load(spark, sf, "conversations").select(
        views.message_id().alias("message_id"), "text"
    )
    found = features.tfidf_terms(base, "message_id", stop_words=lx.BIGRAM_STOP_WORDS)
    return found.withColumn("weight", F.round("weight", 6))


@query
def embed_messages(spark, sf):
    embedded = features.embed(views.tickets(spark, sf, False).select("ticket_id", "text"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x)
    return embedded.select("ticket_id", F.size("embedding").alias("dims"), F.round(norm, 3).alias("squared_norm"))


@query
def train_predict(spark, sf):
    base = views.tickets(spark, sf, False).select("ticket_id", "text", "true_intent")
    model = classify.train_intent(base)
    return classify.predict_intent(model, base).select("ticket_id", "true_intent", "intent", "confidence")


def _labelled(spark, sf):
    return tables.load(spark, sf, "embeddings").withColumnRenamed("label", "cluster")


@query
def kmeans_sweep(spark, sf):
    return cluster.sweep_k(tables.load(spark, sf, "embeddings"))


@query
def kmeans_assign(spark, sf):
    return cluster.kmeans(tables.load(spark, sf, "embeddings"), 8, SEED).select("vec_id", "cluster")


FIRST_K, LAST_K = 5, 12


@query
def kmeans_steps(spark, sf):
    """Models of 5 to 12 clusters from the first vectors as centres: sizes and costs, and the cost one step later."""
    base = tables.load(spark, sf, "embeddings")
    first = [r["embedding"] for r in base.orderBy("vec_id").limit(LAST_K).select("embedding").collect()]
    begin = {k: np.array(first[:k], dtype=np.float64) for k in range(FIRST_K, LAST_K + 1)}
    held = cluster.points(base)
    after = [(k, float(m.cost)) for k, m in cluster.advance(held, begin, max_iterations=1).items()]
    sums = cluster.cluster_sums(held, begin).select(
        F.col("model").alias("k"), "cluster", F.col("size").cast("bigint").alias("size"), F.round("cost", 6).alias("cost")
    )
    return sums.join(spark.createDataFrame(after, "k int, cost_after double"), "k").withColumn(
        "cost_after", F.round("cost_after", 6)
    )


@query
def silhouette_exact(spark, sf):
    """Plain Euclidean silhouettes of the labels and of two coarser labellings, over all pairs of rows."""
    base = _labelled(spark, sf).withColumns({"halves": F.expr("cluster div 5"), "parity": F.expr("cluster % 2")})
    names = ["cluster", "halves", "parity"]
    found = cluster.silhouette_exact(base, names)
    table = spark.createDataFrame([(c, found[c]) for c in names], "labelling string, silhouette double")
    return table.withColumn("silhouette", F.round("silhouette", 6))


@query
def cluster_summary(spark, sf):
    return cluster.cluster_summary(_labelled(spark, sf))


@query
def cluster_examples(spark, sf):
    shown = cluster.cluster_examples(_labelled(spark, sf), [F.col("vec_id")], 5)
    return shown.select("cluster", "vec_id", "rank")


@query
def silhouette_squared(spark, sf):
    found = cluster.silhouette(cluster.with_vectors(_labelled(spark, sf)))
    return _labelled(spark, sf).agg(F.count(F.lit(1)).alias("n")).withColumn("silhouette", F.round(F.lit(found), 6))


# --- Jobs and IO --------------------------------------------------------------


@query
def triage_full(spark, sf):
    corpus = threads.build_threads(views.message_log(spark, sf), BRAND)
    done = jobs.triage(views.raw_tickets(spark, sf), corpus)
    return done.select(
        "ticket_id", "intent", "confidence", "reply", "decision", "reason", "retrieved_context",
        "hallucination_detected", F.array_join("hallucination_flags", " | ").alias("flags"),
        F.array_join("fired_signals", " | ").alias("fired"), "signal_count", "model_type",
    )


@query
def triage_records(spark, sf):
    """Triage records without the retrieved text, which depends on the encoder."""
    return triage_full(spark, sf).drop("retrieved_context")


@query
def triage_by_intent(spark, sf):
    """Triage that searches threads of the message's own intent and falls back on default examples."""
    corpus = threads.build_threads(views.message_log(spark, sf), BRAND)
    done = jobs.triage(views.raw_tickets(spark, sf), corpus, by_intent=True, defaults=views.DEFAULT_EXAMPLES)
    return done.select("ticket_id", "intent", "decision", "reason", "signal_count")


@query
def evaluate_own(spark, sf):
    """A trained model and the triage job scored as one's own systems against the simple one."""
    golden = views.tickets(spark, sf)
    corpus = threads.build_threads(views.message_log(spark, sf), BRAND)
    # Training needs no thread lengths.
    model = classify.train_intent(views.tickets(spark, sf, False).select("text", "true_intent"))

    def trained(rows):
        guessed = classify.predict_intent(model, rows.drop("confidence")).withColumn("confidence", F.lit(0.85))
        return rules.escalate(guessed)

    return jobs.evaluate(
        golden,
        "ticket_id",
        systems={
            "simple_baseline": lambda rows: rules.escalate_simple(rules.rules_regex(rows)),
            "triage": lambda rows: jobs.triage(rows, corpus),
            "trained": trained,
        },
    )


@query
def evaluate_systems(spark, sf):
    golden = views.tickets(spark, sf)
    a, _ = views.ratings(spark, sf)
    rated = a.withColumn("model", F.explode(F.array(*map(F.lit, ["trivial_baseline", "simple_baseline", "full_system"]))))
    return jobs.evaluate(golden, "ticket_id", rated)


@query
def discover_report(spark, sf):
    sweep, summary, shown = jobs.discover(views.tickets(spark, sf, False), "ticket_id")
    return summary.join(shown, "cluster")


@query
def roundtrip_io(spark, sf):
    """Message log to CSV and back, threads to parquet and back."""
    folder = new_path(spark, "roundtrip")
    views.message_log(spark, sf).write.option("header", True).option("escape", '"').csv(f"{folder}/log")
    log = tables.read_messages(spark, f"{folder}/log")
    found = threads.build_threads(log, BRAND)
    threads_path, messages_path = tables.write_tables(found, threads.customer_messages(found), folder)
    back = tables.read_table(spark, threads_path)
    return back.join(
        tables.read_table(spark, messages_path).select(F.col("tweet_id").alias("customer_tweet_id"), "text"),
        "customer_tweet_id",
    ).select("customer_tweet_id", "customer_msg", "brand_reply", "removed_mentions", "text")


@query
def roundtrip_metrics(spark, sf):
    """Metric rows to JSON and back."""
    path = new_path(spark, "metrics")
    scores = class_scores(spark, sf)
    tables.write_metrics(scores, path)
    return spark.read.schema(scores.schema).json(path)


@query
def deduped_log(spark, sf):
    """The log delivered twice, the second time later and in other words: the first delivery stays."""
    log = views.message_log(spark, sf)
    again = log.withColumns({"created_at": F.concat("created_at", F.lit("~")), "text": F.lit(None).cast("string")})
    kept = grouped.dedupe(again.unionByName(log), "tweet_id", ["created_at"])
    return kept.select("tweet_id", "author_id", "text")


@query
def roundtrip_golden(spark, sf):
    """Golden rows to CSV and back, under one producer's column names."""
    path = new_path(spark, "golden")
    drawn = sampling.stratified_backfill(_strata(spark, sf), "stratum", QUOTA, GOLDEN_ROWS, SEED, "ticket_id")
    named = drawn.select(
        "ticket_id", "text", F.coalesce("stratum", F.lit(lx.OTHER)).alias("primary_intent"), F.lit(lx.ESCALATE).alias("ideal_action")
    )
    tables.write_golden(named, path)
    return tables.read_golden(spark, path).select(
        F.col("ticket_id").cast("bigint").alias("ticket_id"), "text", "true_intent", "true_action",
        F.col("thread_length").cast("int").alias("thread_length"),
    )


@query
def embedding_store(spark, sf):
    """Embeddings stored once; the second call only adds ids that are missing."""
    path = new_path(spark, "embeddings")
    base = tables.load(spark, sf, "embeddings").select("vec_id", "embedding")
    partly = tables.load(spark, sf, "embeddings").where(F.col("label") < 5).select("vec_id", "embedding")
    tables.materialize_embeddings(partly, path, lambda frame: frame, "vec_id")
    stored = tables.materialize_embeddings(base, path, lambda frame: frame, "vec_id")
    return stored.select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"))


# --- Streams ------------------------------------------------------------------


def _ticket_stream(spark, sf):
    schema = tables.load(spark, sf, "events").schema
    return views.tickets_of(streams.stream_table(spark, sf, schema, pattern="events.parquet"))


def _drained(spark, frame, label):
    path = new_path(spark, label)
    streams.to_parquet(frame, path, new_path(spark, f"{label}-state")).awaitTermination()
    return spark.read.parquet(path)


def _arriving(spark, sf, start):
    """Starts a stream on a folder of events each time a further third of them, in order of time, has arrived."""
    events, folder = tables.load(spark, sf, "events"), new_path(spark, "arriving")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, second = events.agg(F.percentile_approx(at, F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0] or (0, 0)
    for part in (at.isNull() | (at <= first), (at > first) & (at <= second), (at > first) & (at > second)):
        events.where(part).write.mode("append").parquet(folder)
        start(views.tickets_of(streams.stream_table(spark, folder, events.schema))).awaitTermination()


def _counted(stream):
    return streams.thread_length_stream(stream, ["user_id", "day"], "ts", "ticket_id", ["raw_text", "confidence"])


def _triaged(spark, sf):
    """Folder of a triage stream's records."""
    path, state = new_path(spark, "triage"), new_path(spark, "triage-state")
    _arriving(spark, sf, lambda stream: streams.to_parquet(streams.triage_stream(_counted(stream)), path, state))
    return path


@query
def triage_stream(spark, sf):
    done = spark.read.parquet(_triaged(spark, sf))
    return done.select("ticket_id", "intent", "decision", "reason", "reply", "signal_count")


@query
def triage_batches(spark, sf):
    """The batch decision job on every micro-batch, after thread lengths from the stream's state."""
    path, state = new_path(spark, "batches"), new_path(spark, "batches-state")

    def decide(frame):
        cleaned = frame.withColumn("text", tx.clean_or_raw(F.col("raw_text")))
        return rules.escalate(rules.rules_regex(cleaned)).select("ticket_id", "decision", "signal_count")

    _arriving(spark, sf, lambda stream: streams.each_batch(_counted(stream), decide, path, state))
    return spark.read.parquet(path).drop("batch")


@query
def thread_length_stream(spark, sf):
    path, state = new_path(spark, "lengths"), new_path(spark, "lengths-state")
    _arriving(spark, sf, lambda stream: streams.to_parquet(_counted(stream), path, state))
    return spark.read.parquet(path).select("ticket_id", "thread_length")


@query
def thread_length_final(spark, sf):
    """Final lengths of the messages that the watermark has passed."""
    path, state = new_path(spark, "final"), new_path(spark, "final-state")

    def start(stream):
        with rocksdb_state(spark):
            final = streams.final_thread_length_stream(stream, ["user_id", "day"], "ts", "ticket_id")
            return streams.to_parquet(final, path, state)

    _arriving(spark, sf, start)
    return spark.read.parquet(path).select("ticket_id", "thread_length")


def _differing(rows, others, key, columns):
    """Number of rows, and of those whose columns differ from the others' of their key; columns meet as their SHA-256."""

    def digests(df, prefix):
        return df.select(key, *[F.unhex(F.sha2(F.col(c).cast("binary"), 256)).alias(f"{prefix}{c}") for c in columns])

    both = digests(rows, "").join(digests(others, "_").hint("merge"), key, "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"_{c}").eqNullSafe(F.col(c))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("differing"))


@query
def triage_stream_retrieval(spark, sf):
    """Arriving messages triaged with retrieval from a stored index, against the batch job: rows, and rows that differ."""
    corpus = threads.build_threads(views.message_log(spark, sf), BRAND)
    embedded, fitted = jobs.embed_corpus(corpus)
    path, state, at = new_path(spark, "answered"), new_path(spark, "answered-state"), new_path(spark, "threads")
    index = SearchIndex.create(freeze(embedded), at, CELLS, "thread_id", seed=SEED)
    stored = index.rows()

    def decide(frame):
        done = jobs.triage(
            frame.drop("text"), stored, search=lambda texts: index.search(texts, query_id="_text_key"), fitted=fitted
        )
        return done.select("ticket_id", "decision", "reply", "retrieved_context")

    _arriving(spark, sf, lambda stream: streams.each_batch(_counted(stream), decide, path, state))
    batch = jobs.triage(views.raw_tickets(spark, sf), corpus)
    return _differing(batch, spark.read.parquet(path), "ticket_id", ("decision", "reply", "retrieved_context"))


@query
def session_length_stream(spark, sf):
    """Sessions that the watermark has closed."""
    found = streams.session_length_stream(_ticket_stream(spark, sf), "user_id", "ts", "6 hours", "1 hour")
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("session_start", "session_end")}
    return _drained(spark, found, "sessions").withColumns(shown)


@query
def escalation_rates(spark, sf):
    """Hourly windows that the watermark has closed."""
    path = _triaged(spark, sf)
    decided = streams.stream_table(spark, path, spark.read.parquet(path).schema)
    rates = streams.escalation_rates(decided.select("ts", "decision"))
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    return _drained(spark, rates, "rates").withColumns(shown)


@query
def escalation_rates_sliding(spark, sf):
    """Two-hour windows every half hour, on the batch decisions."""
    rates = streams.escalation_rates(_decided(spark, sf), width="2 hours", slide="30 minutes")
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    return rates.withColumns(shown)
