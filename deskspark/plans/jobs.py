"""The five end-to-end jobs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark import lexicon as lx
from deskspark.functions.text import clean_or_raw, normalize_reply
from deskspark.operators import agreement, cluster, features, metrics, retrieve, rules, sampling, threads
from deskspark.operators.grouped import attach, top_n_per_group
from deskspark.operators.guard import guard_reply
from deskspark.sources.scratch import freeze


def prepare(
    messages: DataFrame, brand: str, n: int = 5000, seed: int = 42, min_length: int = threads.MIN_LENGTH
) -> tuple[DataFrame, DataFrame]:
    """(sampled threads, their customer messages) from a flat message log."""
    found = threads.build_threads(messages, brand, min_length)
    sample = sampling.sample_n(found, n, seed, "customer_tweet_id")
    return sample, threads.customer_messages(sample)


Search = Callable[[DataFrame], DataFrame]


def retrieve_context(
    texts: DataFrame, corpus: DataFrame, text_key: str, brand: str, k: int = 3, vector: str = "embedding",
    cells: int | None = None, probes: int | None = None, intent: str | None = None,
    defaults: Sequence[Mapping] = (), search: Search | None = None,
) -> DataFrame:
    """(text_key, retrieved_context) of the texts with hits in an embedded thread corpus.

    With ``cells`` and ``probes`` the search is by k-means cells, with ``intent`` (a column of both sides) among
    rows of that intent, with ``search`` by a function that gives (text_key, thread_id, similarity, rank), such as
    a stored index; else exact. Texts without a hit get the ``defaults``.
    """
    if search:
        hits = search(texts)
    elif intent:
        hits = retrieve.knn_by_label(texts, corpus, intent, k, text_key, "thread_id", vector)
    elif cells:
        hits = retrieve.knn_cells(texts, corpus, cells, probes or cells, k, text_key, "thread_id", vector)
    else:
        hits = retrieve.knn(texts, corpus, k, text_key, "thread_id", vector)
    # Texts take many times the bytes of their compressed files, by which Spark would broadcast them.
    shown = hits.join(corpus.select("thread_id", "customer_msg", "brand_reply").hint("merge"), "thread_id")
    if defaults:
        shown = retrieve.with_fallback(shown, texts, defaults, text_key, k)
    return retrieve.format_context(shown, brand, text_key)


def embed_corpus(
    corpus: DataFrame, encoder: features.Encoder | None = None
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame] | None]:
    """(threads with ``text`` and ``embedding``, the fitted text features or None with an encoder).

    The threads are stored: fitting reads them several times.
    """
    base = freeze(corpus.select("thread_id", "customer_msg", "brand_reply", F.col("customer_msg").alias("text")))
    fitted = None if encoder else features.fit_tfidf(base, hashed=features.EMBEDDING_DIMS, output="_features")
    return features.embed(base, encoder=encoder, fitted=fitted), fitted


def triage(
    messages: DataFrame,
    corpus: DataFrame,
    policy: lx.EscalationPolicy = lx.EscalationPolicy(),
    classify: Callable[[DataFrame], DataFrame] = rules.rules_substring,
    encoder: features.Encoder | None = None,
    templates: Mapping[str, str] = lx.REPLY_TEMPLATES,
    signoffs: Sequence[str] = lx.SIGNOFFS,
    k: int = 3,
    text: str = "raw_text",
    cells: int | None = None,
    probes: int | None = None,
    by_intent: bool = False,
    defaults: Sequence[Mapping] = (),
    search: Search | None = None,
    fitted: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One triage record per message: intent, reply, guard result, decision and reason.

    Messages need ``text`` and ``thread_length``; the corpus needs thread_id,
    customer_msg and brand_reply. Equal texts are embedded and searched once,
    whatever their share of the messages, and the result is joined back with hot texts dealt out. Labelled messages
    and the embedded corpus are read several times and stored, so each is worked out once.
    ``by_intent`` searches among threads whose message gets the same intent, and all threads
    where there are none; ``defaults`` are shown to messages without a hit. ``search`` (see
    :func:`retrieve_context`) with the ``fitted`` features of :func:`embed_corpus` searches a stored index
    instead of embedding the corpus.
    """
    kept = [c for c in messages.columns if c not in ("intent", "confidence", "text")]
    cleaned = messages.select(*kept, clean_or_raw(F.col(text)).alias("text"))
    labelled = freeze(classify(cleaned))
    if by_intent:
        labelled = labelled.withColumn("_text_key", F.md5(F.concat_ws("\n", "intent", "text")))
    else:
        labelled = labelled.withColumn("_text_key", F.md5("text"))
    grouping = ["_text_key", "text", *(["intent"] if by_intent else [])]
    texts = freeze(labelled.groupBy(*grouping).agg(F.count(F.lit(1)).alias("_copies")))
    if search:
        base = corpus
    else:
        base, fitted = embed_corpus(corpus, encoder)
        if by_intent:
            kinds = classify(base.drop("embedding")).select("thread_id", "intent")
            base = base.join(kinds, "thread_id")
        base = freeze(base.drop("text"))
    asked = features.embed(texts.drop("_copies"), encoder=encoder, fitted=fitted).drop("text")
    contexts = retrieve_context(
        asked, base, "_text_key", policy.brand, k, cells=cells, probes=probes,
        intent="intent" if by_intent else None, defaults=defaults, search=search,
    )
    sized = freeze(contexts.join(texts.select("_text_key", "_copies").hint("merge"), "_text_key"))
    drafted = rules.canned_reply(labelled, templates).withColumn(
        "reply", normalize_reply(F.col("reply"), signoffs)
    )
    # Messages of one text differ in some other column; wholly equal ones stay together.
    differs = F.xxhash64(*[F.col(c) for c in kept])
    grounded = attach(drafted, sized, "_text_key", "_copies", differs).withColumn(
        "retrieved_context", F.coalesce("retrieved_context", F.lit(lx.NO_CONTEXT))
    )
    guarded = guard_reply(grounded, context="retrieved_context").withColumn("reply", F.col("sanitized_reply"))
    decided = rules.escalate(guarded, policy)
    return decided.withColumn("model_type", F.lit("full_system")).drop("_text_key", "_copies", "sanitized_reply")


def system_columns(
    df: DataFrame, policy: lx.EscalationPolicy = lx.EscalationPolicy(), constant_intent: str | Column = lx.INTENTS[0]
) -> tuple[DataFrame, dict[str, dict[str, Column]]]:
    """Predictions of the constant, simple and full systems as columns of one table."""
    keep = df.columns
    simple = rules.escalate_simple(rules.rules_regex(df, intent="simple_intent")).select(
        *keep, "simple_intent", F.col("decision").alias("simple_decision")
    )
    full = rules.escalate(rules.rules_substring(simple.drop("confidence"), intent="intent"), policy).select(
        *[c for c in keep if c not in ("confidence", "intent")],
        "simple_intent", "simple_decision",
        F.col("intent").alias("full_intent"), F.col("decision").alias("full_decision"),
    )
    constant = F.lit(constant_intent) if isinstance(constant_intent, str) else constant_intent
    return full, {
        "trivial_baseline": {"intent": constant, "decision": F.lit(lx.ESCALATE)},
        "simple_baseline": {"intent": F.col("simple_intent"), "decision": F.col("simple_decision")},
        "full_system": {"intent": F.col("full_intent"), "decision": F.col("full_decision")},
    }


def predictions(
    golden: DataFrame, key: str, policy: lx.EscalationPolicy = lx.EscalationPolicy(),
    constant_intent: str | Column = lx.INTENTS[0],
) -> DataFrame:
    """(key, true_intent, true_action, model, intent, decision) of the three systems, one golden scan.

    Rows without a label are no truth to compare with and are left out.
    """
    labelled = golden.where("true_intent IS NOT NULL AND true_action IS NOT NULL")
    wide, systems = system_columns(labelled, policy, constant_intent)
    return metrics.stack_columns(wide, systems, [key, "true_intent", "true_action"])


def evaluate(
    golden: DataFrame,
    key: str,
    ratings: DataFrame | None = None,
    rated_rows: int = 15,
    policy: lx.EscalationPolicy = lx.EscalationPolicy(),
    base: str = "simple_baseline",
    systems: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """One metrics row per system on golden rows (text, true_intent, true_action, thread_length).

    ``systems`` maps names to functions that turn golden rows without their truth into (key, intent, decision);
    without it the constant, simple and full systems are scored. A row that a system gives no answer for
    counts as a wrong one. Golden rows are stored once for all systems. ``base`` names the system that deltas refer
    to. ``ratings`` (model, key, the three dimensions) are averaged over a systematic sample of golden rows.
    """
    if systems:
        truth = freeze(golden.where("true_intent IS NOT NULL AND true_action IS NOT NULL"))
        asked = truth.drop("true_intent", "true_action")
        wanted = truth.select(key, "true_intent", "true_action")
        answers = {
            name: wanted.join(system(asked).select(key, "intent", "decision"), key, "left")
            for name, system in systems.items()
        }
        rows = metrics.compare(metrics.stack_predictions(answers), base)
    else:
        rows = metrics.compare(predictions(golden, key, policy), base)
    if ratings is None:
        return rows
    dims = lx.RATING_DIMENSIONS
    drawn = sampling.systematic_sample(golden.select(key), rated_rows, key).select(key)
    means = metrics.rating_means(ratings.join(drawn, key, "left_semi"), dims, ["model"])
    return rows.join(means, "model", "left")


def calibrate(pairs: DataFrame, dims: Sequence[str] = tuple(lx.RATING_DIMENSIONS), tol: float = 1.0) -> DataFrame:
    """Agreement, Spearman's rho and its p-value per dimension, and for the mean of the dimensions.

    ``pairs`` holds rater A as <dim> and rater B as b_<dim>, on a rating scale of
    few values. A row counts in the average only if both raters gave every rating.
    """
    mean_a = sum((F.col(d) for d in dims[1:]), F.col(dims[0])) / len(dims)
    mean_b = sum((F.col(f"b_{d}") for d in dims[1:]), F.col(f"b_{dims[0]}")) / len(dims)
    both = pairs.withColumns({"average": F.round(mean_a, 2), "b_average": F.round(mean_b, 2)})
    every = [*dims, "average"]
    rates = agreement.agreement(both, every, tol)
    rho = agreement.with_p_value(agreement.spearman(agreement.unpivot_pairs(both, every), few_values=True))
    return rates.join(rho.drop("n"), "dimension", "left")


def calibration_summary(report: DataFrame) -> DataFrame:
    """Means over the rating dimensions, computed from the report."""
    return report.where(F.col("dimension") != "average").agg(
        F.avg("rho").alias("mean_rho"),
        F.avg("within_tolerance").alias("mean_within_tolerance"),
        F.avg("exact_agreement").alias("mean_exact_agreement"),
    )


def discover(
    df: DataFrame,
    key: str,
    text: str = "text",
    ks: Sequence[int] = cluster.KS,
    k: int = 8,
    seed: int = 42,
    n_init: int = cluster.N_INIT,
    encoder: features.Encoder | None = None,
    examples: int = 5,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k sweep, cluster summary, cluster examples) of a message column.

    Equal texts are embedded and fitted once, with their number as weight; the sweep's silhouettes are on
    squared distance, in linear time. The first rows of a cluster are among the first of their texts, so only
    those meet the clusters.
    """
    rows = df.where(F.col(text).isNotNull())
    texts = freeze(rows.groupBy(text).agg(F.count(F.lit(1)).alias("_copies")))
    fitted = None if encoder else features.fit_tfidf(
        texts, text, hashed=features.EMBEDDING_DIMS, output="_features", weight="_copies"
    )
    embedded = freeze(features.embed(texts, text, encoder, fitted))
    models = cluster.fit_many(cluster.points(embedded, weight="_copies"), sorted({*ks, k}), seed, n_init)
    swept = {x: models[x] for x in ks if x in models}
    sweep = cluster.sweep_k(embedded, ks, seed, n_init, metric="squared", weight="_copies", models=swept)
    assigned = freeze(cluster.kmeans(embedded, k, model=models.get(k)).select(text, "_copies", "cluster"))
    first = top_n_per_group(rows.select(text, key), [text], [F.col(key)], examples).drop("rank")
    shown = cluster.cluster_examples(first.join(assigned, text).select("cluster", key, text), [F.col(key)], examples)
    return sweep, cluster.cluster_summary(assigned, weight="_copies"), shown
