import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskspark import lexicon as lx
from deskspark.operators import (
    agreement,
    classify,
    cluster,
    features,
    grouped,
    metrics,
    profile,
    retrieve,
    sampling,
    threads,
)
from deskspark.plans import jobs
from deskspark.sources import tables
from deskspark.sources.scratch import freeze
from deskspark.workload.views import DEFAULT_EXAMPLES


# --- Threads ---


LOG = [
    (1, "c1", "t1", "@brand my parcel is late", None),
    (2, "brand", "t5", "sorry @c1", "1.0"),
    (3, "brand", "t3", "first answer", "1"),
    (4, "c2", "t1", "four", None),
    (5, "brand", "t2", "short one", "4"),
    (6, "c3", "t1", "fives", None),
    (7, "brand", "t2", "to the short one", "6"),
    (8, "c4", "t1", "an answer to a thread", "6"),
    (9, "brand", "t3", "to the follow-up", "8"),
    (10, "brand", "t1", "an announcement", None),
    (11, "brand", "t2", "own reply", "10"),
    (12, "brand", "t2", "bad pointer", "x"),
]
SCHEMA = "tweet_id long, author_id string, created_at string, text string, in_response_to_tweet_id string"


def test_threads_take_the_first_reply(spark):
    got = threads.build_threads(spark.createDataFrame(LOG, SCHEMA), "brand").orderBy("thread_id").collect()
    assert [(r["thread_id"], r["customer_msg"], r["brand_reply"], r["created_at"], r["message_created_at"]) for r in got] == [
        ("thread_1", "my parcel is late", "first answer", "t3", "t1"),
        ("thread_6", "fives", "to the short one", "t2", "t1"),
    ]
    kept = threads.build_threads(spark.createDataFrame(LOG, SCHEMA), "brand", keep_brand_posts=True)
    assert kept.count() == 3


def test_prepare_samples_threads_and_messages_alike(spark):
    sample, messages = jobs.prepare(spark.createDataFrame(LOG, SCHEMA), "brand", 1, 42)
    assert [r["customer_tweet_id"] for r in sample.collect()] == [r["tweet_id"] for r in messages.collect()]


def test_running_count_on_a_hot_key(spark):
    rows = [(i, 1 if i % 3 else i, i * 37 % 10000) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, user long, second long").withColumn("ts", F.timestamp_seconds("second"))
    got = {r["id"]: r["thread_length"] for r in threads.thread_length(df, ["user"], "ts", ["ts", "id"], slice_width="minute").collect()}
    seen, want = {}, {}
    for i, user, second in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = seen[user] = seen.get(user, 0) + 1
    assert got == want


def placed(spark, rows):
    df = spark.createDataFrame(rows, "tweet_id long, in_response_to_tweet_id string").repartition(4)
    return {r["tweet_id"]: (r["root_id"], r["depth"], r["cyclic"], r["thread_size"]) for r in threads.reply_depth(df).collect()}


def test_reply_depth_with_cycles_and_lost_parents(spark):
    rows = [(1, None), (2, "1"), (3, "2.0"), (4, "1"), (5, "99"), (6, "5"), (7, "x")]
    rows += [(10, "12"), (11, "10"), (12, "11"), (13, "12"), (14, "14")]
    got = placed(spark, rows)
    assert got == {
        1: (1, 0, False, 4), 2: (1, 1, False, 4), 3: (1, 2, False, 4), 4: (1, 1, False, 4),
        5: (5, 0, False, 2), 6: (5, 1, False, 2), 7: (7, 0, False, 1),
        **{i: (None, None, True, None) for i in (10, 11, 12, 13, 14)},
    }
    assert placed(spark, rows[:1]) == {1: (1, 0, False, 1)}


def test_reply_depth_of_a_long_chain(spark):
    n = 10_000
    got = placed(spark, [(i, str(i - 1) if i else None) for i in range(n)] + [(n + i, "0") for i in range(50)])
    assert all(got[i] == (0, i, False, n + 50) for i in range(n)) and got[n + 7] == (0, 1, False, n + 50)


def test_attach_deals_hot_keys_out(spark):
    rows = spark.range(4000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> '1'")
    got = grouped.attach(rows, sizes, "k", "n", F.col("id"))
    assert got.count() == 4000 and got.where("n IS NULL").count() == 1
    assert got.where("k = 'hot' AND n = 1334").count() == 1334


# --- Order and samples ---


def test_position_and_running_total(spark):
    values = [(i * 7919 % 1009, i % 5) for i in range(1000)]
    df = spark.createDataFrame(values, "x long, v long").repartition(6)
    ordered = sorted(values)
    placed = {r["x"]: r["position"] for r in grouped.with_position(df, ["x"]).collect()}
    assert placed == {x: i for i, (x, _) in enumerate(ordered)}
    totals = {r["x"]: r["running"] for r in grouped.running_total(df, ["x"], "v").collect()}
    assert totals == {x: int(s) for (x, _), s in zip(ordered, np.cumsum([v for _, v in ordered]))}


@pytest.mark.parametrize("n, m", [(208, 15), (10, 15), (15, 15), (1, 15), (1000, 1)])
def test_systematic_sample(spark, n, m):
    got = sorted(r["id"] for r in sampling.systematic_sample(spark.range(n), m, "id").collect())
    want = list(range(n)) if n <= m else [i * (n - 1) // max(m - 1, 1) for i in range(m)]
    assert got == want


def test_sample_n_does_not_depend_on_partitions(spark):
    df = spark.range(500)
    small = {r["id"] for r in sampling.sample_n(df.repartition(7), 50, 42, "id").collect()}
    assert small == {r["id"] for r in sampling.sample_n(df.coalesce(1), 50, 42, "id").collect()} and len(small) == 50
    ordered = df.orderBy(sampling.hash_order(42, "id"), "id")
    for n in (0, 1, 50, 499, 500):
        got = {r["id"] for r in sampling.sample_n(df, n, 42, "id").collect()}
        assert got == {r["id"] for r in ordered.limit(n).collect()}
    assert sampling.sample_n(df, 900, 42, "id").count() == 500


def test_sample_n_cuts_shared_and_null_keys(spark):
    rows = [(None, 0)] * 3 + [("hot", i // 2) for i in range(400)] + [(f"k{i}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, v int").repartition(5)
    for n in (2, 3, 50, 250, 420, 503):
        drawn = sampling.sample_n(df, n, 7, "key").collect()
        assert len(drawn) == n
        assert sum(r["key"] is None for r in drawn) == min(n, 3)
    twice = [sorted(map(tuple, sampling.sample_n(d, 250, 7, "key").collect()), key=repr) for d in (df, df.coalesce(1))]
    assert twice[0] == twice[1]


def test_a_draw_neither_sorts_nor_shuffles(spark):
    plan = sampling.sample_n(spark.range(5000), 700, 1, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "TakeOrdered" not in plan


def test_top_n_salted_equals_plain(spark, monkeypatch):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("g"), "id")
    plain = {tuple(r) for r in grouped.top_n_per_group(df, ["g"], [F.col("id")], 40).collect()}
    monkeypatch.setattr(grouped, "GROUP_LIMIT_THRESHOLD", 5)
    assert plain == {tuple(r) for r in grouped.top_n_per_group(df, ["g"], [F.col("id")], 40).collect()}


def test_backfill_has_quota_and_no_duplicates(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 10, "rare").when(F.col("id") < 250, "hot").alias("s"))
    rows = sampling.stratified_backfill(df, "s", 20, 60, 1, "id").collect()
    assert len({r["id"] for r in rows}) == len(rows) == 60
    quota = [r["s"] for r in rows if r["origin"] == "quota"]
    assert (quota.count("rare"), quota.count("hot")) == (10, 20)


# --- Profile ---


def test_quotas_win_over_the_total(spark):
    df = spark.range(90).selectExpr("id", "cast(id % 3 AS string) AS s")
    rows = sampling.stratified_backfill(df, "s", 20, 30, 1, "id").collect()
    assert sorted(Counter((r["s"], r["origin"]) for r in rows).items()) == [((str(i), "quota"), 20) for i in range(3)]


def test_embeddings_of_repeated_ids_are_stored_once(spark, tmp_path):
    twice = spark.createDataFrame([(1,), (1,), (2,)], "id bigint")
    stored = tables.materialize_embeddings(twice, str(tmp_path / "vectors"), lambda frame: frame, "id")
    assert sorted(r["id"] for r in stored.collect()) == [1, 2]


def test_one_odd_value_among_many_is_not_constant(spark):
    pairs = spark.createDataFrame([("d", 1.0, 1.0)] * 999 + [("d", 2.0, 2.0)], "dimension string, a double, b double")
    assert agreement.spearman(pairs).first()["rho"] == pytest.approx(1.0)


def test_bigrams_form_after_stop_words(spark):
    df = spark.createDataFrame([("The Late, to parcel late parcel",), ("late café parcel",), (None,)], "text string")
    got = [(r["bigram"], r["n"]) for r in profile.top_bigrams(df, n=2).collect()]
    assert got == [("late parcel", 3), ("parcel late", 1)]


@pytest.mark.parametrize("flat", [0.0, 0.6, 1.6])
def test_sketched_bigrams_equal_the_full_count(spark, flat):
    rng = np.random.default_rng(4)
    weights = 1.0 / np.arange(1, 400) ** (2.0 - flat)
    words = np.array([f"w{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(399)])
    drawn = rng.choice(words, (800, 30), p=weights / weights.sum())
    df = spark.createDataFrame([(" ".join(row),) for row in drawn], "text string").repartition(7)
    want = [tuple(r) for r in profile.top_bigrams(df, n=15).collect()]
    for sketches in ((96,), (768, 6_144), (), (49_152,)):
        assert [tuple(r) for r in profile.frequent_bigrams(df, n=15, sketches=sketches).collect()] == want


def test_sketches_certify_or_refuse(spark):
    pairs = spark.range(40_000).selectExpr("CASE WHEN id % 4 = 0 THEN 'hot' ELSE cast(id AS string) END AS bigram").repartition(5)
    assert profile._candidates(pairs, 1, 768) == ["hot"]
    assert profile._candidates(pairs, 2, 768) is None
    assert len(profile._candidates(pairs.limit(500), 600, 768)) == pairs.limit(500).distinct().count()
    assert profile._candidates(pairs.where("bigram = 'x'"), 3, 768) == []


def test_sketched_bigrams_of_few_rows(spark):
    df = spark.createDataFrame([("The Late, to parcel late parcel",), ("late café parcel",), (None,), ("",)], "text string")
    assert [tuple(r) for r in profile.frequent_bigrams(df, n=2).collect()] == [("late parcel", 3), ("parcel late", 1)]
    assert profile.frequent_bigrams(df, n=0).count() == 0
    assert profile.frequent_bigrams(df.where("text = 'x'")).count() == 0


def test_length_profile_quartiles(spark):
    df = spark.createDataFrame([("a " * n,) for n in (1, 2, 3, 4)], "text string")
    row = profile.length_profile(df).first()
    assert (row["p25_words"], row["median_words"], row["p75_words"], row["mean_words"]) == (1.75, 2.5, 3.25, 2.5)


def test_fold_rare(spark):
    df = spark.createDataFrame([("a",)] * 97 + [("b",)] * 3 + [("c",)] * 1, "c string")
    counts = {r["c"]: r["count"] for r in profile.fold_rare(df, "c").groupBy("c").count().collect()}
    assert counts == {"a": 97, "other": 4}


# --- Metrics ---


def pairs(spark, tp, fp, fn, n):
    rows = [("escalate", "escalate")] * tp + [("auto_handle", "escalate")] * fp + [("escalate", "auto_handle")] * fn
    rows += [("auto_handle", "auto_handle")] * (n - tp - fp - fn)
    return spark.createDataFrame(rows, "t string, p string")


@pytest.mark.parametrize(
    "counts, wanted",
    [
        ((32, 20, 21, 170), (0.6154, 0.6038, 0.6095, 0.7588)),
        ((48, 18, 10, 208), (0.7273, 0.8276, 0.7742, 0.8654)),
        ((53, 117, 0, 170), (0.3118, 1.0, 0.4753, 0.3118)),
        ((58, 150, 0, 208), (0.2788, 1.0, 0.4361, 0.2788)),
        ((0, 0, 5, 10), (0.0, 0.0, 0.0, 0.5)),
    ],
)
def test_binary_prf_published_arithmetic(spark, counts, wanted):
    row = metrics.binary_prf(pairs(spark, *counts), "t", "p").first()
    assert tuple(round(row[c], 4) for c in ("precision", "recall", "f1", "accuracy")) == wanted


def test_macro_counts_classes_only_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c")], "t string, p string")
    row = metrics.macro_prf(df, "t", "p").first()
    assert row["classes"] == 3
    assert row["macro_f1"] == pytest.approx((2 / 3 + 0 + 1) / 3)


def test_confusion_wide_fills_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "t string, p string")
    rows = {r["t"]: (r["a"], r["b"], r["c"]) for r in metrics.confusion_wide(df, "t", "p", ["a", "b", "c"]).collect()}
    assert rows == {"a": (1, 1, 0), "c": (1, 0, 0)}


def test_fn_reduction(spark):
    rows = [("simple_baseline", 0.5, 0.4, 37), ("full_system", 0.6, 0.6, 21)]
    df = spark.createDataFrame(rows, "model string, intent_accuracy double, escalate_f1 double, false_negative_count long")
    got = {r["model"]: r["fn_reduction_pct"] for r in metrics.with_deltas(df, "simple_baseline").collect()}
    assert round(got["full_system"], 1) == 43.2 and got["simple_baseline"] == 0


# --- Agreement ---


def test_spearman_both_ways_and_constants(spark):
    rows = [("d", float(a), float(b)) for a, b in [(1, 2), (2, 2), (2, 5), (4, 3), (5, 9), (5, 1)]]
    rows += [("flat", 4.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "dimension string, a double, b double")
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["d", "a", "b"]).query("d == 'd'")
    want = np.corrcoef(frame["a"].rank(), frame["b"].rank())[0, 1]
    for few in (True, False):
        got = {r["dimension"]: r["rho"] for r in agreement.spearman(df, few).collect()}
        assert got["d"] == pytest.approx(want) and got["flat"] is None


def test_p_values_against_known_points():
    # t distribution: |t| = 2.228 at 10 degrees of freedom and 12.706 at 1 give p = 0.05
    for t, dof in ((2.2281388519649385, 10), (12.706204736432095, 1), (1.9839715184496334, 100)):
        rho = t / math.sqrt(dof + t * t)
        assert agreement.t_two_sided(rho, dof + 2) == pytest.approx(0.05, abs=1e-9)
    assert agreement.t_two_sided(0.0, 30) == 1.0 and agreement.t_two_sided(None, 30) is None


def test_kappa(spark):
    def kappa(rows):
        return agreement.cohens_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()["kappa"]

    assert kappa([("x", "x"), ("y", "y")]) == 1.0
    assert kappa([("x", "x"), ("x", "x")]) is None
    assert kappa([("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")]) == pytest.approx(0.0)


def test_missing_ratings_are_left_out_or_marked(spark):
    a = spark.createDataFrame([(1, 4), (2, 5)], "id int, tone int")
    b = spark.createDataFrame([(1, 3)], "id int, tone int")
    left_out = agreement.agreement(agreement.pair_ratings(a, b, "id", ["tone"]), ["tone"]).first()
    assert (left_out["n"], left_out["exact_agreement"], left_out["within_tolerance"]) == (1, 0.0, 1.0)
    marked = agreement.pair_ratings(a, b, "id", ["tone"], impute=True).orderBy("id").collect()
    assert [(r["b_tone"], r["imputed"]) for r in marked] == [(3, False), (5, True)]


def test_own_systems_are_scored(spark):
    rows = [(i, "x", "cancellation" if i % 2 else "refund_return", "escalate" if i < 3 else "auto_handle") for i in range(8)]
    golden = spark.createDataFrame(rows + [(9, "x", None, "escalate")], "id int, text string, true_intent string, true_action string")
    right = lambda df: df.select("id", F.when(F.col("id") % 2 == 1, "cancellation").otherwise("refund_return").alias("intent"), F.when(F.col("id") < 3, "escalate").otherwise("auto_handle").alias("decision"))
    scores = jobs.evaluate(golden, "id", base="half", systems={"right": right, "half": lambda df: right(df).where("id < 4")})
    got = {r["model"]: (r["n"], r["intent_accuracy"], r["escalate_recall"], r["escalation_accuracy"]) for r in scores.collect()}
    assert got == {"right": (8, 1.0, 1.0, 1.0), "half": (8, 0.5, 1.0, 1.0)}
    pairs = golden.where("true_intent IS NOT NULL").withColumn("decision", F.lit("escalate"))
    levels = {(r["true_intent"], r["level"]): (r["tp"], r["fp"]) for r in metrics.binary_rollup(pairs, "true_action", "decision", ["true_intent"]).collect()}
    assert levels == {("cancellation", 0): (1, 3), ("refund_return", 0): (2, 2), (None, 1): (3, 5)}


def counted(spark, df, column):
    """``df`` with ``column`` passed through a function, and the number of rows it has seen."""
    seen = spark.sparkContext.accumulator(0)

    def passed(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(passed, "string")(column)), seen


def test_golden_rows_are_worked_out_once_for_all_systems(spark):
    rows = [(i, f"late parcel {i}", "cancellation", "escalate") for i in range(6)]
    golden = spark.createDataFrame(rows, "id int, text string, true_intent string, true_action string")
    golden, seen = counted(spark, golden, "text")
    own = lambda word: lambda df: df.select("id", F.lit("cancellation").alias("intent"), F.when(F.col("text").contains(word), "escalate").alias("decision"))
    scores = jobs.evaluate(golden, "id", base="a", systems={"a": own("late"), "b": own("parcel")}).collect()
    assert {(r["model"], r["n"], r["intent_accuracy"], r["escalate_recall"]) for r in scores} == {("a", 6, 1.0, 1.0), ("b", 6, 1.0, 1.0)}
    assert seen.value == 6


def test_triage_works_out_messages_and_threads_once(spark):
    texts = ["my parcel is late", "my parcel is late", "refund my lamp", None]
    messages = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, raw_text string, thread_length int")
    corpus = spark.createDataFrame(
        [("t1", "the parcel is late again", "on its way"), ("t2", "lamp refund please", "refunded")],
        "thread_id string, customer_msg string, brand_reply string",
    )
    messages, read = counted(spark, messages, "raw_text")
    corpus, found = counted(spark, corpus, "customer_msg")
    got = {r["id"]: r for r in jobs.triage(messages, corpus).collect()}
    assert sorted(got) == [0, 1, 2, 3] and [got[i]["raw_text"] for i in range(4)] == texts
    assert "the parcel is late again" in got[1]["retrieved_context"] and got[0]["reply"] == got[1]["reply"]
    assert (read.value, found.value) == (4, 2)


# --- Retrieval ---


def brute(queries, corpus, k):
    hits = {}
    for q, x in queries.items():
        ranked = sorted(((round(float(np.dot(x, y)), 9), c) for c, y in corpus.items()), reverse=True)[:k]
        hits[q] = [c for _, c in ranked]
    return hits


@pytest.mark.parametrize("block_rows", [4096, 32, 7])
def test_knn_is_exact_with_copies_and_zero_vectors(spark, block_rows):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(240, 8)) * rng.uniform(0.2, 2, size=(240, 1))
    vectors[100:180] = vectors[100]  # a third are copies
    vectors[7] = 0.0
    corpus = {i: v.astype(np.float32).astype(float) for i, v in enumerate(vectors)}
    queries = {i: corpus[i] for i in range(0, 240, 5)} | {1007: np.zeros(8)}
    make = lambda rows, key: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], f"{key} long, embedding array<double>").repartition(3)
    got = retrieve.knn(make(queries, "query_id"), make(corpus, "corpus_id"), 4, block_rows=block_rows)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["corpus_id"])
    assert found == brute(queries, corpus, 4)
    every_cell = retrieve.knn_cells(make(queries, "query_id"), make(corpus, "corpus_id"), 6, 6, 4, block_rows=block_rows)
    assert sorted(map(tuple, every_cell.collect())) == sorted(map(tuple, got.collect()))
    empty = make(corpus, "corpus_id").limit(0)
    assert retrieve.knn_cells(make(queries, "query_id"), empty, 6, 2).count() == 0


def test_codes_find_neighbours_and_are_exact_with_whole_lists(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 10))
    vectors[100:200] = vectors[100]  # a third are copies
    corpus = {i: v.astype(np.float32).astype(float) for i, v in enumerate(vectors)}
    queries = {i: corpus[i] for i in range(0, 300, 7)}
    make = lambda rows, key: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], f"{key} long, embedding array<double>").repartition(3)
    asked, base = make(queries, "query_id"), make(corpus, "corpus_id")
    codes = retrieve.fit_codes(base, 4, subspaces=4)
    want = brute(queries, corpus, 3)

    def found(short, probes=4):
        hits = {}
        for r in retrieve.knn_codes(asked, base, 4, probes, short, 3, codes=codes, block_rows=64).orderBy("query_id", "rank").collect():
            hits.setdefault(r["query_id"], []).append(r["corpus_id"])
        return hits

    assert found(300) == want
    few = found(15)
    assert sum(len(set(few[q]) & set(want[q])) for q in want) >= 0.9 * 3 * len(want)
    assert all(len(x) <= 3 for x in found(15, 1).values())
    assert retrieve.knn_codes(asked, base.limit(0), 4, 4, 5).count() == 0


def test_search_groups_receive_few_copies_of_a_row(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "corpus_id long, embedding array<double>").repartition(2)
    asked = df.withColumnRenamed("corpus_id", "query_id")

    def counting(k, schema, *rest):
        def received(queries, corpus):
            return pa.table({"_qid": [queries.num_rows], "_cid": [corpus.num_rows], "similarity": [0.0]}).cast(schema)

        return received

    monkeypatch.setattr(retrieve, "_search_block", counting)
    monkeypatch.setattr(retrieve, "_ranked", lambda hits, *rest: hits)
    got = retrieve.knn(asked, df, 3, block_rows=64).agg(F.sum("_qid"), F.sum("_cid")).first()
    assert got[0] <= 2 * 3000 and got[1] <= 32 * 3000


def test_codes_of_all_cells_are_scanned_once_per_query(spark, monkeypatch):
    rows = [(i, [math.sin(i * j) for j in range(1, 9)]) for i in range(200)]
    df = spark.createDataFrame(rows, "corpus_id long, embedding array<double>")
    asked = df.withColumnRenamed("corpus_id", "query_id")
    sent = []
    parts = retrieve._search_parts
    monkeypatch.setattr(retrieve, "_search_parts", lambda queries, *rest: sent.append(queries.count()) or parts(queries, *rest))
    codes = retrieve.fit_codes(df, 4, subspaces=4)
    whole, few = (retrieve.knn_codes(asked, df, 4, 4, n, 1, codes=codes) for n in (200, 60))
    assert sent == [0, 200, 200, 0]
    want = {tuple(r) for r in retrieve.knn(asked, df, 1).collect()}
    assert {tuple(r) for r in whole.collect()} == want
    assert len({tuple(r) for r in few.collect()} & want) >= 190


def test_whole_short_lists_are_no_pairs(spark, monkeypatch):
    rows = [(i, [math.sin(i * j) for j in range(1, 9)]) for i in range(200)]
    df = spark.createDataFrame([*rows, rows[5]], "corpus_id long, embedding array<double>").repartition(2)
    asked = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    hits = []
    ranked = retrieve._ranked
    monkeypatch.setattr(retrieve, "_ranked", lambda found, *rest: hits.append(found) or ranked(found, *rest))
    got = retrieve.knn_codes(asked, df, 4, 4, 201, 1)
    assert hits[-1].count() <= 200 * 4 * 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieve.knn(asked, df, 1).collect()))


@pytest.mark.parametrize("kind", ["distinct", "copies", "zeros", "large"])
def test_screened_search_equals_the_wide_one(kind, monkeypatch):
    rng = np.random.default_rng(4)
    wanted, corpus = rng.normal(size=(90, 12)), rng.normal(size=(1500, 12))
    if kind == "copies":
        corpus = corpus[rng.integers(0, 20, 1500)]
    elif kind == "zeros":
        corpus[:] = 0.0
    elif kind == "large":
        corpus *= 1e6
    products = []
    multiplied = retrieve._products
    monkeypatch.setattr(retrieve, "_products", lambda *x: products.append(len(x[2])) or multiplied(*x))
    for k, block_rows in ((1, 1500), (3, 256), (24, 512), (40, 33), (1500, 64)):
        want, got = (list(f(wanted, corpus, k, block_rows)) for f in (retrieve._search_wide, retrieve._search))
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(np.array_equal(x, y) for w, g in zip(want, got) for x, y in zip(w[1:], g[1:]))
        if (kind, k) == ("distinct", 3):
            assert sum(products) < 0.1 * 90 * 1500


def test_index_searched_in_all_cells_sends_a_query_once(spark, tmp_path, monkeypatch):
    from deskspark.sources.index import SearchIndex

    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 6)))]
    df = spark.createDataFrame(rows, "corpus_id long, embedding array<double>")
    asked = df.where("corpus_id % 4 = 0").withColumnRenamed("corpus_id", "query_id")
    index = SearchIndex.create(df, str(tmp_path / "index"), 5, "corpus_id")
    sent = []
    parts = retrieve._search_parts
    monkeypatch.setattr(retrieve, "_search_parts", lambda queries, *rest: sent.append(queries.count()) or parts(queries, *rest))
    got = [sorted(map(tuple, index.search(asked, probes=n).collect())) for n in (None, 5, 9)]
    assert sent == [30, 30, 30]
    assert got == [sorted(map(tuple, retrieve.knn(asked, df, 3).collect()))] * 3


def test_stored_index_grows_once_per_batch(spark, tmp_path):
    from deskspark.sources.index import SearchIndex

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], f"t{i}") for i, v in enumerate(rng.normal(size=(200, 6)))]
    df = spark.createDataFrame(rows, "corpus_id long, embedding array<double>, note string")
    asked = df.where("corpus_id % 9 = 0").select(F.col("corpus_id").alias("query_id"), "embedding")
    path = str(tmp_path / "index")
    index = SearchIndex.create(df.where("corpus_id < 80"), path, 5, "corpus_id")
    index.append(df.where("corpus_id BETWEEN 80 AND 149"), "b")
    index.append(df.where("corpus_id >= 150"), "c")
    index.append(df.where("corpus_id >= 150"), "c")  # replayed
    want = sorted(map(tuple, retrieve.knn(asked, df, 3).collect()))
    assert sorted(map(tuple, index.search(asked).collect())) == want
    index.compact("d")
    again = SearchIndex.open(spark, path)
    assert again.live() == ["d"] and again.rows().count() == 200
    assert sorted(map(tuple, again.search(asked).collect())) == want
    # A batch that was written but not logged is not read.
    index._write(df.limit(5).withColumn("cell", F.lit(0)), "half")
    assert again.rows().count() == 200
    plan = again.cells([1, 3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    few = again.search(asked, probes=2)
    assert few.count() == 3 * asked.count()


def test_knn_by_part_and_string_ids(spark):
    rows = [("a", 1, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("c", 2, [1.0, 0.0]), ("d", None, [1.0, 0.0]), ("e", 3, None)]
    df = spark.createDataFrame(rows, "id string, part int, embedding array<double>")
    queries, corpus = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "corpus_id")
    got = retrieve.knn(queries, corpus, 1, partition="part", block_rows=2)
    assert {r["query_id"]: r["corpus_id"] for r in got.collect()} == {"a": "a", "b": "b", "c": "c"}
    by_label = retrieve.knn_by_label(queries, corpus.where("part = 2"), "part", 1)
    assert {r["query_id"]: r["corpus_id"] for r in by_label.collect()} == {"a": "c", "b": "c", "c": "c", "d": "c"}


def test_fallback_and_context(spark):
    hits = spark.createDataFrame([(1, 0.9, "m", "r", "t", 1), (1, 0.5, "m2", "r2", "t2", 2)], "query_id long, similarity double, customer_msg string, brand_reply string, thread_id string, rank int")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    filled = retrieve.with_fallback(hits, queries, DEFAULT_EXAMPLES)
    assert {r["query_id"]: r["count"] for r in filled.groupBy("query_id").count().collect()} == {1: 2, 2: 3}
    texts = {r["query_id"]: r["retrieved_context"] for r in retrieve.format_context(hits, "Desk", queries=queries).collect()}
    assert texts[2] == lx.NO_CONTEXT
    assert texts[1].startswith('[Example 1] (Similarity: 0.90)\nCustomer: "m"\nDesk Verified Resolution: "r"\n\n[Example 2]')


# --- Features, models, clusters ---


def test_vectors_agree_with_terms(spark):
    df = spark.createDataFrame([(1, "late parcel late"), (2, "parcel refund"), (3, "")], "id long, text string")
    table = {(r["id"], r["term"]): r["weight"] for r in features.tfidf_terms(df, "id").collect()}
    vectors = {r["id"]: r["features"] for r in features.fit_tfidf(df, stop_words=[])(df).collect()}
    for key in (1, 2):
        mine = sorted(round(w, 9) for (i, _), w in table.items() if i == key)
        assert mine == sorted(round(float(x), 9) for x in vectors[key].values)
    idf = {t: math.log(4 / (1 + n)) + 1 for t, n in {"late": 1, "parcel": 2, "late parcel": 1, "parcel late": 1}.items()}
    raw = {"late": 2 * idf["late"], "parcel": idf["parcel"], "late parcel": idf["late parcel"], "parcel late": idf["parcel late"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert table[1, "late"] == pytest.approx(raw["late"] / norm)


def test_weights_count_copies(spark):
    rows = [("late parcel",)] * 3 + [("refund",)]
    plain = features.fit_tfidf(spark.createDataFrame(rows, "text string"), stop_words=[])
    folded = features.fit_tfidf(spark.createDataFrame([("late parcel", 3), ("refund", 1)], "text string, n int"), stop_words=[], weight="n")
    probe = spark.createDataFrame([("late refund",)], "text string")
    assert plain(probe).first()["features"] == folded(probe).first()["features"]


def test_user_encoder_is_normalised(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    rows = features.embed(df, encoder=lambda texts: np.array([[len(t), 0.0, len(t)] for t in texts])).orderBy("id").collect()
    assert rows[0]["embedding"] == pytest.approx([math.sqrt(0.5), 0, math.sqrt(0.5)]) and rows[1]["embedding"] == [0, 0, 0]


def test_model_learns_its_training_labels(spark):
    rows = [(t, c) for t, c in (("refund please", "a"), ("card charged", "b"), ("where parcel", "c")) for _ in range(20)]
    rows += [("refund please", "a")] * 60
    df = spark.createDataFrame(rows, "text string, true_intent string")
    got = classify.predict_intent(classify.train_intent(df, max_iterations=50), df)
    assert got.where("intent <> true_intent").count() == 0
    assert got.agg(F.min("confidence")).first()[0] > 0.4


def test_clusters_and_silhouettes(spark):
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(c, 0.2, size=(30, 3)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, embedding array<double>")
    for metric in ("euclidean", "squared"):
        sweep = {r["k"]: (r["silhouette"], r["best"]) for r in cluster.sweep_k(df, [2, 3, 4], n_init=2, metric=metric).collect()}
        assert sweep[3][1]
    clustered = cluster.kmeans(df, 3, n_init=2).cache()
    assert sorted(r["size"] for r in cluster.cluster_summary(clustered).collect()) == [30, 30, 30]


def lloyd(points, weights, centres, rounds):
    for _ in range(rounds):
        gaps = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
        own = gaps.argmin(axis=1)
        centres = np.array([
            np.average(points[own == c], axis=0, weights=weights[own == c]) if (own == c).any() else centres[c]
            for c in range(len(centres))
        ])
    gaps = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    return centres, float((weights * gaps.min(axis=1)).sum())


def test_models_advance_together_like_alone(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(300, 3))
    weights = rng.integers(1, 4, 300)
    df = spark.createDataFrame(
        [(i, [float(x) for x in p], int(w)) for i, (p, w) in enumerate(zip(points, weights))],
        "id long, embedding array<double>, w int",
    ).repartition(5)
    starts = {k: points[:k] for k in (2, 3, 5)}
    found = cluster.advance(cluster.points(df, weight="w"), starts, 4, tolerance=0.0)
    for k, start in starts.items():
        centres, cost = lloyd(points, weights, start, 4)
        assert np.allclose(found[k].centres, centres) and found[k].cost == pytest.approx(cost)
        assert found[k].sizes.sum() == weights.sum()
    best = cluster.fit_many(cluster.points(df, weight="w"), [2, 5], 1, 3)
    assert best[5].cost < best[2].cost
    again = cluster.fit_many(cluster.points(df.repartition(2), weight="w"), [2, 5], 1, 3)
    assert all(np.allclose(best[k].centres, again[k].centres) for k in (2, 5))


def test_fewer_points_than_clusters(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(20)], "id long, embedding array<double>")
    assert cluster.kmeans(df, 5, n_init=2).select("cluster").distinct().count() == 2
    empty = df.limit(0)
    assert cluster.kmeans(empty, 5, n_init=2).count() == 0 and cluster.sweep_k(empty, [2], n_init=1).count() == 0


def plain_silhouette(points, labels):
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        means = {c: gaps[i, labels == c].sum() / ((labels == c).sum() - (c == own)) for c in set(labels) if (labels == c).sum() > (c == own)}
        other = min(m for c, m in means.items() if c != own)
        scores.append((other - means[own]) / max(other, means[own]) if own in means and max(other, means[own]) > 0 else 0.0)
    return float(np.mean(scores))


@pytest.mark.parametrize("tile_rows", [1000, 17])
def test_exact_silhouettes_of_several_labellings(spark, tile_rows):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(150, 4))
    points[30:80] = points[30]  # a third are copies
    a, b = rng.integers(0, 3, 150), rng.integers(5, 9, 150)
    b[3] = 11  # a cluster of its own
    rows = [(i, [float(x) for x in p], int(x), int(y), 1) for i, (p, x, y) in enumerate(zip(points, a, b))]
    rows += [(900, None, 1, 5, 1), (901, [0.0] * 4, None, 5, 1)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, a int, b int, one int").repartition(4)
    got = cluster.silhouette_exact(df, ["a", "b", "one"], tile_rows=tile_rows)
    assert got["a"] == pytest.approx(plain_silhouette(points, a), abs=1e-6)
    assert got["b"] == pytest.approx(plain_silhouette(points, b), abs=1e-6)
    assert got["one"] is None
    assert cluster.silhouette_exact(df.limit(0), ["a"]) == {"a": None}


# --- IO ---


def test_csv_with_line_breaks_and_extra_columns(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        'tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n'
        '1,c1,True,t1,"hello, ""you""\nsecond line",2,\n2,brand,False,t2,hi,,1.0\n'
    )
    rows = tables.read_messages(spark, str(path)).orderBy("tweet_id").collect()
    assert rows[0]["text"] == 'hello, "you"\nsecond line' and rows[0]["in_response_to_tweet_id"] is None
    assert (rows[1]["tweet_id"], rows[1]["in_response_to_tweet_id"]) == (2, "1.0")


def test_golden_column_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("tweet_id,text,primary_intent,ideal_action\n1,x,cancellation,escalate\n")
    (tmp_path / "b.csv").write_text("customer_msg,intent,thread_length\ny,refund_return,4\n")
    names = ["text", "true_intent", "true_action", "thread_length"]
    assert tuple(tables.read_golden(spark, str(tmp_path / "a.csv")).select(*names).first()) == ("x", "cancellation", "escalate", 1)
    assert tuple(tables.read_golden(spark, str(tmp_path / "b.csv")).select(*names).first()) == ("y", "refund_return", "auto_handle", 4)


def test_embeddings_are_added_once(spark, tmp_path):
    path = str(tmp_path / "store")
    calls = []

    def encode(frame):
        calls.append(frame.count())
        return frame.withColumn("embedding", F.array(F.lit(1.0)))

    tables.materialize_embeddings(spark.range(3).toDF("id"), path, encode, "id")
    got = tables.materialize_embeddings(spark.range(5).toDF("id"), path, encode, "id")
    assert calls == [3, 2] and got.count() == 5


def test_metrics_json(spark, tmp_path):
    tables.write_metrics(spark.createDataFrame([("full", 0.5)], "model string, f1 double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["f1"] == 0.5


def test_bad_pointers_and_empty_labels(spark, tmp_path):
    log = tmp_path / "log.csv"
    log.write_text(
        "tweet_id,author_id,created_at,text,in_response_to_tweet_id\n"
        "1,c,2020-01-01,where is my parcel,x\n2,b,2020-01-02,please write to us,1\n"
        "3,c,2020-01-01,my refund is late,\n4,b,2020-01-02,we look at it,3.0\n"
    )
    found = threads.build_threads(tables.read_messages(spark, str(log)), "b")
    assert [r["customer_tweet_id"] for r in found.collect()] == ["3"]
    golden = tables.golden_columns(spark.createDataFrame([("a", None)], "text string, primary_intent string")).first()
    assert (golden["true_intent"], golden["true_action"]) == (None, "auto_handle")


def test_silhouette_tiles_do_not_grow_in_number(spark, monkeypatch):
    frozen = []
    keep = cluster.freeze
    monkeypatch.setattr(cluster, "freeze", lambda df, *rest: frozen.append(keep(df, *rest)) or frozen[-1])
    rng = np.random.default_rng(8)
    points, labels = rng.normal(size=(1500, 3)), rng.integers(0, 3, size=1500)
    df = spark.createDataFrame([([float(x) for x in p], int(c)) for p, c in zip(points, labels)], "embedding array<double>, a int")
    got = cluster.silhouette_exact(df, ["a"], tile_rows=40)
    assert frozen[-1].count() <= 16
    assert got["a"] == pytest.approx(plain_silhouette(points, labels), abs=1e-6)


def test_index_search_shuffles_floats_as_they_are(spark, tmp_path):
    from deskspark.sources.index import SearchIndex

    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(60)]
    df = spark.createDataFrame(rows + [(60, None)], "corpus_id int, embedding array<float>")
    index = SearchIndex.create(df, str(tmp_path / "index"), 3, "corpus_id")
    assert dict(index.cells([0, 1, 2]).dtypes)["_vec"] == "array<float>"
    asked = df.select(F.col("corpus_id").alias("query_id"), "embedding")
    found = index.search(asked, k=3)
    assert "array<double>" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = retrieve.knn(asked, df.withColumn("embedding", F.col("embedding").cast("array<double>")), 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_attach_broadcasts_hot_keys_only(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else f"k{i}") for i in range(40)] + [(40, None)], "i int, key string")
    counts = rows.where("key IS NOT NULL").groupBy("key").count().withColumn("context", F.repeat("key", F.lit(500)))
    got = grouped.attach(rows, freeze(counts), "key", "count", F.col("i"))
    joins = re.findall(r"(?:Broadcast\w+|SortMerge)Join .*", got._jdf.queryExecution().sparkPlan().toString())
    assert any(j.startswith("SortMerge") for j in joins)
    assert all("_hot#" in j for j in joins if j.startswith("Broadcast"))
    assert {r.i: r.context for r in got.collect()} == {
        r.i: r.key and r.key * 500 for r in rows.collect()
    }


def test_differing_rows_meet_as_digests(spark):
    from deskspark.workload.queries import _differing

    ddl = "id int, a string, b string"
    rows = spark.createDataFrame([(1, "x", "y"), (2, None, ""), (3, None, None), (4, "x", "y"), (5, "p", "q")], ddl)
    others = spark.createDataFrame([(1, "x", "y"), (2, None, None), (4, "xy", ""), (5, "p", "q"), (5, "p", "r")], ddl)
    found = _differing(rows, others, "id", ("a", "b"))
    assert tuple(found.first()) == (6, 3)
    # Texts themselves are not joined.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("sha2(")
