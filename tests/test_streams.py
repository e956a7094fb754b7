import uuid

import pandas as pd
from pyspark.sql import functions as F

from deskspark.operators import threads
from deskspark.sources.scratch import rocksdb_state
from deskspark.streaming import triage as streams

SCHEMA = "user long, ts timestamp, id long"


def batch(spark, folder, n, rows):
    times = [(u, pd.Timestamp(t).to_pydatetime(), i) for u, t, i in rows]
    spark.createDataFrame(times, SCHEMA).coalesce(1).write.parquet(f"{folder}/batch={n}")


def drain(spark, frame, folder, name, **trigger):
    streams.to_parquet(frame, f"{folder}/{name}", f"{folder}/{name}-state", **trigger).awaitTermination()
    return spark.read.parquet(f"{folder}/{name}")


def source(spark, folder):
    return streams.stream_table(spark, f"{folder}/in/*", SCHEMA, max_files=1)


FIRST = [(1, "2024-01-01 10:00", 2), (1, "2024-01-01 09:00", 1), (2, "2024-01-01 10:30", 3)]
SECOND = [(1, "2024-01-01 11:00", 4), (2, "2024-01-01 11:10", 5), (2, "2024-01-01 11:05", 6)]


def test_thread_length_state_spans_batches(spark, tmp_path):
    folder = str(tmp_path)
    for n, rows in enumerate((FIRST, SECOND)):
        batch(spark, f"{folder}/in", n, rows)
        counted = streams.thread_length_stream(source(spark, folder), ["user"], "ts", "id")
        got = drain(spark, counted, folder, "out")
    both = spark.createDataFrame([(u, pd.Timestamp(t).to_pydatetime(), i) for u, t, i in FIRST + SECOND], SCHEMA)
    want = threads.thread_length(both, ["user"], "ts", ["ts", "id"])
    key = lambda df: sorted((r["id"], r["thread_length"]) for r in df.collect())
    assert key(got) == key(want)


def test_thread_length_state_expires(spark, tmp_path):
    folder = str(tmp_path)
    late = [(9, "2024-01-03 00:00", 7)]
    for n, rows in enumerate((FIRST, late, [(1, "2024-01-03 01:00", 8)])):
        batch(spark, f"{folder}/in", n, rows)
        counted = streams.thread_length_stream(source(spark, folder), ["user"], "ts", "id", expire_ms=3600_000)
        got = drain(spark, counted, folder, "out")
    assert {r["id"]: r["thread_length"] for r in got.collect()}[8] == 1


def test_late_messages_are_counted_and_marked(spark, tmp_path):
    folder = str(tmp_path)
    for n, rows in enumerate((FIRST, SECOND, [(1, "2023-12-31 23:50", 7)])):
        batch(spark, f"{folder}/in", n, rows)
        counted = streams.thread_length_stream(source(spark, folder), ["user"], "ts", "id")
        got = drain(spark, counted, folder, "out")
    found = {r["id"]: (r["thread_length"], r["late"]) for r in got.collect()}
    assert len(found) == 7 and found[7] == (4, True) and not any(late for i, (_, late) in found.items() if i < 7)


EVENTS = [(i % 3, f"2024-01-01 {10 + i // 12:02d}:{5 * (i % 12):02d}", i) for i in range(40)]
LATER = [(0, "2024-01-03 09:00", 90), (1, "2024-01-03 09:00", 91), (2, "2024-01-04 20:00", 92)]


def test_final_lengths_do_not_depend_on_the_batches(spark, tmp_path):
    both = spark.createDataFrame([(u, pd.Timestamp(t).to_pydatetime(), i) for u, t, i in EVENTS], SCHEMA)
    want = {r["id"]: r["thread_length"] for r in threads.thread_length(both, ["user"], "ts", ["ts", "id"]).collect()}
    want |= {90: 1, 91: 1}  # after a day's silence; the last message stays behind the watermark
    swapped = [EVENTS[i ^ 1] for i in range(len(EVENTS))]  # neighbours change places, within the hour allowed
    for name, cuts, events in (("one", [40], EVENTS), ("some", [7, 8, 30, 40], swapped)):
        folder, start = str(tmp_path / name), 0
        for n, cut in enumerate([*cuts, None]):
            batch(spark, f"{folder}/in", n, events[start:cut] if cut else LATER)
            start = cut
            with rocksdb_state(spark):
                final = streams.final_thread_length_stream(source(spark, folder), ["user"], "ts", "id")
                got = drain(spark, final, folder, "out")
        assert {r["id"]: r["thread_length"] for r in got.collect()} == want


def test_late_rows_are_dropped_from_closed_windows(spark, tmp_path):
    folder = str(tmp_path)
    batches = [FIRST, [(3, "2024-01-01 14:00", 7)], [(1, "2024-01-01 09:30", 8)], [(3, "2024-01-01 20:00", 9)]]
    for n, rows in enumerate(batches):
        batch(spark, f"{folder}/in", n, rows)
        decided = source(spark, folder).withColumn("decision", F.lit("escalate"))
        got = drain(spark, streams.escalation_rates(decided, late="1 hour"), folder, "out")
    counts = {r["window_start"].hour: r["messages"] for r in got.collect()}
    assert counts == {9: 1, 10: 2, 14: 1}


def test_sessions_close_after_the_gap(spark, tmp_path):
    folder = str(tmp_path)
    for n, rows in enumerate((FIRST, SECOND, [(3, "2024-01-02 14:00", 7)])):
        batch(spark, f"{folder}/in", n, rows)
        found = streams.session_length_stream(source(spark, folder), "user", "ts", "2 hours", "1 hour")
        got = drain(spark, found, folder, "out")
    assert sorted((r["user"], r["thread_length"]) for r in got.collect()) == [(1, 3), (2, 3)]


def test_replayed_batch_leaves_one_copy(spark, tmp_path):
    folder = str(tmp_path)
    batch(spark, f"{folder}/in", 0, FIRST)
    for state in ("s1", "s2"):
        streams.each_batch(source(spark, folder), lambda df: df, f"{folder}/out", f"{folder}/{state}").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == len(FIRST)


def test_threads_share_state_entries(spark, tmp_path):
    folder, big = str(tmp_path), 2**60
    rows = [(i % 700, f"2024-01-01 {10 + i // 700}:00", big + i) for i in range(1400)] + [(None, "2024-01-01 12:00", None)]
    batch(spark, f"{folder}/in", 0, rows)
    batch(spark, f"{folder}/in", 1, [(1, "2024-01-03 09:00", 1)])
    lengths = lambda found: {(r["user"], r["id"]): r["thread_length"] for r in found.collect()}
    want = {(u, i): 1 + (i is not None and i - big >= 700) for u, _, i in rows}
    counted = streams.to_parquet(
        streams.thread_length_stream(source(spark, folder), ["user"], "ts", "id", groups=8), f"{folder}/out", f"{folder}/state"
    )
    counted.awaitTermination()
    assert lengths(spark.read.parquet(f"{folder}/out")) == want | {(1, 1): 1}
    with rocksdb_state(spark):
        final = streams.to_parquet(
            streams.final_thread_length_stream(source(spark, folder), ["user"], "ts", "id", groups=8), f"{folder}/out2", f"{folder}/state2"
        )
        final.awaitTermination()
    assert lengths(spark.read.parquet(f"{folder}/out2")) == want
    for query in (counted, final):
        # An entry per group, and a few for lists and timers.
        assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 8 * 6


def test_a_batch_job_that_reads_twice_runs_the_stream_once(spark, tmp_path):
    folder = str(tmp_path)
    batch(spark, f"{folder}/in", 0, FIRST)
    drawn = F.udf(lambda _: uuid.uuid4().hex, "string").asNondeterministic()

    def job(frame):
        frame.select("id", F.col("draw").alias("first")).write.parquet(f"{folder}/first")
        return frame.select("id", "draw")

    stream = source(spark, folder).withColumn("draw", drawn("id"))
    streams.each_batch(stream, job, f"{folder}/out", f"{folder}/state").awaitTermination()
    both = spark.read.parquet(f"{folder}/out").join(spark.read.parquet(f"{folder}/first"), "id").collect()
    assert len(both) == len(FIRST) and all(r["draw"] == r["first"] for r in both)
