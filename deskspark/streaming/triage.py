"""Triage on arriving messages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from deskspark import lexicon as lx
from deskspark.functions.text import clean_or_raw
from deskspark.operators import rules
from deskspark.operators.guard import guard_reply
from deskspark.sources.scratch import stored

# Groups that threads are dealt over: a call, and an entry of the state store, serves all threads of a group.
GROUPS = 256
# Rows of a packed piece of waiting messages.
PIECE_ROWS = 10_000
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def triage_stream(
    stream: DataFrame,
    policy: lx.EscalationPolicy = lx.EscalationPolicy(),
    classify: Callable[[DataFrame], DataFrame] = rules.rules_substring,
    text: str = "raw_text",
) -> DataFrame:
    """Intent, canned reply, guard and decision as stateless columns on a stream."""
    kept = [c for c in stream.columns if c not in ("intent", "confidence", "text")]
    labelled = classify(stream.select(*kept, clean_or_raw(F.col(text)).alias("text")))
    drafted = rules.canned_reply(labelled).withColumn("_context", F.lit(""))
    guarded = guard_reply(drafted, context="_context").withColumn("reply", F.col("sanitized_reply"))
    return rules.escalate(guarded, policy).drop("_context", "sanitized_reply")


def each_batch(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Run a batch job (such as triage with retrieval) on every micro-batch.

    Each batch overwrites its own ``batch=<id>`` folder, so a replayed batch
    leaves one copy. The micro-batch is stored before the job sees it: a job reads its input several times, and each
    reading would run the stream's state anew, on whatever executor, and store it again under the same version.
    """

    def write(frame: DataFrame, batch: int) -> None:
        with stored(frame) as held:
            transform(held).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def to_parquet(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to a parquet folder; the file sink's log keeps it exactly-once."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def session_length_stream(stream: DataFrame, customer: str, ts: str, gap: str, late: str) -> DataFrame:
    """Messages per customer session; a session closes after ``gap`` without messages.

    Sessions of one micro-batch are merged map-side when
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is on.
    """
    session = F.session_window(F.col(ts), gap)
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.col(customer), session.alias("session"))
        .agg(F.count(F.lit(1)).alias("thread_length"))
        .select(
            customer,
            F.col("session.start").alias("session_start"),
            F.col("session.end").alias("session_end"),
            "thread_length",
        )
    )


def thread_length_stream(
    stream: DataFrame, thread: list[str], ts: str, message_id: str, keep: Sequence[str] = (),
    expire_ms: int = 24 * 3600 * 1000, groups: int = GROUPS,
) -> DataFrame:
    """Running thread length per message, and whether it came ``late``; ``keep`` names columns to hand on.

    Every message is counted as it arrives; one older than the newest of its
    thread is marked late, none is dropped. A thread that is silent for longer
    than ``expire_ms`` starts anew, and its state goes that long after its last
    arrival. The watermark is on the time of arrival, which no message misses.
    A group's messages of one micro-batch are ordered by (ts, id) per thread in one task;
    the source's rate limit (maxFilesPerTrigger, maxOffsetsPerTrigger) bounds
    how many that can be. The state is three numbers and the key per live thread; threads share their
    group's entry, which is written anew when one of them gets a message. The number of ``groups`` is fixed in a checkpoint.
    """
    names = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    columns = [*thread, ts, message_id, *keep]
    filled, flags = _filled(columns, names)
    keys = [*thread, *[flags[c] for c in thread if c in flags]]
    order = [ts, *[flags[c] for c in [message_id] if c in flags], message_id]
    handed = [*columns, *flags.values()]
    ddl = ", ".join(f"{c} {names.get(c, 'boolean')}" for c in handed) + ", thread_length bigint, late boolean"

    def count(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        live = _unpacked(state.get[0]) if state.exists else None
        now = state.getCurrentWatermarkMs()
        out = None
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True)[handed]
            rows, own = _by_thread(rows, live, keys, order)
            known = 0 if live is None else len(live)
            threads = max(known, own.max() + 1)
            seen, newest = np.zeros(threads, dtype=np.int64), np.full(threads, -np.inf)
            if known:
                seen[:known], newest[:known] = live["seen"], live["newest"]
            at = (rows[ts] - pd.Timestamp(0)).dt.total_seconds().to_numpy()
            place = np.arange(len(rows))
            begin = np.searchsorted(own, own)
            # Times ascend in a thread, missing ones come last.
            timed = np.maximum.accumulate(np.where(np.isnan(at), -1, place))
            last = np.concatenate([[-1], timed[:-1]])
            before = np.fmax(newest[own], np.where(last >= begin, at[last], -np.inf))
            silent = np.isfinite(before) & (at - before > expire_ms / 1000)
            length = _lengths(silent, begin, seen[own])
            out = rows.assign(thread_length=length, late=at < newest[own])
            ends = np.flatnonzero(np.append(own[1:] != own[:-1], True))
            arrived = rows.iloc[ends][keys].assign(
                seen=length[ends],
                newest=np.fmax(before[ends], at[ends]),
                until=max(int(time.time() * 1000), now) + expire_ms,
            )
            live = _replaced(live, arrived, own[ends])
            quiet = np.arange(len(live)) < len(live) - len(arrived)
        else:
            quiet = np.ones(len(live), dtype=bool)
        live = live[~(quiet & (live["until"] <= now).to_numpy())]
        if len(live):
            state.update((_packed(live),))
            state.setTimeoutTimestamp(int(live["until"].min()))
        else:
            state.remove()
        if out is not None:
            yield out

    counted = (
        stream.select(*columns, F.current_timestamp().alias("_arrived"))
        .withWatermark("_arrived", "1 hour")
        .withColumns(filled)
        .withColumn("_group", _group(thread, flags, groups))
        .groupBy("_group")
        .applyInPandasWithState(count, ddl, "threads binary", "append", GroupStateTimeout.EventTimeTimeout)
    )
    return _emptied(counted, flags)


def _filled(columns: Sequence[str], names: dict[str, str]):
    """Columns to add, and the name of the flag of each: missing integers become 0 with a flag, since pandas
    would make the whole column floats. Names with a leading underscore do not survive on the way to a stateful processor."""
    flags = {c: f"no_{c}" for c in columns if names[c] in _INTEGERS}
    filled = {flag: F.col(c).isNull() for c, flag in flags.items()}
    return filled | {c: F.coalesce(c, F.lit(0).cast(names[c])) for c in flags}, flags


def _emptied(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(flag), F.col(c)) for c, flag in flags.items()}).drop(*flags.values())


def _group(thread: Sequence[str], flags: dict[str, str], groups: int):
    keys = [*thread, *[flags[c] for c in thread if c in flags]]
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")


def _packed(frame: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


def _by_thread(
    rows: pd.DataFrame, live: pd.DataFrame | None, keys: list[str], order: list[str]
) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows in order within each thread, and the thread's number: its place in ``live``, or one after."""
    both = rows[keys] if live is None else pd.concat([live[keys], rows[keys]], ignore_index=True)
    own = both.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()[len(both) - len(rows) :]
    rows = rows.assign(_own=own).sort_values(["_own", *order], ignore_index=True)
    return rows.drop(columns="_own"), rows["_own"].to_numpy()


def _lengths(silent: np.ndarray, begin: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Running length of sorted rows: on from ``seen``, anew from each silent row; ``begin`` is where a row's thread starts."""
    place = np.arange(len(silent))
    anew = np.maximum.accumulate(np.where(silent, place, -1))
    return np.where(anew >= begin, place - anew + 1, place - begin + seen + 1)


def _replaced(live: pd.DataFrame | None, arrived: pd.DataFrame, own: np.ndarray) -> pd.DataFrame:
    """The untouched threads of ``live``, then those that arrived, whose numbers are ``own``."""
    if live is None:
        return arrived
    left = live.drop(index=own[own < len(live)])
    return pd.concat([left, arrived], ignore_index=True) if len(left) else arrived


class _FinalLengths(StatefulProcessor):
    """Holds a group's messages until the watermark has passed them, then numbers them in their threads for good."""

    def __init__(self, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], expire_ms: int):
        self.columns, self.keys, self.order, self.ts = list(columns), list(keys), list(order), order[0]
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.counted = handle.getValueState("counted", "threads binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            micros = frame[self.ts].astype("datetime64[us]").astype("int64")
            self.waiting.appendValue((_packed(frame[self.columns].assign(**{self.ts: micros})),))
            self.handle.registerTimer(int(micros.min()) // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, expire = timerValues.getCurrentWatermarkInMs() * 1000, self.expire_ms * 1000
        pieces = [_unpacked(row[0]) for row in self.waiting.get()]
        held = pd.concat(pieces, ignore_index=True) if pieces else None
        passed = np.zeros(0, dtype=bool) if held is None else (held[self.ts] < due).to_numpy()
        live = _unpacked(self.counted.get()[0]) if self.counted.exists() else None
        out = pd.DataFrame()
        later = held
        if passed.any():
            rows, own = _by_thread(held[passed], live, self.keys, self.order)
            later = held[~passed]
            known = 0 if live is None else len(live)
            threads = max(known, own.max() + 1)
            seen, newest = np.zeros(threads, dtype=np.int64), np.zeros(threads, dtype=np.int64)
            at = rows[self.ts].to_numpy()
            if known:
                seen[:known], newest[:known] = live["seen"], live["newest"]
            begin = np.searchsorted(own, own)
            first = begin == np.arange(len(rows))
            before = np.where(first, newest[own], np.concatenate([[0], at[:-1]]))
            silent = ~(first & (own >= known)) & (at - before > expire)
            length = _lengths(silent, begin, seen[own])
            ends = np.flatnonzero(np.append(own[1:] != own[:-1], True))
            arrived = rows.iloc[ends][self.keys].assign(seen=length[ends], newest=at[ends])
            live = _replaced(live, arrived, own[ends])
            if len(later):
                starts = range(0, len(later), PIECE_ROWS)
                self.waiting.put([(_packed(later.iloc[i : i + PIECE_ROWS]),) for i in starts])
                self.handle.registerTimer(int(later[self.ts].min()) // 1000 + 1)
            else:
                self.waiting.clear()
            out = rows.assign(thread_length=length, **{self.ts: pd.to_datetime(rows[self.ts], unit="us")})
        if live is not None:
            old = (live["newest"] + expire < due).to_numpy()
            if old.any() and later is not None and len(later):
                # A thread with waiting messages is not over.
                both = pd.concat([live[self.keys], later[self.keys]], ignore_index=True)
                own = both.groupby(self.keys, dropna=False, sort=False).ngroup().to_numpy()[len(live) :]
                old[own[own < len(live)]] = False
            live = live[~old]
            if len(live):
                self.counted.update((_packed(live),))
                self.handle.registerTimer(max(int(live["newest"].min()) // 1000 + self.expire_ms + 2, due // 1000 + 1))
            else:
                self.counted.clear()
        yield out

    def close(self) -> None:
        pass


def final_thread_length_stream(
    stream: DataFrame, thread: list[str], ts: str, message_id: str, keep: Sequence[str] = (), late: str = "1 hour",
    expire_ms: int = 24 * 3600 * 1000, groups: int = GROUPS,
) -> DataFrame:
    """Thread length per message once the watermark on ``ts``, ``late`` behind the newest message, has passed it.

    Only event time counts: the same messages give the same lengths however they are split into
    micro-batches and whenever they are replayed, as long as none comes later than ``late``; such messages are
    dropped, as by every watermark. Messages wait in the list state of their thread's group; a timer at the oldest one's
    time numbers all that the watermark has passed, per thread in the order of (ts, id). A thread that is silent for longer
    than ``expire_ms`` starts anew, and a timer then clears its state. The number of ``groups`` is fixed in a
    checkpoint. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    names = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    columns = [*thread, ts, message_id, *[c for c in keep if c not in (*thread, ts, message_id)]]
    filled, flags = _filled(columns, names)
    handed = [*columns, *flags.values()]
    ddl = ", ".join(f"{c} {names.get(c, 'boolean')}" for c in handed) + ", thread_length bigint"
    keys = [*thread, *[flags[c] for c in thread if c in flags]]
    order = [ts, *[flags[c] for c in [message_id] if c in flags], message_id]
    found = (
        stream.select(*columns)
        .withWatermark(ts, late)
        .withColumns(filled)
        .withColumn("_group", _group(thread, flags, groups))
        .groupBy("_group")
        .transformWithStateInPandas(_FinalLengths(handed, keys, order, expire_ms), ddl, "Append", "EventTime")
    )
    return _emptied(found, flags)


def escalation_rates(
    decisions: DataFrame, ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "1 hour"
) -> DataFrame:
    """Messages and escalations per tumbling or sliding window; rows later than ``late`` are dropped."""
    return (
        decisions.withWatermark(ts, late)
        .groupBy(F.window(ts, width, slide or width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.count_if(F.col("decision") == lx.ESCALATE).alias("escalations"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "messages",
            "escalations",
            (F.col("escalations") / F.col("messages")).alias("rate"),
        )
    )


def stream_table(spark: SparkSession, path: str, schema, max_files: int | None = None, pattern: str | None = None) -> DataFrame:
    """Parquet folder as a stream of its files."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)
