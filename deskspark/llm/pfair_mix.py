"""Mixing sources to target weights by Pfair scheduling.

Weights are exact fractions w of their sum. Block i of a source is released at
floor(i / w) and due at ceil((i + 1) / w); earliest deadline first over the
released blocks meets every deadline, so that at any time a source is less than
one block off its target, however long the table. One task walks the blocks,
holding one per source.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm.spread import before_each, shuffled, slice_of
from deskspark.sources.scratch import freeze

# Slots that the scheduling task sends at a time.
PERIOD = 4096
BLOCK_ROWS = 16


def earliest_deadlines(
    blocks: Sequence[int], weights: Sequence[int]
) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, release, deadline, slot) of every block, by slot. A source that has run out of
    blocks leaves its slots to the others; a slot in which no block is released stays empty."""
    total = sum(weights)
    # The next block of a source has a later deadline, so one of each is enough.
    waiting, ready, slot = [(0, k, 0) for k, n in enumerate(blocks) if n], [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[k]), k, i, release))
        deadline, k, i, release = heapq.heappop(ready)
        yield k, i, release, deadline, slot
        slot += 1
        if i + 1 < blocks[k]:
            heapq.heappush(waiting, ((i + 1) * total // weights[k], k, i + 1))


PLAN = "_s string, _i bigint, _release bigint, _deadline bigint, _slot bigint, _start bigint"


def _planned(block_rows: int, period: int):
    """Task code: (source, weight, rows) of all sources in, PLAN rows out: ``_start`` is the position of
    the first row of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = [r for batch in batches for r in batch.to_pylist()]
        sources.sort(key=lambda r: (r["source"] is not None, r["source"] or ""))
        if any(r["weight"] is None for r in sources):
            raise ValueError("a source has no target weight")
        # Floats are whole multiples of a power of two, hence no weight is rounded.
        exact = [Fraction(r["weight"]) for r in sources]
        if any(w <= 0 for w in exact):
            raise ValueError("target weights must be positive")
        unit = max((w.denominator for w in exact), default=1)
        weights, rows = [int(w * unit) for w in exact], [r["rows"] for r in sources]
        names = PLAN.replace(" string", "").replace(" bigint", "").split(", ")
        schema = pa.schema([(n, pa.int64() if n != "_s" else pa.string()) for n in names])
        held, start = [], 0
        for k, i, *times in earliest_deadlines([-(-n // block_rows) for n in rows], weights):
            held.append(dict(zip(names, (sources[k]["source"], i, *times, start))))
            start += min(block_rows, rows[k] - i * block_rows)
            if len(held) == period:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def tempered_weights(docs: DataFrame, power: float, source_col: str = "source") -> DataFrame:
    """Target weights, ``source, weight``, as row counts to a power below 1, for any number of sources."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", F.pow("n", F.lit(power)).alias("weight"))


def schedule(
    docs: DataFrame,
    weights: Mapping[str | None, float] | DataFrame,
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    mix_col: str = "_mix",
) -> DataFrame:
    """``docs`` with the struct ``mix_col``: source_rank, block, release, deadline, slot, position. A column
    of that name gives way to it.

    Every row is placed once. ``slot`` counts blocks; ``position`` is the
    resulting 0-based place of the row. Targets hold for as long as every source
    has blocks left; after that the others go on in proportion, idle slots
    closing up. ``period`` is how many slots are sent at a time and changes no row.
    Rows of a source are shuffled by seed; a null source is a source of its own;
    a source without a weight raises an error. Weights may be a table of
    ``source, weight``, for any number of sources.
    """
    targets = weights
    if isinstance(weights, Mapping):
        if any(w <= 0 for w in weights.values()):
            raise ValueError("target weights must be positive")
        targets = docs.sparkSession.createDataFrame(
            [(s, float(w)) for s, w in weights.items()], "source string, weight double"
        )
    counts = docs.groupBy(F.col(source_col).cast("string").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    sources = counts.join(targets, F.col("_s").eqNullSafe(targets["source"]), "full").select(
        F.coalesce("_s", "source").alias("source"), "weight", F.coalesce("_n", F.lit(0)).alias("rows")
    )
    plan = freeze(sources.repartition(1).mapInArrow(_planned(block_rows, period), PLAN))
    own = [c for c in docs.columns if c.lower() != mix_col.lower()]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),
        F.col(source_col).cast("string").alias("_source"),
        shuffled(F.col(id_col), seed).alias("_order"),
    )
    ranked = before_each(
        rows,
        ["_source"],
        slice_of(F.col("_order")),
        [F.col("_order"), F.xxhash64("_row")],
        {"_rank": F.lit(1)},
    )
    # A block is at most block_rows rows, whatever the share of its source.
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_i"))
    done = (
        ranked.withColumn("_block", F.expr(f"_rank div {block_rows}"))
        .join(plan, same)
        .withColumn("_position", F.expr(f"_start + _rank % {block_rows}"))
    )
    mix = F.struct(
        F.col("_source").alias("source"),
        F.col("_rank").alias("source_rank"),
        F.col("_block").alias("block"),
        F.col("_release").alias("release"),
        F.col("_deadline").alias("deadline"),
        F.col("_slot").alias("slot"),
        F.col("_position").alias("position"),
    )
    return done.select("_row.*", mix.alias(mix_col))


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | DataFrame, position_col: str | None = None, **options
) -> DataFrame:
    """The documents in mixed order, range-partitioned and sorted by position, which ``position_col`` names
    a column for: files are not always read in their order. A column of that name gives way to it."""
    taken, made = {c.lower() for c in docs.columns}, "_mix"
    while made in taken:
        made += "_"
    placed = schedule(docs, weights, mix_col=made, **options)
    at = F.col(f"{made}.position")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(n, at).sortWithinPartitions(at)
    return (ordered.withColumn(position_col, at) if position_col else ordered).drop(made)
