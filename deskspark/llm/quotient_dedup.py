"""Exact dedup by counting quotient filters.

Each task builds a counting quotient filter of its fingerprints, one piece per
block of quotients; the pieces of a block merge by their sorted remainders
without loss. Only documents whose fingerprint counts more than one go on to the
comparison of their bytes, which alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm.spread import attach, maybe_among
from deskspark.sources.scratch import freeze

FINGERPRINT_BITS = 64
# Fingerprints that a task holds before it hands on its filter.
FLUSH = 1 << 20
MAX_LOAD = 0.75


class CountingQuotientFilter:
    """Sorted (quotient, remainder, count) in quotient-filter form.

    A fingerprint is split into ``q`` high bits, kept by position, and the
    remainder, kept in its slot. ``occupied`` marks quotients that have a run,
    ``run_end`` the last slot of each run; a count above 254 moves to a list.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray):
        """fingerprints: ascending and distinct unsigned 64-bit numbers."""
        self.n = len(fingerprints)
        self.q = max(1, int(np.ceil(np.log2(max(self.n, 1) / MAX_LOAD))))
        r = FINGERPRINT_BITS - self.q
        quotients = fingerprints >> np.uint64(r)
        self.width = -(-r // 8)
        self.occupied = np.zeros(1 << self.q, bool)
        self.occupied[quotients.astype(np.int64)] = True
        self.run_end = np.ones(self.n, bool)
        self.run_end[:-1] = quotients[1:] != quotients[:-1]
        low = fingerprints & np.uint64((1 << r) - 1)
        self.remainders = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]
        self.small = np.minimum(counts, 255).astype(np.uint8)
        self.large = counts[self.small == 255].astype("<i8")

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, ascending, and their counts."""
        r = FINGERPRINT_BITS - self.q
        full = np.zeros((self.n, 8), np.uint8)
        full[:, : self.width] = self.remainders
        low = full.reshape(-1).view("<u8")
        run = np.cumsum(self.run_end) - self.run_end
        high = np.flatnonzero(self.occupied).astype(np.uint64)[run]
        counts = self.small.astype(np.int64)
        counts[self.small == 255] = self.large
        return (high << np.uint64(r)) | low, counts

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.q, len(self.large)], "<i8").tobytes()
        bits = np.packbits(self.occupied).tobytes() + np.packbits(self.run_end).tobytes()
        return head + bits + self.remainders.tobytes() + self.small.tobytes() + self.large.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        self = cls.__new__(cls)
        self.n, self.q, large = (int(x) for x in np.frombuffer(data, "<i8", 3))
        self.width = -(-(FINGERPRINT_BITS - self.q) // 8)
        at = 24

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        self.occupied = np.unpackbits(take(-(-(1 << self.q) // 8)), count=1 << self.q).astype(bool)
        self.run_end = np.unpackbits(take(-(-self.n // 8)), count=self.n).astype(bool)
        self.remainders = take(self.n * self.width).reshape(self.n, self.width)
        self.small = take(self.n)
        self.large = take(8 * large).view("<i8")
        return self

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter with the summed counts; quotient widths may differ."""
        parts = [f.items() for f in filters]
        return cls(*_summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # A stable sort merges runs that are sorted already.
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.add.reduceat(counts, first)


def _filters(block_bits: int):
    """Task code: fingerprints in, (block, filter) out."""

    def pieces(held: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(held)
        values, counts = _summed(values, np.ones(len(values), np.int64))
        blocks = (values >> np.uint64(FINGERPRINT_BITS - block_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1], [True])))
        rows = [
            CountingQuotientFilter(values[a:b] << np.uint64(block_bits), counts[a:b]).to_bytes()
            for a, b in zip(cuts[:-1], cuts[1:])
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks[cuts[:-1]], pa.int64()), pa.array(rows, pa.binary())], ["block", "filter"]
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= FLUSH:
                yield pieces(held)
                held, n = [], 0
        if n:
            yield pieces(held)

    return build


def _repeated(block_bits: int):
    """Task code: the filters of one block in, its fingerprints counted more than once out."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        filters = [CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")]
        values, counts = CountingQuotientFilter.merged(filters).items()
        block = np.uint64(key[0].as_py())
        values = (values >> np.uint64(block_bits)) | (block << np.uint64(FINGERPRINT_BITS - block_bits))
        more = counts > 1
        return pa.table({"fingerprint": values[more].view(np.int64), "n": counts[more]})

    return merge


def repeated_fingerprints(docs: DataFrame, column: str, block_bits: int | None = None) -> DataFrame:
    """(fingerprint, n) of the values that a merged filter counts more than once.

    ``block_bits`` sets how many blocks the fingerprint space has; by default
    twice as many as there are shuffle partitions.
    """
    if block_bits is None:
        block_bits = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length() + 1
    pieces = docs.select(column).mapInArrow(_filters(block_bits), "block bigint, filter binary")
    return pieces.groupBy("block").applyInArrow(_repeated(block_bits), "fingerprint bigint, n bigint")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; null counts as empty. The largest
    doc_id of equal texts stays. Repeated rows count in ``group_size`` and are
    all marked kept when their doc_id is; :func:`exact_dedup` leaves one of them.
    An empty table gives an empty result; other columns are not looked at.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("fingerprint", F.xxhash64("text"))
    repeated = freeze(repeated_fingerprints(base, "fingerprint").select("fingerprint"))
    # Equal bytes: the text itself is the grouping key, combined before the shuffle.
    groups = freeze(
        maybe_among(base, "fingerprint", repeated)
        .groupBy("text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > 1)
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows = base.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    keep = F.coalesce(F.col("keep_id"), F.col("doc_id"))
    return attach(rows, groups, "text_sha256", "group_size", "doc_id").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn(
        "fingerprint", F.xxhash64("text")
    )
    repeated = freeze(repeated_fingerprints(base, "fingerprint").select("fingerprint"))
    groups = freeze(
        maybe_among(base, "fingerprint", repeated)
        .groupBy("text", "id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("text")
        .agg(F.max(F.struct("id", "n")).alias("last"), F.sum("n").alias("size"))
        .where(F.col("size") > 1)
        .select(F.sha2("text", 256).alias("sha"), "last", "size")
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"))
    joined = attach(rows, groups, "sha", "size", "id").where(
        F.col("size").isNull() | F.col("last.id").eqNullSafe(F.col("id"))
    )
    twice = F.coalesce(F.col("last.n"), F.lit(1)) > 1
    if not groups.where(F.col("last.n") > 1).isEmpty():  # rows that repeat with their doc_id
        joined = joined.where(~twice).unionByName(joined.where(twice).dropDuplicates(["sha"]))
    return joined.select("row.*")
