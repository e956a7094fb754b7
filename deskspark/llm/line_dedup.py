"""Dedup of lines that many documents share, behind two Bloom filters.

Each task keeps one filter of line hashes it has seen once and one of those it has
seen twice. Merging over tasks is exact on bits: twice is what either side saw twice
or both saw once. Lines whose bits are not all in the merged second filter occur in
one document only and never leave their task; the others are suspects, and only
those are shuffled, counted exactly and settled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm.spread import attach
from deskspark.sources.scratch import freeze

# The blanks stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
# A filter is cut into blocks of 2**16 bits; a hash names its block and PROBES bits in it.
BLOCK_BITS = 16
BLOCK_BYTES = (1 << BLOCK_BITS) // 8
PROBES = 3
# Bits of a filter: BITS_PER_LINE for each line there can be, between 2**20 and 2**28 (32 MB).
BITS_PER_LINE = 8
LEAST_BITS, MOST_BITS = 20, 28
# Rows handed on at a time.
ROWS = 256
# The id that stands for a null one.
NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class LineRule:
    """Lines of at least ``min_chars`` code points in at least ``min_docs`` documents go."""

    min_chars: int = 40
    min_docs: int = 5


def _lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of all texts: where each one's lines start, the lines and their keys."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=BLANKS))
    return np.concatenate(([0], np.cumsum(sizes))), lines, keys


def _long_enough(keys: pa.Array, rule: LineRule) -> np.ndarray:
    return np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), rule.min_chars).to_numpy(zero_copy_only=False))


def _hashes(keys: pa.Array, at: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(k) for k in keys.take(pa.array(at)).to_pylist()), np.uint64, len(at))


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions per hash, all in the block that its leading digits name."""
    block = (hashes >> np.uint64(64 - (bits - BLOCK_BITS))) << np.uint64(BLOCK_BITS) if bits > BLOCK_BITS else 0
    mask = np.uint64((1 << BLOCK_BITS) - 1)
    return np.stack([block | ((hashes >> np.uint64(BLOCK_BITS * i)) & mask) for i in range(PROBES)]).astype(np.int64)


class Bloom:
    """Bits set by hashes."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros((1 << bits) // 8, np.uint8) if data is None else data

    def add(self, hashes: np.ndarray) -> None:
        spots = _positions(hashes, self.bits).reshape(-1)
        np.bitwise_or.at(self.data, spots >> 3, (1 << (spots & 7)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        spots = _positions(hashes, self.bits)
        return ((self.data[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1).all(axis=0)


def _packed(block: np.ndarray) -> bytes:
    """A block's set bits as 16-bit offsets, or all its bytes where that is shorter."""
    offsets = np.flatnonzero(np.unpackbits(block, bitorder="little"))
    return offsets.astype("<u2").tobytes() if 2 * len(offsets) < BLOCK_BYTES else block.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == BLOCK_BYTES:
        return np.frombuffer(data, np.uint8)
    full = np.zeros(1 << BLOCK_BITS, np.uint8)
    full[np.frombuffer(data, "<u2")] = 1
    return np.packbits(full, bitorder="little")


def _seen(rule: LineRule, bits: int):
    """Task code: texts in, the non-empty blocks of the task's two filters out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(bits), Bloom(bits)
        for batch in batches:
            starts, _, keys = _lines(batch.column(0))
            at = _long_enough(keys, rule)
            if not len(at):
                continue
            hashes, docs = _hashes(keys, at), np.searchsorted(starts, at, side="right")
            order = np.argsort(hashes, kind="stable")
            hashes, docs = hashes[order], docs[order]
            new_hash = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            new_doc = new_hash | np.concatenate(([True], docs[1:] != docs[:-1]))
            hashes, new_hash = hashes[new_doc], new_hash[new_doc]
            again = np.concatenate((~new_hash[1:], [False]))[new_hash]
            hashes = hashes[new_hash]
            twice.add(hashes[again | once.holds(hashes)])
            once.add(hashes)
        blocks = once.data.reshape(-1, min(BLOCK_BYTES, len(once.data)))
        for i in np.flatnonzero(blocks.any(axis=1)):
            other = twice.data.reshape(blocks.shape)[i]
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([i], pa.int64()), "once": [_packed(blocks[i])], "twice": [_packed(other)]}
            )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: pieces sorted by block in, the second filter of each block out."""
    at, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int64()), "twice": [twice.tobytes()]})

    for batch in batches:
        for row in batch.to_pylist():
            first, second = _unpacked(row["once"]), _unpacked(row["twice"])
            if row["block"] != at:
                if at is not None and twice.any():
                    yield done()
                at, once, twice = row["block"], first, second
            else:
                once, twice = once | first, twice | second | (once & first)
    if at is not None and twice.any():
        yield done()


def twice_seen(texts: DataFrame, rule: LineRule, bits: int) -> DataFrame:
    """(block, twice): the blocks of the merged filter that hold a bit, 8 KB each, 2**bits bits at most."""
    pieces = texts.mapInArrow(_seen(rule, bits), "block bigint, once binary, twice binary")
    spread = pieces.repartition("block").sortWithinPartitions("block")
    return spread.mapInArrow(_merged, "block bigint, twice binary")


def _joined(lines: pa.Array, start: int, end: int, gone: set[int]) -> str:
    kept = lines.slice(start, end - start).to_pylist()
    return "\n".join(x for i, x in enumerate(kept, start) if i not in gone) if gone else "\n".join(kept)


def _suspects(rule: LineRule, bits: int, twice, with_text: bool):
    """Task code: each document with the digests of its suspected lines, settled if it has none.

    The text of a settled document goes on only ``with_text``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flt = Bloom(bits, np.frombuffer(twice.value, np.uint8))
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                texts = batch.column(1)
                starts, _, keys = _lines(texts)
                at = _long_enough(keys, rule)
                hit = at[flt.holds(_hashes(keys, at))] if len(at) else at
                docs = np.searchsorted(starts, hit, side="right") - 1
                found = [[] for _ in range(batch.num_rows)]
                for d, key in zip(docs.tolist(), keys.take(pa.array(hit)).to_pylist()):
                    found[d].append(hashlib.sha256(key.encode()).digest())
                plain = texts.to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array([t if f or with_text else None for t, f in zip(plain, found)], pa.string()),
                        pa.array([None if f else _sha(t) for t, f in zip(plain, found)], pa.string()),
                        pa.array([list(set(f)) for f in found], pa.list_(pa.binary())),
                    ],
                    ["doc_id", "n_lines", "text", "kept_sha256", "suspects"],
                )

    return run


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _settled(rule: LineRule, with_text: bool):
    """Task code: suspected documents with the keys they lose in, the remaining text or its digest out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                starts, lines, keys = _lines(batch.column(1))
                at = _long_enough(keys, rule)
                docs = (np.searchsorted(starts, at, side="right") - 1).tolist()
                lost = [set(x or ()) for x in batch.column(2).to_pylist()]
                gone = [set() for _ in lost]
                for i, d, key in zip(at.tolist(), docs, keys.take(pa.array(at)).to_pylist()):
                    if lost[d] and hashlib.sha256(key.encode()).digest() in lost[d]:
                        gone[d].add(i)
                texts = [_joined(lines, starts[d], starts[d + 1], g) for d, g in enumerate(gone)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array([len(g) for g in gone], pa.int64()),
                        pa.array(texts if with_text else [_sha(t) for t in texts], pa.string()),
                    ],
                    ["doc_id", "n_lines", "n_dropped", "text" if with_text else "kept_sha256"],
                )

    return run


def filter_bits(text_bytes: int, rule: LineRule) -> int:
    """Bits for as many lines as so many bytes can hold, within the bounds."""
    most_lines = text_bytes // (rule.min_chars + 1) + 1
    return min(MOST_BITS, max(LEAST_BITS, (BITS_PER_LINE * most_lines - 1).bit_length()))


def _staged(
    docs: DataFrame, rule: LineRule, id_col: str, text_col: str, bits: int | None, with_text: bool
) -> tuple[DataFrame, DataFrame]:
    """(every document with its suspected lines, the documents with the keys they lose)."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    if bits is None:
        bits = filter_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, rule)
    full = np.zeros((1 << bits) // 8, np.uint8)
    blocks = full.reshape(-1, BLOCK_BYTES)
    for row in twice_seen(rows.select("text"), rule, bits).collect():
        blocks[row["block"]] = np.frombuffer(row["twice"], np.uint8)
    twice = spark.sparkContext.broadcast(full.tobytes())
    staged = freeze(
        rows.mapInArrow(
            _suspects(rule, bits, twice, with_text),
            "doc_id bigint, n_lines bigint, text string, kept_sha256 string, suspects array<binary>",
        )
    )
    pairs = freeze(
        staged.where(F.size("suspects") > 0)
        .select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.explode("suspects").alias("line"))
        .distinct()
    )
    groups = freeze(
        pairs.groupBy("line")
        .agg(F.max("doc").alias("keep"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= rule.min_docs)
    )
    lost = attach(pairs, groups, "line", "n", "doc", "inner").where(F.col("doc") < F.col("keep"))
    return staged, lost.groupBy("doc").agg(F.collect_list("line").alias("lost"))


def _with_lost(staged: DataFrame, lost: DataFrame) -> DataFrame:
    suspects = staged.where(F.size("suspects") > 0)
    return suspects.join(lost, F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("doc"), "left").select(
        "doc_id", "text", "lost"
    )


def line_report(
    docs: DataFrame,
    rule: LineRule = LineRule(),
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept_sha256``.

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys of at
    least ``min_chars`` code points that at least ``min_docs`` documents hold lose all
    their lines but those of the largest doc_id that holds them; other lines stay in
    order. Null text counts as empty: one empty line. Rows that share a doc_id are one
    document when documents are counted, each row is settled by itself; a null doc_id
    is the least id. Keys are compared by SHA-256. Other columns are not looked at; an
    empty table gives an empty result.

    ``bits`` fixes the size of the filters. They hold at most 32 MB each; beyond some
    30 million long lines they fill up, more lines are suspected and the result stays the same.
    """
    staged, lost = _staged(docs, rule, id_col, text_col, bits, False)
    settled = staged.where(F.size("suspects") == 0).select(
        "doc_id", "n_lines", F.lit(0).cast("bigint").alias("n_dropped"), "kept_sha256"
    )
    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"
    return settled.unionByName(_with_lost(staged, lost).mapInArrow(_settled(rule, False), schema))


def without_repeated_lines(
    docs: DataFrame,
    rule: LineRule = LineRule(),
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int | None = None,
) -> DataFrame:
    """``doc_id, text`` of every document without the lines that :func:`line_report` drops."""
    staged, lost = _staged(docs, rule, id_col, text_col, bits, True)
    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, text string"
    changed = _with_lost(staged, lost).mapInArrow(_settled(rule, True), schema).select("doc_id", "text")
    return staged.where(F.size("suspects") == 0).select("doc_id", "text").unionByName(changed)
