"""Removal of repeated passages by suffix sorting.

Every ``length``-byte string holds an anchor, the k-gram of least hash in it,
so that equal strings meet under equal anchors. Anchors seen in two documents
give contexts, the bytes around them that hold all strings with that anchor.
The contexts of an anchor are suffix-sorted in two stages: suffixes smaller than
their successors are sorted directly, the others induced by bucket scans; common
prefixes of neighbours then group equal strings, and each group's least doc_id
says where it came first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm import ngrams
from deskspark.llm.spread import attach, maybe_among
from deskspark.sources.scratch import freeze, short_lived

# Bytes of an anchor: long enough that chance rarely repeats one, short enough that anchors stay sparse
# (two in length - K + 2 positions).
K = 24
# A long text is read in pieces that overlap by one string; positions fit in POSITION_BITS.
PIECE = 1 << 20
POSITION_BITS = 28
FLUSH = 1 << 19
# Bytes of packed anchors handed on at a time, of text whose anchors make one block of hashes, about, and rows taken out of a batch at a time.
OUT = 1 << 20
BLOCK_BYTES = 1 << 22
ROWS = 256
# Contexts cut out at a time.
SPOTS = 1 << 13
# Bytes of contexts suffix-sorted at a time.
BATCH = 1 << 20


@dataclass(frozen=True)
class PassageRule:
    """``length`` of a repeated string in bytes (32 to 200); anchors with more distinct contexts than
    ``crowd`` have their strings grouped across tasks instead of in one."""

    length: int = 50
    crowd: int = 65_536

    @property
    def reach(self) -> int:
        """How far before its anchor a string can start."""
        return self.length - K


# --- suffix sorting ---------------------------------------------------------


def _lane(text: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 after each position as one number that orders like them."""
    view = np.lib.stride_tricks.as_strided(text[:8].view(">u8"), (len(text) - 7,), (1,))
    return view[np.minimum(at + 8 * k, len(view) - 1)].astype(np.uint64)


def _sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by ``depth`` bytes, eight at a time; later rounds only look at ties."""
    order = at[np.argsort(_lane(text, at, 0))]
    group = np.cumsum(np.concatenate(([0], np.diff(_lane(text, order, 0)) != 0)))
    for k in range(1, -(-depth // 8)):
        same = np.concatenate((group[1:] == group[:-1], [False]))
        tied = np.flatnonzero(same | np.concatenate(([False], same[:-1])))
        if not len(tied):
            break
        lane = _lane(text, order[tied], k)
        place = np.lexsort((lane, group[tied]))
        order[tied] = order[tied][place]
        new = np.zeros(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        lane, owner = lane[place], group[tied]
        new[tied[1:]] |= (lane[1:] != lane[:-1]) & (owner[1:] == owner[:-1])
        group = np.cumsum(new)
    return order


def two_stage_order(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` (unsigned bytes, 0 only as an end mark) ordered by at least ``depth`` bytes: all,
    or those where ``wanted`` is true and what these are induced from.

    Suffixes smaller than their successors are sorted directly. A larger one
    follows from its successor: buckets (first bytes) are scanned upwards, and
    what precedes an entry is appended to its own bucket, in rounds for runs of
    one byte. Suffixes that agree in ``depth`` bytes may come in any order.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    step = np.sign(padded[1 : n + 1].astype(np.int16) - text)
    # A run of equal bytes is as the byte after it.
    changes = np.flatnonzero(step)
    small = np.zeros(n, bool)
    if len(changes):
        after = np.minimum(np.searchsorted(changes, np.arange(n)), len(changes) - 1)
        small = step[changes[after]] > 0
    small[text == 0] = True
    if wanted is None:
        direct, later, firsts = np.flatnonzero(small), ~small, text
    else:
        # A larger suffix follows from its successor, so that one is sorted too.
        kept = wanted.copy()
        ahead = np.flatnonzero(kept & ~small)
        while len(ahead):
            ahead = ahead[ahead < n - 1] + 1
            ahead = ahead[~kept[ahead]]
            kept[ahead] = True
            ahead = ahead[~small[ahead]]
        direct, later, firsts = np.flatnonzero(kept & small), kept & ~small, text[kept]
    direct = _sorted_directly(padded, direct, depth)
    first_of = text[direct]
    sizes = np.bincount(firsts, minlength=256)
    starts = np.cumsum(sizes) - sizes
    tops = np.searchsorted(first_of, np.arange(257))
    order = np.empty(len(firsts), np.int64)
    heads = starts.copy()
    for c in np.flatnonzero(sizes):
        low = starts[c]
        while low < heads[c]:  # runs of this byte, one byte more a round
            found = order[low : heads[c]] - 1
            low = heads[c]
            found = found[found >= 0]
            found = found[(text[found] == c) & later[found]]
            order[low : low + len(found)] = found
            heads[c] += len(found)
        order[heads[c] : starts[c] + sizes[c]] = direct[tops[c] : tops[c + 1]]
        before = order[starts[c] : starts[c] + sizes[c]] - 1
        before = before[before >= 0]
        before = before[(text[before] > c) & later[before]]
        bucket = text[before]
        place = np.argsort(bucket, kind="stable")
        before, bucket = before[place], bucket[place]
        kinds, at, many = np.unique(bucket, return_index=True, return_counts=True)
        for kind, i, m in zip(kinds, at, many):
            order[heads[kind] : heads[kind] + m] = before[i : i + m]
            heads[kind] += m
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, counted up to ``depth``."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    shared = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(-(-depth // 8)):
        differ = _lane(padded, order[live], k) ^ _lane(padded, order[live - 1], k)
        # Leading zero bytes of what differs, eight when nothing does.
        zeros = sum((differ < np.uint64(1 << (64 - 8 * j))).astype(np.int64) for j in range(1, 8))
        zeros += differ == 0
        shared[live] += zeros
        live = live[differ == 0]
    return np.minimum(shared, depth)


# --- anchors ----------------------------------------------------------------


def _pieces(text: bytes, rule: PassageRule) -> Iterator[tuple[int, bytes]]:
    step = PIECE - rule.length + 1
    for at in range(0, max(len(text) - rule.length + 1, 0), step):
        yield at, text[at : at + PIECE]


def _hashed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of K-byte grams given as three numbers each."""
    return ngrams.mixed((a * ngrams.M1 ^ b) * ngrams.M2 ^ c)


def _gram_hashes(blob: np.ndarray) -> np.ndarray:
    view = np.lib.stride_tricks.as_strided(blob[:8].view("<u8"), (len(blob) - 7,), (1,))
    return _hashed(view[:-16], view[8:-8], view[16:])


def anchors(texts: list[bytes], rule: PassageRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the anchors of all strings: the leftmost k-gram of least hash in each."""
    lengths = np.array([len(t) for t in texts], np.int64)
    blob = np.frombuffer(b"".join(texts) + bytes(K), np.uint8)
    h = _gram_hashes(blob)
    low = np.uint64((1 << POSITION_BITS) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, span = rule.reach + 1, 1
    least = packed
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(packed) - width + 1], least[width - span : width - span + len(packed) - width + 1])
    ends = np.cumsum(lengths)
    # No string starts in the last bytes of a text.
    edges = np.zeros(len(blob) + 1, np.int64)
    np.add.at(edges, ends - np.minimum(lengths, rule.length - 1), 1)
    np.add.at(edges, ends, -1)
    size = min(len(blob) - K, len(least))
    inside = np.cumsum(edges[:size]) == 0
    spots = (least[:size][inside] & low).astype(np.int64)
    # The place of the leftmost least hash never goes back.
    spots = spots[np.concatenate(([True], spots[1:] != spots[:-1]))] if len(spots) else spots
    owner = np.searchsorted(ends, spots, side="right")
    return owner, spots - (ends - lengths)[owner], h[spots]


RECORD = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("pos", "<i4")])


def _packed(records: np.ndarray) -> bytes:
    """Records column by column in byte planes, documents as offsets from the least, so that shuffle
    compression removes the zeros. Of the hash 48 bits go on: a rare clash only adds a candidate."""
    least = records["doc"].min()
    columns = [
        (records["hash"] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6],
        (np.ascontiguousarray(records["doc"]).view("<u8") - np.int64(least).view(np.uint64)).view(np.uint8).reshape(-1, 8),
        records["pos"].astype("<i4").view(np.uint8).reshape(-1, 4),
    ]
    return np.array([len(records), least], "<i8").tobytes() + b"".join(c.T.tobytes() for c in columns)


def _unpacked(data: bytes) -> np.ndarray:
    n, least = np.frombuffer(data, "<i8", 2).tolist()
    planes = np.frombuffer(data, np.uint8, offset=16).reshape(18, n)
    out = np.empty(n, RECORD)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, 2:] = planes[:6].T
    out["hash"] = wide.view("<u8")[:, 0]
    offsets = np.ascontiguousarray(planes[6:14].T).view("<u8")[:, 0]
    out["doc"] = (offsets + np.int64(least).view(np.uint64)).view(np.int64)
    out["pos"] = np.ascontiguousarray(planes[14:].T).view("<i4")[:, 0]
    return out


def _anchor_rows(rule: PassageRule, bits: int):
    """Task code: (doc_id, text) in; (block, known, records) out.

    Anchors that two documents of the task share are known to repeat and go on
    by document; of the others, and once for each known hash, the block of the
    hash has to hear. So a hash is sent to its block once by a task at most.
    """

    def batch_of(out: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
        columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["block", "known", "records"])

    def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held)
        held.clear()
        every = every[np.argsort(every["hash"], kind="stable")]
        new = np.concatenate(([True], every["hash"][1:] != every["hash"][:-1]))
        heads = np.flatnonzero(new)
        many = np.minimum.reduceat(every["doc"], heads) != np.maximum.reduceat(every["doc"], heads)
        known = many[np.cumsum(new) - 1]
        told = every[heads[many]].copy()
        told["pos"] = -1
        parts = [(every[known], True), (told, False), (every[~known], False)]
        del every, told, known, many, new, heads
        out, size = [], 0
        while parts:  # one copy at a time
            part, flag = parts.pop()
            if flag:
                spread = ngrams.mixed(np.ascontiguousarray(part["doc"]).view(np.uint64))
                order = np.argsort(spread, kind="stable")
                part, spread = part[order], spread[order]
            else:  # in the order of hashes, hence of blocks
                spread = part["hash"]
            block = (spread >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(part) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                out.append((int(block[a]), flag, _packed(part[a:b])))
                size += len(out[-1][2])
                if size >= OUT:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in ngrams.chunks(batch.column(1)):
                cut = [(ids[first + i], at, p) for i, t in enumerate(texts) for at, p in _pieces(t, rule)]
                while cut:  # at most a few pieces at a time
                    part, size = [], 0
                    while cut and size < PIECE:
                        part.append(cut.pop())
                        size += len(part[-1][2])
                    owner, pos, h = anchors([p for _, _, p in part], rule)
                    made = np.empty(len(h), RECORD)
                    made["hash"], made["doc"] = h, np.array([d for d, _, _ in part], np.int64)[owner]
                    made["pos"] = pos + np.array([at for _, at, _ in part], np.int64)[owner]
                    held.append(made)
                    n += len(made)
                if n >= FLUSH:
                    yield from rows(held)
                    held, n = [], 0
        if n:
            yield from rows(held)

    return run


SPOT = np.dtype([("doc", "<i8"), ("pos", "<i4")])


def _spots_of(parts: list[tuple[bool, bytes]]) -> np.ndarray:
    """One block: anchors whose hash two documents have, as (document, position)."""
    records = {True: [np.empty(0, RECORD)], False: [np.empty(0, RECORD)]}
    for known, data in parts:
        records[known].append(_unpacked(data))
    asked = np.concatenate(records.pop(False))
    if len(asked):
        asked = asked[np.argsort(asked["hash"], kind="stable")]
        new = np.concatenate(([True], asked["hash"][1:] != asked["hash"][:-1]))
        heads = np.flatnonzero(new)
        many = np.minimum.reduceat(asked["doc"], heads) != np.maximum.reduceat(asked["doc"], heads)
        many |= np.minimum.reduceat(asked["pos"], heads) < 0
        asked = asked[many[np.cumsum(new) - 1] & (asked["pos"] >= 0)]
    both = [asked, *records[True]]
    spots = np.empty(sum(map(len, both)), SPOT)
    for name in SPOT.names:
        spots[name] = np.concatenate([x[name] for x in both])
    return spots


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The other columns' values of each run of rows with one value in the first column."""
    at, held = None, []
    for batch in _few(batches):
        for block, *values in zip(*(c.to_pylist() for c in batch.columns)):
            if block != at and held:
                yield at, held
                held = []
            at = block
            held.append(tuple(values))
    if held:
        yield at, held


def _repeated_spots(bits: int):
    """Task code: rows of blocks, sorted by block, in; (bucket of documents, packed spots) out."""

    def dealt(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        spots = np.concatenate(held)
        bucket = (ngrams.mixed(np.ascontiguousarray(spots["doc"]).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        spots, bucket = spots[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))).tolist() if len(spots) else [0]
        rows = [spots[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[cuts[:-1]], pa.int64()), pa.array(rows, pa.binary())], ["bucket", "spots"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, parts in _in_blocks(batches):
            held.append(_spots_of(parts))
            n += len(held[-1])
            if n >= FLUSH:
                yield from dealt(held)
                held, n = [], 0
        if n:
            yield from dealt(held)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: rows of buckets, sorted by bucket, in; the positions of each document out."""
    for _, parts in _in_blocks(batches):
        spots = np.frombuffer(b"".join(x for x, in parts), SPOT)
        spots = spots[np.argsort(spots["doc"], kind="stable")]
        cuts = np.flatnonzero(np.concatenate(([True], spots["doc"][1:] != spots["doc"][:-1], [True]))).tolist()
        positions = np.ascontiguousarray(spots["pos"])
        rows = [positions[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(spots["doc"][cuts[:-1]], pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "spots"]
        )


# --- contexts ---------------------------------------------------------------


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _contexts(rule: PassageRule):
    """Task code: (doc_id, text, spots) in; one (anchor, context, doc_id, start) per distinct spot out.

    The first byte of a context says where its anchor is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few(batches):
            for first, texts in ngrams.chunks(part.column(1)):
                yield from of(*(part.column(i).slice(first, len(texts)).to_pylist() for i in (0, 2)), texts)

    def of(ids: list[int], spots: list[bytes], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        at = [np.unique(np.frombuffer(x, "<i4")).astype(np.int64) for x in spots]
        many = np.array([len(x) for x in at])
        lengths = np.array([len(t) for t in texts])
        begin = np.cumsum(lengths) - lengths
        owners, places = np.repeat(np.arange(len(texts)), many), np.concatenate(at)
        blob = np.frombuffer(b"".join(texts) + bytes(K), np.uint8)
        view = np.lib.stride_tricks.as_strided(blob[:8].view("<u8"), (len(blob) - 7,), (1,))
        for low in range(0, len(places), SPOTS):
            own, place = owners[low : low + SPOTS], places[low : low + SPOTS]
            start = np.maximum(place - rule.reach, 0)
            sizes = np.minimum(place + rule.length, lengths[own]) - start + 1
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            # The byte before a context's first one makes room for the anchor's place.
            data = blob[np.arange(offsets[-1]) + np.repeat(begin[own] + start - 1 - offsets[:-1], sizes)]
            data[offsets[:-1]] = place - start
            grams = [view[begin[own] + place + 8 * i] for i in range(K // 8)]
            contexts = pa.Array.from_buffers(
                pa.binary(), len(own), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(data)]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_hashed(*grams).view(np.int64), pa.int64()),
                    contexts,
                    pa.array(np.array(ids, np.int64)[own], pa.int64()),
                    pa.array(start.astype(np.int32), pa.int32()),
                ],
                ["anchor", "context", "doc_id", "start"],
            )

    return run


RUN = np.dtype([("n", "<u1"), ("doc", "<i8")])


def _first_documents(contexts: list[bytes], docs: np.ndarray, rule: PassageRule) -> tuple[np.ndarray, np.ndarray]:
    """For every string of the contexts, in order, the context's number and the string's least document."""
    lengths = np.array([len(c) for c in contexts])
    # Bytes are shifted by one so that 0 ends a context; UTF-8 has no byte above 0xF4.
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8) + np.uint8(1)
    starts = np.cumsum(lengths + 1) - lengths - 1
    text[starts] = 0  # the byte that says where the anchor is
    owner = np.repeat(np.arange(len(contexts)), lengths + 1)
    offset = np.arange(len(text)) - starts[owner]
    valid = (offset >= 1) & (offset + rule.length <= lengths[owner])
    order = two_stage_order(text, rule.length, valid)
    order = order[valid[order]]
    equal = common_prefixes(text, order, rule.length) >= rule.length
    heads = np.flatnonzero(~equal)
    least = np.empty(len(text), np.int64)
    if len(order):
        sizes = np.diff(np.concatenate((heads, [len(order)])))
        least[order] = np.repeat(np.minimum.reduceat(docs[owner[order]], heads), sizes)
    return owner[valid], least[valid]


def _runs(least: np.ndarray) -> bytes:
    cuts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1], [True])))
    out = np.empty(len(cuts) - 1, RUN)
    out["n"], out["doc"] = np.diff(cuts), least[cuts[:-1]]
    return out.tobytes()


def _suffix_groups(rule: PassageRule):
    """Task code: (anchor, hash, context, first_doc, n) sorted by anchor in; (hash, anchor, n, firsts) out."""

    def solve(held: list[tuple[int, int, bytes, int, int]]) -> pa.RecordBatch:
        docs, n = np.array([r[3] for r in held], np.int64), np.array([r[4] for r in held], np.int64)
        owner, least = _first_documents([r[2] for r in held], docs, rule)
        cuts = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (least[1:] != least[:-1]))[: len(owner)]))
        runs = np.empty(len(cuts), RUN)
        runs["n"], runs["doc"] = np.diff(np.append(cuts, len(owner))), least[cuts]
        own = owner[cuts]
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))[: len(own)])
        rows = own[heads]
        lowest = np.minimum.reduceat(least[cuts], heads) if len(heads) else docs[:0]
        offsets = np.append(heads, len(cuts)) * RUN.itemsize
        firsts = pa.Array.from_buffers(
            pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(runs.tobytes())]
        )
        kept = pa.array((n[rows] > 1) | (lowest < docs[rows]))
        numbers = [pa.array(np.array([r[i] for r in held], np.int64)[rows], pa.int64()) for i in (1, 0)]
        columns = [c.filter(kept) for c in (*numbers, pa.array(n[rows], pa.int64()), firsts)]
        return pa.RecordBatch.from_arrays(columns, ["hash", "anchor", "n", "firsts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != at and size >= BATCH:
                    yield solve(held)
                    held, size = [], 0
                at = row[0]
                held.append(row)
                size += len(row[2])
        if held:
            yield solve(held)

    return run


def _crowded(contexts: DataFrame, rule: PassageRule) -> DataFrame:
    """The same for anchors with a crowd of contexts, one row per string, so that no task holds them all."""
    at = F.expr(f"sequence(0, octet_length(context) - {rule.length} - 1)")
    rows = (
        contexts.where(F.octet_length("context") > rule.length)
        .select("key", "n", "first_doc", "context", F.explode(at).alias("at"))
        .withColumn("string", F.expr(f"substring(context, at + 2, {rule.length})"))
        .drop("context")
    )
    firsts = rows.groupBy("string").agg(F.min("first_doc").alias("least"), F.count(F.lit(1)).alias("rows"))
    met = attach(rows, freeze(firsts), "string", "rows", "at", "inner")
    pairs = F.sort_array(F.collect_list(F.struct("at", "least")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = [_runs(np.array([p["least"] for p in row])) for row in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(firsts, pa.binary())], ["hash", "anchor", "n", "firsts"]
            )

    return (
        met.groupBy("key", "n")
        .agg(pairs.alias("pairs"))
        .select("key.hash", "key.anchor", "n", "pairs")
        .mapInArrow(packed, "hash bigint, anchor bigint, n bigint, firsts binary")
    )


def _spans(rule: PassageRule):
    """Task code: (doc_id, start, firsts) in; (doc_id, from, to) of bytes to remove out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, begins, ends = [], [], []
            for doc, start, firsts in zip(*(c.to_pylist() for c in batch.columns)):
                at = start
                for n, first in np.frombuffer(firsts, RUN).tolist():
                    if first < doc:
                        ids.append(doc)
                        begins.append(at)
                        ends.append(at + n - 1 + rule.length)
                    at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, begins, ends)], ["doc_id", "begin", "end"]
            )

    return run


def _copies(docs: DataFrame, rule: PassageRule) -> DataFrame:
    """``doc_id, end`` of documents with the text of one of smaller doc_id: they lose all their bytes, and
    whatever starts in them starts in that one before."""
    rows = docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("bigint").alias("end"))
    rows = rows.where(F.col("end") >= rule.length)
    groups = freeze(
        rows.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    return attach(rows, groups, "sha", "n", "doc_id", "inner").where("doc_id > least").select("doc_id", "end").distinct()


def repeated_spans(docs: DataFrame, rule: PassageRule = PassageRule()) -> DataFrame:
    """``doc_id, begin, end`` of bytes covered by strings that start in a document of smaller doc_id, of the
    columns ``doc_id, text``; spans of one document may overlap."""
    named = docs.where(F.col("doc_id").isNotNull())
    copies = freeze(_copies(named, rule))
    size = named.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    bits = max(1, size // BLOCK_BYTES).bit_length()
    told = named.mapInArrow(_anchor_rows(rule, bits), "block bigint, known boolean, records binary")
    blocks = told.repartition("block").sortWithinPartitions("block")
    buckets = blocks.mapInArrow(_repeated_spots(bits), "bucket bigint, spots binary")
    by_document = buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _by_document, "doc_id bigint, spots binary"
    )
    spots = freeze(by_document.join(copies, "doc_id", "left_anti"))
    texts = maybe_among(named, "doc_id", spots.select("doc_id"))
    found = freeze(
        texts.join(spots, "doc_id")
        .select("doc_id", "text", "spots")
        .mapInArrow(_contexts(rule), "anchor bigint, context binary, doc_id bigint, start int")
        .select("context", "doc_id", "start", F.struct("anchor", F.xxhash64("context").alias("hash")).alias("key"))
    )
    least = [F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")]
    distinct = freeze(
        found.groupBy("key").agg(*least, F.min(F.octet_length("context") - rule.length).alias("strings"))
    )
    several = freeze(distinct.groupBy("key.anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    # An anchor with one context has nothing to compare: all its strings came first where the context did.
    single = distinct.where("n > 1").join(several, distinct["key.anchor"] == several["anchor"], "left_anti")
    single = single.select("key", "n", "first_doc", "strings", F.lit(None).cast("binary").alias("firsts"))
    contexts = freeze(
        maybe_among(found.withColumn("anchor", F.col("key.anchor")), "anchor", several.select("anchor"))
        .groupBy("anchor", "key", "context")
        .agg(*least)
    )
    crowds = freeze(several.where(F.col("m") > rule.crowd).select("anchor"))
    crowded = not crowds.isEmpty()
    rest = contexts.join(crowds, "anchor", "left_anti") if crowded else contexts
    kind = "hash bigint, anchor bigint, n bigint, firsts binary"
    sorted_rest = rest.repartition("anchor").sortWithinPartitions("anchor")
    firsts = sorted_rest.select("anchor", "key.hash", "context", "first_doc", "n").mapInArrow(_suffix_groups(rule), kind)
    if crowded:
        firsts = firsts.unionByName(_crowded(contexts.join(crowds, "anchor", "left_semi"), rule))
    compared = firsts.join(several, "anchor", "left_semi").select(
        F.struct("anchor", "hash").alias("key"),
        "n",
        F.lit(None).cast("bigint").alias("first_doc"),
        F.lit(None).cast("int").alias("strings"),
        "firsts",
    )
    met = attach(
        found.select("key", "doc_id", "start"), freeze(single.unionByName(compared)), "key", "n", "doc_id", "inner"
    )
    plain = met.where("first_doc < doc_id").select(
        "doc_id",
        F.col("start").cast("bigint").alias("begin"),
        (F.col("start") + F.col("strings") - 1 + rule.length).cast("bigint").alias("end"),
    )
    mixed = met.where("firsts IS NOT NULL").select("doc_id", "start", "firsts")
    kind = "doc_id bigint, begin bigint, end bigint"
    parts = plain.unionByName(mixed.mapInArrow(_spans(rule), kind))
    return parts.unionByName(copies.select("doc_id", F.lit(0).cast("bigint").alias("begin"), "end"))


def remove_repeats(
    docs: DataFrame, rule: PassageRule = PassageRule(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Documents that lose bytes: ``doc_id, kept_bytes, n_removed, spans`` (maximal removed runs as begin, end).

    Strings are judged on the input, so overlaps count and the order of removal
    does not matter; matches never cross documents. A cut may fall inside a
    character, hence bytes. Null texts count as empty; a row without doc_id
    keeps all. Rows that share a doc_id are expected to share their text and do
    not remove each other's. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with short_lived(docs.sparkSession):
        spans = freeze(
            repeated_spans(base, rule)
            .distinct()
            .groupBy("doc_id")
            .agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("found")),
            lasting=True,
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            kept, removed, runs = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, out, at, merged = text.encode(), [], 0, []
                for span in found:
                    if merged and span["begin"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span["end"])
                    else:
                        merged.append([span["begin"], span["end"]])
                for begin, end in merged:
                    out.append(data[at:begin])
                    at = end
                out.append(data[at:])
                kept.append(b"".join(out))
                removed.append(len(data) - len(kept[-1]))
                runs.append([{"begin": b, "end": e} for b, e in merged])
            span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, span_type)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], ["doc_id", "kept_bytes", "n_removed", "spans"]
            )

    texts = maybe_among(base.where("doc_id IS NOT NULL"), "doc_id", spans.select("doc_id"))
    schema = "doc_id bigint, kept_bytes binary, n_removed bigint, spans array<struct<begin: bigint, end: bigint>>"
    return texts.join(spans, "doc_id").select("doc_id", "text", "found").mapInArrow(cut, schema)


def removal_report(docs: DataFrame, rule: PassageRule = PassageRule()) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    cuts = freeze(
        remove_repeats(docs, rule)
        .select(
            F.col("doc_id").alias("_doc"), "n_removed", F.size("spans").alias("n_spans"), F.sha2("kept_bytes", 256).alias("_sha")
        )
        .distinct()
    )
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("_whole"))
    return whole.join(cuts, F.col("doc_id") == F.col("_doc"), "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("_sha", "_whole").alias("kept_sha256"),
    )
