"""Alignment of two tokenizers' tokens by an associative monoid of fragments.

The tokens of a byte range form a fragment: an open prefix up to the first byte at which
tokens of both sides end, closed groups, and an open suffix. Fragments of neighbouring
ranges compose by joining suffix and prefix, in any order of composition. A word between
two safe cuts is a closed fragment by itself and is worked out once; a very long document
is cut into byte ranges whose fragments are made in tasks of their own and composed by a
tree.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm.bpe_stream import _byte_letters
from deskspark.sources.scratch import freeze

# Bytes of text beyond which a document is cut into ranges, and bytes of a range.
RANGE_BYTES = 1 << 16
# Fragments that one step of the tree composes.
FAN = 16
# Links that a task holds before it hands on a unit of documents; words it remembers;
# bytes of a word that it remembers.
UNIT_LINKS = 1 << 22
KNOWN = 1 << 18
SHORT = 64
# Texts looked at together.
ROWS = 128
# Words tokenized in one call.
WORDS = 1 << 14
# A pair of ids is one number: the first id times 2**PAIR_BITS plus the second. Documents in a unit.
PAIR_BITS = 20
UNIT_DOCS = 1 << 16
# A single blank between two characters that are none: no token of either side crosses it.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
CLOSE_BLANKS = re.compile(r"\s\s|^\s|\s$")
# What stands for a blank and for a byte in the second vocabulary.
BLANK = "▁"
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Fragment:
    """Tokens of a byte range: all open, or with a first and a last common end."""

    closed: bool
    prefix: tuple[list[int], list[int]]
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    last: int = 0


@dataclass
class Groups:
    """Closed groups in order from byte ``at`` on: sizes and ids of both sides."""

    at: int
    a_sizes: np.ndarray
    a_ids: np.ndarray
    b_sizes: np.ndarray
    b_ids: np.ndarray


def fragment(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray) -> tuple[Fragment, Groups | None]:
    """The fragment of the tokens that end in one byte range, and its closed groups."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    if not len(common):
        return Fragment(False, (a_ids.tolist(), b_ids.tolist())), None

    def cut(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        place = np.searchsorted(common, ends, side="left")
        sizes = np.bincount(place, minlength=len(common) + 1)
        first, inner = sizes[0], int(sizes[:-1].sum())
        return ids[:first], sizes[1:-1], ids[first:inner], ids[inner:]

    a, b = cut(a_ids, a_ends), cut(b_ids, b_ends)
    whole = Fragment(True, (a[0].tolist(), b[0].tolist()), (a[3].tolist(), b[3].tolist()), int(common[-1]))
    inside = Groups(int(common[0]), a[1], a[2], b[1], b[2]) if len(common) > 1 else None
    return whole, inside


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, Groups | None]:
    """The fragment of two neighbouring ranges, and the group that their joint closes."""

    def both(x: tuple[list[int], list[int]], y: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
        return x[0] + y[0], x[1] + y[1]

    if not left.closed:
        return Fragment(right.closed, both(left.prefix, right.prefix), right.suffix, right.last), None
    if not right.closed:
        return Fragment(True, left.prefix, both(left.suffix, right.prefix), left.last), None
    a, b = both(left.suffix, right.prefix)
    return Fragment(True, left.prefix, right.suffix, right.last), _group(left.last, a, b)


def _group(at: int, a: list[int], b: list[int]) -> Groups:
    return Groups(at, np.array([len(a)]), np.array(a, np.int64), np.array([len(b)]), np.array(b, np.int64))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each span, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def links(g: Groups) -> np.ndarray:
    """Every pair of ids that share a group, by occurrence."""
    a_sizes, b_sizes = g.a_sizes.astype(np.int64), g.b_sizes.astype(np.int64)
    own = np.repeat(b_sizes, a_sizes)
    first = np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)
    return (np.repeat(g.a_ids.astype(np.int64), own) << PAIR_BITS) | g.b_ids.astype(np.int64)[_spans(first, own)]


def shown(g: Groups) -> str:
    """``a1,a2|b1;a3|b2,b3``"""
    a, b = iter(g.a_ids.tolist()), iter(g.b_ids.tolist())
    return ";".join(
        f"{','.join(str(next(a)) for _ in range(m))}|{','.join(str(next(b)) for _ in range(n))}"
        for m, n in zip(g.a_sizes.tolist(), g.b_sizes.tolist())
    )


class _Bytes:
    """Bytes of every id of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return self.data[_spans(self.starts[ids], self.sizes[ids])].tobytes()


class Pair:
    """Two tokenizers: byte-level BPE (JSON file) and byte-fallback BPE (sentencepiece model)."""

    def __init__(self, a_path: str, b_path: str):
        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        named = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        raw = [named.get(i, "") for i in range(max(named) + 1)]
        special = {t["content"] for t in spec["added_tokens"]}
        self.a_bytes = _Bytes([t.encode() if t in special else bytes(letters[c] for c in t) for t in raw])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = [BYTE.fullmatch(p) if self.b.is_byte(i) else None for i, p in enumerate(pieces)]
        self.b_bytes = _Bytes(
            [bytes([int(m[1], 16)]) if m else p.replace(BLANK, " ").encode() for p, m in zip(pieces, byte)]
        )
        cutter = spec.get("pre_tokenizer") or {}
        self.can_cut = (
            cutter.get("type") == "ByteLevel"
            and cutter.get("use_regex", True)
            and not cutter.get("add_prefix_space")
            and not any(BLANK in p.lstrip(BLANK) for p in pieces)
        )

    def words(self, text: str) -> list[str]:
        """The text between safe cuts: tokens of a word do not depend on what stands around it."""
        if not self.can_cut:
            return [text]
        return SAFE_CUT.split(text) if CLOSE_BLANKS.search(text) else text.split(" ")

    def _tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        return np.array(a, np.int64), np.array(self.b.encode(text), np.int64)

    def _groups(self, words: list[str]) -> tuple[Groups, np.ndarray] | None:
        """The groups of some words in a row and where those of each word stop; None if the tokens are other bytes."""
        text = " ".join(words)
        a, b = self._tokens(text)
        want = b" " + text.encode()
        if self.a_bytes.joined(a) != want or self.b_bytes.joined(b) != want:
            return None
        a_ends, b_ends = np.cumsum(self.a_bytes.sizes[a]), np.cumsum(self.b_bytes.sizes[b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_sizes, b_sizes = (
            np.bincount(np.searchsorted(common, ends, side="left"), minlength=len(common)) for ends in (a_ends, b_ends)
        )
        stops = np.searchsorted(common, np.cumsum([len(w.encode()) + 1 for w in words])) + 1
        return Groups(0, a_sizes, a, b_sizes, b), stops

    def parts(self, words: list[str]) -> Iterator[tuple[list[int], Groups, np.ndarray]]:
        """(places of some words, their groups, where each one's stop); words of other bytes than their tokens are left out.

        Words without blanks at their ends go together, since a safe cut stands between any two of them.
        """
        alone = list(range(len(words)))
        if self.can_cut:
            plain = [i for i, w in enumerate(words) if w and not w[0].isspace() and not w[-1].isspace()]
            found = self._groups([words[i] for i in plain]) if plain else None
            if found is not None:
                yield plain, *found
                alone = sorted(set(alone) - set(plain))
        for i in alone:
            found = self._groups([words[i]])
            if found is not None:
                yield [i], *found

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides of words in a row; None if the tokens of one are other bytes."""
        found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(words)
        for places, g, stops in self.parts(words):
            a_at, b_at = (np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], stops))] for n in (g.a_sizes, g.b_sizes))
            for k, i in enumerate(places):
                found[i] = (g.a_ids[a_at[k] : a_at[k + 1]], g.b_ids[b_at[k] : b_at[k + 1]])
        if any(f is None for f in found):
            return None
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    """One per worker and pair of files."""
    return Pair(a_path, b_path)


class _Memory:
    """Words by number, with their links, their groups as text and (tokens of either side, groups, links, bad)."""

    def __init__(self, both: Pair):
        self.both = both
        ids = max(len(both.a_bytes.sizes), len(both.b_bytes.sizes))
        # An id as text by what follows it.
        self.shown = [f"{i}{end}" for i in range(ids) for end in ",|;"]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.links: list[np.ndarray] = []
        self.counts = np.zeros((0, 5), np.int64)

    def __len__(self) -> int:
        return len(self.text)

    def numbers(self, texts: list[list[str]]) -> list[list[int]]:
        """The numbers of the words of some texts."""
        get = self.number.get
        found = [[get(w, -1) for w in words] for words in texts]
        new = list({w for words, ns in zip(texts, found) if -1 in ns for w, n in zip(words, ns) if n < 0})
        if not new:
            return found
        fresh: dict[str, int] = {}
        for i in range(0, len(new), WORDS):
            self._learn(new[i : i + WORDS], fresh)
        self.number.update((w, n) for w, n in fresh.items() if len(w) <= SHORT)
        return [
            [fresh[w] if n < 0 else n for w, n in zip(words, ns)] if -1 in ns else ns for words, ns in zip(texts, found)
        ]

    def _learn(self, words: list[str], fresh: dict[str, int]) -> None:
        for places, g, stops in self.both.parts(words):
            fresh.update((words[i], len(self) + k) for k, i in enumerate(places))
            starts = np.concatenate(([0], stops[:-1]))
            per_word = [np.add.reduceat(n, starts) for n in (g.a_sizes, g.b_sizes, np.ones_like(g.a_sizes), g.a_sizes * g.b_sizes)]
            self.counts = np.concatenate((self.counts, np.stack([*per_word, np.zeros_like(stops)], axis=1)))
            self.links.append(links(g))
            # Tokens in the order of the text: each group's first side, then its second.
            both = g.a_sizes + g.b_sizes
            group_at = np.cumsum(both) - both
            code = np.zeros(int(both.sum()), np.int64)
            code[_spans(group_at, g.a_sizes)] = 3 * g.a_ids
            code[_spans(group_at + g.a_sizes, g.b_sizes)] = 3 * g.b_ids
            code[group_at + g.a_sizes - 1] += 1
            code[group_at + both - 1] += 2
            tokens = [self.shown[c] for c in code.tolist()]
            at = np.concatenate((group_at, [len(code)]))
            self.text += ["".join(tokens[i:j]) for i, j in zip(at[starts].tolist(), at[stops].tolist())]
        bad = [w for w in words if w not in fresh]
        fresh.update((w, len(self) + k) for k, w in enumerate(bad))
        self.text += [""] * len(bad)
        self.counts = np.concatenate((self.counts, np.tile([[0, 0, 0, 0, 1]], (len(bad), 1))))

    def flat_links(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(document, pair) of every link of some documents given by their words' numbers."""
        sizes = self.counts[:, 3]
        words = np.concatenate(docs)
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        all_links = np.concatenate([np.zeros(0, np.int64), *self.links])
        starts = np.cumsum(sizes) - sizes
        return np.repeat(owner, sizes[words]), all_links[_spans(starts[words], sizes[words])]


# Units of documents, and byte ranges of long ones. ``docs`` are a unit's documents in order with the number of
# distinct pairs of each; ``pairs`` the unit's distinct pairs, ``holders`` the documents that hold each; ``spots``
# which of them each document holds, ``times`` how often. The other columns belong to ranges.
_DOC = "struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,pairs:bigint>"
_UNIT = f"unit bigint, docs array<{_DOC}>, pairs binary, holders binary, spots binary, times binary"
_RANGE = "part bigint, doc_id bigint, valid boolean, a_ids binary, a_ends binary, b_ids binary, b_ends binary"
_DOC_TYPE = pa.struct(
    [
        ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.int64()),
    ]
)
_UNIT_TYPES = [("unit", pa.int64()), ("docs", pa.list_(_DOC_TYPE))] + [
    (n, pa.binary()) for n in ("pairs", "holders", "spots", "times")
]
_RANGE_TYPES = [("part", pa.int64()), ("doc_id", pa.int64()), ("valid", pa.bool_())] + [
    (n, pa.binary()) for n in ("a_ids", "a_ends", "b_ids", "b_ends")
]


def _row(types: list[tuple[str, pa.DataType]], **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], t) for n, t in types], [n for n, _ in types])


def _unit_row(unit: int, docs: list[dict], owner: np.ndarray, codes: np.ndarray, types) -> pa.RecordBatch:
    """A unit from the (document, pair) of its links."""
    both, times = np.unique((owner << (2 * PAIR_BITS)) | codes, return_counts=True)
    owner, codes = both >> (2 * PAIR_BITS), both & ((1 << (2 * PAIR_BITS)) - 1)
    distinct, spots, holders = np.unique(codes, return_inverse=True, return_counts=True)
    for doc, n in zip(docs, np.bincount(owner, minlength=len(docs)).tolist()):
        doc["pairs"] = n
    return _row(
        types, unit=unit, docs=docs, pairs=distinct.astype("<i8").tobytes(), holders=holders.astype("<u4").tobytes(),
        spots=np.diff(spots, prepend=0).astype("<i4").tobytes(), times=times.astype("<u4").tobytes(),
    )


def _nothing(doc_id: int | None) -> dict:
    return {"doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""}


class _Ranges:
    """Cuts the tokens of a long document into byte ranges as they come."""

    def __init__(self, unit: int, doc_id: int | None, size: int):
        self.unit, self.doc_id, self.size = unit, doc_id, size
        self.at, self.part = 0, 0
        self.held = [np.zeros(0, np.int64)] * 4

    def add(self, both: Pair, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        a_ends = self.at + np.cumsum(both.a_bytes.sizes[a])
        b_ends = self.at + np.cumsum(both.b_bytes.sizes[b])
        self.at = int(a_ends[-1])
        self.held = [np.concatenate(x) for x in zip(self.held, (a, a_ends, b, b_ends))]
        while self.at >= (self.part + 1) * self.size:
            yield self._cut((self.part + 1) * self.size)

    def _cut(self, end: int) -> pa.RecordBatch:
        a, a_ends, b, b_ends = self.held
        i, j = np.searchsorted(a_ends, end, side="right"), np.searchsorted(b_ends, end, side="right")
        self.held = [a[i:], a_ends[i:], b[j:], b_ends[j:]]
        own = (a[:i], a_ends[:i], b[:j], b_ends[:j])
        row = {n: x.astype("<i8").tobytes() for n, x in zip(("a_ids", "a_ends", "b_ids", "b_ends"), own)}
        self.part += 1
        return _row(_UNIT_TYPES + _RANGE_TYPES, unit=self.unit, part=self.part - 1, **row)

    def end(self, valid: bool) -> Iterator[pa.RecordBatch]:
        if valid:
            yield self._cut(self.at)
        yield _row(_UNIT_TYPES + _RANGE_TYPES, unit=self.unit, part=-1, doc_id=self.doc_id, valid=valid)


def _align(a_path: str, b_path: str, range_bytes: int, unit_links: int):
    """Task code: documents in, units and ranges out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        memory = _Memory(both)
        unit = TaskContext.get().partitionId() << 32
        types = _UNIT_TYPES + _RANGE_TYPES
        docs: list[dict] = []
        held: list[np.ndarray] = []
        n_links = 0

        def flush() -> pa.RecordBatch:
            full = [i for i, d in enumerate(held) if len(d)]
            owner = codes = np.zeros(0, np.int64)
            if full:
                owner, codes = memory.flat_links([held[i] for i in full])
                owner = np.array(full, np.int64)[owner]
            return _unit_row(unit, docs, owner, codes, types)

        def long_one(doc_id: int | None, text: str) -> Iterator[pa.RecordBatch]:
            ranges, words, found = _Ranges(unit, doc_id, range_bytes), both.words(text), None
            for i in range(0, len(words), WORDS):
                found = both.tokens(words[i : i + WORDS])
                if found is None:
                    break
                yield from ranges.add(both, *found)
            yield from ranges.end(found is not None)

        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                long = {i for i, t in enumerate(texts) if len(t) * 4 > range_bytes and len(t.encode()) > range_bytes}
                for i in sorted(long):
                    yield from long_one(ids[i], texts[i])
                    unit += 1
                short = [i for i, t in enumerate(texts) if t and i not in long]
                found = dict(zip(short, memory.numbers([both.words(texts[i]) for i in short])))
                for i, doc_id in enumerate(ids):
                    if i in long:
                        continue
                    doc, numbers = _nothing(doc_id), np.array(found.get(i, []), np.int64)
                    *counts, bad = memory.counts[numbers].sum(axis=0).tolist()
                    if bad:
                        numbers = numbers[:0]
                    elif len(numbers):
                        doc.update(zip(("n_a", "n_b", "n_groups", "n_links"), counts))
                        shown_text = "".join([memory.text[n] for n in found[i]])[:-1]
                        doc["groups_sha256"] = hashlib.sha256(shown_text.encode()).hexdigest()
                        n_links += counts[3]
                    docs.append(doc)
                    held.append(numbers)
                if n_links >= unit_links or len(docs) >= UNIT_DOCS or len(memory) >= KNOWN:
                    if docs:
                        yield flush()
                    unit, docs, held, n_links = unit + 1, [], [], 0
                    if len(memory) >= KNOWN:
                        memory.clear()
        if docs:
            yield flush()

    return run


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


_PIECE = (
    "unit bigint, part bigint, kind int, at bigint, closed boolean, last bigint, "
    "a_sizes binary, a_ids binary, b_sizes binary, b_ids binary, c_ids binary, d_ids binary"
)
_PIECE_TYPES = [
    ("unit", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()), ("closed", pa.bool_()),
    ("last", pa.int64()),
] + [(n, pa.binary()) for n in ("a_sizes", "a_ids", "b_sizes", "b_ids", "c_ids", "d_ids")]
_FRAGMENT, _GROUPS = 0, 1


def _packed(x) -> bytes:
    return np.asarray(x, "<i8").tobytes()


def _fragment_row(unit: int, part: int, f: Fragment) -> pa.RecordBatch:
    return _row(
        _PIECE_TYPES, unit=unit, part=part, kind=_FRAGMENT, closed=f.closed, last=f.last, a_ids=_packed(f.prefix[0]),
        b_ids=_packed(f.prefix[1]), c_ids=_packed(f.suffix[0]), d_ids=_packed(f.suffix[1]),
    )


def _groups_row(unit: int, g: Groups) -> pa.RecordBatch:
    return _row(
        _PIECE_TYPES, unit=unit, kind=_GROUPS, at=g.at, a_sizes=_packed(g.a_sizes), a_ids=_packed(g.a_ids),
        b_sizes=_packed(g.b_sizes), b_ids=_packed(g.b_ids),
    )


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: ranges in, their fragments and closed groups out."""
    for batch in batches:
        for r in batch.to_pylist():
            whole, inside = fragment(*[_numbers(r[n]) for n in ("a_ids", "a_ends", "b_ids", "b_ends")])
            yield _fragment_row(r["unit"], r["part"], whole)
            if inside is not None:
                yield _groups_row(r["unit"], inside)


def _composed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Task code: at most FAN neighbouring fragments in, the composed one and the groups it closes out."""
    unit, part = (k.as_py() for k in key)
    whole, rows = None, []
    for r in table.sort_by("part").to_pylist():
        a, b, c, d = (_numbers(r[n]).tolist() for n in ("a_ids", "b_ids", "c_ids", "d_ids"))
        f = Fragment(r["closed"], (a, b), (c, d), r["last"])
        if whole is None:
            whole = f
            continue
        whole, closed = compose(whole, f)
        if closed is not None:
            rows.append(_groups_row(unit, closed))
    return pa.Table.from_batches([_fragment_row(unit, part, whole), *rows])


class _LongDocument:
    """Folds the groups of a long document, in order, into a unit of its own."""

    def __init__(self, unit: int, doc_id: int | None, valid: bool):
        self.unit, self.valid = unit, valid
        self.doc = _nothing(doc_id)
        self.digest, self.first = hashlib.sha256(), True
        self.codes, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, g: Groups) -> None:
        codes, times = np.unique(links(g), return_counts=True)
        for name, n in zip(("n_a", "n_b", "n_groups", "n_links"), (len(g.a_ids), len(g.b_ids), len(g.a_sizes), times.sum())):
            self.doc[name] += int(n)
        self.digest.update(("" if self.first else ";").encode() + shown(g).encode())
        self.first = False
        all_codes, place = np.unique(np.concatenate((self.codes, codes)), return_inverse=True)
        sums = np.zeros(len(all_codes), np.int64)
        np.add.at(sums, place, np.concatenate((self.times, times)))
        self.codes, self.times = all_codes, sums

    def end(self) -> pa.RecordBatch:
        if self.valid:
            self.doc["groups_sha256"] = self.digest.hexdigest()
        self.doc["pairs"] = len(self.codes)
        ones = np.ones(len(self.codes), "<u4")
        return _row(
            _UNIT_TYPES, unit=self.unit, docs=[self.doc], pairs=_packed(self.codes), holders=ones.tobytes(),
            spots=np.diff(np.arange(len(self.codes)), prepend=0).astype("<i4").tobytes(),
            times=self.times.astype("<u4").tobytes(),
        )


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: of each long document its mark, its first group and its other groups in order of bytes in, units out."""
    now: _LongDocument | None = None
    for batch in batches:
        for r in batch.to_pylist():
            if now is None or r["unit"] != now.unit:
                if now is not None:
                    yield now.end()
                now = _LongDocument(r["unit"], r["doc_id"], r["valid"])
                continue
            a_ids, b_ids = _numbers(r["a_ids"]), _numbers(r["b_ids"])
            if r["kind"] == _FRAGMENT:  # all that is left of the fragments: the group from the first byte on
                now.add(_group(0, a_ids.tolist(), b_ids.tolist()))
            else:
                now.add(Groups(r["at"], _numbers(r["a_sizes"]), a_ids, _numbers(r["b_sizes"]), b_ids))
    if now is not None:
        yield now.end()


def _long_units(ranges: DataFrame) -> DataFrame:
    """Units of the long documents: fragments of their ranges, composed by a tree, groups in order."""
    marks = ranges.where("part = -1").select("unit", "doc_id", "valid")
    parts = ranges.where("part >= 0").join(marks.where("valid").select("unit"), "unit", "left_semi")
    leaves = freeze(parts.repartition("unit", "part").mapInArrow(_leaves, _PIECE))
    groups = [leaves.where(F.col("kind") == _GROUPS)]
    fragments = leaves.where(F.col("kind") == _FRAGMENT)
    most = fragments.agg(F.max("part")).first()[0] or 0
    while most > 0:
        most //= FAN
        near = F.expr(f"part div {FAN}").alias("up")
        step = freeze(fragments.groupBy("unit", near).applyInArrow(_composed, _PIECE))
        groups.append(step.where(F.col("kind") == _GROUPS))
        fragments = step.where(F.col("kind") == _FRAGMENT)
    pieces = fragments.withColumn("at", F.lit(0).cast("bigint"))
    for more in groups:
        pieces = pieces.unionByName(more)
    none = {c: F.lit(None) for c in ("doc_id", "valid")}
    marked = marks.withColumn("at", F.lit(-1).cast("bigint")).unionByName(pieces.withColumns(none), allowMissingColumns=True)
    ordered = marked.repartition("unit").sortWithinPartitions("unit", "at")
    return ordered.select("unit", "kind", "at", "doc_id", "valid", "a_sizes", "a_ids", "b_sizes", "b_ids").mapInArrow(
        _folded, _UNIT
    )


def _held_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: units in, (pair, unit, holders) out."""
    for batch in batches:
        for r in batch.to_pylist():
            codes, n = _numbers(r["pairs"]), np.frombuffer(r["holders"], "<u4")
            for i in range(0, len(codes), 1 << 16):
                part = codes[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.full(len(part), r["unit"])), pa.array(n[i : i + len(part)].astype(np.int64))],
                    ["pair", "unit", "n"],
                )


_RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string"
)
_RESULT_NAMES = [c.split(" ")[0] for c in _RESULT.split(", ")]


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: of each unit the counts of its pairs in order, then the unit in, its documents out."""
    counts, best = [], []
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        cuts = np.concatenate((np.flatnonzero(kinds == 1), [len(kinds)]))
        at = 0
        for cut in cuts.tolist():
            if cut > at:
                counts.append(batch.column(3).slice(at, cut - at).to_numpy(zero_copy_only=False).astype(np.int64))
                best.append(batch.column(4).slice(at, cut - at).to_numpy(zero_copy_only=False).astype(np.int64))
            if cut == len(kinds):
                break
            n = np.concatenate([np.zeros(0, np.int64), *counts])
            top = np.concatenate([np.zeros(0, np.int64), *best])
            counts, best, at = [], [], cut + 1
            docs = batch.column(5)[cut].as_py()
            spots = np.cumsum(np.frombuffer(batch.column(6)[cut].as_py(), "<i4"))
            times = np.frombuffer(batch.column(7)[cut].as_py(), "<u4").astype(np.int64)
            owner = np.repeat(np.arange(len(docs)), [d["pairs"] for d in docs])
            sums = np.zeros((2, len(docs)), np.int64)
            np.add.at(sums[0], owner, times * top[spots])
            np.add.at(sums[1], owner, times * n[spots])
            for i, doc in enumerate(docs):
                doc["n_best"], doc["count_sum"] = int(sums[0, i]), int(sums[1, i])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d[c] for d in docs], pa.string() if c == "groups_sha256" else pa.int64())
                    for c in _RESULT_NAMES
                ],
                _RESULT_NAMES,
            )


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    range_bytes: int = RANGE_BYTES,
    unit_links: int = UNIT_LINKS,
) -> DataFrame:
    """One row per document: sizes of the alignment and how common its links are.

    A blank and the text are encoded by the byte-level BPE of ``a_path``, the text by the
    sentencepiece model of ``b_path``, special tokens' strings as plain text. Bytes at which
    tokens of both end cut them into groups; two tokens in a group are linked. A pair of ids
    counts the documents that hold it linked. ``n_best`` are the links whose pair counts most
    among those of its first id, ``count_sum`` the counts of all links, ``groups_sha256`` the
    digest of the groups' ids. A null or empty text, or one whose joined tokens are other bytes, has
    zeros and ''. Every row is a document, also one that repeats a doc_id; null ids stay null.
    Other columns are not looked at; an empty table gives an empty result.

    Documents leave their task as units of ``unit_links`` links: the distinct pairs of a unit
    with their number of documents are all that is shuffled, once to be counted and once back.
    Longer texts than ``range_bytes`` are aligned in ranges by other tasks. Broadcast is one
    number per id of the first vocabulary.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"{_UNIT}, {_RANGE}"
    made = freeze(rows.mapInArrow(_align(a_path, b_path, range_bytes, unit_links), schema))
    units = made.where("part IS NULL").select("unit", "docs", "pairs", "holders", "spots", "times")
    ranges = made.where("part IS NOT NULL").select("unit", *[n for n, _ in _RANGE_TYPES])
    if not ranges.isEmpty():
        units = units.unionByName(freeze(_long_units(ranges)))
    held = units.select("unit", "pairs", "holders").mapInArrow(_held_pairs, "pair bigint, unit bigint, n bigint")
    counted = freeze(held.withColumn("n", F.expr("sum(n) OVER (PARTITION BY pair)")))
    first = F.shiftright("pair", PAIR_BITS)
    most = counted.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    none = {c: F.lit(None) for c in ("docs", "spots", "times")}
    answers = counted.withColumn("first", first).join(F.broadcast(most), "first").select(
        "unit", F.lit(0).alias("kind"), "pair", "n", (F.col("n") == F.col("most")).alias("best")
    )
    asked = units.select("unit", F.lit(1).alias("kind"), "docs", "spots", "times")
    both = answers.withColumns(none).unionByName(asked, allowMissingColumns=True)
    ordered = both.repartition("unit").sortWithinPartitions("unit", "kind", "pair")
    return ordered.select("unit", "kind", "pair", "n", "best", "docs", "spots", "times").mapInArrow(_scored, _RESULT)
