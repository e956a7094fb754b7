"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

A boundary between tokens can only be undone by later text through a chain of
merges of rising rank, each of which takes the divergence left by its left part.
The longest such chain, computed from the merge list, is a sufficient lookahead:
tokens that end that many bytes before the end of what has been read are final.
Pre-token edges are settled in the same way by holding back the last ones.
Texts are read in pieces, so that working memory does not grow with a text.
"""

from __future__ import annotations

import codecs
import json
import re as stdlib_re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pattern that cuts text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters read at a time, pre-tokens (characters) that are encoded as a whole, and
# entries of each of the two generations of known pre-tokens.
PIECE = 1 << 16
SHORT = 64
KNOWN = 1 << 17
# Rows handed on at a time.
ROWS = 256


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes of lookahead after which no later text changes a token.

    A merge (u, v) moves the divergence left by len(u); a later merge can follow
    it only if its right part starts with u. The longest chain of rising rank is
    found by one pass in rank order.
    """
    best: dict[bytes, int] = {}
    longest = 0
    for u, v in merges:
        reach = len(u) + max((best.get(v[:i], 0) for i in range(1, len(v) + 1)), default=0)
        if reach > best.get(u, 0):
            best[u] = reach
        longest = max(longest, reach)
    return longest


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the
    others numbered from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Encoder and decoder of one tokenizer file (JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merges = [(raw(u), raw(v)) for u, v in pairs]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.lookahead = sufficient_lookahead(merges)
        self.single = [bytes([b]) for b in range(256)]
        self.cut = regex.compile(PRE_TOKEN)
        names = sorted(self.special, key=len, reverse=True)
        self.special_cut = stdlib_re.compile("|".join(map(stdlib_re.escape, names))) if names else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Tokens of a byte string, lowest rank first, leftmost first."""
        single, rank = self.single, self.rank.get
        last = len(self.rank)
        parts = [single[b] for b in data]
        ranks = [rank(pair, last) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == last:
                break
            i = ranks.index(best)
            token = parts[i] + parts[i + 1]
            parts[i : i + 2] = [token]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], token), last)
            if i < len(ranks):
                ranks[i] = rank((token, parts[i + 1]), last)
        return parts

    def stable_tokens(self, chunks: Iterator[bytes]) -> Iterator[list[bytes]]:
        """Tokens of a long pre-token that arrives in chunks; each leaves once it is final."""
        held = b""
        for chunk in chunks:
            held += chunk
            if len(held) < 2 * self.lookahead:
                continue
            out, end = [], 0
            for token in self.merge(held):
                if end + len(token) > len(held) - self.lookahead:
                    break
                out.append(token)
                end += len(token)
            held = held[end:]
            yield out
        yield self.merge(held)

    def _long(self, word: str) -> bytes:
        data = word.encode()
        step = 2 * self.lookahead
        chunks = (data[i : i + step] for i in range(0, len(data), step))
        return self._packed(t for tokens in self.stable_tokens(chunks) for t in tokens)

    def _packed(self, tokens) -> bytes:
        ids = self.ids
        return array("I", [ids[t] for t in tokens]).tobytes()

    def _pre_tokens(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens in pieces. An edge is settled once a whole pre-token follows it."""
        at, size, step = 0, len(text), PIECE
        while at < size:
            end = min(size, at + step)
            words = self.cut.findall(text, at, end)
            if end < size:
                # The last two may still change: blanks depend on what follows them.
                words = words[:-2]
                if not words:
                    step *= 2  # one pre-token fills the piece: read on
                    continue
            yield words
            at += sum(map(len, words))
            step = PIECE

    def _coded(self, word: str) -> bytes:
        if len(word) > SHORT:
            return self._long(word)
        code = self.older.get(word)
        if code is None:
            code = self._packed(self.merge(word.encode()))
        if len(self.known) >= KNOWN:
            self.older, self.known = self.known, {}
        self.known[word] = code
        return code

    def _ordinary(self, text: str) -> Iterator[bytes]:
        for words in self._pre_tokens(text):
            codes = list(map(self.known.get, words))
            if None in codes:
                coded = self._coded
                codes = [coded(w) if c is None else c for w, c in zip(words, codes)]
            yield b"".join(codes)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        out = bytearray()
        at = 0
        if self.special_cut is not None:
            for found in self.special_cut.finditer(text):
                out += b"".join(self._ordinary(text[at : found.start()]))
                out += array("I", [self.special[found.group()]]).tobytes()
                at = found.end()
        out += b"".join(self._ordinary(text[at:] if at else text))
        return bytes(out)

    def decode(self, ids: bytes) -> str:
        """Text of packed ids: bytes enter a UTF-8 state machine piece by piece, which hands on a
        character once it is whole and U+FFFD for what cannot become one."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        table, out = self.bytes_of, []
        numbers = array("I")
        numbers.frombytes(ids)
        for i in range(0, len(numbers), PIECE):
            out.append(machine.decode(b"".join([table[x] for x in numbers[i : i + PIECE]])))
        out.append(machine.decode(b"", final=True))
        return "".join(out)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per worker and file."""
    return Transducer(path)


def _mapped(df: DataFrame, path: str, source: Column, target: str, kind: pa.DataType, name: str) -> DataFrame:
    """Adds ``target``, made from ``source`` by the method ``name`` of the transducer.

    The row goes along as a struct beside the two, so that its columns may have any names. A column
    that has the name of the new one, in any case, gives way to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = getattr(transducer(path), name)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                made = pa.array([make(x.as_py()) for x in part.column(1)], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), made], ["row", "made"])

    kept = [c for c in df.columns if c.lower() != target.lower()]
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("_")]).alias("row"), source.alias("source"))
    made = T.BinaryType() if kind == pa.binary() else T.StringType()
    schema = T.StructType([own.schema["row"], T.StructField("made", made)])
    fields = [F.col("row").getField(c).alias(c) for c in kept]
    return own.mapInArrow(run, schema).select(*fields, F.col("made").alias(target))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col``: the token ids of the whole text as packed little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Strings of special tokens in a
    text become those tokens. ``path`` names the tokenizer file on every worker.
    Rows are independent: repeated rows and other columns pass unchanged, but a column that is
    called ``ids_col`` already is replaced.
    """
    return _mapped(docs, path, F.coalesce(F.col(text_col), F.lit("")), ids_col, pa.binary(), "encode")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col``: the text of packed ids; null ids count as none. Replaces a column of that name."""
    return _mapped(encoded, path, F.coalesce(F.col(ids_col), F.lit(b"")), text_col, pa.string(), "decode")
