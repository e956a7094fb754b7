"""Repair of conversation structure by iterative-deepening A*.

Rows of a conversation are kept, given another role or deleted, and empty turns are
inserted, until the roles read system?, then user and assistant in turn. The cheapest
edits are found by depth-first search in the ASCII order of the edits' initials under a
rising bound on the cost; a table of failed states keeps the search from trying one
twice, so that the first accepted path is the cheapest and, among equals, the least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blanks, sentence ends, what each edit costs.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}
# What the roles read so far end with: nothing, system, user, assistant; the roles that may follow.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
ACCEPTED = (NOTHING, ASSISTANT)
BLANK, DUPLICATE, CUT, SOUND = "bdts"


class Conversation:
    """Initials and faults of a conversation's rows, one character each."""

    def __init__(self, initials: str, faults: str):
        self.initials, self.faults = initials, faults
        n = self.n = len(faults)
        # By suffix: fixed costs, the next row that can stay, and the run of wrong neighbours from there.
        self.fixed, self.next = [0] * (n + 1), [n] * (n + 1)
        self.run, self.rest = [0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            gone = faults[i] in (BLANK, DUPLICATE)
            self.fixed[i] = self.fixed[i + 1] + (DELETE if gone else TRUNCATED if faults[i] == CUT else 0)
            if gone:
                self.next[i], self.run[i], self.rest[i] = self.next[i + 1], self.run[i + 1], self.rest[i + 1]
                continue
            self.next[i], j = i, self.next[i + 1]
            if self._wrong(initials[i], j):
                self.run[i], self.rest[i] = self.run[i + 1] + 1, self.rest[i + 1]
            else:
                self.rest[i] = self.rest[i + 1] + 2 * -(-self.run[i + 1] // 2)

    def _wrong(self, before: str, j: int) -> bool:
        """Whether row j, or the end, cannot follow a role."""
        if j == self.n:
            return before != "a"
        return before + self.initials[j] not in ("su", "ua", "au")

    def least(self, i: int, state: int) -> int:
        """No more than the cost from row i on.

        Neighbours that cannot stand side by side need an edit that touches them; no edit
        touches more than two such pairs, which then lie in one run, and none costs less than 2.
        """
        j = self.next[i]
        if j == self.n:
            wrong = state not in ACCEPTED
        else:
            wrong = self.initials[j] not in NEXT[state]
        return self.fixed[i] + self.rest[i] + 2 * -(-(self.run[i] + wrong) // 2)

    def steps(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(initial, next row, next state, cost) of the edits at row i, in ASCII order."""
        if i < self.n:
            yield "D", i + 1, state, DELETE
        for to in NEXT[state].items():
            if to[0] in ROLES:
                yield "I", i, to[1], INSERT
        if i < self.n and self.faults[i] not in (BLANK, DUPLICATE):
            extra = TRUNCATED if self.faults[i] == CUT else 0
            own = NEXT[state].get(self.initials[i])
            if own is not None:
                yield "K", i + 1, own, extra
            for to in NEXT[state].items():
                if to[0] in ROLES:
                    yield "R", i + 1, to[1], REROLE + extra

    def _within(self, bound: int, failed: dict[tuple[int, int], int]) -> str | None:
        """The first accepted path of at most that cost. ``failed`` holds what was not enough from a state."""
        path: list[str] = []
        stack = [(0, NOTHING, bound, self.steps(0, NOTHING))]
        if not self.n:
            return ""
        while stack:
            i, state, left, steps = stack[-1]
            for edit, to, after, cost in steps:
                rest = left - cost
                if rest < self.least(to, after) or failed.get((to, after), -1) >= rest:
                    continue
                path.append(edit)
                if to == self.n and after in ACCEPTED:
                    return "".join(path)
                stack.append((to, after, rest, self.steps(to, after)))
                break
            else:
                failed[i, state] = max(left, failed.get((i, state), -1))
                stack.pop()
                if path:
                    path.pop()
        return None

    def cheapest(self) -> tuple[int, str]:
        """(cost, edits' initials)."""
        failed: dict[tuple[int, int], int] = {}
        bound = self.least(0, NOTHING)
        while (found := self._within(bound, failed)) is None:
            bound += 1
        return bound, found


class Repaired:
    """Applies edits to rows that come one after the other; digests what remains."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING
        self.digest, self.first = hashlib.sha256(), True

    def _out(self, role: str, text: str) -> None:
        self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def _follow(self) -> str:
        name = next(x for x in NEXT[self.state] if x in ROLES)
        self.state = NEXT[self.state][name]
        return ROLES[name]

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._out(self._follow(), "")

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state][role[:1]]
            self._out(role, text)
        elif edit == "R":
            self._out(self._follow(), text)

    def end(self) -> str:
        self.inserted()
        return self.digest.hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` after the damage that crc32(``conv_id:turn``) % 20 names.

    0 drops a row (``gone`` marks that it was there), 1 empties the text, 2 removes its sentence
    ends, 3 repeats the row, 4 makes it the user's. A null is one space, but turns stay null.
    """

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    role, text = F.when(kind == 4, "user").otherwise(shown("role")), shown("text")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text)
    row = F.struct(role.alias("role"), text.alias("text"), (kind == 0).alias("gone"))
    rows = F.when(kind == 3, F.array(row, row)).otherwise(F.array(row))
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.inline(rows))


def _checked(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` to the rows of :func:`damaged`, all rows of a conversation in one partition.

    Repeats are told by window functions over the same partitioning, so nothing is dealt out again.
    """
    ink = F.rtrim("text", F.lit(BLANKS))
    again = F.expr("row_number() OVER (PARTITION BY conv_id, gone, role, text ORDER BY turn ASC NULLS FIRST) > 1")
    fault = (
        F.when(ink == "", BLANK)
        .when(again, DUPLICATE)
        .when(~F.substring(ink, -1, 1).isin(*ENDS), CUT)
        .otherwise(SOUND)
    )
    return rows.repartition("conv_id").withColumn("fault", fault)


# What the search needs of a row comes first, its text after the last of these.
_HEAD, _BODY = 0, 1
_SCHEMA = (
    "conv_id bigint, n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)
_NAMES = [c.split(" ")[0] for c in _SCHEMA.split(", ")]


class _Stream:
    """One conversation at a time: heads of its rows, then their texts."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.initials, self.faults = [], []
        self.turns: list[int | None] = [None, None]
        self.n_turns = 0
        self.out: Repaired | None = None

    def head(self, role: str, fault: str, turn: int | None) -> None:
        # An initial of another role stands for none that may follow.
        self.initials.append(role[:1] if role[:1] in ("s", "u", "a") else "-")
        self.faults.append(fault)
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn]
            self.n_turns += 1

    def search(self) -> None:
        initials, faults = "".join(self.initials), "".join(self.faults)
        cost, audit = Conversation(initials, faults).cheapest()
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        low, high = self.turns
        gaps = 0 if low is None else high - low + 1 - self.n_turns
        counts = [faults.count(f) for f in (BLANK, DUPLICATE, CUT)]
        self.row = [self.conv_id, len(faults), gaps, *counts, pairs, cost, audit]
        self.out = Repaired(audit)
        self.initials, self.faults = [], []

    def text(self, role: str, text: str) -> None:
        if self.out is None:
            self.search()
        self.out.row(role, text)

    def end(self) -> list:
        if self.out is None:
            self.search()
        return [*self.row, self.out.end()]


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: sorted heads and texts in, a row per conversation out."""

    def packed(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 8 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)

    now: _Stream | None = None
    for batch in batches:
        done = []
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for conv_id, part, turn, role, text, fault in zip(*columns):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.end())
                now = _Stream(conv_id)
            if part == _BODY:
                now.text(role, text)
            elif fault is not None:
                now.head(role, fault, turn)
        if done:
            yield packed(done)
    if now is not None:
        yield packed([now.end()])


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text, gone``, in the order of turn (nulls first),
    role and text.

    ``n_rows, gaps, blank, duplicate, truncated, illegal`` describe what came in, ``cost`` and ``audit`` the
    cheapest edits, ``repaired_sha256`` the lines ``role:text`` that remain. A row's first fault
    counts: blank, else a repeat of an earlier role and text, else an end without a full stop.
    A conversation whose rows are all ``gone`` has zeros and an empty audit. A null conv_id is a
    conversation. Other columns are not looked at; an empty table gives an empty result.

    Rows of a conversation are read in order by one task, as its digest needs; the task holds two
    characters per row and no texts, however long the conversation.
    """
    checked = _checked(rows)
    head = F.struct(
        F.lit(_HEAD).alias("part"), F.lit(None).cast("string").alias("body"),
        F.when(~F.col("gone"), F.col("fault")).alias("fault"),
    )
    body = F.struct(F.lit(_BODY).alias("part"), F.col("text").alias("body"), F.lit(None).cast("string").alias("fault"))
    both = F.when(F.col("gone"), F.array(head)).otherwise(F.array(head, body))
    spread = checked.select("conv_id", "turn", "role", "text", F.explode(both).alias("e"))
    ordered = spread.sortWithinPartitions(
        F.asc_nulls_first("conv_id"), "e.part", F.asc_nulls_first("turn"), "role", "text"
    )
    return ordered.select("conv_id", "e.part", "turn", "role", "e.body", "e.fault").mapInArrow(_repair, _SCHEMA)


def repair_damaged(turns: DataFrame) -> DataFrame:
    """:func:`repair_report` of the rows of ``conv_id, turn, role, text`` after :func:`damaged`."""
    return repair_report(damaged(turns))


def repaired_turns(rows: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(role, text) after the cheapest repair of the (role, text, fault) rows of one conversation."""
    initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "-" for r, _, _ in rows)
    _, audit = Conversation(initials, "".join(f for _, _, f in rows)).cheapest()
    out: list[tuple[str, str]] = []

    class Listed(Repaired):
        def _out(self, role: str, text: str) -> None:
            out.append((role, text))

    edits = Listed(audit)
    for role, text, _ in rows:
        edits.row(role, text)
    edits.end()
    return out
