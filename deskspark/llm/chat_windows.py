"""Chat formatting into budgeted windows, on DataFrame functions only.

Prefix sums of turn tokens place turns on a grid of cells of the token budget;
turns inside a cell share a window, and a turn across a cell border opens the
next cell's window if it fits there or has a window of its own. Each later
window repeats the conversation's leading system turn and a limited history;
only assistant texts that are new in a window are under its loss mask.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.functions.sql import literal
from deskspark.llm.spread import before_each
from deskspark.sources.scratch import freeze

# The template: a turn is OPEN, its role, a line break, its text, CLOSE. Both marks
# hold a character that escaped text cannot hold.
OPEN = "### "
CLOSE = "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
# A token is a run of letters, digits and underscores or any other visible character.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]"
SLICE_TURNS = 1024
SLICE_WINDOWS = 4096


@dataclass(frozen=True)
class WindowBudget:
    """Tokens of new turns and of repeated history in a window, and the most turns repeated.

    A window holds at most ``fresh + history`` tokens beside the system turn,
    unless a single turn is longer: turns are never cut.
    """

    fresh: int = 768
    history: int = 256
    history_turns: int = 2


def _replaced(sql: str, pairs) -> str:
    for old, new in pairs:
        sql = f"replace({sql}, {literal(old)}, {literal(new)})"
    return sql


def escaped(sql: str) -> str:
    """SQL text of a string without ``#`` and ``<``; the backslash goes first."""
    return _replaced(sql, ESCAPES)


def unescaped(sql: str) -> str:
    """SQL text that undoes :func:`escaped`; the backslash goes last."""
    return _replaced(sql, [(new, old) for old, new in reversed(ESCAPES)])


def format_windows(
    turns: DataFrame,
    budget: WindowBudget = WindowBudget(),
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, window, text, loss_spans, n_context, n_tokens`` per window.

    ``window`` is the place of its first new turn in the conversation;
    ``loss_spans`` are (start, length) in code points of ``text``; ``n_context``
    counts the leading turns that repeat earlier ones. Null texts and roles
    count as empty; null ids form a conversation; rows of one turn number are
    ordered by role, then text, and repeated rows are repeated turns. An empty
    table gives an empty result; other columns are not looked at. A conversation
    of any length is cut into slices of turns and of windows.
    """
    line = "replace({}, '\\n', '\\\\n')".format(escaped("role"))
    rows = (
        turns.select(
            F.col(id_col).alias("conv_id"),
            F.coalesce(F.col(turn_col).cast("bigint"), F.lit(-1)).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        )
        .withColumn("body", F.expr(escaped("text")))
        .withColumn("shown", F.concat(F.lit(OPEN), F.expr(line), F.lit("\n"), F.col("body"), F.lit(CLOSE)))
        .withColumn("tokens", F.expr(f"cast(regexp_count(shown, {literal(TOKEN)}) AS bigint)"))
    )
    order = [F.col("turn"), F.col("role"), F.col("text")]
    slice_no = F.expr(f"turn div {SLICE_TURNS}")
    placed = before_each(
        rows, ["conv_id"], slice_no, order, {"place": F.lit(1), "before": F.col("tokens")}, {"place": "n_turns"}
    )
    leads = (F.col("place") == 0) & (F.col("role") == "system")
    at = F.col("before")
    end = at + F.col("tokens") - 1
    cells = freeze(
        placed.withColumns(
            {
                "lead": leads,
                "cell": F.floor(end / budget.fresh).cast("bigint"),
                "across": F.floor(at / budget.fresh) != F.floor(end / budget.fresh),
            }
        ).drop("text")
    )
    # A turn across the border into a cell: at most one per cell.
    inner = (
        cells.where(~F.col("lead") & ~F.col("across"))
        .groupBy("conv_id", "cell")
        .agg(F.sum("tokens").alias("filled"))
    )
    body = _join(cells.where(~F.col("lead")), inner, ["conv_id", "cell"])
    joins = ~F.col("across") | (F.coalesce("filled", F.lit(0)) + F.col("tokens") <= budget.fresh)
    body = body.withColumn("part", 2 * F.col("cell") + F.when(joins, 1).otherwise(0)).drop("filled")
    starts = body.groupBy("conv_id", "part").agg(
        F.min("place").alias("window"), F.min("before").alias("from"), F.max("n_turns").alias("n_turns")
    )
    fresh = _join(body, starts.select("conv_id", "part", "window"), ["conv_id", "part"])
    lead = cells.where("lead")
    # The system turn is new in the first window and repeated in the others.
    first = lead.withColumn("window", F.when(F.col("n_turns") > 1, 1).otherwise(0).cast("bigint"))
    slices = F.sequence(F.lit(0), F.floor(F.col("n_turns") / SLICE_WINDOWS).cast("int"))
    again = _join(
        starts.where("window > 1").select(
            "conv_id", "window", F.floor(F.col("window") / SLICE_WINDOWS).cast("int").alias("slice")
        ),
        lead.withColumn("slice", F.explode(slices)),
        ["conv_id", "slice"],
        "inner",
    )
    ahead = F.explode(F.sequence(F.lit(1), F.lit(budget.history_turns)))
    history = _join(
        cells.where(~F.col("lead")).withColumn("ahead", ahead).withColumn("window", F.col("place") + F.col("ahead")),
        starts.select("conv_id", "window", "from"),
        ["conv_id", "window"],
        "inner",
    ).where(F.col("from") - F.col("before") <= budget.history)
    item = F.struct("place", "fresh", "role", "shown", "body", "tokens")
    parts = None
    for rows_of, new in ((fresh, True), (first, True), (again, False), (history, False)):
        part = rows_of.withColumn("fresh", F.lit(new)).select("conv_id", "window", item.alias("item"))
        parts = part if parts is None else parts.unionByName(part)
    windows = parts.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("item")).alias("items"))
    # Where the text of each turn starts: after the turns before it and its own head.
    spans = (
        "aggregate(items, struct(0L AS at, cast(array() AS array<struct<start: bigint, length: bigint>>) AS spans), "
        "(a, t) -> struct(a.at + length(t.shown) AS at, CASE WHEN t.fresh AND t.role = 'assistant' THEN "
        f"concat(a.spans, array(struct(a.at + length(t.shown) - length(t.body) - {len(CLOSE)} AS start, "
        "cast(length(t.body) AS bigint) AS length))) ELSE a.spans END AS spans), a -> a.spans)"
    )
    return windows.select(
        "conv_id",
        "window",
        F.expr("array_join(transform(items, t -> t.shown), '')").alias("text"),
        F.expr(spans).alias("loss_spans"),
        F.expr("size(filter(items, t -> NOT t.fresh))").alias("n_context"),
        F.expr("aggregate(items, 0L, (a, t) -> a + t.tokens)").alias("n_tokens"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """``conv_id, window, turns, loss`` from formatted text alone: the new turns (role, text) and the
    texts under the loss mask, unescaped, in order."""
    head = literal("\n")
    role = unescaped(f"replace(substring(substring_index(c, {head}, 1), {len(OPEN) + 1}), '\\\\n', {head})")
    text = unescaped(f"substring(c, length(substring_index(c, {head}, 1)) + 2)")
    # Every turn ends with CLOSE, so the last piece of the split is empty. A system turn that is repeated
    # stands first, then the history, so that the new ones are the last.
    chunks = f"split(text, {literal(CLOSE)}, -1)"
    fresh = f"slice({chunks}, n_context + 1, greatest(size({chunks}) - 1 - n_context, 0))"
    span = "substring(text, cast(s.start AS int) + 1, cast(s.length AS int))"
    return windows.select(
        "conv_id",
        "window",
        F.expr(f"transform({fresh}, c -> struct({role} AS role, {text} AS text))").alias("turns"),
        F.expr(f"transform(loss_spans, s -> {unescaped(span)})").alias("loss"),
    )


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from the windows: counts and SHA-256 of its turns and loss texts."""
    size = windows.groupBy("conv_id").agg(F.sum(F.length("text").cast("bigint")).alias("formatted_chars"))
    blob = "array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"
    read = read_windows(windows).select(
        "conv_id",
        F.struct("window", F.expr(blob).alias("turns"), F.array_join("loss", "").alias("loss")).alias("item"),
        F.size("turns").alias("n"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"), F.sort_array(F.collect_list("item")).alias("items")
    )
    loss = F.expr("array_join(transform(items, i -> i.loss), '')")
    digests = whole.select(
        "conv_id",
        "n_turns",
        F.expr("sha2(array_join(transform(items, i -> i.turns), ''), 256)").alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
    )
    return _join(digests, size, ["conv_id"], "inner")


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on null-safe keys, keeping the left ones."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on: list[Column] = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])
