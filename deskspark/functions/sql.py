"""SQL text for long expressions.

A rule table can need a hundred searches per row; as one SQL string it reaches
Spark in one call instead of one per node.
"""

from __future__ import annotations

from collections.abc import Iterable


def literal(text: str) -> str:
    """A SQL string literal, safe for quotes and backslashes."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def literals(texts: Iterable[str]) -> str:
    return ", ".join(literal(t) for t in texts)


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def lookup(table: dict[str, str], key: str) -> str:
    """Value of ``key`` (SQL text) in a literal map, NULL when absent."""
    entries = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items())
    return f"try_element_at(map({entries}), {key})"
