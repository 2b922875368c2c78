"""Expressions as SQL text.

The checks consist of many hundred small expressions. Written as text they are parsed in one
step each, while building them call by call would take longer than running a small query.
"""

from __future__ import annotations


def quoted(value: str) -> str:
    """A string literal."""
    value = value.replace("\\", "\\\\").replace("'", "\\'").replace("\0", "\\0")
    return f"'{value}'"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def any_of(conditions: list[str]) -> str:
    return "(" + " OR ".join(conditions) + ")" if conditions else "false"


def total(numbers: list[str]) -> str:
    return "(" + " + ".join(["0", *numbers]) + ")"


NO_STRINGS = "CAST(array() AS array<string>)"
