"""Numbers written as text, and comparisons that treat NaN as no answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqltext import quoted

# digits with single underscores between them, an optional fraction and exponent
_DIGITS = r"[0-9](?:_?[0-9])*"
_FLOAT = (
    rf"(?iU)\A[\s\x1c-\x1f]*[+-]?(?:inf|infinity|nan"
    rf"|(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?)[\s\x1c-\x1f]*\z"
)


def float_sql(text: str) -> str:
    """SQL for the text as a double where it is written as one, else NULL.

    Narrower than a cast, which also takes hexadecimal numbers and type suffixes, and wider
    in allowing underscores between digits.
    """
    noise = quoted(r"(?iU)[_\s\x1c-\x1f]|[+-](?=nan)")
    return f"CASE WHEN {text} RLIKE {quoted(_FLOAT)} THEN try_cast(regexp_replace({text}, {noise}, '') AS DOUBLE) END"


def float_of(column: str) -> Column:
    """:func:`float_sql` for a column or field by name."""
    return F.expr(float_sql(column))


def at_least(value: Column, limit) -> Column:
    """``value >= limit``, false for NULL and for NaN (which sorts above every number)."""
    return F.coalesce(~F.isnan(value) & (value >= limit), F.lit(False))
