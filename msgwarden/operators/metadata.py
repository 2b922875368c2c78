"""Masking of whole records and short previews, for anything that is logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fixed
from ..functions.pii import mask_value
from ..functions.sqltext import name


def _masked(value: str, kind: T.DataType, in_lists: bool, depth: int = 0) -> str | None:
    """SQL for the masked value, or None when its type holds no text to mask."""
    if isinstance(kind, T.StringType):
        return mask_value(value)
    x = f"x{depth}"
    if isinstance(kind, T.StructType):
        parts = {
            f.name: _masked(f"{value}.{name(f.name)}", f.dataType, in_lists, depth + 1)
            for f in kind.fields
        }
        if not any(parts.values()):
            return None
        fields = ", ".join(f"{p or f'{value}.{name(n)}'} AS {name(n)}" for n, p in parts.items())
        return f"CASE WHEN {value} IS NOT NULL THEN struct({fields}) END"
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType) and not in_lists:
            return None
        inner = _masked(x, kind.elementType, in_lists, depth + 1)
        return inner and f"transform({value}, {x} -> {inner})"
    if isinstance(kind, T.MapType):
        inner = _masked(x, kind.valueType, in_lists, depth + 1)
        return inner and f"transform_values({value}, (k{depth}, {x}) -> {inner})"
    return None


def mask_record(df: DataFrame, columns: list[str] | None = None, in_lists: bool = True) -> DataFrame:
    """The frame with every text inside the given columns masked, at any depth.

    The schema is walked while the query is built; the result is one projection.
    ``in_lists=False`` leaves plain texts that stand directly in a list as they are.
    """
    out = {}
    for f in df.schema.fields:
        if columns is None or f.name in columns:
            masked = _masked(name(f.name), f.dataType, in_lists)
            if masked:
                out[f.name] = F.expr(masked)
    return df.withColumns(out) if out else df


def cut(text: Column, length: int = fixed.PREVIEW_LENGTH) -> Column:
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def with_preview(df: DataFrame, text: str, out: str = "preview", mask_first: bool = True) -> DataFrame:
    """A masked preview of a text.

    Masking comes before cutting, so that a number cut in half is not shown. With
    ``mask_first=False`` the order is reversed; such a number then escapes the patterns.
    """
    from .guardrails import mask_frame

    if mask_first:
        return mask_frame(df, text, "__masked").withColumn(out, cut(F.col("__masked"))).drop("__masked")
    return mask_frame(df.withColumn("__cut", cut(F.col(text))), "__cut", out).drop("__cut")
