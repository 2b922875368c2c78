"""Cheap checks before costly scoring: which cases go on to the judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from .guardrails import CheckSettings, with_hard_fail


def without_errors(df: DataFrame, text: str) -> DataFrame:
    """Cases whose text is no recorded generation error; a missing text is none.

    For a plain column of a parquet table both tests are pushed to the scan.
    """
    return df.where(F.col(text).isNull() | ~F.col(text).startswith(fixed.ERROR_PREFIX))


def first_cases(df: DataFrame, order: str, k: int = 5) -> DataFrame:
    """The first ``k`` rows by a key; each task keeps ``k`` rows, never the whole table."""
    return df.orderBy(order).limit(k)


def hard_fails(checked: DataFrame, order: str | None = None) -> DataFrame:
    """case_id and reason of the cases that must not be scored, personal data first.

    Where a case was checked more than once the last check by ``order`` decides. Without an
    order there is no last one, and a hard failure in any of them counts. Either way each
    case is reduced to one row before it is joined, by a hash aggregate over a number.
    """
    rows = checked.select("case_id", _code(F.col("checks"), F.col("output_mode")).alias("code"), *([order] if order else []))
    if order is None:  # only failing checks reach the aggregate
        rows = rows.where("code > 0")
    last = F.max_by("code", order) if order else F.max("code")
    return rows.groupBy("case_id").agg(last.alias("code")).where("code > 0").select("case_id", _reason("code"))


def _code(checks: Column, output_mode: Column) -> Column:
    invalid = ~checks["json_valid"] & (output_mode == "json")
    return F.when(F.size(checks["pii_hits"]) > 0, 2).when(invalid, 1).otherwise(0)


def _reason(code: str | Column) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.when(code == 2, "PII").when(code == 1, "JSON-invalid").alias("reason")


def gate_rows(cases: DataFrame, text: str, settings: CheckSettings = CheckSettings()) -> DataFrame:
    """The cases without an error text, with ``reason``: why each is held back, NULL for those that go on.

    The check is made beside the row it belongs to, so neither texts nor ids move: one scan, no join, no exchange.
    """
    usable = without_errors(cases, text)
    return with_hard_fail(usable, text, settings, "__code").select(*usable.columns, _reason("__code"))


def decided(checked: DataFrame) -> DataFrame:
    """Stored checks with ``reason``: why the row is held back, NULL where it goes on. For checks that were stored together
    with what is to be passed on, so that nothing is joined."""
    return checked.select("*", _reason(_code(F.col("checks"), F.col("output_mode"))))


def gate(cases: DataFrame, checked: DataFrame, text: str, order: str | None = None) -> DataFrame:
    """Cases that go on: no error text and no hard failure. Unchecked cases pass.

    For checks that are stored; :func:`gate_rows` checks and decides in one pass. An anti join on case_id against the
    failing ids only. No side is forced to broadcast:
    adaptive execution does that when the ids measured at run time are few.
    """
    return without_errors(cases, text).join(hard_fails(checked, order), "case_id", "left_anti")


def skipped(cases: DataFrame, checked: DataFrame, text: str, order: str | None = None) -> DataFrame:
    """The cases held back, with the reason."""
    return without_errors(cases, text).join(hard_fails(checked, order), "case_id", "inner")
