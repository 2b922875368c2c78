"""Forbidden wording, calls to action and length as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .regex import SPACE_MEMBERS
from .rules import CTA_RULES, NOGO_RULES, Rule, Scan
from .sqltext import any_of, quoted, total

NOGO_TYPE = "array<struct<key:string,match:string>>"


def nogo_hits(found: dict[str, str]) -> str:
    """``[{key, match}]`` by rule order and then text order.

    ``found`` names the columns of matches per rule (``Scan.matches``). The match is the
    rule's group where it has one ('' when that group took no part).
    """
    per_rule = ", ".join(
        f"transform({column}, m -> struct({quoted(label)} AS key, m AS match))"
        for label, column in found.items()
    )
    hit = any_of([f"size({column}) > 0" for column in found.values()])
    return f"CASE WHEN {hit} THEN concat({per_rule}) ELSE CAST(array() AS {NOGO_TYPE}) END"


def nogo_count(scan: Scan, rules: tuple[Rule, ...] = NOGO_RULES) -> str:
    return total([scan.count(r) for r in rules])


def nogo_violations(hits: str) -> str:
    before, after = fixed.NOGO_VIOLATION.split("{key}")
    middle, end = after.split("{match}")
    return f"transform({hits}, h -> concat({quoted(before)}, h.key, {quoted(middle)}, h.match, {quoted(end)}))"


def cta_present(scan: Scan, rules: tuple[Rule, ...] = CTA_RULES) -> str:
    return any_of([scan.exists(r) for r in rules])


def cta_matched(scan: Scan, rules: tuple[Rule, ...] = CTA_RULES) -> str:
    """The patterns that were found, in rule order."""
    found = ", ".join(f"CASE WHEN {scan.exists(r)} THEN {quoted(r.pattern)} END" for r in rules)
    return f"array_compact(array({found}))"


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for a null text."""
    space = rf"(?U)[{SPACE_MEMBERS}]"
    ascii_only = F.length(text) == F.octet_length(text)
    pieces = F.when(ascii_only, F.size(F.split(text, r"[\t-\r\x1c-\x20]+"))).otherwise(
        F.size(F.split(text, space + "+"))
    )
    edges = F.substring(text, 1, 1).rlike(space).cast("int") + F.right(text, F.lit(1)).rlike(
        space
    ).cast("int")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(pieces - edges)


def over_by(words: Column, limit: Column) -> Column:
    """Words beyond the limit; a null or zero limit means there is none."""
    return F.when(F.coalesce(limit, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(0), words - limit))


def term_hits(text: Column, terms: Column, lowered: bool = False) -> Column:
    """The row's own forbidden terms (comma list) that occur in the text, any case.

    ``lowered``: the text is a column in lower case already, which saves lowering it per term.
    """
    plain = text if lowered else F.lower(text)
    listed = F.filter(
        F.transform(F.split(F.coalesce(terms, F.lit("")), ","), lambda t: F.lower(F.trim(t))),
        lambda t: t != "",
    )
    return F.filter(listed, lambda t: F.coalesce(plain.contains(t), F.lit(False)))
