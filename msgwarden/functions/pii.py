"""Personal data in a text: matches, offsets, counts and masking.

Functions that take a :class:`Scan` return SQL text for the columns they name; those that
take and return columns are meant for use on their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .regex import EXACT_BOUNDARY, java_body
from .rules import PII_RULES, Rule, Scan, maybe_pii, odd_words
from .sqltext import any_of, quoted, total

GROUPED_TYPE = "array<struct<type:string,matches:array<string>>>"
_HITS_TYPE = "array<struct<start:int,rank:int,type:string,match:string,end:int,mask:string>>"


def bsn_rule_sql(value: str, rule: str = "reference") -> str:
    """Checksum of a nine-digit number.

    With r = (sum of digit_i * (9 - i) over the first eight digits) mod 11, the last digit
    must equal r when r < 2 and 11 - r otherwise; ``rule='standard'`` asks for r itself.
    """
    if rule not in ("reference", "standard"):
        raise ValueError(f"unknown BSN rule {rule!r}")
    digit = "try_cast(substring({v}, {i}, 1) AS INT)"
    r = "(" + total([f"{digit.format(v=value, i=i + 1)} * {9 - i}" for i in range(8)]) + " % 11)"
    wanted = r if rule == "standard" else f"IF({r} < 2, {r}, 11 - {r})"
    return f"coalesce({digit.format(v=value, i=9)} = {wanted}, false)"


def with_bsn_valid(df, number: str, out: str = "valid", rule: str = "reference"):
    """The frame with the checksum of a column of nine-digit numbers."""
    return df.withColumn(out, F.expr(bsn_rule_sql(f"`{number}`", rule)))


def _is_bsn(rule: Rule) -> bool:
    return rule.label == "bsn"


def type_matches(scan: Scan, rule: Rule, bsn_rule: str = "reference") -> str:
    """Matches of one type, as ``array<string>`` in text order."""
    found = scan.matches(rule)
    return f"filter({found}, m -> {bsn_rule_sql('m', bsn_rule)})" if _is_bsn(rule) else found


def type_count(scan: Scan, rule: Rule, bsn_rule: str = "reference") -> str:
    """Number of matches of one type; no array is kept except for checksummed numbers."""
    return f"size({type_matches(scan, rule, bsn_rule)})" if _is_bsn(rule) else scan.count(rule)


def type_present(scan: Scan, rule: Rule, bsn_rule: str = "reference") -> str:
    if _is_bsn(rule):
        return f"(size({type_matches(scan, rule, bsn_rule)}) > 0)"
    return scan.exists(rule)


def count_map(labels: list[str]) -> Column:
    """``map<type, n>`` of the types that occur, from one count column per type."""
    entries = ", ".join(f"struct({quoted(t)} AS key, `{t}` AS value)" for t in labels)
    return F.expr(f"map_from_entries(filter(array({entries}), e -> e.value > 0))")


def _running_starts(found: str, gaps: str) -> str:
    """Start of each match from the gaps before it and the matches before it.

    A running total over an array costs a copy per step. Working in blocks of 256 bounds the
    copies, so texts with very many matches stay affordable within one row.
    """
    steps = (
        f"zip_with(slice({gaps}, 1, size({found})), {found},"
        " (g, m) -> struct(length(g) AS gap, length(m) AS len))"
    )
    blocks = f"transform(sequence(1, size({found}), 256), at -> slice({steps}, at, 256))"
    inner = (
        "aggregate(b, struct(s.pos AS pos, CAST(array() AS array<int>) AS starts),"
        " (t, x) -> struct(t.pos + x.gap + x.len AS pos, concat(t.starts, array(t.pos + x.gap)) AS starts))"
    )
    done = (
        f"aggregate({blocks}, struct(0 AS pos, CAST(array() AS array<array<int>>) AS blocks),"
        " (s, b) -> struct(s.pos + aggregate(b, 0, (n, x) -> n + x.gap + x.len) AS pos,"
        f" concat(s.blocks, array({inner}.starts)) AS blocks))"
    )
    return f"CASE WHEN size({found}) = 1 THEN array(length(get({gaps}, 0))) ELSE flatten({done}.blocks) END"


def type_gaps(scan: Scan, rule: Rule, found: str) -> str:
    """Pieces before and between the candidates of one type, where there are any."""
    match = f"get({found}, 0)"
    before = f"array(substring({scan.text}, 1, instr({scan.text}, {match}) - 1))"
    alone = f"WHEN size({found}) = 1 AND {scan.once(match)} THEN {before}" if rule.group == 0 else ""
    return f"CASE {alone} WHEN size({found}) > 0 THEN {scan.gaps(rule)} END"


def _type_hits(rule: Rule, rank: int, found: str, gaps: str, bsn_rule: str) -> str:
    """Matches of one type with their offsets in characters."""
    hits = (
        f"zip_with({found}, {_running_starts(found, gaps)}, (m, at) -> struct(at AS start, {rank} AS rank,"
        f" {quoted(rule.label)} AS type, m AS match, at + length(m) AS end, {quoted(rule.mask)} AS mask))"
    )
    if _is_bsn(rule):
        hits = f"filter({hits}, h -> {bsn_rule_sql('h.match', bsn_rule)})"
    # sequence() counts down on an empty list, so presence is settled first
    return f"CASE WHEN size({found}) > 0 THEN {hits} ELSE CAST(array() AS {_HITS_TYPE}) END"


def hit_list(
    found: dict[str, str], gaps: dict[str, str], rules: tuple[Rule, ...] = PII_RULES,
    bsn_rule: str = "reference",
) -> str:
    """Every match with offsets, ordered by start and then by type order.

    ``found`` names the columns of candidates per type (``Scan.matches``) and ``gaps`` those
    of the pieces between them (:func:`type_gaps`).
    """
    every = ", ".join(
        _type_hits(r, k, found[r.label], gaps[r.label], bsn_rule) for k, r in enumerate(rules)
    )
    return (
        f"transform(sort_array(concat({every})), h -> struct(h.type AS type, h.match AS match,"
        " h.start AS start, h.end AS end, h.mask AS mask))"
    )


def _first_start(scan: Scan, rule: Rule, found: str) -> str:
    match = f"get({found}, 0)"
    searched = scan.first(rule)
    if _is_bsn(rule):
        # candidates that fail the checksum may come before: look for the first valid number
        edge = quoted(EXACT_BOUNDARY)
        searched = f"regexp_instr({scan.text}, concat('(?U)', {edge}, {match}, {edge}))"
    if rule.group != 0:
        return searched
    # beyond ASCII, the two kinds of search may count characters differently
    return f"CASE WHEN __ascii AND {scan.once(match)} THEN instr({scan.text}, {match}) ELSE {searched} END"


def grouped_hits(scan: Scan, found: dict[str, str], rules: tuple[Rule, ...] = PII_RULES) -> str:
    """``[{type, matches}]`` for the types that occur, in order of first occurrence.

    ``found`` names the columns of matches per type (:func:`type_matches`).
    """
    entries = ", ".join(
        f"CASE WHEN size({found[r.label]}) > 0 THEN struct({_first_start(scan, r, found[r.label])} AS at,"
        f" {k} AS rank, {quoted(r.label)} AS type, {found[r.label]} AS matches) END"
        for k, r in enumerate(rules)
    )
    present = any_of([f"size({found[r.label]}) > 0" for r in rules])
    return (
        f"CASE WHEN {present} THEN transform(sort_array(filter(array({entries}), e -> e IS NOT NULL)),"
        f" e -> struct(e.type AS type, e.matches AS matches)) ELSE CAST(array() AS {GROUPED_TYPE}) END"
    )


def violations(grouped: str) -> str:
    """One reported text per type that occurs."""
    before, after = fixed.PII_VIOLATION.split("{type}")
    middle, end = after.split("{count}")
    return (
        f"transform({grouped}, g -> concat({quoted(before)}, g.type, {quoted(middle)},"
        f" CAST(size(g.matches) AS STRING), {quoted(end)}))"
    )


def _weave(text: str, pattern: str, token: str) -> str:
    """The text with every match ``m`` of ``pattern`` replaced by ``token``.

    One search puts a NUL before and behind each match, after which every second piece is one; not so in a text with NULs.
    """
    nul, p = quoted("\0"), quoted(pattern)
    marked = f"split(regexp_replace({text}, {p}, {quoted(chr(0) + '$0' + chr(0))}), {nul}, -1)"
    once = f"array_join(transform({marked}, (m, i) -> IF(i % 2 = 1, {token}, m)), '')"
    tokens = f"transform(regexp_extract_all({text}, {quoted(pattern)}, 0), m -> {token})"
    gaps = f"split({text}, {p}, -1)"
    return (
        f"CASE WHEN contains({text}, {nul}) THEN array_join(zip_with({gaps}, {tokens}, (g, t) -> concat(g, coalesce(t, ''))), '')"
        f" ELSE {once} END"
    )


def _mask_one(scan: Scan, rule: Rule, bsn_rule: str) -> str:
    if not _is_bsn(rule):
        return scan.replaced(rule, rule.mask)
    token = f"IF({bsn_rule_sql('m', bsn_rule)}, {quoted(rule.mask)}, m)"
    return scan.pick(rule, lambda exact: _weave(scan.text, rule.java(exact), token))


def any_type(rules: tuple[Rule, ...], exact: bool | None) -> str:
    """Alternation of all types, in type order."""
    return ("(?d)" if exact is None else "(?Ud)") + "|".join(rule.body(exact) for rule in rules)


def _token_of(rules: tuple[Rule, ...], bsn_rule: str, unicode: str = "U") -> str:
    """The token for a match ``m`` of the alternation of all types.

    Which type a match has follows from the match alone: the patterns are tried in type order
    against the whole match, without the boundaries, as the alternation tried them in place.
    """
    cases = []
    for rule in rules:
        inside = java_body(rule.pattern.replace(r"\b", ""))
        whole = f"(?{'i' if rule.ignore_case else ''}{unicode}d)\\A(?:{inside})\\z"
        mask = quoted(rule.mask)
        if _is_bsn(rule):
            mask = f"IF({bsn_rule_sql('m', bsn_rule)}, {mask}, m)"
        cases.append(f"WHEN m RLIKE {quoted(whole)} THEN {mask}")
    return f"CASE {' '.join(cases)} ELSE m END"


def _mask_any(text: str, odd: str, rules: tuple[Rule, ...], bsn_rule: str, plain: str | None = None) -> str:
    """``plain``: a condition that only ASCII texts meet."""
    token, fast = _token_of(rules, bsn_rule), ""
    if plain is not None and all(r.ascii for r in rules):
        fast = f"WHEN {plain} THEN {_weave(text, any_type(rules, None), _token_of(rules, bsn_rule, ''))} "
    return (
        f"CASE {fast}WHEN {odd} THEN {_weave(text, any_type(rules, True), token)}"
        f" ELSE {_weave(text, any_type(rules, False), token)} END"
    )


def mask_text(
    scan: Scan, present: dict[str, str], rules: tuple[Rule, ...] = PII_RULES,
    bsn_rule: str = "reference",
) -> str:
    """The text with every match replaced by its type's token.

    ``present`` holds a condition per type. Most texts hold no type or one, and are returned
    as they are or pass through one replacement. Where matches of different types overlap, the
    one that starts first is masked, the earlier type on a tie, and the search goes on
    behind it; :func:`mask_by_splicing` gives the other known behaviour for that case.
    """
    kinds = total([f"CAST({present[r.label]} AS INT)" for r in rules])
    ones = " ".join(
        f"WHEN {present[r.label]} THEN {_mask_one(scan, r, bsn_rule)}" for r in rules
    )
    mixed = _mask_any(scan.text, "__odd", rules, bsn_rule, "__ascii")
    return f"CASE WHEN {kinds} > 1 THEN {mixed} {ones} ELSE {scan.text} END"


def mask_by_splicing(text: Column, hits: Column) -> Column:
    """Tokens spliced in from the last match to the first at the original offsets.

    Equal to :func:`mask_text` as long as matches do not overlap. On overlaps an offset may
    point into text that has already changed; this is kept for exact agreement with results
    that were made that way. It copies the text once per match.
    """
    return F.aggregate(
        F.reverse(hits),
        text,
        lambda t, h: F.concat(
            F.substring(t, F.lit(1), h["start"]),
            h["mask"],
            F.substring(t, h["end"] + 1, F.length(t)),
        ),
    )


def mask_value(value: str, rules: tuple[Rule, ...] = PII_RULES, bsn_rule: str = "reference") -> str:
    """:func:`mask_text` for any SQL value, for short texts such as metadata fields."""
    mixed = _mask_any(value, odd_words(value), rules, bsn_rule)
    return f"CASE WHEN {maybe_pii(value, rules)} THEN {mixed} ELSE {value} END"
