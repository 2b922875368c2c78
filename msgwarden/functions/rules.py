"""Rule tables: what to look for, and cheap tests that rule most texts out first.

A rule may carry ``literals`` (lower-case strings of which a text must hold one) and a
``probe`` (a short pattern a text must match). Both are necessary conditions of the rule's
pattern, so they never change a result: they let a byte search or one short scan decide for
most texts that the costly pattern cannot match. Rules without them are simply always run.

``equivalent`` holds a pattern with the same matches and ``predicate`` one found in the same
texts, where a plainly written pattern would search in a costlier way.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .regex import ODD_WORD_CHARS, SPACE_MEMBERS, java_body, to_java
from .sqltext import NO_STRINGS, any_of, name, quoted


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    group: int = 0
    mask: str | None = None
    ignore_case: bool = True
    literals: tuple[str | bytes, ...] = ()
    probe: str | None = None
    digits: bool = False
    equivalent: str | None = None
    predicate: str | None = None

    def java(self, exact: bool | None) -> str:
        return to_java(self.equivalent or self.pattern, self.ignore_case, exact)

    def java_predicate(self, exact: bool | None) -> str:
        """Pattern found in the same texts as ``java``, though not at the same places."""
        return to_java(self.predicate or self.equivalent or self.pattern, self.ignore_case, exact)

    def body(self, exact: bool | None) -> str:
        """Pattern for the inside of an alternation, with its own case flag."""
        inner = java_body(self.equivalent or self.pattern, exact)
        return f"(?{'i' if self.ignore_case else '-i'}:{inner})"

    @property
    def ascii(self) -> bool:
        """Whether ASCII texts can be searched without Unicode tables; a letter such as U+017F would match an ASCII one."""
        return all(p is None or p.isascii() for p in (self.pattern, self.equivalent, self.predicate))

    @property
    def bounded(self) -> bool:
        return r"\b" in self.pattern


# Any text that holds a match of a digit-bearing personal-data rule matches this one.
_LETTER = "[A-Za-zıſİK]"
_ALNUM = "[A-Za-z0-9ıſİK]"
_SEP = rf"[-{SPACE_MEMBERS}]?"
DIGIT_PROBE = (
    "(?U)[0-9](?:"
    "[0-9]{5}"
    rf"|[0-9]{{3}}{_SEP}[0-9]{{4}}"
    r"|[0-9]{0,2}\.[0-9]{1,3}\.[0-9]"
    rf"|[0-9]{{2}}-?{_LETTER}"
    rf"|[0-9]{_ALNUM}{{11}})"
)

# Equivalent patterns test the first character before anything else and name a boundary that
# all alternatives share only once. The part of an address before "@" holds no "@", so
# nothing is gained there by giving characters back.
_PII_HINTS = {
    "email": {
        "literals": ("@",),
        "equivalent": r"\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    },
    "phone": {
        "digits": True,
        "probe": "[0-9]{6}",
        "equivalent": r"(?=[0+])\b(?:06[-\s]?[0-9]{8}|\+31[-\s]?6[-\s]?[0-9]{8}"
        r"|0031[-\s]?6[-\s]?[0-9]{8}|0[0-9]{2,3}[-\s]?[0-9]{6,7}"
        r"|\+31[-\s]?[0-9]{2,3}[-\s]?[0-9]{6,7})\b",
    },
    "iban": {"digits": True, "probe": f"[0-9]{{2}}{_ALNUM}{{11}}"},
    "linkedin": {"literals": ("linkedin.com/",)},
    "bsn": {"digits": True, "probe": "[0-9]{9}", "equivalent": r"(?=[0-9])\b[0-9]{9}\b"},
    "rijbewijs": {"digits": True, "probe": f"[0-9]{{3}}-?{_LETTER}"},
    "credit_card": {
        "digits": True,
        "probe": f"(?U)[0-9]{{4}}{_SEP}[0-9]{{4}}",
        "equivalent": r"(?=[0-9])\b(?:[0-9]{4}[-\s]?){3}[0-9]{4}\b",
    },
    "ip_address": {
        "digits": True,
        "probe": r"[0-9]\.[0-9]{1,3}\.[0-9]",
        "equivalent": r"(?=[0-9])\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    },
    "api_key": {
        "literals": ("sk-", "pk-", "api"),
        "equivalent": r"(?=[spa])\b(?:sk-|pk-|api[_-]?key)[A-Za-z0-9_-]{20,}\b",
    },
}
# UTF-8 lead bytes shared by every pictograph above U+1F000; searched for as bytes.
EMOJI_BYTES = b"\xf0\x9f"
_NOGO_HINTS = {
    "garantie": {
        "literals": ("garan",),
        "equivalent": r"(?=g)\b(?:garantie(s|vrij)?|gegarandeerd)\b",
    },
    "garanderen": {"literals": ("garan",), "equivalent": r"(?=g)\bgarandeer(t|en|de|den)?\b"},
    "risicoloos": {
        "literals": ("risicoloos", "risk"),
        "equivalent": r"(?=r)\b(?:risicoloos|risk[-\s]?free)\b",
    },
    "zeker_weten": {
        "literals": ("zeker", "100"),
        "equivalent": r"(?=[z1])\b(?:zeker\s+weten\b|100%|100\s?procent\b)",
    },
    "we_beloven": {
        "literals": ("belo",),
        "equivalent": r"(?=[wib])\b(?:(we|wij|ik)\s+beloof|beloofd|we\s+beloven)\b",
    },
    "geld_terug": {
        "literals": ("geld", "money"),
        "equivalent": r"(?=[gm])\b(?:geld[-\s]?terug|money[-\s]?back)\b",
    },
    "hey": {"literals": ("hey", "hoi", "yo"), "equivalent": r"(?=[hy])\b(?:hey|hoi|yo)\b"},
    # every character of the class lies behind U+2727
    "emoji": {
        "literals": ("✨", "❤", "\ufe0f", EMOJI_BYTES),
        "equivalent": r"(?=[^\x00-✧])" + fixed.NOGO_PATTERNS[7][1],
    },
    "excess_exclam": {"literals": ("!!",)},
}
_CTA_HINTS = (
    ("plan", "spreken", "afspraak", "bellen", "call", "overleg"),
    ("kennismaking", "sparr", "kort gesprek"),
    ("uw reactie", "reageer", "contact"),
    ("voorkeur", "beschikbaar"),
    ("kunt u", "zou u", "past ", "voorkeurstijden"),
    ("sdag", "ndag", "rdag", "jdag"),
    ("stuur", "laat ", "geef"),
    ("heeft u tijd", "tijd voor", "minu"),
    ("bevestig", "plan", "stel"),
)

# "A, anything, B" on one line holds exactly when a B follows the line's first A. Committing
# to that first A keeps the search linear where a line repeats A many times without any B.
_CTA_PREDICATES = {
    6: r"(?m)^(?>.*?[mdwv](?<=\b.)(?:(?<=m)aandag|(?<=d)insdag|(?<=w)oensdag|(?<=d)onderdag|(?<=v)rijdag)\b).*\b(?:om|tussen|van)\b",
    7: r"(?m)\b(?:stuurt? u|laat (?:u|het) weten)\b|^(?>.*?g(?<=\bg)eef).*door\b",
    9: r"(?m)\bbevestig(?:t u)?\b|^(?>.*?p(?<=\bp)lan).*in\b|^(?>.*?s(?<=\bs)tel).*voor\b",
}
_CTA_PROBES = {9: r"(?=[psb])\b(?:plan|stel|bevestig)", 7: r"(?=[slg])\b(?:stuur|laat|geef)"}

PII_RULES = tuple(
    Rule(label, pattern, mask=mask, ignore_case=ci, **_PII_HINTS[label])
    for label, pattern, mask, ci in fixed.PII_PATTERNS
)
NOGO_RULES = tuple(
    Rule(label, pattern, group=group, ignore_case=ci, **_NOGO_HINTS[label])
    for label, pattern, group, ci in fixed.NOGO_PATTERNS
)
CTA_RULES = tuple(
    Rule(str(i), pattern, literals=hints, probe=_CTA_PROBES.get(i), predicate=_CTA_PREDICATES.get(i))
    for i, (pattern, hints) in enumerate(zip(fixed.CTA_PATTERNS, _CTA_HINTS), start=1)
)


# Characters beyond ASCII that a case-insensitive match folds to i, s or k.
_FOLDING = ("ı", "ſ", "\u212a", "İ")
SCAN_COLUMNS = ("__lower", "__folds", "__digits", "__odd", "__ascii")


def odd_words(text: str) -> str:
    """Whether the text needs the exact word boundaries."""
    return f"(length({text}) < octet_length({text}) AND {text} RLIKE {quoted(ODD_WORD_CHARS)})"


def maybe_pii(text: str, rules: tuple[Rule, ...]) -> str:
    """A condition every text with personal data meets, without helper columns."""
    if any(not r.digits and not r.literals for r in rules):
        return "true"
    words = sorted({lit for r in rules if not r.digits for lit in r.literals})
    starts = "".join(sorted({re.escape(w[0]) for w in words}))
    found = f"(?iU)(?=[{starts}])(?:" + "|".join(re.escape(w) for w in words) + ")"
    return f"({text} RLIKE {quoted(DIGIT_PROBE)} OR {text} RLIKE {quoted(found)})"


def scan_facts(text: str) -> dict[str, Column]:
    """The helper columns of :class:`Scan`, each computed once per row."""
    t = name(text)
    folds = any_of([f"contains({t}, {quoted(c)})" for c in _FOLDING])
    facts = {
        "__lower": f"lower({t})",
        "__folds": f"length({t}) < octet_length({t}) AND {folds}",
        "__digits": f"{t} RLIKE {quoted(DIGIT_PROBE)}",
        "__odd": odd_words(t),
        "__ascii": f"length({t}) = octet_length({t})",
    }
    return {column: F.expr(e) for column, e in facts.items()}


def pieces(text: str, pattern: str) -> str:
    """The text split at the matches of a pattern.

    Splitting at a pattern compiles it anew for every row, replacing does not. So matches are
    replaced by one NUL each and the text is split there, unless it holds a NUL itself.
    """
    nul, p = quoted("\0"), quoted(pattern)
    return (
        f"CASE WHEN contains({text}, {nul}) THEN split({text}, {p}, -1)"
        f" ELSE split(regexp_replace({text}, {p}, {nul}), {nul}, -1) END"
    )


@dataclass(frozen=True)
class Scan:
    """Searches in a text column next to which the :func:`scan_facts` columns exist.

    All methods return SQL text.
    """

    column: str

    @property
    def text(self) -> str:
        return name(self.column)

    def pick(self, rule: Rule, make: Callable[[bool | None], str]) -> str:
        """``make(exact)`` with the fast boundaries where the text allows them, for ASCII texts without Unicode tables."""
        cases = [f"WHEN __ascii THEN {make(None)}"] if rule.ascii else []
        cases += [f"WHEN __odd THEN {make(True)}"] if rule.bounded else []
        return f"CASE {' '.join(cases)} ELSE {make(False)} END" if cases else make(False)

    def candidate(self, rule: Rule) -> str:
        """Condition without which ``rule`` cannot match."""
        need = ["__digits"] if rule.digits else []
        if rule.literals:
            found = [
                f"contains(CAST({self.text} AS BINARY), X'{lit.hex()}')"
                if isinstance(lit, bytes)
                else f"contains(__lower, {quoted(lit)})"
                for lit in rule.literals
            ]
            if any(isinstance(lit, str) and lit.isascii() and lit.upper() != lit for lit in rule.literals):
                found.append("__folds")
            need.append(any_of(found))
        if rule.probe and r"\b" in rule.probe:  # boundaries in probes are the fast ones
            need.append(f"(__odd OR {self.text} RLIKE {quoted('(?iU)' + rule.probe)})")
        elif rule.probe:
            need.append(f"{self.text} RLIKE {quoted(rule.probe)}")
        return "(" + " AND ".join(need or [f"{self.text} IS NOT NULL"]) + ")"

    def matches(self, rule: Rule) -> str:
        """All matches of the rule, as an array; empty when there are none."""
        found = self.pick(
            rule,
            lambda exact: f"regexp_extract_all({self.text}, {quoted(rule.java(exact))}, {rule.group})",
        )
        return f"CASE WHEN {self.candidate(rule)} THEN {found} ELSE {NO_STRINGS} END"

    def gaps(self, rule: Rule) -> str:
        """The pieces of the text between the matches."""
        return self.pick(rule, lambda exact: pieces(self.text, rule.java(exact)))

    def once(self, match: str) -> str:
        """Whether the text holds a string at one place only, which is then where a search has found it."""
        return f"(locate({match}, {self.text}, instr({self.text}, {match}) + 1) = 0)"

    def first(self, rule: Rule) -> str:
        """Place of the first match, for comparison with those of other rules in the text."""
        return self.pick(rule, lambda exact: f"regexp_instr({self.text}, {quoted(rule.java(exact))})")

    def replaced(self, rule: Rule, token: str) -> str:
        return self.pick(
            rule,
            lambda exact: f"regexp_replace({self.text}, {quoted(rule.java(exact))}, {quoted(token)})",
        )

    def count(self, rule: Rule) -> str:
        n = self.pick(rule, lambda exact: f"regexp_count({self.text}, {quoted(rule.java(exact))})")
        return f"CASE WHEN {self.candidate(rule)} THEN {n} ELSE 0 END"

    def exists(self, rule: Rule) -> str:
        hit = self.pick(
            rule, lambda exact: f"{self.text} RLIKE {quoted(rule.java_predicate(exact))}"
        )
        return f"coalesce({self.candidate(rule)} AND {hit}, false)"
