"""Python regular expressions as Java ones, with the same matches on any text.

Whitespace also includes U+001C to U+001F, and ``.`` stops at ``\\n`` only. Word boundaries
need more care: Java's Unicode boundary is fast but counts other characters as parts of words
than Python does, which takes letters, numbers and ``_``. The difference is limited to the few
kinds of characters in :data:`ODD_WORD_CHARS`. Texts without any of them use Java's boundary;
for the others the boundary is spelled out, which is exact and several times slower.
"""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]"
EXACT_BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
SPACE_MEMBERS = r"\s\x1c-\x1f"

# marks, numbers that are no digits, enclosed letters, joiners and connectors other than "_"
ODD_WORD_CHARS = (
    r"[[^\x00-\x7f]&&[\p{M}\p{No}\p{Nl}\x{24b6}-\x{24e9}\x{1f130}-\x{1f189}"
    r"\x{200c}\x{200d}\x{203f}\x{2040}\x{2054}\x{fe33}\x{fe34}\x{fe4d}-\x{fe4f}\x{ff3f}]]"
)


def to_java(pattern: str, ignore_case: bool = True, exact: bool | None = True) -> str:
    """The Java pattern that matches what Python's ``re`` matches for ``pattern``.

    With ``exact`` None it does so in ASCII texts only, where Java's classes, boundaries and letter cases need no Unicode
    tables and are several times faster without them.
    """
    unicode = "" if exact is None else "U"
    return f"(?{'i' if ignore_case else ''}{unicode}d)" + java_body(pattern, exact)


def java_body(pattern: str, exact: bool | None = True) -> str:
    """As :func:`to_java`, without the flags, for use inside a larger pattern."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not in_class:
            out.append(EXACT_BOUNDARY if exact else two)
        elif two == r"\s":
            out.append(SPACE_MEMBERS if in_class else f"[{SPACE_MEMBERS}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = two[0] == "[" or (in_class and two[0] != "]")
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)
