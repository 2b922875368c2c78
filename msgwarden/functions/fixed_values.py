"""Patterns, word lists, weights, thresholds and message formats.

Results have to agree with these, so they are written out here once, in the order in which
they are evaluated. One pattern has a filter folded in, where a note says so. Patterns use Python notation (``\\b``, ``\\s``); they become
Java patterns in :mod:`msgwarden.functions.regex`.
"""

# --- fixed values: personal data: type, pattern, mask token, case-insensitive ------------
PII_PATTERNS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_MASKED]", True),
    (
        "phone",
        r"\b06[-\s]?[0-9]{8}\b"
        r"|\b\+31[-\s]?6[-\s]?[0-9]{8}\b"
        r"|\b0031[-\s]?6[-\s]?[0-9]{8}\b"
        r"|\b0[0-9]{2,3}[-\s]?[0-9]{6,7}\b"
        r"|\b\+31[-\s]?[0-9]{2,3}[-\s]?[0-9]{6,7}\b",
        "[PHONE_MASKED]",
        True,
    ),
    # 4-30 characters after the check digits, of which matches under 15 characters do not count
    ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", "[IBAN_MASKED]", True),
    (
        "linkedin",
        r"https?://(?:www\.)?linkedin\.com/in/[A-Za-z0-9._-]+/?"
        r"|https?://(?:www\.)?linkedin\.com/company/[A-Za-z0-9._-]+/?"
        r"|linkedin\.com/in/[A-Za-z0-9._-]+/?"
        r"|linkedin\.com/company/[A-Za-z0-9._-]+/?",
        "[LINKEDIN_MASKED]",
        True,
    ),
    ("bsn", r"\b[0-9]{9}\b", "[BSN_MASKED]", False),
    ("rijbewijs", r"\b[A-Z]{2}[-]?[0-9]{3}[-]?[A-Z]{2}\b", "[ID_MASKED]", True),
    ("credit_card", r"\b(?:[0-9]{4}[-\s]?){3}[0-9]{4}\b", "[CC_MASKED]", False),
    ("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP_MASKED]", False),
    ("api_key", r"\b(?:sk-|pk-|api[_-]?key)[A-Za-z0-9_-]{20,}\b", "[API_KEY_MASKED]", True),
)

# --- fixed values: forbidden wording: label, pattern, reported group, case-insensitive ---
NOGO_PATTERNS = (
    ("garantie", r"\bgarantie(s|vrij)?\b|\bgegarandeerd\b", 1, True),
    ("garanderen", r"\bgarandeer(t|en|de|den)?\b", 1, True),
    ("risicoloos", r"\brisicoloos\b|\brisk[-\s]?free\b", 0, True),
    ("zeker_weten", r"\bzeker\s+weten\b|\b100%|\b100\s?procent\b", 0, True),
    ("we_beloven", r"\b(we|wij|ik)\s+beloof\b|\bbeloofd\b|\bwe\s+beloven\b", 1, True),
    ("geld_terug", r"\bgeld[-\s]?terug\b|\bmoney[-\s]?back\b", 0, True),
    ("hey", r"\bhey\b|\bhoi\b|\byo\b", 0, True),
    ("emoji", "[😀-🙏🚀✨🔥👍👏🙂😉😊😅😂🥳❤️💪]", 0, False),
    ("excess_exclam", r"!{2,}", 0, False),
)

# --- fixed values: call-to-action wording, one pattern per rule, all case-insensitive ----
CTA_PATTERNS = (
    r"\b(plan|plannen|inplannen|afspreken|afspraak|spreken|bellen|call|overleg)\b",
    r"\b(kennismakingsgesprek|sparren|sparring|kennismaking|kort gesprek)\b",
    r"\b(graag uw reactie|uw reactie|reageer|neem contact|contact op)\b",
    r"\b(voorkeurstijd|voorkeursmoment|voorkeur|beschikbaar)\b",
    r"\b(kunt u|zou u|past (u|het)|wat (zijn|zijn uw) voorkeurstijden)\b",
    r"\b(dinsdag|woensdag|donderdag|vrijdag|maandag)\b.*\b(om|tussen|van)\b",
    r"\b(stuur(?:t)? u|laat (u|het) weten|geef.*door)\b",
    r"\b(heeft u tijd|tijd voor|20 minuten|15 minuten|minuutje)\b",
    r"\b(bevestig|bevestigt u|plan.*in|stel.*voor)\b",
)

# --- fixed values: texts of reported violations ------------------------------------------
PII_VIOLATION = "PII {type} gevonden: {count} instances"
NOGO_VIOLATION = "No-go token '{key}' gevonden: {match}"
CTA_VIOLATION = "Geen CTA gevonden in tekst"
LENGTH_VIOLATION = "Tekst heeft {words} woorden, max {limit}"

# --- fixed values: rubric, verdict thresholds and judge answer conventions ---------------
RUBRIC_WEIGHTS = (
    ("style_match", 0.30),
    ("policy_safety", 0.30),
    ("pii_free", 0.20),
    ("structure_brevity", 0.10),
    ("personalization", 0.10),
)
DEFAULT_REASON = "Geen reden gegeven"
PARSE_FAILED = "PARSE_FAILED"
RAW_RESPONSE_LIMIT = 500
PREVIEW_LENGTH = 100
PASS_SCORE = 3.5
MIN_BATCH = 100
PROMOTION_DELTA = 0.25
PII_CLEAN_TARGET = 95.0
ERROR_PREFIX = "ERROR:"
MIN_KAPPA_PAIRS = 5
TARGET_AGREEMENT = ">=0.80 binnen ±1 punt"
TARGET_KAPPA = ">=0.60"
