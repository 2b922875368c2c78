"""Inputs of the registered queries, derived by Spark from the given tables.

The expressions are plain SQL that other engines read alike, so that a query and its check
start from the same texts. Every row of a table yields one message, contact line or answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..sources.readers import read_table


@dataclass(frozen=True)
class Derived:
    """Columns computed from every row of one table."""

    table: str
    columns: tuple[str, ...]

    @property
    def sql(self) -> str:
        return f"SELECT {', '.join(self.columns)} FROM {self.table}"

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.table).selectExpr(*self.columns)


@dataclass(frozen=True)
class Split:
    """Lines of one file as splits hold them: each row of a table gives the pieces of the text `whole`, cut at `at`.

    The row's number `row` and the piece's place make the split, `wide` pieces or the rest of the row each.
    """

    table: str
    row: str
    whole: str
    at: str
    wide: int

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = table(spark, sf_dir, self.table).select(F.expr(self.row).alias("row"), F.posexplode(F.split(F.expr(self.whole), self.at)).alias("pos", "value"))
        return parts.selectExpr("'f' AS file", f"row * 3 + least(pos div {self.wide}, 2) AS block", "row * 1000000 + pos AS place", "value")


def ends(spark: SparkSession, before: tuple[str, ...], after: tuple[str, ...]) -> DataFrame:
    """Lines before and after those of a :class:`Split`."""
    far = 1 << 60
    rows = [("f", -far, i, v) for i, v in enumerate(before)] + [("f", far, i, v) for i, v in enumerate(after)]
    return spark.createDataFrame(rows, "file string, block long, place long, value string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, dealt to as many tasks as the setting `msgwarden.spread` asks for, if it is set."""
    spread = spark.conf.get("msgwarden.spread", None)
    return read_table(spark, f"{sf_dir}/{name}.parquet", int(spread) if spread else None)


# A document followed by a Dutch sentence that exercises the wording rules.
MESSAGE = """text || ' ' || CASE doc_id % 13
  WHEN 0 THEN 'Kunt u dinsdag bellen om drie uur?'
  WHEN 1 THEN 'Wij beloof u garanties, 100% gegarandeerd!!'
  WHEN 2 THEN 'Hoi, geld terug of risk free; graag uw reactie.'
  WHEN 3 THEN 'Mail jan.de.vries@voorbeeld.nl of bel 06-12345678 voor een afspraak.'
  WHEN 4 THEN 'Plan een kort gesprek in week 12.'
  WHEN 5 THEN 'Dit is zeker weten risicoloos 🚀 en we beloven niets.'
  WHEN 6 THEN 'Geef het even door aan uw collega.'
  WHEN 7 THEN 'Wat zijn voorkeurstijden voor u? Stuur u een voorstel.'
  WHEN 8 THEN 'Het adres is 192.168.10.24, key sk-abcdefghij0123456789xyz.'
  WHEN 9 THEN 'Planning volgt en komt zo in beeld.'
  WHEN 10 THEN 'Garandeert garandeerde GARANDEREN garantievrij; 20 minuten.'
  WHEN 11 THEN 'Stel het maar voor ❤ yo hey!!!'
  ELSE '' END"""
MESSAGES = Derived(
    "documents",
    ("CAST(doc_id AS STRING) AS id", "lang AS phase", f"{MESSAGE} AS expected_output", "doc_id"),
)

# One line per order in which every kind of personal data may occur.
CONTACT = """'Bel 06-' || lpad(CAST(o_orderkey AS STRING), 8, '0')
  || ' of 020 ' || lpad(CAST(o_custkey AS STRING), 7, '0')
  || ', IBAN NL91ABNA' || lpad(CAST(o_orderkey AS STRING), 10, '0')
  || ' (kort NL12' || lpad(CAST(o_custkey AS STRING), 6, '0')
  || '), BSN ' || lpad(CAST(o_orderkey * 7919 % 1000000000 AS STRING), 9, '0')
  || ', rijbewijs AB-' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0')
  || '-CD, kaart 4111-1111-1111-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')
  || ', mail c' || CAST(o_custkey AS STRING) || '@mail.voorbeeld.nl, IP 10.0.'
  || CAST(o_orderkey % 256 AS STRING) || '.' || CAST(o_custkey % 256 AS STRING)
  || ', https://www.linkedin.com/in/user-' || CAST(o_custkey AS STRING)
  || '/ en key sk-' || lpad(CAST(o_orderkey AS STRING), 24, 'a') || '.'"""
CONTACTS = Derived("orders", ("o_orderkey", "o_custkey", "o_orderpriority", f"{CONTACT} AS line"))

# A labelled sentence per order, one kind of personal data each; every eleventh label is wrong.
_KINDS = (
    ("phone", "'06-' || lpad(CAST(o_orderkey % 100000000 AS STRING), 8, '0')", "[PHONE_MASKED]"),
    ("iban", "'NL91ABNA' || lpad(CAST(o_orderkey AS STRING), 10, '0')", "[IBAN_MASKED]"),
    ("email", "'c' || CAST(o_custkey AS STRING) || '@mail.voorbeeld.nl'", "[EMAIL_MASKED]"),
    ("credit_card", "'4111-1111-1111-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')", "[CC_MASKED]"),
    ("ip_address", "'10.0.' || CAST(o_orderkey % 256 AS STRING) || '.' || CAST(o_custkey % 256 AS STRING)", "[IP_MASKED]"),
    ("api_key", "'sk-' || lpad(CAST(o_orderkey AS STRING), 24, 'a')", "[API_KEY_MASKED]"),
    ("licence", "'AB-' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '-CD'", "[ID_MASKED]"),
    ("none", "'niets'", "niets"),
)
_KIND = f"(o_orderkey + o_custkey) % {len(_KINDS)}"


def _by_kind(values: tuple[str, ...]) -> str:
    return f"CASE {_KIND} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


LABELLED_LINES = Derived(
    "orders",
    (
        _by_kind(tuple(f"'{k}'" for k, _, _ in _KINDS)) + " AS pii_type",
        "'gegeven: ' || " + _by_kind(tuple(v for _, v, _ in _KINDS)) + " || ' !' AS line",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'gegeven: ?' ELSE 'gegeven: ' || "
        + _by_kind(tuple(f"'{m}'" for _, _, m in _KINDS)) + " || ' !' END AS expected_mask",
    ),
)


def _part(name: str, score: str, reason: str = "r") -> str:
    return f"""'"{name}":{{"score":' || {score} || ',"reason":"{reason}"}}'"""


def _points(factor: int, shift: str = "0") -> str:
    return f"CAST((doc_id * {factor} + n_chars + {shift}) % 6 AS STRING)"


def _whole(shift: str = "0") -> str:
    names = ("style_match", "policy_safety", "pii_free", "structure_brevity", "personalization")
    parts = [_part(n, _points(3 + 2 * i, shift), f"toelichting {i}") for i, n in enumerate(names)]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def answer(shift: str = "0") -> str:
    """A judge's answer per document: mostly whole, some in each of the known broken forms."""
    style = _points(3, shift)
    return f"""CASE (doc_id + {shift}) % 23
  WHEN 0 THEN 'geen json'
  WHEN 1 THEN '{{}}'
  WHEN 2 THEN '[1, 2]'
  WHEN 3 THEN {_whole(shift)} || ' met toelichting erachter'
  WHEN 4 THEN '{{' || {_part("style_match", style, " ")} || '}}'
  WHEN 5 THEN '{{' || {_part("style_match", style)} || '}}'
  WHEN 6 THEN '{{' || {_part("style_match", "'\"4.5\"'")} || ',' || {_part("pii_free", style)} || '}}'
  WHEN 7 THEN '{{' || {_part("style_match", "'true'")} || ',' || {_part("personalization", style)} || '}}'
  WHEN 8 THEN '{{' || {_part("style_match", style)} || ',"policy_safety":7,' || {_part("pii_free", "'5'")} || '}}'
  WHEN 9 THEN '{{"error":"Invalid","parse_error":"x","raw_response":"ruw"}}'
  WHEN 10 THEN '5'
  WHEN 11 THEN '"een tekst"'
  WHEN 12 THEN '{{"style_match":{{"reason":"zonder score"}},"pii_free":{{"score":null,"reason":"r"}}}}'
  WHEN 13 THEN '{{"policy_safety":{{"score":3,"reason":5}}}}'
  ELSE {_whole(shift)} END"""


def answers(shift: str = "0") -> Derived:
    return Derived("documents", ("doc_id", "lang", f"{answer(shift)} AS answer"))


#: Versions of a rubric: the known one, and one of fewer criteria, other weights and a criterion that no answer has.
RUBRICS = {
    "v1": fixed.RUBRIC_WEIGHTS,
    "v2": (("policy_safety", 0.5), ("structure_brevity", 0.25), ("extra", 2.0), ("absent", 1.0)),
}


# A score per document and variant as score files hold it.
def score_text(factor: int, shift: int) -> str:
    tenths = f"((doc_id * {factor} + n_chars) % 40 + {shift})"
    return f"""CASE WHEN (doc_id * {factor} + n_chars) % 11 = 0 THEN 'PARSE_FAILED'
  WHEN doc_id % 19 = 0 THEN ''
  ELSE CAST({tenths} AS STRING) || 'e-1' END"""


def score_table(factor: int, shift: int) -> Derived:
    tenths = f"((doc_id * {factor} + n_chars) % 40 + {shift})"
    failed = f"(doc_id * {factor} + n_chars) % 11 = 0"
    return Derived(
        "documents",
        (
            "CAST(doc_id AS STRING) AS case_id",
            f"{score_text(factor, shift)} AS final_score",
            f"CASE WHEN {tenths} >= 35 AND NOT ({failed}) THEN 'True' ELSE 'False' END AS passed",
            f"CASE WHEN {failed} THEN 'True' ELSE 'False' END AS failed_judge_parse",
            "lang",
        ),
    )


SCORES_A, SCORES_B = score_table(7, 5), score_table(11, 9)

# A reply in JSON per customer, right or wrong in one way.
REPLY = """CASE c_custkey % 9
  WHEN 0 THEN '{"message":"Beste ' || c_name || '","cta":"","next_step":"await_reply"}'
  WHEN 1 THEN '{"message":"kort","cta":"x","next_step":"handover"}'
  WHEN 2 THEN '{"message":"Beste ' || c_name || '","next_step":"bel ' || c_mktsegment || '"}'
  WHEN 3 THEN '{"message":"Beste ' || c_name || '","cta":5,"next_step":"handover","tone":"boos"}'
  WHEN 4 THEN '{"message":"Beste ' || c_name || '","cta":"","next_step":"handover","extra":1}'
  WHEN 5 THEN '["' || c_name || '"]'
  WHEN 6 THEN 'Beste ' || c_name
  WHEN 7 THEN '{"message":"Beste ' || c_name || '","cta":"","next_step":"handover"} en meer'
  ELSE '{"message":"Beste ' || c_name || '","cta":"bel","next_step":"propose_times","tone":"formal"}' END"""
REPLIES = Derived("customer", ("c_custkey", "c_mktsegment", f"{REPLY} AS reply"))

# --- fixed values: the reply schema ------------------------------------------------------
REPLY_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "properties": {
        "message": {"type": "string", "minLength": 10, "maxLength": 150},
        "cta": {"type": "string", "minLength": 0, "maxLength": 50},
        "next_step": {"type": "string", "enum": ["propose_times", "await_reply", "handover"]},
        "tone": {"type": "string", "enum": ["formal", "professional", "friendly"]},
    },
    "required": ["message", "cta", "next_step"],
}

#: Our own schema of the events' properties.
PROPS_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "properties": {"k": {"type": "integer"}},
    "required": ["k"],
}

# A line per order as run logs hold it.
LOG_LINE = """CAST(o_orderdate AS STRING) || ' | run_id=run_' || CAST(o_orderkey AS STRING) || ' | dataset=cases_'
  || CAST(o_custkey AS STRING) || ' | variant=V' || CAST(o_orderkey % 3 AS STRING) || ' | parse_failed='
  || CAST(o_custkey % 20 AS STRING) || ' | avg_score=' || CAST(o_orderkey % 50 AS STRING) || 'e-1'"""

LOG_LINES = Derived("orders", (f"{LOG_LINE} AS value",))

# Records as files hold them: CSV with quoted commas and quotes, JSON lines whose values are all text.
_QUOTED = "'\"' || replace(lang || ', \"' || source || '\"', '\"', '\"\"') || '\"'"
CASE_LINES = Derived(
    "documents",
    (f"CAST(doc_id AS STRING) || ',' || lang || ',' || {_QUOTED} || ',out ' || source || ',' || CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id % 90 AS STRING) ELSE '' END || ',\"a,b\"' AS line",),
)
FROZEN_LINES = Derived(
    "documents",
    (
        "'{\"id\":\"' || CAST(doc_id AS STRING) || '\",\"phase\":\"' || lang || '\",\"max_words\":\"' || CASE doc_id % 4 WHEN 0 THEN 'veel' ELSE CAST(doc_id % 90 AS STRING) END"
        " || '\",\"input\":null,\"no_go_terms\":\"x,y\"}' AS line",
    ),
)
ANNOTATION_LINES = Derived(
    "documents",
    (
        "'{\"case_id\":\"' || CAST(doc_id AS STRING) || '\",\"human_scores\":{\"annotator_a\":' || CAST(n_chars % 6 AS STRING)"
        " || CASE doc_id % 3 WHEN 0 THEN ',\"annotator_b\":null' WHEN 1 THEN '' ELSE ',\"annotator_b\":\"' || CAST(doc_id % 6 AS STRING) || '\"' END"
        " || '},\"notes\":\"' || source || '\"}' AS line",
    ),
)
SCORE_LINES = Derived(
    "documents",
    (
        "CAST(doc_id AS STRING) || ',' || CASE doc_id % 6 WHEN 0 THEN 'PARSE_FAILED' WHEN 1 THEN '' ELSE CAST(n_chars % 6 AS STRING) || '.5' END"
        " || ',' || CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END || ',False' AS line",
    ),
)

# One CSV file of documents whose texts hold quoted line breaks, as the lines of its splits; a record may cross splits.
BROKEN_TEXT = "replace(replace(text, '. ', '.' || chr(10)), ' e', ' \"e\"' || chr(10) || chr(10))"
SPLIT_LINES = Split("documents", "doc_id", f"CAST(doc_id AS STRING) || ',\"' || replace({BROKEN_TEXT}, '\"', '\"\"') || '\",' || lang || chr(13)", "\n", 4)

# One JSON document with a list of items, cut before its closing braces; strings hold braces, quotes and escapes.
_ITEM = (
    "'{\"case_id\": \"' || CAST(doc_id AS STRING) || '\", \"human_scores\": {\"annotator_a\": ' || CAST(n_chars % 6 AS STRING)"
    " || '}, \"notes\": \"' || source || '}, {' || chr(92) || '\"[' || chr(92) || chr(92) || '\"'"
)
SPLIT_ITEMS = Split("documents", "doc_id", f"',' || chr(10) || {_ITEM}", "[}]", 1)
ITEMS_BEFORE = ('{"made": "a', 'b{", "meta": {"items": [{"case_id": "no"', "]", ', "n": [1], "items": [{"case_id":"first"')
ITEMS_AFTER = ('], "pairs": [{"case_id":"p"', ', {"case_id": "q", "llm_score": 4', '], "items2": [{"case_id":"no"', "]", "\n")

# Turns of conversations, some of them followed by a phone number; the turn stands in for the phase.
TURNS = Derived(
    "conversations",
    (
        "conv_id",
        "CAST(turn AS STRING) AS role",
        "text || CASE WHEN (conv_id + turn) % 3 = 0 THEN ' bel 06-12345678' ELSE '' END AS line",
    ),
)

# Forbidden terms and a word limit per document.
OWN_LIMITS = Derived(
    "documents",
    (
        "doc_id",
        "lang",
        "text",
        "50 + doc_id % 200 AS max_words",
        "CASE doc_id % 4 WHEN 0 THEN 'the, OUE ,zz' WHEN 1 THEN '' WHEN 2 THEN 'der,que' ELSE 'ng' END"
        " AS no_go_terms",
    ),
)
