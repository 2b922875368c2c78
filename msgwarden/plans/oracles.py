"""The registered queries as SQL for DuckDB, written independently of the operators.

Its pattern engine treats letters beyond ASCII as boundaries. Wording checks therefore run on
a text in which such letters are replaced by ``_``, which occurs in none of the word lists.
"""

from __future__ import annotations

from ..functions import fixed_values as fixed
from ..operators.regression import EXACT_UP_TO, MOST_DRAWN, poisson_limits
from . import inputs as I


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _bsn(x: str, standard: bool = False) -> str:
    total = " + ".join(f"CAST(substr({x}, {i + 1}, 1) AS INT) * {9 - i}" for i in range(8))
    last, r = f"CAST(substr({x}, 9, 1) AS INT)", f"(({total}) % 11)"
    return f"{last} = {r}" if standard else f"{last} = CASE WHEN {r} < 2 THEN {r} ELSE 11 - {r} END"


PATTERNS = {label: (pattern, mask, "i" if ci else "c") for label, pattern, mask, ci in fixed.PII_PATTERNS}
TYPES = list(PATTERNS)
RANK = {t: i for i, t in enumerate(TYPES)}


def _found(t: str, text: str) -> str:
    pattern, _, flag = PATTERNS[t]
    found = f"regexp_extract_all({text}, {q(pattern)}, 0, '{flag}')"
    return f"list_filter({found}, lambda x: {_bsn('x')})" if t == "bsn" else found


def _counts(source: str, key: str, text: str) -> str:
    cols = ", ".join(f"CAST(len({_found(t, text)}) AS BIGINT) AS {t}" for t in TYPES)
    return f"SELECT {key}, {cols} FROM ({source})"


def _mask_steps(source: str, text: str, out: str = "masked_text") -> str:
    """The masking as nested subqueries, one type each, so that no text is repeated."""
    inner = f"SELECT *, {text} AS {out} FROM ({source})"
    for t in TYPES:
        pattern, mask, flag = PATTERNS[t]
        done = f"regexp_replace({out}, {q(pattern)}, {q(mask)}, 'g{flag}')"
        if t == "bsn":
            one = f"nullif(regexp_extract({out}, {q(pattern)}), '')"
            done = f"CASE WHEN {_bsn(one)} THEN {done} ELSE {out} END"
        inner = f"SELECT * REPLACE ({done} AS {out}) FROM ({inner})"
    return inner


def _hits(source: str, key: str, text: str) -> str:
    """key, type, rank, match, start, end of every match."""
    parts = []
    for t in TYPES:
        pattern, _, flag = PATTERNS[t]
        split = f"string_split_regex({text}, {q(('(?i)' if flag == 'i' else '') + pattern)})"
        parts.append(
            f"SELECT {key}, {q(t)} AS type, {RANK[t]} AS rank, m[k] AS match,"
            f" CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS start"
            f" FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS k FROM"
            f" (SELECT {key}, regexp_extract_all({text}, {q(pattern)}, 0, '{flag}') AS m, {split} AS g FROM ({source})) WHERE len(m) > 0)"
            + (f" WHERE {_bsn('m[k]')}" if t == "bsn" else "")
        )
    return " UNION ALL ".join(parts)


def _offsets(source: str, key: str, text: str) -> str:
    masks = " ".join(f"WHEN {q(t)} THEN {q(PATTERNS[t][1])}" for t in TYPES)
    return (
        f"SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY start, rank) - 1 AS pos, type, match,"
        f' start, start + length(match) AS "end", CASE type {masks} END AS mask FROM ({_hits(source, key, text)})'
    )


def _grouped(source: str, key: str, text: str) -> str:
    """key, type, matches in text order, first start, rank."""
    return (
        f"SELECT {key}, type, rank, min(start) AS first, count(*) AS n, string_agg(match, ',' ORDER BY start) AS matches"
        f" FROM ({_hits(source, key, text)}) GROUP BY {key}, type, rank"
    )


def _plain(text: str) -> str:
    return f"regexp_replace({text}, '[ªµºÀ-ÖØ-öø-ɏ]', '_', 'g')"


CONTACTS, MESSAGES = I.CONTACTS.sql, I.MESSAGES.sql
_SUMMARY = " || ".join(
    ["''"] + [f"CASE WHEN {t} > 0 THEN '; {t}=' || {t} ELSE '' END" for t in sorted(TYPES)]
)


def _nogo_rows(source: str, keys: str, text: str) -> str:
    parts = []
    for label, pattern, group, ci in fixed.NOGO_PATTERNS:
        flag = "i" if ci else "c"
        parts.append(
            f"SELECT {keys}, {q(label)} AS key, coalesce(unnest(regexp_extract_all({_plain(text)}, {q(pattern)}, {group}, '{flag}')), '') AS match"
            f" FROM ({source})"
        )
    return " UNION ALL ".join(parts)


def _nogo_n(text: str, labels: tuple[str, ...] | None = None) -> str:
    return " + ".join(
        f"len(regexp_extract_all({text}, {q(p)}, 0, '{'i' if ci else 'c'}'))"
        for label, p, _, ci in fixed.NOGO_PATTERNS
        if labels is None or label in labels
    )


def _cta(text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {q(p)}, 'i')" for p in fixed.CTA_PATTERNS) + ")"


_WORDS = r"len(regexp_extract_all({t}, '\S+'))"


def _cases(source: str, case_id: str, phase: str, text: str, limit: int | None, cta: bool = True, policy=None) -> str:
    """The flat row per case: case_id, phase, severity, counts and flags."""
    words = _WORDS.format(t=text)
    over = f"greatest(0, {words} - {limit})" if limit else "0"
    types = " + ".join(f"CAST(len({_found(t, text)}) > 0 AS INT)" for t in TYPES)
    base = (
        f"SELECT {case_id} AS case_id, {phase} AS phase, CAST({words} AS BIGINT) AS word_count,"
        f" CAST({over} AS BIGINT) AS over_by, CAST({types} AS BIGINT) AS pii_hits_total, w, {text} AS body"
        f" FROM (SELECT *, {_plain(text)} AS w FROM ({source}))"
    )
    flags = (
        f"SELECT * EXCLUDE (w), CAST({_nogo_n('w')} AS BIGINT) AS nogo_hits_total,"
        f" CAST({_nogo_n('w', policy)} AS BIGINT) AS policy, {_cta('w') if cta else 'true'} AS cta_present FROM ({base})"
    )
    return (
        "SELECT case_id, phase, CASE WHEN pii_hits_total > 0 OR policy > 0 OR NOT cta_present OR over_by > 0 THEN 'fail'"
        " WHEN nogo_hits_total > 0 THEN 'warn' ELSE 'pass' END AS severity, word_count, pii_hits_total, nogo_hits_total,"
        f" cta_present, true AS json_valid, over_by = 0 AS length_ok, over_by, policy, body FROM ({flags})"
    )


CASES = _cases(MESSAGES, "id", "phase", "expected_output", 120)
_FLAT = "case_id, phase, severity, word_count, pii_hits_total, nogo_hits_total, cta_present, json_valid, length_ok"


def _report(cases: str, by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {by + ',' if by else ''} count(*) AS total_cases,
      count(*) FILTER (severity = 'pass') AS passed, count(*) FILTER (severity = 'warn') AS warned,
      count(*) FILTER (severity = 'fail') AS failed, count(*) FILTER (NOT json_valid) AS json_invalid,
      CAST(sum(pii_hits_total) AS BIGINT) AS pii_hits_total, CAST(sum(nogo_hits_total) AS BIGINT) AS nogo_hits_total,
      count(*) FILTER (NOT cta_present) AS cta_missing, count(*) FILTER (NOT length_ok) AS length_violations,
      count(*) FILTER (pii_hits_total > 0) AS high_risk_leaks,
      round((count(*) - sum(pii_hits_total)) / count(*) * 100, 9) AS pii_clean_rate,
      (count(*) - sum(pii_hits_total)) / count(*) * 100 >= 95 AND count(*) FILTER (pii_hits_total > 0) = 0 AS accepted
      FROM ({cases}){group}"""


def _percentiles(source: str, value: str, by: str = "", points=(0.5, 0.95, 0.99)) -> str:
    head, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(
        f"SELECT {head}CAST({p} AS DOUBLE) AS point, round(quantile_cont({value}, {p}), 9) AS percentile FROM ({source}){group}"
        for p in points
    )


_CAUSES = f"""SELECT case_id, phase, 'pii:' || type AS cause FROM ({_grouped(MESSAGES, 'id', 'expected_output')}) h
  JOIN (SELECT case_id, phase FROM ({CASES})) c ON h.id = c.case_id
  UNION ALL SELECT id, phase, 'nogo:' || key FROM ({_nogo_rows(MESSAGES, 'id, phase', 'expected_output')})
  UNION ALL SELECT case_id, phase, 'cta:missing' FROM ({CASES}) WHERE NOT cta_present
  UNION ALL SELECT case_id, phase, 'length:over' FROM ({CASES}) WHERE NOT length_ok"""

# --- judge answers: every criterion read with JSON functions -----------------------------
CRITERIA = fixed.RUBRIC_WEIGHTS


def _judged(shift: str = "0", criteria=CRITERIA) -> str:
    read = []
    for i, (c, _) in enumerate(criteria):
        p = f"'$.{c}'"
        score = (
            f"CASE WHEN json_type(j, '$.{c}.score') IS NULL THEN 0.0"
            f" WHEN json_type(j, '$.{c}.score') = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$.{c}.score') AS DOUBLE)"
            f" WHEN json_type(j, '$.{c}.score') = 'BOOLEAN' THEN CAST(CAST(json_extract_string(j, '$.{c}.score') AS BOOLEAN) AS INT)"
            f" WHEN json_type(j, '$.{c}.score') IN ('NULL', 'OBJECT', 'ARRAY') THEN NULL"
            f" ELSE CAST(json_extract_string(j, '$.{c}.score') AS DOUBLE) END"
        )
        reason = (
            f"CASE WHEN json_type(j, '$.{c}.reason') = 'VARCHAR' THEN json_extract_string(j, '$.{c}.reason') END"
        )
        read.append(
            f"json_type(j, {p}) IS NOT NULL AS there{i}, CASE WHEN json_type(j, {p}) = 'OBJECT' THEN {score} END AS s{i}, {reason} AS r{i}"
        )
    one = (
        f"SELECT *, {', '.join(read)}, coalesce(json_type(j), '') AS what FROM"
        f" (SELECT *, CASE WHEN json_valid(answer) THEN CAST(answer AS JSON) END AS j FROM ({I.answers(shift).sql}))"
    )
    kept = []
    for i in range(len(criteria)):
        bad = " OR ".join(f"(there{k} AND s{k} IS NULL)" for k in range(i + 1))
        kept.append(f"(what = 'OBJECT' AND there{i} AND NOT ({bad})) AS k{i}")
    two = f"SELECT *, {', '.join(kept)} FROM ({one})"
    unexplained = " OR ".join(
        f"(k{i} AND coalesce(trim(r{i}) = '' OR r{i} = {q(fixed.DEFAULT_REASON)}, true))" for i in range(len(criteria))
    )
    total = " + ".join(["0.0e0"] + [f"CASE WHEN k{i} THEN s{i} * {w}e0 ELSE 0.0e0 END" for i, (_, w) in enumerate(criteria)])
    weight = " + ".join(["0.0e0"] + [f"CASE WHEN k{i} THEN {w}e0 ELSE 0.0e0 END" for i, (_, w) in enumerate(criteria)])
    failed = (
        "(what NOT IN ('OBJECT', 'ARRAY', 'VARCHAR') OR (what = 'OBJECT' AND json_exists(j, '$.error') AND json_exists(j, '$.parse_error'))"
        f" OR (what = 'VARCHAR' AND contains(answer, 'parse_error')) OR {unexplained})"
    )
    three = f"SELECT *, {failed} AS failed, {total} AS total, {weight} AS weight FROM ({two})"
    return f"""SELECT *, CASE WHEN NOT failed THEN CASE WHEN weight > 0 THEN total / weight ELSE 0.0 END END AS final,
      CASE WHEN failed THEN CASE WHEN what = 'OBJECT' AND json_exists(j, '$.error') AND json_exists(j, '$.parse_error')
      THEN coalesce(json_extract_string(j, '$.raw_response'), '') ELSE answer END ELSE '' END AS raw FROM ({three})"""


def _by_rubric() -> str:
    rows = "CASE WHEN lang = 'en' THEN 'v1' WHEN doc_id % 31 = 0 THEN 'none' ELSE 'v2' END"
    parts = []
    for version, criteria in (*I.RUBRICS.items(), ("none", I.RUBRICS["v1"])):
        unknown = version == "none"
        criteria = sorted(criteria, key=lambda c: (CRITERIA.index(c) if c in CRITERIA else [n for n, _ in CRITERIA].index(c[0]) if c[0] in dict(CRITERIA) else 99, c[0]))
        shown = " || ".join(["''"] + [f"CASE WHEN k{i} THEN ';' || '{c}=' || coalesce(r{i}, '') ELSE '' END" for i, (c, _) in enumerate(criteria)])
        raw = """CASE WHEN what = 'OBJECT' AND json_exists(j, '$.error') AND json_exists(j, '$.parse_error')
            THEN coalesce(json_extract_string(j, '$.raw_response'), '') ELSE answer END"""
        parts.append(f"""SELECT doc_id, '{version}' AS version, {"''" if unknown else f"CASE WHEN failed THEN '' ELSE ltrim({shown}, ';') END"} AS reasons,
          {'CAST(NULL AS DOUBLE)' if unknown else 'round(final, 9)'} AS final, {'false' if unknown else 'coalesce(final >= 3.5, false)'} AS passed,
          {'true' if unknown else 'failed'} AS failed_judge_parse, {raw if unknown else 'raw'} AS raw_response FROM ({_judged('0', criteria)}) WHERE {rows} = '{version}'""")
    return " UNION ALL ".join(parts)


def _long(shift: str = "0") -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, {q(c)} AS criterion, s{i} AS score, r{i} AS reason, CAST({w} AS DOUBLE) AS weight FROM ({_judged(shift)}) WHERE k{i} AND NOT failed"
        for i, (c, w) in enumerate(CRITERIA)
    )


def _run_summary(by: str = "") -> str:
    return f"""SELECT {by + ',' if by else ''} count(*) AS total_cases, count(*) FILTER (final >= 3.5) AS passed_cases,
      count(*) FILTER (failed) AS parse_failed_cases, round(coalesce(avg(final), 0), 9) AS average_score,
      round(count(*) FILTER (final >= 3.5) / count(*), 9) AS pass_rate, count(*) < 100 AS below_min_batch,
      count(*) >= 100 AND avg(final) >= 3.5 AS accepted FROM ({_judged()}){' GROUP BY ' + by if by else ''}"""


def _side(table: I.Derived, v: str) -> str:
    return f"""SELECT '{v}' AS variant, case_id, TRY_CAST(final_score AS DOUBLE) AS score, passed = 'True' AS passed,
      failed_judge_parse = 'True' AS failed, final_score FROM ({table.sql})"""


BOTH = f"{_side(I.SCORES_A, 'A')} UNION ALL {_side(I.SCORES_B, 'B')}"


def _compared(fails: str) -> str:
    cols = ", ".join(
        f"count(*) FILTER (variant = '{v}') AS rows_{v.lower()}, coalesce(avg(score) FILTER (variant = '{v}'), 0) AS avg_{v.lower()},"
        f" count(*) FILTER (variant = '{v}' AND score IS NOT NULL AND passed) AS passed_{v.lower()},"
        f" count(*) FILTER (variant = '{v}' AND failed {fails}) AS parse_failed_{v.lower()}"
        for v in "AB"
    )
    return f"""SELECT 'V1' AS name_a, 'V2' AS name_b, *, rows_a <> rows_b AS rows_differ, avg_b - avg_a AS score_improvement,
      CASE WHEN avg_a <> 0 THEN (avg_b - avg_a) / avg_a * 100 ELSE 0 END AS improvement_percentage,
      parse_failed_a - parse_failed_b AS parse_failure_delta,
      avg_b - avg_a >= 0.25 AND parse_failed_b <= parse_failed_a AS meets_promotion_threshold FROM (SELECT {cols} FROM ({BOTH}))"""


def _rounded(sql: str, *cols: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in cols)}) FROM ({sql})"


_BY_CASE = f"""SELECT case_id, score_a, score_b, score_b - score_a AS delta,
  CASE WHEN a.case_id IS NULL THEN 'only_b' WHEN b.case_id IS NULL THEN 'only_a' ELSE 'both' END AS found_in
  FROM (SELECT case_id, avg(score) AS score_a FROM ({_side(I.SCORES_A, 'A')}) GROUP BY case_id) a
  FULL JOIN (SELECT case_id, avg(score) AS score_b FROM ({_side(I.SCORES_B, 'B')}) GROUP BY case_id) b USING (case_id)"""


def _bootstrap(replicates: int, seed: int = 7) -> str:
    limits = poisson_limits()
    weight = " ".join(f"WHEN u < {x} THEN {k}" for k, x in enumerate(limits))
    part = "CAST('0x' || substr(m, {at}, 8) AS BIGINT) % 2147483647"
    return f"""SELECT replicate, CAST(sum(w) AS BIGINT) AS weight, round(sum(delta * w) / sum(w), 9) AS mean_delta FROM (
      SELECT replicate, delta, CASE {weight} ELSE {len(limits)} END AS w FROM (
        SELECT delta, r AS replicate, (h1 + r * h2) % 2147483647 AS u FROM (
          SELECT delta, {part.format(at=1)} AS h1, {part.format(at=9)} AS h2, unnest(range(1, {replicates + 1})) AS r FROM (
            SELECT delta, md5('{seed}|' || case_id) AS m FROM ({_BY_CASE}) WHERE delta IS NOT NULL)))) GROUP BY replicate"""


def _bootstrap_of_deltas(replicates: int, seed: int = 7) -> str:
    part = "CAST('0x' || substr(m, {at}, 8) AS BIGINT) % 2147483647"
    u = "(((h{a} + r * h{b}) % 2147483647) + 0.5e0) / 2147483647e0"
    return f"""WITH RECURSIVE g AS (SELECT CAST(round(delta * 1e9) AS BIGINT) AS d, count(*) AS n FROM ({_BY_CASE}) WHERE delta IS NOT NULL GROUP BY 1),
      h AS (SELECT d, n, {', '.join(f"{part.format(at=1 + 8 * i)} AS h{i}" for i in range(4))} FROM (SELECT *, md5('{seed}|' || d) AS m FROM g)),
      x AS (SELECT d, n, r, {u.format(a=0, b=1)} AS u, {u.format(a=2, b=3)} AS v FROM (SELECT *, unnest(range(1, {replicates + 1})) AS r FROM h)),
      c AS (SELECT n, 0 AS k, exp(-n::DOUBLE) AS p, exp(-n::DOUBLE) AS c FROM (SELECT DISTINCT n FROM g WHERE n <= {EXACT_UP_TO})
        UNION ALL SELECT n, k + 1, p * n / (k + 1), c + p * n / (k + 1) FROM c WHERE k < {MOST_DRAWN}),
      few AS (SELECT d, r, (SELECT count(*) FROM c WHERE c.n = x.n AND c.c <= x.u AND c.k < {MOST_DRAWN}) AS w FROM x WHERE n <= {EXACT_UP_TO}),
      z AS (SELECT d, r, n::DOUBLE AS n, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z FROM x WHERE n > {EXACT_UP_TO}),
      w AS (SELECT * FROM few UNION ALL SELECT d, r, greatest(0, CAST(floor(n + z * sqrt(n) + (z * z - 1) / 6 + (z - z * z * z) / (72 * sqrt(n)) + 0.5) AS BIGINT)) FROM z)
      SELECT r AS replicate, CAST(sum(w) AS BIGINT) AS weight, round(CASE WHEN sum(w) > 0 THEN sum(d / 1e9 * w) / sum(w) END, 9) AS mean_delta FROM w GROUP BY r"""


def _kappa(pairs: str) -> str:
    return f"""WITH p AS (SELECT CAST(round_even(a, 0) AS BIGINT) AS a, CAST(round_even(b, 0) AS BIGINT) AS b FROM ({pairs}) WHERE a IS NOT NULL AND b IS NOT NULL),
      t AS (SELECT count(*) AS n, count(*) FILTER (a = b) / count(*) AS po FROM p),
      e AS (SELECT sum(x.n * y.n) / (SELECT n * n FROM t) AS pe FROM (SELECT a, count(*) AS n FROM p GROUP BY a) x
        JOIN (SELECT b, count(*) AS n FROM p GROUP BY b) y ON x.a = y.b),
      l AS (SELECT string_agg(v, ',' ORDER BY CAST(v AS INT)) AS labels FROM (SELECT CAST(a AS STRING) AS v FROM p UNION SELECT CAST(b AS STRING) FROM p))
      SELECT 'ok' AS status, n AS n_pairs, labels, round(po, 9) AS observed_agreement, round(coalesce(pe, 0), 9) AS expected_agreement,
        round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - coalesce(pe, 0)) / (1 - coalesce(pe, 0)) END, 9) AS cohens_kappa,
        '>=0.60' AS target_kappa FROM t, e, l"""


_TWO_SCORES = """SELECT doc_id, lang, (doc_id * 7 + n_chars) % 11 * 5e-1 AS a,
  (doc_id * 7 + n_chars + doc_id % 3) % 11 * 5e-1 AS b FROM documents"""


def _fingerprint(cols: tuple[str, ...], by: str = "", table: str = "documents") -> str:
    parts = ", ".join(
        f"coalesce(CAST(length(CAST({c} AS STRING)) AS STRING) || ':' || CAST({c} AS STRING), '-')" for c in cols
    )
    sums = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS STRING)" for i in range(8))
    head = f"{by}, " if by else ""
    return f"""SELECT {head}count(*) AS n_rows, sha256(concat_ws('|', CAST(count(*) AS STRING), {sums})) AS fingerprint
      FROM (SELECT {head}sha256(concat_ws('|', {parts})) AS h FROM {table}){' GROUP BY ' + by if by else ''}"""


def _manifest(table: str) -> str:
    cols = ("doc_id", "text", "lang")
    return f"""SELECT 'documents' AS name, 'group' AS part, source AS key, n_rows AS n, fingerprint AS digest FROM ({_fingerprint(cols, 'source', table)})
      UNION ALL SELECT 'documents', 'all', NULL, n_rows, fingerprint FROM ({_fingerprint(cols, '', table)})"""


_OTHER = """(WITH k AS (SELECT doc_id, CASE WHEN doc_id % 401 = 3 THEN text || '!' ELSE text END AS text, lang, CASE source WHEN 'src3' THEN 'src03' ELSE source END AS source
  FROM documents WHERE doc_id % 503 <> 7) SELECT * FROM k UNION ALL SELECT * FROM k WHERE source = 'src5' AND doc_id % 2 = 0)"""
_CHANGE = "CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN o.n <> n.n OR o.digest <> n.digest THEN 'changed' END"


def _generated() -> str:
    return f"""SELECT doc_id, id AS case_id, phase, CASE WHEN doc_id % 29 = 0 THEN 'ERROR: ' || expected_output ELSE expected_output END AS expected_output FROM ({MESSAGES})"""


_USABLE = f"SELECT * FROM ({_generated()}) WHERE NOT starts_with(expected_output, 'ERROR:')"
_USABLE_CASES = _cases(_USABLE, "case_id", "phase", "expected_output", 120)
_HIT_LINE = I.LABELLED_LINES.sql
_OWN_TERMS = """list_filter(list_filter(list_transform(string_split(no_go_terms, ','), lambda t: lower(trim(t))), lambda t: t <> ''),
  lambda t: contains(lower(text), t))"""
_OWN = f"""SELECT c.*, o.terms FROM ({_cases(I.OWN_LIMITS.sql, 'doc_id', 'lang', 'text', None, cta=False)}) c
  JOIN (SELECT doc_id, {_OWN_TERMS} AS terms, greatest(0, {_WORDS.format(t='text')} - max_words) AS beyond FROM ({I.OWN_LIMITS.sql})) o
  ON c.case_id = o.doc_id"""
_OWN_SEVERITY = "CASE WHEN pii_hits_total > 0 OR nogo_hits_total + len(terms) > 0 OR beyond > 0 THEN 'fail' ELSE 'pass' END"
_B_UNEQUAL = f"SELECT * FROM ({I.SCORES_B.sql}) WHERE lang <> 'fr'"
_REPLY_ERRORS = """SELECT c_custkey, list_sort(list_filter([
    CASE WHEN j IS NULL THEN '$:json' END,
    CASE WHEN json_type(j) <> 'OBJECT' THEN '$:type' END,
    CASE WHEN obj AND NOT list_contains(json_keys(j), 'message') THEN '$:required:message' END,
    CASE WHEN obj AND NOT list_contains(json_keys(j), 'cta') THEN '$:required:cta' END,
    CASE WHEN obj AND NOT list_contains(json_keys(j), 'next_step') THEN '$:required:next_step' END,
    CASE WHEN obj AND len(list_filter(json_keys(j), lambda x: x NOT IN ('message', 'cta', 'next_step', 'tone'))) > 0 THEN '$:additionalProperties' END,
    CASE WHEN json_type(j, '$.message') <> 'VARCHAR' THEN '$.message:type' END,
    CASE WHEN json_type(j, '$.message') = 'VARCHAR' AND length(json_extract_string(j, '$.message')) < 10 THEN '$.message:minLength' END,
    CASE WHEN json_type(j, '$.message') = 'VARCHAR' AND length(json_extract_string(j, '$.message')) > 150 THEN '$.message:maxLength' END,
    CASE WHEN json_type(j, '$.cta') <> 'VARCHAR' THEN '$.cta:type' END,
    CASE WHEN json_type(j, '$.cta') = 'VARCHAR' AND length(json_extract_string(j, '$.cta')) > 50 THEN '$.cta:maxLength' END,
    CASE WHEN json_type(j, '$.next_step') <> 'VARCHAR' THEN '$.next_step:type' END,
    CASE WHEN NOT (json_type(j, '$.next_step') = 'VARCHAR' AND json_extract_string(j, '$.next_step') IN ('propose_times', 'await_reply', 'handover')) THEN '$.next_step:enum' END,
    CASE WHEN json_type(j, '$.tone') <> 'VARCHAR' THEN '$.tone:type' END,
    CASE WHEN NOT (json_type(j, '$.tone') = 'VARCHAR' AND json_extract_string(j, '$.tone') IN ('formal', 'professional', 'friendly')) THEN '$.tone:enum' END
  ], lambda x: x IS NOT NULL)) AS errors FROM (SELECT *, json_type(j) = 'OBJECT' AS obj FROM
    (SELECT *, CASE WHEN json_valid(reply) THEN CAST(reply AS JSON) END AS j FROM (""" + I.REPLIES.sql + ")))"
_CUT = "CASE WHEN length({t}) > 100 THEN substr({t}, 1, 100) || '...' ELSE {t} END"

SQL: dict[str, str] = {
    "pii_counts": _counts("SELECT doc_id, text FROM documents", "doc_id", "text"),
    "pii_counts_contacts": _counts(CONTACTS, "o_orderkey", "line"),
    "pii_summary_map": f"SELECT o_orderkey, substr({_SUMMARY}, 3) AS pii_summary FROM ({_counts(CONTACTS, 'o_orderkey', 'line')})",
    "pii_totals": "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT (SELECT count(*) FROM documents) AS total_rows, {q(t)} AS type, CAST(sum({t}) AS BIGINT) AS matches FROM ({_counts('SELECT doc_id, text FROM documents', 'doc_id', 'text')})"
        for t in TYPES
    )
    + ") WHERE matches > 0",
    "pii_totals_contacts": f"SELECT total_rows, substr({_SUMMARY}, 3) AS pii_matches FROM (SELECT count(*) AS total_rows, "
    + ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t in TYPES)
    + f" FROM ({_counts(CONTACTS, 'o_orderkey', 'line')}))",
    "pii_offsets": _offsets("SELECT doc_id, text FROM documents", "doc_id", "text"),
    "pii_offsets_contacts": _offsets(CONTACTS, "o_orderkey", "line"),
    "pii_check_contacts": f"""SELECT o_orderkey, count(*) = 0 AS passed,
      string_agg('PII ' || type || ' gevonden: ' || n || ' instances', '; ' ORDER BY first, rank) AS violations,
      string_agg(type || '=' || matches, '; ' ORDER BY first, rank) AS found, CAST(sum(n) AS BIGINT) AS total_instances
      FROM ({_grouped(CONTACTS, 'o_orderkey', 'line')}) GROUP BY o_orderkey""",
    "pii_check_masks": f"""SELECT doc_id, masked_text = text AS passed, masked_text
      FROM ({_mask_steps('SELECT doc_id, text FROM documents', 'text')})""",
    "pii_mask": f"SELECT doc_id, masked_text FROM ({_mask_steps('SELECT doc_id, text FROM documents', 'text')})",
    "pii_mask_contacts": f"SELECT o_orderkey, masked_text FROM ({_mask_steps(CONTACTS, 'line')})",
    "pii_mask_spliced": f"SELECT doc_id, masked_text FROM ({_mask_steps('SELECT doc_id, text FROM documents', 'text')})",
    "bsn_checksum": f"""SELECT o_orderkey, number, {_bsn('number')} AS valid, {_bsn('number', True)} AS valid_standard
      FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 % 1000000000 AS STRING), 9, '0') AS number FROM orders)""",
    "pii_hit_rate": f"""SELECT pii_type, count(*) AS n, count(*) FILTER (masked_text = expected_mask) AS exact,
      round(count(*) FILTER (masked_text = expected_mask) / count(*), 9) AS rate FROM ({_mask_steps(_HIT_LINE, 'line')}) GROUP BY pii_type""",
    "deep_mask": f"""SELECT o_orderkey, masked_text AS note, o_custkey AS customer, masked_text AS "inner",
      line = masked_text AS plain_masked FROM ({_mask_steps(CONTACTS, 'line')})""",
    "preview": f"SELECT doc_id, {_CUT.format(t='masked_text')} AS preview FROM ({_mask_steps('SELECT doc_id, text FROM documents', 'text')})",
    "preview_cut_first": f"""SELECT doc_id, masked_text AS preview FROM ({_mask_steps(f"SELECT doc_id, {_CUT.format(t='text')} AS cut FROM documents", 'cut')})""",
    "nogo_hits": f"SELECT doc_id, key, match, count(*) AS n FROM ({_nogo_rows(MESSAGES, 'doc_id', 'expected_output')}) GROUP BY ALL",
    "nogo_documents": f"""SELECT lang, count(*) FILTER (n > 0) AS texts, CAST(sum(n) AS BIGINT) AS hits FROM
      (SELECT lang, {_nogo_n('w')} AS n FROM (SELECT lang, {_plain('text')} AS w FROM documents)) GROUP BY lang""",
    "nogo_violations": f"""SELECT 'No-go token ''' || key || ''' gevonden: ' || match AS violation, count(*) AS n
      FROM ({_nogo_rows(MESSAGES, 'doc_id', 'expected_output')}) GROUP BY ALL""",
    "cta_rate": f"""SELECT phase, count(*) AS n, count(*) FILTER ({_cta('w')}) AS with_cta FROM
      (SELECT phase, {_plain('expected_output')} AS w FROM ({MESSAGES})) GROUP BY phase""",
    "cta_matched": " UNION ALL ".join(
        f"SELECT {q(p)} AS pattern, count(*) AS n FROM (SELECT {_plain('expected_output')} AS w FROM ({MESSAGES})) WHERE regexp_matches(w, {q(p)}, 'i') HAVING count(*) > 0"
        for p in fixed.CTA_PATTERNS
    ),
    "cta_conversations": f"""SELECT role, count(*) AS n, count(*) FILTER ({_cta('w')}) AS with_cta FROM
      (SELECT role, {_plain('text')} AS w FROM conversations) GROUP BY role""",
    "word_limit": f"""SELECT doc_id, n <= 300 AS passed, CASE WHEN n > 300 THEN 'Tekst heeft ' || n || ' woorden, max 300' ELSE '' END AS violations,
      CAST(n AS BIGINT) AS word_count, CAST(greatest(0, n - 300) AS BIGINT) AS over_by FROM (SELECT doc_id, {_WORDS.format(t='text')} AS n FROM documents)""",
    "own_limits": f"""SELECT doc_id, CAST(greatest(0, {_WORDS.format(t='text')} - max_words) AS BIGINT) AS over_by,
      array_to_string(list_filter(list_filter(list_transform(string_split(no_go_terms, ','), lambda t: lower(trim(t))), lambda t: t <> ''), lambda t: contains(lower(text), t)), ',') AS terms
      FROM ({I.OWN_LIMITS.sql})""",
    "style_rates": """SELECT lang, count(*) AS n, round(avg(CAST(regexp_matches(text, '```') AS INT)), 9) AS code_fence,
      round(avg(CAST(regexp_matches(text, '[!?]{2,}') AS INT)), 9) AS doubled_mark,
      round(avg(CAST(regexp_matches(text, '[0-9]{3}') AS INT)), 9) AS digits FROM documents GROUP BY lang""",
    "json_props": """SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props) AND json_type(props) = 'OBJECT'
      AND json_keys(props) = ['k'] AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')) AS valid FROM events GROUP BY event_type""",
    "json_schema": f"SELECT c_custkey, len(errors) = 0 AS passed, array_to_string(errors, '; ') AS errors FROM ({_REPLY_ERRORS})",
    "case_check": f"""SELECT c.case_id, phase, 'text' AS output_mode, word_count, json_valid, length_ok, over_by AS length_over_by,
      nogo_hits_total AS nogo_hits, coalesce(h.pii_hits, '') AS pii_hits, cta_present, policy AS policy_claims, severity FROM ({CASES}) c
      LEFT JOIN (SELECT id, string_agg(type || '=' || matches, '; ' ORDER BY first, rank) AS pii_hits
        FROM ({_grouped(MESSAGES, 'id', 'expected_output')}) GROUP BY id) h ON h.id = c.case_id""",
    "case_check_own_terms": f"""SELECT case_id, CAST(beyond AS BIGINT) AS length_over_by, array_to_string(terms, ',') AS terms,
      CAST(nogo_hits_total + len(terms) AS BIGINT) AS policy_claims, {_OWN_SEVERITY} AS severity FROM ({_OWN.replace("o.terms", "o.terms, o.beyond")})""",
    "case_summary_own_terms": f"""SELECT case_id, CAST(nogo_hits_total + len(terms) AS BIGINT) AS nogo_hits_total, {_OWN_SEVERITY} AS severity
      FROM ({_OWN.replace("o.terms", "o.terms, o.beyond")})""",
    "case_summary": f"SELECT {_FLAT} FROM ({CASES})",
    "case_summary_from_record": f"SELECT {_FLAT} FROM ({CASES})",
    "severity_with_policy_labels": "SELECT severity, count(*) AS n FROM ("
    + _cases(MESSAGES, "id", "phase", "expected_output", None, policy=("garantie", "garanderen", "we_beloven"))
    + ") GROUP BY severity",
    "severity_by_lang": f"SELECT phase, severity, count(*) AS n FROM ({_cases('SELECT doc_id, lang, text FROM documents', 'doc_id', 'lang', 'text', None, cta=False)}) GROUP BY ALL",
    "batch_report": _report(CASES),
    "batch_report_by_phase": _report(CASES, "phase"),
    "percentiles_overall": _percentiles("SELECT value FROM events", "value"),
    "percentiles_by_type": _percentiles("SELECT event_type, value FROM events", "value", "event_type"),
    "percentiles_from_brackets": _percentiles("SELECT event_type, value FROM events", "value", "event_type"),
    "word_count_percentiles": _percentiles(f"SELECT lang, {_WORDS.format(t='text')} AS words FROM documents", "words", "lang"),
    "split_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "top_causes": f"SELECT cause, count(*) AS n FROM ({_CAUSES}) GROUP BY cause ORDER BY n DESC, cause LIMIT 8",
    "causes_by_phase": f"""SELECT cause, phase, count(*) AS n FROM ({_CAUSES}) WHERE cause IN
      (SELECT cause FROM ({_CAUSES}) GROUP BY cause ORDER BY count(*) DESC, cause LIMIT 5) GROUP BY ALL""",
    "prompt_column": "SELECT doc_id, 'INPUT:' || chr(10) || text || ' ' || lang || chr(10) || 'OUTPUT:' || chr(10) || text || chr(10) || 'JSON: {\"a\": {}}' AS prompt FROM documents",
    "judge_scores": _long(),
    "judge_results": f"""SELECT doc_id, round(final, 9) AS weighted_final_score, coalesce(final >= 3.5, false) AS passed,
      failed AS failed_judge_parse, raw AS raw_response FROM ({_judged()})""",
    "judge_report": "SELECT doc_id, round(final, 9) AS final_score, coalesce(final >= 3.5, false) AS passed, failed AS failed_judge_parse, CASE WHEN failed THEN substr(raw, 1, 500) END AS raw_response, "
    + ", ".join(f"CASE WHEN k{i} AND NOT failed THEN s{i} END AS {c}_score, CASE WHEN k{i} AND NOT failed THEN r{i} END AS {c}_reason" for i, (c, _) in enumerate(CRITERIA))
    + f" FROM ({_judged()})",
    "judge_by_rubric": _by_rubric(),
    "rule_table_hits": """WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
        p AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)),
        l AS (SELECT a, b, CASE WHEN length(a) >= length(b) THEN a ELSE b END AS literal FROM p),
        r AS (SELECT a || ' ' || b AS rule, a || '[ ]' || b AS pattern, literal FROM l UNION ALL SELECT b || ', ' || a, b || ',[ ]' || a, literal FROM l),
        d AS (SELECT doc_id, lower(text) AS text, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS literal FROM documents)
      SELECT doc_id, rule, n FROM (SELECT doc_id, rule, CAST(len(regexp_extract_all(text, pattern)) AS BIGINT) AS n FROM d JOIN r USING (literal)
        WHERE contains(text, rule)) WHERE n > 0""",
    "judge_summary": _run_summary("lang"),
    "judge_acceptance": _run_summary(),
    "score_histogram": f"SELECT criterion, CAST(floor(score) AS BIGINT) AS bucket, count(*) AS n FROM ({_long()}) GROUP BY ALL",
    "run_records": f"""SELECT '1' AS run_id, 'V1' AS variant, total_cases, passed_cases, parse_failed_cases, average_score,
      'batch_evaluation,variant_V1,run_1,completed,pass_rate_' || passed_cases || '/' || total_cases AS tags,
      'abc' AS dataset_sha256, CAST(5 AS BIGINT) AS duration_ms FROM ({_run_summary()})""",
    "case_run_records": f"""SELECT 'run_1' AS run_id, CAST(m.doc_id AS STRING) AS case_id, {_CUT.format(t='d.masked_text')} AS input_preview,
      {_CUT.format(t='m.masked_text')} AS output_preview, round(final, 9) AS final_score, coalesce(final >= 3.5, false) AS passed,
      CASE WHEN final <> 0 THEN 'completed,score' ELSE 'completed,score_failed' END AS tags
      FROM ({_mask_steps(MESSAGES, 'expected_output')}) m JOIN ({_judged()}) j ON m.doc_id = j.doc_id
      JOIN ({_mask_steps('SELECT doc_id, text FROM documents', 'text')}) d ON m.doc_id = d.doc_id""",
    "run_log": """SELECT 'run_' || o_orderkey AS run_id, 'V' || (o_orderkey % 3) AS variant, o_custkey % 20 AS parse_failed,
      round((o_orderkey % 50) / 10, 9) AS avg_score, 'cases_' || o_custkey AS dataset FROM orders""",
    "gate_passed": f"SELECT case_id, phase FROM ({_USABLE_CASES}) WHERE pii_hits_total = 0",
    "gate_skipped": f"SELECT case_id, phase, 'PII' AS reason FROM ({_USABLE_CASES}) WHERE pii_hits_total > 0",
    "gate_in_one_pass": f"SELECT case_id, phase, CASE WHEN pii_hits_total > 0 THEN 'PII' END AS reason FROM ({_USABLE_CASES})",
    "gate_of_stored_checks": f"""SELECT case_id, phase, CAST(case_id AS BIGINT) AS doc_id, severity, CASE WHEN pii_hits_total > 0 THEN 'PII' END AS reason
      FROM ({_USABLE_CASES})""",
    "gate_json_in_one_pass": f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {' OR '.join(f"len({_found(t, 'reply')}) > 0" for t in TYPES)} THEN 'PII'
      WHEN len(errors) > 0 THEN 'JSON-invalid' END AS reason FROM ({I.REPLIES.sql}) r JOIN ({_REPLY_ERRORS}) e USING (c_custkey)) GROUP BY reason""",
    "gate_of_repeated_checks": f"""WITH t AS (SELECT conv_id, CAST(role AS BIGINT) AS turn, {' OR '.join(f"len({_found(t, 'line')}) > 0" for t in TYPES)} AS fails FROM ({I.TURNS.sql}))
      SELECT rule, case_id, 'PII' AS reason FROM (SELECT 'last' AS rule, conv_id AS case_id, max_by(fails, turn) AS fails FROM t GROUP BY conv_id
      UNION ALL SELECT 'any', conv_id, max(fails) FROM t GROUP BY conv_id) WHERE fails""",
    "gate_json_mode": f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {' OR '.join(f"len({_found(t, 'reply')}) > 0" for t in TYPES)} THEN 'PII'
      WHEN len(errors) > 0 THEN 'JSON-invalid' END AS reason FROM ({I.REPLIES.sql}) r JOIN ({_REPLY_ERRORS}) e USING (c_custkey)) WHERE reason IS NOT NULL GROUP BY reason""",
    "first_cases": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5",
    "regression_all": _rounded(_compared(""), "avg_a", "avg_b", "score_improvement", "improvement_percentage"),
    "regression_usable": _rounded(_compared("AND score IS NOT NULL"), "avg_a", "avg_b", "score_improvement", "improvement_percentage"),
    "regression_record": f"""SELECT 'documents' AS path, name_a, round_even(avg_a, 3) AS avg_a, round_even(avg_b, 3) AS avg_b,
      round_even(score_improvement, 3) AS score_improvement, round_even(improvement_percentage, 2) AS improvement_percentage,
      parse_failure_delta, meets_promotion_threshold FROM ({_compared('')})""",
    "regression_by_case": _rounded(_BY_CASE, "score_a", "score_b", "delta"),
    "regression_of_unequal_sides": _rounded(
        _BY_CASE.replace(f"FROM ({_side(I.SCORES_B, 'B')})", f"FROM ({_side(I.SCORES_B, 'B')}) WHERE case_id IN (SELECT case_id FROM ({_B_UNEQUAL}))"),
        "score_a", "score_b", "delta",
    ),
    "regression_scores": f"SELECT variant, case_id, score, passed FROM ({BOTH}) WHERE score IS NOT NULL",
    "regression_by_criterion": f"""SELECT criterion, round(avg(score) FILTER (v = 'A'), 9) AS avg_a, round(avg(score) FILTER (v = 'B'), 9) AS avg_b,
      round(avg(score) FILTER (v = 'B') - avg(score) FILTER (v = 'A'), 9) AS delta FROM
      (SELECT 'A' AS v, * FROM ({_long('0')}) UNION ALL SELECT 'B', * FROM ({_long('1')})) GROUP BY criterion""",
    "regression_medians": _percentiles(f"SELECT variant, score FROM ({BOTH}) WHERE score IS NOT NULL", "score", "variant", (0.5,)),
    "regression_bootstrap": _bootstrap(50),
    "bootstrap_of_deltas": _bootstrap_of_deltas(50),
    "run_deltas": f"""SELECT round((b.p - a.p), 9) AS pass_rate_delta, round(b.s - a.s, 9) AS average_score_delta, b.f - a.f AS parse_failed_cases_delta FROM
      (SELECT count(*) FILTER (passed) / count(*) AS p, avg(score) AS s, count(*) FILTER (failed) AS f FROM ({BOTH}) WHERE variant = 'A') a,
      (SELECT count(*) FILTER (passed) / count(*) AS p, avg(score) AS s, count(*) FILTER (failed) AS f FROM ({BOTH}) WHERE variant = 'B') b""",
    "policy_not_worse": f"""SELECT b.l - a.l AS high_risk_leaks_delta, b.n - a.n AS nogo_hits_total_delta, b.l <= a.l AND b.n <= a.n AS not_worse FROM
      (SELECT count(*) FILTER (pii_hits_total > 0) AS l, CAST(sum(nogo_hits_total) AS BIGINT) AS n FROM ({_cases('SELECT doc_id, lang, text FROM documents', 'doc_id', 'lang', 'text', None, cta=False)})) a,
      (SELECT count(*) FILTER (pii_hits_total > 0) AS l, CAST(sum(nogo_hits_total) AS BIGINT) AS n FROM ({CASES})) b""",
    "promotion_verdict": f"""SELECT rows_a, rows_b, rows_a <> rows_b AS rows_differ, fa - fb AS parse_failure_delta,
      avg_b - avg_a >= 0.25 AND fb <= fa AS meets_promotion_threshold, not_worse, avg_b - avg_a >= 0.25 AND fb <= fa AND not_worse AS promote FROM
      (SELECT count(*) FILTER (variant = 'A') AS rows_a, count(*) FILTER (variant = 'B') AS rows_b, avg(score) FILTER (variant = 'A') AS avg_a,
        avg(score) FILTER (variant = 'B') AS avg_b, count(*) FILTER (variant = 'A' AND failed) AS fa, count(*) FILTER (variant = 'B' AND failed) AS fb
        FROM ({BOTH}) WHERE variant = 'A' OR case_id IN (SELECT case_id FROM ({_B_UNEQUAL}))),
      (SELECT b.l <= a.l AND b.n <= a.n AS not_worse FROM
        (SELECT count(*) FILTER (pii_hits_total > 0) AS l, sum(nogo_hits_total) AS n FROM ({_cases(MESSAGES, 'id', 'phase', 'expected_output', None, cta=False)})) a,
        (SELECT count(*) FILTER (pii_hits_total > 0) AS l, sum(nogo_hits_total) AS n FROM ({_cases('SELECT doc_id, lang, text FROM documents', 'doc_id', 'lang', 'text', None, cta=False)})) b)""",
    "variant_names": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'V' || (o_orderkey % 7) ELSE 'A' END AS variant FROM orders",
    "kappa": _kappa("SELECT quality AS a, toxic AS b FROM labels"),
    "kappa_against_rule": _kappa("SELECT toxic AS a, CAST(contains(text, '!!') AS INT) AS b FROM labels JOIN documents USING (doc_id)"),
    "kappa_scores": _kappa(_TWO_SCORES),
    "kappa_with_gaps": _kappa(f"SELECT CASE WHEN doc_id % 5 > 0 THEN a END AS a, CASE WHEN doc_id % 7 > 1 THEN b END AS b FROM ({_TWO_SCORES})"),
    "kappa_of_too_few": f"""SELECT 'insufficient' AS status, count(*) AS n_pairs, CAST(NULL AS STRING) AS labels, CAST(NULL AS DOUBLE) AS observed_agreement,
      CAST(NULL AS DOUBLE) AS expected_agreement, CAST(NULL AS DOUBLE) AS cohens_kappa, '>=0.60' AS target_kappa FROM ({_TWO_SCORES}) WHERE doc_id % 50 = 3""",
    "confusion_counts": f"SELECT CAST(round_even(a, 0) AS BIGINT) AS label_a, CAST(round_even(b, 0) AS BIGINT) AS label_b, count(*) AS n FROM ({_TWO_SCORES}) GROUP BY ALL",
    "label_space": f"SELECT CAST(round_even(a, 0) AS BIGINT) AS label FROM ({_TWO_SCORES}) UNION SELECT CAST(round_even(b, 0) AS BIGINT) FROM ({_TWO_SCORES})",
    "within_one": f"""SELECT lang, count(*) AS n_pairs, round(avg(CAST(abs(a - b) <= 1 AS INT)), 9) AS within_one,
      round(avg(abs(a - b)), 9) AS mae FROM ({_TWO_SCORES}) GROUP BY lang""",
    "calibration": f"""SELECT criterion, count(*) AS n_pairs, round(avg(CAST(abs(a.score - b.score) <= 1 AS INT)), 9) AS within_one,
      round(avg(abs(a.score - b.score)), 9) AS mae FROM ({_long('0')}) a JOIN ({_long('2')}) b USING (doc_id, criterion) GROUP BY criterion""",
    "review_sample": f"""SELECT a.case_id, a.final_score AS score_a, b.final_score AS score_b, a.passed AS passed_a, b.failed_judge_parse AS failed_b
      FROM ({I.SCORES_A.sql}) a JOIN ({I.SCORES_B.sql}) b USING (case_id) ORDER BY md5('7|' || a.case_id), a.case_id LIMIT 30""",
    "row_fingerprint": _fingerprint(("doc_id", "text", "lang")),
    "row_fingerprint_by_lang": _fingerprint(("doc_id", "text"), "lang"),
    "manifest_rows": _manifest("documents"),
    "manifest_changes": f"""SELECT coalesce(o.name, n.name) AS name, coalesce(o.part, n.part) AS part, coalesce(o.key, n.key) AS key, {_CHANGE} AS change,
      o.n AS n_old, n.n AS n_new FROM ({_manifest('documents')}) o FULL JOIN ({_manifest(_OTHER)}) n
      ON o.name = n.name AND o.part = n.part AND o.key IS NOT DISTINCT FROM n.key WHERE {_CHANGE} IS NOT NULL""",
    "freeze_manifest_counts": """SELECT 'documents' AS name, '2025-01-01T00:00:00Z' AS frozen_at, CAST(sum(n) AS BIGINT) AS n_rows,
      string_agg(lang || '=' || n, '; ' ORDER BY lang) AS split FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""",
    "lines_of_cases": """SELECT CAST(doc_id AS STRING) AS id, lang AS phase, lang || ', "' || source || '"' AS input, 'out ' || source AS expected_output,
      CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id % 90 AS INT) END AS max_words, 'a,b' AS no_go_terms FROM documents""",
    "lines_of_frozen_cases": """SELECT CAST(doc_id AS STRING) AS id, lang AS phase, CAST(NULL AS STRING) AS input, CAST(NULL AS STRING) AS expected_output,
      CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 90 AS INT) END AS max_words, 'x,y' AS no_go_terms FROM documents""",
    "lines_of_annotations": """SELECT CAST(doc_id AS STRING) AS case_id, CAST(n_chars % 6 AS DOUBLE) AS annotator_a,
      CASE WHEN doc_id % 3 = 2 THEN CAST(doc_id % 6 AS DOUBLE) END AS annotator_b, source AS notes FROM documents""",
    "records_of_split_lines": f"SELECT doc_id, {I.BROKEN_TEXT} AS text, lang FROM documents",
    "items_of_split_document": """SELECT CAST(doc_id AS STRING) AS case_id, CAST(n_chars % 6 AS DOUBLE) AS annotator_a, source || '}, {"[' || chr(92) AS notes FROM documents
      UNION ALL SELECT 'first', NULL, NULL""",
    "pairs_of_split_document": """SELECT 'p' AS case_id, CAST(NULL AS DOUBLE) AS llm_score, CAST(NULL AS DOUBLE) AS human_score UNION ALL SELECT 'q', 4.0e0, NULL""",
    "lines_of_scores": """SELECT CAST(doc_id AS STRING) AS case_id, CASE doc_id % 6 WHEN 0 THEN 'PARSE_FAILED' WHEN 1 THEN NULL ELSE (n_chars % 6) || '.5' END AS final_score,
      CASE WHEN doc_id % 6 > 1 THEN n_chars % 6 + 0.5e0 END AS score, CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END AS passed FROM documents""",
    "rows_of_score_files": f"""SELECT doc_id, CASE WHEN failed THEN 'PARSE_FAILED' ELSE 'number' END AS final_score, CASE WHEN NOT failed THEN round(final, 9) END AS score,
      coalesce(final >= 3.5, false) AS passed FROM ({_judged()})""",
    "rows_of_summary_files": f"""SELECT case_id || ',' || severity || ',' || word_count || ',' || pii_hits_total || ',' || cta_present || ',' || length_ok AS record
      FROM ({CASES})""",
    "rows_of_nested_files": f"SELECT case_id, cta_present, CAST(over_by AS BIGINT) AS length_over_by, severity FROM ({CASES})",
    "rows_of_agreement_files": f"""SELECT n_pairs, labels, observed_agreement, cohens_kappa, {q(fixed.TARGET_AGREEMENT)} AS target_agreement, false AS has_status FROM ({_kappa(_TWO_SCORES)})""",
    "run_table_deltas": f"""SELECT b.n - a.n AS total_cases_delta, b.p - a.p AS passed_cases_delta, b.f - a.f AS parse_failed_cases_delta, round(b.s - a.s, 9) AS average_score_delta
      FROM (SELECT count(*) AS n, count(*) FILTER (final >= 3.5) AS p, count(*) FILTER (failed) AS f, coalesce(avg(final), 0) AS s FROM ({_judged('0')})) a,
        (SELECT count(*) AS n, count(*) FILTER (final >= 3.5) AS p, count(*) FILTER (failed) AS f, coalesce(avg(final), 0) AS s FROM ({_judged('1')})) b""",
    "rows_of_regression_files": f"""SELECT name_a, round_even(avg_b, 3) AS avg_b, parse_failure_delta, meets_promotion_threshold FROM ({_compared('')})""",
    "judge_inputs": "SELECT CAST(doc_id AS STRING) AS id, '' AS input, md5(text) AS output_md5 FROM documents",
}
