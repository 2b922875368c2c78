"""Checks of message texts: personal data, wording, call to action, length and JSON.

Everything here is a projection: one pass over the text column, no shuffle. The columns are
built in steps (facts, matches, checks) so that each search runs once per row however many
results are derived from it, and later filters on the results do not run the searches again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import jsoncheck, pii, rules as R, wording
from ..functions.barrier import settled
from ..functions.sqltext import total


@dataclass(frozen=True)
class CheckSettings:
    """What to check. The defaults give the plain-text check without a length limit.

    ``max_words`` is a number for the whole run, or a column name for a limit per row.
    ``policy_labels`` names the forbidden-wording rules that count as policy claims; None
    means all of them, which makes every such hit a failure. ``terms`` names a column with a
    row's own forbidden terms (comma list); each that occurs is a hit with the key ``own_term``,
    and a policy claim when ``own_term`` is among the policy labels or these are None.
    """

    max_words: int | str | None = None
    json_schema: dict | None = None
    cta_required: bool = True
    output_mode: str = "text"
    policy_labels: tuple[str, ...] | None = None
    terms: str | None = None
    bsn_rule: str = "reference"
    pii_rules: tuple[R.Rule, ...] = field(default=R.PII_RULES)
    nogo_rules: tuple[R.Rule, ...] = field(default=R.NOGO_RULES)
    cta_rules: tuple[R.Rule, ...] = field(default=R.CTA_RULES)


def with_scan(df: DataFrame, text: str) -> tuple[DataFrame, R.Scan]:
    """The frame with the helper columns the searches share, and the scan over them."""
    return df.withColumns(R.scan_facts(text)), R.Scan(text)


#: Key of a hit of a row's own forbidden terms.
OWN_TERM = "own_term"


def _row_columns(settings: CheckSettings) -> list[Column]:
    """Columns that hold a limit or terms per row."""
    named = (settings.max_words if isinstance(settings.max_words, str) else None, settings.terms)
    return [F.col(c) for c in dict.fromkeys(c for c in named if c is not None)]


def _with_own_terms(df: DataFrame, terms: str) -> DataFrame:
    lowered = df.withColumn("__lower", F.lower("__text"))
    return lowered.withColumn("__own", wording.term_hits(F.col("__lower"), F.col(terms), lowered=True)).drop("__lower")


def without_scan(df: DataFrame) -> DataFrame:
    return df.drop(*R.SCAN_COLUMNS)


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({column: F.expr(e) for column, e in columns.items()})


def pii_counts(df: DataFrame, text: str, settings: CheckSettings = CheckSettings()) -> DataFrame:
    """The frame with one integer column per personal-data type."""
    df, scan = with_scan(df, text)
    counts = {r.label: F.expr(pii.type_count(scan, r, settings.bsn_rule)) for r in settings.pii_rules}
    return without_scan(df.withColumns(counts))


def pii_summary(df: DataFrame, text: str, settings: CheckSettings = CheckSettings()) -> DataFrame:
    """The frame with ``pii_summary``, the ``map<type, n>`` of the types that occur."""
    labels = [r.label for r in settings.pii_rules]
    counted = pii_counts(df, text, settings)
    return counted.withColumn("pii_summary", pii.count_map(labels)).drop(*labels)


def pii_hits(df: DataFrame, text: str, settings: CheckSettings = CheckSettings()) -> DataFrame:
    """The frame with ``hits``: every match with its offsets, ordered."""
    df, scan = with_scan(df, text)
    labels = [r.label for r in settings.pii_rules]
    found = {t: f"__pii_{t}" for t in labels}
    gaps = {t: f"__gap_{t}" for t in labels}
    df = _with(df, {found[r.label]: scan.matches(r) for r in settings.pii_rules})
    df = _with(df, {gaps[r.label]: pii.type_gaps(scan, r, found[r.label]) for r in settings.pii_rules})
    hits = pii.hit_list(found, gaps, settings.pii_rules, settings.bsn_rule)
    df = without_scan(_with(df, {"hits": hits})).drop(*found.values(), *gaps.values())
    return settled(df, ["hits"])


def pii_hits_long(
    df: DataFrame, keys: list[str], text: str, settings: CheckSettings = CheckSettings()
) -> DataFrame:
    """One row per match: the keys, position in the list, type, match, start, end, mask."""
    listed = pii_hits(df.select(*keys, text), text, settings)
    exploded = listed.select(*keys, F.posexplode("hits").alias("pos", "hit"))
    return exploded.select(*keys, "pos", "hit.*")


def check_pii(df: DataFrame, text: str, settings: CheckSettings = CheckSettings()) -> DataFrame:
    """The frame with ``pii``: passed, violations, found, total_instances, masked_text."""
    df, scan = with_scan(df, text)
    found = {r.label: f"__pii_{r.label}" for r in settings.pii_rules}
    df = _with(
        df, {found[r.label]: pii.type_matches(scan, r, settings.bsn_rule) for r in settings.pii_rules}
    )
    df = _with(df, {"__grouped": pii.grouped_hits(scan, found, settings.pii_rules)})
    present = {t: f"(size({c}) > 0)" for t, c in found.items()}
    masked = pii.mask_text(scan, present, settings.pii_rules, settings.bsn_rule)
    result = (
        f"struct(size(__grouped) = 0 AS passed, {pii.violations('__grouped')} AS violations, __grouped AS found,"
        f" {total([f'size({c})' for c in found.values()])} AS total_instances, {masked} AS masked_text)"
    )
    df = without_scan(_with(df, {"pii": result})).drop("__grouped", *found.values())
    return settled(df, ["pii"])


def check_nogo(df: DataFrame, text: str, settings: CheckSettings = CheckSettings()) -> DataFrame:
    """The frame with ``nogo``: passed, violations, found."""
    df, scan = with_scan(df, text)
    terms = {r.label: f"__nogo_{r.label}" for r in settings.nogo_rules}
    df = _with(df, {terms[r.label]: scan.matches(r) for r in settings.nogo_rules})
    df = _with(df, {"__nogo": wording.nogo_hits(terms)}).drop(*terms.values())
    result = (
        f"struct(size(__nogo) = 0 AS passed, {wording.nogo_violations('__nogo')} AS violations, __nogo AS found)"
    )
    return settled(without_scan(_with(df, {"nogo": result})).drop("__nogo"), ["nogo"])


def check_cta(df: DataFrame, text: str, settings: CheckSettings = CheckSettings()) -> DataFrame:
    """The frame with ``cta``: passed, violations, matched_patterns."""
    df, scan = with_scan(df, text)
    df = _with(df, {"__cta": wording.cta_matched(scan, settings.cta_rules)})
    missing = F.size("__cta") == 0
    result = F.struct(
        (~missing).alias("passed"),
        F.when(missing, F.array(F.lit(fixed.CTA_VIOLATION)))
        .otherwise(F.array().cast("array<string>"))
        .alias("violations"),
        F.col("__cta").alias("matched_patterns"),
    )
    return settled(without_scan(df.withColumn("cta", result)).drop("__cta"), ["cta"])


def _limit(settings: CheckSettings) -> Column:
    if isinstance(settings.max_words, str):
        return F.col(settings.max_words).try_cast("int")
    return F.lit(settings.max_words).cast("int")


def check_length(df: DataFrame, text: str, settings: CheckSettings) -> DataFrame:
    """The frame with ``length``: passed, violations, word_count, over_by."""
    words, limit = F.col("__words"), _limit(settings)
    before, after = fixed.LENGTH_VIOLATION.split("{words}")
    middle, end = after.split("{limit}")
    note = F.concat(
        F.lit(before), words.cast("string"), F.lit(middle), limit.cast("string"), F.lit(end)
    )
    over = wording.over_by(words, limit)
    result = F.struct(
        (over == 0).alias("passed"),
        F.when(over > 0, F.array(note)).otherwise(F.array().cast("array<string>")).alias("violations"),
        words.alias("word_count"),
        over.alias("over_by"),
    )
    df = df.withColumn("__words", wording.word_count(F.col(text)))
    return settled(df.withColumn("length", result).drop("__words"), ["length"])


def check_json(df: DataFrame, text: str, schema: dict) -> DataFrame:
    """The frame with ``json``: passed, errors (rule codes)."""
    df = df.withColumn("__json", jsoncheck.parse_json(F.col(text)))
    df = jsoncheck.with_schema_errors(df, "__json", schema, "__errors")
    result = F.struct((F.size("__errors") == 0).alias("passed"), F.col("__errors").alias("errors"))
    return settled(df.withColumn("json", result).drop("__json", "__errors"), ["json"])


def check_cases(
    df: DataFrame,
    text: str = "expected_output",
    case_id: str = "id",
    phase: str = "phase",
    settings: CheckSettings = CheckSettings(),
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """All checks of one message per row, as the nested result record.

    Columns: case_id, phase, output_mode, word_count, checks, severity, and those of ``extra`` as they are. Checks that are not
    asked for count as passed.
    """
    source = df.select(
        F.col(case_id).alias("case_id"),
        F.col(phase).alias("phase") if phase in df.columns else F.lit("unknown").alias("phase"),
        F.col(text).alias("__text"),
        *_row_columns(settings),
        *extra,
    )
    df, scan = with_scan(source, "__text")
    found = {r.label: f"__pii_{r.label}" for r in settings.pii_rules}
    step = {
        found[r.label]: pii.type_matches(scan, r, settings.bsn_rule) for r in settings.pii_rules
    }
    terms = {r.label: f"__nogo_{r.label}" for r in settings.nogo_rules}
    step |= {terms[r.label]: scan.matches(r) for r in settings.nogo_rules}
    step["__cta"] = (
        wording.cta_present(scan, settings.cta_rules) if settings.cta_required else "true"
    )
    df = _with(df, step).withColumn("__words", wording.word_count(F.col("__text")))
    df = _with(df, {"__nogo": wording.nogo_hits(terms)})
    if settings.terms is not None:
        own = F.transform("__own", lambda t: F.struct(F.lit(OWN_TERM).alias("key"), t.alias("match")))
        df = _with_own_terms(df, settings.terms).withColumn("__nogo", F.concat("__nogo", own))
    errors = F.array().cast("array<string>")
    if settings.json_schema is not None:
        df = df.withColumn("__json", jsoncheck.parse_json(F.col("__text")))
        df = jsoncheck.with_schema_errors(df, "__json", settings.json_schema, "__codes")
        errors = F.col("__codes")
    policy = F.col("__nogo")
    if settings.policy_labels is not None:
        policy = F.filter(policy, lambda h: h["key"].isin(list(settings.policy_labels)))
    df = df.withColumns(
        {
            "__grouped": F.expr(pii.grouped_hits(scan, found, settings.pii_rules)),
            "__errors": errors,
            "__over": wording.over_by(F.col("__words"), _limit(settings)),
            "__policy": policy,
        }
    )
    checks = F.struct(
        (F.size("__errors") == 0).alias("json_valid"),
        F.col("__errors").alias("json_errors"),
        (F.col("__over") == 0).alias("length_ok"),
        F.col("__over").alias("length_over_by"),
        F.col("__nogo").alias("nogo_hits"),
        F.col("__grouped").alias("pii_hits"),
        F.col("__cta").alias("cta_present"),
        F.col("__policy").alias("policy_claims"),
    )
    df = df.select(
        "case_id",
        "phase",
        F.lit(settings.output_mode).alias("output_mode"),
        F.col("__words").alias("word_count"),
        checks.alias("checks"),
        *extra,
    )
    df = df.withColumn("severity", severity(F.col("checks")))
    return settled(df, ["word_count", "checks", "severity"])


def severity(checks: Column) -> Column:
    """fail, warn or pass from a checks record."""
    failed = (
        ~checks["json_valid"]
        | (F.size(checks["pii_hits"]) > 0)
        | (F.size(checks["policy_claims"]) > 0)
        | ~checks["cta_present"]
        | (checks["length_over_by"] > 0)
    )
    return (
        F.when(failed, "fail").when(F.size(checks["nogo_hits"]) > 0, "warn").otherwise("pass")
    )


def summarize(checked: DataFrame) -> DataFrame:
    """One flat row per case; ``pii_hits_total`` counts types, not instances."""
    return checked.select(
        "case_id",
        "phase",
        "severity",
        "word_count",
        F.size("checks.pii_hits").alias("pii_hits_total"),
        F.size("checks.nogo_hits").alias("nogo_hits_total"),
        F.col("checks.cta_present").alias("cta_present"),
        F.col("checks.json_valid").alias("json_valid"),
        F.col("checks.length_ok").alias("length_ok"),
    )


def case_summary(
    df: DataFrame,
    text: str = "expected_output",
    case_id: str = "id",
    phase: str = "phase",
    settings: CheckSettings = CheckSettings(),
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """The rows of :func:`summarize` straight from the texts.

    For reports that need no list of matches: presence tests end at the first match and
    nothing is collected, so the projection is cheaper than the full record.
    """
    phase_col = F.col(phase).alias("phase") if phase in df.columns else F.lit("unknown").alias("phase")
    df, scan = with_scan(
        df.select(F.col(case_id).alias("case_id"), phase_col, F.col(text).alias("__text"), *_row_columns(settings), *extra),
        "__text",
    )
    types = [
        f"CAST({pii.type_present(scan, r, settings.bsn_rule)} AS INT)" for r in settings.pii_rules
    ]
    policy_rules = tuple(
        r for r in settings.nogo_rules
        if settings.policy_labels is None or r.label in settings.policy_labels
    )
    step = {
        "pii_hits_total": total(types),
        "nogo_hits_total": wording.nogo_count(scan, settings.nogo_rules),
        "cta_present": wording.cta_present(scan, settings.cta_rules)
        if settings.cta_required
        else "true",
    }
    if len(policy_rules) < len(settings.nogo_rules):
        step["__policy"] = wording.nogo_count(scan, policy_rules)
    df = _with(df, step).withColumn("word_count", wording.word_count(F.col("__text")))
    if settings.terms is not None:
        df = _with_own_terms(df, settings.terms)
        counted = ["nogo_hits_total"]
        if "__policy" in step and OWN_TERM in settings.policy_labels:
            counted.append("__policy")
        elif "__policy" not in step and settings.policy_labels is not None and OWN_TERM not in settings.policy_labels:
            step["__policy"] = ""
            df = df.withColumn("__policy", F.col("nogo_hits_total"))
        df = df.withColumns({c: F.col(c) + F.size("__own") for c in counted})
    valid = F.lit(True)
    if settings.json_schema is not None:
        df = df.withColumn("__json", jsoncheck.parse_json(F.col("__text")))
        df = jsoncheck.with_schema_errors(df, "__json", settings.json_schema, "__codes")
        valid = F.size("__codes") == 0
    df = df.withColumns(
        {"json_valid": valid, "length_ok": wording.over_by(F.col("word_count"), _limit(settings)) == 0}
    )
    policy = F.col("__policy" if "__policy" in step else "nogo_hits_total")
    failed = (
        ~F.col("json_valid")
        | (F.col("pii_hits_total") > 0)
        | (policy > 0)
        | ~F.col("cta_present")
        | ~F.col("length_ok")
    )
    verdict = F.when(failed, "fail").when(F.col("nogo_hits_total") > 0, "warn").otherwise("pass")
    flat = ["word_count", "pii_hits_total", "nogo_hits_total", "cta_present", "json_valid", "length_ok"]
    rows = df.select("case_id", "phase", verdict.alias("severity"), *flat, *extra)
    return settled(rows, ["severity", *flat])


def with_hard_fail(df: DataFrame, text: str, settings: CheckSettings = CheckSettings(), out: str = "hard_fail") -> DataFrame:
    """The frame with ``out``: 2 where the text holds personal data, else 1 where it should be JSON of the schema and is
    not, else 0. Only presence is tested; the search of a row ends with the first type that is found."""
    df, scan = with_scan(df, text)
    present = " OR ".join(pii.type_present(scan, r, settings.bsn_rule) for r in settings.pii_rules) or "false"
    df = _with(df, {"__pii": f"coalesce({present}, false)"})
    invalid = F.lit(False)
    if settings.json_schema is not None and settings.output_mode == "json":
        df = df.withColumn("__json", jsoncheck.parse_json(F.col(text)))
        df = jsoncheck.with_schema_errors(df, "__json", settings.json_schema, "__codes")
        invalid = F.size("__codes") > 0
    code = F.when(F.col("__pii"), 2).when(invalid, 1).otherwise(0)
    return settled(without_scan(df.withColumn(out, code)).drop("__pii", "__json", "__codes"), [out])


def mask_frame(
    df: DataFrame, text: str, out: str = "masked_text", settings: CheckSettings = CheckSettings()
) -> DataFrame:
    """The frame with the masked text in column ``out``."""
    df, scan = with_scan(df, text)
    present = {r.label: f"__has_{r.label}" for r in settings.pii_rules}
    df = _with(
        df, {present[r.label]: pii.type_present(scan, r, settings.bsn_rule) for r in settings.pii_rules}
    )
    masked = pii.mask_text(scan, present, settings.pii_rules, settings.bsn_rule)
    return settled(without_scan(_with(df, {out: masked})).drop(*present.values()), [out])
