"""The registered queries: every operator over whole given tables.

Each takes a session and the folder of the tables and returns a lazy DataFrame. Lists and
records are flattened to text so that results can be compared row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fixed
from ..functions import pii, rules as R, wording
from ..operators import (
    agreement, freeze, gate, guardrails, judging, metadata, regression, reports, ruletables, runs,
)
from ..operators.guardrails import CheckSettings
from ..session import prepare
from ..sources import readers, scans
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PII_LABELS = [r.label for r in R.PII_RULES]
LONG = "bigint"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _round(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _ints(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(LONG) for c in columns})


def _texts(items: Column, text) -> Column:
    return F.array_join(F.transform(items, text), "; ")


# --- personal data -----------------------------------------------------------------------
@query
def pii_counts(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id", "text")
    return _ints(guardrails.pii_counts(docs, "text").drop("text"), *PII_LABELS)


@query
def pii_counts_contacts(spark, d):
    lines = I.CONTACTS.frame(spark, d).select("o_orderkey", "line")
    return _ints(guardrails.pii_counts(lines, "line").drop("line"), *PII_LABELS)


@query
def pii_summary_map(spark, d):
    lines = I.CONTACTS.frame(spark, d).select("o_orderkey", "line")
    found = guardrails.pii_summary(lines, "line")
    entries = F.sort_array(F.map_entries("pii_summary"))
    shown = _texts(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select("o_orderkey", shown.alias("pii_summary"))


@query
def pii_totals(spark, d):
    docs = I.table(spark, d, "documents").select("text")
    return reports.pii_totals(guardrails.pii_counts(docs, "text"), PII_LABELS)


@query
def pii_totals_contacts(spark, d):
    lines = I.CONTACTS.frame(spark, d).select("line")
    totals = reports.pii_totals_map(guardrails.pii_counts(lines, "line"), PII_LABELS)
    entries = F.sort_array(F.map_entries("pii_matches"))
    shown = _texts(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return totals.select("total_rows", shown.alias("pii_matches"))


@query
def pii_offsets(spark, d):
    docs = I.table(spark, d, "documents")
    return _ints(guardrails.pii_hits_long(docs, ["doc_id"], "text"), "pos", "start", "end")


@query
def pii_offsets_contacts(spark, d):
    hits = guardrails.pii_hits_long(I.CONTACTS.frame(spark, d), ["o_orderkey"], "line")
    return _ints(hits, "pos", "start", "end")


@query
def pii_check_contacts(spark, d):
    lines = I.CONTACTS.frame(spark, d).select("o_orderkey", "line")
    return guardrails.check_pii(lines, "line").select(
        "o_orderkey",
        F.col("pii.passed").alias("passed"),
        F.array_join("pii.violations", "; ").alias("violations"),
        _texts(F.col("pii.found"), lambda g: F.concat(g["type"], F.lit("="), F.array_join(g["matches"], ","))).alias("found"),
        F.col("pii.total_instances").cast(LONG).alias("total_instances"),
    )


@query
def pii_check_masks(spark, d):
    docs = guardrails.check_pii(I.table(spark, d, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", F.col("pii.passed").alias("passed"), F.col("pii.masked_text").alias("masked_text"))


@query
def pii_mask(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id", "text")
    return guardrails.mask_frame(docs, "text").select("doc_id", "masked_text")


@query
def pii_mask_contacts(spark, d):
    lines = I.CONTACTS.frame(spark, d).select("o_orderkey", "line")
    return guardrails.mask_frame(lines, "line").select("o_orderkey", "masked_text")


@query
def pii_mask_spliced(spark, d):
    docs = guardrails.pii_hits(I.table(spark, d, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", pii.mask_by_splicing(F.col("text"), F.col("hits")).alias("masked_text"))


@query
def bsn_checksum(spark, d):
    numbers = I.table(spark, d, "orders").selectExpr(
        "o_orderkey", "lpad(CAST(o_orderkey * 7919 % 1000000000 AS STRING), 9, '0') AS number"
    )
    checked = pii.with_bsn_valid(numbers, "number")
    return pii.with_bsn_valid(checked, "number", "valid_standard", "standard")


@query
def pii_hit_rate(spark, d):
    lines = I.LABELLED_LINES.frame(spark, d)
    return _round(agreement.pii_hit_rate(guardrails.mask_frame(lines, "line")), "rate")


@query
def deep_mask(spark, d):
    lines = I.CONTACTS.frame(spark, d)
    record = lines.select(
        "o_orderkey",
        F.struct(
            F.col("line").alias("note"),
            F.col("o_custkey").alias("customer"),
            F.array(F.struct(F.col("line").alias("inner"))).alias("listed"),
            F.array("line").alias("plain"),
        ).alias("meta"),
    )
    masked = metadata.mask_record(record, in_lists=False)
    return masked.select(
        "o_orderkey",
        F.col("meta.note").alias("note"),
        F.col("meta.customer").alias("customer"),
        F.col("meta.listed")[0]["inner"].alias("inner"),
        (F.col("meta.plain")[0] == F.col("meta.note")).alias("plain_masked"),
    )


@query
def preview(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id", "text")
    return metadata.with_preview(docs, "text").select("doc_id", "preview")


@query
def preview_cut_first(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id", "text")
    return metadata.with_preview(docs, "text", mask_first=False).select("doc_id", "preview")


# --- wording, calls to action, length ----------------------------------------------------
@query
def nogo_hits(spark, d):
    checked = guardrails.check_nogo(I.MESSAGES.frame(spark, d), "expected_output")
    hits = checked.select("doc_id", F.explode("nogo.found").alias("h")).select("doc_id", "h.*")
    return hits.groupBy("doc_id", "key", "match").agg(F.count(F.lit(1)).alias("n"))


@query
def nogo_documents(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id", "lang", "text")
    df, scan = guardrails.with_scan(docs, "text")
    counted = df.select("lang", F.expr(wording.nogo_count(scan)).alias("n"))
    return counted.groupBy("lang").agg(
        F.count_if(F.col("n") > 0).alias("texts"), F.sum("n").cast(LONG).alias("hits")
    )


@query
def nogo_violations(spark, d):
    checked = guardrails.check_nogo(I.MESSAGES.frame(spark, d), "expected_output")
    notes = checked.select(F.explode("nogo.violations").alias("violation"))
    return notes.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query
def cta_rate(spark, d):
    df, scan = guardrails.with_scan(I.MESSAGES.frame(spark, d), "expected_output")
    return df.select("phase", F.expr(wording.cta_present(scan)).alias("cta")).groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("cta").alias("with_cta")
    )


@query
def cta_matched(spark, d):
    checked = guardrails.check_cta(I.MESSAGES.frame(spark, d), "expected_output")
    found = checked.select(F.explode("cta.matched_patterns").alias("pattern"))
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query
def cta_conversations(spark, d):
    talk = I.table(spark, d, "conversations")
    df, scan = guardrails.with_scan(talk, "text")
    return df.select("role", F.expr(wording.cta_present(scan)).alias("cta")).groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("cta").alias("with_cta")
    )


@query
def word_limit(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id", "text")
    checked = guardrails.check_length(docs, "text", CheckSettings(max_words=300))
    return checked.select(
        "doc_id",
        F.col("length.passed").alias("passed"),
        F.array_join("length.violations", "; ").alias("violations"),
        F.col("length.word_count").cast(LONG).alias("word_count"),
        F.col("length.over_by").cast(LONG).alias("over_by"),
    )


@query
def own_limits(spark, d):
    docs = I.OWN_LIMITS.frame(spark, d)
    checked = guardrails.check_length(docs, "text", CheckSettings(max_words="max_words"))
    return checked.select(
        "doc_id",
        F.col("length.over_by").cast(LONG).alias("over_by"),
        F.array_join(wording.term_hits(F.col("text"), F.col("no_go_terms")), ",").alias("terms"),
    )


@query
def style_rates(spark, d):
    docs = I.table(spark, d, "documents")
    patterns = {"code_fence": "```", "doubled_mark": "[!?]{2,}", "digits": "[0-9]{3}"}
    return _round(reports.rates(docs, "text", patterns, ("lang",)), *patterns)


# --- JSON --------------------------------------------------------------------------------
@query
def json_props(spark, d):
    events = I.table(spark, d, "events").select("event_type", "props")
    checked = guardrails.check_json(events, "props", I.PROPS_SCHEMA)
    return checked.select("event_type", "json.passed").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("valid")
    )


@query
def json_schema(spark, d):
    checked = guardrails.check_json(I.REPLIES.frame(spark, d), "reply", I.REPLY_SCHEMA)
    return checked.select(
        "c_custkey",
        F.col("json.passed").alias("passed"),
        F.array_join(F.sort_array("json.errors"), "; ").alias("errors"),
    )


# --- whole cases and reports -------------------------------------------------------------
def _checked(spark, d, settings=CheckSettings(max_words=120)):
    return guardrails.check_cases(I.MESSAGES.frame(spark, d), settings=settings)


def _summary(spark, d, settings=CheckSettings(max_words=120)):
    return guardrails.case_summary(I.MESSAGES.frame(spark, d), settings=settings)


@query
def case_check(spark, d):
    c = F.col("checks")
    return _checked(spark, d).select(
        "case_id",
        "phase",
        "output_mode",
        F.col("word_count").cast(LONG).alias("word_count"),
        c["json_valid"].alias("json_valid"),
        c["length_ok"].alias("length_ok"),
        c["length_over_by"].cast(LONG).alias("length_over_by"),
        F.size(c["nogo_hits"]).cast(LONG).alias("nogo_hits"),
        _texts(c["pii_hits"], lambda h: F.concat(h["type"], F.lit("="), F.array_join(h["matches"], ","))).alias("pii_hits"),
        c["cta_present"].alias("cta_present"),
        F.size(c["policy_claims"]).cast(LONG).alias("policy_claims"),
        "severity",
    )


@query
def case_check_own_terms(spark, d):
    c = F.col("checks")
    settings = CheckSettings(max_words="max_words", terms="no_go_terms", cta_required=False)
    return guardrails.check_cases(I.OWN_LIMITS.frame(spark, d), "text", "doc_id", "lang", settings).select(
        "case_id",
        c["length_over_by"].cast(LONG).alias("length_over_by"),
        F.array_join(F.transform(F.filter(c["nogo_hits"], lambda h: h["key"] == guardrails.OWN_TERM), lambda h: h["match"]), ",").alias("terms"),
        F.size(c["policy_claims"]).cast(LONG).alias("policy_claims"),
        "severity",
    )


@query
def case_summary_own_terms(spark, d):
    settings = CheckSettings(max_words="max_words", terms="no_go_terms", cta_required=False)
    rows = guardrails.case_summary(I.OWN_LIMITS.frame(spark, d), "text", "doc_id", "lang", settings)
    return _ints(rows, "nogo_hits_total").select("case_id", "nogo_hits_total", "severity")


@query
def case_summary(spark, d):
    return _ints(_summary(spark, d), "word_count", "pii_hits_total", "nogo_hits_total")


@query
def case_summary_from_record(spark, d):
    return _ints(guardrails.summarize(_checked(spark, d)), "word_count", "pii_hits_total", "nogo_hits_total")


@query
def severity_with_policy_labels(spark, d):
    settings = CheckSettings(policy_labels=("garantie", "garanderen", "we_beloven"))
    return _summary(spark, d, settings).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query
def severity_by_lang(spark, d):
    docs = I.table(spark, d, "documents")
    settings = CheckSettings(cta_required=False)
    rows = guardrails.case_summary(docs, "text", "doc_id", "lang", settings)
    return rows.groupBy("phase", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def batch_report(spark, d):
    return _round(reports.batch_report(_summary(spark, d)), "pii_clean_rate")


@query
def batch_report_by_phase(spark, d):
    return _round(reports.batch_report(_summary(spark, d), ["phase"]), "pii_clean_rate")


@query
def percentiles_overall(spark, d):
    events = I.table(spark, d, "events").select("value")
    return _round(reports.percentiles(events, "value"), "percentile")


@query
def percentiles_by_type(spark, d):
    events = I.table(spark, d, "events").select("event_type", "value")
    return _round(reports.percentiles(events, "value", by=("event_type",)), "percentile")


@query
def percentiles_from_brackets(spark, d):
    """A coarse sketch, so that most values lie outside the brackets."""
    events = I.table(spark, d, "events").select("event_type", "value")
    return _round(reports.percentiles(events, "value", by=("event_type",), accuracy=200), "percentile")


@query
def word_count_percentiles(spark, d):
    docs = I.table(spark, d, "documents").select("lang", wording.word_count(F.col("text")).alias("words"))
    return _round(reports.percentiles(docs, "words", by=("lang",)), "percentile")


@query
def split_counts(spark, d):
    return reports.split_counts(I.table(spark, d, "documents"), "lang")


@query
def top_causes(spark, d):
    return reports.top_causes(reports.violation_causes(_checked(spark, d)), "cause", 8)


@query
def causes_by_phase(spark, d):
    causes = reports.violation_causes(_checked(spark, d))
    return reports.top_causes(causes, "cause", 5, ("phase",))


# --- judge answers -----------------------------------------------------------------------
def _judged(spark, d, shift="0"):
    return judging.score_answers(I.answers(shift).frame(spark, d))


@query
def judge_by_rubric(spark, d):
    """Answers of one run scored by two versions of a rubric, which is a table."""
    rows = I.answers().frame(spark, d).withColumn("version", F.when(F.col("lang") == "en", "v1").when(F.col("doc_id") % 31 == 0, "none").otherwise("v2"))
    rubrics = spark.createDataFrame([(v, c, w) for v, rubric in I.RUBRICS.items() for c, w in rubric], "version string, criterion string, weight double")
    judged = judging.score_by_rubrics(rows, rubrics)
    flat = F.array_join(F.transform("criterion_scores", lambda c: F.concat(c["criterion"], F.lit("="), F.coalesce(c["reason"], F.lit("")))), ";")
    shown = judged.select("doc_id", "version", flat.alias("reasons"), F.col("weighted_final_score").alias("final"), "passed", "failed_judge_parse", "raw_response")
    return _round(shown, "final")


@query
def prompt_column(spark, d):
    template = "INPUT:\n{input_text}\nOUTPUT:\n{model_output}\nJSON: {\"a\": {}}"
    docs = I.table(spark, d, "documents")
    made = judging.prompt_column(template, F.concat(F.lit("{model_output} "), F.col("lang")), F.col("text"))
    return docs.select("doc_id", made.alias("prompt"))


@query
def judge_scores(spark, d):
    return judging.scores_long(_judged(spark, d), ["doc_id"])


@query
def judge_results(spark, d):
    return _round(
        _judged(spark, d).select(
            "doc_id", "weighted_final_score", "passed", "failed_judge_parse", "raw_response"
        ),
        "weighted_final_score",
    )


@query
def judge_report(spark, d):
    wide = judging.scores_wide(_judged(spark, d), ["doc_id"])
    return _round(wide, "final_score")


@query
def judge_summary(spark, d):
    return _round(judging.run_summary(_judged(spark, d), ["lang"]), "average_score", "pass_rate")


@query
def judge_acceptance(spark, d):
    return _round(judging.run_summary(_judged(spark, d)), "average_score", "pass_rate")


@query
def score_histogram(spark, d):
    return judging.score_distribution(judging.scores_long(_judged(spark, d), ["doc_id"]))


@query
def run_records(spark, d):
    record = runs.batch_record(_judged(spark, d), "1", "V1", dataset_sha256="abc", duration_ms=5)
    return _round(record.withColumn("tags", F.array_join("tags", ",")), "average_score").drop("started_at")


@query
def case_run_records(spark, d):
    judged = _judged(spark, d).join(I.MESSAGES.frame(spark, d).select("doc_id", "expected_output"), "doc_id")
    docs = I.table(spark, d, "documents").select("doc_id", "text")
    rows = runs.case_records(judged.join(docs, "doc_id"), "run_1", "text", "expected_output", "doc_id")
    # the score's text form in the tag is Spark's; the tag of a score that is not zero is compared without it
    tags = F.transform("tags", lambda t: F.when(t.rlike("^score_[0-9]"), "score").otherwise(t))
    return _round(
        rows.select("run_id", "case_id", "input_preview", "output_preview", "final_score", "passed", F.array_join(tags, ",").alias("tags")),
        "final_score",
    )


@query
def run_log(spark, d):
    parsed = runs.parse_run_log(I.LOG_LINES.frame(spark, d))
    return parsed.select(
        "run_id", "variant", "parse_failed", F.round("avg_score", 9).alias("avg_score"),
        F.col("fields")["dataset"].alias("dataset"),
    )


@query
def rule_table_hits(spark, d):
    """Two rules for every pair of neighbouring words of the benchmark, searched in all documents that have the longer word."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    pairs = I.table(spark, d, "benchmark").select(words.alias("w")).select("w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i")).where("i > 0 AND i < size(w)")
    pairs = pairs.selectExpr("w[i - 1] AS a", "w[i] AS b").distinct()
    rare = "IF(length(a) >= length(b), a, b) AS literal"  # long words are rare
    near = pairs.selectExpr("a || ' ' || b AS rule", "'(?i)' || a || '[ ]' || b AS pattern", rare, "array(a || ' ' || b) AS also")
    rules = near.union(pairs.selectExpr("b || ', ' || a", "'(?i)' || b || ',[ ]' || a", rare, "array(b || ', ' || a)"))
    return ruletables.rule_hits(I.table(spark, d, "documents"), rules, "doc_id", "text")


# --- gate --------------------------------------------------------------------------------
def _generated(spark, d):
    text = F.when(F.col("doc_id") % 29 == 0, F.concat(F.lit("ERROR: "), F.col("expected_output")))
    cases = I.MESSAGES.frame(spark, d)
    return cases.select("doc_id", F.col("id").alias("case_id"), "phase", text.otherwise(F.col("expected_output")).alias("expected_output"))


def _generated_checks(spark, d):
    usable = gate.without_errors(_generated(spark, d), "expected_output")
    return guardrails.check_cases(usable, case_id="case_id", settings=CheckSettings(max_words=120))


@query
def gate_passed(spark, d):
    kept = gate.gate(_generated(spark, d), _generated_checks(spark, d), "expected_output")
    return kept.select("case_id", "phase")


@query
def gate_skipped(spark, d):
    held = gate.skipped(_generated(spark, d), _generated_checks(spark, d), "expected_output")
    return held.select("case_id", "phase", "reason")


@query
def gate_in_one_pass(spark, d):
    rows = gate.gate_rows(_generated(spark, d), "expected_output")
    return rows.select("case_id", "phase", "reason")


@query
def gate_json_in_one_pass(spark, d):
    settings = CheckSettings(json_schema=I.REPLY_SCHEMA, output_mode="json")
    rows = gate.gate_rows(I.REPLIES.frame(spark, d), "reply", settings)
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def gate_of_stored_checks(spark, d):
    """Checks beside what is passed on, as the live chain stores them."""
    usable = gate.without_errors(_generated(spark, d), "expected_output")
    checked = guardrails.check_cases(usable, case_id="case_id", settings=CheckSettings(max_words=120), extra=("doc_id",))
    return gate.decided(checked).select("case_id", "phase", "doc_id", "severity", "reason")


@query
def gate_of_repeated_checks(spark, d):
    """Checks of conversations: every case has one per turn; the last turn decides, or any."""
    talk = I.TURNS.frame(spark, d)
    checked = guardrails.check_cases(talk, "line", "conv_id", "role", CheckSettings(cta_required=False))
    ordered = checked.withColumn("turn", F.col("phase").cast("bigint"))
    last, any_ = gate.hard_fails(ordered, "turn"), gate.hard_fails(checked)
    return last.select(F.lit("last").alias("rule"), "case_id", "reason").union(any_.select(F.lit("any"), "case_id", "reason"))


@query
def gate_json_mode(spark, d):
    replies = I.REPLIES.frame(spark, d)
    settings = CheckSettings(json_schema=I.REPLY_SCHEMA, cta_required=False, output_mode="json")
    checked = guardrails.check_cases(replies, "reply", "c_custkey", "c_mktsegment", settings)
    return gate.hard_fails(checked).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def first_cases(spark, d):
    return gate.first_cases(I.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


# --- regression --------------------------------------------------------------------------
_COMPARED = ("avg_a", "avg_b", "score_improvement", "improvement_percentage")


@query
def regression_all(spark, d):
    return _round(regression.compare(I.SCORES_A.frame(spark, d), I.SCORES_B.frame(spark, d), ("V1", "V2")), *_COMPARED)


@query
def regression_usable(spark, d):
    a, b = I.SCORES_A.frame(spark, d), I.SCORES_B.frame(spark, d)
    return _round(regression.compare(a, b, ("V1", "V2"), count_failures_in="usable"), *_COMPARED)


@query
def regression_record(spark, d):
    compared = regression.compare(I.SCORES_A.frame(spark, d), I.SCORES_B.frame(spark, d), ("V1", "V2"))
    r = regression.summary_record(compared, "documents")
    return r.select(
        F.col("dataset.path").alias("path"),
        F.col("variant_a.name").alias("name_a"),
        F.col("variant_a.avg_score").alias("avg_a"),
        F.col("variant_b.avg_score").alias("avg_b"),
        "score_improvement",
        "improvement_percentage",
        "parse_failure_delta",
        "meets_promotion_threshold",
    )


@query
def regression_by_case(spark, d):
    return _round(regression.by_case(I.SCORES_A.frame(spark, d), I.SCORES_B.frame(spark, d)), "score_a", "score_b", "delta")


@query
def regression_scores(spark, d):
    rows = regression.both(I.SCORES_A.frame(spark, d), I.SCORES_B.frame(spark, d))
    return rows.where("score IS NOT NULL").select("variant", "case_id", "score", "passed")


@query
def regression_by_criterion(spark, d):
    a = judging.scores_long(_judged(spark, d, "0"), ["doc_id"])
    b = judging.scores_long(_judged(spark, d, "1"), ["doc_id"])
    return _round(regression.by_criterion(a, b), "avg_a", "avg_b", "delta")


@query
def regression_medians(spark, d):
    rows = regression.both(I.SCORES_A.frame(spark, d), I.SCORES_B.frame(spark, d))
    return _round(reports.percentiles(rows, "score", (0.5,), ("variant",)), "percentile")


@query
def regression_bootstrap(spark, d):
    paired = regression.by_case(I.SCORES_A.frame(spark, d), I.SCORES_B.frame(spark, d))
    return _round(regression.bootstrap(paired, 50), "mean_delta")


@query
def bootstrap_of_deltas(spark, d):
    paired = regression.by_case(I.SCORES_A.frame(spark, d), I.SCORES_B.frame(spark, d))
    return _round(regression.bootstrap_of_deltas(paired, 50), "mean_delta")


@query
def run_deltas(spark, d):
    rows = regression.both(I.SCORES_A.frame(spark, d), I.SCORES_B.frame(spark, d))
    table = judging.run_summary(rows.withColumnRenamed("failed", "failed_judge_parse"), ["variant"], score="score")
    metrics = ["pass_rate", "average_score", "parse_failed_cases"]
    return _round(regression.run_deltas(table, "A", "B", metrics, key="variant"), "pass_rate_delta", "average_score_delta")


@query
def policy_not_worse(spark, d):
    docs = I.table(spark, d, "documents")
    plain = CheckSettings(cta_required=False)
    a = reports.batch_report(guardrails.case_summary(docs, "text", "doc_id", "lang", plain))
    b = reports.batch_report(_summary(spark, d, plain))
    return regression.policy_not_worse(a, b)


@query
def promotion_verdict(spark, d):
    docs = I.table(spark, d, "documents")
    plain = CheckSettings(cta_required=False)
    a = reports.batch_report(_summary(spark, d, plain))
    b = reports.batch_report(guardrails.case_summary(docs, "text", "doc_id", "lang", plain))
    compared = regression.compare(I.SCORES_A.frame(spark, d), I.SCORES_B.frame(spark, d).where("lang <> 'fr'"), ("V1", "V2"))
    return regression.promotion(compared, a, b).select(
        "rows_a", "rows_b", "rows_differ", "parse_failure_delta", "meets_promotion_threshold", "not_worse", "promote"
    )


@query
def regression_of_unequal_sides(spark, d):
    """B lacks a language and holds every tenth case twice."""
    b = I.SCORES_B.frame(spark, d).where("lang <> 'fr'")
    b = b.union(b.where("CAST(case_id AS BIGINT) % 10 = 0"))
    return _round(regression.by_case(I.SCORES_A.frame(spark, d), b), "score_a", "score_b", "delta")


@query
def variant_names(spark, d):
    paths = I.table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "'out/v' || CAST(o_custkey % 3 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '_scores_V' ELSE '-' END"
        " || CAST(o_orderkey % 7 AS STRING) || '.csv' AS path",
    )
    return paths.select("o_orderkey", regression.variant_name_column(F.col("path"), "A").alias("variant"))


# --- agreement ---------------------------------------------------------------------------
def _rated(spark, d):
    docs = I.table(spark, d, "documents")
    flagged = docs.select("doc_id", (F.col("text").contains("!!")).cast("int").alias("rule"), "n_chars")
    return I.table(spark, d, "labels").join(flagged, "doc_id")


def _flat_kappa(report):
    shown = report.select(
        "status", "n_pairs", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"),
        "observed_agreement", "expected_agreement", "cohens_kappa", F.col("targets.kappa").alias("target_kappa"),
    )
    return _round(shown, "observed_agreement", "expected_agreement", "cohens_kappa")


@query
def kappa(spark, d):
    labels = I.table(spark, d, "labels")
    return _flat_kappa(agreement.kappa_report(labels, "quality", "toxic"))


@query
def kappa_against_rule(spark, d):
    return _flat_kappa(agreement.kappa_report(_rated(spark, d), "toxic", "rule"))


def _two_scores(spark, d):
    return I.table(spark, d, "documents").selectExpr(
        "doc_id", "lang", "(doc_id * 7 + n_chars) % 11 * 5e-1 AS a", "(doc_id * 7 + n_chars + doc_id % 3) % 11 * 5e-1 AS b"
    )


@query
def kappa_scores(spark, d):
    return _flat_kappa(agreement.kappa_report(_two_scores(spark, d), "a", "b"))


@query
def kappa_with_gaps(spark, d):
    """Many scores are missing on either side."""
    pairs = _two_scores(spark, d).selectExpr("CASE WHEN doc_id % 5 > 0 THEN a END AS a", "CASE WHEN doc_id % 7 > 1 THEN b END AS b")
    return _flat_kappa(agreement.kappa_report(pairs, "a", "b"))


@query
def kappa_of_too_few(spark, d):
    """Nearly all pairs lack a score, and more are asked for than there are."""
    pairs = _two_scores(spark, d).selectExpr("a", "CASE WHEN doc_id % 50 = 3 THEN b END AS b")
    return _flat_kappa(agreement.kappa_report(pairs, "a", "b", min_pairs=1_000_000_000))


@query
def confusion_counts(spark, d):
    return agreement.confusion(agreement.complete_pairs(_two_scores(spark, d), "a", "b"))


@query
def label_space(spark, d):
    return agreement.label_space(agreement.complete_pairs(_two_scores(spark, d), "a", "b"))


@query
def within_one(spark, d):
    return _round(agreement.within_one(_two_scores(spark, d), "a", "b", ["lang"]), "within_one", "mae")


@query
def calibration(spark, d):
    judge = judging.scores_long(_judged(spark, d, "0").withColumnRenamed("doc_id", "case_id"), ["case_id"])
    human = judging.scores_long(_judged(spark, d, "2").withColumnRenamed("doc_id", "case_id"), ["case_id"])
    repeated = judge.union(judge.where("CAST(case_id AS BIGINT) % 3 = 0"))
    return _round(agreement.calibration(repeated, human), "within_one", "mae")


@query
def review_sample(spark, d):
    picked = agreement.review_sample(I.SCORES_A.frame(spark, d), I.SCORES_B.frame(spark, d))
    return picked.select(
        "case_id",
        F.col("model_scores")["A"].alias("score_a"),
        F.col("model_scores")["B"].alias("score_b"),
        F.col("model_passed")["A"].alias("passed_a"),
        F.col("parse_failed")["B"].alias("failed_b"),
    )


# --- freeze ------------------------------------------------------------------------------
@query
def row_fingerprint(spark, d):
    return freeze.row_fingerprint(I.table(spark, d, "documents"), ["doc_id", "text", "lang"])


@query
def row_fingerprint_by_lang(spark, d):
    return freeze.row_fingerprint(I.table(spark, d, "documents"), ["doc_id", "text"], ["lang"])


@query
def file_hashes(spark, d):
    rows = freeze.file_hashes(spark, f"{d}/documents.parquet")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


@query
def file_inventory(spark, d):
    rows = freeze.inventory(spark, d)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes")


@query
def freeze_manifest(spark, d):
    docs = I.table(spark, d, "documents")
    made = freeze.manifest(spark, {"documents": (f"{d}/documents.parquet", docs)}, "2025-01-01T00:00:00Z", "lang")
    split = _texts(F.map_entries("split"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return made.select("name", "sha256", "frozen_at", "n_rows", split.alias("split"))


def _other_version(docs):
    """The documents with some texts changed, some rows gone, a source of another name and one in two rows more."""
    text = F.when(F.col("doc_id") % 401 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    source = F.when(F.col("source") == "src3", "src03").otherwise(F.col("source"))
    kept = docs.where("doc_id % 503 <> 7").select("doc_id", text.alias("text"), "lang", source.alias("source"))
    return kept.unionByName(kept.where("source = 'src5' AND doc_id % 2 = 0"))


@query
def manifest_rows(spark, d):
    return freeze.manifest_rows(spark, {"documents": (None, I.table(spark, d, "documents"))}, "source", ["doc_id", "text", "lang"])


@query
def manifest_changes(spark, d):
    docs = I.table(spark, d, "documents")
    old, new = (freeze.manifest_rows(spark, {"documents": (None, t)}, "source", ["doc_id", "text", "lang"]) for t in (docs, _other_version(docs)))
    return freeze.manifest_changes(old, new)


# --- what readers make of lines, and what writers make of rows -----------------------------
@query
def freeze_manifest_counts(spark, d):
    docs = I.table(spark, d, "documents")
    made = freeze.manifest(spark, {"documents": (f"{d}/documents.parquet", docs)}, "2025-01-01T00:00:00Z", "lang")
    split = _texts(F.map_entries("split"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return made.select("name", "frozen_at", "n_rows", split.alias("split"))


@query
def lines_of_cases(spark, d):
    return readers.case_lines(I.CASE_LINES.frame(spark, d), "line")


@query
def lines_of_frozen_cases(spark, d):
    return readers.frozen_lines(I.FROZEN_LINES.frame(spark, d), "line")


@query
def lines_of_annotations(spark, d):
    return readers.annotation_lines(I.ANNOTATION_LINES.frame(spark, d), "line").select("case_id", "annotator_a", "annotator_b", "notes")


@query
def records_of_split_lines(spark, d):
    """A CSV file with line breaks in quotes, of which records lie in several splits."""
    lines = I.SPLIT_LINES.frame(spark, d).unionByName(I.ends(spark, ("doc_id,text,lang\r",), ("",)))
    records = scans.csv_records(lines).where(~F.col("first"))
    return readers.csv_fields(records, "record", T.StructType.fromDDL("doc_id bigint, text string, lang string"))


@query
def items_of_split_document(spark, d):
    """The list of one JSON document, of which items lie in several splits."""
    pieces = I.SPLIT_ITEMS.frame(spark, d).unionByName(I.ends(spark, I.ITEMS_BEFORE, I.ITEMS_AFTER))
    return readers.annotated_items(pieces).select("case_id", "annotator_a", "notes")


@query
def pairs_of_split_document(spark, d):
    pieces = I.SPLIT_ITEMS.frame(spark, d).unionByName(I.ends(spark, I.ITEMS_BEFORE, I.ITEMS_AFTER))
    return readers.pairs_of(pieces)


@query
def lines_of_scores(spark, d):
    rows = readers.score_lines(I.SCORE_LINES.frame(spark, d), "line")
    return rows.select("case_id", "final_score", regression.usable_score(rows).alias("score"), "passed")


@query
def rows_of_score_files(spark, d):
    """The score file's columns, of which the score is text."""
    wide = judging.scores_wide(_judged(spark, d), ["doc_id"])
    rows = judging.score_file_columns(wide)
    shown = F.when(F.col("failed_judge_parse"), F.col("final_score")).otherwise("number")
    return rows.select("doc_id", shown.alias("final_score"), F.round(F.col("final_score").try_cast("double"), 9).alias("score"), "passed")


@query
def rows_of_summary_files(spark, d):
    """The flat summary as CSV records."""
    rows = _summary(spark, d)
    return rows.select(F.to_csv(F.struct("case_id", "severity", "word_count", "pii_hits_total", "cta_present", "length_ok")).alias("record"))


@query
def rows_of_nested_files(spark, d):
    """The nested record as JSON, read back."""
    text = _checked(spark, d).select(F.to_json(F.struct("case_id", "checks", "severity")).alias("record"))
    parsed = text.select(F.try_parse_json("record").alias("r"))
    get = lambda path, kind: F.try_variant_get("r", path, kind)
    return parsed.select(
        get("$.case_id", "string").alias("case_id"),
        get("$.checks.cta_present", "boolean").alias("cta_present"),
        get("$.checks.length_over_by", "bigint").alias("length_over_by"),
        get("$.severity", "string").alias("severity"),
    )


@query
def rows_of_agreement_files(spark, d):
    """The record that the agreement job writes, as its text holds it."""
    record = agreement.agreement_record(agreement.kappa_report(_two_scores(spark, d), "a", "b"))
    text = record.select(F.to_json(F.struct(*record.columns), {"ignoreNullFields": "false"}).alias("record"))
    get = lambda path, kind: F.try_variant_get(F.try_parse_json("record"), path, kind)
    shown = text.select(
        get("$.n_pairs", "bigint").alias("n_pairs"), F.array_join(get("$.labels", "array<string>"), ",").alias("labels"),
        get("$.observed_agreement", "double").alias("observed_agreement"), get("$.cohens_kappa", "double").alias("cohens_kappa"),
        get("$.targets.agreement_pct", "string").alias("target_agreement"), F.contains("record", F.lit("status")).alias("has_status"),
    )
    return _round(shown, "observed_agreement", "cohens_kappa")


@query
def run_table_deltas(spark, d):
    """Two runs as the run table holds them, compared."""
    table = runs.mask_record(runs.batch_record(_judged(spark, d), "1", "V1").unionByName(runs.batch_record(_judged(spark, d, "1"), "2", "V2")))
    metrics = ["total_cases", "passed_cases", "parse_failed_cases", "average_score"]
    return _round(regression.run_deltas(table, "1", "2", metrics), "average_score_delta")


@query
def rows_of_regression_files(spark, d):
    compared = regression.compare(I.SCORES_A.frame(spark, d), I.SCORES_B.frame(spark, d), ("V1", "V2"))
    record = regression.summary_record(compared, "documents")
    text = record.select(F.to_json(F.struct(*record.columns)).alias("record"))
    get = lambda path, kind: F.try_variant_get(F.try_parse_json("record"), path, kind)
    return text.select(
        get("$.variant_a.name", "string").alias("name_a"),
        get("$.variant_b.avg_score", "double").alias("avg_b"),
        get("$.parse_failure_delta", "bigint").alias("parse_failure_delta"),
        get("$.meets_promotion_threshold", "boolean").alias("meets_promotion_threshold"),
    )


@query
def judge_inputs(spark, d):
    docs = I.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("message"))
    rows = readers.judge_input(docs)
    return rows.select("id", "input", F.md5("output").alias("output_md5"))
