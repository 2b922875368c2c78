"""The four jobs from files to files: checks, judge scores, comparison and agreement.

Each job builds one lazy plan per result and runs it by writing it. Results that several
outputs need are written first and read back, so that no text is searched twice.
"""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..operators import agreement, freeze, gate, guardrails, judging, regression, reports, runs
from ..operators.guardrails import CheckSettings
from ..session import prepare
from ..sources import readers, writers


def run_guardrails(
    spark: SparkSession,
    dataset: str | DataFrame,
    out: str,
    schema_path: str | None = None,
    settings: CheckSettings = CheckSettings(),
    multi_line: bool | str = True,
) -> DataFrame:
    """Checks every case, writes the nested and the flat report, returns the batch report."""
    prepare(spark)
    cases = readers.read_cases(spark, dataset, multi_line) if isinstance(dataset, str) else dataset
    if schema_path is not None:
        settings = replace(settings, json_schema=readers.read_json_document(spark, schema_path))
    checked = guardrails.check_cases(readers.check_input(cases), text="text", settings=settings)
    return _written_reports(spark, checked, out)


def _written_reports(spark: SparkSession, checked: DataFrame, out: str) -> DataFrame:
    detailed, flat = writers.report_paths(out)
    writers.write_json(checked, detailed)
    stored = spark.read.schema(checked.schema).json(detailed)
    summary = guardrails.summarize(stored)
    writers.write_csv(summary, flat)
    return reports.batch_report(summary)


def score_judge_answers(
    spark: SparkSession,
    cases: DataFrame,
    answers: DataFrame,
    out: str,
    run_id: str,
    variant: str,
    rubric_path: str | None = None,
    runs_path: str | None = None,
    cases_path: str | None = None,
    multi_line: bool | str = True,
    dataset_sha256: str | None = None,
) -> DataFrame:
    """Scores the judge's answers (id, answer) to the cases, writes the score table and, when
    asked, the run record and the record of every case (partitioned by run, a repeated run replaces
    itself); returns the run summary. Cases without an answer count as failed."""
    prepare(spark)
    started = time.time()
    rubric = fixed.RUBRIC_WEIGHTS
    if rubric_path is not None:
        rubric = judging.rubric_of(readers.read_rubric(spark, rubric_path))
    asked = readers.judge_input(cases).join(answers.select("id", "answer"), "id", "left")
    judged = judging.score_answers(asked, "answer", rubric)
    wide = judging.scores_wide(
        judged.withColumnRenamed("id", "case_id"), ["case_id"], rubric
    )
    writers.write_scores(wide, out)
    stored = readers.read_scores(spark, out, multi_line)
    scored = stored.select(
        "case_id",
        regression.usable_score(stored).alias("weighted_final_score"),
        (F.lower("passed") == "true").alias("passed"),
        (F.lower("failed_judge_parse") == "true").alias("failed_judge_parse"),
    )
    if runs_path is not None:
        took = int(1000 * (time.time() - started))
        record = runs.batch_record(
            scored, run_id, variant, dataset_sha256=dataset_sha256, started_at=F.timestamp_seconds(F.lit(started)), duration_ms=took
        )
        runs.append_records(record, runs_path)
    if cases_path is not None:
        runs.append_records(runs.case_records(judged, run_id, "input", "output", "id"), cases_path)
    return judging.run_summary(scored)


def prompts(cases: DataFrame, template: str) -> DataFrame:
    """id and prompt of every case, to be handed to whatever answers them."""
    rows = readers.judge_input(cases)
    return rows.select(
        "id", judging.prompt_column(template, F.col("input"), F.col("output")).alias("prompt")
    )


def run_regression(
    spark: SparkSession,
    frozen: str,
    scores_a: str,
    scores_b: str,
    out: str,
    count_failures_in: str = "all",
    multi_line: bool | str = True,
    reports_ab: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Compares two score tables of one frozen dataset, writes and returns the record.

    With the batch reports of both variants the record also says whether B is no worse on personal data and policy, and
    whether it is promoted, which takes both that and the score.
    """
    prepare(spark)
    a, b = readers.read_scores(spark, scores_a, multi_line), readers.read_scores(spark, scores_b, multi_line)
    names = regression.variant_name(scores_a, "A"), regression.variant_name(scores_b, "B")
    compared = regression.compare(a, b, names, count_failures_in=count_failures_in)
    row = compared.first()
    if row["rows_differ"]:
        raise ValueError(f"score tables differ in size: {row['rows_a']} and {row['rows_b']} rows")
    digest = freeze.file_hashes(spark, frozen).agg(F.max("sha256").alias("digest"))
    joined = spark.createDataFrame([row], compared.schema)
    record = regression.summary_record(
        joined, frozen, F.lit(digest.first()["digest"]).cast("string")
    )
    if reports_ab is not None:
        verdict = regression.promotion(joined, *reports_ab).select("not_worse", "promote").first()
        record = record.select("*", F.lit(verdict["not_worse"]).alias("not_worse"), F.lit(verdict["promote"]).alias("promote"))
    writers.write_json(record, out)
    return record


def run_agreement(spark: SparkSession, annotations: str, out: str) -> DataFrame:
    """Kappa of the two annotators, written unless there are too few pairs."""
    items = readers.read_annotations(spark, annotations)
    report = agreement.kappa_report(items, "annotator_a", "annotator_b")
    row = report.first()
    report = spark.createDataFrame([row], report.schema)
    if row["status"] == "ok":
        writers.write_json(agreement.agreement_record(report), out)
    return report


def run_chain(
    spark: SparkSession,
    generated: DataFrame,
    answers: DataFrame,
    out: str,
    run_id: str,
    variant: str = "LIVE",
    max_words: int = 120,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Checks generated texts (id, phase, input, output), holds hard failures back and scores
    the rest. Returns the batch report, the held back cases and the run summary.

    Checks are stored beside the texts they are of, at ``out``/gated, so that each text is searched once and the gate is a
    filter of that table: neither texts nor ids are joined."""
    prepare(spark)
    usable = gate.without_errors(generated, "output")
    checked = guardrails.check_cases(
        usable.withColumn("__checked", F.col("output")), "__checked", settings=CheckSettings(max_words=max_words), extra=("input", "output")
    )
    place = f"{out}/gated"
    checked.write.mode("overwrite").parquet(place)
    stored = spark.read.schema(checked.schema).parquet(place)
    report = _written_reports(spark, stored.drop("input", "output"), f"{out}/checks")
    rows = gate.decided(stored)
    passed_on = rows.where("reason IS NULL").select(F.col("case_id").alias("id"), "input", "output")
    summary = score_judge_answers(spark, passed_on, answers, f"{out}/scores", run_id, variant)
    held = rows.where("reason IS NOT NULL").select("case_id", "phase", "input", "output", "reason")
    return report, held, summary
