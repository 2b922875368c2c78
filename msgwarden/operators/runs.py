"""The run table: one row per run or per scored case, with masked texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .judging import run_summary
from .metadata import mask_record, with_preview


def batch_record(
    judged: DataFrame,
    run_id: str,
    variant: str,
    tags: list[str] | None = None,
    dataset_sha256: str | None = None,
    started_at: Column | None = None,
    duration_ms: int | None = None,
) -> DataFrame:
    """One row for a scored run. The means and counts are those of ``run_summary``.

    Without ``tags`` a batch carries ``batch_evaluation`` and those of its variant and run.
    """
    tags = ["batch_evaluation", f"variant_{variant}", f"run_{run_id}"] if tags is None else tags
    tag_list = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
    rate_tag = F.concat(
        F.lit("pass_rate_"), F.col("passed_cases").cast("string"), F.lit("/"), F.col("total_cases").cast("string")
    )
    return run_summary(judged).select(
        F.lit(run_id).alias("run_id"),
        F.lit(variant).alias("variant"),
        "total_cases",
        "passed_cases",
        "parse_failed_cases",
        "average_score",
        F.concat(tag_list, F.array(F.lit("completed"), rate_tag)).alias("tags"),
        F.lit(dataset_sha256).cast("string").alias("dataset_sha256"),
        (F.lit(None) if started_at is None else started_at).cast("timestamp").alias("started_at"),
        F.lit(duration_ms).cast("bigint").alias("duration_ms"),
    )


def case_records(
    judged: DataFrame, run_id: str, input_text: str, output_text: str, case_id: str = "case_id"
) -> DataFrame:
    """One row per scored case with masked previews of both texts."""
    shown = with_preview(judged, input_text, "input_preview")
    shown = with_preview(shown, output_text, "output_preview")
    # as in the source of these records, a score of zero is tagged like no score at all
    own = F.col("weighted_final_score")
    score = F.when(own != 0, own.cast("string")).otherwise(F.lit("failed"))
    return shown.select(
        F.lit(run_id).alias("run_id"),
        F.col(case_id).cast("string").alias("case_id"),
        "input_preview",
        "output_preview",
        F.col("weighted_final_score").alias("final_score"),
        "passed",
        F.array(F.lit("completed"), F.concat(F.lit("score_"), score)).alias("tags"),
    )


def append_records(records: DataFrame, path: str) -> None:
    """Adds a run to a run table, masking every text first.

    The table is partitioned by ``run_id``; a run that is there already is replaced, so a job
    that is repeated leaves one copy.
    """
    rows = mask_record(records).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy("run_id").parquet(path)


def parse_run_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """``time | key=value | key=value`` lines as logged_at, run_id, variant and a map."""
    at = F.instr(line, " | ")
    fields = F.str_to_map(
        F.when(at > 0, F.substring(F.col(line), at + 3, F.length(line))).otherwise(F.lit("")),
        F.lit(" \\| "),
        F.lit("="),
    )
    parsed = lines.where(F.trim(line) != "").select(
        F.when(at > 0, F.substring(F.col(line), F.lit(1), at - 1)).otherwise(F.col(line)).alias("logged_at"),
        fields.alias("fields"),
    )
    return parsed.select(
        "logged_at",
        F.col("fields")["run_id"].alias("run_id"),
        F.col("fields")["variant"].alias("variant"),
        F.col("fields")["parse_failed"].try_cast("bigint").alias("parse_failed"),
        F.col("fields")["avg_score"].try_cast("double").alias("avg_score"),
        "fields",
    )
