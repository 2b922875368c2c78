"""Sinks. Each result goes to its own path; nothing is gathered to one file."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.judging import score_file_columns


def report_paths(out: str) -> tuple[str, str]:
    """Paths of the detailed and the flat report, which always differ."""
    stem = out.rstrip("/")
    for ending in (".csv", ".json"):
        stem = stem.removesuffix(ending)
    return stem + "_detailed.json", stem + ".csv"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_scores(wide: DataFrame, path: str) -> None:
    """A score table as CSV, with the failure text in place of a missing score."""
    write_csv(score_file_columns(wide), path)


def store_by_case(df: DataFrame, table: str, path: str, buckets: int, key: str = "case_id") -> DataFrame:
    """The rows as a table in buckets of their case, sorted by it. Tables of equally many buckets meet by case without an
    exchange: checks stored so and cases stored so go through the gate where they lie, texts included."""
    rows = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    rows.option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
