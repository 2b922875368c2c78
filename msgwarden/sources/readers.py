"""Readers. Every schema is declared; nothing is inferred from the data."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import float_of
from .scans import csv_records, json_items, placed_lines

CASES = "id string, phase string, input string, expected_output string, max_words int, no_go_terms string"
CASES_FROZEN = "id string, phase string, input string, expected_output string, max_words string, no_go_terms string"
RUBRIC = "criterion string, weight double, description string, score_0 string, score_1 string, score_2 string, score_3 string, score_4 string, score_5 string"
LABELLED = "id int, text string, pii_type string, expected_mask string"
_ITEM = (
    "struct<case_id:string,model_scores:map<string,string>,model_passed:map<string,boolean>,"
    "parse_failed:map<string,boolean>,human_scores:map<string,string>,notes:string>"
)
_PAIR = "case_id string, llm_score double, human_score double"


def read_table(spark: SparkSession, path: str, spread: int | None = None) -> DataFrame:
    """A parquet table, read in the splits it has.

    ``spread`` deals the rows to that many tasks instead, at the price of a shuffle. That may pay
    for a table of very few row groups whose texts are searched, since searching costs far more
    per byte than reading; the caller decides.
    """
    df = spark.read.parquet(path)
    return df if spread is None else df.repartition(spread)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV table: reads a header line, not the data."""
    return spark.read.option("header", True).option("escape", '"').csv(path).columns


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool | str = True) -> DataFrame:
    """A CSV table with header and quoted fields; columns are matched by name.

    Columns of ``schema`` that the files lack are left out, others are kept as strings. Line breaks in quoted fields are
    allowed, and a file is still read by as many tasks as it has splits. ``multi_line`` False reads files without such
    breaks, which takes no exchange; "whole" reads each file in one task, for many small ones or for quotes in the
    middle of fields that have none around them.
    """
    declared = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
    names = csv_columns(spark, path)
    typed = T.StructType([T.StructField(n, declared.get(n, T.StringType())) for n in names])
    if multi_line is True:
        records = csv_records(placed_lines(spark, path)).where(~F.col("first"))
        return csv_fields(records, "record", typed)
    return (
        spark.read.schema(typed)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line == "whole")
        .csv(path)
    )


def csv_fields(records: DataFrame, record: str, typed: T.StructType) -> DataFrame:
    """The fields of CSV records, which may hold quoted line breaks, in the order of ``typed``."""
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in typed)
    return records.select(F.from_csv(F.col(record), F.lit(schema), {"escape": '"', "multiLine": "true"}).alias("c")).select("c.*")


def read_cases(spark: SparkSession, path: str, multi_line: bool | str = True) -> DataFrame:
    return read_csv(spark, path, CASES, multi_line)


def read_frozen_cases(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines in which every value is a text; numbers are cast where they are numbers."""
    return typed_frozen(spark.read.schema(CASES_FROZEN).json(path))


def typed_frozen(frozen: DataFrame) -> DataFrame:
    return frozen.withColumn("max_words", F.col("max_words").try_cast("int"))


def frozen_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """:func:`read_frozen_cases` for lines that are already in a table."""
    return typed_frozen(lines.select(F.from_json(line, CASES_FROZEN).alias("c")).select("c.*"))


def case_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """:func:`read_cases` for CSV records that are already in a table, columns in the declared order."""
    return lines.select(F.from_csv(F.col(line), F.lit(CASES), {"escape": '"'}).alias("c")).select("c.*")


def score_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Records of a score file that are already in a table: case_id, final_score, passed, failed_judge_parse."""
    schema = "case_id string, final_score string, passed string, failed_judge_parse string"
    return lines.select(F.from_csv(F.col(line), F.lit(schema), {"escape": '"'}).alias("s")).select("s.*")


def annotation_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """:func:`read_annotation_lines` for lines that are already in a table."""
    return annotator_scores(lines.select(F.from_json(line, _ITEM).alias("item")).select("item.*"))


def read_rubric(spark: SparkSession, path: str) -> DataFrame:
    """Criteria and weights, from CSV or JSON lines."""
    if path.rstrip("/").endswith((".json", ".jsonl")):
        text = ", ".join(c.split()[0] + " string" for c in RUBRIC.split(", "))
        table = spark.read.schema(text).json(path)
        return table.withColumn("weight", float_of("weight"))
    return read_csv(spark, path, RUBRIC)


def read_scores(spark: SparkSession, path: str, multi_line: bool | str = True) -> DataFrame:
    """A score table; ``final_score`` stays text because it may say that parsing failed.

    Files that name the column ``weighted_final_score`` are read alike.
    """
    table = read_csv(spark, path, "case_id string, final_score string", multi_line)
    if "final_score" not in table.columns and "weighted_final_score" in table.columns:
        table = table.withColumnRenamed("weighted_final_score", "final_score")
    for name in ("passed", "failed_judge_parse"):
        if name not in table.columns:
            table = table.withColumn(name, F.lit(None).cast("string"))
    return table


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotated cases, one row each, with the scores of both annotators as numbers.

    They are the list ``items`` of a JSON document, which is read by as many tasks as it has splits.
    """
    return annotated_items(placed_lines(spark, path, "}"))


def annotated_items(pieces: DataFrame) -> DataFrame:
    """:func:`read_annotations` for documents that are already in a table, as the pieces before each closing brace."""
    return annotation_lines(json_items(pieces, "items"), "item")


def read_annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from JSON lines, one case per line, which splits over tasks."""
    fields = T._parse_datatype_string(_ITEM)
    return annotator_scores(spark.read.schema(fields).json(path))


def annotator_scores(items: DataFrame) -> DataFrame:
    return items.select(
        "*",
        float_of("human_scores['annotator_a']").alias("annotator_a"),
        float_of("human_scores['annotator_b']").alias("annotator_b"),
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The list ``pairs`` of a JSON document, read as :func:`read_annotations` reads."""
    return pairs_of(placed_lines(spark, path, "}"))


def pairs_of(pieces: DataFrame) -> DataFrame:
    return json_items(pieces, "pairs").select(F.from_json("item", _PAIR).alias("p")).select("p.*")


def read_json_document(spark: SparkSession, path: str) -> dict:
    """A small JSON document such as a schema or a rule table, for building a query."""
    whole = spark.read.option("wholetext", True).text(path).limit(1).collect()
    return json.loads(whole[0][0])


def read_template(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).limit(1).collect()[0][0]


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def column_or(df: DataFrame, *names: str, default: str = "") -> Column:
    """The first of the columns that exists. A NULL in it does not fall through."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    return F.lit(default)


def check_input(df: DataFrame) -> DataFrame:
    """id, phase and text to check, with the fallbacks for absent columns.

    Without an id column a generated one is used, which is unique but not consecutive.
    """
    case_id = F.col("id") if "id" in df.columns else F.monotonically_increasing_id().cast("string")
    return df.select(
        case_id.alias("id"),
        column_or(df, "phase", default="unknown").alias("phase"),
        column_or(df, "expected_output", "output").cast("string").alias("text"),
        *[c for c in ("max_words", "no_go_terms") if c in df.columns],
    )


def judge_input(df: DataFrame) -> DataFrame:
    """id, input and output of the cases to score, with the fallbacks for absent columns."""
    case_id = F.col("id") if "id" in df.columns else F.monotonically_increasing_id()
    return df.select(
        case_id.cast("string").alias("id"),
        column_or(df, "input").alias("input"),
        column_or(df, "output", "message").alias("output"),
    )


def rules_from_table(table: dict[str, str], groups: dict[str, int] | None = None, masks: dict[str, str] | None = None):
    """Rules from a JSON object of label and pattern.

    The group that is reported is 1 for a pattern with one group and 0 for one without,
    unless given. Labels of the built-in tables with an unchanged pattern keep their hints.
    """
    import re

    from ..functions.rules import NOGO_RULES, PII_RULES, Rule

    known = {r.label: r for r in (*PII_RULES, *NOGO_RULES)}
    out = []
    for label, pattern in table.items():
        if label == "iban":  # shorter matches do not count
            pattern = pattern.replace("{4,30}", "{11,30}")
        same = known.get(label)
        if same is not None and same.pattern == pattern:
            out.append(same)
            continue
        group = (groups or {}).get(label, min(1, re.compile(pattern).groups))
        out.append(Rule(label, pattern, group=group, mask=(masks or {}).get(label, f"[{label.upper()}_MASKED]")))
    return tuple(out)


