"""Agreement between two annotators or between a judge and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed


def complete_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows in which both scores are present, as double columns ``a`` and ``b``."""
    return df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()


def label_of(score: Column) -> Column:
    """Score as a whole label, halves to the even neighbour."""
    return F.rint(score).cast("bigint")


def confusion(pairs: DataFrame) -> DataFrame:
    """Pairs per (label_a, label_b). Everything else is derived from this small table."""
    return (
        pairs.select(label_of(F.col("a")).alias("label_a"), label_of(F.col("b")).alias("label_b"))
        .groupBy("label_a", "label_b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def label_space(pairs: DataFrame) -> DataFrame:
    """The distinct labels of both annotators, sorted."""
    cells = confusion(pairs)
    return cells.select(F.col("label_a").alias("label")).union(cells.select("label_b")).distinct().orderBy("label")


def marginals(cells: DataFrame) -> DataFrame:
    """Per label how often each annotator gave it and how often both did."""
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label_a").alias("label"), F.col("n").alias("n_a"), F.lit(0).cast("bigint").alias("n_b")),
                F.struct(F.col("label_b").alias("label"), F.lit(0).cast("bigint").alias("n_a"), F.col("n").alias("n_b")),
            )
        ).alias("s"),
        F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0).alias("both"),
    )
    # an agreeing cell yields two rows, so its count is halved again
    return sides.groupBy("s.label").agg(
        F.sum("s.n_a").alias("n_a"), F.sum("s.n_b").alias("n_b"), (F.sum("both") / 2).cast("bigint").alias("n_both")
    )


def kappa_report(df: DataFrame, a: str, b: str, min_pairs: int = fixed.MIN_KAPPA_PAIRS) -> DataFrame:
    """One row: status, n_pairs, labels, observed and expected agreement, kappa, targets.

    The data is scanned once and reduced to one row per label pair before the first shuffle;
    marginals and the final row are aggregates of that table. Under ``min_pairs`` pairs the
    status is ``insufficient`` and the figures are NULL.
    """
    per_label = marginals(confusion(complete_pairs(df, a, b)))
    n = F.sum("n_a")
    totals = per_label.agg(
        F.coalesce(n, F.lit(0)).alias("n_pairs"),
        F.sort_array(F.collect_set("label")).alias("labels"),
        F.sum("n_both").alias("agreeing"),
        F.sum(F.col("n_a").cast("double") * F.col("n_b")).alias("chance"),
    )
    n = F.col("n_pairs").cast("double")
    enough = F.col("n_pairs") >= min_pairs
    observed = F.col("agreeing") / n
    expected = F.col("chance") / (n * n)
    figures = totals.select(
        "n_pairs",
        "labels",
        F.when(enough, observed).alias("observed_agreement"),
        F.when(enough, expected).alias("expected_agreement"),
        F.when(enough, "ok").otherwise("insufficient").alias("status"),
    )
    po, pe = F.col("observed_agreement"), F.col("expected_agreement")
    kappa = F.when(pe == 1, 1.0).when(pe.isNotNull(), (po - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return figures.select(
        "status",
        "n_pairs",
        F.when(enough, F.col("labels")).alias("labels"),
        "observed_agreement",
        "expected_agreement",
        kappa.alias("cohens_kappa"),
        F.struct(
            F.lit(fixed.TARGET_AGREEMENT).alias("agreement_pct"),
            F.lit(fixed.TARGET_KAPPA).alias("kappa"),
        ).alias("targets"),
    )


def agreement_record(report: DataFrame) -> DataFrame:
    """What of a :func:`kappa_report` is written: its figures, if there were enough pairs for any."""
    return report.where("status = 'ok'").drop("status")


def within_one(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Pairs, share within one point and mean absolute error, per group or overall."""
    gap = F.abs(F.col(a).cast("double") - F.col(b).cast("double"))
    pairs = df.select(*(by or []), gap.alias("gap")).where("gap IS NOT NULL")
    return pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg((F.col("gap") <= 1).cast("int")).alias("within_one"),
        F.avg("gap").alias("mae"),
    )


def calibration(judge_scores: DataFrame, human_scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean absolute error and share within one point per criterion, judge against people.

    Both tables are long (case_id, criterion, score). Repeated scores of one side are averaged first, so that a case
    counts once. One shuffle: both sides meet in one aggregate.
    """
    def side(df: DataFrame, judge: bool) -> DataFrame:
        own, other = ("judge_score", "human_score") if judge else ("human_score", "judge_score")
        return df.select("case_id", "criterion", F.col("score").cast("double").alias(own), F.lit(None).cast("double").alias(other))

    both = side(judge_scores, True).unionByName(side(human_scores, False)).where("case_id IS NOT NULL AND criterion IS NOT NULL")
    pairs = both.groupBy("case_id", "criterion").agg(F.avg("judge_score").alias("judge_score"), F.avg("human_score").alias("human_score"))
    return within_one(pairs, "judge_score", "human_score", by or ["criterion"])


def review_sample(a: DataFrame, b: DataFrame, n: int = 30, seed: int = 7) -> DataFrame:
    """``n`` cases for review with both variants' scores and room for two annotators.

    The choice follows a hash of case id and seed, so it is the same on every run. Both tables are read once and meet in
    one aggregate, which holds the smallest row per case and variant; then each task keeps its ``n`` smallest hashes.
    """
    cols = ["final_score", "passed", "failed_judge_parse"]

    def side(df: DataFrame, variant: str) -> DataFrame:
        return df.where(F.col("case_id").isNotNull()).select("case_id", F.lit(variant).alias("variant"), F.struct(*cols).alias("row"))

    least = [F.min(F.when(F.col("variant") == v, F.col("row"))).alias(v) for v in "AB"]
    cases = side(a, "A").unionByName(side(b, "B")).groupBy("case_id").agg(*least).where("A IS NOT NULL AND B IS NOT NULL")
    chosen = cases.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("case_id").cast("string"))), "case_id").limit(n)

    def both(field: str) -> Column:
        return F.create_map(F.lit("A"), F.col("A")[field], F.lit("B"), F.col("B")[field])

    return chosen.select(
        "case_id",
        both("final_score").alias("model_scores"),
        both("passed").alias("model_passed"),
        both("failed_judge_parse").alias("parse_failed"),
        F.create_map().cast("map<string,double>").alias("human_scores"),
        F.lit("").alias("notes"),
    )


def pii_hit_rate(masked: DataFrame, by: str = "pii_type") -> DataFrame:
    """Per kind of labelled sentence: how many were masked exactly as labelled.

    Input columns: ``by``, masked_text, expected_mask.
    """
    exact = F.col("masked_text").eqNullSafe(F.col("expected_mask")).cast("int")
    return masked.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(exact).alias("exact"), F.avg(exact).alias("rate")
    )
