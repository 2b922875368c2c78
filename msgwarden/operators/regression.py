"""Comparison of two score tables and of whole runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.numbers import at_least, float_of

A, B = "A", "B"


def usable_score(df: DataFrame, score: str = "final_score") -> Column:
    """The score as a number, NULL where it is missing or no number. NaN stays NaN."""
    if dict(df.dtypes)[score] == "string":
        return float_of(f"`{score}`")
    return F.col(score).cast("double")


def _flag(column: str) -> Column:
    return F.coalesce(F.lower(F.col(column).cast("string")) == "true", F.lit(False))


def side(df: DataFrame, variant: str, score: str = "final_score") -> DataFrame:
    """One variant's rows in the common shape: variant, case_id, score, passed, failed."""
    return df.select(
        F.lit(variant).alias("variant"),
        F.col("case_id").cast("string").alias("case_id"),
        usable_score(df, score).alias("score"),
        _flag("passed").alias("passed"),
        _flag("failed_judge_parse").alias("failed"),
    )


def both(a: DataFrame, b: DataFrame, score: str = "final_score") -> DataFrame:
    """Both variants in one long table; the form in which score lists are kept."""
    return side(a, A, score).unionByName(side(b, B, score))


def compare(
    a: DataFrame,
    b: DataFrame,
    names: tuple[str, str] = (A, B),
    score: str = "final_score",
    count_failures_in: str = "all",
    threshold: float = fixed.PROMOTION_DELTA,
) -> DataFrame:
    """One row with both variants' means and counts, the deltas and the promotion flag.

    A single aggregate over the union: every task sends one partial row. Rows without a
    usable score never enter the mean or the pass count. With ``count_failures_in='usable'``
    they do not count as parse failures either; ``'all'`` counts every marked failure.
    Values are unrounded; :func:`summary_record` rounds. ``rows_differ`` tells that the two
    tables have different sizes, which forbids the comparison.
    """
    if count_failures_in not in ("all", "usable"):
        raise ValueError("count_failures_in must be 'all' or 'usable'")

    def stats(v: str) -> list[Column]:
        mine, usable = F.col("variant") == v, F.col("score").isNotNull()
        fails = mine & F.col("failed")
        if count_failures_in == "usable":
            fails = fails & usable
        low = v.lower()
        return [
            F.count_if(mine).alias(f"rows_{low}"),
            F.coalesce(F.avg(F.when(mine, F.col("score"))), F.lit(0.0)).alias(f"avg_{low}"),
            F.count_if(mine & usable & F.col("passed")).alias(f"passed_{low}"),
            F.count_if(fails).alias(f"parse_failed_{low}"),
        ]

    totals = both(a, b, score).agg(*stats(A), *stats(B))
    delta = F.col("avg_b") - F.col("avg_a")
    return totals.select(
        F.lit(names[0]).alias("name_a"),
        F.lit(names[1]).alias("name_b"),
        "*",
        (F.col("rows_a") != F.col("rows_b")).alias("rows_differ"),
        delta.alias("score_improvement"),
        F.when(F.col("avg_a") != 0, delta / F.col("avg_a") * 100)
        .otherwise(0.0)
        .alias("improvement_percentage"),
        (F.col("parse_failed_a") - F.col("parse_failed_b")).alias("parse_failure_delta"),
        (at_least(delta, threshold) & (F.col("parse_failed_b") <= F.col("parse_failed_a"))).alias(
            "meets_promotion_threshold"
        ),
    )


def round_half_even(value: Column, digits: int) -> Column:
    """Rounds the double to the nearest decimal, exact ties to even; NaN and infinities stay.

    What looks like a tie in the shortest decimal form, such as 4.4145 at three digits, mostly is none in binary. The
    double times ten to the digits is therefore taken exactly, as the rounded product and its rounding error (found by
    splitting both factors), and compared with the half between the decimals below and above.
    """
    finite = ~F.isnan(value) & (F.abs(value) < 1e15)
    x, scale, splitter = F.when(finite, value), 10.0**digits, 134217729.0
    scaled = x * scale
    high = x * splitter - (x * splitter - x)
    scale_high = scale * splitter - (scale * splitter - scale)
    low, scale_low = x - high, scale - scale_high
    error = ((high * scale_high - scaled) + high * scale_low + low * scale_high) + low * scale_low
    below = F.floor(scaled).cast("double")
    over = (scaled - (below + 0.5)) + error
    nearest = F.when(over > 0, (below + 1) / scale).when(over < 0, below / scale).otherwise(F.bround(x, digits))
    return F.when(finite, nearest).otherwise(value)


def summary_record(compared: DataFrame, dataset_path: str, sha256: Column | None = None) -> DataFrame:
    """The comparison as the nested, rounded summary record."""

    def part(v: str) -> Column:
        return F.struct(
            F.col(f"name_{v}").alias("name"),
            round_half_even(F.col(f"avg_{v}"), 3).alias("avg_score"),
            F.col(f"passed_{v}").alias("passed"),
            F.col(f"parse_failed_{v}").alias("parse_failed"),
        )

    digest = F.lit(None).cast("string") if sha256 is None else sha256
    return compared.select(
        F.struct(F.lit(dataset_path).alias("path"), digest.alias("sha256")).alias("dataset"),
        part("a").alias("variant_a"),
        part("b").alias("variant_b"),
        round_half_even(F.col("score_improvement"), 3).alias("score_improvement"),
        round_half_even(F.col("improvement_percentage"), 2).alias("improvement_percentage"),
        "parse_failure_delta",
        "meets_promotion_threshold",
    )


def promotion(compared: DataFrame, report_a: DataFrame, report_b: DataFrame) -> DataFrame:
    """The comparison with ``not_worse`` (personal data and policy, from both batch reports) and ``promote``: the score
    rule and that one together. All three are tables of one row."""
    guarded = policy_not_worse(report_a, report_b).select("not_worse")
    return compared.crossJoin(guarded).withColumn("promote", F.col("meets_promotion_threshold") & F.col("not_worse"))


def variant_name(path: str, fallback: str) -> str:
    """Text behind the last ``_`` of the file's stem, or the fallback."""
    stem = path.rstrip("/").rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem.lstrip(".") else stem
    return stem.rsplit("_", 1)[1] if "_" in stem else fallback


def variant_name_column(path: Column, fallback: str) -> Column:
    """The same for a column of paths, such as the input file name."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*\z", 1), r"(?<=.)\.[^.]*\z", "")
    return F.when(stem.contains("_"), F.element_at(F.split(stem, "_"), -1)).otherwise(fallback)


def by_case(a: DataFrame, b: DataFrame, score: str = "final_score") -> DataFrame:
    """Per case_id both scores, their difference and where the case occurs.

    Each side is reduced to one row per case before the join (mean of its usable scores), so
    a repeated id cannot multiply rows.
    """

    def one(df: DataFrame, v: str) -> DataFrame:
        return (
            side(df, v, score)
            .groupBy("case_id")
            .agg(F.avg("score").alias(f"score_{v.lower()}"), F.lit(True).alias(f"in_{v.lower()}"))
        )

    joined = one(a, A).join(one(b, B), "case_id", "full_outer")
    where = (
        F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").otherwise("both")
    )
    return joined.select(
        "case_id", "score_a", "score_b", (F.col("score_b") - F.col("score_a")).alias("delta"),
        where.alias("found_in"),
    )


def by_criterion(long_a: DataFrame, long_b: DataFrame) -> DataFrame:
    """Mean per criterion for both variants and the difference."""
    rows = long_a.select(F.lit(A).alias("variant"), "criterion", "score").unionByName(
        long_b.select(F.lit(B).alias("variant"), "criterion", "score")
    )
    a = F.avg(F.when(F.col("variant") == A, F.col("score")))
    b = F.avg(F.when(F.col("variant") == B, F.col("score")))
    return rows.groupBy("criterion").agg(
        a.alias("avg_a"), b.alias("avg_b"), (b - a).alias("delta")
    )


def run_deltas(runs: DataFrame, before: str, after: str, metrics: list[str], key: str = "run_id") -> DataFrame:
    """Difference of each metric between two runs of a run table, one row."""
    def of(run: str, metric: str) -> Column:
        return F.max(F.when(F.col(key) == run, F.col(metric)))

    return runs.where(F.col(key).isin(before, after)).agg(
        *[(of(after, m) - of(before, m)).alias(f"{m}_delta") for m in metrics]
    )


def policy_not_worse(report_a: DataFrame, report_b: DataFrame) -> DataFrame:
    """One row: whether B has no more personal-data cases and forbidden wording than A."""
    cols = ["high_risk_leaks", "nogo_hits_total"]
    rows = report_a.select(F.lit(A).alias("v"), *cols).unionByName(
        report_b.select(F.lit(B).alias("v"), *cols)
    )
    of = lambda v, c: F.coalesce(F.max(F.when(F.col("v") == v, F.col(c))), F.lit(0))
    return rows.agg(
        *[(of(B, c) - of(A, c)).alias(f"{c}_delta") for c in cols],
        ((of(B, cols[0]) <= of(A, cols[0])) & (of(B, cols[1]) <= of(A, cols[1]))).alias("not_worse"),
    )


_PRIME = 2_147_483_647


def poisson_limits() -> list[int]:
    """Cumulative Poisson(1) probabilities scaled to the draw's range, while they differ."""
    limits, k, mass, total = [], 0, math.exp(-1.0), 0.0
    while int((total + mass) * _PRIME) > int(total * _PRIME):
        total += mass
        limits.append(int(total * _PRIME))
        k += 1
        mass /= k
    return limits


def bootstrap(paired: DataFrame, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Replicates of the mean difference, from per-case deltas (:func:`by_case`).

    Every case gets a Poisson(1) weight per replicate, so no case list is ever gathered or
    redrawn: a replicate is a weighted mean. Weights follow from the case id and the seed by
    ``(h1 + replicate * h2) mod p``, so they do not change with partitioning or on a retry.
    Rows are multiplied by ``replicates`` inside the task and summed before the shuffle,
    which carries one partial row per task and replicate.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col("case_id").cast("string")))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") % _PRIME
    cases = paired.where(F.col("delta").isNotNull()).select(
        "delta", part(1).alias("h1"), part(9).alias("h2")
    )
    drawn = cases.select(
        "delta", "h1", "h2", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    )
    u = (F.col("h1") + F.col("replicate") * F.col("h2")) % _PRIME
    limits = poisson_limits()
    weight = F.lit(len(limits))
    for k in reversed(range(len(limits))):
        weight = F.when(u < limits[k], k).otherwise(weight)
    return (
        drawn.select("replicate", "delta", weight.alias("w"))
        .groupBy("replicate")
        .agg(F.sum("w").alias("weight"), F.sum(F.col("delta") * F.col("w")).alias("total"))
        .select("replicate", "weight", F.when(F.col("weight") > 0, F.col("total") / F.col("weight")).alias("mean_delta"))
    )


#: Up to so many equal deltas a weight is drawn by exact inversion, which takes this many steps at most; beyond, the
#: normal quantile is corrected for skew, by which chances are off by less than one in a thousand.
EXACT_UP_TO, MOST_DRAWN = 50, 150


def bootstrap_of_deltas(paired: DataFrame, replicates: int = 200, seed: int = 7) -> DataFrame:
    """:func:`bootstrap` at the cost of the distinct deltas, however many cases there are.

    Cases whose deltas agree to nine decimals are counted first, combined before the shuffle. The Poisson(1) weights of n
    cases add up to one Poisson(n) weight, so each distinct delta draws one for each replicate, by inversion of a number that
    follows from delta, seed and replicate. Replicates are distributed as those of ``bootstrap``, though not the same ones.
    """
    counts = paired.where(F.col("delta").isNotNull()).groupBy(F.round(F.col("delta") * 1e9).cast("bigint").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col("d").cast("string")))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") % _PRIME
    hashed = counts.select("d", F.col("n").cast("double").alias("n"), *[part(1 + 8 * i).alias(f"h{i}") for i in range(4)])
    drawn = hashed.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    uniform = lambda a, b: (((F.col(f"h{a}") + F.col("replicate") * F.col(f"h{b}")) % _PRIME) + 0.5) / _PRIME
    drawn = drawn.select("d", "n", "replicate", uniform(0, 1).alias("u"), uniform(2, 3).alias("v"))
    n, u = F.col("n"), F.col("u")

    def step(state: Column, k: Column) -> Column:
        mass = state["mass"] * n / k
        on = F.struct(mass.alias("mass"), (state["total"] + mass).alias("total"), k.cast("bigint").alias("k"))
        return F.when(u < state["total"], state).otherwise(on)

    first = F.struct(F.exp(-n).alias("mass"), F.exp(-n).alias("total"), F.lit(0).cast("bigint").alias("k"))
    exact = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_DRAWN)), first, step, lambda s: s["k"])
    z = F.col("z")
    many = F.floor(n + z * F.sqrt(n) + (z * z - 1) / 6 + (z - z * z * z) / (72 * F.sqrt(n)) + 0.5)
    normal = F.sqrt(F.log(u) * -2) * F.cos(F.col("v") * (2 * math.pi))
    weight = F.when(n <= EXACT_UP_TO, exact).otherwise(F.greatest(F.lit(0), many))
    weighed = drawn.withColumn("z", normal).select("replicate", (F.col("d") / 1e9).alias("delta"), weight.cast("bigint").alias("w"))
    return (
        weighed.groupBy("replicate")
        .agg(F.sum("w").alias("weight"), F.sum(F.col("delta") * F.col("w")).alias("total"))
        .select("replicate", "weight", F.when(F.col("weight") > 0, F.col("total") / F.col("weight")).alias("mean_delta"))
    )
