"""Aggregates over checked cases and exact percentiles of any numeric column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.barrier import settled


def batch_report(summary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Severity counts, violation totals, clean rate and verdict, per group or overall.

    Input rows are those of ``summarize``. Partial sums are made before the shuffle, so one
    group holding most of the rows costs no more than many small ones.
    """
    n, types = F.col("total_cases"), F.col("pii_hits_total")
    totals = summary.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("severity") == "pass").alias("passed"),
        F.count_if(F.col("severity") == "warn").alias("warned"),
        F.count_if(F.col("severity") == "fail").alias("failed"),
        F.count_if(~F.col("json_valid")).alias("json_invalid"),
        F.coalesce(F.sum("pii_hits_total"), F.lit(0)).cast("bigint").alias("pii_hits_total"),
        F.coalesce(F.sum("nogo_hits_total"), F.lit(0)).cast("bigint").alias("nogo_hits_total"),
        F.count_if(~F.col("cta_present")).alias("cta_missing"),
        F.count_if(~F.col("length_ok")).alias("length_violations"),
        F.count_if(F.col("pii_hits_total") > 0).alias("high_risk_leaks"),
    )
    rate = F.when(n > 0, (n - types) / n * 100)
    return totals.withColumn("pii_clean_rate", rate).withColumn(
        "accepted",
        F.coalesce(
            (F.col("pii_clean_rate") >= fixed.PII_CLEAN_TARGET) & (F.col("high_risk_leaks") == 0),
            F.lit(False),
        ),
    )


def split_counts(df: DataFrame, by: str = "phase") -> DataFrame:
    """Rows per group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def pii_totals(counted: DataFrame, labels: list[str]) -> DataFrame:
    """Matches per type over a dataset, one row per type that occurs, with ``total_rows``.

    Input is the frame with one count column per type. All sums are taken in one row first,
    so the shuffle carries one partial row per task.
    """
    sums = counted.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.coalesce(F.sum(t), F.lit(0)).cast("bigint").alias(t) for t in labels],
    )
    return sums.unpivot(["total_rows"], labels, "type", "matches").where("matches > 0")


def pii_totals_map(counted: DataFrame, labels: list[str]) -> DataFrame:
    """The same as one row: ``total_rows`` and ``pii_matches map<type, n>``."""
    sums = counted.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.coalesce(F.sum(t), F.lit(0)).cast("bigint").alias(t) for t in labels],
    )
    entries = F.array(*[F.struct(F.lit(t).alias("key"), F.col(t).alias("value")) for t in labels])
    found = F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))
    return sums.select("total_rows", found.alias("pii_matches"))


def order_key(number: Column) -> Column:
    """A long that sorts as the double does: its bits, those of negative numbers turned round."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), number).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFF_FFFF_FFFF_FFFF))).otherwise(bits)


def percentiles(
    df: DataFrame,
    value: str,
    points: tuple[float, ...] = (0.5, 0.95, 0.99),
    by: tuple[str, ...] = (),
    accuracy: int = 1 << 16,
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group and point. NULL and NaN values are left out.

    The built-in exact percentile keeps every distinct value of a group in one task. Here rows are counted per group and
    value, combined before the shuffle, which deals by both. The counts are added up over ever wider brackets of values,
    each of at most ``accuracy`` brackets of the level below. Then the two ranks next to each point are followed down:
    the group's widest brackets say which of them holds the rank, that one's own brackets which of those does, and so on
    to the value. A window sees at most ``accuracy`` rows, whatever the group holds, and a level is joined by group and
    bracket, of which one is asked for per group and rank. Brackets are leading bits of the number, so nothing is guessed.
    """
    keys = [f"__k{i}" for i in range(len(by))] or ["__all"]
    group_keys = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("__all")]
    data = settled(df.select(*group_keys, F.col(value).cast("double").alias("__v")), ["__v"])  # the value is worked out once
    data = data.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    counts = data.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    bits = max(1, accuracy.bit_length() - 1)
    levels = [counts.withColumn("__b", order_key(F.col("__v") + F.lit(0.0)))]
    for _ in range((63 + bits) // bits - 1):
        wider = levels[-1].select(*keys, F.shiftright("__b", bits).alias("__b"), "__c")
        levels.append(wider.groupBy(*keys, "__b").agg(F.sum("__c").alias("__c")))

    def holding(rows: DataFrame, part: list[str], rank: str) -> DataFrame:
        """The brackets of each part that hold the rank, which is counted from their start from then on."""
        upto = F.sum("__c").over(Window.partitionBy(*part).orderBy("__b"))
        found = rows.withColumn("__upto", upto).withColumn("__rank", F.col(rank) - (F.col("__upto") - F.col("__c")))
        return found.where((F.col("__rank") >= 0) & (F.col("__rank") < F.col("__c")))

    n = F.sum("__c").over(Window.partitionBy(*keys))
    target = (F.col("__n") - 1) * F.col("__p")
    asked = levels[-1].withColumn("__n", n).withColumn("__upto", F.sum("__c").over(Window.partitionBy(*keys).orderBy("__b")))
    asked = asked.select("*", F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("__p"))
    asked = asked.select("*", F.inline(F.array(
        F.struct(F.lit(0).alias("__side"), F.floor(target).alias("__ask")), F.struct(F.lit(1).alias("__side"), F.ceil(target).alias("__ask")),
    )))
    asked = asked.withColumn("__rank", F.col("__ask") - (F.col("__upto") - F.col("__c")))
    asked = asked.where((F.col("__rank") >= 0) & (F.col("__rank") < F.col("__c")))
    about = ["__p", "__side", "__n"]
    for level in reversed(levels[:-1]):
        sides = asked.select(*[F.col(k).alias(f"{k}_a") for k in keys], F.col("__b").alias("__in"), *about, F.col("__rank").alias("__ask"))
        same = F.shiftright("__b", bits) == F.col("__in")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_a"))
        asked = holding(level.join(sides, same), [*keys, "__p", "__side"], "__ask")
    ends = asked.groupBy(*keys, "__p", "__n").agg(
        F.max(F.when(F.col("__side") == 0, F.col("__v"))).alias("__lo"), F.max(F.when(F.col("__side") == 1, F.col("__v"))).alias("__hi")
    )
    exact = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (target - F.floor(target))
    return ends.select(*[F.col(key).alias(c) for c, key in zip(by, keys)], F.col("__p").alias("point"), exact.alias("percentile"))


def top_causes(violations: DataFrame, cause: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per cause (and group), the ``k`` most frequent causes overall.

    Input is one row per violation. Ties go to the smaller cause.
    """
    counts = violations.groupBy(cause, *by).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), F.asc(cause)).limit(k)
    best = (
        counts.groupBy(cause).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), F.asc(cause)).limit(k)
    )
    return counts.join(F.broadcast(best.select(cause)), cause, "left_semi")


def violation_causes(checked: DataFrame) -> DataFrame:
    """One row per violated rule of a case: case_id, phase, cause."""
    c = F.col("checks")
    listed = F.concat(
        F.transform(c["pii_hits"], lambda h: F.concat(F.lit("pii:"), h["type"])),
        F.transform(c["nogo_hits"], lambda h: F.concat(F.lit("nogo:"), h["key"])),
        F.array_compact(
            F.array(
                F.when(~c["cta_present"], F.lit("cta:missing")),
                F.when(~c["length_ok"], F.lit("length:over")),
                F.when(~c["json_valid"], F.lit("json:invalid")),
            )
        ),
    )
    return checked.select("case_id", "phase", F.explode(listed).alias("cause"))


def rates(df: DataFrame, text: str, patterns: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Share of texts in which each pattern (Python notation) is found, per group."""
    from ..functions.regex import to_java

    hits = df.select(
        *by,
        *[
            F.coalesce(F.col(text).rlike(to_java(p)), F.lit(False)).cast("int").alias(name)
            for name, p in patterns.items()
        ],
    )
    return hits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(name).alias(name) for name in patterns]
    )
