"""Raw judge answers to weighted rubric scores, pass flags and run aggregates.

One projection per answer: the answer is parsed once, each criterion is read from the parsed
value, and the weighted mean is summed in rubric order inside the row, so the result does not
depend on partitioning. Only the run aggregate shuffles, and only partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.barrier import settled
from ..functions.jsoncheck import at, kind, parse_json
from ..functions.numbers import at_least, float_sql
from ..functions.sqltext import any_of, name, quoted

Rubric = tuple[tuple[str, float], ...]
SCORES_TYPE = "array<struct<criterion:string,score:double,reason:string,weight:double>>"
_WRITTEN = r"(?U)[^\s\x1c-\x1f]"


def rubric_of(table: DataFrame) -> Rubric:
    """Criteria and weights of a rubric table. They become expressions of a query.

    The known criteria come first, in their known order, others follow by name: the order, which
    decides what an unreadable criterion hides, does not depend on how the table was read.
    """
    rows = [(r[0], r[1]) for r in table.select("criterion", F.col("weight").cast("double")).collect()]
    known = [c for c, _ in fixed.RUBRIC_WEIGHTS]
    return tuple(sorted(rows, key=lambda r: (known.index(r[0]) if r[0] in known else len(known), r[0])))


def prompt_column(template: str, input_text: Column, output_text: Column) -> Column:
    """The prompt for one case: ``{input_text}`` is filled in first, then ``{model_output}``.

    A ``{model_output}`` inside the input text is therefore filled in as well.
    """
    filled = F.replace(F.lit(template), F.lit("{input_text}"), F.coalesce(input_text, F.lit("")))
    return F.replace(filled, F.lit("{model_output}"), F.coalesce(output_text, F.lit("")))


def _score(value: str, what: str) -> str:
    """Score from the columns of its value and kind: 0 when left out, NULL when it is no number."""
    text = float_sql(f"try_variant_get({value}, '$', 'string')")
    return (
        f"CASE WHEN {what} IS NULL THEN 0.0D WHEN {what} = 'string' THEN {text}"
        f" WHEN {what} IN ('number', 'boolean') THEN try_variant_get({value}, '$', 'double') END"
    )


# Answers that are no scores at all, whatever the rubric.
_OWN_ERROR = f"({at('__v', ('error',))} IS NOT NULL AND {at('__v', ('parse_error',))} IS NOT NULL)"
_ITEMS = "try_variant_get(__v, '$', 'array<string>')"
_REFUSED = (
    f"CASE __kind WHEN 'object' THEN {_OWN_ERROR}"
    f" WHEN 'array' THEN coalesce(array_contains({_ITEMS}, 'error') AND array_contains({_ITEMS}, 'parse_error'), false)"
    " WHEN 'string' THEN contains(try_variant_get(__v, '$', 'string'), 'parse_error') ELSE true END"
)


def score_answers(
    df: DataFrame,
    answer: str = "answer",
    rubric: Rubric = fixed.RUBRIC_WEIGHTS,
    pass_score: float = fixed.PASS_SCORE,
) -> DataFrame:
    """The frame with criterion_scores, weighted_final_score, passed, failed_judge_parse and
    raw_response (the answer's text, kept on failure only).

    Criteria are read in rubric order up to the first one that is no object with a numeric
    score. Absent criteria are skipped and the weights of the others renormalised; an answer
    without any scores gets 0. A scored criterion without a written reason fails the whole
    answer.
    """
    steps = df.withColumn("__v", parse_json(F.col(answer))).withColumn("__kind", F.expr(kind("__v")))
    # each step works on the columns of the former: every value is taken out and classified once
    every = range(len(rubric))
    steps = _with(steps, {f"__c{i}": at("__v", (criterion,)) for i, (criterion, _) in enumerate(rubric)})
    fields = {f"__ck{i}": kind(f"__c{i}") for i in every}
    for field, short in (("score", "s"), ("reason", "r")):
        fields |= {f"__{short}{i}": at(f"__c{i}", (field,)) for i in every}
    steps = _with(steps, fields)
    steps = _with(steps, {f"__{x}k{i}": kind(f"__{x}{i}") for x in "sr" for i in every})
    read = {"__refused": _REFUSED}
    for i in every:
        read[f"__there{i}"] = f"__c{i} IS NOT NULL"
        read[f"__score{i}"] = f"CASE WHEN __ck{i} = 'object' THEN {_score(f'__s{i}', f'__sk{i}')} END"
        read[f"__reason{i}"] = f"CASE WHEN __rk{i} = 'string' THEN try_variant_get(__r{i}, '$', 'string') END"
    steps = _with(steps, read)
    # a criterion counts when it is present and nothing up to it was unreadable
    kept, explained = {}, []
    for i in range(len(rubric)):
        bad = any_of([f"(__there{k} AND __score{k} IS NULL)" for k in range(i + 1)])
        kept[f"__kept{i}"] = f"coalesce(__kind = 'object' AND __there{i} AND NOT {bad}, false)"
        written = f"__reason{i} RLIKE {quoted(_WRITTEN)} AND __reason{i} <> {quoted(fixed.DEFAULT_REASON)}"
        explained.append(f"(NOT __kept{i} OR coalesce({written}, false))")
    weights = [f"{float(w)!r}D" for _, w in rubric]
    points = " + ".join(["0.0D", *[f"IF(__kept{i}, __score{i} * {w}, 0.0D)" for i, w in enumerate(weights)]])
    weight = " + ".join(["0.0D", *[f"IF(__kept{i}, {w}, 0.0D)" for i, w in enumerate(weights)]])
    steps = _with(_with(steps, kept), {
        "__failed": f"__refused OR NOT ({' AND '.join(explained)})", "__total": points, "__weight": weight,
    })
    scores = ", ".join(
        f"IF(__kept{i}, struct({quoted(c)} AS criterion, __score{i} AS score, __reason{i} AS reason,"
        f" {w} AS weight), NULL)"
        for i, ((c, _), w) in enumerate(zip(rubric, weights))
    )
    raw = f"IF({_OWN_ERROR}, coalesce({at('__v', ('raw_response',), 'string')}, ''), {name(answer)})"
    made = {
        "criterion_scores": f"IF(__failed, CAST(array() AS {SCORES_TYPE}), array_compact(array({scores})))",
        "weighted_final_score": "CASE WHEN NOT __failed THEN IF(__weight > 0, __total / __weight, 0.0D) END",
        "failed_judge_parse": "__failed",
        "raw_response": f"IF(__failed, {raw}, '')",
    }
    rows = _with(steps, made).withColumn(
        "passed", at_least(F.col("weighted_final_score"), pass_score)
    )
    out = ["criterion_scores", "weighted_final_score", "passed", "failed_judge_parse", "raw_response"]
    return settled(rows.select(*df.columns, *out), out)


#: Criteria of all versions of a rubric table together; they are sent to every task.
MOST_CRITERIA = 100_000


def rubric_versions(table: DataFrame, version: str = "version") -> DataFrame:
    """One row per version of a rubric table (version, criterion, weight): its criteria in their order, as in :func:`rubric_of`."""
    known = F.array(*[F.lit(c) for c, _ in fixed.RUBRIC_WEIGHTS])
    place = F.coalesce(F.nullif(F.array_position(known, F.col("criterion")), F.lit(0)), F.lit(len(fixed.RUBRIC_WEIGHTS) + 1))
    item = F.struct(place.alias("place"), "criterion", F.col("weight").cast("double").alias("weight"))
    packed = table.groupBy(F.col(version).alias("__version")).agg(F.sort_array(F.collect_list(item)).alias("__criteria"))
    size = F.sum(F.size("__criteria")).over(Window.partitionBy())
    checked = F.when(size > MOST_CRITERIA, F.raise_error(F.lit(f"more than {MOST_CRITERIA} criteria")).cast(packed.schema["__criteria"].dataType))
    return packed.withColumn("__criteria", checked.otherwise(F.col("__criteria")))


def score_by_rubrics(
    df: DataFrame, rubrics: DataFrame, answer: str = "answer", version: str = "version", pass_score: float = fixed.PASS_SCORE
) -> DataFrame:
    """:func:`score_answers` where every row names the version of the rubric that it is scored by.

    ``rubrics`` is a table (version, criterion, weight) and stays one: its versions are sent to the tasks, up to a stated
    size, and each row takes its own criteria, so a query does not grow with them and new versions need no new query.
    An answer whose version is unknown fails.
    """
    versions = F.broadcast(rubric_versions(rubrics))
    rows = df.join(versions, F.col(version).eqNullSafe(F.col("__version")), "left")
    rows = rows.withColumn("__v", parse_json(F.col(answer))).withColumn("__kind", F.expr(kind("__v")))
    rows = _with(rows, {"__refused": f"__criteria IS NULL OR {_REFUSED}", "__members": "try_variant_get(__v, '$', 'map<string,variant>')"})
    read = "named_struct('criterion', c.criterion, 'weight', c.weight, 'value', try_element_at(__members, c.criterion))"
    rows = _with(rows, {"__read": f"transform(coalesce(__criteria, array()), c -> {read})"})
    taken = f"IF({kind('c.value')} = 'object', {at('c.value', ('score',))}, NULL)"
    fields = f"named_struct('criterion', c.criterion, 'weight', c.weight, 'there', c.value IS NOT NULL, 'object', {kind('c.value')} = 'object', 'raw', {taken}, 'why', {at('c.value', ('reason',))})"
    rows = _with(rows, {"__fields": f"transform(__read, c -> {fields})"})
    score = f"CASE WHEN c.object THEN {_score('c.raw', kind('c.raw'))} END"
    reason = f"IF({kind('c.why')} = 'string', try_variant_get(c.why, '$', 'string'), NULL)"
    rows = _with(rows, {"__scored": f"transform(__fields, c -> named_struct('criterion', c.criterion, 'score', {score}, 'reason', {reason}, 'weight', c.weight, 'there', c.there))"})
    rows = _with(rows, {"__bad": "array_position(transform(__scored, c -> c.there AND c.score IS NULL), true)"})
    open_ = "__kind = 'object' AND (__bad = 0 OR i + 1 < __bad) AND c.there"
    rows = _with(rows, {"__kept": f"filter(__scored, (c, i) -> coalesce({open_}, false))"})
    written = f"coalesce(c.reason RLIKE {quoted(_WRITTEN)} AND c.reason <> {quoted(fixed.DEFAULT_REASON)}, false)"
    rows = _with(rows, {
        "failed_judge_parse": f"__refused OR NOT forall(__kept, c -> {written})",
        "__total": "aggregate(__kept, 0.0D, (a, c) -> a + c.score * c.weight)", "__weight": "aggregate(__kept, 0.0D, (a, c) -> a + c.weight)",
    })
    listed = f"CAST(transform(__kept, c -> struct(c.criterion, c.score, c.reason, c.weight)) AS {SCORES_TYPE})"
    raw = f"IF({_OWN_ERROR}, coalesce({at('__v', ('raw_response',), 'string')}, ''), {name(answer)})"
    rows = _with(rows, {
        "criterion_scores": f"IF(failed_judge_parse, CAST(array() AS {SCORES_TYPE}), {listed})",
        "weighted_final_score": "CASE WHEN NOT failed_judge_parse THEN IF(__weight > 0, __total / __weight, 0.0D) END",
        "raw_response": f"IF(failed_judge_parse, {raw}, '')",
    })
    rows = rows.withColumn("passed", at_least(F.col("weighted_final_score"), pass_score))
    out = ["criterion_scores", "weighted_final_score", "passed", "failed_judge_parse", "raw_response"]
    return settled(rows.select(*df.columns, *out), out)


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({column: F.expr(e) for column, e in columns.items()})


def scores_long(judged: DataFrame, keys: list[str]) -> DataFrame:
    """One row per case and criterion."""
    return judged.select(*keys, F.explode("criterion_scores").alias("c")).select(*keys, "c.*")


def scores_wide(
    judged: DataFrame, keys: list[str], rubric: Rubric = fixed.RUBRIC_WEIGHTS
) -> DataFrame:
    """One row per case: final_score, flags, cut raw text and two columns per criterion."""
    columns = []
    for criterion, _ in rubric:
        own = f"get(filter(criterion_scores, c -> c.criterion = {quoted(criterion)}), 0)"
        columns.append(F.expr(f"{own}.score AS {name(criterion + '_score')}"))
        columns.append(F.expr(f"{own}.reason AS {name(criterion + '_reason')}"))
    raw = F.when(
        F.col("failed_judge_parse"), F.substring("raw_response", 1, fixed.RAW_RESPONSE_LIMIT)
    )
    return judged.select(
        *keys,
        F.col("weighted_final_score").alias("final_score"),
        "passed",
        "failed_judge_parse",
        raw.alias("raw_response"),
        *columns,
    )


def score_file_columns(wide: DataFrame) -> DataFrame:
    """The wide rows with ``final_score`` as written to score files: text on failure."""
    text = F.when(F.col("failed_judge_parse"), F.lit(fixed.PARSE_FAILED)).otherwise(
        F.col("final_score").cast("string")
    )
    return wide.withColumn("final_score", text)


def run_summary(
    judged: DataFrame,
    by: list[str] | None = None,
    score: str = "weighted_final_score",
    min_batch: int = fixed.MIN_BATCH,
    pass_score: float = fixed.PASS_SCORE,
) -> DataFrame:
    """Per run: cases, passes, pass rate, mean of the scores there are, parse failures, and
    the verdict (enough cases and a high enough mean). The mean of no scores is 0."""
    totals = judged.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if("passed").alias("passed_cases"),
        F.count_if("failed_judge_parse").alias("parse_failed_cases"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("average_score"),
    )
    n = F.col("total_cases")
    return totals.select(
        "*",
        F.when(n > 0, F.col("passed_cases") / n).alias("pass_rate"),
        (n < min_batch).alias("below_min_batch"),
        ((n >= min_batch) & at_least(F.col("average_score"), pass_score)).alias("accepted"),
    )


def score_distribution(long_scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cases per criterion and whole score."""
    return (
        long_scores.groupBy(*by, "criterion", F.floor("score").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
