"""Worked examples and edge tables."""

import json

import pytest
from pyspark.sql import functions as F

from msgwarden.functions import jsoncheck, numbers, pii, wording
from msgwarden.operators import agreement, gate, guardrails, judging, metadata, regression, reports, runs
from msgwarden.operators.guardrails import CheckSettings
from msgwarden.plans.inputs import REPLY_SCHEMA

#: One text or more for each rule, with what masking makes of it.
MASKED = [
    ("t.o.n+x@a-b.c.io, Q_9%z@HOST.Museum; not@host, @x.nl", "[EMAIL_MASKED], [EMAIL_MASKED]; not@host, @x.nl"),
    ("0687654321/06 87654321", "[PHONE_MASKED]/[PHONE_MASKED]"),
    ("tel:+31687654321 tel +31687654321 x+31 6 87654321", "tel:+31687654321 tel +31687654321 x[PHONE_MASKED]"),
    ("030 7654321; 0316-765432; 0031-6-87654321", "[PHONE_MASKED]; [PHONE_MASKED]; [PHONE_MASKED]"),
    ("BE71096123456769 but not GB29NWBK60161", "[IBAN_MASKED] but not GB29NWBK60161"),
    ("see LinkedIn.com/in/a-b_c/ and http://www.linkedin.com/company/x9", "see [LINKEDIN_MASKED] and [LINKEDIN_MASKED]"),
    ("200000004 or 200000003", "[BSN_MASKED] or 200000003"),
    ("plates ZX987yw, Q1-234-AB", "plates [ID_MASKED], Q1-234-AB"),
    ("5500-0000 0000-0004 and 5500 0000 0000 000", "[CC_MASKED] and 5500 0000 0000 000"),
    ("hosts 8.8.4.4:53, 1.2.3, 999.1.1.1", "hosts [IP_MASKED]:53, 1.2.3, [IP_MASKED]"),
    ("pk-ABCDEFGHIJKLMNOPQRST apikey0123456789abcdefghij sk-tooshort", "[API_KEY_MASKED] [API_KEY_MASKED] sk-tooshort"),
    ("nothing of the kind: 12-34, a@b, c.d", "nothing of the kind: 12-34, a@b, c.d"),
]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_masks_of_every_rule(spark):
    df = frame(spark, MASKED, "text string, want string")
    for row in guardrails.mask_frame(df, "text").collect():
        assert row.masked_text == row.want


def test_bsn_rules(spark):
    df = frame(spark, [("123456789",), ("111222333",), ("000000000",)], "n string")
    checked = pii.with_bsn_valid(pii.with_bsn_valid(df, "n"), "n", "std", "standard")
    assert [(r.n, r.valid, r.std) for r in checked.collect()] == [
        ("123456789", True, False), ("111222333", False, True), ("000000000", True, True)
    ]


def test_length(spark):
    df = frame(spark, [(120,), (121,), (0,)], "n int")
    out = df.select(wording.over_by(F.col("n"), F.lit(120)).alias("a"), wording.over_by(F.col("n"), F.lit(0)).alias("b"), wording.over_by(F.col("n"), F.lit(None).cast("int")).alias("c"))
    assert [tuple(r) for r in out.collect()] == [(0, 0, 0), (1, 0, 0), (0, 0, 0)]


def test_severity_and_policy_labels(spark):
    df = frame(spark, [("1", "p", "Plan een afspraak"), ("2", "p", "Plan nu, hoi"), ("3", "p", "Goedemorgen"), ("4", "p", None)], "id string, phase string, t string")
    def verdicts(**kw):
        return [r.severity for r in guardrails.check_cases(df, "t", settings=CheckSettings(**kw)).orderBy("case_id").collect()]
    assert verdicts() == ["pass", "fail", "fail", "fail"]
    assert verdicts(policy_labels=("garantie",)) == ["pass", "warn", "fail", "fail"]
    assert verdicts(cta_required=False) == ["pass", "fail", "pass", "pass"]
    assert verdicts(cta_required=False, max_words=2) == ["fail", "fail", "pass", "pass"]
    assert verdicts(cta_required=False, json_schema=REPLY_SCHEMA) == ["fail"] * 4


def test_filter_on_result_runs_no_search_twice(spark):
    df = frame(spark, [("1", "p", "a@b.nl")], "id string, phase string, t string")
    failed = guardrails.check_cases(df, "t").where("severity = 'fail' AND case_id = '1'")
    plan = failed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_instr") <= 40 and failed.count() == 1


JSON = [
    ('{"a":1}', "object"), ('{"a":1} x', None), ('{"a":1}{"b":2}', None), ("[1],[2]", None), ("", None), (" ", None),
    ('"x"', "string"), ("null", "null"), ("5", "number"), ("true", "boolean"), ("[]", "array"), ('{"a":NaN}', "object"),
    ("-Infinity", "string"), ('{"a":"NaN, x","b":-Infinity}', "object"), ("{'a':1}", None), ('{"a":1,}', None), ("01", None),
    ('{"a":1,"a":2}', "object"), ('1,"x"]', None), (None, None),
]


def test_json_texts(spark):
    df = frame(spark, [(i, t) for i, (t, _) in enumerate(JSON)], "id int, t string").withColumn("v", jsoncheck.parse_json(F.col("t")))
    for row in df.select("id", F.expr(jsoncheck.kind("v")).alias("k"), F.try_variant_get("v", "$.a", "string").alias("a")).collect():
        assert row.k == JSON[row.id][1], JSON[row.id]
        if row.id == 17:
            assert row.a == "2"
        if row.id == 13:
            assert row.a == "NaN, x"


def test_schema_codes(spark):
    texts = [
        json.dumps({"message": "Een goed bericht", "cta": "", "next_step": "handover"}),
        json.dumps({"message": "kort", "cta": 5, "next_step": "x", "tone": "boos", "y": 1}),
        "[]",
        "geen json",
    ]
    df = frame(spark, [(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: sorted(r.json.errors) for r in guardrails.check_json(df, "t", REPLY_SCHEMA).collect()}
    assert got == {
        0: [],
        1: ["$.cta:type", "$.message:minLength", "$.next_step:enum", "$.tone:enum", "$:additionalProperties"],
        2: ["$:type"],
        3: ["$:json"],
    }
    with pytest.raises(ValueError):
        jsoncheck.schema_errors("v", {"type": "object", "pattern": "x"})


def test_numbers(spark):
    rows = [("5", 5.0), ("5d", None), ("0x1p3", None), (" 4.5 ", 4.5), ("1_000", 1000.0), ("1__0", None), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("", None), ("abc", None), ("inf", float("inf")), (None, None)]
    df = frame(spark, [(t,) for t, _ in rows], "t string")
    assert [r[0] for r in df.select(numbers.float_of("t")).collect()] == [w for _, w in rows]


def full(scores, reason="r"):
    names = ["style_match", "policy_safety", "pii_free", "structure_brevity", "personalization"]
    return json.dumps({n: {"score": s, "reason": reason} for n, s in zip(names, scores)})


# answer, weighted score, failed, number of criteria kept
ANSWERS = [
    (full([4, 5, 5, 4, 3]), 4.4, False, 5),
    (full([1, 5, 5, 1, 1]), 3.0, False, 5),
    (full([5, 4.5, 5, 5, 5]), 4.85, False, 5),
    ('{"style_match":{"score":4,"reason":"r"}}', 4.0, False, 1),
    ("{}", 0.0, False, 0),
    ("[]", 0.0, False, 0),
    ('["error","parse_error"]', None, True, 0),
    ("5", None, True, 0),
    ("true", None, True, 0),
    ("null", None, True, 0),
    ("geen json", None, True, 0),
    (full([4, 4, 4, 4, 4]) + " klaar", None, True, 0),
    ('"tekst"', 0.0, False, 0),
    ('"met parse_error"', None, True, 0),
    ('{"style_match":7,"pii_free":{"score":4,"reason":"r"}}', 0.0, False, 0),
    ('{"style_match":{"score":"5","reason":"r"}}', 5.0, False, 1),
    ('{"style_match":{"score":true,"reason":"r"}}', 1.0, False, 1),
    ('{"style_match":{"score":null,"reason":"r"}}', 0.0, False, 0),
    ('{"style_match":null}', 0.0, False, 0),
    ('{"style_match":{"score":4,"reason":"r"},"policy_safety":{"score":"x","reason":"r"},"pii_free":{"score":1,"reason":"r"}}', 4.0, False, 1),
    ('{"style_match":{"reason":"r"}}', 0.0, False, 1),
    ('{"style_match":{"score":4}}', None, True, 0),
    ('{"style_match":{"score":4,"reason":null}}', None, True, 0),
    ('{"style_match":{"score":4,"reason":"  "}}', None, True, 0),
    ('{"style_match":{"score":4,"reason":5}}', None, True, 0),
    ('{"style_match":{"score":4,"reason":"Geen reden gegeven"}}', None, True, 0),
    ('{"error":"x","parse_error":"y","raw_response":"ruw"}', None, True, 0),
    ('{"error":"x"}', 0.0, False, 0),
    (None, None, True, 0),
]


def test_answers(spark):
    df = frame(spark, [(i, a[0]) for i, a in enumerate(ANSWERS)], "id int, answer string")
    for row in judging.score_answers(df).collect():
        text, score, failed, n = ANSWERS[row.id]
        assert row.failed_judge_parse == failed, text
        assert (row.weighted_final_score is None) == (score is None), text
        if score is not None:
            assert row.weighted_final_score == pytest.approx(score, abs=1e-12), text
        assert row.passed == (score is not None and score >= 3.5)
        assert len(row.criterion_scores) == n
    raw = {r.id: r.raw_response for r in judging.score_answers(df).collect()}
    assert raw[26] == "ruw" and raw[10] == "geen json" and raw[0] == ""


def test_nan_score_never_passes(spark):
    df = frame(spark, [('{"style_match":{"score":NaN,"reason":"r"}}',)], "answer string")
    row = judging.score_answers(df).first()
    assert row.weighted_final_score != row.weighted_final_score and row.passed is False


def test_wide_and_file_form(spark):
    df = frame(spark, [("1", full([4, 5, 5, 4, 3])), ("2", "x" * 900)], "case_id string, answer string")
    wide = judging.scores_wide(judging.score_answers(df), ["case_id"])
    first, second = judging.score_file_columns(wide).orderBy("case_id").collect()
    assert (first.final_score, first.style_match_score, first.raw_response) == ("4.4", 4.0, None)
    assert (second.final_score, second.style_match_score, len(second.raw_response)) == ("PARSE_FAILED", None, 500)


def test_prompt(spark):
    df = frame(spark, [("in {model_output}", "uit {input_text}", None)], "i string, o string, n string")
    out = df.select(judging.prompt_column("A{input_text}B{model_output}{output_text}", F.col("i"), F.col("o")), judging.prompt_column("{input_text}|", F.col("n"), F.col("o"))).first()
    assert tuple(out) == ("Ain uit {input_text}Buit {input_text}{output_text}", "|")


def scores(spark, values):
    rows = [(str(i), v, "True" if v not in ("PARSE_FAILED", "", None) and float(v) >= 3.5 else "False", str(v == "PARSE_FAILED")) for i, v in enumerate(values)]
    return frame(spark, rows, "case_id string, final_score string, passed string, failed_judge_parse string")


def test_regression_rules(spark):
    def compare(a, b, **kw):
        return regression.compare(scores(spark, a), scores(spark, b), **kw).first()
    up = compare(["4.4", "4.4"], ["4.7", "4.7"])
    assert up.meets_promotion_threshold and up.score_improvement == pytest.approx(0.3) and up.passed_b == 2
    same = compare(["4.4"], ["4.4"])
    assert not same.meets_promotion_threshold and same.score_improvement == 0
    mixed = ["PARSE_FAILED", "3.0", "", None]
    assert compare(mixed, mixed, count_failures_in="usable").parse_failed_a == 0
    every = compare(mixed, mixed)
    assert (every.parse_failed_a, every.avg_a, every.rows_a) == (1, 3.0, 4)
    nan = compare(["1.0", "1.0"], ["nan", "5.0"])
    assert nan.avg_b != nan.avg_b and not nan.meets_promotion_threshold
    none = compare(["PARSE_FAILED"], ["4.0", "4.0"])
    assert (none.avg_a, none.improvement_percentage, none.rows_differ) == (0.0, 0.0, True)
    worse = compare(["1.0", "1.0"], ["5.0", "PARSE_FAILED"])
    assert not worse.meets_promotion_threshold


def test_variant_names(spark):
    names = [("out/scores_V2.csv", "V2"), ("scores.csv", "A"), ("a_b/run_1_2.tar.gz", "2.tar"), ("x_", ""), (".hid_x", "x")]
    for path, want in names:
        assert regression.variant_name(path, "A") == want
    df = frame(spark, [(p,) for p, _ in names], "p string")
    assert [r[0] for r in df.select(regression.variant_name_column(F.col("p"), "A")).collect()] == [w for _, w in names]


def test_by_case_keeps_every_id(spark):
    a, b = scores(spark, ["1.0", "2.0"]), scores(spark, ["3.0", "4.0", "5.0"])
    got = {r.case_id: (r.delta, r.found_in) for r in regression.by_case(a, b.unionByName(b)).collect()}
    assert got == {"0": (2.0, "both"), "1": (2.0, "both"), "2": (None, "only_b")}


def test_bootstrap_centres_on_the_mean(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("case_id"), (F.col("id") % 5 - 1.0).alias("delta"))
    rows = regression.bootstrap(df, 200).collect()
    means = sorted(r.mean_delta for r in rows)
    assert len(rows) == 200 and means[4] < 1.0 < means[-5] and 0.9 < sum(means) / 200 < 1.1
    assert all(1700 < r.weight < 2300 for r in rows)
    again = regression.bootstrap(df.coalesce(1), 200).collect()
    assert {r.replicate: r.weight for r in rows} == {r.replicate: r.weight for r in again}


def kappa(spark, pairs):
    pairs = [tuple(None if v is None else float(v) for v in p) for p in pairs]
    df = frame(spark, pairs, "a double, b double")
    return agreement.kappa_report(df, "a", "b").first()


def test_kappa(spark):
    k = kappa(spark, list(zip([1, 1, 2, 2, 3, 3], [1, 1, 2, 2, 3, 1])))
    assert (k.observed_agreement, k.expected_agreement, k.cohens_kappa) == pytest.approx((5 / 6, 1 / 3, 0.75))
    assert k.labels == [1, 2, 3] and k.n_pairs == 6
    assert kappa(spark, [(2.0, 2.0)] * 6).cohens_kappa == 1.0
    assert kappa(spark, [(float(i), float(i)) for i in range(6)]).cohens_kappa == pytest.approx(1.0)
    few = kappa(spark, [(1.0, 1.0)] * 4 + [(None, 1.0)])
    assert (few.status, few.n_pairs, few.cohens_kappa) == ("insufficient", 4, None)
    half = kappa(spark, [(0.5, 0.0), (1.5, 2.0), (2.5, 2.0), (3.5, 4.0), (4.5, 4.0)])
    assert half.observed_agreement == 1.0
    assert kappa(spark, [(0.0, 1.0)] * 6).cohens_kappa == 0.0


def test_percentiles(spark):
    df = frame(spark, [(1.0,), (2.0,), (10.0,), (None,), (float("nan"),)], "v double")
    got = {r.point: r.percentile for r in reports.percentiles(df, "v").collect()}
    assert got == pytest.approx({0.5: 2.0, 0.95: 9.2, 0.99: 9.84})


@pytest.mark.parametrize("n", [1, 2, 17, 999, 20_000])
def test_percentiles_of_skewed_groups(spark, n):
    import numpy as np

    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 2).cast("string")).alias("g"),
        F.when(F.col("id") % 3 == 0, 7.25).otherwise((F.col("id") * 7919 % 1009) * 1.0).alias("v"),
    )
    rows = df.toPandas()
    for r in reports.percentiles(df, "v", (0.0, 0.5, 0.95, 1.0), ("g",), accuracy=1000).collect():
        mine = rows[rows.g.isna()] if r.g is None else rows[rows.g == r.g]
        assert r.percentile == pytest.approx(float(np.quantile(mine.v, r.point)))


def test_report_of_nothing(spark):
    df = frame(spark, [], "id string, phase string, expected_output string")
    row = reports.batch_report(guardrails.case_summary(df)).first()
    assert (row.total_cases, row.pii_hits_total, row.pii_clean_rate, row.accepted) == (0, 0, None, False)


def test_gate(spark):
    cases = frame(spark, [("1", "p", "Plan a@b.nl"), ("2", "p", "Plan nu"), ("3", "p", "ERROR: x"), ("4", "p", "niet gecontroleerd"), ("5", "p", "Plan")], "case_id string, phase string, t string")
    checked = guardrails.check_cases(cases.where("case_id < '3'"), "t", "case_id")
    assert [r.case_id for r in gate.gate(cases, checked, "t").orderBy("case_id").collect()] == ["2", "4", "5"]
    assert [(r.case_id, r.reason) for r in gate.skipped(cases, checked, "t").collect()] == [("1", "PII")]
    twice = checked.withColumn("n", F.lit(1)).unionByName(
        checked.where("case_id = '2'").withColumn("case_id", F.lit("1")).withColumn("n", F.lit(2))
    )
    assert gate.hard_fails(twice).count() == 1 and gate.hard_fails(twice, "n").count() == 0


def test_deep_mask(spark):
    df = frame(spark, [(("a@b.nl", [("c@d.nl",)], ["e@f.nl"], {"k": "g@h.nl"}, 5, None),)], "m struct<s:string,l:array<struct<x:string>>,p:array<string>,d:map<string,string>,n:int,z:struct<q:string>>")
    both = metadata.mask_record(df).first().m
    assert (both.s, both.l[0].x, both.p, both.d, both.n, both.z) == ("[EMAIL_MASKED]", "[EMAIL_MASKED]", ["[EMAIL_MASKED]"], {"k": "[EMAIL_MASKED]"}, 5, None)
    assert metadata.mask_record(df, in_lists=False).first().m.p == ["e@f.nl"]


def test_preview_hides_cut_numbers(spark):
    text = "x" * 90 + " 06-12345678 " + "y" * 50
    df = frame(spark, [(text,)], "t string")
    assert "06-" not in metadata.with_preview(df, "t").first().preview
    assert "06-123456" in metadata.with_preview(df, "t", mask_first=False).first().preview


def test_run_log(spark):
    line = "2025-01-01 14:10 CEST | run_id=run_1 | variant=V1 | parse_failed=16 | delta=-0.03 | promotion=false"
    row = runs.parse_run_log(frame(spark, [(line,), ("",)], "value string")).collect()
    assert len(row) == 1 and row[0].logged_at == "2025-01-01 14:10 CEST"
    assert (row[0].run_id, row[0].variant, row[0].parse_failed, row[0].fields["delta"]) == ("run_1", "V1", 16, "-0.03")


def test_own_terms(spark):
    df = frame(spark, [("Een Garantie", " garantie ,x,"), ("niets", None)], "t string, terms string")
    got = [r[0] for r in df.select(wording.term_hits(F.col("t"), F.col("terms"))).collect()]
    assert got == [["garantie"], []]


def test_rounding_agrees_with_exact_values(spark):
    values = [4.4145, 2.2825, 0.5555, 0.0005, 0.0015, 2.5, 1.0005, -4.4145, -0.0625, 0.0625, 3.1415926, 0.0, 123456.7895, 1e-9, 2.675]
    values += [k / 2000 for k in range(1, 4000, 7)] + [-k / 400 for k in range(1, 4000, 13)]
    df = frame(spark, [(v,) for v in values], "v double")
    for digits in (2, 3):
        got = df.select("v", regression.round_half_even(F.col("v"), digits).alias("r")).collect()
        assert [(r.v, r.r) for r in got] == [(r.v, round(r.v, digits)) for r in got]
    odd = frame(spark, [(float("nan"),), (float("inf"),), (None,)], "v double").select(regression.round_half_even(F.col("v"), 3).alias("r")).collect()
    assert str(odd[0].r) == "nan" and odd[1].r == float("inf") and odd[2].r is None


def test_json_checks_refuse_a_session_without_its_setting(spark):
    spark.conf.set(jsoncheck.DUPLICATE_KEYS_CONF, "false")
    try:
        with pytest.raises(ValueError):
            jsoncheck.parse_json(F.col("x"))
    finally:
        spark.conf.set(jsoncheck.DUPLICATE_KEYS_CONF, "true")


def test_gate_in_one_pass(spark, tmp_path):
    rows = [("1", "Plan: mail x@y.nl"), ("2", "Plan"), ("3", "ERROR: none"), ("4", None)]
    path = str(tmp_path / "cases")
    frame(spark, rows, "case_id string, text string").write.parquet(path)
    cases = spark.read.parquet(path)
    got = gate.gate_rows(cases, "text")
    assert sorted((r.case_id, r.reason) for r in got.collect()) == [("1", "PII"), ("2", None), ("4", None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1
    assert "StringStartsWith(text,ERROR:)" in gate.without_errors(cases, "text")._jdf.queryExecution().executedPlan().toString()


def test_tables_are_read_in_their_splits(spark, tmp_path):
    from msgwarden.sources.readers import read_table

    path = str(tmp_path / "t")
    spark.range(10).coalesce(1).write.parquet(path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(read_table(spark, path)) and "RoundRobin" in plan(read_table(spark, path, spread=4))


def test_rubric_order_does_not_follow_the_rows(spark):
    rows = [("zeal", 0.1), ("pii_free", 0.2), ("style_match", 0.3), ("care", 0.4)]
    df = frame(spark, rows, "criterion string, weight double")
    assert [c for c, _ in judging.rubric_of(df)] == [c for c, _ in judging.rubric_of(df.orderBy("weight"))] == ["style_match", "pii_free", "care", "zeal"]


def test_repeated_scores_count_once(spark):
    judge = frame(spark, [("1", "c", 4.0)] * 3 + [("2", "c", 1.0), (None, "c", 1.0)], "case_id string, criterion string, score double")
    human = frame(spark, [("1", "c", 3.0)] * 3 + [("2", "c", 4.0), ("3", "c", 1.0)], "case_id string, criterion string, score double")
    row = agreement.calibration(judge, human).first()
    assert (row.n_pairs, row.within_one, row.mae) == (2, 0.5, 2.0)


def test_bootstrap_of_deltas_is_distributed_as_that_of_cases(spark):
    import numpy as np

    for n in (3, 40, 4000):  # few equal deltas, drawn exactly, and many
        paired = spark.range(6 * n).selectExpr("CAST(id AS STRING) AS case_id", "IF(id = 0, NULL, CAST(id % 3 AS DOUBLE) / 10 - 0.1) AS delta")
        of_cases, of_deltas = (f(paired, 1500).toPandas() for f in (regression.bootstrap, regression.bootstrap_of_deltas))
        assert len(of_deltas) == 1500
        for column in ("weight", "mean_delta"):
            a, b = of_cases[column].astype(float), of_deltas[column].astype(float)
            spread = a.std() / np.sqrt(1500)
            assert abs(a.mean() - b.mean()) < 6 * spread and 0.85 < a.std() / b.std() < 1.18
            grid = np.quantile(np.concatenate([a, b]), np.linspace(0.02, 0.98, 25))
            assert max(abs((a <= x).mean() - (b <= x).mean()) for x in grid) < 0.075
