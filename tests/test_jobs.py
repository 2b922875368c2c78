"""The jobs from files to files, readers, freeze and the stream."""

import csv
import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from msgwarden.functions import fixed_values as fixed
from msgwarden.functions.rules import NOGO_RULES, PII_RULES
from msgwarden.operators import agreement, freeze, gate, guardrails, judging, ruletables, runs
from msgwarden.operators.guardrails import CheckSettings
from msgwarden.plans import jobs
from msgwarden.plans.inputs import REPLY_SCHEMA
from msgwarden.sources import readers, writers
from msgwarden.streaming.checks import check_stream

CASES = [
    ["1", "intro", "context, met komma", 'Plan een "kort" gesprek,\nbel 06-12345678', "100", "garantie,gratis"],
    ["2", "followup", "context", "Kunt u dinsdag om 3 uur?", "3", ""],
    ["3", "meeting", "context", "We beloven niets", "", "niets"],
]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.fixture
def cases(tmp_path):
    path = tmp_path / "cases.csv"
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow("id phase input expected_output max_words no_go_terms".split())
        out.writerows(CASES)
    return str(path)


def test_read_cases(spark, cases):
    rows = readers.read_cases(spark, cases).orderBy("id").collect()
    assert rows[0].expected_output == CASES[0][3] and rows[0].max_words == 100 and rows[2].max_words is None
    assert rows[0].no_go_terms == "garantie,gratis" and rows[1].no_go_terms is None


def test_frozen_cases(spark, tmp_path):
    line = {"id": "1", "phase": "intro", "input": "i", "expected_output": "e", "max_words": "100", "no_go_terms": "a,b"}
    path = write(tmp_path / "f.jsonl", json.dumps(line) + "\n" + json.dumps({**line, "max_words": "veel"}))
    assert [r.max_words for r in readers.read_frozen_cases(spark, path).collect()] == [100, None]


def test_fallback_is_on_absent_columns(spark):
    both = spark.createDataFrame([("1", None, "b")], "id string, expected_output string, output string")
    assert readers.check_input(both).first().text is None
    one = spark.createDataFrame([("1", "b")], "id string, output string")
    assert readers.check_input(one).first().text == "b" and readers.check_input(one).first().phase == "unknown"
    none = spark.createDataFrame([(1,)], "x int")
    assert readers.check_input(none).first().text == ""
    assert readers.judge_input(spark.createDataFrame([("m",)], "message string")).first().output == "m"


def test_guardrail_job(spark, cases, tmp_path):
    schema = write(tmp_path / "schema.json", json.dumps(REPLY_SCHEMA))
    report = jobs.run_guardrails(spark, cases, str(tmp_path / "out" / "summary.csv")).first()
    assert (report.total_cases, report.passed, report.failed, report.cta_missing) == (3, 1, 2, 1)
    assert (report.pii_hits_total, report.nogo_hits_total, report.high_risk_leaks) == (1, 1, 1)
    detailed = [json.loads(x) for x in _lines(tmp_path / "out" / "summary_detailed.json")]
    first = next(r for r in detailed if r["case_id"] == "1")
    assert first["checks"]["pii_hits"] == [{"type": "phone", "matches": ["06-12345678"]}]
    assert first["severity"] == "fail" and set(first["checks"]) == {
        "json_valid", "json_errors", "length_ok", "length_over_by", "nogo_hits", "pii_hits", "cta_present", "policy_claims"
    }
    flat = spark.read.option("header", True).csv(str(tmp_path / "out" / "summary.csv"))
    assert flat.columns[:4] == ["case_id", "phase", "severity", "word_count"] and flat.count() == 3
    strict = jobs.run_guardrails(spark, cases, str(tmp_path / "out2" / "s.csv"), schema).first()
    assert strict.json_invalid == 3
    limited = jobs.run_guardrails(spark, cases, str(tmp_path / "out3" / "s"), settings=CheckSettings(max_words="max_words")).first()
    assert limited.length_violations == 1


def _lines(folder):
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            yield from (folder / name).read_text(encoding="utf-8").splitlines()


def test_report_paths_differ():
    for out in ("a/b.csv", "a/b.json", "a/b"):
        assert writers.report_paths(out) == ("a/b_detailed.json", "a/b.csv")


def _answer(score):
    return json.dumps({c: {"score": score, "reason": "r"} for c, _ in fixed.RUBRIC_WEIGHTS})


def test_judge_and_regression_jobs(spark, cases, tmp_path):
    table = readers.read_cases(spark, cases)
    answers = spark.createDataFrame([("1", _answer(4)), ("2", "stuk")], "id string, answer string")
    runs_path = str(tmp_path / "runs")
    a = jobs.score_judge_answers(spark, table, answers, str(tmp_path / "scores_V1.csv"), "r1", "V1", runs_path=runs_path).first()
    assert (a.total_cases, a.passed_cases, a.parse_failed_cases, a.average_score) == (3, 1, 2, 4.0)
    assert a.below_min_batch and not a.accepted
    better = spark.createDataFrame([(i, _answer(5)) for i in "123"], "id string, answer string")
    jobs.score_judge_answers(spark, table, better, str(tmp_path / "scores_V2.csv"), "r2", "V2", runs_path=runs_path)
    assert {(r.run_id, r.passed_cases) for r in spark.read.parquet(runs_path).collect()} == {("r1", 1), ("r2", 3)}
    text = spark.read.option("header", True).csv(str(tmp_path / "scores_V1.csv"))
    assert {r.case_id: r.final_score for r in text.collect()} == {"1": "4.0", "2": "PARSE_FAILED", "3": "PARSE_FAILED"}
    record = jobs.run_regression(spark, cases, str(tmp_path / "scores_V1.csv"), str(tmp_path / "scores_V2.csv"), str(tmp_path / "reg")).first()
    assert (record.variant_a.name, record.variant_b.name, record.score_improvement) == ("V1", "V2", 1.0)
    assert record.meets_promotion_threshold and record.improvement_percentage == 25.0 and record.parse_failure_delta == 2
    assert record.dataset.sha256 == hashlib.sha256(open(cases, "rb").read()).hexdigest()
    short = write(tmp_path / "short_V3.csv", "case_id,final_score,passed,failed_judge_parse\n1,4.0,True,False\n")
    with pytest.raises(ValueError):
        jobs.run_regression(spark, cases, str(tmp_path / "scores_V1.csv"), short, str(tmp_path / "x"))


def test_rubric_table_is_honoured(spark, tmp_path):
    path = write(tmp_path / "rubric.csv", 'criterion,weight,description\nstyle_match,0.75,"a, b"\npii_free,0.25,c\n')
    cases = spark.createDataFrame([("1", "i", "o")], "id string, input string, output string")
    answer = '{"style_match":{"score":4,"reason":"r"},"pii_free":{"score":0,"reason":"r"}}'
    answers = spark.createDataFrame([("1", answer)], "id string, answer string")
    got = jobs.score_judge_answers(spark, cases, answers, str(tmp_path / "s"), "r", "V", path).first()
    assert got.average_score == 3.0


def test_chain(spark, tmp_path):
    rows = [("1", "p", "i", "Plan a@b.nl"), ("2", "p", "i", "Plan een afspraak"), ("3", "p", "i", "ERROR: uitval")]
    generated = spark.createDataFrame(rows, "id string, phase string, input string, output string")
    answers = spark.createDataFrame([(i, _answer(4)) for i in "123"], "id string, answer string")
    report, held, summary = jobs.run_chain(spark, generated, answers, str(tmp_path / "chain"), "r1")
    assert report.first().total_cases == 2
    assert [(r.case_id, r.reason) for r in held.collect()] == [("1", "PII")]
    assert (summary.first().total_cases, summary.first().passed_cases) == (1, 1)


def test_agreement_job(spark, tmp_path):
    def document(pairs):
        items = [{"case_id": str(i), "model_scores": {"V1": "3.0"}, "model_passed": {"V1": False}, "parse_failed": {}, "human_scores": {"annotator_a": a, "annotator_b": b} if a is not None else {}, "notes": ""} for i, (a, b) in enumerate(pairs)]
        return json.dumps({"generated_at": "x", "items": items}, indent=2)

    path = write(tmp_path / "a.json", document([(1, 1), (1, 1), (2, 2), (2, 2), (3, 3), (3.4, 1), (None, None)]))
    report = jobs.run_agreement(spark, path, str(tmp_path / "out")).first()
    assert report.n_pairs == 6 and report.cohens_kappa == pytest.approx(0.75)
    stored = json.loads(next(iter(_lines(tmp_path / "out"))))
    assert stored["labels"] == [1, 2, 3] and stored["targets"]["kappa"] == ">=0.60"
    few = write(tmp_path / "b.json", document([(None, None)] * 30))
    assert jobs.run_agreement(spark, few, str(tmp_path / "none")).first().status == "insufficient"
    assert not (tmp_path / "none").exists()
    lines = write(tmp_path / "l.jsonl", "\n".join(json.dumps(i) for i in json.loads(document([(1, 2)]))["items"]))
    assert readers.read_annotation_lines(spark, lines).first().annotator_b == 2.0


def test_pairs(spark, tmp_path):
    path = write(tmp_path / "p.json", json.dumps({"pairs": [{"case_id": "1", "llm_score": 4.4, "human_score": 3.9}, {"case_id": "2", "llm_score": 1, "human_score": 4}]}))
    row = agreement.within_one(readers.read_pairs(spark, path), "llm_score", "human_score").first()
    assert (row.n_pairs, row.within_one) == (2, 0.5) and row.mae == pytest.approx(1.75)


def test_rules_from_table(spark):
    table = {r.label: r.pattern for r in NOGO_RULES}
    assert readers.rules_from_table(table) == NOGO_RULES
    pii_table = {r.label: r.pattern.replace("{11,30}", "{4,30}") for r in PII_RULES}
    assert readers.rules_from_table(pii_table) == PII_RULES
    own = readers.rules_from_table({"x": r"\b(a)b\b", "y": "c"})
    assert [(r.label, r.group) for r in own] == [("x", 1), ("y", 0)]


def test_hashes_inventory_and_manifest(spark, cases, tmp_path):
    digest = hashlib.sha256(open(cases, "rb").read()).hexdigest()
    assert freeze.file_hashes(spark, cases).first().sha256 == digest
    assert freeze.file_hashes(spark, cases, one_value=10).first().sha256 == digest
    missing = freeze.file_hashes(spark, str(tmp_path / "none")).first()
    assert missing.sha256 is None and missing.length is None
    assert freeze.inventory(spark, cases).first().bytes == os.path.getsize(cases)
    row = freeze.manifest(spark, {"c": (cases, readers.read_cases(spark, cases))}, "2025-01-01").first()
    assert (row.sha256, row.n_rows) == (digest, 3) and row.split == {"followup": 1, "intro": 1, "meeting": 1}


def test_manifests_of_files_and_groups(spark, tmp_path):
    def store(name, rows):
        (tmp_path / name).mkdir()
        for k in range(4):
            lines = [json.dumps(dict(zip(("id", "phase", "n"), r))) for r in rows[10 * k : 10 * k + 10]]
            write(tmp_path / name / f"{k}.json", "\n".join(lines))
        table = spark.read.schema("id string, phase string, n int").json(str(tmp_path / name))
        return freeze.manifest_rows(spark, {"d": (str(tmp_path / name), table)})

    rows = [(f"{i:02}", "ab"[i % 2], i) for i in range(40)]
    one, same = store("one", rows), store("two", rows)
    assert freeze.manifest_changes(one, same).collect() == []
    other = store("three", [*rows[:-2], ("38", "a", 99), ("40", "c", 1)])
    found = {(r.part, r.key, r.change) for r in freeze.manifest_changes(one, other).collect()}
    assert {x for x in found if x[0] != "file"} == {("group", "a", "changed"), ("group", "b", "changed"), ("group", "c", "added"), ("all", None, "changed")}
    assert {x[2] for x in found if x[0] == "file"} == {"changed"} and len([x for x in found if x[0] == "file"]) == 1
    kept = str(tmp_path / "kept")
    one.write.parquet(kept)
    assert freeze.manifest_changes(spark.read.parquet(kept), one).collect() == []
    lost = freeze.manifest_changes(one, one.where("part = 'file' OR key = 'a'")).collect()
    assert {(r.key, r.change, r.n_new) for r in lost} == {("b", "removed", None), (None, "removed", None)}
    several = freeze.manifest(spark, {"d": (str(tmp_path / "one"), spark.read.schema("phase string").json(str(tmp_path / "one")))}, "x").first()
    again = freeze.manifest(spark, {"d": (str(tmp_path / "two"), spark.read.schema("phase string").json(str(tmp_path / "two")))}, "x").first()
    assert several.sha256 == again.sha256 and several.n_rows == 40


def test_stored_checks_meet_their_cases_without_an_exchange(spark, tmp_path):
    rows = spark.range(2000).selectExpr("CAST(id AS STRING) AS case_id", "'p' AS phase", "IF(id % 5 = 0, 'bel 06-12345678', 'Kunt u bellen?') AS output")
    checks = guardrails.check_cases(rows, "output", "case_id", settings=CheckSettings(cta_required=False))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cases = writers.store_by_case(rows, "cases_by_case", str(tmp_path / "cases"), 4)
        checked = writers.store_by_case(checks, "checks_by_case", str(tmp_path / "checks"), 4)
        passed, held = gate.gate(cases, checked, "output"), gate.skipped(cases, checked, "output")
        for df, n in ((passed, 1600), (held, 400)):
            assert df.count() == n
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert gate.gate(rows, checks, "output").exceptAll(passed).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS cases_by_case")
        spark.sql("DROP TABLE IF EXISTS checks_by_case")


def test_rule_tables_of_any_size(spark):
    docs = spark.createDataFrame([(1, "Geld terug, geld weg"), (2, "niets"), (3, None), (None, "GELD")], "id int, text string")
    rules = spark.createDataFrame([("r1", "(?i)geld", "Geld"), ("r2", "(?i)geld terug", "terug"), ("r3", "n[a-z]+s", None), ("r4", "weg", "elders")], "rule string, pattern string, literal string")
    wanted = {(1, "r1", 2), (1, "r2", 1), (2, "r3", 1), (None, "r1", 1)}
    for sent in (10, 2):
        assert {tuple(r) for r in ruletables.rule_hits(docs, rules, "id", "text", sent).collect()} == wanted
        needed = rules.withColumn("also", F.when(F.col("rule") == "r1", F.array(F.lit("weg"))))
        assert {tuple(r) for r in ruletables.rule_hits(docs, needed, "id", "text", sent).collect()} == wanted - {(None, "r1", 1)}


def test_rules_of_two_words_meet_neighbours_only(spark):
    words = [f"w{i:03d}x" for i in range(120)]
    texts = [(1, " ".join(words)), (2, "bathe cat, the\U0001f680cat THE CAT the cat"), (3, "he cat\0he cat"), (4, "y lado, y lo the"), (5, None), (5, "cat")]
    docs = spark.createDataFrame([*texts, texts[1]], "id int, text string")
    pairs = [(a, b) for a in words[::3] for b in words[::2] if a != b] + [("he", "cat"), ("the", "cat"), ("y", "l")]
    rows = [(f"{a} {b}", f"(?i){a}[ ]{b}", None if a == "y" else max(a, b, key=len), [f"{a} {b}"]) for a, b in pairs]
    rules = spark.createDataFrame(rows, "rule string, pattern string, literal string, also array<string>")
    wanted = [
        (i, rule, len(found)) for i, text in [*texts, texts[1]] if text for rule, pattern, literal, also in rows
        if also[0] in text.lower() and (literal is None or literal in re.findall(r"\w+", text.lower())) and (found := re.findall(pattern, text))
    ]
    for sent in (10_000, 10):
        got = ruletables.rule_hits(docs.where("id <> 2") if sent == 10 else docs, rules, "id", "text", sent).collect()
        assert sorted(map(tuple, got)) == sorted(w for w in wanted if sent > 10 or w[0] != 2)
    low = docs.where("id = 1").selectExpr("id AS __key", "text AS __text", "lower(text) AS __low")
    index = rules.selectExpr("rule", "pattern", "coalesce(literal, '') AS __token", "also AS __also", "also[0] AS __seam")
    assert ruletables._by_seam(low, index).count() == sum(b == words[words.index(a) + 1] for a, b in pairs[:-3])


def test_strings_are_counted_where_they_meet_the_text(spark):
    texts = [(1, "the the the, the the. he the the"), (2, "He the THE theK the Kit"), (3, "bathe cat, the cat; İ the cat \\E"), (4, "kit kat KIT kat Kit kat"),
             (None, "the\ncat the  cat the cat"), (5, "a a a a\na a, a a"), (6, "cats"), (7, "the " * 50), (8, None)]
    rows = [("the the", "(?i)the[ ]the", "the"), ("he the", "(?i)he[ ]the", "the"), ("e cat", "(?i)e cat", "cat"), ("kit kat", "(?i)kit[ ]kat", "kat"), ("a a", "(?i)a a", "a"), ("the cat", "the cat", "cat"), ("a, a", "(?i)a,[ ]a", None)]
    rows = [(*r, [r[0]]) for r in rows] + [("gap", r"(?i)the\s+cat", "cat", ["cat the"]), ("both", "cat", "cat", ["the cat", "bathe", "\\e"]), ("none", None, "cat", ["the cat"]), ("null", "cat", "cat", ["the cat", None])]
    docs = spark.createDataFrame([*texts, *texts[:2]], "id int, text string")
    rules = spark.createDataFrame([*rows, rows[0]], "rule string, pattern string, literal string, also array<string>")
    wanted = [
        (i, rule, n) for i, text in [*texts, *texts[:2]] if text for rule, pattern, literal, also in [*rows, rows[0]] if pattern and None not in also
        and all(a in text.lower() for a in also) and (literal is None or literal in re.findall(r"\w+", text.lower())) and (n := len(re.findall(pattern, text, re.A)))
    ]
    assert sorted(map(str, ruletables.rule_hits(docs, rules, "id", "text").collect())) == sorted(f"Row(id={i}, rule={r!r}, n={n})" for i, r, n in wanted)
    # what is exploded is added up in the same generated code, or the rows of a text would pile up with copies of it
    rows = docs.selectExpr("id AS __key", "text AS __text", "lower(text) AS __low")
    found = ruletables._by_seam(rows, rules.selectExpr("rule", "pattern", "coalesce(literal, '') AS __token", "also AS __also", "also[0] AS __seam"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["__key", "rule", "n"] and "lambdafunction" not in plan[: plan.index("posexplode")]


def test_rubrics_as_a_table(spark):
    rubric = (("style_match", 0.3), ("policy_safety", 0.3), ("own", 1.0))
    answers = ['{"style_match": {"score": 4, "reason": "x"}, "own": {"score": "2", "reason": "y"}}', '{"own": 3}', '{"own": {"score": 3}}', "x", "[]", "{}", None,
               '{"style_match": {"score": null, "reason": "x"}, "own": {"score": 2, "reason": "y"}}', '{"error": 1, "parse_error": 2, "raw_response": "r"}']
    df = spark.createDataFrame([(i, a, "v") for i, a in enumerate(answers)], "id int, answer string, version string")
    table = spark.createDataFrame([("v", c, w) for c, w in reversed(rubric)] + [("w", "z", 1.0)], "version string, criterion string, weight double")
    one = judging.score_answers(df, "answer", rubric).orderBy("id").collect()
    assert judging.score_by_rubrics(df, table).orderBy("id").collect() == one
    lost = judging.score_by_rubrics(df.withColumn("version", F.lit("absent")), table)
    assert lost.where("failed_judge_parse AND weighted_final_score IS NULL AND NOT passed").count() == len(answers)
    many = spark.range(judging.MOST_CRITERIA + 1).selectExpr("'v' AS version", "CAST(id AS STRING) AS criterion", "1D AS weight")
    with pytest.raises(Exception, match="criteria"):
        judging.score_by_rubrics(df, many).collect()


def test_row_fingerprint(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("t"))
    mark = freeze.row_fingerprint(df).first()
    assert mark == freeze.row_fingerprint(df.orderBy(F.desc("id")).repartition(7)).first()
    assert mark != freeze.row_fingerprint(df.withColumn("t", F.coalesce("t", F.lit("")))).first()
    assert mark != freeze.row_fingerprint(df.union(df.limit(1))).first()


def test_run_table_masks_texts(spark, tmp_path):
    df = spark.createDataFrame([("r", "mail a@b.nl")], "run_id string, note string")
    runs.append_records(df, str(tmp_path / "t"))
    runs.append_records(df.withColumn("run_id", F.lit("s")), str(tmp_path / "t"))
    runs.append_records(df, str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t")).collect()
    assert sorted((r.run_id, r.note) for r in rows) == [("r", "mail [EMAIL_MASKED]"), ("s", "mail [EMAIL_MASKED]")]


def test_stream(spark, cases, tmp_path):
    readers.read_cases(spark, cases).write.parquet(str(tmp_path / "in"))
    messages = spark.readStream.schema(readers.CASES).parquet(str(tmp_path / "in"))
    stream = check_stream(messages, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    assert stream.awaitTermination(120)
    got = {r.case_id: r.severity for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": "fail", "2": "pass", "3": "fail"}


def test_csv_keeps_quotes_and_breaks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b", c\nd')], "id string, output string")
    writers.write_csv(df, str(tmp_path / "x"))
    assert readers.read_csv(spark, str(tmp_path / "x"), "id string").first().output == 'a "b", c\nd'


def test_a_repeated_job_leaves_one_run(spark, tmp_path):
    cases = spark.createDataFrame([("1", "in", "mail a@b.nl"), ("2", "in", "x")], "id string, input string, output string")
    answers = spark.createDataFrame([("1", '{"style_match":{"score":0,"reason":"r"}}'), ("2", "no json")], "id string, answer string")
    for _ in range(2):
        jobs.score_judge_answers(
            spark, cases, answers, str(tmp_path / "s"), "r1", "V1", runs_path=str(tmp_path / "runs"), cases_path=str(tmp_path / "cases"),
            multi_line=False, dataset_sha256="d",
        )
    run = spark.read.parquet(str(tmp_path / "runs")).collect()
    assert [(r.run_id, r.total_cases, r.dataset_sha256) for r in run] == [("r1", 2, "d")]
    assert run[0].tags[:3] == ["batch_evaluation", "variant_V1", "run_r1"] and run[0].duration_ms > 0 and run[0].started_at
    records = spark.read.parquet(str(tmp_path / "cases")).orderBy("case_id").collect()
    assert [(r.case_id, r.output_preview, r.tags[1]) for r in records] == [("1", "mail [EMAIL_MASKED]", "score_failed"), ("2", "x", "score_failed")]
