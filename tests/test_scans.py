"""Files that many tasks read: CSV with quoted line breaks, lists in one JSON document."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from msgwarden.sources import readers, scans


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fields(rng):
    parts = ["woord", "een, twee", 'zei "ja"', "\n", "\n\n", '"', '""', ",", "é😀", " ", "", "'", "\\", "5"]
    return "".join(rng.choices(parts, k=rng.randrange(8)))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_are_those_of_a_whole_read(spark, tmp_path, small_splits, end):
    rng = random.Random(3)
    folder = tmp_path / "cases"
    folder.mkdir()
    for part in range(3):
        with open(folder / f"{part}.csv", "w", newline="") as f:
            out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator=end)
            out.writerow(["id", "phase", "input", "expected_output", "max_words", "extra"])
            for i in range(300 if part else 1):
                out.writerow([f"{part}-{i}", fields(rng), fields(rng) * rng.choice([1, 1, 1, 40]), fields(rng), rng.choice(["", "7"]), fields(rng)])
    path = str(folder)
    assert scans.splits_of(spark, path)[0] > 8
    split, whole = readers.read_cases(spark, path), readers.read_cases(spark, path, "whole")
    assert split.schema == whole.schema
    rows = sorted(split.collect(), key=repr)
    assert len(rows) == 601 and rows == sorted(whole.collect(), key=repr)
    assert sum("\n" in (r.input or "") for r in rows) > 100


def test_csv_edges(spark, tmp_path):
    for text in ('id,phase\n"a\n\n\n', "id,phase\n", 'id,phase\n\n\n1,"x"\n \n2,y', 'id,"phase"\r\n"1","a\r\nb"\r\n'):
        (tmp_path / "one.csv").write_bytes(text.encode())
        split, whole = (readers.read_csv(spark, str(tmp_path / "one.csv"), "id string, phase string", m).collect() for m in (True, "whole"))
        if '"a\n' in text:  # a quote that is never closed holds the rest of the file, but for the last line break
            assert [r.id + "\n" for r in split] == [r.id for r in whole]
        else:
            assert split == whole


def strange(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choices(["}", "{", '"', "\\", "[", "]", ":", ",", "items", "\n", "é😀", "a"], k=rng.randrange(9)))
    if kind < 4:
        return rng.choice([None, True, 1, -2.5])
    if kind == 4:
        return [strange(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {f'k{i}"}}': strange(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("indent", [None, 2])
def test_items_of_one_document(spark, tmp_path, small_splits, indent):
    rng = random.Random(4)
    items = [{"n": i, "x": strange(rng), "y": {"items": [{"z": strange(rng)}]}} for i in range(400)]
    other = [{"n": -i, "x": strange(rng)} for i in range(30)]
    document = {"a": "items", "b}{": {"items": [{"n": 0}]}, "items": items, "n": [1, 2], "pairs": other, "none": [], "end": {"x": {}}}
    path = str(tmp_path / "one.json")
    with open(path, "w") as f:
        json.dump(document, f, indent=indent, ensure_ascii=False)
    pieces = scans.placed_lines(spark, path, "}")
    assert pieces.rdd.getNumPartitions() > 8
    for key, wanted in (("items", items), ("pairs", other), ("none", []), ("absent", []), ("n", [])):
        found = sorted((json.loads(r.item) for r in scans.json_items(pieces, key).collect()), key=lambda i: abs(i["n"]))
        assert found == wanted
    with open(path, "w") as f:
        json.dump(items, f, indent=indent)
    found = [json.loads(r.item) for r in scans.json_items(scans.placed_lines(spark, path, "}"), None).collect()]
    assert sorted(found, key=lambda i: i["n"]) == items


def test_annotations_and_pairs(spark, tmp_path):
    items = [{"case_id": str(i), "human_scores": {"annotator_a": i % 5, "annotator_b": "3"}, "notes": "a } b"} for i in range(20)]
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "items": items, "pairs": [{"case_id": "x", "llm_score": 1, "human_score": 2.5}]}))
    rows = readers.read_annotations(spark, str(tmp_path / "a.json")).orderBy(F.col("case_id").cast("int")).collect()
    assert [(r.case_id, r.annotator_a, r.annotator_b) for r in rows] == [(str(i), float(i % 5), 3.0) for i in range(20)]
    assert [tuple(r) for r in readers.read_pairs(spark, str(tmp_path / "a.json")).collect()] == [("x", 1.0, 2.5)]
