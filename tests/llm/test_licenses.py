"""License scans against SQL, and template copies with words put in or left out."""

import random

import duckdb

from msgwarden.llm import licenses as lic
from msgwarden.llm.catalog import SQL, op10_license_scan
from msgwarden.llm.license_texts import NOTICES
from tests.compare import compare, connect


def test_query(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, "op10", op10_license_scan, SQL["op10_license_scan"]) == ""


def test_copies_and_edges(spark):
    random.seed(8)
    noise = lambda n: " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
    mit, bsd = NOTICES[0][1], next(t for label, t in NOTICES if label == "bsd-3-clause")
    words = bsd.split()
    docs = [
        (1, noise(40) + " " + mit + " " + noise(40), "mit", 1.0),
        (2, noise(9) + " " + " ".join(words[:40] + ["put", "in"] + words[40:70] + words[72:]), "bsd-3-clause", None),
        (3, " ".join(words[:30]), "", 0.0),
        (4, " ".join(words[i] + " " + noise(3) for i in range(len(words))), "", 0.0),
        (5, "MIT-LICENSE, mit license; GNU  general\npublic licenseé gnu general public license", "gpl,mit", 0.0),
        (6, None, "", 0.0), (7, "", "", 0.0), (None, "Released under the MIT License.", "mit", 1.0),
        (1, "é" * 5, "", 0.0), (1, "é" * 5, "", 0.0), (8, mit + noise(60) + mit, "mit", 1.0),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t, _, _ in docs], "doc_id long, text string, words string")
    got = lic.scan(df).collect()
    assert len(got) == len(docs)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for r, (i, text, labels, score) in zip(sorted(got, key=lambda r: key((r.doc_id, r.labels))), sorted(docs, key=lambda d: key((d[0], d[2])))):
        assert (r.doc_id, r.labels) == (i, labels)
        assert 0.7 <= r.score < 1 if score is None else r.score == score
    five = next(r for r in got if r.doc_id == 5)
    assert (five.n_words, five.n_base, five.first_word, five.last_word, five.base_labels) == (12, 3, 0, 8, "gpl,mit")
    assert lic.scan(df.limit(0)).collect() == []


def test_copies_close_together(spark, tmp_path):
    """Each notice twice, three and forty times, next to one another and with words between; operator and SQL."""
    docs = []
    for label, text in NOTICES:
        for between in (" ", " one two ", " 2025 a b c d e f g h i "):
            docs += [(label, 1.0, between.join([text] * n)) for n in (2, 3, 40)]
    docs += [
        ("all-rights-reserved", 1.0, "Copyright 2024 Foo. All rights reserved. Copyright 2025 Bar. All rights reserved."),
        ("cc-by-nc-4.0", 1.0, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0, Licensed under"),
        # no stretch of the span is a copy: the grams it needs are too far apart
        ("", 0.0, " ".join("reserved rights all" for _ in range(30))),
        ("mit", 0.0, "Released under the x x x x x x x x MIT License under the x x x x x x x x license"),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r for r in lic.scan(df).collect()}
    assert len(got) == len(docs)
    df.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert sorted(con.execute(lic.scan_sql()).fetchall()) == sorted(tuple(r) for r in got.values())
    for i, (label, score, text) in enumerate(docs):
        assert label in got[i].labels.split(",") and got[i].score == score, (label, text[:80], got[i])
