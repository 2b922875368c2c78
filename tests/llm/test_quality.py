"""Quality rules against a plain count, and the bands at their edges."""

import random
import re

from msgwarden.llm import quality as q
from msgwarden.llm.catalog import op2_quality_rules


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(5)}
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if len(docs[r.doc_id]) < 6000:
            assert tuple(r)[1:7] == plain(docs[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_long_texts_take_the_same_rule(monkeypatch):
    random.seed(3)
    words = [random.choice([b"a", b"b", b"c", b"dd", b"e", b"f"]) for _ in range(900)]
    short = q.repeated_words(words)
    monkeypatch.setattr(q, "_TUPLES_UPTO", 0)
    assert short == q.repeated_words(words) == plain(b" ".join(words).decode())[4]


def test_bands(spark):
    random.seed(1)
    noise = " ".join("".join(random.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=60)) for _ in range(80))
    prose = " ".join("".join(random.choices(["an", "ther", "ing", "ou", "ed", "th", "s", "la"], k=random.randint(1, 3))) for _ in range(1800))
    loop = " ".join(f"{i % 40} of {i}" for i in range(4000))
    half = prose[:8192] + noise
    docs = [(1, noise, 0), (2, prose, 0), (3, loop, 0), (4, half, 0), (5, None, 0), (6, "", 0), (7, " \n", 0), (None, prose, 0), (2, prose, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept int")
    rows = sorted((r.doc_id or 0, r.kept) for r in q.quality(df).collect())
    assert rows == [(0, True), (1, False), (2, True), (2, True), (3, False), (4, False), (5, False), (6, False), (7, False)]
    kept = q.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 2]
    assert q.quality(df.limit(0)).collect() == []
