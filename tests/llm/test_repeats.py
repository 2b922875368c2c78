"""Repeated strings against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np

from msgwarden.llm import repeats as r
from msgwarden.llm.catalog import op7_suffix_dedup


def plain(docs, length):
    raws = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    rows = []
    for (doc_id, _), b in zip(docs, raws):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int(((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()) if len(gone) else 0)
        rows.append((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=lambda x: (x[0] is None, x))


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda x: (x[0] is None, x))


def corpus(seed, length):
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdeé", k=random.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(6)]
    docs = []
    for i in range(120):
        text = prose(random.randrange(120))
        for _ in range(random.randrange(3)):
            p = random.choice(shared)
            at, cut = random.randrange(len(text) + 1), random.randrange(len(p))
            text = text[:at] + p[cut : cut + random.randrange(length * 3)] + text[at:]
        docs.append((i, text))
    near = prose(150)
    for i in range(30):
        at = random.randrange(len(near))
        docs.append((200 + i, near[:at] + word() + near[at + 3 :]))
    docs += [(300 + i, near) for i in range(9)] + [(400, "ab" * 700), (401, "x" * 900), (402, "ab" * 700 + "y"), (403, prose(30) * 9)]
    docs += [(500, None), (501, ""), (None, prose(99)), (0, docs[0][1]), (502, "\0" * 300), (503, "short")]
    return docs


def test_query(spark, sf_dir):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op7_suffix_dedup(spark, sf_dir)) == plain(docs, r.LENGTH)


def test_corpora(spark):
    for seed, settings in ((1, {}), (2, {"longest": 37}), (3, {"crowded": 600}), (4, {"crowded": 0}), (5, {"crowded": 0, "longest": 61})):
        docs = corpus(seed, 50)
        df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_bytes int").repartition(3)
        assert got(r.repeats(df, length=50, gram=16, **settings)) == plain(docs, 50)
    assert r.repeats(df.limit(0)).collect() == []


def test_a_passage_in_many_surroundings(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, docs = letters(90), []
    for i in range(300):  # the passage is cut here and there, so that strings end in it and go on beyond it together
        a, b = rng.choice([0, 0, 0, rng.randrange(30)]), rng.choice([90, 90, 90, rng.randrange(60, 90)])
        docs.append((i, letters(rng.randrange(60)) + rng.choice(["", "xy", "xyz", "zzzzzzzz"]) + passage[a:b] + rng.choice(["", "uv", "uvw"]) + letters(rng.randrange(60))))
    docs += [(400 + i, "a" * (70 + i % 5) + letters(3)) for i in range(40)]  # the same gram at every place
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for crowded in (r.CROWDED, 2000, 0):
        assert got(r.repeats(df, length=50, gram=16, crowded=crowded)) == plain(docs, 50)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("llm_")]


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    docs = corpus(4, 50)
    rows = [(i, (t or "").encode()) for i, t in docs]
    parts = [p for block in r._blocks(rows, 50, 128) for p in block]
    whole = Counter((i, b[j : j + 50], j) for i, b in rows for j in range(len(b) - 49))
    assert whole == Counter((i, b[j : j + 50], at + j) for i, at, b in parts for j in range(len(b) - 49))


def test_run_index():
    random.seed(5)
    segments = ["".join(random.choices("ab", k=random.randrange(1, 60))).encode() for _ in range(60)] + [b"a" * 50, b"ab" * 40]
    index = r.RunIndex(segments)
    best = index.matching()
    suffixes = [(s, i) for s, text in enumerate(segments) for i in range(len(text))]
    for s, i in random.sample(suffixes, 300):
        own = segments[s][i:]
        longest = 0
        for t, j in suffixes:
            if (t, j) != (s, i):
                other = segments[t][j:]
                k = next((k for k, (x, y) in enumerate(zip(own, other)) if x != y), min(len(own), len(other)))
                longest = max(longest, k)
        assert best[index.starts[s] + i] == longest
    assert len(index.heads) < len(index.order)


def test_whole_characters_and_columns(spark):
    p = "é" * 40
    docs = [(1, "a" + p + "b", "en", 82), (2, "c" + p + "d", "en", 82), (3, None, "x", 0), (4, "alone", None, 5), (4, "alone", None, 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, t1 string, n_chars long")
    rows = r.without_repeats(df, chars_col="n_chars", length=50, gram=16)
    assert rows.columns == df.columns and rows.dtypes == df.dtypes
    assert sorted(map(tuple, rows.collect())) == [(1, "ab", "en", 2), (2, "cd", "en", 2), (3, None, "x", 0), (4, "alone", None, 5), (4, "alone", None, 5)]
    assert r._kept_text("aébc".encode(), [2], [4]) == "ac" and r._kept_text("éé".encode(), [1], [2]) == "é"
